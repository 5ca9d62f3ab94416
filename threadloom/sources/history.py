"""Run history: an append-only JSON log and the questions asked of it."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.shuffles import lookup_join

RUN = (
    "run_id STRING, timestamp STRING, source STRING, conversation_title STRING, input_file STRING, "
    "output_dir STRING, artifacts ARRAY<STRING>, target STRING, use_llm BOOLEAN"
)
_FIELDS = [f.split()[0] for f in RUN.split(", ")]
_REQUIRED = _FIELDS[:7]
_COMMIT = "batch_id STRING, attempt_id STRING"


def append_history(runs: DataFrame, path: str) -> None:
    """Append runs, one JSON line each."""
    runs.select(*_FIELDS).write.mode("append").json(path, ignoreNullFields=False)


def write_attempt(runs: DataFrame, folder: str, batch: str) -> str:
    """Writes the runs of a batch where no reader sees them yet; the name of this attempt."""
    attempt = uuid.uuid4().hex
    runs.select(*_FIELDS).write.json(f"{folder}/runs/batch={quote(batch, safe='')}/attempt={attempt}", ignoreNullFields=False)
    return attempt


def commit_attempt(spark: SparkSession, folder: str, batch: str, attempt: str) -> None:
    """Makes an attempt visible: one small file, which appears at once or not at all."""
    marker = spark.createDataFrame([(batch, attempt)], _COMMIT).coalesce(1)
    marker.write.json(f"{folder}/commits/batch={quote(batch, safe='')}/attempt={attempt}")


def _commits(spark: SparkSession, folder: str) -> DataFrame | None:
    """(batch, attempt) that counts of every batch: of attempts that were all committed, the least by name."""
    try:
        marks = spark.read.schema(_COMMIT).json(f"{folder}/commits", recursiveFileLookup=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.groupBy(F.col("batch_id").alias("batch")).agg(F.min("attempt_id").alias("attempt"))


def append_batch(runs: DataFrame, folder: str, batch: str) -> None:
    """Appends a batch of runs to the log in ``folder``, once however often it is asked to.

    A batch that is there already is left alone. Jobs that append it at the same time each write their
    own attempt, of which readers take one; an attempt that failed before its commit is never read.
    """
    spark = runs.sparkSession
    done = _commits(spark, folder)
    if done is None or done.filter(F.col("batch") == batch).isEmpty():
        commit_attempt(spark, folder, batch, write_attempt(runs, folder, batch))


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of all committed batches with ``pos``; of runs that share an id the first, by batch and line, is taken."""
    lines = spark.read.text(f"{folder}/runs", recursiveFileLookup=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    part = lambda n: F.substring_index(F.element_at(parts, n), "=", -1)
    placed = lines.select(
        F.url_decode(F.url_decode(part(-3))).alias("batch"), part(-2).alias("attempt"),
        F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        F.col("value").alias("line"),
    )
    counted = lookup_join(placed, _commits(spark, folder), ["batch", "attempt"], "left_semi")
    runs = parse_history(counted.select(F.struct("batch", "at").alias("pos"), "line"))
    first = F.min_by(F.struct("pos", *_FIELDS), "pos").alias("r")
    return runs.groupBy("run_id").agg(first).select("r.*")


def parse_history(lines: DataFrame) -> DataFrame:
    """Lines to runs; malformed lines and lines with missing or unknown fields are skipped."""
    keys = F.json_object_keys("line")
    known = F.array(*[F.lit(f) for f in _FIELDS])
    required = F.array(*[F.lit(f) for f in _REQUIRED])
    sound = (F.size(F.array_except(keys, known)) == 0) & (F.size(F.array_except(required, keys)) == 0)
    kept = [c for c in lines.columns if c != "line"]
    runs = lines.filter(F.coalesce(sound, F.lit(False))).select(*kept, F.from_json("line", RUN).alias("r")).select(*kept, "r.*")
    return runs.withColumn("target", F.coalesce("target", F.lit("claude-code"))).withColumn("use_llm", F.coalesce("use_llm", F.lit(True)))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Runs with ``pos``, which orders the lines of a file; files are ordered by time of writing."""
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        ).alias("pos"),
        F.col("value").alias("line"),
    )
    return parse_history(lines)


def history_under_path(runs: DataFrame, directory: str) -> DataFrame:
    """Runs that wrote to the directory or below it; a sibling with the same prefix does not count."""
    base = directory.rstrip("/") or "/"
    target = F.regexp_replace("output_dir", "(.)/+$", "$1")
    below = F.lit(True) if base == "/" else (target == base) | target.startswith(base + "/")
    return runs.filter(below)


def recent_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs first."""
    return runs.orderBy(F.col("pos").desc()).limit(limit)


def history_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    """First run with the id."""
    return runs.filter(F.col("run_id") == run_id).orderBy("pos").limit(1)
