"""Tables written in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A folder of this machine serves a local session without that setting (a test); any other
    session must name one, as its executors cannot see this machine's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir()


def run_folder(spark: SparkSession) -> str:
    """Fresh folder for the output of one run, below the shared folder."""
    return f"{shared_folder(spark)}/threadloom-run-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a compressed table in the shared folder and reads it back.

    Cuts lineage like a checkpoint, but in columns: narrow tables of numbers take a fraction of a
    checkpoint's space. Survives the loss of any executor.
    """
    spark = df.sparkSession
    folder = f"{run_folder(spark)}/table"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
