"""Versions of a table kept in hash buckets: a new version writes the buckets it changes and shares the others.

``data/version=V/bucket=B`` holds what version V wrote of a bucket. ``manifest/version=V`` is one small
file: for every bucket the version that wrote it last, the table's schema, and the token of the batch
that made the version. A version exists once that file does, which the file system makes appear at
once; what a failed run left in ``data`` is written over by the next one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
_MANIFEST = "bucket INT, written INT, schema STRING, token STRING"
_HEAD = -1  # the manifest row that carries schema and token


class BucketedSnapshot:
    """One writer at a time, any number of readers; a reader keeps the version it asked for."""

    def __init__(self, folder: str, key: str = "project_id", buckets: int = BUCKETS):
        self.folder, self.key, self.buckets = folder.rstrip("/"), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _manifests(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(f"{_MANIFEST}, version INT").parquet(f"{self.folder}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def latest(self, spark: SparkSession, token: str | None = None) -> int | None:
        """The newest version, or the one that the batch with ``token`` made; None where there is none."""
        manifests = self._manifests(spark)
        if manifests is None:
            return None
        heads = manifests.filter(F.col("bucket") == _HEAD)
        return (heads if token is None else heads.filter(F.col("token") == token)).agg(F.max("version")).first()[0]

    def manifest(self, spark: SparkSession, version: int) -> tuple[dict[int, int], T.StructType]:
        """({bucket: version that wrote it}, schema) of a version: a row for each bucket, whatever the table's size."""
        rows = self._manifests(spark).filter(F.col("version") == version).collect()
        schema = next(r.schema for r in rows if r.bucket == _HEAD)
        return {r.bucket: r.written for r in rows if r.bucket != _HEAD}, T.StructType.fromJson(json.loads(schema))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys in ``rows``."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, spark: SparkSession, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A version's rows, of all buckets or of some, from the files of these buckets alone."""
        version = self.latest(spark) if version is None else version
        written, schema = self.manifest(spark, version)
        wanted = written if buckets is None else [b for b in buckets if b in written]
        paths = [f"{self.folder}/data/version={written[b]}/bucket={b}" for b in wanted]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame, token: str, touched: Iterable[int] | None = None) -> int:
        """Makes a version in which ``touched`` buckets (all, if not given) hold ``rows`` alone; its number.

        A batch that is run again, known by its token, changes nothing.
        """
        spark = rows.sparkSession
        done = self.latest(spark, token)
        if done is not None:
            return done
        base = self.latest(spark)
        version = 0 if base is None else base + 1
        placed = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")  # splits a hot bucket, joins small ones
        data = f"{self.folder}/data/version={version}"
        placed.write.mode("overwrite").partitionBy("bucket").parquet(data)
        kept = {} if base is None or touched is None else {b: v for b, v in self.manifest(spark, base)[0].items() if b not in set(touched)}
        present = spark.read.schema("bucket INT").parquet(data).select("bucket").distinct().collect()
        entries = [(b, v, None, None) for b, v in (kept | {r.bucket: version for r in present}).items()]
        head = (_HEAD, version, rows.schema.json(), token)
        spark.createDataFrame([head, *entries], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        return version
