"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the id as text leaves ``fold`` when divided by ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int, fold: int, doc_id: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(_text, _label, *extra) of at most ``rows`` labelled documents outside the held-out fold.

    The ids with the least hashes are taken, so the sample does not depend on partitions. Ids labelled
    more than once take the greatest label; null labels and ids are left out. Of rows that share an id the
    one with the least hash of its text is taken.
    """
    ids = (
        labels.select(F.col("doc_id").alias("_doc"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_doc").isNotNull() & F.col("_label").isNotNull() & ~held_out("_doc", folds, fold))
        .groupBy("_doc")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_doc"), "_doc")
        .limit(rows)
    )
    chosen = F.broadcast(ids)  # two numbers for each of at most ``rows`` rows
    joined = docs.join(chosen, F.col(doc_id) == F.col("_doc"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("_text"), *extra)).alias("one")
    return joined.groupBy("_doc", "_label").agg(one).select("one._text", "_label", *[f"one.{c}" for c in extra])
