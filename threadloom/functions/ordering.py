"""Numbering and top-k inside groups that may be far larger than one task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORD_TYPE = "struct<src:bigint,seq:bigint,sub:bigint,kw:bigint,pos:bigint>"


def ord_of(
    src: Column | int = 0,
    seq: Column | int = 0,
    sub: Column | int = 0,
    kw: Column | int = 0,
    pos: Column | int = 0,
) -> Column:
    """Sort key of an extracted item: session, message, kind, keyword, place in the message."""

    parts = {"src": src, "seq": seq, "sub": sub, "kw": kw, "pos": pos}
    columns = [(F.lit(v) if isinstance(v, int) else v).cast("bigint").alias(n) for n, v in parts.items()]
    return F.struct(*columns).cast(ORD_TYPE)


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def _offsets(counts: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Rows before each bucket, from the coarsest bucket level down."""
    outer, last = keys + levels[:-1], levels[-1]
    before = Window.partitionBy(*outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if len(levels) == 1:
        return inside.drop("_n")
    coarse = counts.groupBy(*outer).agg(F.sum("_n").alias("_n"))
    base = _offsets(coarse, keys, levels[:-1]).withColumnRenamed("_before", "_base")
    return (
        inside.alias("_inside")
        .join(base.alias("_outer"), _same("_inside", "_outer", outer))
        .select(
            *[F.col(f"_inside.{c}") for c in outer + [last]],
            (F.col("_inside._before") + F.col("_outer._base")).alias("_before"),
        )
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    buckets: Sequence[Column],
    name: str = "n",
) -> DataFrame:
    """1-based row numbers inside each key without sorting a whole key in one task.

    ``buckets`` are non-decreasing along ``order``, coarsest first, and small enough to sort one
    at a time. Rows are numbered inside their finest bucket and shifted by the number of rows in
    the buckets before it, which comes from an aggregate over the bucket counts alone.
    """
    keys = list(keys)
    levels = [f"_b{i}" for i in range(len(buckets))]
    bucketed = df.select("*", *[b.alias(level) for b, level in zip(buckets, levels)])
    counts = bucketed.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, keys, levels)
    inside = Window.partitionBy(*keys, *levels).orderBy(*order)
    return (
        bucketed.withColumn("_rank", F.row_number().over(inside))
        .alias("_ranked")
        .join(offsets.alias("_shift"), _same("_ranked", "_shift", keys + levels))
        .select(
            *[F.col(f"_ranked.{c}") for c in df.columns],
            (F.col("_ranked._rank") + F.col("_shift._before")).cast("bigint").alias(name),
        )
    )


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` at or before each row of its key, without sorting a whole key in one task.

    ``bucket`` is non-decreasing along ``order``: values are carried inside buckets, and from bucket to
    bucket by one row each.
    """
    keys = list(keys)
    bucketed = df.select("*", bucket.alias("_b"), value.alias("_v"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = bucketed.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    carried = ends.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    return (
        bucketed.withColumn("_inside", F.last("_v", ignorenulls=True).over(inside))
        .alias("_rows")
        .join(carried.alias("_ends"), _same("_rows", "_ends", [*keys, "_b"]))
        .select(*[F.col(f"_rows.{c}") for c in df.columns], F.coalesce("_rows._inside", "_ends._carried").alias(name))
    )


def ord_buckets(column: str = "ord", width: int = 4096) -> list[Column]:
    """Buckets for item order keys: blocks of sessions, one session, blocks of its messages."""
    o = F.col(column)
    return [
        F.floor(o["src"] / width),
        o["src"],
        F.floor(o["seq"] / width),
    ]


def top_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt: Column | None = None,
    name: str = "rank",
) -> DataFrame:
    """First ``k`` rows of every key.

    Spark limits each group on the map side for small ``k``. For larger ``k`` pass ``salt``: the
    key is first cut down in salted slices, so that no task sees more than a slice of it.
    """
    if salt is not None:
        slice_window = Window.partitionBy(*keys, F.col("_salt")).orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(128)))
            .withColumn("_slice_rank", F.row_number().over(slice_window))
            .filter(F.col("_slice_rank") <= k)
            .drop("_salt", "_slice_rank")
        )
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)
