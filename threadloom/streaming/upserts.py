"""Micro-batches of fresh contexts merged into a saved snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.extraction import ITEM_COLUMNS
from threadloom.operators.maintenance import new_items, revised_decisions
from threadloom.streaming.snapshots import BucketedSnapshot


def upsert_items(saved: DataFrame, fresh: DataFrame, today: str, no_conflict: bool = False, key: str = "project_id", decision_key: str = "topic") -> tuple[DataFrame, DataFrame]:
    """(items, conflicts): saved items plus what the fresh ones add, and revised decisions to resolve.

    Added items sort behind the saved ones: their session number is one past the highest saved.
    """
    last = saved.groupBy(key).agg(F.max("ord.src").alias("_last"))
    o = F.col("ord")
    behind = F.struct((F.coalesce("_last", F.lit(-1)) + 1).alias("src"), *[o[c].alias(c) for c in ("seq", "sub", "kw", "pos")])
    added = new_items(saved, fresh, key, decision_key).join(last, key, "left").withColumn("ord", behind)
    first = fresh.join(saved.select(key).distinct(), key, "left_anti").filter("section = 'goal'")
    items = saved.select(key, *ITEM_COLUMNS).unionByName(added.select(key, *ITEM_COLUMNS)).unionByName(first.select(key, *ITEM_COLUMNS))
    conflicts = revised_decisions(saved, fresh, key).withColumn("detected_on", F.lit(today))
    return items, conflicts.filter(F.lit(not no_conflict))


def incremental_upsert(
    read_snapshot: Callable[[int], DataFrame], write_snapshot: Callable[[DataFrame, int], None], write_conflicts: Callable[[DataFrame, int], None], today: Callable[[], str], **options: str | bool
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for a stream of fresh items.

    ``read_snapshot(batch_id)`` gives the snapshot that the batch starts from and
    ``write_snapshot(items, batch_id)`` writes the one it ends with, each under its own version, so
    that a batch that is run again after a failure starts from the same snapshot.
    """

    def run(fresh: DataFrame, batch_id: int) -> None:
        items, conflicts = upsert_items(read_snapshot(batch_id), fresh, today(), **options)
        write_snapshot(items, batch_id)
        write_conflicts(conflicts, batch_id)

    return run


def bucketed_upsert(
    snapshot: BucketedSnapshot, write_conflicts: Callable[[DataFrame, int], None], today: Callable[[], str], stream: str, **options: str | bool
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for a stream of fresh items: reads and writes the buckets that a batch touches, no others.

    Batches are known by the name of their ``stream`` and their number: one that is run again after its
    commit changes nothing, one that failed before it starts anew from the same version. Conflicts are
    written before the commit, under the batch's number.
    """

    def run(fresh: DataFrame, batch_id: int) -> None:
        spark, token = fresh.sparkSession, f"{stream}/{batch_id}"
        if snapshot.latest(spark, token) is not None:
            return
        fresh = fresh.persist()  # its keys are read first, then its rows
        touched = snapshot.touched(fresh)
        saved = snapshot.read(spark, buckets=touched)
        items, conflicts = upsert_items(saved, fresh, today(), key=snapshot.key, **options)
        write_conflicts(conflicts, batch_id)
        snapshot.commit(items, token, touched)
        fresh.unpersist()

    return run
