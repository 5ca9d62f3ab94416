"""Merging the contexts of several sessions into one per project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.shuffles import lookup_join
from threadloom.operators.extraction import ITEM_COLUMNS


def _whole(df: DataFrame, without: Sequence[str] = ()) -> Column:
    return F.struct(*[c for c in df.columns if c not in without])


def last_non_empty(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Value of the last row, per key, that has one."""
    filled = df.filter(~T.is_blank(F.col(value)))
    return filled.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def merge_maps(df: DataFrame, keys: Sequence[str], maps: str, order: str) -> DataFrame:
    """(keys, entry, value, first_at): the last map to hold an entry sets its value, the first its place."""
    rows = df.select(*keys, F.col(order).alias("_at"), F.posexplode(maps).alias("_pos", "entry", "value"))
    return rows.groupBy(*keys, "entry").agg(
        F.max_by("value", "_at").alias("value"), F.min(F.struct("_at", "_pos")).alias("first_at")
    )


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row of every key."""
    first = F.min_by(_whole(df, keys), F.col(order)).alias("r")
    return df.groupBy(*keys).agg(first).select(*keys, "r.*")


def ordered_union(parts: Sequence[DataFrame], keys: Sequence[str], text: str, order: str) -> DataFrame:
    """All rows of the parts in order, the first of each entry only; entries match by folded text."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return dedup_first(rows.withColumn("_key", T.fold(F.col(text))), [*keys, "_key"], order).drop("_key")


def promote_done(tasks: DataFrame, keys: Sequence[str], title: str, order: str) -> DataFrame:
    """One row per task title: the last done row where there is one, else the first; ``first_at``
    is the place of the first."""
    whole = _whole(tasks, keys)
    return (
        tasks.groupBy(*keys, T.fold(F.col(title)).alias("_title"))
        .agg(
            F.coalesce(F.max_by(F.when(F.col("done"), whole), F.when(F.col("done"), F.col(order))), F.min_by(whole, F.col(order))).alias("r"),
            F.min(order).alias("first_at"),
        )
        .select(*keys, "r.*", "first_at")
    )


def _with_session(session: str) -> Column:
    """Item order inside a merged context: session first, then the item's own order."""
    o = F.col("ord")
    return F.struct(
        F.col(session).cast("bigint").alias("src"), *[o[c].alias(c) for c in ("seq", "sub", "kw", "pos")]
    )


def merge_contexts(
    items: DataFrame, keys: Sequence[str] = ("project_id",), session: str = "session_ord"
) -> DataFrame:
    """Items of all sessions of a project merged: the last goal and technology win, decisions, tasks
    and list entries appear once, a task is done when any session says so.

    One aggregate on (project, section, item). A project with a single session stays as it is.
    """
    spans = items.groupBy(*keys).agg(F.min(session).alias("_lo"), F.max(session).alias("_hi"))
    rows = lookup_join(items, spans, list(keys))
    section, text = F.col("section"), F.col("text")
    entry = (
        F.when(section == "goal", "")
        .when(section == "tech_stack", F.col("label"))
        .when(section == "decision", F.concat_ws("\x00", T.fold(F.col("label")), T.fold(text)))
        .otherwise(T.fold(text))
    )
    alone = F.when(F.col("_lo") == F.col("_hi"), F.to_json("ord")).otherwise("")
    ranked = rows.filter((section != "goal") | (text != "")).select(
        *keys, "section", entry.alias("_entry"), alone.alias("_alone"), _with_session(session).alias("ord"),
        F.struct("label", "text", "detail", "priority", "done").alias("r"),
    )
    done = (F.col("section") == "task") & F.col("r.done")
    takes_last = F.col("section").isin("goal", "tech_stack")
    return (
        ranked.groupBy(*keys, "section", "_entry", "_alone")
        .agg(
            F.min("ord").alias("ord"),
            F.min_by("r", "ord").alias("head"),
            F.max_by("r", "ord").alias("tail"),
            F.max_by(F.when(done, F.col("r")), F.when(done, F.col("ord"))).alias("closed"),
        )
        .withColumn("r", F.when(takes_last, F.col("tail")).otherwise(F.coalesce("closed", "head")))
        .select(*keys, *[F.col(f"r.{c}").alias(c) if c not in ("section", "ord") else F.col(c) for c in ITEM_COLUMNS])
    )
