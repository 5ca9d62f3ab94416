"""Filters and projections on the messages table (conv_id, seq, role, content, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ordering import number_rows
from threadloom.functions.shuffles import cut_lineage, lookup_join
from threadloom.sources.exports import normalised_role

ROLES = ("user", "assistant")
PRIORITIES = ("high", "medium", "low")


def normalise_roles(messages: DataFrame, strict: bool = True) -> DataFrame:
    """human/user to user, assistant to assistant; another role is an error, or null if not strict."""
    role = normalised_role(F.col("role"))
    if strict:
        complaint = F.raise_error(F.concat(F.lit("Unknown role "), F.coalesce("role", F.lit("")))).cast("string")
        role = F.coalesce(role, complaint)
    return messages.withColumn("role", role)


def drop_empty_messages(messages: DataFrame, text: str = "text", content: str = "content") -> DataFrame:
    """Content is the first non-empty of the two fields; messages with neither are dropped."""
    filled = T.non_empty(F.col(text), F.col(content)) if text in messages.columns else T.non_empty(F.col(content))
    return messages.withColumn("content", filled).filter(F.col("content").isNotNull())


def _split(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    held = F.coalesce(valid, F.lit(False))
    return df.filter(held), df.filter(~held)


def validate_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): a known role and some content."""
    return _split(messages, F.col("role").isin(*ROLES) & ~T.is_blank(F.col("content")))


def validate_tasks(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): a known priority."""
    return _split(tasks, F.col("priority").isin(*PRIORITIES))


def select_conversation(
    conversations: DataFrame,
    title: str | None = None,
    conv_id: str | None = None,
    order: Sequence[str] = ("pos",),
    per: Sequence[str] = ("path",),
) -> DataFrame:
    """First conversation per file whose title holds ``title`` or whose id is ``conv_id``."""
    wanted = F.lit(False)
    if title:
        wanted = wanted | F.lower(T.strip(F.col("title"))).contains(title.strip().lower())
    if conv_id:
        wanted = wanted | (F.col("conv_id") == conv_id)
    first = Window.partitionBy(*per).orderBy(*order)
    return (
        conversations.filter(wanted).withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    )


def order_messages(messages: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Number messages 0, 1, ... by time, missing times first, ties in input order (``seq``).

    The readers order inside a row; this is for message tables. Rows are range-partitioned by the
    whole sort key, so a long conversation spreads over many tasks. The ranges are pinned by a
    checkpoint, because the numbers depend on them.
    """
    ts = F.coalesce("timestamp", F.lit(""))
    ranged = cut_lineage(
        messages.withColumn("_ts", ts)
        .repartitionByRange(*keys, "_ts", "seq")
        .withColumn("_range", F.spark_partition_id())
    )
    numbered = number_rows(ranged, keys, ["_ts", "seq"], [F.col("_range")], "_n")
    return numbered.withColumn("seq", F.col("_n") - 1).drop("_ts", "_range", "_n")


def two_sided_conversations(messages: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Messages longer than 5 characters, of conversations where both roles still speak."""
    long_enough = messages.filter(F.length(T.strip(F.col("content"))) > 5)
    both = (
        long_enough.groupBy(*keys)
        .agg(
            F.bool_or(F.col("role") == "user").alias("_user"),
            F.bool_or(F.col("role") == "assistant").alias("_assistant"),
        )
        .filter("_user AND _assistant")
        .select(*keys)
    )
    return lookup_join(long_enough, both, list(keys), "left_semi")


def question_quality(c: Column) -> Column:
    """Long enough, holding a word, and no fragment of code or Markdown."""
    return (
        (F.length(c) >= 20)
        & ~c.startswith("`")
        & ~c.startswith("*")
        & ~c.rlike(r"(?U)^[a-z]\w*`")
        & c.rlike("[a-zA-Z]{3,}")
    )
