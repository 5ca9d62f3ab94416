"""Agent-session logs: JSONL lines to typed entries, messages and per-session metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.sources.exports import file_name

ENTRY = (
    "type STRING, sessionId STRING, timestamp STRING, cwd STRING, gitBranch STRING, version STRING, "
    "message STRUCT<content: VARIANT, usage: STRUCT<input_tokens: BIGINT, "
    "cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT>>"
)
_BLOCKS = "array<variant>"


def file_stem(path: Column | str) -> Column:
    """Name of a file without its folders and last extension."""
    return F.regexp_replace(file_name(F.col(path) if isinstance(path, str) else path), r"\.[^.]*$", "")


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, size, seq, line) of session logs, without reading any file whole.

    ``seq`` orders the lines of a file: splits by their offset, lines of a split by the running id
    that the scan hands out.
    """
    lines = spark.read.text(path)
    seq = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        file_stem("_metadata.file_path").alias("stem"),
        F.col("_metadata.file_size").alias("size"),
        seq.alias("seq"),
        F.col("value").alias("line"),
    )


def entry_type_filter(entries: DataFrame) -> DataFrame:
    """Keep user and assistant entries; the rest is housekeeping."""
    return entries.filter(F.col("type").isin("user", "assistant"))


def read_session_entries(lines: DataFrame) -> DataFrame:
    """Lines to entries; lines that are no JSON object are skipped. Other columns stay as they are."""
    # explode keeps the type filter above it; pushed down, the filter would parse every line again
    entry = F.explode(F.array(F.from_json("line", ENTRY, {"mode": "PERMISSIVE"})))
    parsed = lines.withColumn("entry", entry)
    kept = [c for c in lines.columns if c != "line"]
    entries = parsed.select(*kept, "entry.*")
    return entry_type_filter(
        entries.select(
            *kept, "type", F.col("sessionId").alias("session_id"), "timestamp", "cwd",
            F.col("gitBranch").alias("git_branch"), "version",
            F.col("message.content").alias("content"), F.col("message.usage").alias("usage"),
        )
    )


def content_blocks(content: Column) -> Column:
    """Blocks of a message, null when its content is plain text."""
    return F.try_variant_get(content, "$", _BLOCKS)


def _field(block: Column, path: str) -> Column:
    return F.try_variant_get(block, f"$.{path}", "string")


def block_texts(content: Column) -> Column:
    texts = F.filter(content_blocks(content), lambda b: _field(b, "type") == "text")
    return F.transform(texts, lambda b: F.coalesce(_field(b, "text"), F.lit("")))


def plain_text(content: Column) -> Column:
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))


def session_messages(entries: DataFrame) -> DataFrame:
    """Entries to messages: text only; turns made of tool calls or tool results alone drop out."""
    glue = F.when(F.col("type") == "user", F.array_join(block_texts(F.col("content")), " ")).otherwise(
        F.array_join(block_texts(F.col("content")), "\n\n")
    )
    text = T.strip(F.coalesce(plain_text(F.col("content")), glue, F.lit("")))
    return (
        entries.withColumn("_text", text)
        .filter(F.col("_text") != "")
        .select("path", "seq", F.col("type").alias("role"), F.col("_text").alias("content"), "timestamp")
    )


def assistant_texts(entries: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, seq, text) of assistant entries, text blocks joined by a space."""
    text = F.coalesce(plain_text(F.col("content")), F.array_join(block_texts(F.col("content")), " "), F.lit(""))
    return entries.filter("type = 'assistant'").select(*keys, "seq", text.alias("text"))


def tool_use_events(entries: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """One row per tool call of assistant entries: (keys, seq, pos, name, file_path, command).

    The one explode that file changes, commands and the last action all start from. Calls whose
    input is not an object are left out.
    """
    calls = entries.filter("type = 'assistant'").select(
        *keys, "seq", F.posexplode(content_blocks(F.col("content"))).alias("pos", "block")
    )
    block = F.col("block")
    given = F.try_variant_get(block, "$.input", "variant")
    is_object = given.isNull() | F.is_variant_null(given) | F.schema_of_variant(given).startswith("OBJECT")
    return calls.filter((_field(block, "type") == "tool_use") & is_object).select(
        *keys,
        "seq",
        "pos",
        F.coalesce(_field(block, "name"), F.lit("")).alias("name"),
        T.non_empty(_field(block, "input.file_path"), _field(block, "input.path")).alias("file_path"),
        T.non_empty(_field(block, "input.command")).alias("command"),
    )


def session_meta(entries: DataFrame) -> DataFrame:
    """Sessions by file: start, branch and folder of the first dated user entry, entry count, size."""
    dated = (F.col("type") == "user") & ~T.is_blank(F.col("timestamp"))
    first = F.min_by(F.when(dated, F.struct("timestamp", "git_branch", "cwd")), F.when(dated, F.col("seq")))
    return (
        entries.groupBy("path")
        .agg(
            F.first("stem").alias("session_id"), F.first("size").alias("size_bytes"),
            first.alias("first"), F.count(F.lit(1)).alias("message_count"),
        )
        .filter("first IS NOT NULL")
        .select(
            "path", "session_id", F.coalesce("first.cwd", F.lit("")).alias("project_path"), F.col("first.timestamp").alias("started_at"),
            F.coalesce("first.git_branch", F.lit("")).alias("git_branch"), "message_count", "size_bytes",
        )
    )


def session_listing(sessions: DataFrame) -> DataFrame:
    """Sessions as conversations (path, conv_id, title, date)."""
    title = F.concat(F.lit("Session "), F.left("session_id", F.lit(8)), F.lit(" @ "), F.left("started_at", F.lit(10)))
    return sessions.select("path", F.col("session_id").alias("conv_id"), title.alias("title"), F.col("started_at").alias("date"))


def session_format_version(entries: DataFrame) -> DataFrame:
    """Tool version of the first user entry of every file, else ``unknown``."""
    is_user = F.col("type") == "user"
    found = F.min_by(F.when(is_user, F.coalesce("version", F.lit("unknown"))), F.when(is_user, F.col("seq")))
    return entries.groupBy("path").agg(F.coalesce(found, F.lit("unknown")).alias("format_version"))
