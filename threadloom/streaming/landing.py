"""Conversations that arrive as JSON documents, extracted as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.lexicons import DEFAULT_LEXICON, Lexicon
from threadloom.operators.extraction import extract_items
from threadloom.sources import exports as S

READERS = S.FILE_READERS


def judge_payloads(documents: DataFrame) -> DataFrame:
    """(path, source, parse_as, content, error) of documents (path, value) with a body {source, conversation}.

    Rows without an error hold the conversation as an export with one entry.
    A ChatGPT conversation that already has the sender/text form is read as such.
    """
    payload = T.json_value(F.col("value"))
    known = F.col("source").isin(*READERS)
    present = ~F.coalesce(F.col("_conversation"), F.lit("")).isin("", "null", "{}", "[]", "false", "0", '""')
    error = (
        F.when(~F.col("_json"), "Invalid JSON")
        .when(~known, F.concat(F.lit("Unknown source '"), F.col("source"), F.lit("'")))
        .when(~present, "'conversation' field is required")
    )
    has_senders = F.array_contains(F.json_object_keys("_conversation"), "chat_messages")
    parse_as = F.when((F.col("source") == "chatgpt") & has_senders, "claude").otherwise(F.col("source"))
    # the raw text, because ChatGPT's tree needs its keys in document order and a VARIANT sorts them
    raw = F.get_json_object("value", "$.conversation")
    content = F.when(parse_as.isin("claude", "chatgpt"), F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw)
    return (
        documents.withColumn("_p", payload)
        .select(
            "path", "value", F.col("_p").isNotNull().alias("_json"),
            F.coalesce(F.try_variant_get("_p", "$.source", "string"), F.lit("claude")).alias("source"),
            F.to_json(F.try_variant_get("_p", "$.conversation", "variant")).alias("_conversation"),
        )
        .select("path", "source", error.alias("error"), parse_as.alias("parse_as"), content.alias("content"))
        .select("path", "source", "parse_as", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")
    )


def split_payloads(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of judged payloads: (path, source, parse_as, content) and (path, error)."""
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL").select("path", "error")


def validate_payloads(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of documents (path, value), see ``judge_payloads``."""
    return split_payloads(judge_payloads(documents))


def payload_messages(good: DataFrame) -> DataFrame:
    """Messages of valid payloads, each source through its own reader; conversations that cannot be read have none."""
    out = None
    for name, reader in READERS.items():
        part = reader(S.files_where(good, F.col("parse_as") == name), on_error="skip")
        out = part if out is None else out.unionByName(part)
    return out


def landing_ingest(
    write_items: Callable[[DataFrame, int], None], write_rejects: Callable[[DataFrame, int], None], lexicon: Lexicon = DEFAULT_LEXICON
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for a stream of documents (path, value).

    Every document leaves items, or a reject (path, error) where it is no valid payload or no message
    can be read from it.
    """

    def run(documents: DataFrame, batch_id: int) -> None:
        judged = judge_payloads(documents).persist()  # read by every reader: each filter would parse the payloads again
        good, rejects = split_payloads(judged)
        messages = payload_messages(good).persist()  # read for items and for rejects
        write_items(extract_items(messages, lexicon), batch_id)
        write_rejects(rejects.unionByName(S.silent_files(good, messages)), batch_id)
        messages.unpersist()
        judged.unpersist()

    return run
