"""Views of the driver tables as the inputs operators expect, and their SQL twins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import WHITESPACE
from threadloom.lexicons import DomainRule, Lexicon
from threadloom.plans.registry import texts

# Words that do occur in the tables, in place of the default phrases.
LEXICON = Lexicon(
    intents=("with the", "when", "the"),
    goal_prefixes=("the ", "of ", "in ", "that "),
    decisions=("with", "for the", "that", "when", "die", "les"),
    constraints=("must", "from", "with", "the"),
    non_goals=("not", "for", "und"),
    task_headers=("when", "with"),
    tech={
        "article": {"the": "The", "that": "That", "die": "Die", "les": "Les"},
        "link": {"and": "And", "und": "Und", "of": "Of"},
        "place": {"in": "In", "on": "On", "for": "For", "by the": "By The"},
    },
    needs_subject=None,
)

DOMAINS = (
    DomainRule("english-domain", ("the ", "that"), ("spelling", "grammar")),
    DomainRule("german-domain", ("und ", "nicht"), ("grammar", "cases")),
    DomainRule("french-domain", ("les ", "ê"), ("accents",)),
    DomainRule("absent-domain", ("zzzz",), ("none",)),
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages(conv_id, seq, role, content)."""
    return texts(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


def list_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with list items, questions and open points put in front of the text."""
    return messages(spark, sf_dir).withColumn(
        "content",
        F.concat(
            F.lit("- "), F.replace("content", F.lit(".\n"), F.lit(" so?\n* ")), F.lit("\nunclear: "), F.left("content", F.lit(30))
        ),
    )


def exported_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the export document they belong to: one of each conversation."""
    return texts(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("i"), "role", "text")


def export_files(turns: DataFrame, extension: str, item: Column, build) -> DataFrame:
    """files(path, content): one document per ``doc``, its items in turn order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", item.alias("item")))), lambda x: x["item"])
    return turns.groupBy("doc").agg(listed.alias("items")).select(
        F.concat(F.lit("/exports/"), F.col("doc"), F.lit(extension)).alias("path"), build(F.col("doc"), F.col("items")).alias("content")
    )


# ---- SQL twins -----------------------------------------------------------------------------------


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: Iterable[Iterable]) -> str:
    def cell(v) -> str:
        return quoted(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


WS = quoted(WHITESPACE)

SQL_MESSAGES = "msgs AS (SELECT conv_id, turn AS seq, role, text AS content FROM conversations)"

SQL_LIST_MESSAGES = (
    "msgs AS (SELECT conv_id, turn AS seq, role, '- ' || replace(text, '.' || chr(10), ' so?' || chr(10) || '* ') "
    "|| chr(10) || 'unclear: ' || left(text, 30) AS content FROM conversations)"
)

SQL_SENTENCES = (
    "sent AS (SELECT conv_id, seq, role, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM ("
    "SELECT conv_id, seq, role, list_filter(list_transform(regexp_split_to_array(content, '[.!?]+'), "
    f"lambda x: trim(x, {WS})), lambda x: x <> '') AS s FROM msgs))"
)

SQL_TURNS = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS doc, turn AS i, role, text FROM conversations)"


def sql_dedup(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9 ]', '', 'g'))"


def sql_first_wins(section_words: Iterable[str], role_filter: str = "TRUE") -> str:
    """Distinct sentences that hold a word, by clean key; the first of (message, word, sentence) wins."""
    return (
        f"hits AS (SELECT s.*, w.kw, {sql_dedup('sentence')} AS k FROM sent s, {values((w, i) for i, w in enumerate(section_words))} w(word, kw) "
        f"WHERE contains(lower(s.sentence), w.word) AND {role_filter})"
    )
