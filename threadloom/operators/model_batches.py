"""Batches for model-assisted extraction: building prompts and reading answers.

Calling a model is not part of this library; answers come in as a table (key, text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ordering import ord_of, top_rows
from threadloom.operators.rendering import assemble_documents, context_json_lines

MAX_CONVERSATION, MAX_SESSION, MAX_INDEX = 60_000, 40_000, 20_000
TRUNCATION_NOTE = "...(earlier messages truncated)...\n\n"

EXTRACT_TEMPLATE = (
    "Read the conversation below and answer with one JSON object with the fields goal, tech_stack, decisions "
    "(topic, decision, rationale), tasks (title, description, priority, done), constraints, non_goals and open_questions. "
    "Later statements override earlier ones. Leave out what is not there.\n\nConversation:\n{conversation}"
)
DOCUMENTS_TEMPLATE = (
    "Read the conversation below and answer with one JSON object that holds a Markdown body for each document of the "
    "project's knowledge base.\n\nConversation:\n{conversation}"
)
SESSION_TEMPLATE = (
    "List the technical decisions made in this coding session and the next steps, as one JSON object with the fields "
    "decisions and next_steps.\n\nSession transcript:\n\n{conversation}"
)

# The document fields of a knowledge-base answer.
BODY_FIELDS = (
    "overview", "architecture", "decisions", "constraints", "risks", "acceptance_criteria", "work_spec", "work_tasks",
    "work_milestones", "standards_coding", "standards_testing", "standards_security", "standards_release",
)


def tail_transcripts(messages: DataFrame, line: Column, glue: str, limit: int | None, keys: Sequence[str] = ("conv_id",), shortest: int = 0) -> DataFrame:
    """(keys, transcript, whole_length): the last ``limit`` characters of the joined lines, all of them with null.

    Only the messages that can reach into that tail are brought together: they are few, because
    every line takes up at least ``shortest`` characters and the glue, and each is cut to the limit first.
    """
    keys = list(keys)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), glue)
    if limit is None:
        whole = messages.select(*keys, "seq", line.alias("line")).groupBy(*keys).agg(joined.alias("transcript"))
        return whole.withColumn("whole_length", F.length("transcript").cast("bigint"))
    lines = messages.select(*keys, "seq", line.alias("line")).select(*keys, "seq", F.right("line", F.lit(limit)).alias("line"), F.length("line").alias("size"))
    lengths = lines.groupBy(*keys).agg((F.sum(F.col("size") + len(glue)) - len(glue)).alias("whole_length"))
    last = top_rows(lines, keys, [F.col("seq").desc()], limit // max(shortest + len(glue), 1) + 1, salt=F.col("seq"))
    later = Window.partitionBy(*keys).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.sum(F.length("line") + len(glue)).over(later), F.lit(0))
    tail = last.withColumn("_later", reached).filter(F.col("_later") < limit + len(glue))
    return tail.groupBy(*keys).agg(F.right(joined, F.lit(limit)).alias("transcript")).join(lengths, keys)


def _fill(template: str, slot: str, value: Column) -> Column:
    before, _, after = template.partition(slot)
    return F.concat(F.lit(before), value, F.lit(after))


def conversation_prompts(messages: DataFrame, template: str = EXTRACT_TEMPLATE, keys: Sequence[str] = ("conv_id",), limit: int | None = MAX_CONVERSATION) -> DataFrame:
    """(keys, prompt) from the end of every conversation."""
    line = F.concat(F.upper("role"), F.lit(": "), F.col("content"))
    tails = tail_transcripts(messages, line, "\n", limit, keys, shortest=len(": "))
    return tails.select(*keys, _fill(template, "{conversation}", F.col("transcript")).alias("prompt"))


def session_prompts(messages: DataFrame, template: str = SESSION_TEMPLATE, keys: Sequence[str] = ("path",), limit: int | None = MAX_SESSION) -> DataFrame:
    """(keys, prompt) from the end of every session, with a note where something was cut."""
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), F.col("content"))
    tails = tail_transcripts(messages, line, "\n\n", limit, keys, shortest=len("[]\n"))
    note = F.lit("") if limit is None else F.when(F.col("whole_length") > limit, TRUNCATION_NOTE).otherwise("")
    return tails.select(*keys, _fill(template, "{conversation}", F.concat(note, "transcript")).alias("prompt"))


_MERGED_FIELDS = ("goal", "tech_stack", "decisions", "tasks", "constraints", "non_goals", "open_questions")


def merge_prompts(items: DataFrame, key: str = "project_id", session: str = "session_ord") -> DataFrame:
    """(key, rel_path, body): the contexts of a project's sessions as JSON, to be merged.

    Items are rows per (key, session, section); sessions go by their order number.
    """
    each = context_json_lines(items, [key, session], "merge", _MERGED_FIELDS)
    heads = items.select(key, session).distinct().select(
        key, session, F.lit("merge").alias("rel_path"), F.lit(-1).alias("place"), ord_of().alias("ord"), F.lit(0).alias("pos"),
        F.concat(F.lit("Session "), F.col(session).cast("string"), F.lit(":")).alias("line"),
    )
    intro = items.select(key).distinct().select(
        key, F.lit("merge").alias("rel_path"), F.lit(0).alias("place"), ord_of().alias("ord"), F.lit(0).alias("pos"),
        F.lit("Merge the contexts below into one JSON object of the same form. The latest session wins.").alias("line"),
    )
    o = F.col("ord")
    placed = heads.unionByName(each).select(
        key, "rel_path", F.lit(1).alias("place"),
        ord_of(src=F.col(session), seq=F.col("place") + 1, sub=o["src"], kw=o["seq"], pos=o["sub"] * (1 << 40) + o["kw"] * (1 << 20) + o["pos"]).alias("ord"), "pos", "line",
    )
    return assemble_documents(intro.unionByName(placed), [key])


def sync_prompts(backlog: DataFrame, index_text: DataFrame, commits: DataFrame, key: str = "project_id", max_index: int | None = MAX_INDEX) -> DataFrame:
    """(key, rel_path, body): open tasks, the start of the code index, and recent commits.

    ``index_text`` is (key, text), one row per project; ``commits`` is (key, ord, line), already cut
    to the latest ones. Of the index its first ``max_index`` characters are shown, all with null.
    """
    projects = backlog.select(key).distinct()

    def lines(df: DataFrame, place: int, line: Column, order: Column) -> DataFrame:
        return df.select(key, F.lit("sync").alias("rel_path"), F.lit(place).alias("place"), order.alias("ord"), F.lit(0).alias("pos"), line.alias("line"))

    task = F.to_json(F.struct("id", "title", "description"))
    texts = projects.join(index_text, key, "left")
    index = F.col("text") if max_index is None else T.head_truncate(F.col("text"), max_index)
    shown = F.coalesce(T.non_empty(index), F.lit("(empty)"))
    without = projects.join(commits.select(key).distinct(), key, "left_anti")
    one = ord_of()
    parts = [
        lines(projects, 0, F.lit("Answer with one JSON object {task id: true or false}: true only where the evidence shows that a task is done."), one),
        lines(projects, 1, F.lit("Tasks:"), one),
        lines(backlog.filter("NOT done"), 2, task, F.col("ord")),
        lines(projects, 3, F.lit("Code index:"), one),
        lines(texts, 4, shown, one),
        lines(projects, 5, F.lit("Recent commits:"), one),
        lines(commits, 6, F.col("line"), ord_of(seq=F.col("ord"))),
        lines(without, 6, F.lit("(no commits)"), one),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return assemble_documents(out, [key])


# ---- answers -------------------------------------------------------------------------------------

_CONTEXT = (
    "STRUCT<goal: STRING, tech_stack: MAP<STRING, STRING>, decisions: ARRAY<STRUCT<topic: STRING, decision: STRING, rationale: STRING>>, "
    "tasks: ARRAY<STRUCT<title: STRING, description: STRING, priority: STRING, done: BOOLEAN>>, constraints: ARRAY<STRING>, "
    "non_goals: ARRAY<STRING>, open_questions: ARRAY<STRING>>"
)
_ITEM = "array<struct<section:string,pos:bigint,label:string,text:string,detail:string,priority:string,done:boolean>>"


def _answer_item(section: str, pos: Column, text: Column, label: Column | None = None, detail: Column | None = None, priority: Column | None = None, done: Column | None = None) -> Column:
    def given(c: Column | None) -> Column:
        return F.lit("") if c is None else F.coalesce(c, F.lit(""))

    return F.struct(
        F.lit(section).alias("section"), pos.cast("bigint").alias("pos"), given(label).alias("label"), given(text).alias("text"), given(detail).alias("detail"),
        (F.lit("") if priority is None else F.coalesce(priority, F.lit("medium"))).alias("priority"), (F.lit(False) if done is None else F.coalesce(done, F.lit(False))).alias("done"),
    )


def parse_context_responses(responses: DataFrame, keys: Sequence[str] = ("conv_id",)) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of context answers; absent fields are empty, an answer that is no JSON object
    is an error row."""
    body = T.strip_fences(F.col("text"))
    checked = responses.select(*keys, "text", F.when(T.is_json_object(body), body).alias("_body"))
    errors = checked.filter("_body IS NULL").select(*keys, F.concat(F.lit("Model returned invalid JSON: "), F.left("text", F.lit(200))).alias("error"))
    good = checked.filter("_body IS NOT NULL").select(*keys, F.from_json("_body", _CONTEXT).alias("r"))
    nothing = F.array().cast(_ITEM)

    def each(name: str, build) -> Column:
        return F.coalesce(F.transform(F.col(f"r.{name}"), build), nothing)

    stack = F.transform(F.map_entries("r.tech_stack"), lambda e, i: _answer_item("tech_stack", i, e["value"], label=e["key"]))
    found = F.concat(
        F.array(_answer_item("goal", F.lit(0), F.col("r.goal"))),
        F.coalesce(stack, nothing),
        each("decisions", lambda d, i: _answer_item("decision", i, d["decision"], label=d["topic"], detail=d["rationale"])),
        each("tasks", lambda t, i: _answer_item("task", i, t["title"], detail=t["description"], priority=t["priority"], done=t["done"])),
        each("constraints", lambda c, i: _answer_item("constraint", i, c)),
        each("non_goals", lambda c, i: _answer_item("non_goal", i, c)),
        each("open_questions", lambda c, i: _answer_item("open_question", i, c)),
    )
    rows = good.select(*keys, F.explode(found).alias("i"))
    items = rows.select(
        *keys, "i.section", ord_of(seq=F.col("i.pos")).alias("ord"), "i.label", "i.text", "i.detail", "i.priority", "i.done"
    )
    return items, errors


def parse_body_responses(responses: DataFrame, keys: Sequence[str] = ("conv_id",), fields: Sequence[str] = BODY_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(bodies(keys, field, body), errors); answers that were cut off are repaired where possible."""
    repaired = responses.select(*keys, "text", T.repair_json(T.strip_fences(F.col("text"))).alias("_json"))
    errors = repaired.filter("_json IS NULL").select(*keys, F.concat(F.lit("Model returned invalid JSON: "), F.left("text", F.lit(200))).alias("error"))
    value = T.json_value(F.col("_json"))

    def body(field: str) -> Column:
        # text as it is, anything else as its JSON
        return F.struct(F.lit(field).alias("field"), F.coalesce(F.try_variant_get("_value", f"$.{field}", "string"), F.lit("")).alias("body"))

    good = repaired.filter("_json IS NOT NULL").select(*keys, value.alias("_value"))
    return good.select(*keys, F.explode(F.array(*[body(f) for f in fields])).alias("b")).select(*keys, "b.*"), errors


def parse_verdict_responses(responses: DataFrame, key: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """(verdicts(key, id, verdict), errors) of {task id: truth value} answers."""
    body = T.strip_fences(F.col("text"))
    checked = responses.select(key, "text", F.when(T.is_json_object(body), body).alias("_body"))
    errors = checked.filter("_body IS NULL").select(key, F.concat(F.lit("Model returned no JSON object: "), F.left("text", F.lit(200))).alias("error"))
    verdicts = checked.filter("_body IS NOT NULL").select(key, F.explode(F.from_json("_body", "MAP<STRING, VARIANT>")).alias("id", "_v"))
    kind, shown = F.schema_of_variant("_v"), F.try_variant_get("_v", "$", "string")
    empty = F.col("_v").isNull() | F.is_variant_null("_v") | (shown == "") | ((kind != "STRING") & shown.isin("false", "0", "0.0", "[]", "{}"))
    return verdicts.select(key, "id", (~F.coalesce(empty, F.lit(False))).alias("verdict")), errors


def parse_session_responses(responses: DataFrame, heuristics: DataFrame, key: str = "path") -> DataFrame:
    """(key, decisions, next_steps): what the model said; nothing where its answer is no JSON; and the
    rule-based lists of ``heuristics`` (key, decisions, next_steps) where there is no answer at all."""
    body = T.strip_inner_fences(F.col("text"))
    answer = F.from_json(F.when(T.is_json_object(body), body), "STRUCT<decisions: ARRAY<STRING>, next_steps: ARRAY<STRING>>")
    said = responses.select(key, F.col("text").isNotNull().alias("_answered"), answer.alias("_r"))
    joined = heuristics.join(said, key, "left")
    nothing = F.array().cast("array<string>")

    def chosen(name: str) -> Column:
        return F.when(F.col("_answered"), F.coalesce(f"_r.{name}", nothing)).otherwise(F.col(name)).alias(name)

    return joined.select(key, chosen("decisions"), chosen("next_steps"))
