"""Agent-session analytics.

Every entry is turned into small facts (a tool call, a field, a decision) in one scan. One shuffle
on (session, kind, key) settles which occurrence counts; file changes, commands, the last action,
context usage and the summary are all read off that table. A session of any length spreads over its
distinct facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ordering import top_rows
from threadloom.functions.shuffles import contained_tokens, cut_lineage, lookup_join
from threadloom.lexicons import CREATE_TOOLS, MODIFY_TOOLS, SESSION_DECISION
from threadloom.sources.sessions import content_blocks, file_stem, plain_text

CONTEXT_WINDOW_TOKENS = 200_000
MIN_USAGE_TOKENS = 1_000
MAX_COMMANDS, MAX_DECISIONS, MAX_STEPS = 20, 10, 5
MIN_DECISION_LENGTH = 35


def _fact(kind: str, key: Column, pos: Column, value: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), pos.cast("int").alias("pos"), value.cast("string").alias("value")
    )


def _used_tokens() -> Column:
    used = F.col("usage")
    counts = [F.coalesce(used[c], F.lit(0)) for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    return F.when((F.col("type") == "assistant") & used.isNotNull(), counts[0] + counts[1] + counts[2])


def _read_blocks(content: Column) -> Column:
    """Fields of every block of a message, each taken out of the VARIANT once."""

    def read(block: Column) -> Column:
        def field(path: str) -> Column:
            return F.try_variant_get(block, f"$.{path}", "string")

        given = F.try_variant_get(block, "$.input", "variant")
        return F.struct(
            field("type").alias("type"),
            F.coalesce(field("name"), F.lit("")).alias("name"),
            F.coalesce(field("text"), F.lit("")).alias("text"),
            T.non_empty(field("input.file_path"), field("input.path")).alias("path"),
            F.coalesce(field("input.command"), F.lit("")).alias("command"),
            (given.isNull() | F.is_variant_null(given) | F.schema_of_variant(given).startswith("OBJECT")).alias("usable"),
        )

    return F.transform(content_blocks(content), read)


def _tool_facts(blocks: Column) -> Column:
    """Facts of the tool calls of one entry."""

    def of(block: Column, pos: Column) -> Column:
        usable = (block["type"] == "tool_use") & block["usable"]
        name, path, raw = block["name"], block["path"], block["command"]
        command = T.strip(raw)
        shown = (
            F.when(path.isNotNull(), F.concat(name, F.lit(" "), path))
            .when(raw != "", F.concat(F.lit("Bash: "), F.replace(F.left(raw, F.lit(80)), F.lit("\n"), F.lit(" "))))
            .otherwise(name)
        )
        return F.array(
            F.when(usable & path.isNotNull() & name.isin(*CREATE_TOOLS, *MODIFY_TOOLS), _fact("change", path, pos, name)),
            F.when(usable & (name == "Bash") & (command != ""), _fact("command", command, pos, name)),
            F.when(usable, _fact("action", F.lit(""), pos, shown)),
        )

    return F.flatten(F.transform(blocks, of))


def _decision_facts(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(SESSION_DECISION), F.lit(0))
    cleaned = F.transform(found, lambda d: F.rtrim(T.strip(d), F.lit(".,;")))
    return F.transform(
        cleaned, lambda d, i: F.when(F.length(d) >= MIN_DECISION_LENGTH, _fact("decision", d, i, F.lit("")))
    )


ENTRY_FIELDS = ("session_id", "git_branch", "started_at", "tokens")


def entry_facts(entries: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, kind, key, at, value, and the entry fields): the facts of each entry by itself.

    Every entry leaves one fact of kind ``entry``, which carries the fields of the session itself.
    """
    nothing = F.array().cast("array<struct<kind:string,key:string,pos:int,value:string>>")
    content, blocks = F.col("content"), F.col("blocks")
    is_assistant = F.col("type") == "assistant"
    read = entries.select(
        *keys, "seq", _used_tokens().alias("tokens"), T.non_empty(F.col("session_id")).alias("session_id"), T.non_empty(F.col("git_branch")).alias("git_branch"),
        F.when(F.col("type") == "user", T.non_empty(F.col("timestamp"))).alias("started_at"),
        F.when(is_assistant, plain_text(content)).alias("plain"),
        F.when(is_assistant, _read_blocks(content)).alias("blocks"),
    )
    spoken = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    text = F.coalesce("plain", F.array_join(spoken, " "))
    parts = [
        F.array(_fact("entry", F.lit(""), F.lit(0), F.lit(""))),
        F.coalesce(_tool_facts(blocks), nothing),
        F.coalesce(_decision_facts(text), nothing),
    ]
    facts = read.select(*keys, "seq", *ENTRY_FIELDS, F.explode(F.concat(*parts)).alias("f")).filter("f IS NOT NULL")
    is_entry = F.col("f.kind") == "entry"
    at = F.struct("seq", F.col("f.pos").alias("pos"))
    return facts.select(
        *keys, "f.kind", "f.key", at.alias("at"), "f.value", *[F.when(is_entry, F.col(c)).alias(c) for c in ENTRY_FIELDS]
    )


def session_facts(entries: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, kind, key, first_at, last_at, first_value, last_value, n, and the entry fields)."""

    def given(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.col("at"))

    return entry_facts(entries, keys).groupBy(*keys, "kind", "key").agg(
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.min_by("value", "at").alias("first_value"),
        F.max_by("value", "at").alias("last_value"),
        F.count(F.lit(1)).alias("n"),
        *[F.min_by(c, given(c)).alias(c) for c in ENTRY_FIELDS[:3]],
        F.max_by("tokens", given("tokens")).alias("tokens"),
    )


def file_changes(facts: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, file, action, first_at): created only when touched once, by a creating tool."""
    created = (F.col("n") == 1) & F.col("first_value").isin(*CREATE_TOOLS)
    return facts.filter("kind = 'change'").select(
        *keys, F.col("key").alias("file"), F.when(created, "created").otherwise("modified").alias("action"), "first_at"
    )


def session_commands(facts: DataFrame, keys: Sequence[str] = ("path",), limit: int = MAX_COMMANDS) -> DataFrame:
    """First distinct shell commands of every session (keys, ord, command)."""
    commands = facts.filter("kind = 'command'")
    return top_rows(commands, keys, [F.col("first_at")], limit, name="ord").select(*keys, "ord", F.col("key").alias("command"))


def last_action(facts: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    return facts.filter("kind = 'action'").select(*keys, F.col("last_value").alias("last_action"))


def usage_percent(tokens: Column) -> Column:
    share = F.bround(tokens / CONTEXT_WINDOW_TOKENS * 100)
    return F.when(tokens >= MIN_USAGE_TOKENS, F.least(F.lit(100), share.cast("int")))


def context_usage(facts: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Context share in percent by the last assistant entry that reports usage."""
    reported = facts.filter("kind = 'entry' AND tokens IS NOT NULL")
    return reported.select(*keys, usage_percent(F.col("tokens")).alias("context_usage_pct"))


def first_metadata(facts: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """First non-empty session id, start and branch; empty text where a session has none.

    With ``path`` among the keys, a session without an id takes the stem of its file's name.
    """
    if "path" in keys:
        facts = facts.withColumn("session_id", F.coalesce("session_id", file_stem("path")))
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in ("session_id", "started_at", "git_branch")]
    return facts.filter("kind = 'entry'").select(*keys, *fields)


def match_plan_tasks(tasks: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Plan tasks (key, ord, title, done, ...) with ``done`` also set when a significant word of the
    title is part of a changed path of the same key."""
    opened = tasks.filter("NOT done")
    words = opened.select(key, F.explode(T.significant_words(F.col("title"))).alias("token")).distinct()
    texts = changes.select(key, F.col("file").alias("text"))
    hit = contained_tokens(words, texts, key, r"(?U)\w+", shortest=5)
    by_word = opened.select(key, "ord", F.explode(T.significant_words(F.col("title"))).alias("token"))
    touched = (
        lookup_join(by_word, hit, [key, "token"], "left_semi").select(key, "ord").distinct().withColumn("_touched", F.lit(True))
    )
    return tasks.join(touched, [key, "ord"], "left").withColumn("done", F.col("done") | F.coalesce("_touched", F.lit(False))).drop("_touched")


def next_steps(remaining: DataFrame, sessions: DataFrame, key: str = "path") -> DataFrame:
    """(key, ord, step): up to five open tasks, high priority first, else one fallback line.

    ``sessions`` is (key, files_changed).
    """
    ranked = top_rows(remaining, [key], [F.col("priority") != "high", F.col("ord")], MAX_STEPS, name="_rank")
    steps = ranked.select(key, F.col("_rank").alias("ord"), F.concat(F.lit("Complete: "), "title").alias("step"))
    fallback = F.when(F.col("files_changed") > 0, "Review changed files and run tests").otherwise(
        "Review session output and continue implementation"
    )
    # "steps" holds at most five rows per session, so this join has no heavy key
    return sessions.join(steps, key, "left").select(key, F.coalesce("ord", F.lit(1)).alias("ord"), F.coalesce("step", fallback).alias("step"))


def _in_order(kind: str, limit: int, value: Column) -> Column:
    """Array of one kind's ranked facts; the caller has already cut it to ``limit`` rows."""
    listed = F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= limit), F.struct("rank", value.alias("v"))))
    return F.transform(F.array_sort(listed), lambda x: x["v"])


def summarise_sessions(facts: DataFrame, plans: DataFrame | None = None, key: str = "path", tasks: DataFrame | None = None) -> DataFrame:
    """One row per session. Lists that have no upper bound (file changes, tasks) stay tables of
    their own (``file_changes``, ``match_plan_tasks``); here they are counted.

    ``plans`` is (key, ord, title, priority, done). Where ``match_plan_tasks`` has matched them already,
    pass its result as ``tasks`` instead.
    """
    if tasks is None:
        facts = cut_lineage(facts)  # a small digest of the logs, read several times below
    listed = F.col("kind").isin("command", "decision")
    per_list = Window.partitionBy(key, "kind", F.when(listed, "").otherwise(F.col("key"))).orderBy("first_at")
    ranked = facts.withColumn("rank", F.row_number().over(per_list)).filter(F.col("rank") <= MAX_COMMANDS)

    def single(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    summary = ranked.groupBy(key).agg(
        *[F.coalesce(F.max(c), F.lit("")).alias(c) for c in ("session_id", "started_at", "git_branch")],
        F.coalesce(single("action", "last_value"), F.lit("")).alias("last_action"),
        usage_percent(F.max("tokens")).alias("context_usage_pct"),
        single("entry", "n").alias("message_count"),
        F.count_if(F.col("kind") == "change").alias("files_changed"),
        _in_order("command", MAX_COMMANDS, F.col("key")).alias("commands_run"),
        _in_order("decision", MAX_DECISIONS, F.col("key")).alias("decisions"),
    )
    if tasks is None:
        if plans is None:
            plans = summary.select(key, F.lit(0).alias("ord"), F.lit("").alias("title"), F.lit("medium").alias("priority"), F.lit(False).alias("done")).limit(0)
        tasks = match_plan_tasks(plans, file_changes(facts, [key]), key)
    counts = tasks.groupBy(key).agg(F.count_if("done").alias("tasks_completed"), F.count_if(~F.col("done")).alias("tasks_remaining"))
    steps = next_steps(tasks.filter("NOT done"), summary.select(key, "files_changed"), key)
    listed_steps = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "step"))).alias("s"))
    return (
        summary.join(counts, key, "left")
        .join(listed_steps, key, "left")
        .withColumn("tasks_completed", F.coalesce("tasks_completed", F.lit(0)))
        .withColumn("tasks_remaining", F.coalesce("tasks_remaining", F.lit(0)))
        .withColumn("next_steps", F.transform("s", lambda x: x["step"]))
        .drop("s")
    )


def latest_session(sessions: DataFrame, keys: Sequence[str] = ("project_path",)) -> DataFrame:
    """Session that started last, per project."""
    return top_rows(sessions, keys, [F.col("started_at").desc(), F.col("session_id")], 1).drop("rank")


def recent_sessions(sessions: DataFrame, limit: int = 10, keys: Sequence[str] = ("project_path",)) -> DataFrame:
    return top_rows(sessions, keys, [F.col("started_at").desc(), F.col("session_id")], limit)
