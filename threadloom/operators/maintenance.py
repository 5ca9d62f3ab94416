"""Keeping a saved context current: what a fresh extraction changes, applying it, syncing the backlog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ordering import number_rows, ord_buckets, top_rows
from threadloom.functions.shuffles import contained_tokens, lookup_join
from threadloom.lexicons import TASK_STOP_WORDS

NEW_KINDS = {
    "task": "new_task",
    "decision": "new_decision",
    "constraint": "new_constraint",
    "non_goal": "new_non_goal",
    "open_question": "new_open_question",
    "tech_stack": "new_tech_stack",
}
CHANGE_KINDS = (*NEW_KINDS.values(), "revised_decision", "new_backlog_task")
_DELTA = ["kind", "ord", "label", "text", "detail", "priority", "done", "old_label", "old_text"]


def _match_key(decision_key: str) -> Column:
    """What makes a fresh item the same as a saved one."""
    section, topic, text = F.col("section"), F.lower("label"), F.lower("text")
    decision = topic if decision_key == "topic" else F.concat_ws("\x00", topic, text)
    return F.when(section == "tech_stack", F.col("label")).when(section == "decision", decision).otherwise(text)


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def new_items(existing: DataFrame, fresh: DataFrame, key: str = "project_id", decision_key: str = "topic") -> DataFrame:
    """Fresh items that the saved context does not hold yet."""
    match = _match_key(decision_key)
    known = existing.select(key, "section", match.alias("_match")).distinct()
    rows = fresh.filter(F.col("section").isin(*NEW_KINDS)).withColumn("_match", match)
    return lookup_join(rows, known, [key, "section", "_match"], "left_anti").drop("_match")


def revised_decisions(existing: DataFrame, fresh: DataFrame, key: str = "project_id") -> DataFrame:
    """Fresh decisions on a saved topic (its last one) that come to another conclusion."""
    topic = F.lower("label").alias("_topic")
    saved = (
        existing.filter("section = 'decision'").groupBy(key, topic).agg(F.max_by(F.struct("label", "text"), "ord").alias("_old"))
    )
    rows = fresh.filter("section = 'decision'").withColumn("_topic", F.lower("label"))
    joined = lookup_join(rows, saved, [key, "_topic"])
    return (
        joined.filter(F.lower("text") != F.lower("_old.text"))
        .withColumn("old_label", F.col("_old.label"))
        .withColumn("old_text", F.col("_old.text"))
        .drop("_topic", "_old")
    )


def new_backlog_tasks(existing: DataFrame, fresh: DataFrame, key: str = "project_id", match_on_id: bool = True) -> DataFrame:
    """Fresh backlog rows whose id (if ``match_on_id``) and title are both unknown."""
    titles = existing.select(key, F.lower("title").alias("_title")).distinct()
    rows = lookup_join(fresh.withColumn("_title", F.lower("title")), titles, [key, "_title"], "left_anti").drop("_title")
    if match_on_id:
        rows = lookup_join(rows, existing.select(key, "id").distinct(), [key, "id"], "left_anti")
    return rows


def compute_delta(
    existing: DataFrame,
    existing_backlog: DataFrame,
    fresh: DataFrame,
    fresh_backlog: DataFrame,
    key: str = "project_id",
    match_on_id: bool = True,
    decision_key: str = "topic",
) -> DataFrame:
    """Long table (key, kind, ord, ...) of additions, revisions and what is preserved.

    Backlog rows carry their id in ``label`` and their title in ``text``.
    """
    section = F.col("section")
    kinds = F.coalesce(*[F.when(section == s, F.lit(k)) for s, k in NEW_KINDS.items()])
    added = new_items(existing, fresh, key, decision_key)
    if decision_key != "topic":  # a topic with another conclusion is a revision, not an addition
        topics = existing.filter("section = 'decision'").select(key, "section", F.lower("label").alias("_topic")).distinct()
        added = lookup_join(added.withColumn("_topic", F.lower("label")), topics.filter("_topic <> ''"), [key, "section", "_topic"], "left_anti").drop("_topic")
    revised = revised_decisions(existing, fresh, key)
    if decision_key != "topic":
        revised = revised.filter("label <> ''")
    kept = existing.filter((section == "task") & F.col("done"))

    def backlog(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            key, F.lit(kind).alias("kind"), "ord", F.col("id").alias("label"), F.col("title").alias("text"), F.col("description").alias("detail"),
            "priority", "done", _none("old_label"), _none("old_text"),
        )

    parts = [
        added.withColumn("kind", kinds).withColumn("old_label", _none("x")).withColumn("old_text", _none("x")).select(key, *_DELTA),
        revised.withColumn("kind", F.lit("revised_decision")).select(key, *_DELTA),
        kept.withColumn("kind", F.lit("preserved_done_task")).withColumn("old_label", _none("x")).withColumn("old_text", _none("x")).select(key, *_DELTA),
        backlog(new_backlog_tasks(existing_backlog, fresh_backlog, key, match_on_id), "new_backlog_task"),
        backlog(existing_backlog.filter("done"), "preserved_done_backlog"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def delta_counts(delta: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, kind, n)."""
    return delta.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))


def delta_is_empty(delta: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, is_empty): preserved rows alone are no change."""
    return delta.groupBy(key).agg((~F.bool_or(F.col("kind").isin(*CHANGE_KINDS))).alias("is_empty"))


def number_decisions(saved: DataFrame, new_decisions: DataFrame, key: str = "project_id") -> DataFrame:
    """New decisions (key, ord, ...) with ``number`` going on from the highest saved one."""
    highest = saved.groupBy(key).agg(F.max("number").alias("_max"))
    numbered = number_rows(new_decisions, [key], ["ord"], ord_buckets(), "_n")
    joined = lookup_join(numbered, highest, [key], "left")
    return joined.withColumn("number", F.coalesce("_max", F.lit(0)) + F.col("_n")).drop("_n", "_max")


def assign_backlog_ids(tasks: DataFrame, now: str, key: str = "project_id") -> DataFrame:
    """Tasks (key, ord, title, description, priority, done) to backlog rows task-001, task-002, ..."""
    numbered = number_rows(tasks, [key], ["ord"], ord_buckets(), "_n")
    return numbered.select(
        key, F.format_string("task-%03d", F.col("_n")).alias("id"), "ord", "title", "description", F.lit("1").alias("phase"), "priority", "done",
        F.array().cast("array<string>").alias("tags"), F.lit(now).alias("added_at"), F.when(F.col("done"), now).alias("done_at"),
    )


def apply_items(existing: DataFrame, delta: DataFrame, today: str, no_conflict: bool = False, key: str = "project_id") -> DataFrame:
    """Saved items plus the delta's additions, dated and in front-to-back order.

    ``batch`` is 0 for saved items and 1 for additions; (batch, ord) orders a section. Revised
    decisions become ``revised_decision`` rows for someone to resolve; with ``no_conflict`` they
    are left out, and the saved decision stays. Nothing saved is ever reset.
    """
    back = {k: s for s, k in NEW_KINDS.items()}
    section = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in back.items()])
    columns = [key, "section", "batch", "ord", "label", "text", "detail", "priority", "done", "added_on", "old_label", "old_text"]
    saved = existing.select("*", F.lit(0).alias("batch"), _none("added_on"), _none("old_label"), _none("old_text")).select(columns)
    added = delta.filter(F.col("kind").isin(*back)).withColumn("section", section)
    if not no_conflict:
        added = added.unionByName(delta.filter("kind = 'revised_decision'").withColumn("section", F.lit("revised_decision")))
    added = added.withColumn("batch", F.lit(1)).withColumn("added_on", F.lit(today))
    return saved.unionByName(added.select(columns))


def apply_backlog(backlog: DataFrame, delta: DataFrame, fresh_backlog: DataFrame, updated_at: str, key: str = "project_id") -> DataFrame:
    """Saved backlog plus the new rows; a saved row that is done stays done.

    A project whose delta has no new backlog row keeps its old ``updated_at``.
    """
    new_ids = delta.filter("kind = 'new_backlog_task'").select(key, F.col("label").alias("id"), "ord").distinct()
    fresh = fresh_backlog.join(new_ids, [key, "id", "ord"], "left_semi").withColumn("batch", F.lit(1))
    touched = new_ids.select(key).distinct().withColumn("_touched", F.lit(True))
    both = backlog.withColumn("batch", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    marked = lookup_join(both, touched, [key], "left")
    return marked.withColumn("updated_at", F.when(F.col("_touched"), F.lit(updated_at)).otherwise(F.col("updated_at"))).drop("_touched")


# ---- backlog sync --------------------------------------------------------------------------------


def recent_commits(commits: DataFrame, key: str = "project_id", limit: int = 50) -> DataFrame:
    """Latest commits (key, committed_at, line) of every project as evidence (key, text)."""
    latest = top_rows(commits, [key], [F.col("committed_at").desc(), F.col("line")], limit)
    return latest.select(key, F.col("line").alias("text"))


def union_names(*lists: DataFrame, key: str = "project_id", name: str = "file") -> DataFrame:
    """(key, name): every name that any of the lists holds for the key, once. Nulls are no names."""
    out = lists[0].select(key, name)
    for more in lists[1:]:
        out = out.unionByName(more.select(key, name))
    return out.filter(F.col(name).isNotNull()).distinct()


def evidence_verdicts(
    backlog: DataFrame, evidence: DataFrame, key: str = "project_id", stop_words: Sequence[str] = TASK_STOP_WORDS, at_least: int = 2
) -> DataFrame:
    """(key, id) of open tasks with at least two title tokens, repeats counted, in the evidence."""
    tokens = backlog.filter("NOT done").select(key, "id", F.posexplode(T.task_tokens(F.col("title"), stop_words)).alias("pos", "token"))
    hit = contained_tokens(tokens.select(key, "token").distinct(), evidence, key, "[a-z0-9_-]+", shortest=3)
    hits = lookup_join(tokens, hit, [key, "token"], "left_semi")
    counted = hits.groupBy(key, "id").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= at_least).select(key, "id", F.lit(True).alias("verdict"))


def apply_verdicts(backlog: DataFrame, verdicts: DataFrame, now: str, key: str = "project_id") -> DataFrame:
    """Backlog with open tasks closed where (key, id, verdict) says so; ``marked`` tells which.

    Every backlog that is synced gets ``now`` as its ``updated_at``, also where nothing was closed.
    """
    joined = backlog.join(verdicts, [key, "id"], "left")
    marked = ~F.col("done") & F.coalesce("verdict", F.lit(False))
    return (
        joined.withColumn("marked", marked)
        .withColumn("done_at", F.when(F.col("marked"), now).otherwise(F.col("done_at")))
        .withColumn("already_done", F.col("done"))
        .withColumn("done", F.col("done") | F.col("marked"))
        .withColumn("updated_at", F.lit(now))
        .drop("verdict")
    )


def sync_backlog(backlog: DataFrame, evidence: DataFrame, now: str, key: str = "project_id") -> DataFrame:
    """Close open tasks that the code evidence (key, text) speaks for. Writing is up to the caller."""
    return apply_verdicts(backlog, evidence_verdicts(backlog, evidence, key), now, key)


def sync_result(synced: DataFrame, mode: str = "heuristic", dry_run: bool = False, key: str = "project_id") -> DataFrame:
    """Counts per project; the ids newly done are the ``marked`` rows of ``synced``."""
    return synced.groupBy(key).agg(
        F.count(F.lit(1)).alias("tasks_total"), F.count_if("marked").alias("tasks_marked_done"), F.count_if("already_done").alias("already_done"),
        F.lit(mode).alias("mode"), F.lit(dry_run).alias("dry_run"),
    )


# ---- status --------------------------------------------------------------------------------------


def backlog_status(backlog: DataFrame, key: str = "project_id") -> DataFrame:
    return backlog.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("remaining"),
        F.count_if(~F.col("done") & (F.col("priority") == "high")).alias("high_priority_remaining"),
    )


def high_priority_remaining(backlog: DataFrame, key: str = "project_id", limit: int = 5) -> DataFrame:
    urgent = backlog.filter((~F.col("done")) & (F.col("priority") == "high"))
    return top_rows(urgent, [key], [F.col("ord")], limit).select(key, "rank", "title")


def next_and_last_task(backlog: DataFrame, key: str = "project_id") -> DataFrame:
    """First open and last done task, both by list order."""
    done = F.col("done")
    return backlog.groupBy(key).agg(
        F.min_by(F.when(~done, F.col("title")), F.when(~done, F.col("ord"))).alias("next_task"),
        F.max_by(F.when(done, F.col("title")), F.when(done, F.col("ord"))).alias("last_completed"),
        F.max_by(F.when(done, F.coalesce("done_at", F.lit(""))), F.when(done, F.col("ord"))).alias("last_completed_at"),
    )


def at_risk_files(changed: DataFrame, impact: DataFrame, key: str = "project_id", limit: int = 5) -> DataFrame:
    """First files, by name, that changed files (key, file) put at risk.

    ``impact`` is long: (key, file, other) with dependents and affected tests in ``other``.
    """
    files = changed.select(key, "file").distinct()
    hit = impact.join(files, [key, "file"], "left_semi").select(key, F.col("other").alias("at_risk")).distinct()
    return top_rows(hit, [key], [F.col("at_risk")], limit)


def project_status(backlog: DataFrame, changed: DataFrame, impact: DataFrame, key: str = "project_id") -> DataFrame:
    """Progress, urgent tasks, next and last task and files at risk, one row per project."""

    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", column))).alias(name)).withColumn(
            name, F.transform(name, lambda x: x[column])
        )

    urgent = listed(high_priority_remaining(backlog, key), "title", "high_priority")
    risky = listed(at_risk_files(changed, impact, key), "at_risk", "at_risk")
    return (
        backlog_status(backlog, key)
        .join(next_and_last_task(backlog, key), key)
        .join(urgent, key, "left")
        .join(risky, key, "left")
    )
