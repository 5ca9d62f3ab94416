"""Rendering, saved documents and model batches."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.lexicons import EXCLUDED_DIRS
from threadloom.functions.shuffles import cut_lineage
from threadloom.functions.storage import run_folder
from threadloom.functions.ordering import ord_of
from threadloom.operators import extraction as X
from threadloom.operators import maintenance as N
from threadloom.operators import merging as M
from threadloom.operators import model_batches as B
from threadloom.operators import rendering as R
from threadloom.operators import sessions as A
from threadloom.plans import contexts as C
from threadloom.plans import sessions as P
from threadloom.plans.contexts import NOW
from threadloom.plans.inputs import LEXICON, SQL_MESSAGES, WS, messages, quoted, values
from threadloom.plans.registry import query, table, texts
from threadloom.sources import documents as D
from threadloom.sources import sessions as S
from threadloom.sources import trees


def contexts(spark, sf_dir) -> DataFrame:
    """One merged context per project, as saved."""
    return M.merge_contexts(C.order_items(spark, sf_dir))


_CTX = (
    f"{C._ITEMS}, {C._MERGED}, ctx AS (SELECT m.project_id, m.section, m.o, i.label, i.text, i.detail, i.priority, i.done FROM merged m JOIN items i ON i.seq = m.chosen), "
    "nl AS (SELECT chr(10) AS n)"
)


def _agg(expr: str, section: str, glue: str = "chr(10)", extra: str = "TRUE") -> str:
    return f"string_agg({expr}, {glue} ORDER BY o) FILTER (section = '{section}' AND {extra})"


_N = "chr(10)"
_ENTRY = "'- **' || upper(left(label, 1)) || lower(substr(label, 2)) || '**: ' || text"
_CHECKBOX = "CASE WHEN done THEN '- [x] ' ELSE '- [ ] ' END || text || CASE WHEN priority = 'high' THEN ' *(high priority)*' ELSE '' END || chr(10) || '  - ' || detail"
_ADR = (
    "'## ADR-' || printf('%03d', rn) || ' — ' || label || chr(10) || chr(10) || '**Status:** Accepted' || chr(10) || chr(10) || '**Context:**' || chr(10) || chr(10) || detail || chr(10) || chr(10) "
    "|| '**Decision:**' || chr(10) || chr(10) || text || chr(10) || chr(10) || '**Consequences:**' || chr(10) || chr(10) || '_Document the trade-offs here._'"
)


def _or(value: str, stand_in: str) -> str:
    return f"coalesce({value}, {quoted(stand_in)})"


_DOC_PARTS = {
    "context/overview.md": f"'## Goal' || {_N} || {_N} || {_or('max(text) FILTER (section = ' + quoted('goal') + ')', '(goal not detected — fill in manually)')} || {_N} || {_N} || '## Vision' || {_N} || {_N} "
    f"|| 'Build the system described above using ' || {_or(_agg('text', 'tech_stack', quoted(', ')), 'the chosen tech stack')} || '.' || {_N} || {_N} || '## Success criteria' || {_N} || {_N} || 'See `acceptance-criteria.md` for the explicit definition of done.'",
    "context/architecture.md": f"'## Tech stack' || {_N} || {_N} || {_or(_agg(_ENTRY, 'tech_stack'), '_No tech stack detected — fill in manually._')} || {_N} || {_N} || '## System design' || {_N} || {_N} "
    f"|| CASE WHEN bool_or(section = 'tech_stack') THEN '_Add a high-level component diagram and data-flow description here._' ELSE '_Document the major components here._' END",
    "context/decisions.md": _or(_agg(_ADR, "decision", "chr(10) || chr(10)"), "_No decisions extracted yet._"),
    "context/constraints.md": "CASE WHEN bool_or(section IN ('constraint', 'non_goal')) THEN concat_ws(chr(10) || chr(10), "
    + f"'## Constraints' || {_N} || {_N} || {_agg(quoted('- ') + ' || text', 'constraint')}, '## Non-goals' || {_N} || {_N} || {_agg(quoted('- ') + ' || text', 'non_goal')}) ELSE '_No constraints or non-goals recorded._' END",
    "context/risks.md": f"coalesce('## Open questions' || {_N} || {_N} || {_agg(quoted('- [ ] ') + ' || text', 'open_question')}, '_No open questions or risks recorded._')",
    "context/acceptance-criteria.md": f"coalesce('## Must-have (high-priority tasks)' || {_N} || {_N} || {_agg(quoted('- [ ] ') + ' || text', 'task', extra=chr(112) + 'riority = ' + quoted('high'))}, '_No high-priority tasks recorded — define acceptance criteria manually._')",
    "work/spec.md": f"'## Goal' || {_N} || {_N} || {_or('max(text) FILTER (section = ' + quoted('goal') + ')', '_(see overview.md)_')} || {_N} || {_N} || '## Tech stack' || {_N} || {_N} || {_or(_agg(_ENTRY, 'tech_stack'), '_TBD_')} "
    f"|| {_N} || {_N} || '## Tasks' || {_N} || {_N} || {_or(_agg(quoted('- ') + ' || text', 'task'), '_TBD_')}",
    "work/tasks.md": _or(_agg(_CHECKBOX, "task"), "- [ ] _No tasks extracted — add them manually._"),
}
_DOCS = _CTX + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, section ORDER BY o) AS rn FROM ctx), docs AS (" + " UNION ALL ".join(
    f"SELECT project_id, '{path}' AS rel_path, {body} AS body FROM ranked GROUP BY 1" for path, body in _DOC_PARTS.items()
) + ")"


def knowledge_base_lines(spark, sf_dir) -> DataFrame:
    return R.number_lines(R.document_lines(contexts(spark, sf_dir)))


def knowledge_base(spark, sf_dir) -> DataFrame:
    return R.render_documents(contexts(spark, sf_dir))


@query("b1_render_documents", f"WITH {_DOCS} SELECT * FROM docs")
def _(spark, sf_dir):
    return knowledge_base(spark, sf_dir)


# A target that a user adds: two short documents with a heading, a stand-in and a list each.
BRIEF = (
    R.Fixed("brief.md", 1, ("# Brief", "", "{goal}"), ("goal",)),
    R.Fixed("brief.md", 1, ("# Brief", "", "No goal yet."), ("!goal",)),
    R.Fixed("brief.md", 2, ("", "Made with {stack}."), ("tech_stack",)),
    R.Fixed("brief.md", 3, ("", "## To do", "")),
    R.Listed("brief.md", 4, "task", "checkbox"),
    R.Fixed("brief.md", 4, ("Nothing to do.",), ("!task",)),
    R.Fixed("limits.md", 1, ("# Limits",), ("constraint",)),
    R.Listed("limits.md", 2, "constraint", "bullet"),
    R.Fixed("limits.md", 2, ("No limits.",), ("!constraint",)),
)
_BRIEF_PARTS = {
    "brief.md": f"'# Brief' || {_N} || {_N} || {_or('max(text) FILTER (section = ' + quoted('goal') + ')', 'No goal yet.')} || coalesce({_N} || {_N} || 'Made with ' || {_agg('text', 'tech_stack', quoted(', '))} || '.', '') "
    f"|| {_N} || {_N} || '## To do' || {_N} || {_N} || {_or(_agg(_CHECKBOX, 'task'), 'Nothing to do.')}",
    "limits.md": f"coalesce('# Limits' || {_N} || {_agg(quoted('- ') + ' || text', 'constraint')}, 'No limits.')",
}


@query("e2_render_added_layout", f"WITH {_CTX}, docs AS (" + " UNION ALL ".join(
    f"SELECT project_id, '{path}' AS rel_path, {body} AS body FROM ctx GROUP BY 1" for path, body in _BRIEF_PARTS.items()
) + ") SELECT * FROM docs")
def _(spark, sf_dir):
    return R.render_documents(contexts(spark, sf_dir), BRIEF)


@query("s17_write_documents_plan", f"WITH {_DOCS} SELECT project_id, rel_path FROM docs")
def _(spark, sf_dir):
    return D.write_documents(knowledge_base(spark, sf_dir), "/nowhere", dry_run=True)


@query("s17_write_documents", f"WITH {_DOCS} SELECT project_id, rel_path, length(body) - length(replace(body, chr(10), '')) + 1 AS n_lines, length(body) AS n_chars FROM docs")
def _(spark, sf_dir):
    target = f"{run_folder(spark)}/documents"
    D.write_documents(knowledge_base_lines(spark, sf_dir), target)
    breaks = F.length("line") - F.length(F.replace("line", F.lit("\n"), F.lit("")))
    return spark.read.parquet(target).groupBy("project_id", "rel_path").agg(
        F.sum(breaks + 1).alias("n_lines"), (F.sum(F.length("line") + 1) - 1).alias("n_chars")
    )


@query("s14_read_knowledge_base", (
    f"WITH {_CTX} SELECT project_id, section, CASE WHEN section = 'tech_stack' THEN lower(label) WHEN section = 'decision' THEN label ELSE '' END AS label, trim(text) AS text, "
    "CASE WHEN section = 'decision' THEN detail ELSE '' END AS detail, CASE WHEN section = 'task' THEN priority ELSE '' END AS priority, section = 'task' AND done AS done FROM ctx "
    "UNION ALL SELECT project_id, 'goal', '', '(goal not detected — fill in manually)', '', '', FALSE FROM ctx GROUP BY 1 HAVING NOT bool_or(section = 'goal')"
))
def _(spark, sf_dir):
    return D.read_knowledge_base(knowledge_base_lines(spark, sf_dir)).drop("ord")


_LONG = "SELECT CASE WHEN l_linenumber < 3 THEN 0 ELSE l_suppkey END AS project_id, CASE WHEN l_returnflag = 'R' THEN 'non_goal' WHEN l_linenumber = 1 THEN 'task' WHEN l_linenumber = 2 THEN 'open_question' ELSE 'constraint' END AS section"


@query("s14_long_documents", f"WITH i AS ({_LONG}, 'line ' || l_linenumber || ' of order ' || l_orderkey AS text FROM lineitem) SELECT * FROM i UNION ALL SELECT DISTINCT project_id, 'goal', '(goal not detected — fill in manually)' FROM i UNION ALL SELECT project_id, 'task', '_No tasks extracted — add them manually._' FROM i GROUP BY 1 HAVING NOT bool_or(section = 'task')")
def _(spark, sf_dir):
    text = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of order "), F.col("l_orderkey").cast("string"))
    project = F.when(F.col("l_linenumber") < 3, 0).otherwise(F.col("l_suppkey"))
    section = (
        F.when(F.col("l_returnflag") == "R", "non_goal").when(F.col("l_linenumber") == 1, "task").when(F.col("l_linenumber") == 2, "open_question").otherwise("constraint")
    )
    items = table(spark, sf_dir, "lineitem").select(
        project.alias("project_id"), section.alias("section"), ord_of(seq=F.col("l_orderkey"), sub=F.col("l_linenumber")).alias("ord"), F.lit("").alias("label"),
        text.alias("text"), F.lit("").alias("detail"), F.lit("medium").alias("priority"), F.lit(False).alias("done"),
    )
    return D.read_knowledge_base(R.number_lines(R.document_lines(items))).select("project_id", "section", "text")


@query("s15_read_plan_checklist", (
    f"WITH {_CTX} SELECT project_id, 2 * (row_number() OVER (PARTITION BY project_id ORDER BY o) - 1) AS ord, trim(text || CASE WHEN priority = 'high' THEN ' *(high priority)*' ELSE '' END) AS title, done FROM ctx WHERE section = 'task'"
))
def _(spark, sf_dir):
    plans = knowledge_base(spark, sf_dir).filter("rel_path = 'work/tasks.md'")
    return D.read_plan_checklist(plans).select("project_id", F.col("ord").cast("bigint").alias("ord"), "title", "done")


def _json_field(name: str, section: str, item: str, brackets: str = "[]") -> str:
    return f"'\"{name}\":{brackets[0]}' || chr(10) || coalesce({_agg(item, section, 'chr(10) || ' + quoted(','))} || chr(10), '') || '{brackets[1]}'"


_J_TASK = "'{\"title\":\"' || text || '\",\"description\":\"' || detail || '\",\"priority\":\"' || priority || '\",\"done\":' || done || '}'"
_J_DECISION = "'{\"topic\":\"' || label || '\",\"decision\":\"' || text || '\",\"rationale\":\"' || detail || '\"}'"
_J_TEXT = "'\"' || text || '\"'"
_J_TECH = "'\"' || label || '\":\"' || text || '\"'"
_J_GOAL = "'{\"goal\":\"' || coalesce(max(text) FILTER (section = 'goal'), '') || '\",' || chr(10)"
_CONTEXT_JSON = " || ',' || chr(10) || ".join([
    _J_GOAL + " || " + _json_field("tech_stack", "tech_stack", _J_TECH, "{}"), _json_field("tasks", "task", _J_TASK),
    _json_field("constraints", "constraint", _J_TEXT), _json_field("open_questions", "open_question", _J_TEXT),
]) + " || '}'"
_FULL_JSON = " || ',' || chr(10) || ".join([
    _J_GOAL + " || " + _json_field("tech_stack", "tech_stack", _J_TECH, "{}"), _json_field("decisions", "decision", _J_DECISION), _json_field("tasks", "task", _J_TASK),
    _json_field("constraints", "constraint", _J_TEXT), _json_field("non_goals", "non_goal", _J_TEXT), _json_field("open_questions", "open_question", _J_TEXT),
]) + " || '}'"


@query("b2_export_context_json", f"WITH {_CTX} SELECT project_id, {_CONTEXT_JSON} AS body FROM ctx GROUP BY 1")
def _(spark, sf_dir):
    return R.export_context_json(contexts(spark, sf_dir)).select("project_id", "body")


_TITLES = "titles AS (SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS title FROM customer WHERE c_custkey % 3 < 2)"


def manifest(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    titles = table(spark, sf_dir, "customer").filter(key % 3 < 2).select(key.alias("project_id"), F.when(key % 3 == 0, F.col("c_name")).otherwise("").alias("title"))
    return R.build_manifest(contexts(spark, sf_dir), titles, "merged", "all", "1.0", NOW)


_MANIFEST = (
    f"{_TITLES}, man AS (SELECT c.project_id, '1.0' AS schema_version, '1.0' AS version, '{NOW}' AS generated_at, 'merged' AS source, 'all' AS target, "
    "coalesce(nullif(max(t.title), ''), nullif(max(c.text) FILTER (c.section = 'goal'), ''), 'Untitled project') AS project FROM ctx c LEFT JOIN titles t USING (project_id) GROUP BY 1)"
)


@query("b4_manifest", f"WITH {_CTX}, {_MANIFEST} SELECT * FROM man")
def _(spark, sf_dir):
    return manifest(spark, sf_dir)


def backlog(spark, sf_dir) -> DataFrame:
    tasks = contexts(spark, sf_dir).filter("section = 'task'")
    return N.assign_backlog_ids(tasks.select("project_id", "ord", F.col("text").alias("title"), F.col("detail").alias("description"), "priority", "done"), NOW)


_BACKLOG_DOC = (
    "bl AS (SELECT *, printf('task-%03d', row_number() OVER (PARTITION BY project_id ORDER BY o)) AS id FROM ctx WHERE section = 'task'), "
    "bdoc AS (SELECT m.project_id, '{\"schema_version\":\"1.0\",\"updated_at\":\"' || generated_at || '\",\"project\":\"' || any_value(project) || '\",\"tasks\":[' || chr(10) || coalesce(string_agg("
    f"'{{\"id\":\"' || id || '\",\"title\":\"' || text || '\",\"description\":\"' || detail || '\",\"phase\":\"1\",\"priority\":\"' || priority || '\",\"done\":' || done || ',\"tags\":[],\"added_at\":\"{NOW}\",\"done_at\":' || "
    f"CASE WHEN done THEN '\"{NOW}\"' ELSE 'null' END || '}}', chr(10) || ',' ORDER BY o) || chr(10), '') || '],\"milestones\":[]}}' AS body FROM man m LEFT JOIN bl USING (project_id) GROUP BY m.project_id, generated_at)"
)


@query("b5_backlog_json", f"WITH {_CTX}, {_MANIFEST}, {_BACKLOG_DOC} SELECT project_id, body FROM bdoc")
def _(spark, sf_dir):
    return R.backlog_json(backlog(spark, sf_dir), manifest(spark, sf_dir)).select("project_id", "body")


@query("s14_read_backlog", (
    f"WITH {_CTX} SELECT project_id, printf('task-%03d', row_number() OVER (PARTITION BY project_id ORDER BY o)) AS id, row_number() OVER (PARTITION BY project_id ORDER BY o) - 1 AS ord, text AS title, '1' AS phase, priority, done, "
    f"CASE WHEN done THEN '{NOW}' END AS done_at, '{NOW}' AS updated_at FROM ctx WHERE section = 'task'"
))
def _(spark, sf_dir):
    saved = D.read_backlog(R.number_lines(R.backlog_json_lines(backlog(spark, sf_dir), manifest(spark, sf_dir))))
    return saved.select("project_id", "id", F.col("ord.seq").alias("ord"), "title", "phase", "priority", "done", "done_at", "updated_at")


_B3_DOC = " || ".join([
    "'# Session summary — loader' || chr(10) || chr(10) || 'Generated: ' || '" + NOW + "' || ' | Session: `' || left(f.session_id, 8) || '`' || chr(10) || 'Branch: `' || f.git_branch || '` | Started: ' || coalesce(nullif(left(f.started_at, 10), ''), 'unknown') || chr(10)",
    "chr(10) || '---' || chr(10) || chr(10) || '## What Was Accomplished' || chr(10) || chr(10) || coalesce((SELECT string_agg('- ' || upper(left(action, 1)) || substr(action, 2) || ': `' || file || '`', chr(10) ORDER BY first_seq) FROM changes c WHERE c.path = f.path), '*(no file changes detected in session)*') || chr(10)",
    "chr(10) || '---' || chr(10) || chr(10) || '## Files Changed' || chr(10) || chr(10) || coalesce('| File | Action |' || chr(10) || '|------|--------|' || chr(10) || (SELECT string_agg('| `' || file || '` | ' || action || ' |', chr(10) ORDER BY first_seq) FROM changes c WHERE c.path = f.path), '*(none)*') || chr(10)",
    "chr(10) || '---' || chr(10) || chr(10) || '## Tasks (matched from PLAN.md)' || chr(10) || chr(10) || coalesce((SELECT string_agg(CASE WHEN done THEN '- [x] ' || title ELSE '- [ ] ' || title || CASE WHEN priority = 'high' THEN ' ← **high priority**' ELSE '' END END, chr(10) ORDER BY NOT done, ord) FROM settled t WHERE t.path = f.path), '*(no PLAN.md found in project directory)*') || chr(10)",
    "chr(10) || '---' || chr(10) || chr(10) || '## Decisions Made During Implementation' || chr(10) || chr(10) || coalesce((SELECT string_agg('- ' || d, chr(10) ORDER BY ord) FROM dec c WHERE c.path = f.path AND ord <= 10), '*(none extracted — run with LLM enabled or add decisions manually)*') || chr(10)",
    "chr(10) || '---' || chr(10) || chr(10) || '## Where the Session Ended' || chr(10) || chr(10) || '**Last action:** ' || coalesce(l.last_action, 'unknown') || coalesce(chr(10) || '**Context used:** ~' || u.context_usage_pct || '%', '') || chr(10)",
    "chr(10) || '---' || chr(10) || chr(10) || '## Recommended Next Steps' || chr(10) || chr(10) || (SELECT string_agg(ord || '. ' || step, chr(10) ORDER BY ord) FROM steps s WHERE s.path = f.path) || chr(10)",
    "chr(10) || '---' || coalesce(chr(10) || chr(10) || '## Commands Run' || chr(10) || chr(10) || '```bash' || chr(10) || (SELECT string_agg(command, chr(10) ORDER BY ord) FROM commands c WHERE c.path = f.path) || chr(10) || '```', '')",
])


@query("b3_render_session_summary", (
    f"WITH {P._E}, {P._CHANGES}, {P._COMMANDS}, {P._USAGE}, {P._FIRSTS}, {P._PLAN}, {P._STEPS}, "
    "dec AS (SELECT path, 'We decided to keep variant ' || k || ' of the loader for all the tables here' AS d, row_number() OVER (PARTITION BY path ORDER BY min(seq)) AS ord FROM e WHERE tool IS NOT NULL GROUP BY path, k) "
    f"SELECT f.path, {_B3_DOC} AS body FROM firsts f LEFT JOIN (SELECT path, arg_max({P._ACTION}, seq) AS last_action FROM e WHERE tool IS NOT NULL GROUP BY 1) l USING (path) LEFT JOIN usage u USING (path)"
))
def _(spark, sf_dir):
    facts = cut_lineage(P.facts(spark, sf_dir))  # the summary, the changes and the tasks are read off it
    changes = A.file_changes(facts)
    matched = cut_lineage(A.match_plan_tasks(P.plan_tasks(spark, sf_dir), changes))
    tasks = matched.join(facts.select("path").distinct(), "path", "left_semi")
    summary = A.summarise_sessions(facts, tasks=matched)
    return R.render_session_summary(summary, changes, tasks, NOW, project="loader").select("path", "body")


# ---- model batches -------------------------------------------------------------------------------


def _sql_fill(template: str, value: str) -> str:
    before, _, after = template.partition("{conversation}")
    return f"{quoted(before)} || {value} || {quoted(after)}"


_TRANSCRIPT = "string_agg(upper(role) || ': ' || content, chr(10) ORDER BY seq)"


@query("m1_build_prompts", f"WITH {SQL_MESSAGES} SELECT conv_id, {_sql_fill(B.EXTRACT_TEMPLATE, f'right({_TRANSCRIPT}, 60000)')} AS prompt FROM msgs GROUP BY 1")
def _(spark, sf_dir):
    return B.conversation_prompts(messages(spark, sf_dir))


@query("m1_build_prompts_truncated", f"WITH {SQL_MESSAGES} SELECT conv_id, {_sql_fill(B.DOCUMENTS_TEMPLATE, f'right({_TRANSCRIPT}, 1500)')} AS prompt FROM msgs GROUP BY 1")
def _(spark, sf_dir):
    return B.conversation_prompts(messages(spark, sf_dir), B.DOCUMENTS_TEMPLATE, limit=1500)


_SESSION_TEXT = "string_agg('[' || CASE WHEN tool IS NULL THEN 'USER' ELSE 'ASSISTANT' END || ']' || chr(10) || CASE WHEN tool IS NULL THEN 'look at ' || k ELSE 'We decided to keep variant ' || k || ' of the loader for all the tables here' END, chr(10) || chr(10) ORDER BY seq)"


@query("m1_session_prompts", (
    f"WITH {P._E}, t AS (SELECT path, {_SESSION_TEXT} AS x FROM e GROUP BY 1) SELECT path, "
    + _sql_fill(B.SESSION_TEMPLATE, f"CASE WHEN length(x) > 2000 THEN {quoted(B.TRUNCATION_NOTE)} || right(x, 2000) ELSE x END") + " AS prompt FROM t"
))
def _(spark, sf_dir):
    return B.session_prompts(S.session_messages(P.entries(spark, sf_dir)), limit=2000)


_YEARLY = "yearly AS (SELECT project_id, session_ord // 100 AS session_ord, section, seq AS o, label, text, detail, priority, done FROM items)"


def yearly_items(spark, sf_dir) -> DataFrame:
    """One context per project and year, each item once."""
    return C.order_items(spark, sf_dir).withColumn("session_ord", F.floor(F.col("session_ord") / 100))


@query("m1_merge_prompts", (
    f"WITH {C._ITEMS}, {_YEARLY}, each_ AS (SELECT project_id, session_ord, 'Session ' || session_ord || ':' || chr(10) || {_FULL_JSON.replace('max(text) FILTER', 'arg_max(text, o) FILTER')} AS x FROM yearly GROUP BY 1, 2) "
    "SELECT project_id, 'Merge the contexts below into one JSON object of the same form. The latest session wins.' || chr(10) || string_agg(x, chr(10) ORDER BY session_ord) AS body FROM each_ GROUP BY 1"
))
def _(spark, sf_dir):
    return B.merge_prompts(yearly_items(spark, sf_dir)).select("project_id", "body")


@query("m1_sync_prompts", (
    f"WITH {C._BACKLOG}, {C._EVIDENCE}, {C._LATEST}, idx AS (SELECT c_custkey AS project_id, c_name AS text FROM customer WHERE c_custkey % 2 = 0), "
    "com AS (SELECT project_id, string_agg(text, chr(10) ORDER BY text) AS x FROM ev WHERE project_id % 3 > 0 GROUP BY 1), "
    "open_ AS (SELECT project_id, string_agg('{\"id\":\"' || id || '\",\"title\":\"' || title || '\",\"description\":\"\"}', chr(10) ORDER BY ord) AS t FROM backlog WHERE NOT done GROUP BY 1) "
    "SELECT o.project_id, 'Answer with one JSON object {task id: true or false}: true only where the evidence shows that a task is done.' || chr(10) || 'Tasks:' || chr(10) || t || chr(10) || 'Code index:' || chr(10) || coalesce(idx.text, '(empty)') "
    "|| chr(10) || 'Recent commits:' || chr(10) || coalesce(com.x, '(no commits)') AS body FROM open_ o LEFT JOIN idx USING (project_id) LEFT JOIN com USING (project_id)"
))
def _(spark, sf_dir):
    from pyspark.sql import Window

    rows = C.order_backlog(spark, sf_dir).withColumn("ord", ord_of(seq=F.col("ord")))
    index = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("text"))
    latest = N.recent_commits(C.part_evidence(spark, sf_dir).withColumnRenamed("text", "line")).filter("project_id % 3 > 0")
    commits = latest.select("project_id", F.col("text").alias("line"), F.row_number().over(Window.partitionBy("project_id").orderBy("text")).alias("ord"))
    return B.sync_prompts(rows, index, commits).select("project_id", "body")


def context_answers(spark, sf_dir) -> DataFrame:
    """Contexts as model answers: some fenced, some cut off."""
    body = R.assemble_documents(R.context_json_lines(contexts(spark, sf_dir), fields=B._MERGED_FIELDS))
    key = F.col("project_id")
    text = F.when(key % 7 == 3, F.left("body", F.lit(60))).when(key % 2 == 0, F.concat(F.lit("```json\n"), "body", F.lit("\n```\n"))).otherwise(F.col("body"))
    return body.select("project_id", text.alias("text"))


@query("m2_parse_context_responses", (
    f"WITH {_CTX} SELECT project_id, section, CASE WHEN section IN ('tech_stack', 'decision') THEN label ELSE '' END AS label, text, CASE WHEN section IN ('task', 'decision') THEN detail ELSE '' END AS detail, "
    "CASE WHEN section = 'task' THEN priority ELSE '' END AS priority, section = 'task' AND done AS done FROM ctx WHERE project_id % 7 <> 3 "
    "UNION ALL SELECT project_id, 'goal', '', '', '', '', FALSE FROM ctx WHERE project_id % 7 <> 3 GROUP BY 1 HAVING NOT bool_or(section = 'goal')"
))
def _(spark, sf_dir):
    items, _ = B.parse_context_responses(context_answers(spark, sf_dir), ["project_id"])
    return items.drop("ord")


@query("m2_context_response_errors", f"WITH {_CTX} SELECT DISTINCT project_id FROM ctx WHERE project_id % 7 = 3")
def _(spark, sf_dir):
    return B.parse_context_responses(context_answers(spark, sf_dir), ["project_id"])[1].select("project_id")


def body_answers(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    whole = F.concat(F.lit('{"overview": "'), "c_name", F.lit('", "risks": "'), "c_mktsegment", F.lit('", "work_spec": 7}'))
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("```\n"), whole, F.lit("\n```"))).when(key % 4 == 1, F.concat(F.lit('{"overview": "'), "c_name", F.lit('", "risks": "'), F.left("c_mktsegment", F.lit(4))))
        .when(key % 4 == 2, F.concat(F.lit('{"overview": "'), "c_name", F.lit('", "ris'))).otherwise("no json at all")
    )
    return texts(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select("c_custkey", text.alias("text"))


_FIELD_ROWS = values((f,) for f in B.BODY_FIELDS)


@query("m3_parse_body_responses", (
    f"SELECT c_custkey, field, CASE WHEN field = 'overview' THEN c_name WHEN field = 'risks' AND c_custkey % 4 = 0 THEN c_mktsegment WHEN field = 'risks' AND c_custkey % 4 = 1 THEN left(c_mktsegment, 4) "
    f"WHEN field = 'work_spec' AND c_custkey % 4 = 0 THEN '7' ELSE '' END AS body FROM customer, {_FIELD_ROWS} f(field) WHERE c_custkey % 4 < 3"
))
def _(spark, sf_dir):
    return B.parse_body_responses(body_answers(spark, sf_dir), ["c_custkey"])[0]


@query("m3_body_response_errors", "SELECT c_custkey, 'Model returned invalid JSON: no json at all' AS error FROM customer WHERE c_custkey % 4 = 3")
def _(spark, sf_dir):
    return B.parse_body_responses(body_answers(spark, sf_dir), ["c_custkey"])[1]


@query("f10_repair_json", (
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN '{\"overview\": \"' || c_name || '\", \"risks\": \"' || left(c_mktsegment, 4) || '\"}' WHEN 2 THEN '{\"overview\": \"' || c_name || '\"}' WHEN 0 THEN '{\"overview\": \"' || c_name || '\", \"risks\": \"' || c_mktsegment || '\", \"work_spec\": 7}' END AS json FROM customer"
))
def _(spark, sf_dir):
    return body_answers(spark, sf_dir).select("c_custkey", T.repair_json(T.strip_fences(F.col("text"))).alias("json"))


@query("m4_parse_verdict_responses", (
    "SELECT o_custkey AS project_id, id, verdict FROM orders, (VALUES ('a', TRUE), ('b', TRUE), ('c', FALSE), ('d', FALSE), ('e', FALSE), ('f', TRUE), ('g', FALSE)) v(id, verdict) WHERE o_orderkey % 5 > 0"
))
def _(spark, sf_dir):
    answer = F.lit('{"a": true, "b": "no", "c": 0, "d": "", "e": null, "f": [1], "g": {}}')
    text = F.when(F.col("o_orderkey") % 5 == 0, "[1]").when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), text.alias("text"))
    return B.parse_verdict_responses(rows)[0]


@query("m5_parse_session_responses", (
    "SELECT event_id AS path, CASE event_id % 4 WHEN 0 THEN 'use ' || event_type WHEN 3 THEN 'rule' ELSE '' END AS decisions, CASE event_id % 4 WHEN 0 THEN 'test|ship' WHEN 3 THEN 'step' ELSE '' END AS next_steps FROM events"
))
def _(spark, sf_dir):
    key = F.col("event_id")
    text = F.when(key % 4 == 0, F.concat(F.lit('```json\n{"decisions": ["use '), "event_type", F.lit('"], "next_steps": ["test", "ship"]}\n```'))).when(key % 4 == 1, "oops").when(key % 4 == 2, "{}")
    rows = table(spark, sf_dir, "events")
    answers = rows.select(key.alias("path"), text.alias("text"))
    rules = rows.select(key.alias("path"), F.array(F.lit("rule")).alias("decisions"), F.array(F.lit("step")).alias("next_steps"))
    out = B.parse_session_responses(answers, rules)
    return out.select("path", F.array_join("decisions", "|").alias("decisions"), F.array_join("next_steps", "|").alias("next_steps"))


# ---- scalars and files ---------------------------------------------------------------------------


@query("f1_py_strip", f"SELECT doc_id, md5(trim(chr(160) || chr(9) || text || chr(8195), {WS})) AS stripped FROM documents")
def _(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), "text", F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip(padded)).alias("stripped"))


@query("f2_clean_goal", (
    "WITH b AS (SELECT doc_id, rtrim(trim('Of ' || text || '??', {0}), '?') AS b FROM documents), c AS (SELECT doc_id, substr(b, 4) AS c FROM b) "
    "SELECT doc_id, left(upper(left(c, 1)) || substr(c, 2), 300) AS goal FROM c"
).format(WS))
def _(spark, sf_dir):
    raw = F.concat(F.lit("Of "), "text", F.lit("??"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_goal(raw, LEXICON.goal_prefixes).alias("goal"))


@query("f4_canonical_tech", (
    "SELECT conv_id, turn, word, name FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM conversations) JOIN "
    + values((w, n) for listed in LEXICON.tech.values() for w, n in listed.items()) + " t(word, name) USING (word)"
))
def _(spark, sf_dir):
    words = F.explode(F.array_distinct(T.words(F.lower("text"), "[a-z]+")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("word")).withColumn("name", X.canonical_tech(F.col("word"), LEXICON)).filter("name IS NOT NULL")


@query("f8_truncate", "SELECT doc_id, right(text, 200) AS tail, left(text, 200) AS head FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tail_truncate(F.col("text"), 200).alias("tail"), T.head_truncate(F.col("text"), 200).alias("head"))


@query("f9_strip_fences", f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN trim(text, {WS}) ELSE trim(text, {WS}) END) AS body FROM documents WHERE trim(text, {WS}) <> ''")
def _(spark, sf_dir):
    bare = T.strip(F.col("text"))
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).otherwise(bare)
    return table(spark, sf_dir, "documents").filter(bare != "").select("doc_id", F.md5(T.strip_fences(fenced)).alias("body"))


# A file for every four parts, in one of seven repositories: some below excluded folders, some binary, some too long.
_FOLDERS = ("src", "src/deep/er", "node_modules/lib", ".git/objects", "build", "docs", "pkg.egg-info", "_private")
_TREE_FILES = (
    "f AS (SELECT p_partkey // 4 AS k, string_agg('part ' || p_name, chr(10) ORDER BY p_partkey) || repeat(chr(10), CASE WHEN p_partkey // 4 % 31 = 0 THEN 600 ELSE 0 END) AS body "
    "FROM part GROUP BY p_partkey // 4), "
    f"placed AS (SELECT 'r' || (k % 7) AS repo_id, [{', '.join(repr(d) for d in _FOLDERS)}][k % 8 + 1] AS folder, 'f' || k || '.py' AS name, k, "
    "body || CASE WHEN k % 13 = 0 THEN chr(10) || '?' ELSE '' END AS body FROM f)"
)


def _write_files(root: str):
    """Task code that writes rows (path, content) below ``root`` and, where folders can be linked, a loop in every repository."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
                system.create_dir(f"{base}/{path.rsplit('/', 1)[0]}")
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
                loop = f"{base}/{path.split('/')[0]}/loop"
                if system.type_name == "local":
                    try:
                        os.symlink(base, loop)
                    except FileExistsError:
                        pass
            yield batch[["path"]]

    return run


@query("s13_scan_source_tree", (
    f"WITH {_TREE_FILES} SELECT repo_id, folder || '/' || name AS path, strlen(body) AS size, length(body) - length(replace(body, chr(10), '')) + 1 AS line_count FROM placed "
    "WHERE folder NOT IN ('node_modules/lib', '.git/objects', 'build', 'pkg.egg-info') AND k % 13 > 0 AND k % 31 > 0"
))
def _(spark, sf_dir):
    root = run_folder(spark) + "/tree"
    k = F.floor(F.col("p_partkey") / 4)
    lines = F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit("part "), "p_name").alias("line"))))
    files = table(spark, sf_dir, "part").groupBy(k.alias("k")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))
    long = F.when(F.col("k") % 31 == 0, F.repeat(F.lit("\n"), 600)).otherwise("")
    zero = F.when(F.col("k") % 13 == 0, F.lit("\n\0")).otherwise("")
    folder = F.element_at(F.array(*[F.lit(d) for d in _FOLDERS]), (F.col("k") % 8 + 1).cast("int"))
    path = F.concat(F.lit("r"), F.col("k") % 7, F.lit("/"), folder, F.lit("/f"), F.col("k"), F.lit(".py"))
    rows = files.select(path.alias("path"), F.concat("body", long, zero).cast("binary").alias("content"))
    rows.mapInPandas(_write_files(root), "path STRING").write.format("noop").mode("overwrite").save()
    found = trees.source_files(trees.read_tree(spark, root, repo_depth=1, excluded=EXCLUDED_DIRS))
    return found.select("repo_id", "path", "size", F.col("line_count").cast("bigint").alias("line_count"))
