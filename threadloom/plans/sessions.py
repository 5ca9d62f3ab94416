"""Agent-session operators over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import sessions as A
from threadloom.plans.registry import query, table, texts
from threadloom.sources import sessions as S

# An event becomes one log line: views are user turns, signups housekeeping, the rest tool calls.
_TOOL = {"click": "Write", "purchase": "Edit", "error": "Bash"}


def session_lines(spark, sf_dir) -> DataFrame:
    events = texts(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    tool = F.coalesce(*[F.when(kind == e, F.lit(t)) for e, t in _TOOL.items()])
    given = F.struct(
        F.when(kind != "error", F.concat(F.lit("/src/module"), k, F.lit(".py"))).alias("file_path"),
        F.when(kind == "error", F.concat(F.lit(" make target"), k)).alias("command"),
    )
    thought = F.concat(F.lit("We decided to keep variant "), k, F.lit(" of the loader for all the tables here"))
    blocks = F.to_json(F.array(
        F.struct(F.lit("text").alias("type"), thought.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(given_type()).alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), tool.alias("name"), given.alias("input")),
    ))
    content = F.when(kind == "view", F.concat(F.lit('" look at '), k, F.lit(' "'))).otherwise(blocks)
    usage = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "usage": {"input_tokens": '), k * 1000, F.lit(', "cache_read_input_tokens": 7}'))).otherwise("")
    line = F.concat(
        F.lit('{"type": "'), F.when(kind == "view", "user").when(kind == "signup", "summary").otherwise("assistant"),
        F.lit('", "sessionId": "s'), F.col("user_id"), F.lit('", "timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('", "cwd": "/work/p'), F.col("user_id") % 7, F.lit('", "gitBranch": "b'), k % 3, F.lit('", "version": "1.'), k,
        F.lit('", "message": {"content": '), content, usage, F.lit("}}"),
    )
    broken = F.when(F.col("event_id") % 97 == 0, F.left(line, F.lit(40))).otherwise(line)
    user = F.col("user_id").cast("string")
    return events.select(
        F.concat(F.lit("/logs/"), user, F.lit(".jsonl")).alias("path"), F.concat(F.lit("stem"), user).alias("stem"),
        (F.col("user_id") * 10).alias("size"), F.col("event_id").alias("seq"), broken.alias("line"),
    )


def given_type() -> str:
    return "struct<file_path:string,command:string>"


def entries(spark, sf_dir) -> DataFrame:
    return S.read_session_entries(session_lines(spark, sf_dir))


def facts(spark, sf_dir) -> DataFrame:
    return A.session_facts(entries(spark, sf_dir))


_E = (
    "e AS (SELECT '/logs/' || user_id || '.jsonl' AS path, 'stem' || user_id AS stem, user_id, event_id AS seq, event_type, "
    "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, "
    "CASE event_type WHEN 'click' THEN 'Write' WHEN 'purchase' THEN 'Edit' WHEN 'error' THEN 'Bash' END AS tool "
    "FROM events WHERE event_type <> 'signup' AND event_id % 97 <> 0)"
)


@query("s9_read_session_entries", (
    f"WITH {_E} SELECT path, seq, CASE WHEN tool IS NULL THEN 'user' ELSE 'assistant' END AS type, 's' || user_id AS session_id, timestamp, "
    "'b' || (k % 3) AS git_branch, CASE WHEN seq % 3 = 0 THEN CAST(k * 1000 AS BIGINT) END AS input_tokens FROM e"
))
def _(spark, sf_dir):
    return entries(spark, sf_dir).select("path", "seq", "type", "session_id", "timestamp", "git_branch", F.col("usage.input_tokens").alias("input_tokens"))


@query("s10_session_messages", (
    f"WITH {_E} SELECT path, seq, CASE WHEN tool IS NULL THEN 'user' ELSE 'assistant' END AS role, "
    "CASE WHEN tool IS NULL THEN 'look at ' || k ELSE 'We decided to keep variant ' || k || ' of the loader for all the tables here' END AS content, timestamp FROM e"
))
def _(spark, sf_dir):
    return S.session_messages(entries(spark, sf_dir))


@query("r2_tool_use_events", (
    f"WITH {_E} SELECT path, seq, CAST(1 AS BIGINT) AS pos, tool AS name, CASE WHEN tool <> 'Bash' THEN '/src/module' || k || '.py' END AS file_path, "
    "CASE WHEN tool = 'Bash' THEN ' make target' || k END AS command FROM e WHERE tool IS NOT NULL"
))
def _(spark, sf_dir):
    return S.tool_use_events(entries(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))


_CHANGES = (
    "changes AS (SELECT path, '/src/module' || k || '.py' AS file, CASE WHEN count(*) = 1 AND min(tool) = 'Write' THEN 'created' ELSE 'modified' END AS action, "
    "min(seq) AS first_seq FROM e WHERE tool IN ('Write', 'Edit') GROUP BY 1, 2)"
)


@query("w1_file_changes", f"WITH {_E}, {_CHANGES} SELECT * FROM changes")
def _(spark, sf_dir):
    return A.file_changes(facts(spark, sf_dir)).select("path", "file", "action", F.col("first_at.seq").alias("first_seq"))


_ACTION = "CASE WHEN tool = 'Bash' THEN 'Bash:  make target' || k ELSE tool || ' /src/module' || k || '.py' END"


@query("w2_last_action", f"WITH {_E} SELECT path, arg_max({_ACTION}, seq) AS last_action FROM e WHERE tool IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return A.last_action(facts(spark, sf_dir))


_COMMANDS = (
    "commands AS (SELECT path, command, ord FROM (SELECT path, 'make target' || k AS command, row_number() OVER (PARTITION BY path ORDER BY min(seq)) AS ord "
    "FROM e WHERE tool = 'Bash' GROUP BY path, k) WHERE ord <= 20)"
)


@query("t4_session_commands", f"WITH {_E}, {_COMMANDS} SELECT * FROM commands")
def _(spark, sf_dir):
    return A.session_commands(facts(spark, sf_dir)).withColumn("ord", F.col("ord").cast("bigint"))


_USAGE = (
    "usage AS (SELECT path, CASE WHEN t >= 1000 THEN CAST(least(100, round_even(t / 200000.0 * 100, 0)) AS BIGINT) END AS context_usage_pct FROM "
    "(SELECT path, arg_max(k * 1000 + 7, seq) AS t FROM e WHERE tool IS NOT NULL AND seq % 3 = 0 GROUP BY 1))"
)


@query("a8_context_usage", f"WITH {_E}, {_USAGE} SELECT * FROM usage")
def _(spark, sf_dir):
    return A.context_usage(facts(spark, sf_dir)).withColumn("context_usage_pct", F.col("context_usage_pct").cast("bigint"))


_FIRSTS = (
    "firsts AS (SELECT path, 's' || min(user_id) AS session_id, coalesce(arg_min(timestamp, seq) FILTER (tool IS NULL), '') AS started_at, "
    "'b' || (arg_min(k, seq) % 3) AS git_branch FROM e GROUP BY 1)"
)


@query("a7_first_metadata", f"WITH {_E}, {_FIRSTS} SELECT * FROM firsts")
def _(spark, sf_dir):
    return A.first_metadata(facts(spark, sf_dir))


_META = (
    "meta AS (SELECT path, stem AS session_id, '/work/p' || (user_id % 7) AS project_path, arg_min(timestamp, seq) FILTER (tool IS NULL) AS started_at, "
    "'b' || (arg_min(k, seq) FILTER (tool IS NULL) % 3) AS git_branch, count(*) AS message_count, user_id * 10 AS size_bytes "
    "FROM e GROUP BY path, stem, user_id HAVING bool_or(tool IS NULL))"
)


@query("a6_session_meta", f"WITH {_E}, {_META} SELECT * FROM meta")
def _(spark, sf_dir):
    return S.session_meta(entries(spark, sf_dir))


@query("s11_session_listing", f"WITH {_E}, {_META} SELECT path, session_id AS conv_id, 'Session ' || left(session_id, 8) || ' @ ' || left(started_at, 10) AS title, started_at AS date FROM meta")
def _(spark, sf_dir):
    return S.session_listing(S.session_meta(entries(spark, sf_dir)))


@query("s12_session_format_version", f"WITH {_E} SELECT path, coalesce('1.' || arg_min(k, seq) FILTER (tool IS NULL), 'unknown') AS format_version FROM e GROUP BY 1")
def _(spark, sf_dir):
    return S.session_format_version(entries(spark, sf_dir))


@query("w5_latest_session", f"WITH {_E}, {_META} SELECT project_path, session_id, started_at FROM meta QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY started_at DESC, session_id) = 1")
def _(spark, sf_dir):
    return A.latest_session(S.session_meta(entries(spark, sf_dir))).select("project_path", "session_id", "started_at")


@query("t1_recent_sessions", f"WITH {_E}, {_META}, r AS (SELECT project_path, session_id, row_number() OVER (PARTITION BY project_path ORDER BY started_at DESC, session_id) AS rank FROM meta) SELECT * FROM r WHERE rank <= 10")
def _(spark, sf_dir):
    rows = A.recent_sessions(S.session_meta(entries(spark, sf_dir)))
    return rows.select("project_path", "session_id", F.col("rank").cast("bigint").alias("rank"))


def plan_tasks(spark, sf_dir) -> DataFrame:
    """One plan per session from its events: the title names a module that may have been changed."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select(
        F.concat(F.lit("/logs/"), F.col("user_id"), F.lit(".jsonl")).alias("path"), F.col("event_id").alias("ord"),
        F.concat(F.lit("Fix module"), k, F.lit(", now")).alias("title"), F.when(k % 4 == 0, "high").otherwise("medium").alias("priority"), (k % 5 == 0).alias("done"),
    )


_PLAN = (
    "plan AS (SELECT '/logs/' || user_id || '.jsonl' AS path, event_id AS ord, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'signup'), "
    "settled AS (SELECT p.path, p.ord, 'Fix module' || k || ', now' AS title, CASE WHEN k % 4 = 0 THEN 'high' ELSE 'medium' END AS priority, "
    "k % 5 = 0 OR EXISTS (SELECT 1 FROM changes c WHERE c.path = p.path AND contains(c.file, 'module' || p.k)) AS done FROM plan p)"
)


@query("j8_match_plan_tasks", f"WITH {_E}, {_CHANGES}, {_PLAN} SELECT * FROM settled")
def _(spark, sf_dir):
    return A.match_plan_tasks(plan_tasks(spark, sf_dir), A.file_changes(facts(spark, sf_dir)))


_STEPS = (
    "ranked AS (SELECT path, title, row_number() OVER (PARTITION BY path ORDER BY priority <> 'high', ord) AS ord FROM settled WHERE NOT done), "
    "steps AS (SELECT s.path, coalesce(r.ord, 1) AS ord, coalesce('Complete: ' || r.title, CASE WHEN s.path IN (SELECT path FROM changes) "
    "THEN 'Review changed files and run tests' ELSE 'Review session output and continue implementation' END) AS step "
    "FROM (SELECT DISTINCT path FROM e) s LEFT JOIN (SELECT * FROM ranked WHERE ord <= 5) r ON r.path = s.path)"
)


@query("t5_next_steps", f"WITH {_E}, {_CHANGES}, {_PLAN}, {_STEPS} SELECT * FROM steps")
def _(spark, sf_dir):
    known = facts(spark, sf_dir)
    tasks = A.match_plan_tasks(plan_tasks(spark, sf_dir), A.file_changes(known))
    sessions = known.groupBy("path").agg(F.count_if(F.col("kind") == "change").alias("files_changed"))
    return A.next_steps(tasks.filter("NOT done"), sessions).withColumn("ord", F.col("ord").cast("bigint"))


@query("r1_summarise_sessions", (
    f"WITH {_E}, {_CHANGES}, {_COMMANDS}, {_USAGE}, {_FIRSTS}, {_PLAN}, {_STEPS}, "
    "dec AS (SELECT path, 'We decided to keep variant ' || k || ' of the loader for all the tables here' AS d, row_number() OVER (PARTITION BY path ORDER BY min(seq)) AS ord FROM e WHERE tool IS NOT NULL GROUP BY path, k) "
    "SELECT f.path, f.session_id, f.started_at, f.git_branch, coalesce(l.last_action, '') AS last_action, u.context_usage_pct, m.message_count, "
    "(SELECT count(*) FROM changes c WHERE c.path = f.path) AS files_changed, "
    "coalesce((SELECT string_agg(command, '|' ORDER BY ord) FROM commands c WHERE c.path = f.path), '') AS commands_run, "
    "coalesce((SELECT string_agg(d, '|' ORDER BY ord) FROM dec c WHERE c.path = f.path AND ord <= 10), '') AS decisions, "
    "(SELECT count(*) FROM settled t WHERE t.path = f.path AND done) AS tasks_completed, (SELECT count(*) FROM settled t WHERE t.path = f.path AND NOT done) AS tasks_remaining, "
    "(SELECT string_agg(step, '|' ORDER BY ord) FROM steps s WHERE s.path = f.path) AS next_steps "
    f"FROM firsts f JOIN (SELECT path, count(*) AS message_count FROM e GROUP BY 1) m USING (path) LEFT JOIN (SELECT path, arg_max({_ACTION}, seq) AS last_action FROM e WHERE tool IS NOT NULL GROUP BY 1) l USING (path) LEFT JOIN usage u USING (path)"
))
def _(spark, sf_dir):
    rows = A.summarise_sessions(facts(spark, sf_dir), plan_tasks(spark, sf_dir))
    shown = {c: F.array_join(c, "|") for c in ("commands_run", "decisions", "next_steps")}
    return rows.withColumns(shown).withColumn("context_usage_pct", F.col("context_usage_pct").cast("bigint"))
