"""Merging, deltas, updates and backlog sync over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.ordering import ord_of
from threadloom.functions.storage import materialise
from threadloom.operators import maintenance as N
from threadloom.operators import merging as M
from threadloom.plans.inputs import quoted
from threadloom.plans.registry import query, run_folder, table, texts
from threadloom.lexicons import TASK_STOP_WORDS
from threadloom.sources import history as H

NOW, TODAY = "2024-06-01T00:00:00Z", "2024-06-01"
_SECTIONS = ["goal", "tech_stack", "decision", "task", "constraint", "non_goal", "open_question"]


def order_items(spark, sf_dir) -> DataFrame:
    """Orders as context items: customers are projects, months sessions, cases and blanks vary."""
    key = F.col("o_orderkey")
    section = F.element_at(F.array(*[F.lit(s) for s in _SECTIONS]), (key % 7 + 1).cast("int"))
    raw = F.concat(F.lit("Item "), key % 11)
    text = F.when((section == "goal") & (key % 4 == 0), "").when(key % 2 == 0, F.concat(F.lit(" "), F.upper(raw))).otherwise(raw)
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("project_id"), F.date_format("o_orderdate", "yyyyMM").cast("bigint").alias("session_ord"), section.alias("section"),
        ord_of(seq=key).alias("ord"), F.concat(F.lit("L"), key % 3).alias("label"), text.alias("text"), F.concat(F.lit("d"), key).alias("detail"),
        F.when(F.col("o_orderpriority").startswith("1"), "high").otherwise("medium").alias("priority"), (F.col("o_orderstatus") == "F").alias("done"),
    )


_CASES = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SECTIONS))
_ITEMS = (
    f"raw_ AS (SELECT *, CASE o_orderkey % 7 {_CASES} END AS section, 'Item ' || (o_orderkey % 11) AS r FROM orders), "
    "items AS (SELECT o_custkey % 40 AS project_id, CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS session_ord, section, o_orderkey AS seq, 'L' || (o_orderkey % 3) AS label, "
    "CASE WHEN section = 'goal' AND o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN ' ' || upper(r) ELSE r END AS text, 'd' || o_orderkey AS detail, "
    "CASE WHEN starts_with(o_orderpriority, '1') THEN 'high' ELSE 'medium' END AS priority, o_orderstatus = 'F' AS done FROM raw_)"
)
_MERGED = (
    "keyed AS (SELECT *, CASE section WHEN 'goal' THEN '' WHEN 'tech_stack' THEN label WHEN 'decision' THEN lower(label) || '|' || trim(lower(text)) ELSE trim(lower(text)) END AS k "
    "FROM items WHERE section <> 'goal' OR text <> ''), "
    "merged AS (SELECT project_id, section, k, min((session_ord, seq)) AS o, "
    "CASE WHEN section IN ('goal', 'tech_stack') THEN arg_max(seq, (session_ord, seq)) "
    "ELSE coalesce(arg_max(seq, (session_ord, seq)) FILTER (section = 'task' AND done), arg_min(seq, (session_ord, seq))) END AS chosen FROM keyed GROUP BY project_id, section, k)"
)


@query("d5_merge_contexts", (
    f"WITH {_ITEMS}, {_MERGED} SELECT m.project_id, m.section, m.o[1] AS session, m.o[2] AS seq, i.label, i.text, i.detail, i.priority, i.done FROM merged m JOIN items i ON i.seq = m.chosen"
))
def _(spark, sf_dir):
    merged = M.merge_contexts(order_items(spark, sf_dir))
    return merged.select("project_id", "section", F.col("ord.src").alias("session"), F.col("ord.seq").alias("seq"), "label", "text", "detail", "priority", "done")


def _goals(spark, sf_dir):
    return order_items(spark, sf_dir).filter("section = 'goal'").withColumn("at", F.struct("session_ord", "ord"))


@query("a1_last_non_empty", f"WITH {_ITEMS} SELECT project_id, arg_max(text, (session_ord, seq)) AS text FROM items WHERE section = 'goal' AND text <> '' GROUP BY 1")
def _(spark, sf_dir):
    return M.last_non_empty(_goals(spark, sf_dir), ["project_id"], "text", "at")


@query("a2_merge_maps", (
    "SELECT o_custkey % 40 AS project_id, CASE WHEN s % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS entry, arg_max(o_orderkey, (o_orderkey, s)) AS value, min((o_orderkey, s))[1] AS first_order "
    "FROM orders, (VALUES (0), (1)) v(s) GROUP BY 1, 2"
))
def _(spark, sf_dir):
    maps = F.create_map("o_orderstatus", "o_orderkey", "o_orderpriority", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("project_id"), maps.alias("stack"), F.col("o_orderkey").alias("at"))
    return M.merge_maps(rows, ["project_id"], "stack", "at").select("project_id", "entry", "value", F.col("first_at._at").alias("first_order"))


@query("a3_dedup_first", "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return M.dedup_first(rows, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("a4_promote_done", (
    f"WITH {_ITEMS}, p AS (SELECT project_id, trim(lower(text)) AS k, min(seq) AS first_at, coalesce(arg_max(seq, seq) FILTER (done), min(seq)) AS chosen FROM items WHERE section = 'task' GROUP BY 1, 2) "
    "SELECT p.project_id, i.text AS title, i.detail, i.done, p.first_at FROM p JOIN items i ON i.seq = p.chosen"
))
def _(spark, sf_dir):
    tasks = order_items(spark, sf_dir).filter("section = 'task'").select("project_id", F.col("text").alias("title"), "detail", "done", F.col("ord.seq").alias("seq"))
    return M.promote_done(tasks, ["project_id"], "title", "seq").drop("seq")


@query("u1_ordered_union", (
    f"WITH {_ITEMS} SELECT project_id, arg_min(text, seq) AS text, min(seq) AS seq FROM items WHERE section IN ('constraint', 'non_goal') GROUP BY project_id, trim(lower(text))"
))
def _(spark, sf_dir):
    rows = order_items(spark, sf_dir).select("project_id", "section", "text", F.col("ord.seq").alias("seq"))
    parts = [rows.filter(F.col("section") == s).drop("section") for s in ("constraint", "non_goal")]
    return M.ordered_union(parts, ["project_id"], "text", "seq")


# ---- deltas --------------------------------------------------------------------------------------


def saved_and_fresh(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Later orders are the fresh extraction; their texts and topics reach further than the saved."""
    items = order_items(spark, sf_dir).drop("session_ord")
    key = F.col("ord.seq")
    topic = F.when(F.col("section") == "decision", F.concat(F.lit("Topic "), F.when(key % 2 == 0, F.upper("label")).otherwise(F.col("label")), F.lit("-"), key % 29))
    items = items.withColumn("label", F.coalesce(topic, "label")).withColumn("text", F.concat("text", F.lit("/"), key % 13))
    return items.filter(key % 5 > 0), items.filter(key % 5 == 0)


_DELTA = (
    f"{_ITEMS}, all_ AS (SELECT project_id, section, seq, CASE WHEN section = 'decision' THEN 'Topic ' || CASE WHEN seq % 2 = 0 THEN upper(label) ELSE label END || '-' || (seq % 29) ELSE label END AS label, "
    "text || '/' || (seq % 13) AS text, detail, priority, done FROM items), "
    "keyed AS (SELECT *, CASE section WHEN 'tech_stack' THEN label WHEN 'decision' THEN lower(label) ELSE lower(text) END AS k FROM all_), "
    "saved AS (SELECT * FROM keyed WHERE seq % 5 > 0), fresh AS (SELECT * FROM keyed WHERE seq % 5 = 0), "
    "added AS (SELECT 'new_' || CASE section WHEN 'tech_stack' THEN 'tech_stack' ELSE section END AS kind, f.* FROM fresh f ANTI JOIN saved s ON s.project_id = f.project_id AND s.section = f.section AND s.k = f.k WHERE section <> 'goal'), "
    "topics AS (SELECT project_id, k, arg_max(text, seq) AS old_text, arg_max(label, seq) AS old_label FROM saved WHERE section = 'decision' GROUP BY 1, 2), "
    "revised AS (SELECT f.*, t.old_label, t.old_text FROM fresh f JOIN topics t ON t.project_id = f.project_id AND t.k = f.k WHERE f.section = 'decision' AND lower(f.text) <> lower(t.old_text))"
)


@query("j5_new_items", f"WITH {_DELTA} SELECT project_id, section, seq, label, text FROM added")
def _(spark, sf_dir):
    saved, fresh = saved_and_fresh(spark, sf_dir)
    return N.new_items(saved, fresh).select("project_id", "section", F.col("ord.seq").alias("seq"), "label", "text")


@query("u2_new_list_items", f"WITH {_DELTA} SELECT project_id, section, seq, text FROM added WHERE section NOT IN ('decision', 'tech_stack')")
def _(spark, sf_dir):
    saved, fresh = saved_and_fresh(spark, sf_dir)
    lists = [df.filter("section NOT IN ('decision', 'tech_stack')") for df in (saved, fresh)]
    return N.new_items(*lists).select("project_id", "section", F.col("ord.seq").alias("seq"), "text")


@query("j6_revised_decisions", f"WITH {_DELTA} SELECT project_id, seq, label, text, old_label, old_text FROM revised")
def _(spark, sf_dir):
    saved, fresh = saved_and_fresh(spark, sf_dir)
    return N.revised_decisions(saved, fresh).select("project_id", F.col("ord.seq").alias("seq"), "label", "text", "old_label", "old_text")


def order_backlog(spark, sf_dir) -> DataFrame:
    """Orders as backlog rows; titles are made of words that the parts' names also use."""
    key = F.col("o_orderkey")
    words = F.array(*[F.lit(w) for w in ("red", "blue", "small", "hot", "gear", "bolt", "ring", "widget", "zebra", "build", "quartz")])

    def word(n: int):
        return F.element_at(words, (F.floor(key / n) % 11 + 1).cast("int"))

    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("project_id"), F.concat(F.lit("task-"), key).alias("id"), key.alias("ord"),
        F.concat(F.lit("Add "), word(1), F.lit(" "), word(11), F.lit(" "), word(121), F.lit(" in "), key % 17).alias("title"),
        F.lit("").alias("description"), F.lit("1").alias("phase"), F.when(F.col("o_orderpriority") <= "2-HIGH", "high").otherwise("medium").alias("priority"),
        (F.col("o_orderstatus") == "F").alias("done"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("added_at"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("done_at"),
    )


_WORDS = "['red', 'blue', 'small', 'hot', 'gear', 'bolt', 'ring', 'widget', 'zebra', 'build', 'quartz']"
_BACKLOG = (
    "backlog AS (SELECT o_custkey % 40 AS project_id, 'task-' || o_orderkey AS id, o_orderkey AS ord, "
    + "'Add ' || " + " || ' ' || ".join(f"{_WORDS}[CAST((o_orderkey // {n}) % 11 + 1 AS INTEGER)]" for n in (1, 11, 121)) + " || ' in ' || (o_orderkey % 17) AS title, "
    "CASE WHEN o_orderpriority <= '2-HIGH' THEN 'high' ELSE 'medium' END AS priority, o_orderstatus = 'F' AS done, "
    "CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS done_at FROM orders)"
)
_BACKLOG_NEW = (
    f"{_BACKLOG}, bold AS (SELECT * FROM backlog WHERE ord % 5 > 0), bnew AS (SELECT 'task-' || (ord // 2) AS nid, * FROM backlog WHERE ord % 5 = 0), "
    "badd AS (SELECT * FROM bnew n WHERE NOT EXISTS (SELECT 1 FROM bold o WHERE o.project_id = n.project_id AND o.id = n.nid) "
    "AND NOT EXISTS (SELECT 1 FROM bold o WHERE o.project_id = n.project_id AND lower(o.title) = lower(n.title)))"
)


def backlogs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Saved and fresh backlog; fresh ids run into saved ones now and then."""
    rows = order_backlog(spark, sf_dir)
    return rows.filter("ord % 5 > 0"), rows.filter("ord % 5 = 0").withColumn("id", F.concat(F.lit("task-"), F.floor(F.col("ord") / 2)))


_DELTA_ROWS = (
    "delta AS (SELECT project_id, kind, seq, label, text, NULL AS old_text FROM added UNION ALL SELECT project_id, 'revised_decision', seq, label, text, old_text FROM revised UNION ALL "
    "SELECT project_id, 'preserved_done_task', seq, label, text, NULL FROM saved WHERE section = 'task' AND done UNION ALL "
    "SELECT project_id, 'new_backlog_task', ord, nid, title, NULL FROM badd UNION ALL SELECT project_id, 'preserved_done_backlog', ord, id, title, NULL FROM bold WHERE done)"
)


def whole_delta(spark, sf_dir) -> DataFrame:
    saved, fresh = saved_and_fresh(spark, sf_dir)
    old, new = [b.withColumn("ord", ord_of(seq=F.col("ord"))) for b in backlogs(spark, sf_dir)]
    return N.compute_delta(saved, old, fresh, new)


@query("d1_compute_delta", f"WITH {_DELTA}, {_BACKLOG_NEW}, {_DELTA_ROWS} SELECT * FROM delta")
def _(spark, sf_dir):
    return whole_delta(spark, sf_dir).select("project_id", "kind", F.col("ord.seq").alias("seq"), "label", "text", "old_text")


@query("a12_delta_counts", f"WITH {_DELTA}, {_BACKLOG_NEW}, {_DELTA_ROWS} SELECT project_id, kind, count(*) AS n FROM delta GROUP BY 1, 2")
def _(spark, sf_dir):
    return N.delta_counts(whole_delta(spark, sf_dir))


@query("a12_delta_is_empty", f"WITH {_DELTA}, {_BACKLOG_NEW}, {_DELTA_ROWS} SELECT project_id, bool_and(starts_with(kind, 'preserved')) AS is_empty FROM delta GROUP BY 1")
def _(spark, sf_dir):
    return N.delta_is_empty(whole_delta(spark, sf_dir))


@query("d2_apply_update", (
    f"WITH {_DELTA} SELECT project_id, section, 0 AS batch, seq, text, NULL AS added_on, NULL AS old_text FROM saved UNION ALL "
    f"SELECT project_id, section, 1, seq, text, '{TODAY}', NULL FROM added UNION ALL SELECT project_id, 'revised_decision', 1, seq, text, '{TODAY}', old_text FROM revised"
))
def _(spark, sf_dir):
    saved, _ = saved_and_fresh(spark, sf_dir)
    updated = N.apply_items(saved, whole_delta(spark, sf_dir), TODAY)
    return updated.select("project_id", "section", "batch", F.col("ord.seq").alias("seq"), "text", "added_on", "old_text")


@query("d2_apply_backlog", (
    f"WITH {_BACKLOG_NEW}, t AS (SELECT DISTINCT project_id FROM badd), u AS (SELECT project_id, id, ord, done, 0 AS batch FROM bold UNION ALL SELECT project_id, nid, ord, done, 1 FROM badd) "
    f"SELECT u.*, CASE WHEN project_id IN (SELECT project_id FROM t) THEN '{NOW}' ELSE 'before' END AS updated_at FROM u"
))
def _(spark, sf_dir):
    old, new = [b.withColumn("ord", ord_of(seq=F.col("ord"))) for b in backlogs(spark, sf_dir)]
    updated = N.apply_backlog(old.withColumn("updated_at", F.lit("before")), whole_delta(spark, sf_dir), new, NOW)
    return updated.select("project_id", "id", F.col("ord.seq").alias("ord"), "done", "batch", F.coalesce("updated_at", F.lit("before")).alias("updated_at"))


@query("w4_adr_numbering", (
    f"WITH {_DELTA}, numbered AS (SELECT project_id, seq, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS number FROM saved WHERE section = 'decision'), "
    "top_ AS (SELECT project_id, max(number) AS m FROM numbered GROUP BY 1) "
    "SELECT a.project_id, a.seq, coalesce(m, 0) + row_number() OVER (PARTITION BY a.project_id ORDER BY a.seq) AS number FROM added a LEFT JOIN top_ USING (project_id) WHERE section = 'decision'"
))
def _(spark, sf_dir):
    from threadloom.functions.ordering import number_rows, ord_buckets

    saved, fresh = saved_and_fresh(spark, sf_dir)
    adrs = number_rows(saved.filter("section = 'decision'"), ["project_id"], ["ord"], ord_buckets(), "number")
    added = N.new_items(saved, fresh).filter("section = 'decision'")
    return N.number_decisions(adrs, added).select("project_id", F.col("ord.seq").alias("seq"), "number")


@query("w3_backlog_ids", (
    f"WITH {_ITEMS} SELECT project_id, printf('task-%03d', row_number() OVER (PARTITION BY project_id ORDER BY seq)) AS id, text AS title, CASE WHEN done THEN '{NOW}' END AS done_at FROM items WHERE section = 'task'"
))
def _(spark, sf_dir):
    tasks = order_items(spark, sf_dir).filter("section = 'task'").select("project_id", "ord", F.col("text").alias("title"), F.col("detail").alias("description"), "priority", "done")
    return N.assign_backlog_ids(tasks, NOW).select("project_id", "id", "title", "done_at")


# ---- backlog sync and status ---------------------------------------------------------------------


def part_evidence(spark, sf_dir) -> DataFrame:
    """Part names as commit lines of the projects; each project sees its own parts only."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % 40).alias("project_id"), F.concat(F.lit("fix_"), F.upper("p_name"), F.lit("s/x"), key).alias("text"), key.alias("committed_at")
    )


_EVIDENCE = "evidence AS (SELECT p_partkey % 40 AS project_id, 'fix_' || upper(p_name) || 's/x' || p_partkey AS text, p_partkey AS committed_at FROM part)"
_STOP = "[" + ", ".join(quoted(w) for w in TASK_STOP_WORDS) + "]"
_SYNC = (
    "tok AS (SELECT project_id, id, unnest(list_filter(regexp_extract_all(lower(title), '[a-zA-Z][a-zA-Z0-9_-]{2,}'), "
    f"lambda w: NOT list_contains({_STOP}, w))) AS token FROM backlog WHERE NOT done), "
    "hay AS (SELECT project_id, lower(string_agg(text, chr(10))) AS h FROM ev GROUP BY 1), "
    "verdicts AS (SELECT t.project_id, t.id, count(*) >= 2 AS verdict FROM tok t JOIN hay USING (project_id) WHERE contains(h, token) GROUP BY 1, 2), "
    f"synced AS (SELECT b.*, NOT b.done AND coalesce(v.verdict, FALSE) AS marked FROM backlog b LEFT JOIN verdicts v USING (project_id, id))"
)
_LATEST = "ev AS (SELECT project_id, text FROM evidence QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY committed_at DESC, text) <= 50)"


@query("s19_commit_evidence", f"WITH {_EVIDENCE}, {_LATEST} SELECT * FROM ev")
def _(spark, sf_dir):
    return N.recent_commits(part_evidence(spark, sf_dir).withColumnRenamed("text", "line"))


@query("j9_match_backlog_evidence", f"WITH {_BACKLOG}, {_EVIDENCE}, ev AS (SELECT * FROM evidence), {_SYNC} SELECT project_id, id FROM verdicts WHERE verdict")
def _(spark, sf_dir):
    return N.evidence_verdicts(order_backlog(spark, sf_dir), part_evidence(spark, sf_dir)).select("project_id", "id")


@query("d3_sync_backlog", (
    f"WITH {_BACKLOG}, {_EVIDENCE}, {_LATEST}, {_SYNC} SELECT project_id, id, done OR marked AS done, marked, CASE WHEN marked THEN '{NOW}' ELSE done_at END AS done_at, '{NOW}' AS updated_at FROM synced"
))
def _(spark, sf_dir):
    evidence = N.recent_commits(part_evidence(spark, sf_dir).withColumnRenamed("text", "line"))
    return N.sync_backlog(order_backlog(spark, sf_dir), evidence, NOW).select("project_id", "id", "done", "marked", "done_at", "updated_at")


@query("d3_sync_result", (
    f"WITH {_BACKLOG}, {_EVIDENCE}, {_LATEST}, {_SYNC} SELECT project_id, count(*) AS tasks_total, count(*) FILTER (marked) AS tasks_marked_done, count(*) FILTER (done) AS already_done, "
    "'heuristic' AS mode, TRUE AS dry_run FROM synced GROUP BY 1"
))
def _(spark, sf_dir):
    evidence = N.recent_commits(part_evidence(spark, sf_dir).withColumnRenamed("text", "line"))
    return N.sync_result(N.sync_backlog(order_backlog(spark, sf_dir), evidence, NOW), dry_run=True)


@query("d4_apply_decisions_map", (
    f"WITH {_BACKLOG} SELECT project_id, id, done OR ord % 3 = 0 AS done, CASE WHEN NOT done AND ord % 3 = 0 THEN '{NOW}' ELSE done_at END AS done_at FROM backlog"
))
def _(spark, sf_dir):
    rows = order_backlog(spark, sf_dir)
    verdicts = rows.filter("ord % 2 = 0 OR ord % 3 = 0").select("project_id", "id", (F.col("ord") % 3 == 0).alias("verdict"))
    return N.apply_verdicts(rows, verdicts, NOW).select("project_id", "id", "done", "done_at")


_STATUS = (
    "status AS (SELECT project_id, count(*) AS total, count(*) FILTER (done) AS done, count(*) FILTER (NOT done) AS remaining, count(*) FILTER (NOT done AND priority = 'high') AS high_priority_remaining FROM backlog GROUP BY 1), "
    "ends AS (SELECT project_id, arg_min(title, ord) FILTER (NOT done) AS next_task, arg_max(title, ord) FILTER (done) AS last_completed, arg_max(coalesce(done_at, ''), ord) FILTER (done) AS last_completed_at FROM backlog GROUP BY 1), "
    "urgent AS (SELECT project_id, rank, title FROM (SELECT project_id, title, row_number() OVER (PARTITION BY project_id ORDER BY ord) AS rank FROM backlog WHERE NOT done AND priority = 'high') WHERE rank <= 5), "
    "risk AS (SELECT project_id, at_risk, rank FROM (SELECT project_id, at_risk, row_number() OVER (PARTITION BY project_id ORDER BY at_risk) AS rank FROM "
    "(SELECT DISTINCT l_suppkey % 40 AS project_id, 'p' || (l_partkey % 211) AS at_risk FROM lineitem WHERE l_orderkey % 9 < 3)) WHERE rank <= 5)"
)


@query("a11_backlog_status", f"WITH {_BACKLOG}, {_STATUS} SELECT * FROM status")
def _(spark, sf_dir):
    return N.backlog_status(order_backlog(spark, sf_dir))


@query("t6_high_priority_remaining", f"WITH {_BACKLOG}, {_STATUS} SELECT * FROM urgent")
def _(spark, sf_dir):
    return N.high_priority_remaining(order_backlog(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query("w7_next_and_last_task", f"WITH {_BACKLOG}, {_STATUS} SELECT * FROM ends")
def _(spark, sf_dir):
    return N.next_and_last_task(order_backlog(spark, sf_dir))


def changed_files(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.filter("l_orderkey % 9 < 3").select((F.col("l_suppkey") % 40).alias("project_id"), F.concat(F.lit("f"), F.col("l_orderkey") % 9).alias("file"))


def impact_edges(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        (F.col("l_suppkey") % 40).alias("project_id"), F.concat(F.lit("f"), F.col("l_orderkey") % 9).alias("file"), F.concat(F.lit("p"), F.col("l_partkey") % 211).alias("other")
    )


@query("j10_at_risk_files", f"WITH {_BACKLOG}, {_STATUS} SELECT * FROM risk")
def _(spark, sf_dir):
    return N.at_risk_files(changed_files(spark, sf_dir), impact_edges(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


@query("d6_project_status", (
    f"WITH {_BACKLOG}, {_STATUS} SELECT s.*, next_task, last_completed, last_completed_at, (SELECT string_agg(title, '|' ORDER BY rank) FROM urgent u WHERE u.project_id = s.project_id) AS high_priority, "
    "(SELECT string_agg(at_risk, '|' ORDER BY rank) FROM risk u WHERE u.project_id = s.project_id) AS at_risk FROM status s JOIN ends USING (project_id)"
))
def _(spark, sf_dir):
    rows = N.project_status(order_backlog(spark, sf_dir), changed_files(spark, sf_dir), impact_edges(spark, sf_dir))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("high_priority", "at_risk")})


@query("u4_at_risk_union", (
    "SELECT o_custkey % 40 AS project_id, array_to_string(list_sort(list_distinct(list_concat(list_distinct(array_agg(o_orderstatus)), list_distinct(array_agg(o_orderpriority))))), '|') AS at_risk FROM orders GROUP BY 1"
))
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("project_id", F.col("o_custkey") % 40)
    union = N.union_names(*[orders.select("project_id", F.col(c).alias("file")) for c in ("o_orderstatus", "o_orderpriority")])
    return union.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("file")), "|").alias("at_risk"))


# ---- run history ---------------------------------------------------------------------------------


def history_lines(spark, sf_dir) -> DataFrame:
    """Events as history lines; some are cut short, some have a field too many, some one too few."""
    key = F.col("event_id")
    folder = F.concat(F.lit("/out/p"), F.col("user_id") % 12, F.when(key % 4 == 0, "/sub").when(key % 4 == 1, "/").otherwise(""))
    run = F.struct(
        F.concat(F.lit("h_"), key % 500).alias("run_id"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.col("event_type").alias("source"),
        F.lit("").alias("conversation_title"), F.lit("/in").alias("input_file"), folder.alias("output_dir"), F.array(F.lit("a.md")).alias("artifacts"),
    )
    line = F.to_json(run)
    line = (
        F.when(key % 10 == 7, F.left(line, F.lit(30)))
        .when(key % 10 == 8, F.replace(line, F.lit('"source"'), F.lit('"extra"')))
        .when(key % 10 == 9, F.replace(line, F.lit('{"run_id"'), F.lit('{"more": 1, "run_id"')))
        .otherwise(line)
    )
    return texts(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").select(key.alias("pos"), line.alias("line"))


_HISTORY = (
    "h AS (SELECT event_id AS pos, 'h_' || (event_id % 500) AS run_id, event_type AS source, '/out/p' || (user_id % 12) || CASE event_id % 4 WHEN 0 THEN '/sub' WHEN 1 THEN '/' ELSE '' END AS output_dir "
    "FROM events WHERE event_id % 10 < 7)"
)


@query("s16_read_history", f"WITH {_HISTORY} SELECT *, 'claude-code' AS target, TRUE AS use_llm FROM h")
def _(spark, sf_dir):
    return H.parse_history(history_lines(spark, sf_dir)).select("pos", "run_id", "source", "output_dir", "target", "use_llm")


@query("s16_append_history", f"WITH {_HISTORY} SELECT 'h_' || pos AS run_id, source, output_dir FROM h")
def _(spark, sf_dir):
    """Three batches, appended again, by two jobs at once, after a failure, and once more as one batch: each run is read once."""
    folder = run_folder(spark) + "/history"
    runs = materialise(H.parse_history(history_lines(spark, sf_dir)).withColumn("run_id", F.concat(F.lit("h_"), "pos")))  # written six times
    batches = [runs.filter(F.col("pos") % 3 == n) for n in range(3)]
    H.append_batch(batches[0], folder, "a/0")
    H.append_batch(batches[0], folder, "a/0")
    H.write_attempt(batches[1].limit(5), folder, "a/1")  # a job that died before its commit
    attempts = [H.write_attempt(batches[1], folder, "a/1") for _ in range(2)]
    for attempt in attempts:
        H.commit_attempt(spark, folder, "a/1", attempt)
    H.append_batch(batches[2], folder, "a/2")
    H.append_batch(runs, folder, "b: everything")
    return H.read_batches(spark, folder).select("run_id", "source", "output_dir")


@query("p6_history_under_path", f"WITH {_HISTORY} SELECT pos, output_dir FROM h WHERE rtrim(output_dir, '/') = '/out/p1' OR starts_with(output_dir, '/out/p1/')")
def _(spark, sf_dir):
    return H.history_under_path(H.parse_history(history_lines(spark, sf_dir)), "/out/p1/").select("pos", "output_dir")


@query("t2_recent_history", f"WITH {_HISTORY} SELECT pos, run_id FROM h ORDER BY pos DESC LIMIT 20")
def _(spark, sf_dir):
    return H.recent_history(H.parse_history(history_lines(spark, sf_dir))).select("pos", "run_id")


@query("t3_history_by_id", f"WITH {_HISTORY} SELECT pos, run_id FROM h WHERE run_id = 'h_42' ORDER BY pos LIMIT 1")
def _(spark, sf_dir):
    return H.history_by_id(H.parse_history(history_lines(spark, sf_dir)), "h_42").select("pos", "run_id")


@query("f3_dedup_key", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'))) AS k FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dedup_key(F.col("text"))).alias("k"))
