"""Export readers and message filters over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import extraction as X
from threadloom.operators import messages as M
from threadloom.plans import extraction as _extraction  # noqa: F401 - its SQL is built upon below
from threadloom.plans.inputs import LEXICON, SQL_MESSAGES, SQL_TURNS, WS, export_files, exported_turns, messages
from threadloom.plans.registry import ORACLES, query, table
from threadloom.sources import exports as S

_TOLD = "role IN ('user', 'assistant')"


def _stamp():
    """Times that run backwards, so that reading has to sort."""
    return F.format_string("2024-01-01T00:%02d:00Z", 59 - F.col("i") % 60)


_SQL_STAMP = "printf('2024-01-01T00:%02d:00Z', 59 - i % 60)"


def _claude_item(v2: bool = False):
    sender = F.when(F.col("role") == "user", "Human").otherwise(F.col("role"))
    if v2:
        return F.struct(F.col("role"), F.col("text").alias("content"), _stamp().alias("created_at"), F.concat(F.lit("m"), "i").alias("id"))
    return F.struct(F.concat(F.lit("m"), "i").alias("uuid"), sender.alias("sender"), F.col("text"), _stamp().alias("created_at"))


def _claude_doc(doc, items):
    return F.struct(doc.alias("uuid"), F.concat(F.lit("Talk "), doc).alias("name"), F.lit("2024-01-01").alias("created_at"), items.alias("chat_messages"))


def claude_files(spark, sf_dir) -> DataFrame:
    turns = exported_turns(spark, sf_dir).filter(_TOLD)
    return export_files(turns, ".json", _claude_item(), lambda d, i: F.to_json(_claude_doc(d, i)))


def claude_array_files(spark, sf_dir) -> DataFrame:
    turns = exported_turns(spark, sf_dir).filter(_TOLD)
    return export_files(turns, ".json", _claude_item(), lambda d, i: F.to_json(F.array(_claude_doc(d, i))))


def claude_v2_files(spark, sf_dir) -> DataFrame:
    turns = exported_turns(spark, sf_dir).filter(_TOLD)
    return export_files(turns, ".json", _claude_item(v2=True), lambda d, i: F.to_json(F.struct(d.alias("id"), i.alias("messages"))))


def claude_lines(spark, sf_dir) -> DataFrame:
    return claude_files(spark, sf_dir).select(F.replace("path", F.lit(".json"), F.lit(".jsonl")).alias("path"), F.col("content").alias("line"))


def markdown_files(spark, sf_dir) -> DataFrame:
    who = F.when(F.col("role") == "user", "Human").otherwise("Assistant")
    item = F.concat(F.lit("**"), who, F.lit(":** "), F.col("text"), F.lit("\n\n"))
    return export_files(exported_turns(spark, sf_dir), ".md", item, lambda d, i: F.concat(F.lit("# Export\n\n"), F.array_join(i, "")))


def chatgpt_files(spark, sf_dir) -> DataFrame:
    """Turn i hangs below turn (i - 1) / 2, so every node branches."""
    turns = exported_turns(spark, sf_dir)
    sizes = turns.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    i, n = F.col("i"), F.col("n")
    kids = F.transform(F.filter(F.array(2 * i + 1, 2 * i + 2), lambda k: k < n), lambda k: F.concat(F.lit("n"), k))
    message = F.struct(
        F.struct(F.col("role")).alias("author"), F.struct(F.array(F.col("text"), F.lit("")).alias("parts")).alias("content"),
        (F.lit(1700000000) + i).cast("double").alias("create_time"),
    )
    node = F.struct(
        F.concat(F.lit("n"), i).alias("key"),
        F.struct(
            F.when(i > 0, F.concat(F.lit("n"), F.floor((i - 1) / 2))).alias("parent"), kids.alias("children"), message.alias("message")
        ).alias("value"),
    )
    return export_files(
        turns.join(sizes, "doc"), ".json", node,
        lambda d, items: F.to_json(F.array(F.struct(
            d.alias("id"), F.concat(F.lit("Talk "), d).alias("title"), F.lit(1700000000.0).alias("create_time"), F.map_from_entries(items).alias("mapping")
        ))),
    )


def gemini_files(spark, sf_dir) -> DataFrame:
    def body(role: str):
        return F.struct(F.array(F.struct(F.when(F.col("role") == role, F.col("text")).otherwise("").alias("text"))).alias("parts"))

    item = F.struct(_stamp().alias("activityTime"), body("user").alias("requestBody"), body("assistant").alias("responseBody"))
    return export_files(exported_turns(spark, sf_dir), ".json", item, lambda d, i: F.to_json(F.struct(i.alias("appActivity"))))


def perplexity_files(spark, sf_dir) -> DataFrame:
    i = F.col("i")
    links = F.when(i % 4 == 1, F.array(
        F.struct(F.lit("A").alias("title"), F.concat(F.lit("http://a/"), i).alias("url")), F.struct(F.lit("B").alias("title"), F.lit("").alias("url"))
    ))
    item = F.struct(F.col("role"), F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("content"), _stamp().alias("timestamp"), links.alias("sources"))
    return export_files(
        exported_turns(spark, sf_dir), ".json", item,
        lambda d, items: F.to_json(F.struct(F.array(F.struct(d.alias("id"), F.concat(F.lit("Talk "), d).alias("title"), items.alias("messages"))).alias("conversations"))),
    )


_CHOSEN = ["conv_id", "seq", "role", "content"]
_CLAUDE_SQL = (
    f"WITH {SQL_TURNS} SELECT doc AS conv_id, row_number() OVER (PARTITION BY doc ORDER BY {_SQL_STAMP}, i) - 1 AS seq, role, text AS content "
    f"FROM turns WHERE {_TOLD} AND text <> ''"
)


@query("s2_read_claude_json", _CLAUDE_SQL)
def _(spark, sf_dir):
    return S.read_claude_json(claude_files(spark, sf_dir)).select(_CHOSEN)


@query("s2_read_claude_json_array", _CLAUDE_SQL)
def _(spark, sf_dir):
    return S.read_claude_json(claude_array_files(spark, sf_dir)).select(_CHOSEN)


@query("s2_read_claude_json_v2", _CLAUDE_SQL)
def _(spark, sf_dir):
    return S.read_claude_json(claude_v2_files(spark, sf_dir)).select(_CHOSEN)


@query("s3_read_claude_jsonl", _CLAUDE_SQL)
def _(spark, sf_dir):
    return S.read_claude_jsonl(claude_lines(spark, sf_dir)).select(_CHOSEN)


@query("s4_read_claude_markdown", (
    f"WITH {SQL_TURNS} SELECT '/exports/' || doc || '.md' AS conv_id, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS seq, "
    f"CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, trim(text, {WS}) AS content FROM turns WHERE trim(text, {WS}) <> ''"
))
def _(spark, sf_dir):
    return S.read_claude_markdown(markdown_files(spark, sf_dir)).select(_CHOSEN)


@query("s5_read_chatgpt_tree", (
    "WITH RECURSIVE p(i, way) AS (SELECT 0, '' UNION ALL SELECT CAST(2 * i + k AS INTEGER), way || c FROM p, (VALUES (1, 'L'), (2, 'R')) v(k, c) WHERE 2 * i + k <= (SELECT max(turn) FROM conversations)), "
    f"{SQL_TURNS} SELECT doc AS conv_id, row_number() OVER (PARTITION BY doc ORDER BY way) - 1 AS seq, role, text AS content, "
    "strftime(make_timestamp((1700000000 + i) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp "
    "FROM turns JOIN p USING (i) WHERE role <> 'system' AND text <> ''"
))
def _(spark, sf_dir):
    return S.read_chatgpt_tree(chatgpt_files(spark, sf_dir)).select(*_CHOSEN, "timestamp")


@query("s6_read_chatgpt_active_branch", (
    f"WITH RECURSIVE {SQL_TURNS}, sizes AS (SELECT doc, count(*) AS n FROM turns GROUP BY 1), "
    "w(doc, n, i, depth) AS (SELECT doc, n, 0, 0 FROM sizes UNION ALL SELECT doc, n, CAST(CASE WHEN 2 * i + 2 < n THEN 2 * i + 2 ELSE 2 * i + 1 END AS INTEGER), depth + 1 FROM w WHERE 2 * i + 1 < n) "
    f"SELECT t.doc AS conv_id, row_number() OVER (PARTITION BY t.doc ORDER BY depth) - 1 AS seq, role, trim(text, {WS}) AS content, "
    "strftime(make_timestamp((1700000000 + t.i) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp "
    f"FROM turns t JOIN w ON w.doc = t.doc AND w.i = t.i WHERE {_TOLD} AND trim(text, {WS}) <> ''"
))
def _(spark, sf_dir):
    return S.read_chatgpt_active_branch(chatgpt_files(spark, sf_dir)).select(*_CHOSEN, "timestamp")


@query("s7_read_gemini", (
    f"WITH {SQL_TURNS} SELECT '/exports/' || doc || '.json' AS conv_id, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS seq, role, text AS content, "
    f"{_SQL_STAMP} AS timestamp FROM turns WHERE {_TOLD} AND text <> ''"
))
def _(spark, sf_dir):
    return S.read_gemini(gemini_files(spark, sf_dir)).select(*_CHOSEN, "timestamp")


@query("s8_read_perplexity", (
    f"WITH {SQL_TURNS}, t AS (SELECT doc, i, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, trim(text, {WS}) AS content FROM turns), "
    "rows_ AS (SELECT doc, i, 0 AS sub, role, content FROM t WHERE content <> '' UNION ALL SELECT doc, i, 1, role, "
    "'Sources:' || chr(10) || '- [A](http://a/' || i || ')' || chr(10) || '- B' FROM t WHERE content <> '' AND role = 'assistant' AND i % 4 = 1) "
    "SELECT doc AS conv_id, row_number() OVER (PARTITION BY doc ORDER BY i, sub) - 1 AS seq, role, content FROM rows_"
))
def _(spark, sf_dir):
    return S.read_perplexity(perplexity_files(spark, sf_dir)).select(_CHOSEN)


def mixed_files(spark, sf_dir) -> DataFrame:
    """Every kind of export side by side, and files that no reader knows."""
    lines = claude_lines(spark, sf_dir).withColumnRenamed("line", "content")
    parts = {
        "a": claude_files(spark, sf_dir), "b": lines, "c": markdown_files(spark, sf_dir), "d": chatgpt_files(spark, sf_dir),
        "e": gemini_files(spark, sf_dir), "f": perplexity_files(spark, sf_dir),
    }
    out = None
    for tag, part in parts.items():
        named = part.withColumn("path", F.replace("path", F.lit("/exports/"), F.lit(f"/exports/{tag}/perplexity_")))
        out = named if out is None else out.unionByName(named)
    strange = exported_turns(spark, sf_dir).select(
        F.concat(F.lit("/exports/g/"), "doc", F.lit("-"), "i", F.when(F.col("i") % 2 == 0, ".txt").otherwise(".json")).alias("path"), F.col("text").alias("content")
    )
    return out.unionByName(strange)


_DOCS_SQL = f"{SQL_TURNS}, told AS (SELECT doc FROM turns WHERE {_TOLD} GROUP BY 1), docs AS (SELECT doc FROM turns GROUP BY 1)"


def _kinds(column_per_kind: dict[str, str]) -> str:
    spec = {"a": ("told", ".json"), "b": ("told", ".jsonl"), "c": ("docs", ".md"), "d": ("docs", ".json"), "e": ("docs", ".json"), "f": ("docs", ".json")}
    return " UNION ALL ".join(
        f"SELECT '/exports/{tag}/perplexity_' || doc || '{ext}' AS path, {column_per_kind[tag]} FROM {source}" for tag, (source, ext) in spec.items()
    )


@query("s1_classify_exports", (
    f"WITH {_DOCS_SQL} "
    + _kinds({k: f"'{v}' AS source, NULL AS error" for k, v in zip("abcdef", ["claude", "claude", "claude", "chatgpt", "gemini", "perplexity"])})
    + " UNION ALL SELECT '/exports/g/' || doc || '-' || i || CASE WHEN i % 2 = 0 THEN '.txt' ELSE '.json' END, NULL, "
    "CASE WHEN i % 2 = 0 THEN 'Unsupported file extension .txt' ELSE 'Could not auto-detect source from ' || doc || '-' || i || '.json' END FROM turns"
))
def _(spark, sf_dir):
    return S.classify_exports(mixed_files(spark, sf_dir)).select("path", "source", "error")


@query("s12_format_version", (
    f"WITH {_DOCS_SQL} "
    + _kinds({k: f"'{v}' AS format_version" for k, v in zip("abcdef", [
        "single-json v1.0", "bulk-jsonl v1.0", "markdown v1.0", "chatgpt-json v1.0", "gemini-takeout v1.0", "perplexity-json v1.0"])})
))
def _(spark, sf_dir):
    known = S.classify_exports(mixed_files(spark, sf_dir)).filter("source IS NOT NULL")
    return S.format_version(known).select("path", "format_version")


@query("s11_list_conversations", (
    f"WITH {_DOCS_SQL}, a(source, path, conv_id, title, date) AS ("
    "SELECT 'claude', '/exports/a/perplexity_' || doc || '.json', doc, 'Talk ' || doc, '2024-01-01' FROM told UNION ALL "
    "SELECT 'claude', '/exports/b/perplexity_' || doc || '.jsonl', doc, 'Talk ' || doc, '2024-01-01' FROM told UNION ALL "
    "SELECT 'chatgpt', '/exports/d/perplexity_' || doc || '.json', doc, 'Talk ' || doc, '2023-11-14T22:13:20+00:00' FROM docs UNION ALL "
    f"SELECT 'perplexity', '/exports/f/perplexity_' || doc || '.json', doc, 'Talk ' || doc, printf('2024-01-01T00:%02d:00Z', 59) FROM docs) SELECT * FROM a"
))
def _(spark, sf_dir):
    return S.list_conversations(S.classify_exports(mixed_files(spark, sf_dir)))


@query("e1_read_exports_by_source", (
    f"WITH {SQL_TURNS}, c(source, n) AS (SELECT 'claude', 2 * count(*) FILTER ({_TOLD} AND text <> '') + count(*) FILTER (trim(text, {WS}) <> '') FROM turns UNION ALL "
    "SELECT 'chatgpt', count(*) FILTER (role <> 'system' AND text <> '') FROM turns UNION ALL "
    f"SELECT 'gemini', count(*) FILTER ({_TOLD} AND text <> '') FROM turns UNION ALL "
    f"SELECT 'perplexity', count(*) FILTER (trim(text, {WS}) <> '') + count(*) FILTER (trim(text, {WS}) <> '' AND role <> 'user' AND i % 4 = 1) FROM turns) "
    "SELECT source, CAST(n AS BIGINT) AS n FROM c"
))
def _(spark, sf_dir):
    return S.read_exports(mixed_files(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("p1_normalise_roles", "SELECT conv_id, turn AS seq, CASE WHEN role IN ('user', 'assistant') THEN role END AS role FROM conversations")
def _(spark, sf_dir):
    shouted = messages(spark, sf_dir).withColumn("role", F.when(F.col("role") == "user", "HUMAN").otherwise(F.upper("role")))
    return M.normalise_roles(shouted, strict=False).select("conv_id", "seq", "role")


@query("p2_drop_empty_messages", (
    "SELECT conv_id, turn AS seq, CASE WHEN turn % 3 = 0 THEN 'spare ' || turn ELSE text END AS content FROM conversations WHERE turn % 3 <> 1 AND (turn % 3 = 0 OR text <> '')"
))
def _(spark, sf_dir):
    third = F.col("seq") % 3
    rows = messages(spark, sf_dir).withColumn("text", F.when(third == 2, F.col("content")).otherwise(""))
    rows = rows.withColumn("content", F.when(third == 0, F.concat(F.lit("spare "), "seq")))
    return M.drop_empty_messages(rows).select("conv_id", "seq", "content")


@query("p3_validate_records", (
    "SELECT conv_id, turn AS seq, role IN ('user', 'assistant') AND text <> '' AS good FROM conversations"
))
def _(spark, sf_dir):
    good, bad = M.validate_messages(messages(spark, sf_dir))
    return good.select("conv_id", "seq", F.lit(True).alias("good")).unionByName(bad.select("conv_id", "seq", F.lit(False).alias("good")))


@query("p3_validate_tasks", (
    "SELECT o_orderkey, p IN ('high', 'medium', 'low') AS good FROM (SELECT o_orderkey, lower(split_part(o_orderpriority, '-', 2)) AS p FROM orders)"
))
def _(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("priority"))
    good, bad = M.validate_tasks(tasks)
    return good.select("o_orderkey", F.lit(True).alias("good")).unionByName(bad.select("o_orderkey", F.lit(False).alias("good")))


@query("p4_select_conversation", (
    "SELECT p_brand AS path, min(p_partkey) AS pos, arg_min(p_name, p_partkey) AS title FROM part "
    "WHERE contains(lower(p_name), 'bolt') OR p_partkey = 7 GROUP BY 1"
))
def _(spark, sf_dir):
    listing = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("path"), F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("conv_id"), F.col("p_name").alias("title")
    )
    return M.select_conversation(listing, title=" BOLT ", conv_id="7").select("path", "pos", "title")


@query("p7_entry_type_filter", "SELECT conv_id, turn AS seq FROM conversations WHERE role IN ('user', 'assistant')")
def _(spark, sf_dir):
    from threadloom.sources.sessions import entry_type_filter

    return entry_type_filter(messages(spark, sf_dir).withColumn("type", F.col("role"))).select("conv_id", "seq")


@query("p11_two_sided_conversations", (
    f"WITH {SQL_MESSAGES}, long_ AS (SELECT * FROM msgs WHERE length(trim(content, {WS})) > 5), "
    "both_ AS (SELECT conv_id FROM long_ GROUP BY 1 HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')) "
    "SELECT conv_id, seq, role FROM long_ SEMI JOIN both_ USING (conv_id)"
))
def _(spark, sf_dir):
    return M.two_sided_conversations(messages(spark, sf_dir)).select("conv_id", "seq", "role")


@query("w6_message_order", (
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(t, ''), event_id) - 1 AS seq FROM "
    "(SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%dT%H') END AS t FROM events)"
))
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd'T'HH")).alias("timestamp"),
    )
    return M.order_messages(rows, ["user_id"]).select("user_id", "event_id", "seq")


_FLAGSHIP_MSGS = f"{SQL_TURNS}, msgs AS (SELECT doc AS conv_id, row_number() OVER (PARTITION BY doc ORDER BY {_SQL_STAMP}, i) - 1 AS seq, role, text AS content FROM turns WHERE {_TOLD} AND text <> '')"


@query("flagship_export_to_summary", ORACLES["a10_extraction_summary"].replace(
    "msgs AS (SELECT conv_id, turn AS seq, role, text AS content FROM conversations)", _FLAGSHIP_MSGS
).replace(
    "msgs AS (SELECT conv_id, turn AS seq, role, '- ' || replace(text, '.' || chr(10), ' so?' || chr(10) || '* ') || chr(10) || 'unclear: ' || left(text, 30) AS content FROM conversations)",
    _FLAGSHIP_MSGS,
))
def flagship(spark, sf_dir):
    rows = S.read_claude_json(claude_files(spark, sf_dir))
    good, _ = M.validate_messages(rows)
    return X.extraction_summary(good, X.extract_items(good, LEXICON))


@query("f5_unix_to_iso", (
    "SELECT o_orderkey, strftime(o_orderdate + INTERVAL (o_orderkey % 86400) SECOND, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders"
))
def _(spark, sf_dir):
    seconds = F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400
    return table(spark, sf_dir, "orders").select("o_orderkey", T.unix_to_iso(seconds.cast("string")).alias("iso"))
