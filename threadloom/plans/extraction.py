"""Extraction over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import lexicons as L
from threadloom.functions import text as T
from threadloom.operators import extraction as X
from threadloom.operators.messages import question_quality
from threadloom.plans.inputs import (
    DOMAINS, LEXICON, SQL_LIST_MESSAGES, SQL_MESSAGES, SQL_SENTENCES, WS, list_messages, messages, quoted, sql_dedup, sql_first_wins, values,
)
from threadloom.plans.registry import query, table, texts

def _ord():
    return [F.col("ord.seq").alias("seq"), F.col("ord.kw").alias("kw"), F.col("ord.pos").alias("pos")]



@query("x1_split_sentences", f"WITH {SQL_MESSAGES}, {SQL_SENTENCES} SELECT conv_id, seq AS msg_seq, pos AS sent_ord, sentence FROM sent")
def _(spark, sf_dir):
    return X.split_sentences(messages(spark, sf_dir)).withColumn("sent_ord", F.col("sent_ord").cast("bigint"))


_WORDS = {"decision": LEXICON.decisions, "constraint": LEXICON.constraints, "non_goal": LEXICON.non_goals}
_WORD_ROWS = values((c, i, w) for c, ws in _WORDS.items() for i, w in enumerate(ws))


@query(
    "x2_match_lexicon",
    f"WITH {SQL_MESSAGES}, {SQL_SENTENCES} SELECT conv_id, seq AS msg_seq, pos AS sent_ord, sentence, category, "
    f"CAST(kw_ord AS BIGINT) AS kw_ord, keyword FROM sent, {_WORD_ROWS} w(category, kw_ord, keyword) WHERE contains(lower(sentence), keyword)",
)
def _(spark, sf_dir):
    hits = X.match_lexicon(X.split_sentences(messages(spark, sf_dir)), _WORDS)
    return hits.withColumn("sent_ord", F.col("sent_ord").cast("bigint")).withColumn("kw_ord", F.col("kw_ord").cast("bigint"))


# Five terms of three letters for each part, numbered in the order of parts; the same letters may come again.
_LETTERS = [26 * 26, 26, 1]
_TERMS = (
    "terms AS (SELECT 'list' || i AS category, p_partkey AS kw_ord, "
    + " || ".join(f"chr(CAST(97 + ((5 * p_partkey + i) * 7 // {n}) % 26 AS INTEGER))" for n in _LETTERS)
    + " AS keyword FROM part, (VALUES (0), (1), (2), (3), (4)) v(i))"
)


def part_terms(spark, sf_dir):
    """A lexicon as long as five times the parts table."""
    numbered = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    place = (F.col("p_partkey") * 5 + F.col("i")) * 7
    letters = [F.char((F.floor(place / n) % 26 + 97).cast("int")) for n in _LETTERS]
    return numbered.select(F.concat(F.lit("list"), "i").alias("category"), F.col("p_partkey").cast("bigint").alias("kw_ord"), F.concat(*letters).alias("keyword"))


@query("x2_match_terms", (
    f"WITH {SQL_MESSAGES}, {SQL_SENTENCES}, {_TERMS} SELECT conv_id, seq AS msg_seq, pos AS sent_ord, category, CAST(count(*) AS BIGINT) AS hits, CAST(sum(kw_ord) AS BIGINT) AS ord_sum, "
    "min(keyword) AS first_word FROM sent, terms WHERE contains(lower(sentence), keyword) GROUP BY ALL"
))
def _(spark, sf_dir):
    listed = part_terms(spark, sf_dir).groupBy("category", "keyword").agg(F.count(F.lit(1)).alias("hits"), F.sum("kw_ord").alias("ord_sum"))
    hits = X.match_terms(X.split_sentences(messages(spark, sf_dir)), listed, columns=listed.columns)
    counted = hits.groupBy("conv_id", "msg_seq", "sent_ord", "category").agg(F.sum("hits").alias("hits"), F.sum("ord_sum").alias("ord_sum"), F.min("keyword").alias("first_word"))
    return counted.withColumn("sent_ord", F.col("sent_ord").cast("bigint"))


@query("x2_term_ordinals", (
    f"WITH {SQL_MESSAGES}, {SQL_SENTENCES}, {_TERMS} SELECT conv_id, seq AS msg_seq, pos AS sent_ord, category, min(kw_ord) AS first_ord, max(kw_ord) AS last_ord "
    "FROM sent, terms WHERE contains(lower(sentence), keyword) GROUP BY ALL"
))
def _(spark, sf_dir):
    return X.term_ordinals(X.split_sentences(messages(spark, sf_dir)), part_terms(spark, sf_dir)).withColumn("sent_ord", F.col("sent_ord").cast("bigint"))


def _sql_clean_goal(expr: str) -> str:
    bare = f"rtrim(trim({expr}, {WS}), '?')"
    cases = " ".join(f"WHEN starts_with(lower({bare}), {quoted(p)}) THEN substr({bare}, {len(p) + 1})" for p in LEXICON.goal_prefixes)
    cut = f"(CASE {cases} ELSE {bare} END)"
    return f"left(upper(left({cut}, 1)) || substr({cut}, 2), 300)"


_GOAL_SQL = (
    f"WITH {SQL_MESSAGES}, {SQL_SENTENCES}, "
    + sql_first_wins(LEXICON.intents, "role = 'user'")
    + f", best AS (SELECT conv_id, arg_min({_sql_clean_goal('sentence')}, (seq, kw, pos)) AS goal FROM hits GROUP BY 1), "
    f"fb AS (SELECT conv_id, arg_min({_sql_clean_goal('content')}, seq) FILTER (role = 'user') AS goal FROM msgs GROUP BY 1) "
    "SELECT fb.conv_id, coalesce(best.goal, fb.goal, '') AS goal FROM fb LEFT JOIN best USING (conv_id)"
)


@query("x3_extract_goal", _GOAL_SQL)
def _(spark, sf_dir):
    return X.extract_goal(messages(spark, sf_dir), LEXICON)


def _sql_tech_key() -> str:
    out = "lower(sentence)"
    for listed in LEXICON.tech.values():  # the last category is tested first
        cases = " ".join(f"WHEN contains(lower(sentence), {quoted(w)}) THEN {quoted(w)}" for w in listed)
        out = f"(CASE {cases} ELSE {out} END)"
    return out


_DECISION_CTES = (
    f"dhits AS (SELECT s.*, w.kw, {_sql_tech_key()} AS k FROM sent s, {values((w, i) for i, w in enumerate(LEXICON.decisions))} w(word, kw) "
    "WHERE contains(lower(s.sentence), w.word))"
)


@query(
    "x4_extract_decisions",
    f"WITH {SQL_MESSAGES}, {SQL_SENTENCES}, {_DECISION_CTES}, agg AS (SELECT conv_id, k, min((seq, kw, pos)) AS o, arg_max(sentence, (seq, kw, pos)) AS decision "
    "FROM dhits GROUP BY 1, 2) SELECT conv_id, o[1] AS seq, CAST(o[2] AS BIGINT) AS kw, o[3] AS pos, decision FROM agg",
)
def _(spark, sf_dir):
    return X.extract_decisions(messages(spark, sf_dir), LEXICON).select("conv_id", *_ord(), "decision")


def _sql_first(words) -> str:
    return (
        f"WITH {SQL_MESSAGES}, {SQL_SENTENCES}, {sql_first_wins(words)}, agg AS (SELECT conv_id, k, min((seq, kw, pos)) AS o, "
        "arg_min(sentence, (seq, kw, pos)) AS text FROM hits WHERE k <> '' GROUP BY 1, 2) "
        "SELECT conv_id, o[1] AS seq, CAST(o[2] AS BIGINT) AS kw, o[3] AS pos, text FROM agg"
    )


@query("x5_extract_constraints", _sql_first(LEXICON.constraints))
def _(spark, sf_dir):
    return X.extract_constraints(messages(spark, sf_dir), LEXICON).select("conv_id", *_ord(), "text")


@query("x6_extract_non_goals", _sql_first(LEXICON.non_goals))
def _(spark, sf_dir):
    return X.extract_non_goals(messages(spark, sf_dir), LEXICON).select("conv_id", *_ord(), "text")


_HEADER_CASES = " ".join(
    f"WHEN contains(lower(content), {quoted(h)}) THEN substr(content, instr(lower(content), {quoted(h)}) + {len(h)})" for h in LEXICON.task_headers
)
_TASK_SQL = (
    f"WITH {SQL_LIST_MESSAGES}, cut AS (SELECT conv_id, seq, CASE {_HEADER_CASES} ELSE content END AS body FROM msgs), "
    f"found AS (SELECT conv_id, seq, list_filter(list_transform(regexp_extract_all(body, '(?m)^\\s*(?:\\d+[.)]\\s+|[-*]\\s+|Phase\\s+\\d+\\s*[—\\-–]\\s*)(.+)$', 1), lambda x: trim(x, {WS})), lambda x: x <> '') AS f FROM cut), "
    "items AS (SELECT conv_id, seq, unnest(f) AS title, generate_subscripts(f, 1) - 1 AS pos FROM found), "
    "agg AS (SELECT conv_id, lower(title) AS k, min((seq, pos)) AS o, arg_min(title, (seq, pos)) AS title FROM items GROUP BY 1, 2) "
    "SELECT conv_id, o[1] AS seq, o[2] AS pos, title, CASE WHEN contains(title, '!') OR contains(lower(title), 'high priority') THEN 'high' ELSE 'medium' END AS priority FROM agg"
)


@query("x7_extract_tasks", _TASK_SQL)
def _(spark, sf_dir):
    tasks = X.extract_tasks(list_messages(spark, sf_dir), LEXICON)
    return tasks.select("conv_id", F.col("ord.seq").alias("seq"), F.col("ord.pos").alias("pos"), "title", "priority")


_TECH_ROWS = [(c, ci, ki, w, n) for ci, (c, ws) in enumerate(LEXICON.tech.items()) for ki, (w, n) in enumerate(ws.items())]
# Word edges are spelled out: this SQL's own \b knows ASCII letters only.
_TECH_SQL = (
    f"WITH {SQL_MESSAGES}, whole AS (SELECT conv_id, ' ' || lower(string_agg(content, ' ' ORDER BY seq)) || ' ' AS body FROM msgs GROUP BY 1), "
    f"hits AS (SELECT conv_id, category, c, i, name FROM whole, {values(_TECH_ROWS)} t(category, c, i, word, name) "
    "WHERE contains(body, word) AND regexp_matches(body, '[^\\p{L}\\p{N}\\p{M}_]' || word || '[^\\p{L}\\p{N}\\p{M}_]')) "
    "SELECT conv_id, string_agg(category || '=' || name, ',' ORDER BY c) AS tech_stack FROM "
    "(SELECT conv_id, category, c, arg_max(name, i) AS name FROM hits GROUP BY 1, 2, 3) GROUP BY 1"
)


@query("x8_extract_tech_stack", _TECH_SQL)
def _(spark, sf_dir):
    stacks = X.extract_tech_stack(messages(spark, sf_dir), LEXICON)
    shown = F.transform(F.map_entries("tech_stack"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return stacks.select("conv_id", F.array_join(shown, ",").alias("tech_stack"))


def _sql_quality(c: str) -> str:
    return (
        f"length({c}) >= 20 AND NOT starts_with({c}, '`') AND NOT starts_with({c}, '*') AND NOT regexp_matches({c}, '^[a-z][\\p{{L}}\\p{{N}}\\p{{M}}_]*`') "
        f"AND regexp_matches({c}, '[a-zA-Z]{{3,}}')"
    )


_QUESTION_SQL = (
    f"WITH {SQL_LIST_MESSAGES}, q AS (SELECT conv_id, seq, list_filter(list_transform(regexp_extract_all(content, '[^.!?]*\\?'), lambda x: trim(x, {WS})), lambda x: {_sql_quality('x')}) AS a, "
    f"list_transform(regexp_extract_all(content, '(?m)^(?:TBD|tbd|open question:|unclear:)\\s*(.+)$'), lambda x: trim(x, {WS})) AS b FROM msgs), "
    "both_kinds AS (SELECT conv_id, seq, 0 AS sub, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS pos FROM q UNION ALL "
    "SELECT conv_id, seq, 1, unnest(b), generate_subscripts(b, 1) - 1 FROM q), "
    f"agg AS (SELECT conv_id, {sql_dedup('text')} AS k, min((seq, sub, pos)) AS o, arg_min(text, (seq, sub, pos)) AS text FROM both_kinds GROUP BY 1, 2) "
    "SELECT conv_id, o[1] AS seq, CAST(o[2] AS BIGINT) AS sub, o[3] AS pos, text FROM agg WHERE k <> ''"
)


@query("x9_extract_open_questions", _QUESTION_SQL)
def _(spark, sf_dir):
    found = X.extract_open_questions(list_messages(spark, sf_dir), LEXICON)
    return found.select("conv_id", F.col("ord.seq").alias("seq"), F.col("ord.sub").alias("sub"), F.col("ord.pos").alias("pos"), "text")


def _union_sql() -> str:
    """Items of all sections from the section queries above, on the list messages."""

    def on_lists(sql: str) -> str:
        return sql.replace(SQL_MESSAGES, SQL_LIST_MESSAGES)

    parts = [f"SELECT conv_id, 'goal' AS section, goal AS text FROM ({on_lists(_GOAL_SQL)})"]
    from threadloom.plans.registry import ORACLES

    for section, name, column in (
        ("decision", "x4_extract_decisions", "decision"), ("constraint", "x5_extract_constraints", "text"),
        ("non_goal", "x6_extract_non_goals", "text"), ("task", "x7_extract_tasks", "title"), ("open_question", "x9_extract_open_questions", "text"),
    ):
        parts.append(f"SELECT conv_id, '{section}', {column} FROM ({on_lists(ORACLES[name])})")
    tech = on_lists(_TECH_SQL)
    parts.append(f"SELECT conv_id, 'tech_stack', split_part(u, '=', 2) FROM (SELECT conv_id, unnest(string_split(tech_stack, ',')) AS u FROM ({tech}))")
    return " UNION ALL ".join(parts)


@query("x10_extract_context", _union_sql())
def _(spark, sf_dir):
    return X.extract_context(list_messages(spark, sf_dir), LEXICON, "2024-01-01T00:00:00Z").select("conv_id", "section", "text")


@query("a10_extraction_summary", (
    f"WITH items AS ({_union_sql()}), {SQL_MESSAGES} SELECT m.conv_id, m.messages, count(text) FILTER (section = 'decision') AS decisions, "
    "count(text) FILTER (section = 'task') AS tasks, count(text) FILTER (section = 'constraint') AS constraints, "
    "count(text) FILTER (section = 'open_question') AS open_questions FROM (SELECT conv_id, count(*) AS messages FROM msgs GROUP BY 1) m "
    "LEFT JOIN items i ON i.conv_id = m.conv_id GROUP BY 1, 2"
))
def _(spark, sf_dir):
    rows = list_messages(spark, sf_dir)
    return X.extraction_summary(rows, X.extract_items(rows, LEXICON))


_DOMAIN_ROWS = values((i, r.name, k) for i, r in enumerate(DOMAINS) for k in r.keywords)
_DOMAIN_SKILLS = values([("english-domain", "spelling,grammar"), ("german-domain", "cases"), ("french-domain", "accents"), ("absent-domain", "none")])


@query("x11_detect_domains", (
    f"WITH {SQL_LIST_MESSAGES}, corpus AS (SELECT conv_id, lower(content) AS body FROM msgs UNION ALL SELECT conv_id, lower(text) FROM ({_union_sql()}) "
    "WHERE section IN ('tech_stack', 'decision', 'task')) "
    f"SELECT DISTINCT conv_id, domain, CAST(i AS BIGINT) AS rule_ord, skills FROM corpus JOIN {_DOMAIN_ROWS} r(i, domain, keyword) ON contains(body, keyword) "
    f"JOIN {_DOMAIN_SKILLS} s(domain, skills) USING (domain)"
))
def _(spark, sf_dir):
    rows = list_messages(spark, sf_dir)
    found = X.detect_domains(rows, X.extract_items(rows, LEXICON), DOMAINS)
    return found.select("conv_id", "domain", F.col("rule_ord").cast("bigint").alias("rule_ord"), F.array_join("skills", ",").alias("skills"))


_DECISION_TEXT = "'We decided ' || content || ' rather than ' || content"


@query("x12_session_decisions", (
    f"WITH {SQL_MESSAGES}, t AS (SELECT conv_id, seq, {_DECISION_TEXT} AS text FROM msgs WHERE role = 'assistant'), "
    "f AS (SELECT conv_id, seq, list_transform(regexp_extract_all(text, '(?i)(?:I (?:chose|decided|opted|selected|went with|picked)\\b.{20,150})"
    "|(?:(?:chose to|we (?:chose|decided|opted|went with))\\b.{20,120})|(?:instead of\\b.{20,100})|(?:rather than\\b.{20,100})"
    f"|(?:(?:approach|strategy|pattern|design)[:—]\\s*.{{20,150}})'), lambda x: rtrim(trim(x, {WS}), '.,;')) AS d FROM t), "
    "u AS (SELECT conv_id, seq, unnest(d) AS decision, generate_subscripts(d, 1) AS pos FROM f), "
    "m AS (SELECT conv_id, decision, min((seq, pos)) AS o FROM u WHERE length(decision) >= 35 GROUP BY 1, 2), "
    "r AS (SELECT conv_id, decision, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS ord FROM m) SELECT * FROM r WHERE ord <= 10"
))
def _(spark, sf_dir):
    texts = messages(spark, sf_dir).filter("role = 'assistant'")
    texts = texts.withColumn("text", F.concat(F.lit("We decided "), "content", F.lit(" rather than "), "content"))
    return X.session_decisions(texts, ["conv_id"]).withColumn("ord", F.col("ord").cast("bigint"))


def _sql_stop(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


@query("x13_tokenise_title", (
    "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), "
    f"lambda w: length(w) >= 2 AND NOT list_contains({_sql_stop(L.TITLE_STOP_WORDS)}, w)))), ' ') AS tokens FROM documents"
))
def _(spark, sf_dir):
    tokens = T.title_tokens(F.col("text"), L.TITLE_STOP_WORDS)
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("x14_tokenise_task", (
    "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9_-]{2,}'), "
    f"lambda w: NOT list_contains({_sql_stop(L.TASK_STOP_WORDS)}, w)), ' ') AS tokens FROM documents"
))
def _(spark, sf_dir):
    tokens = T.task_tokens(F.col("text"), L.TASK_STOP_WORDS)
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(tokens, " ").alias("tokens"))


@query("x15_significant_words", (
    "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda w: length(w) > 4), ' ') AS words FROM documents"
))
def _(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(T.significant_words(F.col("text")), " ").alias("words"))


@query("p8_question_quality", f"SELECT doc_id, pos, s AS sentence FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents)) WHERE {_sql_quality('s')}")
def _(spark, sf_dir):
    pieces = F.split("text", r"\.")
    parts = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(pieces).alias("pos", "sentence"))
    return parts.filter(question_quality(F.col("sentence"))).withColumn("pos", F.col("pos").cast("bigint"))


@query("p10_must_with_subject", (
    "SELECT doc_id FROM (SELECT doc_id, replace(text, ' of ', ' must ') AS t FROM documents) "
    "WHERE regexp_matches(t, '(?i)(^|[^\\p{L}\\p{N}\\p{M}_])(it|the\\s+[\\p{L}\\p{N}\\p{M}_]+|we|you|this|system|api|service|app)\\s+must($|[^\\p{L}\\p{N}\\p{M}_])')"
))
def _(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.replace("text", F.lit(" of "), F.lit(" must ")).alias("text"))
    return docs.filter(F.col("text").rlike(L.MUST_SUBJECT)).select("doc_id")
