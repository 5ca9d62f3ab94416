import time

from pyspark.sql import functions as F

from threadloom.functions.automaton import contained_terms
from threadloom.operators import extraction as X

SCHEMA = "conv_id STRING, seq INT, role STRING, content STRING"


def items(spark, *turns, section=None):
    rows = [("c", i, role, content) for i, (role, content) in enumerate(turns)]
    found = X.extract_items(spark.createDataFrame(rows, SCHEMA)).orderBy("section", "ord").collect()
    return [r for r in found if section is None or r.section == section]


def texts(spark, *turns, section):
    return [r.text for r in items(spark, *turns, section=section)]


def test_goal_takes_first_intent_sentence_of_user(spark):
    assert texts(spark, ("assistant", "Build a house."), ("user", "Hi there. I want to build a tracker!"), section="goal") == ["A tracker"]


def test_goal_order_is_message_then_keyword_then_sentence(spark):
    turn = ("user", "Create a list. We need to build a shop")  # "build a" comes before "create a" in the list
    assert texts(spark, turn, section="goal") == ["We need to build a shop"]


def test_goal_falls_back_to_first_user_message(spark):
    assert texts(spark, ("assistant", "x"), ("user", "help me create a bot?"), ("user", "y"), section="goal") == ["A bot"]
    assert texts(spark, ("assistant", "x"), section="goal") == [""]


def test_goal_starts_with_one_capital(spark):
    assert texts(spark, ("user", "create ßbetz"), section="goal") == ["ẞbetz"]


def test_decision_last_occurrence_wins_at_first_place(spark):
    got = texts(spark, ("user", "Let's use Flask. Going with Redis"), ("user", "We decided to keep Flask"), section="decision")
    assert got == ["We decided to keep Flask", "Going with Redis"]


def test_decision_key_is_a_substring_of_the_last_category(spark):
    # "flask" is a framework and "sqlite" a database: the later category gives the key
    got = texts(spark, ("user", "Let's use Flask with sqlite"), ("user", "Let's use sqlite alone"), section="decision")
    assert got == ["Let's use sqlite alone"]


def test_constraint_must_needs_a_subject(spark):
    got = texts(spark, ("user", "Must see movie. The system must be fast. you MUST log. It cannot fail"), section="constraint")
    assert got == ["The system must be fast", "you MUST log", "It cannot fail"]


def test_constraint_duplicates_by_clean_key(spark):
    assert texts(spark, ("user", "It cannot fail! it, cannot fail."), section="constraint") == ["It cannot fail"]


def test_non_goals(spark):
    assert texts(spark, ("user", "Billing is out of scope. We skip it"), section="non_goal") == ["Billing is out of scope", "We skip it"]


def test_tasks_after_first_listed_header(spark):
    text = "- before\nTODO:\n- in todo\nNext steps:\n1. Do a!\n2) Do B\n* do b\nPhase 2 — high priority thing"
    got = [(r.text, r.priority) for r in items(spark, ("user", text), section="task")]
    assert got == [("Do a!", "high"), ("Do B", "medium"), ("high priority thing", "high")]


def test_tasks_without_header_take_all_lists(spark):
    assert texts(spark, ("user", "- a\n-b\n  * c\n"), ("user", "- A"), section="task") == ["a", "c"]


def test_tech_stack_word_edges_and_last_in_list(spark):
    got = {r.label: r.text for r in items(spark, ("user", "Postgres is good, mysql too, Python and going"), section="tech_stack")}
    assert got == {"database": "MySQL", "language": "Python"}


def test_tech_name_across_messages(spark):
    assert texts(spark, ("user", "export it with Google"), ("user", "Takeout please"), section="tech_stack") == ["Google Takeout"]
    assert texts(spark, ("user", "export it with Google"), ("user", "x"), ("user", "Takeout"), section="tech_stack") == []


def test_open_questions(spark):
    text = "Which database should we pick? Why? `x` is it the right one here?\nTBD the colour scheme\nUnclear: no\nunclear: who pays"
    got = texts(spark, ("user", text), ("user", "which database should we pick?"), section="open_question")
    assert got == ["Which database should we pick?", "TBD the colour scheme", "unclear: who pays"]


def test_question_pattern_is_the_plain_one(spark):
    import re

    text = "Is this a real question? no. What about the\nsecond one here?! ...? Really do we need this one?"
    plain = [m.strip() for m in re.findall(r"[^.!?]*\?", text)]
    assert texts(spark, ("user", text), section="open_question") == [q for q in plain if len(q) >= 20]


def test_conversations_do_not_mix(spark):
    rows = [("a", 0, "user", "It cannot fail"), ("b", 0, "user", "It cannot fail")]
    found = X.extract_constraints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.conv_id for r in found) == ["a", "b"]


def test_domains_match_any_substring(spark):
    messages = spark.createDataFrame([("a", 0, "user", "We build it"), ("b", 0, "user", "nothing")], SCHEMA)
    found = X.detect_domains(messages, X.extract_items(messages)).collect()
    assert [(r.conv_id, r.domain, r.skills) for r in found] == [("a", "frontend-agent", ["accessibility-checklist"])]


def test_session_decisions_distinct_and_capped(spark):
    rows = [("s", i, f"I chose approach number {i % 12} because it is simpler to run.") for i in range(24)]
    rows.append(("s", 30, "I chose it."))
    got = X.session_decisions(spark.createDataFrame(rows, "session_id STRING, seq INT, text STRING")).orderBy("ord").collect()
    assert len(got) == 10 and got[0].decision == "I chose approach number 0 because it is simpler to run"


def test_names_of_three_words_break_at_any_of_their_spaces(spark):
    from threadloom.lexicons import Lexicon

    lexicon = Lexicon(tech={"cloud": {"google cloud run": "Google Cloud Run", "app store": "App Store"}})
    turns = [("a", "we use google", "cloud run now"), ("b", "we use google cloud", "run it"), ("c", "google", "cloud"), ("d", "the app", "store"), ("e", "google cloud", "cloud run")]
    rows = [(conv, i, "user", text) for conv, *parts in turns for i, text in enumerate(parts)]
    found = X.extract_items(spark.createDataFrame(rows, SCHEMA), lexicon, sections=["tech_stack"]).collect()
    assert sorted((r.conv_id, r.text) for r in found) == [("a", "Google Cloud Run"), ("b", "Google Cloud Run"), ("d", "App Store")]


def test_term_tables_of_any_length(spark):
    rows = [(1, "The cat scattered 🙂 cathode-rays"), (2, ""), (3, None), (4, "cat cat"), (4, "nothing here")]
    terms = [("a", 0, "cat"), ("a", 1, "scatter"), ("b", 2, "cat"), ("b", 3, "hode"), ("b", 4, "🙂 c"), ("c", 5, ""), ("c", 6, None), ("c", 7, "dog"), ("a", 0, "cat")]
    texts = spark.createDataFrame(rows, "id INT, body STRING")
    table = spark.createDataFrame(terms, "category STRING, kw_ord LONG, keyword STRING")
    want = sorted((i, t, *term) for i, t in rows for term in terms if t is not None and term[2] is not None and term[2] in t)
    for part_bytes in (1 << 20, 12):  # one automaton, and several
        assert sorted(tuple(r) for r in contained_terms(texts, table, "body", part_bytes=part_bytes).collect()) == want
    assert contained_terms(texts, table.limit(0), "body").count() == 0
    assert contained_terms(texts.limit(0), table, "body").count() == 0


def test_planning_does_not_grow_with_the_lexicon(spark):
    sentences = spark.createDataFrame([(1, 0, 0, "Word77 and word7999")], "conv_id INT, msg_seq INT, sent_ord INT, sentence STRING")
    terms = spark.range(10_000).select(F.lit("list").alias("category"), F.col("id").alias("kw_ord"), F.concat(F.lit("word"), "id").alias("keyword"))
    began = time.time()
    hits = X.match_terms(sentences, terms)
    hits._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5
    assert {r.kw_ord for r in hits.collect()} == {7, 77, 79, 799, 7999}
    ordinals = X.term_ordinals(sentences, terms).first()
    assert (ordinals.first_ord, ordinals.last_ord) == (7, 7999)


def test_keywords_listed_many_times_meet_a_sentence_once(spark, monkeypatch):
    """What is shared with executors is bounded, and ordinals join one row for each keyword of a category."""
    joined = []

    def counted(texts, terms, *args, **kwargs):
        joined.append(terms.count())
        return contained_terms(texts, terms, *args, **kwargs)

    monkeypatch.setattr(X, "contained_terms", counted)
    sentences = spark.createDataFrame([(1, 0, 0, "The cat and the dog"), (1, 0, 1, "nothing")], "conv_id INT, msg_seq INT, sent_ord INT, sentence STRING")
    terms = spark.range(5000).select(F.lit("list").alias("category"), F.col("id").alias("kw_ord"), F.element_at(F.array(F.lit("cat"), F.lit("dog"), F.lit("cow")), (F.col("id") % 3 + 1).cast("int")).alias("keyword"))
    assert [tuple(r) for r in X.term_ordinals(sentences, terms).collect()] == [(1, 0, 0, "list", 0, 4999)]
    assert joined == [3]


def test_rows_of_terms_are_shared_up_to_a_size(spark, monkeypatch):
    from threadloom.functions import automaton

    texts = spark.createDataFrame([(i, f"a cat {i}") for i in range(50)], "id INT, body STRING")
    table = spark.range(200).select(F.col("id").alias("kw_ord"), F.lit("cat").alias("keyword"))
    plans = {}
    for size in (1 << 20, 100):
        monkeypatch.setattr(automaton, "SHARED_BYTES", size)
        hits = contained_terms(texts, table, "body")
        assert hits.count() == 50 * 200
        plans[size] = "ResolvedHint (strategy=broadcast)" in hits._jdf.queryExecution().analyzed().toString()
    assert plans == {1 << 20: True, 100: False}
