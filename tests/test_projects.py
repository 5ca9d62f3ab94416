import random
import re

from pyspark.sql import functions as F

from threadloom.functions.ordering import ord_of
from threadloom.lexicons import TITLE_STOP_WORDS
from threadloom.operators import grouping as G
from threadloom.operators import maintenance as N
from threadloom.operators import merging as M

LISTING = "listing STRING, ord LONG, conv_id STRING, title STRING"


def listing(spark, titles, name="L"):
    return spark.createDataFrame([(name, i, str(i), t) for i, t in enumerate(titles)], LISTING)


def projects(spark, titles):
    return [r.project for r in G.group_by_project(listing(spark, titles)).orderBy("ord").collect()]


def test_shared_prefix(spark):
    got = projects(spark, ["Shop - cart", "Shop: checkout", "Blog | first", "x - one", "x - two"])
    assert got == ["Shop", "Shop", "(ungrouped)", "(ungrouped)", "(ungrouped)"]


def test_token_overlap_names_the_common_tokens(spark):
    got = projects(spark, ["Build payment api now", "The payment api tests", "Holiday plans"])
    assert got == ["Api Payment", "Api Payment", "(ungrouped)"]


def test_leader_without_common_token_stays_alone(spark):
    # the first title shares two tokens with each other one, but none with all of them
    got = projects(spark, ["aa bb cc dd", "aa bb xx", "cc dd xx yy", "cc dd yy"])
    assert got == ["(ungrouped)", "(ungrouped)", "Cc Dd Yy", "Cc Dd Yy"]


def plain_leaders(titles):
    """One title after the other, as the rule is stated."""
    sets = [{w for w in re.findall("[a-z0-9]+", t.lower()) if w not in TITLE_STOP_WORDS and len(w) >= 2} for t in titles]
    owner = {}
    for i, own in enumerate(sets):
        if i in owner:
            continue
        group = [i] + [j for j in range(i + 1, len(sets)) if j not in owner and len(own & sets[j]) >= 2]
        common = set.intersection(*[sets[g] for g in group])
        if len(group) >= 2 and common:
            owner.update({g: (i, " ".join(sorted(common)).title()) for g in group})
    return [owner.get(i, (None, "(ungrouped)")) for i in range(len(sets))]


def test_rounds_agree_with_one_by_one(spark):
    rng = random.Random(7)
    words = ["red", "blue", "api", "shop", "cart", "test", "plan", "note"]
    for size in (2, 3, 4):
        titles = [" ".join(rng.sample(words, rng.randrange(1, size + 1))) for _ in range(30)]
        got = [(r.leader, r.project) for r in G.group_by_project(listing(spark, titles)).orderBy("ord").collect()]
        assert got == plain_leaders(titles)


def test_listings_are_grouped_apart(spark):
    both = listing(spark, ["payment api one"], "L").unionByName(listing(spark, ["payment api two"], "M"))
    assert {r.project for r in G.group_by_project(both).collect()} == {"(ungrouped)"}


def test_filter_by_project(spark):
    rows = listing(spark, ["My payment API", "payment", "api"])
    assert [r.title for r in G.filter_by_project(rows, "the API payment").collect()] == ["My payment API"]
    assert G.filter_by_project(rows, "the of").count() == 0


def test_page_counts_the_rest(spark):
    rows = listing(spark, [f"t{i}" for i in range(25)]).withColumn("date", F.lit(None).cast("string"))
    page = G.conversation_page(rows).collect()
    assert len(page) == 20 and {r.more for r in page} == {5} and {r.date for r in page} == {"unknown"}


ITEM = "project_id STRING, session_ord LONG, section STRING, seq LONG, label STRING, text STRING, detail STRING, priority STRING, done BOOLEAN"


def items(spark, *rows):
    full = [("p", s, section, i, label, text, "", "medium", done) for i, (s, section, label, text, done) in enumerate(rows)]
    return spark.createDataFrame(full, ITEM).withColumn("ord", ord_of(seq=F.col("seq")))


def merged(df):
    return [(r.section, r.label, r.text, r.done) for r in M.merge_contexts(df).orderBy("section", "ord").collect()]


def test_merge_rules(spark):
    df = items(
        spark, (1, "goal", "", "first", False), (2, "goal", "", "", False), (1, "tech_stack", "language", "Go", False), (2, "tech_stack", "language", "Rust", False),
        (1, "tech_stack", "database", "SQLite", False), (1, "task", "", "Ship it", False), (2, "task", "", "ship it ", True), (3, "task", "", "SHIP IT", False),
        (1, "constraint", "", "No cloud", False), (2, "constraint", "", "no cloud", False), (1, "decision", "a", "x", False), (2, "decision", "A", "X", False), (2, "decision", "b", "x", False),
    )
    assert merged(df) == [
        ("constraint", "", "No cloud", False), ("decision", "a", "x", False), ("decision", "b", "x", False), ("goal", "", "first", False),
        ("task", "", "ship it ", True), ("tech_stack", "language", "Rust", False), ("tech_stack", "database", "SQLite", False),
    ]


def test_single_session_is_unchanged(spark):
    assert merged(items(spark, (1, "constraint", "", "a", False), (1, "constraint", "", "A", False))) == [("constraint", "", "a", False), ("constraint", "", "A", False)]


BACKLOG = "project_id STRING, id STRING, seq LONG, title STRING, description STRING, phase STRING, priority STRING, done BOOLEAN, added_at STRING, done_at STRING"


def backlog(spark, *rows):
    full = [("p", i, n, title, "", "1", priority, done, "", "2024" if done else None) for n, (i, title, priority, done) in enumerate(rows)]
    return spark.createDataFrame(full, BACKLOG).withColumn("ord", ord_of(seq=F.col("seq"))).drop("seq")


def delta(spark, saved, fresh, old=(), new=(), **options):
    old_rows, new_rows = backlog(spark, *(old or [("t", "t", "low", False)])), backlog(spark, *(new or [("t", "t", "low", False)]))
    out = N.compute_delta(items(spark, *saved), old_rows, items(spark, *fresh), new_rows, **options).collect()
    return sorted((r.kind, r.label, r.text, r.old_text) for r in out)


def test_delta_kinds(spark):
    saved = [(0, "task", "", "Ship", True), (0, "decision", "DB", "sqlite", False), (0, "decision", "db", "mysql", False), (0, "tech_stack", "language", "Go", False), (0, "constraint", "", "No cloud", False)]
    fresh = [
        (0, "task", "", "SHIP", False), (0, "task", "", "Test", False), (0, "decision", "Db", "MYSQL", False), (0, "decision", "DB", "redis", False), (0, "decision", "ui", "web", False),
        (0, "tech_stack", "language", "Rust", False), (0, "tech_stack", "ai", "X", False), (0, "constraint", "", "no CLOUD", False), (0, "open_question", "", "why", False), (0, "goal", "", "g", False),
    ]
    assert delta(spark, saved, fresh) == [
        ("new_decision", "ui", "web", None), ("new_open_question", "", "why", None), ("new_task", "", "Test", None), ("new_tech_stack", "ai", "X", None),
        ("preserved_done_task", "", "Ship", None), ("revised_decision", "DB", "redis", "mysql"),
    ]


def test_delta_backlog_ids_collide_unless_told(spark):
    old, new = [("task-001", "Old", "low", True)], [("task-001", "New", "low", False), ("task-002", "OLD", "low", False), ("task-003", "Other", "low", False)]
    some = [(0, "goal", "", "g", False)]
    got = delta(spark, some, some, old, new)
    assert [g[:3] for g in got] == [("new_backlog_task", "task-003", "Other"), ("preserved_done_backlog", "task-001", "Old")]
    got = delta(spark, some, some, old, new, match_on_id=False)
    assert [g[2] for g in got if g[0] == "new_backlog_task"] == ["New", "Other"]


def test_delta_is_empty_when_only_preserved(spark):
    saved = [(0, "task", "", "Ship", True)]
    args = items(spark, *saved), backlog(spark, ("a", "A", "low", False)), items(spark, *saved), backlog(spark, ("a", "A", "low", False))
    assert [r.is_empty for r in N.delta_is_empty(N.compute_delta(*args)).collect()] == [True]


def test_apply_items_keeps_and_dates(spark):
    saved, fresh = items(spark, (0, "decision", "db", "a", False)), items(spark, (0, "decision", "db", "b", False), (0, "task", "", "t", False))
    none = backlog(spark, ("a", "A", "low", False))
    d = N.compute_delta(saved, none, fresh, none)
    rows = N.apply_items(saved, d, "2024-06-01").collect()
    assert sorted((r.section, r.text, r.added_on, r.old_text) for r in rows) == [("decision", "a", None, None), ("revised_decision", "b", "2024-06-01", "a"), ("task", "t", "2024-06-01", None)]
    assert {r.section for r in N.apply_items(saved, d, "2024-06-01", no_conflict=True).collect()} == {"decision", "task"}


def test_decision_numbers_go_on(spark):
    saved = spark.createDataFrame([("p", 7)], "project_id STRING, number INT")
    new = items(spark, (0, "decision", "", "a", False), (0, "decision", "", "b", False))
    assert sorted((r.text, r.number) for r in N.number_decisions(saved, new).collect()) == [("a", 8), ("b", 9)]


def test_sync_needs_two_tokens(spark):
    rows = backlog(spark, ("1", "Add login endpoint", "low", False), ("2", "Add login page", "low", False), ("3", "Login login", "low", False), ("4", "Old endpoint", "low", True))
    evidence = spark.createDataFrame([("p", "src/LOGIN_endpoint.py"), ("q", "page")], "project_id STRING, text STRING")
    synced = N.sync_backlog(rows, evidence, "now").orderBy("id").collect()
    assert [(r.id, r.done, r.marked, r.done_at) for r in synced] == [("1", True, True, "now"), ("2", False, False, None), ("3", True, True, "now"), ("4", True, False, "2024")]
    assert {r.updated_at for r in synced} == {"now"}
    result = N.sync_result(N.sync_backlog(rows, evidence, "now")).first()
    assert (result.tasks_total, result.tasks_marked_done, result.already_done) == (4, 2, 1)


def test_status_goes_by_list_order(spark):
    rows = backlog(spark, ("1", "a", "low", True), ("2", "b", "high", False), ("3", "c", "low", True), ("4", "d", "low", False))
    ends = N.next_and_last_task(rows).first()
    assert (ends.next_task, ends.last_completed) == ("b", "c")
    assert N.backlog_status(rows).first().asDict() == {"project_id": "p", "total": 4, "done": 2, "remaining": 2, "high_priority_remaining": 1}
