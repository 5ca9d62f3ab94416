import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.operators import sessions as A
from threadloom.sources import sessions as S
from threadloom.streaming import idle_sessions as Z


def entry(kind, content, **more):
    message = {"role": kind, "content": content, **({"usage": more.pop("usage")} if "usage" in more else {})}
    return json.dumps({"type": kind, "message": message, **more})


def call(name, **given):
    return {"type": "tool_use", "name": name, "input": given}


LOG = [
    json.dumps({"type": "queue-operation"}),
    "not json",
    entry("user", "Please start", timestamp="2024-01-01T10:00:00Z", gitBranch="main", cwd="/w", version="1.2"),
    entry("assistant", [{"type": "text", "text": "Ok."}, call("Write", file_path="a.py"), call("Bash", command=" ls \n")], sessionId="s1"),
    entry("user", [{"type": "tool_result", "content": "x"}]),
    entry("assistant", [call("Edit", path="b.py"), call("Write", file_path="c.py"), call("Write", file_path="c.py"), call("Read", file_path="d.py")], usage={"input_tokens": 50_000}),
    entry("assistant", [call("Write", file_path="b.py"), call("Bash", command="ls"), {"type": "tool_use", "name": "Odd", "input": "text"}]),
    entry("assistant", [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "I chose sqlite over postgres because it is simple."}, {"type": "text", "text": "Bye"}], usage={"input_tokens": 1_000, "cache_read_input_tokens": 4_000}),
    entry("assistant", [call("Bash", command="make\nall")]),
]


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "stem1.jsonl").write_text("\n".join(LOG) + "\n")
    return S.read_session_entries(S.read_session_lines(spark, str(folder)))


def test_entries_skip_housekeeping_and_bad_lines(entries):
    assert [r.type for r in entries.orderBy("seq").collect()] == ["user", "assistant", "user", "assistant", "assistant", "assistant", "assistant"]


def test_messages_are_text_only(entries):
    got = [(r.role, r.content) for r in S.session_messages(entries).orderBy("seq").collect()]
    assert got == [("user", "Please start"), ("assistant", "Ok."), ("assistant", "I chose sqlite over postgres because it is simple.\n\nBye")]


def test_meta_and_listing(entries):
    meta = S.session_meta(entries).first()
    assert (meta.session_id, meta.started_at, meta.git_branch, meta.project_path, meta.message_count) == ("stem1", "2024-01-01T10:00:00Z", "main", "/w", 7)
    assert S.session_listing(S.session_meta(entries)).first().title == "Session stem1 @ 2024-01-01"
    assert S.session_format_version(entries).first().format_version == "1.2"


def test_facts(entries):
    facts = A.session_facts(entries)
    changes = [(r.file, r.action) for r in A.file_changes(facts).orderBy("first_at").collect()]
    assert changes == [("a.py", "created"), ("b.py", "modified"), ("c.py", "modified")]
    assert [r.command for r in A.session_commands(facts).orderBy("ord").collect()] == ["ls", "make\nall"]
    assert A.last_action(facts).first().last_action == "Bash: make all"
    assert A.context_usage(facts).first().context_usage_pct == 2
    assert A.first_metadata(facts).first()[1:] == ("s1", "2024-01-01T10:00:00Z", "main")


def test_sessions_without_an_id_are_named_by_their_file(spark, tmp_path):
    (tmp_path / "stem.2.jsonl").write_text(entry("user", "Hello") + "\n")
    facts = A.session_facts(S.read_session_entries(S.read_session_lines(spark, str(tmp_path))))
    assert A.first_metadata(facts).first().session_id == "stem.2"


def test_usage_rounds_half_even_and_has_a_floor(spark):
    df = spark.createDataFrame([(999,), (1000,), (5000,), (7000,), (900_000,)], "t LONG")
    assert [r[0] for r in df.select(A.usage_percent(F.col("t"))).collect()] == [None, 0, 2, 4, 100]


def test_summary(spark, entries):
    path = entries.first().path
    plans = spark.createDataFrame([(path, 0, "Do the other thing", "medium", False), (path, 1, "Old", "high", True), (path, 2, "Urgent thing", "high", False)], "path STRING, ord INT, title STRING, priority STRING, done BOOLEAN")
    row = A.summarise_sessions(A.session_facts(entries), plans).first()
    assert row.files_changed == 3 and row.tasks_completed == 1 and row.tasks_remaining == 2
    assert row.next_steps == ["Complete: Urgent thing", "Complete: Do the other thing"]
    assert row.decisions == ["I chose sqlite over postgres because it is simple. Bye"]
    assert A.summarise_sessions(A.session_facts(entries)).first().next_steps == ["Review changed files and run tests"]


def test_plan_tasks_match_significant_words(spark):
    changes = spark.createDataFrame([("s", "src/Payments_api.py")], "path STRING, file STRING")
    tasks = spark.createDataFrame([("s", 0, "Add payments now", False), ("s", 1, "Add apis", False), ("s", 2, "Fix src api", False), ("t", 3, "payments", False)], "path STRING, ord INT, title STRING, done BOOLEAN")
    assert [r.done for r in A.match_plan_tasks(tasks, changes).orderBy("ord").collect()] == [True, False, False, False]


def logged(spark, lines, first_seq, paths=("s1.jsonl",)):
    return spark.createDataFrame([(p, p, 1, first_seq + n, line) for p in paths for n, line in enumerate(lines)], "path STRING, stem STRING, size LONG, seq LONG, line STRING")


def test_idle_session_is_emitted_whole_and_again_when_it_goes_on(spark, tmp_path):
    landing, facts, summaries = str(tmp_path / "logs"), [], []
    first = logged(spark, LOG, 0, ("s1.jsonl", "s2.jsonl"))
    late = logged(spark, [entry("assistant", [call("Write", file_path="late.py"), call("Bash", command="make late")])], 100)
    first.write.parquet(landing)

    def each(df, n):
        got = df.persist()
        if got.count():
            facts.append(got.collect())
            Z.summarise_idle(lambda s, _: summaries.append({r.path: r for r in s.collect()}))(got, n)

    with Z.keyed_state(spark):
        stream = S.read_session_entries(spark.readStream.schema(first.schema).parquet(landing))
        run = Z.idle_sessions(stream, idle_seconds=2).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "out")).trigger(processingTime="1 second").start()
    try:
        for wanted in (2, 3):
            until = time.time() + 90
            while sum(map(len, summaries)) < wanted and time.time() < until:
                time.sleep(0.5)
            assert sum(map(len, summaries)) == wanted, run.exception()
            late.write.mode("append").parquet(landing)
    finally:
        run.stop()
    assert [s["s1.jsonl"].files_changed for s in summaries if "s1.jsonl" in s] == [3, 4]
    assert [s["s2.jsonl"].files_changed for s in summaries if "s2.jsonl" in s] == [3]
    # what the stream merged is what the batch operator aggregates from the whole log
    whole = A.session_facts(S.read_session_entries(first.filter("path = 's1.jsonl'").unionByName(late)))
    columns = whole.columns
    emitted = [tuple(r[c] for c in columns) for r in facts[-1] if r.path == "s1.jsonl"]
    assert sorted(emitted, key=repr) == sorted((tuple(r) for r in whole.collect()), key=repr)


def test_digests_merge_in_any_order():
    parts = [(seq, 0, f"v{seq}", seq, 0, f"v{seq}", 1, *[x for k in range(4) for x in ((seq, f"f{k}{seq}") if (seq + k) % 3 else (None, None))]) for seq in range(6)]
    whole = None
    for p in parts:
        whole = Z._merged(whole, p)
    halves = [None, None]
    for n, p in enumerate(reversed(parts)):
        halves[n % 2] = Z._merged(halves[n % 2], p)
    assert Z._merged(*halves) == whole and whole[:7] == (0, 0, "v0", 5, 0, "v5", 6)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_windows_of_hot_keys_equal_those_of_spark(spark, kind, monkeypatch):
    monkeypatch.setattr(Z, "CELLS", 3)
    us = F.when(F.col("id") % 3 == 0, F.col("id") * 7_000_000).otherwise(F.pmod(F.xxhash64("id"), F.lit(20_000 * 60_000_000)))
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 5)).alias("path"), (us - 9_000_000_000).alias("us")
    ).withColumn("ts", F.timestamp_micros("us").cast(kind))
    rows = rows.unionByName(rows.limit(500)).unionByName(rows.limit(3).withColumn("ts", F.lit(None).cast(kind)))
    for idle in ("60 seconds", "10 minutes", "20 seconds"):
        want = rows.groupBy("path", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ended"))
        want = Counter(tuple(r) for r in want.select("path", "w.start", "ended", "n").collect())
        got = Z.session_windows(rows, idle)
        assert got.schema["started"].dataType.simpleString() == kind
        assert Counter(tuple(r) for r in got.select("path", "started", "ended", "entries").collect()) == want
    assert Z.session_windows(rows.limit(0)).count() == 0


def test_state_of_a_session_is_read_by_pages(monkeypatch):
    """Facts in doubling pages: emitted whole whatever the pages, with far fewer calls to the state than facts."""
    import pandas as pd

    calls = []

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Map(dict):
        def getValue(self, key):
            calls.append(key)
            return self.get(key)

        def updateValue(self, key, value):
            calls.append(key)
            self[key] = value

    class Handle:
        timers: list = []
        getValueState = staticmethod(lambda name, schema: Value())
        getMapState = staticmethod(lambda name, key, value, ttl: Map())
        listTimers = lambda self: iter(self.timers)
        deleteTimer = lambda self, timer: self.timers.remove(timer)
        registerTimer = lambda self, timer: self.timers.append(timer)

    def rows(seqs):
        given = [("change", f"/f{n % 500}", n, 0, f"v{n}", n) for n in seqs]
        frame = pd.DataFrame(given, columns=["kind", "key", "seq", "pos", "value", "at_ms"])
        return frame.assign(**{c: None for c in Z.ENTRY_FIELDS})

    def emitted(page_facts):
        monkeypatch.setattr(Z, "PAGE_FACTS", page_facts)
        calls.clear()
        digests = Z.SessionDigests("path", 10, True, None)
        digests.init(Handle())
        for start in (0, 300, 600):
            list(digests.handleInputRows(("p",), iter([rows(range(start, start + 300))]), None))
        out = list(digests.handleExpiredTimer(("p",), None, None))
        assert all(len(page) <= 4 * page_facts for page in out)
        return sorted((r.key, r.first_seq, r.last_seq, r.last_value, r.n) for r in pd.concat(out).itertuples())

    want = sorted((f"/f{k}", k, k + 500 * (k < 400), f"v{k + 500 * (k < 400)}", 1 + (k < 400)) for k in range(500))
    assert emitted(2000) == want
    assert len(calls) < 10
    assert emitted(16) == want


def test_rendered_summaries_read_the_log_once(spark):
    from threadloom.plans.catalog import QUERIES

    rendered = QUERIES["b3_render_session_summary"](spark, "/root/testdata/sf0.001")
    assert "Relation [" not in rendered._jdf.queryExecution().optimizedPlan().toString()  # all from facts and tasks that are cut


def test_summary_of_matched_tasks(spark):
    facts = A.session_facts(spark.createDataFrame(
        [("a", 1, "assistant", None, None, None, None, '[{"type": "tool_use", "name": "Write", "input": {"file_path": "src/loader.py"}}]')],
        "path STRING, seq INT, type STRING, session_id STRING, git_branch STRING, timestamp STRING, usage STRUCT<input_tokens: BIGINT, cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT>, raw STRING",
    ).withColumn("content", F.try_parse_json("raw")))
    plans = spark.createDataFrame([("a", 0, "Write loader", "medium", False), ("a", 1, "Other thing", "high", False), ("b", 0, "No session", "medium", False)], "path STRING, ord INT, title STRING, priority STRING, done BOOLEAN")
    tasks = A.match_plan_tasks(plans, A.file_changes(facts))
    got = A.summarise_sessions(facts, tasks=tasks).collect()
    assert got == A.summarise_sessions(facts, plans).collect() and [(r.tasks_completed, r.tasks_remaining, r.next_steps) for r in got] == [(1, 1, ["Complete: Other thing"])]
