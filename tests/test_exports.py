import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import messages as M
from threadloom.sources import exports as S


def files(spark, *pairs):
    return spark.createDataFrame([(p, c if isinstance(c, str) else json.dumps(c)) for p, c in pairs], "path STRING, content STRING")


def turns(df):
    return [(r.role, r.content) for r in df.orderBy("conv_id", "seq").collect()]


def test_claude_object_sorts_and_normalises(spark):
    doc = {"uuid": "u", "name": "Shop", "chat_messages": [
        {"sender": "assistant", "text": "second", "created_at": "2024-01-02"}, {"sender": "Human", "text": "first", "created_at": "2024-01-01"},
        {"sender": "human", "text": "", "content": "", "created_at": "2024-01-03"}, {"sender": "human", "text": "undated"},
    ]}
    df = S.read_claude_json(files(spark, ("/a.json", doc)))
    assert turns(df) == [("user", "undated"), ("user", "first"), ("assistant", "second")]
    assert df.first().conv_id == "u" and df.first().title == "Shop"


def test_claude_array_reads_every_conversation(spark):
    docs = [{"uuid": u, "chat_messages": [{"sender": "human", "text": u}]} for u in "ab"]
    assert turns(S.read_claude_json(files(spark, ("/a.json", docs)))) == [("user", "a"), ("user", "b")]


def test_claude_role_content_form(spark):
    doc = {"id": "v2", "messages": [{"role": "user", "content": "hello", "id": "m"}]}
    row = S.read_claude_json(files(spark, ("/a.json", doc))).first()
    assert (row.conv_id, row.role, row.content, row.message_id) == ("v2", "user", "hello", "m")


def test_claude_unknown_role(spark):
    doc = {"uuid": "u", "chat_messages": [{"sender": "system", "text": "x"}, {"sender": "human", "text": "y"}]}
    source = files(spark, ("/a.json", doc))
    with pytest.raises(Exception, match="Unknown role"):
        S.read_claude_json(source).collect()
    assert turns(S.read_claude_json(source, on_error="skip")) == [("user", "y")]


def test_claude_bad_json_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_claude_json(files(spark, ("/a.json", '{"uuid": '))).collect()
    lines = spark.createDataFrame([("/a.jsonl", "oops")], "path STRING, line STRING")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_claude_jsonl(lines).collect()


def test_claude_markdown(spark):
    text = "Preamble\n**Human:** Hi\n\n1. one\n\n**Assistant:**\nHello **Human:** inline\n\n**Human:**   \n"
    assert turns(S.read_claude_markdown(files(spark, ("/a.md", text)))) == [("user", "Hi\n\n1. one"), ("assistant", "Hello **Human:** inline")]


def node(parent, children, role=None, parts=None, at=None):
    message = None if role is None else {"author": {"role": role}, "content": {"parts": parts or []}, "create_time": at}
    return {"parent": parent, "children": children, "message": message}


TREE = [{"id": "c", "title": "T", "create_time": 1700000000, "mapping": {
    "root": node(None, ["sys", "u1"]), "sys": node("root", [], "system", ["hidden"]),
    "u1": node("root", ["a1", "a2"], "user", ["ask", "", "more"], 1700000000.5), "a1": node("u1", ["u2"], "assistant", ["first"]),
    "u2": node("a1", [], "user", ["follow"]), "a2": node("u1", ["gone", "t"], "other", ["second", {"text": "inner"}]), "t": node("a2", [], "tool", ["x"]),
}}]


def test_chatgpt_walks_all_branches(spark):
    df = S.read_chatgpt_tree(files(spark, ("/a.json", TREE)))
    assert turns(df) == [("user", "ask\nmore"), ("assistant", "first"), ("user", "follow"), ("assistant", 'second\n{"text":"inner"}')]
    assert df.orderBy("seq").first().timestamp == "2023-11-14T22:13:20.500000+00:00"


def test_chatgpt_active_branch_follows_last_child(spark):
    mapping = dict(TREE[0]["mapping"], a2=node("u1", [], "assistant", ["second", {"text": "inner"}]))
    df = S.read_chatgpt_active_branch(files(spark, ("/a.json", [dict(TREE[0], mapping=mapping)])))
    assert turns(df) == [("user", "ask\n\nmore"), ("assistant", "second\ninner")]
    assert df.orderBy("seq").first().timestamp == "2023-11-14T22:13:20.500Z"


def test_chatgpt_deep_tree(spark):
    n = 600
    mapping = {f"n{i}": node(f"n{i - 1}" if i else None, [f"n{i + 1}"] if i + 1 < n else [], "user", [str(i)]) for i in range(n)}
    got = turns(S.read_chatgpt_tree(files(spark, ("/a.json", [{"id": "d", "mapping": mapping}]))))
    assert [c for _, c in got] == [str(i) for i in range(n)]


def test_chatgpt_empty_mapping_is_an_error(spark):
    with pytest.raises(Exception, match="mapping"):
        S.read_chatgpt_tree(files(spark, ("/a.json", [{"id": "x", "mapping": {}}]))).collect()


def test_gemini(spark):
    doc = {"appActivity": [
        {"activityTime": "t1", "requestBody": {"parts": [{"text": "a"}, {"text": ""}, {"text": "b"}]}, "responseBody": {"parts": [{"text": "c"}]}},
        {"activityTime": "t2", "responseBody": {"parts": [{"text": "d"}]}},
    ]}
    assert turns(S.read_gemini(files(spark, ("/a.json", doc)))) == [("user", "a\nb"), ("assistant", "c"), ("assistant", "d")]
    with pytest.raises(Exception, match="appActivity"):
        S.read_gemini(files(spark, ("/a.json", {"x": 1}))).collect()


def test_perplexity_lists_sources(spark):
    doc = {"conversations": [{"id": "p", "title": "T", "messages": [
        {"role": "user", "content": " q ", "timestamp": "1", "sources": [{"title": "no", "url": "no"}]},
        {"role": "assistant", "content": "a", "sources": [{"title": "A", "url": "http://a"}, {"url": "http://b"}, {"title": "C"}]},
        {"role": "assistant", "content": " ", "sources": [{"title": "x"}]},
    ]}]}
    got = turns(S.read_perplexity(files(spark, ("/a.json", doc))))
    assert got == [("user", "q"), ("assistant", "a"), ("assistant", "Sources:\n- [A](http://a)\n- [Link](http://b)\n- C")]


def test_mixed_files_reach_their_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"uuid": "u", "chat_messages": [{"sender": "human", "text": "one"}]}))
    (tmp_path / "b.jsonl").write_text(json.dumps({"uuid": "v", "chat_messages": [{"sender": "human", "text": "two"}]}) + "\n\n")
    (tmp_path / "c.md").write_text("**Human:** three")
    (tmp_path / "d.json").write_text(json.dumps(TREE))
    (tmp_path / "perplexity_e.json").write_text(json.dumps({"conversations": [{"id": "p", "messages": [{"role": "user", "content": "four"}]}]}))
    (tmp_path / "f.txt").write_text("plain")
    read = S.read_files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[-1]: (r.source, r.error) for r in S.classify_exports(read).collect()}
    assert kinds["f.txt"][0] is None and "Unsupported" in kinds["f.txt"][1]
    assert {k: v[0] for k, v in kinds.items() if k != "f.txt"} == {"a.json": "claude", "b.jsonl": "claude", "c.md": "claude", "d.json": "chatgpt", "perplexity_e.json": "perplexity"}
    contents = {r.content for r in S.read_exports(read).collect()}
    assert {"one", "two", "three", "four", "ask\nmore"} <= contents


def test_select_conversation(spark):
    rows = spark.createDataFrame([("f", 0, "1", "API design"), ("f", 1, "2", "my api"), ("g", 0, "3", "x")], "path STRING, pos INT, conv_id STRING, title STRING")
    assert [r.conv_id for r in M.select_conversation(rows, title="API").collect()] == ["1"]
    assert [r.conv_id for r in M.select_conversation(rows, conv_id="3").collect()] == ["3"]
    assert M.select_conversation(rows).count() == 0


def test_two_sided(spark):
    rows = spark.createDataFrame(
        [("a", 0, "user", "long enough"), ("a", 1, "assistant", "also long"), ("a", 2, "user", "no"), ("b", 0, "user", "long enough"), ("b", 1, "assistant", "hm")],
        "conv_id STRING, seq INT, role STRING, content STRING",
    )
    assert sorted((r.conv_id, r.seq) for r in M.two_sided_conversations(rows).collect()) == [("a", 0), ("a", 1)]


def test_strict_roles(spark):
    rows = spark.createDataFrame([("HUMAN",), ("Assistant",), ("tool",)], "role STRING")
    assert {r.role for r in M.normalise_roles(rows, strict=False).collect()} == {"user", "assistant", None}
    with pytest.raises(Exception, match="Unknown role"):
        M.normalise_roles(rows).collect()
    assert M.order_messages(rows.select(F.lit(1).alias("conv_id"), F.lit(0).alias("seq"), F.lit("t").alias("timestamp")).limit(1)).count() == 1


def test_chatgpt_cycles_end_and_unknown_last_children_stop(spark):
    ring = {"r": node(None, ["a"], "user", ["r"]), "a": node("r", ["b"], "user", ["a"]), "b": node("a", ["a"], "user", ["b"])}
    gone = {"r": node("", ["a", "gone"], "user", ["r"]), "a": node("r", [], "user", ["a"])}
    for mapping, branch, everything in ((ring, "rab", "rab"), (gone, "r", "ra")):
        given = files(spark, ("/a.json", [{"id": "d", "mapping": mapping}]))
        assert "".join(c for _, c in turns(S.read_chatgpt_active_branch(given))) == branch
        assert "".join(c for _, c in turns(S.read_chatgpt_tree(given))) == everything


def test_chatgpt_walk_is_linear(spark):
    n = 20_000
    mapping = {f"n{i}": node(f"n{i - 1}" if i else None, [f"n{i + 1}"] if i + 1 < n else [], "user", [str(i)]) for i in range(n)}
    got = turns(S.read_chatgpt_tree(files(spark, ("/a.json", [{"id": "d", "mapping": mapping}]))))
    assert [c for _, c in got] == [str(i) for i in range(n)]


def test_landing_judges_payloads_once(spark, monkeypatch):
    from threadloom.streaming import landing

    bodies = ["{broken", '{"source": "other", "conversation": {"a": 1}}', '{"source": "claude"}',
              '{"source": "claude", "conversation": {"uuid": "c", "chat_messages": [{"sender": "human", "text": "TODO: add a test"}]}}']
    documents = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "path STRING, value STRING")
    items, rejects, plans = [], [], []

    def messages_of(good):
        plans.append(good._jdf.queryExecution().executedPlan().toString())
        return payload_messages(good)

    payload_messages = landing.payload_messages
    monkeypatch.setattr(landing, "payload_messages", messages_of)
    landing.landing_ingest(lambda df, n: items.extend(df.collect()), lambda df, n: rejects.extend(df.collect()))(documents, 0)
    assert {r.conv_id for r in items} == {"c"}
    assert sorted((r.path, r.error) for r in rejects) == [("0", "Invalid JSON"), ("1", "Unknown source 'other'"), ("2", "'conversation' field is required")]
    assert "InMemoryTableScan" in plans[0]
