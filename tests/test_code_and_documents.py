import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions.ordering import ord_of
from threadloom.lexicons import EXCLUDED_DIRS
from threadloom.operators import code_index as C
from threadloom.operators import model_batches as B
from threadloom.operators import rendering as R
from threadloom.sources import documents as D
from threadloom.sources import history as H
from threadloom.sources import trees as S

PROJECT = {
    "src/auth.py": '"""\n\nLogin helpers.\n"""\nimport jwt, datetime\nfrom .models import User\nfrom . import x\n\n@cache\ndef login(a):\n    """Log in."""\n\nasync def out(b: int = 1) -> None: ...\n\nclass Auth(Base):\n    def inner(self): pass\n',
    "src/models.py": "from .database import db\nfrom ..src import auth\nclass User: pass\n",
    "src/database.py": "import os.path\n",
    "src/broken.py": "def (:\n",
    "src/__init__.py": "",
    "main.py": "import src.auth\nimport src\nimport json\n",
    "tests/test_auth.py": "import src.auth\n",
    "web/app.ts": 'import React from "react";\nimport "./style.css";\nimport {a} from \'@scope/pkg\';\n\nexport\n  class App {}\nexport default async function go() {}\nexport const App = 1;\n export const no = 1;\n',
    "web/app.test.ts": "export const t = 1;\n",
    "node_modules/x.js": "export const x = 1;\n",
    "lib.egg-info/a.txt": "x",
    "data.bin": "a\x00b",
    "long.txt": "\n" * 500,
    "fits.txt": "\n" * 499,
    "skip/deep/me.txt": "x",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "repo"
    for name, content in PROJECT.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())
    assert S.read_tree(spark, str(root)).count() == len(PROJECT)
    return C.index_tree(spark, str(root), ["skip/*"])


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_files(index):
    listed = {r.path: r for r in index["files"].collect()}
    assert sorted(listed) == sorted(set(PROJECT) - {"node_modules/x.js", "lib.egg-info/a.txt", "data.bin", "long.txt", "skip/deep/me.txt"})
    assert listed["src/auth.py"].purpose == "Login helpers." and listed["src/broken.py"].purpose == "(parse error)"
    assert listed["fits.txt"].line_count == 500
    assert listed["src/auth.py"].test_file == "tests/test_auth.py" and listed["web/app.ts"].test_file == "web/app.test.ts"
    assert not listed["src/models.py"].has_tests


def test_symbols(index):
    got = rows(index["symbols"].filter("path LIKE 'src/auth%' OR path LIKE 'web/app.ts'"), "name", "type", "line", "signature", "docstring")
    assert got == [
        ("App", "function", 5, "(approximate)", ""), ("Auth", "class", 15, "class Auth(Base)", ""), ("go", "function", 7, "(approximate)", ""),
        ("login", "function", 10, "def login(...)", "Log in."), ("out", "function", 13, "async def out(b: int=1) -> None", ""),
    ]


def test_imports(index):
    got = rows(index["imports"].filter("path IN ('src/auth.py', 'src/models.py', 'main.py', 'web/app.ts')"), "path", "kind", "import")
    assert got == [
        ("main.py", "external", "json"), ("main.py", "internal", "src"), ("main.py", "internal", "src.auth"),
        ("src/auth.py", "external", "datetime"), ("src/auth.py", "external", "jwt"), ("src/auth.py", "internal", "."), ("src/auth.py", "internal", ".models"), ("src/auth.py", "internal", "src/models.py"),
        ("src/models.py", "internal", "..src"), ("src/models.py", "internal", ".database"), ("src/models.py", "internal", "src/__init__.py"), ("src/models.py", "internal", "src/database.py"),
        ("web/app.ts", "external", "@scope"), ("web/app.ts", "external", "react"), ("web/app.ts", "internal", "./style.css"),
    ]


def test_edges_and_impact(index):
    assert rows(index["edges"], "src", "dst") == [
        ("main.py", "src/__init__.py"), ("main.py", "src/auth.py"), ("src/auth.py", "src/models.py"), ("src/models.py", "src/__init__.py"), ("src/models.py", "src/database.py"), ("tests/test_auth.py", "src/auth.py"),
    ]
    risk = {r.path: (r.dependents, r.affected_tests, r.risk) for r in index["change_impact"].collect()}
    assert risk["src/auth.py"] == (2, 1, "high") and risk["src/models.py"] == (1, 1, "medium") and risk["fits.txt"] == (0, 0, "low")


def test_folder_import_means_its_first_file(spark):
    files = spark.createDataFrame([("r", "pkg/b/z.py"), ("r", "pkg/b-a.py"), ("r", "pkg/b/a.py"), ("r", "pkg.py")], "repo_id STRING, path STRING")
    imports = spark.createDataFrame([("r", "m.py", "pkg.b", "internal"), ("r", "m.py", "os", "external")], "repo_id STRING, path STRING, import STRING, kind STRING")
    assert rows(C.resolve_imports(files, imports), "src", "dst") == [("m.py", "pkg/b/a.py")]


def test_write_index(spark, index, tmp_path):
    C.write_code_index({k: index[k] for k in ("files", "edges")}, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/edges")).count() == 6


def test_globs(spark):
    df = spark.createDataFrame([("docs/a/b.md",), ("doc.md",), ("a.txt",)], "p STRING")
    assert [r.p for r in df.filter(S.matches_glob(F.col("p"), ["docs/*", "?.tx[t]"])).collect()] == ["docs/a/b.md", "a.txt"]


ITEM = "project_id STRING, section STRING, seq LONG, label STRING, text STRING, detail STRING, priority STRING, done BOOLEAN"


def context(spark, *items):
    full = [("p", s, i, label, text, detail, priority, done) for i, (s, label, text, detail, priority, done) in enumerate(items)]
    return spark.createDataFrame(full, ITEM).withColumn("ord", ord_of(seq=F.col("seq")))


FULL = [
    ("goal", "", "Build it", "", "", False), ("tech_stack", "language", "Go", "", "", False), ("decision", "DB", "sqlite", "simple", "", False), ("decision", "UI", "web", "", "", False),
    ("task", "", "Ship", "", "high", False), ("task", "", "Test", "", "medium", True), ("constraint", "", "offline", "", "", False), ("non_goal", "", "mobile", "", "", False), ("open_question", "", "Who pays?", "", "", False),
]


def test_documents_read_back(spark):
    items = context(spark, *FULL)
    back = D.read_knowledge_base(R.render_documents(items))
    columns = ["section", "label", "text", "detail", "priority", "done"]
    assert rows(back, *columns) == rows(items, *columns)


def test_empty_context_gets_placeholders(spark):
    docs = {r.rel_path: r.body for r in R.render_documents(context(spark, ("goal", "", "", "", "", False))).collect()}
    assert docs["context/decisions.md"] == "_No decisions extracted yet._"
    assert docs["context/architecture.md"] == "## Tech stack\n\n_No tech stack detected — fill in manually._\n\n## System design\n\n_Document the major components here._"
    assert docs["work/spec.md"] == "## Goal\n\n_(see overview.md)_\n\n## Tech stack\n\n_TBD_\n\n## Tasks\n\n_TBD_"
    assert "using the chosen tech stack." in docs["context/overview.md"]
    assert docs["context/constraints.md"] == "_No constraints or non-goals recorded._"


def test_long_documents_read_back_whole(spark):
    section = F.element_at(F.array(*[F.lit(s) for s in ("constraint", "non_goal", "task", "open_question")]), (F.col("id") % 4 + 1).cast("int"))
    items = spark.range(120_000).select(
        F.lit("p").alias("project_id"), section.alias("section"), ord_of(seq=F.col("id")).alias("ord"), F.lit("").alias("label"),
        F.concat(F.lit("item "), F.col("id").cast("string")).alias("text"), F.lit("").alias("detail"), F.lit("medium").alias("priority"), F.lit(False).alias("done"),
    )
    lines = R.document_lines(items)
    for saved in (R.number_lines(lines), R.assemble_documents(lines)):
        back = D.read_knowledge_base(saved).filter("section <> 'goal'").select("section", "text")
        assert back.count() == 120_000 and back.exceptAll(items.select("section", "text")).isEmpty()
    assert R.assemble_documents(lines).count() == 8


def test_lines_and_bodies_read_alike(spark):
    bodies = {
        "context/overview.md": "## Goal\n## Goal\n\nsecond\n## Vision\nx",
        "context/decisions.md": "## ADR-001 — Use it\n\n**Context:**\n\nwhy\nso\n\n**Decision:**\n\nyes\n## Other\n## ADR-002 — Empty\n",
        "context/constraints.md": "- loose\n## Constraints\n- a\n- [ ] b\n## Else\n- no\n## Non-goals\n- c",
        "context/architecture.md": "- **Db**: one\n- **db**: two",
    }
    df = spark.createDataFrame([("p", k, v) for k, v in bodies.items()] + [("q", "context/overview.md", "text\n## Goal"), ("q", "context/risks.md", None)], "project_id STRING, rel_path STRING, body STRING")
    lines = df.select("project_id", "rel_path", F.posexplode(F.split("body", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    names = ["project_id", "section", "label", "text", "detail"]
    got = rows(D.read_knowledge_base(df), *names)
    assert got == rows(D.read_knowledge_base(lines), *names) == sorted([
        ("p", "goal", "", "", ""), ("p", "decision", "Use it", "yes\n## Other", "why\nso"), ("p", "decision", "Empty", "", ""), ("p", "constraint", "", "a", ""),
        ("p", "constraint", "", "b", ""), ("p", "non_goal", "", "c", ""), ("p", "tech_stack", "db", "two", ""),
    ])


def test_context_json(spark):
    got = json.loads(R.export_context_json(context(spark, *FULL)).first().body)
    assert got == {"goal": "Build it", "tech_stack": {"language": "Go"}, "constraints": ["offline"], "open_questions": ["Who pays?"], "tasks": [
        {"title": "Ship", "description": "", "priority": "high", "done": False}, {"title": "Test", "description": "", "priority": "medium", "done": True}]}
    empty = json.loads(R.export_context_json(context(spark, ("goal", "", 'say "x"', "", "", False))).first().body)
    assert empty == {"goal": 'say "x"', "tech_stack": {}, "tasks": [], "constraints": [], "open_questions": []}


def test_write_documents(spark, tmp_path):
    docs, target = R.render_documents(context(spark, *FULL)), str(tmp_path / "kb")
    assert D.write_documents(docs, target, dry_run=True).count() == 8 and not (tmp_path / "kb").exists()
    D.write_documents(docs, target)
    with pytest.raises(Exception, match="(?i)exists"):
        D.write_documents(docs, target)
    D.write_documents(docs, target, overwrite=True)
    assert spark.read.parquet(target).count() == 8


def test_plan_checklist(spark):
    df = spark.createDataFrame([("p", "# Plan\n- [ ] one\n  - [X]  two \n* [ ] no\n- [] no\n")], "project_id STRING, body STRING")
    assert rows(D.read_plan_checklist(df), "title", "done") == [("one", False), ("two", True)]


def test_backlog_defaults(spark):
    body = json.dumps({"tasks": [{"id": "task-001"}]})
    df = spark.createDataFrame([("p", "work/backlog.json", body)], "project_id STRING, rel_path STRING, body STRING")
    row = D.read_backlog(df).first()
    assert (row.id, row.title, row.phase, row.priority, row.done, row.tags, row.done_at) == ("task-001", "", "1", "medium", False, [], None)


def test_history_round_trip(spark, tmp_path):
    run = "run_id STRING, timestamp STRING, source STRING, conversation_title STRING, input_file STRING, output_dir STRING, artifacts ARRAY<STRING>, target STRING, use_llm BOOLEAN"
    path = str(tmp_path / "history")
    for i, folder in enumerate(["/out/a", "/out/ab", "/out/a/b"]):
        H.append_history(spark.createDataFrame([(f"h{i}", "t", "claude", "", "in", folder, ["x.md"], "all", False)], run).coalesce(1), path)
    runs = H.read_history(spark, path)
    assert [r.run_id for r in H.recent_history(runs, 2).collect()] == ["h2", "h1"]
    assert rows(H.history_under_path(runs, "/out/a"), "run_id") == [("h0",), ("h2",)]
    assert H.history_by_id(runs, "h1").first().output_dir == "/out/ab"


def test_transcript_tail(spark):
    turns = [("c", i, "user", f"message {i} " + "x" * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(turns, "conv_id STRING, seq INT, role STRING, content STRING")
    whole = "\n".join(f"USER: {t[3]}" for t in turns)
    for limit in (1, 17, 100, 5000):
        got = B.conversation_prompts(df, "<{conversation}>", limit=limit).first().prompt
        assert got == "<" + whole[-limit:] + ">"


def test_context_answers(spark):
    good = {"goal": "g", "tech_stack": {"language": "Go"}, "tasks": [{"title": "t"}], "decisions": [{"topic": "a"}]}
    df = spark.createDataFrame([("a", "```json\n" + json.dumps(good) + "\n```"), ("b", "sorry"), ("c", "[1]")], "conv_id STRING, text STRING")
    items, errors = B.parse_context_responses(df)
    assert rows(items, "section", "label", "text", "priority", "done") == [("decision", "a", "", "", False), ("goal", "", "g", "", False), ("task", "", "t", "medium", False), ("tech_stack", "language", "Go", "", False)]
    assert rows(errors, "conv_id") == [("b",), ("c",)]


def test_tree_listing_prunes_folders_and_links(spark, tmp_path):
    for name in ("r1/src/a.py", "r1/node_modules/x/b.py", "r1/.git/c", "r1/x.egg-info/d", "build/src/e.py", "r1/_p/__init__.py"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x = 1\n")
    (tmp_path / "r1/src/loop").symlink_to(tmp_path)
    (tmp_path / "r1/src/linked.py").symlink_to(tmp_path / "r1/src/a.py")
    (tmp_path / "r1/src/broken.py").symlink_to(tmp_path / "nothing")
    (tmp_path / "r1/empty").mkdir()
    listed = S.list_tree(spark, str(tmp_path), repo_depth=1, excluded=EXCLUDED_DIRS)
    found = {(r.repo_id, r.path) for r in listed.collect()}
    assert found == {("r1", "src/a.py"), ("r1", "src/linked.py"), ("build", "src/e.py"), ("r1", "_p/__init__.py")}
    assert {r.path for r in S.list_tree(spark, str(tmp_path), excluded=EXCLUDED_DIRS).collect()} == {"r1/src/a.py", "r1/src/linked.py", "r1/_p/__init__.py"}
    assert S.list_tree(spark, str(tmp_path / "r1/empty")).count() == 0
    assert S.list_tree(spark, str(tmp_path)).count() == 7
    assert {bytes(r.content) for r in S.read_tree(spark, str(tmp_path), 1, EXCLUDED_DIRS).collect()} == {b"x = 1\n"}


def test_history_batches_are_read_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    run = "run_id STRING, timestamp STRING, source STRING, conversation_title STRING, input_file STRING, output_dir STRING, artifacts ARRAY<STRING>, target STRING, use_llm BOOLEAN"

    def runs(*ids, source="claude"):
        return spark.createDataFrame([(i, "t", source, "", "in", "/out", ["x.md"], "all", False) for i in ids], run)

    def seen():
        return sorted((r.run_id, r.source) for r in H.read_batches(spark, folder).collect())

    H.append_batch(runs("h1", "h2"), folder, "one/1 %")
    H.append_batch(runs("h1", "h2", source="again"), folder, "one/1 %")
    assert seen() == [("h1", "claude"), ("h2", "claude")]
    H.write_attempt(runs("lost"), folder, "two")
    assert len(seen()) == 2
    for attempt in [H.write_attempt(runs("h3", "h4"), folder, "two") for _ in range(2)]:  # two jobs at once
        H.commit_attempt(spark, folder, "two", attempt)
    H.append_batch(runs("h2", "h5", source="later"), folder, "two-b")
    assert seen() == [("h1", "claude"), ("h2", "claude"), ("h3", "claude"), ("h4", "claude"), ("h5", "later")]


def test_files_of_one_small_table_use_all_cores(spark, tmp_path):
    from threadloom.plans import code

    spark.range(50).selectExpr("id AS p_partkey", "'green' AS p_name", "CAST(id AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert code.sources(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_symbols_parse_each_file_once(spark, tmp_path):
    from threadloom.operators import code_index
    from threadloom.plans import code

    spark.range(50).selectExpr("id AS p_partkey", "'green' AS p_name", "CAST(id AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    symbols = code_index.symbols_of(code.structure(spark, str(tmp_path)).filter("language = 'python'"))
    # one for the parts and one for their tests; a filter on the array below the shuffle added one to each
    assert symbols._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2


def test_history_lines_and_answers_of_one_small_table_use_all_cores(spark, tmp_path):
    from threadloom.plans import contexts, documents

    events = "id AS event_id, id % 3 AS user_id, timestamp'2024-01-01' AS ts, 'view' AS event_type"
    spark.range(50).selectExpr(*events.replace("timestamp'2024-01-01' AS ts", "timestamp_seconds(id) AS ts").split(", ")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(50).selectExpr("id AS c_custkey", "'name' AS c_name", "'segment' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert contexts.history_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= cores
    assert documents.body_answers(spark, str(tmp_path)).rdd.getNumPartitions() >= cores


def test_lines_are_numbered_once_and_items_only_where_shown(spark):
    items, brief = context(spark, *FULL), (R.Listed("brief.md", 1, "task", "checkbox"), R.Listed("brief.md", 2, "constraint", "bullet"))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    lines = R.document_lines(items, brief)
    assert "row_number" not in plan(lines)
    assert [r.line for r in lines.orderBy("place", "ord", "pos").collect()] == ["- [ ] Ship *(high priority)*", "- [x] Test", "- offline"]
    assert "row_number" not in plan(D.read_knowledge_base(R.number_lines(R.document_lines(items))))


def test_imports_are_sought_in_statements_alone(monkeypatch):
    import ast

    source = (
        "import a\nx = [f(lambda: 1, *(y if y else z for y in q))]\ndef g():\n    import b\n    class K:\n        from .c import d\n"
        "try:\n    import e\nexcept ValueError:\n    import h\nelse:\n    import i\nfinally:\n    import j\nif x: import k\nelif y:\n    import l\nelse:\n    import m\n"
        "match x:\n    case 1:\n        import n\nwhile x:\n    import o\nelse:\n    import p\nwith x as y: import q\nasync def r():\n    async for s in t:\n        import u\ntry:\n    import v\nexcept* TypeError:\n    import w\n"
    )
    asked, judge = [], C._imports
    want = [i for node in ast.walk(ast.parse(source)) for i in judge(node)]
    monkeypatch.setattr(C, "_imports", lambda node: asked.append(node) or judge(node))
    assert C._parse_python(source)["imports"] == want and len(want) == 17
    assert not any(isinstance(node, (ast.expr, ast.arguments)) for node in asked)


def test_contents_are_built_after_the_deal_and_kept_in_columns(spark, tmp_path):
    from threadloom.plans import code

    spark.range(200).selectExpr("id AS p_partkey", "'green' AS p_name", "CAST(id AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = code.sources(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "Filter" not in plan.partition("Repartition")[2]
    found = code.index(spark, str(tmp_path))
    assert "symbols" not in found.listed._jdf.queryExecution().executedPlan().toString()


def test_tests_and_imports_are_settled_without_sorting_texts(spark, index):
    tests = C.map_test_files(index.listed, index.listed.select("repo_id", "path"))
    assert rows(tests, "path", "test_file") == [("src/auth.py", "tests/test_auth.py"), ("web/app.ts", "web/app.test.ts")]
    for frame in (tests, C.classify_imports(index.structure, index.listed)):
        assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_imports_meet_files_in_one_join(spark):
    files = spark.createDataFrame([("r", "pkg/A.py"), ("r", "pkg/__init__.py"), ("r", "pkg/sub/b.py"), ("r", "m.py")], "repo_id STRING, path STRING")
    imports = spark.createDataFrame(
        [("r", "m.py", i, "internal") for i in ("pkg", "pkg.sub", "pkg.A", ".m", "pkg.gone", "pkg")], "repo_id STRING, path STRING, import STRING, kind STRING"
    )
    edges = C.resolve_imports(files, imports)
    assert rows(edges, "src", "dst") == [("m.py", "pkg/A.py"), ("m.py", "pkg/__init__.py"), ("m.py", "pkg/sub/b.py")]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_plain_signatures_are_written_without_unparse(monkeypatch):
    import ast

    plain = "class A(Base, other.Kind): pass\ndef f(a, b: x.y) -> z: pass\nasync def g(): pass\n"
    odd = "class B(f(1), (1).real, *c, metaclass=m): pass\ndef h(a, b: 'x\\ny', c: (1, 2), d: (q := 1)) -> a[1:2]: pass\ndef i(a, /, b=1, *c, d, **e): pass\ndef j[T](a: T): pass\n"
    got = [s["signature"] for s in C._parse_python(plain + odd)["symbols"]]
    assert got == [
        "class A(Base, other.Kind)", "def f(a, b: x.y) -> z", "async def g()", "class B(f(1), 1 .real, *c)",
        "def h(a, b: 'x\\ny', c: (1, 2), d: (q := 1)) -> a[1:2]", "def i(a, /, b=1, *c, d, **e)", "def j[T](a: T)",
    ]
    monkeypatch.setattr(ast, "unparse", lambda node: 1 / 0)
    assert [s["signature"] for s in C._parse_python(plain)["symbols"]] == got[:3]
