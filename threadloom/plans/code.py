"""Source-tree index over trees that part describes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.shuffles import cut_lineage
from threadloom.functions.storage import materialise
from threadloom.operators import code_index as C
from threadloom.plans.registry import query, run_folder, table, texts
from threadloom.sources import trees as S

# Part k belongs to repository k / 100. It is a package file, a module, a script, or one of the files
# that indexing leaves out, and imports two other parts of its repository.
_PY = '''"""{name} tools.

Size {size}."""
import os, pkg{t5}.m{t}
from .m{u} import thing
from json import loads

@cached
def make{k}(a, b: int = 1, *rest) -> str:
    """Makes it."""
    return a
async def wait{k}(x):
    pass
class Box{k}(Base, other.Kind):
    def inner(self): pass
'''
_TS = '''import x from "./c{t}";
import "react/dom";
import {{ y }} from 'react';

export default async function run{k}() {{}}
export const limit{k} = 1;
export const limit{k} = 2;
'''


def _fill(template: str):
    k = F.col("k")
    base = F.floor(k / 100) * 100
    t, u = base + (k * 7 + 3) % 100, base + (k % 100 + 5) % 100
    values = {"{name}": F.col("p_name"), "{size}": F.col("p_size"), "{k}": k, "{t5}": t % 5, "{t}": t, "{u}": u}
    pieces = re.split("(" + "|".join(map(re.escape, values)) + ")", template.replace("{{", "{").replace("}}", "}"))
    return F.concat(*[values[p].cast("string") if p in values else F.lit(p) for p in pieces])


def tree(spark, sf_dir) -> DataFrame:
    """Files of every kind as (repo_id, path, content).

    Parts are written once they are dealt to all cores: otherwise filters on contents go below the deal, and build all files there.
    """
    parts = materialise(texts(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")).withColumn("k", F.col("p_partkey"))
    k = F.col("k")
    kind = (
        F.when(k % 100 < 5, "init").when(k % 50 == 7, "excl").when(k % 50 == 8, "long").when(k % 50 == 9, "bad").when(k % 50 == 15, "bin").when(k % 50 == 16, "doc")
        .when((k % 50 >= 10) & (k % 50 <= 14), "ts").otherwise("py")
    )
    rows = parts.withColumn("kind", kind)
    folder = F.concat(F.lit("pkg"), k % 5, F.lit("/"))
    name = F.concat(F.lit("m"), k, F.lit(".py"))
    path = (
        F.when(kind == "init", F.concat(folder, F.lit("__init__.py"))).when(kind == "excl", F.concat(F.lit("node_modules/"), name))
        .when(kind == "ts", F.concat(F.lit("web/c"), k, F.lit(".ts"))).when(kind == "bin", F.concat(folder, F.lit("b"), k, F.lit(".dat")))
        .when(kind == "doc", F.concat(F.lit("docs/d"), k, F.lit(".txt"))).otherwise(F.concat(folder, name))
    )
    content = (
        F.when(kind == "long", F.concat(_fill(_PY), F.repeat(F.lit("\n"), F.lit(500)))).when(kind == "bad", F.lit("def ("))
        .when(kind == "ts", _fill(_TS)).when(kind == "bin", F.concat(F.lit("a"), F.decode(F.lit(b"\x00"), "UTF-8"))).when(kind == "doc", F.lit("a\nb")).otherwise(_fill(_PY))
    )
    repo = F.concat(F.lit("r"), F.floor(k / 100))
    files = rows.select(repo.alias("repo_id"), path.alias("path"), content.alias("content"))
    tests = rows.filter((k % 10 == 0) & (F.col("kind") == "py")).select(
        repo.alias("repo_id"), F.concat(F.lit("tests/test_m"), k, F.lit(".py")).alias("path"), F.concat(F.lit("import pkg"), k % 5, F.lit(".m"), k, F.lit("\n")).alias("content")
    )
    return files.unionByName(tests).withColumn("content", F.encode("content", "UTF-8"))


_T = (
    "kinds AS (SELECT *, p_partkey AS k, 'r' || (p_partkey // 100) AS repo_id, CASE WHEN p_partkey % 100 < 5 THEN 'init' WHEN p_partkey % 50 = 7 THEN 'excl' WHEN p_partkey % 50 = 8 THEN 'long' "
    "WHEN p_partkey % 50 = 9 THEN 'bad' WHEN p_partkey % 50 = 15 THEN 'bin' WHEN p_partkey % 50 = 16 THEN 'doc' WHEN p_partkey % 50 BETWEEN 10 AND 14 THEN 'ts' ELSE 'py' END AS kind FROM part), "
    "placed AS (SELECT *, CASE kind WHEN 'init' THEN 'pkg' || (k % 5) || '/__init__.py' WHEN 'excl' THEN 'node_modules/m' || k || '.py' WHEN 'ts' THEN 'web/c' || k || '.ts' "
    "WHEN 'bin' THEN 'pkg' || (k % 5) || '/b' || k || '.dat' WHEN 'doc' THEN 'docs/d' || k || '.txt' ELSE 'pkg' || (k % 5) || '/m' || k || '.py' END AS path, "
    "(k // 100) * 100 + (k * 7 + 3) % 100 AS t, (k // 100) * 100 + (k % 100 + 5) % 100 AS u FROM kinds), "
    "tests AS (SELECT *, 'tests/test_m' || k || '.py' AS tpath FROM placed WHERE kind = 'py' AND k % 10 = 0), "
    "files AS (SELECT repo_id, path, kind, k, CASE kind WHEN 'bad' THEN 1 WHEN 'doc' THEN 2 WHEN 'ts' THEN 8 ELSE 16 END AS line_count FROM placed WHERE kind NOT IN ('excl', 'long', 'bin') "
    "UNION ALL SELECT repo_id, tpath, 'test', k, 2 FROM tests)"
)


def sources(spark, sf_dir) -> DataFrame:
    return S.source_files(tree(spark, sf_dir))


def structure(spark, sf_dir) -> DataFrame:
    return C.file_structure(sources(spark, sf_dir))


def all_paths(spark, sf_dir) -> DataFrame:
    return tree(spark, sf_dir).select("repo_id", "path")


@query("p9_source_file_exclusions", f"WITH {_T} SELECT repo_id, path, CAST(line_count AS BIGINT) AS line_count FROM files WHERE NOT (path LIKE 'docs/%')")
def _(spark, sf_dir):
    kept = S.source_files(tree(spark, sf_dir), ["docs/*", "no[x-z]e?.py"])
    return kept.select("repo_id", "path", F.col("line_count").cast("bigint").alias("line_count"))


@query("c5_indexer_routing", (
    f"WITH {_T} SELECT repo_id, path, CASE WHEN kind = 'ts' THEN 'script' WHEN kind = 'doc' THEN 'generic' ELSE 'python' END AS language FROM files"
))
def _(spark, sf_dir):
    return sources(spark, sf_dir).select("repo_id", "path", C.language(F.col("path")).alias("language"))


_SYMBOLS = (
    "sym AS (SELECT f.repo_id, f.path, s.ord, s.name || f.k AS name, s.type, s.line, replace(s.signature, '#', CAST(f.k AS VARCHAR)) AS signature, s.docstring FROM files f, (VALUES "
    "(0, 'make', 'function', 9, 'def make#(...)', 'Makes it.'), (1, 'wait', 'function', 12, 'async def wait#(x)', ''), (2, 'Box', 'class', 14, 'class Box#(Base, other.Kind)', '')) s(ord, name, type, line, signature, docstring) "
    "WHERE kind IN ('py', 'init')), "
    "exported AS (SELECT f.repo_id, f.path, s.ord, s.name || f.k AS name, 'function' AS type, s.line, '(approximate)' AS signature, '' AS docstring FROM files f, (VALUES (0, 'run', 5), (1, 'limit', 6)) s(ord, name, line) WHERE kind = 'ts')"
)


@query("c1_python_files", (
    f"WITH {_T} SELECT f.repo_id, f.path, CASE kind WHEN 'bad' THEN '(parse error)' WHEN 'test' THEN '' ELSE p_name || ' tools.' END AS purpose FROM files f JOIN part ON p_partkey = k WHERE kind NOT IN ('ts', 'doc')"
))
def _(spark, sf_dir):
    return structure(spark, sf_dir).filter("language = 'python'").select("repo_id", "path", "purpose")


@query("c1_python_symbols", f"WITH {_T}, {_SYMBOLS} SELECT repo_id, path, CAST(ord AS BIGINT) AS ord, name, type, CAST(line AS BIGINT) AS line, signature, docstring FROM sym")
def _(spark, sf_dir):
    rows = C.symbols_of(structure(spark, sf_dir).filter("language = 'python'"))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("ord", "line")})


def _notes(files: DataFrame) -> DataFrame:
    """An indexer of plain notes: every line of one word is a heading."""
    text = F.when(F.col("language") == "notes", F.col("text"))
    heads = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.struct(line.alias("name"), F.lit("heading").alias("type"), (i + 1).alias("line"), F.lit("").alias("signature"), F.lit("").alias("docstring"))), lambda h: h["name"].rlike(r"^\w+$"))
    nothing = F.array().cast("array<struct<kind:string,name:string,level:int>>")
    built = F.struct(F.concat(F.lit("Notes of "), F.size(heads), F.lit(" headings")).alias("purpose"), heads.alias("symbols"), nothing.alias("imports"))
    return files.withColumn("_notes", F.when(text.isNotNull(), built))


@query("e3_custom_indexer", (
    f"WITH {_T} SELECT repo_id, path, CASE kind WHEN 'doc' THEN 'notes' WHEN 'ts' THEN 'generic' ELSE 'python' END AS language, "
    "CASE kind WHEN 'doc' THEN 'Notes of 2 headings' WHEN 'bad' THEN '(parse error)' WHEN 'test' THEN '' WHEN 'ts' THEN '' ELSE p_name || ' tools.' END AS purpose, "
    "CASE kind WHEN 'doc' THEN 'a:1 b:2' END AS headings FROM files f JOIN part ON p_partkey = k"
))
def _(spark, sf_dir):
    """A third indexer beside the two given ones, and extensions of the caller's own."""
    rows = C.file_structure(S.source_files(tree(spark, sf_dir)), C.INDEXERS | {"notes": _notes}, {".py": "python", ".txt": "notes"})
    heads = F.transform(F.filter("symbols", lambda s: s["type"] == "heading"), lambda s: F.concat_ws(":", s["name"], s["line"]))
    return rows.select("repo_id", "path", "language", "purpose", F.when(F.size(heads) > 0, F.array_join(heads, " ")).alias("headings"))


@query("c2_ts_exports", f"WITH {_T}, {_SYMBOLS} SELECT repo_id, path, CAST(ord AS BIGINT) AS ord, name, CAST(line AS BIGINT) AS line, signature FROM exported")
def _(spark, sf_dir):
    rows = C.symbols_of(structure(spark, sf_dir).filter("language = 'script'")).select("repo_id", "path", "ord", "name", "line", "signature")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("ord", "line")})


_SCRIPT_IMPORTS = (
    "SELECT f.repo_id, f.path, 'internal' AS kind, './c' || t AS import FROM files f JOIN placed p USING (k) WHERE f.kind = 'ts' UNION ALL SELECT repo_id, path, 'external', 'react' FROM files WHERE kind = 'ts'"
)


@query("c3_ts_imports", f"WITH {_T} {_SCRIPT_IMPORTS}")
def _(spark, sf_dir):
    own = cut_lineage(structure(spark, sf_dir).filter("language = 'script'"))
    return C.classify_imports(own, all_paths(spark, sf_dir)).select("repo_id", "path", "kind", "import")


@query("c3_page_links", (
    "SELECT page_id, link, CASE WHEN starts_with(link, '.') OR starts_with(link, '/') THEN 'internal' ELSE 'external' END AS kind, count(*) AS n FROM "
    "(SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1, 2"
))
def _(spark, sf_dir):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    rows = table(spark, sf_dir, "pages").select("page_id", links.alias("link"))
    return rows.groupBy("page_id", "link", C.import_kind(F.col("link")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("c4_generic_files", f"WITH {_T} SELECT repo_id, path, CAST(line_count AS BIGINT) AS line_count FROM files WHERE kind = 'doc'")
def _(spark, sf_dir):
    return structure(spark, sf_dir).filter("language = 'generic'").select("repo_id", "path", F.col("line_count").cast("bigint").alias("line_count"))


_IMPORTS = (
    "ondisk AS (SELECT repo_id, k, path FROM placed WHERE kind IN ('py', 'bad', 'long')), "
    "own AS (SELECT f.repo_id, f.path, f.k, f.kind, p.t, p.u FROM files f JOIN placed p USING (k) WHERE f.kind IN ('py', 'init')), "
    "imports AS (SELECT repo_id, path, 'external' AS kind, 'os' AS import FROM own UNION ALL SELECT repo_id, path, 'external', 'json' FROM own UNION ALL "
    "SELECT repo_id, path, 'internal', 'pkg' || (t % 5) || '.m' || t FROM own UNION ALL SELECT repo_id, path, 'internal', '.m' || u FROM own UNION ALL "
    "SELECT o.repo_id, o.path, 'internal', d.path FROM own o JOIN ondisk d ON d.k = o.u UNION ALL SELECT repo_id, path, 'internal', 'pkg' || (k % 5) || '.m' || k FROM files WHERE kind = 'test')"
)


@query("j3_classify_imports", f"WITH {_T}, {_IMPORTS} SELECT * FROM imports UNION ALL {_SCRIPT_IMPORTS}")
def _(spark, sf_dir):
    parsed = cut_lineage(structure(spark, sf_dir))
    return C.classify_imports(parsed, all_paths(spark, sf_dir)).select("repo_id", "path", "kind", "import")


@query("j4_map_test_files", f"WITH {_T} SELECT repo_id, path, tpath AS test_file FROM tests")
def _(spark, sf_dir):
    return C.map_test_files(sources(spark, sf_dir), all_paths(spark, sf_dir))


_EDGES = (
    "edges AS (SELECT DISTINCT o.repo_id, o.path AS src, f.path AS dst FROM own o JOIN files f ON f.k IN (o.t, o.u) AND f.kind IN ('py', 'bad') WHERE o.path <> f.path "
    "UNION SELECT f.repo_id, f.path, g.path FROM files f JOIN files g ON g.k = f.k AND g.kind = 'py' WHERE f.kind = 'test'), "
    "tested AS (SELECT repo_id, path, tpath AS test_file FROM tests), "
    "related AS (SELECT repo_id, dst AS path, 'dependent' AS kind, src AS other FROM edges UNION SELECT e.repo_id, e.dst, 'test', t.test_file FROM edges e JOIN tested t ON t.repo_id = e.repo_id AND t.path = e.src "
    "UNION SELECT repo_id, path, 'test', test_file FROM tested), "
    "impact AS (SELECT f.repo_id, f.path, count(r.path) FILTER (r.kind = 'dependent') AS dependents, count(r.path) FILTER (r.kind = 'test') AS affected_tests FROM files f LEFT JOIN related r ON r.repo_id = f.repo_id AND r.path = f.path GROUP BY 1, 2), "
    "risks AS (SELECT *, CASE WHEN dependents >= 2 THEN 'high' WHEN dependents = 1 THEN 'medium' ELSE 'low' END AS risk FROM impact), "
    "stats AS (SELECT f.repo_id, count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines, count(test_file) AS tested_files, CAST(round_even(100.0 * count(test_file) / count(*), 0) AS BIGINT) AS coverage_pct "
    "FROM files f LEFT JOIN tested t ON t.repo_id = f.repo_id AND t.path = f.path GROUP BY 1)"
)
_ALL = f"WITH {_T}, {_SYMBOLS}, {_IMPORTS}, {_EDGES}"


def index(spark, sf_dir) -> C.RepositoryIndex:
    return C.index_repository(tree(spark, sf_dir))


@query("j2_resolve_imports", f"{_ALL} SELECT * FROM edges")
def _(spark, sf_dir):
    return index(spark, sf_dir)["edges"]


@query("c6_dependency_graph", (
    f"{_ALL} SELECT repo_id, path, (SELECT count(*) FROM edges e WHERE e.repo_id = f.repo_id AND e.src = f.path) AS depends_on, "
    "(SELECT count(*) FROM edges e WHERE e.repo_id = f.repo_id AND e.dst = f.path) AS depended_on_by FROM files f"
))
def _(spark, sf_dir):
    return index(spark, sf_dir)["nodes"]


@query("j11_dependents_tests", f"{_ALL} SELECT * FROM related")
def _(spark, sf_dir):
    return index(spark, sf_dir)["impact_edges"]


@query("c7_change_impact", f"{_ALL} SELECT * FROM risks")
def _(spark, sf_dir):
    return index(spark, sf_dir)["change_impact"]


@query("a9_repo_stats", f"{_ALL} SELECT * FROM stats")
def _(spark, sf_dir):
    return index(spark, sf_dir)["stats"]


@query("t8_key_exports", f"{_ALL} SELECT repo_id, path, string_agg(name, ', ' ORDER BY ord) AS key_exports FROM (SELECT * FROM sym UNION ALL SELECT * FROM exported) WHERE ord < 3 GROUP BY 1, 2")
def _(spark, sf_dir):
    return C.key_exports(index(spark, sf_dir)["symbols"])


_REPORT = (
    "ke AS (SELECT repo_id, path, string_agg(name, ', ' ORDER BY ord) AS x FROM (SELECT * FROM sym UNION ALL SELECT * FROM exported) WHERE ord < 3 GROUP BY 1, 2), "
    "pu AS (SELECT f.*, CASE kind WHEN 'bad' THEN '(parse error)' WHEN 'py' THEN p_name || ' tools.' WHEN 'init' THEN p_name || ' tools.' ELSE '' END AS purpose FROM files f JOIN part ON p_partkey = k) "
    ", report AS (SELECT f.repo_id, 1 AS section_ord, f.path, '| ' || CASE WHEN purpose = '' THEN f.path ELSE purpose END || ' | `' || f.path || '` | ' || coalesce(x, '') || ' |' AS line FROM pu f LEFT JOIN ke ON ke.repo_id = f.repo_id AND ke.path = f.path WHERE purpose <> '' OR x IS NOT NULL "
    "UNION ALL SELECT repo_id, 2, path, '- `' || path || '`' FROM files f ANTI JOIN tested t ON t.repo_id = f.repo_id AND t.path = f.path "
    "UNION ALL SELECT repo_id, 3, path, '- `' || path || '` — ' || dependents || ' files depend on it' FROM risks WHERE risk = 'high' "
    "UNION ALL SELECT repo_id, 4, '', '- ' || total_files || ' source files | ' || tested_files || ' tested | ' || total_lines || ' total lines' FROM stats "
    "UNION ALL SELECT repo_id, 4, '', '- Test coverage: ' || coverage_pct || '% of source files have a test file' FROM stats)"
)


@query("c8_index_report", f"{_ALL}, {_REPORT} SELECT * FROM report")
def _(spark, sf_dir):
    return index(spark, sf_dir)["report"]


# One line of text for each row of every table.
_ROWS = {
    "files": ("path", "line_count", "test_file"), "symbols": ("path", "ord", "name", "type", "line", "signature"), "imports": ("path", "kind", "import"), "edges": ("src", "dst"),
    "nodes": ("path", "depends_on", "depended_on_by"), "impact_edges": ("path", "kind", "other"), "change_impact": ("path", "dependents", "affected_tests", "risk"),
    "stats": ("total_files", "total_lines", "tested_files", "coverage_pct"), "report": ("section_ord", "path", "line"),
}
_WRITTEN = {
    "files": "(SELECT f.repo_id, f.path, line_count, test_file FROM files f LEFT JOIN tested t ON t.repo_id = f.repo_id AND t.path = f.path)",
    "symbols": "(SELECT * FROM sym UNION ALL SELECT * FROM exported)", "imports": f"(SELECT * FROM imports UNION ALL {_SCRIPT_IMPORTS})", "edges": "edges",
    "nodes": "(SELECT repo_id, path, (SELECT count(*) FROM edges e WHERE e.repo_id = f.repo_id AND e.src = f.path) AS depends_on, "
    "(SELECT count(*) FROM edges e WHERE e.repo_id = f.repo_id AND e.dst = f.path) AS depended_on_by FROM files f)",
    "impact_edges": "related", "change_impact": "risks", "stats": "stats", "report": "report",
}


@query("s18_write_code_index", f"{_ALL}, {_REPORT} " + " UNION ALL ".join(
    f"SELECT '{name}' AS part, repo_id, concat_ws('|', {', '.join(columns)}) AS row FROM {_WRITTEN[name]}" for name, columns in _ROWS.items()
))
def _(spark, sf_dir):
    """All nine tables written in buckets of repositories and read back."""
    folder = f"{run_folder(spark)}/index"
    C.write_code_index(index(spark, sf_dir), folder)
    parts = [spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("part"), "repo_id", F.concat_ws("|", *columns).alias("row")) for name, columns in _ROWS.items()]
    return reduce(DataFrame.unionByName, parts)



@query("c9_index_repository", (
    f"{_ALL} SELECT f.repo_id, f.path, CAST(line_count AS BIGINT) AS line_count, test_file, test_file IS NOT NULL AS has_tests FROM files f LEFT JOIN tested t ON t.repo_id = f.repo_id AND t.path = f.path"
))
def _(spark, sf_dir):
    return index(spark, sf_dir)["files"].select("repo_id", "path", F.col("line_count").cast("bigint").alias("line_count"), "test_file", "has_tests")


@query("f11_line_count", "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).cast("bigint").alias("line_count"))


@query("f13_risk_level", "SELECT o_custkey, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS risk FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(T.risk_level(F.count(F.lit(1))).alias("risk"))
