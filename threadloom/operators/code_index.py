"""Index of source trees: symbols, imports, tests, dependencies and the impact of a change.

``files`` is (repo_id, path, content, line_count). The dependency graph is the table
``edges(repo_id, src, dst)``; read forwards it is what a file needs, backwards what needs it. A file
that half a repository depends on is just many edges, never one long array.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.shuffles import cut_lineage, lookup_join
from threadloom.functions.storage import materialise
from threadloom.lexicons import PYTHON_EXTENSIONS, SCRIPT_EXPORT, SCRIPT_EXTENSIONS, SCRIPT_IMPORT
from threadloom.sources.trees import MAX_LINES, indexable_paths, list_tree, read_contents, source_files

MAX_SIGNATURE = 200
PARSE_ERROR = "(parse error)"
READ_ERROR = "(read error)"

_SYMBOL = "STRUCT<name: STRING, type: STRING, line: INT, signature: STRING, docstring: STRING>"
_IMPORT = "STRUCT<kind: STRING, name: STRING, level: INT>"
_STRUCTURE = f"purpose: STRING, symbols: ARRAY<{_SYMBOL}>, imports: ARRAY<{_IMPORT}>"


def extension(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"[^.](\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=[^.])\.[^.]+$", "")


def parent(path: Column) -> Column:
    """Folder with its slash, empty at the root."""
    return F.regexp_extract(path, "^(.*/)", 1)


EXTENSIONS = {e: "python" for e in PYTHON_EXTENSIONS} | {e: "script" for e in SCRIPT_EXTENSIONS}


def language(path: Column, extensions: Mapping[str, str] = EXTENSIONS) -> Column:
    """Indexer of a file by its extension."""
    return F.coalesce(*[F.when(extension(path) == e, F.lit(name)) for e, name in extensions.items()], F.lit("generic"))


# ---- Python files --------------------------------------------------------------------------------


def _expression(node: ast.AST) -> str:
    """Source of an expression; ``ast.unparse`` costs far more than a name is worth."""
    names = []
    at = node
    while isinstance(at, ast.Attribute):
        names.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(names)]) if isinstance(at, ast.Name) else ast.unparse(node)


def _argument(node: ast.arg) -> str:
    return f"{node.arg}: {_expression(node.annotation)}" if node.annotation else node.arg


def _signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(map(_expression, node.bases))
        return f"class {node.name}({bases})" if bases else f"class {node.name}"
    if node.decorator_list:  # the decorator would come first, so the arguments are left out
        awaited = "async " if isinstance(node, ast.AsyncFunctionDef) else ""
        return f"{awaited}def {node.name}(...)"
    given = node.args
    if given.posonlyargs or given.vararg or given.kwonlyargs or given.kwarg or given.defaults or getattr(node, "type_params", ()):
        node.body = [ast.Pass()]
        source = ast.unparse(node)
    else:
        awaited = "async " if isinstance(node, ast.AsyncFunctionDef) else ""
        returned = f" -> {_expression(node.returns)}" if node.returns else ""
        source = f"{awaited}def {node.name}({', '.join(map(_argument, given.args))}){returned}:"
    return source.split("\n", 1)[0].removesuffix(":").rstrip()


def _symbol(node: ast.AST) -> dict:
    doc = ast.get_docstring(node) or ""
    kind = "class" if isinstance(node, ast.ClassDef) else "function"
    return {"name": node.name, "type": kind, "line": node.lineno, "signature": _signature(node)[:MAX_SIGNATURE], "docstring": doc}


def _imports(node: ast.AST) -> list[dict]:
    if isinstance(node, ast.Import):
        return [{"kind": "absolute", "name": alias.name, "level": 0} for alias in node.names]
    if isinstance(node, ast.ImportFrom):
        kind = "relative" if node.level else "absolute"
        return [{"kind": kind, "name": node.module or "", "level": node.level}] if node.level or node.module else []
    return []


_BLOCKS = {
    kind: parts for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, (ast.mod, ast.stmt, ast.excepthandler, ast.match_case))
    if (parts := [f for f in kind._fields if f in ("body", "handlers", "orelse", "finalbody", "cases")])
}


def _statements(tree: ast.Module) -> Iterator[ast.AST]:
    """Statements of a module in the order of ``ast.walk``; expressions, most of its nodes, hold none."""
    level = [tree]
    while level:
        level = [s for node in level for part in _BLOCKS.get(type(node), ()) for s in getattr(node, part)]
        yield from level


def _parse_python(source: str | None) -> dict | None:
    """Structure of one module; the standard parser is the only per-row Python in the library."""
    if source is None:
        return None
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"purpose": PARSE_ERROR, "symbols": [], "imports": []}
    doc = (line.strip() for line in (ast.get_docstring(tree) or "").splitlines())
    imports = [i for node in _statements(tree) for i in _imports(node)]
    top = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return {"purpose": next(filter(None, doc), ""), "symbols": [_symbol(n) for n in top], "imports": imports}


def _python_structure(files: DataFrame) -> DataFrame:
    parse = F.udf(_parse_python, _STRUCTURE, useArrow=True)
    return files.withColumn("_python", parse(F.when(F.col("language") == "python", F.col("text"))))


# ---- script files --------------------------------------------------------------------------------


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def import_kind(module: Column) -> Column:
    return F.when(module.startswith(".") | module.startswith("/"), "internal").otherwise("external")


def _script_structure(files: DataFrame) -> DataFrame:
    """TypeScript and JavaScript: exported names, each once with the line of its match, and imports,
    each once, external ones by package."""
    text = F.when(F.col("language") == "script", F.col("text"))
    # columns of their own, so that no element of the arrays below runs a pattern again
    cut = files.withColumns({
        "_between": F.split(text, SCRIPT_EXPORT),
        "_whole": F.regexp_extract_all(text, F.lit(SCRIPT_EXPORT), F.lit(0)),
        "_names": F.regexp_extract_all(text, F.lit(SCRIPT_EXPORT), F.lit(1)),
        "_modules": F.regexp_extract_all(text, F.lit(SCRIPT_IMPORT), F.lit(1)),
    })

    def lines(texts: str, upto: Column) -> Column:
        return F.aggregate(F.slice(texts, F.lit(1), upto), F.lit(0), lambda n, t: n + _newlines(t))

    def symbol(name: Column, i: Column) -> Column:
        return F.struct(
            name.alias("name"), F.lit("function").alias("type"), (lines("_between", i + 1) + lines("_whole", i) + 1).alias("line"),
            F.lit("(approximate)").alias("signature"), F.lit("").alias("docstring"),
        )

    symbols = F.transform("_names", symbol)
    first = F.filter(symbols, lambda s, i: F.array_position("_names", s["name"]) == i + 1)
    # a kept name tells its kind: only internal ones start with a dot or a slash
    named = F.transform("_modules", lambda m: F.when(import_kind(m) == "internal", m).otherwise(F.split_part(m, F.lit("/"), F.lit(1))))
    imports = F.transform(F.array_distinct(named), lambda m: F.struct(import_kind(m).alias("kind"), m.alias("name"), F.lit(0).alias("level")))
    built = F.struct(F.lit("").alias("purpose"), first.alias("symbols"), imports.alias("imports"))
    return cut.withColumn("_script", F.when(text.isNotNull(), built)).drop("_between", "_whole", "_names", "_modules")


# Indexers by language: each adds its structure column, named after the language with an underscore before
# it, null for files of other languages. Pass one more, and its extensions, to index another; files of no
# indexer keep their line count only.
Indexer = Callable[[DataFrame], DataFrame]
INDEXERS: dict[str, Indexer] = {"python": _python_structure, "script": _script_structure}


def file_structure(files: DataFrame, indexers: Mapping[str, Indexer] = INDEXERS, extensions: Mapping[str, str] = EXTENSIONS) -> DataFrame:
    """(repo_id, path, line_count, language, purpose, symbols, imports) of all files, in one scan."""
    raw = F.col("content").cast("string")  # the bytes as they are; not every file is UTF-8
    readable = F.coalesce(F.is_valid_utf8(raw), F.lit(True))
    rows = files.select(
        "repo_id", "path", "line_count", language(F.col("path"), extensions).alias("language"), F.when(readable, raw).alias("text"), readable.alias("_readable")
    )
    for indexer in indexers.values():
        rows = indexer(rows)
    nothing = F.struct(F.lit("").alias("purpose"), F.array().cast(f"ARRAY<{_SYMBOL}>").alias("symbols"), F.array().cast(f"ARRAY<{_IMPORT}>").alias("imports"))
    unread = F.struct(F.lit(READ_ERROR).alias("purpose"), F.array().cast(f"ARRAY<{_SYMBOL}>").alias("symbols"), F.array().cast(f"ARRAY<{_IMPORT}>").alias("imports"))
    built = F.coalesce(*[F.col(f"_{name}").cast(f"STRUCT<{_STRUCTURE}>") for name in indexers], nothing)
    found = F.when(F.col("_readable"), built).otherwise(unread)
    return rows.select("repo_id", "path", "line_count", "language", found.alias("s")).select("repo_id", "path", "line_count", "language", "s.*")


def symbols_of(structure: DataFrame) -> DataFrame:
    # outer: for an inner one a filter on the array goes below the scan's shuffle, and parses every file there again
    return structure.select("repo_id", "path", F.posexplode_outer("symbols").alias("ord", "s")).filter("ord IS NOT NULL").select("repo_id", "path", "ord", "s.*")


def classify_imports(structure: DataFrame, all_paths: DataFrame) -> DataFrame:
    """(repo_id, path, ord, import, kind): internal when the top-level module is a file of the project.

    Script imports come classified. Relative imports are internal, and appear once more as the file they mean when that exists.
    ``all_paths`` is every file on disk, indexed or not.
    """
    return _import_rows(structure, all_paths).groupBy("repo_id", "path", "kind", "import").agg(F.min("ord").alias("ord"))


def _import_rows(structure: DataFrame, all_paths: DataFrame) -> DataFrame:
    """The same, imports that a file repeats still repeated: edges are made distinct themselves."""
    rows = structure.select("repo_id", "path", F.posexplode_outer("imports").alias("ord", "i")).filter("ord IS NOT NULL").select("repo_id", "path", "ord", "i.*")
    absolute = rows.filter("kind = 'absolute'").withColumn("top", F.split_part("name", F.lit("."), F.lit(1)))
    tops = F.regexp_extract("path", r"^([^/]+)(?:/__init__)?\.py$", 1)
    modules = structure.select("repo_id", tops.alias("top")).filter("top <> ''").distinct().withColumn("_own", F.lit(True))
    judged = lookup_join(absolute, modules, ["repo_id", "top"], "left")
    own = F.coalesce("_own", F.lit(False))
    plain = judged.select(
        "repo_id", "path", (F.col("ord") * 2).alias("ord"), F.when(own, F.col("name")).otherwise(F.col("top")).alias("import"),
        F.when(own, "internal").otherwise("external").alias("kind"),
    )
    relative = rows.filter("kind = 'relative'")
    written = relative.select(
        "repo_id", "path", (F.col("ord") * 2).alias("ord"), F.concat(F.repeat(F.lit("."), F.col("level")), "name").alias("import"), F.lit("internal").alias("kind")
    )
    # folders and target are columns of their own, so that neither is cut again for each use
    folders = F.filter(F.split(parent(F.col("path")), "/"), lambda p: p != "")
    base = F.slice("_folders", F.lit(1), F.greatest(F.size("_folders") - F.col("level") + 1, F.lit(0)))
    inside = F.size("_folders") >= F.col("level") - 1
    target = F.concat_ws("/", F.concat(base, F.split("name", r"\.")))
    placed = relative.filter("name <> ''").withColumn("_folders", folders).filter(inside).select("repo_id", "path", "ord", target.alias("_target"))
    endings = (".py", "/__init__.py")
    candidates = placed.select("*", F.posexplode(F.array(*[F.concat("_target", F.lit(e)) for e in endings])).alias("rank", "candidate"))
    known = all_paths.select("repo_id", F.col("path").alias("candidate"))
    hits = lookup_join(candidates, known, ["repo_id", "candidate"], "left_semi")
    found = hits.groupBy("repo_id", "path", "ord", "_target").agg(F.min("rank").alias("rank"))  # numbers, unlike texts, are aggregated without a sort
    resolved = found.select(
        "repo_id", "path", (F.col("ord") * 2 + 1).alias("ord"),
        F.concat("_target", F.when(F.col("rank") == 0, endings[0]).otherwise(endings[1])).alias("import"), F.lit("internal").alias("kind"),
    )
    settled = rows.filter(F.col("kind").isin("internal", "external")).select("repo_id", "path", (F.col("ord") * 2).alias("ord"), F.col("name").alias("import"), "kind")
    return plain.unionByName(written).unionByName(resolved).unionByName(settled)


# ---- tests ---------------------------------------------------------------------------------------


_TEST_NAME = r"^test_|\.(test|spec)\."  # every candidate below is named so


def _with_test_candidates(files: DataFrame) -> DataFrame:
    """``files`` with the array of its possible test files; the parts of a path are columns first, or each candidate would cut them again."""
    path, folder, name, ext = F.col("path"), F.col("_folder"), F.col("_stem"), F.col("_extension")
    cut = files.withColumns({"_folder": parent(path), "_stem": stem(path), "_extension": extension(path), "_language": language(path)})

    def paths(*parts: tuple) -> Column:
        return F.array(*[F.concat(*[F.lit(p) if isinstance(p, str) else p for p in part]) for part in parts])

    python = paths((folder, "test_", name, ".py"), ("tests/test_", name, ".py"), ("test/test_", name, ".py"))
    script = paths(
        (folder, name, ".test", ext), (folder, name, ".spec", ext), ("__tests__/", name, ".test", ext), ("tests/", name, ".test", ext)
    )
    tried = F.when(F.col("_language") == "python", python).when(F.col("_language") == "script", script)
    return cut.select(*files.columns, tried.alias("candidates"))


def map_test_files(files: DataFrame, all_paths: DataFrame) -> DataFrame:
    """(repo_id, path, test_file) of files that have a test; the first candidate on disk counts."""
    # outer: an inner one would ask for the size of the array, and build it, once more
    rows = _with_test_candidates(files.select("repo_id", "path")).select("repo_id", "path", F.posexplode_outer("candidates").alias("rank", "candidate"))
    known = all_paths.filter(F.substring_index("path", "/", -1).rlike(_TEST_NAME)).select("repo_id", F.col("path").alias("candidate"))
    hits = lookup_join(rows.filter("rank IS NOT NULL"), known, ["repo_id", "candidate"], "left_semi")
    first = _with_test_candidates(hits.groupBy("repo_id", "path").agg(F.min("rank").alias("rank")))
    return first.select("repo_id", "path", F.get("candidates", F.col("rank")).alias("test_file"))


# ---- dependencies --------------------------------------------------------------------------------


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """edges(repo_id, src, dst) of internal imports that mean a known file.

    An import is, in this order: a path, a module file, or a folder, which stands for its ``__init__.py``
    or else its first file. The folder case joins on every file's ancestor folders instead of comparing prefixes.
    """
    module = F.replace(F.ltrim(F.col("import"), F.lit(".")), F.lit("."), F.lit("/"))
    wanted = imports.filter("kind = 'internal'").select("repo_id", F.col("path").alias("src"), "import", module.alias("_module"))
    candidates = wanted.select(
        "repo_id", "src", "import",
        F.posexplode(F.array(F.col("import"), F.concat("_module", F.lit(".py")), F.concat("_module", F.lit("/")))).alias("rank", "target"),
    )
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    firsts = (
        files.filter(F.contains("path", F.lit("/")))
        .select("repo_id", "path", F.explode(folders).alias("target"))
        .groupBy("repo_id", "target")
        .agg(F.min_by("path", F.struct(F.col("path") != F.concat("target", F.lit("__init__.py")), F.split("path", "/"))).alias("dst"))
    )
    known = files.select("repo_id", F.col("path").alias("target"), F.col("path").alias("dst")).unionByName(firsts)
    meant = lookup_join(candidates, known, ["repo_id", "target"]).groupBy("repo_id", "src", "import").agg(F.min_by("dst", "rank").alias("dst"))
    return meant.filter("src <> dst").select("repo_id", "src", "dst").distinct()


def dependency_nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Every file with the number of files it needs and that need it."""
    ends = edges.select("repo_id", F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select("repo_id", F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    every = files.select("repo_id", "path", F.lit(0).alias("o"), F.lit(0).alias("i")).unionByName(ends)
    return every.groupBy("repo_id", "path").agg(F.sum("o").alias("depends_on"), F.sum("i").alias("depended_on_by"))


def impact_edges(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(repo_id, path, kind, other): dependents of a file, the tests of these, and its own test."""
    dependents = edges.select("repo_id", F.col("dst").alias("path"), F.lit("dependent").alias("kind"), F.col("src").alias("other"))
    by_file = tests.select("repo_id", F.col("path").alias("src"), F.col("test_file").alias("other"))
    # edges have one row per (src, dst): the heavy side of this join is bounded by a file's imports
    theirs = edges.join(by_file, ["repo_id", "src"]).select("repo_id", F.col("dst").alias("path"), F.lit("test").alias("kind"), "other")
    own = tests.select("repo_id", "path", F.lit("test").alias("kind"), F.col("test_file").alias("other"))
    return dependents.unionByName(theirs).unionByName(own).distinct()


def change_impact(files: DataFrame, impact: DataFrame) -> DataFrame:
    """Every file with its number of dependents and affected tests, and its risk."""
    every = files.select("repo_id", "path", F.lit("file").alias("kind")).unionByName(impact.select("repo_id", "path", "kind"))
    counted = every.groupBy("repo_id", "path").agg(
        F.count_if(F.col("kind") == "dependent").alias("dependents"), F.count_if(F.col("kind") == "test").alias("affected_tests"),
        F.bool_or(F.col("kind") == "file").alias("_known"),
    )
    return counted.filter("_known").drop("_known").withColumn("risk", T.risk_level(F.col("dependents")))


def repo_stats(files: DataFrame) -> DataFrame:
    """Files, lines, tested files and their share per repository; ``files`` has ``has_tests``."""
    total, tested = F.count(F.lit(1)), F.count_if("has_tests")
    return files.groupBy("repo_id").agg(
        total.alias("total_files"), F.sum("line_count").alias("total_lines"), tested.alias("tested_files"),
        F.bround(tested * 100 / total).cast("bigint").alias("coverage_pct"),
    )


def key_exports(symbols: DataFrame, limit: int = 3) -> DataFrame:
    """First exports of every file, joined by a comma."""
    kept = symbols.filter(F.col("ord") < limit)
    names = F.array_sort(F.collect_list(F.struct("ord", "name")))
    return kept.groupBy("repo_id", "path").agg(F.array_join(F.transform(names, lambda s: s["name"]), ", ").alias("key_exports"))


def index_report(files: DataFrame, symbols: DataFrame, impact: DataFrame, stats: DataFrame) -> DataFrame:
    """Report lines (repo_id, section_ord, path, line): where to find things, files without tests,
    high-risk files and statistics. (section_ord, path) orders a report."""
    shown = files.join(key_exports(symbols), ["repo_id", "path"], "left")
    exports = F.coalesce("key_exports", F.lit(""))
    purpose = T.non_empty(F.col("purpose"), F.col("path"))

    def lines(df: DataFrame, section: int, line: Column, path: Column | None = None) -> DataFrame:
        return df.select("repo_id", F.lit(section).alias("section_ord"), (F.col("path") if path is None else path).alias("path"), line.alias("line"))

    told = lines(
        shown.filter(~T.is_blank(F.col("purpose")) | (exports != "")), 1,
        F.concat(F.lit("| "), purpose, F.lit(" | `"), "path", F.lit("` | "), exports, F.lit(" |")),
    )
    untested = lines(files.filter("NOT has_tests"), 2, F.concat(F.lit("- `"), "path", F.lit("`")))
    risky = lines(
        impact.filter("risk = 'high'"), 3,
        F.concat(F.lit("- `"), "path", F.lit("` — "), F.col("dependents").cast("string"), F.lit(" files depend on it")),
    )
    summary = stats.withColumn("line", F.explode(F.array(
        F.concat_ws("", F.lit("- "), "total_files", F.lit(" source files | "), "tested_files", F.lit(" tested | "), "total_lines", F.lit(" total lines")),
        F.concat_ws("", F.lit("- Test coverage: "), "coverage_pct", F.lit("% of source files have a test file")),
    )))
    return told.unionByName(untested).unionByName(risky).unionByName(lines(summary, 4, F.col("line"), F.lit("")))


# ---- whole index ---------------------------------------------------------------------------------


class RepositoryIndex(Mapping[str, DataFrame]):
    """The tables of ``index_repository`` by name, each built when it is first asked for.

    What several tables start from (structure, test files, edges) is checkpointed when the first of them
    needs it, and not at all for a table that does without.
    """

    TABLES = ("files", "symbols", "imports", "edges", "nodes", "impact_edges", "change_impact", "stats", "report")

    def __init__(self, sources: DataFrame, all_paths: DataFrame, indexers: Mapping[str, Indexer], extensions: Mapping[str, str]):
        self._sources, self._all_paths, self._kinds = sources, all_paths, (indexers, extensions)

    @cached_property
    def structure(self) -> DataFrame:
        return materialise(file_structure(self._sources, *self._kinds))  # in columns: most tables read two or three of them

    @cached_property
    def listed(self) -> DataFrame:
        return self.structure.select("repo_id", "path", "line_count", "purpose")

    @cached_property
    def tests(self) -> DataFrame:
        return cut_lineage(map_test_files(self.listed.filter(F.col("purpose") != PARSE_ERROR), self._all_paths))

    @cached_property
    def files(self) -> DataFrame:
        return self.listed.join(self.tests, ["repo_id", "path"], "left").withColumn("has_tests", F.col("test_file").isNotNull())

    @cached_property
    def symbols(self) -> DataFrame:
        return symbols_of(self.structure)

    @cached_property
    def imports(self) -> DataFrame:
        return classify_imports(self.structure, self._all_paths)

    @cached_property
    def edges(self) -> DataFrame:
        return cut_lineage(resolve_imports(self.listed, _import_rows(self.structure, self._all_paths)))

    @cached_property
    def nodes(self) -> DataFrame:
        return dependency_nodes(self.listed, self.edges)

    @cached_property
    def impact_edges(self) -> DataFrame:
        return impact_edges(self.edges, self.tests)

    @cached_property
    def change_impact(self) -> DataFrame:
        return change_impact(self.listed, self.impact_edges)

    @cached_property
    def stats(self) -> DataFrame:
        return repo_stats(self.files)

    @cached_property
    def report(self) -> DataFrame:
        return index_report(self.files, self.symbols, self.change_impact, self.stats)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.TABLES)

    def __len__(self) -> int:
        return len(self.TABLES)


def index_repository(
    tree: DataFrame, globs: Sequence[str] = (), all_paths: DataFrame | None = None, max_lines: int | None = MAX_LINES,
    indexers: Mapping[str, Indexer] = INDEXERS, extensions: Mapping[str, str] = EXTENSIONS,
) -> RepositoryIndex:
    """Tables files, symbols, imports, edges, nodes, impact_edges, change_impact, stats and report.

    File contents are read and parsed once. ``all_paths`` is every file on disk, when ``tree`` is already
    cut down. Files of more than ``max_lines`` lines are left out; null keeps files of any length.
    """
    paths = (tree if all_paths is None else all_paths).select("repo_id", "path")
    return RepositoryIndex(source_files(tree, globs, max_lines=max_lines), paths, indexers, extensions)


def index_tree(
    spark: SparkSession, root: str, globs: Sequence[str] = (), repo_depth: int = 0, max_lines: int | None = MAX_LINES
) -> RepositoryIndex:
    """Index of the files below ``root``; contents of excluded files are not even read."""
    listed = list_tree(spark, root, repo_depth)  # whole: imports and tests may lie in excluded folders
    return index_repository(read_contents(indexable_paths(listed, globs)), globs, listed, max_lines)


def write_code_index(index: Mapping[str, DataFrame], path: str, mode: str = "overwrite", buckets: int = 64) -> None:
    """One Parquet table per part of the index, in folders by hash bucket of the repository and sorted inside."""
    for name, part in index.items():
        order = ["repo_bucket", "repo_id", *[c for c in ("path", "src", "file") if c in part.columns]]
        placed = part.withColumn("repo_bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)))
        placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)  # a hot repository is spread over its ranges
        placed.write.mode(mode).partitionBy("repo_bucket").parquet(f"{path}/{name}")
