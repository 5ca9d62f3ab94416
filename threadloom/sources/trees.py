"""Source trees: files of many repositories as rows (repo_id, path, content)."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.shuffles import cut_lineage
from threadloom.lexicons import EXCLUDED_DIRS

MAX_LINES = 500
SNIFFED_BYTES = 1024
FILES_PER_BATCH = 64


def _pruned(name: str, excluded: Sequence[str]) -> bool:
    return bool(excluded) and (name in excluded or name.endswith(".egg-info"))


def _lister(excluded: Sequence[str]):
    """Lists folders one level deep: excluded ones, links to folders (a loop, or files listed elsewhere) and broken links left out."""

    def listed(uri: str) -> pd.DataFrame:
        system, path = fs.FileSystem.from_uri(uri)
        prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
        entries = []
        for e in system.get_file_info(fs.FileSelector(path)):
            if e.type == fs.FileType.Directory:
                linked = system.type_name == "local" and os.path.islink(e.path)
                if not linked and not _pruned(e.base_name, excluded):
                    entries.append(e)
            elif e.type == fs.FileType.File:
                entries.append(e)
        return pd.DataFrame({
            "uri": pd.Series([prefix + e.path for e in entries], dtype=object),
            "is_dir": pd.Series([e.type == fs.FileType.Directory for e in entries], dtype=bool),
            "size": pd.Series([int(e.size or 0) for e in entries], dtype="int64"),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from map(listed, batch["uri"])

    return run


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), FILES_PER_BATCH):
            part = batch.iloc[start : start + FILES_PER_BATCH].copy()
            contents = []
            for uri in part["uri"]:
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(path) as stream:
                    contents.append(stream.read())
            part["content"] = contents
            yield part[["repo_id", "path", "size", "content"]]


def list_tree(spark: SparkSession, root: str, repo_depth: int = 0, excluded: Sequence[str] = ()) -> DataFrame:
    """(repo_id, path, uri, size) of every file below ``root``.

    With ``repo_depth`` n, the first n folders below the root name the repository; with 0 the whole
    tree is one repository. Spark's own file sources leave out names that start with "_" or ".", and
    with them every ``__init__.py``; so folders are listed level by level, each level in parallel.
    Links to folders are never followed. Folders named in ``excluded``, and with them those of installed
    eggs, are not entered below a repository's own folder.
    """
    base = root.rstrip("/")
    folders = spark.createDataFrame([(base,)], "uri STRING")
    levels = []
    while True:
        below = excluded if len(levels) >= repo_depth else ()
        listed = cut_lineage(folders.repartition("uri").mapInPandas(_lister(below), "uri STRING, is_dir BOOLEAN, size LONG"))
        levels.append(listed.filter("NOT is_dir"))
        folders = listed.filter("is_dir").select("uri")
        if folders.isEmpty():
            break
    files = reduce(DataFrame.union, levels)
    parts = F.split(F.substr("uri", F.lit(len(base) + 2)), "/")
    depth = F.lit(repo_depth)
    repo = F.array_join(F.slice(parts, F.lit(1), depth), "/") if repo_depth else F.lit(base.rsplit("/", 1)[-1])
    inside = F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0)))
    return files.select(repo.alias("repo_id"), F.array_join(inside, "/").alias("path"), "uri", "size")


def read_contents(listed: DataFrame) -> DataFrame:
    """(repo_id, path, size, content) of listed files, spread evenly over tasks."""
    return listed.repartition("uri").mapInPandas(_read_files, "repo_id STRING, path STRING, size LONG, content BINARY")


def read_tree(spark: SparkSession, root: str, repo_depth: int = 0, excluded: Sequence[str] = ()) -> DataFrame:
    """(repo_id, path, size, content) of every file that ``list_tree`` lists."""
    return read_contents(list_tree(spark, root, repo_depth, excluded))


def byte_text(content: Column) -> Column:
    """One character per byte, so that counting characters counts bytes."""
    return F.decode(content, "ISO-8859-1")


def bytes_line_count(content: Column) -> Column:
    text = byte_text(content)
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def in_excluded_dir(path: Column, excluded: Sequence[str] = EXCLUDED_DIRS) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.isin(*excluded) | part.endswith(".egg-info"))


def matches_glob(path: Column, patterns: Sequence[str]) -> Column:
    """Shell pattern over the whole path; ``*`` also crosses folders."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | path.rlike("^" + fnmatch.translate(pattern).replace(r"\Z", r"\z"))
    return hit


def indexable_paths(files: DataFrame, globs: Sequence[str] = (), excluded: Sequence[str] = EXCLUDED_DIRS) -> DataFrame:
    """Files outside excluded folders that no glob matches; needs paths only, so it can run before
    contents are read."""
    path = F.col("path")
    return files.filter(~in_excluded_dir(path, excluded) & ~matches_glob(path, globs))


def source_files(
    tree: DataFrame, globs: Sequence[str] = (), excluded: Sequence[str] = EXCLUDED_DIRS, max_lines: int | None = MAX_LINES
) -> DataFrame:
    """Files worth indexing, with ``line_count``: indexable by path, not binary (a zero byte near the
    start) and not longer than ``max_lines``; null sets no limit."""
    content = F.col("content")
    binary = F.contains(F.substr(content, F.lit(1), F.lit(SNIFFED_BYTES)), F.lit(b"\x00"))
    counted = indexable_paths(tree, globs, excluded).filter(~binary).withColumn("line_count", bytes_line_count(content))
    return counted if max_lines is None else counted.filter(F.col("line_count") <= max_lines)
