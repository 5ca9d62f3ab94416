"""Removal of long word sequences that an earlier document has, by compacted De Bruijn paths.

Edges are windows of ``window`` consecutive words; an edge follows another where the window moves on
by one word. Neighbouring windows that share their minimiser, the least hashed k-mer of words in
them, form a path, so one row stands for some twenty windows. All edges of a window's content lie
behind the same minimiser at the same place, so paths can be compacted by joins on it:

* behind a minimiser that all its documents continue alike there is one path: it does not branch,
  and its first document settles all its windows at once;
* where paths branch, one occurrence of each distinct path is read again at its source coordinates
  and its windows are settled one by one.

Word hashes have 64 bits, and minimiser and window hash together 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.storage import materialise
from threadloom.llm.common import Batches, Sieve, as_bytes, keyed, map_arrow, sized

WINDOW = 50
KMER = 16
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that its powers have inverses modulo 2 ** 64
_BITS = 64
_PLACE_BITS = 32  # places of one batch's words: more than a text can have


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any span of a word sequence, from sums of powers modulo 2 ** 64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, down = np.full(n + 1, _BASE, dtype=np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << _BITS), dtype=np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from leasts of powers of two."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def _paths(lengths: np.ndarray, hashes: np.ndarray, window: int, kmer: int):
    """(document, start, windows, anchor, path hash) of all paths of a batch of documents."""
    total, doc_end = len(hashes), np.cumsum(lengths)
    empty = np.empty(0, dtype=np.int64)
    if total < window:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), None
    rolling = Rolling(hashes)
    at = np.arange(total - kmer + 1)
    kmers = rolling.span(at, at + kmer)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = _sliding_least((_mix(kmers ^ np.uint64(0xA5)) & ~mask) | at.astype(np.uint64), window - kmer + 1)
    starts = np.arange(total - window + 1)
    doc = np.searchsorted(doc_end, starts, "right")
    inside = starts + window <= doc_end[doc]
    starts, doc, place = starts[inside], doc[inside], (least[inside] & mask).astype(np.int64)
    if not len(starts):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), None
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin, doc = starts[first], doc[first]
    anchor = kmers[place[first]]
    return doc, begin, count, anchor, rolling.span(begin, begin + count + window - 1), rolling


def _chunks(texts: list[bytes | None], most_words: int = 200_000):
    """(first row, split texts) of consecutive rows with about ``most_words`` words at most."""
    first, held, words = 0, [], 0
    for n, t in enumerate(texts):
        split = (t or b"").split()
        if held and words + len(split) > most_words:
            yield first, held
            first, held, words = n, [], 0
        held.append(split)
        words += len(split)
    if held:
        yield first, held


def _hash_words(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    hashes = np.fromiter((_hashes[w] for words in parts for w in words), dtype=np.uint64, count=int(lengths.sum()))
    return lengths, hashes


def _slices(batches: Batches) -> Batches:
    """Batches cut so that the texts which a task unpacks at once stay small."""
    return (part for batch in batches for part in sized(batch, batch.schema.get_field_index("_text"), 4 << 20))


def document_paths(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, wanted: Sieve | None = None) -> DataFrame:
    """(_id, _key, start, n, anchor, path): paths of n consecutive windows, from word ``start`` of a document.

    Paths that ``wanted`` holds back are left out.
    """

    def run(batches: Batches) -> Batches:
        for batch in _slices(batches):
            for first, parts in _chunks(as_bytes(batch.column(2))):
                lengths, hashes = _hash_words(parts)
                doc, begin, count, anchor, path, _ = _paths(lengths, hashes, window, kmer)
                if wanted and len(path):
                    keep = wanted.passes(path.view(np.int64))
                    doc, begin, count, anchor, path = (x[keep] for x in (doc, begin, count, anchor, path))
                offset = np.cumsum(lengths) - lengths
                row = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array((begin - offset[doc]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(path.view(np.int64)),
                    ],
                    ["_id", "_key", "start", "n", "anchor", "path"],
                )

    return map_arrow(docs, run, "_id long, _key binary, start int, n int, anchor long, path long")


def _row_hash():
    return F.xxhash64("_id", "_key")


def _sieved(docs: DataFrame, wanted: Sieve) -> DataFrame:
    """Rows of (_id, _key, _text) that ``wanted`` lets through."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pa.array(wanted.passes(batch.column(3).to_numpy()))).select(["_id", "_key", "_text"])

    return map_arrow(docs.withColumn("h", _row_hash()), run, "_id long, _key binary, _text string")


def _settled_branches(docs: DataFrame, branching: DataFrame, window: int) -> DataFrame:
    """(anchor, path, first_id, windows) of branching paths: a bit for each window that first_id has first.

    ``branching(anchor, path, n, first)`` holds each distinct path with its first occurrence, where its
    windows are read again.
    """
    sources = materialise(
        branching.groupBy("first._id", "first._key").agg(F.collect_list(F.struct("first.start", "n", "anchor", "path")).alias("paths"))
    )

    def expand(batches: Batches) -> Batches:
        for batch in _slices(batches):
            asked = batch.column("paths")
            for first, parts in _chunks(as_bytes(batch.column("_text"))):
                lengths, hashes = _hash_words(parts)
                if not len(hashes):
                    continue
                rolling, offset = Rolling(hashes), np.cumsum(lengths) - lengths
                lists = asked.slice(first, len(parts))
                flat = lists.flatten()
                doc = np.repeat(np.arange(len(parts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                start, n, anchor, path = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(start + offset[doc], n) + step
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(anchor, n)),
                        pa.array(np.repeat(path, n)),
                        pa.array(step.astype(np.int32)),
                        pa.array(rolling.span(begin, begin + window).view(np.int64)),
                        batch.column("_id").take(pa.array(np.repeat(doc + first, n))),
                    ],
                    ["anchor", "path", "step", "window", "first_id"],
                )

    texts = _sieved(docs, Sieve(sources.select(_row_hash().alias("h")), "h")).join(sources, ["_id", "_key"]).select("_id", "_text", "paths")
    windows = map_arrow(texts, expand, "anchor long, path long, step int, window long, first_id long")
    shared = windows.groupBy("anchor", "window").agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("paths")).filter("paths > 1")
    settled = windows.join(shared, ["anchor", "window"], "left").withColumn("first_id", F.coalesce("least_id", "first_id"))
    return settled.groupBy("anchor", "path", "first_id").agg(F.expr("bit_or(shiftleft(1L, step))").alias("windows"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: the words no repeated window covers, joined by a space.

    A word goes if a window of ``window`` consecutive words covers it and the same words also start in
    a document with a smaller id; windows are judged on the input. Words are runs without ASCII white
    space; a null text has none. Rows without an id are neither compared nor cut. Rows that repeat an id
    are judged each by itself, against documents with smaller ids.
    """
    if window - kmer + 1 > 62:
        raise ValueError("a path's windows must fit the bits of a long")
    source = keyed(docs, doc_id, text)
    named = source.filter(F.col("_id").isNotNull())
    paths = document_paths(named, window, kmer)
    distinct = paths.groupBy("anchor", "path", "n").agg(F.min(F.struct("_id", "_key", "start")).alias("first"), F.max("_id").alias("last_id"))
    anchors = (
        distinct.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("paths"), F.min("first._id").alias("low"), F.max("last_id").alias("high"))
        .filter("low < high")
        .select("anchor", (F.col("paths") > 1).alias("branches"))
    )
    repeated = materialise(distinct.join(anchors, "anchor"))
    straight = repeated.filter("not branches").select(
        "anchor", "path", F.col("first._id").alias("first_id"), F.expr("shiftleft(1L, n) - 1").alias("windows")
    )
    settled = materialise(straight.union(_settled_branches(named, repeated.filter("branches"), window)))
    cuts = materialise(
        document_paths(named, window, kmer, Sieve(settled, "path"))
        .join(settled, ["anchor", "path"])
        .filter("first_id < _id")
        .groupBy("_id", "_key")
        .agg(F.collect_list(F.struct("start", "windows")).alias("cuts"))
    )

    def cut(batches: Batches) -> Batches:
        for batch in _slices(batches):
            texts, spans = as_bytes(batch.column("_text")), batch.column("cuts")
            words, removed, kept = [], [], []
            for n, t in enumerate(texts):
                parts = (t or b"").split()
                words.append(len(parts))
                gone = 0
                if spans[n].is_valid:
                    flat = spans[n].values
                    start, bits = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
                    row, step = np.nonzero((bits[:, None] >> np.arange(62)) & 1)
                    begin = start[row] + step
                    edge = np.zeros(len(parts) + 1, dtype=np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + window, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    parts = [w for w, c in zip(parts, covered.tolist()) if not c]
                removed.append(gone)
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    touched = Sieve(cuts.select(_row_hash().alias("h")), "h")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int64())]))

    def whole(batches: Batches) -> Batches:
        """Rows that nothing touches, in the worker that finds them."""
        rest = (batch.filter(pa.array(~touched.passes(batch.column("h").to_numpy()))) for batch in batches)
        return cut(pa.RecordBatch.from_arrays([b.column("_id"), b.column("_text"), pa.nulls(b.num_rows, spans)], ["_id", "_text", "cuts"]) for b in rest)

    schema = "doc_id long, n_words long, n_removed long, kept string"
    joined = _sieved(source, touched).join(cuts, ["_id", "_key"], "left").select("_id", "_text", "cuts")
    return map_arrow(joined, cut, schema).union(map_arrow(source.select("_id", "_text", _row_hash().alias("h")), whole, schema))
