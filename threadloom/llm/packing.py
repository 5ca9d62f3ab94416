"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.storage import materialise
from threadloom.llm.common import Batches, as_bytes, map_arrow
from threadloom.llm.token_counts import TOKENIZER
from threadloom.llm.word_pieces import WordPieces

CAPACITY = 2048
SEPARATOR = 0
SLICE_ROWS = 50_000  # rows of one size that are ranked together: about what one task sorts at once


class PieceIds(dict):
    """Token ids of pre-tokens as little-endian bytes; forgets all beyond ``most``."""

    def __init__(self, tokenizer: str, most: int = 500_000):
        super().__init__()
        self.pieces, self.most = WordPieces(tokenizer), most

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        self.update(zip(new, self.pieces.packed(new)))


_ids: dict[str, PieceIds] = {}


def token_pieces(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """``docs`` without its text, exploded into (piece, start, length, ids, ids_crc32).

    A text's ids are those of its tokenizer and then the separator. Only sequences longer than
    ``capacity`` are cut; a null text is the separator alone. Words are encoded once for each
    bounded cache of a worker, and white space, which this tokenizer drops, never joins words.
    Columns of ``docs`` that clash with these names must be dropped or renamed before.
    """
    kept = [c for c in docs.columns if c != text]
    width, end = 4 * capacity, struct.pack("<I", separator)

    def cut(batches: Batches) -> Batches:
        if tokenizer not in _ids:
            _ids[tokenizer] = PieceIds(tokenizer)
        ids = _ids[tokenizer]
        for batch in batches:
            texts = as_bytes(batch.column(text))
            for first in range(0, max(1, batch.num_rows), 200):
                parts = [(t or b"").split() for t in texts[first : first + 200]]
                ids.learn({w for words in parts for w in words})
                rows, pieces, blobs = [], [], []
                for n, words in enumerate(parts):
                    encoded = b"".join(map(ids.__getitem__, words)) + end
                    for piece in range(-(-len(encoded) // width)):
                        rows.append(first + n)
                        pieces.append(piece)
                        blobs.append(encoded[piece * width : (piece + 1) * width])
                columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in kept]
                columns += [
                    pa.array(pieces, pa.int32()),
                    pa.array([p * capacity for p in pieces], pa.int64()),
                    pa.array([len(b) // 4 for b in blobs], pa.int64()),
                    pa.array(blobs, pa.binary()),
                    pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "piece", "start", "length", "ids", "ids_crc32"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), "piece int, start long, length long, ids binary, ids_crc32 long"])
    return map_arrow(docs, cut, schema)


def _ranked_levels(items: DataFrame, slice_rows: int) -> DataFrame:
    """Adds ``level``: the height at which a gap is pushed on, or a document taken off, the stack of
    one sweep from the largest size to the smallest, gaps before documents of the same size.

    The height before each size comes from the counts, 2 x ``capacity`` numbers whatever the corpus.
    A size is ranked in slices of some ``slice_rows`` rows, as many as its count asks for, and each
    slice goes on from the rows of those before it.
    """
    counts = items.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    height, before = 0, []
    for row in sorted(counts, key=lambda r: (-r["size"], r["kind"])):
        before.append((row["kind"], row["size"], height, -(-row["n"] // slice_rows)))
        height += row["n"] if row["kind"] == 0 else -row["n"]
    heights = items.sparkSession.createDataFrame(before, "kind int, size long, height long, slices long")
    parts = ["kind", "size", "slice"]
    sliced = items.join(F.broadcast(heights), ["kind", "size"]).withColumn("slice", F.pmod(F.xxhash64("id", "slot"), "slices"))
    earlier = Window.partitionBy("kind", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sliced.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).select(*parts, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy(*parts).orderBy("id", "slot"))
    step = F.when(F.col("kind") == 0, F.col("height") + F.col("rank")).otherwise(F.col("height") - F.col("rank") + 1)
    ranked = sliced.withColumn("rank", rank).join(ahead, parts).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.withColumn("level", step).drop("height", "rank", "base", "slices", "slice")


def _sweep(items: DataFrame, slice_rows: int) -> DataFrame:
    """One round: every document takes the smallest gap that holds it and that no document before it
    took; every gap takes one document at most. Adds ``bin`` to documents that found one, and ``taken``,
    the length that came in, to gaps.

    Documents and gaps that meet are neighbours on their level, and a level has at most one row of
    each size and kind.
    """
    near = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    back, ahead = F.lag(F.struct("kind", "id")).over(near), F.lead(F.struct("kind", "size")).over(near)
    met, filled = (F.col("kind") == 1) & (F.col("back.kind") == 0), (F.col("kind") == 0) & (F.col("ahead.kind") == 1)
    return (
        _ranked_levels(items, slice_rows)
        .withColumns({"back": back, "ahead": ahead})
        .withColumns({"bin": F.when(met, F.col("back.id")), "taken": F.when(filled, F.col("ahead.size")).otherwise(0)})
        .drop("level", "back", "ahead")
    )


def _histogram(frame: DataFrame, size: str, capacity: int) -> np.ndarray:
    """Rows of each size from 0 to ``capacity``."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in frame.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect():  # ``capacity`` + 1 rows at most
        counts[row["size"]] = row["n"]
    return counts


def _needed(docs: np.ndarray, gaps: np.ndarray, capacity: int) -> int:
    """Bins without which the open documents cannot fit into the open gaps, from the counts of each size.

    The tokens left may outnumber the room of the gaps that take any; and of the documents of some
    size or more, a gap or a bin takes no more than that size goes into it.
    """
    sizes = np.arange(capacity + 1)
    least = int(np.flatnonzero(docs)[0])
    short = int(docs @ sizes - (gaps * sizes)[least:].sum())
    needed = max(0, -(-short // capacity))
    at_least = docs[::-1].cumsum()[::-1]
    for size in np.flatnonzero(docs):
        over = int(at_least[size] - (gaps * (sizes // size)).sum())
        needed = max(needed, -(-over // (capacity // int(size))))
    return needed


def best_fit(items: DataFrame, capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Packs ``items`` (id, size: 1 to ``capacity``; ids unique) into bins: (id, bin, offset).

    Rounds of sweeps over all open documents and gaps. Before each, as many bins are opened as the open
    documents need beyond the open gaps, no more: then all documents of the greatest size find a place.
    A gap that holds the longest open document several times is offered in as many slots. Gaps that the
    shortest open document does not fit are shut. Offsets come last, from the documents of each bin,
    of which there are at most ``capacity``.
    """
    spark = items.sparkSession
    docs = items.select(F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("slot"), F.col("size").cast("long"), F.lit(0).cast("long").alias("room"))
    placed = [docs.filter(F.col("size") >= capacity).select("id", F.col("id").alias("bin"), "size")]
    docs = docs.filter(F.col("size") < capacity)
    gaps, opened = spark.createDataFrame([], "id long, room long"), 0
    left, rooms = _histogram(docs, "size", capacity), np.zeros(capacity + 1, dtype=np.int64)
    while left.any():
        n = _needed(left, rooms, capacity)
        if n:
            # negative numbers: bins of full documents are named by the document
            new = spark.range(-opened - n, -opened, numPartitions=max(1, n // 200_000))
            gaps, opened = gaps.union(new.select("id", F.lit(capacity).cast("long").alias("room"))), opened + n
        least, most = (int(np.flatnonzero(left)[k]) for k in (0, -1))
        offered = (
            gaps.filter(F.col("room") >= least)
            .withColumn("slots", F.greatest(F.floor(F.col("room") / most), F.lit(1).cast("long")))
            .select(F.lit(0).alias("kind"), "id", F.explode(F.expr("sequence(1L, slots)")).alias("slot"), F.floor(F.col("room") / F.col("slots")).alias("size"), "room")
        )
        swept = materialise(_sweep(docs.unionByName(offered), slice_rows))
        placed.append(swept.filter(F.col("bin").isNotNull()).select("id", "bin", "size"))
        docs = swept.filter((F.col("kind") == 1) & F.col("bin").isNull()).select("kind", "id", "slot", "size", "room")
        gaps = swept.filter("kind = 0").groupBy("id").agg((F.max("room") - F.sum("taken")).alias("room"))
        left = _histogram(docs, "size", capacity)
        if left.any():
            rooms = _histogram(gaps, "room", capacity)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    ahead = Window.partitionBy("bin").orderBy(F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return out.select("id", "bin", F.coalesce(F.sum("size").over(ahead), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most ``capacity`` tokens and are filled from 0 without holes. A null text is
    packed as its separator; rows that repeat an id or a whole row are packed each by itself. Other
    columns of ``docs`` are not carried. Lineage is cut after encoding, so every round sees the same rows.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    pieces = token_pieces(narrow, "_text", tokenizer, capacity, separator).drop("ids")
    pieces = materialise(pieces.withColumn("_id", F.monotonically_increasing_id()))
    where = best_fit(pieces.select(F.col("_id").alias("id"), F.col("length").alias("size")), capacity)
    return (
        pieces.join(where.withColumnRenamed("id", "_id"), "_id")
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    )
