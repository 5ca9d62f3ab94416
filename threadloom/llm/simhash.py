"""SimHash fingerprints of word shingles, linked within a Hamming radius by forests of BK-trees."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.storage import materialise
from threadloom.llm.common import Batches, as_bytes, keyed, map_arrow
from threadloom.llm.components import components, forest

SHINGLE = 4
RADIUS = 4
BLOCKS = 6  # a fingerprint's blocks; two within the radius agree on at least BLOCKS - RADIUS of them
SHARD = 2048  # most fingerprints in one tree


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is 1 where over half of the shingles' XXH64 (seed 42) have bit b; zero without words."""
    words = text.lower().split()  # bytes: lowers A-Z only and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    bounds = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in bounds), dtype="<u8", count=len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, _key, fp) for each row; fp is the fingerprint's 64 bits as a signed long. Null text: no words."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            prints = np.array([fingerprint(t or b"", shingle) for t in as_bytes(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["_id", "_key", "fp"])

    return map_arrow(keyed(docs, doc_id, text), run, "_id long, _key binary, fp long")


def hex_of(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bk_forest(bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree for each bucket, all grown at once: order of nodes, their parents, edges, depths.

    All fingerprints start below their bucket's first one. Of those that share parent and distance
    the first becomes the child behind that edge, the others go on below it.
    """
    n = len(fp)
    parent, edge, depth = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    _, root, inverse = np.unique(bucket, return_index=True, return_inverse=True)
    below = root[inverse]
    open_ = np.flatnonzero(below != np.arange(n))
    level = 0
    while len(open_):
        level += 1
        distance = np.bitwise_count(fp[open_] ^ fp[below[open_]]).astype(np.int64)
        group = below[open_] * 65 + distance
        _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        node = open_[first]
        parent[node], edge[node], depth[node] = below[node], distance[first], level
        rest = np.ones(len(open_), dtype=bool)
        rest[first] = False
        below[open_] = node[inverse]
        open_ = open_[rest]
    return root, parent, edge, depth


def bk_links(bucket: np.ndarray, fp: np.ndarray, query_bucket: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of positions within ``radius`` inside a bucket.

    All queries walk down their bucket's tree together, level by level, and from a node at distance d
    follow only edges d - radius to d + radius.
    """
    root, parent, edge, _ = bk_forest(bucket, fp)
    order = np.lexsort((edge, parent))
    order = order[np.searchsorted(parent[order], 0) :]
    key = parent[order] * 65 + edge[order]  # children sorted by parent and edge
    of_bucket = bucket[root]
    at = np.searchsorted(of_bucket, query_bucket)
    at[at == len(of_bucket)] = 0
    has_tree = of_bucket[at] == query_bucket
    q, node = np.flatnonzero(has_tree), root[at[has_tree]]
    hits_q, hits_n = [], []
    while len(q):
        distance = np.bitwise_count(query[q] ^ fp[node]).astype(np.int64)
        near = distance <= radius
        hits_q.append(q[near])
        hits_n.append(node[near])
        low = np.searchsorted(key, node * 65 + np.maximum(distance - radius, 0), "left")
        high = np.searchsorted(key, node * 65 + np.minimum(distance + radius, 64), "right")
        n = high - low
        q = np.repeat(q, n)
        node = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    return np.concatenate(hits_q or [[]]).astype(np.int64), np.concatenate(hits_n or [[]]).astype(np.int64)


def block_keys(fp: str, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """All (choice of blocks, their bits) keys of a fingerprint: two within the radius share one."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        bits = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask = bits - (1 << 64) if bits >= 1 << 63 else bits
        keys.append(F.struct(F.lit(n).alias("choice"), F.col(fp).bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of distinct ``prints(fp)`` within ``radius``.

    Two such fingerprints agree on ``blocks - radius`` blocks, so each goes to one bucket for every
    choice of that many. Buckets of one are left out; a bucket's fingerprints form BK-trees of about
    ``shard`` of them, and each shard of its fingerprints asks each tree in a group of its own. Trees are shuffled to their queries, not broadcast:
    their number grows with the corpus. A tree's task keeps a spanning star of what it links, never
    the pairs.
    """
    keyed_prints = prints.select("fp", F.explode(block_keys("fp", radius, blocks)).alias("k")).select("fp", "k.*")
    sizes = keyed_prints.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / shard).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    # tree i is asked by the fingerprints of shard j >= i, so every pair meets once
    pair = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda p: F.struct(F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j")),
        )
    )
    placed = (
        keyed_prints.join(sizes.select("choice", "bits", parts.alias("parts")), ["choice", "bits"])
        .withColumn("own", own)
        .withColumn("pair", pair)
        .select(
            F.xxhash64("choice", "bits", "pair").alias("bucket"),
            "fp",
            (F.col("own") == F.col("pair.i")).alias("node"),
            (F.col("own") == F.col("pair.j")).alias("asks"),
        )
    )

    def search(batches: Batches) -> Batches:
        def links(table: pa.Table) -> pa.RecordBatch:
            bucket = table.column("bucket").to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            node, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "asks"))
            a, b = [], []
            asking = np.flatnonzero(asks)
            for at in range(0, len(asking), 1024):
                part = asking[at : at + 1024]
                # trees that these queries can ask; rows are sorted by bucket
                lo, hi = np.searchsorted(bucket, bucket[part][0], "left"), np.searchsorted(bucket, bucket[part][-1], "right")
                trees = lo + np.flatnonzero(node[lo:hi])
                q, n = bk_links(bucket[trees], fp[trees], bucket[part], fp[part], radius)
                x, y = fp[part][q], fp[trees][n]
                apart = x != y
                star = forest(x[apart].view(np.int64), y[apart].view(np.int64)) if apart.any() else (np.empty(0, np.int64),) * 2
                a.append(star[0])
                b.append(star[1])
            none = np.empty(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 100_000:
                continue
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1], "left"))  # the last bucket may go on
            if whole:
                yield links(table.slice(0, whole))
                rest = table.slice(whole).combine_chunks().to_batches()
                held, rows = rest, sum(x.num_rows for x in rest)
        if held:
            yield links(pa.Table.from_batches(held))

    sorted_trees = placed.repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(sorted_trees, search, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, _key, fp, component_id, representative) for each row of ``docs``.

    Documents link where fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id that links reach, itself included. ``representative`` marks the rows of that id whose text
    key is the least: one text for each group. Texts without words have fingerprint zero and are
    linked like any other. Rows without an id belong to a component by their text; a component of
    such rows alone has a null id, and its least text key represents it.
    """
    prints = materialise(fingerprints(docs, doc_id, text, shingle))
    best = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_key")))
    nameless = F.min(F.when(F.col("_id").isNull(), F.col("_key")))
    classes = prints.groupBy("fp").agg(best.alias("best"), nameless.alias("nameless"))
    roots = components(link_fingerprints(prints.select("fp").distinct(), radius))
    classed = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "best", "nameless", F.coalesce("component", "fp").alias("root")
    )
    firsts = classed.groupBy("root").agg(F.min("best").alias("first"), F.min("nameless").alias("first_nameless"))
    named = classed.select("fp", "root").join(firsts, "root").select("fp", "first", "first_nameless")
    stays = F.when(F.col("first").isNotNull(), (F.col("_id") == F.col("first._id")) & (F.col("_key") == F.col("first._key"))).otherwise(
        F.col("_key") == F.col("first_nameless")
    )
    return prints.join(materialise(named), "fp").select(
        F.col("_id").alias("doc_id"), "_key", "fp", F.col("first._id").alias("component_id"), F.coalesce(stays, F.lit(False)).alias("representative")
    )
