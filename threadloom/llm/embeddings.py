"""Near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.storage import materialise
from threadloom.llm.common import Batches, map_arrow
from threadloom.llm.components import components, forest

LEAST_COSINE = 0.9
RECALL = 0.99  # share of the pairs at the least cosine that the tables shall find
PROBES = 2  # nearest vertices taken of each function
MOST_FUNCTIONS = 6  # longest key: 2 ** 6 probes of a table, 10 ** 9 chance partners of 64 dimensions apart
BLOCK = 1024  # most vectors of a bucket on one side of a comparison
SEED = 20_11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x


def vertices(x: np.ndarray, table: int, function: int, probes: int) -> np.ndarray:
    """Numbers of the ``probes`` cross-polytope vertices nearest to each row after a random rotation.

    The rotation is three rounds of random signs and a Hadamard transform. Vertex 2i is axis i,
    2i + 1 its opposite. Rows come out sorted.
    """
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    rng = np.random.default_rng((SEED, table, function, width))
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    top = np.argpartition(-np.abs(y), min(probes, width) - 1, axis=1)[:, :probes]
    return np.sort(2 * top + (np.take_along_axis(y, top, axis=1) < 0), axis=1).astype(np.int32)


def functions_for(rows: int, width: int, probes: int = PROBES) -> int:
    """Functions in a table's key for so many vectors: with one fewer, a vector would share a table's
    buckets with more than a tenth of a vector by chance. So buckets do not grow with the corpus."""
    apart = max(2.0, 2 * max(width, 1) / probes**2)  # one function's odds against sharing a vertex by chance
    return int(min(MOST_FUNCTIONS, max(1, np.ceil(np.log(max(rows, 1) * 10) / np.log(apart)))))


def shared_chance(width: int, least: float = LEAST_COSINE, probes: int = PROBES, pairs: int = 2000) -> float:
    """Chance that one function gives two vectors of cosine ``least`` a common vertex, by trial.

    Rotations are random, so it hangs on the cosine and the width alone, not on the corpus.
    """
    rng = np.random.default_rng((SEED, width))
    a, b = rng.normal(size=(2, pairs, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = least * a + np.sqrt(max(0.0, 1 - least**2)) * b
    va, vb = vertices(a, 0, 0, probes), vertices(b, 0, 0, probes)
    return float((va[:, :, None] == vb[:, None, :]).any(axis=(1, 2)).mean())


def tables_for(width: int, functions: int, least: float = LEAST_COSINE, probes: int = PROBES, recall: float = RECALL) -> int:
    """Tables of which one at least finds a pair of cosine ``least`` with chance ``recall``."""
    found = min(max(shared_chance(width, least, probes), 0.05) ** functions, 1 - 1e-9)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - found)))


def _matrix(lists: pa.Array, rows: np.ndarray, width: int, kind=np.float64) -> np.ndarray:
    """The given rows of a list column, all of one width."""
    return lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(rows), width)


def _signatures(vectors: DataFrame, tables: int, functions: int, probes: int) -> DataFrame:
    """Adds ``sig``: the vertices of all tables, functions and probes, one after the other."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("v")
            sig: list = [None] * batch.num_rows
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                x = _matrix(lists, at, size)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                parts = [vertices(x, t, f, probes) for t in range(tables) for f in range(functions)]
                # a vector of one or two dimensions has fewer vertices than probes: its last one stands for the rest
                flat = np.concatenate([p[:, np.minimum(np.arange(probes), p.shape[1] - 1)] for p in parts], axis=1)
                for i, row in zip(at, flat):
                    sig[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.list_(pa.int32()))], [*batch.schema.names, "sig"])

    return map_arrow(vectors, run, "v array<double>, least_vec long, times long, sig array<int>")


def _bucket_keys(size: np.ndarray, table: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """64-bit names of buckets: vector length, table and the chosen vertices (last axis)."""
    h = (size.astype(np.uint64) << np.uint64(20)) + table.astype(np.uint64)
    for f in range(chosen.shape[-1]):
        h = (h ^ (chosen[..., f].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _first_shared(sig_a: np.ndarray, sig_b: np.ndarray, size: int, tables: int, functions: int, probes: int) -> np.ndarray:
    """For pairs of signatures: name of the first bucket that both are in."""
    a = sig_a.reshape(-1, tables, functions, probes)
    b = sig_b.reshape(-1, tables, functions, probes)
    both = (a[..., :, None] == b[..., None, :]).any(axis=-1)  # which of a's vertices b has
    slot = both.argmax(axis=-1)  # vertices are sorted: the least shared one
    least_vertex = np.take_along_axis(a, slot[..., None], axis=-1)[..., 0]
    table = both.any(axis=-1).all(axis=-1).argmax(axis=-1)
    return _bucket_keys(np.full(len(a), size), table, least_vertex[np.arange(len(a)), table])


def _close_pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, side: np.ndarray, least: float, few: int = 64, most: int = 100_000):
    """Pairs (i, j) of rows of one group whose cosine is ``least`` or more, in pieces of bounded size.

    Rows of a group are all of one side, then each meets each, or of two, then each meets the other
    side. Pairs of small groups are listed and compared together, large groups are multiplied.
    """
    one_sided = side[starts] == side[ends - 1]  # rows come sorted by side
    small = one_sided & (ends - starts <= few)
    last = np.repeat(np.where(small, ends, 0), ends - starts)
    count = np.maximum(last - np.arange(len(x)) - 1, 0)
    piece = np.cumsum(count) // most
    for n in np.unique(piece[count > 0]):
        rows = np.flatnonzero((piece == n) & (count > 0))
        i = np.repeat(rows, count[rows])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        near = np.einsum("ij,ij->i", x[i], x[j]) >= least
        yield i[near], j[near]
    for lo, hi, one in zip(starts[~small], ends[~small], one_sided[~small]):
        if one:
            i, j = np.nonzero(np.triu(x[lo:hi] @ x[lo:hi].T >= least, 1))
            yield i + lo, j + lo
        else:
            mid = lo + int(np.searchsorted(side[lo:hi], side[lo], "right"))
            i, j = np.nonzero(x[lo:mid] @ x[mid:hi].T >= least)
            yield i + lo, j + mid


def near_embeddings(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    least: float = LEAST_COSINE,
    recall: float = RECALL,
    probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Equal vectors form one class first; a class counts as often as it occurs. A class goes to
    ``probes ** functions`` buckets of each table, buckets of one are left out, and vectors meet only
    where they share a bucket; every candidate pair is verified by cosine in double precision and
    counts in its first shared bucket only. The number of functions follows the rows, so that buckets
    do not grow by chance partners; the number of tables follows ``recall``, the widest vector and the
    functions. A bucket of many is compared in blocks of ``block`` against each other, exactly, and
    gives counts and spanning stars, not pairs.

    Null, zero and non-finite vectors link with nothing; vectors of different lengths do not link.
    Rows without an id are neither linked nor counted, and come back with no links and a null
    component. Rows that repeat an id with the same vector are one vector.
    """
    shape = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(embedding)).alias("widest")).first()
    width = max(1, shape["widest"] or 1)
    functions = functions_for(shape["rows"], width, probes)
    tables = tables_for(width, functions, least, probes, recall)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    usable_rows = rows.filter(usable).dropDuplicates(["vec", "v"])
    # class by value: -0.0 and 0.0 are one number
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    members = usable_rows.select("vec", plain.alias("v"))
    grouped = members.groupBy("v").agg(F.min("vec").alias("least_vec"), F.count(F.lit(1)).alias("times"))
    numbered = _signatures(grouped, tables, functions, probes).withColumn("vec", F.monotonically_increasing_id())
    classes = materialise(numbered)  # written, so that the numbers stay

    def keys(batches: Batches) -> Batches:
        choice = np.stack(np.meshgrid(*[np.arange(probes)] * functions, indexing="ij"), axis=-1).reshape(-1, functions)
        slots = choice + np.arange(functions) * probes
        for batch in batches:
            vec, size = batch.column("vec").to_numpy(), batch.column("size").to_numpy()
            sig = _matrix(batch.column("sig"), np.arange(batch.num_rows), tables * functions * probes, np.int32)
            for table in range(tables):
                picked = sig[:, slots + table * functions * probes]  # rows, choices, functions
                key = _bucket_keys(np.repeat(size[:, None], len(choice), axis=1), np.full(picked.shape[:2], table), picked)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vec, len(choice))), pa.array(key.ravel())], ["vec", "key"])

    asked = map_arrow(classes.select("vec", F.size("v").alias("size"), "sig"), keys, "vec long, key long")
    crowded = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("vec", F.lit(3)), F.col("parts")).cast("int")
    # blocks of one bucket against each other, each pair of blocks once
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(F.least(p, F.col("own")).alias("i"), F.greatest(p, F.col("own")).alias("j")),
    )
    placed = (
        asked.join(crowded, "key")
        .select("vec", "key", parts.alias("parts"))
        .withColumn("own", own)
        .select("vec", "key", "own", F.explode(pairs).alias("pair"))
        .select("vec", F.xxhash64("key", "pair").alias("bucket"), "key", "own")
    )
    carried = (
        placed.join(classes.select("vec", "v", "times", "sig"), "vec")
        .withColumn("size", F.size("v"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "size", "own", "vec")
    )

    def link(batches: Batches) -> Batches:
        def linked_of(part: pa.Table, size: int):
            """Counts and stars of buckets whose vectors all have ``size`` numbers."""
            bucket, vec, own = (part.column(c).to_numpy() for c in ("bucket", "vec", "own"))
            again = np.concatenate([[False], (np.diff(bucket) == 0) & (np.diff(vec) == 0)])
            if again.any():  # names of two buckets of one vector fell together, or two probes did
                part = part.filter(pa.array(~again))
                bucket, vec, own = bucket[~again], vec[~again], own[~again]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
            ends = np.concatenate([starts[1:], [len(bucket)]])
            every = np.arange(len(bucket))
            x = _matrix(part.column("v").combine_chunks(), every, size)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            sig = _matrix(part.column("sig").combine_chunks(), every, tables * functions * probes, np.int32)
            key, times = part.column("key").to_numpy(), part.column("times").to_numpy()
            links, nodes, roots = np.zeros(len(vec), dtype=np.int64), [], []
            for i, j in _close_pairs(x, starts, ends, own, least):
                for at in range(0, len(i), 20_000):
                    p, q = i[at : at + 20_000], j[at : at + 20_000]
                    here = _first_shared(sig[p], sig[q], size, tables, functions, probes) == key[p]  # each pair counts in one bucket only
                    p, q = p[here], q[here]
                    np.add.at(links, p, times[q])
                    np.add.at(links, q, times[p])
                    if len(p):
                        node, root = forest(vec[p], vec[q])
                        nodes.append(node)
                        roots.append(root)
            none = np.empty(0, dtype=np.int64)
            return vec[links > 0], links[links > 0], np.concatenate([none, *nodes]), np.concatenate([none, *roots])

        def done(table: pa.Table) -> Batches:
            sizes = table.column("size").to_numpy()
            for size in np.unique(sizes):
                vec, links, node, root = linked_of(table.filter(pa.array(sizes == size)), int(size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([vec, node])), pa.array(np.concatenate([links, np.zeros(len(node), dtype=np.int64)])), pa.array(np.concatenate([vec, root]))],
                    ["vec", "links", "other"],
                )

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 4 * block:
                continue
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1], "left"))
            if whole:
                yield from done(table.slice(0, whole))
                rest = table.slice(whole).combine_chunks().to_batches()
                held, rows = rest, sum(x.num_rows for x in rest)
        if held:
            yield from done(pa.Table.from_batches(held))

    linked = materialise(map_arrow(carried, link, "vec long, links long, other long"))
    counts = linked.groupBy("vec").agg(F.sum("links").alias("links"))
    roots = components(linked.filter("other != vec").select(F.col("vec").alias("a"), F.col("other").alias("b")))
    placed_classes = (
        classes.select("vec", "v", "times", "least_vec")
        .join(counts, "vec", "left")
        .join(roots.withColumnRenamed("node", "vec"), "vec", "left")
        .withColumn("root", F.coalesce("component", "vec"))
    )
    firsts = placed_classes.groupBy("root").agg(F.min("least_vec").alias("component_id"))
    settled = placed_classes.join(firsts, "root").select(
        F.col("v").alias("class_v"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    found = rows.withColumn("usable", usable)
    return (
        found.join(settled, F.when(F.col("usable"), F.transform("v", lambda x: x + F.lit(0.0))) == F.col("class_v"), "left")
        .select(
            F.col("vec").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
