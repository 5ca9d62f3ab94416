"""Quality scores from a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Batches, map_arrow
from threadloom.llm.samples import labelled_sample

SAMPLE_ROWS = 12_000
FOLDS, HELD_OUT = 3, 1
BITS = 16  # slots of hashed words
RANK = 8
BINS = 8
_EDGES = [0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.75]
_STATS = ("capitals", "marks", "digits", "odd words", "distinct words", "most frequent word", "distinct lines", "word length", "length", "declared length")
STRUCTURE = len(_STATS) * BINS
_LETTERS = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-Z]")
_MARK = re.compile(r"[^\w\s.,;:'\"()-]")
_DIGIT = re.compile(r"[0-9]")


def structure(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[int]:
    """One bin of each statistic: shares by fixed edges, lengths by powers of four."""
    chars, n = max(len(text), 1), max(len(words), 1)
    lines = text.split("\n")
    shares = (
        len(_UPPER.findall(text)) / chars,
        len(_MARK.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        sum(c for w, c in counts.items() if not _LETTERS.search(w)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(lines)) / len(lines),
        min(0.99, chars / n / 20),
    )
    bins = [sum(s > e for e in _EDGES) for s in shares]
    bins.append(min(BINS - 1, int(math.log(chars, 4))))
    bins.append(0 if n_chars is None or n_chars < 1 else min(BINS - 1, int(math.log(n_chars, 4)) + 1))
    return [k * BINS + b for k, b in enumerate(bins)]


class Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = self[word] = STRUCTURE + (xxhash.xxh32_intdigest(word) & ((1 << BITS) - 1))
        return slot


_words = Words()


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: words by the logarithm of their counts, of length one together, and structure."""
    words = text.split()
    counts = Counter(words)
    slots = np.fromiter((_words[w] for w in counts), dtype=np.int64, count=len(counts))
    values = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    values /= max(np.sqrt((values**2).sum()), 1e-9)
    own = structure(text, words, counts, n_chars)
    return np.concatenate([own, slots]).astype(np.int64), np.concatenate([np.full(len(own), 0.5), values])


def score_rows(row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int, w: np.ndarray, v: np.ndarray, bias: float):
    """Logits: bias + sum w x + half of (sum v x) squared less the sum of squares, in linear time."""
    linear = np.bincount(row, weights=w[slot] * value, minlength=n)
    vx = v[slot] * value[:, None]
    sums = np.stack([np.bincount(row, weights=vx[:, k], minlength=n) for k in range(v.shape[1])], axis=1)
    squares = np.bincount(row, weights=(vx**2).sum(axis=1), minlength=n)
    return bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), vx, sums


def fit(texts: list[str], n_chars: list[int | None], labels: np.ndarray, rank: int = RANK, epochs: int = 12, seed: int = 9):
    """(w, v, bias) by adaptive gradient steps on mini-batches of a bounded sample."""
    size = STRUCTURE + (1 << BITS)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(size), rng.normal(0, 0.05, (size, rank)), 0.0
    n = len(texts)
    if not n:
        return w, v * 0, 0.0
    rows = [features(t, c) for t, c in zip(texts, n_chars)]
    y = (labels == 1).astype(np.float64)
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    gw, gv = np.full(size, 0.1), np.full((size, rank), 0.1)
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 0.1 if epoch < epochs // 2 else 0.05
        for at in range(0, n, 128):
            part = order[at : at + 128]
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            slot, value = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            z, vx, sums = score_rows(row, slot, value, len(part), w, v, bias)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            used, inverse = np.unique(slot, return_inverse=True)
            ex = error[row] * value
            grad_w = np.bincount(inverse, weights=ex, minlength=len(used)) + 1e-3 * w[used]
            pair = ex[:, None] * (sums[row] - vx)
            grad_v = np.stack([np.bincount(inverse, weights=pair[:, k], minlength=len(used)) for k in range(rank)], axis=1) + 1e-3 * v[used]
            gw[used] += grad_w**2
            gv[used] += grad_v**2
            w[used] -= rate * grad_w / np.sqrt(gw[used])
            v[used] -= rate * grad_v / np.sqrt(gv[used])
            bias -= 0.01 * error.mean()
    return w, v, bias


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits in one task on at most ``rows`` labelled documents; the model's size is fixed by BITS and RANK."""
    sample = labelled_sample(docs, labels, "quality", rows, FOLDS, HELD_OUT, "doc_id", ("n_chars",))

    def run(batches: Batches) -> Batches:
        texts, chars, marks = [], [], []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            marks += batch.column(1).to_pylist()
            chars += batch.column(2).to_pylist()
        w, v, bias = fit(texts, chars, np.array(marks, dtype=np.int64))
        blob = np.concatenate([[bias], w, v.ravel()]).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["model"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("_text"), "_label")
    fitted, size = map_arrow(ordered, run, "model binary").first(), STRUCTURE + (1 << BITS)
    if fitted is None:  # nothing runs on an empty sample
        return np.zeros(size), np.zeros((size, RANK)), 0.0
    flat = np.frombuffer(bytes(fitted["model"]), dtype="<f4").astype(np.float64)
    return flat[1 : size + 1], flat[size + 1 :].reshape(size, -1), float(flat[0])


def with_quality(docs: DataFrame, labels: DataFrame, score: str = "quality_score", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score) for each row of ``docs(doc_id, text, n_chars)``; a null text scores as an empty one.

    ``labels(doc_id, quality)`` trains the model, rows of the held-out fold excepted. A score depends on
    the text and the declared number of characters, which may be null.
    """
    narrow = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(x.astype(np.float32) if isinstance(x, np.ndarray) else x for x in train(narrow, labels, rows)))

    def run(batches: Batches) -> Batches:
        w, v, bias = shared.value
        for batch in batches:
            scores = []
            texts, chars = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(texts), 64):
                rows = [features(t or "", c) for t, c in zip(texts[at : at + 64], chars[at : at + 64])]
                row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
                slot, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
                z, _, _ = score_rows(row, slot, value, len(rows), w, v, bias)
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            flat = np.concatenate([np.empty(0), *scores])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat)], ["doc_id", score])

    return map_arrow(narrow, run, f"doc_id long, `{score}` double")
