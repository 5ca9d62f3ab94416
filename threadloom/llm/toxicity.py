"""Toxicity scores from weak supervision.

Voters are lexicon entries (words), patterns (word beginnings, shouting, repeated marks, letters
spelt with digits) that labelled rows show to lean towards toxic texts. A generative model of their
votes estimates each voter's accuracy by expectation-maximisation and the correlations between voters
within a class; its posterior labels, correlated votes discounted, train a sparse linear classifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Batches, fresh, map_arrow, quoted
from threadloom.llm.samples import held_out, labelled_sample

SAMPLE_ROWS = 12_000
FOLDS, HELD_OUT = 5, 0
BITS = 22
VOTERS = 400
LEAST_PURITY = 0.5  # share of toxic rows among those that a voter fires on
LEAST_GAIN = 15.0  # log-likelihood that a voter's lean must be worth, well above what chance gives among a million
_WORD = re.compile(r"[^\W\d_]+")
_SHAPES = {
    "marks": re.compile(r"[!?]{2,}"),
    "spelt with digits": re.compile(r"\b(?=\w*\d)[a-z]+[013457@$]+[a-z]+\b", re.IGNORECASE),
    "shouting": re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}"),
}


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind} {value}") & ((1 << BITS) - 1)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed lexicon entry and beginnings of a lower-case word."""
    starts = [_slot("starts", word[:n]) for n in (3, 4, 5) if len(word) > n]
    return (_slot("word", word), *starts)


def text_features(text: str, known: dict[str, tuple[int, ...]]) -> set[int]:
    """Hashed features present in a text; ``known`` keeps those of words seen before."""
    out: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        found = known.get(word)
        if found is None:
            found = known[word] = word_features(word)
        out.update(found)
    out.update(_slot("shape", name) for name, pattern in _SHAPES.items() if pattern.search(text))
    return out


def label_model(votes: np.ndarray, marks: np.ndarray, prior: float, start: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of ``votes`` (rows x voters, 0 or 1), evidence and correlations of voters.

    ``marks`` are the annotators' labels: one more voter, which says toxic or clean and never abstains. Its
    accuracy is estimated like the others', from 0.95 on. Any other voter says toxic or abstains; its rates among toxic and clean rows are estimated by EM from the
    evidence ``start``. Voters that fire together beyond what the class explains are correlated: in a
    row, each firing voter's evidence is divided by one plus its correlations with the others that fire,
    so that copies of one voter weigh as one.
    """
    n, voters = votes.shape
    v = votes.astype(np.float32)
    evidence, correlation = start.astype(np.float64), np.zeros((voters, voters), dtype=np.float32)
    posterior, agrees = np.full(n, prior), 0.95
    for step in range(rounds):
        shared = 1 + v @ correlation
        annotated = np.where(marks == 1, 1.0, -1.0) * np.log(agrees / (1 - agrees))
        logit = np.log(prior / (1 - prior)) + annotated + (v / shared) @ evidence
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        agreed = posterior[marks == 1].sum() + (1 - posterior[marks != 1]).sum()
        agrees = min(0.999, (agreed + 1) / (n + 2))
        weight = posterior.sum()
        alpha = (posterior @ v + 1) / (weight + 2)
        beta = ((1 - posterior) @ v + 1) / (n - weight + 2)
        evidence = np.log(alpha) - np.log(beta)
        if step % 4 == 0:
            centred = ((v - alpha) * np.sqrt(posterior)[:, None]).astype(np.float32)
            cov = centred.T @ centred / max(weight, 1)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            correlation = np.clip(cov / np.outer(scale, scale), 0, 1)
            correlation[correlation < 2 / np.sqrt(max(weight, 4))] = 0  # within what chance gives
            np.fill_diagonal(correlation, 0)
    return posterior, evidence, correlation


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.empty(0, np.int64), *rows])


def fit(texts: Iterable[str], labels: np.ndarray, voters: int = VOTERS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature slots, weights, bias) of the linear classifier, from the texts of a bounded sample.

    Without any toxic row the classifier says clean; without any row its bias is -2.
    """
    known: dict[str, tuple[int, ...]] = {}
    rows: list[np.ndarray] = []
    for t in texts:
        if len(known) > 200_000:
            known.clear()
        rows.append(np.fromiter(text_features(t, known), dtype=np.int64))
    n1, n0 = int((labels == 1).sum()), int((labels != 1).sum())
    nothing = np.empty(0, np.int64), np.empty(0), -2.0
    if not n1:
        return nothing
    row, slot = _csr(rows)
    toxic = np.bincount(slot[labels[row] == 1], minlength=1 << BITS)
    clean = np.bincount(slot[labels[row] != 1], minlength=1 << BITS)
    lean = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    prior, total = n1 / (n1 + n0), toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(toxic * np.log(toxic / (total * prior))) + np.nan_to_num(clean * np.log(clean / (total * (1 - prior))))
    chosen = np.flatnonzero((gain >= LEAST_GAIN) & ((toxic + 0.5) / (total + 1) >= LEAST_PURITY))
    chosen = chosen[np.argsort(-gain[chosen], kind="stable")][:voters]
    if not len(chosen):
        return nothing
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    votes = np.zeros((len(rows), len(chosen)), dtype=np.int8)
    hit = place[slot] >= 0
    votes[row[hit], place[slot[hit]]] = 1
    posterior, _, _ = label_model(votes, labels, min(prior, 0.5), lean[chosen])

    # linear classifier on posterior labels: proximal gradient, so that most weights are zero
    used = np.flatnonzero((toxic + clean >= 4) & (np.abs(lean) >= 0.7))
    place[:] = -1
    place[used] = np.arange(len(used))
    keep = place[slot] >= 0
    row, col = row[keep], place[slot[keep]]
    w, bias = np.zeros(len(used)), float(np.log(n1 / n0)) if n0 else 0.0
    penalty, gathered, bias_gathered = 0.5, np.ones(len(used)), 1.0
    for _ in range(200):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - posterior
        gradient = np.bincount(col, weights=error[row], minlength=len(used))
        gathered += gradient**2
        bias_gathered += error.sum() ** 2
        rate = 0.3 / np.sqrt(gathered)
        w -= rate * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        bias -= 0.3 * error.sum() / np.sqrt(bias_gathered)
    nonzero = np.flatnonzero(w)
    return used[nonzero], w[nonzero], bias


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id") -> tuple[dict[int, float], float]:
    """Weights by feature slot, and bias, fitted in one task on at most ``rows`` labelled documents."""
    sample = labelled_sample(docs, labels, "toxic", rows, FOLDS, HELD_OUT, doc_id)

    def run(batches: Batches) -> Batches:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        slots, weights, bias = fit((t or "" for t in texts), np.array(marks, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *slots.tolist()], pa.int64()), pa.array([bias, *weights.tolist()], pa.float64())], ["slot", "weight"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("_text"), "_label")
    model = {r["slot"]: r["weight"] for r in map_arrow(ordered, run, "slot long, weight double").collect()}
    return model, model.pop(-1, -2.0)  # nothing runs on an empty sample


def with_toxicity(docs: DataFrame, labels: DataFrame, score: str = "toxicity", rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 added; a null text scores as an empty one, which gets the bias alone.

    ``labels(doc_id, toxic)`` trains the model, rows of the held-out fold excepted. The score is a
    function of the text only. ``score`` must be a new column name.
    """
    weights, bias = train(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # no more entries than features of the sample

    def run(batches: Batches) -> Batches:
        active = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for t in batch.column(text).to_pylist():
                if len(known) > 300_000:
                    known.clear()
                found: set[int] = set()
                for word in set(_WORD.findall((t or "").lower())):
                    slots = known.get(word)
                    if slots is None:
                        slots = known[word] = tuple(s for s in word_features(word) if s in active)
                    if slots:
                        found.update(slots)
                for name, pattern in _SHAPES.items():
                    slot = _slot("shape", name)
                    if slot in active and pattern.search(t or ""):
                        found.add(slot)
                z = bias + sum(active[s] for s in sorted(found))
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score}` double"])
    return map_arrow(docs, run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with their own columns."""
    (score,) = fresh(docs, "_toxicity")
    return with_toxicity(docs, labels, score, rows).filter(F.col(score) < threshold).select(*map(quoted, docs.columns))


__all__ = ["fit", "held_out", "label_model", "train", "with_toxicity", "without_toxic"]
