"""Personal data by aggregated weak supervision.

Four kinds are found: email, ip, card, phone. Base spans match fixed patterns and checks and always
stay. Looser candidates get votes of regex, gazetteer and context labelers; expectation-maximisation
estimates each labeler's reliability from the votes of the whole corpus, with base spans as known
positives, and its posterior labels train the classifier that decides on the candidates.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Batches, fresh, map_arrow, quoted

KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins: what follows a run decides for all its digits.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SPELT_AT = re.compile(r"[\[({]\x20?at\x20?[\])}]", re.IGNORECASE)
_SPELT_RIGHT = re.compile(r"\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]++)++", re.IGNORECASE)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|0[0-9]{1,4}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9-])")

# Gazetteers and context words
_TLDS = frozenset("com org net edu gov io co uk de fr es it nl eu us info biz".split())
_ISSUERS = re.compile(r"(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)")
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|address|correo|courriel|kontakt)\b", re.IGNORECASE),
    "ip": re.compile(r"\b(?:ip|host|server|login|client|addr(?:ess)?)\b", re.IGNORECASE),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b", re.IGNORECASE),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b", re.IGNORECASE),
}
_AGAINST = re.compile(r"\b(?:isbn|issn|order|invoice|version|release|page|id|no|nr|ref|section|date)\b\W{0,3}\Z", re.IGNORECASE)
LABELERS = 6  # pattern strict, check passed, gazetteer, context before, context against, stands alone

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _local_start(text: str, end: int, free: int = 0) -> int:
    """Where the run of local characters before ``end`` begins, not before ``free``."""
    start = end
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    return start


def _emails(text: str) -> list[Span]:
    """Around each @: the run of local characters before it, not into the match before, and a host with a dot."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, free)
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_and_near(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, by kind and start, and candidates: failed matches and looser forms clear of base spans."""
    base, near = _emails(text), []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            plain = [p.lstrip("0") or "0" for p in m[0].split(".")]
            good = all(len(p) <= 3 and int(p) <= 255 for p in plain)
            (base if good else near).append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _only_digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                base.append(("card", *m.span()))
            elif 13 <= len(digits) <= 19:
                near.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (base if 8 <= len(_only_digits(m[0])) <= 15 else near).append(("phone", *m.span()))
        near += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    for m in _SPELT_AT.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        left, right = _local_start(text, end), _SPELT_RIGHT.match(text, m.end())
        if left < end and right:
            near.append(("email", left, right.end()))
    if near:
        taken = sorted((s, e) for _, s, e in base)
        starts = np.array([s for s, _ in taken] or [0])
        clear = []
        for kind, s, e in sorted(near, key=lambda x: (x[1], -x[2], x[0])):
            k = int(np.searchsorted(starts, e)) - 1 if taken else -1
            if (k < 0 or taken[k][1] <= s) and (not clear or clear[-1][2] <= s):
                clear.append((kind, s, e))
        near = clear
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(base, key=lambda x: (order[x[0]], x[1])), near


def votes(text: str, span: Span, base: bool) -> tuple[int, ...]:
    """Of each labeler: 1 for personal data, -1 against, 0 abstains."""
    kind, s, e = span
    found, before = text[s:e], text[max(0, s - 40) : s]
    digits = _only_digits(found)
    if kind == "email":
        strict, check = 1 if base else 0, 1 if re.search(r"[A-Za-z]", found) else -1
        known = 1 if re.split(r"[\W_]+", found.rstrip("])} ").lower())[-1] in _TLDS else 0
    elif kind == "ip":
        parts = [int((p.lstrip("0") or "0")[:6]) for p in found.split(".")]
        strict, check, known = 1 if base else 0, 1 if max(parts) <= 255 else -1, 0
    elif kind == "card":
        strict, check, known = 1 if base else 0, 1 if luhn(digits) else -1, 1 if _ISSUERS.match(digits) else -1
    else:
        strict, check = 1 if base else 0, 1 if 8 <= len(digits) <= 15 else -1
        known = 1 if found.startswith(("+", "(", "00")) else 0
    context = 1 if _CONTEXT[kind].search(before) else 0
    against = -1 if _AGAINST.search(before) else 0
    alone = 1 if (s == 0 or text[s - 1].isspace() or text[s - 1] in "(<:;,\"'") and (e == len(text) or text[e].isspace() or text[e] in ").,;:>\"'") else -1
    return strict, check, known, context, against, alone


def learn(patterns: Counter, rounds: int = 30) -> dict[str, np.ndarray]:
    """Weights of the span classifier of each kind, bias last, from counts of (kind, is base, votes).

    A labeler has its rates of 1, 0 and -1 among true and false spans, estimated by EM; base spans are
    true. The posterior labels train a logistic regression on the votes. The number of patterns has a
    bound (3 to the power of labelers), so counts of a whole corpus fit here.
    """
    weights = {}
    for kind in KINDS:
        rows = [(b, v, n) for (k, b, v), n in sorted(patterns.items()) if k == kind]
        v = np.array([r[1] for r in rows], dtype=np.int64).reshape(-1, LABELERS)
        n, known = np.array([r[2] for r in rows], dtype=np.float64), np.array([r[0] for r in rows], dtype=bool)
        # starting point and weak prior: labelers are right four times out of five; candidates are rarely true
        posterior = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(np.log(4) * v[:, 1:].sum(axis=1) - 2.0, -20, 20))))
        believed = {1: (0.6, 0.15), 0: (0.25, 0.25), -1: (0.15, 0.6)}
        for _ in range(rounds):
            logit = np.full(len(rows), -1.0)
            for k in range(1, LABELERS):  # the first labeler is what makes a span base
                for value, (true, false) in believed.items():
                    here = v[:, k] == value
                    rate1 = ((posterior * n)[here].sum() + 20 * true) / ((posterior * n).sum() + 20)
                    rate0 = (((1 - posterior) * n)[here].sum() + 20 * false) / (((1 - posterior) * n).sum() + 20)
                    logit[here] += np.log(rate1) - np.log(rate0)
            posterior = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(logit, -20, 20))))
        x = np.column_stack([v[:, 1:], np.ones(len(rows))])
        w = np.array([1.0] * (LABELERS - 1) + [-2.0])
        share = n / max(n.sum(), 1)
        for _ in range(500):
            error = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - posterior
            w -= 1.0 * (x.T @ (share * error) + 1e-3 * (w - np.array([1.0] * (LABELERS - 1) + [-2.0])))
        weights[kind] = w
    return weights


def _patterns(docs: DataFrame, text: str) -> Counter:
    def run(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    base, near = base_and_near(t)
                    for spans, is_base in ((base, True), (near, False)):
                        counts.update((span[0], is_base, votes(t, span, is_base)) for span in spans)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([list(k[2]) for k in keys], pa.list_(pa.int32())), pa.array([counts[k] for k in keys], pa.int64())],
            ["kind", "base", "votes", "n"],
        )

    counted = map_arrow(docs.select(text), run, "kind string, base boolean, votes array<int>, n long").groupBy("kind", "base", "votes").agg(F.sum("n").alias("n"))
    return Counter({(r["kind"], r["base"], tuple(r["votes"])): r["n"] for r in counted.collect()})


def _accepted(text: str, weights: dict[str, np.ndarray]) -> tuple[list[Span], list[Span]]:
    base, near = base_and_near(text)
    added = [s for s in near if float(np.dot(weights[s[0]], (*votes(text, s, False)[1:], 1))) > 0]
    order = {k: n for n, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda x: (order[x[0]], x[1]))


def find_personal_data(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """``docs`` with its text replaced by span lists: ``base`` and ``spans``, arrays of (kind, start, end).

    Starts and ends are code points, ends exclusive; both lists are sorted by kind, then start. With
    ``redacted``, a column of the text with each span replaced by its kind in brackets is added. A null
    text has no spans and stays null. The new names must not clash with columns of ``docs``.
    """
    weights = learn(_patterns(docs, text))
    kept = [c for c in docs.columns if c != text]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [_accepted(t or "", weights) for t in batch.column(text).to_pylist()]
            lists = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f[n]] for f in found], span_type) for n in (0, 1)]
            columns, names = [batch.column(c) for c in kept] + lists, [*kept, base, spans]
            if redacted:
                columns.append(pa.array([redact(t, f[1]) for t, f in zip(batch.column(text).to_pylist(), found)], pa.string()))
                names.append(redacted)
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "array<struct<kind:string,start:bigint,end:bigint>>"
    added = [f"`{base}` {kinds}", f"`{spans}` {kinds}"] + ([f"`{redacted}` string"] if redacted else [])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), *added])
    return map_arrow(docs, run, schema)


def redact(text: str | None, spans: list[Span]) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:  # a span inside another goes with it
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in its texts replaced by kinds in brackets; all rows and columns stay."""
    base, spans, redacted = fresh(docs, "_base", "_spans", "_redacted")
    found = find_personal_data(docs, text, base, spans, redacted)
    return found.select(*[F.col(redacted).alias(text) if c == text else quoted(c) for c in docs.columns])


def joined(spans: str):
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
