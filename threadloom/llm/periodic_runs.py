"""Periodic runs of words: stretches that repeat a shorter sequence three times or more.

The dictionary of basic factors names every factor (word sequence) whose length is a power of two,
so that equal factors have equal names; a length's names come from pairs of names of half the
length. At length m = 2^k, a place's successor is the next one where its factor occurs. Inside a run
of period q with m/2 < q <= m, the factor at every place has its successor q words on, because it is
longer than the period and a shorter distance would be a shorter period. So successors that lie
within m form arithmetic progressions of difference q that start at neighbouring places, and a
stretch of neighbouring places with one distance q is extended to the run it belongs to: it starts
where the stretch starts and ends m + q - 1 words behind the stretch's last place. Each period
belongs to one length, so no run is proposed twice.

A place whose factor occurs only once in its text can start no longer factor that repeats, so each
length looks only at what is left of the last one, and plain prose is done after a few words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Batches, id_and_text, map_arrow, sized

LEAST_WORDS = 24
LEAST_PERIODS = 3


def word_names(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts): all texts behind each other, a place of its own between two; equal words of one text share a name."""
    names, starts, used = [], [], 0
    for words in texts:
        starts.append(len(names))
        own: dict[bytes, int] = {}
        names += [own.setdefault(w, used + len(own)) for w in words]
        names.append(used + len(own))
        used += len(own) + 1
    return np.array(names, dtype=np.int64), np.array(starts, dtype=np.int64)


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, same, name): places sorted by key and then place, whether each has the key of the one before, and its class."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    return order, same, np.cumsum(~same) - 1


def runs_of_names(names: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``least_words`` words and ``least_periods`` periods, by start and period.

    ``least_periods`` is three or more: two periods need not hold a factor longer than the period twice.
    """
    if least_periods < 3:
        raise ValueError("runs are found from three periods on")
    found, size, k = [], len(names), 0
    places, keys = np.arange(size), names
    name_at = np.full(size, -1, dtype=np.int64)
    while places.size:
        m = 1 << k
        order, same, name = _classes(keys)
        sorted_places = places[order]
        # places with a successor, and how far it is; a factor that occurs once is of no further use
        has_next = np.append(same[1:], False)
        at, step = sorted_places[:-1][has_next[:-1]], np.diff(sorted_places)[has_next[:-1]]
        near = (step <= m) & (step * 2 > m)
        at, step = at[near], step[near]
        by_place = np.argsort(at)
        at, step = at[by_place], step[by_place]
        if at.size:
            first = np.ones(len(at), dtype=bool)
            first[1:] = (np.diff(at) != 1) | (np.diff(step) != 0)
            begin = np.flatnonzero(first)
            last = np.append(begin[1:], len(at)) - 1
            start, period = at[begin], step[begin]
            length = at[last] - start + period + m
            enough = length >= np.maximum(least_words, least_periods * period)
            found.append(np.stack([start[enough], length[enough], period[enough]], axis=1))
        repeated = same | has_next
        name_at[:] = -1
        name_at[sorted_places[repeated]] = name[repeated]
        places = np.sort(sorted_places[repeated])
        places = places[places + m < size]
        places = places[name_at[places + m] >= 0]
        keys = name_at[places] * size + name_at[places + m]
        k += 1
    rows = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``size`` words stay when every run keeps its first period only."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """One row (doc_id, n_words, runs, collapsed) for each row of ``docs``.

    ``runs`` lists {start, length, period} of all runs, by start and then period; words are what lies
    between ASCII white space, numbered from 0. ``collapsed`` is the text with every run cut to its
    first period, its words joined by single spaces. A null text has no words, no runs and an empty
    ``collapsed``; rows that repeat an id are judged each by itself; other columns are left out.
    """
    source, id_type = id_and_text(docs, doc_id, text)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Batches) -> Batches:
        for batch in batches:
            for part in sized(batch, 1, 4 << 20):
                split = [(t or "").encode().split() for t in part.column(1).to_pylist()]
                names, starts = word_names(split)
                rows = runs_of_names(names, least_words, least_periods)
                ends = np.append(np.searchsorted(rows[:, 0], starts), len(rows))
                collapsed = []
                for n, words in enumerate(split):
                    own = rows[ends[n] : ends[n + 1]]
                    own[:, 0] -= starts[n]
                    if len(own):
                        words = [words[k] for k in np.flatnonzero(kept_words(len(words), own)).tolist()]
                    collapsed.append(b" ".join(words).decode())
                spans = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(run))
                columns = [pa.array([len(w) for w in split], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "runs", "collapsed"])

    return map_arrow(source, find, f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run with the most periods as an exact ratio; of equal ones the first. Null where there is none."""
    best = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.reduce(runs, best, lambda a, b: F.when(more(a, b), b).otherwise(a))
