"""Summaries of agent sessions once they go idle, and again when they go on and go idle anew.

The state of a session is its digest: one entry for each distinct fact (a file, a command, a
decision, the last action, the session's own fields), as the batch operators aggregate them. All of
it merges by least, greatest and count, so a batch of entries is folded into what its facts already
hold, and nothing that landed before is read again.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.functions.shipping import ship_package
from threadloom.operators.sessions import ENTRY_FIELDS, entry_facts, summarise_sessions

IDLE_SECONDS = 60
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_FACT = "kind STRING, key STRING"
_FIELDS = ", ".join(f"{c}_seq LONG, {c} {'LONG' if c == 'tokens' else 'STRING'}" for c in ENTRY_FIELDS)
_DIGEST = f"first_seq LONG, first_pos INT, first_value STRING, last_seq LONG, last_pos INT, last_value STRING, n LONG, {_FIELDS}"
_LATEST = ENTRY_FIELDS.index("tokens")  # the field of which the last one counts; of the others the first


PAGE_FACTS = 2_000  # facts of a session that a page of its state holds, on average at most


def _page_of(fact: tuple, pages: int) -> int:
    """Page of a fact among a power of two; with twice the pages it stays, or moves up by their number."""
    return zlib.crc32(repr(fact).encode()) & (pages - 1)


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Two digests of one fact as one."""
    if a is None:
        return b
    first, last = min(a[:3], b[:3], key=lambda x: x[:2]), max(a[3:6], b[3:6], key=lambda x: x[:2])
    fields = []
    for k in range(len(ENTRY_FIELDS)):
        pairs = [x[7 + 2 * k : 9 + 2 * k] for x in (a, b) if x[7 + 2 * k] is not None]
        fields += (max if k == _LATEST else min)(pairs, key=lambda x: x[0]) if pairs else (None, None)
    return (*first, *last, a[6] + b[6], *fields)


class SessionDigests(StatefulProcessor):
    """Folds entries into the digest of their session and emits all of it when the session's timer runs out.

    Every batch that holds a session sets its timer anew: ``idle`` after the batch came in, or, by event
    time, after the session's latest entry. Reading or writing a value of the state is a call from Python
    to the executor, so facts lie together in pages by their hash: one page for most sessions, twice as many
    each time a session outgrows ``PAGE_FACTS`` facts a page. No more than a page is in memory at once.
    """

    def __init__(self, key: str, idle_ms: int, event_time: bool, forget_ms: int | None):
        self.key, self.idle_ms, self.event_time, self.forget_ms = key, idle_ms, event_time, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "pages INT, facts LONG")
        self.pages = handle.getMapState("pages", "page INT", "digests BINARY", self.forget_ms)

    def _load(self, page: int, now: int) -> dict[tuple, tuple]:
        """The facts of a page that are not forgotten, each with its digest and when it was touched."""
        kept = self.pages.getValue((page,))
        facts = {} if kept is None else pickle.loads(kept[0])
        return facts if self.forget_ms is None else {f: x for f, x in facts.items() if x[1] + self.forget_ms > now}

    def _store(self, page: int, facts: dict[tuple, tuple]) -> None:
        self.pages.updateValue((page,), (pickle.dumps(facts, pickle.HIGHEST_PROTOCOL),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        fresh: dict[tuple, tuple] = {}
        latest = 0
        for batch in rows:
            kinds, names, seqs, places, values, moments, *columns = (
                [None if x is None or x != x else x for x in batch[c].tolist()] for c in ("kind", "key", "seq", "pos", "value", "at_ms", *ENTRY_FIELDS)
            )
            for fact, seq, pos, value, at, *fields in zip(zip(kinds, names), seqs, places, values, moments, *columns):
                given = [x for field in fields for x in ((None, None) if field is None else (int(seq), field))]
                if given[2 * _LATEST + 1] is not None:
                    given[2 * _LATEST + 1] = int(given[2 * _LATEST + 1])
                fresh[fact] = _merged(fresh.get(fact), (int(seq), int(pos), value, int(seq), int(pos), value, 1, *given))
                latest = max(latest, int(at))
        pages, count = (self.held.get() if self.held.exists() else None) or (1, 0)
        by_page: dict[int, list[tuple]] = {}
        for fact in fresh:
            by_page.setdefault(_page_of(fact, pages), []).append(fact)
        for page, touched in by_page.items():
            facts = self._load(page, now) if count else {}
            before = len(facts)
            for fact in touched:
                facts[fact] = (_merged(facts[fact][0] if fact in facts else None, fresh[fact]), now)
            self._store(page, facts)
            count += len(facts) - before
        while count > PAGE_FACTS * pages:
            for page in range(pages):
                halves: tuple[dict, dict] = ({}, {})
                for fact, held in self._load(page, now).items():
                    halves[_page_of(fact, 2 * pages) != page][fact] = held
                self._store(page, halves[0])
                self._store(page + pages, halves[1])
            pages *= 2
        self.held.update((pages, count))
        due = (latest if self.event_time else now) + self.idle_ms
        for timer in list(self.handle.listTimers()):
            due = max(due, timer)  # entries may arrive out of order
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 0 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        pages = self.held.get()[0] if self.held.exists() else 0
        for page in range(pages):
            held = [(key[0], *fact, *digest) for fact, (digest, _) in self._load(page, now).items()]
            if held:
                yield self._frame(held)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [field.split()[0] for field in f"{_FACT}, {_DIGEST}".split(", ")]
        frame = pd.DataFrame(rows, columns=[self.key, *names], dtype=object)
        return frame.astype({c: "Int64" for c in names if c in ("n", "tokens") or c.endswith(("_seq", "_pos"))})


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers and keyed state need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def idle_sessions(
    entries: DataFrame, idle_seconds: float = IDLE_SECONDS, at: str | None = None, lateness: str = "0 seconds", key: str = "path", forget_seconds: float | None = None
) -> DataFrame:
    """Stream of the facts of sessions that went ``idle_seconds`` without an entry, in the shape of ``session_facts``.

    A session is emitted whole: the facts of all its entries so far, also of those before it was emitted
    last. Idleness is measured by the clock of the cluster or, with ``at``, by that timestamp column, which
    may run ``lateness`` behind. ``seq`` must be a number that orders the entries of a session; rows
    without a key are left out. The state holds the distinct facts of all sessions; with ``forget_seconds``
    it drops facts that no entry touched for so long. Start the stream inside ``keyed_state``.
    """
    ship_package(entries.sparkSession)
    given = entries.filter(F.col(key).isNotNull())
    if at is not None:
        given = given.withWatermark(at, lateness)
    keys = (key, at) if at is not None else (key,)
    moment = F.unix_millis(F.col(at)) if at is not None else F.lit(0).cast("long")
    rows = entry_facts(given, keys).select(
        F.col(key).cast("string").alias(key), *keys[1:], "kind", "key", F.col("at.seq").cast("long").alias("seq"), "at.pos", "value", *ENTRY_FIELDS, moment.alias("at_ms")
    )
    forget = None if forget_seconds is None else int(forget_seconds * 1000)
    emitted = rows.groupBy(key).transformWithStateInPandas(
        SessionDigests(key, int(idle_seconds * 1000), at is not None, forget), f"`{key}` STRING, {_FACT}, {_DIGEST}", "append", "processingTime" if at is None else "eventTime"
    )
    place = lambda name: F.struct(F.col(f"{name}_seq").alias("seq"), F.col(f"{name}_pos").alias("pos")).alias(f"{name}_at")
    return emitted.select(key, "kind", "key", place("first"), place("last"), "first_value", "last_value", "n", *ENTRY_FIELDS)


def summarise_idle(sink: Callable[[DataFrame, int], None], key: str = "path") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for ``idle_sessions``: one summary of each session that went idle.

    ``sink`` should replace what it holds of that session, under the batch's number.
    """

    def run(facts: DataFrame, batch_id: int) -> None:
        sink(summarise_sessions(facts, key=key), batch_id)

    return run


CELLS = 4096  # pauses long that the buckets of ``session_windows`` are


def _joined(parts: DataFrame, keys: list[str], idle_us: int) -> DataFrame:
    """(keys, _first, _last, entries, _alone): neighbouring stretches of each key merged where no pause parts them."""
    by_time = Window.partitionBy(*keys).orderBy("_first")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(by_time) >= idle_us, F.lit(True))
    numbered = parts.withColumn("_open", opens.cast("long")).withColumn("_n", F.sum("_open").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_n").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("entries").alias("entries"))


def _batch_windows(entries: DataFrame, idle_us: int, at: str, key: str) -> DataFrame:
    """Stretches of any key without sorting it in one task.

    Entries of one cell, a pause wide, are never parted, so cells count them on the map side. Cells are
    merged inside buckets of ``CELLS`` cells; only a bucket's first and last stretch can go on in its
    neighbours, and those edges, two a bucket at most, are merged once more.
    """
    moment = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at)) if isinstance(entries.schema[at].dataType, T.TimestampNTZType) else F.unix_micros(F.col(at))
    cells = (
        entries.select(F.col(key).alias("_key"), moment.alias("_us")).filter("_us IS NOT NULL")
        .groupBy("_key", F.floor(F.col("_us") / idle_us).alias("_cell"))
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count(F.lit(1)).alias("entries"))
        .withColumn("_bucket", F.floor(F.col("_cell") / CELLS))
    )
    inside = _joined(cells, ["_key", "_bucket"], idle_us)
    in_bucket = Window.partitionBy("_key", "_bucket")
    edge = (F.col("_n") == 1) | (F.col("_n") == F.max("_n").over(in_bucket))
    marked = inside.withColumn("_edge", edge)
    across = _joined(marked.filter("_edge"), ["_key"], idle_us)
    whole = ["_key", "_first", "_last", "entries"]
    return marked.filter("NOT _edge").select(*whole).unionByName(across.select(*whole))


def session_windows(entries: DataFrame, idle: str = "60 seconds", lateness: str | None = None, at: str = "ts", key: str = "path") -> DataFrame:
    """Event-time form: (key, started, ended, entries) of every stretch without a longer pause.

    Works on batch and streaming input alike; rows without a time are left out. On a batch, a key of any
    size spreads over tasks. A stream closes a stretch once the watermark passes it and has to say how
    late entries may come: later ones are left out, as Spark's progress reports count
    (``numRowsDroppedByWatermark``).
    """
    if entries.isStreaming:
        if lateness is None:
            raise ValueError("a stream of entries needs its lateness, such as '1 day'")
        counted = entries.withWatermark(at, lateness).groupBy(key, F.session_window(at, idle).alias("w"))
        return counted.agg(F.count(F.lit(1)).alias("entries"), F.max(at).alias("ended")).select(key, F.col("w.start").alias("started"), "ended", "entries")
    kind = entries.schema[at].dataType
    idle_us = entries.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{idle}')").first()[0]

    def moment(us: str) -> Column:
        if isinstance(kind, T.TimestampNTZType):
            return F.timestamp_add("MICROSECOND", F.col(us), F.lit("1970-01-01").cast("timestamp_ntz"))
        return F.timestamp_micros(F.col(us)).cast(kind)

    windows = _batch_windows(entries, idle_us, at, key)
    return windows.select(F.col("_key").alias(key), moment("_first").alias("started"), moment("_last").alias("ended"), "entries")
