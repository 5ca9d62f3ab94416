"""Lexicons kept as tables: every term that a text contains, by an Aho-Corasick automaton.

The automaton reads a text once, whatever the number of terms. It is built once in each Python
worker from a list of terms whose size is checked before it is shared; longer lexicons are split into
parts of that size, each of which reads the texts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.shipping import ship_package

PART_BYTES = 4 << 20  # of terms that one automaton holds; its nodes take some fifty times that in a worker
SHARED_BYTES = 16 << 20  # of term rows that every executor may hold; more of them are joined by shuffle
_built: dict[str, object] = {}


def _automaton(token: str, shared):
    """The automaton over a shared list of terms; a worker keeps the last one it built."""
    import ahocorasick

    if token not in _built:
        _built.clear()
        automaton = ahocorasick.Automaton()
        for number, term in enumerate(shared.value):
            automaton.add_word(term, number)
        automaton.make_automaton()
        _built[token] = automaton
    return _built[token]


def _with_matches(texts: DataFrame, text: str, terms: list[str], into: str) -> DataFrame:
    """``texts`` with the numbers of the terms that ``text`` contains, each once, in order."""
    shared, token = texts.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex
    at, names = texts.columns.index(text), [*texts.columns, into]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(token, shared)
        for batch in batches:
            found = [sorted({n for _, n in automaton.iter(t)}) if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names)

    schema = T.StructType([*texts.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])
    return texts.mapInArrow(find, schema)


def contained_terms(texts: DataFrame, terms: DataFrame, text: str, term: str = "keyword", part_bytes: int = PART_BYTES) -> DataFrame:
    """``texts`` joined with every row of ``terms`` whose term its ``text`` contains.

    Null texts and terms match nothing, an empty term matches every text. Names of the two tables must
    differ. Terms are compared as they are: lower both sides for matches without regard to case.
    """
    ship_package(texts.sparkSession)
    distinct = terms.select(F.col(term).alias("_term")).filter("_term <> ''").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("_term") + 8), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in terms.columns), F.lit(16 * len(terms.columns)))
    rows_size, empties = terms.agg(F.coalesce(F.sum(width), F.lit(0)), F.count_if(F.col(term) == "")).first()
    found = []
    for part in range(parts):
        held = distinct.filter(F.pmod(F.xxhash64("_term"), F.lit(parts)) == part)
        words = sorted(held.toArrow().column(0).to_pylist())  # about ``part_bytes`` of them
        if not words:
            continue
        hits = _with_matches(texts, text, words, "_found").withColumn("_number", F.explode("_found")).drop("_found")
        numbers = texts.sparkSession.createDataFrame(pa.table({"_number": pa.array(range(len(words)), pa.int32()), "_term": pa.array(words, pa.string())}))
        known = terms.join(numbers, F.col(term) == F.col("_term")).drop("_term")
        found.append(hits.join(F.broadcast(known) if rows_size <= SHARED_BYTES else known, "_number").drop("_number"))
    if found and not empties:
        return reduce(DataFrame.unionByName, found)
    empty = terms.filter(F.col(term) == "")
    whole = texts.filter(F.col(text).isNotNull()).withColumn("_every", F.lit("")).join(empty, F.col("_every") == F.col(term)).drop("_every")
    return reduce(DataFrame.unionByName, [*found, whole])
