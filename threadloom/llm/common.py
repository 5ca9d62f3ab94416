"""What several operators of this subpackage share: row keys, Arrow helpers, fresh column names."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.functions.shipping import ship_package

Batches = Iterator[pa.RecordBatch]


def text_key(text: str | Column = "text") -> Column:
    """128 bits of the text that tell rows of one id, or of none, apart: repeated ids are safe join keys."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))  # a null text is not an empty one


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _key, _text): the columns that operators work on, whatever else ``docs`` carries."""
    return docs.select(F.col(doc_id).alias("_id"), text_key(text).alias("_key"), F.col(text).alias("_text"))


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, also for columns whose names hold dots."""
    ship_package(df.sparkSession)
    names = df.columns
    if not any("." in name or "`" in name for name in names):
        return df.mapInArrow(fn, schema)

    def renamed(batches: Batches) -> Batches:
        return fn(batch.rename_columns(names) for batch in batches)

    return df.toDF(*[f"c{n}" for n in range(len(names))]).mapInArrow(renamed, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, near the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str, frame: str | None = None) -> Column:
    """A column by its whole name, whatever characters it holds, of an aliased frame if given."""
    whole = "`" + name.replace("`", "``") + "`"
    return F.col(f"{frame}.{whole}" if frame else whole)


def tokenizer_file(name: str) -> str:
    """A tokenizer's place on the machine that asks: a path as it is, else a public one by name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


SIEVE_BITS = 1 << 25


class Sieve:
    """A bitmap of fixed size (4 MB) over 64-bit hashes: lets all given ones pass, and few others.

    Rows that fail need not be shuffled to a join that they cannot meet. What passes wrongly costs a
    little shuffle and nothing else, so results never depend on the size of the corpus.
    """

    def __init__(self, hashes: DataFrame, column: str):
        place = F.pmod(F.col(column), F.lit(SIEVE_BITS))
        words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits"))
        table = words.toArrow()  # SIEVE_BITS / 64 rows at most
        bitmap = np.zeros(SIEVE_BITS // 64, dtype=np.int64)
        bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy()
        self.shared = hashes.sparkSession.sparkContext.broadcast(bitmap)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        place = np.mod(hashes, SIEVE_BITS)
        return (self.shared.value[place >> 6] >> (place & 63)) & 1 == 1


def sized(batch: pa.RecordBatch, column: int, most: int = 16 << 20) -> Batches:
    """Row ranges of ``batch`` whose values of one column take about ``most`` bytes together, one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    blocks = np.cumsum(lengths) // most
    starts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [batch.num_rows]])
    for a, b in zip(starts[:-1], starts[1:]):
        yield batch.slice(a, b - a)


def id_and_text(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """(doc_id, _text) of ``docs``, columns taken by their whole names, and the DDL type of the id."""
    return docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("_text")), docs.schema[doc_id].dataType.simpleString()
