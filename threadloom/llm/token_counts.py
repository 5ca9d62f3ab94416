"""Token counts of whole texts, from the pieces of their distinct pre-tokens.

A pre-token is a run of bytes without ASCII white space. The tokenizer drops white space and
splits there, and its normaliser never joins what white space parts, so a text's count is the sum
over its pre-tokens, and each distinct pre-token needs to be encoded once in the whole corpus.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.storage import materialise
from threadloom.llm.common import Batches, as_bytes, keyed, map_arrow
from threadloom.llm.word_pieces import WordPieces

TOKENIZER = "word_bpe_49k.json"
HEAD_BYTES = 48  # longest pre-token that may be broadcast


def pretoken_frequencies(docs: DataFrame, text: str = "text", hold: int = 300_000) -> DataFrame:
    """(pretoken, freq) over all texts. A task sums what it reads, at most ``hold`` pre-tokens at a time."""

    def count(batches: Batches) -> Batches:
        seen: Counter[bytes] = Counter()

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["pretoken", "freq"])

        for batch in batches:
            for t in as_bytes(batch.column(0)):
                if t:
                    seen.update(t.split())
                if len(seen) >= hold:
                    yield held()
                    seen.clear()
        yield held()

    counted = map_arrow(docs.select(text), count, "pretoken binary, freq long")
    return counted.groupBy("pretoken").agg(F.sum("freq").alias("freq"))


def piece_counts(pretokens: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds ``pieces``, how many tokens each pre-token gives."""

    def encode(batches: Batches) -> Batches:
        known = WordPieces(tokenizer)
        for batch in batches:
            pieces = [len(ids) // 4 for ids in known.packed(as_bytes(batch.column("pretoken")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], [*batch.schema.names, "pieces"])

    return map_arrow(pretokens.select("pretoken", "freq"), encode, "pretoken binary, freq long, pieces long")


def frequent_from(vocabulary: DataFrame, most: int) -> int | None:
    """The least frequency that at most ``most`` pre-tokens reach, from a histogram of some hundred bins."""
    bins = vocabulary.groupBy(F.floor(F.log2("freq") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("freq").alias("least"))
    held, least = 0, None
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
        held += row["n"]
        if held > most:
            break
        least = row["least"]
    return least


def token_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    head: int = 300_000,
) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens) for each row of ``docs``.

    Frequent pre-tokens, at most ``head`` of at most 48 bytes, are broadcast; all others are joined
    to the documents' pre-token frequencies, so no size of vocabulary breaks it. A null text counts
    as empty, an empty one has no tokens; rows that repeat an id are counted each by itself.
    """
    spark = docs.sparkSession
    vocabulary = materialise(piece_counts(pretoken_frequencies(docs, text), tokenizer))
    least = frequent_from(vocabulary, head)
    common = (F.col("freq") >= (least or 0)) & (F.length("pretoken") <= HEAD_BYTES) & F.lit(least is not None)
    frequent = spark.sparkContext.broadcast({bytes(r[0]): r[1] for r in vocabulary.filter(common).select("pretoken", "pieces").collect()})

    def weigh(batches: Batches) -> Batches:
        known = frequent.value.get
        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            rows: list[tuple] = []
            for doc, key, t in zip(ids, keys, texts):
                total = 0
                for word, n in Counter((t or b"").split()).items():
                    pieces = known(word)
                    if pieces is None:
                        rows.append((doc, key, None, 0, word, n))
                    else:
                        total += pieces * n
                # no pre-token has a space: this key meets no pre-token, and spreads evenly
                rows.append((doc, key, len(t or b""), total, b" " + key, 0))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_id", "_key", "n_bytes", "known", "pretoken", "n"])

    weighed = map_arrow(keyed(docs, doc_id, text), weigh, "_id long, _key binary, n_bytes long, known long, pretoken binary, n long")
    rare = vocabulary.filter(~common).select("pretoken", "pieces")
    summed = (
        weighed.join(rare, "pretoken", "left")
        .groupBy("_id", "_key")
        .agg(
            F.sum(F.col("known") + F.coalesce(F.col("pieces") * F.col("n"), F.lit(0))).alias("tokens"),
            F.max("n_bytes").alias("n_bytes"),
            F.count("n_bytes").alias("rows"),  # rows alike in id and text were summed together
        )
    )
    return summed.select(
        F.col("_id").alias("doc_id"),
        "n_bytes",
        (F.col("tokens") / F.col("rows")).cast("long").alias("n_tokens"),
        F.explode(F.expr("sequence(1L, rows)")).alias("_copy"),
    ).drop("_copy")
