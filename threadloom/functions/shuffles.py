"""Lineage cuts and joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.storage import run_folder

_PIECE = 64


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(run_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan dealt to all cores where its files give fewer splits than that.

    For scans before work that costs far more than moving a row, such as parsing. Tables with enough
    splits stay as they are, as do streams.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins many rows to at most one lookup row per key, where a single key may own a third of the rows.

    Keys without skew cost nothing extra. Where both sides are shuffled for the join, adaptive
    execution splits the partitions of hot keys as it finds them.
    """
    return rows.join(lookup, list(on), how)


def hash_filter(wanted: DataFrame, *columns: str) -> Callable[..., Column]:
    """A test that passes every row whose columns hash like some row of ``wanted``, and few others.

    Hashes set bits of one array, sixteen for each wanted row and 16 MB at most, which becomes a constant
    of the plan. Beyond some 100 million rows it lets more through; what passes wrongly must be joined away.
    """
    spark = wanted.sparkSession
    words = 1 << min(max((wanted.count() // 4).bit_length(), 10), 21)

    def place(*values: Column) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(*values), F.lit(words * 64))
        return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")

    word, bit = place(*[F.col(c) for c in columns])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    sets = wanted.groupBy(word.alias("id")).agg(F.bit_or(one).alias("bits"))
    dense = spark.range(words).join(sets, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    bitmap = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bitmap")).scalar()

    def passes(*values: Column) -> Column:
        word, bit = place(*values)
        return F.call_function("shiftright", F.get(bitmap, word.cast("int")), bit).bitwiseAND(F.lit(1).cast("long")) == 1

    return passes


def contained_tokens(
    tokens: DataFrame,
    texts: DataFrame,
    key: str,
    run_pattern: str,
    shortest: int,
    longest: int = 8,
) -> DataFrame:
    """Rows of ``tokens(key, token)`` whose token is a substring of some text of the same key.

    A token made only of characters that ``run_pattern`` matches lies inside one run of such
    characters, so texts shrink to their distinct runs. Runs are cut into windows of two pieces, a
    piece as long as the tokens sought in it (``_PIECE`` characters, or the next power of two for
    longer tokens, where a key has any); from each start in the first piece goes a gram of the
    token's length, and those of ``longest`` characters take along what follows them for longer
    tokens. The search becomes an equi-join on (key, piece, gram) whose work grows with the length of
    the texts, also of a single long run: no task pairs a key's tokens with its texts.
    """
    wanted = tokens.filter(F.length("token") >= shortest).select(
        "*",
        F.left("token", F.least(F.length("token"), F.lit(longest))).alias("_gram"),
        F.greatest(F.lit(_PIECE), F.pow(F.lit(2), F.ceil(F.log2(F.length("token")))).cast("int")).alias("_piece"),
    )
    runs = (
        texts.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(run_pattern), F.lit(0))).alias("_run"))
        .filter(F.length("_run") >= shortest)
        .distinct()
    )
    wide = wanted.filter(F.col("_piece") > _PIECE).select(key, "_piece").distinct()
    long_runs = runs.filter(F.length("_run") > _PIECE).join(wide, key).select(key, "_run", "_piece")
    cut = runs.withColumn("_piece", F.lit(_PIECE)).unionByName(long_runs)
    pieces = F.regexp_extract_all("_run", F.concat(F.lit("(?s).{1,"), F.col("_piece").cast("string"), F.lit("}")), F.lit(0))
    windows = (
        cut.select(key, "_piece", pieces.alias("_pieces"))
        .select(key, "_piece", F.explode(F.transform("_pieces", lambda p, i: F.concat(p, F.coalesce(F.get("_pieces", i + 1), F.lit(""))))).alias("_window"))
    )
    asked = hash_filter(wanted.select(key, "_gram").distinct(), key, "_gram")
    least = F.when(F.col("_piece") == _PIECE, F.lit(shortest)).otherwise(F.lit(longest))
    most = F.least(F.length("_window"), F.lit(longest))
    last = F.least(F.length("_window") - F.col("_size") + 1, F.col("_piece"))
    grams = (
        windows.filter(most >= least)
        .select(key, "_piece", "_window", F.explode(F.sequence(least, most)).alias("_size"))
        .select(key, "_piece", "_window", "_size", F.explode(F.sequence(F.lit(1), last)).alias("_start"))
        .withColumn("_gram", F.substr("_window", F.col("_start"), F.col("_size")))
        .filter(asked(F.col(key), F.col("_gram")))
        .select(
            key,
            "_piece",
            "_gram",
            F.when(F.col("_size") == longest, F.substr("_window", F.col("_start"), F.col("_piece"))).alias("_tail"),
        )
        .distinct()
    )
    t, g = wanted.alias("_wanted"), grams.alias("_grams")
    hit = (
        (F.col(f"_wanted.{key}") == F.col(f"_grams.{key}"))
        & (F.col("_wanted._piece") == F.col("_grams._piece"))
        & (F.col("_wanted._gram") == F.col("_grams._gram"))
        & ((F.length("_wanted.token") < longest) | F.col("_grams._tail").startswith(F.col("_wanted.token")))
    )
    return t.join(g, hit, "left_semi").drop("_gram", "_piece")
