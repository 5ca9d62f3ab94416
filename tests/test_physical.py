"""Helpers that must hold for any distribution of keys, against plain Python."""

import random

from pyspark.sql import functions as F

from threadloom.functions.ordering import number_rows, ord_buckets, ord_of, top_rows
from threadloom.functions.shuffles import contained_tokens, hash_filter, lookup_join, spread


def test_number_rows_counts_across_buckets(spark):
    rng = random.Random(1)
    rows = list({(rng.choice("aaab"), rng.randrange(3), rng.randrange(40), rng.randrange(5)) for _ in range(500)})
    df = spark.createDataFrame(rows, "k STRING, src INT, seq INT, pos INT").withColumn("ord", ord_of(src=F.col("src"), seq=F.col("seq"), pos=F.col("pos")))
    got = {(r.k, r.src, r.seq, r.pos): r.n for r in number_rows(df, ["k"], ["ord"], ord_buckets(width=2)).collect()}
    for key in "ab":
        ordered = sorted(r for r in rows if r[0] == key)
        assert [got[r] for r in ordered] == list(range(1, len(ordered) + 1))


def test_top_rows_with_salt(spark):
    df = spark.range(1000).select((F.col("id") % 3 * 0).alias("k"), F.col("id").alias("v"))
    got = top_rows(df, ["k"], [F.col("v").desc()], 7, salt=F.col("v")).collect()
    assert sorted((r["rank"], r.v) for r in got) == [(i + 1, 999 - i) for i in range(7)]


def test_lookup_join_joins_like_a_join(spark):
    left = spark.range(200).select((F.col("id") % 2).alias("k"), "id")
    right = spark.createDataFrame([(0, "x")], "k LONG, v STRING")
    assert lookup_join(left, right, ["k"]).count() == 100
    assert lookup_join(left, right, ["k"], "left_anti").count() == 100
    assert lookup_join(left, right, ["k"], "left").count() == 200


def test_contained_tokens_is_substring_search(spark):
    rng = random.Random(2)

    def word(n):
        return "".join(rng.choice("ab_-") for _ in range(n))

    texts = [(k, " ".join(word(rng.randrange(1, 30)) for _ in range(6)).upper()) for k in "xy" for _ in range(4)]
    tokens = sorted({(k, word(n)) for k in "xyz" for n in range(3, 14) for _ in range(12)})
    got = contained_tokens(
        spark.createDataFrame(tokens, "k STRING, token STRING"), spark.createDataFrame(texts, "k STRING, text STRING"), "k", "[a-z0-9_-]+", shortest=3
    )
    want = [t for t in tokens if any(k == t[0] and t[1] in text.lower() for k, text in texts)]
    assert want and len(want) < len(tokens)
    assert sorted((r.k, r.token) for r in got.collect()) == want


def test_hash_filter_passes_all_wanted_and_few_others(spark):
    wanted = spark.range(0, 5000, 5).select(F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("gram"))
    passes = hash_filter(wanted, "k", "gram")
    asked = spark.range(5000).select(F.explode(F.array(*[F.lit(f"k{i}") for i in range(3)])).alias("k"), F.col("id").cast("string").alias("gram"))
    kept = asked.filter(passes(F.col("k"), F.col("gram")))
    assert kept.join(wanted, ["k", "gram"], "left_semi").count() == 1000
    assert kept.count() < 1700  # of 15 000
    assert asked.filter(hash_filter(wanted.limit(0), "k", "gram")(F.col("k"), F.col("gram"))).count() == 0


def test_spread_deals_few_splits_only(spark):
    few, many = spark.range(10).coalesce(1), spark.range(0, 100, 1, 50)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many) is many
