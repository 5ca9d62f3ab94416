"""Rows that old keys and limits confused: colliding texts of one id, oversized samples, deep paths, long addresses."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import decontamination
from threadloom.llm.common import load_tokenizer
from threadloom.llm.decontamination import contaminated, without_contaminated
from threadloom.llm.personal_data import without_personal_data
from threadloom.llm.samples import labelled_sample
from threadloom.llm.simhash import near_duplicates
from threadloom.llm.substrings import remove_repeats
from threadloom.llm.token_counts import token_counts
from threadloom.llm.toxicity import without_toxic
from threadloom.llm.url_filters import judge_urls

DOCS = "doc_id long, text string, `meta.lang` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def colliding():
    """Two texts of 70 words whose 64-bit hashes agree in their lower half."""
    rng, seen = random.Random(3), {}
    head = " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    for n in range(1_000_000):
        text = head + "".join(f" x{n}y{k}" for k in range(n % 7 + 4))
        low = xxhash.xxh64_intdigest(text, 42) & 0xFFFFFFFF
        if low in seen and len(seen[low].split()) != len(text.split()):
            return seen[low], text
        seen[low] = text
    raise AssertionError("no collision")


def test_colliding_texts_of_one_id(spark, colliding):
    one, two = colliding
    docs = frame(spark, [(7, one), (7, two), (7, two), (3, one)])
    tok = load_tokenizer("word_bpe_49k.json")
    want = sorted((i, len(t), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in [(7, one), (7, two), (7, two), (3, one)])
    assert sorted(tuple(r) for r in token_counts(docs, head=5).collect()) == want
    n = 60  # words that both share with the text of id 3
    kept = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect())
    assert kept == sorted([(3, len(one.split()), 0), (7, len(one.split()), len(one.split())), *[(7, len(two.split()), n)] * 2])
    assert near_duplicates(docs).select("_key").distinct().count() == 2
    different = frame(spark, [(7, one), (7, " ".join(reversed(two.split())))])
    assert corpus_pipeline.drop_near_duplicates(spark, different, "").count() == 2


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(6, "six"), (8, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(n, n % 2) for n in range(5, 9)], "doc_id long, toxic long")
    kept = {r["_text"] for r in labelled_sample(docs, labels, "toxic", 12_000, 1, 1).collect()}
    assert len(kept) == 3 and {"six", None} < kept
    assert labelled_sample(docs, labels, "toxic", 2, 1, 1).count() <= 2


def test_deep_paths_have_templates_of_their_own(spark):
    urls = [f"http://h{n % 4}.org/a/b/c/d/good/{n}" for n in range(40)] + [f"http://h{n % 4}.org/a/b/c/d/bad/{n}" for n in range(40)]
    urls += ["http://h1.org/a/b/c/d/bad/new/er/path", "http://h1.org/a/b/c/d/good/new/er/path", "http://h9.org/" + "x/" * 60, None]
    pages = spark.createDataFrame([(n, u, "s", 1, "f") for n, u in enumerate(urls)], "page_id long, url string, share string, template long, _Host string")
    rules = [("block", "org", "/a/b/c/d/bad/1"), ("allow", "org", "/a/b/c/d/good/")]
    judged = judge_urls(pages, rules=rules)
    assert judged.columns == ["page_id", "url", "share", "template", "_host", "_path", "_rule", "_template", "_share", "_verdict"]
    rows = {r["page_id"]: r for r in judged.collect()}
    assert len(rows) == len(urls)
    assert {rows[n]["_template"] for n in range(40)} == {"/a/b/c/d/good/*"} and {rows[n]["_template"] for n in range(40, 80)} == {"/a/b/c/d/bad/*"}
    assert {rows[n]["_verdict"] for n in range(40, 80)} == {"block"}  # learnt from those that the rule names
    assert rows[80]["_template"] == "/a/b/c/d/bad/*/*/*" and rows[82]["_template"] == "/*" * 60 and rows[83]["_template"] == ""


def test_spelt_addresses_of_any_length(spark):
    local, host = "x" * 200, ".".join("abcdefghijkl")
    rows = [(1, f"mail jane [at] {host} x"), (2, f"mail {local}[at]a [dot] b(dot)c{{dot}}d.e.f.com, x"), (3, "look [at] this")]
    got = {r["doc_id"]: r["text"] for r in without_personal_data(frame(spark, rows)).collect()}
    assert got == {1: "mail [email] x", 2: "mail [email], x", 3: "look [at] this"}


def test_columns_with_dots(spark):
    docs = frame(spark, [(n, f"some words of document number {n}") for n in range(8)] + [(None, None)])
    labels = spark.createDataFrame([(n, n % 2) for n in range(8)], "doc_id long, toxic long")
    bench = spark.createDataFrame([(1, "nothing of this kind is in there at all")], "item_id long, text string")
    for kept in (without_contaminated(docs, bench), corpus_pipeline.drop_near_duplicates(spark, docs, ""), without_personal_data(docs), without_toxic(docs, labels)):
        assert kept.columns == docs.columns and kept.count() > 0


def test_large_index_joins_places_without_words(spark, monkeypatch):
    rng = random.Random(9)
    items = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([5, 9, 20, 40]))) for _ in range(12)]
    rows = [(n, " ".join(f"w{rng.randrange(900)}" for _ in range(60)) + " " + items[n % 12] + " tail") for n in range(40)] + [(None, items[3]), (5, items[4]), (5, items[4]), (6, None), (7, "")]
    bench = spark.createDataFrame([*enumerate(items), (3, items[5]), (99, items[3]), (None, items[0])], "item_id long, text string")
    docs = frame(spark, rows)
    small = {tuple(r) for r in contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = contaminated(docs, bench)
        assert {tuple(r) for r in large.collect()} == small and len(small) > 40
        plan = large._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.split("\n") if "Project [seed" in line and "hit_id" in line]
    assert joins and not any("words" in line for line in joins)


def _exchanges(node):
    """(name and keys, rows written) of the exchanges of a plan that ran."""
    name = node.nodeName()
    if name == "Exchange":
        yield node.simpleString(1000), node.metrics().apply("shuffleRecordsWritten").value()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
    for child in inner or [node.children().apply(i) for i in range(node.children().size())]:
        yield from _exchanges(child)


def test_large_index_shuffles_few_places(spark, monkeypatch):
    rng = random.Random(4)
    items = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(12)]
    rows = [(n, " ".join(f"w{rng.randrange(5000)}" for _ in range(200)) + " " + items[n % 12][:90 if n < 12 else 0]) for n in range(100)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = contaminated(frame(spark, rows), bench)
        assert {(r["_id"], r["item_id"]) for r in found.collect()} == {(n, n) for n in range(12)}
        by_seed = [n for keys, n in _exchanges(found._jdf.queryExecution().executedPlan()) if "hashpartitioning(seed" in keys]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    asked = 3 * 200 * len(rows)  # masks and places
    assert len(by_seed) == 2 and sum(by_seed) < asked / 20


def test_pipeline_stage_with_large_index_shuffles_few_places(spark, monkeypatch, tmp_path):
    rng = random.Random(5)
    items = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(9)]
    rows = [(n, " ".join(f"w{rng.randrange(5000)}" for _ in range(200)) + " " + (items[n % 9] if n < 18 else "")) for n in range(90)] + [(90, None), (91, ""), (None, items[2]), (None, "kept")]
    spark.createDataFrame([*enumerate(items), (None, items[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(-1, "kept"), (90, ""), (91, ""), *rows[18:90]])
        by_seed = [n for keys, n in _exchanges(kept._jdf.queryExecution().executedPlan()) if "hashpartitioning(seed" in keys]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(by_seed) == 2 and sum(by_seed) < 3 * 200 * 90 / 10


@pytest.mark.parametrize("rows", [0, 1, 70, 3000])
def test_sieve_keeps_all_that_the_index_holds(spark, rows):
    index = spark.range(rows).select(F.xxhash64("id").alias("seed"))
    asked = spark.range(-20_000, rows).select("id", F.xxhash64("id").alias("seed"))
    kept = {r["id"] for r in decontamination.sieved(asked, index, rows).select("id").collect()}
    assert kept >= set(range(rows)) and len(kept) - rows <= 60
    crowded = {r["id"] for r in decontamination.sieved(asked, index, 1).select("id").collect()}  # a sieve too small for them
    assert crowded >= set(range(rows))
