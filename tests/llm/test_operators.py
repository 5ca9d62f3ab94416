"""Each operator against brute force on small tables, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import queries as q
from threadloom.llm.common import load_tokenizer
from threadloom.llm.components import components
from threadloom.llm.decontamination import contaminated, without_contaminated
from threadloom.llm.embeddings import functions_for, near_embeddings, tables_for
from threadloom.llm.packing import best_fit, pack
from threadloom.llm.quality import with_quality
from threadloom.llm.personal_data import find_personal_data, joined, without_personal_data
from threadloom.llm.simhash import hex_of, near_duplicates
from threadloom.llm.substrings import remove_repeats
from threadloom.llm.token_counts import token_counts
from threadloom.llm.toxicity import label_model, with_toxicity
from threadloom.llm.url_filters import judge_urls
from threadloom.llm.word_pieces import WordPieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, fp long, base string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "eps", "ζeta", "the", "of", "x1", "<|endoftext|>"]
    shared = [rng.choice(words) + str(rng.randint(0, 60)) for _ in range(130)]
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "lonely text"), (4, " \t\n")]
    for i in range(5, 45):
        own = [rng.choice(words) + str(rng.randint(0, 400)) for _ in range(rng.randint(1, 200))]
        if i % 3 == 0:
            cut = rng.randint(0, 60)
            own[len(own) // 2 : len(own) // 2] = shared[cut : cut + rng.randint(45, 70)]
        rows.append((i, " ".join(own)))
    rows += [(50, rows[-1][1]), (51, rows[-1][1] + " more"), (50, rows[-2][1]), (None, rows[-1][1]), (60, "w " * 30_000)]
    return rows


def test_word_pieces_equal_the_tokenizer():
    rng = random.Random(1)
    letters = "abcXYZ'stre0123.,!?<|>@ÀÖß×÷ªº­éİıſ́漢~"
    words = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)}) + [b"a<|endoftext|>b"]
    got = WordPieces("word_bpe_49k.json").packed(words)
    tok = load_tokenizer("word_bpe_49k.json")
    for word, ids in zip(words, got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(word.decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("head", [0, 20, 300_000])
def test_token_counts(spark, corpus, head):
    tok = load_tokenizer("word_bpe_49k.json")
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus)
    assert Counter(tuple(r) for r in token_counts(docs_of(spark, corpus), head=head).collect()) == want


def test_remove_repeats(spark, corpus):
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in corpus]
    for i, w in split:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, w in split:
        gone = {z for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for z in range(k, k + 50)}
        want[(i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())] += 1
    got = Counter(tuple(r) for r in remove_repeats(docs_of(spark, corpus)).collect())
    assert got == want
    assert sum(r[2] for r in got) > 300


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"w{n}" for n in range(3000)]
    item = [rng.choice(words) for _ in range(30)]
    worn = list(item)
    worn[7] = worn[15] = worn[22] = "changed"
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [
        (1, " ".join(filler(50) + item + filler(9))),
        (2, " ".join(filler(31) + [w.upper() + "," for w in item] + filler(5))),
        (3, " ".join(filler(40) + worn)),
        (4, " ".join(filler(200))),
        (5, " ".join(filler(20) + item[:8] + filler(20))),
        (6, None),
        (7, ""),
    ]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None), (None, " ".join(item))], "item_id long, text string")
    docs = docs_of(spark, rows)
    assert {(r["_id"], r["item_id"]) for r in contaminated(docs, bench).collect()} == {(1, 10), (2, 10), (3, 10)}
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7}
    assert without_contaminated(docs, bench.limit(0)).count() == 7


def test_decontamination_finds_every_accepted_window(spark):
    """All placements of as many substitutions as verification accepts, from even and odd words on."""
    items = {w: [f"w{w}x{k}" for k in range(w)] for w in range(8, 14)}
    rows, want = [], set()
    for w, item in items.items():
        spare = w // 5  # 0.8 of the places are equal
        for gone in combinations(range(w), spare):
            for before in ([], ["before"]):
                worn = ["other" if k in gone else word for k, word in enumerate(item)]
                want.add((len(rows), w, w - spare))
                rows.append((len(rows), " ".join(before + worn)))
    bench = spark.createDataFrame([(w, " ".join(item)) for w, item in items.items()], "item_id long, text string")
    found = {tuple(r) for r in contaminated(docs_of(spark, rows), bench).select("_id", "item_id", "matched").collect()}
    assert found == want


def test_decontamination_of_short_items_and_items_without_id(spark):
    bench = spark.createDataFrame([(1, "Solo"), (2, "two words"), (3, "a b c d e"), (4, "p q r s t u v"), (5, "..."), (None, "no id here")], "item_id long, text string")
    rows = [(1, "x solo y"), (2, "two, words"), (3, "two other words"), (4, "a b z d e"), (5, "b c d e"), (6, "a b z z e"), (7, "1 p q r s t u x"), (8, "not p q r x t u x"), (9, "No id here!"), (10, "no id"), (11, None), (12, "")]
    docs = docs_of(spark, rows)
    assert {tuple(r) for r in contaminated(docs, bench).select("_id", "item_id", "matched").collect()} == {(1, 1, 1), (2, 2, 2), (4, 3, 4), (5, 3, 4), (7, 4, 6)}
    assert {r["doc_id"] for r in without_contaminated(docs, bench).collect()} == {3, 6, 8, 10, 11, 12}


def test_near_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 20))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + rng.normal(size=20) * 0.15).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0] * 20) for i in range(30)] + [(300, None), (301, [0.0] * 20), (302, [float("nan")] + [1.0] * 19), (303, [None] + [1.0] * 19), (304, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(i, np.array(v)) for i, v in rows[:150]]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    component = np.array([i for i, _ in ok])
    for _ in range(200):
        component = np.array([min([component[k], *component[near[k]]]) for k in range(len(ok))])
    want = {i: (int(near[k].sum()), int(component[k])) for k, (i, _) in enumerate(ok)} | {i: (0, i) for i in range(300, 305)}
    for block in (1024, 16):  # whole buckets, and buckets in blocks
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_embeddings(frame, block=block).collect()}
        assert got == want
    assert near_embeddings(frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [2.0]), (4, [3.0]), (None, [3.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in near_embeddings(twice).fillna(-1).collect())
    assert got == [(-1, 0, -1, False), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]


@pytest.mark.parametrize("width", [64, 768])
def test_near_embeddings_recall_at_the_least_cosine(spark, width):
    """Pairs of cosine just above the threshold, whatever the width of the vectors."""
    rng = np.random.default_rng(width)
    a, b = rng.normal(size=(2, 250, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9001 * a + np.sqrt(1 - 0.9001**2) * b
    frame = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(np.concatenate([a, near]))], "vec_id long, embedding array<double>")
    found = near_embeddings(frame).filter("n_links = 1").count()
    assert found >= 0.97 * 500


def test_functions_follow_rows_and_tables_follow_width():
    assert [functions_for(n, 64) for n in (1, 10_000, 50_000, 10**8)] == [1, 4, 4, 6]
    assert tables_for(64, 3) < tables_for(384, 3) <= tables_for(1024, 3) < tables_for(1024, 4)


def test_near_duplicates(spark, corpus):
    def fingerprint(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = [(i, t) for i, t in corpus if i is not None]
    prints = [fingerprint(t) for _, t in rows]
    component = [i for i, _ in rows]
    for _ in range(8):
        component = [min(c for c, p in zip(component, prints) if (p ^ mine).bit_count() <= 4) for mine in prints]
    want = Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, component))
    got = near_duplicates(docs_of(spark, rows)).withColumn("hex", hex_of())
    assert Counter((r["doc_id"], r["hex"], r["component_id"]) for r in got.collect()) == want
    assert near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(n, n + 1) for n in range(40)] + [(100, 100 + n) for n in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, None), (9, 9)]
    root = {n: n for pair in links for n in pair if n is not None}
    for _ in range(300):
        for a, b in links:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    linked = {n for a, b in links if None not in (a, b) and a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}


def test_label_model_discounts_copies():
    rng = np.random.default_rng(6)
    truth = rng.random(2000) < 0.2
    good = (truth & (rng.random(2000) < 0.6)) | (rng.random(2000) < 0.01)
    other = (truth & (rng.random(2000) < 0.5)) | (rng.random(2000) < 0.01)
    votes = np.column_stack([good, good, good, other]).astype(np.int8)
    posterior, evidence, correlation = label_model(votes, truth.astype(int), 0.2, np.full(4, 2.0))
    assert correlation[0, 1] > 0.9 > 0.3 > correlation[0, 3]
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert (evidence > 1).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = q.op6_toxicity(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    few = with_toxicity(docs_of(spark, [(1, None), (2, ""), (None, "x")]), labels.limit(0), "score").collect()
    assert len(few) == 3 and few[0]["score"] == few[1]["score"] < 0.5


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.op9_quality(spark, sf).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    few = with_quality(docs_of(spark, [(1, None), (2, ""), (None, "x " * 9)]), labels.limit(0)).collect()
    assert [round(r["quality_score"], 6) for r in few] == [0.5] * 3


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/1?x", "http://a.example.com/en/2", "http://x.com", "ftp://b.net/es/", "nothing", None, "://h#/x", "http://c.net/fr/9/9/9/9", "http://o.org/q/1"]
    frame = spark.createDataFrame([(n, u, "z") for n, u in enumerate(urls)] + [(50, "http://b.net/es/", "z")] * 2, "page_id long, url string, html string")
    got = judge_urls(frame).collect()
    by_id = {r["page_id"]: (r["_host"], r["_path"], r["_rule"]) for r in got}
    assert len(got) == len(urls) + 2
    assert by_id[0] == ("www.example.com", "/en/1", "www.example.com/en/")
    assert by_id[1] == ("a.example.com", "/en/2", "example.com/en/")
    assert by_id[2] == ("x.com", "", None)
    assert by_id[3] == ("b.net", "/es/", "net/es/")
    assert by_id[4] == by_id[5] == ("", "", None)
    assert by_id[6] == ("h", "", None)
    assert by_id[7] == ("c.net", "/fr/9/9/9/9", "net/fr/")
    assert {r["_verdict"] for r in got} <= {"allow", "block"}
    assert judge_urls(frame.limit(0)).count() == 0


def test_packing(spark, corpus):
    tok = load_tokenizer("word_bpe_49k.json")
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")) for i, t in corpus]
    want = Counter((i, k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for i, a in ids for k in range(-(-len(a) // 2048)) for p in [a[2048 * k : 2048 * (k + 1)]])
    rows = pack(docs_of(spark, corpus)).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert pack(docs_of(spark, corpus).limit(0)).count() == 0


@pytest.mark.parametrize(("short", "long"), [((5, 25), [2000] * 10), ((4, 20), [1500])])
def test_short_texts_fill_bins_beside_long_ones(spark, short, long):
    rng = random.Random(8)
    sizes = [rng.randint(*short) for _ in range(10_000)] + long
    rows = best_fit(spark.createDataFrame(list(enumerate(sizes)), "id long, size long")).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(sizes)))
    used = Counter()
    for r in rows:
        used[r["bin"]] += sizes[r["id"]]
    assert max(used.values()) <= 2048
    assert len(used) <= -(-sum(sizes) // 2048) + 1


def test_best_fit_ranks_hot_sizes_in_slices(spark):
    """A third of all documents of one size: slices of few rows pack as the whole size does."""
    sizes = [700] * 1000 + [5 + n % 900 for n in range(2000)]
    frame = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    bins = []
    for slice_rows in (90, 10_000):
        places = defaultdict(list)
        for r in best_fit(frame, slice_rows=slice_rows).collect():
            places[r["bin"]].append((r["offset"], sizes[r["id"]]))
        for held in places.values():
            ends = [0, *(at + size for at, size in sorted(held))]
            assert [at for at, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
        assert sum(map(len, places.values())) == len(sizes)
        bins.append(len(places))
    assert bins[0] == bins[1]


PERSONAL = [
    (1, "a@b.co x@y z.q@@w.x.y"), (2, "1.2.3.4 256.1.1.1 1.2.3.4.5.6 00000000300.1.1.1"), (3, "4539 1488 0343 6467 and 4539148803436468 12345"),
    (4, "call +1 (988) 555-2485. or +12 +1 2 3 4 5 6 7 8"), (5, None), (6, ""), (7, "é +49 30 123456 mail: ab@cd.ef.gh. 10.0.0.255"), (8, "@" * 3000 + "a" * 5000), (9, "a.b@c.d@e.f"),
]


def test_personal_data(spark):
    def luhn(s):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda s: re.sub(r"\D", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    docs = spark.createDataFrame(PERSONAL, "doc_id long, text string")
    for r in find_personal_data(docs).withColumn("b", joined("base")).withColumn("s", joined("spans")).collect():
        text = dict(PERSONAL)[r["doc_id"]] or ""
        want = [f"{k}:{m.start()}:{m.end()}" for k, pattern, good in kinds for m in re.finditer(pattern, text) if good(m[0])]
        assert r["b"] == ",".join(want)
        assert set(want) <= set(r["s"].split(","))
    clean = {r["doc_id"]: r["text"] for r in without_personal_data(docs).collect()}
    assert clean[1].startswith("[email] x@y") and clean[5] is None and clean[6] == ""


def test_queries_digest(spark):
    row = q.op2_substring_dedup(spark, "/root/testdata/sf0.001").filter(F.col("n_removed") == 0).first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(b" ".join(text.encode().split())).hexdigest()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} < {r["doc_id"] for r in docs.select("doc_id").collect()}
    once = docs.union(docs)  # every row twice: one of each stays
    kept = corpus_pipeline.drop_near_duplicates(spark, once, sf)
    assert kept.columns == docs.columns
    assert kept.count() == corpus_pipeline.drop_near_duplicates(spark, docs, sf).count()
    assert corpus_pipeline.redact_personal_data(spark, docs, sf).columns == docs.columns
