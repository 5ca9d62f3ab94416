"""Periodic runs, byte-level BPE and fill-in-the-middle against plain Python and the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from threadloom.llm import queries as q
from threadloom.llm.byte_bpe import LONGEST_ROW, Encoder, PairTable, decode_ids, encode_pieces, encode_texts, vocabulary
from threadloom.llm.fill_in_middle import Markers, fill_in_middle, restored, unit_ends
from threadloom.llm.periodic_runs import periodic_runs, runs_of_names, strongest, word_names

RANKS = "byte_bpe_50k.tiktoken"
DOCS = "doc_id long, text string, _text string, ids binary, runs long, decoded string, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", b"y", 1, "z", 2) for i, t in rows], DOCS)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def texts_of(seed: int) -> list[str]:
    rng = random.Random(seed)
    letters = ["the ", "ing", " ", "\n", "é", "漢", "a", "b", "'ll", "12", " ", "\x1c", "🙂", "<P>", "<|endoftext|>", "\t "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150)]


ODD = [(1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (None, "no id"), (None, None), (4, "word"), (4, "other text"), (5, "w " * 30_000)]


@pytest.fixture(scope="module")
def tables(spark):
    return {name: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select("doc_id", "text").collect()] for name in ["documents"]}


# ---- periodic runs --------------------------------------------------------------------------------


def brute_runs(w: list, least: int = 24) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, kept where no smaller period fits it."""
    found = []
    for period in range(1, len(w) // 3 + 1):
        x = 0
        while x + period < len(w):
            y = x
            while y + period < len(w) and w[y] == w[y + period]:
                y += 1
            if y > x:
                length, seg = y - x + period, w[x : y + period]
                if length >= max(least, 3 * period) and not any(seg[p:] == seg[:-p] for p in range(1, period)):
                    found.append((x, length, period))
            x = y + 1
    return sorted(found)


def collapse(w: list, runs: list) -> list:
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return [x for k, x in enumerate(w) if k not in gone]


def repetitive(seed: int, count: int) -> list[str]:
    rng, out = random.Random(seed), []
    for _ in range(count):
        words: list[str] = []
        while rng.random() < 0.8 and len(words) < 220:
            unit = [rng.choice("abç") for _ in range(rng.randint(1, rng.choice([2, 4, 12, 30])))]
            words += (unit * 12)[: rng.randint(1, 90)]
        out.append("  \n".join(words))
    return out


def test_runs_equal_brute_force(spark):
    rows = ODD + list(enumerate(repetitive(1, 200), 10))
    got = periodic_runs(docs_of(spark, rows))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    have = sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got.collect()), key=repr)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, len(w), 1)] if i == 5 else brute_runs(w)
        want.append((i, len(w), runs, " ".join(collapse(w, runs))))
    assert have == sorted(want, key=repr)
    assert sum(len(r[2]) for r in have) > 200


def test_runs_of_fibonacci_words_and_thresholds():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    names, _ = word_names([[c.encode() for c in b]])
    for least in (1, 6, 24):
        assert [tuple(r) for r in runs_of_names(names, least).tolist()] == brute_runs(list(b), least)
    assert len(runs_of_names(names, 1)) > 300
    with pytest.raises(ValueError):
        runs_of_names(names, 24, 2)


def test_strongest_run_is_exact(spark):
    big = 1 << 26
    runs = [(9, 3 * big + 2, big), (4, 3 * big + 3, big), (1, 3 * big + 3, big), (0, 30, 10)]
    df = spark.createDataFrame([(runs,), ([],), ([(5, 30, 10), (7, 60, 20)],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [None if r[0] is None else tuple(r[0]) for r in df.select(strongest()).collect()] == [runs[1], None, (5, 30, 10)]


def test_op11_query(spark, tables):
    want = {}
    for i, t in tables["documents"]:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", t or ""), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        runs = brute_runs(w) if h % 10 == 0 or n < 1500 else [tuple(r) for r in runs_of_names(word_names([[x.encode() for x in w]])[0]).tolist()]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        digest = best + (1000 * best[1] // best[2],) if best else (None,) * 4
        want[i] = (len(runs), *digest, sha("".join(f"{s},{n_},{p_}\n" for s, n_, p_ in runs)), sha(" ".join(collapse(w, runs))))
    got = q.op11_periodic_runs(spark, "/root/testdata/sf0.001")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert sum(v[0] for v in want.values()) > 10


# ---- byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def test_pair_table_with_full_clusters():
    rng = random.Random(7)
    pairs = {(rng.randrange(900), rng.randrange(900)): n for n in range(20_000)}
    table = PairTable([(a, b, rank) for (a, b), rank in pairs.items()])
    asked = list(pairs) + [(rng.randrange(900), rng.randrange(900)) for _ in range(20_000)] + [(5, -1), (-1, -1)]
    left, right = np.array(asked, dtype=np.int32).T
    assert table.rank(left, right).tolist() == [pairs.get(p, np.iinfo(np.int32).max) for p in asked]


def test_pieces_of_every_length(library):
    rng = random.Random(2)
    known = vocabulary(RANKS)
    pieces = [bytes(rng.choice(b"theinorabc \xc3\xa9\n") for _ in range(n)) for n in [*range(1, 140), 255, 256, 257, LONGEST_ROW - 1, LONGEST_ROW, LONGEST_ROW + 1, 5000]]
    pieces += [b"a" * n for n in (7, 64, LONGEST_ROW, 3 * LONGEST_ROW)] + [b""]
    for piece, ids in zip(pieces, encode_pieces(pieces, known)):
        assert unpack(ids) == (library._encode_single_piece(piece) if piece else [])


def test_code_points_split_and_encode_as_in_the_library(library):
    chars = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xA400), 0x1F642, 0xFFFF, 0x10FFFF, 0xE000, 0x200B, 0xFEFF]]
    texts = ["".join(f"a{c}1{c} {c}b" for c in chars[k : k + 50]) for k in range(0, len(chars), 50)]
    encoder = Encoder(RANKS)
    for text, ids in zip(texts, encoder.packed(texts)):
        assert unpack(ids) == library.encode_ordinary(text)


def test_long_texts_go_in_blocks_and_memory_stays_bounded(library):
    texts = [t * 9 for t in texts_of(3)]
    encoder = Encoder(RANKS, most=40)
    assert [unpack(i) for i in encoder.packed(texts, at_once=7)] == [library.encode_ordinary(t) for t in texts]


def test_encode_and_decode(spark, library):
    rows = ODD + list(enumerate(texts_of(4), 10))
    coded = decode_ids(encode_texts(docs_of(spark, rows)))
    assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    have = sorted(((r[0], r[1], unpack(r[2]), bytes(r[3])) for r in coded.collect()), key=repr)
    want = [(i, len(ids := library.encode_ordinary(t or "")), ids, (t or "").encode()) for i, t in rows]
    assert have == sorted(want, key=repr)
    clash = spark.createDataFrame([(None, "x"), (struct.pack("<I", 64), "x")], "ids binary, Decoded string")
    assert decode_ids(clash, into="ids").columns == ["Decoded", "ids"]
    assert [r[-1] for r in decode_ids(clash).collect()] == [None, bytearray(library.decode_single_token_bytes(64))]
    assert encode_texts(docs_of(spark, rows).limit(0)).count() == 0


def test_op12_query(spark, tables, library):
    want = {}
    for i, t in tables["documents"]:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode_bytes(ids)))
    assert {r[0]: tuple(r)[1:] for r in q.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()} == want


# ---- fill in the middle ---------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_of(i, text: str, rate: int = 50, spm: int = 80):
    units, digest = UNIT.findall(text), sha(f"42:{'' if i is None else i}")
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units():
    for text in ["", *texts_of(5), " " * 100_000, "x" * 100_000, " y" * 50_000 + "  "]:
        assert unit_ends(text) == [m.end() for m in UNIT.finditer(text)]


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (0, 80)])
def test_fill_in_middle(spark, rate, spm):
    rows = ODD + list(enumerate(texts_of(6), 10)) + [(n, "a<P <S<M> <\n<P") for n in range(900, 920)]
    made = fill_in_middle(docs_of(spark, rows), rate=rate, spm_rate=spm)
    have = made.withColumn("back", restored()).collect()
    want = [(i, *middle_of(i, t or "", rate, spm), t or "") for i, t in rows]
    assert sorted(map(tuple, have), key=repr) == sorted(want, key=repr)
    forms = {r["form"] for r in have}
    assert forms == ({"plain"} if not rate else {"plain", "psm", "spm"} if spm else {"plain", "psm"})


def test_other_markers(spark):
    markers = Markers("[a.", "[b*", "[c$")
    made = fill_in_middle(docs_of(spark, [(n, "one [a* two <P> ") for n in range(20)] + [(99, "with [b* in it")]), rate=100, markers=markers)
    rows = made.withColumn("back", restored(markers=markers)).collect()
    assert {(r["form"] == "plain", r["back"]) for r in rows} == {(False, "one [a* two <P> "), (True, "with [b* in it")}


def test_op13_query(spark, tables):
    want = {}
    for i, t in tables["documents"]:
        *facts, output = middle_of(i, t or "")
        want[i] = (*facts, sha(output), sha(t or ""))
    assert {r[0]: tuple(r)[1:] for r in q.op13_fill_in_middle(spark, "/root/testdata/sf0.001").collect()} == want


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "`doc.id` long, `my.text` string, `meta.lang` string")
    for made in (fill_in_middle(df, "doc.id", "my.text"), encode_texts(df, "doc.id", "my.text"), periodic_runs(df, "doc.id", "my.text")):
        assert made.select(F.col("doc_id")).first()[0] == 1
