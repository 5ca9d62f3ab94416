"""Byte-level BPE ids of texts and back, by merge rounds over padded matrices.

Texts are split by the vocabulary's pattern and every distinct piece of a batch is encoded once.
Pieces of similar length share a matrix, a row for each, its ids padded on the right. In a round
every row merges its leftmost pair of least rank: the rank of the merged bytes is the merged id.
A merge shortens its row by one, so each round drops one column, and rows without a pair to merge
leave the matrix. Ranks of pairs are kept beside the ids and only the two next to a merge are looked
up anew, in a hash table of all pairs that the vocabulary can merge.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadloom.llm.common import Batches, id_and_text, map_arrow, quoted, sized, tokenizer_file

VOCABULARY = "byte_bpe_50k.tiktoken"
LONGEST_ROW = 1024  # bytes; longer pieces keep their pairs in a heap
CELLS = 1 << 17  # of one matrix
NEVER = np.iinfo(np.int32).max  # rank of a pair that does not merge
PAD = -1


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Rank of every mergeable pair of ids: open addressing over arrays, probed for many pairs at once."""

    _EMPTY = np.uint64(2**64 - 1)
    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: list[tuple[int, int, int]]):
        left, right, rank = np.array(pairs, dtype=np.uint64).reshape(-1, 3).T
        bits = max(int(len(pairs) * 4).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self._EMPTY)
        self.ranks = np.full(1 << bits, NEVER, dtype=np.int32)
        keys = left << np.uint64(32) | right
        slots = self._slot(keys)
        while keys.size:
            free = self.keys[slots] == self._EMPTY
            self.keys[slots[free]] = keys[free]
            own = self.keys[slots] == keys  # of the keys that want one slot, one has it now
            self.ranks[slots[own]] = rank[own]
            keys, rank, slots = keys[~own], rank[~own], (slots[~own] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self._SPREAD) >> self.shift

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; padding merges with nothing."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self._slot(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.ranks[slots], NEVER)
        on = np.flatnonzero((seen != keys) & (seen != self._EMPTY))
        slots = slots[on]
        while on.size:
            slots = (slots + np.uint64(1)) & self.mask
            seen = self.keys[slots]
            hit = seen == keys[on]
            out[on[hit]] = self.ranks[slots[hit]]
            further = ~hit & (seen != self._EMPTY)
            on, slots = on[further], slots[further]
        return out


class Vocabulary:
    """Tokens by id, ids by token, and the pairs that merge."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        sizes = np.zeros(max(self.tokens) + 1, dtype=np.int64)
        for rank, token in self.tokens.items():
            sizes[rank] = len(token)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), dtype=np.uint8)

    @cached_property
    def pairs(self) -> PairTable:
        known = self.ids.get
        return PairTable(
            [(a, b, rank) for token, rank in self.ids.items() for k in range(1, len(token)) if (a := known(token[:k])) is not None and (b := known(token[k:])) is not None]
        )

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a row of ids, some 100 000 at a time."""
        out = []
        for at in range(0, len(ids), 100_000):
            some = ids[at : at + 100_000].astype(np.int64)
            size = self.sizes[some]
            shift = np.repeat(self.starts[some] - (np.cumsum(size) - size), size)
            out.append(self.bytes[shift + np.arange(shift.size)].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(tokenizer_file(name))


def merge_matrix(ids: np.ndarray, pairs: PairTable) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their merged ids, padded) of an (n, length) matrix, in groups as rows finish."""
    done = []
    rows = np.arange(len(ids))
    ranks = pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
    while rows.size:
        if not ranks.shape[1]:
            done.append((rows, ids))
            break
        at = ranks.argmin(axis=1)  # the first of the least: leftmost
        least = ranks[np.arange(rows.size), at]
        merges = least != NEVER
        if not merges.all():
            done.append((rows[~merges], ids[~merges]))
            rows, ids, ranks, at, least = rows[merges], ids[merges], ranks[merges], at[merges], least[merges]
        if not rows.size:
            break
        row, place = np.arange(rows.size), np.arange(ids.shape[1] - 1)
        ids[row, at] = least
        ids = np.where(place > at[:, None], ids[:, 1:], ids[:, :-1])
        ranks = np.where(place[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
        before, behind = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
        ranks[before, at[before] - 1] = pairs.rank(ids[before, at[before] - 1], ids[before, at[before]])
        ranks[behind, at[behind]] = pairs.rank(ids[behind, at[behind]], ids[behind, at[behind] + 1])
    return done


def merge_long(piece: bytes, known: Vocabulary) -> np.ndarray:
    """Ids of one long piece by the same order of merges: pairs wait in a heap, least rank and then leftmost first."""
    ids = known.of_byte[np.frombuffer(piece, dtype=np.uint8)]
    left = np.arange(-1, len(ids) - 1).tolist()
    right = np.arange(1, len(ids) + 1).tolist()
    first = known.pairs.rank(ids[:-1], ids[1:])
    some = np.flatnonzero(first != NEVER)
    heap = list(zip(first[some].tolist(), some.tolist(), ids[some].tolist(), ids[some + 1].tolist()))
    heapq.heapify(heap)
    ids, end, tokens, rank_of = ids.tolist(), len(ids), known.tokens, known.ids.get
    while heap:
        rank, at, a, b = heapq.heappop(heap)
        after = right[at]
        if ids[at] != a or after == end or ids[after] != b:
            continue  # one of the two has merged since
        ids[at], ids[after] = rank, None
        right[at] = right[after]
        if right[at] != end:
            left[right[at]] = at
        for x, y in ((left[at], at), (at, right[at])):
            if x >= 0 and y != end:
                merged = rank_of(tokens[ids[x]] + tokens[ids[y]])
                if merged is not None:
                    heapq.heappush(heap, (merged, x, ids[x], ids[y]))
    return np.array([i for i in ids if i is not None], dtype="<u4")


def encode_pieces(pieces: list[bytes], known: Vocabulary) -> list[bytes]:
    """Ids of each piece, four little-endian bytes each."""
    out: list[bytes] = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for n, piece in enumerate(pieces):
        whole = known.ids.get(piece)
        if whole is not None:  # a piece that is a token is that token, whatever its merges give
            out[n] = whole.to_bytes(4, "little")
        elif len(piece) > LONGEST_ROW:
            out[n] = merge_long(piece, known).tobytes()
        elif piece:
            buckets.setdefault((len(piece) - 1).bit_length(), []).append(n)
    for bits, members in buckets.items():
        members.sort(key=lambda n: len(pieces[n]))
        height = max(CELLS >> bits, 1)
        for start in range(0, len(members), height):
            some = members[start : start + height]
            width = len(pieces[some[-1]])
            spelt = np.frombuffer(b"".join(pieces[n].ljust(width, b"\0") for n in some), dtype=np.uint8).reshape(len(some), width)
            sizes = np.array([len(pieces[n]) for n in some])
            ids = np.where(np.arange(width) < sizes[:, None], known.of_byte[spelt], PAD)
            for rows, merged in merge_matrix(ids, known.pairs):
                kept = merged != PAD
                packed, ends = merged[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
                for row, a, b in zip(rows.tolist(), [0, *ends], ends):
                    out[some[row]] = packed[a:b]
    return out


class Encoder:
    """Ids of texts; remembers the ids of some ``most`` pieces between calls."""

    def __init__(self, name: str, pattern: str | None = None, most: int = 120_000):
        self.known, self.most = vocabulary(name), most
        self.split = regex.compile(pattern or public_pattern())
        self.ids: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.ids]
        if len(self.ids) + len(new) > self.most:  # what these pieces use stays
            self.ids = {p: self.ids[p] for p in pieces if p in self.ids}
        self.ids.update(zip(new, encode_pieces([p.encode() for p in new], self.known)))

    def packed(self, texts: list[str], at_once: int = 200_000) -> list[bytes]:
        """Ids of each text, four little-endian bytes each; texts that may hold more than ``at_once`` pieces go block by block."""
        split = [self.split.findall(t) if len(t) <= 4 * at_once else None for t in texts]
        self._learn({p for pieces in split for p in pieces or ()})
        out = [b"".join(map(self.ids.__getitem__, pieces or ())) for pieces in split]
        for n, pieces in enumerate(split):
            if pieces is None:
                blocks, found = [], self.split.finditer(texts[n])
                while block := [m.group() for m in islice(found, at_once)]:
                    self._learn(set(block))
                    blocks.append(b"".join(map(self.ids.__getitem__, block)))
                out[n] = b"".join(blocks)
        return out


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """One row (doc_id, n_tokens, ids) for each row of ``docs``; ``ids`` holds little-endian unsigned 32-bit ids.

    Ids are those of the tiktoken library without special tokens. A null text counts as empty and has
    no ids; rows that repeat an id are encoded each by itself; other columns are left out.
    """
    source, id_type = id_and_text(docs, doc_id, text)

    def encode(batches: Batches) -> Batches:
        encoder = Encoder(name, pattern)
        for batch in batches:
            for part in sized(batch, 1, 1 << 20):
                ids = encoder.packed([t or "" for t in part.column(1).to_pylist()])
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_arrow(source, encode, f"doc_id {id_type}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, ids: str = "ids", into: str = "decoded", name: str = VOCABULARY) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; a column named ``into`` is replaced, null ids give null."""
    kept = [c for c in encoded.columns if c.lower() != into.lower()]
    source = encoded.select(*[quoted(c).alias(f"c{n}") for n, c in enumerate([*kept, ids])])
    at = len(kept)

    def decode(batches: Batches) -> Batches:
        known = vocabulary(name)
        for batch in batches:
            for part in sized(batch, at, 2 << 20):
                out = [None if i is None else known.decode(np.frombuffer(i, dtype="<u4")) for i in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(out, pa.binary())], [*part.schema.names[:at], into])

    schema = T.StructType([*source.schema.fields[:at], T.StructField(into, T.BinaryType())])
    return map_arrow(source, decode, schema).toDF(*kept, into)
