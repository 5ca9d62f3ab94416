"""Token ids of words, with a short way for Latin ones.

The tokenizer's normaliser and splitter cost several times what its merges do. Words of printable
ASCII and Latin-1 letters, which normalising leaves alone but for their case, are split here by the
same pattern, and only their parts go through the merges, each part once. All other words, and those
that may hold a special string, go through the whole tokenizer.
"""

from __future__ import annotations

import json
import re
import struct

from threadloom.llm.common import load_tokenizer, tokenizer_file

# The splitter of word_bpe_49k.json on lower-case printable ASCII and Latin-1 letters.
_SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordPieces:
    """Ids of words; remembers the ids of at most ``most`` parts."""

    def __init__(self, tokenizer: str, most: int = 300_000):
        self.tok = load_tokenizer(tokenizer)
        self.most, self.parts = most, {}
        self.letters = _byte_letters()
        with open(tokenizer_file(tokenizer)) as f:
            spec = json.load(f)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splitters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [s.get("pattern", {}).get("Regex") for s in splitters if s.get("type") == "Split"]
        self.short = kinds == ["NFC", "Replace", "Lowercase"] and patterns == [_SPLITTER]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= self.most:
                self.parts.clear()
            spelt = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            tokens = [t.id for t in self.tok.model.tokenize(spelt)]
            ids = self.parts[part] = struct.pack(f"<{len(tokens)}I", *tokens)
        return ids

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, four little-endian bytes each; words must hold no white space."""
        out: list[bytes] = [b""] * len(words)
        whole: list[int] = []
        plain, split, part = _PLAIN.fullmatch, _PART.findall, self._part
        for n, raw in enumerate(words):
            word = raw.decode("utf-8", "replace")
            if self.short and plain(word) and "<|" not in word:
                parts = split(word.lower())
                out[n] = part(parts[0]) if len(parts) == 1 else b"".join(map(part, parts))
            else:
                whole.append(n)
        for at in range(0, len(whole), 2000):
            some = whole[at : at + 2000]
            texts = [words[n].decode("utf-8", "replace") for n in some]
            for n, e in zip(some, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                out[n] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out
