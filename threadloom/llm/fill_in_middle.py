"""Fill-in-the-middle training texts: prefix, middle and suffix of a document in a new order.

A text is cut between units: a unit is a word with the white space before it, or white space at the
very end. One match of the repeated unit against the whole text keeps where each repetition ends, so
the number of units and both cuts are read from that list. Draws come from a hash of the document's
id, so a document is always cut alike, however the table is partitioned.
"""

from __future__ import annotations

import hashlib
import re
import struct
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Batches, id_and_text, map_arrow, sized

SEED = 42

# possessive throughout: a unit is never given back, so a match takes time and space linear in the text
_UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")


class Markers(NamedTuple):
    """Strings before each part. Each must start and end with characters that occur nowhere else in any of them."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


MARKERS = Markers()


def unit_ends(text: str) -> list[int]:
    """Where each unit of ``text`` ends, in code points."""
    return _UNITS.fullmatch(text).ends(1)


def draws(seed: int, doc_id: object) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document; a null id draws as an empty one."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = 50, spm_rate: int = 80, markers: Markers = MARKERS
) -> DataFrame:
    """One row (doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    ``n`` counts units. ``form`` is 'psm' (prefix, suffix, middle), 'spm' (suffix, prefix, middle) or
    'plain': ``rate`` documents of 100 are cut, ``spm_rate`` of 100 of those as spm. Empty texts and
    texts that hold a marker stay plain, their lengths null. A null text counts as empty; rows that
    repeat an id are cut by the same draws, each in its own text. Other columns are left out.
    """
    source, id_type = id_and_text(docs, doc_id, text)

    def cut(key: object, whole: str) -> tuple[int, str, int | None, int | None, str]:
        ends = unit_ends(whole)
        n, (h1, h2, h3, h4) = len(ends), draws(seed, key)
        if not whole or any(m in whole for m in markers) or h3 % 100 >= rate:
            return n, "plain", None, None, whole
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (first, last))
        prefix, middle, suffix = markers.prefix + whole[:a], markers.middle + whole[a:b], markers.suffix + whole[b:]
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, suffix + prefix + middle
        return n, "psm", a, b - a, prefix + suffix + middle

    def transform(batches: Batches) -> Batches:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for part in sized(batch, 1):
                rows = [cut(key, t or "") for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(source, transform, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", markers: Markers = MARKERS) -> Column:
    """The text before ``fill_in_middle``, from output and form alone."""
    parts = F.split(F.col(output), "|".join(map(re.escape, markers)), -1)  # an empty one, then three in the form's order
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
