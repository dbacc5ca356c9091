"""Token counts of sections by offset mapping: a document is encoded once, its tokens' spans are joined to its sections."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .bpe import Ranks, _text, encode, token_bytes
from .common import map_rows

#: Rules for a token that lies across a boundary: it counts for the section of its first byte, of its last byte, or of most
#: of its bytes (ties: the earlier).
RULES = ("first", "last", "most")
SECTION = re.compile(r"[^\n]*\n+|[^\n]+")


def sections(text: str) -> list[tuple[int, int]]:
    """Spans in characters of lines with the line ends behind them; they cover the text."""
    return [m.span() for m in SECTION.finditer(text)]


def allocate(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. Spans in bytes; cuts are the sections' starts in order, the first 0.

    This is an interval join by merging two sorted sides: token spans and section spans.
    """
    first = np.searchsorted(cuts, starts, side="right") - 1
    last = np.searchsorted(cuts, ends - 1, side="right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    best, most = first.copy(), np.minimum(ends, np.append(cuts, 1 << 62)[first + 1]) - starts
    for i in np.flatnonzero(last > first):
        for s in range(first[i] + 1, last[i] + 1):
            held = min(ends[i], cuts[s + 1] if s + 1 < len(cuts) else ends[i]) - cuts[s]
            if held > most[i]:
                best[i], most[i] = s, held
    return best


def count_sections(docs: DataFrame, rule: str = "first", ranks: Ranks | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, section_chars, section_tokens) for every row.

    A section is a line with the line ends after it. section_tokens holds the tokens that the rule gives to each section, in
    order; they add up to n_tokens. n_crossing counts tokens with bytes in several sections. Null and empty texts have no
    sections. Repeated rows stay.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks or Ranks())

    def make():
        encoding = shared.value.encoding()
        lengths = token_bytes(encoding)

        def one(r):
            text = _text(r[1])
            spans = sections(text)
            if not spans:
                return r[0], 0, 0, 0, [], []
            ids = np.array(encode(encoding, text), dtype=np.int64)
            ends = np.cumsum(lengths[ids])
            starts = ends - lengths[ids]
            cuts = np.cumsum([0] + [len(text[a:b].encode()) for a, b in spans[:-1]])
            mine = allocate(starts, ends, cuts, rule)
            crossing = int((np.searchsorted(cuts, ends - 1, side="right") - 1 > np.searchsorted(cuts, starts, side="right") - 1).sum())
            return r[0], len(ids), len(spans), crossing, [b - a for a, b in spans], np.bincount(mine, minlength=len(spans)).tolist()

        return one

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, section_chars array<long>, section_tokens array<long>")
