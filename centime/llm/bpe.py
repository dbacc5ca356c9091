"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from .common import map_rows

RANKS = "byte_bpe_50k.tiktoken"
#: Texts over this many characters are cut at safe boundaries before they are encoded.
LONG = 1 << 16
#: Before a single space between two characters that are no spaces: no match of the pattern spans it, as a space can only lead
#: a match or belong to a run of spaces. Python's \s takes in all that the library's does.
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def default_ranks() -> str:
    return public_tokenizers.path(RANKS)


class Ranks:
    """A rank file's bytes, read once on the driver, so that tasks need no path of their own."""

    _encodings: dict[str, tiktoken.Encoding] = {}

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        with open(path or default_ranks(), "rb") as f:
            self.data = f.read()
        self.pattern, self.key = pattern, hashlib.sha256(self.data + pattern.encode()).hexdigest()

    def encoding(self) -> tiktoken.Encoding:
        """The encoding, made once a Python worker."""
        made = Ranks._encodings
        if self.key not in made:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            made[self.key] = tiktoken.Encoding("local", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return made[self.key]


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """The text cut at the first safe boundary after each ``size`` characters; a stretch without one stays whole."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(encoding: tiktoken.Encoding, text: str, size: int = LONG) -> list[int]:
    """Ids of the whole text without special tokens."""
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    return [i for p in pieces(text, size) for i in encoding.encode_ordinary(p)]


def _text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "replace")


def encode_texts(docs: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """(doc_id, ids) for every row: the ids of its whole text; null and empty texts have none. Repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks or Ranks())

    def make():
        encoding = shared.value.encoding()
        return lambda r: (r[0], encode(encoding, _text(r[1])))

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded, decoded_sha256): raw bytes of each ids array, and digests of both."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks or Ranks())

    def make():
        encoding = shared.value.encoding()

        def one(r):
            data = encoding.decode_bytes(r[1])
            return r[0], len(r[1]), hashlib.sha256(" ".join(map(str, r[1])).encode()).hexdigest(), data, hashlib.sha256(data).hexdigest()

        return one

    kind = encoded.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(encoded.select("doc_id", "ids"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string")


def round_trip(docs: DataFrame, ranks: Ranks | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and decoded again.

    One pass over Arrow batches does both, so that neither ids nor bytes travel between processes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks or Ranks())

    def make():
        encoding = shared.value.encoding()

        def one(r):
            ids = encode(encoding, _text(r[1]))
            digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            return r[0], len(ids), digest, hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()

        return one

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_bytes(encoding: tiktoken.Encoding) -> np.ndarray:
    """The byte length of each id."""
    return np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)], dtype=np.int64)
