"""Language identification by compression: the language whose raw-content dictionary packs a text best."""

from __future__ import annotations

import math

import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, free_name, hashed_sample, map_rows
from .compression import Sizer, raw_dictionary, slice_of

#: The bound on rows of each language that the dictionaries are made of.
SAMPLE_PER_LANGUAGE, DICTIONARY_BYTES, SLICE_BYTES, CHUNK = 200, 32_768, 400, 2048
PARAMETERS = {"window_log": 17, "hash_log": 15, "chain_log": 16, "search_log": 3, "min_match": 4, "target_length": 8, "strategy": zstandard.STRATEGY_GREEDY}
#: A text is rejected if the best size is not at least this share below the next best.
MARGIN = 0.004
UNDETERMINED = "und"
_NOT_LETTERS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    """Lower-cased letters and their marks, each run of other characters made one space: what is compressed. No letter: empty."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace") if _LETTER.search(text) else b""


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, bytes]:
    """A dictionary for each language of ``labelled`` (doc_id, text, lang), of at most ``per_language`` documents each.

    What reaches the driver is a slice of SLICE_BYTES of each. Of repeated ids the least text is taken; equal slices count once.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sample = hashed_sample(rows, "doc_id", "lang", per_language)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(r):
        return r[0].decode() if isinstance(r[0], bytes) else r[0], r[1].decode(), slice_of(letters(r[2].decode("utf-8", "replace")), SLICE_BYTES)

    keys = rows.sparkSession.createDataFrame([(i, k) for k, ids in sample.items() for i in ids], rows.select("doc_id", "lang").schema)
    found = rows.join(F.broadcast(keys), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    slices = {(r[0], r[1]): bytes(r[2]) for r in map_rows(found, lambda: cut, f"doc_id {kind}, lang string, slice binary").collect()}
    made = {lang: raw_dictionary([s for s in dict.fromkeys(slices[i, lang] for i in ids) if s], DICTIONARY_BYTES) for lang, ids in sample.items()}
    return {k: v for k, v in made.items() if v}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for every row, from its whole text alone.

    margin is the gap between the two smallest sizes over the larger; score rises from 0.5 to 1 with it. Equal sizes take the
    first language by name. Texts that are null or have no letter, and all texts if no language was learned, are ``und``
    with score 0, rejected. With one language the margin is 1. Repeated rows stay.
    """

    def make():
        sizers = {k: Sizer(v, CHUNK, **PARAMETERS) for k, v in sorted(dictionaries.items())}

        def one(r):
            data = letters(r[1].decode("utf-8", "replace")) if r[1] else b""
            if not data or not sizers:
                return r[0], UNDETERMINED, 0.0, 0.0, True
            ranked = sorted((f(data), k) for k, f in sizers.items())
            gap = (ranked[1][0] - ranked[0][0]) / ranked[1][0] if len(ranked) > 1 else 1.0
            return r[0], ranked[0][1], 1 / (1 + math.exp(-60 * gap)), gap, gap < margin

        return one

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def held_out(column):
    return F.coalesce(crc_mod(column, 4) == 2, F.lit(False))


def fit_not_held_out(docs: DataFrame) -> dict[str, bytes]:
    return fit(docs.where(~held_out(F.col("doc_id"))))


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on rows that are not held out, applied to all rows."""
    found = identify(docs, fit_not_held_out(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that language identification rejects; all columns stay.

    Rejections are few, so they are what is joined back, by a digest of the text: rows of one id but other texts stay, ids may
    be null or repeat. Null texts and those without letters go. An empty table gives no rows; without a labelled row all go.
    """
    mark = free_name(docs, "text_digest")
    texts = docs.select(F.md5("text").alias("doc_id"), "text")
    rejected = identify(texts, fit_not_held_out(docs)).where("rejected").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(rejected, F.md5(docs.text).eqNullSafe(F.col(mark)), "left_anti")
