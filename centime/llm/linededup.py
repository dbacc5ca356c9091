"""Line dedup over exact reference counts, with sharded cuckoo filters in front of them.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. The reference-count table holds how many
documents have each key. Keys of enough documents are frequent; their lines are dropped everywhere. Tasks know frequent keys by
the filters alone. A filter also passes about 1 in 8,000 of the other keys; the exact table tells which, and these exceptions
go along. Documents can be added and taken away again, which changes counts by
one each, and filters only by the keys that pass the threshold either way.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, map_rows, quoted
from .cuckoo import CuckooFilter, Full

_BLANK = b" \t\n\x0b\x0c\r"
#: Keys that a filter shard holds on average, and the bytes of filters and exceptions that tasks hold at once: with more shards
#: the texts pass several times, against as many as fit each time.
SHARD_KEYS, FILTER_BYTES, EXCEPTION_BYTES = 100_000, 128 << 20, 120


def line_key(line: bytes) -> bytes | None:
    """A digest of the line's key; none for a blank line, which is never dropped."""
    key = line.strip(_BLANK).lower()
    return hashlib.blake2b(key, digest_size=16).digest() if key else None


def distinct_keys(text: bytes | None) -> set[bytes]:
    return {k for k in {line_key(x) for x in set((text or b"").split(b"\n"))} if k}


def reference_counts(docs: DataFrame) -> DataFrame:
    """(key, refs): how many rows of ``docs`` have a line of that key. Each task adds up its own batches first."""
    keys = map_rows(docs.select("text"), lambda: lambda r: (list(distinct_keys(r[0])),), "keys array<binary>")
    return keys.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("refs"))


def updated_counts(counts: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The table after whole documents came or went; keys that no document has any more are gone."""
    deltas = counts.select("key", "refs")
    if added is not None:
        deltas = deltas.unionByName(reference_counts(added))
    if removed is not None:
        deltas = deltas.unionByName(reference_counts(removed).withColumn("refs", -F.col("refs")))
    return deltas.groupBy("key").agg(F.sum("refs").alias("refs")).where("refs > 0")


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("key", 11, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def shard_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, cells): a cuckoo filter of each shard's keys. Shards are sized so that one group is bounded."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "cells": [CuckooFilter.of(sorted(group["key"])).dump()]})

    return keys.select(_shard(shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, cells binary")


def updated_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int) -> DataFrame:
    """Filters of the keys ``after`` made from those of ``before``: changed keys are added or removed one by one.

    A shard that overflows is made anew from its keys, which is why they come along for shards with changes only.
    """
    b, a = before.select("key", F.lit(1).alias("was")), after.select("key", F.lit(1).alias("now"))
    both = b.join(a, "key", "full").select(_shard(shards).alias("shard"), "key", "was", "now")
    touched = both.where("was is null or now is null").select("shard").distinct()
    changes = both.join(touched, "shard", "left_semi")

    def merge(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else keys)["shard"].iloc[0]
        now = sorted(keys["key"][keys["now"].notna()])
        try:
            made = CuckooFilter.load(bytes(old["cells"].iloc[0])) if len(old) else CuckooFilter.of([])
            for k in keys["key"][keys["now"].isna()]:
                made.remove(k)
            for k in keys["key"][keys["was"].isna()]:
                made.add(k)
        except Full:
            made = CuckooFilter.of(now)
        return pd.DataFrame({"shard": [shard], "cells": [made.dump()]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(merge, "shard int, cells binary")


class LineIndex:
    """The exact reference-count table and the filters of its keys of at least ``threshold`` documents, both as tables.

    counts (key, refs), filters (shard, cells). ``added`` and ``removed`` give the index after whole documents came or went:
    adding and removing the same rows leads back to the same counts, and to filters that tell the same keys.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, threshold: int, shards: int, shard_keys: int = SHARD_KEYS):
        self.counts, self.filters, self.threshold, self.shards, self.shard_keys = counts, filters, threshold, shards, shard_keys

    @classmethod
    def of(cls, docs: DataFrame, threshold: int = 10, shard_keys: int = SHARD_KEYS) -> LineIndex:
        counts = checkpointed(reference_counts(docs))
        frequent = counts.where(F.col("refs") >= threshold).select("key")
        shards = frequent.count() // shard_keys + 1
        return cls(counts, checkpointed(shard_filters(frequent, shards)), threshold, shards, shard_keys)

    def _changed(self, counts: DataFrame) -> LineIndex:
        now, frequent = checkpointed(counts), F.col("refs") >= self.threshold
        n, shards = now.where(frequent).count(), self.shards
        if n > 2 * shards * self.shard_keys:  # else a shard would grow with the corpus
            shards = n // self.shard_keys + 1
            filters = shard_filters(now.where(frequent).select("key"), shards)
        else:
            filters = updated_filters(self.filters, self.counts.where(frequent), now.where(frequent), shards)
        return LineIndex(now, checkpointed(filters), self.threshold, shards, self.shard_keys)

    def added(self, docs: DataFrame) -> LineIndex:
        return self._changed(updated_counts(self.counts, added=docs))

    def removed(self, docs: DataFrame) -> LineIndex:
        return self._changed(updated_counts(self.counts, removed=docs))

    def exceptions(self, most_bytes: int = FILTER_BYTES, docs: DataFrame | None = None) -> DataFrame:
        """(shard, key): the keys that the filters pass by mistake, of the index's documents or of ``docs``, as the exact table tells."""
        shards, found, frequent = self.shards, None, F.col("refs") >= self.threshold
        rare = self.counts.where(~frequent) if docs is None else reference_counts(docs).join(self.counts.where(frequent).select("key"), "key", "left_anti")
        rare = rare.select(_shard(shards).alias("shard"), "key")
        for wave in _waves({r[0]: r[1] for r in self.filters.select("shard", F.octet_length("cells")).collect()}, most_bytes):
            shared = self._broadcast(wave)

            def make(shared=shared):
                passes = _passing(shared.value, shards)
                return lambda r: r if passes(r[1]) else None

            here = map_rows(rare.where(F.col("shard").isin(wave)), make, "shard int, key binary")
            found = here if found is None else found.unionByName(here)
        return rare.limit(0) if found is None else found

    def _broadcast(self, wave: list[int], *more):
        cells = {r["shard"]: bytes(r["cells"]) for r in self.filters.where(F.col("shard").isin(wave)).collect()}
        return self.counts.sparkSession.sparkContext.broadcast((cells, *more) if more else cells)

    def screens(self, most_bytes: int = FILTER_BYTES, docs: DataFrame | None = None) -> list:
        """Broadcast filters and exceptions of some shards each, which take up to ``most_bytes`` (one shard at least)."""
        exceptions = checkpointed(self.exceptions(most_bytes, docs))
        n = {r[0]: r[1] for r in exceptions.groupBy("shard").count().collect()}
        sizes = {r[0]: r[1] + EXCEPTION_BYTES * n.get(r[0], 0) for r in self.filters.select("shard", F.octet_length("cells")).collect()}
        keys = lambda wave: frozenset(bytes(r["key"]) for r in exceptions.where(F.col("shard").isin(wave)).collect())
        return [self._broadcast(wave, keys(wave)) for wave in _waves(sizes, most_bytes) or [[]]]


def _waves(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Shards in groups of up to ``most`` bytes, or of one."""
    made: list[list[int]] = []
    room = 0
    for shard, size in sorted(sizes.items()):
        if not made or size > room:
            made.append([])
            room = most
        made[-1].append(shard)
        room -= size
    return made


def _passing(cells: dict[int, bytes], shards: int):
    filters = {k: CuckooFilter.load(v) for k, v in cells.items()}

    def passes(key: bytes) -> bool:
        shard = filters.get(int.from_bytes(key[10:14], "big") % shards)
        return shard is not None and key in shard

    return passes


def drop_lines(docs: DataFrame, index: LineIndex, *keep: str, most_bytes: int = FILTER_BYTES, held: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` with n_lines, n_dropped and kept (the other lines, joined): one row for each row.

    Null and empty texts are one empty line; blank lines stay. Repeated rows stay. Very long texts are one row of a batch. A
    line goes if its shard's filter passes its key and the key is no exception. Shards that don't fit at once take turns.
    Documents that the index does not hold have keys that its table says nothing of, so their own keys are looked up in it;
    ``held`` says that it holds all of ``docs``, which saves that.
    """
    shards, at = index.shards, [free_name(docs.select(*map(quoted, keep)), c) for c in ("n_lines", "n_dropped", "kept")]
    zero = F.lit(0).cast("long")
    out = docs.select(*map(quoted, keep), zero.alias(at[0]), zero.alias(at[1]), F.col("text").cast("string").alias(at[2]))
    schema = out.schema
    for i, shared in enumerate(index.screens(most_bytes, None if held else docs)):

        def make(shared=shared):
            cells, exceptions = shared.value
            passes = _passing(cells, shards)

            def one(r):
                *kept_columns, n_lines, n_dropped, text = r
                lines = (text or b"").split(b"\n")
                left = [x for x in lines if not ((k := line_key(x)) and passes(k) and k not in exceptions)]
                return *kept_columns, n_lines or len(lines), n_dropped + len(lines) - len(left), b"\n".join(left)

            return one

        out = map_rows(checkpointed(out) if i else out, make, schema)
    return out


def dedup_lines(docs: DataFrame, threshold: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row, dropping lines whose key is in at least ``threshold`` rows."""
    return drop_lines(docs, LineIndex.of(docs, threshold), "doc_id", held=True)


def without_frequent_lines(docs: DataFrame, threshold: int = 10) -> DataFrame:
    """``docs`` with the frequent lines cut from ``text``; all columns and rows stay, n_chars (if there) follows, null texts stay null.

    The other columns travel under numbers, so their names may hold any characters.
    """
    index, row, empty = LineIndex.of(docs, threshold), "row", "text_is_null"
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    packed = F.struct(F.col("text").isNull().alias(empty), *[F.col(quoted(c)).alias(n) for c, n in others.items()]).alias(row)
    out = drop_lines(docs.select(packed, "text"), index, row, held=True)
    full = ~F.col(row)[empty]
    columns = {c: F.col(row)[n] for c, n in others.items()} | {"text": F.when(full, F.col("kept"))}
    if "n_chars" in others:
        length = F.length("kept").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when((F.col("n_dropped") > 0) & full, length).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])
