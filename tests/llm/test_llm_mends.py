import gzip
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from centime.llm import linededup, simhash, warc

SF = "/root/testdata/sf0.001"


def test_lines_of_documents_that_the_index_does_not_hold_stay(spark):
    rnd = random.Random(1)
    common = [f"common {k}" for k in range(300)]
    docs = spark.createDataFrame([(i, "\n".join(common)) for i in range(5)], "doc_id long, text string")
    index = linededup.LineIndex.of(docs, 5, shard_keys=100)
    others = [f"line {rnd.getrandbits(60)}" for _ in range(60_000)]
    new = spark.createDataFrame([(k, "\n".join([*others[k::6], "common 7"])) for k in range(6)], "doc_id long, text string")
    got = linededup.drop_lines(new, index, "doc_id").collect()
    assert {r["doc_id"]: (r["n_dropped"], r["kept"]) for r in got} == {k: (1, "\n".join(others[k::6])) for k in range(6)}


def test_shards_split_as_the_index_grows(spark):
    table = lambda a, b: spark.createDataFrame([(i, "\n".join(f"key {k}" for k in range(a, b))) for i in range(2)], "doc_id long, text string")
    index = linededup.LineIndex.of(table(0, 40), 2, shard_keys=20)
    grown = index.added(table(40, 200))
    assert (index.shards, grown.shards) == (3, 11) and grown.filters.count() <= 11
    kept = {r["kept"] for r in linededup.drop_lines(table(0, 201), grown, "doc_id", held=True).collect()}
    assert kept == {"key 200"}


ODD_NAMES = ["a.b", "a b", "a-b", "_", "sel`ect", "Ü", "c0", "a.b c`", "text_is_null", "of"]


def test_stages_take_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    words = "the and of which have with from this " * 4
    docs = spark.createDataFrame([(i, words + f"w{i} " * 12, "en", "s", 9) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(ODD_NAMES):
        docs = docs.withColumn(name, F.struct(F.lit(k).alias(name), F.lit("é").alias("x y")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r[ODD_NAMES[3]][0] for r in out.collect()} <= {3}, name
    assert linededup.without_frequent_lines(docs).count() == 12
    assert corpus_pipeline.bpe_round_trip(spark, docs, SF).count() == 12


def archives(tmp_path, spark, pages=40):
    rnd = random.Random(2)
    rows = [(i, f"http://x/{i}", "".join(rnd.choice("abcdefgh \n") for _ in range(3000))) for i in range(pages)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    return next((tmp_path / "w").rglob("*.gz")).read_bytes()


def test_damaged_archives_are_read_as_far_as_they_go_and_reported(spark, tmp_path):
    good = archives(tmp_path, spark)
    whole = gzip.decompress(good)
    flipped = bytearray(good)
    flipped[len(good) // 2] ^= 255
    twice = good + gzip.compress(whole[: whole.index(b"WARC/1.1", 10)])
    files = {"good": good, "plain": whole, "cut": good[: len(good) // 2], "no end": good[:-8], "flipped": bytes(flipped), "head only": good[:12], "twice": twice, "empty": b"", "bad crc": good[:-8] + b"\0" * 8, "cut plain": whole[:-50]}
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    broken = {r["file"] for r in warc.broken_chains(table).collect()}
    assert broken == set(files) - {"good", "plain", "twice", "empty"}
    found = warc.scan(table).where("at is not null").groupBy("file").count().collect()
    n = {r["file"]: r["count"] for r in found}
    assert n["good"] == n["plain"] == n["no end"] == 40 and n["twice"] == 41 and 0 < n["cut"] < 40 and "head only" not in n
    assert warc.plain(good) == whole and warc.plain(twice).startswith(whole)
    assert whole.startswith(warc.plain(files["cut"])) and len(warc.plain(files["cut"])) > 0.4 * len(whole)
    assert warc.inflated(zlib.compress(b"x"))[1]


def near_pairs(rnd, words, kind):
    """A text of so many words and one whose five-word shingles are alike by 0.8 or little more, changed at ends or within."""
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    n = words - 4
    for _ in range(100):
        other = list(base)
        if kind == "ends" or n < 40:
            k = rnd.randint(1, max(1, n // 5))
            other = [f"x{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, k // 2))] + other[rnd.randint(0, k // 2) :] + [f"y{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, k // 2))]
        else:
            for _ in range(max(1, n // 46)):
                other[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        if a != b and 0.8 <= len(a & b) / len(a | b) < 0.84:
            return " ".join(base), " ".join(other)
    return None


@pytest.mark.parametrize("words", [12, 20, 28, 45, 80, 200, 600])
def test_recall_of_near_pairs_of_each_size(words):
    rnd, met, orders = random.Random(words), [], simhash._orders()
    for k in range(150):
        if pair := near_pairs(rnd, words, "ends" if k % 2 else "within"):
            sets = [simhash.shingle_set(t.encode(), 5) for t in pair]
            keys = [(set(simhash.block_keys(simhash.set_signature(h), orders).tolist()) if len(h) >= 10 else set()) | (set(simhash.small_keys(h)) if len(h) <= simhash.SMALL else set()) for h in sets]
            apart = sum(int(x) for x in simhash.set_signature(sets[0]) ^ simhash.set_signature(sets[1]))
            met.append(bool(keys[0] & keys[1]) and (min(map(len, sets)) <= simhash.SMALL or apart <= simhash.WIDE_RADIUS))
    print(words, len(met), sum(met) / max(len(met), 1))
    assert not met or sum(met) >= 0.95 * len(met)


def test_blocks_grow_with_the_rows_so_that_unlike_texts_seldom_share_one(monkeypatch):
    """pipeline: at a fixed width, rows of blocks that unlike texts share grow with the square of the texts."""
    monkeypatch.setattr(simhash, "BLOCK_BITS", 12)
    monkeypatch.setattr(simhash, "BASE_POWER", 6)
    rng, rows = np.random.default_rng(3), {}
    for n in (64, 1024):
        orders = simhash._orders(simhash.width_for(n))
        keys = np.concatenate([simhash.block_keys(b, orders) for b in rng.integers(0, 2, (n, simhash.LANES * 64), dtype=np.uint8)])
        _, m = np.unique(keys, return_counts=True)
        rows[n] = m[m > 1].sum() / n
    assert simhash.width_for(1024) == 16 and 0 < rows[1024] < 3 * rows[64]
    assert [simhash.width_for(n) for n in (0, 64, 65)] == [12, 12, 13]
