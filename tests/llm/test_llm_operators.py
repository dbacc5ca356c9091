import hashlib
import math
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
import zstandard

from centime.llm import audio, bpe, decontaminate, language, linededup, quality, secret_scan, simhash, token_counts, warc
from centime.llm.cuckoo import CuckooFilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h int, key int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2) for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


EDGE = [None, "", " ", "a", "a b", "a b c", "a b c", "x\n\ny\n", "Ünïcode Wörter!", "w " * 30000, "same line\nother", "same line\nmore"]


def simhash_brute(text, size=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_groups(spark):
    got = by_id(simhash.near_groups(table(spark, EDGE)))
    fps = [simhash_brute(t) for t in EDGE]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(EDGE))] == fps
    parent = list(range(len(EDGE)))
    for _ in EDGE:
        for a in range(len(EDGE)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert [got[i]["component_id"] for i in range(len(EDGE))] == parent
    assert simhash.near_groups(table(spark, [])).count() == 0


def top_of(links, n):
    group = list(range(n))
    for a, b in links:
        x, y = sorted((group[a], group[b]))
        group = [x if g == y else g for g in group]
    return group


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


def test_similar_groups_link_what_shares_a_block_and_is_similar_and_little_is_missed(spark):
    rnd, texts = random.Random(8), []
    for length in (6, 9, 13, 18, 60, 150, 400):
        for _ in range(4):
            base = [f"w{rnd.randrange(5000)}" for _ in range(length)]
            for _ in range(8):
                words = list(base)
                for at in rnd.sample(range(length), min(length, rnd.choice([0, 1, 1, 2, 3, 5, 9]))):
                    words[at] = f"w{rnd.randrange(5000)}"
                texts.append(" ".join(words[rnd.randrange(2) : length - rnd.randrange(2)]))
    texts += ["", None, "one", "one", " \t"]
    sets = [shingles(t) for t in texts]
    hashed = [simhash.shingle_set((t or "").encode(), 5) for t in texts]
    orders = simhash._orders()
    blocks = [set(simhash.block_keys(simhash.set_signature(h), orders).tolist()) if len(h) >= 10 else set() for h in hashed]
    small = [set(simhash.small_keys(h)) if len(h) <= simhash.SMALL else set() for h in hashed]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    met = [(a, b) for a, b in alike if sets[a] == sets[b] or blocks[a] & blocks[b] or small[a] & small[b]]
    assert len(met) > 0.97 * len(alike)
    assert all(len(sets[a] | sets[b]) > simhash.SMALL for a, b in set(alike) - set(met))
    got = {}
    for r in simhash.similar_groups(table(spark, texts)).collect():
        got.setdefault(r["group"], []).append(r["doc_id"])
    want = {}
    for i, g in enumerate(top_of(met, len(texts))):
        want.setdefault(g, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(want.values())
    assert simhash.similar_groups(table(spark, [])).count() == 0


@pytest.mark.parametrize("most", [64, 3])
def test_close_pairs_find_all_components(spark, most):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3))) for b in base for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from centime.operators.graph import components

    found = {r["node"] % (1 << 64): r["root"] for r in components(simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most)).collect()}
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                group[top(a)] = top(b)
    for i, a in enumerate(values):
        for b in values[:i]:
            same = top(a) == top(b)
            assert same == (a in found and b in found and found[a] == found[b])


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(30)]
    copies = []
    for t in texts[:10]:
        w = t.split()
        w[rnd.randrange(300)] = "changed"
        copies.append(" ".join(w))
    docs = table(spark, texts + copies + texts[:3] + [None, ""])
    kept = sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect())
    assert kept == [*range(30), 43] and simhash.keep_one_of_each(docs).columns == docs.columns


def test_quality(spark):
    rnd = random.Random(1)
    good = [" ".join(rnd.choices("the of and water light house garden morning".split(), k=60)) for _ in range(80)]
    bad = ["!! ".join(rnd.choices("BUY NOW FREE CLICK WIN".split(), k=60)) for _ in range(80)]
    docs = table(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = by_id(quality.classify(docs, labels))
    assert len(got) == 162 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["predicted"] == int(i < 80) for i in range(160) if got[i]["held_out"]) == sum(got[i]["held_out"] for i in range(160))
    assert by_id(quality.classify(docs, labels.limit(0)))[0]["score"] == 0.5


def plain_size(dictionary, data, chunk, **how):
    """Compressed size by a compressor that loads the dictionary anew for each chunk."""
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(dict_data=d, **how)
    return sum(len(c.compress(data[i : i + chunk])) for i in range(0, len(data), chunk))


def test_quality_scores_agree_with_a_plain_loop(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "long text here " * 30_000), (-4, "same"), (-4, "same")], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(extra)
    train = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    model = quality.fit(every, spark.createDataFrame(list(train.items()), "doc_id long, quality int"))
    got = quality.classify(every, labels).collect()
    texts = every.collect()
    assert len(got) == len(texts)
    want = {}
    for r in texts:
        data = (r["text"] or "").encode()
        g, b = (plain_size(d, data, quality.CHUNK, level=quality.LEVEL) for d in (model.good, model.bad))
        want[r["doc_id"]] = 1 / (1 + math.exp(-max(-50, min(50, model.slope * (b - g) / max(b, g, 1) + model.intercept))))
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert quality.classify(every.limit(0), labels).count() == 0


def test_quality_tells_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], r["predicted"], marks[r["doc_id"]]) for r in quality.classify(docs, labels).collect() if r["held_out"] and marks.get(r["doc_id"]) is not None]
    pairs = [(a > b) + (a == b) / 2 for a, _, q in held for b, _, r in held if q > r]
    assert sum(pairs) / len(pairs) > 0.95 and sum(p == q for _, p, q in held) > 0.9 * len(held)


def test_language_agrees_with_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = language.fit_not_held_out(docs)
    p = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **language.PARAMETERS)
    got, right, held = by_id(language.classify(docs)), 0, 0
    for r in docs.collect():
        data = " ".join(x for x in "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (r["text"] or "").lower()).split(" ") if x).encode()
        mine = got[r["doc_id"]]
        if not any(unicodedata.category(c)[0] == "L" for c in r["text"] or ""):
            assert (mine["lang_pred"], mine["score"], mine["rejected"]) == ("und", 0.0, True)
            continue
        sizes = sorted((plain_size(d, data, language.CHUNK, compression_params=p), k) for k, d in made.items())
        gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert (mine["lang_pred"], mine["rejected"]) == (sizes[0][1], gap < language.MARGIN) and abs(mine["margin"] - gap) < 1e-12
        if mine["held_out"] and r["lang"] is not None:
            held, right = held + 1, right + (mine["lang_pred"] == r["lang"])
    assert right >= 0.9 * held > 0


def test_language(spark):
    de, en = "der und die nicht ich auch eine werden", "the and of which have with from this"
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices((de if i % 2 else en).split(), k=40)), "de" if i % 2 else "en") for i in range(60)] + [(60, None, None), (61, "123 !!", None), (62, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.classify(docs))
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(60)) and [got[i]["lang_pred"] for i in (60, 61, 62)] == ["und"] * 3
    assert sorted(r["doc_id"] for r in language.keep_identified(docs).collect()) == list(range(60))
    odd = by_id(language.identify(table(spark, ["½ ² ½ ²", "Ⅷ ①", "\u0301", "_ 9", "der ² die und nicht", "der die " * 40_000, rows[1][1], rows[1][1]]), language.fit_not_held_out(docs)))
    assert [odd[i]["lang_pred"] for i in range(8)] == ["und"] * 4 + ["de"] * 4 and odd[6][1:] == odd[7][1:]
    assert language.classify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 936, 937, 938, 20000])
def test_audio_round_trip_of_any_bytes(n):
    payload = audio.padded(os.urandom(n))
    s = audio.parse(audio.pack(payload))
    assert audio.unpack(s) == payload and s.failed == s.skipped == 0 and s.table.frames == len(s.offsets) and s.table_ok


def test_audio_resynchronises_and_checks(spark):
    media = audio.pack(audio.padded(b"\xff\xfb\x90\x00" * 3000))
    start = media.index(b"\xff\xfa")
    s = audio.parse(b"junk\xff\xe0" * 5 + media[start:] + b"TAG" + b"title".ljust(30, b"\0") + bytes(95))
    assert (s.skipped, s.failed, s.tags["title"]) == (30, 0, "title") and len(s.offsets) == 13 and s.samples == 13 * 1152
    broken = bytearray(media)
    broken[start + 4] ^= 1
    assert audio.parse(bytes(broken)).failed == 1
    got = by_id(audio.inspect(audio.store_texts(table(spark, EDGE)), "doc_id", "n_bytes"))
    assert [got[i]["payload_sha256"] for i in range(len(EDGE))] == [hashlib.sha256(audio.padded((t or "").encode())).hexdigest() for t in EDGE]


def frames_walked(media):
    """Offsets of the frames of a clean stream from its tag on, lengths from the header's fields alone; CRCs bit by bit."""
    size = 0
    for b in media[6:10]:
        size = size << 7 | b
    at, found = 10 + size, []
    while at < len(media):
        word = int.from_bytes(media[at : at + 4], "big")
        assert word >> 16 == 0xFFFA and word >> 10 & 3 == 1
        kbps = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[word >> 12 & 15]
        c = 0xFFFF
        for byte in media[at + 2 : at + 4] + media[at + 6 : at + 23]:
            for k in range(7, -1, -1):
                c = (c << 1 ^ (0x8005 if (c >> 15) ^ (byte >> k & 1) else 0)) & 0xFFFF
        assert c == int.from_bytes(media[at + 4 : at + 6], "big")
        found.append(at)
        at += 144 * kbps * 1000 // 48000
    return found


def test_audio_features_agree_with_a_walk(spark):
    texts = [*EDGE, "a" * 64, "b" * 65, "x" * 50_000, None]
    got = by_id(audio.inspect(audio.store_texts(table(spark, texts)), "doc_id", "n_bytes"))
    for i, t in enumerate(texts):
        payload = audio.padded((t or "").encode())
        offsets = frames_walked(audio.pack(payload))[1:]
        r = got[i]
        assert (r["seek_offsets"], r["n_frames"], r["samples"], r["sample_rate"]) == (offsets, len(offsets), 1152 * len(offsets), 48000)
        assert (r["duration_us"], r["crc_checked"], r["crc_failed"], r["table_ok"]) == (24_000 * len(offsets), len(offsets) + 1, 0, True)
    assert audio.inspect(audio.store_texts(table(spark, []))).count() == 0
    odd = spark.createDataFrame([(0, None), (1, bytearray(b"\xff" * 4000)), (2, bytearray(audio.pack(b"x" * 64, {"payload_bytes": "abc"})))], "n_frames int, media binary")
    assert [r["payload_bytes"] for r in audio.inspect(odd.withColumnRenamed("n_frames", "id"), "id").orderBy("id").collect()] == [0, 0, 0]


def frame(version_layer, bitrate, body=b"", rate=0, mode=0xC0):
    """A frame of protected audio with a right checksum over what its layer asks for."""
    head = bytes((0xFF, version_layer, bitrate << 4 | rate << 2, mode))
    h = audio.header(head, 0)
    data = bytearray(head + b"\0\0" + body + bytes(h.length - 6 - len(body)))
    bits = audio._checked_bits(bytes(data), 0, h)
    data[4:6] = audio.crc16_bits(bytes(data[2:4]), bytes(data[6:]), bits).to_bytes(2, "big")
    return bytes(data)


def test_audio_of_other_layers_tables_and_tags():
    for kind, bodies in ((0xFE, (b"", b"\x12\x34" * 8)), (0xFC, (b"", b"\x77" * 20)), (0xF4, (b"\x55" * 20,))):  # Layer I, II, II at low rates
        for mode in (0xC0, 0x00, 0x50):
            frames = b"".join(frame(kind, 8, b, mode=mode) for b in bodies * 3)
            s = audio.parse(frames)
            assert (len(s.offsets), s.checked, s.failed) == (3 * len(bodies), 3 * len(bodies), 0), (kind, mode)
            broken = bytearray(frames)
            broken[7] ^= 0x40
            assert audio.parse(bytes(broken)).failed == 1
    n, length = 40, len(frame(0xFA, 9, rate=1))
    plain = frame(0xFA, 9, rate=1)
    for entries, right in (([length * 10] * 4, True), ([length * 10, length * 30, length, length], False)):
        entries[0] += length
        vbri = b"VBRI" + bytes(6) + (length * (n + 1)).to_bytes(4, "big") + n.to_bytes(4, "big") + b"\0\4\0\1\0\2\0\x0a" + b"".join(e.to_bytes(2, "big") for e in entries)
        lead = bytearray(plain)
        lead[36 : 36 + len(vbri)] = vbri
        s = audio.parse(bytes(lead) + plain * n)
        assert (s.table.kind, s.table.frames, len(s.offsets), s.table_ok) == ("vbri", n, n, right)
    media = audio.pack(b"z" * 5000)
    start = media.index(b"\xff\xfa")
    xing = media.index(b"Xing")
    for at in (xing + 11, xing + 15, xing + 16 + 50):
        wrong = bytearray(media)
        wrong[at] ^= 0x80
        assert audio.parse(media).table_ok and not audio.parse(bytes(wrong)).table_ok
    text = lambda name, value, marks=b"\0\0", more=b"": name + len(more + value).to_bytes(4, "big") + marks + more + value
    tag = lambda major, flags, body: b"ID3" + bytes((major, 0, flags)) + audio._synchsafe(len(body)) + body
    for made in (
        tag(3, 0x40, b"\0\0\0\6" + bytes(6) + text(b"TIT2", b"\0name")),
        tag(3, 0x80, text(b"TIT2", b"\0name") + text(b"TXXX", b"\0k\0" + b"v").replace(b"\xff", b"\xff\0")),
        tag(4, 0x50, b"\0\0\0\6\1\0" + text(b"TIT2", b"\0name", b"\0\1", b"\0\0\0\5")) + b"3DI" + bytes(7),
        tag(2, 0, b"TIT\0\0\5\0name"),
    ):
        s = audio.parse(made + media[start:])
        assert "name" in s.tags.values() and s.skipped == 0 and len(s.offsets) == 6, made[:12]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def test_decontamination(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(1, passage), (2, "Two Words"), (3, None), (4, passage + " tail"), (5, "--"), (5, "two words")]
    texts = [f"lead {passage.upper()} end", "has two, WORDS and two words", passage.replace("p7", "q7"), None, "", "clean text", "two", f"{passage} {passage}", "clean text"]
    docs = table(spark, texts)
    got = by_id(decontaminate.find_hits(docs, spark.createDataFrame(items, "item_id long, text string")))
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[k : k + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found)), i
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(docs, bench).collect()) == [2, 3, 4, 5, 6, 8]
    assert by_id(decontaminate.remove_spans(docs, bench))[1]["text"].split() == ["has", ",", "and"]
    clash = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, hit_id int, HIT_HASH int, hit_spans int, hit_words int, hit_gaps int, hit_lead int")
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(clash, bench).collect()) == [2, 3, 4, 5, 6, 8]
    cut = decontaminate.remove_spans(clash, bench)
    assert cut.columns == clash.columns and by_id(cut)[1]["text"].split() == ["has", ",", "and"]
    same = spark.createDataFrame([(None, passage), (None, "clean"), (1, passage), (1, "clean"), (1, passage)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in decontaminate.remove_documents(same, bench).collect()) == [("1", "clean"), ("None", "clean")]
    long = table(spark, ["w " * 30_000 + passage + " w" * 30_000])
    assert decontaminate.find_hits(long, bench).first()["n_hit"] == 14
    assert by_id(decontaminate.find_hits(docs, bench.limit(0)))[0]["n_hit"] == 0
    assert decontaminate.find_hits(docs.limit(0), bench).count() == 0


def test_warc_rejects_magic_in_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long = "x" * 150
    rows = [(i, f"http://a/{i}\r\nX: y", h) for i, h in enumerate([None, "", "short", "short", long, inner + "tail", long, inner * 3, "é" * 80, long])]
    got = {r["page_id"]: r for r in warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sorted(got) == list(range(10)) and all(r["digest_ok"] for r in got.values())
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: got[i]["refers_to"] for i in got if got[i]["record_type"] == "revisit"} == {6: 4, 9: 4}


def test_warc_files_are_bounded_and_ids_may_be_words(spark, tmp_path):
    rnd = random.Random(2)
    html = [None, "", "ß" * 70] + ["".join(rnd.choices("abcdef <>", k=n)) for n in (99, 100, 5_000, 40_000, 200_000, 200_000) for _ in range(3)]
    rows = [(f"p {i:03}/ü", f"http://x/{i}", h) for i, h in enumerate(html + html[2:5])] + [(None, None, "no id"), ("p 000/ü", "u", "x" * 100), ("p 000/ü", "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    folder = str(tmp_path / "warc")
    warc.write_archives(pages, folder, 100_000)
    files = [r for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").collect()]
    sizes = [len(warc.plain(bytes(r["content"]))) for r in files]
    assert max(sizes) < 202_000 and len(sizes) > 9
    got = sorted((str(r["page_id"]), r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, folder).collect())
    first = {}
    for i, _, h in sorted(rows, key=lambda r: str(r[0])):
        first.setdefault(h, i)
    seen = [(i, (h or "").encode(), first[h]) for i, _, h in rows]
    want = [(str(i), hashlib.sha256(h).hexdigest(), "revisit" if len(h) >= 100 and i != f else "response", f if len(h) >= 100 and i != f else None) for i, h, f in seen]
    assert got == sorted(want, key=lambda w: (w[0], w[1], w[2], str(w[3])))
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_tells_where_a_damaged_chain_stops(spark):
    record = lambda i: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: 8\r\n\r\n\r\n\r\nabcd\r\n\r\n".encode()
    whole, cut = b"".join(map(record, range(4))), record(0) + record(1)[:-5] + record(2)
    files = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(cut)), ("c", bytearray()), ("d", bytearray(b"junk"))], "path string, content binary")
    assert sorted((r["file"], r["stops"]) for r in warc.broken_chains(files).collect()) == [("b", len(record(0))), ("d", 0)]


def test_bpe_pieces_and_round_trip(spark):
    ranks = bpe.Ranks()
    e = ranks.encoding()
    text = "don't  stop  here \x1c x   \n\n  Ärger 123 '''s " * 400
    assert bpe.encode(e, text, 50) == e.encode_ordinary(text) and "".join(bpe.pieces(text, 50)) == text
    assert list(bpe.pieces("y" * 500, 50)) == ["y" * 500]
    got = by_id(bpe.round_trip(table(spark, EDGE)))
    other = by_id(bpe.decode_ids(bpe.encode_texts(table(spark, EDGE))))
    for i, t in enumerate(EDGE):
        ids = e.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert tuple(got[i])[1:] == want and (other[i]["n_tokens"], other[i]["ids_sha256"], other[i]["decoded_sha256"]) == want
    assert isinstance(e, tiktoken.Encoding)


def frequent_lines_brute(texts, threshold):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    docs = [(t or "").split("\n") for t in texts]
    seen = {}
    for lines in docs:
        for k in {key(x) for x in lines}:
            seen[k] = seen.get(k, 0) + 1
    left = [[x for x in lines if not key(x) or seen[key(x)] < threshold] for lines in docs]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(docs, left)]


def test_line_dedup_agrees_with_brute_force_however_shards_take_turns(spark):
    rnd = random.Random(4)
    texts = [f" Shared Line\t\nown {i}\n\nshared line" for i in range(4)] + ["own 0", None, "", "shared  line", "shared line\n" * 5000, "x" * 300_000]
    texts += ["\n".join(rnd.choice((f"Line {rnd.randrange(40)}", f"line {rnd.randrange(4000)} ", "Ünïcode", "")) for _ in range(30)) for _ in range(60)]
    docs, want = table(spark, texts), frequent_lines_brute(texts, 4)
    for shard_keys, most in ((100_000, 1 << 20), (16, 1)):
        got = by_id(linededup.drop_lines(docs, linededup.LineIndex.of(docs, 4, shard_keys), "doc_id", most_bytes=most))
        assert [(got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) for i in range(len(texts))] == want
    assert linededup.dedup_lines(docs.limit(0)).count() == linededup.without_frequent_lines(docs.limit(0)).count() == 0
    again = linededup.drop_lines(docs.union(docs), linededup.LineIndex.of(docs.union(docs), 8), "doc_id")
    assert sorted(r["kept"] for r in again.collect()) == sorted([w[2] for w in want] * 2)


def test_line_dedup_keeps_clashing_columns_and_nulls(spark):
    rows = [(i, "Twice\nown" if i < 4 else None, i, i, "k", i) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, row int, kept string, n_chars int")
    got = linededup.without_frequent_lines(docs, 4)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(i, "" if i < 4 else None, i, i, "k", 0 if i < 4 else i) for i in range(5)]


def test_line_dedup_is_reversible(spark):
    base = [f"common\nrare {i}" for i in range(4)]
    more = ["common\nnew line\nrare 0"] * 3 + ["new line"]
    docs, extra = table(spark, base), table(spark, more)
    before = linededup.LineIndex.of(docs, 4, 2)
    grown = before.added(extra)
    back = grown.removed(extra)
    table_of = lambda x: {bytes(r["key"]): r["refs"] for r in x.counts.collect()}
    cut = lambda x: [r["kept"] for r in linededup.drop_lines(docs, x, "doc_id").orderBy("doc_id").collect()]
    assert table_of(back) == table_of(before) != table_of(grown)
    assert cut(back) == cut(before) == [f"rare {i}" for i in range(4)] and cut(grown) == ["", "rare 1", "rare 2", "rare 3"]
    assert table_of(before.removed(docs)) == {}
    whole = linededup.LineIndex.of(table(spark, base + more), 4, 2)
    assert table_of(grown) == table_of(whole) and cut(grown) == cut(whole)


def test_filters_pass_more_than_they_hold_and_the_table_tells_what(spark):
    texts = ["a\nb"] * 3 + [f"rare {i}\na" for i in range(200)]
    docs = table(spark, texts)
    index = linededup.LineIndex.of(docs, 3)
    every = CuckooFilter.of(sorted({linededup.line_key(x.encode()) for t in texts for x in t.split("\n")}))
    wide = linededup.LineIndex(index.counts, spark.createDataFrame([(0, bytearray(every.dump()))], "shard int, cells binary"), 3, 1)
    assert wide.exceptions(1 << 20).count() == 200
    got = [tuple(r)[1:] for r in linededup.drop_lines(docs, wide, "doc_id").orderBy("doc_id").collect()]
    assert got == frequent_lines_brute(texts, 3)


def test_cuckoo_filters_follow_the_keys(spark):
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    made = CuckooFilter.load(CuckooFilter.of(keys[:2000]).dump())
    assert all(k in made for k in keys[:2000]) and sum(k in made for k in keys[2000:]) < 10
    assert made.remove(keys[0]) and all(k in made for k in keys[1:2000])
    frame = lambda ks: spark.createDataFrame([(bytearray(k),) for k in ks], "key binary")
    first = linededup.shard_filters(frame(keys[:50]), 3)
    after = {r["shard"]: CuckooFilter.load(bytes(r["cells"])) for r in linededup.updated_filters(first, frame(keys[:50]), frame(keys[10:400]), 3).collect()}
    assert all(k in after[int.from_bytes(k[10:14], "big") % 3] for k in keys[10:400])


def test_secrets_base_and_linked(spark):
    access, weak = "AKIA" + "A1B2" * 4, "aB3/" * 10
    texts = [
        f"id {access} key {weak} at https://api.example.com:8443/x", f"only {weak} and https://h.example.com", f"{access} " + "z " * 400 + weak, f"é𝄞 password=abcdefg TOKEN: 'x1' {access}",
        None, "", "deadbeef" * 4 + " secret=token:abcdefgh", f"{access} https://h.example.com", f"{access} https://h.example.com api_key=abcdef1",
    ]
    got = by_id(secret_scan.report(table(spark, texts)))
    a = re.compile(secret_scan.ASSIGN.removeprefix("(?i)"), re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in a.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), i
    linked = {i: [x.split(":")[0] for x in r["spans"].split(",") if x.startswith("linked")] for i, r in got.items()}
    assert linked == {**{i: [] for i in range(9)}, 0: ["linked_secret", "linked_endpoint"], 8: ["linked_endpoint"]}


def linked_brute(text, scope):
    found = lambda k: [m.span() for m in re.finditer({x[0]: x[1] for x in secret_scan.WEAK}[k], text)]
    a = re.compile(secret_scan.ASSIGN.removeprefix("(?i)"), re.I | re.A)
    access = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    near = lambda x, others: any(o[1] >= x[0] - scope and o[0] <= x[1] + scope for o in others)
    secrets = [x for x in found("linked_secret") if near(x, access)]
    known = secrets + [m.span() for m in a.finditer(text) if len(m[2]) >= 6]
    ends = [x for x in found("linked_endpoint") if near(x, access) and near(x, known)]
    return sorted([("linked_secret", *x) for x in secrets] + [("linked_endpoint", *x) for x in ends], key=lambda x: (x[1], x[0]))


def test_linked_secrets_agree_with_brute_force_at_every_gap(spark):
    access, weak, end = "AKIA" + "Q7" * 8, "aB3/" * 10, "https://h.example.com"
    texts = [f"{' ' * lead}{x}{' ' * gap}{y}" for lead in (0, 3, 17, 399) for gap in (398, 399, 400, 401, 402) for x, y in ((access, weak), (weak, access))]
    texts += [" " * lead + access + " " * gap + weak for lead in range(0, 420, 20) for gap in range(399, 402)]
    rnd = random.Random(11)
    for _ in range(150):
        parts = [rnd.choice((access, weak, end, "password=abcdefg", "é𝄞", "word")) + " " * rnd.choice((1, 2, 60, 199, 380, 400)) for _ in range(rnd.randrange(2, 9))]
        texts.append("".join(parts))
    got = by_id(secret_scan.report(table(spark, texts + texts[:5])))
    for i, t in enumerate(texts):
        spans = [tuple(x.split(":")) for x in got[i]["spans"].split(",") if x.startswith("linked")]
        assert sorted((k, int(a), int(b)) for k, a, b in spans) == sorted(linked_brute(t, 400)), i
    assert secret_scan.report(table(spark, [])).count() == 0
    long = secret_scan.report(table(spark, [" ".join([access, weak, end] * 3000)])).first()
    assert (long["n_access"], long["n_linked"]) == (3000, 6000)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up(spark, rule):
    ranks = bpe.Ranks()
    e = ranks.encoding()
    for i, r in by_id(token_counts.count_sections(table(spark, EDGE), rule)).items():
        text = EDGE[i] or ""
        assert r["n_tokens"] == len(e.encode_ordinary(text)) == sum(r["section_tokens"]) and sum(r["section_chars"]) == len(text)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_agree_with_brute_force(spark, rule):
    e = bpe.Ranks().encoding()
    rnd = random.Random(6)
    texts = [*EDGE, "\n\n\n", "a\n", "\na", "word\n" * 3000] + ["".join(rnd.choice(("ab ", "\n", "\n\n", "é", "𝄞x", "  ", "123", "\n \n")) for _ in range(40)) for _ in range(30)]
    got = by_id(token_counts.count_sections(table(spark, texts), rule))
    for i, t in enumerate(texts):
        data, lines, owner = (t or "").encode(), [], []
        for line in re.findall(r"[^\n]*\n+|[^\n]+", t or ""):
            owner += [len(lines)] * len(line.encode())
            lines.append(len(line))
        tokens, at, crossing = [0] * len(lines), 0, 0
        for token in e.encode_ordinary(t or ""):
            n = len(e.decode_single_token_bytes(token))
            mine = owner[at : at + n]
            best = {"first": mine[0], "last": mine[-1], "most": max(sorted(set(mine)), key=mine.count)}[rule]
            tokens[best] += 1
            crossing += mine[0] != mine[-1]
            at += n
        assert at == len(data)
        assert (got[i]["section_chars"], got[i]["section_tokens"], got[i]["n_crossing"]) == (lines, tokens, crossing), i
    assert token_counts.count_sections(table(spark, []), rule).count() == 0


def test_boundary_rules():
    starts, ends, cuts = np.array([0, 3, 7]), np.array([3, 7, 8]), np.array([0, 4, 7])
    assert [token_counts.allocate(starts, ends, cuts, r).tolist() for r in token_counts.RULES] == [[0, 0, 2], [0, 1, 2], [0, 1, 2]]
