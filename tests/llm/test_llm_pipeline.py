import random

import corpus_pipeline
from centime.llm import bpe, decontaminate, language, linededup, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_act(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns
    rejected = {r[0] for r in language.identify(docs, language.fit_not_held_out(docs)).where("rejected").select("doc_id").collect()}
    one = corpus_pipeline.language_id(spark, docs, SF).cache()
    assert {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - rejected
    two = corpus_pipeline.line_dedup(spark, one, SF).cache()
    want = {r["doc_id"]: r["kept"] for r in linededup.dedup_lines(one).collect()}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want
    three = corpus_pipeline.near_dedup(spark, two, SF).cache()
    ids, texts = zip(*sorted((r["doc_id"], r["text"]) for r in two.collect()))
    assert {r[0] for r in three.select("doc_id").collect()} == {ids[i] for i in set(brute_groups(texts))}
    four = corpus_pipeline.decontamination(spark, three, SF).cache()
    bad = {r[0] for r in decontaminate.find_hits(three, bench).where("n_hit > 0").select("doc_id").collect()}
    assert {r[0] for r in four.select("doc_id").collect()} == {r[0] for r in three.select("doc_id").collect()} - bad
    assert one.columns == two.columns == three.columns == four.columns == columns
    last = {tuple(r) for r in bpe.round_trip(four).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == last and last


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_groups(texts):
    sets, group = [grams(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    return group


def test_near_dedup_gives_the_groups_of_brute_force_on_shingles(spark, monkeypatch):
    rnd, texts = random.Random(8), []
    passage = " ".join(f"p{i}" for i in range(40))
    for _ in range(4):
        base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
        for _ in range(22):
            words = list(base)
            for at in rnd.sample(range(150), rnd.choice([0, 1, 2, 3, 4, 5, 9])):
                words[at] = f"w{rnd.randrange(5000)}"
            texts.append(" ".join(words))
    texts += [f"a b c d e f g h i j {w}" for w in ("k", "l")]  # similarity 0.75 - not near copies
    texts += [passage + " " + " ".join(f"v{rnd.randrange(5000)}" for _ in range(n)) for n in (3, 20, 25, 30, 60) for _ in range(6)]
    texts += ["", None, "one", "one"]
    group = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rounds in (8, 0):
        monkeypatch.setattr(simhash, "PIVOT_ROUNDS", rounds)
        kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
        assert kept == set(group)


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (3, b + " end"), (7, a), (None, a), (9, "z"), (9, "z"), (None, "only"), (None, "only")], "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert kept == sorted([("5", a), ("3", b + " end"), ("9", "z"), ("None", "only")])


def test_language_id_drops_only_the_rejected_text_of_an_id(spark):
    de, en = "der und die nicht ich auch eine werden", "the and of which have with from this"
    rows = [(i, " ".join(random.Random(i).choices((de if i % 2 else en).split(), k=40)), "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame([*rows, (5, "123 !!", None), (6, None, None)], "doc_id long, text string, lang string")
    kept = sorted((r["doc_id"], r["text"]) for r in language.keep_identified(docs).collect())
    assert kept == sorted(r[:2] for r in rows)


EDGES = [None, "", " ", "word", "word", "Ünï " * 20_000, "der und die nicht", "½ ①", "a\nb\n" * 3000]


def test_every_stage_takes_odd_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, kept string, n_lines int, hit_id int, text_digest string, row_digest string, node int"
    rows = [(None if i == 3 else i % 7, t, None, None, None, 1, "k", 2, 3, "d", "r", 4) for i, t in enumerate(EDGES + EDGES)]
    train = [(100 + i, f"{w} " * 30, lang, "s", 9, 1, "k", 2, 3, "d", "r", 4) for i in range(20) for lang, w in (("de", f"der und die nicht auch {i}"), ("en", f"the and of which with {i}"))]
    for made in (rows + train, rows, []):
        docs = spark.createDataFrame(made, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF).collect()
            assert len(out) <= len(made), name
            if name != "bpe_round_trip":
                assert stage(spark, docs, SF).columns == docs.columns, name
    docs = spark.createDataFrame(rows, schema)
    kept = [r["text"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(kept) == 6 and {t for t in kept if t and t.strip()} == {t for t in EDGES if t and t.strip()}
