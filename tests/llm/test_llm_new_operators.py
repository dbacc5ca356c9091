import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from centime.llm import merkle, rules, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, g string, leaf string, rank int, n int, word string, path string, stratum string, w string, lines string, h string, `a.b` int"
ODD = [None, "", " ", "\n", "a", "same same same same same same", "x\n\ny\nx\nx", "Ünïcode Wörter! " * 3, "w " * 30000, "one two three four five six seven eight nine ten eleven"]


def table(spark, rows):
    """rows: (doc_id, text, lang); the other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, k, "s", 5, 1, "g", "l", 2, 3, "w", "p", "st", "w", "l", "h", 9) for i, t, k in rows], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(i, text, lang):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, "s", lang, 5, text)))


def tree(leaves):
    """The root and, for each leaf, its siblings' digests level by level."""
    nodes, at, proofs = leaves, list(range(len(leaves))), [""] * len(leaves)
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for j, k in enumerate(at):
            proofs[j] += "".join(h for x, h in enumerate(runs[k // 8]) if x != k % 8)
        nodes, at = [sha("".join(r)) for r in runs], [k // 8 for k in at]
    return nodes[0], proofs


def manifest_brute(rows):
    groups = defaultdict(list)
    for i, t, k in rows:
        groups[k].append((i is not None, i or 0, leaf_of(i, t, k)))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: tree([x[2] for x in sorted(groups[k])]) for k in order}
    root, above = tree([built[k][0] for k in order])
    return sorted((leaf, built[k][0], root, sha(built[k][1][j] + above[at])) for at, k in enumerate(order) for j, (_, _, leaf) in enumerate(sorted(groups[k])))


@pytest.mark.parametrize("sizes", [{"de": 1}, {None: 1, "de": 8, "é": 9, "": 3}, {"de": 513, None: 65, "z": 2, **{f"k{j}": 1 for j in range(70)}}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rnd, rows = random.Random(1), []
    for lang, n in sizes.items():
        ids = rnd.sample([None, 0, -1, 5, -(1 << 63), (1 << 63) - 1, *range(7000, 10000), *(1 << k for k in range(20, 60))], n) if n > 1 else [3]
        rows += [(i, rnd.choice(ODD[:7]), lang) for i in ids]
    rows += rows[:3] + [(rows[0][0], "another text", rows[0][2]), (7, "repeated", "rep")] + [(7, "repeated", "rep")] * 20
    made = merkle.manifest(table(spark, rows)).withColumn("proof", merkle.proof_digest(F.col("path")))
    got = merkle.verified(made, "leaf").collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == manifest_brute(rows)
    assert all(r["verified"] for r in got)


def test_manifest_tells_tampering_and_bears_odd_rows(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)]
    other = merkle.leaf([F.lit("x") if c == "text" else F.col(c) for c in merkle.COLUMNS])
    docs = table(spark, rows)
    got = merkle.verified(merkle.manifest(docs, carry={"claimed": F.when(F.col("doc_id") % 2 == 0, other).otherwise(merkle.leaf([F.col(c) for c in merkle.COLUMNS]))}), "claimed").collect()
    assert {r["id"]: r["verified"] for r in got} == {i: i % 2 == 1 for i, _, _ in rows}
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_a_hot_id_is_ranked_by_its_leaves(spark):
    rows = [(4, f"text {k % 300}", "en") for k in range(400)] + [(3, "before", "en"), (5, "after", "en")]
    got = merkle.manifest(table(spark, rows)).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [3] + [4] * 400 + [5]
    inner = [r["leaf"] for r in sorted(got, key=lambda r: r["rank"])][1:-1]
    assert inner == sorted(inner)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_brute(counts, ratio=10):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= ratio * n else None
        out[w] = [forms[w], None, n, len(near), counts[best] if forms[w] else None]
    for w in out:
        end = w
        while forms[end]:
            end = forms[end]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "azÀÿé÷É"])
def test_variants_equal_all_pairs(spark, letters):
    rnd, counts = random.Random(3), {}
    for _ in range(25):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(7, 12)))
        for step in range(8):
            counts[word] = rnd.choice([2, 3, 20, 30, 200, 2000])
            at = rnd.randrange(len(word))
            word = rnd.choice([word[:at] + word[at + 1 :], word[:at] + rnd.choice(letters) + word[at:], word[:at] + rnd.choice(letters) + word[at + 1 :], word[:at] + word[at:][::-1]])
            if len(word) < 7:
                break
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == variants_brute(counts)


def test_forms_are_followed_to_the_end(spark):
    chain = {"aaaaaaab": 2, "aaaaaaac": 20, "aaaaaacc": 200, "aaaaaccc": 2000, "aaaacccc": 20000, "aaaccccc": 200000}
    got = spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()
    assert {r["root"] for r in got} == {"aaaccccc"}
    assert {r["word"]: r["form"] for r in got}["aaaaaaab"] == "aaaaaaac"


def test_runs_and_vocabulary(spark):
    texts = [None, "", "short", "Größeres größeres ÄÖÜäöüß", "abcdefg1abcdefg_ABCDEFG", "x" * 50000, "x" * 50000, "straßenbahnÃÿ"]
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(None, "nullable nullable", None)])
    got = Counter((r["doc_id"], r["run"]) for r in spelling.runs(docs).collect())
    want = Counter((i, "".join(c.lower() if c < "\x80" else c for c in x)) for i, t in [*enumerate(texts), (None, "nullable nullable")] for x in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(x) >= 7)
    assert got == want
    words = spelling.vocabulary(spelling.runs(docs).select(F.col("run").alias("word")))
    assert {r["word"]: r["n"] for r in words.collect()} == {"größeres": 2, "abcdefg": 3, "x" * 50000: 2, "nullable": 2}
    assert {r["n_near"] for r in spelling.variants(words).collect()} == {0}
    assert spelling.variants(words.limit(0)).count() == 0


def measures_brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {x for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    doubled = sum(a == b for a, b in zip(w, w[1:]))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines), doubled


def test_measures_equal_plain_counts(spark):
    rnd = random.Random(5)
    texts = ODD + [" ".join(rnd.choice(["a", "b", "#x", "c\n", "d*|", "é", " ", "z\r\n"]) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    got = rules.measures(table(spark, [(i, t, "en") for i, t in enumerate(texts)]), "doc_id").collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"], r["n_doubled"]) for r in got} == {i: measures_brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("k", "n", "rate"), [(0, 1, 0.05), (0, 90, 0.05), (3, 200, 0.05), (9, 200, 0.05), (4800, 100_000, 0.05), (40, 1000, 0.1)])
def test_binomial_chance_is_exact(spark, k, n, rate):
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)) for i in range(k + 1))
    got = spark.range(1).select(rules.binomial_at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), rate)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)
    assert spark.range(1).select(rules.binomial_at_most(F.lit(n).cast("long"), F.lit(n).cast("long"), rate)).first()[0] == 1


def test_levels_stop_where_the_bound_is_passed(spark):
    rows = [("big", 10)] * 500 + [("big", 6)] * 60 + [("big", 4)] * 8 + [("few", 10)] * 20 + [("clean", 10)] * 200
    got = {r["stratum"]: (r["level"], r["n_good"], r["n_rejected"]) for r in rules.certified(spark.createDataFrame(rows, "stratum string, strictness int")).collect()}
    assert got == {"big": (5, 568, 8), "clean": (9, 200, 0)}


def test_few_good_rows_are_lost_in_any_stratum(spark):
    """Over many draws of labels the share of strata that lose more than the risk stays under the error."""
    rnd, broken = random.Random(9), 0
    rates = {f"s{j}": [0.01 * (t + 1) * (j + 1) / 4 for t in range(10)] for j in range(4)}
    for draw in range(12):
        rows = []
        for s, r in rates.items():
            for _ in range(400):
                u = rnd.random()
                rows.append((s, next((t for t, x in enumerate(r) if u < x), 10)))
        chosen = {x["stratum"]: x["level"] for x in rules.certified(spark.createDataFrame(rows, "stratum string, strictness int")).collect()}
        broken += any(rates[s][t] > rules.RISK for s, t in chosen.items())
    assert broken <= 2


def test_judge_learns_cutoffs_where_labels_suffice(spark):
    rnd, rows, labels = random.Random(2), [], []
    text = lambda junk: " ".join(f"{'$#' if junk else ''}{rnd.choice('abcdefgh')}{rnd.randrange(5000)}" for _ in range(40))
    for i in range(600):
        junk = i % 6 == 0
        rows.append((i, text(junk), "en" if i < 500 else None if i < 520 else "de"))
        labels.append((i, 0 if junk else 1, 0))
    rows += [(None, text(True), "en"), (600, None, "en"), (600, "", "en"), (601, text(False), "en"), (601, text(False), "en")]
    docs, lab = table(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (601, 1, 0), (601, 0, 0)], "doc_id long, quality int, toxic int")
    got = rules.judge(docs, lab).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] == (i % 6 > 0) for i in range(500))
    assert all(by[i]["kept"] for i in range(500, 600)) and by[600]["base_failed"] and not by[600]["kept"] and by[601]["kept"]
    assert not by[None]["kept"]
    assert all(r["kept"] != r["base_failed"] for r in rules.judge(docs, lab.limit(0)).collect())
    assert rules.judge(docs.limit(0), lab).count() == 0
