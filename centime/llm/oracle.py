"""SQL of the queries whose whole result SQL can express and whose text is long; the others' stands beside their queries."""

from __future__ import annotations

from . import rules

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's bytes: each byte goes into the register, then eight shifts (marked -1)."""
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i - 1, 2)) AS BIGINT))"
    steps = f"flatten(list_transform({octets}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce({steps}, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE {shift} END, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, leaves: str) -> str:
    """All nodes (l, g, i, h, n) over leaves (g, i, h, n), level by level."""
    return f"""{name} AS (SELECT 0 AS l, g, i, h, n FROM {leaves}
 UNION ALL SELECT l + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY l, g, i // 8)"""


MERKLE = f"""WITH RECURSIVE lf AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, {_leaf("text")} AS leaf, coalesce('=' || lang, '-') AS g FROM documents),
k AS (SELECT r, doc_id, leaf, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n,
 CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(f"translate(text, {_AZ})")} ELSE leaf END AS claimed FROM lf),
{_levels("nodes", "(SELECT g, i, leaf AS h, n FROM k)")},
subs AS (SELECT g, h FROM nodes WHERE n = 1 AND i = 0),
tl AS (SELECT 'top' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM subs),
{_levels("tops", "(SELECT g, i, h, n FROM tl)")},
every AS (SELECT * FROM nodes UNION ALL SELECT * FROM tops),
beside AS (SELECT a.l, a.g, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
 FROM every a JOIN every b ON a.l = b.l AND a.g = b.g AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
walk AS (SELECT r, g AS lang, g, 0 AS l, i, n, claimed AS h, '' AS proof, 0 AS step FROM k
 UNION ALL SELECT w.r, w.lang, CASE WHEN w.n > 1 THEN w.g ELSE 'top' END, CASE WHEN w.n > 1 THEN w.l + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.i // 8 ELSE t.i END,
 CASE WHEN w.n > 1 THEN (w.n + 7) // 8 ELSE t.n END, CASE WHEN w.n > 1 THEN sha256(b.before || w.h || b.after) ELSE w.h END, CASE WHEN w.n > 1 THEN w.proof || b.before || b.after ELSE w.proof END, w.step + 1
 FROM walk w LEFT JOIN beside b ON b.l = w.l AND b.g = w.g AND b.i = w.i LEFT JOIN tl t ON t.lang = w.lang WHERE w.n > 1 OR w.g <> 'top')
SELECT k.doc_id, k.leaf, s.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified, k.i AS rank
FROM k JOIN walk w ON w.r = k.r AND w.g = 'top' AND w.n = 1 JOIN subs s ON s.g = k.g JOIN (SELECT h FROM tops WHERE n = 1) t ON true"""

_H = _crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")
SPELLING = f"""WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), {_AZ}) AS run FROM documents) GROUP BY ALL),
slips AS (SELECT run, c, {_H} AS h FROM runs),
made AS (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM slips),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT c.word, v.word FROM cut c JOIN v ON c.rest = v.word UNION SELECT v.word, c.word FROM cut c JOIN v ON c.rest = v.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min({{'form': other, 'n': v.n}}, {{'less': -v.n, 'other': encode(other)}}) AS b FROM near JOIN v ON v.word = near.other GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN b.form END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN f ON f.word = w.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""


def _strictness() -> str:
    of = {"symbols": ("n_symbols", "n_words"), "repeated_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words"), "doubled_words": ("n_doubled", "n_words")}
    cases = [f"CASE {' '.join(f'WHEN 100 * {of[rule][0]} > {c} * {of[rule][1]} THEN {t}' for t, c in enumerate(steps))} ELSE {len(steps)} END" for rule, steps in rules.CUTOFFS.items()]
    return f"least({', '.join(cases)})"


_LEVELS = max(len(c) for c in rules.CUTOFFS.values())
RULES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS stratum, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents),
p AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS x FROM p JOIN (SELECT r, gram FROM p GROUP BY ALL HAVING count(*) > 1) USING (r, gram)) GROUP BY 1),
m AS (SELECT d.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_doubled FROM d LEFT JOIN rep ON rep.r = d.r),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST({_strictness()} AS INTEGER) AS strictness FROM m),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
g AS (SELECT stratum, strictness FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
t AS (SELECT stratum, CAST(level AS INTEGER) AS level, count(*) AS n, count(*) FILTER (WHERE strictness <= level) AS k FROM g, range({_LEVELS}) AS x(level) GROUP BY ALL),
c AS (SELECT *, CASE WHEN k > n * {rules.RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
 lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rules.RISK}) + (n - i) * ln(1 - {rules.RISK})))) END <= {rules.ERROR} / (SELECT count(DISTINCT stratum) FROM g) AS safe FROM t),
z AS (SELECT stratum, coalesce(min(level) FILTER (WHERE NOT safe), {_LEVELS}) - 1 AS level FROM c GROUP BY 1),
u AS (SELECT stratum, CAST(level AS INTEGER) AS level FROM z WHERE level >= 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND strictness > coalesce(level, -1) AS kept, level AS cutoff_level, strictness FROM s LEFT JOIN u USING (stratum)"""

ORACLE = {"op11_merkle": MERKLE, "op12_spelling": SPELLING, "op13_quality_rules": RULES}
