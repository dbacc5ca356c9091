"""SimHash near-duplicate groups: fingerprints, pigeonhole blocks, Hamming checks, connected components.

Two forms share the steps:

* ``near_groups``: 64-bit fingerprints, links at ``radius`` 2 or fewer differing bits, exact. The 64 bits are split into
  ``radius + 3`` blocks; two fingerprints within the radius agree in at least 3 of them, so they share a key of 3 blocks
  (about 38 bits), which stays selective for billions of texts.
* ``similar_groups``: long fingerprints for texts whose five-word shingles are similar by 0.8 or more, where 64 bits tell too
  little. They are split into blocks of 24 bits in three orders (more of both for larger corpora); pairs that share one are checked by the Hamming distance of the
  whole fingerprints, and what passes by the similarity of the whole shingle sets, which alone decides.

Both work on distinct fingerprints or sets, one representative each, so copies never meet each other in pairs.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import checkpointed, free_name, map_rows, quoted

SEED = 42
#: Shingles that are hashed at once, which bounds the memory that a very long text takes.
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _shingle_hashes(words: list[bytes], size: int, start: int) -> np.ndarray:
    part = words[start : start + CHUNK + size - 1]
    grams = zip(*(part[i:] for i in range(size))) if len(words) >= size else [words]
    return np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype=np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, the most significant first."""
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    return (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes, derived from h by a multiply-and-shift mixer."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(text: bytes | None, size: int, lanes: int = 1) -> np.ndarray:
    """The fingerprint's bits of a text, 64 a lane. Lane 0 takes the plain XXH64 values. No words: all zero."""
    words = (text or b"").lower().split()
    total, counts = max(len(words) - size + 1, 1) if words else 0, np.zeros((lanes, 64), dtype=np.int64)
    for start in range(0, total, CHUNK):
        h = _shingle_hashes(words, size, start)
        for k in range(lanes):
            counts[k] += _bit_counts(_mixed(h, k) if k else h)
    return (counts * 2 > total).ravel().astype(np.uint8)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row's whole text as a signed long. A null text counts as empty."""

    def make():
        return lambda r: (r[0], int.from_bytes(np.packbits(signature(r[1], shingle)).tobytes(), "big", signed=True))

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, fp long")


def _pigeonhole_masks(radius: int, share: int = 3) -> list[int]:
    """Masks of ``share`` of ``radius + share`` blocks: fingerprints within the radius agree under one of them at least."""
    cuts = np.linspace(0, 64, radius + share + 1).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, share)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(fps: DataFrame, radius: int = 2, most: int = 64) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints of ``fps`` (fp) within ``radius`` (at most 2) differing bits.

    Fingerprints that agree on a key of blocks form a bucket. In buckets of up to ``most`` all pairs are compared. Larger
    buckets give no pairs: each member gives itself and its one-bit variants outside the key's blocks, and those that share
    a variant are linked to the least of them. They then differ in at most 2 bits, and any 2 that differ in 1 or 2 bits share
    one, so the components are exact and the rows stay proportional to the members.
    """
    if radius > 2:
        raise ValueError("radius is at most 2; similar_groups serves larger distances")
    masks = _pigeonhole_masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.inline(keys).alias("t", "key"))
    sizes = checkpointed(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    held = checkpointed(rows.join(sizes, ["t", "key"]))
    few, many = held.where(F.col("n") <= most), held.where(F.col("n") > most)
    pairs = few.alias("x").join(few.alias("y"), ["t", "key"]).where("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    spots = many.select("fp", F.explode(flips[F.col("t")]).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot")).distinct()
    ends = checkpointed(spots.groupBy("spot").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("spot", "a"))
    stars = spots.join(ends, "spot").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).where(_distance(F.col("a"), F.col("b")) <= radius).distinct()


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    component_id is the least doc_id that can be reached over links of at most ``radius`` differing bits, itself included.
    Null or empty texts have fingerprint zero, which links like any other. Repeated rows stay, in one group. A null doc_id
    never names a group; a group that has no other has a null component_id. An empty table gives no rows.
    """
    fps = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(components(close_pairs(classes.select("fp"), radius)))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = checkpointed(rooted.join(named, "root").select("fp", "component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


#: Wide fingerprints: LANES of 64 bits. Texts whose shingle sets have a similarity of 0.8 differ in about 0.151 of the bits (232
#: of 1,536, give or take 14; short texts in up to 0.19), so a block of 24 bits agrees with a chance of 0.019. Three orders of
#: the bits (as they come, every 64th, every 599th) make 192 blocks, of which one agrees with a chance of 0.98, and more the more
#: alike two texts are. Unlike texts share one with a chance of 0.00001, so at a fixed width what shares a block by chance grows with the
#: square of the rows. Blocks of BLOCK_BITS serve 2**BASE_POWER shingle sets; each doubling beyond takes a bit more, which keeps such pairs
#: few a text, and 1.18 times the blocks (of more orders), which keeps the recall: keys a text grow as the fourth root of the rows.
LANES, BLOCK_BITS, BASE_POWER, BLOCK_GROWTH, WIDE_RADIUS = 24, 24, 16, 1.18, 330
#: Sets of up to so many shingles are also found by what is left without any two or fewer of their shingles, whatever the blocks say:
#: two of which neither has more than two shingles that the other lacks share such a rest.
SMALL = 24
#: Least Jaccard similarity of near copies' shingle sets, as a fraction of whole numbers, so that no comparison rounds.
SIMILAR = (4, 5)
#: Rounds go on while more pairs than so many a row are open. The first PIVOT_ROUNDS take one pivot a bucket, later ones twice as
#: many as the round before, up to MOST_PIVOTS.
PAIRS_A_ROW, PIVOT_ROUNDS, MOST_PIVOTS = 2, 4, 32
#: Orders of the bits, each of which gives as many blocks of BLOCK_BITS.
ORDERS = 3


def width_for(n: int) -> int:
    """Bits of a block for so many distinct shingle sets."""
    return BLOCK_BITS + max(0, (max(n, 1) - 1).bit_length() - BASE_POWER)


def _a_order(width: int) -> int:
    """Blocks that one order of the bits gives."""
    return LANES * 64 // width


def _orders(width: int | None = None) -> np.ndarray:
    """The places of the bits of each block of ``width`` (BLOCK_BITS if not given), one order's blocks after the other's; later orders are shuffled."""
    width, bits = width or BLOCK_BITS, np.arange(LANES * 64)
    blocks = math.ceil(ORDERS * _a_order(BLOCK_BITS) * BLOCK_GROWTH ** (width - BLOCK_BITS))
    made = [bits, bits.reshape(LANES, 64).T.ravel(), bits * 599 % len(bits)]
    made += [np.argsort(_mixed(bits.astype(np.uint64), k), kind="stable") for k in range(len(made), -(-blocks // _a_order(width)))]
    return np.concatenate([o[: _a_order(width) * width].reshape(-1, width) for o in made])[:blocks]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles in ascending order. No words: none."""
    words = (text or b"").lower().split()
    total = max(len(words) - size + 1, 1) if words else 0
    parts = [np.unique(_shingle_hashes(words, size, start)) for start in range(0, total, CHUNK)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def set_signature(h: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The fingerprint's bits of a shingle set, 64 a lane, each hash counted once."""
    counts = np.zeros((lanes, 64), dtype=np.int64)
    for start in range(0, len(h), CHUNK):
        part = h[start : start + CHUNK]
        for k in range(lanes):
            counts[k] += _bit_counts(_mixed(part, k) if k else part)
    return (counts * 2 > len(h)).ravel().astype(np.uint8)


def block_keys(bits: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The fingerprint's blocks, each a number that holds its place and its bits."""
    width = orders.shape[1]
    weights = (1 << np.arange(width - 1, -1, -1)).astype(np.int64)
    return bits[orders] @ weights + (np.arange(len(orders)) << width)


def small_keys(h: np.ndarray) -> list[int]:
    """Digests of a small set without any two, any one and none of its hashes."""
    kept = (np.delete(h, out) for k in range(min(3, len(h))) for out in combinations(range(len(h)), k))
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in kept]


def _row_digest(docs: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(quoted(c)) for c in docs.columns])))


def _fingerprinted(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, doc_id, node, n, fp, small): a row's digest, the digest, size and wide fingerprint of its shingle set, small sets' keys."""

    def make():
        def row(r):
            h = shingle_set(r[2], shingle)
            doc_id = r[1].decode() if isinstance(r[1], bytes) else r[1]
            small = small_keys(h) if 0 < len(h) <= SMALL else []
            return r[0].decode(), doc_id, xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63), len(h), np.packbits(set_signature(h)).view(">i8").tolist(), small

        return row

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(docs.select(_row_digest(docs).alias("row"), "doc_id", "text"), make, f"row string, doc_id {kind}, node long, n int, fp array<long>, small array<long>")


def _keys(nodes: DataFrame, width: int) -> DataFrame:
    """(key, node): the blocks of each node's fingerprint and the keys of small sets. Sets of under 10 need only the latter."""
    orders = _orders(width)

    def make():

        def row(r):
            if r[1] < 10:
                return r[0], r[3]
            bits = np.unpackbits(np.array(r[2], dtype=">i8").view(np.uint8))
            return r[0], block_keys(bits, orders).tolist() + r[3]

        return row

    return map_rows(nodes.select("node", "n", "fp", "small"), make, "node long, keys array<long>").select(F.explode("keys").alias("key"), "node")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows (key, node) whose key another node has too; keys go through one exchange."""
    by = Window.partitionBy("key").orderBy("node")
    met = F.lag("node").over(by).isNotNull() | F.lead("node").over(by).isNotNull()
    return keys.select("key", "node", met.alias("met")).where("met").drop("met")


def _near(p: str, q: str) -> Column:
    """Whether fingerprints are within the radius, or one is that of a small set, which tells too little."""
    apart = reduce(lambda a, b: a + b, [_distance(F.col(f"{p}.fp")[i], F.col(f"{q}.fp")[i]) for i in range(LANES)])
    return (F.least(F.col(f"{p}.n"), F.col(f"{q}.n")) <= SMALL) | (apart <= WIDE_RADIUS)


def _like_size(p: str, q: str) -> Column:
    num, den = SIMILAR
    return (F.least(F.col(f"{p}.n"), F.col(f"{q}.n")) * den) >= (F.greatest(F.col(f"{p}.n"), F.col(f"{q}.n")) * num)


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets are similar. Only the texts of nodes in ``pairs`` are read again."""
    num, den = SIMILAR
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.select("node", "row").join(ends, "node")
    texts = docs.select(_row_digest(docs).alias("row"), "text").join(wanted, "row").select("node", "text")
    sets = map_rows(texts, lambda: lambda r: (r[0], shingle_set(r[1], shingle).tobytes()), "node long, shingles binary")
    sets = checkpointed(sets.dropDuplicates(["node"]))

    def make():
        def row(r):
            x, y = np.frombuffer(r[2], dtype=np.uint64), np.frombuffer(r[3], dtype=np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            return (r[0], r[1]) if common * den >= num * (len(x) + len(y) - common) else None

        return row

    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return map_rows(met.select("a", "b", "x", "y"), make, "a long, b long")


def similar_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(row, doc_id, group) of each row of ``docs``: groups of texts linked by a shingle similarity of 0.8 or more.

    Rows are told apart by a digest of all columns, so repeated rows share one; ids may repeat or be null. Equal shingle sets
    are one node (a 64-bit digest); null texts, empty ones and others without words are one too, and link to nothing else.

    Nodes that share a block of their fingerprints form a bucket. A round compares a bucket's members with its pivots, which have
    then met all and leave; buckets whose members are in one group leave too. The first round takes the blocks of one order of the
    bits only, so that a large group of near copies is linked by a third of its blocks or fewer. Pivots are those of least hash, another hash each round, so buckets of the same members mostly share them. Rounds go on until so
    few pairs are open that they are in proportion to the rows; those are compared within a join. So a large group costs rows in
    proportion to its members, and no bucket is compared all against all unless its members are few or all in groups of their own.
    Every link is verified on the whole shingle sets, so no two texts are linked that are not similar.
    """
    rows = checkpointed(_fingerprinted(docs, shingle))
    nodes = checkpointed(rows.groupBy("node").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "fp", "small")]))
    width = width_for(nodes.count())
    held, prints = checkpointed(_shared(_keys(nodes, width)).withColumn("group", F.col("node"))), nodes.select("node", "n", "fp")

    def linked(near: DataFrame, links: DataFrame | None) -> DataFrame:
        edges = _similar(docs, nodes, checkpointed(near), shingle)
        return checkpointed(components(edges if links is None else edges.union(links.toDF("a", "b"))))

    links, at = None, 0
    while True:
        later = _order(width) > 0
        open_, n_rows, n_pairs = _unsettled(held if at else held.where(~later))
        if at and n_pairs <= PAIRS_A_ROW * n_rows:
            break
        if n_pairs:
            choices = [F.min(F.struct(F.xxhash64("node", F.lit(at), F.lit(k)).alias("h"), "node", "group")) for k in range(min(2 ** max(0, at + 1 - PIVOT_ROUNDS), MOST_PIVOTS))]
            pivots = checkpointed(open_.groupBy("key").agg(F.array(*choices).alias("p")).select("key", F.inline("p")).select("key", "node", "group").distinct())
            met = open_.alias("q").join(pivots.alias("p"), "key").where("p.group <> q.group")
            pairs = checkpointed(met.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct())
            p, q = prints.withColumnRenamed("node", "a").alias("p"), prints.withColumnRenamed("node", "b").alias("q")
            links = linked(pairs.join(p, "a").join(q, "b").where(_like_size("p", "q") & _near("p", "q")).select("a", "b"), links)
            stay = open_.join(pivots.select("key", "node"), ["key", "node"], "left_anti").select("key", "node")
            stay = stay if at else stay.unionByName(held.where(later).select("key", "node"))
            held = stay.join(links, "node", "left").select("key", "node", F.coalesce("root", "node").alias("group"))
        at += 1
    if n_pairs:
        of = checkpointed(open_.join(prints, "node"))
        met = of.alias("p").join(of.alias("q"), "key").where(F.expr("p.node < q.node and p.group <> q.group") & _like_size("p", "q") & _near("p", "q"))
        links = linked(met.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(), links)
    if links is None:
        return rows.select("row", "doc_id", F.col("node").alias("group"))
    return rows.select("row", "doc_id", "node").join(links, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("group"))


def _order(width: int) -> Column:
    """The order of the bits that a key's block is of, as block_keys numbers them; keys of small sets go with the first."""
    return F.when(F.col("key").between(0, (len(_orders(width)) << width) - 1), F.shiftright("key", width) / _a_order(width)).otherwise(0).cast("int")


def _unsettled(held: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of buckets whose members are in more than one group, their number, and how many pairs of members are of two groups."""
    of = held.groupBy("key", "group").agg(F.count("*").cast("double").alias("m"))
    mixed = checkpointed(of.groupBy("key").agg(F.sum("m").alias("m"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs")).where("pairs > 0"))
    total = mixed.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    return checkpointed(held.join(mixed.select("key"), "key")), total[0], total[1]


def keep_one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one row (that of the least doc_id; null ids come last) of each group of near copies; all columns stay.

    Of repeated rows one stays. Texts without words, null ones included, are one group. An empty table gives no rows.
    """
    rows = checkpointed(similar_groups(docs, shingle).groupBy("row", "doc_id", "group").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    kept = checkpointed(rows.groupBy("group").agg(first).select(F.col("first.row").alias("row")))
    mark = free_name(docs, "row_digest")
    dropped = checkpointed(rows.join(kept, "row", "left_anti").select(F.col("row").alias(mark)))
    again = checkpointed(rows.where("n > 1").join(kept, "row").select(F.col("row").alias(mark)))
    left = docs.withColumn(mark, _row_digest(docs)).join(dropped, mark, "left_anti")
    if not again.isEmpty():
        left = left.join(again, mark, "left_anti").unionByName(left.join(again, mark, "left_semi").dropDuplicates([mark]))
    return left.select(*[F.col(quoted(c)) for c in docs.columns])
