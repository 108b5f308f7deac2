"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components.

Two permutations of the 32-bit universe make every signature coordinate: a first one scatters
the shingles, a second one is applied after a circular shift by the coordinate's number.
Bands of the signature are looked up for equal values, and every link is confirmed on the full
shingle sets. Groups of copies are never expanded into pairs:

* texts with equal shingle sets become one representative before banding;
* a shingle that only one representative has can't be shared, so ``u`` such shingles bound the
  similarity of two sets by ``a / (n_x + n_y - a)``, ``a = min(n_x - u_x, n_y - u_y)``;
* in each bucket one centre is compared with the others; what is then still apart is
  compared in blocks, from which only a spanning tree of the links comes out.

The last step is exact: no link that banding finds is lost to the steps before it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import components, cut, in_batches, packed, small, table

#: Chance that banding misses a pair just at the threshold.
MISS = 1e-6
#: Rounds of comparing a bucket's members with one of them.
STARS = 1
#: Comparisons of a bucket that are made as pairs; sets on either side of a block beyond that.
PAIRS, TILE = 64, 512


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows of a band for a threshold, so that at most MISS of the pairs on it are missed."""
    t = percent / 100
    if t >= 1:
        return 1, 8
    rows = max(1, round(math.log(0.3) / math.log(t)))
    return math.ceil(math.log(MISS) / math.log(1 - t**rows)), rows


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of an ASCII-lower-cased text."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(k, n)
    x = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        x = (x ^ h[i : i + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(items: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least value of pi(sigma(item) + k) over the set."""
    scattered = _mix((items >> np.uint64(32)).astype(np.uint32) ^ np.uint32((0xA511E9B3 + seed) & 0xFFFFFFFF))
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(scattered), 512):
        out = np.minimum(out, _mix(scattered[None, at : at + 512] + shift ^ np.uint32(0x5BD1E995)).min(axis=1))
    return out


def _signed(texts, k: int, bands: int, rows: int):
    """Set size, key of the set and band values of each text."""
    sizes, keys, values, ends = [], [], [], [0]
    for text in texts:
        s = shingles(text, k)
        sizes.append(len(s))
        keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        if len(s):
            sig = signature(s, bands * rows)
            values += [
                xxhash.xxh3_64_intdigest(sig[i * rows : (i + 1) * rows].tobytes(), seed=i) - 2**63 for i in range(bands)
            ]
        ends.append(len(values))
    return (
        pa.array(sizes, pa.int64()),
        pa.array(keys, pa.binary()),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())),
    )


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, key, bands) of rows (doc_id, text)."""
    bands, rows = bands_for(percent)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = pc.cast(part.column(1), pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *_signed(text, k, bands, rows)], ["doc_id", "n", "key", "bands"]
                )

    return in_batches(docs).mapInArrow(run, "doc_id bigint, n bigint, key binary, bands array<bigint>")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(rep, n, items) of rows (rep, text, key) whose set has that key."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, items = [], []
                wanted = part.column(2).to_pylist()
                for i, text in enumerate(pc.cast(part.column(1), pa.binary()).to_pylist()):
                    s = shingles(text, k)
                    if xxhash.xxh3_128_digest(s.tobytes()) == wanted[i]:
                        ids.append(part.column(0)[i].as_py())
                        items.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(map(len, items), pa.int64()),
                        pa.array(items, pa.list_(pa.int64())),
                    ],
                    ["rep", "n", "items"],
                )

    return in_batches(docs).mapInArrow(run, "rep bigint, n bigint, items array<bigint>")


def _possible(x: str, y: str, percent: int):
    """Whether the shingles that a set has alone leave enough to share."""
    a = F.least(F.col(f"{x}.n") - F.col(f"{x}.u"), F.col(f"{y}.n") - F.col(f"{y}.u"))
    return 100 * a >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - a)


def _confirmed(pairs: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst) whose full sets are similar enough."""
    left = of.select(F.col("rep").alias("src"), F.col("n").alias("n1"), F.col("items").alias("i1"))
    right = of.select(F.col("rep").alias("dst"), F.col("n").alias("n2"), F.col("items").alias("i2"))
    both = F.size(F.array_intersect("i1", "i2"))
    return (
        pairs.join(right, "dst")
        .join(left, "src")
        .where(100 * both >= percent * (F.col("n1") + F.col("n2") - both))
        .select("src", "dst")
    )


def links(reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (src, dst) between representatives (rep, key, doc_id, bands) that span the same components
    as all pairs which share a band and have the similarity. rep is a set's own number, doc_id the
    document that has its text."""
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    inside = cut(rows.join(full.select("bucket"), "bucket"))
    wanted = inside.select("rep").distinct().join(reps.select("rep", "key", "doc_id"), "rep")
    texts = docs.join(wanted, "doc_id").select("rep", "text", "key")
    of = cut(sets(texts, k))
    alone = (
        of.select("rep", F.explode("items").alias("item"))
        .groupBy("item")
        .agg(F.min("rep").alias("rep"), F.max("rep").alias("hi"))
        .where("rep = hi")
        .groupBy("rep")
        .agg(F.count("*").alias("u"))
    )
    known = (
        of.select("rep", "n")
        .distinct()
        .join(alone, "rep", "left")
        .select("rep", "n", F.coalesce("u", F.lit(0)).alias("u"))
        .where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n"))
    )
    members = cut(inside.join(known, "rep").select("bucket", "rep", "n", "u"))
    node = F.struct("rep", "n", "u")
    edges, label = None, members.select("rep", F.col("rep").alias("component")).distinct()
    for star in range(STARS):
        # rows of each bucket by component, then the bucket's largest component and a member of it
        at = members.join(label, "rep").select("bucket", "component", node.alias("x"))
        by = at.groupBy("bucket", "component").agg(
            F.count("*").alias("size"), F.min_by("x", F.xxhash64("x.rep", F.lit(star))).alias("c")
        )
        centre = (
            by.groupBy("bucket")
            .agg(
                F.max_by(F.struct("component", "c"), F.struct("size", F.xxhash64("c.rep"))).alias("top"),
                F.count("*").alias("parts"),
            )
            .where("parts > 1")
            .select("bucket", F.col("top.c").alias("y"), F.col("top.component").alias("main"))
        )
        pairs = (
            at.join(centre, "bucket")
            .where((F.col("component") != F.col("main")) & _possible("x", "y", percent))
            .select(F.least("x.rep", "y.rep").alias("src"), F.greatest("x.rep", "y.rep").alias("dst"))
            .distinct()
        )
        found = _confirmed(pairs, of, percent)
        edges = packed(cut(found if edges is None else edges.union(found)))
        label = (
            label.select("rep")
            .join(components(edges).withColumnRenamed("v", "rep"), "rep", "left")
            .select("rep", F.coalesce("component", "rep").alias("component"))
        )
        label = packed(cut(label))
    return edges.union(_apart(members, label, of, percent))


def _apart(members: DataFrame, label: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """Edges for all links within a bucket between different components.

    Where few comparisons are left they are pairs; larger buckets are compared in blocks of at
    most TILE sets on either side, where a product of incidence matrices counts what any two sets
    share, and only a spanning tree of the links leaves a block.
    """
    at = cut(members.join(label, "rep"))
    by = at.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = by.groupBy("bucket").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"),
        F.sum("size").alias("right"),
        (F.sum("size") - F.max("size")).alias("left"),
    )
    # of two members, the stars have compared the only pair
    at = cut(at.join(main.where("left > 0 and right > 2"), "bucket"))
    node = F.struct("rep", "n", "u", "component")
    few = at.where(F.col("left") * F.col("right") <= PAIRS)
    pairs = (
        few.where("component <> main").select("bucket", node.alias("x"))
        .join(few.select("bucket", node.alias("y")), "bucket")
        .where((F.col("x.component") != F.col("y.component")) & _possible("x", "y", percent))
        .select(F.least("x.rep", "y.rep").alias("src"), F.greatest("x.rep", "y.rep").alias("dst"))
        .distinct()
    )
    many = at.where(F.col("left") * F.col("right") > PAIRS).join(of.select("rep", "items").dropDuplicates(["rep"]), "rep")
    tiles = lambda side: F.ceil(F.col(side) / TILE).cast("int")
    own = lambda side: F.pmod(F.xxhash64("rep"), tiles(side)).cast("int")
    each = lambda side: F.explode(F.sequence(F.lit(0), tiles(side) - 1))
    left = many.where("component <> main").select("bucket", own("left").alias("i"), each("right").alias("j"), "rep", "items")
    right = many.select(
        F.col("bucket").alias("b"), each("left").alias("k"), own("right").alias("l"), F.col("rep").alias("rep"), F.col("items").alias("items")
    )

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        src, dst = _linked(x, y, percent)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    tiled = left.groupBy("bucket", "i", "j").cogroup(right.groupBy("b", "k", "l")).applyInArrow(compare, "src bigint, dst bigint")
    return _confirmed(pairs, of, percent).union(tiled.distinct())


def _linked(x: pa.Table, y: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links between the sets of two tables (rep, items)."""
    ids = [np.asarray(t["rep"].combine_chunks()) for t in (x, y)]
    lists = [t["items"].combine_chunks() for t in (x, y)]
    if not len(ids[0]) or not len(ids[1]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = [np.diff(np.asarray(v.offsets)) for v in lists]
    items = [np.asarray(v.flatten()) for v in lists]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    known = np.intersect1d(items[0], items[1])  # others are in no intersection
    shared = np.zeros((len(ids[0]), len(ids[1])), np.float32)
    at = [np.searchsorted(known, v) for v in items]
    held = [(a < len(known)) & (known[np.minimum(a, len(known) - 1)] == v) if len(known) else np.zeros(len(v), bool) for a, v in zip(at, items, strict=True)]
    for begin in range(0, len(known), 4096):
        sides = []
        for side in (0, 1):
            inside = held[side] & (at[side] >= begin) & (at[side] < begin + 4096)
            m = np.zeros((len(ids[side]), min(4096, len(known) - begin)), np.float32)
            m[rows[side][inside], at[side][inside] - begin] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    union = sizes[0][:, None] + sizes[1][None] - shared
    link = (100 * shared >= percent * union) & (shared > 0)
    low = [ids[0].copy(), ids[1].copy()]
    none = np.iinfo(np.int64).max
    while True:  # the least id that links lead to
        to_left = np.where(link, low[1][None], none).min(axis=1)
        new = np.minimum(low[0], to_left)
        other = np.minimum(low[1], np.where(link, new[:, None], none).min(axis=0))
        if (new == low[0]).all() and (other == low[1]).all():
            break
        low = [new, other]
    src, dst = np.concatenate(ids), np.concatenate(low)
    return src[src != dst], dst[src != dst]


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and
    carriage return, after A-Z are lower-cased. A text's set holds its distinct ``k``-word
    shingles; with fewer words its whole sequence is the only one. Documents are linked if
    ``100 * intersection >= percent * union``. component_id is the smallest id reachable.

    Null, empty or blank texts have no shingles, link with nothing and are kept. Rows that
    repeat an id are one vertex: each gives a result row, and their links add up. A row without
    id has a null component, is kept, and links with nothing. Other columns are not read. An
    empty table gives an empty one. Texts of any length are hashed whole, 512 shingles at a time.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(signatures(docs, k, percent))
    whole = signed.where("key is not null and doc_id is not null")
    reps = whole.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    # sets stand for themselves by the smallest id of their texts; where an id has several sets, by a hash
    shared = reps.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select(F.col("doc_id").alias("__id"))
    reps = reps.join(shared, F.col("doc_id") == F.col("__id"), "left")
    rep = F.when(F.col("__id").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "key"))
    reps = cut(reps.select("key", "doc_id", rep.alias("rep"), "bands"))
    named = reps.where("rep <> doc_id").select("rep", F.col("doc_id").alias("named"))
    copies = whole.join(reps.select("key", F.col("doc_id").alias("rep")), "key").where("doc_id <> rep").select("doc_id", "rep")
    edges = links(reps.select("rep", "key", "doc_id", "bands"), docs, k, percent)
    for end in ("src", "dst"):
        own = small(named).withColumnRenamed("rep", "__rep")
        edges = edges.join(own, edges[end] == F.col("__rep"), "left").withColumn(end, F.coalesce("named", end)).select("src", "dst")
    found = components(edges.union(copies)).withColumnRenamed("v", "doc_id")
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that near_duplicates doesn't keep; all its columns stay."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
      WHERE 100 * common >= 85 * (len(x.s) + len(y.s) - common)),
r(v, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.v WHERE r.c < e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(c) AS component_id, min(c) = s.doc_id AS kept
FROM s JOIN r ON r.v = s.doc_id GROUP BY s.doc_id, s.s
"""
