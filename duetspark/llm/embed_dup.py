"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact cosines.

Codes alone are dealt to the tables' buckets, in blocks; a vector travels only to blocks in which
another one's code is within the radius of its own. There exact cosines in double precision decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import components, cut, small, table

#: Bound of the sample that the rotations are learned from.
SAMPLE = 4_096
#: Chance of finding a pair whose cosine is just the threshold, if bits were independent; closer pairs are
#: found more surely (tests measure both).
RECALL = 0.98
#: Vectors on either side of a block of exact products.
TILE = 512
#: Bits of a code at least: fewer would tell little of the distance.
BITS = 128
#: Deviations beyond the mean Hamming distance at the threshold that are still looked at.
DEVIATIONS = 4


class Quantiser:
    """Principal axes and learned rotations: codes that quantise well.

    Cosines look from the origin, so vectors are not centred: around a common mean even vectors at
    a cosine near 1 would point anywhere and share few bits.
    """

    def __init__(self, sample: np.ndarray, bits: int, seed: int = 1, rounds: int = 30):
        dims = sample.shape[1]
        x = sample
        _, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(dims))
        rng, turns = np.random.default_rng(seed), []
        for _ in range(math.ceil(bits / dims)):
            r, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
            y = x @ axes
            for _ in range(rounds if len(x) else 0):
                u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (u @ vt).T
            turns.append(axes @ r)
        self.axes = np.concatenate(turns, axis=1)[:, :bits]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, bytes): codes of whole bytes."""
        return np.packbits(unit @ self.axes >= 0, axis=1, bitorder="little")


class Index:
    """How vectors of one length are looked up: ``tables`` runs of ``width`` bits, and a radius."""

    def __init__(self, sample: np.ndarray, count: int, cosine: float):
        self.tables, self.width = tables_for(count, cosine)
        bits = max(BITS, -(-self.tables * self.width // 8) * 8)
        differ = math.acos(min(1, max(-1, cosine))) / math.pi
        self.radius = math.ceil(bits * differ + DEVIATIONS * math.sqrt(bits * differ * (1 - differ)))
        self.bits, self.quantiser = bits, Quantiser(sample, bits)

    def values(self, codes: np.ndarray) -> np.ndarray:
        """(vectors, tables): the bucket of each code in each table."""
        bits = np.unpackbits(codes, axis=1, bitorder="little")[:, : self.tables * self.width]
        return (bits.reshape(len(codes), self.tables, self.width) * (1 << np.arange(self.width))).sum(axis=2)


def tables_for(count: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Tables and bits of each: buckets of half a block on average, and the recall at the threshold."""
    width = min(20, max(4, round(math.log2(max(count, 1) / 256))))
    agree = (1 - math.acos(min(1, max(-1, cosine))) / math.pi) ** width
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1, width


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size: they are brought near 1 before they are squared."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows_of(vectors: pa.Array, dims: int) -> np.ndarray:
    return _unit(np.asarray(vectors.flatten(), np.float64).reshape(-1, dims))


def _sides(chunk: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)


def _near(codes: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """(left, right) whether codes differ in ``radius`` bits at most."""
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    return signs[left] @ signs[right].T >= signs.shape[1] - 2 * radius


def _survivors(codes, chunk, i, j, radius) -> np.ndarray:
    """Rows of a block with another one within the radius."""
    left, right = _sides(chunk, i, j)
    near = _near(codes, left, right, radius)
    if i == j:
        np.fill_diagonal(near, False)
    keep = np.zeros(len(chunk), bool)
    keep[left[near.any(axis=1)]] = True
    keep[right[near.any(axis=0)]] = True
    return keep


def _tile(ids, weights, unit, values, chunk, i, j, at, cosine):
    """(id, links, least id linked) of one block; a link counts in the first table that has it."""
    left, right = _sides(chunk, i, j)
    link = unit[left] @ unit[right].T >= cosine
    if i == j:
        np.fill_diagonal(link, False)
    a, b = np.nonzero(link)
    if at and len(a):
        fresh = np.ones(len(a), bool)
        for begin in range(0, len(a), 65536):
            part = slice(begin, begin + 65536)
            fresh[part] = ~(values[left[a[part]], :at] == values[right[b[part]], :at]).any(axis=1)
        link[a[~fresh], b[~fresh]] = False
    count = np.zeros(len(ids), np.int64)
    count[left] += link @ weights[right]
    if i != j:
        count[right] += link.T @ weights[left]
    low = ids.copy()
    none = np.iinfo(np.int64).max
    while True:
        new = low.copy()
        new[left] = np.minimum(new[left], np.where(link, low[right][None], none).min(axis=1, initial=none))
        new[right] = np.minimum(new[right], np.where(link, new[left][:, None], none).min(axis=0, initial=none))
        if (new == low).all():
            break
        low = new
    keep = count > 0
    return ids[keep], count[keep], low[keep]


#: A block: length of its vectors, table, bucket, and numbers of its two chunks.
_BLOCK = ["dims", "at", "value", "i", "j"]


def _by_block(each, columns: list[str], kinds: list):
    """A function for mapInArrow over rows in order of their block: ``each(key, rows)`` gives the columns."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def blocks(t: pa.Table, whole: bool):
            key = np.stack([np.asarray(t[k].combine_chunks()) for k in _BLOCK], axis=1)
            ends = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key))
            begin, out = 0, []
            for end in ends if whole else ends[:-1]:
                out.append(each(key[begin], t.slice(begin, end - begin).combine_chunks()))
                begin = end
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], columns), t.slice(begin)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * TILE:
                done, rest = blocks(pa.Table.from_batches(held), False)
                held = rest.combine_chunks().to_batches()
                yield done
        if sum(b.num_rows for b in held):
            yield blocks(pa.Table.from_batches(held), True)[0]

    return run


def _column(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t[name].combine_chunks())


def _codes(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)


def indexes(classes: DataFrame, cosine: float) -> dict[int, Index]:
    """An index for each length of vectors of which there are two or more, learned from at most SAMPLE vectors in all."""
    counts = {r["dims"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).where("n > 1").collect()}
    each = max(64, SAMPLE // max(1, len(counts)))
    out = {}
    for dims, n in counts.items():
        rows = classes.where(F.size("embedding") == dims).orderBy(F.xxhash64("rep"), "rep").limit(each).select("embedding").collect()  # bounded
        out[dims] = Index(_unit(np.array([r[0] for r in rows], np.float64)), n, cosine)
    return out


def links(classes: DataFrame, cosine: float) -> DataFrame | None:
    """(v, links, root) of classes (rep, weight, embedding): partial counts, and edges that span the links."""
    known = indexes(classes, cosine)
    if not known:
        return None

    def encode(batches):
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("embedding").offsets))
            for dims in np.unique(sizes).tolist():
                index = known.get(dims)
                if index is None:
                    continue
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                codes = index.quantiser.codes(_rows_of(part.column("embedding"), dims))
                values = pa.array(index.values(codes).ravel(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), pa.array(np.full(len(codes), dims, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.FixedSizeListArray.from_arrays(values, index.tables).cast(pa.list_(pa.int32()))], ["rep", "dims", "code", "values"],
                )

    coded = cut(classes.select("rep", "embedding").mapInArrow(encode, "rep bigint, dims int, code binary, values array<int>"))
    rows = coded.select("rep", "dims", "code", F.posexplode("values").alias("at", "value"))
    full = coded.select("dims", F.posexplode("values").alias("at", "value")).groupBy("dims", "at", "value").agg(F.count("*").alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    placed = rows.join(full, ["dims", "at", "value"]).select("rep", "dims", "at", "value", "code", chunks.alias("chunks"), F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("chunk"))
    # a chunk meets itself and every other one: tile (i, j) with i <= j
    each = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j")))
    tiles = placed.select("rep", "dims", "at", "value", "code", "chunk", F.explode(each).alias("t")).select(*_BLOCK[:3], "t.i", "t.j", "rep", "code", "chunk")

    def look(key, t):
        keep = np.flatnonzero(_survivors(_codes(t), _column(t, "chunk"), key[3], key[4], known[int(key[0])].radius))
        return [np.full(len(keep), k) for k in key] + [_column(t, "rep")[keep], _column(t, "chunk")[keep]]

    dealt = tiles.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    run = _by_block(look, [*_BLOCK, "rep", "chunk"], [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()])
    found = cut(dealt.mapInArrow(run, "dims int, at int, value int, i int, j int, rep bigint, chunk int"))

    def compare(key, t):
        index = known[int(key[0])]
        unit = _rows_of(t["embedding"].combine_chunks(), int(key[0]))
        return _tile(_column(t, "rep"), _column(t, "weight"), unit, index.values(_codes(t)), _column(t, "chunk"), key[3], key[4], key[1], cosine)

    full_rows = found.join(classes, "rep").join(coded.select("rep", "code"), "rep").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    return full_rows.mapInArrow(_by_block(compare, ["v", "links", "root"], [pa.int64()] * 3), "v bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Codes learned by iterative quantisation are cut into parts, each a hash table; vectors that
    share a bucket and whose whole codes are near are compared by exact cosines in double precision,
    in blocks of TILE, and a pair that several tables find counts once. Equal vectors are one class
    before that. n_links counts other rows at ``cosine`` or more that are found; component_id is the
    smallest id reachable. Only vectors with equally many components can be linked.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing,
    and so do rows without id (null component, kept). Rows that repeat an id are one vertex, but
    count each in n_links; vectors that repeat an id with other components are vertices by the hash
    of both, and their links add up. Other columns are not read; an empty table gives an empty one.
    Floats stay as they are in storage, other numbers become doubles. The rotations are learned from
    a sample of SAMPLE vectors; all vectors are indexed.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    wanted = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(wanted).alias("embedding"))
    v = v.withColumn("ok", _valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    keys = v.select("vec_id", "ok", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    classes = v.where("ok").groupBy(F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")).agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")
    )
    shared = classes.groupBy("least").agg(F.count("*").alias("sets")).where("sets > 1").select(F.col("least").alias("__least"))
    classes = classes.join(small(shared), F.col("least") == F.col("__least"), "left")
    rep = F.when(F.col("__least").isNull(), F.col("least")).otherwise(F.xxhash64("least", "k1", "k2"))
    classes = cut(classes.select("k1", "k2", "least", rep.alias("rep"), "weight", "embedding"))
    found = links(classes.select("rep", "weight", "embedding"), cosine)
    slim = classes.select("k1", "k2", "rep", "least", "weight")
    edges = keys.where("ok").select("vec_id", "k1", "k2").join(slim, ["k1", "k2"]).where("vec_id <> least").select(F.col("vec_id").alias("src"), F.col("least").alias("dst"))
    sums = slim.select("k1", "k2", "rep", (F.col("weight") - 1).alias("copies"))
    if found is None:
        sums = sums.withColumn("links", F.lit(0))
    else:
        found = cut(found)
        named = small(slim.where("rep <> least").select(F.col("rep").alias("__rep"), "least"))
        between = found.select(F.col("v").alias("src"), F.col("root").alias("dst"))
        for end in ("src", "dst"):
            between = between.join(named, F.col(end) == F.col("__rep"), "left").withColumn(end, F.coalesce("least", end)).select("src", "dst")
        edges = edges.union(between)
        sums = sums.join(found.groupBy(F.col("v").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left")
    sums = sums.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies")).cast("bigint").alias("n_links"))
    counted = keys.select("vec_id", "ok", F.when(F.col("ok"), F.col("k1")).alias("k1"), F.when(F.col("ok"), F.col("k2")).alias("k2"))
    return (
        counted.join(sums, ["k1", "k2"], "left")
        .join(components(edges).withColumnRenamed("v", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op9_itq_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.v WHERE r.c < l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.c) AS component_id, min(r.c) = e.vec_id AS kept
FROM embeddings e JOIN r ON r.v = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id
"""
