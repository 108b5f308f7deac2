"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

A window has as many words as the benchmark item it is held against. A window without any shingle
of an item of its length has similarity 0; all others are fingerprinted and looked up in an index
of the items' fingerprints, which alone selects what is compared exactly. The index has BLOCKS
blocks of ten bits or more: of two fingerprints within the radius, one block at least differs in no
more than radius // BLOCKS bits, and every value so near to an item's is a key of the item. Around
each window that the index finds, the exact weighted Jaccard similarity of the shingle multisets
decides, for each window of the same place.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, fresh, small, table

#: At similarity 0.8 fingerprints differ in 9.7 bits of 64 on average (deviation 2.9): 17 holds 99.6 % of windows
#: just there (tests measure it), and one of 7,000 windows of other words.
RADIUS = 17
BITS, BLOCKS = 64, 6
SHINGLE, PERCENT = 5, 80
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(w: Column, k: Column, stride: int = 1) -> Column:
    """Positions (from 0) and hashes of the k-word shingles of a word array."""
    last = F.size(w) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(w, i + 1, k)).alias("h")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _lane(j: int, ones: Column):
    return lambda s, h: s + F.shiftrightunsigned(h, j).bitwiseAND(ones)


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of a column of arrays of 64-bit hashes; a hash counts as often as it occurs.

    Votes of eight bits are counted at once, each in a byte of a long; for longer arrays, of two in halves.
    """
    none, size = F.lit(0).cast("bigint"), F.size(hashes)

    def packed(lanes: int) -> Column:
        width = 64 // lanes
        ones = F.lit(sum(1 << (width * i) for i in range(lanes)))

        def won(s: Column, x: Column) -> Column:
            for lane in range(lanes):  # bit lane * width + j has its votes in that lane of the sum j
                votes = F.shiftrightunsigned(x["votes"], lane * width).bitwiseAND(F.lit((1 << width) - 1))
                bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), x["j"] + lane * width)
                s = s.bitwiseOR(F.when(votes * 2 > size, bit).otherwise(none))
            return s

        sums = [F.struct(F.aggregate(hashes, none, _lane(j, ones)).alias("votes"), F.lit(j).alias("j")) for j in range(width)]
        return F.aggregate(F.array(*sums), none, won)

    return F.when(size < 1 << 8, packed(8)).otherwise(packed(2))


def _block(fingerprint: Column, i: int) -> Column:
    """The value of a fingerprint's block ``i`` of BLOCKS."""
    lo, hi = BITS * i // BLOCKS, BITS * (i + 1) // BLOCKS
    return F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _flipped(value: Column, flips: list[int]) -> Column:
    # no second parameter with a default: Spark would hand it the place in the array
    return F.transform(F.array(*[F.lit(x).cast("bigint") for x in flips]), lambda x: value.bitwiseXOR(x))


def blocks(fingerprint: Column, near: int = 0) -> Column:
    """Keys of a fingerprint: BLOCKS runs of bits, each with its number above its value; with
    ``near``, also all values of a block that differ in so many bits at most."""
    keys = []
    for i in range(BLOCKS):
        width = BITS * (i + 1) // BLOCKS - BITS * i // BLOCKS
        flips = [sum(1 << x for x in own) for k in range(near + 1) for own in combinations(range(width), k)]
        keys.append(_flipped(_block(fingerprint, i) + F.lit(i << 32), flips))
    return F.concat(*keys)


def _pairs(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Rows of ``windows(n, fp, ...)`` beside the key of each item(key, n, fp) of their length whose
    fingerprint differs in ``radius`` bits at most.

    Several blocks may be near: a pair is taken from the first of them alone, so it comes once.
    """
    near = radius // BLOCKS
    ours = windows.withColumn("block", F.explode(blocks(F.col("fp"))))
    theirs = small(items.select("key", "n", F.col("fp").alias("fp2"), F.explode(blocks(F.col("fp"), near)).alias("block")))
    apart = F.col("fp").bitwiseXOR(F.col("fp2"))
    first = F.coalesce(*[F.when(F.bit_count(_block(apart, i)) <= near, F.lit(i)) for i in range(BLOCKS)])
    return (
        ours.join(theirs, ["n", "block"])
        .where((F.bit_count(apart) <= radius) & (F.shiftright("block", 32) == first)).drop("block", "fp", "fp2")
    )


def _ranges(at: Column, before: Column, after: Column, last: Column) -> Column:
    """Each number from x - before to x + after for the x of a sorted array, within 0 and ``last``, once."""
    return F.flatten(F.transform(at, lambda x, i: _between(
        F.greatest(x - before, F.lit(0), F.coalesce(F.get(at, i - 1) + after + 1, F.lit(0))), F.least(x + after, last)
    )))


def _between(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def stride_for(percent: int, shingles: int) -> int:
    """The largest stride up to 4 at which a window of so many shingles or more meets a shared one.

    Of n shingles at most n * (1 - r) / (1 + r) are foreign at similarity r.
    """
    r = percent / 100
    for stride in range(min(4, shingles), 1, -1):
        if all(n // stride > n * (1 - r) / (1 + r) for n in range(shingles, 64)):
            return stride
    return 1


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, windows) of items that documents hold.

    A window of an item's length, starting at any word ``start`` (from 0), counts if
    ``100 * shared >= percent * all`` over the multisets of k-word shingles of lower-cased runs
    of letters and digits; an item of fewer words is one shingle. The row has the most similar
    window, the first of equals, and how many windows count.

    Null and empty texts and items match nothing; rows without id give rows without id; rows that
    repeat an id count as one document; items that repeat an id count as one if their texts are
    equal, else each is held against the documents under that id. Other columns are not read.
    Empty tables give an empty one. Words of a document leave its row only if it has a shingle of
    an item where the stride looks. Texts are kept and shuffled as they are, not as words, and rows
    of positions and windows don't carry them.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).distinct()
    items = items.where(F.size("w") > 0).withColumns({"n": F.size("w"), "k": F.least(F.size("w"), F.lit(k))})
    hashes = F.transform(_grams(F.col("w"), F.col("k")), lambda g: g["h"])
    items = items.withColumns({"key": F.xxhash64("item_id", "w"), "hashes": hashes, "full": _full(F.col("w"), F.col("k"))})
    items = cut(items.withColumns({"fp": simhash(F.col("hashes")), "numbered": _numbered(F.col("full"))}).drop("full"))
    widths = sorted(r["k"] for r in items.select("k").distinct().collect())  # 1 to k at most
    shortest = items.agg(F.min(F.col("n") - F.col("k") + 1)).first()[0] or 1
    stride = stride_for(percent, shortest)
    seeds = small(items.select("n", "k", F.explode("hashes").alias("h")).distinct())
    any_seed = small(seeds.select("k", "h").distinct())

    text = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    met = None
    for width in widths:
        step = stride if width == k else 1
        at = text.select("doc_id", F.explode(_grams(F.col("w"), F.lit(width), step)).alias("g"))
        own = at.join(any_seed.where(F.col("k") == width), F.col("g.h") == F.col("h"), "left_semi").select("doc_id")
        met = own if met is None else met.union(own)
    met = cut((text.select("doc_id").where("false") if met is None else met).distinct())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    suspects = texts.join(small(met).withColumnRenamed("doc_id", "met"), F.col("doc_id").eqNullSafe(F.col("met"))).drop("met")
    suspects = cut(suspects.withColumn("text_key", F.xxhash64(words(F.col("text")))).dropDuplicates(["doc_id", "text_key"]))

    # positions of items' shingles, by length of the items; a document's, so never more than its words
    hits, split = None, suspects.select("doc_id", "text_key", words(F.col("text")).alias("w")).withColumn("m", F.size("w"))
    for width in widths:
        at = split.select("doc_id", "text_key", "m", F.explode(_grams(F.col("w"), F.lit(width))).alias("g"))
        own = at.join(seeds.where(F.col("k") == width), F.col("g.h") == F.col("h")).select("doc_id", "text_key", "m", "n", "k", "g.at")
        hits = own if hits is None else hits.union(own)
    if hits is None:
        hits = suspects.select("doc_id", "text_key", F.lit(0).alias("m"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(0).alias("at"))
    each = F.col("n") - F.col("k") + 1
    last = F.col("m") - F.col("n")
    places = hits.where("m >= n").groupBy("doc_id", "text_key", "m", "n", "k").agg(F.array_sort(F.collect_set("at")).alias("at"))
    starts = places.select("doc_id", "text_key", "m", "n", "k", _ranges(F.col("at"), each - 1, F.lit(0), last).alias("starts"))
    whole = suspects.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "text")
    own = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("t"))

    def printed(w: Column) -> Column:
        def of(start: Column) -> Column:
            shingles = F.transform(F.sequence(start + 1, start + each), lambda i: F.xxhash64(F.slice(w, i, F.col("k"))))
            return F.struct(start.alias("start"), _let(shingles, simhash).alias("fp"))

        return F.transform("starts", of)

    windows = (
        whole.join(starts, own).select("doc_id", "text_key", "m", "n", "k", F.explode(_let(words(F.col("text")), printed)).alias("at"))
        .select("doc_id", "text_key", "m", "n", "k", "at.start", "at.fp")
    )
    windows = cut(windows)  # each fingerprint is made once

    near = (
        _pairs(windows, items, radius)
        .groupBy("doc_id", "text_key", "m", "n", "k", "key").agg(F.array_sort(F.collect_set("start")).alias("at"))
    )

    # exact, and for all windows of the place: a found one and others over the threshold are less than a quarter apart.
    # a multiset's shingles are numbered as they recur, so what two multisets share is an intersection
    reach = F.floor(each / 4).cast("int") + 1
    near = near.select("doc_id", "text_key", "n", "k", "key", _ranges(F.col("at"), reach, reach, last).alias("starts"))
    ref = items.select("key", "item_id", F.col("numbered").alias("theirs"))
    ref = small(ref, 20_000, F.aggregate("theirs", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)))

    def compared(w: Column) -> Column:
        def of(start: Column) -> Column:
            own = _let(F.slice(w, start + 1, F.col("n")), lambda x: _full(x, F.col("k")))
            return F.struct(start.alias("start"), F.size(F.array_intersect(_let(own, _numbered), "theirs")).alias("shared"))

        return F.transform("starts", of)

    held = (
        whole.join(near, own).join(ref, "key")
        .select("item_id", "doc_id", "n", (2 * each).alias("all"), F.explode(_let(words(F.col("text")), compared)).alias("at"))
        .select("doc_id", "item_id", "at.start", "n", "all", "at.shared")
    )
    return (
        held.where(100 * F.col("shared") >= percent * (F.col("all") - F.col("shared")))
        .select("doc_id", "item_id", "start", "n", F.round(F.col("shared") / (F.col("all") - F.col("shared")), 6).alias("similarity"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.min_by("start", F.struct(-F.col("similarity"), "start")).alias("start"),
            F.min_by("n", F.struct(-F.col("similarity"), "start")).alias("n_words"),
            F.max("similarity").alias("similarity"),
            F.count("*").alias("windows"),
        )
    )


def _full(w: Column, k: Column) -> Column:
    """The k-word shingles in full."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))


def _numbered(full: Column) -> Column:
    """A column of shingles, each with how often it has occurred so far."""
    again = F.transform(full, lambda g, i: F.concat(g, F.lit(" #"), F.size(F.filter(F.slice(full, F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    return F.when(F.size(F.array_distinct(full)) == F.size(full), F.transform(full, lambda g: F.concat(g, F.lit(" #1")))).otherwise(again)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay, and rows without id.

    Documents are shuffled only if more ids go than are broadcast.
    """
    leaks = cut(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(fresh(docs, "leak"))).distinct())
    return docs.join(small(leaks), docs["doc_id"] == leaks[leaks.columns[0]], "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
t AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ig AS (SELECT item_id, n, k, w, unnest(range(1, n - k + 2)) AS p FROM t),
ig2 AS (SELECT item_id, n, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM ig),
dg AS (SELECT doc_id, len(w) AS m, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, (SELECT DISTINCT k FROM t)),
dg2 AS (SELECT doc_id, m, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM dg),
s AS (SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(1, dg2.p - n + k), least(dg2.p, m - n + 1) + 1)) - 1 AS start
      FROM dg2 JOIN (SELECT DISTINCT item_id, n, k, g FROM ig2) USING (k, g) WHERE n <= m),
a AS (SELECT s.doc_id, s.item_id, s.start, s.n, s.k, g, count(*) AS c FROM s JOIN dg2 ON dg2.doc_id = s.doc_id AND dg2.k = s.k
      AND dg2.p > s.start AND dg2.p <= s.start + s.n - s.k + 1 GROUP BY ALL),
b AS (SELECT item_id, g, count(*) AS c FROM ig2 GROUP BY ALL),
m AS (SELECT doc_id, item_id, a.start, n, 2 * (n - k + 1) AS z, sum(least(a.c, b.c)) AS shared FROM a JOIN b USING (item_id, g) GROUP BY ALL),
f AS (SELECT *, round(shared / (z - shared), 6) AS similarity FROM m WHERE 100 * shared >= 80 * (z - shared))
SELECT doc_id, item_id, CAST(arg_min(f.start, {'a': -similarity, 'b': f.start}) AS INTEGER) AS start, CAST(min(n) AS INTEGER) AS n_words,
  max(similarity) AS similarity, count(*) AS windows FROM f GROUP BY doc_id, item_id
"""
