"""Lines that many documents repeat, dropped by an index from which documents can be taken out again.

The index has three tables. ``holders`` names each key's documents, ``counts`` says how many those
are and which has the largest id: they are exact. ``filters`` has a cuckoo filter for each shard of
keys, with the keys that at least ``min_docs`` documents hold. Cleaning asks the filters first; only
keys that they know are looked up in ``counts``, so a false hit costs a look-up and never a line.
Adding and taking out documents moves keys over ``min_docs`` either way, into the filters and out of
them: what a cuckoo filter can do and a Bloom filter can't.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, table

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that a shard is meant to hold, of all that the index counts when it is built.
SHARD_KEYS = 100_000
#: Keys that at least so many lines of a table have, and one in so many of all its lines, are hot: at
#: most HOT_KEYS of them, so they can be broadcast.
HOT_LINES, HOT_KEYS = 10_000, 10_000
#: Slots of a bucket, moves before a filter counts as full, share of slots filled when it is made.
SLOTS, MOVES, LOAD = 4, 500, 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\v\f\r"
_KEY = ["k1", "k2"]


# ---- one shard's cuckoo filter ----


class Cuckoo:
    """16-bit fingerprints in buckets of four; 0 is an empty slot. A key is two 64-bit hashes.

    A key's second bucket follows from the first and the fingerprint alone, so that fingerprints
    move without their keys. Keys must be added once each, and only those be taken out.
    """

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(0, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        print_ = (k2.astype(np.int64).view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = k1.astype(np.int64).view(np.uint64) & mask
        return print_, first.astype(np.int64), (first ^ self._jump(print_)).astype(np.int64)

    def _jump(self, print_: np.ndarray) -> np.ndarray:
        return (print_.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.slots) - 1)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        p, a, b = self._places(k1, k2)
        return ((self.slots[a] == p[:, None]) | (self.slots[b] == p[:, None])).any(axis=1)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Whether all keys found room; if not, the filter is to be made anew, larger."""
        rng, slots = np.random.default_rng(1), self.slots
        for p, a, b in zip(*(x.tolist() for x in self._places(k1, k2)), strict=True):
            for _ in range(MOVES):
                at = next((x for x in (a, b) if not slots[x].all()), None)
                if at is not None:
                    slots[at, int(np.argmin(slots[at] != 0))] = p
                    break
                at, j = (a, b)[int(rng.integers(2))], int(rng.integers(SLOTS))
                p, slots[at, j] = int(slots[at, j]), p
                a = b = at ^ int(self._jump(np.array([p], np.uint16))[0])
            else:
                return False
        return True

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self._places(k1, k2)), strict=True):
            for at in (a, b):
                hit = np.flatnonzero(self.slots[at] == p)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break


def _made(k1: np.ndarray, k2: np.ndarray) -> Cuckoo:
    """A filter of these keys, as large as it must be."""
    room = max(len(k1), 1)
    while not (made := Cuckoo.sized(room)).add(k1, k2):
        room *= 2
    return made


# ---- keys ----


def _lines(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _exploded(docs: DataFrame, keep: list[str], min_chars: int) -> DataFrame:
    """(keep, pos, k1, k2): a row for each line with a key that is long enough.

    The key is the line, stripped and with A-Z lower-cased. Two hashes of 64 bits stand for it: of a
    trillion keys any two agree in both with a chance of 2e-15.
    """
    low = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), "\n", -1)  # the whole text at once
    key = F.btrim(F.col("line"), F.lit(_SPACE))
    lines = docs.select(*keep, F.posexplode(low).alias("pos", "line")).where(F.length(key) >= min_chars)
    return lines.select(*keep, "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2"))


def _holders(docs: DataFrame, min_chars: int) -> DataFrame:
    return _exploded(docs.where("doc_id is not null"), ["doc_id"], min_chars).select(*_KEY, "doc_id").distinct()


def _counts(holders: DataFrame) -> DataFrame:
    return holders.groupBy(*_KEY).agg(F.count("*").alias("refs"), F.max("doc_id").alias("keeper"))


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("k1", 32), F.lit(shards))  # other bits than those that name a bucket


# ---- the index ----


@dataclass(frozen=True)
class LineIndex:
    """holders (k1, k2, doc_id), counts (k1, k2, refs, keeper) and filters (shard, slots): tables that are
    written, not plans. ``insert`` and ``delete`` give a new index and leave this one as it is."""

    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    def _with(self, holders: DataFrame, changed: DataFrame) -> LineIndex:
        """The index over ``holders``, of whose keys only those in ``changed`` (k1, k2, cut) have other documents."""
        new = _counts(holders.join(changed, _KEY, "left_semi"))
        was = self.counts.join(changed, _KEY, "left_semi").select(*_KEY, F.col("refs").alias("was"))
        moved = cut(changed.join(new, _KEY, "left").join(was, _KEY, "left").withColumns({"refs": F.coalesce("refs", F.lit(0)), "was": F.coalesce("was", F.lit(0))}))
        rest = self.counts.join(changed, _KEY, "left_anti")
        counts = cut(rest.unionByName(moved.where("refs > 0").select(*_KEY, "refs", "keeper")))
        n = self.min_docs
        ins, outs = F.col("refs") >= n, F.col("was") >= n
        delta = moved.where(ins != outs).select(_shard(self.shards).alias("shard"), *_KEY, ins.alias("adds"))
        filters = cut(_updated(self.filters, delta))
        full = filters.where("slots is null").select("shard")
        again = counts.where(F.col("refs") >= n).withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi")
        made = _updated(full.withColumn("slots", F.lit(None).cast("binary")), again.select("shard", *_KEY, F.lit(True).alias("adds")))
        return LineIndex(holders, counts, cut(filters.where("slots is not null").unionByName(made)), self.shards, self.min_chars, n)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents (doc_id, text) too. What the index already knows of an id counts once."""
        new = cut(_holders(docs, self.min_chars).join(self.holders, [*_KEY, "doc_id"], "left_anti"))
        return self._with(cut(self.holders.unionByName(new)), cut(new.select(*_KEY).distinct()))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents in ``ids`` (doc_id): as if they had never been inserted."""
        ids = ids.select("doc_id").distinct()
        changed = cut(self.holders.join(ids, "doc_id", "left_semi").select(*_KEY).distinct())
        return self._with(cut(self.holders.join(ids, "doc_id", "left_anti").select(*_KEY, "doc_id")), changed)

    def repeated(self, keys: DataFrame) -> DataFrame:
        """Of distinct ``keys`` (k1, k2, n), written before, those that enough documents hold, with ``keeper``.

        Keys far more than the index has are asked in parts, each beside a copy of its shard's filter.
        """
        parts = max(1, -(-keys.count() // (self.shards * SHARD_KEYS)))
        hits = _asked(self.filters, keys.select(_shard(self.shards).alias("shard"), F.pmod("k2", F.lit(parts)).alias("part"), *_KEY, "n"), parts)
        return hits.join(self.counts, _KEY).where(F.col("refs") >= self.min_docs).select(*_KEY, "n", "keeper")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text, ...) with the repeated lines dropped from ``text``, and n_lines, n_dropped.

        A line goes if at least ``min_docs`` documents of the index hold its key and the document
        isn't the one with the largest id among them; all its other copies in that one stay. Text is
        split at line feeds: null or empty text is one empty line, and comes back empty. Rows are
        judged one by one, rows that repeat alike; a row without an id is no document of the index and
        keeps no line that is repeated. Other columns stay, those named like the new ones are replaced.
        """
        own = ["doc_id", "__h1", "__h2"]  # rows with one id may have different texts
        marked = docs.withColumns({"__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit(7), "text")})
        lines = _exploded(marked, own, self.min_chars)
        keys = cut(lines.groupBy(*_KEY).agg(F.count("*").alias("n")))
        gone = _met(lines, cut(self.repeated(keys)), keys.agg(F.sum("n")).first()[0] or 0)
        gone = gone.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select(*own, "pos").distinct()
        gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("__h1").alias("__g1"), F.col("__h2").alias("__g2")).agg(F.collect_list("pos").alias("__gone"))
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2"))
        both = marked.join(gone, same, "left").select(*docs.columns, "__gone")
        parts, dropped = _lines("text"), F.coalesce("__gone", F.array().cast("array<int>"))
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), dropped)
        kept = F.array_join(F.transform(stay, lambda p: F.get(parts, p)), "\n")
        text = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
        return both.withColumns({"n_lines": F.size(parts).cast("bigint"), "n_dropped": F.size(dropped).cast("bigint"), "text": text}).drop("__gone")


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The index of the documents (doc_id, text). Rows without an id are left out, rows with one id are
    one document, lines that repeat in it count once; an empty table gives an empty index.

    Shards are as many as the keys ask for, so a filter and the keys that meet it in a task stay small
    whatever the table's size; keys are spread by their hash and stand once each, however often their
    lines are repeated.
    """
    spark = docs.sparkSession
    holders = cut(_holders(docs, min_chars))
    counts = cut(_counts(holders))
    shards = max(1, -(-counts.count() // shard_keys))
    known = counts.where(F.col("refs") >= min_docs).select(_shard(shards).alias("shard"), *_KEY, F.lit(True).alias("adds"))
    empty = spark.createDataFrame([], "shard bigint, slots binary")
    return LineIndex(holders, counts, cut(_updated(empty, known)), shards, min_chars, min_docs)


def _updated(filters: DataFrame, delta: DataFrame) -> DataFrame:
    """The filters after ``delta`` (shard, k1, k2, adds); ``slots`` is null where one is full. A filter without slots is made."""

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else new)["shard"].iloc[0])
        adds = new["adds"].to_numpy(bool)
        k1, k2 = new["k1"].to_numpy(np.int64), new["k2"].to_numpy(np.int64)
        data = old["slots"].iloc[0] if len(old) else None
        if data is None:
            return pd.DataFrame({"shard": [shard], "slots": [_made(k1[adds], k2[adds]).bytes()]})
        f = Cuckoo.read(data)
        f.remove(k1[~adds], k2[~adds])
        return pd.DataFrame({"shard": [shard], "slots": [f.bytes() if f.add(k1[adds], k2[adds]) else None]})

    return filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(run, "shard bigint, slots binary")


def _met(lines: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """``lines`` (k1, k2, ...) whose key is in ``repeated`` (k1, k2, n, keeper), with ``keeper``.

    Hot keys are broadcast: no more than HOT_KEYS can each have that share of the ``total`` lines. Their
    lines pass the join with the other keys under made-up ones, spread over all tasks.
    """
    is_hot = F.col("n") >= max(HOT_LINES, -(-total // HOT_KEYS))
    hot = F.broadcast(repeated.where(is_hot).select(*_KEY, F.col("keeper").alias("__keeper"), F.lit(True).alias("__hot")))
    cold = repeated.where(~is_hot).select(F.lit(False).alias("__hot"), F.col("k1").alias("__a"), F.col("k2").alias("__b"), "keeper")
    marked = lines.join(hot, _KEY, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    marked = marked.withColumns({"__a": F.when(F.col("__hot"), F.xxhash64("doc_id", "pos")).otherwise(F.col("k1")), "__b": F.col("k2")})
    both = marked.join(cold, ["__hot", "__a", "__b"], "left").withColumn("keeper", F.coalesce("__keeper", "keeper"))
    return both.where(F.col("__hot") | F.col("keeper").isNotNull()).drop("__hot", "__a", "__b", "__keeper")


def _asked(filters: DataFrame, keys: DataFrame, parts: int) -> DataFrame:
    """Of distinct keys (shard, part, k1, k2, n) those that their shard's filter knows."""

    def run(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(asked):
            return asked.iloc[:0][[*_KEY, "n"]]
        hit = Cuckoo.read(known["slots"].iloc[0]).has(asked["k1"].to_numpy(np.int64), asked["k2"].to_numpy(np.int64))
        return asked.loc[hit, [*_KEY, "n"]]

    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return copies.groupBy("shard", "part").cogroup(keys.groupBy("shard", "part")).applyInPandas(run, "k1 bigint, k2 bigint, n bigint")


def op12_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return build(docs).clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SQL_KEY = f"translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT *, {_SQL_KEY} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
