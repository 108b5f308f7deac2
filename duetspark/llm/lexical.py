"""Ranked lexical search over all documents: an index of byte impacts above exact term counts.

A posting's impact, its share of a document's score, is rounded up to a byte in steps of the term's
own size. Sums of steps bound a score from above, and from below if each byte counts one less. So
two scans of the index rank a corpus: the first finds each item's kth largest lower bound, the second
rescores, in integers, every document whose upper bound reaches it, and no other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut, in_batches, table

TOP = 10
#: Bytes of items' texts that are searched together: their terms travel with the tasks.
ITEM_BYTES = 4 << 20
#: Documents and items whose bounds a task holds at a time.
CELLS = 1 << 22

#: ASCII letters and digits, letters lower-cased, stay; other ASCII is space; bytes of other characters stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The text's terms in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


@dataclass(frozen=True)
class Items:
    """Items of one scan: ids, and for each term the items that hold it and how often."""

    ids: list
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    who: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        found: list[tuple[int, int, int]] = []
        for i, (_, text) in enumerate(rows):
            found += [(vocabulary.setdefault(t, len(vocabulary)), i, n) for t, n in Counter(terms(text)).items()]
        t, who, times = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return cls([r[0] for r in rows], vocabulary, np.searchsorted(t, np.arange(len(vocabulary) + 1)), who, times)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row of ``docs`` (doc_id, text): all its terms' number, and of the
    vocabulary's terms their numbers and occurrences. No row moves."""

    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for x in text.tolist():
            found = terms(x)
            own = {v: c for t, c in Counter(found).items() if (v := vocabulary.get(t)) is not None}
            out.append((len(found), list(own), list(own.values())))
        return pd.DataFrame(out, columns=["n", "terms", "tfs"])

    counted = F.pandas_udf(run, "n bigint, terms array<int>, tfs array<bigint>")("text").alias("c")
    return in_batches(docs).select("doc_id", counted).select("doc_id", "c.*")


@dataclass(frozen=True)
class Corpus:
    """What scores need of the whole corpus: documents with a term, their terms, and each term's weight."""

    documents: int
    terms: int
    weights: np.ndarray


def statistics(counted: DataFrame, size: int) -> Corpus:
    """Over all documents; the vocabulary of ``size`` terms bounds what comes to the driver."""
    n = counted.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(size, np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    w = np.array([math.floor(1000 * math.log((2 * n["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return Corpus(n["n"], n["l"] or 0, w)


def _steps(weights: np.ndarray) -> np.ndarray:
    """What one unit of a term's byte is worth: 255 of them are more than any impact of the term."""
    return np.maximum(-(-weights * 1_000_000 // 255), 1)


def _impacts(weights: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


def quantised(counted: DataFrame, corpus: Corpus) -> DataFrame:
    """The index: (doc_id, terms, bytes; m, tfs), a row a document with any of the terms. The first three
    columns are what bounds need, the last two what exact scores need beside the terms."""
    w = corpus.weights
    step = _steps(w)

    def run(n: pd.Series, terms: pd.Series, tfs: pd.Series) -> pd.DataFrame:
        m = [100 - 75 + 75 * x * corpus.documents // corpus.terms for x in n.tolist()]  # may pass 64 bits on the way
        sizes = terms.map(len).to_numpy()
        t = _flat(terms, np.int64)
        e = _impacts(w[t], _flat(tfs, np.int64), np.repeat(np.array(m, np.int64), sizes))
        up = (-(-e // step[t])).astype(np.uint8)
        return pd.DataFrame({"bytes": [x.tobytes() for x in np.split(up, np.cumsum(sizes)[:-1])] if len(m) else [], "m": m})

    level = F.pandas_udf(run, "bytes binary, m bigint")("n", "terms", "tfs").alias("c")
    return counted.where(F.size("terms") > 0).select("doc_id", "terms", level, "tfs").select("doc_id", "terms", "c.*", "tfs")


def _flat(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.asarray(x, kind) for x in column]) if len(column) else np.zeros(0, kind)


def _sums(items: Items, doc: np.ndarray, t: np.ndarray, values: np.ndarray, docs: int) -> np.ndarray:
    """(docs, items): for each the values of the document's postings, as often as the item has their terms."""
    per = items.starts[t + 1] - items.starts[t]
    at = np.repeat(np.arange(len(t)), per)
    own = items.starts[t[at]] + np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
    out = np.zeros(docs * len(items.ids), np.int64)
    np.add.at(out, doc[at] * len(items.ids) + items.who[own], values[at] * items.times[own])
    return out.reshape(docs, len(items.ids))


def _blocks(pdf: pd.DataFrame, items: Items) -> Iterator[pd.DataFrame]:
    size = max(1, CELLS // max(1, len(items.ids)))
    return (pdf.iloc[a : a + size] for a in range(0, len(pdf), size))


def _postings(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, terms and bytes of the documents' postings."""
    doc = np.repeat(np.arange(len(pdf)), pdf["terms"].map(len).to_numpy())
    return doc, _flat(pdf["terms"], np.int64), np.frombuffer(b"".join(pdf["bytes"]), np.uint8).astype(np.int64)


def _thresholds(index: DataFrame, items: Items, corpus: Corpus, top: int) -> np.ndarray:
    """Each item's ``top``-th largest lower bound, 1 where fewer documents have a score."""
    step = _steps(corpus.weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.zeros((top, len(items.ids)), np.int64)
        for pdf in batches:
            for part in _blocks(pdf, items):
                doc, t, up = _postings(part)
                lower = _sums(items, doc, t, ((up - 1) * step[t] + 1) * (up > 0), len(part))
                if len(lower) > top:
                    lower = np.partition(lower, len(lower) - top, axis=0)[-top:]
                best = np.sort(np.vstack([best, lower]), axis=0)[-top:]
        k, i = np.nonzero(best)
        yield pd.DataFrame({"item": i, "bound": best[k, i]})

    found = index.select("terms", "bytes").mapInPandas(run, "item int, bound bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))
    out = np.ones(len(items.ids), np.int64)
    for r in found.withColumn("k", place).where(F.col("k") == top).collect():  # one row an item at most
        out[r["item"]] = max(1, r["bound"])
    return out


def _ranked(index: DataFrame, items: Items, corpus: Corpus, top: int, item_kind: str) -> DataFrame:
    kind, w, step = dict(index.dtypes)["doc_id"], corpus.weights, _steps(corpus.weights)
    least = _thresholds(index, items, corpus, top)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _blocks(pdf, items):
                doc, t, up = _postings(part)
                fit = _sums(items, doc, t, up * step[t], len(part)) >= least
                some = fit.any(axis=1)
                keep = some[doc]
                rows = np.cumsum(some) - 1
                tf, m = _flat(part["tfs"], np.int64)[keep], part["m"].to_numpy(np.int64)
                exact = _sums(items, rows[doc[keep]], t[keep], _impacts(w[t[keep]], tf, m[doc[keep]]), int(some.sum()))
                r, i = np.nonzero(fit[some] & (exact > 0))
                yield pd.DataFrame({"item": i, "doc_id": part["doc_id"].to_numpy()[some][r], "score": exact[r, i]})

    names = index.sparkSession.createDataFrame([(i, x) for i, x in enumerate(items.ids)], f"item int, item_id {item_kind}")
    by_name = index.withColumn("doc_id", F.col("doc_id").cast("string"))  # a number may be null there, which pandas would make a float
    found = by_name.mapInPandas(run, "item int, doc_id string, score bigint").withColumn("doc_id", F.col("doc_id").cast(kind))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))  # cut to the first rows before they are shuffled
    best = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: the items of one scan


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) its ``top`` documents of
    ``docs`` (doc_id, text) by score, equal scores by id; fewer where fewer have a score above 0.

    Null texts have no terms: such items get no rows, such documents are in none and not counted among
    the documents. Rows that repeat are documents, or items, of their own. Empty tables give no rows;
    other columns are not read. Long texts count whole. Items are searched in blocks of at most
    ITEM_BYTES of text or one item; each block is two scans of an index that was written once.
    """
    kind = dict(items.dtypes)["item_id"]
    sized = items.where("text is not null").select("item_id", "text", F.octet_length("text").alias("bytes"))
    # blocks follow from running sums by hash: few rows of sums, no rank over all items
    buckets = max(1, -(-(sized.agg(F.sum("bytes")).first()[0] or 0) // (ITEM_BYTES // 2)))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets)))
    out = None
    for block in range(buckets):
        own = Items.of([(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == block).select("item_id", "text").collect()])
        if not own.vocabulary:
            continue
        counted = cut(count_terms(docs, own.vocabulary))
        corpus = statistics(counted, len(own.vocabulary))
        if corpus.documents:
            found = _ranked(cut(quantised(counted, corpus)), own, corpus, top, kind)
            out = found if out is None else out.unionByName(found)
    none = f"item_id {kind}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score bigint"
    return docs.sparkSession.createDataFrame([], none) if out is None else out


def op11_two_level_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH q AS (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark),
i AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY ALL),
d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, len(ts) AS size, unnest(ts) AS t FROM d),
f AS (SELECT doc_id, size, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l)))) AS BIGINT) AS score FROM f JOIN w USING (t) JOIN i USING (t) CROSS JOIN c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
