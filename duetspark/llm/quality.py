"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh, in_batches, table
from .lang_id import held_out

#: Bound of the labelled sample, hashed terms, latent dimensions, voting neighbours.
SAMPLE, TERMS, DIMS, NEIGHBOURS = 4_000, 4_096, 48, 31
THRESHOLD = 0.3
#: Documents in a block of cosine products.
BLOCK = 512

_SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def _bucket(x: float) -> int:
    return min(9, int(10 * x))


def terms(text: str | None) -> dict[int, float]:
    """Hashed terms of a text and their weights: words, word shapes, and how much repeats."""
    data = (text or "").encode()
    words = data.split()
    out: Counter = Counter()
    if not words:
        return out
    n = len(words)
    for w, c in Counter(data.lower().split()).items():
        out[zlib.crc32(w) % (TERMS // 2)] += c / n
    shapes: Counter = Counter()
    shaped = data.translate(_SHAPES)
    for s, c in Counter(shaped.split()).items():
        shapes[_RUN.sub(rb"\1", s)] += c
    lines = [x for x in data.split(b"\n") if x.strip()]
    counted = Counter(lines)
    pairs = Counter(zip(words, words[1:], strict=False))
    facts = {
        b"length %d" % min(12, int(log(n, 2))): 1.0,
        b"distinct %d" % _bucket(len(set(words)) / n): 1.0,
        b"lines again %d" % _bucket(1 - len(counted) / len(lines)): 1.0,
        b"most common pair %d" % _bucket(max(pairs.values(), default=0) / n): 1.0,
        b"letters %d" % _bucket((shaped.count(b"a") + shaped.count(b"A")) / len(data)): 1.0,
        b"capitals %d" % _bucket(shaped.count(b"A") / len(data)): 1.0,
        b"word again %d" % _bucket(sum(c for (a, b), c in pairs.items() if a == b) / n): 1.0,
    }
    for s, c in shapes.items():
        out[TERMS // 2 + zlib.crc32(b"shape " + s) % (TERMS // 2)] += 4 * (c / n) ** 0.5
    for s, c in facts.items():
        out[TERMS // 2 + zlib.crc32(s) % (TERMS // 2)] += c
    return out


def matrix(texts) -> np.ndarray:
    """Dense rows of term weights; callers hold BLOCK or so many rows at a time."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        t = terms(text)
        row[list(t)] = list(t.values())
    return out


class Model:
    """Term weights, projection, labelled vectors and labels: a few hundred KB, bounded by SAMPLE."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        rng = np.random.default_rng(7)
        weighed = self.weigh(x)
        # truncated singular value decomposition by randomised subspace iteration
        dims = min(DIMS, *x.shape) if len(x) else 0
        q = rng.standard_normal((TERMS, dims)).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(weighed.T @ (weighed @ q))
        self.axes = q
        self.vectors = self.project(x)

    def weigh(self, x: np.ndarray) -> np.ndarray:
        y = x * self.idf
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def project(self, x: np.ndarray) -> np.ndarray:
        y = self.weigh(x) @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def scores(self, texts) -> np.ndarray:
        """Mean label of the nearest labelled vectors, weighted by similarity; the prior without terms."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), BLOCK):
            x = matrix(texts[at : at + BLOCK])
            cosines = self.project(x) @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 4
            total = weight.sum(axis=1)
            voted = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[at : at + BLOCK] = np.where((total > 1e-9) & x.any(axis=1), voted, self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` labelled documents that aren't held out.

    Those with the least hashes of their ids are taken, a documented bound; their hashed terms
    (not their texts) reach the driver. Labels other than 0 and 1 don't count; a document with
    several labels is taken once for each.
    """
    ids = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most ``sample`` rows

    def run(batches):
        for pdf in batches:
            t = [terms(x) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "ks": [list(x) for x in t], "vs": [list(x.values()) for x in t]})

    got = in_batches(rows).mapInPandas(run, "doc_id bigint, quality int, ks array<int>, vs array<double>")
    got = sorted(got.collect(), key=lambda r: (r["doc_id"], r["quality"]))[:sample]
    x = np.zeros((len(got), TERMS), np.float32)
    for row, r in zip(x, got, strict=True):
        row[r["ks"]] = r["vs"]
    return Model(x, np.array([r["quality"] for r in got]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``quality_score`` between 0 and 1, higher where label 1 is likelier.

    Every whole text becomes a vector of its words, word shapes and repetitions, projected to the
    latent space and compared with every labelled vector in blocks; the nearest ones vote with
    their similarity. Null and empty texts get the share of label 1 in the sample. Rows are judged
    one by one, so repeated rows get equal scores and an empty table gives an empty one; other
    columns pass through (the new name gets underscores while it is taken). Without labels every
    score is a half.
    """

    def run(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text.tolist()))

    return in_batches(docs).withColumn(fresh(docs, "quality_score"), F.pandas_udf(run, "double")(F.col(text_col)))


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
