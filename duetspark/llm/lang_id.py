"""Language identification by compression: the language whose dictionary shortens a text most."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import fresh, in_batches, table

#: The fitted sample: passages a language, from anywhere in its documents, and characters of a passage.
PASSAGES, PASSAGE = 192, 512
#: Compression levels, the second for texts that the first leaves undecided.
LEVEL, SECOND_LEVEL = 5, 12
#: Relative gain over the second language below which a document is rejected.
MARGIN = 0.02
#: Bytes of letters compressed at a time: a longer text would soon be its own dictionary, and the margin would shrink.
PIECE = 4096
UND = "und"

_SEPARATORS = re.compile(r"[\W\d_]+")
_SCORES = "lang_pred string, score double, margin double, rejected boolean"


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents that nothing may learn from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def plain(text: str | None) -> bytes:
    """Lower-cased runs of letters between single spaces; empty without letters."""
    words = _SEPARATORS.sub(" ", (text or "").lower()).strip()
    if not words.replace(" ", "").isalpha():  # fractions, circled and Roman numerals are no letters either
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return f" {words} ".encode() if words else b""


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each language, the most frequent language first.

    Whole texts with a language that aren't held out are cut into passages of PASSAGE characters;
    a language's dictionary is made of the PASSAGES of them with the least hashes of document and
    number, a bounded sample from everywhere in the texts, which is all that reaches the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    passages = F.sum(F.ceil(F.length("text") / PASSAGE)).alias("passages")
    counts = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), passages).collect()}
    if not counts:
        return {}
    # twice as many as are wanted pass a bound on the hash, so that few have to be put in order
    chance = F.create_map(*[F.lit(x) for lang, r in counts.items() for x in (lang, min(1.0, 2 * PASSAGES / r["passages"]))])
    parts = rows.select("id", "lang", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % PASSAGE), F.lit(0))).alias("k", "text"))
    parts = parts.withColumn("h", F.xxhash64("id", "k")).where(F.shiftrightunsigned("h", 11) / 2.0**53 <= chance[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("h", "id", "k", "text")
    sample = parts.withColumn("at", F.row_number().over(order)).where(F.col("at") <= PASSAGES).orderBy("lang", "at").collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x]["n"], x)):
        out[lang] = b"".join(dict.fromkeys(plain(r["text"]) for r in sample if r["lang"] == lang))
    return out


class Classifier:
    """Compresses with every dictionary. Made in the worker, as compressors can't be sent."""

    def __init__(self, model: dict[str, bytes], margin: float):
        self.langs, self.margin, self.by_level = list(model), margin, {}
        for level in (LEVEL, SECOND_LEVEL):
            self.by_level[level] = []
            for data in model.values():
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                self.by_level[level].append(
                    zstandard.ZstdCompressor(
                        level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
                    )
                )

    def sizes(self, data: bytes, level: int) -> np.ndarray:
        """Bytes of all pieces of ``data`` together, with each dictionary."""
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.by_level[level]], float)

    def one(self, text: str | None) -> tuple[str, float, float, bool]:
        data = plain(text)
        if not data or not self.langs:
            return UND, 0.0, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0, False
        for level in (LEVEL, SECOND_LEVEL):
            size = self.sizes(data, level)
            first, second = np.argsort(size, kind="stable")[:2]
            margin = float((size[second] - size[first]) / size[second])
            if margin >= self.margin:
                break
        return self.langs[first], min(1.0, 0.5 + 5 * margin), margin, margin < self.margin


def classify(model: dict[str, bytes], margin: float = MARGIN):
    """A pandas UDF text -> struct(lang_pred, score, margin, rejected)."""
    made: list[Classifier] = []

    def run(text: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Classifier(model, margin))
        return pd.DataFrame(map(made[0].one, text), columns=["lang_pred", "score", "margin", "rejected"])

    return F.pandas_udf(run, _SCORES)


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``lang_id``: lang_pred, score, margin, rejected.

    Each whole text is lower-cased, reduced to its letters and compressed with each dictionary
    in pieces of PIECE bytes, whose sizes add up, so that length doesn't narrow the margin;
    the smallest sum wins. Where its margin, the relative gain over the second, is under ``margin``,
    a stronger level decides; under it again, the document is rejected, whatever its length, and of
    equal sums the language with more training documents is named. score is a half for a tie and
    rises with the margin. Null texts and texts without letters
    are ``und`` with score 0, and rejected. Rows are judged one by one: repeated rows get equal
    results, an empty table gives an empty one, and other columns pass through (the new column's
    name gets underscores while it is taken). Without any labelled row everything is ``und``.
    """
    return in_batches(docs).withColumn(fresh(docs, "lang_id"), classify(model, margin)(F.col(text_col)))


def keep_identified(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs`` without the documents that are rejected; their columns as they were."""
    name = fresh(docs, "lang_id")
    return identify(docs, model, margin).where(~F.col(name)["rejected"]).select(*docs.columns)


def op8_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_id.lang_pred", "lang_id.score", "lang_id.margin", "lang_id.rejected"
    )
