"""URL filters: stated host and path rules, and association rules mined by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, small, table

# Verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Least share of labelled URLs that a rule's tokens and label must cover, and least confidence.
SUPPORT, CONFIDENCE = 0.005, 0.8
#: Joins of more token combinations than are broadcast are salted by so many.
SALT = 16


def host_of(url: Column) -> Column:
    """From after the first :// to the next / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end to the next ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equal lengths the first."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # a later one stands above
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, the host's last label, path parts by position, query keys, extension.

    Runs of digits become ``0``, so that page numbers don't count as words.
    """
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda q: F.split(q, "=")[0]), lambda q: q != "")
    return F.array_distinct(F.concat(
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), plain(x))),
        F.array(F.concat(F.lit("t:"), F.element_at(labels, -1))),
        F.transform(parts, lambda p, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), plain(p))),
        F.transform(keys, lambda k: F.concat(F.lit("q:"), plain(k))),
    ))


def together(rows: DataFrame) -> DataFrame:
    """(twin, token) of tokens that are in exactly the same rows (row, tokens) as others.

    ``twin`` is the least of them. A template that gives its URLs thirty tokens of its own is one
    token to FP-growth then, not 2^30 combinations.
    """
    each = rows.select(F.explode("tokens").alias("token"), "row").groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("a"), F.bit_xor("row").alias("b")
    )
    twins = each.groupBy("n", "a", "b").agg(F.min("token").alias("twin"), F.collect_list("token").alias("tokens"))
    return twins.where(F.size("tokens") > 1).select("twin", F.explode("tokens").alias("token"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, items, verdict, confidence) mined from (tokens, label) with label allow or block.

    FP-growth counts the token combinations with their label; kept are rules of any length whose
    tokens and label cover ``support`` of the labelled rows and hold with ``confidence``, unless the
    rule without one of the tokens has the same verdict as surely (it fits wherever the longer one
    does). Tokens that are always together are mined as one, and a rule names all of them.
    Support bounds how many rules there can be.
    """
    rows = cut(labelled.select(F.xxhash64("tokens", F.monotonically_increasing_id()).alias("row"), "tokens", "label"))
    twins = cut(together(rows))
    other = small(twins.where("token <> twin").select("token"))
    kept = rows.select("label", "row", F.explode("tokens").alias("token")).join(other, "token", "left_anti").groupBy("row", "label").agg(F.collect_set("token").alias("tokens"))
    items = F.concat("tokens", F.array(F.concat(F.lit("label:"), "label")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(kept.select(items.alias("items")))
    rules = model.associationRules.select(
        F.array_sort("antecedent").alias("items"), F.col("consequent")[0].alias("label"), "confidence"
    )
    rules = cut(rules.where(F.col("label").startswith("label:")).select(
        "items", F.substring("label", 7, 99).alias("verdict"), "confidence"
    ))
    shorter = rules.select(F.col("items").alias("part"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    parts = rules.select("items", "verdict", "confidence", F.explode(_parts(F.col("items"))).alias("part"))
    said = parts.join(shorter, "part").where("same = verdict and sure >= confidence").select("items", "verdict").distinct()
    left = rules.join(said, ["items", "verdict"], "left_anti").withColumn("token", F.explode("items"))
    full = left.join(small(twins.withColumnRenamed("token", "own")), F.col("token") == F.col("twin"), "left")
    named = full.groupBy("items", "verdict", "confidence").agg(F.array_sort(F.collect_set(F.coalesce("own", "token"))).alias("named"))
    return cut(named.select(F.xxhash64("named").alias("rule_id"), F.col("named").alias("items"), "verdict", "confidence"))


def _parts(items: Column) -> Column:
    """The array without each of its items in turn; none of a single item."""
    return F.when(F.size(items) > 1, F.transform(items, lambda x: F.array_remove(items, x))).otherwise(F.array().cast("array<array<string>>"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, mined: DataFrame | None = None,
          default: str = "allow", id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT,
          confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, mined_confidence), one row per row of ``pages``.

    A stated rule fits its host and all subdomains if the path starts with the rule's; the longest
    decides. For other pages the mined rules do: those whose tokens all occur in the URL, found by
    an inverted index from token to rules; the surest wins, then the one with more tokens, then
    block, then the least items. Without one, ``default``.

    Unless ``mined`` is given, rules are mined from the URLs that stated rules decide, labelled
    with their verdicts: what the stated rules say is carried over to token combinations that
    behave alike.

    Null URLs and URLs without :// have an empty host and path, no tokens and the default verdict.
    Ids may be null or repeated; equal URLs are judged once and get equal verdicts; an empty table
    gives an empty one; other columns are not read.
    """
    rules = RULES if rules is None else rules
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "tokens", F.when((F.col("host") != "") | (F.col("path") != ""), tokens(F.col("host"), F.col("path"), url)).otherwise(F.array().cast("array<string>"))
    )
    rows = cut(rows.select("page_id", "host", "path", "stated", F.array_sort("tokens").alias("tokens")))
    if mined is None:
        labelled = rows.where("stated is not null and size(tokens) > 0").select("tokens", F.col("stated.verdict").alias("label"))
        mined = mine(labelled, support, confidence)
    # each combination of tokens is judged once, so a host with a third of all pages is a few rows
    open_ = rows.where("stated is null and size(tokens) > 0").select("tokens").distinct().withColumn("key", F.xxhash64("tokens"))
    index = small(mined.select("rule_id", "verdict", "confidence", F.size("items").alias("need"),
                               F.array_join("items", " ").alias("named"), F.explode("items").alias("token")))
    met = (
        open_.select("key", F.explode("tokens").alias("token")).join(index, "token")
        .groupBy("key", "rule_id", "verdict", "confidence", "need", "named").agg(F.count("*").alias("met")).where("met = need")
    )
    best = met.groupBy("key").agg(F.min_by(
        F.struct("verdict", "confidence", "named"), F.struct(-F.col("confidence"), -F.col("need"), F.col("verdict") != "block", "named")
    ).alias("best"))
    best = cut(best)
    judged = small(best)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")
    if judged is best:  # too many combinations to send to all: a third of all pages may still share one
        judged = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    else:
        salt, judged = F.lit(0), judged.withColumn("salt", F.lit(0))
    unstated = F.col("stated").isNull() & (F.size("tokens") > 0)
    open_pages = rows.where(unstated).withColumns({"key": F.xxhash64("tokens"), "salt": salt}).join(judged, ["key", "salt"], "left")
    rest = rows.where(~unstated).withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return open_pages.unionByName(rest, allowMissingColumns=True).select(
        "page_id", "host", "path", F.col("stated.rule").alias("rule"),
        F.coalesce("stated.verdict", "best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.named").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"),
    )


def op5_fp_growth_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
