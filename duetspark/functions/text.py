"""Wording of results, its guard, and time formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that reports must not use, and the wording of edges and drivers.
FORBIDDEN = ["causes", "cause", "drives", "drive", "makes", "made", "determines", "determine", "controls", "lead to", "result in"]
STRENGTHS = {"strong": "strongly", "moderate": "moderately", "weak": "weakly"}
TOGETHER = "%s and %s are nearly synchronous%s. Their %s covariance suggests tight temporal coupling."
SHORTLY = "%s %s precedes temporally %s by %.1fs%s. %s provides early signal for %s."
SLOWLY = "%s %s precedes temporally %s by %.1fs%s. This is a slow anticipatory trend, not an instantaneous coupling."
DRIVER = "%s acts as a driver: it temporally precedes %d other modalities (out-degree=%d, in-degree=%d). This is a network hub, not necessarily a causal source."
FOLLOWER = "%s acts as a follower: it is preceded by %d other modalities (in-degree=%d, out-degree=%d)."
BALANCED = "%s has balanced influence: out-degree=%d, in-degree=%d. No clear temporal leader/follower pattern."


def describe_edge(source: Column, target: Column, lag_sec: Column, polarity: Column, strength: Column, p: Column) -> Column:
    """A sentence by lag: under half a second, under three, longer. ``strength`` is a key of STRENGTHS."""
    sure = F.when((p > 0) & (p < 0.001), " (highly significant)").otherwise("")
    by = F.lit("moderately")
    for name, word in STRENGTHS.items():
        by = F.when(strength == name, word).otherwise(by)
    return (
        F.when(lag_sec < 0.5, F.format_string(TOGETHER, source, target, sure, polarity))
        .when(lag_sec < 3, F.format_string(SHORTLY, source, by, target, lag_sec, sure, source, target))
        .otherwise(F.format_string(SLOWLY, source, by, target, lag_sec, sure))
    )


def describe_driver(modality: Column, score: Column, out_degree: Column, in_degree: Column) -> Column:
    return (
        F.when(score > 1, F.format_string(DRIVER, modality, out_degree, out_degree, in_degree))
        .when(score < -1, F.format_string(FOLLOWER, modality, in_degree, in_degree, out_degree))
        .otherwise(F.format_string(BALANCED, modality, out_degree, in_degree))
    )


def forbidden_words(text: Column, words: list[str] | None = None) -> Column:
    """The forbidden words that a text holds anywhere, in any case; inside longer words too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, FORBIDDEN if words is None else words)), lambda w: F.contains(low, w))


def allowed(text: Column, words: list[str] | None = None) -> Column:
    return F.size(forbidden_words(text, words)) == 0


def timestamp(ms: Column) -> Column:
    """Milliseconds as m:ss.mmm, with a minus sign before a time before zero."""
    whole = F.floor(ms).cast("bigint")
    size, part = F.abs(whole), lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(F.when(whole < 0, "-").otherwise(""), F.floor(size / 60000).cast("string"), F.lit(":"), part(F.floor(size % 60000 / 1000), 2), F.lit("."), part(size % 1000, 3))
