"""Registry of the library's queries: each Spark query beside SQL that gives the same rows.

The driver's tables stand for recordings: a third of the users is a dyad, an event type a modality,
an hour a sample. Queries apply one operator each to these series.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import peak_sql
from .functions import text as wording
from .operators import align, cascade, clean, context, episodes, features, normalize, predict, prelude, quality, viewer, wcc
from .operators import granger as nested
from .operators.neighbours import with_neighbours
from .operators.reuse import reuse, shared_folder
from .schema import FEATURES, SERIES
from .streaming import epochs as stream
from .streaming import live

HOURS = 720
WINDOW, LAGS = 10, 12
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places) + F.lit(0.0)


# ---- tables ----


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals: t in hours since the first day, one series for each third of the users and event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    return e.select(
        F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dyad_id"), F.col("event_type").alias("modality"), F.lit("value").alias("feature"),
        (micros / 3.6e9).alias("t"), "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned: hourly means to the last event's hour, at least for HOURS; NULL where an hour has no event."""
    by = events(spark, sf_dir).groupBy(*SERIES, F.floor("t").alias("idx")).agg(F.avg("value").alias("value"))
    last = by.agg(F.greatest(F.max("idx"), F.lit(HOURS - 1).cast("bigint")).alias("last"))
    grid = by.select(*SERIES).distinct().crossJoin(F.broadcast(last)).select(*SERIES, F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("idx"))  # last is one row
    return grid.join(by, [*SERIES, "idx"], "left").select(*SERIES, "idx", F.col("idx").cast("double").alias("t"), "value")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.zscore(clean.ffill(hourly(spark, sf_dir)))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wcc.pairs(scored(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wcc.wcc(paired(spark, sf_dir), WINDOW)


def phases(spark: SparkSession) -> DataFrame:
    return context.contexts(spark, [(f"d{d}", a, b, label) for d in range(3) for a, b, label in ((0, 240, "first"), (240, 480, "second"), (480, 720, "third"))])


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.epoch_mean(scored(spark, sf_dir), 24)


_SERIES = "PARTITION BY dyad_id, modality ORDER BY idx"
CTE = f"""WITH e AS (SELECT 'd' || (user_id % 3) AS dyad_id, event_type AS modality, epoch_us(ts - TIMESTAMP '2024-01-01') / 3.6e9 AS t, value FROM events),
b AS (SELECT dyad_id, modality, CAST(floor(t) AS BIGINT) AS idx, avg(value) AS value FROM e GROUP BY ALL),
g AS (SELECT dyad_id, modality, CAST(unnest(range(0, (SELECT greatest({HOURS}, max(idx) + 1) FROM b))) AS BIGINT) AS idx FROM (SELECT DISTINCT dyad_id, modality FROM b)),
hn AS (SELECT max(idx) + 1 AS h, max(idx) + 2 - {WINDOW} AS wn FROM g),
a AS (SELECT g.*, b.value FROM g LEFT JOIN b USING (dyad_id, modality, idx)),
n AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  last_value(value IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  first_value(value IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM a),
f AS (SELECT dyad_id, modality, idx, coalesce(value, pv, nv) AS value FROM n),
z AS (SELECT dyad_id, modality, idx, (value - avg(value) OVER s) / nullif(stddev_pop(value) OVER s, 0) AS value FROM f WINDOW s AS (PARTITION BY dyad_id, modality)),
p AS (SELECT x.dyad_id, x.modality || '_value__' || y.modality || '_value' AS pair_key, x.modality AS mod_a, y.modality AS mod_b, x.idx, x.value AS x, y.value AS y
      FROM z x JOIN z y ON x.dyad_id = y.dyad_id AND x.idx = y.idx AND x.modality < y.modality),
v AS (SELECT dyad_id, pair_key, idx, count(*) OVER r AS n, covar_pop(x, y) OVER r AS c, stddev_pop(x) OVER r * stddev_pop(y) OVER r AS s FROM p
      WINDOW r AS (PARTITION BY dyad_id, pair_key ORDER BY idx ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
w AS (SELECT dyad_id, pair_key, idx, CASE WHEN s > 1e-10 THEN round(greatest(-1.0, least(1.0, c / s)), 12) END AS r FROM v WHERE n = {WINDOW}),
h AS (SELECT * FROM (VALUES (0, 0.0, 240.0, 'first'), (1, 240.0, 480.0, 'second'), (2, 480.0, 720.0, 'third')) t(k, start_sec, end_sec, label)),
m AS (SELECT dyad_id, modality, idx // 24 AS epoch, avg(value) AS value FROM z GROUP BY ALL)
"""
_ROW = "SELECT dyad_id, modality, idx, round(value, 6) + 0.0 AS value FROM "


def _row(df: DataFrame) -> DataFrame:
    return df.select("dyad_id", "modality", "idx", rounded("value").alias("value"))


# ---- the flagship ----


@query(CTE + """SELECT dyad_id, pair_key, count(r) AS windows, round(avg(r), 6) + 0.0 AS mean_r, round(max(r), 6) + 0.0 AS max_r FROM w GROUP BY dyad_id, pair_key""")
def top_pairs(spark, sf_dir):
    """How closely each pair of modalities moves together."""
    by = series(spark, sf_dir).groupBy("dyad_id", "pair_key").agg(F.count("r").alias("windows"), rounded(F.avg("r")).alias("mean_r"), rounded(F.max("r")).alias("max_r"))
    return by


# ---- alignment and cleaning ----

_CLOCK = """WITH e AS (SELECT 'd' || (user_id % 3) AS dyad_id, event_type AS modality, epoch_us(ts - TIMESTAMP '2024-01-01') / 3.6e9 AS t, value FROM events),
u AS (SELECT dyad_id, modality, t, arg_min(value, value) AS value FROM e GROUP BY ALL),
b0 AS (SELECT dyad_id, max(lo) AS t0, min(hi) AS t1 FROM (SELECT dyad_id, modality, min(t) AS lo, max(t) AS hi FROM u GROUP BY ALL) GROUP BY dyad_id),
b AS (SELECT *, CAST(floor((t1 - t0) * 1.0) + 1 AS BIGINT) AS n FROM b0),
g AS (SELECT s.dyad_id, s.modality, t0, t1, n, CAST(unnest(range(0, n)) AS BIGINT) AS idx FROM (SELECT DISTINCT dyad_id, modality FROM u) s JOIN b USING (dyad_id)),
c AS (SELECT dyad_id, modality, idx, CASE WHEN idx = n - 1 THEN t1 ELSE t0 + idx * ((t1 - t0) / (n - 1)) END AS t FROM g),
l AS (SELECT c.*, u.t AS t_a, u.value AS v_a FROM c ASOF LEFT JOIN u ON c.dyad_id = u.dyad_id AND c.modality = u.modality AND c.t >= u.t),
k AS (SELECT l.*, u.t AS t_b, u.value AS v_b FROM l ASOF LEFT JOIN u ON l.dyad_id = u.dyad_id AND l.modality = u.modality AND l.t <= u.t)
"""


def _clocked(spark, sf_dir):
    e = events(spark, sf_dir)
    return align.first_per_time(e, F.struct("value"))


@query(_CLOCK + """SELECT dyad_id, modality, idx, round(CASE WHEN t_a = t THEN v_a ELSE v_a + (v_b - v_a) * (t - t_a) / (t_b - t_a) END, 6) + 0.0 AS value FROM k""")
def resample_linear(spark, sf_dir):
    return _row(align.align(_clocked(spark, sf_dir), 1.0))


@query(_CLOCK + """SELECT dyad_id, modality, idx, round(CASE WHEN v_a IS NULL OR v_b IS NULL THEN NULL WHEN t - t_a <= t_b - t THEN v_a ELSE v_b END, 6) + 0.0 AS value FROM k""")
def resample_nearest(spark, sf_dir):
    return _row(align.align(_clocked(spark, sf_dir), 1.0, "nearest"))


@query()
def resample_cubic(spark, sf_dir):
    return _row(align.align(_clocked(spark, sf_dir), 1.0, "cubic"))


@query("""WITH e AS (SELECT 'd' || (user_id % 3) AS dyad_id, event_type AS modality, epoch_us(ts - TIMESTAMP '2024-01-01') / 3.6e9 AS t FROM events)
SELECT dyad_id, modality, CASE WHEN max(t) > 1e6 THEN 'absolute' WHEN min(t) >= 0 AND max(t) < 10000 THEN 'relative' ELSE 'unknown' END AS time_type FROM e GROUP BY ALL""")
def time_type(spark, sf_dir):
    return align.time_type(events(spark, sf_dir))


@query("""SELECT DISTINCT 'd' || (user_id % 3) AS dyad_id, 'warning' AS level, 'relative clocks may not start together' AS message FROM events""")
def clock_report(spark, sf_dir):
    return align.clock_report(events(spark, sf_dir))


@query(CTE + _ROW + "f")
def ffill(spark, sf_dir):
    return _row(clean.ffill(hourly(spark, sf_dir)))


_GAP = "CASE WHEN value IS NULL THEN coalesce(ni, (SELECT h FROM hn)) - coalesce(pi, -1) - 1 END"


@query(CTE + f"SELECT dyad_id, modality, idx, round(coalesce(value, CASE WHEN {_GAP} <= 3 THEN pv END), 6) + 0.0 AS value FROM n")
def ffill_maxgap(spark, sf_dir):
    return _row(clean.ffill(hourly(spark, sf_dir), 3))


_LINE = "CASE WHEN pi IS NOT NULL AND ni IS NOT NULL THEN pv + (nv - pv) * (idx - pi) / nullif(ni - pi, 0) ELSE pv END"


@query(CTE + f"SELECT dyad_id, modality, idx, round(coalesce(value, {_LINE}, nv), 6) + 0.0 AS value FROM n")
def interp_gap(spark, sf_dir):
    return _row(clean.interpolate(hourly(spark, sf_dir)))


@query(CTE + f"SELECT dyad_id, modality, idx, round(coalesce(value, CASE WHEN {_GAP} <= 2 THEN coalesce({_LINE}, nv) END), 6) + 0.0 AS value FROM n")
def short_gaps(spark, sf_dir):
    return _row(clean.short_gaps(hourly(spark, sf_dir), 2))


@query(CTE + """, k AS (SELECT dyad_id, idx, row_number() OVER (PARTITION BY dyad_id ORDER BY idx) - 1 AS i FROM (SELECT dyad_id, idx FROM a GROUP BY ALL HAVING count(*) = count(value)))
SELECT a.dyad_id, modality, k.i AS idx, round(value, 6) + 0.0 AS value FROM a JOIN k USING (dyad_id, idx)""")
def drop_window(spark, sf_dir):
    return _row(clean.drop_window(hourly(spark, sf_dir)))


@query(CTE + """, q AS (SELECT dyad_id, modality, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM a GROUP BY ALL)
SELECT dyad_id, modality, idx, round(CASE WHEN value IS NOT NULL THEN greatest(q.a - 0.5 * (q.b - q.a), least(q.b + 0.5 * (q.b - q.a), value)) END, 6) + 0.0 AS value FROM a JOIN q USING (dyad_id, modality)""")
def clip_iqr(spark, sf_dir):
    return _row(clean.clip_outliers(hourly(spark, sf_dir), 0.5)[0])


@query(CTE + """, q AS (SELECT dyad_id, modality, median(value) AS m, mad(value) AS d FROM a GROUP BY ALL)
SELECT dyad_id, modality, count(value) AS n, round(any_value(m - 1.4826 * d), 6) + 0.0 AS lower, round(any_value(m + 1.4826 * d), 6) + 0.0 AS upper,
  CAST(count_if(value < m - 1.4826 * d OR value > m + 1.4826 * d) AS BIGINT) AS clipped FROM a JOIN q USING (dyad_id, modality) GROUP BY ALL""")
def clip_mad(spark, sf_dir):
    r = clean.clip_outliers(hourly(spark, sf_dir), 1.0, "mad")[1]
    return r.select("dyad_id", "modality", "n", rounded("lower").alias("lower"), rounded("upper").alias("upper"), "clipped")


@query(CTE + """, t AS (SELECT *, idx - row_number() OVER (PARTITION BY dyad_id, modality ORDER BY idx) AS run FROM a WHERE value IS NOT NULL),
r AS (SELECT *, min(idx) OVER s AS lo, max(idx) OVER s AS hi FROM t WINDOW s AS (PARTITION BY dyad_id, modality, run)),
x AS (SELECT r.dyad_id, r.modality, r.idx, r.value, r.hi - r.lo + 1 AS len, j,
        CASE WHEN r.idx + j < lo THEN 2 * lo - 1 - r.idx - j WHEN r.idx + j > hi THEN 2 * hi + 1 - r.idx - j ELSE r.idx + j END AS src FROM r, (VALUES (-2), (-1), (0), (1), (2)) d(j)),
y AS (SELECT x.dyad_id, x.modality, x.idx, median(a.value) AS m FROM x JOIN a ON a.dyad_id = x.dyad_id AND a.modality = x.modality AND a.idx = x.src WHERE len >= 5 GROUP BY ALL)
SELECT a.dyad_id, a.modality, a.idx, round(coalesce(y.m, a.value), 6) + 0.0 AS value FROM a LEFT JOIN y USING (dyad_id, modality, idx)""")
def median5(spark, sf_dir):
    return _row(clean.median_filter(hourly(spark, sf_dir), 5))


# ---- normalisation ----


@query(CTE + _ROW + "z")
def zscore(spark, sf_dir):
    return _row(scored(spark, sf_dir))


@query(CTE + """, q AS (SELECT dyad_id, modality, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS d FROM a GROUP BY ALL)
SELECT dyad_id, modality, idx, round(CASE WHEN d = 0 THEN 0 ELSE greatest(-2.0, least(2.0, CASE WHEN value IS NOT NULL THEN (value - m) / d END)) * CASE WHEN value IS NULL THEN NULL ELSE 1 END END, 6) + 0.0 AS value
FROM a JOIN q USING (dyad_id, modality)""")
def zscore_robust(spark, sf_dir):
    return _row(normalize.zscore(hourly(spark, sf_dir), "robust", 2.0))


@query(CTE + "SELECT dyad_id, modality, round(avg(value), 6) + 0.0 AS centre, round(stddev_pop(value), 6) + 0.0 AS scale FROM a GROUP BY ALL")
def zscore_stats(spark, sf_dir):
    s = normalize.stats(hourly(spark, sf_dir))
    return s.select("dyad_id", "modality", rounded("centre").alias("centre"), rounded("scale").alias("scale"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, round(coalesce((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_pop(l_quantity) OVER w, 0), 0), 6) + 0.0 AS l_quantity,
  round(coalesce((l_discount - avg(l_discount) OVER w) / nullif(stddev_pop(l_discount) OVER w, 0), 0), 6) + 0.0 AS l_discount FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")
def multi_dyad_zscore(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")
    z, _ = normalize.within_dyad_zscore(rows, "l_returnflag", None, ("l_orderkey", "l_linenumber"))
    return z.withColumns({c: rounded(c) for c in ("l_quantity", "l_discount")})


@query(CTE + """, q AS (SELECT dyad_id, modality, avg(value) FILTER (idx < 100) AS m, stddev_pop(value) FILTER (idx < 100) AS s FROM f GROUP BY ALL)
SELECT dyad_id, modality, idx, round(coalesce((value - m) / nullif(s, 0), 0), 6) + 0.0 AS value FROM f JOIN q USING (dyad_id, modality)""")
def baseline_z(spark, sf_dir):
    return _row(normalize.baseline_zscore(clean.ffill(hourly(spark, sf_dir)), 100))


@query(CTE + """, q AS (SELECT dyad_id, modality, min(value) AS lo, max(value) AS hi FROM f GROUP BY ALL)
SELECT dyad_id, modality, idx, round(coalesce((value - lo) / nullif(hi - lo, 0), 0), 6) + 0.0 AS value FROM f JOIN q USING (dyad_id, modality)""")
def minmax(spark, sf_dir):
    return _row(normalize.minmax(clean.ffill(hourly(spark, sf_dir))))


@query(CTE + """, q AS (SELECT dyad_id, modality, regr_slope(value, idx) AS s, regr_intercept(value, idx) AS i FROM f GROUP BY ALL)
SELECT dyad_id, modality, idx, round(value - i - s * idx, 6) + 0.0 AS value FROM f JOIN q USING (dyad_id, modality)""")
def detrend(spark, sf_dir):
    return _row(normalize.detrend(clean.ffill(hourly(spark, sf_dir)), SERIES))


# ---- pairs, correlation, contexts ----


@query(CTE + "SELECT dyad_id, pair_key, mod_a, mod_b, count(*) AS samples FROM p GROUP BY ALL")
def pairs(spark, sf_dir):
    return paired(spark, sf_dir).groupBy("dyad_id", "pair_key", "mod_a", "mod_b").agg(F.count("*").alias("samples"))


@query(CTE + "SELECT dyad_id, pair_key, idx, round(r, 6) + 0.0 AS r FROM w")
def sliding_correlation(spark, sf_dir):
    return series(spark, sf_dir).select("dyad_id", "pair_key", "idx", rounded("r").alias("r"))


@query(CTE + f""", o AS (SELECT p.dyad_id, p.pair_key, p.idx, p.x, q.y FROM p LEFT JOIN p q ON q.dyad_id = p.dyad_id AND q.pair_key = p.pair_key AND q.idx = p.idx - 3),
s AS (SELECT dyad_id, pair_key, idx, count(*) OVER r AS n, count(y) OVER r AS k, covar_pop(x, y) OVER r AS c, stddev_pop(x) OVER r * stddev_pop(y) OVER r AS s FROM o
      WINDOW r AS (PARTITION BY dyad_id, pair_key ORDER BY idx ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING))
SELECT dyad_id, pair_key, idx, round(CASE WHEN k = {WINDOW} THEN round(greatest(-1.0, least(1.0, coalesce(c / nullif(s, 0), 0))), 12) END, 6) + 0.0 AS r FROM s WHERE n = {WINDOW}""")
def wcc_lagged(spark, sf_dir):
    return wcc.wcc(paired(spark, sf_dir), WINDOW, 3).select("dyad_id", "pair_key", "idx", rounded("r").alias("r"))


_DIRECTED = CTE + f""", dl AS (SELECT s.dyad_id, s.pair_key, s.idx, lag, s.x, t.y FROM p s, range(-{LAGS}, {LAGS} + 1) l(lag), p t WHERE t.dyad_id = s.dyad_id AND t.pair_key = s.pair_key AND t.idx = s.idx - lag),
dw AS (SELECT dyad_id, pair_key, idx, CAST(lag AS INTEGER) AS lag, count(*) OVER r AS n, covar_pop(x, y) OVER r AS c, stddev_pop(x) OVER r * stddev_pop(y) OVER r AS s FROM dl
       WINDOW r AS (PARTITION BY dyad_id, pair_key, lag ORDER BY idx ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
dr AS (SELECT dyad_id, pair_key, idx, lag, round(greatest(-1.0, least(1.0, c / s)), 9) AS r FROM dw WHERE n = {WINDOW} AND s > 1e-10),
db AS (SELECT dyad_id, pair_key, idx, arg_max(lag, {{'a': abs(r), 'b': -abs(lag), 'c': -lag}}) AS lag, arg_max(r, {{'a': abs(r), 'b': -abs(lag), 'c': -lag}}) AS r, CAST(count(*) AS INTEGER) AS lags FROM dr GROUP BY ALL),
dd AS (SELECT w.dyad_id, w.pair_key, w.idx, lag, db.r, coalesce(lags, 0) AS lags FROM w LEFT JOIN db USING (dyad_id, pair_key, idx) WHERE w.idx % 2 = 0)
"""


def _directed(spark, sf_dir):
    return wcc.wcc_directional(paired(spark, sf_dir), WINDOW, LAGS, 2)


@query(_DIRECTED + "SELECT dyad_id, pair_key, idx, lag, round(r, 6) + 0.0 AS r, lags FROM dd")
def wcc_directional(spark, sf_dir):
    """Every other window's best lag of 25."""
    return _directed(spark, sf_dir).withColumn("r", rounded("r"))


@query(_DIRECTED + """, de AS (SELECT dyad_id, pair_key, idx // 24 AS epoch, avg(r) AS s, avg(lag) AS l, avg(CAST(r < 0 AS INTEGER)) AS f FROM dd GROUP BY ALL)
SELECT dyad_id, pair_key, epoch, round(s, 6) + 0.0 AS mean_signed, round(l, 6) + 0.0 AS mean_lag, round(f, 6) + 0.0 AS fraction_negative, CASE WHEN l < 0 THEN 'a_leads' WHEN l > 0 THEN 'b_leads' ELSE 'synchronous' END AS direction FROM de""")
def epoch_directional(spark, sf_dir):
    """Who leads, and how often the two move apart, by day."""
    w = _directed(spark, sf_dir).select("dyad_id", "pair_key", F.floor(F.col("idx") / 2).alias("win"), F.col("r").alias("ccf"), "lag")
    return _rounded_all(viewer.epoch_direction(w, 12), ["mean_signed", "mean_lag", "fraction_negative"])


@query(CTE + "SELECT dyad_id, modality, idx, k AS ctx_id, label FROM z JOIN h ON idx >= start_sec AND idx < end_sec")
def context_lookup(spark, sf_dir):
    got = context.context_at(scored(spark, sf_dir), phases(spark))
    return got.select("dyad_id", "modality", "idx", (F.col("ctx_id") % 3).cast("int").alias("ctx_id"), "label")


_SPELLS = "'d' || (user_id % 3) AS dyad_id, event_id, epoch_us(ts - TIMESTAMP '2024-01-01') / 3.6e9 AS t"


@query(f"""WITH c AS (SELECT {_SPELLS} FROM events WHERE event_type = 'purchase'), s AS (SELECT dyad_id, event_id AS ctx_id, t AS a, t + 0.02 * (1 + event_id % 7) * CASE WHEN event_id % 50 = 0 THEN 100 ELSE 1 END AS b FROM c),
e AS (SELECT {_SPELLS} FROM events WHERE event_type = 'click')
SELECT e.event_id, coalesce(arg_min(ctx_id, {{'a': a, 'c': ctx_id}}), -1) AS ctx_id FROM e LEFT JOIN s ON s.dyad_id = e.dyad_id AND t >= a AND t < b GROUP BY e.event_id""")
def event_contexts(spark, sf_dir):
    """Each click with the first of the purchases' spells that hold it: as many intervals as there are purchases."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 3.6e9
    rows = e.select(F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dyad_id"), "event_id", t.alias("t"), "event_type")
    length = 0.02 * (1 + F.col("event_id") % 7) * F.when(F.col("event_id") % 50 == 0, 100).otherwise(1)
    spells = rows.where("event_type = 'purchase'").select("dyad_id", F.col("event_id").alias("ctx_id"), F.col("t").alias("start_sec"), (F.col("t") + length).alias("end_sec"), F.lit("spell").alias("label"))
    return context.context_at(rows.where("event_type = 'click'"), spells).select("event_id", F.coalesce("ctx_id", F.lit(-1)).alias("ctx_id"))


@query(CTE + f""", s AS (SELECT p.dyad_id, label, pair_key, idx, x, y FROM p JOIN h ON idx >= start_sec AND idx < end_sec),
t AS (SELECT dyad_id, label, pair_key, count(*) OVER r AS n, covar_pop(x, y) OVER r AS c, stddev_pop(x) OVER r * stddev_pop(y) OVER r AS s FROM s
      WINDOW r AS (PARTITION BY dyad_id, label, pair_key ORDER BY idx ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING))
SELECT dyad_id, label, pair_key, count(*) AS windows, round(avg(CASE WHEN s > 1e-10 THEN round(greatest(-1.0, least(1.0, c / s)), 12) END), 6) + 0.0 AS mean_r FROM t WHERE n = {WINDOW} GROUP BY ALL""")
def segment_wcc(spark, sf_dir):
    rows, _ = wcc.segments(paired(spark, sf_dir), phases(spark), WINDOW)
    keys = ["dyad_id", "label", "pair_key"]
    return wcc.wcc(rows, WINDOW, keys=keys).groupBy(*keys).agg(F.count("*").alias("windows"), rounded(F.avg("r")).alias("mean_r"))


@query(CTE + """, t AS (SELECT w.dyad_id, label, pair_key, avg(r) AS m FROM w JOIN h ON idx >= start_sec AND idx < end_sec GROUP BY ALL)
SELECT dyad_id, label, round(avg(m), 6) + 0.0 AS mean_sync FROM t GROUP BY ALL""")
def score_view(spark, sf_dir):
    z = scored(spark, sf_dir)
    got = features.score_view(series(spark, sf_dir), z, phases(spark))
    return got.select("dyad_id", "label", rounded("mean_sync").alias("mean_sync"))


# ---- features ----


@query(CTE + "SELECT dyad_id, pair_key, min(idx) FILTER (r >= 0.5) AS onset_idx, round(arg_min(r, idx) FILTER (r >= 0.5), 6) + 0.0 AS onset_amplitude FROM w GROUP BY ALL")
def onset(spark, sf_dir):
    return features.onset(series(spark, sf_dir), 0.5).withColumn("onset_amplitude", rounded("onset_amplitude"))


@query(CTE + """, s AS (SELECT dyad_id, pair_key, min(r) AS lo, max(r) AS hi, avg(r) AS m, count(r) AS n FROM w GROUP BY ALL),
t AS (SELECT dyad_id, pair_key, m, n, least(floor((r - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS c FROM w JOIN s USING (dyad_id, pair_key) WHERE r IS NOT NULL GROUP BY ALL)
SELECT dyad_id, pair_key, round(any_value(m), 6) + 0.0 AS mean_synchrony, round(sum(-c / n * ln(c / n)), 6) + 0.0 AS synchrony_entropy FROM t GROUP BY ALL""")
def entropy(spark, sf_dir):
    return features.entropy(series(spark, sf_dir)).withColumns({c: rounded(c) for c in ("mean_synchrony", "synchrony_entropy")})


_PEAKS = CTE.replace("WITH ", "WITH RECURSIVE ", 1) + peak_sql.profiles("w", "dyad_id, pair_key")
_CONTEXTS = CTE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", pc AS (SELECT p.*, label, row_number() OVER (PARTITION BY dyad_id, label, pair_key ORDER BY p.idx) - 1 AS pos FROM p JOIN h ON p.idx >= start_sec AND p.idx < end_sec),
vc AS (SELECT dyad_id, label, pair_key, pos AS idx, count(*) OVER r AS n, covar_pop(x, y) OVER r AS c, stddev_pop(x) OVER r * stddev_pop(y) OVER r AS s FROM pc
      WINDOW r AS (PARTITION BY dyad_id, label, pair_key ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
wc AS (SELECT dyad_id, label, pair_key, idx, CASE WHEN s > 1e-10 THEN round(greatest(-1.0, least(1.0, c / s)), 12) END AS r FROM vc WHERE n = {WINDOW})
""" + peak_sql.profiles("wc", "dyad_id, label, pair_key")
_HOPS = CTE.replace("WITH ", "WITH RECURSIVE ", 1) + """, hp AS (SELECT dyad_id, pair_key, CAST(j AS BIGINT) AS win, idx - j * 30 AS idx, r FROM w, (SELECT unnest(range(0, (wn - 60) // 30 + 1)) AS j FROM hn) WHERE idx >= j * 30 AND idx < j * 30 + 60)
""" + peak_sql.profiles("hp", "dyad_id, pair_key, win")
_TEN = peak_sql.rounded(peak_sql.TEN)


def _rounded_all(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in names})


@query(_PEAKS + f"SELECT dyad_id, pair_key, peak_index, {peak_sql.rounded(peak_sql.PEAK.split(', '))} FROM pk")
def peaks(spark, sf_dir):
    return _rounded_all(features.peaks(series(spark, sf_dir)), peak_sql.PEAK.split(", "))


@query(_PEAKS + peak_sql.ten("dyad_id, pair_key") + f"SELECT dyad_id, pair_key, {_TEN} FROM tf")
def features10(spark, sf_dir):
    return _rounded_all(features.features(series(spark, sf_dir)), FEATURES)


@query(_CONTEXTS + peak_sql.ten("dyad_id, label, pair_key") + f"SELECT dyad_id, label, pair_key, {_TEN} FROM tf")
def features_by_context(spark, sf_dir):
    return _rounded_all(features.per_context(paired(spark, sf_dir), phases(spark), WINDOW), FEATURES)


_OVER = """, best AS (SELECT *, row_number() OVER (PARTITION BY dyad_id, pair_key ORDER BY peak_value DESC, peak_index) AS k FROM pk)
SELECT dyad_id, pair_key, {how} FROM {source} JOIN (SELECT dyad_id, pair_key FROM si GROUP BY ALL HAVING count(r) >= 5) USING (dyad_id, pair_key) GROUP BY dyad_id, pair_key"""


def _aggregated(spark, sf_dir, how):
    got = features.features(series(spark, sf_dir), max_missing=1.0, aggregation=how).where("peak_amplitude is not null")
    return _rounded_all(got.select("dyad_id", "pair_key", "build_up_rate", "peak_duration", "breakdown_rate", "peak_amplitude"), ["build_up_rate", "peak_duration", "breakdown_rate", "peak_amplitude"])


@query(_PEAKS + _OVER.format(how=", ".join(f"round(median({a}), 6) + 0.0 AS {b}" for a, b in (("build_up_rate", "build_up_rate"), ("width_samples", "peak_duration"), ("breakdown_rate", "breakdown_rate"))) + ", round(max(peak_value), 6) + 0.0 AS peak_amplitude", source="best"))
def features_median(spark, sf_dir):
    """Features over peaks by their median."""
    return _aggregated(spark, sf_dir, "median")


@query(_PEAKS + _OVER.format(how=", ".join(f"round(any_value({a}) FILTER (k = 1), 6) + 0.0 AS {b}" for a, b in (("build_up_rate", "build_up_rate"), ("width_samples", "peak_duration"), ("breakdown_rate", "breakdown_rate"), ("peak_value", "peak_amplitude"))), source="best"))
def features_max(spark, sf_dir):
    """Features of each series' highest peak."""
    return _aggregated(spark, sf_dir, "max")


@query(_PEAKS + "SELECT dyad_id, pair_key, CAST(count(r) FILTER (i >= last) AS DOUBLE) AS recovery_time FROM si JOIN (SELECT dyad_id, pair_key, max(peak_index) AS last FROM pk GROUP BY ALL) USING (dyad_id, pair_key) GROUP BY dyad_id, pair_key")
def recovery(spark, sf_dir):
    s = series(spark, sf_dir)
    return features.recovery(s, features.peaks(s))


# ---- cascade ----

_CCF = CTE + f""", q AS (SELECT dyad_id, pair_key, regr_slope(x, idx) AS sx, regr_intercept(x, idx) AS ix, regr_slope(y, idx) AS sy, regr_intercept(y, idx) AS iy, count(*) AS n FROM p GROUP BY ALL),
d AS (SELECT dyad_id, pair_key, idx, x - ix - sx * idx AS x, y - iy - sy * idx AS y, 0.5 * (1 - cos(2 * pi() * idx / n)) AS h FROM p JOIN q USING (dyad_id, pair_key)),
o AS (SELECT dyad_id, pair_key, sqrt(sum(x * x)) * sqrt(sum(y * y)) AS norm FROM d GROUP BY ALL),
l AS (SELECT CAST(unnest(range(-{LAGS}, {LAGS} + 1)) AS INTEGER) AS lag),
c AS (SELECT s.dyad_id, s.pair_key, lag, sum(s.x * s.h * t.y * t.h) / any_value(norm) AS ccf FROM d s, l, d t, o
      WHERE t.dyad_id = s.dyad_id AND t.pair_key = s.pair_key AND t.idx = s.idx - lag AND o.dyad_id = s.dyad_id AND o.pair_key = s.pair_key GROUP BY ALL),
k AS (SELECT dyad_id, pair_key, arg_max(lag, {{'a': abs(ccf), 'b': -lag}}) AS lag, arg_max(ccf, {{'a': abs(ccf), 'b': -lag}}) AS ccf FROM c GROUP BY ALL)
"""


def _rows(spark, sf_dir):
    return cascade.trimmed(paired(spark, sf_dir), LAGS)[0]


@query(_CCF + "SELECT dyad_id, pair_key, lag, round(ccf, 6) + 0.0 AS ccf FROM c")
def ccf(spark, sf_dir):
    return cascade.ccf(_rows(spark, sf_dir)).withColumn("ccf", rounded("ccf"))


@query(_CCF + """SELECT dyad_id, pair_key, lag, CAST(abs(lag) AS DOUBLE) AS lag_sec, round(ccf, 6) + 0.0 AS ccf,
  CASE WHEN lag < 0 THEN 'a_leads' WHEN lag > 0 THEN 'b_leads' ELSE 'synchronous' END AS direction FROM k""")
def ccf_peak(spark, sf_dir):
    return cascade.peak(cascade.ccf(_rows(spark, sf_dir))).withColumn("ccf", rounded("ccf"))


@query(_CCF + """, r AS (SELECT dyad_id, pair_key, coalesce(regr_r2(x, idx), 0) AS a, coalesce(regr_r2(y, idx), 0) AS b FROM p GROUP BY ALL)
SELECT dyad_id, pair_key, a < 0.05 AS drift_x, b < 0.05 AS drift_y FROM r""")
def drift_flag(spark, sf_dir):
    return cascade.drift(_rows(spark, sf_dir))


_P = "exp(-abs(ccf) * 30)"


@query(_CCF + f""", t AS (SELECT dyad_id, pair_key, {_P} AS p_value FROM k),
u AS (SELECT *, row_number() OVER (PARTITION BY dyad_id ORDER BY p_value, pair_key) AS rk, count(*) OVER (PARTITION BY dyad_id) AS m FROM t)
SELECT dyad_id, pair_key, round(p_value, 6) + 0.0 AS p_value,
  round(min(least(1.0, p_value * m / rk)) OVER (PARTITION BY dyad_id ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS p_corrected FROM u""")
def bh_fdr(spark, sf_dir):
    """Benjamini-Hochberg over stated p-values, which fall with the peak."""
    p = cascade.peak(cascade.ccf(_rows(spark, sf_dir))).select("dyad_id", "pair_key", F.expr(_P).alias("p_value"))
    return cascade.benjamini_hochberg(p).withColumns({c: rounded(c) for c in ("p_value", "p_corrected")})


_EDGES = _CCF + """, n2 AS (SELECT DISTINCT dyad_id, pair_key, mod_a, mod_b FROM p),
ed AS (SELECT dyad_id, CASE WHEN lag < 0 THEN mod_a ELSE mod_b END AS source, CASE WHEN lag < 0 THEN mod_b ELSE mod_a END AS target, ccf, lag FROM k JOIN n2 USING (dyad_id, pair_key) WHERE abs(ccf) >= 0.05 AND lag <> 0)
"""


def _edges(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    p = cascade.peak(cascade.ccf(rows)).withColumn("p_corrected", F.when(F.abs("ccf") >= 0.05, 0.01).otherwise(1.0))
    return cascade.edges(p.join(rows.select("dyad_id", "pair_key", "mod_a", "mod_b").distinct(), ["dyad_id", "pair_key"]))


@query(_EDGES + "SELECT dyad_id, source, target, CAST(abs(lag) AS DOUBLE) AS lag_sec, round(ccf, 6) + 0.0 AS ccf_value, CASE WHEN ccf >= 0 THEN 'positive' ELSE 'negative' END AS polarity FROM ed")
def cascade_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("dyad_id", "source", "target", "lag_sec", rounded("ccf_value").alias("ccf_value"), "polarity")


@query(_EDGES + """, ev AS (SELECT dyad_id, source AS modality, 1 AS o, 0 AS i FROM ed UNION ALL SELECT dyad_id, target, 0, 1 FROM ed)
SELECT dyad_id, modality, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(o) - sum(i) AS BIGINT) AS driver_score, sum(o) >= 2 AS is_hub, sum(i) >= 2 AS is_follower FROM ev GROUP BY ALL""")
def graph_metrics(spark, sf_dir):
    return cascade.metrics(_edges(spark, sf_dir))


@query(_EDGES + "SELECT DISTINCT dyad_id, unnest([source, target]) AS node FROM ed")
def graph_nodes(spark, sf_dir):
    return cascade.nodes(_edges(spark, sf_dir))


_ROLL = CTE + """, i AS (SELECT dyad_id, pair_key, mod_a, mod_b, CAST(k AS BIGINT) AS win, idx - k * 60 AS idx, x, y FROM p, (SELECT unnest(range(0, (h - 120) // 60 + 1)) AS k FROM hn) WHERE idx >= k * 60 AND idx < k * 60 + 120),
q AS (SELECT dyad_id, pair_key, win, regr_slope(x, idx) AS sx, regr_intercept(x, idx) AS ix, regr_slope(y, idx) AS sy, regr_intercept(y, idx) AS iy FROM i GROUP BY ALL),
d AS (SELECT dyad_id, pair_key, win, idx, x - ix - sx * idx AS x, y - iy - sy * idx AS y, 0.5 * (1 - cos(2 * pi() * idx / 120)) AS h FROM i JOIN q USING (dyad_id, pair_key, win)),
o AS (SELECT dyad_id, pair_key, win, sqrt(sum(x * x)) * sqrt(sum(y * y)) AS norm FROM d GROUP BY ALL),
c AS (SELECT s.dyad_id, s.pair_key, s.win, CAST(lag AS INTEGER) AS lag, sum(s.x * s.h * t.y * t.h) / any_value(CASE WHEN norm > 0 THEN norm ELSE 1 END) AS ccf FROM d s, range(-10, 11) l(lag), d t, o
      WHERE t.dyad_id = s.dyad_id AND t.pair_key = s.pair_key AND t.win = s.win AND t.idx = s.idx - lag AND o.dyad_id = s.dyad_id AND o.pair_key = s.pair_key AND o.win = s.win GROUP BY ALL),
k AS (SELECT dyad_id, pair_key, win, arg_max(lag, {'a': abs(ccf), 'b': -lag}) AS lag, arg_max(ccf, {'a': abs(ccf), 'b': -lag}) AS ccf FROM c GROUP BY ALL),
r AS (SELECT k.*, CASE WHEN lag < 0 THEN mod_a WHEN lag > 0 THEN mod_b END AS leader FROM k JOIN (SELECT DISTINCT pair_key, mod_a, mod_b FROM p) USING (pair_key))
"""


@query(_ROLL + "SELECT dyad_id, pair_key, win, win * 60.0::DOUBLE AS window_start, win * 60.0::DOUBLE + 120 AS window_end, lag, round(ccf, 6) + 0.0 AS ccf, leader FROM r")
def rolling_ccf(spark, sf_dir):
    got = cascade.rolling(paired(spark, sf_dir), 120, 60, 10)
    return got.select("dyad_id", "pair_key", "win", "window_start", "window_end", "lag", rounded("ccf").alias("ccf"), "leader")


@query(_ROLL + "SELECT dyad_id, win, leader, count(*) AS leads FROM r WHERE leader IS NOT NULL GROUP BY ALL")
def driver_score(spark, sf_dir):
    got = cascade.rolling_driver_score(cascade.rolling(paired(spark, sf_dir), 120, 60, 10))
    return got.select("dyad_id", "win", F.explode("driver_score").alias("leader", "leads"))


@query(CTE + "SELECT s.dyad_id, s.pair_key, s.idx, round(s.x, 6) + 0.0 AS x, round(t.y, 6) + 0.0 AS y FROM p s JOIN p t ON t.dyad_id = s.dyad_id AND t.pair_key = s.pair_key AND (t.idx + 100) % (SELECT h FROM hn) = s.idx")
def circular_shift(spark, sf_dir):
    return cascade.circular_shift(paired(spark, sf_dir), 100).select("dyad_id", "pair_key", "idx", rounded("x").alias("x"), rounded("y").alias("y"))


@query()
def surrogate_p(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return cascade.p_values(cascade.peak(cascade.ccf(rows)), cascade.null_peaks(rows, 100))


@query()
def surrogate_summary(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return cascade.null_summary(cascade.peak(cascade.ccf(rows)), cascade.null_peaks(rows, 100))


@query(CTE + """, c AS (SELECT s.dyad_id, s.pair_key, shift, round(corr(s.x, t.y), 12) AS r FROM p s CROSS JOIN (SELECT unnest(range(0, 720, 24)) AS shift)
  JOIN p t ON t.dyad_id = s.dyad_id AND t.pair_key = s.pair_key AND (t.idx + shift) % (SELECT h FROM hn) = s.idx GROUP BY ALL),
o AS (SELECT dyad_id, pair_key, abs(r) AS o FROM c WHERE shift = 0)
SELECT dyad_id, pair_key, round(any_value(o), 6) + 0.0 AS observed, count(*) AS n, round(avg(abs(r)), 6) + 0.0 AS null_mean, round(stddev_samp(abs(r)), 6) + 0.0 AS null_sd,
  round(100 * avg(CAST(abs(r) < o AS INTEGER)), 6) + 0.0 AS percentile, round((any_value(o) - avg(abs(r))) / stddev_samp(abs(r)), 6) + 0.0 AS z, round((1 + count(*) FILTER (abs(r) >= o)) / (count(*) + 1), 6) + 0.0 AS p_value
FROM c JOIN o USING (dyad_id, pair_key) WHERE shift > 0 AND r IS NOT NULL AND o IS NOT NULL GROUP BY ALL""")
def shift_summary(spark, sf_dir):
    """Observed correlations beside those with y turned by 1 to 29 days."""
    by = reuse(cascade.shift_null(paired(spark, sf_dir), list(range(0, 720, 24))))
    got = cascade.null_summary(by.where("shift = 0"), by.where("shift > 0"), value="r", peak="r")
    return _rounded_all(got, ["observed", "null_mean", "null_sd", "percentile", "z", "p_value"])


_G = CTE + """, gl AS (SELECT dyad_id, pair_key, x, y, lag(x) OVER o AS x1, lag(y) OVER o AS y1 FROM p WINDOW o AS (PARTITION BY dyad_id, pair_key ORDER BY idx)),
ge AS (SELECT dyad_id, pair_key, 'x_to_y' AS direction, y AS t, y1 AS own, x1 AS other FROM gl WHERE x IS NOT NULL AND y IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL
  UNION ALL SELECT dyad_id, pair_key, 'y_to_x', x, x1, y1 FROM gl WHERE x IS NOT NULL AND y IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL),
gm AS (SELECT dyad_id, pair_key, direction, count(*) AS n, regr_sxx(t, own) AS a, regr_sxx(t, other) AS b, regr_sxy(own, other) AS c, regr_sxy(t, own) AS d, regr_sxy(t, other) AS f, regr_syy(t, own) AS s FROM ge GROUP BY ALL),
gq AS (SELECT *, s - d * d / a AS small, s - (b * d * d - 2 * c * d * f + a * f * f) / (a * b - c * c) AS large FROM gm)
"""


@query(_G + "SELECT dyad_id, pair_key, direction, 1 AS lag, n, round((small - large) / (large / (n - 3)), 4) + 0.0 AS f, round(1 - large / small, 6) + 0.0 AS eta2 FROM gq")
def granger_one(spark, sf_dir):
    """One lag: what SQL says in closed form."""
    got = nested.granger(paired(spark, sf_dir), 1)
    return got.select("dyad_id", "pair_key", "direction", "lag", "n", rounded("f", 4).alias("f"), rounded("eta2").alias("eta2"))


@query()
def granger_rows(spark, sf_dir):
    return nested.granger(paired(spark, sf_dir), LAGS)


# ---- prediction ----


@query(CTE + """, k AS (SELECT dyad_id, pair_key, CAST(j AS BIGINT) AS win, r FROM w, (SELECT wn, unnest(range(0, (wn - 30) // 15 + 1)) AS j FROM hn) WHERE idx >= j * 15 + 30 AND idx < j * 15 + 60 AND j * 15 + 30 <= wn)
SELECT dyad_id, pair_key, win, CAST(avg(r) > 0 AS INTEGER) AS label FROM k GROUP BY ALL HAVING count(r) >= 0.5 * count(*) AND count(r) > 0""")
def future_label(spark, sf_dir):
    return predict.future_labels(series(spark, sf_dir), 30)


@query(_HOPS + peak_sql.ten("dyad_id, pair_key, win") + f"SELECT dyad_id, pair_key, win, {_TEN} FROM tf")
def feature_windows(spark, sf_dir):
    return _rounded_all(predict.feature_matrix(series(spark, sf_dir), 60), FEATURES)


_EXAMPLES = _HOPS + peak_sql.ten("dyad_id, pair_key, win") + """, lb AS (SELECT dyad_id, pair_key, win, CAST(avg(r) > 0 AS INTEGER) AS label FROM (SELECT dyad_id, pair_key, CAST(j AS BIGINT) AS win, r FROM w, (SELECT wn, unnest(range(0, (wn - 60) // 30 + 1)) AS j FROM hn) WHERE idx >= j * 30 + 60 AND idx < j * 30 + 120 AND j * 30 + 60 <= wn)
  GROUP BY ALL HAVING count(r) >= 0.5 * count(*) AND count(r) > 0)
"""


@query(_EXAMPLES + f"SELECT dyad_id, pair_key, win, label, {', '.join(f'round(coalesce({c}, {60.0 if c in predict.DURATIONS else 0.0}), 6) + 0.0 AS {c}' for c in FEATURES)} FROM tf JOIN lb USING (dyad_id, pair_key, win) WHERE coalesce({', '.join(FEATURES)}) IS NOT NULL")
def examples(spark, sf_dir):
    """Labelled windows with imputed features, as cross-validation reads them."""
    return _rounded_all(predict.examples(series(spark, sf_dir), 60), FEATURES)


_FOLDS = CTE + """, r AS (SELECT dyad_id, modality, epoch, value, row_number() OVER (PARTITION BY dyad_id, modality ORDER BY epoch) - 1 AS k, count(*) OVER (PARTITION BY dyad_id, modality) AS n FROM m),
t AS (SELECT *, CAST(j AS INTEGER) AS fold_id, n - (4 - j) * (n // 5) AS start, n // 5 AS test FROM r, range(0, 4) f(j))
"""


@query(_FOLDS + """SELECT dyad_id, modality, fold_id, CAST(count_if(k < start - 2) AS BIGINT) AS train, CAST(count_if(k >= start AND k < start + test) AS BIGINT) AS test FROM t GROUP BY ALL""")
def tscv_folds(spark, sf_dir):
    rows = predict.fold_rows(epochs(spark, sf_dir), 4, 2, ["dyad_id", "modality"], "epoch")
    return rows.groupBy("dyad_id", "modality", "fold_id").agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test"))


@query(CTE + """, s AS (SELECT dyad_id, modality, round(value, 2) AS score, CAST(epoch % 3 = 0 AS INTEGER) AS label FROM m),
k AS (SELECT *, rank() OVER (PARTITION BY dyad_id, modality ORDER BY score) + (count(*) OVER (PARTITION BY dyad_id, modality, score) - 1) / 2.0 AS rk FROM s)
SELECT dyad_id, modality, round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) + 0.0 AS auc FROM k GROUP BY ALL""")
def auc(spark, sf_dir):
    s = epochs(spark, sf_dir).select("dyad_id", "modality", F.round("value", 2).alias("score"), (F.col("epoch") % 3 == 0).cast("int").alias("label"))
    return predict.auc(s, ["dyad_id", "modality"]).withColumn("auc", rounded("auc"))


@query("""WITH d AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY ALL), t AS (SELECT sum(v) AS s, count(*) AS n FROM d)
SELECT 'n' || k AS dyad_id, round(v, 4) + 0.0 AS actual, round((s - v) / (n - 1), 4) + 0.0 AS predicted, round(abs(v - (s - v) / (n - 1)), 4) + 0.0 AS error FROM d, t""")
def lodo(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("dyad_id")).agg(F.avg("c_acctbal").alias("mean_delta_auc"))
    return predict.leave_one_dyad_out(c)[0].withColumns({x: rounded(x, 4) for x in ("actual", "predicted", "error")})


@query(CTE + """, k AS (SELECT dyad_id, modality, value AS v, row_number() OVER (PARTITION BY dyad_id, modality ORDER BY epoch) - 1 AS k, count(*) OVER (PARTITION BY dyad_id, modality) AS n FROM m WHERE value IS NOT NULL),
d AS (SELECT DISTINCT dyad_id, modality, n, CAST(unnest(range(1, 201)) AS INTEGER) AS d FROM k WHERE n >= 3), j AS (SELECT *, unnest(range(0, n)) AS j FROM d),
i AS (SELECT *, ('0x' || md5('42|' || dyad_id || '|' || modality || '|' || d || '|' || j)[1:8])::BIGINT % n AS k FROM j),
u AS (SELECT dyad_id, modality, d, avg(v) AS mean FROM i JOIN k USING (dyad_id, modality, k) GROUP BY ALL)
SELECT dyad_id, modality, any_value(n) AS n, round(quantile_cont(mean, 0.025), 6) + 0.0 AS lower, round(quantile_cont(mean, 0.975), 6) + 0.0 AS upper FROM u JOIN (SELECT DISTINCT dyad_id, modality, n FROM k) USING (dyad_id, modality) GROUP BY dyad_id, modality""")
def bootstrap_ci(spark, sf_dir):
    """Intervals of each modality's mean over days, from 200 resamples."""
    return _rounded_all(predict.bootstrap_ci(epochs(spark, sf_dir), ["dyad_id", "modality"], "value", "epoch", 200), ["lower", "upper"])


@query(_EXAMPLES + f""", ft2 AS (SELECT dyad_id, pair_key, {', '.join(f'coalesce({c}, {60.0 if c in predict.DURATIONS else 0.0}) AS {c}' for c in FEATURES)} FROM tf JOIN lb USING (dyad_id, pair_key, win) WHERE coalesce({', '.join(FEATURES)}) IS NOT NULL),
cr AS (""" + " UNION ALL ".join(f"SELECT dyad_id, pair_key, '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END AS r FROM ft2 GROUP BY ALL" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + """)
SELECT dyad_id, pair_key, feature_a, feature_b, round(r, 6) + 0.0 AS r FROM cr WHERE abs(r) > 0.4""")
def multicollinearity(spark, sf_dir):
    """Features of a pair's windows that say nearly the same."""
    return predict.multicollinearity(predict.examples(series(spark, sf_dir), 60), above=0.4).withColumn("r", rounded("r"))


@query()
def prediction(spark, sf_dir):
    return predict.rolling_origin_cv(series(spark, sf_dir), 60, folds=3)[0]


@query()
def cross_modal_prediction(spark, sf_dir):
    return predict.cross_modal(series(spark, sf_dir), 40, folds=3)[1]


_AHEAD = CTE + """, cx AS (SELECT dyad_id, epoch, avg(value) AS c, list(value ORDER BY modality) AS x FROM m GROUP BY ALL HAVING count(value) = 5),
cl AS (SELECT dyad_id, avg(c) + 0.5 * stddev_pop(c) AS level FROM cx GROUP BY ALL),
ex AS (SELECT a.dyad_id, a.epoch, CAST(b.c >= level AS INTEGER) AS label, a.c AS composite, list_concat(a.x, list_transform(range(1, 6), lambda k: a.x[k] - w.x[k])) AS x
  FROM cx a JOIN cx b ON b.dyad_id = a.dyad_id AND b.epoch = a.epoch + 2 JOIN cx w ON w.dyad_id = a.dyad_id AND w.epoch = a.epoch - 1 JOIN cl ON cl.dyad_id = a.dyad_id)
"""
_MODALITIES = ["click", "error", "purchase", "signup", "view"]


def _preludes(spark, sf_dir):
    return prelude.examples(epochs(spark, sf_dir), 2)


@query(_AHEAD + """, lf AS (SELECT *, unnest(range(1, 11)) AS k FROM ex)
SELECT dyad_id, epoch, label, CAST(k - 1 AS INTEGER) AS k, round(x[k], 6) + 0.0 AS x FROM lf""")
def prelude_examples(spark, sf_dir):
    """What the modalities do on a day, and whether the dyad is in step two days later."""
    return _preludes(spark, sf_dir).select("dyad_id", "epoch", "label", F.posexplode("x").alias("k", "x")).withColumn("x", rounded("x"))


@query(_AHEAD + """, pp AS (SELECT dyad_id, label, round(1 / (1 + exp(-composite)), 9) AS p FROM ex),
pc AS (SELECT dyad_id, count(*) AS n, count_if(p >= 0.5 AND label = 1)::BIGINT AS tp, count_if(p >= 0.5 AND label = 0)::BIGINT AS fp, count_if(p < 0.5 AND label = 0)::BIGINT AS tn, count_if(p < 0.5 AND label = 1)::BIGINT AS fn FROM pp GROUP BY ALL),
pa AS (SELECT a.dyad_id, avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc FROM pp a JOIN pp b ON a.dyad_id = b.dyad_id AND a.label = 1 AND b.label = 0 GROUP BY ALL)
SELECT pc.*, round((tp + tn) / n, 6) + 0.0 AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) + 0.0 AS f1, round(tp / nullif(tp + fn, 0), 6) + 0.0 AS sensitivity,
  round(tn / nullif(tn + fp, 0), 6) + 0.0 AS specificity, round(auc, 6) + 0.0 AS auc FROM pc LEFT JOIN pa USING (dyad_id)""")
def persistence_report(spark, sf_dir):
    """How well today's composite alone tells the state two days later."""
    p = _preludes(spark, sf_dir).select("dyad_id", "label", F.round(1 / (1 + F.exp(-F.col("composite"))), 9).alias("p"))
    return _rounded_all(prelude.report(p), ["accuracy", "f1", "sensitivity", "specificity", "auc"])


@query()
def prelude_report(spark, sf_dir):
    """The same of models fitted to all but the day that they are asked about."""
    return _rounded_all(prelude.report(prelude.left_out(_preludes(spark, sf_dir))), ["accuracy", "f1", "sensitivity", "specificity", "auc"])


# ---- episodes ----

_STATES = CTE + """, es AS (SELECT dyad_id, modality, epoch, value, value >= avg(value) OVER k + 0.5 * stddev_pop(value) OVER k AS high FROM m WINDOW k AS (PARTITION BY dyad_id, modality)),
er AS (SELECT dyad_id, modality, high, min(epoch) AS first, max(epoch) AS last, count(*) AS epochs FROM (SELECT *, epoch - row_number() OVER (PARTITION BY dyad_id, modality, high ORDER BY epoch) AS run FROM es) GROUP BY dyad_id, modality, high, run),
ee AS (SELECT dyad_id, modality, min(epoch) AS a, max(epoch) AS b FROM es GROUP BY ALL)
"""


@query(_STATES + """, t AS (SELECT dyad_id, modality, min(epoch) FILTER (high) AS onset, max(value) AS peak, arg_min(value, epoch) AS v, min(epoch) AS a, arg_max(epoch, {'v': value, 'e': -epoch}) AS b, min(value) AS lo FROM es GROUP BY ALL),
hd AS (SELECT dyad_id, modality, coalesce(max(epochs) FILTER (high), 0) AS maintenance, CAST(count_if(high AND last < b) AS BIGINT) AS breakdowns, avg(epochs) FILTER (NOT high AND first > a AND last < b) AS recovery FROM er JOIN ee USING (dyad_id, modality) GROUP BY ALL),
nb AS (SELECT dyad_id, modality, least(floor((value - lo) / (peak - lo) * 10), 9) AS bin, count(*) AS c FROM es JOIN t USING (dyad_id, modality) GROUP BY ALL),
y AS (SELECT dyad_id, modality, sum(-c / total * ln(c / total)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY dyad_id, modality) AS total FROM nb) GROUP BY ALL)
SELECT dyad_id, modality, onset, round((peak - v) / nullif(b - a, 0), 6) + 0.0 AS build_up, round(peak, 6) + 0.0 AS peak, maintenance, breakdowns, round(recovery, 6) + 0.0 AS recovery, round(entropy, 6) + 0.0 AS entropy
FROM t JOIN hd USING (dyad_id, modality) JOIN y USING (dyad_id, modality)""")
def dynamics(spark, sf_dir):
    """How each modality rises above its threshold, holds, breaks and returns, by days."""
    return _rounded_all(episodes.dynamics(epochs(spark, sf_dir)), ["build_up", "peak", "recovery", "entropy"])


@query(_STATES + """, o AS (SELECT dyad_id, modality, min(epoch) AS onset FROM es WHERE high GROUP BY ALL),
ol AS (SELECT dyad_id, arg_min(modality, {'o': onset, 'm': modality}) AS leader, max(onset) - min(onset) AS delay FROM o GROUP BY ALL),
oc AS (SELECT dyad_id, epoch, count_if(high) AS h FROM es GROUP BY ALL)
SELECT dyad_id, any_value(leader) AS leader, any_value(delay) AS delay, CAST(count_if(h >= 2) AS BIGINT) AS coherence, round(avg(CAST(h = 5 AS INTEGER)), 6) + 0.0 AS full_chord FROM oc LEFT JOIN ol USING (dyad_id) GROUP BY dyad_id""")
def chords(spark, sf_dir):
    """Which modality leads, and how often several are high together."""
    return episodes.chords(epochs(spark, sf_dir)).withColumn("full_chord", rounded("full_chord"))


# ---- reports and viewer ----


@query("""WITH r AS (SELECT 'd' || (user_id % 3) AS dyad_id, event_type AS modality, count(*) AS samples, CAST(1 AS BIGINT) AS features, CAST(count(*) - count(value) AS BIGINT) AS missing,
  round(min(epoch_us(ts - TIMESTAMP '2024-01-01') / 3.6e9), 6) + 0.0 AS t_min, round(max(epoch_us(ts - TIMESTAMP '2024-01-01') / 3.6e9), 6) + 0.0 AS t_max FROM events GROUP BY ALL) SELECT * FROM r""")
def summary(spark, sf_dir):
    return quality.summary(events(spark, sf_dir)).withColumns({c: rounded(c) for c in ("t_min", "t_max")})


def _stream(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.floor(F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 1000).cast("double")
    return e.select((F.col("user_id") % 5).cast("string").alias("stream_id"), F.col("event_id").alias("row"), ms.alias("t_ms"), F.col("value").alias("p1"), (F.col("value") * 2).alias("p2"))


@query("""WITH s AS (SELECT CAST(user_id % 5 AS VARCHAR) AS stream_id, event_id, floor(epoch_us(ts - TIMESTAMP '2024-01-01') / 1000) AS t FROM events),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY stream_id ORDER BY event_id) AS dt FROM s),
q AS (SELECT stream_id, list_sort(list(dt) FILTER (dt > 0)) AS l FROM d GROUP BY 1), m AS (SELECT stream_id, l[len(l) // 2 + 1] AS median FROM q)
SELECT stream_id, count(*) AS n, CAST(count_if(dt < 0) AS BIGINT) AS backwards, CAST(count_if(dt = 0) AS BIGINT) AS duplicates, any_value(median) AS median, CAST(count_if(dt > 3 * median) AS BIGINT) AS gaps, round(1000 / any_value(median), 6) + 0.0 AS rate
FROM d JOIN m USING (stream_id) GROUP BY ALL""")
def validate_report(spark, sf_dir):
    return quality.validate(_stream(spark, sf_dir)).select("stream_id", "n", "backwards", "duplicates", "median", "gaps", rounded("rate").alias("rate"))


@query(CTE + "SELECT dyad_id, modality, epoch, round(value, 6) + 0.0 AS value FROM m")
def epoch_mean(spark, sf_dir):
    return epochs(spark, sf_dir).select("dyad_id", "modality", "epoch", rounded("value").alias("value"))


@query(CTE + """SELECT dyad_id, epoch, round(max(value) FILTER (modality = 'click'), 6) + 0.0 AS click, round(max(value) FILTER (modality = 'error'), 6) + 0.0 AS error, round(max(value) FILTER (modality = 'purchase'), 6) + 0.0 AS purchase,
  round(max(value) FILTER (modality = 'signup'), 6) + 0.0 AS signup, round(max(value) FILTER (modality = 'view'), 6) + 0.0 AS view FROM m GROUP BY ALL""")
def pivot_timeline(spark, sf_dir):
    names = ["click", "error", "purchase", "signup", "view"]
    return viewer.pivot_timeline(epochs(spark, sf_dir), names).withColumns({c: rounded(c) for c in names})


@query(CTE + "SELECT dyad_id, modality, round(max(value), 6) + 0.0 AS max, round(avg(value), 6) + 0.0 AS mean FROM m GROUP BY ALL")
def modality_summary(spark, sf_dir):
    return viewer.modality_summary(epochs(spark, sf_dir)).withColumns({c: rounded(c) for c in ("max", "mean")})


def _segments(spark):
    return spark.createDataFrame([("d0", "s1", 3, 9), ("d0", "s2", 14, 20), ("d1", "s1", 0, 10), ("d2", "s1", 5, 6)], "dyad_id string, segment string, start_epoch int, end_epoch int")


_SEG = "(VALUES ('d0', 's1', 3, 9), ('d0', 's2', 14, 20), ('d1', 's1', 0, 10), ('d2', 's1', 5, 6)) s(dyad_id, segment, start_epoch, end_epoch)"


@query(CTE + f"""SELECT m.dyad_id, segment, modality, round(avg(value), 3) + 0.0 AS mean, round(max(value), 3) + 0.0 AS max, round(min(value), 3) + 0.0 AS min
FROM m JOIN {_SEG} ON s.dyad_id = m.dyad_id AND epoch >= start_epoch AND epoch < end_epoch GROUP BY ALL""")
def segment_stats(spark, sf_dir):
    return viewer.segment_stats(epochs(spark, sf_dir), _segments(spark)).withColumns({c: F.col(c) + 0.0 for c in ("mean", "max", "min")})


@query(f"""WITH l AS (SELECT dyad_id, end_epoch AS a, coalesce(lead(start_epoch) OVER (PARTITION BY dyad_id ORDER BY start_epoch), 30) AS b FROM {_SEG}
UNION ALL SELECT dyad_id, 0, min(start_epoch) FROM {_SEG} GROUP BY 1 HAVING min(start_epoch) > 1)
SELECT dyad_id, arg_max(a, {{'w': b - a, 'k': -a}}) AS gap_start, arg_max(b, {{'w': b - a, 'k': -a}}) AS gap_end FROM l WHERE b > a GROUP BY 1""")
def largest_gap(spark, sf_dir):
    return viewer.largest_gap(_segments(spark), 30)


@query(CTE + """, s AS (SELECT dyad_id, modality, avg(value) + stddev_pop(value) AS t FROM m GROUP BY ALL), o AS (SELECT dyad_id, modality, min(epoch) FILTER (value >= t) AS onset_epoch FROM m JOIN s USING (dyad_id, modality) GROUP BY ALL)
SELECT dyad_id, modality, onset_epoch, CAST(row_number() OVER q AS INTEGER) AS position, CAST(lead(onset_epoch) OVER q - onset_epoch AS DOUBLE) AS delay FROM o WHERE onset_epoch IS NOT NULL WINDOW q AS (PARTITION BY dyad_id ORDER BY onset_epoch, modality)""")
def cascade_chain(spark, sf_dir):
    return viewer.cascade_chain(viewer.onsets(epochs(spark, sf_dir))).withColumn("delay", F.col("delay").cast("double"))


_SIGMAS = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5)


@query(CTE + ", sg AS (SELECT dyad_id, modality, avg(value) AS a, stddev_pop(value) AS s FROM m GROUP BY ALL), os AS (SELECT dyad_id, modality, " + ", ".join(f"min(epoch) FILTER (value >= a + {k} * s) AS o{i}" for i, k in enumerate(_SIGMAS))
       + " FROM m JOIN sg USING (dyad_id, modality) GROUP BY ALL) SELECT dyad_id, modality, " + " || ',' || ".join(f"coalesce(o{i}::VARCHAR, '-')" for i in range(6)) + " AS onsets, greatest(o0, o1, o2, o3, o4, o5) - least(o0, o1, o2, o3, o4, o5) AS spread FROM os")
def onset_stability(spark, sf_dir):
    """How far a modality's onset moves with the threshold."""
    got = viewer.onset_stability(epochs(spark, sf_dir), _SIGMAS)
    return got.select("dyad_id", "modality", F.array_join("onsets", ",", "-").alias("onsets"), "spread")


@query(_CCF + "SELECT dyad_id, pair_key, lag, round(ccf, 6) + 0.0 AS ccf FROM (SELECT * FROM k ORDER BY ccf DESC, dyad_id, pair_key LIMIT 4)")
def topk_leadlag(spark, sf_dir):
    return viewer.top_leads(cascade.peak(cascade.ccf(_rows(spark, sf_dir)))).select("dyad_id", "pair_key", "lag", rounded("ccf").alias("ccf"))


@query(CTE + """SELECT dyad_id, epoch, round(sum(value * w) / sum(w), 6) + 0.0 AS composite FROM m JOIN (VALUES ('click', 1.0), ('view', 2.0), ('purchase', 3.5)) t(modality, w) USING (modality) GROUP BY ALL""")
def weighted_composite(spark, sf_dir):
    w = spark.createDataFrame([("click", 1.0), ("view", 2.0), ("purchase", 3.5)], "modality string, weight double")
    return viewer.weighted_composite(epochs(spark, sf_dir), F.broadcast(w)).withColumn("composite", rounded("composite"))  # w is three rows


@query(CTE + "SELECT dyad_id, modality, idx AS epoch, round(pv, 6) + 0.0 AS value FROM n")
def step_hold(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumnRenamed("idx", "epoch")
    return viewer.step_hold(h.where("value is not null"), h, ["dyad_id", "modality"]).withColumn("value", rounded("value"))


@query(CTE + """SELECT dyad_id, pair_key, idx, round(1 - abs(x - y) / 6, 6) + 0.0 AS convergence FROM p""")
def convergence(spark, sf_dir):
    return viewer.convergence(paired(spark, sf_dir), 6.0).select("dyad_id", "pair_key", "idx", rounded("convergence").alias("convergence"))


@query(CTE + """, s AS (SELECT dyad_id, row_number() OVER (PARTITION BY epoch, dyad_id ORDER BY modality) AS o, epoch, value FROM m)
SELECT dyad_id, epoch, round(((((max(value) FILTER (o = 1) + max(value) FILTER (o = 2)) / 2 + max(value) FILTER (o = 3)) / 2 + max(value) FILTER (o = 4)) / 2 + max(value) FILTER (o = 5)) / 2, 6) + 0.0 AS value FROM s GROUP BY dyad_id, epoch HAVING count(*) = 5""")
def stream_merge(spark, sf_dir):
    """Each dyad's five modalities, taken as streams of one, merged in order of their names."""
    rank = F.array_position(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), F.col("modality"))
    s = epochs(spark, sf_dir).select("dyad_id", F.lit("events").alias("modality"), rank.alias("stream_ord"), "epoch", "value")
    return viewer.merge_streams(s).select("dyad_id", "epoch", rounded("value").alias("value"))


@query(_EDGES + """SELECT dyad_id, source, target, CASE WHEN abs(lag) < 3 THEN printf('%s moderately precedes temporally %s by %.1fs. %s provides early signal for %s.', source, target, CAST(abs(lag) AS DOUBLE), source, target)
  ELSE printf('%s moderately precedes temporally %s by %.1fs. This is a slow anticipatory trend, not an instantaneous coupling.', source, target, CAST(abs(lag) AS DOUBLE)) END AS said FROM ed""")
def nlg_edge(spark, sf_dir):
    e = _edges(spark, sf_dir)
    said = wording.describe_edge(F.col("source"), F.col("target"), F.col("lag_sec"), F.col("polarity"), F.lit("moderate"), F.col("p_value"))
    return e.select("dyad_id", "source", "target", said.alias("said"))


_BAD = " OR ".join(f"contains(lower(p_name), '{w}')" for w in wording.FORBIDDEN)


@query(f"SELECT p_partkey, NOT ({_BAD}) AS ok FROM part")
def nlg_guard(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", wording.allowed(F.col("p_name")).alias("ok"))


@query("""SELECT event_id, printf('%s%d:%02d.%03d', CASE WHEN ms < 0 THEN '-' ELSE '' END, CAST(abs(ms) // 60000 AS INTEGER), CAST(abs(ms) % 60000 // 1000 AS INTEGER), CAST(abs(ms) % 1000 AS INTEGER)) AS clock
FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events)""")
def timestamp_format(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", wording.timestamp(F.floor(F.col("value") * 1000)).alias("clock"))


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")
def category_counts(spark, sf_dir):
    return viewer.category_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "category"))


@query("""SELECT event_type AS modality, date_trunc('hour', ts)::TIMESTAMP AS epoch_start, count(*) AS n, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY ALL""")
def event_time_epochs(spark, sf_dir):
    """The batch form of the streaming epochs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("modality"), F.col("ts").cast("timestamp").alias("ts"), "value")
    got = stream.epochs(e, "1 hour")
    return got.select("modality", F.col("epoch_start").cast("timestamp_ntz").alias("epoch_start"), "n", rounded("value").alias("value"))


@query("""WITH s AS (SELECT 'd' || (user_id % 3) AS dyad_id, event_type AS m, ts, value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
e AS (SELECT dyad_id, m, time_bucket(INTERVAL 12 HOUR, ts) AS h, avg(value) AS v FROM s GROUP BY ALL),
p AS (SELECT a.dyad_id, a.m || '__' || b.m AS pair_key, a.h, a.v AS x, b.v AS y FROM e a JOIN e b USING (dyad_id, h)
      WHERE a.m < b.m AND a.h + INTERVAL 12 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM s) - INTERVAL 1 HOUR),
w AS (SELECT dyad_id, pair_key, h, lead(h, 9) OVER o AS last, covar_pop(x, y) OVER f AS c, stddev_pop(x) OVER f * stddev_pop(y) OVER f AS d FROM p
      WINDOW o AS (PARTITION BY dyad_id, pair_key ORDER BY h), f AS (PARTITION BY dyad_id, pair_key ORDER BY h ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT dyad_id, pair_key, h AS epoch_start, CASE WHEN d > 1e-10 THEN round(greatest(-1, least(1, c / d)), 6) + 0.0 END AS r FROM w WHERE last = h + INTERVAL 108 HOUR""")
def live_pairs(spark, sf_dir):
    """All events as a stream: half days of two event types, that meet by event time, in windows of ten without a missing one.

    What the watermark, an hour behind the last event, doesn't make final yet is not there.
    """
    path = f"{sf_dir}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    dyad = F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string"))
    zero = F.lit("1970-01-01").cast("timestamp_ntz")  # whatever the session's time zone, half days are those of the table
    ts = F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, F.col("ts")))
    signals = e.select(dyad.alias("dyad_id"), F.col("event_type").alias("modality"), ts.alias("ts"), "value")
    out = live.all_of(live.correlations(live.pairs(signals, "12 hours", "1 hour"), WINDOW), f"{shared_folder(spark)}/live-{uuid.uuid4()}")
    return out.where("not ended").select("dyad_id", "pair_key", F.timestamp_add("MICROSECOND", F.unix_micros("epoch_start"), zero).alias("epoch_start"), rounded("r").alias("r"))


@query("""SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice,
  round(last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS last_urgent FROM orders""")
def asof_last(spark, sf_dir):
    """The as-of primitive on a general table: each order with its customer's last urgent one."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    near = with_neighbours(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"), F.floor(day / 365))
    return near.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.round("prev", 2).alias("last_urgent"))
