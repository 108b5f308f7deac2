"""SQL for the peaks and the ten features of correlation series: what the grouped functions are held against."""

from __future__ import annotations


def profiles(source: str, keys: str, height: float = 0.2, distance: int = 10) -> str:
    """Common table expressions from ``source(keys, idx, r)`` to ``pk``, a row a peak, and ``si``, the numbered samples."""
    same = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    of = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    return f""", si AS (SELECT {keys}, CAST(row_number() OVER s - 1 AS BIGINT) AS i, r, coalesce(r, avg(r) OVER k, 0) AS v, count(*) OVER k AS n FROM {source}
  WINDOW s AS (PARTITION BY {keys} ORDER BY idx), k AS (PARTITION BY {keys})),
rn AS (SELECT *, sum(CAST(was IS DISTINCT FROM v AS INTEGER)) OVER (PARTITION BY {keys} ORDER BY i) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY {keys} ORDER BY i) AS was FROM si)),
fl AS (SELECT {keys}, run, min(i) AS a, max(i) AS b, any_value(v) AS v FROM rn GROUP BY {keys}, run),
tp AS (SELECT {keys}, (a + b) // 2 AS p, v, lag(v) OVER q AS low, lead(v) OVER q AS next FROM fl WINDOW q AS (PARTITION BY {keys} ORDER BY run)),
cd AS (SELECT {keys}, p, row_number() OVER (PARTITION BY {keys} ORDER BY v DESC, p DESC) AS pr FROM tp WHERE v > low AND v > next AND v >= {height}),
nm AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM cd
  UNION ALL SELECT {of('nm')}, nm.k + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - cd.p) < {distance})) = 0 THEN list_append(kept, cd.p) ELSE kept END FROM nm JOIN cd ON {same('nm', 'cd')} AND cd.pr = nm.k + 1),
kp AS (SELECT {keys}, unnest(arg_max(kept, k)) AS p FROM nm GROUP BY {keys}),
bd AS (SELECT {of('kp')}, p, any_value(t.v) AS vp, coalesce(max(s.i) FILTER (s.i < p AND s.v > t.v) + 1, 0) AS l, coalesce(min(s.i) FILTER (s.i > p AND s.v > t.v), any_value(s.n)) - 1 AS rt
  FROM kp JOIN si s ON {same('kp', 's')} JOIN si t ON {same('kp', 't')} AND t.i = p GROUP BY {of('kp')}, p),
pm AS (SELECT {of('bd')}, p, vp, l, rt, vp - greatest(min(s.v) FILTER (s.i BETWEEN l AND p), min(s.v) FILTER (s.i BETWEEN p AND rt)) AS tall FROM bd JOIN si s ON {same('bd', 's')} GROUP BY {of('bd')}, p, vp, l, rt),
hf AS (SELECT {of('pm')}, p, vp, tall, vp - tall / 2 AS level, coalesce(max(s.i) FILTER (s.i BETWEEN l AND p AND s.v <= vp - tall / 2), l) AS x, coalesce(min(s.i) FILTER (s.i BETWEEN p AND rt AND s.v <= vp - tall / 2), rt) AS y
  FROM pm JOIN si s ON {same('pm', 's')} WHERE tall >= {height / 2} GROUP BY {of('pm')}, p, vp, tall, l, rt),
wd AS (SELECT {of('hf')}, p, vp, tall, (y - CASE WHEN b.v < level THEN (level - b.v) / (b1.v - b.v) ELSE 0 END) - (x + CASE WHEN a.v < level THEN (level - a.v) / (a1.v - a.v) ELSE 0 END) AS wide
  FROM hf JOIN si a ON {same('hf', 'a')} AND a.i = x JOIN si b ON {same('hf', 'b')} AND b.i = y LEFT JOIN si a1 ON {same('hf', 'a1')} AND a1.i = x + 1 LEFT JOIN si b1 ON {same('hf', 'b1')} AND b1.i = y - 1),
ps AS (SELECT *, lag(p) OVER q AS before, lead(p) OVER q AS after FROM wd WHERE wide >= 1 WINDOW q AS (PARTITION BY {keys} ORDER BY p)),
ar AS (SELECT {of('ps')}, p, vp, tall, wide, before, after, arg_min(s.i, s.v) FILTER (s.i BETWEEN before AND p) AS lo, arg_min(s.i, s.v) FILTER (s.i BETWEEN p AND after) AS hi,
    min(s.v) FILTER (s.i BETWEEN before AND p) AS vlo, min(s.v) FILTER (s.i BETWEEN p AND after) AS vhi, avg(s.v) FILTER (s.i < p) AS mlo, avg(s.v) FILTER (s.i >= p) AS mhi, any_value(s.n) AS n
  FROM ps JOIN (SELECT * FROM si ORDER BY i) s ON {same('ps', 's')} GROUP BY {of('ps')}, p, vp, tall, wide, before, after),
pk AS (SELECT {keys}, p AS peak_index, CAST(p AS DOUBLE) AS peak_time_sec, vp AS peak_value, tall AS prominence, wide AS width_samples, CAST(after - p AS DOUBLE) AS inter_peak_interval_sec,
    CASE WHEN before IS NULL THEN (vp - mlo) / p ELSE (vp - vlo) / (p - lo) END AS build_up_rate, CASE WHEN after IS NULL THEN (vp - mhi) / (n - 1 - p) ELSE (vp - vhi) / (hi - p) END AS breakdown_rate FROM ar)
"""


PEAK = "peak_time_sec, peak_value, prominence, width_samples, inter_peak_interval_sec, build_up_rate, breakdown_rate"
TEN = ["onset_latency", "onset_amplitude", "build_up_slope", "build_up_rate", "peak_amplitude", "peak_duration", "breakdown_rate", "recovery_time", "mean_synchrony", "synchrony_entropy"]


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


def ten(keys: str, onset: float = 0.2, max_missing: float = 0.2) -> str:
    """Further expressions to ``tf``: the ten features, a row a series, NULL throughout where there are none."""
    use = f"USING ({keys})"
    return f""", ok AS (SELECT {keys} FROM si GROUP BY {keys} HAVING 1 - count(r) / count(*) <= {max_missing} AND count(r) >= 5),
fr AS (SELECT {keys}, min(peak_index) AS f, max(peak_index) AS l, max(peak_value) AS peak_amplitude, avg(build_up_rate) AS build_up_rate, avg(width_samples) AS peak_duration, avg(breakdown_rate) AS breakdown_rate FROM pk GROUP BY {keys}),
st AS (SELECT {keys}, min(i) FILTER (r >= {onset}) AS start, avg(r) AS mean_synchrony, min(r) AS lo, max(r) AS hi, count(r) AS c FROM si GROUP BY {keys}),
sl AS (SELECT {keys}, CASE WHEN any_value(f) - coalesce(any_value(start), 0) > 1 AND count(r) FILTER (i BETWEEN coalesce(start, 0) AND f) > 1 THEN regr_slope(r, i) FILTER (i BETWEEN coalesce(start, 0) AND f) ELSE 0 END AS build_up_slope,
    count(r) FILTER (i >= l) AS rest, arg_min(r, i) FILTER (r IS NOT NULL AND i < greatest(f, 1)) AS head, any_value(r) FILTER (i = start) AS hit FROM si JOIN fr {use} JOIN st {use} GROUP BY {keys}),
bn AS (SELECT {keys}, CASE WHEN hi > lo THEN least(floor((r - lo) / (hi - lo) * 10), 9) ELSE 0 END AS bin, any_value(c) AS c, count(*) AS k FROM si JOIN st {use} WHERE r IS NOT NULL GROUP BY {keys}, bin),
en AS (SELECT {keys}, sum(-k / c * ln(k / c)) AS synchrony_entropy FROM bn GROUP BY {keys}),
ft AS (SELECT {keys}, CAST(coalesce(start, f) AS DOUBLE) AS onset_latency, CASE WHEN start IS NULL THEN head ELSE hit END AS onset_amplitude, build_up_slope, build_up_rate, peak_amplitude, peak_duration, breakdown_rate,
    CAST(nullif(rest, 0) AS DOUBLE) AS recovery_time, mean_synchrony, synchrony_entropy FROM ok JOIN fr {use} JOIN st {use} JOIN sl {use} JOIN en {use}),
tf AS (SELECT {keys}, ft.* EXCLUDE ({keys}) FROM (SELECT DISTINCT {keys} FROM si) LEFT JOIN ft {use})
"""
