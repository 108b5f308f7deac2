"""Each of the library's queries beside its SQL, on the smallest tables."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

import __spark_entry__
from duetspark.operators import predict
from duetspark.queries import QUERIES, SQL, series
from duetspark.schema import FEATURES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: On so few events these repeat what the others show, at length.
SLOW = {"cross_modal_prediction", "graph_nodes", "bh_fdr", "topk_leadlag", "nlg_edge", "cascade_edges", "rolling_ccf"}


def rows(x):
    """Sorted rows; pandas makes whole numbers floats where some are missing."""
    plain = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    known = x[sorted(x.columns)].astype(object).where(x.notna(), None)
    return sorted(repr(tuple(map(plain, r))) for r in known.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_as_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    spark.catalog.clearCache()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


#: At the smallest tables the windows of these are empty or hold nothing but NULL.
SPARSE = ("features10", "features_by_context", "feature_windows", "examples", "dynamics", "persistence_report", "peaks", "onset", "recovery")


@pytest.mark.parametrize("name", SPARSE)
def test_query_as_its_sql_on_more_events(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    a, b = QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
    spark.catalog.clearCache()
    assert rows(a) == rows(b) and a.notna().all(axis=1).any()


@pytest.mark.parametrize("name", ["zscore", "ffill_maxgap", "short_gaps", "sliding_correlation", "future_label", "examples", "rolling_ccf", "circular_shift", "wcc_directional"])
def test_sixty_days(spark, tmp_path_factory, name):
    """All of a longer recording counts."""
    rng, start = np.random.default_rng(5), datetime(2024, 1, 1)
    path = tmp_path_factory.mktemp("days")
    made = [(int(rng.integers(0, 3)), str(rng.choice(["click", "error", "view"])), start + timedelta(hours=float(rng.random() * 1440)), float(rng.standard_normal())) for _ in range(2_500)]
    spark.createDataFrame(made, "user_id bigint, event_type string, ts timestamp_ntz, value double").write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    a, b = QUERIES[name](spark, str(path)).toPandas(), con.sql(SQL[name]).df()
    spark.catalog.clearCache()
    assert len(a) and rows(a) == rows(b)
    if "idx" in a.columns:
        assert a["idx"].max() > 1_400


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def cross_modal_by_hand(x, r, window, folds):
    """{(source, target): (mean AUC, mean AUC of the target's own features, folds)} of one dyad, by loops; x[pair][win] are features."""
    out, step, nothing = {}, window // 2, [float(window) if f in predict.DURATIONS else 0.0 for f in FEATURES]
    for source, target in ((a, b) for a in r for b in r if a != b):
        rows, n = [], len(r[target])
        for win in range((n - window) // step + 1):
            later = [v for v in r[target][win * step + window : win * step + 2 * window] if v is not None]
            future = len(r[target][win * step + window : win * step + 2 * window])
            if later and len(later) >= 0.5 * future and win in x[source]:
                rows.append((x[source][win], x[target].get(win, nothing), int(np.mean(later) > 0)))
        a, own, y = (np.array(z) for z in zip(*rows, strict=True))
        got, test = [], len(y) // (folds + 1)
        for k in range(folds):
            start = len(y) - (folds - k) * test
            s = slice(start, start + test)
            if len({*y[:start]}) == len({*y[s]}) == 2:
                fits = [(z, predict.l1_logistic(z[:start], y[:start])) for z in (a, own)]
                got.append([predict.rank_auc(y[s], z[s] @ w[:-1] + w[-1]) for z, w in fits])
        out[source, target] = (*(np.mean(got, axis=0) if got else (0.5, 0.5)), len(got))
    return out


def test_cross_modal_prediction_of_every_dyad(spark, tmp_path):
    rng, start = np.random.default_rng(3), datetime(2024, 1, 1)
    made = [(u, m, start + timedelta(hours=h, minutes=1), float(np.sin(h / (30 + 9 * u + 5 * k)) + 0.5 * rng.standard_normal()))
            for u in range(3) for k, m in enumerate(("click", "error", "view")) for h in range(720)]
    spark.createDataFrame(made, "user_id bigint, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["dyad_id"], r["source"], r["target"]): r for r in QUERIES["cross_modal_prediction"](spark, str(tmp_path)).collect()}
    s = series(spark, str(tmp_path)).persist()
    rs, xs = {}, {}
    for r in s.orderBy("idx").collect():
        rs.setdefault(r["dyad_id"], {}).setdefault(r["pair_key"], []).append(r["r"])
    for r in predict.feature_matrix(s, 40).collect():
        if any(r[f] is not None for f in FEATURES):
            x = [(40.0 if f in predict.DURATIONS else 0.0) if r[f] is None else r[f] for f in FEATURES]
            xs.setdefault(r["dyad_id"], {}).setdefault(r["pair_key"], {})[r["win"]] = x
    s.unpersist()
    want = {(d, *k): v for d in rs for k, v in cross_modal_by_hand(xs[d], rs[d], 40, 3).items()}
    assert {d for d, _, _ in got} == {"d0", "d1", "d2"} and got.keys() == want.keys() and len(got) == 18
    assert any(v[2] for v in want.values())
    for k, (auc, own, n) in want.items():
        assert got[k]["n_folds"] == n
        assert np.allclose([got[k]["mean_dynamic_auc"], got[k]["mean_ar_baseline_auc"]], [auc, own])
