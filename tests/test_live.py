"""Live pairs: late samples, missing epochs, series that end and come back, beside plain loops."""

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from duetspark.streaming import live

START = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "dyad_id string, modality string, ts timestamp, value double, pair_key string, w string"


def at(minute, second=0):
    return START + timedelta(minutes=minute, seconds=second)


def played(spark, folder, rows, window, patience):
    spark.createDataFrame([(*r, "p", "q") for r in rows], SCHEMA).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    return live.all_of(live.correlations(live.pairs(stream, "1 minute", "2 minutes"), window, patience), f"{folder}/out").collect()


def by_hand(values, window):
    """{(pair, first minute): r} of {modality: {minute: mean}}: windows without a missing epoch."""
    out = {}
    for a in values:
        for b in values:
            both = sorted(set(values[a]) & set(values[b])) if a < b else []
            for m in both:
                if all(m + k in both for k in range(window)):
                    x, y = ([values[s][m + k] for k in range(window)] for s in (a, b))
                    out[f"{a}__{b}", m] = np.corrcoef(x, y)[0, 1] if np.std(x) * np.std(y) > 1e-10 else None
    return out


def test_live_pairs_missing_epochs_and_ended_series(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = {m: {k: float(rng.standard_normal()) for k in range(60)} for m in "abc"}
    for gone in (10, 11, 30):
        del values["b"][gone]
    values["c"] = {k: v for k, v in values["c"].items() if k < 20}  # c ends, and is heard again much later
    values["c"] |= {k: float(k % 3) for k in range(50, 60)}
    rows = [("d", m, at(k, s), v + d) for m, by in values.items() for k, v in by.items() for s, d in ((5, 0.5), (40, -0.5))]
    rows += [("d", "a", at(90), 0.0), ("d", None, at(1), 1.0), (None, "a", at(1), 1.0), ("d", "a", None, 1.0), ("d", "b", at(2), None), ("alone", "a", at(3), 1.0)]
    got = played(spark, str(tmp_path), rows, 5, 600.0)
    want = by_hand(values, 5)
    seen = {(r["pair_key"], round((r["epoch_start"].timestamp() - START.timestamp()) / 60)): r["r"] for r in got if not r["ended"]}
    assert seen.keys() == want.keys() and len(seen) == sum(not r["ended"] for r in got)
    assert all(seen[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    ended = sorted((r["pair_key"], round((r["epoch_start"].timestamp() - START.timestamp()) / 60)) for r in got if r["ended"])
    assert ended == [("a__b", 59), ("a__c", 59), ("b__c", 59)]  # one trigger: c's hole is only a gap


def test_live_pairs_over_triggers_late_samples_and_end(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rng = np.random.default_rng(2)
    value = {m: {k: float(rng.standard_normal()) for k in range(40)} for m in "ab"}

    def come(rows):
        spark.createDataFrame([(*r, "p", "q") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return live.all_of(live.correlations(live.pairs(stream, "1 minute", "2 minutes"), 4, 600.0), out).collect()

    both = lambda a, b: [("d", m, at(k, 1), value[m][k]) for m in "ab" for k in range(a, b)]
    assert {r["epoch_start"].timestamp() for r in come(both(0, 10))} == {at(k).timestamp() for k in range(4)}  # 7 to 9 may still change
    late = [("d", "a", at(9, 30), value["a"][9]), ("d", "a", at(2, 30), 1e6)]  # in time, and too late: the first alone counts
    got = come(both(10, 20) + late)
    assert {r["epoch_start"].timestamp() for r in got} == {at(k).timestamp() for k in range(14)}
    got = come([("e", "a", at(60), 0.0)])  # time goes on by another dyad: d is final, and has ended
    ended = [r for r in got if r["ended"]]
    assert [(r["dyad_id"], r["pair_key"], r["epoch_start"].timestamp()) for r in ended] == [("d", "a__b", at(19).timestamp())]
    got = come([("d", m, at(60 + k, 1), value[m][20 + k]) for m in "ab" for k in range(8)] + [("e", "a", at(90), 0.0)])
    seen = {round((r["epoch_start"].timestamp() - START.timestamp()) / 60): r["r"] for r in got if not r["ended"]}
    assert len(seen) == sum(not r["ended"] for r in got) and sorted(seen) == [*range(17), *range(60, 65)]
    for m, r in seen.items():
        k = m if m < 40 else m - 40
        assert r == pytest.approx(np.corrcoef([value["a"][k + i] for i in range(4)], [value["b"][k + i] for i in range(4)])[0, 1], abs=1e-9)


def test_pairs_of_a_table_and_of_nothing(spark):
    rows = [("d", m, at(k), float(k), "p", "q") for m in "ab" for k in range(3)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["pair_key"], r["x"], r["y"]) for r in live.pairs(d).collect()) == [("a__b", float(k), float(k)) for k in range(3)]
    assert live.pairs(d.where("false")).count() == 0


def test_all_events_as_a_stream_beside_sql(spark):
    import duckdb

    from duetspark.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    key = lambda r: (r[0], r[1], r[2])
    want = sorted(con.sql("SELECT dyad_id, pair_key, epoch_start, r FROM (" + SQL["live_pairs"] + ")").fetchall(), key=key)
    got = sorted((tuple(r) for r in QUERIES["live_pairs"](spark, sf).select("dyad_id", "pair_key", "epoch_start", "r").collect()), key=key)
    assert len(want) > 1000 and got == want
