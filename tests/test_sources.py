"""Files of recording devices, column roles, EDF, synthetic recordings, the store, live epochs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duetspark.sources import columns, delimited, edf, store, synthetic
from duetspark.streaming import epochs


def write(path, text):
    path.write_text(text)
    return str(path)


def test_formats():
    s = delimited.sniff
    assert (f := s(["1600000000.0", "4.0", "1.5", "2"])).name == "empatica" and f.rate == 4 and f.headers == ["timestamp_s", "value"] and f.skip == 2
    assert (f := s(["# OpenSignals Text", "# {}", "nSeq\tA1", "0\t1"])).name == "opensignals" and f.skip == 2 and f.delimiter == "\t"
    assert (f := s(["AcqKnowledge export", "made today", "time,ecg", "0,1"])).name == "biopac" and f.headers == ["time", "ecg"]
    assert s(["'Elapsed time','ECG'", "0,1"]).name == "physionet"
    assert s([f"{i}\t{i}" for i in range(25)], "x.txt").name == "rmea" and s([f"{i}\t{i}" for i in range(25)]).name is None
    assert s(["time,ibi", *[f"{i},0.8" for i in range(8)]]).name == "ibi"
    assert (f := s(["% note", 'a;"b"', "1;2"])).headers == ["a", "b"] and f.delimiter == ";" and f.skip == 1
    assert s(["1,2,3,4"]).headers == ["col_1", "col_2", "col_3", "col_4"] and s([]).headers == []
    assert delimited.number("1.5abc") == 1.5 and delimited.number("x") is None


def test_reading_text(spark, tmp_path):
    rows, f = delimited.read(spark, write(tmp_path / "e.csv", "1600000000\n4\n1.0\n2.0\n\n3.0\n"))
    assert f.name == "empatica"
    t = delimited.table(rows, f).orderBy("row").collect()
    assert [(r["timestamp_s"], r["value"]) for r in t] == [(0.0, 1.0), (0.25, 2.0), (0.75, 3.0)]
    rows, f = delimited.read(spark, write(tmp_path / "g.csv", '# c\ntime,"x"\n0,1\n1,"oops"\n'))
    assert [(r["time"], r["x"]) for r in delimited.table(rows, f).orderBy("row").collect()] == [(0.0, 1.0), (1.0, None)]


def test_many_files_of_mixed_formats(spark, tmp_path):
    """Every file as if read alone, though lines of one file come from several tasks."""
    folder = tmp_path / "in"
    folder.mkdir()
    made = {
        "e.csv": "1600000000\n4\n1.0\n2.0\n\n3.0\n", "g.csv": '# c\ntime,"x"\n0,1\n1,"oops"\n2\n3,4,5\n', "o.txt": "# OpenSignals Text\n# {}\nnSeq\tA1\n0\t1\n1\t2\n",
        "s.csv": "a;b\n1;2\n", "head.csv": "time,v\n", "none.csv": "", "m.txt": "".join(f"{i}\t{i * 2}\n" for i in range(400)),
    }
    for name, text in made.items():
        write(folder / name, text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 512)
    try:
        rows, told = delimited.read_many(spark, str(folder))
        got, kinds = rows.collect(), {r["file"].rsplit("/", 1)[1]: r for r in told.collect()}
        cols = {(r["file"].rsplit("/", 1)[1], r["header"]): r["values"] for r in delimited.columns_of(rows, told).collect()}
        roles = {(r["file"].rsplit("/", 1)[1], r["header"], r["role"]) for r in columns.assign(delimited.columns_of(rows, told)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert kinds.keys() == made.keys() - {"none.csv"}
    by = {}
    for r in sorted(got, key=lambda r: r["row"]):
        by.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["row"], r["cells"]))
    for name in made.keys() - {"none.csv", "head.csv"}:
        alone, f = delimited.read(spark, str(folder / name))
        assert by[name] == [(r["row"], r["cells"]) for r in alone.orderBy("row").collect()], name
        assert (kinds[name]["name"], kinds[name]["headers"], kinds[name]["rate"]) == (f.name, f.headers, f.rate)
    assert "head.csv" not in by and len(by["m.txt"]) == 400 and kinds["m.txt"]["name"] == "rmea"
    assert sorted(r["malformed"] for r in got if r["malformed"] is not None) == ["2", "3,4,5"]
    assert cols["g.csv", "x"] == [1.0, None, None, 4.0] and cols["head.csv", "v"] == [] and len(cols["m.txt", "person1_mea"]) == 20
    assert ("g.csv", "time", "time") in roles and ("head.csv", "time", "time") in roles


def test_csv_of_modalities(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", "time,v\n0,1\n1,2\n"), write(tmp_path / "b.csv", "time,w,note\n0,3,x\n1,4,y\n")
    got = delimited.load_multimodal(spark, {"a": a, "b": b}, "d")
    assert {(r["modality"], r["feature"]) for r in got.collect()} == {("a", "v"), ("b", "w")} and got.count() == 4
    with pytest.raises(ValueError, match="no column"):
        delimited.load_csv(spark, a, "stamp")


def sheet(spark, **files):
    """COLUMNS of files given as {header: values}."""
    rows = [(f, i, h, [v if v is None else float(v) for v in x]) for f, cols in files.items() for i, (h, x) in enumerate(cols.items())]
    return spark.createDataFrame(rows, columns.COLUMNS)


def test_column_roles(spark):
    ones, up = [1.0] * 5, list(range(20))
    got = columns.assign(sheet(
        spark, named=dict.fromkeys(["timestamp", "hr_p1", "hr_p2", "eda", "zzz"], []), theta={"theta": ones}, data={"q": up, "m": ones, "n": ones},
        four={k: ones for k in "qmnv"}, three={"q": ones, "m": ones, "n": ones, "v": [None] * 5})).collect()
    roles = lambda f: [(r["pos"], r["role"]) for r in sorted(got, key=lambda r: (r["pos"], r["role"])) if r["file"] == f]
    assert roles("named") == [(0, "time"), (1, "person1"), (2, "person2"), (3, "signal"), (4, "unknown")]
    assert roles("theta") == [(0, "time")]  # any header that starts with t counts as time
    assert [x for x in roles("data") if x[1] != "unknown"] == [(0, "time"), (1, "person1"), (2, "person2")] and (0, "unknown") not in roles("data")
    assert [r for _, r in roles("four") if r != "unknown"] == ["person1", "person1", "person2", "person2"]
    assert [p for p, r in roles("three") if r == "signal"] == [0, 1, 2]
    assigned = spark.createDataFrame(got)
    assert [tuple(r) for r in columns.groups(assigned).where("file = 'named'").collect()] == [("named", "hr", 1, 2)]
    by = {r["file"]: r for r in columns.summary(assigned).collect()}
    assert by["named"]["confidence"] == pytest.approx(1.0) and by["named"]["suggestions"] == [] and len(by["three"]["suggestions"]) == 2


def test_named_persons_and_pairs(spark):
    heads = ["mother_hr", "sub02_hbo", "x", "hr_p1", "hr__P2", "sub1-eeg", "_s1"]
    got = {r["header"]: (r["person"], r["stem"]) for r in columns.named(sheet(spark, f=dict.fromkeys(heads, []))).collect()}
    assert got == {"mother_hr": (1, "hr"), "sub02_hbo": (2, "hbo"), "x": (None, "x"), "hr_p1": (1, "hr"), "hr__P2": (2, "hr"), "sub1-eeg": (1, "eeg"), "_s1": (1, "")}
    two = dict.fromkeys(["hr_p1", "eda_p1", "EDA_p2", "hr_p2", "rr_p1"], [])
    assert sorted((r["pos1"], r["pos2"]) for r in columns.pairs(sheet(spark, f=two, g={"hr_p1": []})).collect()) == [(0, 3), (1, 2)]
    assert columns.modality_of(["EEG alpha"]) == "neural" and columns.modality_of(["zz"]) == "behavioral"


def edf_bytes(signals, records, duration=1, cut=0):
    """signals: (label, samples a record, digital values)."""
    pad = lambda x, n: str(x).ljust(n).encode()
    n = len(signals)
    head = b"".join(pad(x, w) for x, (_, w) in zip(["0", "p", "r", "01.01.24", "00.00.00", 256 * (n + 1), "", records, duration, n], edf.MAIN, strict=True))
    fields = {"label": [s[0] for s in signals], "pmin": [-100] * n, "pmax": [100] * n, "dmin": [-1000] * n, "dmax": [1000] * n, "samples": [s[1] for s in signals]}
    for name, width in edf.SIGNAL:
        head += b"".join(pad(x, width) for x in fields.get(name, [""] * n))
    body = b"".join(np.array(v[k * m : (k + 1) * m], "<i2").tobytes() for k in range(records) for _, m, v in signals)
    return head + body[: len(body) - cut]


def test_edf(spark, tmp_path):
    (tmp_path / "x.edf").write_bytes(edf_bytes([("EEG", 4, list(range(12))), ("Resp", 2, [100] * 6), ("EDF Annotations", 1, [0, 0, 0])], 3))
    s = edf.read(spark, str(tmp_path / "x.edf"))
    eeg = s.where("label = 'EEG'").orderBy("idx").collect()
    assert [r["value"] for r in eeg] == pytest.approx([v / 10 for v in range(12)]) and eeg[5]["t"] == 1.25
    wide = edf.common_clock(s).groupBy("idx", "t").pivot("label").agg(F.first("value")).orderBy("idx").collect()
    assert len(wide) == 12 and {r["Resp"] for r in wide} == {10.0} and "EDF Annotations" not in wide[0].asDict()
    parts = dict((label, v) for _, label, _, v in edf.decode(edf_bytes([("A", 4, list(range(12)))], 3, cut=6)))
    assert len(parts["A"]) == 9


def test_edf_in_ranges(spark, tmp_path, monkeypatch):
    """Several tasks read one file, whatever the ranges; files may be cut, short, flat or of no signal."""
    rng = np.random.default_rng(6)
    made = [("A", 5, rng.integers(-900, 900, 200)), ("B b", 3, rng.integers(-900, 900, 120)), ("C", 1, np.arange(40))]
    files = {"whole.edf": edf_bytes(made, 40), "two words.edf": edf_bytes(made, 40, cut=7), "half.edf": edf_bytes(made, 40, cut=360), "head.edf": edf_bytes(made, 0), "short.edf": b"0", "none.edf": edf_bytes([], 3)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = {(name, k): v for name in files if name != "short.edf" for k, _, _, v in edf.decode(files[name]) if len(v)}
    for size in (1, 100, 1 << 20):
        got, tasks = {}, set()
        for r in edf.read(spark, str(tmp_path), size=size, tasks=4).withColumn("task", F.spark_partition_id()).orderBy("path", "signal", "idx").collect():
            key = r["path"].rsplit("/", 1)[1], r["signal"]
            got.setdefault(key, []).append(r["value"])
            assert r["idx"] == len(got[key]) - 1 and r["t"] == pytest.approx(r["idx"] / r["rate"])
            tasks |= {r["task"]} if key[0] == "whole.edf" else set()
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
        assert len(tasks) == (1 if size > 1000 else 4)
    assert {r["label"] for r in edf.read(spark, str(tmp_path), ["B b"], 100).select("label").distinct().collect()} == {"B b"}
    held = edf.read(spark, str(tmp_path), size=100).collect()
    monkeypatch.setattr(edf, "REACHED", "^elsewhere:")
    assert sorted(edf.read(spark, str(tmp_path)).collect()) == sorted(held) and edf.read(spark, str(tmp_path), ["C"]).select("label").distinct().count() == 1
    monkeypatch.undo()
    flat = edf_bytes(made, 40).replace(b"-1000".ljust(8), b"1000".ljust(8))
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "f.edf").write_bytes(flat)
    assert edf.read(spark, str(tmp_path / "flat")).agg(F.count("*"), F.count("value")).first()[:] == (360, 0)


def test_edf_ranges_reach_every_task(spark, tmp_path):
    """Whatever a file's name: as many ranges as tasks are read by all of them, and eight by each of four twice."""
    for k in range(12):
        (tmp_path / f"{k}.edf").write_bytes(edf_bytes([("A", 5, list(range(200)))], 40))
    for size, each in ((100, 1), (50, 2)):  # 40 records of 10 bytes: 4 ranges, then 8
        got = edf.read(spark, str(tmp_path), size=size, tasks=4).withColumn("task", F.spark_partition_id())
        by = got.groupBy("path", "task").agg(F.count("*").alias("n")).collect()
        assert len(by) == 12 * 4 and {r["n"] for r in by} == {50}, each


def test_synthetic_recordings(spark):
    f = synthetic.ground_truth("a", "b", gaps=0)
    assert len(f) == 600 and f["value"].notna().all() and (f[f["modality"] == "b"]["value"][:12] == 0).all()
    assert synthetic.ground_truth("a", "b").equals(synthetic.ground_truth("a", "b"))
    assert synthetic.dyads(spark, 3).select("dyad_id").distinct().count() == 3
    with pytest.raises(ValueError, match="morphology"):
        synthetic.ground_truth("a", "b", morphology="x")
    assert len(synthetic.ground_truth("a", "b", morphology="divergent")) == 600
    assert synthetic.multimodal().groupby("modality").size().to_dict() == {"behavior": 3000, "bio": 1200, "neural": 300}
    assert synthetic.demo_epochs(spark, 10).count() == 40
    assert synthetic.sample_streams(spark, 60).select("stream_id").distinct().count() == 9


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("1", "x", "draft"), ("2", "y", "complete")], "id string, name string, status string")
    s.append("datasets", rows)
    s.append("data_streams", spark.createDataFrame([("9", "1", "bio"), ("8", "2", "bio")], "id string, dataset_id string, modality string"))
    assert [r["id"] for r in s.read("datasets", status="complete").collect()] == ["2"]
    before = s.read("datasets", status="draft")
    s.update("datasets", F.col("id") == "1", status="complete")
    assert [r["id"] for r in before.collect()] == ["1"]  # one who read before still sees the old version whole
    with pytest.raises(Exception, match="broken"):
        s._rewrite("datasets", s.read("datasets").withColumn("name", F.raise_error(F.lit("broken")).cast("string")))
    assert s.read("datasets", order="name", status="complete").count() == 2 and s._versions("datasets") == [0, 1]
    s.delete("datasets", rows.where("id = '1'"))
    assert [r["id"] for r in s.read("datasets").collect()] == ["2"] and [r["id"] for r in s.read("data_streams").collect()] == ["8"]
    with pytest.raises(Exception, match="not allowed"):
        s.append("datasets", spark.createDataFrame([("3", "odd")], "id string, status string"))


def test_live_epochs_and_correlation(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.lit("d").alias("dyad_id"), F.col("event_type").alias("modality"), F.col("ts").cast("timestamp").alias("ts"), "value")
    batch = epochs.epochs(e, "6 hours")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = epochs.epochs(live, "6 hours").writeStream.format("memory").queryName("live_epochs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    r = lambda df: df.select("modality", "epoch_start", "n", F.round("value", 6).alias("value"))
    assert r(spark.table("live_epochs")).exceptAll(r(batch)).count() == 0

    from duetspark.operators import wcc

    rng = np.random.default_rng(0)
    rows = [("d", "p", i, float(a), float(b)) for i, (a, b) in enumerate(rng.standard_normal((30, 2)))]
    schema = "dyad_id string, pair_key string, idx bigint, x double, y double"
    p = spark.createDataFrame(rows, schema)
    for k in range(3):
        p.where(f"idx >= {10 * k} and idx < {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "pairs"))
    live = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pairs"))
    q = epochs.live_wcc(live, 8).writeStream.format("memory").queryName("live_wcc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["idx"]: r["r"] for r in spark.table("live_wcc").collect()}
    want = {r["idx"]: r["r"] for r in wcc.wcc(p, 8).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
