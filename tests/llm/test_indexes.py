"""Search, line dedup and manifest against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from duetspark.llm import lexical, line_dedup, merkle
from duetspark.llm.line_dedup import Cuckoo

DOCS = "doc_id bigint, text string, score string, keeper int, lang string"


def docs(spark, rows, parts=4):
    """(doc_id, text) rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 1, "x") for i, t in rows], DOCS).repartition(parts)


# ---- search ----


def ranked_by_hand(texts, items, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(low))
    counts = [(i, Counter(of(t))) for i, t in texts]
    sizes = [c.total() for _, c in counts if c]
    n, total, out = len(sizes), sum(sizes), set()
    df = Counter(t for _, c in counts for t in c)
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 25 + 75 * c.total() * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in Counter(of(text)).items() if c[t])
            if s > 0:
                scored.append((-s, doc))
        out |= {(item, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(scored)[:top])}
    return out


def test_search_as_by_hand(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3_000)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 80)))) for i in range(300)]
    texts += [(i, texts[7][1]) for i in range(400, 425)]  # more copies than are returned: ties by id
    texts += [(500, None), (501, ""), (502, "., -\n"), (503, "Äpfel W1; w1_W2 é" + " long" * 40_000), (504, "w1 " * 9), (505, "w1 " * 9)]
    items = [(k, texts[k * 9][1] + " " + texts[k][1]) for k in range(12)] + [(20, None), (21, ""), (22, "never"), (23, "äpfel Äpfel LONG w1 w1"), (24, "never")]
    monkeypatch.setattr(lexical, "ITEM_BYTES", 2_000)  # several blocks
    monkeypatch.setattr(lexical, "CELLS", 64)
    got = lexical.search(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {tuple(r) for r in got.collect()} == ranked_by_hand(texts, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_odd_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical.search(docs(spark, []), items).count() == 0
    assert lexical.search(docs(spark, [(1, None), (2, "")]), items).count() == 0
    assert lexical.search(docs(spark, [(1, "a")]), items.limit(0)).count() == 0
    got = [tuple(r)[:3] for r in lexical.search(docs(spark, [(5, "a c"), (5, "a c"), (None, "b c d"), (2**60 + 1, "z"), (2**60 + 3, "y y")]), items).collect()]
    assert sorted(got, key=str) == [(1, 1, None), (1, 2, 5), (1, 3, 5)]
    big = lexical.search(docs(spark, [(None, "q"), (2**60 + 1, "a")], 1), items).collect()
    assert [r["doc_id"] for r in big] == [2**60 + 1]


def test_bounds_hold_and_select(spark):
    """Bytes bound every impact from both sides, closely."""
    rng = np.random.default_rng(2)
    w, tf, m = rng.integers(0, 20_000, 5_000), rng.integers(1, 900, 5_000), rng.integers(25, 90_000, 5_000)
    e, step = lexical._impacts(w, tf, m), lexical._steps(w)
    up = -(-e // step)
    assert up.max() <= 255 and (up * step >= e).all() and (((up - 1) * step + 1 <= e) | (up == 0)).all()
    assert ((e > 0) == (up > 0)).all()


# ---- line dedup ----


def keys_of(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [x.strip(" \t\n\v\f\r").translate(low) for x in (text or "").split("\n")]


def cleaned_by_hand(known, rows, least=3):
    """What is left of rows [(id, text)] by what the documents [(id, text)] repeat."""
    holders = {}
    for i, t in known:
        for k in keys_of(t):
            if i is not None and len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        gone = [k in holders and len(holders[k]) >= least and i != max(holders[k]) for k in keys_of(t)]
        kept = [x for x, g in zip((t or "").split("\n"), gone, strict=True) if not g]
        out.append((i, "\n".join(kept), len(gone), sum(gone)))
    return sorted(out, key=str)


def cleaned(index, df):
    return sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in index.clean(df).collect()], key=str)


def some_docs(rng, ids):
    common = [f"  A line that many Documents share, number {k}\t" for k in range(12)]
    return [(i, "\n".join(rng.choice([rng.choice(common), "short", "", f"own line of document {i} {rng.random()}", common[0].upper()]) for _ in range(rng.randrange(1, 14)))) for i in ids]


@pytest.mark.parametrize("hot", [10_000, 12])
def test_lines_as_by_hand(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rng = random.Random(8)
    rows = some_docs(rng, range(60))
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "a repeated line of one document\n" * 9), (None, rows[0][1]), (None, None)]
    rows += [rows[3], rows[3], (4, "another text of number four\n" + rows[9][1])]  # repeated rows, one id with two texts
    rows += [(90 + k, f"the very same line here\n{k}") for k in range(3)] + [(95, "x\n" * 50_000 + "the very same line here")]
    df = docs(spark, rows)
    index = line_dedup.build(df, shard_keys=40)
    assert index.shards > 1
    assert cleaned(index, df) == cleaned_by_hand(rows, rows)
    out = index.clean(df)
    assert set(out.columns) == {*df.columns, "n_lines", "n_dropped"} and out.where("score = 's' and keeper = 1").count() == len(rows)


def test_documents_go_in_and_out(spark):
    rng = random.Random(9)
    first, second = some_docs(rng, range(25)), some_docs(rng, range(25, 45))
    a = line_dedup.build(docs(spark, first), shard_keys=40)
    both = a.insert(docs(spark, second))
    assert cleaned(both, docs(spark, second)) == cleaned_by_hand(first + second, second)
    assert both.insert(docs(spark, second)).counts.exceptAll(both.counts).count() == 0  # known documents count once
    back = both.delete(docs(spark, second))
    table = lambda x, t: sorted(map(tuple, getattr(x, t).collect()))
    assert table(back, "counts") == table(a, "counts") and table(back, "holders") == table(a, "holders")
    prints = lambda x: {r["shard"]: p for r in x.filters.collect() if (p := Counter(v for v in np.frombuffer(r["slots"], np.uint16).tolist() if v))}
    assert prints(back) == prints(a) and prints(both) != prints(a)
    gone = {40, 44, 24, 3}
    less = both.delete(spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    left = [r for r in first + second if r[0] not in gone]
    assert cleaned(less, docs(spark, left)) == cleaned_by_hand(left, left)
    few = both.delete(docs(spark, [(i, None) for i in range(43)]))  # two documents are left: nothing is repeated
    assert cleaned(few, docs(spark, second)) == cleaned_by_hand([r for r in second if r[0] >= 43], second)


def test_empty_index_grows(spark):
    rows = some_docs(random.Random(3), range(40))
    empty = line_dedup.build(docs(spark, []))
    assert cleaned(empty, docs(spark, rows)) == cleaned_by_hand([], rows)
    assert empty.clean(docs(spark, [])).count() == 0
    grown = empty.insert(docs(spark, rows[:20])).insert(docs(spark, rows[20:]))
    assert cleaned(grown, docs(spark, rows)) == cleaned_by_hand(rows, rows)


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63 - 1, (60_000, 2))
    k1, k2 = keys[:20_000].T
    f = line_dedup._made(k1, k2)
    assert f.has(k1, k2).all() and f.slots.astype(bool).sum() == 20_000
    assert f.has(*keys[20_000:].T).mean() < 0.001
    f.remove(k1[:5_000], k2[:5_000])
    assert f.has(k1[5_000:], k2[5_000:]).all() and f.has(k1[:5_000], k2[:5_000]).mean() < 0.001
    assert f.slots.astype(bool).sum() == 15_000
    assert Cuckoo.read(f.bytes()).has(k1[5_000:], k2[5_000:]).all()
    assert not Cuckoo.sized(100).add(k1, k2)  # full


# ---- manifest ----


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(leaves):
    """The root of a list of digests, and each one's siblings, level by level as (left, right)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k in range(len(leaves)):
            run, j = runs[at[k] // 8], at[k] % 8
            paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[k] //= 8
        level = [h(*run) for run in runs]
    return level[0], paths


def manifest_by_hand(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], h(*map(said, r))))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    subs, out = [], []
    for g in names:
        own = sorted(by[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, paths = tree_by_hand([d for _, d in own])
        subs.append(root)
        out.append([(i, d, root, p) for (i, d), p in zip(own, paths, strict=True)])
    root, up = tree_by_hand(subs)
    return sorted([(i, d, sub, root, p + up[k]) for k, rows in enumerate(out) for i, d, sub, p in rows], key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 9, "": 1}, {"a": 700, "b": 65, "é": 64, None: 3}, {f"g{k}": k % 3 + 1 for k in range(30)}])
def test_manifest_as_by_hand(spark, sizes):
    rng, rows = random.Random(1), []
    for g, n in sizes.items():
        rows += [(rng.randrange(10**6), g, rng.choice([None, "", "é|:-", "text " * 3])) for _ in range(n)]
    rows += [rows[0], (rows[0][0], rows[0][1], "other"), (None, rows[0][1], "no id"), (None, rows[0][1], None)] if len(rows) > 1 else []
    df = spark.createDataFrame([(*r, "idx", 1) for r in rows], "doc_id bigint, lang string, text string, g string, n int").repartition(6)
    m = merkle.build(df, fields=("doc_id", "lang", "text"))
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(p["l"], p["r"]) for p in r["path"]]) for r in merkle.proofs(m).collect()]
    want = manifest_by_hand(rows)
    assert sorted(got, key=str) == want
    assert merkle.root(m) == want[0][3]
    for _, leaf, _, root, path in want:
        for left, right in path:
            leaf = h(left, leaf, right)
        assert leaf == root


def test_manifest_finds_changes_and_takes_empty_tables(spark):
    from pyspark.sql import functions as F

    fields = ("doc_id", "lang", "text")
    df = spark.createDataFrame([(i, "ab"[i % 2], f"text {i}") for i in range(200)], "doc_id bigint, lang string, text string")
    now = F.when(F.col("doc_id") % 7 == 0, merkle.digest([F.col("doc_id"), F.col("lang"), F.lit("changed")]))
    p = merkle.proofs(merkle.build(df, fields=fields, changed=now))
    ok = p.select("doc_id", (merkle.fold(F.coalesce("changed", "leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert len(ok) == 200 and all(r["ok"] == (r["doc_id"] % 7 != 0) for r in ok)
    none = merkle.build(df.limit(0), fields=fields)
    assert merkle.proofs(none).count() == 0 and merkle.root(none) is None
