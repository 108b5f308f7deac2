"""Near-duplicates of texts and vectors against brute force, and components."""

import random

import numpy as np
import pytest

from duetspark.llm import embed_dup, near_dup
from duetspark.llm.base import components, cut

DOCS = "doc_id bigint, text string, n bigint, kept string, component_id string"


def brute(texts: dict, k: int, percent: int) -> dict:
    """The smallest id of each text's component, by comparing all pairs."""

    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    sets, label = {i: of(t) for i, t in texts.items()}, {i: i for i in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in texts}


def edited(rng: random.Random, words: list[str], changes: int) -> str:
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_texts_as_by_brute_force(spark, k, percent):
    rng, texts = random.Random(k), {}
    for g in range(6):
        base = [f"w{rng.randrange(900)}" for _ in range(140)]
        for _ in range(40):  # edits from none to far over the threshold: hot buckets with parts that don't link
            texts[len(texts)] = edited(rng, base, rng.randrange(8))
    texts |= {1000: None, 1001: "", 1002: " \t\n", 1003: "one", 1004: "ONE", 1005: "one two", 1006: "long " * 30_000}
    rows = [(i, t, 1, "a", "b") for i, t in texts.items()]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_texts_odd_rows(spark):
    rows = [(None, "a b c d", 1, None, None), (5, "a b c d", 1, "", ""), (5, "a b c d", 1, "", ""), (3, "a b c d", 1, "", ""), (9, "other words here now", 1, "", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(near_dup.near_duplicates(df, 3, 85).collect(), key=str)
    assert sorted([(r["doc_id"], r["component_id"], r["kept"]) for r in got], key=str) == sorted([(None, None, True), (5, 3, False), (5, 3, False), (3, 3, True), (9, 9, True)], key=str)
    kept = near_dup.keep_one(df, 3, 85)
    assert kept.columns == df.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["3", "9", "None"]
    empty = near_dup.near_duplicates(df.where("false"), 3, 85)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_an_id_with_two_texts_links_by_both(spark):
    rng = random.Random(9)
    a, b, c = ([f"{x}{rng.randrange(900)}" for _ in range(120)] for x in "abc")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, None), (2, edited(rng, a, 2)), (3, edited(rng, b, 2)), (4, " ".join(c)), (5, edited(rng, c, 2))]
    rows += [(10 + i, edited(rng, b, 1)) for i in range(90)]  # many in one bucket: compared in blocks
    df = spark.createDataFrame([(i, t, 1, "", "") for i, t in rows], DOCS).repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df, 3, 85).collect()}
    assert got == {(i, 4 if i in (4, 5) else 1) for i, _ in rows}


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = np.concatenate([a[:340], rng.integers(0, 2**64, 60, dtype=np.uint64)])
    x, y = (near_dup.signature(np.unique(v), 2048) for v in (a, b))
    assert abs((x == y).mean() - 340 / 460) < 0.05
    bands, rows = near_dup.bands_for(85)
    assert (1 - 0.85**rows) ** bands <= near_dup.MISS


def test_block_comparison_spans_links():
    import pyarrow as pa

    sets = [list(range(100)), list(range(5, 105)), list(range(500, 600)), [1, 2]]
    t = pa.table({"rep": [4, 7, 8, 9], "items": pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))})
    src, dst = near_dup._linked(t, t, 80)
    assert {(int(a), int(b)) for a, b in zip(src, dst, strict=True)} == {(7, 4)}


def test_components(spark):
    n = 200
    edges = [(i, i + 1) for i in range(0, n)] + [(1000, 1001), (1002, 1001), (5000, 5000), (None, 3)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 1002: 1000, 5000: 5000}
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def vectors(count: int = 400, dims: int = 64) -> list[tuple]:
    rng, rows = np.random.default_rng(4), []
    for g in range(count // 8):
        base = rng.standard_normal(dims)
        for k in range(8):
            noise = 0 if k < 2 else rng.uniform(0, 0.9)
            rows.append((len(rows), [float(x) for x in (base + noise * rng.standard_normal(dims)).astype(np.float32)], 1, "x"))
    return rows


VECS = "vec_id bigint, embedding array<float>, n_links bigint, code string"


def test_vectors_recall_and_precision(spark):
    rows = vectors()
    got = {r["vec_id"]: r for r in embed_dup.near_duplicates(spark.createDataFrame(rows, VECS)).collect()}
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= link.sum(axis=1)).all()
    assert found.sum() >= 0.9 * link.sum()
    assert all(got[i]["component_id"] <= i for i in got)
    for i in range(len(rows)):  # nothing beyond what all links reach: groups are apart
        assert got[i]["component_id"] // 8 == i // 8


def test_vectors_in_several_blocks(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    rows = [(i, [float(v) for v in base + 0.01 * rng.standard_normal(16)], 1, "") for i in range(1300)]
    got = embed_dup.near_duplicates(spark.createDataFrame(rows, VECS)).collect()
    assert {r["n_links"] for r in got} == {1299} and {r["component_id"] for r in got} == {0}


def test_vectors_odd_rows(spark):
    v, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(1, v), (2, v), (3, [2.0, 4.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (10, [1.0, 2.0, 3.0]), (None, v), (2, v), (11, [0.0, 5.0, 0.0, 1.0]), (12, [0.0, 5.1, 0.0, 1.0])]
    df = spark.createDataFrame([(a, b, 0, "") for a, b in rows], VECS)
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dup.near_duplicates(df).collect()], key=str)
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)] + [(None, 0, None, True)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), (11, 1, 11, True), (12, 1, 11, False), *alone], key=str)
    assert embed_dup.near_duplicates(df.where("false")).count() == 0


def test_vectors_in_double_precision_and_of_all_lengths(spark):
    rows = [(1, [1e39, 1e39]), (2, [1e39, 1.01e39]), (3, [1.0, 1.0]), (4, [1e-300, 1e-300]), (5, [1.0, 1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [1.0, -1.0]), (8, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dup.near_duplicates(df).collect()}
    assert got == {**{i: (4, 1) for i in (1, 2, 3, 4, 8)}, 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_vectors_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)}


@pytest.mark.parametrize("dims", [64, 24])
def test_recall_just_over_the_threshold(spark, dims):
    rng, rows = np.random.default_rng(dims), []
    spread = np.linspace(0.3, 2, dims)  # axes that matter unequally
    for _ in range(1500):  # pairs between 0.9 and 0.92, among vectors that link with nothing else
        a = rng.standard_normal(dims) * spread
        a /= np.linalg.norm(a)
        b = rng.standard_normal(dims) * spread
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9, 0.92)
        rows += [(len(rows), [float(x) for x in a]), (len(rows) + 1, [float(x) for x in c * a + np.sqrt(1 - c * c) * b])]
    got = {r["vec_id"]: r["n_links"] for r in embed_dup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    x = np.array([r[1] for r in rows])
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    found = np.array([got[i] for i in range(len(rows))])
    print("recall", dims, found.sum() / link.sum())
    assert (found <= link.sum(1)).all() and found.sum() >= 0.9 * link.sum()


def test_cut_keeps_rows(spark):
    assert cut(spark.range(10)).count() == 10
