"""URL filters, chat pairs, mixing, the pipeline, and all corpus queries beside their SQL."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duetspark.llm import chat, mixing, url_filter
from duetspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string, tokens string")


def test_hosts_paths_and_stated_rules(spark):
    cases = {
        "HTTP://WWW.Example.COM/en/1?q=2#x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://badexample.com/en/1": ("badexample.com", "/en/1", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net/espana": ("x.net", "/espana", None, None),
        "http://x.com": ("x.com", "", None, None),
        "http://x.com?a=/b": ("x.com", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "no scheme/en/": ("", "", None, None),
        "http://": ("", "", None, None),
    }
    got = url_filter.judge(pages(spark, [*cases, None])).orderBy("page_id").collect()
    for r, (host, path, rule, verdict) in zip(got, [*cases.values(), ("", "", None, None)], strict=True):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_rules_are_mined_as_by_counting(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        kind = rng.integers(4)
        t = [f"h:{'spam' if kind == 0 else 'site'}{rng.integers(3)}", f"p0:{('en', 'de')[rng.integers(2)]}", f"q:{('a', 'b')[rng.integers(2)]}"]
        bad = kind == 0 or (t[1] == "p0:de" and t[2] == "q:b")
        rows.append((sorted(t), "block" if bad else "allow"))
    got = {(tuple(r["items"]), r["verdict"]): r["confidence"] for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.9).collect()}
    both, alone = Counter(), Counter()
    import itertools

    for t, label in rows:
        for k in (1, 2, 3):
            for part in itertools.combinations(t, k):
                alone[part] += 1
                both[part, label] += 1
    want = {(p, v): n / alone[p] for (p, v), n in both.items() if n >= 0.02 * len(rows) and n / alone[p] >= 0.9}
    want = {(p, v): c for (p, v), c in want.items() if not any((q, v) in want and want[q, v] >= c for q in itertools.combinations(p, len(p) - 1))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert (("h:spam0",), "block") in got


def test_rules_of_four_tokens_and_tokens_that_go_together(spark):
    import itertools

    rows = []
    for bits in itertools.product((0, 1), repeat=4):  # blocked if all four are there, never for three
        t = [f"q:{c}" for c, b in zip("abcd", bits, strict=True) if b]
        rows += [(sorted(["h:x", *t]), "block" if all(bits) else "allow")] * 10
    rows += [(sorted(f"p{i}:same" for i in range(40)), "block")] * 20
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.9).collect()
    got = {(tuple(r["items"]), r["verdict"]) for r in mined}
    assert (("q:a", "q:b", "q:c", "q:d"), "block") in got
    assert (tuple(sorted(f"p{i}:same" for i in range(40))), "block") in got


def judged_by_hand(urls, rules, mined):
    """(host, path, rule, verdict) of each URL by loops; mined rules as (items, verdict, confidence)."""
    out = []
    for url in urls:
        head, sep, rest = (url or "").partition("://")
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), -k, h + p, v) for k, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            out.append((host, path, max(fit)[2], max(fit)[3]))
            continue
        zero = lambda x: __import__("re").sub("[0-9]+", "0", x)
        labels = host.split(".")
        tokens = {"h:" + zero(x) for x in labels if x} | {"t:" + labels[-1]} | {f"p{min(i, 3)}:{zero(x)}" for i, x in enumerate(x for x in path.split("/") if x)}
        query = url.split("?", 1)[1].split("#")[0] if url and "?" in url else ""
        tokens |= {"q:" + zero(q.split("=")[0]) for q in query.split("&") if q.split("=")[0]}
        hit = [(-c, -len(i), v != "block", " ".join(i), v) for i, v, c in mined if set(i) <= tokens] if host or path else []
        out.append((host, path, None, min(hit)[4] if hit else "allow"))
    return out


def test_pages_as_by_hand(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    p = p.select("page_id", "url").union(spark.createDataFrame([(-1, None), (-2, "x"), (-3, "http://b.a.com/xy/1"), (-4, "http://a.com/xy")], "page_id bigint, url string"))
    rules = [*url_filter.RULES, ("allow", "a.com", "/xy"), ("block", "b.a.com", "/")]
    labelled = spark.createDataFrame([(["h:casino-win"], "block"), (["p0:en"], "allow"), (["h:example", "q:page"], "block"), (["h:example", "p0:fr"], "allow")], "items array<string>, verdict string")
    mined = labelled.withColumns({"confidence": 0.9 + F.length("verdict") / 1000, "rule_id": F.xxhash64("items")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(p, rules, mined).collect()}
    rows = p.collect()
    want = judged_by_hand([r["url"] for r in rows], rules, [(r["items"], r["verdict"], r["confidence"]) for r in mined.collect()])
    assert got == {r["page_id"]: w for r, w in zip(rows, want, strict=True)}
    assert got[-3][2] == "a.com/xy" and len(got) > 50


def test_mined_rules_apply_and_odd_pages(spark):
    urls = [f"http://s{i % 3}.spam.org/en/{i}" for i in range(60)] + [f"http://fine{i % 5}.org/en/{i}" for i in range(60)]
    rules = [("block", "s0.spam.org", "/"), ("block", "s1.spam.org", "/"), ("allow", "fine0.org", "/"), ("allow", "fine1.org", "/")]
    got = url_filter.judge(pages(spark, [*urls, "http://s2.spam.org/en/9", None, ""]), rules, support=0.05).collect()
    v = {r["page_id"]: r["verdict"] for r in got}
    assert len(got) == 123 and all(v[i] == "block" for i in range(60)) and v[120] == "block" and v[121] == v[122] == "allow"
    assert url_filter.judge(pages(spark, [])).count() == 0
    assert [r["verdict"] for r in url_filter.judge(pages(spark, [None])).collect()] == ["allow"]


def test_preference_pairs(spark):
    rows = [
        (1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "good"), (1, 2, "assistant", "good"),
        (2, 0, "system", "S"), (2, 1, "user", "U"), (2, 2, "assistant", "bad"), (2, 3, "user", "more"), (2, 4, "assistant", "é!"),
        (3, 0, "system", "S"), (3, 1, "user", "U"), (4, 0, None, None), (None, 0, "user", "lost"), (5, None, "user", "first"), (5, 0, "assistant", "second"),
    ]
    c = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, prompt string, p string")
    p = spark.createDataFrame([(1, 2), (1, 3), (3, 1), (2, 2), (4, 5), (1, 99), (None, 1)], "chosen_id bigint, rejected_id bigint")
    got = {(r["chosen_id"], r["rejected_id"]): r for r in chat.preference_pairs(c, p).collect()}
    assert set(got) == {(1, 2), (1, 3), (3, 1), (2, 2), (4, 5)}
    r = got[1, 2]
    assert r["prompt"] == "<|system|>\nS\n<|user|>\nU\n" and r["n_prefix"] == 2
    assert r["chosen"] == "<|assistant|>\ngood\n" and r["rejected"] == "<|assistant|>\nbad\n<|user|>\nmore\n<|assistant|>\né!\n"
    cut = lambda text, mask: [text[int(a) : int(b)] for a, b in (m.split(":") for m in mask.split(",") if m)]
    assert cut(r["chosen"], r["chosen_mask"]) == ["good\n"] and cut(r["rejected"], r["rejected_mask"]) == ["bad\n", "é!\n"]
    assert got[1, 3]["rejected"] == "" and got[1, 3]["rejected_mask"] == "" and got[3, 1]["chosen"] == ""
    assert got[2, 2]["n_prefix"] == 5 and got[2, 2]["chosen"] == got[2, 2]["rejected"] == ""
    assert got[4, 5]["prompt"] == "" and got[4, 5]["chosen"] == "<||>\n\n" and got[4, 5]["rejected"].startswith("<|user|>\nfirst")
    assert chat.preference_pairs(c.where("false"), p).count() == 0


def plain(turns):
    return "".join(f"<|{r}|>\n{t}\n" for r, t in turns)


def test_continuations_of_equal_beginnings_and_of_others(spark):
    talks = {
        1: [("user", "hi"), ("assistant", "a")], 2: [("user", "hi"), ("assistant", "b"), ("user", "thanks")], 3: [("user", "hi"), ("assistant", "a")],
        4: [("user", "else"), ("assistant", "c"), ("user", "and"), ("assistant", "d")], 5: [("user", "no answer")], 6: [("assistant", "starts")],
        2000: [("user", "far"), ("assistant", "away")],
    }
    rows = [(k, i, r, t, "x", "y", "z") for k, v in talks.items() for i, (r, t) in enumerate(v)]
    c = spark.createDataFrame([*rows, *rows[:3], (None, 0, "user", "lost", "x", "y", "z")], "conv_id bigint, turn bigint, role string, text string, begin string, r string, k string")
    got = {r["chosen_id"]: r for r in chat.continuations(c).collect()}
    donors = {1: 2, 2: 3, 3: 1, 4: 5, 5: 6, 6: 1, 2000: None}  # 1 to 3 begin alike; the others take the next one's answer
    assert {k: r["rejected_id"] for k, r in got.items()} == donors

    def cut(talk):
        last = [i for i, (r, _) in enumerate(talk) if r == "assistant"]
        return last[-1] if last else len(talk)

    for k, donor in donors.items():
        own = talks[k]
        other = own[: cut(own)] + (talks[donor][cut(talks[donor]) :] if donor else [])
        n = next((i for i, (x, y) in enumerate(zip(own, other, strict=False)) if x != y), min(len(own), len(other)))
        r = got[k]
        assert (r["n_prefix"], r["prompt"], r["chosen"], r["rejected"]) == (n, plain(own[:n]), plain(own[n:]), plain(other[n:]))
    assert got[3]["n_prefix"] == 2 and got[3]["chosen"] == "" and got[1]["n_prefix"] == 1
    assert got[2]["rejected_mask"] == "14:16" and got[5]["rejected"] == plain(talks[6])
    assert chat.continuations(c.where("false")).count() == 0


def test_many_equal_beginnings_lose_no_conversation(spark):
    rows = [(i, t, r, x) for i in range(5000) for t, r, x in ((0, "user", "the same"), (1, "assistant", str(i)))]
    got = chat.continuations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert got.count() == 5000 and got.where("n_prefix = 1 and rejected_id <> chosen_id and chosen <> rejected").count() == 5000


def test_mixing_draws_are_poisson(spark):
    rows = [(i, "t", "big" if i % 3 else "small", "l", 1, "c") for i in range(9000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n bigint, copy string")
    out = mixing.mix(d, {"big": 1.0, "small": 2.0}, 12_000)
    assert out.columns == [*d.columns, "copy_"]
    got = out.groupBy("source").count().collect()
    by = {r["source"]: r["count"] for r in got}
    assert by["big"] == pytest.approx(4000, rel=0.06) and by["small"] == pytest.approx(8000, rel=0.06)
    times = Counter(r["doc_id"] for r in out.where("source = 'small'").select("doc_id").collect())
    counts = np.array([times.get(i, 0) for i in range(0, 9000, 3)])
    mean = 8000 / 3000
    for k in range(6):
        assert (counts == k).mean() == pytest.approx(math.exp(-mean) * mean**k / math.factorial(k), abs=0.03)
    again = mixing.mix(d.repartition(7), {"big": 1.0, "small": 2.0}, 12_000)
    assert out.exceptAll(again).count() == 0 and again.exceptAll(out).count() == 0


def test_mixing_large_means_and_odd_rows(spark):
    d = spark.createDataFrame([(i, None, None) for i in range(20)] + [(100, "", "a"), (None, "x", "a"), (7, "y", "zero")], "doc_id bigint, text string, source string")
    out = mixing.mix(d, {"a": 1.0}, 700).groupBy("source").count().collect()
    assert [r["source"] for r in out] == ["a"] and out[0]["count"] == pytest.approx(700, rel=0.15)
    assert mixing.mix(d).where("source is null").count() > 0
    assert mixing.mix(d.where("false")).count() == 0


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, None), (None, "the and of to in is that with for was on by", "en", "s", 1)], d.schema)
    docs = d.unionByName(extra).withColumn("lang_id", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert stage_columns(corpus_pipeline.STAGES[-1][1](spark, docs, SF)) >= set(docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.where("false"), SF).count() == 0


def stage_columns(df):
    return set(df.columns)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0.5 * n < out.count() < 1.5 * n
    assert out.where("text rlike '[A-Za-z0-9]@mail[0-9]'").count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_as_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    a = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    b = con.sql(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(x.notna(), None).itertuples(index=False, name=None)))
    assert rows(a) == rows(b)
