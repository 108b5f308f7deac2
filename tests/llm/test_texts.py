"""Operators on single texts: languages, quality, personal data, licences, benchmark leaks."""

import pickle
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duetspark.llm import decontam, lang_id, licenses, pii, quality
from duetspark.llm.crf import BiLstmCrf

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, pii string, lang_id string, quality_score string, w string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "p", "l", "q", "w") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "  \n"), (None, "some words"), (4, "same"), (4, "same"), (5, "é" * 300_000)]


@pytest.fixture(scope="module")
def model(spark):
    return lang_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_accuracy_held_out(spark, model):
    got = lang_id.identify(spark.read.parquet(f"{SF}/documents.parquet").where(lang_id.held_out()), model).select("lang", "lang_id.*").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and {r["lang_pred"] for r in got} <= {*model, "und"}


def test_language_odd_rows(spark, model):
    df = docs(spark, [*ODD, (6, "123 456"), (7, "the and of to in is that with for")])
    out = lang_id.identify(df, model)
    assert out.columns == [*df.columns, "lang_id_"]
    got = [(r["doc_id"], r["lang_id_"]) for r in out.collect()]
    assert all(x["lang_pred"] == "und" and x["score"] == 0 and x["rejected"] for i, x in got if i in (1, 2, 3, 6))
    assert [x["lang_pred"] for i, x in got if i == 7] == ["en"]
    assert len({str(x) for i, x in got if i == 4}) == 1
    assert lang_id.keep_identified(df, model).columns == df.columns
    assert lang_id.identify(df.where("false"), model).count() == 0
    assert lang_id.fit(df) == {} and [r[0] for r in lang_id.identify(df, {}).select("lang_id_.lang_pred").distinct().collect()] == ["und"]


def test_languages_as_by_compressing_plainly(spark, model):
    import zstandard

    def size(data, dictionary, level):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(data[k : k + lang_id.PIECE])) for k in range(0, len(data), lang_id.PIECE))

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(150).collect()
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(10**7, "Die tz."), (10**7 + 1, "A"), (10**7 + 2, "ja " * 4000)]
    got = {r["doc_id"]: r for r in lang_id.identify(docs(spark, rows), model).select("doc_id", "lang_id_.*").collect()}
    for i, text in rows:
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        r = got[i]
        if not letters:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        data = (" " + " ".join(letters) + " ").encode()
        for level in (lang_id.LEVEL, lang_id.SECOND_LEVEL):
            sizes = sorted((size(data, d, level), at, lang) for at, (lang, d) in enumerate(model.items()))
            margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            if margin >= lang_id.MARGIN:
                break
        assert (r["lang_pred"], r["rejected"]) == (sizes[0][2], margin < lang_id.MARGIN) and r["margin"] == pytest.approx(margin), text
    assert got[10**7 + 1]["rejected"]


def test_numbers_that_are_no_letters(spark, model):
    odd = ["½ ² ①", "Ⅷ", "٣ 4 _", "½ the and of that is for with"]
    got = lang_id.identify(docs(spark, list(enumerate(odd))), model).orderBy("doc_id").select("lang_id_.*").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en"] and all(r["score"] == 0 for r in got[:3])


def test_passages_come_from_whole_texts(spark):
    text = " ".join(f"w{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(9000))
    got = lang_id.fit(docs(spark, [(1, text)]).withColumn("lang", F.lit("x")))["x"].decode()
    places = [text.index(w) / len(text) for w in got.split()[5::40]]
    assert len(got) <= lang_id.PASSAGES * (lang_id.PASSAGE + 2) and min(places) < 0.1 and max(places) > 0.9


def test_language_of_long_texts(spark, model):
    d = spark.read.parquet(f"{SF}/documents.parquet").where(lang_id.held_out() & (F.length("text") > 500)).orderBy("doc_id").collect()
    long = []
    for lang in model:
        joined = " ".join(r["text"] for r in d if r["lang"] == lang)
        long += [(lang, (joined * (n // len(joined) + 1))[:n]) for n in (3_000, 100_000, 1_000_000)]
    got = lang_id.identify(spark.createDataFrame(long, "lang string, text string"), model).select("lang", "lang_id.*").collect()
    assert len(got) == 3 * len(model) == 12
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] and r["margin"] > 0.05 for r in got)


def test_language_folds_are_kept_apart(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where(lang_id.held_out())
    assert lang_id.fit(d) == {}
    ids = {r["doc_id"] for r in d.select("doc_id").collect()}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    m = quality.fit(d, labels)
    held = d.where(quality.held_out()).join(labels, "doc_id").select("doc_id", "text", "quality")
    got = quality.score(held, m).collect()
    right = [(r["quality_score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in got]
    assert np.mean(right) >= 0.95
    assert np.mean([x for x, r in zip(right, got, strict=True) if r["quality"] == 0]) >= 0.85
    odd = quality.score(docs(spark, ODD), m)
    assert odd.columns[-1] == "quality_score_"
    got = {r["doc_id"]: r["quality_score_"] for r in odd.collect()}
    assert got[1] == got[2] == got[3] == m.prior and all(0 <= v <= 1 for v in got.values())
    empty = quality.fit(d, labels.where("false"))
    assert {r[0] for r in quality.score(docs(spark, ODD), empty).select("quality_score_").collect()} == {0.5}
    assert quality.score(docs(spark, ODD).where("false"), m).count() == 0


def test_quality_votes_are_exact():
    rng = np.random.default_rng(2)
    x = rng.random((40, quality.TERMS)).astype(np.float32) * (rng.random((40, quality.TERMS)) < 0.01)
    m = quality.Model(x, rng.integers(0, 2, 40))
    texts = ["alpha beta gamma", "one two three four"]
    for text, got in zip(texts, m.scores(texts), strict=True):
        v = m.project(quality.matrix([text]))[0]
        c = m.vectors @ v
        top = np.argsort(-c)[: quality.NEIGHBOURS]
        w = np.maximum(c[top], 0) ** 4
        assert got == pytest.approx((w * m.labels[top]).sum() / w.sum() if w.sum() > 1e-9 else m.prior, abs=1e-4)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    n = lambda s: len(re.sub("[^0-9]", "", s))
    good = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= n(s) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)), "phone": lambda s: 8 <= n(s) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if good[k](m.group())] for k, p in PLAIN.items()}


def test_base_spans_as_the_plain_patterns():
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "x.y@z", "a@b@c.de.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "7", " ", "-", "é", "(", "+49", "00012.3.4.5", "a+b%c@d-e.f-g", "\n", "5555555555554444"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@b.c", "a@" * 100_000, "+1 " * 100_000, "1 " * 150_000):
        pii.base_spans(text)


def test_network_gradients():
    m = BiLstmCrf(6, 3, 4)
    rng = np.random.default_rng(0)
    idx, tags = rng.integers(0, 6, (2, 5)), rng.integers(0, 3, (2, 5))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, g = m.gradients(idx, tags)
    for name in m.p:
        at = tuple(rng.integers(0, s) for s in m.p[name].shape)
        was = m.p[name][at]
        m.p[name][at] = was + 1e-3
        up, _ = m.gradients(idx, tags)
        m.p[name][at] = was - 1e-3
        down, _ = m.gradients(idx, tags)
        m.p[name][at] = was
        assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3), name


def test_network_finds_looser_forms_and_leaves_other_numbers():
    m = pii.trained()
    idx, tags = pii.encoded(*pii.labelled(99, 200))
    right = np.array([m.decode(e) for e in m.emissions(idx)]) == tags
    assert right[tags > 0].mean() > 0.9 and right[tags == 0].mean() > 0.98
    found = lambda t: pii.find(m, [t])[0][1]
    assert found("call (555) 123-4567 now") == [("phone", 5, 19)]
    assert found("on 2024-01-31 at 12:30 paid 1,234.50, version 3.") == []
    far = "word " * 5000 + "call (555) 123-4567 now"
    assert found(far) == [("phone", 25005, 25019)]


def test_windows_cover_every_character_once():
    for n in (0, 1, 31, 48, 49, 64, 255, 256, 257, 448, 449, 465, 5000):
        got = pii.windows(n)
        assert [i for _, lo, hi in got for i in range(lo, hi)] == list(range(n))
        assert all(s <= lo and hi <= s + pii.WINDOW for s, lo, hi in got)


def test_spans_as_by_decoding_every_window_alone():
    m, rng = pii.trained(), random.Random(4)
    made = pii.labelled(8, 60)[0]
    texts = ["", "x", " ".join(made), " ".join(rng.choice(made)[:40] + " plain words without any sign " * rng.randrange(9) for _ in range(80))]
    for text, tags, spans in zip(texts, pii.tags_of(m, texts), pii.added_spans(m, texts), strict=True):
        want = []
        for s, lo, hi in pii.windows(len(text)):
            piece = pii.symbols(text)[s : s + pii.WINDOW]
            padded = np.concatenate([piece, np.zeros(-len(piece) % pii.ROUND, np.uint8)])
            want += m.decode(m.emissions(padded[None])[0])[lo - s : hi - s].tolist()
        assert tags.tolist() == want
        by_hand, at = [], 0
        while at < len(want):
            end = at + 1
            if want[at] % 2:
                while end < len(want) and want[end] == want[at] + 1:
                    end += 1
                by_hand.append((pii.KINDS[(want[at] - 1) // 2], at, end))
            at = end
        assert spans == by_hand
    assert sum(len(x) for x in pii.added_spans(m, texts)) > 30


def test_network_by_onnx_runtime_as_by_numpy():
    """The same scores in less CPU time, for any weights and after pickling; tags as without the bound on gains."""
    pytest.importorskip("onnxruntime")
    rng = np.random.default_rng(7)
    for hidden, scale in ((14, 0.1), (5, 0.3)):  # not so large that rounding grows from step to step
        m = BiLstmCrf(pii.SYMBOLS, pii.TAGS, hidden)
        for _ in range(2):  # weights that change are seen
            m.p = {k: (v + scale * rng.standard_normal(v.shape)).astype(np.float32) for k, v in m.p.items()}
            for batch, width in ((1, 64), (7, 256), (3, 50)):
                idx = rng.integers(0, pii.SYMBOLS, (batch, width)).astype(np.uint8)
                want = m.plain_scores(idx)
                assert np.allclose(m.scores(idx), want, atol=1e-4) and np.allclose(pickle.loads(pickle.dumps(m)).scores(idx), want, atol=1e-4)
                assert np.allclose(want.transpose(2, 0, 1), m.emissions(idx), atol=1e-4)
            m.p["c"] = m.p["c"] + np.float32(30) * (np.arange(pii.TAGS) == 0)  # most windows are outside throughout
            assert (m.tag(idx) == m.best(m.scores(idx))).all()
    m, idx = pii.trained(), rng.integers(3, 29, (512, 64)).astype(np.uint8)

    def seconds(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f(idx)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(m.scores) < 0.8 * seconds(m.plain_scores)


def test_words_for_at_are_found_without_digits_or_at_signs():
    m = pii.trained()
    assert pii.find(m, ["write to john_doe [at] example.com please"])[0][1] == [("email", 9, 34)]
    assert pii.find(m, ["meet (at) noon at the [office] today"])[0][1] == []


def test_personal_data_rows(spark):
    df = docs(spark, [*ODD, (7, "to x@y.zz or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111.")])
    out = pii.scan(df)
    assert out.columns == [*df.columns, "pii_"]
    got = {r["doc_id"]: r["pii_"] for r in out.collect()}
    assert all(got[i]["spans"] == "" for i in (1, 2, 3, 5))
    assert got[7]["base"] == "email:3:9,ip:32:40,card:45:64,phone:13:30"
    assert [got[7][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[7] == "to [email] or [phone], [ip] and [card]." and red[1] is None and red[2] == ""
    assert pii.scan(df.where("false")).count() == 0


def test_licences(spark):
    mit = licenses.SENTENCES["mit-grant"] + "\n" + licenses.SENTENCES["mit-notice"]
    wrapped = mit.replace(" software", "\nsoftware")
    bsd = "\n".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    rows = [*ODD, (10, "Foo.\nReleased under the MIT License.\nBar"), (11, mit), (12, wrapped), (13, bsd), (14, bsd + "\n" + licenses.SENTENCES["bsd-endorse"]),
            (15, licenses.SENTENCES["mit-notice"] + " " + licenses.SENTENCES["mit-grant"]), (16, "released under the mit license. x. Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[1] == got[2] == got[3] == got[5] == ("", "")
    assert got[10] == ("mit-line", "mit") and got[11][1] == got[12][1] == "mit"
    assert got[13][1] == "bsd-2-clause" and got[14][1] == "bsd-3-clause"
    assert got[15][1] == "" and got[16] == ("mit-line,cc-by-nc-4.0-line", "mit,cc-by-nc-4.0")
    assert licenses.scan(docs(spark, ODD).where("false")).count() == 0


APACHE = """# Copyright 2024 Somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_headers_as_they_are_written(spark):
    import textwrap

    mit = textwrap.fill(licenses.SENTENCES["mit-grant"], 40) + "\n\n" + textwrap.fill(licenses.SENTENCES["mit-notice"], 72)
    cases = {
        20: (APACHE, "apache-2.0"), 21: ("A title\nReleased under the MIT License.\n" + APACHE, "apache-2.0,mit"), 22: (GPL, "gpl-3.0"), 23: (MPL, "mpl-2.0"), 24: (LGPL, "lgpl-2.1"),
        25: (mit, "mit"), 26: ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", "gpl-2.0"), 27: ("# SPDX-License-Identifier: MIT", "mit"), 28: (GPL.replace("GNU General", "GNU Affero General"), "agpl-3.0"),
        29: ("Released under the MIT License and other terms.", ""), 30: (APACHE.split("\n", 2)[2].replace("\n#", ""), "apache-2.0"),
    }
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs(spark, [(k, v[0]) for k, v in cases.items()])).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def brute_leaks(texts, items, k=5, percent=80):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in texts:
        w = words(t)
        for j, s in items:
            v = words(s)
            n, size = len(v), min(k, len(v))
            if not n:
                continue
            grams = lambda x: [tuple(x[a : a + size]) for a in range(len(x) - size + 1)]
            b = grams(v)
            for start in range(len(w) - n + 1):
                a = grams(w[start : start + n])
                shared = sum(min(a.count(g), b.count(g)) for g in set(a))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    sim = round(shared / (len(a) + len(b) - shared), 6)
                    out[i, j] = max(out.get((i, j), (0, 0)), (sim, -start))
    return out


def test_leaks_as_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 12, 40, 60])))) for i in range(15)] + [(50, None), (51, ""), (52, "Tic tac tic tac tic tac tic tac")]
    texts = []
    for i in range(60):
        body = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            v = rng.choice(items)[1] or ""
            v = v.split()
            if len(v) > 30 and i % 3 == 0:
                v[-1] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() + "," for x in v]
        texts.append((i, " ".join(body)))
    texts += [(100, None), (101, ""), (102, items[3][1]), (102, items[4][1]), (103, "tic tac " * 3000)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n int")
    got = decontam.contaminated(docs(spark, texts).repartition(4), bench).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start"]) for r in got} == brute_leaks(texts, items)
    clean = decontam.drop_contaminated(docs(spark, [*texts, (None, "x y z")]), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in texts} - {i for i, _ in brute_leaks(texts, items)} | {None}
    assert clean.columns == DOCS_COLUMNS
    assert decontam.contaminated(docs(spark, texts), bench.where("false")).count() == 0
    assert decontam.contaminated(docs(spark, []), bench).count() == 0


DOCS_COLUMNS = [f.strip().split()[0] for f in DOCS.split(",")]


def test_stride_meets_every_window():
    for shingles in (1, 3, 5, 12):
        s = decontam.stride_for(80, shingles)
        assert all(n // s > n * 0.2 / 1.8 for n in range(shingles, 300))


def test_keys_are_the_blocks_of_a_fingerprint(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    ends = [64 * i // 6 for i in range(7)]
    values = lambda fp: [(i << 32) + ((fp >> lo) & ((1 << (hi - lo)) - 1)) for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False))]
    got = spark.createDataFrame([(x,) for x in prints], "fp bigint").select("fp", decontam.blocks(F.col("fp")).alias("own"), decontam.blocks(F.col("fp"), 2).alias("near")).collect()
    for r in got:
        assert r["own"] == values(r["fp"])
        widths = [hi - lo for lo, hi in zip(ends, ends[1:], strict=False)]
        assert len(r["near"]) == len(set(r["near"])) == sum(1 + w + w * (w - 1) // 2 for w in widths)
        assert all((x ^ own).bit_count() <= 2 for own in r["own"] for x in r["near"] if x >> 32 == own >> 32)


def test_each_near_pair_comes_once(spark):
    rng = random.Random(6)
    items = [(j, 10 + j % 2, rng.getrandbits(64)) for j in range(12)]
    flipped = lambda x, bits: x ^ sum(1 << b for b in rng.sample(range(64), bits))
    windows = [(i, rng.choice((10, 11)), flipped(rng.choice(items)[2], bits)) for i, bits in enumerate([*range(25)] * 8)]
    signed = lambda x: x - (x >> 63 << 64)
    ours = spark.createDataFrame([(i, n, signed(x)) for i, n, x in windows], "start int, n int, fp bigint")
    theirs = spark.createDataFrame([(j, n, signed(x)) for j, n, x in items], "key bigint, n int, fp bigint")
    got = decontam._pairs(ours, theirs, 17).select("start", "key").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, n, x in windows for j, m, y in items if n == m and (x ^ y).bit_count() <= 17)


def test_positions_and_windows_carry_no_text(spark, monkeypatch):
    """Rows that are multiplied, by positions or by windows, hold neither a document's text nor its words."""
    frames, cut = [], decontam.cut
    monkeypatch.setattr(decontam, "cut", lambda df: frames.append(df) or cut(df))
    rng = random.Random(8)
    said = lambda n: " ".join(rng.choice(("one", "two", "three", "four", "five", "six")) + str(rng.randrange(400)) for _ in range(n))
    held = said(30)
    bench = spark.createDataFrame([(1, held), (2, said(30)), (3, said(12))], "item_id bigint, text string")
    df = docs(spark, [(1, f"{said(3000)} {held} {said(2000)} {held}"), (2, said(500)), (3, f"{held[:-4]} changed"), (4, "")])
    frames.append(decontam.contaminated(df, bench))
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"], r["windows"]) for r in frames[-1].collect()}
    assert got[1, 1][:2] == (3000, 1.0) and set(got) == {(1, 1), (3, 1)} and got[1, 1][2] % 2 == 0

    def multiplied(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Generate":
            yield [plan.output().apply(i).dataType().simpleString() for i in range(plan.output().size())]
        for x in below:
            yield from multiplied(x)

    rows = [kinds for df in frames for kinds in multiplied(df._jdf.queryExecution().optimizedPlan()) if "int" in kinds]
    assert rows and not [kinds for kinds in rows if "string" in kinds or "array<string>" in kinds]


def test_clean_documents_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(9)
    held = " ".join(f"w{rng.randrange(10_000)}" for _ in range(20))
    bench = spark.createDataFrame([(1, held)], "item_id bigint, text string")
    df = docs(spark, [(i, f"a document {i}" if i % 3 else f"before {held} after") for i in range(30)] + [(None, "no id")])
    left, small = sorted([*[i for i in range(30) if i % 3], -1]), decontam.small
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ids were too many for Spark's own choice
    try:
        for limit, shuffled in ((200_000, False), (3, True)):  # beyond the bound the join shuffles and leaves the same
            monkeypatch.setattr(decontam, "small", lambda d, rows=limit, width=None, most=limit: small(d, min(rows, most), width))
            got = decontam.drop_contaminated(df, bench)
            assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == left
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan) == shuffled and ("BroadcastHashJoin" in plan) != shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
