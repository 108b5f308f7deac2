"""Personal data: base patterns, and spans that a character-level BiLSTM-CRF adds."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh, in_batches, table
from .crf import BiLstmCrf

KINDS = ("email", "ip", "card", "phone")
#: Characters in a window, those that it shares with the next, windows in a batch.
WINDOW, OVERLAP, BATCH = 256, 48, 512
#: Windows at the end of a text are padded to a multiple of this.
ROUND = 64
#: Texts that go through the network together.
TEXTS = 1024
#: Units a direction; labelled texts that the network is trained on, their length, and passes over them.
HIDDEN, EXAMPLES, LENGTH, EPOCHS = 14, 2_200, 96, 6

# Runs start where no digit stands before and give nothing back: equal to the plain patterns'
# leftmost matches, but linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @: the local part that ends there, then the domain. No text is looked at twice."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind: leftmost and non-overlapping for each kind, then the failing ones dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        digits = lambda m: _digits(m.group())
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


# ---- the network: symbols, tags, labelled texts ----

_PLAIN = "abcdefghijklmnopqrstuvwxyz@.-+()_% \n\"'=:/,;#[]"
SYMBOLS = len(_PLAIN) + 3  # 0 pads, 1 is any other letter or sign, 2 a digit
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind
_OF_ASCII = np.ones(129, np.uint8)
for _i, _c in enumerate(_PLAIN):
    _OF_ASCII[[ord(_c), ord(_c.upper())]] = _i + 3
_OF_ASCII[48:58] = 2


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of the characters."""
    return _OF_ASCII[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def labelled(seed: int, count: int) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Seeded texts with labelled spans: the base forms, looser forms, and numbers that are neither."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    num = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    word = lambda: "".join(pick("an", "er", "ti", "on", "th", "le", "que", "sch", "re", "os", "é", "ver", "la", "do") for _ in range(rng.integers(1, 5)))

    def card(n: int) -> str:
        d = pick("4", "5", "3") + num(n - 2)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    def email() -> str:
        host = pick("example.com", "example.org", f"mail{num(1)}.example.com", f"{word()}.example.net", "localhost")
        at = pick("@", "@", "@", " [at] ", "[at]", "(at)")
        return pick(word() + "." + num(2), word() + "_" + word(), word(), word() + num(3)).replace("é", "e") + at + host.replace("é", "e")

    def ip() -> str:
        return pick(".", ".", ".", "[.]").join(str(x) for x in rng.integers(0, 256, 4))

    def grouped(d: str) -> str:
        sep = pick(" ", "-", "")
        cuts = [4, 10] if len(d) == 15 else [4, 8, 12]
        return sep.join(d[a:b] for a, b in zip([0, *cuts], [*cuts, len(d)], strict=True))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {num(2)} {num(7)}", f"+{num(2)}-{num(3)}-{num(6)}", f"1-{a}-{b}-{c}")

    def other() -> str:
        hexed = "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(24, 44)))
        return pick(f'token = "{hexed}"', f'token = "{hexed}"', "Version 2.0.", "version 3.", "CC BY-NC 4.0.", num(int(rng.integers(1, 9))), num(int(rng.integers(9, 16))),
                    f"20{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}:{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(2)},{num(2)}", f"page {num(3)}", "@" + word(), f"({word()}) ", f"[{word()}] ", f"sk_{hexed}", f"AKIA{num(8)}{word().upper()}")

    makers = {"email": email, "ip": ip, "card": lambda: grouped(card(pick(15, 16, 16, 19))), "phone": phone}
    texts, spans = [], []
    for _ in range(count):
        text, own = "", []
        while len(text) < LENGTH:
            text += " ".join(word() for _ in range(rng.integers(1, 5))) + pick(" ", " ", " ", ", ", ". ", "\n", " | ", ": ")
            if rng.random() < 0.6:
                kind = pick(*KINDS, "", "", "", "")
                piece = makers[kind]() if kind else other()
                if kind:
                    own.append((kind, len(text), len(text) + len(piece)))
                text += piece + pick(" ", " ", ", ", ".\n", "\n", "%%% ", "")
                text += " " * (text[-1] not in " \n")
        cut = int(rng.integers(0, 24))  # windows begin and end anywhere
        texts.append(text[cut : cut + LENGTH])
        spans.append([(k, max(0, a - cut), min(b - cut, LENGTH)) for k, a, b in own if b > cut and a - cut < LENGTH])
    return texts, spans


def encoded(texts: list[str], spans: list[list[tuple[str, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    idx, tags = np.zeros((len(texts), LENGTH), np.int64), np.zeros((len(texts), LENGTH), np.int64)
    for i, (text, own) in enumerate(zip(texts, spans, strict=True)):
        idx[i, : len(text)] = symbols(text)
        for kind, a, b in own:
            k = 1 + 2 * KINDS.index(kind)
            tags[i, a:b] = k + 1
            tags[i, a] = k
    return idx, tags


@lru_cache(1)
def trained(seed: int = 11, examples: int = EXAMPLES, epochs: int = EPOCHS) -> BiLstmCrf:
    """The network, trained on seeded labelled texts: the same weights in every process."""
    model = BiLstmCrf(SYMBOLS, TAGS, HIDDEN)
    model.fit(*encoded(*labelled(seed, examples)), epochs)
    return model


# ---- decoding whole texts ----


def windows(size: int) -> list[tuple[int, int, int]]:
    """(start, from, to) of the windows over a text of ``size`` characters: each overlaps the next
    by OVERLAP, and its tags hold between ``from`` and ``to``, the middles of its overlaps."""
    starts = range(0, max(size - OVERLAP, 1), WINDOW - OVERLAP) if size else ()
    half = OVERLAP // 2
    return [(s, s + half if s else 0, s + WINDOW - half if s + WINDOW < size else size) for s in starts]


def _plausible(kind: str, piece: str) -> bool:
    """What an added span must hold at least."""
    d = _digits(piece)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+(?:@| ?[\[(]at[\])] ?)[^\s@]+", piece))
    if kind == "ip":
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and not re.search("[^0-9.\\[\\]]", piece)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search("[^0-9 -]", piece)
    return 10 <= len(d) <= 15 and bool(re.search("[ ()-]", piece)) and not re.search("[^0-9 ().+-]", piece)


def tags_of(model: BiLstmCrf, texts: list[str]) -> list[np.ndarray]:
    """A tag for every character of every text.

    All windows go through the network, in batches of equal length. Each is decoded by itself; where
    two overlap, either half of the overlap has the tags of the window that sees more around it,
    so a span that crosses windows is put together from both.
    """
    known = [symbols(t) for t in texts]
    out = [np.zeros(len(x), np.uint8) for x in known]
    jobs: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, x in enumerate(known):
        for s, lo, hi in windows(len(x)):
            jobs.setdefault(-(-min(WINDOW, len(x) - s) // ROUND) * ROUND, []).append((i, s, lo, hi))
    for width, own in jobs.items():
        for at in range(0, len(own), BATCH):
            part = own[at : at + BATCH]
            idx = np.zeros((len(part), width), np.uint8)
            for row, (i, s, _, _) in zip(idx, part, strict=True):
                piece = known[i][s : s + width]
                row[: len(piece)] = piece
            for row, (i, s, lo, hi) in zip(model.tag(idx), part, strict=True):
                out[i][lo:hi] = row[lo - s : hi - s]
    return out


def added_spans(model: BiLstmCrf, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The network's spans of each text: a first character of a kind and the further ones after it."""
    out = []
    for tags in tags_of(model, texts):
        first = np.flatnonzero(tags % 2)
        ends = np.flatnonzero(np.diff(tags, append=0) != 0) + 1  # of runs of equal tags
        own = []
        for a in first.tolist():
            end = a + 1
            if end < len(tags) and tags[end] == tags[a] + 1:
                end = int(ends[np.searchsorted(ends, end, "right")])
            own.append((KINDS[(tags[a] - 1) // 2], a, end))
        out.append(own)
    return out


def find(model: BiLstmCrf, texts: list[str | None]) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text its base spans by kind, and the spans the network adds beside them."""
    known = [t or "" for t in texts]
    out = []
    for text, more in zip(known, added_spans(model, known), strict=True):
        base = base_spans(text)
        taken = np.zeros(len(text) if more else 0, bool)
        for a, b in (s for spans in base.values() for s in spans if more):
            taken[a:b] = True
        kept = [(kind, a, b) for kind, a, b in more if _plausible(kind, text[a:b]) and not taken[a:b].any()]
        out.append((base, kept))
    return out


def _joined(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


_FOUND = "base string, spans string, " + ", ".join(f"n_{k} bigint" for k in KINDS)


def scan(docs: DataFrame, text_col: str = "text", model: BiLstmCrf | None = None) -> DataFrame:
    """``docs`` with a struct column ``pii``: base, spans, n_email, n_ip, n_card, n_phone.

    ``base`` and ``spans`` list ``kind:start:end`` (code points, end exclusive) by kind, then
    start; spans also has what the network adds. The counts are of base spans. Whole texts are
    scanned in time linear in their length. Null and empty texts have no spans. Rows are judged
    one by one: repeated rows give equal results, an empty table an empty one, and other columns
    pass through (the new column's name gets underscores while it is taken).
    """
    model = model or trained()

    def run(text: pd.Series) -> pd.DataFrame:
        rows = []
        for at in range(0, len(text), TEXTS):
            for base, more in find(model, text.iloc[at : at + TEXTS].tolist()):
                flat = [(k, a, b) for k, spans in base.items() for a, b in spans]
                rows.append((_joined(flat), _joined(flat + more), *[len(base[k]) for k in KINDS]))
        return pd.DataFrame(rows, columns=["base", "spans", *[f"n_{k}" for k in KINDS]])

    return in_batches(docs).withColumn(fresh(docs, "pii"), F.pandas_udf(run, _FOUND)(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text", model: BiLstmCrf | None = None) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; overlapping
    spans count as one, named by the first. Null texts stay null; all columns and rows stay."""
    model = model or trained()

    def run(text: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), TEXTS):
            part = text.iloc[at : at + TEXTS].tolist()
            for t, (base, more) in zip(part, find(model, part), strict=True):
                spans = sorted([(a, b, k) for k, own in base.items() for a, b in own] + [(a, b, k) for k, a, b in more])
                pieces, done = [], 0
                for a, b, k in spans:
                    if a >= done:
                        pieces += [t[done:a], f"[{k}]"]
                    done = max(done, b)
                out.append(t if not spans else "".join([*pieces, t[done:]]))
        return pd.Series(out, dtype=object)

    return in_batches(docs).withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))


def op4_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[f"pii.n_{k}" for k in KINDS],
        F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"), "pii.spans",
    )


def sha(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
