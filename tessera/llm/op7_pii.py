"""Personal data: base rules, and beyond them candidates that boosted trees accept.

Base spans (email, ip, card, phone) follow fixed rules and always stay. High-recall generators propose further, overlapping spans; gradient
boosted trees score each candidate by its format and context; a threshold for each kind, calibrated on held-out documents, selects.

There are no labelled spans, so training plants them. In a bounded sample of documents, seeded personal data that the base rules miss
(masked addresses, IPv6 and defanged hosts, cards in other groupings, national and 00- phone numbers), with and without words that
announce it, and seeded look-alikes (dates, versions, order numbers, sums, clock times) are put between words. Positive are the planted spans
and the base spans; negative are look-alikes, wrongly bounded candidates, and the text's own candidates unless a word before them announces
the kind: those may be personal data that the base rules miss, and are left out.

Defined results: null text counts as empty. Spans are in code points, end exclusive; ordered by start, then kind as listed, then end.
Accepted candidates never touch a base span or each other (the higher score, then the earlier start wins). An empty table gives an empty
result, and without texts to train on only base spans are found. Repeated rows each get a row; other columns are neither read nor returned
(redact() keeps them). Every search is linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, map_rows, release, table

KINDS = ("email", "ip", "card", "phone")
_ANY, _DIGIT = re.compile(r"[0-9@]").search, re.compile(r"[0-9]").search
PARTIAL = -1.0  # weight of an example until the parameters give it
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by start and kind."""
    if not text or not _ANY(text):
        return []
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", at + 1)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


#: Signs of an address, and what may stand around them.
_AT = re.compile(r" ?(?:@|[\[({]at[\])}]) ?| at (?=[\w-]{1,64} dot )", re.I)
_BEFORE_AT = re.compile(r"[\w.+%-]{1,64}\Z")
_AFTER_AT = re.compile(r"[\w-]{1,64}(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[\w-]{2,64}){1,5}", re.I)
#: High-recall generators of the other kinds; each begins at a digit, a bracket or a group of hex digits.
GENERATORS = [
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:[.:]|\[\.\]|\(\.\))[0-9]{1,4}){3,7}")),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,19}(?:(?:[ ./_-]| - |  )[0-9]{1,19}){0,9}")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,15}\)?(?:[ ./-]{1,2}\(?[0-9]{1,15}\)?){0,8}")),
]
_HEX = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![\w:])")
_HINTS = [re.compile(x, re.I) for x in (r"mail|@|contact|write|reach", r"\bip\b|host|addr|server|login|from", r"card|visa|credit|iban|account|paid", r"tel|phone|call|fax|mobil|ring")]
_MASKED = re.compile(r"[\[({](?:at|dot|\.)[\])}]| (?:at|dot) ", re.I)
_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}(?![0-9])|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:1[89]|20)[0-9]{2}(?![0-9])")


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """All proposed spans; they may overlap."""
    if not text:
        return []
    out = set()
    for m in _AT.finditer(text):
        left, right = _BEFORE_AT.search(text[max(0, m.start() - 64) : m.start()]), _AFTER_AT.match(text, m.end())
        if left and right:
            out.add(("email", m.start() - len(left[0]), right.end()))
    if _DIGIT(text):
        for kind, rule in GENERATORS:
            out.update((kind, m.start(), m.end()) for m in rule.finditer(text) if sum(map(str.isdigit, m[0])) >= (4 if kind == "ip" else 7))
        if text.count(":") > 1:
            out.update(("ip", m.start(), m.end()) for m in _HEX.finditer(text))
    return sorted(out)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    size = [len(g) for g in groups] or [0]
    tail = s.rsplit(".", 1)[-1] if "." in s else ""
    return [
        KINDS.index(kind), len(s), len(d), len(groups), s.count("."), s.count("-"), s.count(" "), s.count("(") + s.count(")"), float(s[:1] == "+"), float("@" in s),
        sum(c.isalpha() for c in s) / max(len(s), 1), float(bool(d) and luhn(d)), max((min(int(g[:6]), 99999) for g in groups), default=-1), max(size), len(tail) if tail.isalpha() else 0,
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(bool(_HINTS[KINDS.index(kind)].search(left))), float(left[-1:] in "=\"'/#"),
        min(size), size[0], size[-1], s.count(":"), float("::" in s), s.count("/"), float(s[:1] == "0") + float(s[:2] == "00"), len(_MASKED.findall(s)), float(bool(_DATE.search(s))),
        float(s[:1] == "("), float(s.count("(") == s.count(")")), float(left[-1:] in "+(.-:,"), float(right[:1] in "%.,:-/"), len(set(size)),
    ]


def planted(draw: random.Random, kind: str) -> str:
    """Invented personal data of a kind, in a form that the base rules miss."""

    def digits(n):
        return "".join(draw.choice("0123456789") for _ in range(n))

    def word(lo=3, hi=9):
        return "".join(draw.choice("abcdefghijklmnoprstuvwyz") for _ in range(draw.randint(lo, hi)))

    if kind == "email":
        at, dot = draw.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("{at}", "{dot}"), (" @ ", "."), ("[at]", "."), (" (at) ", ".")])
        who = word() + draw.choice(["", draw.choice("._-") + word(), digits(2)])
        return who + at + word() + draw.choice(["", dot + word(3, 6)]) + dot + draw.choice(["com", "org", "net", "de", "fr", "es", "io", "edu"])
    if kind == "ip":
        if draw.random() < 0.5:
            return draw.choice(["[.]", "(.)"]).join(str(draw.randint(0, 255)) for _ in range(4))
        parts = [f"{draw.randint(0, 65535):x}" for _ in range(draw.choice([8, 8, 4, 5]))]
        return ":".join(parts) if len(parts) == 8 else ":".join(parts[:2]) + "::" + ":".join(parts[2:])
    if kind == "card":
        d = draw.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return draw.choice([".", "/", " - ", "_", "  "]).join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = draw.choice("23456789") + digits(2), digits(3), digits(4)
    return draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"0{a}/{b}{c}", f"(0{a}) {b} {c}", f"00{draw.choice('1344')}{digits(1)} {a} {b} {c}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"])


def look_alike(draw: random.Random) -> str:
    """Invented text of numbers or signs that is no personal data."""
    r = draw.randint
    return draw.choice(
        [
            lambda: f"{r(1900, 2030)}-{r(1, 12):02}-{r(1, 28):02}", lambda: f"{r(1, 28)}.{r(1, 12)}.{r(1900, 2030)}", lambda: f"{r(1900, 2030)}-{r(1900, 2030)}", lambda: f"{r(1900, 2030)}-{r(1, 12):02}-{r(1, 28):02} {r(0, 23):02}:{r(0, 59):02}:{r(0, 59):02}",
            lambda: f"{r(1, 9)}.{r(0, 30)}.{r(0, 99)}.{r(256, 9999)}", lambda: f"{r(0, 23):02}:{r(0, 59):02}:{r(0, 59):02}:{r(0, 999):03}", lambda: f"{r(10**7, 10**12)}", lambda: f"{r(1, 999)},{r(0, 999):03},{r(0, 999):03}.{r(0, 99):02}",
            lambda: f"{r(1, 99)} {r(1, 99)} {r(1, 99)} {r(1, 99)} {r(1, 99)}", lambda: f"{r(10**5, 10**6)}/{r(10**3, 10**5)}", lambda: f"{r(1, 99)} @ {r(1, 99)}.{r(10, 99)}", lambda: f"978-{r(0, 9)}-{r(100, 999)}-{r(10000, 99999)}-{r(0, 9)}",
            lambda: f"{r(1, 9999)} - {r(1, 9999)} - {r(1, 9999)} - {r(1, 9999)}", lambda: f"{r(0, 9)}.{r(10**7, 10**9)}", lambda: f"{r(10, 99)}:{r(10, 99)}:{r(10, 99)}", lambda: f"{r(10**3, 10**4)} {r(10**3, 10**4)} {r(10**3, 10**4)}",
        ]
    )()


_SAID = {"email": ("mail", "write to", "contact:", "e-mail:"), "ip": ("host", "ip", "server", "login from"), "card": ("card", "visa", "paid with", "account"), "phone": ("call", "tel", "phone:", "fax")}


def with_plants(text: str | None, draw: random.Random, each: int = 2) -> tuple[str, list, list]:
    """The text with planted data and look-alikes between its words, as many of each; the spans of both."""
    words = (text or "").split(" ")
    gaps = sorted(draw.randrange(len(words) + 1) for _ in range(2 * each))
    what = [True] * each + [False] * each
    draw.shuffle(what)
    out, size, good, bad, done = [], 0, [], [], 0

    def put(s):
        nonlocal size
        out.append(s)
        size += len(s) + 1
        return size - len(s) - 1, size - 1

    for gap, real in zip(gaps, what):
        if gap > done:
            put(" ".join(words[done:gap]))
            done = gap
        if real:
            kind = draw.choice(KINDS)
            if draw.random() < 0.6:
                put(draw.choice(_SAID[kind]))
            good.append((kind, *put(planted(draw, kind))))
        else:
            bad.append(("", *put(look_alike(draw))))
        put(draw.choice(["and", "or", "the", "der", "la", "- see", "x,"]))  # so that plants don't run into each other or into numbers
    put(" ".join(words[done:]))
    return " ".join(out), good, bad


@dataclass(frozen=True)
class PiiParams:
    max_train_docs: int = 8000  # bound on the documents whose candidates train the trees, drawn by a hash of the id
    trees: int = 80
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    partial_weight: float = 0.5  # of candidates that overlap a positive with other bounds
    precision: float = 0.995  # asked of the held-out candidates of a kind at the threshold


@dataclass
class Trees:
    """Gradient boosted regression trees on the logistic loss; each tree is (feature, cut, left, right) or (value,) nodes."""

    base: float = 0.0
    trees: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self._walk(t, x)
        return 1 / (1 + np.exp(-out))

    def _walk(self, node, x):
        if len(node) == 1:
            return np.full(len(x), node[0])
        left = x[:, node[0]] <= node[1]
        out = np.empty(len(x))
        out[left] = self._walk(node[2], x[left])
        out[~left] = self._walk(node[3], x[~left])
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: PiiParams) -> Trees:
    rate = float((w * y).sum() / w.sum())
    if rate in (0.0, 1.0):
        return Trees(-20.0 if not rate else 20.0)
    model = Trees(float(np.log(rate / (1 - rate))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins))) for j in range(x.shape[1])]
    f = np.full(len(x), model.base)

    def grow(rows, g, h, depth):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for j, cs in enumerate(cuts):
                if len(cs) < 2:
                    continue
                b = np.searchsorted(cs, x[rows, j], side="left")
                gl, hl = np.cumsum(np.bincount(b, g[rows], len(cs) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(cs) + 1))[:-1]
                gain = np.where((hl > 0.5) & (H - hl > 0.5), gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, cs[k])
        if best[1] is None:
            return (float(-p.rate * G / (H + 1)),)
        left = x[rows, best[1]] <= best[2]
        return (best[1], float(best[2]), grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1))

    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(x)), w * (q - y), np.maximum(w * q * (1 - q), 1e-9), p.depth)
        model.trees.append(tree)
        f += model._walk(tree, x)
    return model


def merged(spans: list) -> list[tuple[int, int]]:
    """Disjoint intervals that cover the spans."""
    out: list = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def touches(disjoint: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span overlaps one of sorted disjoint intervals."""
    i = bisect_left(disjoint, (end, end))
    return i > 0 and disjoint[i - 1][1] > start


@dataclass
class PiiModel:
    params: PiiParams
    trees: Trees | None = None
    thresholds: dict = field(default_factory=dict)
    report: dict = field(default_factory=dict)  # kind to (held-out planted and base spans, recall, precision)

    def spans(self, text: str | None) -> tuple[list, list]:
        """(base spans, all spans)."""
        base = base_spans(text)
        if self.trees is None:
            return base, base
        taken = merged(base)
        free = [c for c in candidates(text) if not touches(taken, c[1], c[2])]
        if not free:
            return base, base
        prob = self.trees.score(np.array([features(text, *c) for c in free], dtype=float))
        more: list = []
        held: list = []
        for q, c in sorted(zip(prob, free), key=lambda z: (-z[0], z[1][1], z[1])):
            if q >= self.thresholds.get(c[0], 2.0) and not touches(held, c[1], c[2]):
                more.append(c)
                insort(held, (c[1], c[2]))
        return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _examples(seed: int):
    """Rows (group, kind, label, weight, features) of texts with plants; a text's hash is its seed and its group."""

    def rows_of(cols):
        for text in cols["text"]:
            group = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
            made, good, bad = with_plants(text, random.Random(group ^ seed))
            real = {*good, *base_spans(made)}
            near, false = merged(list(real)), merged(bad)
            for c in candidates(made):
                if c in real:
                    y, w = 1.0, 1.0
                elif touches(near, c[1], c[2]):
                    y, w = 0.0, PARTIAL
                elif touches(false, c[1], c[2]):
                    y, w = 0.0, 1.0
                elif _HINTS[KINDS.index(c[0])].search(made[max(0, c[1] - 24) : c[1]]):
                    continue  # announced, but not planted: not known
                else:
                    y, w = 0.0, 1.0
                yield group, c[0], y, w, features(made, *c)

    return lambda: rows_of


def fit(docs: DataFrame, p: PiiParams = PiiParams()) -> PiiModel:
    """docs: a column text."""
    sample = drawn(docs.select("text").where("text is not null and text <> ''"), "op7", p.max_train_docs)
    got = map_rows(sample, _examples(11), "g long, kind string, y double, w double, x array<double>").toPandas()
    release(docs.sparkSession)  # Python's part of the driver's memory is largest from here on
    if not len(got) or not got["y"].any():
        return PiiModel(p)
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort((*x.T, y, got["g"].to_numpy()))
    x, y, kind, group = x[order], y[order], got["kind"].to_numpy()[order], got["g"].to_numpy()[order]
    w = got["w"].to_numpy()[order]
    w = np.where(w == PARTIAL, p.partial_weight, w)
    held = group % 4 == 0
    if held.all() or not y[held].any():
        held[:] = False
    trees = boost(x[~held], y[~held], w[~held], p)
    model = PiiModel(p, trees)
    at = held if held.any() else np.ones(len(y), dtype=bool)
    prob = trees.score(x[at])
    for k in KINDS:
        mine = kind[at] == k
        cut = model.thresholds[k] = threshold(prob[mine], y[at][mine], p.precision)
        hit = prob[mine] >= cut
        model.report[k] = (int(y[at][mine].sum()), float(hit[y[at][mine] > 0].mean()) if y[at][mine].any() else 0.0, float(y[at][mine][hit].mean()) if hit.any() else 1.0)
    return model


def threshold(prob: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut of at least one half whose held-out precision is as asked; 2 (nothing) if there is none."""
    if not y.any():
        return 2.0
    order = np.argsort(-prob, kind="stable")
    s, hit = prob[order], np.cumsum(y[order])
    good = (hit / np.arange(1, len(s) + 1) >= precision) & (s >= 0.5)
    good[:-1] &= s[:-1] != s[1:]
    return float(s[np.flatnonzero(good)[-1]]) if good.any() else 2.0


def written(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: PiiModel) -> DataFrame:
    """docs to (doc_id, counts by kind of the base spans, base_sha256, spans)."""

    def rows_of(cols):
        for i, text in zip(cols["doc_id"], cols["text"]):
            base, every = model.spans(text)
            yield i, *[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(written(base).encode()).hexdigest(), written(every)

    return map_rows(docs.select("doc_id", "text"), lambda: rows_of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list) -> str:
    """Each span, or run of overlapping spans, becomes the first one's [KIND]."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """docs with personal data in `text` replaced; all rows and columns stay, null stays null, n_chars follows the text where it is there."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None else redact_text(t, model.spans(t)[1]))

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))
