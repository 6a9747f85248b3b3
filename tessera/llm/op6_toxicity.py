"""Toxicity: a classifier chain over the categories of the labels table.

The categories are predicted one after the other by linear models; each model also sees the probabilities of the categories before it. In
training those are out-of-fold predictions, their features chosen without the fold too, so that a later model does not trust an earlier
one more than it deserves.
Features: whole words and word beginnings (4 to 6 letters) that tell the categories apart, present or not. They are found in the
labelled sample by support and difference of rates, so the model learns insults of any language, inflected or not.

Defined results: null, empty or wordless text has the probabilities of a text without features. Without labels of both kinds a category's
probability is its rate (0 without labels) and nothing is rejected. Labels with a null id or category are not used; of several
labels of an id the highest counts, of several texts of an id one is learned from. Empty tables give empty results. Repeated rows each get a row; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, map_rows, materialise, release, table

_WORDS = re.compile(r"[^\W\d_]+").findall
CACHE = 200_000


@dataclass(frozen=True)
class ToxicityParams:
    categories: tuple = ("low_quality", "toxic")  # in the chain's order; the last one rejects
    max_positive: int = 2000  # bounds on the labelled sample by the last category
    max_negative: int = 4000
    features: int = 1024
    floor: float = 4.0  # standard errors by which a feature's rates must differ; below, a small sample's chance words decide
    folds: int = 3
    steps: int = 120
    l2: float = 1e-3


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    return (zlib.crc32(word.encode()), *[zlib.crc32(("^" + word[:k]).encode()) for k in (4, 5, 6) if len(word) >= k])


def text_features(text: str | None) -> set[int]:
    out: set[int] = set()
    for word in set(_WORDS((text or "").lower())):
        out.update(word_features(word))
    return out


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by accelerated gradient steps."""
    rate = float((weight * y).sum() / weight.sum())
    if rate in (0.0, 1.0):
        return np.zeros(x.shape[1]), 0.0 if rate else -40.0
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(rate / (1 - rate))
    ahead, t = w.copy(), 1.0
    share = (weight / weight.sum()).astype(np.float32)
    step = 1.0 / (0.25 * float((share * ((x**2).sum(axis=1) + 1)).sum()) + p.l2)
    for _ in range(p.steps):
        g = share * (_sigmoid(x @ ahead[:-1].astype(np.float32) + ahead[-1]) - y).astype(np.float32)
        grad = np.append(g @ x + p.l2 * 1e-2 * ahead[:-1], g.sum())
        new = ahead - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    params: ToxicityParams
    column: dict = field(default_factory=dict)  # feature hash to column
    links: list = field(default_factory=list)  # (weights of features, weights of earlier probabilities, bias) by category
    threshold: float = 2.0
    _words: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_words": {}}

    def columns_of(self, text: str | None) -> list[int]:
        found: set[int] = set()
        words = self._words
        for word in set(_WORDS((text or "").lower())):
            at = words.get(word)
            if at is None:
                at = tuple(c for h in word_features(word) if (c := self.column.get(h)) is not None)
                if len(words) >= CACHE:
                    words.clear()
                if len(word) <= 40:
                    words[word] = at
            if at:
                found.update(at)
        return sorted(found)

    def predict(self, text: str | None) -> list[float]:
        """The probability of each category, in the chain's order."""
        at, out = self.columns_of(text), []
        for w, v, b in self.links:
            out.append(float(_sigmoid(w[at].sum() + float(np.dot(v, out)) + b)))
        return out or [0.0] * len(self.params.categories)


def fit_chain(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, fold: np.ndarray, kept: list[list[int]], p: ToxicityParams) -> ToxicityModel:
    """rows: the kept feature hashes of each text; y: categories by row; kept: the features chosen on all rows, then on those outside each fold.

    A fold's probabilities come from a model that has seen none of its labels, in its choice of features neither."""
    if not len(rows):
        return ToxicityModel(p)
    column = {h: i for i, h in enumerate(kept[0])}
    every = {h: i for i, h in enumerate(sorted(set().union(*kept)))}
    x = np.zeros((len(rows), len(every)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, [every[int(h)] for h in r]] = 1.0
    mine = [np.array([every[h] for h in k], dtype=int) for k in kept]
    model = ToxicityModel(p, column)
    before = np.zeros((len(rows), 0), dtype=np.float32)
    for c in range(y.shape[1]):
        w, b = logistic(np.hstack([x[:, mine[0]], before]), y[:, c], weight, p)
        model.links.append((w[: len(column)], w[len(column) :], b))
        held = np.zeros(len(rows))
        for k in range(p.folds):
            out = fold == k
            if out.any() and (~out).any():
                full = np.hstack([x[:, mine[k + 1]], before])
                wk, bk = logistic(full[~out], y[~out, c], weight[~out], p)
                held[out] = _sigmoid(full[out] @ wk + bk)
        before = np.hstack([before, held[:, None].astype(np.float32)])
    model.threshold = best_threshold(before[:, -1], y[:, -1], weight)
    return model


def best_threshold(prob: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of highest F1 over out-of-fold probabilities, in the middle of the gap that it lies in; 2 (nothing) without positives."""
    if not y.any():
        return 2.0
    order = np.argsort(-prob, kind="stable")
    s, hit = prob[order], np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    below = float(s[i + 1]) if i + 1 < len(s) else 0.0
    return (float(s[i]) + below) / 2


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """docs: (doc_id, text); labels: (doc_id, one 0/1 column for each category)."""
    cats = list(p.categories)
    good = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in cats]).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in cats])
    n = {r[0]: r[1] for r in good.groupBy(cats[-1]).count().collect()}
    share = {1: min(1.0, p.max_positive / max(n.get(1, 0), 1)), 0: min(1.0, p.max_negative / max(n.get(0, 0), 1))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("op6")), F.lit(1 << 30)) / float(1 << 30)
    sample = good.where(draw < F.when(F.col(cats[-1]) == 1, share[1]).otherwise(share[0]))

    def start():
        return lambda cols: ((i, zlib.crc32(str(i).encode()) % p.folds, *[float(cols[c][k]) for c in cats], sorted(text_features(cols["text"][k]))) for k, i in enumerate(cols["doc_id"]))

    found = join_checked(docs.select("doc_id", "text"), sample, ["doc_id"])
    # of several texts of an id one is learned from, whatever their number
    found = found.groupBy("doc_id", *cats).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    ddl = "doc_id long, fold int, " + ", ".join(f"`{c}` double" for c in cats) + ", at array<long>"
    rows = materialise(map_rows(found, start, ddl))
    kept = telling(rows, cats, p)
    every = sorted(set().union(*kept))
    own = F.array_intersect("at", F.array(*map(F.lit, every))) if every else F.slice("at", 1, 0)
    got = rows.select("doc_id", "fold", *cats, own.alias("at")).toPandas().sort_values("doc_id", kind="stable")
    release(docs.sparkSession)  # Python's part of the driver's memory is largest from here on
    y = got[cats].to_numpy(dtype=float).reshape(len(got), len(cats))
    weight = np.where(y[:, -1] == 1, 1 / share[1], 1 / share[0]) if len(got) else np.zeros(0)
    return fit_chain([np.asarray(a, dtype=np.int64) for a in got["at"]], y, weight, got["fold"].to_numpy(), kept, p)


def telling(rows: DataFrame, cats: list[str], p: ToxicityParams) -> list[list[int]]:
    """The features of at least three rows whose rates differ most, and beyond chance, between a category's rows and the others: by all rows,
    then by the rows outside each fold. Only these reach the driver."""
    folds = range(p.folds)
    inside = [F.col("fold") == k for k in folds]
    sums = [F.count("*").alias("s"), *[F.sum(c).alias(c) for c in cats]]
    sums += [x for k in folds for x in (F.count_if(inside[k]).alias(f"s_{k}"), *[F.sum(F.when(inside[k], F.col(c)).otherwise(0.0)).alias(f"{c}_{k}") for c in cats])]
    n = rows.agg(*sums).first().asDict()
    seen = materialise(rows.select("fold", *cats, F.explode("at").alias("h")).groupBy("h").agg(*sums).where("s >= 3"))
    chosen = []
    for k in [None, *folds]:

        def number(name):
            return (n[name] or 0) - (0 if k is None else n[f"{name}_{k}"] or 0)

        def column(name):
            return F.col(name) - (F.lit(0) if k is None else F.col(f"{name}_{k}"))

        out: set[int] = set()
        every = number("s")
        for c in cats:
            n1, s = number(c), column("s")
            rate = s / max(every, 1)
            d = F.abs(column(c) / max(n1, 1.0) - (s - column(c)) / max(every - n1, 1.0))
            error = F.sqrt(rate * (1 - rate) * (1 / max(n1, 1.0) + 1 / max(every - n1, 1.0)))
            best = seen.where(s >= 3).select("h", d.alias("d"), error.alias("e")).where(F.expr(f"d > 0 and d >= {p.floor} * e")).orderBy(F.desc("d"), "h").limit(p.features // len(cats))
            out.update(r["h"] for r in best.collect())
        chosen.append(sorted(out))
    return chosen


def categories(labels: DataFrame) -> DataFrame:
    """The labels table as categories: low_quality is quality 0."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs to (doc_id, <category>_prob of each category, toxic boolean)."""

    def rows_of(cols):
        for i, text in zip(cols["doc_id"], cols["text"]):
            probs = model.predict(text)
            yield i, *probs, probs[-1] >= model.threshold

    ddl = "doc_id long, " + ", ".join(f"{c}_prob double" for c in model.params.categories) + ", toxic boolean"
    return map_rows(docs.select("doc_id", "text"), lambda: rows_of, ddl)


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs without the rows that the model rejects; all columns as they were."""

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([model.predict(t)[-1] < model.threshold for t in text], dtype=bool)

    return docs.where(clean(F.col("text")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(docs, fit(docs, categories(table(spark, sf_dir, "labels"))))
