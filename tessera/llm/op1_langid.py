"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (FTRL-proximal) under elastic-net penalties, then calibrated by one temperature.

Defined results: null, empty or letterless text gives `und` with score 0; so does any text if nothing could be learned (empty table,
no labelled rows). Repeated rows each get a row; rows with a null id are predicted but never learned from (held_out false).
Other columns are neither read nor returned. Texts are used whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_rows, table

_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LangIdParams:
    bits: int = 15  # hashed n-gram space
    orders: tuple = (1, 2, 3)
    max_train_rows: int = 1600  # bound on the labelled sample that the model is fitted on, shared evenly by the languages
    least_rows: int = 8  # of a language, however many there are
    calibration: int = 5  # every fifth sampled row sets the temperature
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


def letters(text: str | None) -> str:
    """Lower case, every run of other characters one space; empty if there is no letter."""
    if not text:
        return ""
    out = _OTHER.sub(" ", text.lower())
    return f" {out.strip()} " if any(map(str.isalpha, out)) else ""


def counts(clean: str, p: LangIdParams) -> np.ndarray:
    """Occurrences of each hashed n-gram of a cleaned text."""
    code = np.frombuffer(clean.encode("utf-32-le"), dtype=np.uint32)
    parts, roll = [], np.zeros(len(code), dtype=np.uint32)
    for n in range(1, max(p.orders) + 1):
        if n > len(code):
            break
        roll = (roll[: len(code) - n + 1] * np.uint32(0x01000193)) ^ (code[n - 1 :] * np.uint32(0x9E3779B1))
        if n in p.orders:
            parts.append(((roll + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - p.bits))
    return np.bincount(np.concatenate(parts), minlength=1 << p.bits)


def _frequencies(p: LangIdParams):
    def run(batches):
        df, n = np.zeros(1 << p.bits, dtype=np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                if clean := letters(text):
                    df += counts(clean, p) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1).astype("int64"), "n": np.append(df[at], n)})

    return run


def _features(p: LangIdParams):
    def rows_of(cols):
        for lang, text, k in zip(cols["lang"], cols["text"], cols["k"]):
            if clean := letters(text):
                c = counts(clean, p)
                at = np.flatnonzero(c)
                yield lang, k, at.tolist(), c[at].tolist()

    return lambda: rows_of


@dataclass
class LangIdModel:
    params: LangIdParams
    langs: list
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, sparse by the l1 penalty
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, texts):
        """(language, calibrated probability) of each text."""
        used = np.flatnonzero(self.weights.any(axis=1)) if len(self.langs) else np.array([], dtype=int)
        idf2, w = self.idf**2, self.weights[used] * self.idf[used, None] if len(used) else None
        for text in texts:
            clean = letters(text)
            if not clean or not self.langs:
                yield "und", 0.0
                continue
            c = np.log1p(counts(clean, self.params))
            z = self.bias.copy()
            if len(used):
                z = z + (c[used] @ w) / max(math.sqrt(float((c * c) @ idf2)), 1e-12)
            z = z / self.temperature
            e = np.exp(z - z.max())
            best = int(e.argmax())
            yield self.langs[best], float(e[best] / e.sum())


def ftrl(rows: list, y: np.ndarray, n_classes: int, dims: int, p: LangIdParams):
    """FTRL-proximal over sparse rows (index, value); an index of dims is the bias, which no penalty shrinks."""
    z, n = np.zeros((dims + 1, n_classes)), np.zeros((dims + 1, n_classes))

    def weights(at):
        zz, l1 = z[at], np.where(at == dims, 0.0, p.l1)[:, None]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            s = x @ w
            e = np.exp(s - s.max())
            g = e / e.sum()
            g[y[i]] -= 1.0
            grad = x[:, None] * g
            sigma = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / p.alpha
            z[at] += grad - sigma * w
            n[at] += grad**2
    w = weights(np.arange(dims + 1))
    return w[:dims], w[dims]


def fit(labelled: DataFrame, p: LangIdParams = LangIdParams()) -> LangIdModel:
    """labelled: (key, text, lang), all rows that may be learned from. Document frequencies cover all of them; the weights come from a
    sample of about p.max_train_rows rows, drawn by a hash of key."""
    labelled = labelled.where("lang is not null and text is not null")
    dims = 1 << p.bits
    df = labelled.select("text").mapInPandas(_frequencies(p), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    idf = np.ones(dims)
    total = int(df.loc[df["bucket"] < 0, "n"].sum())
    seen = np.zeros(dims)
    real = df[df["bucket"] >= 0]
    seen[real["bucket"].to_numpy()] = real["n"].to_numpy()
    idf = np.log((1 + total) / (1 + seen)) + 1.0
    langs = sorted(sizes)
    if not langs or not total:
        return LangIdModel(p, [], idf, np.zeros((dims, 0)), np.zeros(0))
    share = max(p.max_train_rows / len(langs), p.least_rows)
    # the hash covers the text, so that a key of many rows is thinned like any other; exact repeats are one row
    draw = F.pmod(F.xxhash64("key", "text", F.lit("op1")), F.lit(1 << 30)) / float(1 << 30)
    want = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, share / sizes[lang]))]), F.col("lang"))
    sample = labelled.where(draw < want).select("lang", "text", F.pmod(F.xxhash64("key", "text", F.lit("fold")), F.lit(p.calibration)).alias("k")).dropDuplicates()
    got = map_rows(sample, _features(p), "lang string, k long, at array<int>, tf array<float>").toPandas()
    got["order"] = [hash((tuple(a), tuple(t))) for a, t in zip(got["at"], got["tf"])]  # hashes of numbers: the same in every process
    got = got.sort_values(["lang", "k", "order"], kind="stable").reset_index(drop=True)
    rows, y = [], []
    for lang, at, tf in zip(got["lang"], got["at"], got["tf"]):
        at = np.asarray(at, dtype=np.int64)
        x = np.log1p(np.asarray(tf, dtype=np.float64)) * idf[at]
        x /= max(np.linalg.norm(x), 1e-12)
        rows.append((np.append(at, dims), np.append(x, 1.0)))
        y.append(langs.index(lang))
    if not rows:
        return LangIdModel(p, [], idf, np.zeros((dims, 0)), np.zeros(0))
    y = np.array(y)
    held = (got["k"] == 0).to_numpy() & (len(rows) >= 50)
    w, b = ftrl([r for r, h in zip(rows, held) if not h], y[~held], len(langs), dims, p)
    model = LangIdModel(p, langs, idf, w, b)
    if held.any():
        z = np.array([x[:-1] @ w[at[:-1]] + b for (at, x), h in zip(rows, held) if h])
        model.temperature = temperature(z, y[held])
    return model


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    As in Platt's calibration, targets keep a little mass for the other classes, so perfectly separated rows don't drive it to 0."""
    n, k = z.shape
    rest = 1 / (n + 2)
    target = np.full((n, k), rest / max(k - 1, 1))
    target[np.arange(n), y] = 1 - rest

    def loss(t):
        s = z / math.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)).mean())

    lo, hi, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def predict(docs: DataFrame, model: LangIdModel) -> DataFrame:
    """docs: (doc_id, held_out, text) to (doc_id, held_out, lang_pred, score)."""

    def rows_of(cols):
        return ((i, h, *found) for i, h, found in zip(cols["doc_id"], cols["held_out"], model.predict(cols["text"])))

    return map_rows(docs.select("doc_id", "held_out", "text"), lambda: rows_of, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.coalesce(crc_mod("doc_id", 5), F.lit(-1)) == 0).alias("held_out"))
    model = fit(docs.where("doc_id is not null and not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(docs, model)
