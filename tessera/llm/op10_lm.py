"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Vocabulary: the most frequent words that cover a share of the corpus' tokens are units of their own, so that the model grows with the corpus;
all other words share a unit by their ending and are told apart inside it by add-one unigram shares, so every word, seen or not, has a
normalised probability. The context vector is the sum of the last words' embeddings, each scaled by its position's vector. The softmax has
two levels, both exact: units are dealt by frequency into about sqrt(units) classes, and a unit's probability is its class's times its own
among the class, each from the product with an output embedding plus a bias. Both levels are trained with noise of their own.

Word counts cover all training documents. Each document is cut into units once; training and scoring read the units. Training starts on a
sample of about `warm_docs` documents drawn by a hash, at the driver. Then all training documents are dealt by the same hash to shards whose
number follows from the token count; a shard is gone through in the order of the hash from the warm start, and the parameters are averaged
by targets. So neither files nor partitions change a score. Every position of every training document is a target. Exact repeats of an id
and text train once (counts take them all).
The frequent words' counts, at most `head`, go to the workers; rarer words meet their counts in a shuffled join, pre-aggregated by document.

Defined results: null text counts as empty and is one end token. Rows with a null id are scored (held_out false) but not learned from.
Without training documents all counts are 0 and the model is uniform. Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_rows, materialise, partitions, table

END = b""  # the end token; words are never empty


@dataclass(frozen=True)
class LmParams:
    head: int = 150_000  # words whose counts every worker holds
    own: int = 192  # of them, units of their own; fit() takes more where the corpus has more
    endings: int = 64  # units shared by the other words, by their last bytes; fit() takes more beside more words
    coverage: float = 0.55  # of the training tokens, by words of their own
    ending: int = 3
    dims: int = 64
    context: int = 2
    noise: int = 32  # classes
    inner: int = 8  # noise units of each class
    batch: int = 8192
    rate: float = 0.2
    warm_docs: int = 3000  # bound on the driver's sample
    warm_epochs: int = 4
    shard_tokens: int = 4_000_000  # training tokens of a shard, about

    @property
    def units(self) -> int:
        return self.own + self.endings

    @property
    def width(self) -> int:
        """Units of a class; the last may have fewer."""
        return math.isqrt(self.units - 1) + 1

    @property
    def classes(self) -> int:
        return -(-self.units // self.width)

    def sized(self, frequent: list[tuple[bytes, int]], tokens: int) -> LmParams:
        """With the fewest frequent words that cover the share of all tokens as units, and endings in the same proportion to them."""
        sums = np.cumsum([c for _, c in frequent], dtype=np.float64)
        own = max(self.own, min(len(sums), int(np.searchsorted(sums, self.coverage * tokens)) + 1))
        return replace(self, own=own, endings=max(self.endings, own * self.endings // self.own))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def _count():
    seen: Counter = Counter()

    def flush():
        out = list(seen), list(seen.values())
        seen.clear()
        return out

    return seen, flush


def count_words(docs: DataFrame) -> DataFrame:
    """docs to (word, c): each partition counts in a dictionary that it hands on when it is large; sums follow."""

    def run(batches):
        import pyarrow as pa

        seen, flush = _count()

        def out():
            words, counts = flush()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    seen.update(words_of(text))
                if len(seen) > 600_000:
                    yield out()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent words with counts, and the units of all words."""

    def __init__(self, frequent: list[tuple[bytes, int]], p: LmParams):
        self.p = p
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        self.log_c = np.log10(np.array([c for _, c in frequent], dtype=np.float64) + 1) if frequent else np.zeros(0)
        self.unit = np.array([i if i < p.own else self.ending_unit(w) for i, (w, _) in enumerate(frequent)], dtype=np.int32)

    def ending_unit(self, word: bytes) -> int:
        return self.p.own + zlib.crc32(word[-self.p.ending :]) % self.p.endings

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place among the frequent words or -1, unit) of each word."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        unit = self.unit[at] if len(self.unit) else np.zeros(len(at), np.int32)
        for k in np.flatnonzero(at < 0).tolist():
            unit[k] = self.ending_unit(words[k])
        return at, unit


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order; numbers of 16 bits are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def _run_sums(x: np.ndarray, order: np.ndarray, first: np.ndarray, short: int = 24) -> np.ndarray:
    """Sums of the rows x[order] over runs that begin at `first`: all first rows, then all second ones and so on; what a run has beyond
    `short` rows is summed by itself."""
    size = np.diff(first, append=len(order))
    longest = np.argsort(-size, kind="stable")
    begin, upto = first[longest], np.searchsorted(-size[longest], -np.arange(1, short + 1), side="right")
    out = x.take(order[begin], axis=0)
    for k in range(1, short):
        if not (m := upto[k]):
            break
        out[:m] += x.take(order[begin[:m] + k], axis=0)
    for i in range(np.count_nonzero(size > short)):
        rest = order[begin[i] + short : begin[i] + size[longest[i]]]
        out[i] += np.ones(len(rest), x.dtype) @ x.take(rest, axis=0)
    back = np.empty_like(out)
    back[longest] = out
    return back


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[len(x) > 0], x[1:] != x[:-1]]))


def _slope(z: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(z, -30, 30, out=z)
    np.exp(np.negative(z, out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


class Noise:
    """Noise distributions by mass: of classes, and of units in each class; shifts are the logs of expected noise counts."""

    def __init__(self, p: LmParams, mass: np.ndarray):
        u, w = p.units, p.width
        self.p, starts = p, np.arange(0, u, w)
        by_class = np.add.reduceat(mass, starts)
        self.class_shift = np.log(p.noise * by_class / by_class.sum()).astype(np.float32)
        self.shift = np.log(p.inner * mass / np.repeat(by_class, w)[:u]).astype(np.float32)
        self.class_upto, self.upto, self.by_class = np.cumsum(by_class), np.cumsum(mass), by_class
        self.below = np.concatenate([[0.0], self.upto])[starts]

    def inside(self, kinds: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        """Noise units of each of the classes, a row for a class."""
        w = self.p.width
        at = np.searchsorted(self.upto, self.below[kinds][:, None] + draw.random((len(kinds), self.p.inner)) * self.by_class[kinds][:, None], side="right")
        return np.clip(at, (kinds * w)[:, None], np.minimum(kinds * w + w, self.p.units)[:, None] - 1)


@dataclass
class Tables:
    """For each place of a context: what each of its units adds to the classes' scores, the greatest of that, the exponentials less the
    greatest, and the scaled embeddings. Then the classes' output embeddings, and a bound on a unit's score."""

    adds: list[np.ndarray]
    tops: list[np.ndarray]
    exps: list[np.ndarray]
    scaled: list[np.ndarray]
    inner: list[np.ndarray]
    reach: float


class LogBilinear:
    """Parameters in one flat vector: context embeddings (with one for the text's start), output embeddings of units and classes, each with
    its bias as the last column, and position scales."""

    def __init__(self, p: LmParams, flat: np.ndarray | None = None):
        self.p = p
        u, k, d, n = p.units, p.classes, p.dims, p.context
        if flat is None:
            draw = np.random.default_rng(3)
            out = np.hstack([draw.normal(0, 0.1, (u + k, d)), np.zeros((u + k, 1))])
            flat = np.concatenate([draw.normal(0, 0.1, (u + 1) * d), out.ravel(), np.ones(n * d)])
        self.flat = flat.astype(np.float32)
        self.r, self.q, self.a, self.c = self.parts(self.flat)

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Views of a vector of this shape: contexts, units, classes, positions."""
        u, k, d, n = self.p.units, self.p.classes, self.p.dims, self.p.context
        x = np.split(flat, np.cumsum([(u + 1) * d, u * (d + 1), k * (d + 1)]))
        return x[0].reshape(u + 1, d), x[1].reshape(u, d + 1), x[2].reshape(k, d + 1), x[3].reshape(n, d)

    def start(self, mass: np.ndarray) -> None:
        """Biases from the units' masses."""
        by_class = np.add.reduceat(mass, np.arange(0, len(mass), self.p.width))
        self.a[:, -1] = np.log(by_class / mass.sum())
        self.q[:, -1] = np.log(mass / np.repeat(by_class, self.p.width)[: len(mass)])

    def contexts(self, docs_units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(contexts, targets) of whole texts; the nearest word's unit comes first."""
        n, start = self.p.context, self.p.units
        if not docs_units:
            return np.zeros((0, n), np.int32), np.zeros(0, np.int32)
        gap = np.full(n, start, dtype=np.int32)
        line = np.concatenate([x for u in docs_units for x in (gap, u)]).astype(np.int32)
        size = np.array([len(u) for u in docs_units])
        at = np.arange(int(size.sum())) + n * np.repeat(np.arange(1, len(size) + 1), size)
        return np.stack([line[at - k - 1] for k in range(n)], axis=1), line[at]

    def embedded(self, ctx: np.ndarray, scaled: list[np.ndarray] | None = None) -> np.ndarray:
        """Context vectors. scaled: the embeddings for each place, if made before."""
        scaled = scaled or [self.r * self.c[j] for j in range(self.p.context)]
        both = scaled[0].take(ctx[:, 0], axis=0)
        for j in range(1, self.p.context):
            both += scaled[j].take(ctx[:, j], axis=0)
        return both

    def hidden(self, ctx: np.ndarray, emb: list) -> np.ndarray:
        """Context vectors, with a one for the bias."""
        h = np.empty((len(ctx), self.p.dims + 1), dtype=np.float32)
        h[:, -1] = 1
        for j, x in enumerate(emb):
            if j:
                h[:, :-1] += x * self.c[j]
            else:
                np.multiply(x, self.c[j], out=h[:, :-1])
        return h

    def train(self, ctx: np.ndarray, y: np.ndarray, noise: Noise, draw: np.random.Generator, grad2: np.ndarray) -> None:
        """Noise-contrastive estimation with AdaGrad over the rows in batches, for the target's class and for the target among its class. A
        batch shares its noise classes, and its targets of one class share noise units. Only the rows that a batch touches are changed."""
        for at in range(0, len(y), self.p.batch):
            self._step(ctx[at : at + self.p.batch], y[at : at + self.p.batch], noise, draw, self.parts(grad2))

    def _step(self, ctx, y, noise, draw, grad2) -> None:
        p, (gr, gq, ga, gc) = self.p, grad2
        w, n, inner = p.width, p.context, p.inner
        by_unit = _order(y)  # units of a class come together
        cx, t = ctx[by_unit], y[by_unit]
        k = t // w
        m = np.float32(1 / len(t))
        emb = [self.r.take(cx[:, j], axis=0) for j in range(n)]
        h = self.hidden(cx, emb)
        first = _starts(k)
        kinds, size = k[first], np.diff(first, append=len(k))
        spans = list(zip(first.tolist(), (first + size).tolist()))
        # noise classes
        some = np.searchsorted(noise.class_upto, draw.random(p.noise) * noise.class_upto[-1], side="right").clip(0, p.classes - 1)
        dn = _slope(h @ self.a[some].T - noise.class_shift[some])
        dn *= m
        dh = dn @ self.a[some]
        # a class: its noise units, and itself
        at = noise.inside(kinds, draw)
        rows = np.concatenate([self.q[at], self.a[kinds][:, None]], axis=1)
        dk = np.empty((len(t), inner + 1), dtype=np.float32)
        for x, (lo, hi) in zip(rows, spans):
            np.matmul(h[lo:hi], x.T, out=dk[lo:hi])
        dk -= np.repeat(np.concatenate([noise.shift[at], noise.class_shift[kinds][:, None]], axis=1), size, axis=0)
        _slope(dk)
        dk[:, -1] -= 1
        dk *= m
        on_k = np.empty_like(rows)
        for i, (x, (lo, hi)) in enumerate(zip(rows, spans)):
            dh[lo:hi] += dk[lo:hi] @ x
            np.matmul(dk[lo:hi].T, h[lo:hi], out=on_k[i])
        # targets among their class
        q_t = self.q.take(t, axis=0)
        ep = (_slope(np.einsum("ij,ij->i", h, q_t) - noise.shift[t]) - 1) * m
        dh += np.multiply(ep[:, None], q_t, out=q_t)
        h_sums = dn.T @ h
        h *= ep[:, None]
        units = _starts(t)
        self._move(self.q, gq, [(t[units], _run_sums(h, np.arange(len(t)), units)), *((at[:, j], on_k[:, j]) for j in range(inner))])
        drawn, which = np.unique(some, return_inverse=True)
        on_some = (which == np.arange(len(drawn))[:, None]).astype(np.float32) @ h_sums
        self._move(self.a, ga, [(kinds, on_k[:, -1]), (drawn, on_some)])
        dh = np.ascontiguousarray(dh[:, :-1])
        on_c = np.stack([np.einsum("ij,ij->j", dh, e) for e in emb])
        on_r = []
        for j in range(n):
            order = _order(cx[:, j])
            line = cx[order, j]
            begin = _starts(line)
            on_r.append((line[begin], _run_sums(dh, order, begin) * self.c[j]))
        self._move(self.r, gr, on_r)
        self._move(self.c, gc, [(np.arange(n), on_c)])

    def _move(self, par, g2, parts) -> None:
        """parts: rows, each once in a part, and their gradients."""
        rows = np.concatenate([at for at, _ in parts])
        rows = rows[_order(rows)]
        rows = rows[_starts(rows)]
        grad = np.zeros((len(rows), par.shape[1]), dtype=np.float32)
        for at, x in parts:
            grad[np.searchsorted(rows, at)] += x
        g2_rows = g2.take(rows, axis=0)
        g2_rows += grad * grad
        g2[rows] = g2_rows
        np.sqrt(g2_rows, out=g2_rows)
        g2_rows += np.float32(1e-6)
        grad *= np.float32(self.p.rate)
        grad /= g2_rows
        par[rows] -= grad

    def tables(self) -> Tables:
        """What scoring reads of the parameters, made once for many calls."""
        adds = [(self.r * self.c[j]).astype(np.float64) @ self.a[:, :-1].T.astype(np.float64) for j in range(self.p.context)]
        adds[0] += self.a[:, -1]
        tops = [x.max(axis=1) for x in adds]
        scaled = [self.r * self.c[j] for j in range(self.p.context)]
        w = self.p.width
        inner = [np.ascontiguousarray(self.q[k * w : k * w + w].T.astype(np.float64)) for k in range(self.p.classes)]
        reach = sum(float(np.linalg.norm(x.astype(np.float64), axis=1).max()) for x in scaled) * float(np.linalg.norm(self.q[:, :-1].astype(np.float64), axis=1).max())
        return Tables(adds, tops, [np.exp(x - top[:, None]) for x, top in zip(adds, tops)], scaled, inner, reach + float(np.abs(self.q[:, -1]).max()))

    def log10(self, ctx: np.ndarray, y: np.ndarray, block: int = 65536, tables: Tables | None = None) -> np.ndarray:
        """Normalised log10 probabilities of the targets: of their classes, from sums of products of the context units' exponentials, and of the
        units among their class. A block is gone through class by class, in pieces that stay in the processor's cache. Products are in double
        precision, so that a score doesn't depend on the rows beside it."""
        w, out, most = self.p.width, np.empty(len(y)), 1024
        tables = tables or self.tables()
        adds, tops, exps = tables.adds, tables.tops, tables.exps
        h, each = np.ones((min(most, len(y)), self.p.dims + 1)), np.arange(most)
        room, ones = np.empty((min(most, len(y)), w)), np.ones(w)

        def of_units(x, by, at):
            """The units' scores, and their rows' sums of exponentials."""
            z = np.matmul(x, by, out=room.reshape(-1)[: len(x) * by.shape[1]].reshape(len(x), -1))
            if tables.reach > 500 and (top := z.max()) > 500:
                z -= top
            found = z[each[: len(z)], at]
            return found, np.exp(z, out=z) @ ones[: z.shape[1]]

        def of_class(cx, k):
            """Scores of class k, and logs of the rows' sums of exponentials."""
            places = [cx[:, j] for j in range(self.p.context)]
            rows = exps[0].take(places[0], axis=0)
            for x, at in zip(exps[1:-1], places[1:-1]):
                rows *= x[at]
            sums = np.einsum("ij,ij->i", rows, exps[-1].take(places[-1], axis=0)) if len(places) > 1 else rows.sum(axis=1)
            logs = sum(top[at] for top, at in zip(tops, places))
            low = np.flatnonzero(sums < 1e-250)
            for i in low.tolist():  # the units' greatest lie too far apart for products
                z = sum(x[at[i]] for x, at in zip(adds, places))
                logs[i], sums[i] = z.max(), np.exp(z - z.max()).sum()
            return sum(x[at, k] for x, at in zip(adds, places)) - logs, sums

        for i in range(0, len(y), block):
            by_class = _order(y[i : i + block])
            t, cx = y[i : i + block][by_class], ctx[i : i + block][by_class]
            k, found, sums = t // w, np.empty(len(t)), np.empty(len(t))
            first = _starts(k)
            for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(t)]):
                mine = int(k[begin])
                for lo in range(begin, end, most):
                    hi = min(end, lo + most)
                    h[: hi - lo, :-1] = self.embedded(cx[lo:hi], tables.scaled)
                    more, among = of_units(h[: hi - lo], tables.inner[mine], t[lo:hi] - mine * w)
                    score, total = of_class(cx[lo:hi], mine)
                    found[lo:hi] = score + more - np.log(total)
                    sums[lo:hi] = among
            out[i + by_class] = found - np.log(sums)
        return out / math.log(10)


@dataclass
class Statistics:
    counts: DataFrame  # (word, c), all words
    tokens: int
    distinct: int
    frequent: list  # (word, count), the most frequent first
    most: int  # no word beyond the frequent ones has a greater count


def _tie(word):
    return F.pmod(F.xxhash64(word, F.lit("op10")), F.lit(1 << 12))


def gather(train: DataFrame, p: LmParams) -> Statistics:
    """Word counts of all training documents. The frequent words are those above the least count that leaves at most p.head of them, and as
    many with that count, in the order of a hash, as there is room for."""
    counts = materialise(count_words(train))
    total = counts.agg(F.sum("c"), F.count("*")).first()
    n, least = 0, 0
    fine = F.floor(F.log2(F.col("c").cast("double")) * 32).cast("int")
    for r in sorted(counts.groupBy(fine.alias("f")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["f"]):
        if n + r["n"] > p.head:
            # at most this bin's distinct counts, a 32nd of an octave
            for s in sorted(counts.where(fine == r["f"]).groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda s: -s["c"]):
                if n + s["n"] > p.head:
                    least = s["c"]
                    break
                n += s["n"]
            break
        n += r["n"]
    chosen, cut = F.col("c") > least, -1
    if least:
        for r in counts.where(F.col("c") == least).groupBy(_tie("word").alias("t")).agg(F.count("*").alias("n")).orderBy("t").collect():
            if n + r["n"] > p.head:
                break
            n, cut = n + r["n"], r["t"]
        chosen = chosen | ((F.col("c") == least) & (_tie("word") <= cut))
    frequent = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(chosen).collect()), key=lambda x: (-x[1], x[0]))
    return Statistics(counts, total[0] or 0, total[1] or 0, frequent, least)


@dataclass
class Units:
    """Units of all words: the vocabulary, the mass of each unit, log10 of each ending unit's denominator."""

    vocab: Vocabulary
    mass: np.ndarray
    denominators: np.ndarray

    @property
    def kind(self) -> str:
        return "<u2" if self.vocab.p.units < 1 << 16 else "<u4"


def units_of(stats: Statistics, p: LmParams) -> Units:
    p = p.sized(stats.frequent, stats.tokens)
    shared = stats.frequent[: p.own]
    tail = F.when(F.length("word") <= p.ending, F.col("word")).otherwise(F.substring("word", -p.ending, p.ending))
    c, v, mass = np.zeros(p.endings), np.zeros(p.endings), np.zeros(p.units)
    for r in stats.counts.groupBy((F.crc32(tail) % p.endings).cast("int").alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        c[r["t"]], v[r["t"]] = r["c"], r["v"]
    for i, (w, n) in enumerate(shared):
        t = zlib.crc32(w[-p.ending :]) % p.endings
        c[t] -= n
        v[t] -= 1
        mass[i] = n
    mass[p.own :] = c
    return Units(Vocabulary(stats.frequent, p), mass + 1, np.log10(c + v + 1))


def encode(docs: DataFrame, units: Units) -> DataFrame:
    """docs (doc_id, held_out, text) to a row each with a hash of id and text, whether the task has met it before, the units, what is known of the base and inner shares without
    the rare words, and the rare words with their counts in the document."""

    def start():
        vocab, own, denominators, kind = units.vocab, units.vocab.p.own, units.denominators, units.kind
        seen: set = set()

        def rows_of(cols):
            heads, held = [], []
            for doc_id, out, h, text in zip(cols["doc_id"], cols["held_out"], cols["h"], cols["text"]):
                again = (doc_id, h) in seen
                if len(seen) > 200_000:
                    seen.clear()
                seen.add((doc_id, h))
                words = words_of(text)
                heads.append((doc_id, out, h, again, len(words)))
                held += words
                if len(held) > 32768:
                    yield from looked_up(heads, held)
                    heads, held = [], []
            if heads:
                yield from looked_up(heads, held)

        def looked_up(heads, words):
            """Rows of some documents, whose words are looked up together."""
            at, unit = vocab.look_up(words)
            size = np.array([x[-1] for x in heads])
            begin = np.cumsum(size) - size
            known, shared = at >= 0, unit >= own
            log_c = np.zeros(len(at))
            log_c[known] = vocab.log_c[at[known]]
            inner = np.where(shared, log_c, 0.0)
            inner[shared] -= denominators[unit[shared] - own]
            sums = [np.add.reduceat(x, begin).tolist() for x in (known.astype(np.int64), log_c, inner)]
            rare = np.flatnonzero(~known)
            upto = np.searchsorted(rare, begin + size).tolist()
            rare, unit, lo = rare.tolist(), unit.astype(kind), 0
            for head, b, n, base, more, hi in zip(heads, begin.tolist(), *sums, upto):
                times = Counter([words[k] for k in rare[lo:hi]])
                yield *head, n, base, more, unit[b : b + head[-1]].tobytes(), list(times.keys()), list(times.values())
                lo = hi

        return rows_of

    ddl = "doc_id long, held_out boolean, h long, again boolean, n_tokens long, known long, base double, inner double, units binary, words array<binary>, times array<int>"
    return map_rows(docs.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("h"), "text"), start, ddl)


def fit(encoded: DataFrame, stats: Statistics, units: Units) -> LogBilinear:
    """encoded: encode()'s rows of the training documents."""
    p, kind, noise = units.vocab.p, units.kind, Noise(units.vocab.p, units.mass)
    model = LogBilinear(p)
    model.start(units.mass)
    rows, n = encoded.where("not again").select("doc_id", "h", "units"), encoded.count()  # so no repeated row fills a shard
    warm = rows.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, p.warm_docs / max(n, 1)))).toPandas().drop_duplicates(["h", "doc_id"]).sort_values(["h", "doc_id"])
    if not n:
        return model
    grad2, draw = np.full_like(model.flat, 1e-4), np.random.default_rng(5)
    ctx, y = model.contexts([np.frombuffer(u, kind) for u in warm["units"]])
    for _ in range(p.warm_epochs):
        order = draw.permutation(len(y))
        model.train(ctx[order], y[order], noise, draw, grad2)
    flat, start2 = model.flat, grad2
    shards = max(1, round(stats.tokens / p.shard_tokens))

    def run(batches):
        import pyarrow as pa

        def done(shard, mine, seen):
            blocks = [x.tobytes() for x in np.split(mine.flat, range(1 << 16, len(mine.flat), 1 << 16))]
            return pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int64()), pa.array([shard] * len(blocks), pa.int64()), pa.array([seen] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["i", "shard", "seen", "x"])

        shard, held, n_held, seen, last, rest = None, [], 0, 0, None, model.contexts([])

        def learn(every=False):
            """Trains on whole batches, or on all that is held."""
            nonlocal rest
            cx, t = (np.concatenate(x) for x in zip(rest, mine.contexts(held)))
            upto = len(t) if every else len(t) // p.batch * p.batch
            mine.train(cx[:upto], t[:upto], noise, draw, g2)
            rest = cx[upto:], t[upto:]
            held.clear()

        for batch in batches:
            for s, h, doc_id, u in zip(*[batch.column(c).to_pylist() for c in ("shard", "h", "doc_id", "units")]):
                if last == (doc_id, h):
                    continue
                last = (doc_id, h)
                if s != shard:
                    if seen:
                        learn(every=True)
                        yield done(shard, mine, seen)
                    shard, n_held, seen = s, 0, 0
                    mine, g2, draw = LogBilinear(p, flat.copy()), start2.copy(), np.random.default_rng([9, s])
                held.append(np.frombuffer(u, kind))
                n_held += len(held[-1])
                seen += len(held[-1])
                if n_held >= p.batch:
                    learn()
                    n_held = len(rest[1])
        if seen:
            learn(every=True)
            yield done(shard, mine, seen)

    def mean(pdf):
        pdf = pdf.sort_values("shard")
        rows = sum(n * np.frombuffer(x, np.float32).astype(float) for n, x in zip(pdf["seen"], pdf["x"]))
        return pdf[["i", "shard"]].head(1).assign(seen=pdf["seen"].sum(), x=[(rows / pdf["seen"].sum()).astype(np.float32).tobytes()])

    dealt = rows.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards))).repartitionById(min(shards, 4 * partitions(rows.sparkSession)), F.col("shard").cast("int"))
    found = dealt.sortWithinPartitions("shard", "h", "doc_id").select("shard", "h", "doc_id", "units").mapInArrow(run, "i long, shard long, seen long, x binary")
    while shards > 0:  # in rounds of at most 64 shards each, so that no task holds more
        shards = shards // 64
        found = found.withColumn("shard", F.expr("shard div 64")).groupBy("i", "shard").applyInPandas(mean, "i long, shard long, seen long, x binary")
    got = found.toPandas().sort_values("i")
    return LogBilinear(p, np.frombuffer(b"".join(map(bytes, got["x"])), np.float32)) if len(got) else model


def score(encoded: DataFrame, stats: Statistics, units: Units, model: LogBilinear) -> DataFrame:
    """encode()'s rows, of all documents, to the contract's columns."""
    n_all, v_all, kind = stats.tokens, stats.distinct, units.kind

    def start():
        tables = model.tables()

        def rows_of(cols):
            found = [np.frombuffer(u, kind) for u in cols["units"]]
            ends = np.cumsum([len(u) for u in found])
            logs = np.zeros(len(found))
            begin = 0
            while begin < len(found):  # as many texts as make up a block; a longer one alone, its contexts in pieces
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 65536, side="right")))
                each = model.log10(*model.contexts(found[begin:end]), tables=tables)
                size = np.array([len(u) for u in found[begin:end]])
                logs[begin:end] = [float(x.sum()) for x in np.split(each, np.cumsum(size)[:-1])]
                begin = end
            yield from zip(*[cols[c] for c in kept], [x + y for x, y in zip(logs.tolist(), cols["inner"])])

        return rows_of

    rare = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    counts = stats.counts.where(F.col("c") <= stats.most)
    more = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("more"), F.sum("times").alias("k"))
    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base"]
    ddl = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
    out = map_rows(encoded.select(*kept, "inner", "units"), start, ddl).join(more, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def scored(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """docs (doc_id, held_out, text) to the contract's columns; learns from the rows that have an id and are not held out."""
    docs = docs.select("doc_id", "held_out", "text")
    learned = "doc_id is not null and not held_out"
    stats = gather(docs.where(learned), p)
    units = units_of(stats, p)
    encoded = materialise(encode(docs, units).withColumn("row", F.monotonically_increasing_id()))
    return score(encoded, stats, units, fit(encoded.where(learned), stats, units))


def op10_lm(spark: SparkSession, sf_dir: str, p: LmParams = LmParams()) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out")), p)
