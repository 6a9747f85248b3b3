"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Each occurrence of an anchor (a common word) gives a signature: the anchor and the next `chain` content words behind it. A fingerprint is the
set of a text's signatures. Tables and lists have few common words; so that they get signatures too, one in `sampled` of all other words,
chosen by a hash, also anchors a chain. Fingerprints are compared by Jaccard likeness; pairs whose sizes alone rule out the threshold are never
compared (set lengths are cut into partitions, a fingerprint meets its own partition and the next), and of the rest only those
that share one of a fingerprint's rarest signatures, which any pair above the threshold must.

Defined results: null text counts as empty. A text without chains is one signature of all its words; without words its fingerprint is
empty, and two empty fingerprints have likeness 1. Documents follow each other by id, nulls first; of rows with one id, by crc32 of the
text, then text. The last row is followed by the first, a single row by itself. Repeated rows each get a row; other columns are
neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise, partitions, table

# Common words of four languages.
ANCHORS = frozenset(
    """the of and to in a is was for that with as by on at from it be an are this which or
    der die das und ist im den von zu mit sich des auf für nicht ein eine dem
    le la les des de du et un une est que qui dans pour par sur en au
    el los las y del se por con para su al lo como más""".split()
)
_WORDS = re.compile(r"\w+").findall
_FIRST = -(1 << 63)


@dataclass(frozen=True)
class SpotParams:
    anchors: frozenset = ANCHORS
    chain: int = 2
    sampled: int = 8  # 0: common words only
    near: float = 0.5


def signatures(text: str | None, p: SpotParams = SpotParams()) -> set[int]:
    """The 32-bit hashes of a text's signatures."""
    words, anchors, chain = _WORDS((text or "").lower()), p.anchors, p.chain
    content = [w for w in words if w not in anchors]
    picked = {w for w in set(content) if zlib.crc32(w.encode("utf-8", "surrogatepass")) % p.sampled == 0} if p.sampled else ()
    out, at, last = set(), 0, len(content) - chain
    for w in words:
        if w not in anchors:
            at += 1
            if w not in picked:
                continue
        if at <= last:
            out.add(f"{w} {' '.join(content[at : at + chain])}")
    if not out and words:
        out.add(" ".join(["", *words]))
    hash32 = xxhash.xxh32_intdigest
    return {hash32(s.encode("utf-8", "surrogatepass")) for s in out}


def fingerprint(sigs: set[int]) -> str:
    """The set as sorted numbers of eight hex digits."""
    return np.sort(np.fromiter(sigs, dtype=np.uint32, count=len(sigs))).astype(">u4").tobytes().hex()


def likeness(a: set[int], b: set[int]) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by as many from the start of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def block_bounds(keyed: DataFrame, low: int, cuts: list[int]) -> list[tuple[int, int]]:
    """(id, crc32) of the first documents of blocks; a crc of -1 stands for all rows of an id. An id that several cuts fall on holds more
    than a block's share of the rows (null ids, say) and is cut further by the crc32 of its texts."""
    times = Counter(cuts)
    hot = {k: n + 1 for k, n in times.items() if n > 1}
    bounds = {(k, -1) for k in {low, *cuts} if k not in hot}
    if hot:
        part = F.element_at(F.create_map(*[F.lit(x) for k, n in hot.items() for x in (k, n)]), F.col("k"))
        found = keyed.where(F.col("k").isin(list(hot))).groupBy("k", F.floor(F.col("crc") * part / F.lit(1 << 32)).alias("part")).agg(F.min("crc").alias("crc"))
        bounds |= {(r["k"], r["crc"]) for r in found.collect()}
    return sorted(bounds)


def in_order(docs: DataFrame, row, ddl: str, n_blocks: int | None = None) -> DataFrame:
    """Runs row(doc_id, text, next text) on every document beside its follower, with one shuffle of the texts.

    Block bounds are ids of the table (and checksums, where one id has many rows), so a block's first document is known in advance: it also
    goes to the end of the block before (the very first to the end of the last), and each task reads its sorted block once, holding two
    documents."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_FIRST)).alias("k"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    n = n_blocks or partitions(spark)
    low, cuts = keyed.agg(F.min("k"), F.percentile_approx("k", [i / n for i in range(1, n)] if n > 1 else [0.5], 10 * n)).first()
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    if low is None:
        return spark.createDataFrame([], ddl)
    bounds = block_bounds(keyed, low, cuts or [])
    ids, sums = np.array([b[0] for b in bounds], dtype=np.int64), np.array([b[1] for b in bounds], dtype=np.int64)
    starts = {k: i for i, (k, _) in reversed(list(enumerate(bounds)))}

    @F.pandas_udf("array<int>")
    def blocks(k: pd.Series, crc: pd.Series) -> pd.Series:
        out = []
        for i, key, c in zip((np.searchsorted(ids, k.to_numpy(), side="right") - 1).tolist(), k.tolist(), crc.tolist()):
            first = ids[i] == key
            if first and sums[i] >= 0:  # an id of several blocks
                begin = starts[key]
                i = begin + int(np.searchsorted(sums[begin : i + 1], c, side="right")) - 1
                first = sums[i] == c
            out.append([i, -1 - (i - 1) % len(bounds)] if first else [i])
        return pd.Series(out)

    # a block b holds its documents as b, the document that follows its last one as -1 - b
    dealt = keyed.withColumn("b", F.explode(blocks("k", "crc"))).withColumns({"block": F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")), "after": F.col("b") < 0}).drop("b")
    dealt = dealt.repartitionById(len(bounds), F.col("block")).sortWithinPartitions("block", "after", "k", "crc", "text")

    def run(batches):
        held, done = None, -1
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cols, rows = batch.slice(at, 256).to_pydict(), []
                for doc_id, text, block, after in zip(cols["doc_id"], cols["text"], cols["block"], cols["after"]):
                    if block == done:
                        continue  # more rows of the id that follows
                    if held is not None:
                        rows.append(row(*held, text or ""))
                    held = None if after else (doc_id, text or "")
                    done = block if after else done
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return dealt.select("doc_id", "text", "block", "after").mapInArrow(run, ddl)


def fingerprints(docs: DataFrame, p: SpotParams = SpotParams()) -> DataFrame:
    """docs to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""

    last: list = [None, None]  # the follower's signatures, its own in the next call

    def row(doc_id, text, following):
        new = edited(text, following)
        a = last[1] if last[0] == text else signatures(text, p)
        b, c = signatures(new, p), signatures(following, p)
        last[:] = [following, c]
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(a), fingerprint(b), likeness(a, b), likeness(a, c)

    return in_order(docs, row, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def length_partition(n: int, threshold: float) -> int:
    """Sets whose sizes differ so little that they may reach the threshold lie in the same or in neighbouring partitions."""
    return int(math.log(max(n, 1)) / -math.log(threshold))


def near_pairs(sigs: DataFrame, p: SpotParams = SpotParams()) -> DataFrame:
    """(fp_id, sigs array<long>, distinct sets) to pairs (a, b, likeness) of at least p.near, a < b, exactly.

    Each set sends its rarest signatures, as many as any partner must share one of, to its length partition and the one above."""
    t = p.near
    s = materialise(sigs.select("fp_id", F.array_distinct("sigs").alias("sigs")).where("size(sigs) > 0").withColumn("n", F.size("sigs")))
    freq = s.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    rank = s.select("fp_id", "n", F.explode("sigs").alias("sig")).join(freq, "sig").groupBy("fp_id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "sig"))).alias("o"))
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(t)).cast("int")
    rare = rank.withColumn("part", part).select("fp_id", "n", "part", F.explode(F.expr(f"slice(o.sig, 1, n - cast(ceil({t} * n) as int) + 1)")).alias("sig"))
    left = rare.select("fp_id", "n", "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    pair = left.alias("l").join(rare.alias("r"), ["part", "sig"]).where("(l.n < r.n or (l.n = r.n and l.fp_id < r.fp_id)) and l.n >= " + str(t) + " * r.n")
    pair = pair.select(F.col("l.fp_id").alias("x"), F.col("r.fp_id").alias("y")).distinct()
    both = pair.join(s.select(F.col("fp_id").alias("x"), F.col("sigs").alias("xs")), "x").join(s.select(F.col("fp_id").alias("y"), F.col("sigs").alias("ys")), "y")
    common = F.size(F.array_intersect("xs", "ys"))
    both = both.withColumn("likeness", common / (F.size("xs") + F.size("ys") - common)).where(F.col("likeness") >= t)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def near_classes(sigs: DataFrame, p: SpotParams = SpotParams()) -> tuple[DataFrame, DataFrame]:
    """(fp_id, sigs array<long>) to the classes of equal sets, (fp_id, class: the smallest id of the set), and near_pairs() between classes:
    copies are not expanded into pairs, however many there are. Empty sets are classes that are near nothing."""
    s = sigs.select("fp_id", F.sort_array(F.array_distinct("sigs")).alias("sigs"))
    one = materialise(s.groupBy(F.xxhash64("sigs").alias("h"), "sigs").agg(F.min("fp_id").alias("class")))
    members = s.withColumn("h", F.xxhash64("sigs")).join(one, ["h", "sigs"]).select("fp_id", "class")
    return members, near_pairs(one.select(F.col("class").alias("fp_id"), "sigs"), p)


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
