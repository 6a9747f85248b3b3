"""Mixing sources to target weights by hierarchical budgeting. Native: DataFrame functions only.

A tree domain - language - source carries integer weights. The token budget is propagated from the root: each child gets its weight's
share, but no more than its subtree can give (tokens x max_epochs). What a child cannot take goes to its siblings in proportion
(water-filling); only what the siblings cannot take either leaves the parent's subtree, as the parent's own capacity was lower.
Each leaf then takes floor(budget / tokens) whole epochs and, in one more seeded epoch, the prefix of documents whose tokens fit.

Defined results: null text has 0 tokens; null lang or source is the group `(none)`; a null id counts as -1 in the seeded order. Rows equal
in the order key stand or fall together. Documents without tokens are taken in every epoch that reaches them. Empty tables give
empty results. A floor at each node leaves at most one token for each child unspent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialise, table

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixParams:
    seed: int = 11
    max_epochs: int = 2
    percent: int = 60  # budget, of all tokens
    domains: int = 4  # a source belongs to the domain of its hash modulo this
    weights: dict = field(default_factory=lambda: {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 1}})
    default_weight: int = 2


def _hash32(text):
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def tag_for(docs: DataFrame) -> str:
    """A prefix that no column of docs has: `__`, with as many more as it takes."""
    tag = "__"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    return tag


def keyed(docs: DataFrame, p: MixParams, tag: str) -> DataFrame:
    """Adds the columns domain, lang, source, tokens, id, each behind the tag."""
    source = F.coalesce(docs["source"], F.lit("(none)"))
    return docs.withColumns(
        {
            f"{tag}domain": F.concat(F.lit("d"), (_hash32(source) % p.domains).cast("string")),
            f"{tag}lang": F.coalesce(docs["lang"], F.lit("(none)")),
            f"{tag}source": source,
            f"{tag}tokens": F.coalesce(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
            f"{tag}id": F.coalesce(docs["doc_id"], F.lit(-1)),
        }
    )


def _weight(level: str, p: MixParams):
    w = F.lit(p.default_weight)
    for name, value in p.weights.get(level, {}).items():
        w = F.when(F.col(f"__{level}") == name, F.lit(value)).otherwise(w)
    return w.cast("long")


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Weighted water-filling of `budget` (on each row, the parent's) among children of (cap, w); gives `share`.

    Children are taken by cap / w. The leading ones that their share would overfill are capped; the rest split what is left by weight."""
    order = [(F.col("cap") / F.col("w")).asc(), F.col(name).asc()]
    over = Window.partitionBy(*parent)
    upto = over.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    c = children.withColumns({"w_all": F.sum("w").over(over), "w_before": F.coalesce(F.sum("w").over(upto), F.lit(0)), "cap_before": F.coalesce(F.sum("cap").over(upto), F.lit(0))})
    c = c.withColumns({"rest": F.col("budget") - F.col("cap_before"), "w_rest": F.col("w_all") - F.col("w_before")})
    c = c.withColumn("full", F.expr("cast(cap as decimal(38,0)) * w_rest <= cast(w as decimal(38,0)) * rest"))
    c = c.withColumns({"w_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(over), F.lit(0)), "cap_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(over), F.lit(0))})
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(cast(w as decimal(38,0)) * (budget - cap_full) div (w_all - w_full) as bigint)"))
    return c.withColumn("share", share).drop("w_all", "w_before", "cap_before", "rest", "w_rest", "full", "w_full", "cap_full")


def budgets(leaves: DataFrame, p: MixParams) -> DataFrame:
    """leaves: (__domain, __lang, __source, docs, tokens), one row for each leaf; adds `budget`."""
    caps = leaves.withColumn("cap", F.col("tokens") * p.max_epochs)
    node = caps.agg(F.expr(f"cast(sum(tokens) as bigint) * {p.percent} div 100").alias("budget")).withColumn("__root", F.lit(0))
    path = ["__root"]
    caps = caps.withColumn("__root", F.lit(0))
    for level in LEVELS:
        name = f"__{level}"
        children = caps.groupBy(*path, name).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, p))
        node = _fill(children.join(node, path), path, name).select(*path, name, F.col("share").alias("budget"))
        path = [*path, name]
    return leaves.join(node.drop("__root"), path[1:])


def _order(p: MixParams, epoch, key: str = "__id"):
    """A document's 32-bit place in an epoch."""
    return _hash32(F.concat_ws(":", F.lit(str(p.seed)), epoch.cast("string"), F.col(key).cast("string")))


def plan(docs: DataFrame, p: MixParams) -> DataFrame:
    """docs with the keyed() columns to a row for each leaf: __domain, __lang, __source, docs, tokens, budget, whole (epochs),
    last_h and last_id (the order key of the last document of the partial epoch; null: none).

    The partial epoch's prefix is found in two steps, so no leaf's documents meet in one task: token sums of about sqrt(docs)
    ranges of the order give the range where the budget ends; only that range's documents are put in order."""
    path = [f"__{x}" for x in LEVELS]
    leaves = docs.groupBy(*path).agg(F.count("*").alias("docs"), F.sum("__tokens").alias("tokens"))
    b = budgets(leaves, p).withColumn("whole", F.expr("case when tokens > 0 then least(budget div tokens, %d) else 0 end" % p.max_epochs))
    b = materialise(b.withColumns({"rest": F.when(F.col("whole") < p.max_epochs, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(F.lit(-1)), "ranges": F.ceil(F.sqrt("docs"))}))
    d = join_checked(docs.select(*path, "__tokens", "__id"), b.select(*path, "whole", "rest", "ranges"), path).where("rest >= 0")
    d = d.withColumn("h", _order(p, F.col("whole"))).withColumn("range", F.expr("h * ranges div 4294967296"))
    sums = d.groupBy(*path, "range", "rest").agg(F.sum("__tokens").alias("t"))
    ends = sums.withColumn("upto", F.sum("t").over(Window.partitionBy(*path).orderBy("range")))
    edge = ends.groupBy(*path).agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("range", (F.col("upto") - F.col("t")).alias("before")))).alias("e"))
    edge = materialise(edge.select(*path, F.col("e.range").alias("range"), F.col("e.before").alias("before")))
    inside = join_checked(d, edge.where("range is not null").withColumnRenamed("range", "edge"), path)
    edge_rows = inside.where("range = edge").groupBy(*path, "range", "rest", "before", "h", "__id").agg(F.sum("__tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy(*path, "range").orderBy("h", "__id").rowsBetween(Window.unboundedPreceding, 0))
    last_in = edge_rows.withColumn("run", F.col("before") + run).where("run <= rest").groupBy(*path).agg(F.max(F.struct("h", "__id")).alias("k"))
    last_before = inside.where("range < edge").groupBy(*path).agg(F.max(F.struct("h", "__id")).alias("k"))
    whole_leaf = join_checked(d, edge.where("range is null").select(*path), path).groupBy(*path).agg(F.max(F.struct("h", "__id")).alias("k"))
    last = last_in.unionByName(last_before).unionByName(whole_leaf).groupBy(*path).agg(F.max("k").alias("k"))
    return b.join(last, path, "left").select(*path, "docs", "tokens", "budget", "whole", F.col("k.h").alias("last_h"), F.col("k.__id").alias("last_id"))


def pick(docs: DataFrame, leaf: DataFrame, p: MixParams, tag: str) -> DataFrame:
    """docs with keyed()'s columns to a row for each epoch in which a document is taken (column epoch behind the tag). leaf: of plan()."""
    path = [f"{tag}{x}" for x in LEVELS]
    limits = leaf.select(*[F.col(f"__{x}").alias(f"{tag}{x}") for x in LEVELS], *[F.col(x).alias(f"{tag}{x}") for x in ("whole", "last_h", "last_id")])
    whole, last_h, last_id = (F.col(f"{tag}{x}") for x in ("whole", "last_h", "last_id"))
    out = join_checked(docs, limits, path)
    h = _order(p, whole, f"{tag}id")
    partial = F.coalesce((h < last_h) | ((h == last_h) & (F.col(f"{tag}id") <= last_id)), F.lit(False))
    out = out.withColumn(f"{tag}epochs", whole.cast("int") + partial.cast("int")).where(F.col(f"{tag}epochs") > 0)
    out = out.withColumn(f"{tag}epoch", F.explode(F.sequence(F.lit(0), F.col(f"{tag}epochs") - 1)))
    return out.drop(*[f"{tag}{x}" for x in ("id", "whole", "last_h", "last_id", "epochs")])


def select(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """All columns of docs, a row for each epoch in which a document is taken, with the columns domain, lang, source, tokens and epoch behind
    `__` (or a longer tag where docs has such names)."""
    tag = tag_for(docs)
    k = materialise(keyed(docs.select("doc_id", "text", "lang", "source"), p, "__").select("__domain", "__lang", "__source", "__tokens", "__id"))
    return pick(keyed(docs, p, tag), materialise(plan(k, p)), p, tag)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, docs = MixParams(), table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    k = materialise(keyed(docs, p, "__").drop("text", "lang", "source"))  # texts are read once
    out = pick(k, materialise(plan(k, p)), p, "__")
    return out.select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("__epoch").alias("epoch"))
