"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

Documents are sets of word shingles. Equal sets are one representative first. Every tree starts with all representatives in its root; a
node chooses, by a hash of its path, which minwise coordinates branch, and a representative goes to the child named by its minwise
token there. Nodes without two members end; small nodes are compared exhaustively on compact sketches; large ones branch
again. Trees are independent, so a pair at the threshold that one tree misses with probability q is missed by all with q^trees:
with two branches of the root q is 0.06 where its children are small, with eight trees 2e-10; where they are large and branch twice more
(once each, so that a document's rows don't multiply), q is 0.33 at most and the miss 2e-4, for a pair that no third document joins. Pairs that sketches let pass are confirmed on full sets.

First each cell (small node) gives a spanning forest of its passing pairs; the confirmed ones are joined. Nodes that stay large at the
last level hold documents that share most tokens; overlapping ones are one group, whose members are dealt into random cells beside a pivot.
Then what is still contested (members of cells with passing pairs between different components, and large groups with several
components) is gathered into clusters, each document once, and all members outside a cluster's main component meet all its members in
blocks, on full sets. So nothing is capped, no node's members meet in one task, and links inside a component are not listed.

Defined results: null, empty or blank text has an empty set (n_shingles 0) and links with nothing; its component is its own id. Texts below
the shingle's length are one shingle of all words. A row with a null id keeps a null component and is kept; it links no others.
Repeated rows each get a row; rows that repeat an id with other texts are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, map_rows, materialise, release, table

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    percent: int = 75  # of the union that must be shared
    trees: int = 8
    branches: int = 2  # coordinates that a root chooses; later nodes choose one
    coordinates: int = 128  # minwise tokens of a document; a byte of each is its sketch
    leaf: int = 64  # nodes up to this many members are compared exhaustively
    levels: int = 3  # the last level's larger nodes are groups
    deals: int = 4  # random cells that a group's member takes part in
    block: int = 192  # members, and outsiders, of a block
    sketch: int = 70  # equal bytes of 128 that let a pair pass: 0.75 less five standard deviations, and chance hits


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit shingle hashes of a text: differences of one running polynomial hash over its words joined by single spaces."""

    def __init__(self, width: int):
        self.width, self.up, self.down = width, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 8192)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK)]))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        width = min(self.width, len(words))
        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        n = len(data)
        self._powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=run[1:])
        gaps = np.flatnonzero(data == 32)
        start = np.concatenate([[0], gaps + 1])[: len(words) - width + 1]
        end = np.concatenate([gaps, [n]])[width - 1 :]
        whole = (run[end] - run[start]) * self.down[start]
        return np.unique(_mix(whole + _mix(end.astype(np.uint64) - start.astype(np.uint64)) + np.uint64(width)))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 32, n, dtype=np.uint32), draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def minwise(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each coordinate's permuted hashes; long sets in blocks."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        x = (low[at : at + 1024, None] ^ a) * b
        x ^= x >> np.uint32(15)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def describe(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """docs to (doc_id, text_hash, n_shingles, set_id: 16 bytes that name the set, sketch, roots: the keys of the root's children in all trees)."""

    def start():
        import hashlib

        shingle, (a, b) = Shingler(p.shingle), _coefficients(p.coordinates)
        chosen = root_choice(p)
        names = np.arange(chosen.size, dtype=np.uint64).reshape(chosen.shape)

        def rows_of(cols):
            for doc_id, name, text in zip(cols["doc_id"], cols["text_hash"], cols["text"]):
                h = shingle(text)
                if not len(h):
                    yield doc_id, name, 0, None, None, None
                    continue
                m = minwise(h, a, b)
                sketch = ((m * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
                keys = _mix((m[chosen].astype(np.uint64) << np.uint64(32)) + names).astype(np.int64)
                yield doc_id, name, len(h), hashlib.md5(h.tobytes()).digest(), sketch.tobytes(), keys.ravel().tolist()

        return rows_of

    ddl = "doc_id long, text_hash long, n_shingles long, set_id binary, sketch binary, roots array<long>"
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), start, ddl)


def root_choice(p: NearDupParams) -> np.ndarray:
    """Trees x branches: the coordinates that each root chooses."""
    draw = np.random.default_rng(7)
    return np.stack([draw.choice(p.coordinates, p.branches, replace=False) for _ in range(p.trees)])


def _branch(nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, rep, sketch) to the children's (key, rep, sketch): the path's hash chooses a coordinate, the sketch byte there names the child."""
    at = F.pmod(F.xxhash64("key"), F.lit(p.coordinates)).cast("int")
    return nodes.withColumn("key", F.xxhash64("key", F.substring(F.col("sketch"), at + 1, F.lit(1))))


def _counted(rows: DataFrame, total: int) -> DataFrame:
    """rows whose key occurs more than once, with its `count`. total: how many rows there are.

    Keys of more than a 10,000th of the rows, so fewer than 10,000, are broadcast: no task gets all rows of a hot key."""
    counts = materialise(rows.groupBy("key").count().where("count > 1"))
    most = max(1000, total // 10_000)
    marked = rows.join(F.broadcast(counts.where(F.col("count") > most)), "key", "left")
    other = marked.where("count is null").drop("count").join(counts.where(F.col("count") <= most).hint("merge"), "key")
    return marked.where("count is not null").unionByName(other)


def _by_cell(work, columns: list[str]):
    """Runs work(rows of one cell) over rows sorted by cell, across batches; work gives pairs as an array of two columns."""
    import pandas as pd

    def run(batches):
        held = None
        for last, pdf in _with_last(batches):
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            cell = pdf["cell"].to_numpy()
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1 if len(cell) else np.zeros(0, int)
            found, at = [], 0
            for end in [*cuts.tolist(), len(cell)] if last else cuts.tolist():
                if end - at > 1:
                    found.append(work(pdf.iloc[at:end]))
                at = end
            held = pdf.iloc[at:]
            both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pd.DataFrame({columns[0]: both[:, 0], columns[1]: both[:, 1]})

    return run


def _passing(rows, p: NearDupParams, comp: np.ndarray):
    """(i, j, equal bytes) of a cell's passing pairs of different components; i < j."""
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    out = []
    for i in range(len(rows) - 1):
        same = (sketch[i + 1 :] == sketch[i]).sum(axis=1)
        j = np.flatnonzero((same >= p.sketch) & (comp[i + 1 :] != comp[i]))
        if len(j):
            out.append(np.stack([np.full(len(j), i), j + i + 1, same[j]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


class _Joined:
    def __init__(self):
        self.root: dict = {}

    def find(self, x):
        while (up := self.root.get(x, x)) != x:
            self.root[x] = x = self.root.get(up, up)
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        return x != y


def _forest(p: NearDupParams):
    """A cell's spanning forest of passing pairs, by falling likeness."""

    def work(rows):
        rep = rows["rep"].to_numpy()
        found, joined = _passing(rows, p, rep), _Joined()
        kept = [(rep[i], rep[j]) for i, j, _ in found[np.argsort(-found[:, 2], kind="stable")].tolist() if joined.join(i, j)]
        return np.sort(np.array(kept, dtype=np.int64).reshape(-1, 2), axis=1)

    return _by_cell(work, ["a", "b"])


def _contested(p: NearDupParams):
    """(cell, rep) of the members with a passing pair to another component."""

    def work(rows):
        comp = rows["comp"].to_numpy()
        if (comp == comp[0]).all():
            return np.zeros((0, 2), np.int64)
        at = np.unique(_passing(rows, p, comp)[:, :2])
        return np.stack([rows["cell"].to_numpy()[at], rows["rep"].to_numpy()[at]], axis=1)

    return _by_cell(work, ["cell", "rep"])


def _full(p: NearDupParams):
    """Confirmed links between the outsiders (side 1) and the members (side 0) of a block, as many as join components.

    Shared shingles are counted for all pairs at once by products of membership matrices, in slices of columns."""
    shingle = Shingler(p.shingle)

    def work(rows):
        side, rep, comp = rows["side"].to_numpy(), rows["rep"].to_numpy(), rows["comp"].to_numpy()
        sets = [shingle(t) for t in rows["text"]]
        size = np.array([len(x) for x in sets])
        ids, which = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        twice = np.bincount(which, minlength=len(ids)) > 1
        column = np.cumsum(twice) - 1
        keep = twice[which]
        row, which = row[keep], column[which[keep]]
        outs, ins = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        shared = np.zeros((len(outs), len(ins)), dtype=np.float32)
        order = np.argsort(which, kind="stable")
        row, which = row[order], which[order]
        for at in range(0, int(twice.sum()), 4096):
            lo, hi = np.searchsorted(which, [at, at + 4096])
            m = np.zeros((len(sets), 4096), dtype=np.float32)
            m[row[lo:hi], which[lo:hi] - at] = 1.0
            shared += m[outs] @ m[ins].T
        shared = shared.astype(np.int64)  # counts are exact below 2^24; a hundred times one need not be
        total = size[outs][:, None] + size[ins][None, :] - shared
        i, j = np.nonzero((100 * shared >= p.percent * total) & (comp[outs][:, None] != comp[ins][None, :]))
        joined = _Joined()
        kept = [(rep[outs[x]], rep[ins[y]]) for x, y in zip(i.tolist(), j.tolist()) if joined.join(comp[outs[x]], comp[ins[y]])]
        return np.sort(np.array(kept, dtype=np.int64).reshape(-1, 2), axis=1)

    return _by_cell(work, ["a", "b"])


def _with_last(batches):
    before = None
    for b in batches:
        if before is not None:
            yield False, before
        before = b
    if before is not None:
        yield True, before


def _per_cell(cells: DataFrame, run, ddl: str) -> DataFrame:
    # no number of partitions: AQE joins small ones, as each task in Python has its price
    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, ddl).distinct()


def confirm(pairs: DataFrame, docs: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs of representatives (a, b) with the measured `shared` and `total` sizes. docs: (rep, text), a row for each representative named."""
    left = pairs.join(docs.withColumnsRenamed({"rep": "a", "text": "ta"}), "a")
    both = left.join(docs.withColumnsRenamed({"rep": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb").sortWithinPartitions("b")

    def start():
        shingle = Shingler(p.shingle)
        last: list = [None, None]

        def rows_of(cols):
            for a, b, ta, tb in zip(cols["a"], cols["b"], cols["ta"], cols["tb"]):
                if last[0] != b:
                    last[:] = [b, shingle(tb)]
                ha, hb = shingle(ta), last[1]
                shared = len(np.intersect1d(ha, hb, assume_unique=True))
                yield a, b, shared, len(ha) + len(hb) - shared

        return rows_of

    return map_rows(both, start, "a long, b long, shared long, total long")


def link(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id, text_hash, group: names the component, null for empty sets), a row for each row."""
    spark = docs.sparkSession
    described = materialise(describe(docs, p))
    some = described.where("set_id is not null and doc_id is not null")
    # a number for each distinct set; its smallest document stands for it
    reps = materialise(some.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("sketch", "roots"), "doc_id").alias("x")).select("set_id", "first", "x.sketch", "x.roots").withColumn("rep", F.xxhash64("set_id")))
    nodes = _counted(reps.select("rep", F.explode("roots").alias("key")), reps.count() * p.trees * p.branches)
    small, hot = [], None
    nodes = materialise(nodes.join(reps.select("rep", "sketch"), "rep").select("key", "rep", "sketch", "count"))
    for level in range(p.levels):
        small.append(nodes.where(F.col("count") <= p.leaf).select(F.col("key").alias("cell"), "rep", "sketch"))
        big = nodes.where(F.col("count") > p.leaf).drop("count")
        if not big.take(1):
            break
        if level == p.levels - 1:
            hot = _groups(big)
            break
        nodes = materialise(_counted(_branch(big, p), big.count()).select("key", "rep", "sketch", "count"))
    cells = small[0]
    for s in small[1:]:
        cells = cells.union(s)
    if hot is not None:
        cells = cells.union(_deal(hot, p))
    cells = materialise(cells)
    release(spark)
    pairs = materialise(_per_cell(cells, _forest(p), "a long, b long"))
    active = pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
    if hot is not None:
        active = active.union(hot.select("rep"))
    texts = _texts(docs, reps, active, p)
    links = materialise(confirm(pairs, texts, p).where(f"100 * shared >= {p.percent} * total").select("a", "b"))
    comp = materialise(components(links))
    contested = _per_cell(_coloured(cells, comp), _contested(p), "cell long, rep long")
    if hot is not None:
        contested = contested.union(hot.select("group", "rep"))
    contested = materialise(contested)
    if contested.take(1):
        more = materialise(_settle(contested, comp, texts, p))
        if more.take(1):
            comp = materialise(components(links.union(more)))
    release(spark)
    # component by set, then by document
    named = reps.select("set_id", "rep", "first").join(comp.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    by_set = named.join(smallest, "component").select("set_id", "smallest", F.col("component").alias("group"))
    out = described.select("doc_id", "text_hash", "n_shingles", "set_id").join(by_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id"), "text_hash", "group")


def _groups(big: DataFrame) -> DataFrame:
    """Large last-level nodes that share members are one group: (group, rep, sketch), each member once."""
    group = components(big.select(F.col("key").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("v", "rep")
    members = big.groupBy("rep").agg(F.first("sketch").alias("sketch"))
    return materialise(members.join(group, "rep").select(F.col("component").alias("group"), "rep", "sketch"))


def _deal(hot: DataFrame, p: NearDupParams) -> DataFrame:
    """Random cells of each group, each with the group's pivot: (cell, rep, sketch)."""
    size = hot.groupBy("group").agg(F.count("*").alias("m"), F.min("rep").alias("pivot"), F.min_by("sketch", "rep").alias("psketch"))
    size = materialise(size.withColumn("parts", F.expr(f"cast(ceil(m / {p.leaf}) as bigint)")))
    dealt = hot.join(size.select("group", "parts"), "group")
    mine = [dealt.select(F.xxhash64("group", F.lit(k), F.pmod(F.xxhash64("rep", F.lit(k)), F.col("parts"))).alias("cell"), "rep", "sketch") for k in range(p.deals)]
    for k in range(p.deals):
        each = size.withColumn("i", F.explode(F.expr("sequence(0L, parts - 1)")))
        mine.append(each.select(F.xxhash64("group", F.lit(k), "i").alias("cell"), F.col("pivot").alias("rep"), F.col("psketch").alias("sketch")))
    out = mine[0]
    for m in mine[1:]:
        out = out.union(m)
    return out.dropDuplicates(["cell", "rep"])


def _texts(docs: DataFrame, reps: DataFrame, active: DataFrame, p: NearDupParams) -> DataFrame:
    """(rep, text) of the representatives named in active: the text of a document whose set is the representative's."""
    wanted = reps.select("rep", "first", "set_id").join(active.distinct(), "rep", "left_semi")
    near = docs.select(F.col("doc_id").alias("first"), "text").join(wanted, "first")

    def start():
        import hashlib

        shingle = Shingler(p.shingle)
        # an id may be repeated with other texts: only the right set's text passes
        return lambda cols: ((r, t) for r, t, s in zip(cols["rep"], cols["text"], cols["set_id"]) if hashlib.md5(shingle(t).tobytes()).digest() == s)

    return materialise(map_rows(near.select("rep", "text", "set_id"), start, "rep long, text string").dropDuplicates(["rep"]))


def _coloured(cells: DataFrame, comp: DataFrame) -> DataFrame:
    return cells.join(comp.withColumnRenamed("v", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _settle(contested: DataFrame, comp: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """Links between components of contested documents: (cell, rep) rows make clusters, in which outsiders meet all members in blocks."""
    cluster = components(contested.select(F.col("cell").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("v", "rep")
    c = _coloured(contested.select("rep").distinct(), comp).join(cluster, "rep").withColumnRenamed("component", "cluster")
    c = materialise(c.select("cluster", "rep", "comp"))
    size = c.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    main = size.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("m"), F.max("n").alias("top")).where("top < m")
    j = materialise(c.join(main, "cluster"))
    nu, nm = F.expr(f"cast(ceil((m - top) / {p.block}) as bigint)"), F.expr(f"cast(ceil(m / {p.block}) as bigint)")
    h = F.xxhash64("rep", "cluster")
    members = j.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), nu - 1))).select(F.xxhash64("cluster", "i", F.pmod(h, nm)).alias("cell"), "rep", "comp", F.lit(0).alias("side"))
    outs = j.where("comp <> main").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), nm - 1))).select(F.xxhash64("cluster", F.pmod(h, nu), "i").alias("cell"), "rep", "comp", F.lit(1).alias("side"))
    return _per_cell(members.union(outs).join(texts, "rep"), _full(p), "a long, b long")


def _kept():
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    return link(docs.select("doc_id", "text"), p).select("doc_id", "n_shingles", "component_id", _kept())


def drop_near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """docs with one row for each group of near-duplicates: of the rows of its smallest id, that whose text has the smallest hash; exact
    repeats of that row go. Rows with a null id stay. All columns as they were, whatever their names."""
    rows = link(docs.select("doc_id", "text"), p)
    kept = rows.where(_kept() & F.col("doc_id").isNotNull()).groupBy("doc_id", F.coalesce("group", "text_hash").alias("group")).agg(F.min("text_hash").alias("text_hash"))
    tag = "__near"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    kept = kept.select(F.col("doc_id").alias(f"{tag}_id"), F.col("text_hash").alias(f"{tag}_text")).distinct()
    named = docs.where(docs["doc_id"].isNotNull()).withColumns({f"{tag}_id": docs["doc_id"], f"{tag}_text": F.xxhash64(docs["text"])})
    named = named.join(kept, [f"{tag}_id", f"{tag}_text"], "left_semi").dropDuplicates([f"{tag}_id", f"{tag}_text"]).select(*docs.columns)
    return named.unionByName(docs.where(docs["doc_id"].isNull()))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
