"""Operators over a column of bytes: headers, tables of contents, entropy-coded lines, trees and whole modular sub-streams.

decode operators take (id, bytes). A stream is sequential, so a row is one task's work; rows are independent. Queries write a table's values
into streams and read them back, so their SQL is the table itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.arrow import map_rows
from tessera.bitstream import blocks, entropy, headers, modular, profile, quant
from tessera.bitstream.bits import Bits, BitSink, pack_signed, unpack_signed
from tessera.sources import views

# headers


def file_headers(files: DataFrame) -> DataFrame:
    """(id, bytes) of bare streams to (id, width, height, orientation, bits, xyb, extra, animated, header_bytes)."""

    def rows_of(cols):
        for i, raw in zip(cols["id"], cols["bytes"]):
            b = Bits(raw)
            if raw[:2] != headers.SIGNATURE:
                raise ValueError("not a bare stream")
            b.skip(16)
            h = headers.read_file_header(b)
            yield i, h["width"], h["height"], h["orientation"], h["depth"]["bits"], h["xyb"], len(h["extra"]), h["animation"] is not None, b.at // 8

    return map_rows(files.select("id", "bytes"), rows_of, "id long, width int, height int, orientation int, bits int, xyb boolean, extra int, animated boolean, header_bytes int")


def frames(files: DataFrame) -> DataFrame:
    """(id, bytes) to a row for each section of the first frame: (id, frame sizes, section, kind, grp, pass, offset, length)."""

    def rows_of(cols):
        for i, raw in zip(cols["id"], cols["bytes"]):
            b = Bits(raw)
            b.skip(16)
            frame = headers.read_frame_header(b, headers.read_file_header(b))
            for section, offset, length in sorted(headers.read_contents(b, frame["sections"])):
                yield (i, frame["width"], frame["height"], *frame["blocks"], *frame["groups"], *frame["lf_groups"], section, *headers.section_kind(section, frame), offset, length)

    return map_rows(files.select("id", "bytes"), rows_of, "id long, width int, height int, blocks_x int, blocks_y int, groups_x int, groups_y int, lf_x int, lf_y int, section int, kind string, grp int, pass int, offset long, length long")


def _order(i: int, n: int) -> list[int] | None:
    """Every other file has its sections backwards."""
    return list(range(n))[::-1] if i % 2 else None


def _written(customers: DataFrame) -> DataFrame:
    """A file for each customer; its sizes follow from the key."""

    def rows_of(cols):
        for i in cols["c_custkey"]:
            s = BitSink()
            for byte in headers.SIGNATURE:
                s.write(8, byte)
            size = 64 + i * 37 % 1500, 16 + i * 91 % 1100
            headers.write_file_header(s, *size, 1 + i % 8, (8, 10, 12, 16)[i % 4], i % 3 == 0, i % 5 == 0, (100, 1) if i % 7 == 0 else None)
            b = Bits(s.bytes())
            b.skip(16)
            file = headers.read_file_header(b)
            headers.write_frame_header(s, file, passes=1 + i % 3)
            n = headers.read_frame_header(_at(s, b.at), file)["sections"]
            headers.write_contents(s, [i * (k + 1) % 3000 for k in range(n)], _order(i, n))
            yield i, s.bytes()

    return map_rows(customers.select("c_custkey"), rows_of, "id long, bytes binary")


def _at(s: BitSink, at: int) -> Bits:
    b = Bits(s.bytes())
    b.at = at
    return b


def s7_file_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_headers(_written(views.read(spark, sf_dir, "customer"))).drop("header_bytes")


def s8_frame_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(_written(views.read(spark, sf_dir, "customer"))).where("section = 0").select("id", "width", "height", "blocks_x", "blocks_y", "groups_x", "groups_y", "lf_x", "lf_y")


def s9_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(_written(views.read(spark, sf_dir, "customer"))).select("id", "section", "kind", "grp", "pass", "offset", "length")


_SIZES = "select c_custkey::bigint id, (64 + c_custkey*37 % 1500)::int width, (16 + c_custkey*91 % 1100)::int height from customer"
_FRAME = f"select *, ((width+7)//8)::int blocks_x, ((height+7)//8)::int blocks_y, ((width+255)//256)::int groups_x, ((height+255)//256)::int groups_y, ((width+2047)//2048)::int lf_x, ((height+2047)//2048)::int lf_y from ({_SIZES})"
_S9 = f"""with f as (select *, groups_x*groups_y n, lf_x*lf_y n_lf, 1 + id % 3 p from ({_FRAME})), g as (select *, case when n = 1 and p = 1 then 1 else 2 + n_lf + n*p end k from f),
s as (select *, unnest(range(0, k)) section from g), o as (select *, case when id % 2 = 1 then k-1-section else section end place from s), z as (select *, id*(place+1) % 3000 as length from o)
select id, section::int section, case when k = 1 then 'all' when section = 0 then 'lf_global' when section <= n_lf then 'lf' when section = n_lf+1 then 'hf_global' else 'hf' end kind,
(case when k = 1 or section = 0 then 0 when section <= n_lf then section-1 when section = n_lf+1 then 0 else (section-n_lf-2) % n end)::int grp, (case when k = 1 or section <= n_lf+1 then 0 else (section-n_lf-2) // n end)::int pass,
(sum(length) over (partition by id order by place) - length)::bigint as offset, length::bigint as length from z"""

# scalars


def e6_varint16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two codes of variable length for each order line."""

    def rows_of(cols):
        for k, line, a, c in zip(cols["k"], cols["l"], cols["c0"], cols["c1"]):
            s = BitSink()
            s.varint16(a)
            s.varint16(a * 1000 + c)
            b = Bits(s.bytes())
            yield k, line, b.varint16(), b.varint16(), b.at

    return map_rows(views.pix_i32(spark, sf_dir), rows_of, "k long, l int, a int, b int, bits int", 4096)





def e12_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected ranges, 64 bits, halves and strings, one behind the other in a row's bytes."""
    orders = views.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))

    def rows_of(cols):
        for k, c, text, cents in zip(cols["o_orderkey"], cols["o_custkey"], cols["o_orderpriority"], cols["cents"]):
            s, sides = BitSink(), ((9, 1), (13, 1), (18, 1), (30, 1))
            s.u32(c + 1, *sides)
            s.u64(cents * cents)
            s.f16(c % 2048 / 8)
            s.string(text)
            s.enum(k % 64)
            b = Bits(s.bytes())
            out = b.u32(*sides), b.u64(), b.f16(), b.string(), b.enum()
            b.check()
            yield k, *out

    return map_rows(orders, rows_of, "id long, key int, square long, half double, priority string, kind int", 4096)


# entropy-coded lines


def lines(plane: DataFrame) -> DataFrame:
    """(y, x, v) to (y, v array); a line has the plane's width."""
    return plane.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("s")).select("y", F.expr("transform(s, e -> e.v)").alias("v"))


def encode_lines(lines_: DataFrame, contexts: int = 1, **how) -> DataFrame:
    """(y, v array) to (y, n, bytes): a stream of its own for each line; a value's context follows from its place."""

    def rows_of(cols):
        for y, vs in zip(cols["y"], cols["v"]):
            s = BitSink()
            entropy.encode(s, [(x % contexts, pack_signed(v)) for x, v in enumerate(vs)], contexts, **how)
            yield y, len(vs), s.bytes()

    return map_rows(lines_, rows_of, "y int, n int, bytes binary")


def decode_lines(streams: DataFrame, contexts: int = 1, width: int = 0, resume: int = 0) -> DataFrame:
    """(y, n, bytes) to (y, x, v). resume: after so many symbols the reader goes on for a while, and then again from where it was, as if
    the bytes had ended there."""

    def rows_of(cols):
        for y, n, raw in zip(cols["y"], cols["n"], cols["bytes"]):
            b = Bits(raw)
            reader = entropy.Reader(entropy.Code.read_from(b, contexts), b, width)
            values = []
            for x in range(n):
                if resume and x and x % resume == 0:
                    at = reader.checkpoint()
                    for ahead in range(x, min(n, x + 5)):
                        reader.read(ahead % contexts)
                    reader.restore(at)
                values.append(unpack_signed(reader.read(x % contexts)))
            reader.finish()
            yield y, values

    return map_rows(streams, rows_of, "y int, v array<long>").select("y", F.posexplode("v").alias("x", "v"))


def _lines_query(contexts: int = 1, coarse: int = 1, resume: int = 0, **how):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        plane = views.plane_i32(spark, sf_dir)
        if coarse > 1:
            plane = plane.withColumn("v", F.expr(f"abs(v) div {coarse}"))
        return decode_lines(encode_lines(lines(plane), contexts, **how), contexts, resume=resume)

    return query


def _line_sql(coarse: int = 1) -> str:
    return f"select y, x, {'v' if coarse == 1 else f'abs(v)//{coarse}'} v from {{ints}}"


def e9_context_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty contexts whose clusters take more than three bits: an entropy-coded map, moved to the front."""
    return _lines_query(60, clusters=[x * 7 % 11 for x in range(60)])(spark, sf_dir)


def e11_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's ranks as a permutation in Lehmer's code, written, read and composed with itself."""

    def rows_of(cols):
        for y, vs in zip(cols["y"], cols["v"]):
            rank = [0] * len(vs)
            for place, x in enumerate(sorted(range(len(vs)), key=lambda x: (vs[x], x))):
                rank[x] = place
            s = BitSink()
            entropy.encode(s, entropy.permutation_values(rank), 8, prefix=False)
            b = Bits(s.bytes())
            reader = entropy.Reader(entropy.Code.read_from(b, 8), b)
            got = entropy.read_permutation(reader, len(rank))
            reader.finish()
            yield y, got, entropy.compose(got, got)

    out = map_rows(lines(views.plane_i32(spark, sf_dir)), rows_of, "y int, rank array<int>, twice array<int>")
    return out.select("y", F.posexplode(F.arrays_zip("rank", "twice")).alias("x", "r")).select("y", "x", "r.rank", "r.twice")


_E11 = "with r as (select y, x, (row_number() over (partition by y order by v, x) - 1)::int rank from {ints}) select a.y, a.x, a.rank, b.rank twice from r a join r b on b.y = a.y and b.x = a.rank"

# modular sub-streams

N = modular.Node
#: Splits on channel, row, neighbours, the self-correcting predictor's error and another channel; leaves with many predictors.
TREE = [
    N(0, 0, 1, 2), N(9, 900, 3, 4), N(15, 40, 5, 6), N(2, 7, 7, 8), N(19, 3, 9, 10), N(predictor=5, context=0), N(14, -20, 11, 12), N(predictor=6, context=1), N(predictor=4, offset=2, context=2),
    N(predictor=13, context=3), N(predictor=1, context=4), N(predictor=6, context=5), N(predictor=12, offset=-1, context=6),
]


def images(plane: DataFrame, rows: int = 16) -> DataFrame:
    """(y, x, v) to (id, v array): bands of rows as images, one array in raster order."""
    band = plane.groupBy(F.expr(f"y div {rows}").cast("int").alias("id")).agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    return band.select("id", F.expr("transform(s, e -> e.v)").alias("v"))


def three(v: np.ndarray) -> list[np.ndarray]:
    """Channels from a plane: itself, a remainder, a quotient."""
    return [v, np.abs(v) % 97, np.abs(v) // 7]


def encode_images(bands: DataFrame, width: int, tree: list, transforms: list, channels=three, **how) -> DataFrame:
    """(id, v array) to (id, h, n, bytes): the last row is filled up with zeros, n samples are the image's own."""

    def rows_of(cols):
        for i, vs in zip(cols["id"], cols["v"]):
            v = np.array(vs, np.int64)
            v = np.pad(v, (0, -len(v) % width)).reshape(-1, width)
            s = BitSink()
            arrays = channels(v)
            modular.encode_stream(s, arrays, tree, transforms(arrays) if callable(transforms) else transforms, **how)
            yield i, len(v), len(vs), s.bytes()

    return map_rows(bands, rows_of, "id int, h int, n int, bytes binary", 8)


def decode_images(streams: DataFrame, width: int, n: int = 3, bits: int = 16) -> DataFrame:
    """(id, h, n, bytes) of modular sub-streams to (id, y, x, c0, ...)."""

    def rows_of(cols):
        for i, h, count, raw in zip(cols["id"], cols["h"], cols["n"], cols["bytes"]):
            b = Bits(raw)
            yield i, *[c.ravel()[:count].tolist() for c in modular.decode_stream(b, [(h, width)] * n, bits)]
            b.check()

    names = [f"c{k}" for k in range(n)]
    out = map_rows(streams, rows_of, "id int, " + ", ".join(f"{c} array<long>" for c in names), 8)
    out = out.select("id", F.posexplode(F.arrays_zip(*names)).alias("at", "e"))
    return out.select("id", F.expr(f"cast(at div {width} as int)").alias("y"), (F.col("at") % width).cast("int").alias("x"), *[F.col(f"e.{c}") for c in names])


def _images_query(transforms=(), tree=TREE, channels=three, n: int = 3, **how):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decode_images(encode_images(images(views.plane_i32(spark, sf_dir)), views.WIDTH, tree, transforms if callable(transforms) else list(transforms), channels, **how), views.WIDTH, n)

    return query


_THREE = "select y//16 id, y % 16 y, x, v c0, abs(v) % 97 c1, abs(v)//7 c2 from {ints}"


def _palette(arrays: list[np.ndarray]) -> list:
    n = len(np.unique(np.stack([a.ravel() for a in arrays]), axis=1)[0])
    return [modular.Transform("palette", 0, len(arrays), 0, n)]


def coarse(v: np.ndarray) -> list[np.ndarray]:
    return [np.abs(v) // 500, np.abs(v) % 3]


def m7_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each band, whose splits follow from its first values, written and read with its checks: its nodes."""

    def rows_of(cols):
        for i, vs in zip(cols["id"], cols["v"]):
            a, c = vs[0] % 50, vs[-1] % 50
            tree = [N(4, a + 60, 1, 2), N(4, a + c + 61, 3, 4), N(predictor=5, factor=3, context=0), N(predictor=1, offset=a, context=1), N(predictor=13, factor=8, context=2)]
            s = BitSink()
            modular.write_tree(s, tree)
            for k, n in enumerate(modular.read_tree(Bits(s.bytes()))):
                yield i, k, n.property, n.value, n.predictor, n.offset, n.factor

    return map_rows(images(views.plane_i32(spark, sf_dir)), rows_of, "id int, node int, property int, value long, predictor int, offset long, factor long")


_M7 = """with e as (select y//16 id, arg_min(v, y*64+x) a, arg_max(v, y*64+x) c from {ints} group by 1), m as (select id, ((a % 50) + 50) % 50 a, ((c % 50) + 50) % 50 c from e)
select id, 0 node, 4 property, a+60 as value, 0 predictor, 0 as offset, 1 factor from m union all select id, 1, 4, a+c+61, 0, 0, 1 from m union all select id, 2, -1, 0, 5, 0, 3 from m union all select id, 3, -1, 0, 1, a, 1 from m union all select id, 4, -1, 0, 13, 0, 8 from m"""


def m11_specialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree for each channel: what is left of it, and of which kind it is."""

    def rows_of(cols):
        for i in cols["id"]:
            for channel in range(3):
                tree = modular.pruned(TREE, channel, int(i))
                yield i, channel, len(tree), modular.kind_of(tree)

    return map_rows(images(views.plane_i32(spark, sf_dir)).select("id"), rows_of, "id int, channel int, nodes int, kind string")


_M11 = "select distinct y//16 id, c.channel, c.nodes, c.kind from {ints}, (values (0, 5, 'general'), (1, 7, 'general'), (2, 7, 'general')) c(channel, nodes, kind)"


def m19_squeeze_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default squeezes of an image of each customer's size, and the channels that they leave."""

    def rows_of(cols):
        for i in cols["c_custkey"]:
            w, h = 1 + i * 37 % 1500, 1 + i * 91 % 1100
            channels, plan = modular.planned([modular.Channel(np.broadcast_to(np.int64(0), (h, w)))], [modular.Transform("squeeze")])
            yield i, w, h, len(plan[0].steps), channels[0].size[1], channels[0].size[0], len(channels), sum(c.size[0] * c.size[1] for c in channels)

    return map_rows(views.read(spark, sf_dir, "customer").select("c_custkey"), rows_of, "id long, w int, h int, steps int, first_w int, first_h int, channels int, samples long")


# a side is halved, rounding up, until eight are left
_M19 = """with recursive s as (select c_custkey id, (1 + c_custkey*37 % 1500)::int w, (1 + c_custkey*91 % 1100)::int h from customer),
a(id, n, k) as (select id, w, 0 from s union all select id, (n+1)//2, k+1 from a where n > 8), b(id, n, k) as (select id, h, 0 from s union all select id, (n+1)//2, k+1 from b where n > 8),
x as (select id, min(n) n, max(k) k from a group by id), y as (select id, min(n) n, max(k) k from b group by id)
select s.id, w, h, (x.k+y.k)::int steps, x.n::int first_w, y.n::int first_h, (1+x.k+y.k)::int channels, w::bigint*h samples from s join x on x.id = s.id join y on y.id = s.id"""


def m16_delta_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of each line's first differences as the first entries of a palette, undone by the west predictor; the rest plain colours."""

    def rows_of(cols):
        for y, vs in zip(cols["y"], cols["v"]):
            v = np.array(vs, np.int64) % 8
            d = np.diff(v, prepend=0)
            t = modular.Transform("palette", 0, 1, 0, 15, 15, 1)
            table = np.arange(-7, 8)[None]
            got = modular.undo_palette(table, modular.Channel((d + 7)[None]), t, 8, modular.Weights())[0].v[0]
            yield y, got.tolist()

    out = map_rows(lines(views.plane_i32(spark, sf_dir)), rows_of, "y int, v array<long>")
    return out.select("y", F.posexplode("v").alias("x", "v"))


def m15_negative_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers as negative indices of an empty palette of three colours, at 10 bits."""

    def rows_of(cols):
        index = modular.Channel(-1 - np.array(cols["c"], np.int64)[None])
        three = modular.undo_palette(np.zeros((3, 0), np.int64), index, modular.Transform("palette"), 10, modular.Weights())
        yield from zip(cols["k"], *[c.v[0].tolist() for c in three])

    orders = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return map_rows(orders, rows_of, "k long, r long, g long, b long", 4096)


def s11_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names, many times over, as profiles that go through a stream."""

    def rows_of(cols):
        for i, icc in zip(cols["id"], cols["icc"]):
            s = BitSink()
            profile.write_profile(s, bytes(icc), i % 2 == 0)
            yield i, profile.read_profile(Bits(s.bytes()))

    named = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("cast(repeat(s_name, cast(s_suppkey % 20 as int)) as binary)").alias("icc"))
    return map_rows(named, rows_of, "id long, icc binary").select("id", F.length("icc").cast("long").alias("n_bytes"), F.sha2("icc", 256).alias("sha256"))


def v3_block_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of 2x3 blocks for each customer: five or six special ones, or a large one and two."""

    def rows_of(cols):
        for i in cols["c_custkey"]:
            kinds = [blocks.KINDS[12 + (i + j) % 6] for j in range(6)] if i % 2 else ["dct16x16", "corner1", "dct4x4"]
            where = blocks.placed(kinds, 2, 3)
            given = [(y, x, k, 1 + (i * 7 + j) % 256) for j, ((y, x), k) in enumerate(zip(where, kinds))]
            s = BitSink()
            blocks.write_map(s, blocks.BlockMap(given, np.arange(6).reshape(2, 3) + i % 3, np.array([[i % 300 - 150]]), np.array([[i % 5]])))
            m = blocks.read_map(Bits(s.bytes()), 2, 3)
            for y, x, kind, q in m.blocks:
                yield i, y, x, kind, q, int(m.sharpness[y, x]), int(m.x_from_y[0, 0]), int(m.b_from_y[0, 0])

    return map_rows(views.read(spark, sf_dir, "customer").select("c_custkey"), rows_of, "id long, y int, x int, kind string, quant int, sharpness int, x_from_y int, b_from_y int")


_V3 = """with odd as (select c_custkey i, j.j, j.j // 3 y, j.j % 3 x, ['dct4x8', 'dct8x4', 'corner0', 'corner1', 'corner2', 'corner3'][1 + (c_custkey + j.j) % 6] kind from customer, range(0, 6) j(j) where c_custkey % 2 = 1),
even as (select c_custkey i, j.j, case when j.j = 2 then 1 else 0 end y, case when j.j = 0 then 0 else 2 end x, ['dct16x16', 'corner1', 'dct4x4'][1 + j.j] kind from customer, range(0, 3) j(j) where c_custkey % 2 = 0)
select i::bigint id, y::int y, x::int x, kind, (1 + (i*7 + j) % 256)::int quant, (y*3 + x + i % 3)::int sharpness, greatest(-128, least(127, i % 300 - 150))::int x_from_y, (i % 5)::int b_from_y from (select * from odd union all select * from even)"""


def v7_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a group of three blocks that differ in kind, its values in steps of 1/4, 1/8 and 1/12 in the three channels; groups
    of a batch share their distributions."""
    kinds = ["dct8x8", "corner3", "dct4x8"]

    def rows_of(cols):
        row = [(0, j, k, 1 + 9 * j) for j, k in enumerate(kinds)]
        values = [[np.trunc(np.outer([4, 8, 12], e)).astype(np.int64) * (j + 1) for j in range(3)] for e in cols["embedding"]]
        s = BitSink()
        groups = blocks.write_coefficients(s, [(v, row) for v in values], 1, 3)
        code = entropy.Code.read_from(Bits(s.bytes()), blocks.Contexts().total)
        for i, group in zip(cols["vec_id"], groups):
            for j, got in enumerate(blocks.read_coefficients(Bits(group), code, row, 1, 3)):
                yield i, kinds[j], got[0].tolist(), got[1].tolist(), got[2].tolist()

    e = views.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = map_rows(e, rows_of, "id long, kind string, x array<long>, y array<long>, b array<long>")
    return out.select("id", "kind", F.posexplode(F.arrays_zip("x", "y", "b")).alias("k", "v")).select("id", "kind", "k", "v.x", "v.y", "v.b")


# the lowest coefficient of a block comes from elsewhere
_V7 = """select vec_id::bigint id, ['dct8x8', 'corner3', 'dct4x8'][j.j + 1] kind, k.k::int k, case when k.k = 0 then 0 else trunc(embedding[k.k+1]::double*4)*(j.j+1) end::bigint x,
case when k.k = 0 then 0 else trunc(embedding[k.k+1]::double*8)*(j.j+1) end::bigint y, case when k.k = 0 then 0 else trunc(embedding[k.k+1]::double*12)*(j.j+1) end::bigint b from embeddings, range(0, 64) k(k), range(0, 3) j(j)"""


def v9_quant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse weights of the default tables that follow distance bands, at most 64 a side, by way of their written form."""

    def rows_of(cols):
        for n in cols["id"]:
            kind = list(quant.SIZES)[n]
            s = BitSink()
            quant.write_encoding(s, quant.Encoding("default"))
            w = quant.weights(quant.read_encoding(Bits(s.bytes()), kind), kind)
            for c in range(3):
                yield kind, c, (1000 / w[c]).ravel().tolist()

    small = [n for n, (k, size) in enumerate(quant.SIZES.items()) if quant.default(k).mode == "bands" and max(size) <= 64]
    ids = spark.range(len(quant.SIZES)).where(F.col("id").isin(small))
    return map_rows(ids, rows_of, "kind string, channel int, w array<double>").select("kind", "channel", F.posexplode("w").alias("k", "v")).select("kind", "channel", "k", F.round("v", 6).alias("per_mille"))


def _v9_sql() -> str:
    """Levels by running products of the steps, then the definition of the interpolation."""
    given = [(k, *quant.SIZES[k], c, n, v) for k in quant.SIZES if quant.default(k).mode == "bands" and max(quant.SIZES[k]) <= 64 for c, row in enumerate(quant.default(k).bands.tolist()) for n, v in enumerate(row)]
    rows = ", ".join(f"('{k}', {h}, {w}, {c}, {n}, {v!r}e0)" for k, h, w, c, n, v in given)
    return f"""with p(kind, h, w, c, n, v) as (values {rows}), l as (select *, product(case when n = 0 then v when v > 0 then 1e0+v else 1e0/(1e0-v) end) over (partition by kind, c order by n) a, max(n) over (partition by kind) top from p),
cells as (select kind, h, w, c, top, k.k from l, range(0, 4096) k(k) where n = 0 and k.k < h*w), d as (select *, sqrt(((k//w)*1e0/(h-1))**2 + ((k%w)*1e0/(w-1))**2)*top/(sqrt(2e0)+1e-6) s from cells)
select d.kind, d.c::int channel, k::int k, round(1000e0/(i.a*pow(j.a/i.a, s-floor(s))), 6) per_mille from d join l i on i.kind = d.kind and i.c = d.c and i.n = floor(s)::int join l j on j.kind = d.kind and j.c = d.c and j.n = floor(s)::int+1"""


# every difference appears negated, then as it is; four times as large at 10 bits
_M15 = "with d as (values " + ", ".join(f"({n}, {r}, {g}, {b})" for n, (r, g, b) in enumerate(modular.DELTAS.tolist())) + """),
o as (select o_orderkey k, (o_custkey % 143)::int t from orders), q as (select k, (t + 1)//2 n, case when t % 2 = 1 then 4 else -4 end f from o)
select k, (col1*f)::bigint r, (col2*f)::bigint g, (col3*f)::bigint b from q join d on d.col0 = n"""


QUERIES = {
    "s7_file_header": s7_file_header,
    "s8_frame_header": s8_frame_header,
    "s9_contents": s9_contents,
    "e1_code_sets": _lines_query(4, clusters=[0, 1, 1, 2]),
    "e2_prefix_codes": _lines_query(),
    "e3_alias_codes": _lines_query(prefix=False),
    "e6_varint16": e6_varint16,
    "e7_copies": _lines_query(coarse=3000, copies=(224, 3)),
    "e8_repeats": _lines_query(coarse=3000, prefix=False, copies=(224, 3), only_repeats=True),
    "e9_context_maps": e9_context_maps,
    "e10_resumed": _lines_query(2, resume=9, prefix=False, clusters=[0, 1]),
    "e11_permutations": e11_permutations,
    "e12_scalars": e12_scalars,
    "m5_self_correcting": _images_query(tree=[N(predictor=6)]),
    "m7_trees": m7_trees,
    "m10_channels": _images_query(),
    "m11_specialised": m11_specialised,
    "m12_sub_streams": _images_query([modular.Transform("rct", 0, 3, 6), modular.Transform("squeeze")], prefix=False, tree=[N(predictor=5)]),
    "m15_negative_indices": m15_negative_indices,
    "s11_profiles": s11_profiles,
    "v3_block_maps": v3_block_maps,
    "v7_coefficients": v7_coefficients,
    "v9_quant_tables": v9_quant_tables,
    "m16_delta_palette": m16_delta_palette,
    "m19_squeeze_plan": m19_squeeze_plan,
    "m20_transform_plan": _images_query(_palette, channels=coarse, n=2),
}
_ORACLES = {
    "s7_file_header": f"select id, width, height, (1 + id % 8)::int orientation, case id % 4 when 0 then 8 when 1 then 10 when 2 then 12 else 16 end bits, id % 3 = 0 xyb, (id % 5 = 0)::int extra, id % 7 = 0 animated from ({_SIZES})",
    "s8_frame_header": _FRAME,
    "s9_contents": _S9,
    "e1_code_sets": _line_sql(),
    "e2_prefix_codes": _line_sql(),
    "e3_alias_codes": _line_sql(),
    "e6_varint16": "select k, l, c0::int a, (c0*1000+c1)::int b, ((case when c0 = 0 then 1 else 4 + length(bin(c0)) end) + (case when c0*1000+c1 = 0 then 1 else 4 + length(bin(c0*1000+c1)) end))::int bits from {pix}",
    "e7_copies": _line_sql(3000),
    "e8_repeats": _line_sql(3000),
    "e9_context_maps": _line_sql(),
    "e10_resumed": _line_sql(),
    "e11_permutations": _E11,
    "e12_scalars": "with o as (select *, round(o_totalprice*100)::bigint cents from orders) select o_orderkey id, (o_custkey+1)::int as key, cents*cents square, (o_custkey % 2048)/8e0 half, o_orderpriority priority, (o_orderkey % 64)::int kind from o",
    "m5_self_correcting": _THREE,
    "m7_trees": _M7,
    "m10_channels": _THREE,
    "m11_specialised": _M11,
    "m12_sub_streams": _THREE,
    "m15_negative_indices": _M15,
    "s11_profiles": "select s_suppkey::bigint id, length(r)::bigint n_bytes, sha256(r) sha256 from (select s_suppkey, repeat(s_name, s_suppkey % 20) r from supplier)",
    "v3_block_maps": _V3,
    "v7_coefficients": _V7,
    "v9_quant_tables": _v9_sql(),
    "m16_delta_palette": "select y, x, ((v % 8) + 8) % 8 v from {ints}",
    "m19_squeeze_plan": _M19,
    "m20_transform_plan": "select y//16 id, y % 16 y, x, abs(v)//500 c0, abs(v) % 3 c1 from {ints}",
}


def _filled(sql: str) -> str:
    for n in ("ints", "pix"):
        sql = sql.replace("{" + n + "}", f"({views.VIEWS[n].duck})")
    return sql


ORACLE_SQL = {k: _filled(q) for k, q in _ORACLES.items()}
