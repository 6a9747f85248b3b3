"""Every plane query against its SQL on the smallest tables; known vectors; the planner; sinks."""

import struct
import zlib

import numpy as np
import pytest

from tessera.functions import transfer as t
from tessera.operators import colour, compose, modular, stencil, vardct
from tessera.plans import pipeline
from tessera.queries import ORACLE_SQL, QUERIES, flagship
from tessera.sources import container, sinks
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert same(spark, con, QUERIES[name], ORACLE_SQL[name], SF) == ""


def test_flagship_has_rows(spark):
    assert flagship(spark, SF).count() == 63


def _value(con, expr):
    return con.execute(f"select {expr}").fetchone()[0]


@pytest.mark.parametrize(
    "cb, y, cr, rgb",
    [(-0.16873589, -0.20296079, 0.5, (1, 0, 0)), (-0.3312641, 0.08503921, -0.41868758, (0, 1, 0)), (0.5, -0.3879608, -0.08131241, (0, 0, 1))],
)
def test_ycbcr_unit_vectors(con, cb, y, cr, rgb):
    got = [_value(con, e) for e in t.ycbcr_to_rgb(f"({cb}e0)", f"({y}e0)", f"({cr}e0)")]
    assert np.allclose(got, rgb, atol=1e-6)


@pytest.mark.parametrize(
    "x, y, b, rgb",
    [(0.028100073, 0.4881882, 0.471659, (1, 0, 0)), (-0.015386105, 0.71478134, 0.43707693, (0, 1, 0)), (0.0, 0.2781282, 0.66613984, (0, 0, 1))],
)
def test_xyb_unit_vectors(con, x, y, b, rgb):
    got = [_value(con, e) for e in t.xyb_to_linear(f"({x}e0)", f"({y}e0)", f"({b}e0)")]
    assert np.allclose(got, rgb, atol=2e-6)


def test_transfer_functions_invert(con):
    for f, g in ((t.srgb, t.srgb_inverse), (t.bt709, t.bt709_inverse), (t.pq, t.pq_inverse), (t.hlg, t.hlg_inverse)):
        for v in (-0.7, 0.0, 0.001, 0.3, 1.0):
            assert abs(_value(con, g(f"({f(f'({v}e0)')})")) - v) < 2e-3 * (abs(v) < 0.01) + 1e-6


def test_sdr_white(con):
    assert abs(_value(con, t.pq("(0.203e0)", 1000)) - 0.58) < 1e-3
    assert abs(_value(con, t.hlg("(0.265e0)")) - 0.75) < 2e-3


def test_gaborish_vector(spark):
    plane = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0)], "y int, x int, v double")
    got = {(r.y, r.x): r.v for r in stencil.OPERATORS["p6_gaborish"].apply(spark, plane=plane).collect()}
    assert np.allclose([got[0, 0], got[0, 1]], [0.20686, 0.79314], atol=1e-5)


def test_stencils_of_constant_planes(spark):
    plane = spark.createDataFrame([(y, x, 0.25) for y in range(7) for x in range(5)], "y int, x int, v double")
    for name in ("p4_chroma_up_x", "p5_chroma_up_y", "p6_gaborish", "p12_upsample2"):
        assert {round(r.v, 5) for r in stencil.OPERATORS[name].apply(spark, plane=plane).collect()} == {0.25}
    assert {r.v for r in stencil.OPERATORS["p19_convolve_noise"].apply(spark, plane=plane).collect()} == {0.0}


def test_upsampling_equals_numpy(spark):
    v = np.random.default_rng(1).random((6, 9))
    plane = spark.createDataFrame([(y, x, float(v[y, x])) for y in range(6) for x in range(9)], "y int, x int, v double")
    p = np.pad(v, 2, mode="symmetric")
    for n, weights in ((2, stencil.UP2), (4, stencil.UP4)):
        side = 5 * n // 2
        rows = stencil.OPERATORS[f"p12_upsample{n}"].apply(spark, plane=plane).collect()
        assert len(rows) == v.size * n * n
        for r in rows:
            w = p[r.y // n : r.y // n + 5, r.x // n : r.x // n + 5]
            want = 0.0
            for dy in range(5):
                for dx in range(5):
                    # a place in the last half is the mirror image of one in the first
                    i, j = ((k * 5 + d) if k < n // 2 else (n - 1 - k) * 5 + 4 - d for k, d in ((r.y % n, dy), (r.x % n, dx)))
                    i, j = min(i, j), max(i, j)
                    want += weights[i * side - i * (i - 1) // 2 + j - i] * w[dy, dx]
            assert abs(r.v - min(max(want, w.min()), w.max())) < 2e-6


@pytest.mark.parametrize("name, reach, mul, near, plus", [("p7_edge_filter0", 3, 0.9, 2, True), ("p8_edge_filter1", 2, 1.0, 1, True), ("p9_edge_filter2", 1, 6.5, 1, False)])
def test_edge_filters_equal_numpy(spark, name, reach, mul, near, plus):
    c = np.random.default_rng(5).normal(size=(3, 20, 13)) * np.array([0.1, 1.5, 1])[:, None, None]
    c[0, 8:16, 8:] *= 9
    rgb = spark.createDataFrame([(y, x, *[float(c[k, y, x]) for k in range(3)]) for y in range(20) for x in range(13)], "y int, x int, c0 double, c1 double, c2 double")
    p = np.pad(c, ((0, 0), (3, 3), (3, 3)), mode="symmetric")
    stays = 0
    for r in stencil.OPERATORS[name].apply(spark, rgb=rgb).collect():
        block = c[:, r.y // 8 * 8 : r.y // 8 * 8 + 8, r.x // 8 * 8 : r.x // 8 * 8 + 8]
        quant, sharp = 1 + int(np.floor((block[0].max() - block[0].min()) * 4)) % 8, int((block[1] > 0).sum()) % 8
        sigma = 1 / min(0.46 / (0.125 * quant * -1.1715728752538099024) * sharp / 7, -1e-4)
        at = lambda dy, dx: p[:, r.y + 3 + dy, r.x + 3 + dx]
        want = c[:, r.y, r.x]
        if sigma >= -3.90524291751269967465540850526868:
            m = sigma * 1.65 * mul * (2 / 3 if r.x % 8 in (0, 7) or r.y % 8 in (0, 7) else 1)
            top, total = want.copy(), 1.0
            for dy in range(-near, near + 1):
                for dx in range(-near, near + 1):
                    if 0 < abs(dy) + abs(dx) <= near:
                        about = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)] if plus else [(0, 0)]
                        sad = sum((np.array([40.0, 5.0, 3.5]) * abs(at(dy + a, dx + b) - at(a, b))).sum() for a, b in about)
                        w = max(0.0, 1 + sad * m)
                        top, total = top + w * at(dy, dx), total + w
            want = top / total
        else:
            stays += 1
        assert np.allclose([r.c0, r.c1, r.c2], want, atol=2e-6)
    assert 0 < stays < 260


def test_columns_longer_than_a_block(spark):
    v = np.random.default_rng(7).integers(0, 1000, (2 * stencil.BLOCK + 9, 3))
    plane = spark.createDataFrame([(y, x, float(v[y, x])) for y, x in np.ndindex(v.shape)], "y int, x int, v double")
    got = {(r.y, r.x): r.v for r in stencil.OPERATORS["p19_convolve_noise"].apply(spark, plane=plane).collect()}
    p = np.pad(v, 2, mode="symmetric")
    assert len(got) == v.size and all(abs(got[y, x] - (0.16 * (p[y : y + 5, x : x + 5].sum() - v[y, x]) - 3.84 * v[y, x])) < 1e-5 for y, x in got)
    ints = spark.createDataFrame([(y, x, int(v[y, x])) for y, x in np.ndindex(v.shape)], "y int, x int, v long")
    near = {(r.y, r.x): r for r in modular.OPERATORS["m4_neighbours"].apply(spark, ints=ints).collect()}
    assert len(near) == v.size and all((r.t, r.tt) == (v[y - 1, x], v[y - 2, x]) for (y, x), r in near.items() if y > 1)
    ready = {(r.y, r.x): r for r in stencil.OPERATORS["t5_group_readiness"].apply(spark, ints=ints).collect()}
    for (y, x), r in ready.items():
        assert r.rendered == v[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].max() and r.freed == v[max(y - 2, 0) : y + 3, max(x - 2, 0) : x + 3].max()


def test_error_function(con):
    """The format's polynomial, whose coefficients differ from the handbook's in the fourth digit."""
    for v in (-3.0, -0.4, 0.0, 0.1, 0.7, 2.5):
        a = abs(v)
        q = (((a * 7.77394369e-02 + 2.05260015e-04) * a + 2.32120216e-01) * a + 2.77820801e-01) * a + 1
        assert abs(_value(con, t.erf(f"({v}e0)")) - np.copysign(1 - 1 / q**4, v)) < 1e-9
        assert abs(_value(con, t.erf(f"({v}e0)")) - __import__("math").erf(v)) < 6e-4


def test_frames_meet_their_slots_whole(spark):
    draw = np.random.default_rng(2)
    sizes = {0: (50, 64), 1: (3, 70), 3: (45, 5), 4: (1, 2), 9: (6, 66)}  # gaps, and rows and columns beyond 40 and 64
    v = {k: draw.normal(size=s) for k, s in sizes.items()}
    frames = spark.createDataFrame([(k, y, x, float(p[y, x])) for k, p in v.items() for y, x in np.ndindex(p.shape)], "frame int, y int, x int, v double")
    high, wide = max(h + 2 * k for k, (h, _) in sizes.items()), max(w + k for k, (_, w) in sizes.items())
    placed = {}
    for k, p in v.items():
        placed[k] = np.full((high, wide), np.nan)
        placed[k][2 * k : 2 * k + p.shape[0], k : k + p.shape[1]] = p
    for name, slot in (("p26_frame_blending", 3), ("p28_extend", 1)):
        got = {(r.frame, r.y, r.x): r.v for r in compose.OPERATORS[name].apply(spark, frames=frames).collect()}
        assert len(got) == len(v) * high * wide
        for k, c in placed.items():
            before = [o for o in v if o < k and o % 4 == (k + slot) % 4]
            old = np.nan_to_num(placed[max(before)]) if before else np.zeros((high, wide))
            new = c * np.clip(c + 0.5, 0, 1) + old if slot == 3 else c
            want = np.where(np.isnan(c), old, new)
            assert np.allclose([[got[k, y, x] for x in range(wide)] for y in range(high)], want, atol=1e-6)


def test_empty_planes(spark):
    plane = spark.createDataFrame([], "y int, x int, v double")
    for name in ("p6_gaborish", "p12_upsample2", "p4_chroma_up_x"):
        assert stencil.OPERATORS[name].apply(spark, plane=plane).count() == 0
    rgb = spark.createDataFrame([], "y int, x int, c0 double, c1 double, c2 double")
    assert colour.OPERATORS["p22_xyb_linear"].apply(spark, rgb=rgb).count() == 0


def test_unsqueeze_inverts():
    from tessera.bitstream.modular import squeeze_rows

    draw = np.random.default_rng(2)
    for n in (2, 3, 8, 31):
        v = draw.integers(-1000, 1000, n)
        assert modular.unsqueeze(*[x[0] for x in squeeze_rows(v[None])]) == v.tolist()


def test_squeeze_lines_keep_their_length(spark):
    assert QUERIES["m17_horizontal_squeeze"](spark, SF).count() == QUERIES["m4_neighbours"](spark, SF).count()


def test_rct6_inverts_ycocg():
    r, g, b = 17, 200, 3
    co = r - b
    y0 = b + (co >> 1)
    cg = g - y0
    a = y0 + (cg >> 1)
    env = {"a": a, "b": co, "c": cg}
    assert [eval(e, env) for e in modular.RCT[6]] == [r, g, b]


@pytest.mark.parametrize("shape", [(8, 8), (16, 16), (8, 16), (16, 8), (32, 8)])
def test_idct_inverts_dct(shape):
    v = np.random.default_rng(3).random(shape)
    assert np.allclose(vardct.idct2d(vardct.dct2d(v)), v)
    assert np.allclose(vardct.basis(shape[0]) @ vardct.basis(shape[0]).T, shape[0] * np.eye(shape[0]))


def test_block_idct_equals_one_by_one(spark):
    got = {}
    for r in QUERIES["v15_idct_8x16"](spark, SF).collect():
        got.setdefault(r.id, {})[r.k] = r.v
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()}
    for i, v in got.items():
        c = np.array([x for k in range(2) for x in e.get(2 * i + k, [0.0] * 64)]).reshape(8, 16)
        assert np.allclose(np.array([v[k] for k in range(128)]).reshape(8, 16), vardct.idct2d(c), atol=1e-5)


def test_special_blocks_by_their_definitions(spark):
    def idct(c):  # rows x columns, by sums
        h, w = c.shape
        f = lambda k, x, n: 1.0 if k == 0 else np.sqrt(2) * np.cos((x + 0.5) * k * np.pi / n)
        return np.array([[sum(c[v, u] * f(v, y, h) * f(u, x, w) for v in range(h) for u in range(w)) for x in range(w)] for y in range(h)])

    def plain(kind, c):
        c, out = c.copy(), np.zeros((8, 8))
        if kind == "dct8x8":
            return idct(c.T)
        if kind == "dct2x2":
            for n in (1, 2, 4):
                new = c.copy()
                for y in range(n):
                    for x in range(n):
                        p, q, r, s = c[y, x], c[y, n + x], c[n + y, x], c[n + y, n + x]
                        new[2 * y : 2 * y + 2, 2 * x : 2 * x + 2] = [[p + q + r + s, p + q - r - s], [p - q + r - s, p - q - r + s]]
                c = new
            return c
        if kind in ("dct4x8", "dct8x4"):
            for k in range(2):
                part = c[k::2].copy()
                part[0, 0] = c[0, 0] + (-c[1, 0] if k else c[1, 0])
                if kind == "dct4x8":
                    out[4 * k : 4 * k + 4] = idct(part)
                else:
                    out[:, 4 * k : 4 * k + 4] = idct(part.T)
            return out
        p, q, r, s = c[0, 0], c[0, 1], c[1, 0], c[1, 1]
        if kind.startswith("corner"):
            down, right = divmod(int(kind[-1]), 2)
            parts = [c[::2, ::2].copy(), c[::2, 1::2].copy(), c[1::2].copy()]
            for part, mean in zip(parts, (4 * (p + q + r), p - q + r, p - r)):
                part[0, 0] = mean
            for y in range(4):
                for x in range(4):
                    v = sum(parts[0][k // 4, k % 4] * vardct.CORNER[k, 4 * y + x] for k in range(16))
                    out[7 - y if down else y, 7 - x if right else x] = v
            out[4 * down : 4 * down + 4, 4 - 4 * right : 8 - 4 * right] = idct(parts[1].T)
            out[4 - 4 * down : 8 - 4 * down] = idct(parts[2])
            return out
        for k, mean in enumerate((p + q + r + s, p + q - r - s, p - q + r - s, p - q - r + s)):
            y, x = divmod(k, 2)
            part = c[y::2, x::2].copy()
            if kind == "dct4x4":
                part[0, 0] = mean
                out[4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = idct(part.T)
            else:
                centre = mean - (part.sum() - part[0, 0]) / 16
                part[0, 0], part[1, 1] = part[1, 1], 0
                out[4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = part + centre
        return out

    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 24").collect()}
    got = {}
    for r in QUERIES["v14_block_transforms"](spark, SF).where("id < 24").collect():
        got.setdefault((r.id, r.kind), np.zeros(64))[r.k] = r.v
    assert {k for _, k in got} == set(vardct.SMALL) and len(got) == 24
    for (i, kind), v in got.items():
        assert np.allclose(v.reshape(8, 8), plain(kind, np.array(e[i]).reshape(8, 8)), atol=1e-5), kind
    draw = np.random.default_rng(0)
    for kind in ("dct32x8", "dct16x32", "dct64x64"):
        r, c = map(int, kind[3:].split("x"))
        m = draw.normal(size=(2, r * c))
        assert np.allclose(vardct.KINDS[kind](m)[1], vardct.idct2d(m[1].reshape(r, c)))


def test_corner_waves():
    """Waves are orthonormal; the format's numbers of some of them."""
    w = vardct.CORNER
    assert np.allclose(w @ w.T, np.eye(16))
    assert np.allclose(w[1, :5], [0.8769029298, 0.2206518107, -0.1014005039, -0.1014005039, 0.2206518107])
    assert np.allclose(w[5, :3], [-0.4105, 0.6235, -0.0644], atol=1e-4)
    assert np.allclose(w[2, [2, 3, 6, 7, 11]], [0.4067007583, 0.4444481662, 0.1957439937, 0.2929100137, 0.1137907446])
    assert np.allclose(vardct.CORNER_FREQUENCY[[0, 2, 3], [2, 1, 3]], [0.8517778890, 4, 12.9716620257])


def test_assembly_of_blocks(spark):
    draw = np.random.default_rng(1)
    rows, want = [], np.zeros((32, 32))
    for y, x, kind in ((0, 0, "dct16x32"), (2, 0, "dct8x8"), (2, 1, "corner2"), (2, 2, "dct16x8"), (2, 3, "dct16x8"), (3, 0, "identity"), (3, 1, "dct4x8")):
        h, w = vardct.size_of(kind)
        coeff, lf = draw.normal(size=(min(h, w), max(h, w))), draw.normal(size=(h // 8, w // 8))
        rows.append((y, x, kind, coeff.ravel().tolist(), lf.ravel().tolist()))
        low = vardct.reinterpreting_dct(lf)
        coeff[: low.shape[0], : low.shape[1]] = low
        want[8 * y : 8 * y + h, 8 * x : 8 * x + w] = vardct.KINDS[kind](coeff[None])[0]
    ddl = "block_y int, block_x int, kind string, coeff array<double>, lf array<double>"
    got = np.full((32, 32), np.nan)
    for r in vardct.blocks_to_plane(spark.createDataFrame([*rows, (9, 9, "dct8x8", None, None)], ddl)).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, want)
    flat = spark.createDataFrame([(0, 0, "dct32x16", [0.0] * 512, [3.5] * 8)], ddl)
    assert {round(r.v, 9) for r in vardct.blocks_to_plane(flat).collect()} == {3.5}
    assert vardct.blocks_to_plane(flat.where("false")).count() == 0


def test_colour_transforms_undo_themselves():
    from tessera.bitstream.modular import do_rct, undo_rct

    v = [np.random.default_rng(k).integers(-300, 300, 50) for k in range(3)]
    for kind in range(42):
        coded = do_rct(v, kind)
        assert all((a == b).all() for a, b in zip(undo_rct(*coded, kind), v))
        env = {n: x for n, x in zip("abc", coded)}
        sql = modular.rct(kind % 7, list(modular.PERMUTATIONS)[kind // 7])
        order = modular.PERMUTATIONS[list(modular.PERMUTATIONS)[kind // 7]]
        assert sql.id == "M13" and all((eval(modular.RCT[kind % 7][i], env) == x).all() for i, x in zip(order, v))



def test_natural_order_is_a_permutation():
    for cx, cy in ((1, 1), (2, 1), (2, 2), (4, 2), (4, 4)):
        o = vardct.natural_order(cx, cy)
        assert sorted(o) == list(range(64 * cx * cy))
    o = vardct.natural_order(1, 1).tolist()
    assert o[:6] == [0, 1, 8, 16, 9, 2] and o[34:39] == [49, 56, 57, 50, 43] and o[-4:] == [47, 55, 62, 63]


def test_orientations_swap_sizes():
    for o, (x, y) in compose.ORIENTATIONS.items():
        cells = {(eval(x, {"x": i, "y": j, "w": 4, "h": 3}), eval(y, {"x": i, "y": j, "w": 4, "h": 3})) for i in range(4) for j in range(3)}
        assert cells == {(i, j) for i in range(3 if o >= 5 else 4) for j in range(4 if o >= 5 else 3)}


def test_planner():
    p = pipeline.frame_plan(epf_iterations=2, upsampling=2)
    assert [s.name for s in p.stages] == ["convert", "gaborish", "epf1", "epf2", "upsample2", "xyb", "from_linear", "extend"]
    assert p.halo == (6, 6) and p.scale == (1, 1)
    assert "from_linear" not in [s.name for s in pipeline.frame_plan(linear_output=True).stages]
    with pytest.raises(pipeline.PlanError):
        pipeline.plan([pipeline.CHAIN["gaborish"]], "int")
    with pytest.raises(pipeline.PlanError):
        pipeline.plan([pipeline.CHAIN["extend"], pipeline.CHAIN["gaborish"]])


def test_boxes_and_parts():
    def box(kind, data):
        return struct.pack(">I", len(data) + 8) + kind + data

    made = container.CONTAINER + box(b"ftyp", b"x") + box(b"jxlp", b"\0\0\0\0ab") + box(b"jxlp", b"\x80\0\0\1cd")
    assert [k for k, _, _ in container.boxes(made)] == ["JXL ", "ftyp", "jxlp", "jxlp"]
    assert container.codestream(made) == b"abcd"
    for more in (box(b"jxlp", b"\0\0\0\2ef"), box(b"jxlc", b"ef")):
        assert [e for e, *_ in container.events(made + more)][-1] == "invalid" and container.codestream(made + more) == b"abcd"
    early = container.CONTAINER + box(b"jxlp", b"\0\0\0\1cd")
    assert list(container.events(early))[-1][0] == "invalid" and container.codestream(early) == b""
    assert list(container.events(None)) == [("kind", "none", 0, 0)]
    assert list(container.boxes(None)) == [] and list(container.boxes(b"\0\0\0\x05abcd")) == []


def test_files(spark, tmp_path):
    (tmp_path / "a.jxl").write_bytes(b"\xff\x0aabc")
    (tmp_path / "b.jxl").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_bytes(b"no")
    found = container.files(spark, str(tmp_path), "*.jxl")
    assert sorted((r.path[-5:], bytes(r.content)) for r in found.collect()) == [("a.jxl", b"\xff\x0aabc"), ("b.jxl", b"\xff")]
    assert sorted(r.kind for r in container.signature(found).collect()) == ["codestream", "more"]


def test_bit_reader():
    b = container.BitReader(bytes([0b10110101, 0b1]))
    assert (b.read(3), b.read(5), b.read(1)) == (0b101, 0b10110, 1)
    b.align()
    with pytest.raises(EOFError):
        b.read(1)


def test_png_reads_back():
    v = np.random.default_rng(4).random((5, 7))
    raw = sinks.png(v)
    at = raw.index(b"IDAT")
    n = struct.unpack(">I", raw[at - 4 : at])[0]
    rows = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + n]), np.uint8).reshape(5, 8)
    assert (rows[:, 0] == 0).all() and (rows[:, 1:] == sinks.to_u8(v)).all()
    assert sinks.ppm(v).startswith(b"P5\n7 5\n255\n") and sinks.apng_delay(40) == (1, 25)


def test_primaries():
    from tessera.functions import primaries as pr

    m = pr.rgb_to_xyz(((0.64, 0.33), (0.3, 0.6), (0.15, 0.06)), (0.3127, 0.3290))
    assert np.allclose(m, [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]], atol=2e-4)
    assert np.allclose(pr.adapt_to_d50((0.3127, 0.3290)) @ m @ np.ones(3), pr.D50, atol=1e-9)
    with pytest.raises(ValueError):
        pr.xyz(0.3, 0.0)


def test_output_matrices():
    """White stays white whatever the primaries; sRGB's own matrix is the format's."""
    white = np.array(t.OPSIN).sum(axis=1)
    assert np.allclose(np.array(colour.output_matrix(*colour._BT2100)).sum(axis=1), white, atol=1e-3)
    same_ = colour.output_matrix(colour.pr.PRIMARIES["SRG"], colour.pr.WHITE_POINTS["D65"])
    assert np.allclose(same_, t.OPSIN, atol=1e-9)
    assert np.allclose(np.array(colour.grey_matrix())[0], np.array([0.2126, 0.7152, 0.0722]) @ np.array(t.OPSIN), atol=1e-2)


def test_halves_equal_numpy(spark):
    rows = QUERIES["p2_convert_half"](spark, SF).collect()
    i = np.array([r.i for r in rows])
    assert len(set(i)) > 500 and np.array_equal(i.astype(np.uint16).view(np.float16).astype(float), np.array([r.v for r in rows]))


def test_inverse_matrices_equal_numpy(spark):
    pix = {(k, 1): (k % 7, k // 7 % 5, k % 3) for k in range(105)}
    df = spark.createDataFrame([(*key, *v) for key, v in pix.items()], "k long, l int, c0 long, c1 long, c2 long")
    got = {(r.k, r.l): r for r in colour.OPERATORS["f9_inverse"].apply(spark, pix=df).collect()}
    for key, (a, d, g) in pix.items():
        m = np.array([[a, 1, 2], [d, 3, 1], [g, 1, 5]], dtype=float)
        if abs(np.linalg.det(m)) > 1e-6:
            assert np.allclose([got[key][f"m{i}{j}"] for i in range(3) for j in range(3)], np.linalg.inv(m).ravel(), atol=2e-6)


def read_chunks(raw):
    assert raw[:8] == sinks.SIGNATURE
    at, out = 8, []
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + data) == struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]
        out.append((kind, data))
        at += 12 + n
    return out


def test_png_of_16_bits_and_animation():
    draw = np.random.default_rng(4)
    image = draw.random((5, 7, 3))
    parts = dict(read_chunks(sinks.png(image, 16, cicp=(9, 16))))
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(5, -1)
    assert (rows[:, 0] == 0).all() and parts[b"cICP"] == bytes([9, 16, 0, 1]) and parts[b"IHDR"][8:10] == bytes([16, 2])
    assert np.allclose(rows[:, 1:].copy().view(">u2").reshape(5, 7, 3) / 65535, image, atol=1 / 65535)
    assert zlib.decompress(dict(read_chunks(sinks.png(image, icc=b"profile bytes")))[b"iCCP"][9:]) == b"profile bytes"
    frames = [draw.random((4, 3)) for _ in range(3)]
    chunks = read_chunks(sinks.apng(frames, [100, 40, 1000]))
    assert [k for k, _ in chunks] == [b"IHDR", b"sRGB", b"acTL", b"fcTL", b"IDAT", b"fcTL", b"fdAT", b"fcTL", b"fdAT", b"IEND"]
    numbers = [struct.unpack(">I", d[:4])[0] for k, d in chunks if k in (b"fcTL", b"fdAT")]
    assert numbers == list(range(5)) and [struct.unpack(">HH", d[20:24]) for k, d in chunks if k == b"fcTL"] == [(1, 10), (1, 25), (1, 1)]
    for f, data in zip(frames, [chunks[4][1], chunks[6][1][4:], chunks[8][1][4:]]):
        assert (np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, 4)[:, 1:] == sinks.to_u8(f)).all()
