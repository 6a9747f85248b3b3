"""The bit-stream reader against published vectors, random round trips and hand-made streams."""

import hashlib
import random
import struct
from dataclasses import replace

import numpy as np
import pytest

from tessera.bitstream import entropy as en
from tessera.bitstream import blocks, headers, modular, profile, quant
from tessera.bitstream.bits import Bits, BitSink, StreamError, pack_signed, unpack_signed
from tessera.operators import streams
from tessera.sources import icc
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(streams.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert same(spark, con, streams.QUERIES[name], streams.ORACLE_SQL[name], SF) == ""


def test_scalars():
    for v in (0, 1, 16, 17, 272, 273, 4095, 4096, 1 << 20, 1 << 40, 1 << 63, (1 << 64) - 1):
        s = BitSink()
        s.u64(v)
        s.write(3, 5)
        b = Bits(s.bytes())
        assert (b.u64(), b.read(3)) == (v, 5)
    assert [unpack_signed(pack_signed(v)) for v in range(-9, 9)] == list(range(-9, 9))
    b = Bits(b"\xff")
    b.skip(20)
    assert b.missing == 2
    with pytest.raises(EOFError):
        b.check()
    with pytest.raises(StreamError):
        Bits(b"\x00\x7c").f16()
    whole = Bits(b"abcdef")
    assert whole.split(2).read(16) == int.from_bytes(b"ab", "little") and whole.read(8) == ord("c")


def test_distributions_of_one_and_two_symbols():
    assert en.AliasCode.read_from(Bits(bytes([0b00100101, 0b01])), 5).single == 20
    with pytest.raises(StreamError):
        en.AliasCode.read_from(Bits(bytes([0b00101101, 0b000])), 5)
    two = en.AliasCode.read_from(Bits(bytes([0b10011111, 0b10010010, 0b00000000, 0b00010])), 5)
    assert two.counts[10] == 256 and two.counts[20] == 4096 - 256
    even = BitSink()
    even.write(2, 2)
    even.varint8(6)
    assert en.AliasCode.read_from(Bits(even.bytes()), 5).counts[:8] == [586, 585, 585, 585, 585, 585, 585, 0]


def test_every_place_of_an_alias_table_is_taken_once():
    draw = np.random.default_rng(0)
    for bits in (5, 6, 8):
        for _ in range(20):
            code = en.AliasCode.of_counts((draw.integers(0, 50, draw.integers(1, 1 << bits)) ** 3).tolist(), bits)
            found = [code.place(at) for at in range(4096)]
            assert sorted(found) == [(s, k) for s, c in enumerate(code.counts) for k in range(c)]


def test_damaged_distributions_end_in_errors():
    draw = random.Random(0)
    for _ in range(300):
        b = Bits(draw.randbytes(40))
        try:
            while b.at < 250:
                assert sum(en.AliasCode.read_from(b, 8).counts) == 4096
        except (StreamError, EOFError, IndexError):
            pass


def test_prefix_code_of_bytes_reads_reversed_octets():
    code = en.PrefixCode([8] * 256)
    want = [8, 13, 21, 34, 55, 89, 144, 233]
    b = Bits(bytes(int(f"{v:08b}"[::-1], 2) for v in want))
    assert [code.read(b) for _ in want] == want


def repeated(*extras, more=0):
    """A code whose first length is 4, then runs of it (two extra bits each), then as many single lengths of 4."""
    s = BitSink()
    s.write(2, 0)
    for at in en.LENGTH_ORDER[:9]:  # the lengths 4 and 16 take a bit each
        s.write(*((4, 7) if at in (4, 16) else (2, 0)))
    s.write(1, 0)
    for extra in extras:
        s.write(1, 1)
        s.write(2, extra)
    s.write(more, 0)
    return Bits(s.bytes())


def test_repeats_of_code_lengths():
    # a run of four, made (4 - 2) * 4 + 3 + 3 = 14 by the next, and a length: sixteen of length 4
    assert {n for n, _ in en.PrefixCode.read_from(repeated(1, 3, more=1), 16).codes.values()} == {4}
    with pytest.raises(StreamError):  # 3, 7, then 23 would pass sixteen
        en.PrefixCode.read_from(repeated(0, 0, 0), 16)
    with pytest.raises(StreamError):  # seven of length 4 leave room
        en.PrefixCode.read_from(repeated(3), 7)


@pytest.mark.parametrize("seed", range(6))
def test_random_streams(seed):
    draw = random.Random(seed)
    for _ in range(40):
        k = draw.choice([1, 2, 3, 9, 30])
        clusters = [draw.randrange(min(k, draw.choice([1, 2, 12]))) for _ in range(k)]
        clusters = [sorted(set(clusters)).index(c) for c in clusters]
        values = [(draw.randrange(k), min(int(draw.expovariate(1) * draw.choice([2, 40, 10**6])), 1 << 30)) for _ in range(draw.choice([0, 1, 5, 200]))]
        values = [x for x in values for _ in range(draw.choice([1, 1, 1, 20]))]
        prefix, copies, split = draw.random() < 0.5, draw.choice([None, (224, 3)]), draw.choice([en.Split(4, 2, 0), en.Split(4, 1, 1), en.Split(0, 0, 0)])
        s = BitSink()
        s.write(3, 5)
        en.encode(s, values, k, prefix, split, copies, clusters, bool(copies) and draw.random() < 0.5)
        b = Bits(s.bytes())
        b.skip(3)
        reader = en.Reader(en.Code.read_from(b, k), b)
        assert [reader.read(c) for c, _ in values] == [v for _, v in values]
        reader.finish()


def test_near_distances_of_copies():
    """A row of an image copied from the row above: distance code 0 is straight up."""
    code = en.Code([0, 1], [en.Split(8, 0, 0), en.Split(8, 0, 0)], [en.PrefixCode([9] * 512), en.PrefixCode([9] * 512)], 15, (224, 3), en.Split(4, 0, 0))
    s = BitSink()
    for v in range(10):
        s.write(*code.codes[0].codes[v])
    s.write(*code.codes[0].codes[224 + 7])  # ten symbols
    s.write(*code.codes[1].codes[0])
    reader = en.Reader(code, Bits(s.bytes()), width=10)
    assert [reader.read(0) for _ in range(20)] == [*range(10), *range(10)]
    assert len(en.NEAR) == 120 and len(set(en.NEAR)) == 120


def test_permutations():
    assert en.from_lehmer([2, 0, 1], 5) == [2, 0, 3, 1, 4] and en.compose([2, 0, 1], [1, 2, 0]) == [0, 1, 2]
    with pytest.raises(StreamError):
        en.from_lehmer([0, 4], 5)
    assert en.inverse_move_to_front(en.move_to_front([3, 3, 1, 0, 3])) == [3, 3, 1, 0, 3] and en.move_to_front([2, 2, 0]) == [2, 0, 1]


def test_self_correcting_predictor_against_published_numbers():
    """Inputs from the minimal standard generator; outputs of the public reference decoder for them."""
    state = 1

    def draw():
        nonlocal state
        state = state * 48271 % 0x7FFFFFFF
        return state

    w = modular.Weights(tuple(draw() % 32 for _ in range(7)), tuple(draw() % 16 for _ in range(4)))
    # the numbers visit places in any order, so both rows stay at hand, dealt by the parity of y
    p = modular.Corrected(w, 8)
    rows = {k: (p.errors[k], p.true[k]) for k in (0, 1)}
    got = []
    for _ in range(4):
        x, y = draw() % 8, draw() % 8
        own = 0 if y & 1 else 1
        p.errors, p.true = [rows[1 - own][0], rows[own][0]], [rows[1 - own][1], rows[own][1]]
        n, west, ne, nw, nn = (draw() % 256 for _ in range(5))
        got.append(p.predict(x, west, n, nw, ne, nn))
        p.learn(x, draw() % 256)
    assert got == [(135, 0), (110, -60), (165, 0), (153, -60)]


def tree_of(draw, depth, properties):
    nodes, queue, leaves = [], [(0, {})], 0
    for d, ranges in queue:
        p = draw.choice(properties)
        low, high = ranges.get(p, (-300, 300))
        if d < depth and high - low > 4 and draw.random() < 0.8:
            v = draw.randrange(low + 1, high - 1)
            nodes.append(modular.Node(p, v, len(queue), len(queue) + 1))
            queue += [(d + 1, ranges | {p: (v + 1, high)}), (d + 1, ranges | {p: (low, v)})]
        else:
            nodes.append(modular.Node(predictor=draw.randrange(14), offset=draw.randrange(-3, 4), context=leaves))
            leaves += 1
    return nodes


@pytest.mark.parametrize("seed", range(4))
def test_random_sub_streams(seed):
    draw, rng = random.Random(seed), np.random.default_rng(seed)
    for _ in range(12):
        h, w = draw.choice([(1, 1), (5, 7), (16, 12), (9, 33)])
        arrays = [np.cumsum(rng.integers(-4, 5, (h, w)), axis=1) + 100 for _ in range(3)]
        T = modular.Transform
        chosen = draw.choice([[], [T("rct", 0, 3, draw.randrange(42))], [T("squeeze")], [T("rct", 0, 3, 6), T("squeeze")]])
        s = BitSink()
        s.write(5, 9)
        modular.encode_stream(s, arrays, tree_of(draw, draw.choice([0, 1, 4]), [*range(16), 16, 17, 19, 20]), chosen, draw.random() < 0.5)
        b = Bits(s.bytes())
        b.skip(5)
        assert all((x == y).all() for x, y in zip(modular.decode_stream(b, [(h, w)] * 3), arrays))


def test_trees_that_cannot_be():
    bad = [modular.Node(4, 10, 1, 2), modular.Node(4, 10, 3, 4), *[modular.Node() for _ in range(3)]]
    s = BitSink()
    modular.write_tree(s, bad)
    with pytest.raises(StreamError):
        modular.read_tree(Bits(s.bytes()))
    modular.check_tree([modular.Node(4, 10, 1, 2), replace(bad[1], value=11), *bad[2:]])


def test_squeezes_by_the_definition():
    def one(b, m, a):
        if b >= m >= a or b <= m <= a:
            s = 1 if b >= a else -1
            t = (4 * s * b - 3 * s * a - s * m + 6) // 12
            if t - t % 2 > 2 * s * (b - m):
                t = 2 * s * (b - m) + 1
            if t + t % 2 > 2 * s * (m - a):
                t = 2 * s * (m - a)
            return s * t
        return 0

    rng = np.random.default_rng(1)
    for scale in (3, 20, 1000):
        b, m, a = rng.integers(-scale, scale + 1, (3, 4000))
        assert modular.tendency(b, m, a).tolist() == [one(*x) for x in zip(b.tolist(), m.tolist(), a.tolist())]
    for n in (1, 2, 3, 8, 17):
        v = rng.integers(-500, 500, (5, n))
        assert (modular.unsqueeze_rows(*modular.squeeze_rows(v)) == v).all()


def test_headers():
    draw = random.Random(3)
    for _ in range(60):
        size = draw.randrange(1, 3000), draw.randrange(1, 3000)
        animation = draw.choice([None, (100, 1), (30, 1001)])
        s = BitSink()
        headers.write_file_header(s, *size, draw.randrange(1, 9), draw.choice([8, 10, 12, 16]), draw.random() < 0.5, draw.random() < 0.5, animation)
        file = headers.read_file_header(Bits(s.bytes()))
        assert (file["width"], file["height"]) == size
        crop, mode = draw.choice([None, (-3, 5, 20, 400)]), draw.choice(headers.BLENDING)
        s = BitSink()
        headers.write_frame_header(s, file, 7 if animation else 0, draw.random() < 0.5, crop, mode, "frame", 2, 3)
        end = len(s.bytes())
        sizes = [draw.choice([0, 1023, 1024, 20000, 5_000_000]) for _ in range(6)]
        order = draw.sample(range(6), 6)
        headers.write_contents(s, sizes, order)
        b = Bits(s.bytes())
        frame = headers.read_frame_header(b, file)
        assert b.at == 8 * end and (frame["crop"], frame["blending"]["mode"], frame["name"], frame["passes"], frame["group"]) == (crop, mode, "frame", 3, 512)
        at = np.concatenate([[0], np.cumsum(sizes)])
        assert headers.read_contents(b, 6) == [(i, at[p], sizes[p]) for i, p in enumerate(order)]
    with pytest.raises(EOFError):
        headers.read_file_header(Bits(b"\x00"))


def test_palettes_before_and_beyond_their_entries():
    """Differences, entries, cubes; a palette of 2 differences and 3 colours is 5 wide."""
    table = np.array([[1, -1, 10, 20, 30], [2, -2, 11, 21, 31], [3, -3, 12, 22, 32]])
    index = modular.Channel(np.array([[2, 0, 1, -2, -3, -4, -1, -144, 4, 5, 5 + 63, 5 + 64, 5 + 64 + 124]]))
    t = modular.Transform("palette", 0, 3, 0, 3, 2, 1)
    got = np.stack([c.v[0] for c in modular.undo_palette(table, index, t, 8, modular.Weights())], 1).tolist()
    want = [[10, 11, 12], [11, 13, 15], [10, 11, 12], [14, 15, 16], [10, 11, 12], [21, 11, 12], [21, 11, 12], [21, 11, 12], [30, 31, 32], [32, 32, 32], [223, 223, 223], [0, 0, 0], [255, 255, 255]]
    assert got == want
    channels, _ = modular.planned([modular.Channel(np.zeros((4, 4), np.int64)) for _ in range(3)], [t])
    assert [c.size for c in channels] == [(3, 5), (4, 4)]
    assert len(modular.DELTAS) == 72


def test_shapes_of_blocks():
    assert [blocks.SHAPE[k] for k in blocks.KINDS] == [0, 1, 1, 1, 2, 3, 4, 4, 5, 5, 6, 6, 1, 1, 1, 1, 1, 1, 7, 8, 8, 9, 10, 10, 11, 12, 12]
    assert {blocks.quant_kind(k) for k in blocks.KINDS} == set(quant.SIZES)
    # offsets of a coefficient's context by how many are left and by place: the least and greatest of each step
    c = blocks.Contexts()
    at = lambda left, k: (c.of_coefficient(0, left, k, 1, False) - 37 * 15) // 2
    assert [at(n, 1) for n in (1, 2, 3, 4, 5, 8, 9, 12, 13, 20, 21, 32, 33, 63)] == [0, 31, 62, 62, 93, 93, 123, 123, 152, 152, 180, 180, 206, 206]
    assert [at(1, k) for k in (1, 15, 16, 17, 18, 31, 32, 35, 36, 63)] == [0, 14, 15, 15, 16, 22, 23, 23, 24, 30]
    assert [c.of_count(3, n) for n in (0, 7, 8, 9, 63, 64, 900)] == [15 * n + 3 for n in (0, 7, 8, 8, 35, 36, 36)]


@pytest.mark.parametrize("seed", range(4))
def test_random_coefficients(seed):
    draw = np.random.default_rng(seed)
    grid = [(0, 0, "dct16x32", 3), (0, 4, "dct8x8", 9), (0, 5, "corner2", 40), (1, 4, "dct8x16", 200), (2, 0, "dct16x16", 1), (2, 2, "dct8x32", 7), (3, 2, "dct4x8", 5), (3, 3, "identity", 6), (3, 4, "dct2x2", 3), (3, 5, "dct8x8", 2)]
    assert blocks.placed([k for _, _, k, _ in grid], 4, 6) == [(y, x) for y, x, *_ in grid]
    values = []
    for _, _, k, _ in grid:
        n = int(np.prod(blocks.size_of(k)))
        v = np.where(draw.random((3, n)) < draw.random(), draw.integers(-90, 90, (3, n)), 0)
        v[:, blocks.order_of(k)[: n // 64]] = 0
        values.append(v)
    contexts = blocks.Contexts() if seed % 2 else blocks.Contexts([int(x) for x in np.arange(39 * 4 * 6) % 11], ((0,), (5,), ()), (4, 30, 90, 150, 200))
    lf = None if seed % 2 else blocks.lf_index(contexts, [draw.integers(-9, 9, (4, 6)) for _ in range(3)])
    s = BitSink()
    (group,) = blocks.write_coefficients(s, [(values, grid)], 4, 6, contexts, histograms=3, chosen=seed % 3, lf=lf, prefix=seed < 2)
    code = en.Code.read_from(Bits(s.bytes()), 3 * contexts.total)
    read = lambda **more: blocks.read_coefficients(Bits(group), code, grid, 4, 6, contexts, histograms=3, lf=lf, **more)
    once = read()
    assert all((a == b).all() for a, b in zip(once, values))
    # a second pass of finer steps adds to the first one
    assert all((a == 5 * b).all() for a, b in zip(read(shift=2, before=once), values))
    with pytest.raises((StreamError, EOFError)):
        blocks.read_coefficients(Bits(group[: len(group) // 2]), code, grid, 4, 6, contexts, histograms=3, lf=lf)


def test_subsampled_coefficients():
    """X and B at half size: only blocks at even places have them."""
    draw = np.random.default_rng(9)
    grid = [(y, x, "dct8x8", 4) for y in range(2) for x in range(4)]
    values = [draw.integers(-3, 4, (3, 64)) for _ in grid]
    for v, (y, x, *_) in zip(values, grid):
        v[:, 0] = 0
        v[[0, 2]] *= not (y % 2 or x % 2)
    s, half = BitSink(), ((1, 1), (0, 0), (1, 1))
    (group,) = blocks.write_coefficients(s, [(values, grid)], 2, 4, shifts=half)
    got = blocks.read_coefficients(Bits(group), en.Code.read_from(Bits(s.bytes()), blocks.Contexts().total), grid, 2, 4, shifts=half)
    assert all((a == b).all() for a, b in zip(got, values))


def test_low_frequencies():
    draw = np.random.default_rng(3)
    x, y, b = (draw.integers(-50, 50, (3, 5)) for _ in range(3))
    s = BitSink()
    s.write(2, 1)
    modular.encode_stream(s, [y, x, b], [modular.Node(predictor=5)])
    whole, out = blocks.read_lf(Bits(s.bytes()), 3, 5, (2.0, 4.0, 8.0), (0.5, 1.0))
    assert (whole[0] == x).all() and (whole[1] == y).all()
    assert np.allclose(out[1], 2 * y) and np.allclose(out[0], x + y) and np.allclose(out[2], 4 * b + 2 * y)
    c = blocks.Contexts(lf=((0,), (-1, 3), (2,)))
    at = blocks.lf_index(c, whole)
    assert c.n_lf == 12 and at[1, 2] == ((x[1, 2] > 0) * 2 + (b[1, 2] > 2)) * 3 + (y[1, 2] > -1) + (y[1, 2] > 3)


def test_maps_that_cannot_be():
    for kinds, rows, cols in ((["dct16x16"], 1, 2), (["dct8x8"], 1, 2), (["dct8x8", "dct16x8", "dct16x16"], 2, 3), (["dct8x8"] * 31 + ["dct8x16"], 1, 40)):
        with pytest.raises(StreamError):
            blocks.placed(kinds, rows, cols)


@pytest.mark.parametrize("kind", [k for k in quant.SIZES if max(quant.SIZES[k]) <= 32])
def test_weights_by_their_definitions(kind):
    """Sample by sample, of the default parameters as they come back from a stream (exactly where halves can hold them)."""
    e = quant.default(kind)
    s = BitSink()
    quant.write_encodings(s, {kind: e})
    back = quant.read_encodings(Bits(s.bytes()))
    assert np.allclose(quant.weights(back[kind], kind), quant.weights(quant.Encoding("default"), kind), rtol=0.03)
    assert all(v.mode == "default" for k, v in back.items() if k != kind)

    def steps(v):
        out = [v[0]]
        for x in v[1:]:
            out.append(out[-1] * (1 + x) if x > 0 else out[-1] / (1 - x))
        return out

    def level(w, place):
        i = int(place)
        return w[i] * (w[i + 1] / w[i]) ** (place - i)

    def far(bands, y, x, h, w):
        n = len(bands) - 1
        return level(steps(bands), n / (2**0.5 + 1e-6) * ((y / (h - 1)) ** 2 + (x / (w - 1)) ** 2) ** 0.5)

    h, w = quant.SIZES[kind]
    got = quant.weights(e, kind)
    f = [0, 0, 0.8517778890324296, 5.37778436506804, 0, 0, 4.734747904497923, 5.449245381693219, 1.6598270267479331, 4, 7.275749096817861, 10.423227632456525, 2.662932286148962, 7.630657783650829, 8.962388608184032, 12.97166202570235]
    for c in range(3):
        for y in range(h):
            for x in range(w):
                v = None if e.values is None else e.values[c]
                if e.mode == "bands":
                    want = far(e.bands[c], y, x, h, w)
                elif e.mode == "identity":
                    want = {(0, 1): v[1], (1, 0): v[1], (1, 1): v[2]}.get((y, x), v[0])
                elif e.mode == "haar":
                    n = max(y, x).bit_length()
                    want = v[2 * n - 2 + (min(y, x) >= 1 << n - 1)] if n else 1
                elif e.mode == "quarters":
                    want = far(e.bands[c], y // 2, x // 2, 4, 4)
                elif e.mode == "halves":
                    want = far(e.bands[c], y // 2, x, 4, 8)
                elif (y, x) in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (2, 2)):
                    want = [1, *v[:5]][((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (2, 2)).index((y, x))]
                elif y % 2:
                    want = far(e.bands[c], y // 2, x, 4, 8)
                elif x % 2:
                    want = far(e.more[c], y // 2, x // 2, 4, 4)
                else:
                    want = level(steps(v[5:]), (f[2 * y + x // 2] - f[2]) * 3 / (f[15] - f[2] + 1e-6))
                assert np.isclose(got[c, y, x], want), (y, x)


def test_encodings_of_weights():
    raw = np.arange(1, 193).reshape(3, 8, 8)
    e = {"dct8x8": quant.Encoding("raw", raw, unit=0.25), "dct4x4": quant.Encoding("quarters", np.full((3, 2), 2.0), np.full((3, 1), 64.0)), "dct4x8": quant.Encoding("halves", np.full((3, 1), 0.5), np.full((3, 1), 128.0))}
    s = BitSink()
    quant.write_encodings(s, e, lambda s, v: modular.encode_stream(s, list(v), [modular.Node(predictor=1)]))
    got = quant.read_encodings(Bits(s.bytes()), lambda b, kind: np.stack(modular.decode_stream(b, [quant.SIZES[kind]] * 3)))
    assert np.allclose(quant.weights(got["dct8x8"], "dct8x8"), 4 / raw)
    w = quant.weights(got["dct4x4"], "dct4x4")
    assert (w[:, 0, 1] == 32).all() and (w[:, 1, 1] == 32).all() and (w[:, 2:] == 64).all()
    assert (quant.weights(got["dct4x8"], "dct4x8")[:, 1, 0] == 256).all()
    s = BitSink()
    quant.write_encodings(s, {})
    assert len(s.bytes()) == 1 and quant.read_encodings(Bits(s.bytes()))["corner"].mode == "default"
    for kind, bad in (("dct16x16", quant.Encoding("identity", np.ones((3, 3)))), ("dct8x8", quant.Encoding("bands", bands=np.zeros((3, 1))))):
        s = BitSink()
        quant.write_encoding(s, bad)
        with pytest.raises(StreamError):
            quant.read_encoding(Bits(s.bytes()), kind)


def tags_of(raw):
    n = struct.unpack_from(">I", raw, 128)[0]
    return {t: raw[at : at + size] for t, at, size in (struct.unpack_from(">4sII", raw, 132 + 12 * k) for k in range(n))}


def test_profiles_of_encodings(spark):
    raw = icc.profile("RGB", "D65", "SRG", "SRG", "Per")
    tags = tags_of(raw)
    assert struct.unpack_from(">I", raw)[0] == len(raw) and raw[36:40] == b"acsp" and len(raw) % 4 == 0
    assert tags[b"desc"][28:].decode("utf-16-be") == "sRGB" and tags[b"cicp"][8:] == bytes([1, 13, 0, 1])
    point = lambda t: np.frombuffer(tags[t][8:], ">i4") / 65536
    # published values of the colour space's profiles
    assert np.allclose([point(t) for t in (b"rXYZ", b"gXYZ", b"bXYZ")], [[0.43607, 0.22249, 0.01392], [0.38515, 0.71687, 0.09708], [0.14307, 0.06061, 0.71410]], atol=2e-4)
    assert np.allclose(np.frombuffer(tags[b"chad"][8:], ">i4") / 65536, [1.04788, 0.02292, -0.05022, 0.02959, 0.99048, -0.01707, -0.00925, 0.01508, 0.75168], atol=5e-4)  # of a rounder D65
    assert tags[b"rTRC"] == tags[b"gTRC"] == tags[b"bTRC"] and raw.count(b"para") == 1
    bare = bytearray(icc.profile("RGB", "D65", "SRG", "SRG", "Abs"))
    assert struct.unpack_from(">I", bare, 64)[0] == 3
    digest, bare[84:100], bare[64:68] = bytes(bare[84:100]), bytes(16), bytes(4)
    assert hashlib.md5(bare).digest() == digest
    grey = icc.profile("Gra", "DCI", None, 0.5)
    assert tags_of(grey)[b"desc"][28:].decode("utf-16-be") == "Gra_DCI_Rel_g0.5000000" and tags_of(grey)[b"kTRC"][12:] == struct.pack(">I", 2 << 16) and grey[16:20] == b"GRAY"
    with pytest.raises(NotImplementedError):
        icc.profile("RGB", "D65", "202", "PeQ")
    rows = [(1, "RGB", "D65", "202", "709", None, "Sat"), (2, "Gra", "EER", None, None, 0.25, "Abs")]
    got = icc.profiles(spark.createDataFrame(rows, "id long, space string, white string, primaries string, transfer string, gamma double, intent string")).collect()
    assert [bytes(r.icc) for r in got] == [icc.profile("RGB", "D65", "202", "709", "Sat"), icc.profile("Gra", "EER", None, 0.25, "Abs")]


@pytest.mark.parametrize("prefix", [True, False])
def test_profiles_in_streams(prefix):
    draw = random.Random(5)
    table = b"curv" + bytes(4) + struct.pack(">I", 64) + b"".join(struct.pack(">H", 16 * k * k) for k in range(64))
    all_ = [icc.profile("RGB", "D65", "DCI", "709"), icc.profile("Gra", "EER", None, 0.4), *(draw.randbytes(n) for n in (0, 1, 127, 128, 129, 131, 132, 700))]
    for maker in (b"APPL", b"MSFT", b"SGI ", b"SUNW", b"SAME", b"none", bytes(4)):
        size = 128 + 4 + 24 + len(table) + 20
        head = bytearray(draw.randbytes(128))
        head[40:44] = maker
        all_.append(bytes(head) + struct.pack(">I4sII4sII", 2, b"rTRC", 156, len(table), b"wtpt", 156 + len(table), 20) + table + b"XYZ " + bytes(4) + draw.randbytes(12))
        assert len(all_[-1]) == size
    for raw in all_:
        s = BitSink()
        profile.write_profile(s, raw, prefix)
        assert profile.read_profile(Bits(s.bytes())) == raw
        if raw:
            with pytest.raises((StreamError, EOFError)):
                profile.read_profile(Bits(s.bytes()[: len(s.bytes()) // 2]))


def test_commands_of_profiles():
    """Written by hand: three curves and three points at once, planes of two and four bytes, predictions of all orders and with a stride."""
    n = profile._number

    def build(size, commands, data):
        head = bytes((a - b) % 256 for a, b in zip(bytes(128), profile.expected_header(size, bytes(128))))
        return profile.rebuilt(n(size) + n(len(commands)) + commands + head + data)[128:]

    tags = build(128 + 4 + 72, n(7) + bytes([2 | 64 | 128]) + n(10) + n(14) + bytes([3 | 64]) + n(30) + bytes([0]), b"")
    assert tags == struct.pack(">I", 6) + b"".join(struct.pack(">4sII", *t) for t in ((b"rTRC", 10, 14), (b"gTRC", 10, 14), (b"bTRC", 10, 14), (b"rXYZ", 30, 20), (b"gXYZ", 50, 20), (b"bXYZ", 70, 20)))
    assert build(128 + 5, n(0) + bytes([2]) + n(5), b"acebd") == b"abcde"
    assert build(128 + 7, n(0) + bytes([3]) + n(7), b"aebfcgd") == b"abcdefg"
    start = bytes([1, 2, 4, 1, 2, 4, 1, 2, 4])
    for order, want in ((0, [4, 4]), (1, [6, 8]), (2, [7, 11])):
        assert list(build(128 + 11, n(0) + bytes([1, 9, 4, order << 2, 2]), start + bytes(2))[9:]) == want
    assert list(build(128 + 12, n(0) + bytes([1, 9, 4, 16, 3, 3]), start + bytes([0, 1, 0]))[9:]) == [1, 3, 4]
    for size, commands in ((129, n(0) + bytes([9])), (130, n(0) + bytes([1, 1])), (130, n(0) + bytes([4, 2, 1])), (140, n(9))):
        with pytest.raises(StreamError):
            build(size, commands, b"xyz")
