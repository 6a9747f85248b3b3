"""Noise and splines against published vectors; streams that arrive in pieces against plain Python."""

import numpy as np

from tessera.bitstream import headers
from tessera.bitstream.bits import Bits
from tessera.operators import noise, streams
from tessera.queries import QUERIES
from tessera.streaming import decoder

SF = "/root/testdata/sf0.001"


def test_generators_against_published_numbers():
    """The states of this vector come from one seed in turns."""
    z, s = np.array([12345 + 0x9E3779B97F4A7C15], dtype=np.uint64), []
    for _ in range(16):
        z = noise.split_mix(z)
        s.append(z[0])
    got = noise.steps(np.array(s[::2]), np.array(s[1::2]), 2)
    assert [hex(int(x)).upper()[2:] for x in got[0]] == ["6E901576D477CBB1", "E9E53789195DA2A2", "B681F6DDA5E0AE99", "8EFD18CE21FD6896", "A898A80DF75CF532", "50CEB2C9E2DE7E32", "3CA7C2FEB25C0DD0", "A4D0866B80B4D836"]
    assert [hex(int(x)).upper()[2:] for x in got[1]][:4] == ["8CD6A1E6233D3A26", "3D4603ADE98B112D", "DC427AF674019E36", "E28B4D230705AC53"]


def test_noise_by_plain_integers(spark):
    mask = (1 << 64) - 1

    def mix(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    rows = QUERIES["p18_noise"](spark, SF).where("frame = 3").collect()
    got = {(r.c, r.y, r.x): r.v for r in rows}
    w, h = max(x for _, _, x in got) - 255, 12
    a, b = [(3 << 32) + 0x9E3779B97F4A7C15 & mask], [(256 << 32) + 0x9E3779B97F4A7C15 & mask]
    for _ in range(8):
        a.append(mix(a[-1]))
        b.append(mix(b[-1]))
    state = list(zip(a[1:], b[1:]))
    for c in range(3):
        for y in range(h):
            for x in range(w):
                if x % 16 == 0:
                    numbers = []
                    for k, (p, q) in enumerate(state):
                        numbers.append(p + q & mask)
                        p ^= p << 23 & mask
                        state[k] = (q, p ^ q ^ p >> 18 ^ q >> 5)
                n = numbers[x % 16 // 2] >> 32 * (x % 2) & 0xFFFFFFFF
                assert got[c, y, 256 + x] == 1 + (n >> 9) / 2**23
    assert len(got) == 3 * w * h


def test_spline_dequantisation_against_published_numbers():
    dct = np.zeros((4, 32))
    dct[0, :3], dct[1, :2], dct[3, 0] = (12223, 9452, 5524), (177, 712), 139
    points, series = noise.dequantised((109, 54), [(109, 105), (-247, -261), (168, 427), (-46, -360), (-61, 181)], dct, 0, 0.0, 0.0)
    assert points.tolist() == [[109, 54], [218, 159], [80, 3], [110, 274], [94, 185], [17, 277]]
    assert np.allclose(series[0, :3], [36.300457, 39.69839859, 23.20079994], atol=1e-5)


def test_splines():
    line = noise.curve(np.array([[0.0, 0.0], [16.0, 0.0], [32.0, 0.0]]))
    assert np.allclose(line[:, 0], np.arange(33)) and np.allclose(line[:, 1], 0)
    points, gone = noise.evenly(np.array([[0.0, 0.0], [3.0, 4.0], [3.0, 6.5]]))
    assert len(points) == 9 and np.allclose(points[5], [3, 4]) and gone.tolist() == [1.0] * 8 + [0.5] and np.allclose(np.hypot(*np.diff(points[:-1], axis=0).T), 1)
    flat = np.zeros((1, 32))
    flat[0, 0] = 2.0
    assert np.allclose(noise.continuous(flat, np.array([0.0, 31.0])), 2 * np.sqrt(2))
    assert noise.segments((5, 5), [], np.zeros((4, 32)).tolist(), 0).shape == (0, 7)


def test_spline_geometry_in_batches_equals_single_splines(spark):
    """Rows to the last bit, and tasks by the number of keys, though the file is one."""
    got = {}
    df = QUERIES["p17_spline_geometry"](spark, SF)
    for r in df.collect():
        got.setdefault(r.id, {})[r.n] = tuple(r)[2:]
    ids = [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()]
    assert sorted(got) == sorted(ids)
    for i in ids[:60]:
        dct = [[(i * (c + 3) * (k + 1)) % 41 - 20 for k in range(32)] for c in range(4)]
        rows = noise.segments((i % 90, i % 70), [((i * k) % 23 + 1, (i + k) % 19 - 9) for k in range(1, 4 + i % 3)], dct, i % 5 - 2)
        assert [got[i][n] for n in range(len(got[i]))] == [tuple(round(float(x), 6) for x in s) for s in rows]
    x = np.array([0.0078125, -0.0078125, 2.5e-7, 1.0000005, 1.0000015, -3.4999995])
    assert noise.round6(x).tolist() == [round(v, 6) for v in x.tolist()]


def test_splines_of_many_keys_take_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(noise, "TASK", 40)
    assert QUERIES["p17_spline_geometry"](spark, SF).rdd.getNumPartitions() > 1


def test_headers_in_chunks(spark):
    files = {r.id: bytes(r.bytes) for r in streams._written(spark.read.parquet(f"{SF}/customer.parquet")).collect()}
    got = {}
    for r in QUERIES["t1_resumable"](spark, SF).collect():
        got.setdefault(r.id, {})[r.seq] = (r.stage, r.missing)
    assert set(got) == set(files)
    for i, raw in files.items():
        b = Bits(raw)
        b.skip(16)
        file = headers.read_file_header(b)
        info = b.at // 8
        stages = [got[i][k] for k in range(len(got[i]))]
        for k, (stage, missing) in enumerate(stages):
            have = min(3 * k + 3, len(raw))
            assert stage == ("frame_info" if have == len(raw) else "image_info" if have >= info else "initialised")
            assert (missing == 0) == (stage == "frame_info")
        assert file["width"] and stages[-1][0] == "frame_info"


def test_held_sections_by_plain_python(spark):
    got = {}
    for r in QUERIES["t3_held_sections"](spark, SF).where("frame < 3").collect():
        got[r.frame, r.section] = (r.arrival, r.released)
    for frame in range(3):
        arrival = {s: got[frame, s][0] for s in range(decoder.SECTIONS)}
        released = {}
        for s in range(decoder.SECTIONS):
            released[s] = max([arrival[s], *[released[n] for n in decoder.needs(s)]])
        assert released == {s: got[frame, s][1] for s in range(decoder.SECTIONS)}
