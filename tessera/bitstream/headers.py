"""File header, frame header and table of contents, field by field; writers make what the readers read back.

A reader takes Bits and gives a plain dictionary. Fields that a header leaves out have the format's defaults."""

from __future__ import annotations

from tessera.bitstream.bits import Bits, BitSink, StreamError
from tessera.bitstream.entropy import Code, Reader, encode, permutation_values, read_permutation

SIGNATURE = b"\xff\x0a"
# Width by height of the seven named aspect ratios.
RATIOS = ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))
_SIDE = ((9, 1), (13, 1), (18, 1), (30, 1))
_PLACE = ((8, 0), (11, 256), (14, 2304), (30, 18688))
_SECTION = ((10, 0), (14, 1024), (22, 17408), (30, 4211712))
FRAME_TYPES = ("regular", "lf", "reference", "skip_progressive")
NOISE, PATCHES, SPLINES, LF_FRAME, NO_SMOOTHING = 1, 2, 16, 32, 128
BLENDING = ("replace", "add", "blend", "weighted_add", "mul")
_ONE_TO_EIGHT = ((0, 1), (0, 2), (0, 4), (0, 8))


def read_size(b: Bits) -> tuple[int, int]:
    """(width, height): the height, then a ratio or the width."""
    small = b.flag()

    def side():
        return 8 * (b.read(5) + 1) if small else b.u32(*_SIDE)

    height, ratio = side(), b.read(3)
    if not ratio:
        return side(), height
    w, h = RATIOS[ratio - 1]
    return height * w // h, height


def write_size(s: BitSink, width: int, height: int) -> None:
    small = width % 8 == height % 8 == 0 and max(width, height) <= 256
    ratio = next((i + 1 for i, (w, h) in enumerate(RATIOS) if height * w // h == width), 0)

    def side(n):
        s.write(5, n // 8 - 1) if small else s.u32(n, *_SIDE)

    s.write(1, small)
    side(height)
    s.write(3, ratio)
    if not ratio:
        side(width)


def _depth(b: Bits) -> dict:
    if not b.flag():
        return {"float": False, "bits": b.u32((0, 8), (0, 10), (0, 12), (6, 1)), "exponent": 0}
    return {"float": True, "bits": b.u32((0, 32), (0, 16), (0, 24), (6, 1)), "exponent": b.read(4) + 1}


def _extensions(b: Bits) -> int:
    """Skips extensions; returns which there were."""
    which = b.u64()
    for n in [b.u64() for i in range(64) if which >> i & 1]:
        b.skip(n)
    return which


def _extra_channel(b: Bits) -> dict:
    out = {"kind": 0, "depth": {"float": False, "bits": 8, "exponent": 0}, "shift": 0, "name": "", "associated": False}
    if b.flag():
        return out
    out |= {"kind": b.enum(), "depth": _depth(b), "shift": b.u32((0, 0), (0, 3), (0, 4), (3, 1)), "name": b.string()}
    if out["kind"] == 0:
        out["associated"] = b.flag()
    elif out["kind"] == 2:
        out["spot"] = [b.f16() for _ in range(4)]
    elif out["kind"] == 5:
        out["cfa"] = b.u32((0, 1), (2, 0), (4, 3), (8, 19))
    return out


def _point(b: Bits) -> tuple[int, int]:
    coder = ((19, 0), (19, 524288), (20, 1048576), (21, 2097152))
    return b.signed(*coder), b.signed(*coder)


def _colour(b: Bits) -> dict:
    out = {"icc": False, "space": 0, "white": 1, "primaries": 1, "gamma": 0, "transfer": 13, "intent": 1}
    if b.flag():
        return out
    out |= {"icc": b.flag(), "space": b.enum()}
    if out["icc"]:
        return out
    if out["space"] != 2:
        out["white"] = b.enum()
        if out["white"] == 2:
            out["white_xy"] = _point(b)
        if out["space"] != 1:
            out["primaries"] = b.enum()
            if out["primaries"] == 2:
                out["primaries_xy"] = [_point(b) for _ in range(3)]
        if b.flag():
            out["gamma"] = b.read(24)
        else:
            out["transfer"] = b.enum()
    out["intent"] = b.enum()
    return out


def read_file_header(b: Bits) -> dict:
    """Behind the signature: size, metadata, transform data; ends at a byte unless a colour profile follows."""
    width, height = read_size(b)
    out = {"width": width, "height": height, "orientation": 1, "animation": None, "depth": {"float": False, "bits": 8, "exponent": 0}, "buffers16": True, "extra": [], "xyb": True, "colour": _colour(Bits(b"\x01")), "nits": 255.0, "intrinsic": None, "preview": None, "weights": {}}
    if not b.flag():
        more = b.flag()
        if more:
            out["orientation"] = b.read(3) + 1
            if b.flag():
                out["intrinsic"] = read_size(b)
            if b.flag():
                out["preview"] = _preview(b)
            if b.flag():
                out["animation"] = {"numerator": b.u32((0, 100), (0, 1000), (10, 1), (30, 1)), "denominator": b.u32((0, 1), (0, 1001), (8, 1), (10, 1)), "loops": b.u32((0, 0), (3, 0), (16, 0), (32, 0)), "timecodes": b.flag()}
        out["depth"] = _depth(b)
        out["buffers16"] = b.flag()
        out["extra"] = [_extra_channel(b) for _ in range(b.u32((0, 0), (0, 1), (4, 2), (12, 1)))]
        out["xyb"] = b.flag()
        out["colour"] = _colour(b)
        if more and not b.flag():
            out["nits"], out["least_nits"], out["relative"], out["linear_below"] = b.f16(), b.f16(), b.flag(), b.f16()
        _extensions(b)
    if not b.flag():
        if out["xyb"] and not b.flag():
            out["opsin"] = [b.f16() for _ in range(16)]
        mask = b.read(3)
        out["weights"] = {n: [b.f16() for _ in range(k)] for i, (n, k) in enumerate(((2, 15), (4, 55), (8, 210))) if mask >> i & 1}
    if not out["colour"]["icc"]:
        b.align()
    b.check()
    return out


def _preview(b: Bits) -> tuple[int, int]:
    eight = b.flag()

    def side():
        return 8 * b.u32((0, 16), (0, 32), (5, 1), (9, 33)) if eight else b.u32((6, 1), (8, 65), (10, 321), (12, 1345))

    height, ratio = side(), b.read(3)
    return (side(), height) if not ratio else (height * RATIOS[ratio - 1][0] // RATIOS[ratio - 1][1], height)


def write_file_header(s: BitSink, width: int, height: int, orientation: int = 1, bits: int = 8, xyb: bool = False, alpha: bool = False, animation: tuple[int, int] | None = None) -> None:
    write_size(s, width, height)
    s.write(1, 0)
    more = orientation > 1 or animation is not None
    s.write(1, more)
    if more:
        s.write(3, orientation - 1)
        s.write(2, 0)
        s.write(1, animation is not None)
        if animation:
            s.u32(animation[0], (0, 100), (0, 1000), (10, 1), (30, 1))
            s.u32(animation[1], (0, 1), (0, 1001), (8, 1), (10, 1))
            s.u32(0, (0, 0), (3, 0), (16, 0), (32, 0))
            s.write(1, 0)
    s.write(1, 0)
    s.u32(bits, (0, 8), (0, 10), (0, 12), (6, 1))
    s.write(1, bits <= 12)
    s.u32(int(alpha), (0, 0), (0, 1), (4, 2), (12, 1))
    if alpha:
        s.write(1, 1)
    s.write(1, xyb)
    s.write(1, 1)  # the default colour encoding
    if more:
        s.write(1, 1)  # the default tone mapping
    s.u64(0)
    s.write(1, 1)
    s.align()


def _blending(b: Bits, extra: int, full: bool) -> dict:
    mode = b.u32((0, 0), (0, 1), (0, 2), (2, 3))
    if mode >= len(BLENDING):
        raise StreamError("blending mode")
    out = {"mode": BLENDING[mode], "alpha": 0, "clamp": False, "source": 0}
    if extra and mode in (2, 3):
        out["alpha"] = b.u32((0, 0), (0, 1), (0, 2), (3, 3))
    if extra and mode in (2, 3, 4):
        out["clamp"] = b.flag()
    if not (full and mode == 0):
        out["source"] = b.u32((0, 0), (0, 1), (0, 2), (0, 3))
    return out


def _restoration(b: Bits, modular: bool) -> dict:
    out = {"gaborish": True, "weights": [0.115169525, 0.061248592] * 3, "iterations": 2, "sharpness": [i / 7 for i in range(8)], "scale": [40.0, 5.0, 3.5], "quant_mul": 0.46, "sigma0": 0.9, "sigma2": 6.5, "border": 2 / 3, "sigma": 1.0}
    if b.flag():
        return out
    out["gaborish"] = b.flag()
    if out["gaborish"] and b.flag():
        out["weights"] = [b.f16() for _ in range(6)]
    out["iterations"] = b.read(2)
    if out["iterations"]:
        if not modular and b.flag():
            out["sharpness"] = [b.f16() for _ in range(8)]
        if b.flag():
            out["scale"] = [b.f16() for _ in range(3)]
            b.skip(32)
        if b.flag():
            if not modular:
                out["quant_mul"] = b.f16()
            out["sigma0"], out["sigma2"], out["border"] = b.f16(), b.f16(), b.f16()
        if modular:
            out["sigma"] = b.f16()
    _extensions(b)
    return out


def read_frame_header(b: Bits, file: dict) -> dict:
    """file: of read_file_header. Ends at a byte."""
    extra = len(file["extra"])
    plain = {"mode": "replace", "alpha": 0, "clamp": False, "source": 0}
    out = {"type": "regular", "modular": False, "flags": 0, "ycbcr": False, "jpeg_upsampling": [0, 0, 0], "upsampling": 1, "group_shift": 1, "x_qm": 3 if file["xyb"] else 2, "b_qm": 2, "passes": 1, "pass_shifts": [], "crop": None, "blending": dict(plain), "extra_blending": [dict(plain) for _ in range(extra)], "duration": 0, "last": True, "save_as": 0, "save_before": False, "name": "", "lf_level": 0, "filter": _restoration(Bits(b"\x01"), False)}
    if b.flag():
        b.align()
        b.check()
        return _sized(out, file)
    out["type"], out["modular"], out["flags"] = FRAME_TYPES[b.read(2)], b.flag(), b.u64()
    lf = out["flags"] & LF_FRAME
    if not file["xyb"]:
        out["ycbcr"] = b.flag()
    if not lf:
        if out["ycbcr"]:
            out["jpeg_upsampling"] = [b.read(2) for _ in range(3)]
        out["upsampling"] = b.u32(*_ONE_TO_EIGHT)
        out["extra_upsampling"] = [b.u32(*_ONE_TO_EIGHT) for _ in range(extra)]
    if out["modular"]:
        out["group_shift"] = b.read(2)
    elif file["xyb"]:
        out["x_qm"], out["b_qm"] = b.read(3), b.read(3)
    if out["type"] != "reference":
        out["passes"] = b.u32((0, 1), (0, 2), (0, 3), (3, 4))
        if out["passes"] > 1:
            n = b.u32((0, 0), (0, 1), (0, 2), (1, 3))
            out["pass_shifts"] = [b.read(2) for _ in range(out["passes"] - 1)]
            scales = [b.u32(*_ONE_TO_EIGHT) for _ in range(n)]
            out["downsampling"] = list(zip([b.u32((0, 0), (0, 1), (0, 2), (3, 0)) for _ in range(n)], scales))
    if out["type"] == "lf":
        out["lf_level"] = b.u32((0, 1), (0, 2), (0, 3), (0, 4))
    elif b.flag():
        x, y = (b.signed(*_PLACE), b.signed(*_PLACE)) if out["type"] != "reference" else (0, 0)
        out["crop"] = (x, y, b.u32(*_PLACE), b.u32(*_PLACE))
    x, y, w, h = out["crop"] or (0, 0, file["width"], file["height"])
    full = x <= 0 and y <= 0 and x + w >= file["width"] and y + h >= file["height"]
    if out["type"] in ("regular", "skip_progressive"):
        out["blending"] = _blending(b, extra, full)
        out["extra_blending"] = [_blending(b, extra, full) for _ in range(extra)]
        if file["animation"]:
            out["duration"] = b.u32((0, 0), (0, 1), (8, 0), (32, 0))
            if file["animation"]["timecodes"]:
                out["timecode"] = b.read(32)
        out["last"] = b.flag()
    else:
        out["last"] = False
    if out["type"] != "lf" and not out["last"]:
        out["save_as"] = b.read(2)
    kept = out["type"] == "reference" or (not out["last"] and out["type"] != "lf" and (out["duration"] == 0 or out["save_as"] != 0))
    if out["type"] == "reference" or (kept and full and out["blending"]["mode"] == "replace"):
        out["save_before"] = b.flag()
    elif out["type"] == "lf":
        out["save_before"] = True
    out["name"] = b.string()
    out["filter"] = _restoration(b, out["modular"])
    _extensions(b)
    b.align()
    b.check()
    return _sized(out, file)


def _sized(out: dict, file: dict) -> dict:
    """With derived sizes: of the coded frame, its blocks, groups and low-frequency groups, and the number of sections."""
    w, h = out["crop"][2:] if out["crop"] else (file["width"], file["height"])
    scale = out["upsampling"] << 3 * out["lf_level"]
    w, h = -(-w // scale), -(-h // scale)
    dim = 128 << out["group_shift"]
    out |= {"width": w, "height": h, "blocks": (-(-w // 8), -(-h // 8)), "group": dim, "groups": (-(-w // dim), -(-h // dim)), "lf_groups": (-(-w // (8 * dim)), -(-h // (8 * dim)))}
    n, n_lf = out["groups"][0] * out["groups"][1], out["lf_groups"][0] * out["lf_groups"][1]
    out["sections"] = 1 if n == out["passes"] == 1 else 2 + n_lf + n * out["passes"]
    return out


def write_frame_header(s: BitSink, file: dict, duration: int = 0, last: bool = True, crop: tuple | None = None, mode: str = "replace", name: str = "", group_shift: int = 1, passes: int = 1) -> None:
    """A modular frame without filters."""
    s.write(1, 0)
    s.write(2, 0)
    s.write(1, 1)
    s.u64(0)
    if not file["xyb"]:
        s.write(1, 0)
    s.u32(1, *_ONE_TO_EIGHT)
    for _ in file["extra"]:
        s.u32(1, *_ONE_TO_EIGHT)
    s.write(2, group_shift)
    s.u32(passes, (0, 1), (0, 2), (0, 3), (3, 4))
    if passes > 1:
        s.write(2, 0)
        for _ in range(passes - 1):
            s.write(2, 0)
    s.write(1, crop is not None)
    if crop:
        for v in crop[:2]:
            s.u32(2 * v if v >= 0 else -2 * v - 1, *_PLACE)
        for v in crop[2:]:
            s.u32(v, *_PLACE)
    x, y, w, h = crop or (0, 0, file["width"], file["height"])
    full = x <= 0 and y <= 0 and x + w >= file["width"] and y + h >= file["height"]
    for m in [mode] + ["replace"] * len(file["extra"]):
        k = BLENDING.index(m)
        s.u32(k, (0, 0), (0, 1), (0, 2), (2, 3))
        if file["extra"] and k in (2, 3):
            s.u32(0, (0, 0), (0, 1), (0, 2), (3, 3))
        if file["extra"] and k in (2, 3, 4):
            s.write(1, 0)
        if not (full and k == 0):
            s.write(2, 0)
    if file["animation"]:
        s.u32(duration, (0, 0), (0, 1), (8, 0), (32, 0))
    s.write(1, last)
    if not last:
        s.write(2, 0)
        if full and mode == "replace" and duration == 0:
            s.write(1, 0)
    s.string(name)
    s.write(1, 0)
    s.write(1, 0)
    s.write(2, 0)
    s.u64(0)
    s.u64(0)
    s.align()


def read_contents(b: Bits, n: int) -> list[tuple[int, int, int]]:
    """The table of contents: (section, offset behind the table, length) in the order of the bytes."""
    order = list(range(n))
    if b.flag():
        code = Code.read_from(b, 8)
        reader = Reader(code, b)
        order = read_permutation(reader, n)
        reader.finish()
    b.align()
    sizes = [b.u32(*_SECTION) for _ in range(n)]
    b.align()
    b.check()
    out, at = [None] * n, 0
    for place, size in enumerate(sizes):
        out[place] = (place, at, size)
        at += size
    # the permutation names the place of each section
    return [(section, *out[place][1:]) for section, place in enumerate(order)]


def write_contents(s: BitSink, sizes: list[int], order: list[int] | None = None) -> None:
    """sizes in the order of the bytes; order: the place of each section."""
    s.write(1, order is not None)
    if order is not None:
        encode(s, permutation_values(order), 8)
    s.align()
    for n in sizes:
        s.u32(n, *_SECTION)
    s.align()


def section_kind(index: int, frame: dict) -> tuple[str, int, int]:
    """(kind, group, pass) of a section by its number."""
    n, n_lf = frame["groups"][0] * frame["groups"][1], frame["lf_groups"][0] * frame["lf_groups"][1]
    if frame["sections"] == 1:
        return "all", 0, 0
    if index == 0:
        return "lf_global", 0, 0
    if index <= n_lf:
        return "lf", index - 1, 0
    if index == n_lf + 1:
        return "hf_global", 0, 0
    return "hf", (index - n_lf - 2) % n, (index - n_lf - 2) // n
