"""Transfer functions and other scalar formulas as SQL expressions that Spark and DuckDB both read. All odd: the sign is kept."""

from __future__ import annotations


def odd(f, v: str) -> str:
    return f"(case when ({v}) < 0 then -1e0 else 1e0 end * ({f(f'abs({v})')}))"


def srgb(v):
    return odd(lambda a: f"case when {a} <= 0.0031308e0 then 12.92e0*{a} else 1.055e0*pow({a}, 1e0/2.4e0)-0.055e0 end", v)


def srgb_inverse(v):
    return odd(lambda a: f"case when {a} <= 0.04045e0 then {a}/12.92e0 else pow(({a}+0.055e0)/1.055e0, 2.4e0) end", v)


def bt709(v):
    return odd(lambda a: f"case when {a} <= 0.018e0 then 4.5e0*{a} else 1.099e0*pow({a}, 0.45e0)-0.099e0 end", v)


def bt709_inverse(v):
    return odd(lambda a: f"case when {a} <= 0.081e0 then {a}/4.5e0 else pow(({a}+0.099e0)/1.099e0, 1e0/0.45e0) end", v)


# The PQ curve of SMPTE ST 2084.
M1, M2 = "(2610e0/16384e0)", "(2523e0/4096e0*128e0)"
C1, C2, C3 = "(3424e0/4096e0)", "(2413e0/4096e0*32e0)", "(2392e0/4096e0*32e0)"


def pq(v, nits=10000):
    """Linear light, 1 standing for `nits`, to PQ."""

    def f(a):
        p = f"pow({a}*{float(nits)}e0/10000e0, {M1})"
        return f"case when {a} = 0 then 0e0 else pow(({C1}+{C2}*{p})/(1e0+{C3}*{p}), {M2}) end"

    return odd(f, v)


def pq_inverse(v, nits=10000):
    def f(a):
        p = f"pow({a}, 1e0/{M2})"
        return f"case when {a} = 0 then 0e0 else pow(greatest({p}-{C1}, 0e0)/({C2}-{C3}*{p}), 1e0/{M1})*10000e0/{float(nits)}e0 end"

    return odd(f, v)


# The HLG curve of BT.2100.
A, B, C = "0.17883277e0", "0.28466892e0", "0.55991073e0"


def hlg(v):
    return odd(lambda a: f"case when {a} <= 1e0/12e0 then sqrt(3e0*{a}) else {A}*ln(12e0*{a}-{B})+{C} end", v)


def hlg_inverse(v):
    return odd(lambda a: f"case when {a} <= 0.5e0 then {a}*{a}/3e0 else (exp(({a}-{C})/{A})+{B})/12e0 end", v)


def gamma(v, g):
    return odd(lambda a: f"pow({a}, {float(g)}e0)", v)


def hlg_ootf(channels, luminances, nits, to_scene=False):
    """The channels times a power of their mixed luminance; unchanged if the exponent is small."""
    from math import log2

    g = 1.2 * 1.111 ** log2(nits / 1000)
    e = (1 - g) / g if to_scene else g - 1
    if abs(e) < 0.1:
        return channels
    mixed = "(" + "+".join(f"{w!r}e0*({c})" for c, w in zip(channels, luminances)) + ")"
    return [f"(({c})*pow(greatest({mixed}, 1e-12), {e!r}e0))" for c in channels]


# The format's coefficients of the error function, highest power first.
ERF = (7.77394369e-02, 2.05260015e-04, 2.32120216e-01, 2.77820801e-01)


def erf(v):
    """The error function as 1 - 1/q^4 with the format's polynomial q."""
    p4, p3, p2, p1 = (f"{c:.12f}e0" for c in ERF)
    return odd(lambda a: f"1e0-1e0/pow(1e0+{a}*({p1}+{a}*({p2}+{a}*({p3}+{a}*{p4}))), 4)", v)


def to_u8(v):
    return f"cast(floor(least(greatest(({v})*255e0, 0e0), 255e0)+0.5e0) as int)"


# Inverse opsin matrix of the public format.
OPSIN = [(11.031566901960783, -9.866943921568629, -0.16462299647058826), (-3.254147380392157, 4.418770392156863, -0.16462299647058826), (-3.6588512862745097, 2.7129230470588235, 1.9459282392156863)]


def xyb_to_linear(x, y, b, nits=255.0, m=OPSIN):
    """XYB to linear RGB, of the primaries that the matrix is for."""
    # Fixed value: opsin bias of the public format.
    bias = -0.0037930732552754493
    c, k = f"cbrt({bias!r}e0)", 255.0 / nits

    def part(v):
        return f"(pow({v}-{c}, 3e0)*{k!r}e0+{bias * k!r}e0)"

    lms = [part(f"({y}+{x})"), part(f"({y}-{x})"), part(f"({b})")]
    return ["(" + "+".join(f"({w!r}e0)*{s}" for w, s in zip(row, lms)) + ")" for row in m]


def ycbcr_to_rgb(cb, y, cr):
    yy = f"({y}+128e0/255e0)"
    return [f"({yy}+1.402e0*{cr})", f"({yy}-0.114e0*1.772e0/0.587e0*{cb}-0.299e0*1.402e0/0.587e0*{cr})", f"({yy}+1.772e0*{cb})"]
