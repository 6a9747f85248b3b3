"""Operators that bring planes together: reference slots, blending on a canvas, patches, splines, orientation, saving."""

from __future__ import annotations

import math

from tessera.functions import transfer as t
from tessera.relational import Operator

ORIENTATIONS = {
    1: ("x", "y"), 2: ("w-1-x", "y"), 3: ("w-1-x", "h-1-y"), 4: ("x", "h-1-y"), 5: ("y", "x"), 6: ("h-1-y", "x"), 7: ("h-1-y", "w-1-x"), 8: ("y", "w-1-x"),
}
_SIZE = "with s as (select p.*, max(x) over () + 1 w, max(y) over () + 1 h from {plane} p)"
#: One number for the size, from a pre-aggregated scan, instead of a global window.
_SIZE = "with z as (select max(x)+1 w, max(y)+1 h from {plane}), s as (select p.y, p.x, p.v, z.w, z.h from {plane} p, z)"

# Frame k lies at (k, 2k) of a canvas that holds all frames whole. Frames save to the slot of their number, of four, and meet the last frame saved
# to another slot, as it is stored. The hints (to DuckDB comments) deal out the canvas's rows and send its few columns and frames to them.
_PLACED = "placed as (select frame, y + 2*frame y, x + frame x, v from {frames}), size as (select max(x) w, max(y) h from placed), f as (select distinct frame from {frames})"
_CANVAS = "ys as (select /*+ repartition(y) */ y from (select @each(h)) y from size) a), xs as (select @each(w)) x from size), canvas as (select /*+ broadcast(xs, f) */ f.frame, ref, y, x from ys cross join xs cross join refs f)"


def over_slot(ahead: int, v: str) -> str:
    """Each frame c on the whole canvas k with the frame o of the slot `ahead` of its own."""
    refs = f"refs as (select c.frame, max(o.frame) ref from f c left join f o on o.frame < c.frame and o.frame % 4 = (c.frame + {ahead}) % 4 group by c.frame)"
    return f"with {_PLACED}, {refs}, {_CANVAS} select k.frame, k.y, k.x, {v} v from canvas k left join placed c on c.frame = k.frame and c.y = k.y and c.x = k.x left join placed o on o.frame = k.ref and o.y = k.y and o.x = k.x"


# Patches (id, source rectangle, place, mode); drawn in the order of their ids.
PATCHES = [(0, 4, 2, 9, 7, 10, 5, "add"), (1, 0, 0, 16, 12, 20, 8, "replace"), (2, 8, 8, 12, 12, 22, 12, "add"), (3, 1, 3, 20, 4, 30, 20, "mul")]


def patch_query() -> str:
    rows = " union all ".join(f"select {i} id, {sx} sx, {sy} sy, {w} w, {h} h, {px} px, {py} py, '{mode}' mode" for i, sx, sy, w, h, px, py, mode in PATCHES)
    wide, high = max(p[3] for p in PATCHES), max(p[4] for p in PATCHES)
    nums = lambda n: " union all ".join(f"select {i} i" for i in range(n))
    steps = []
    # each patch becomes the pixels it covers: an equi-join on coordinates, never an interval join
    steps.append(f"patches as ({rows}), cover as (select id, mode, px+a.i x, py+b.i y, sx+a.i fx, sy+b.i fy from patches join ({nums(wide)}) a on a.i < w join ({nums(high)}) b on b.i < h)")
    steps.append("drawn as (select c.id, c.mode, c.x, c.y, f.v from cover c join {frames} f on f.frame = 1 and f.x = c.fx and f.y = c.fy)")
    last = "(select y, x, v from {frames} where frame = 0)"
    for i, *_, mode in PATCHES:
        e = {"add": "b.v+p.v", "replace": "p.v", "mul": "b.v*p.v"}[mode]
        steps.append(f"s{i} as (select b.y, b.x, case when p.v is null then b.v else {e} end v from {last} b left join (select * from drawn where id = {i}) p on p.x = b.x and p.y = b.y)")
        last = f"s{i}"
    return "with " + ", ".join(steps) + f" select y, x, round(v, 6) v from {last}"


#: Spline segments: centre, largest distance, 1/sigma, sigma/4 times intensity, three colours.
SEGMENTS = [(10.5 + 4.5 * k, 20 + 6 * math.sin(k / 2), 5.0, 0.8, 0.3, (0.5, 0.2 + k / 50, -0.1)) for k in range(10)]


def spline_query() -> str:
    rows = " union all ".join(f"select {i} id, {cx!r}e0 cx, {cy!r}e0 cy, {inv!r}e0 inv, {s4!r}e0 s4, {c[0]!r}e0 r, {c[1]!r}e0 g, {c[2]!r}e0 b, {math.floor(cy - d)} y0, {math.ceil(cy + d)} y1, {max(0, math.floor(cx - d + 0.5))} x0, {math.floor(cx + d + 0.5)} x1" for i, (cx, cy, d, inv, s4, c) in enumerate(SEGMENTS))
    nums = " union all ".join(f"select {i} i" for i in range(12))
    dist = "sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))"
    f = f"({t.erf(f'(({dist})*0.5e0+0.35355338e0)*inv')} - {t.erf(f'(({dist})*0.5e0-0.35355338e0)*inv')})"
    return (
        f"with seg as ({rows}), n as ({nums}), px as (select s.*, y0+a.i y, x0+b.i x from seg s join n a on y0+a.i <= y1 join n b on x0+b.i <= x1),"
        f" one as (select y, x, r, g, b, {f} f, s4 from px), ink as (select y, x, sum(r*s4*f*f) r, sum(g*s4*f*f) g, sum(b*s4*f*f) b from one group by y, x)"
        " select p.y, p.x, round(c0+coalesce(r, 0e0), 6) c0, round(c1+coalesce(g, 0e0), 6) c1, round(c2+coalesce(b, 0e0), 6) c2 from {rgb} p left join ink on ink.y = p.y and ink.x = p.x"
    )


OPERATORS = {
    "p14_patches": Operator("P14", patch_query(), ("frames",)),
    "p15_patch_rows": Operator("P15", "with patches as (" + " union all ".join(f"select {p[0]} id, {p[6]} y0, {p[6] + p[4]} y1" for p in PATCHES) + "), n as (" + " union all ".join(f"select {i} i" for i in range(max(p[4] for p in PATCHES))) + "), r as (select id, y0+i y from patches join n on y0+i < y1) select f.y, r.id from (select distinct y from {frames}) f join r on r.y = f.y", ("frames",)),
    "p16_splines": Operator("P16", spline_query(), ("rgb",)),
    "p26_frame_blending": Operator("P26", over_slot(3, "round(case when c.v is null then coalesce(o.v, 0e0) else c.v*least(greatest(c.v+0.5e0,0e0),1e0)+coalesce(o.v, 0e0) end, 6)"), ("frames",)),
    "p28_extend": Operator("P28", over_slot(1, "coalesce(c.v, o.v, 0e0)"), ("frames",)),
    "p30_save_rows": Operator("P30", "select y, x, " + ", ".join(f"{t.to_u8(f'c{i}')} s{i}" for i in (2, 1, 0)) + " from {rgb}", ("rgb",)),
    "d11_reference_slots": Operator("D11", "with f as (select frame, frame % 4 slot, count(*) n from {frames} group by frame), w as (select f.*, " + ", ".join(f"max(case when slot = {s} then frame end) over (order by frame rows between unbounded preceding and 1 preceding) slot{s}" for s in range(4)) + " from f) select frame, slot, n, slot0, slot1, slot2, slot3 from w", ("frames",)),
    "t7_timeline": Operator("T7", "with f as (select frame, count(*) n from {frames} group by frame) select frame, n*40e0 ms, sum(n*40e0) over (order by frame) until_ms from f", ("frames",)),
}
for _o, (_x, _y) in ORIENTATIONS.items():
    OPERATORS[f"p31_orientation{_o}"] = Operator("P31", f"{_SIZE} select cast({_y} as int) y, cast({_x} as int) x, v from s", ("plane",))
