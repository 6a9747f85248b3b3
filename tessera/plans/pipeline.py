"""A planner of stage chains: checks channel types, sums halos and scales, drops stages that do nothing and pairs that cancel."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Stage:
    name: str
    takes: str = "float"  # type of its input channels
    gives: str = "float"
    border: tuple[int, int] = (0, 0)
    shift: tuple[int, int] = (0, 0)  # log2 of its up-scaling
    extend: bool = False
    identity: bool = False
    undoes: str = ""  # the name of a stage that this one inverts


@dataclass(frozen=True)
class Plan:
    stages: tuple[Stage, ...]
    halo: tuple[int, int]  # input samples needed around a tile
    scale: tuple[int, int]


class PlanError(ValueError):
    pass


def plan(stages: list[Stage], source: str = "float") -> Plan:
    kept: list[Stage] = []
    for s in stages:
        if s.identity:
            continue
        if kept and s.undoes and kept[-1].name == s.undoes:
            kept.pop()
        else:
            kept.append(s)
    kind, extended = source, False
    for s in kept:
        if s.takes != kind:
            raise PlanError(f"{s.name} takes {s.takes}, but gets {kind}")
        if extended and (any(s.border) or any(s.shift)):
            raise PlanError(f"{s.name} needs neighbours or scales after the canvas was extended")
        kind, extended = s.gives, extended or s.extend
    halo, scale = [0, 0], [0, 0]
    for s in reversed(kept):
        for axis in (0, 1):
            halo[axis] = -(-halo[axis] >> s.shift[axis]) if s.shift[axis] == 0 else -(-halo[axis] // (1 << s.shift[axis]))
            halo[axis] += s.border[axis]
            scale[axis] += s.shift[axis]
    return Plan(tuple(kept), tuple(halo), tuple(scale))


CHAIN = {
    "convert": Stage("convert", "int", "float"),
    "chroma_x": Stage("chroma_x", border=(1, 0), shift=(1, 0)),
    "chroma_y": Stage("chroma_y", border=(0, 1), shift=(0, 1)),
    "gaborish": Stage("gaborish", border=(1, 1)),
    "epf0": Stage("epf0", border=(3, 3)),
    "epf1": Stage("epf1", border=(2, 2)),
    "epf2": Stage("epf2", border=(1, 1)),
    "upsample2": Stage("upsample2", border=(2, 2), shift=(1, 1)),
    "noise": Stage("noise", border=(2, 2)),
    "xyb": Stage("xyb"),
    "from_linear": Stage("from_linear"),
    "to_linear": Stage("to_linear", undoes="from_linear"),
    "extend": Stage("extend", extend=True),
}


def frame_plan(epf_iterations: int = 0, gaborish: bool = True, upsampling: int = 1, noise: bool = False, xyb: bool = True, linear_output: bool = False) -> Plan:
    """The chain of one frame in its fixed order; header flags leave stages out."""
    names = ["convert"] + ["gaborish"] * gaborish
    names += ["epf0"] * (epf_iterations >= 3) + ["epf1"] * (epf_iterations >= 1) + ["epf2"] * (epf_iterations >= 2)
    names += ["upsample2"] * {1: 0, 2: 1, 4: 2, 8: 3}[upsampling] + ["noise"] * noise + ["xyb"] * xyb + ["from_linear", "extend"] + ["to_linear"] * linear_output
    stages = [CHAIN[n] for n in names]
    if linear_output:
        stages = [s for s in stages if s.name not in ("from_linear", "to_linear")]
    return plan([replace(s) for s in stages], "int")
