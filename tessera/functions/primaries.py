"""Chromaticities to matrices (numpy on the driver, nine numbers each), named values, and an encoding's short description as SQL."""

from __future__ import annotations

import numpy as np

# Coordinates (x, y) of the named white points and of the red, green and blue primaries.
WHITE_POINTS = {"D65": (0.3127, 0.3290), "EER": (1 / 3, 1 / 3), "DCI": (0.314, 0.351)}
PRIMARIES = {
    "SRG": ((0.6399987, 0.33001015), (0.3000038, 0.60000336), (0.15000205, 0.059997204)),
    "202": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)),
    "DCI": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)),
}
TRANSFERS = ("709", "Lin", "SRG", "PeQ", "DCI", "HLG")
INTENTS = ("Per", "Rel", "Sat", "Abs")
#: (white point, primaries, transfer, intent) of encodings with a name of their own.
COMMON = {("D65", "SRG", "SRG", "Per"): "sRGB", ("D65", "DCI", "SRG", "Per"): "DisplayP3", ("D65", "202", "PeQ", "Rel"): "Rec2100PQ", ("D65", "202", "HLG", "Rel"): "Rec2100HLG"}
#: XYZ of the white to which profiles adapt, and the Bradford cone responses.
D50 = (0.96422, 1.0, 0.82521)
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))


def xyz(x: float, y: float) -> np.ndarray:
    """XYZ of a chromaticity at Y = 1."""
    if not 0 <= x <= 1 or not 0 < y <= 1:
        raise ValueError(f"chromaticity out of range: {x}, {y}")
    return np.array([x / y, 1.0, (1 - x - y) / y])


def rgb_to_xyz(primaries, white) -> np.ndarray:
    """The matrix whose columns are the primaries, scaled so that (1, 1, 1) is the white point."""
    p = np.column_stack([xyz(*c) for c in primaries])
    return p * np.linalg.solve(p, xyz(*white))


def adapt_to_d50(white) -> np.ndarray:
    """Bradford adaptation of XYZ from a white point to D50."""
    cones = np.array(BRADFORD)
    return np.linalg.inv(cones) @ np.diag((cones @ D50) / (cones @ xyz(*white))) @ cones


def description(space: str, white: str, primaries: str, transfer: str, intent: str) -> str:
    """SQL for the description from columns of short names; space is RGB, Gra or XYB."""
    named = " ".join(f"when {space}='RGB' and {white}='{w}' and {primaries}='{p}' and {transfer}='{t}' and {intent}='{i}' then '{n}'" for (w, p, t, i), n in COMMON.items())
    parts = {"RGB": (white, primaries, intent, transfer), "Gra": (white, intent, transfer), "XYB": (intent,)}
    return f"case {named} " + " ".join(f"when {space}='{s}' then concat_ws('_', '{s}', {', '.join(c)})" for s, c in parts.items()) + " end"
