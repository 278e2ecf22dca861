"""Scalar column expressions: bins, densities, colours, geometry, affinities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_search(x: Column, edges: list[float]) -> Column:
    """Number of edges <= x: bin 0 below the first, M from the last on."""
    return sum((F.when(x >= F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dsigmoid(x: Column) -> Column:
    return sigmoid(x) * (1 - sigmoid(x))


def gaussian(x: Column) -> Column:
    return F.lit(1 / math.sqrt(2 * math.pi)) * F.exp(-0.5 * x * x)


def dgaussian(x: Column) -> Column:
    return -x * gaussian(x)


def ddgaussian(x: Column) -> Column:
    return (x * x - 1) * gaussian(x)


def raised_cosine(x: Column, r: float) -> Column:
    """1 up to 1 - r, a half cosine down to 0 at 1."""
    if r <= 0:
        return (F.abs(x) <= 1).cast("double")
    return F.when(x < 1 - r, 1.0).when(x <= 1, 0.5 * (1 + F.cos((1 - r - x) / r * math.pi))).otherwise(0.0)


#: RGB to XYZ matrices by working space, white points by illuminant.
SPACES = {
    "CIE": ((0.488718, 0.310680, 0.200602), (0.176204, 0.812985, 0.0108109), (0.000000, 0.0102048, 0.989795)),
    "Adobe": ((0.576700, 0.185556, 0.188212), (0.297361, 0.627355, 0.0752847), (0.0270328, 0.0706879, 0.99124)),
}
WHITES = {
    "a": (0.4476, 0.4074), "b": (0.3324, 0.3474), "c": (0.3101, 0.3162), "e": (1 / 3, 1 / 3), "d50": (0.3457, 0.3585),
    "d55": (0.3324, 0.3474), "d65": (0.312713, 0.329016), "d75": (0.299, 0.3149), "d93": (0.2848, 0.2932),
}
GAMMA, LINEAR, SLOPE = 2.2, 0.00856, 903.3


def rgb_to_xyz(r: Column, g: Column, b: Column, space: str = "CIE") -> list[Column]:
    """Of channels from 0 to 1."""
    lin = [F.pow(c, F.lit(GAMMA)) for c in (r, g, b)]
    return [sum((F.lit(w) * c for w, c in zip(row, lin)), F.lit(0.0)) for row in SPACES[space]]


def xyz_to_rgb(x: Column, y: Column, z: Column, space: str = "CIE") -> list[Column]:
    import numpy as np

    back = np.linalg.inv(np.array(SPACES[space]))
    return [F.pow(F.greatest(F.lit(0.0), sum((F.lit(float(w)) * c for w, c in zip(row, (x, y, z))), F.lit(0.0))), F.lit(1 / GAMMA)) for row in back]


def _white(name: str) -> tuple[float, float, float]:
    xw, yw = WHITES[name]
    return xw / yw, 1.0, (1 - xw - yw) / yw


def _lightness(a: Column) -> Column:
    return F.when(a > LINEAR, F.pow(a, F.lit(1 / 3))).otherwise((SLOPE * a + 16) / 116)


def xyz_to_lab(x: Column, y: Column, z: Column, white: str = "e") -> list[Column]:
    fx, fy, fz = (_lightness(c / F.lit(w)) for c, w in zip((x, y, z), _white(white)))
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]


def xyz_to_luv(x: Column, y: Column, z: Column, white: str = "e") -> list[Column]:
    wx, wy, wz = _white(white)
    light = 116 * _lightness(y / F.lit(wy)) - 16
    base = x + 15 * y + 3 * z
    part = lambda c, k, w: F.when(base == 0, 0.0).otherwise(13 * light * (k * c / base - k * w / (wx + 15 * wy + 3 * wz)))
    return [light, part(x, 4, wx), part(y, 9, wy)]


def alpha_blend(fg: Column, bg: Column, coef: Column) -> Column:
    return F.round(bg + coef * (fg - bg))


def to_id(row: Column, col: Column, rows: int) -> Column:
    return (col - 1) * rows + row


def from_id(pixel: Column, rows: int) -> list[Column]:
    return [F.pmod(pixel - 1, F.lit(rows)) + 1, F.floor((pixel - 1) / rows) + 1]


def segment_geometry(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    dx, dy = x2 - x1, y2 - y1
    return {"length": F.sqrt(dx * dx + dy * dy), "angle": F.when(dy == 0, F.lit(math.pi / 2)).otherwise(F.atan(dx / dy)), "cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2}


def reflected(angle: Column, about: Column) -> Column:
    """The angle of a line mirrored at one of angle `about`."""
    return 2 * about - angle


#: Constant, then weight and scale of each cue (contour ic, brightness bp, texture tp, colour cp).
AFFINITY = {
    "C_P_SS": (2.0404, {"bp": (-0.4301, 0.1989), "tp": (-1.0353, 0.1639), "cp": (-0.5053, 0.3554)}),
    "C_IC_SS": (1.8682, {"ic": (-1.3113, 0.3130)}),
    "C_B_SS": (2.1585, {"ic": (-0.6615, 0.3130), "bp": (-0.3093, 0.1989), "tp": (-0.6605, 0.1639), "cp": (-0.2920, 0.3554)}),
    "G_P_SS": (2.1339, {"bp": (-0.6303, 0.1932), "tp": (-1.1480, 0.1348)}),
}


def affinity(kind: str, cues: dict[str, Column]) -> Column:
    """Logistic affinity of a pair from its cues; 0 where not finite."""
    base, weights = AFFINITY[kind]
    z = sum((cues[c] / F.lit(s) * F.lit(w) for c, (w, s) in weights.items()), F.lit(base))
    p = sigmoid(z)
    return F.when(p.isNull() | F.isnan(p), 0.0).otherwise(p)


#: Those of the sigmoid below.
def contrast_sigmoid(p: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.2 * p))
    return (1 / (1 + F.exp(-(F.lit(-2.6433) + 10.7998 * c))) - 0.0667) / 0.9333


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
