"""Rasters in long form (image_id, r, c, ...): neighbourhoods, morphology, integral images, components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.operators.components import connected_components
from fieldloom.operators.shared import checkpoint

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def shifted(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each pixel once per offset: r, c are the neighbour's, r0, c0 its own; all other columns stay."""
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets))).alias("_o")
    rest = [x for x in px.columns if x not in ("r", "c")]
    return px.select(*rest, F.col("r").alias("r0"), F.col("c").alias("c0"), o, "r", "c").select(*rest, "r0", "c0", (F.col("r") + F.col("_o.a")).alias("r"), (F.col("c") + F.col("_o.b")).alias("c"))


def square(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1)]


def disk(radius: float) -> list[tuple[int, int]]:
    k = int(radius)
    return [(a, b) for a, b in square(k) if a * a + b * b <= radius * radius]


def dilate(mask: DataFrame, grid: DataFrame, offsets: list[tuple[int, int]], by: list[str]) -> DataFrame:
    """Pixels of the grid (image_id, r, c) with a member among the offsets; by: what names a mask, image_id included."""
    grown = shifted(mask.select(*by, "r", "c"), offsets).select(*by, "r", "c").distinct()
    return grown.join(grid.select("image_id", "r", "c"), ["image_id", "r", "c"], "left_semi").select(*by, "r", "c")


def complement(mask: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    full = mask.select(*by).distinct().join(grid.select("image_id", "r", "c"), "image_id")
    return full.join(mask, [*by, "r", "c"], "left_anti").select(*by, "r", "c")


def erode(mask: DataFrame, grid: DataFrame, offsets: list[tuple[int, int]], by: list[str]) -> DataFrame:
    """Members without a non-member of the grid among the offsets."""
    gone = dilate(complement(mask, grid, by), grid, offsets, by)
    return mask.select(*by, "r", "c").join(gone, [*by, "r", "c"], "left_anti")


def boundary(mask: DataFrame, by: list[str]) -> DataFrame:
    """Members with a 4-neighbour that is none (the image's outside included)."""
    near = shifted(mask.select(*by, "r", "c"), FOUR)
    inside = near.join(mask.select(*by, "r", "c"), [*by, "r", "c"], "left_semi").groupBy(*by, "r0", "c0").agg(F.count("*").alias("k"))
    full = inside.where("k = 4").select(*by, F.col("r0").alias("r"), F.col("c0").alias("c"))
    return mask.select(*by, "r", "c").join(full, [*by, "r", "c"], "left_anti")


def within_radius(a: DataFrame, b: DataFrame, d2: float) -> DataFrame:
    """All pairs of an image with squared distance <= d2: a's columns, and b's with "2" at their end. Cells as wide as
    the radius make it an equi-join of each a with the nine cells around it."""
    k = max(1, math.ceil(math.sqrt(d2)))
    o = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in square(1)))).alias("_o")
    left = a.select("*", o).withColumn("_x", F.floor(F.col("r") / k) + F.col("_o.x")).withColumn("_y", F.floor(F.col("c") / k) + F.col("_o.y")).drop("_o")
    right = b.select("image_id", *(F.col(c).alias(f"{c}2") for c in b.columns if c != "image_id"), F.floor(F.col("r") / k).alias("_x"), F.floor(F.col("c") / k).alias("_y"))
    j = left.join(right, ["image_id", "_x", "_y"]).where((F.col("r") - F.col("r2")) ** 2 + (F.col("c") - F.col("c2")) ** 2 <= d2)
    return j.drop("_x", "_y")


def integral(px: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sum of value over rows <= r and columns <= c."""
    rows = W.partitionBy(*by, "r").orderBy("c").rowsBetween(W.unboundedPreceding, 0)
    cols = W.partitionBy(*by, "c").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    return px.withColumn("_s", F.sum(value).over(rows)).withColumn("integral", F.sum("_s").over(cols)).drop("_s")


def oriented_maxima(px: DataFrame, value: str, orientation: str) -> DataFrame:
    """px (image_id, r, c, ...) with `kept`: the value where neither neighbour across its orientation is greater, else 0.

    orientation: an angle along the structure (x to the right, y downwards). The two neighbours lie on its normal, at
    the edge of the 3 x 3 pixels around; each is interpolated between the two pixels beside it (to 6 digits; equal ones
    stay). Pixels on the image's border, or without an orientation, are 0. Windows along rows and columns."""
    x, y = W.partitionBy("image_id", "r").orderBy("c"), W.partitionBy("image_id", "c").orderBy("r")
    p = px.select("*", F.lag(value).over(x).alias("_w"), F.lead(value).over(x).alias("_e"))
    beside = {"_n": value, "_nw": "_w", "_ne": "_e"}, {"_s": value, "_sw": "_w", "_se": "_e"}
    p = p.select("*", *(F.lag(c).over(y).alias(n) for n, c in beside[0].items()), *(F.lead(c).over(y).alias(n) for n, c in beside[1].items()))
    t = F.pmod(F.col(orientation) + math.pi / 2, F.lit(math.pi))
    p = p.withColumn("_x", F.cos(t)).withColumn("_y", F.sin(t))
    flat, falls = F.abs("_x") >= F.abs("_y"), F.col("_x") * F.col("_y") >= 0
    d = F.when(flat, F.abs(F.col("_y") / F.col("_x"))).otherwise(F.abs(F.col("_x") / F.col("_y")))
    between = lambda a, b: F.round((1 - d) * F.col(a) + d * b + 1e-9, 6)
    pick = lambda a, b: F.when(falls, F.col(a)).otherwise(F.col(b))
    one = F.when(flat, between("_e", pick("_se", "_ne"))).otherwise(between("_s", pick("_se", "_sw")))
    two = F.when(flat, between("_w", pick("_nw", "_sw"))).otherwise(between("_n", pick("_nw", "_ne")))
    keep = (one <= F.round(F.col(value) + 1e-9, 6)) & (two <= F.round(F.col(value) + 1e-9, 6))
    return p.select(*px.columns, F.when(keep, F.col(value)).otherwise(0.0).alias("kept"))


#: Side of the tiles in which components are found before tiles are joined.
TILE = 64


def _tile_components(offsets: list[tuple[int, int]]):
    """Rows of one tile's mask (arrays r, c, at most TILE x TILE pixels) with each pixel's component: its smallest pixel by
    column, then row. A union-find over the pixels in that order, so a root is always the smallest."""
    back = [(a, b) for a, b in offsets if (b, a) < (0, 0)]

    def labels(r: list[int], c: list[int]) -> list[int]:
        place = {p: i for i, p in enumerate(zip(r, c))}
        root = list(range(len(r)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, (y, x) in enumerate(zip(r, c)):
            for a, b in back:
                j = place.get((y + a, x + b))
                if j is not None:
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
        return [find(i) for i in range(len(r))]

    def run(frames):
        for df in frames:
            rr, cc = [], []
            for r, c in zip(df["r"], df["c"]):
                at = labels(r.tolist(), c.tolist())
                rr.append(r[at])
                cc.append(c[at])
            yield df.assign(lr=rr, lc=cc)

    return run


def masks_components(mask: DataFrame, by: list[str], offsets: list[tuple[int, int]] = EIGHT, tile: int = TILE) -> DataFrame:
    """mask (by, r, c, ...) with cr, cc: the smallest pixel (by column, then row) that a mask's neighbours reach.

    Two levels of disjoint sets: a union-find inside each tile, which is one row of at most tile x tile pixels, then
    connected components of the tiles' components, of which only pixels on tile borders make edges. So what is shuffled
    as a graph grows with the borders, not with the pixels, and no key is packed: a component is named by its mask and
    pixel. by: what names a mask, image_id included; offsets: symmetric, one step at most. A repeated pixel counts once;
    the other columns of mask stay.
    """
    m = mask.select(*by, "r", "c").distinct()
    m = m.select(*by, F.floor(F.col("r") / tile).alias("_tr"), F.floor(F.col("c") / tile).alias("_tc"), "r", "c")
    px = F.sort_array(F.collect_list(F.struct("c", "r")))
    t = m.groupBy(*by, "_tr", "_tc").agg(px.alias("p")).select(*by, "_tr", "_tc", F.col("p.r").cast("array<long>").alias("r"), F.col("p.c").cast("array<long>").alias("c"))
    schema = ", ".join([*(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in t.columns), "lr array<long>", "lc array<long>"])
    t = t.mapInPandas(_tile_components(offsets), schema).select(*by, "_tr", "_tc", F.explode(F.arrays_zip("r", "c", "lr", "lc")).alias("p"))
    t = checkpoint(t.select(*by, "_tr", "_tc", "p.*"))
    edge = t.where(F.pmod("r", F.lit(tile)).isin(0, tile - 1) | F.pmod("c", F.lit(tile)).isin(0, tile - 1))
    near = shifted(edge.select(*by, "_tr", "_tc", "lr", "lc", "r", "c"), [(a, b) for a, b in offsets if (b, a) < (0, 0)])
    near = near.where((F.floor(F.col("r") / tile) != F.col("_tr")) | (F.floor(F.col("c") / tile) != F.col("_tc")))
    other = edge.select(*by, "r", "c", F.col("lr").alias("_r"), F.col("lc").alias("_c"))
    ends = near.join(other, [*by, "r", "c"]).select(F.struct(*by, "lc", "lr").alias("u"), F.struct(*by, F.col("_c").alias("lc"), F.col("_r").alias("lr")).alias("v"))
    comp = connected_components(ends.distinct()).select("node.*", F.col("component.lr").alias("cr"), F.col("component.lc").alias("cc"))
    t = t.join(comp, [*by, "lc", "lr"], "left").select(*by, F.col("r").cast(mask.schema["r"].dataType), F.col("c").cast(mask.schema["c"].dataType), F.coalesce("cr", "lr").alias("cr"), F.coalesce("cc", "lc").alias("cc"))
    return mask.join(t, [*by, "r", "c"])


def _envelope(x: np.ndarray, f: np.ndarray, q: np.ndarray, p: float, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place q the least f + p (x - q - shift)^2 (to 9 digits) and its index, the smallest on ties: the
    lower envelope of equal parabolas, kept as a stack in one pass over x (sorted)."""
    if p == 0:
        k = np.full(len(q), int(np.argmin(np.round(f, 9))))
        return np.round(f[k], 9), k
    stack, start = [0], [-np.inf]  # parabolas and where each begins to be the lowest
    for j in range(1, len(x)):
        while True:
            i = stack[-1]
            at = (x[i] + x[j]) / 2 + (f[j] - f[i]) / (2 * p * (x[j] - x[i]))
            if at < start[-1] - 1e-7:  # ties stay, as rounded values may be equal around them
                stack.pop()
                start.pop()
            else:
                break
        stack.append(j)
        start.append(at)
    stack, start = np.array(stack), np.maximum.accumulate(start)
    k = np.searchsorted(start, q + shift, "right") - 1
    best, at = np.full(len(q), np.inf), np.zeros(len(q), np.int64)
    step = 2
    while True:  # neighbours may be as low within the digits
        place = k + step
        own = stack[np.clip(place, 0, len(stack) - 1)]
        value = np.round(f[own] + p * (x[own] - q - shift) ** 2, 9)
        better = (value <= best) & (place >= 0)  # smaller ones come later
        best, at = np.where(better, value, best), np.where(better, own, at)
        step -= 1
        if step < -2 and not better.any():
            return best, at


def _lines(p: float, shift: float):
    """Rows of one line (arrays q: its cells, x and f: the parabolas, by x; w: what goes along with each) with the least
    value d of each cell, and the x and w where it is."""

    def run(frames):
        for df in frames:
            out = {"d": [], "at": [], "along": []}
            for q, x, f, w in zip(df["q"], df["x"], df["f"], df["w"]):
                if len(x):
                    d, k = _envelope(x.astype(float), f.astype(float), q.astype(float), p, shift)
                    out["d"].append(d)
                    out["at"].append(x[k])
                    out["along"].append(w[k])
                else:
                    for c in out.values():
                        c.append([None] * len(q))
            yield df[["image_id", "line", "q"]].assign(**out)

    return run


def _line_pass(px: DataFrame, line: str, place: str, value: str, along: str, p: float, shift: float) -> DataFrame:
    """(image_id, line, q, d, at, along) of every cell: one row a line, one pass over it."""
    kind = px.schema["image_id"].dataType.simpleString()
    cell = F.sort_array(F.collect_list(F.struct(F.col(place).cast("long").alias("x"), F.col(value).cast("double").alias("f"), F.col(along).cast("long").alias("w"))))
    lines = px.groupBy("image_id", F.col(line).cast("long").alias("line")).agg(cell.alias("p"))
    lines = lines.select("image_id", "line", F.col("p.x").alias("q"), F.filter("p", lambda s: s["f"].isNotNull()).alias("has"))
    lines = lines.select("image_id", "line", "q", *(F.col(f"has.{n}").alias(n) for n in "xfw"))
    schema = f"image_id {kind}, line long, q array<long>, d array<double>, at array<long>, along array<long>"
    out = lines.mapInPandas(_lines(p, shift), schema)
    return out.select("image_id", "line", F.explode(F.arrays_zip("q", "d", "at", "along")).alias("z")).select("image_id", "line", "z.*")


def distance_transform(px: DataFrame, value: str, p1: float, p2: float, p3: float, p4: float) -> DataFrame:
    """dt, u, v: the least value(v, u) + p1 (u - c - p2)^2 + p3 (v - r - p4)^2 (to 9 digits) and the column u and row v
    where it is (the smallest v, then u on ties): along rows, then along columns.

    A line is one row of arrays, and its lower envelope of parabolas takes one pass; so there are two shuffles of the
    pixels and a task holds some lines. Pixels without a value offer none; where a raster has no value at all dt is null.
    p1 and p3 must not be negative.
    """
    if p1 < 0 or p3 < 0:
        raise ValueError("parabolas that open downwards have no least value")
    row = _line_pass(px, "r", "c", value, "c", p1, p2)
    col = _line_pass(row.select("image_id", F.col("line").alias("r"), F.col("q").alias("c"), "d", F.col("at").alias("u")), "c", "r", "d", "u", p3, p4)
    like = lambda c, name: F.col(c).cast(px.schema[name].dataType)
    return col.select("image_id", like("q", "r").alias("r"), like("line", "c").alias("c"), F.col("d").alias("dt"), like("along", "c").alias("u"), like("at", "r").alias("v"))
