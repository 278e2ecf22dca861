"""Rasters that are wider than the test tables: borders, keys, components by tiles, distance transforms."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldloom.operators import raster as R
from fieldloom.plans import catalog
from fieldloom.sources import bindings as B
from tests.conftest import SF
from tests.test_queries import rows

#: The queries that meet the last column, and some of each other kind.
WIDE = [n for n, sql in catalog.ORACLES.items() if B.LAST in sql] + ["i4_label_boundary", "i8_boundary_distance", "i20_flatten_forest", "j26_distance_transform", "w6_integral_image", "w17_oriented_non_max"]


def wide_tables(spark, folder: str, days: int) -> str:
    """The tables of SF, with events that span so many days."""
    os.makedirs(folder)
    for t in os.listdir(SF):
        if t != "events.parquet":
            os.symlink(f"{SF}/{t}", f"{folder}/{t}")
    e = pd.read_parquet(f"{SF}/events.parquet")
    n = len(e)
    parts = []
    for k in range(max(1, days // 25)):
        own = e.sample(min(n, max(200, 20_000 // (days // 25 + 1))), random_state=k).copy()
        own["ts"] = own["ts"] + pd.Timedelta(days=(days - 30) * k // max(1, days // 25 - 1) if days > 50 else 20 * k)
        own["value"] = own["value"] * (1 + 0.1 * (k % 5))
        parts.append(own)
    e = pd.concat(parts)
    e["event_id"] = np.arange(len(e))
    spark.createDataFrame(e).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    d = wide_tables(spark, str(tmp_path_factory.mktemp("wide") / "t"), 50)
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"create view {t[:-8]} as select * from '{d}/{t}{'/*.parquet' if t == 'events.parquet' else ''}'")
    return d, con


def alike(got: pd.DataFrame, want: pd.DataFrame) -> bool:
    """Equal but for the last digit of sums, which the order of adding may turn."""
    a, b = rows(got), rows(want)
    number = lambda x: float(x) if x not in ("NULL", "True", "False") and x.replace(".", "", 1).replace("-", "").replace("e", "").isdigit() else x
    same = lambda x, y: x == y or (isinstance(number(x), float) and isinstance(number(y), float) and abs(number(x) - number(y)) < 2e-3)
    return sorted(got.columns) == sorted(want.columns) and len(a) == len(b) and all(same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.mark.parametrize("name", sorted(WIDE))
def test_wide_raster_equals_sql(spark, wide, name):
    d, con = wide
    got, want = catalog.QUERIES[name](spark, d).toPandas(), con.execute(catalog.ORACLES[name]).fetchdf()
    assert alike(got, want)
    if name in ("w10_local_maxima", "i33_seed_grid", "a19_contour_energy"):
        assert B.raster_of(spark, d)[1] > 45 and ("c" not in got or got.c.max() > 40)
    spark.catalog.clearCache()


def flood(pixels: set, offsets) -> dict:
    """Each pixel's smallest reachable one, by column, then row."""
    seen = {}
    for start in sorted(pixels, key=lambda p: p[::-1]):
        todo = [start] if start not in seen else []
        while todo:
            p = todo.pop()
            if p in pixels and p not in seen:
                seen[p] = start
                todo += [(p[0] + a, p[1] + b) for a, b in offsets]
    return seen


def test_components_on_500_days(spark, tmp_path):
    d = wide_tables(spark, str(tmp_path / "t"), 500)
    ras = B.raster(spark, d).toPandas()
    assert ras.c.max() > 480
    n = catalog.QUERIES["i5_mask_components"](spark, d).toPandas()
    want = []
    for image, own in ras.groupby("image_id"):
        for k in range(1, 5):
            px = flood({(int(r), int(c)) for r, c in own.loc[own.val > 20 * k, ["r", "c"]].to_numpy()}, R.EIGHT)
            many = pd.Series(list(px.values())).value_counts() if px else {}
            want += [(image, k, (c - 1) * B.ROWS + r + 1, int(m)) for (r, c), m in many.items() if m >= 3]
    assert sorted(map(tuple, n[["image_id", "segment_id", "first_pixel", "n"]].to_numpy().tolist())) == sorted(want)
    lab = catalog.QUERIES["i6_label_components"](spark, d).toPandas()
    for (image, label), own in lab.groupby(["image_id", "label"]):
        px = flood({(r, c) for r, c in own[["r", "c"]].to_numpy().tolist()}, R.FOUR)
        assert {(r, c): k for r, c, k in own[["r", "c", "component"]].to_numpy().tolist()} == {p: (q[1] - 1) * B.ROWS + q[0] + 1 for p, q in px.items()}
    flat = catalog.QUERIES["i20_flatten_forest"](spark, d).toPandas()
    assert flat.groupby("image_id").node.nunique().eq(ras.groupby("image_id").size()).all() and len(flat) == len(ras)
    seg = catalog.QUERIES["i21_quick_segmentation"](spark, d).toPandas()
    assert len(seg) == len(ras) and (seg.groupby("image_id").n.max() < 24 * 500).all()
    spark.catalog.clearCache()


@pytest.mark.parametrize("offsets", [R.FOUR, R.EIGHT])
def test_components_by_tiles(spark, offsets):
    """Random masks, a snake through all tiles, repeated pixels, a column with a clashing name; edges only at tile borders."""
    rng = np.random.default_rng(1)
    masks = {0: {(int(r), int(c)) for r, c in rng.integers(-20, 40, (1_700, 2))}}
    masks[1] = {(r, c) for r in range(0, 40, 2) for c in range(60)} | {(r, 59 if r % 4 == 1 else 0) for r in range(1, 39, 2)}
    df = spark.createDataFrame([(i, r, c, "given") for i, px in masks.items() for r, c in [*px, *list(px)[:5]]], "m int, r int, c int, lr string")
    for tile in (4, 16):
        got = R.masks_components(df, ["m"], offsets, tile).collect()
        assert all(x.lr == "given" for x in got) and len(got) == sum(map(len, masks.values())) + 10
        for i, px in masks.items():
            assert {(x.r, x.c): (x.cr, x.cc) for x in got if x.m == i} == flood(px, offsets)
    assert R.masks_components(df.limit(0), ["m"], offsets).count() == 0


def envelope_brute(f, p, shift):
    x = np.arange(len(f))
    d = np.round(f[None, :] + p * (x[None, :] - x[:, None] - shift) ** 2, 9)
    return d.min(1), d.argmin(1)


def test_envelope_of_parabolas():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 60, 400):
        for f in (np.round(rng.uniform(0, 50, n), 1), rng.integers(0, 3, n) * 7.0, np.where(rng.uniform(size=n) < 0.2, 0, 1e9), -1.0 * np.arange(n) ** 2, np.zeros(n)):
            for p, shift in ((1.0, 0.0), (0.5, 1.0), (0.03, -2.5), (0.0, 3.0)):
                d, k = R._envelope(np.arange(n, dtype=float), f, np.arange(n, dtype=float), p, shift)
                wd, wk = envelope_brute(f, p, shift)
                assert (d == wd).all() and (k == wk).all()


def test_distance_transform_long_lines_and_gaps(spark):
    rng = np.random.default_rng(3)
    f = np.round(rng.uniform(0, 1e4, 10_000), 2)
    px = spark.createDataFrame(pd.DataFrame({"image_id": "i", "r": 0, "c": np.arange(10_000), "val": f}))
    got = R.distance_transform(px, "val", 0.7, 1.0, 1.0, 0.0).toPandas().sort_values("c")
    near = [np.round(f[max(0, c - 130) : c + 132] + 0.7 * (np.arange(max(0, c - 130), min(10_000, c + 132)) - c - 1) ** 2, 9).min() for c in range(10_000)]
    assert (got["dt"].to_numpy() == np.array(near)).all() and (got.v == 0).all()
    grid = rng.uniform(0, 9, (7, 9)).round(1)
    hole = rng.uniform(size=grid.shape) < 0.4
    cells = [("a", r, c, None if hole[r, c] else float(grid[r, c])) for r in range(7) for c in range(9)] + [("b", 0, 0, None), ("b", 0, 1, None)]
    got = R.distance_transform(spark.createDataFrame(cells, "image_id string, r int, c int, val double"), "val", 1.5, 1.0, 0.5, 0.5).collect()
    assert len(got) == 65
    for x in got:
        if x.image_id == "b":
            assert x["dt"] is None and x.u is None and x.v is None
        else:
            all_ = [(round(round(grid[v, u] + 1.5 * (u - x.c - 1) ** 2, 9) + 0.5 * (v - x.r - 0.5) ** 2, 9), v, u) for v in range(7) for u in range(9) if not hole[v, u]]
            assert (x["dt"], x.v, x.u) == min(all_)
    with pytest.raises(ValueError):
        R.distance_transform(px, "val", -1.0, 0, 1.0, 0)


def test_oriented_maxima_against_pixels(spark):
    rng = np.random.default_rng(5)
    val, o = rng.uniform(size=(9, 8)).round(2), rng.uniform(0, np.pi, (9, 8))
    o[4, 4], o[5, 5], o[6, 3], o[3, 3], o[2, 2] = 0, np.pi / 2, np.pi / 4, 3 * np.pi / 4, np.nan
    cells = [("a", r, c, float(val[r, c]), None if np.isnan(o[r, c]) else float(o[r, c]), 7) for r in range(9) for c in range(8)]
    got = R.oriented_maxima(spark.createDataFrame(cells, "image_id string, r int, c int, val double, o double, d int"), "val", "o").collect()
    kept = 0
    for x in got:
        want = 0.0
        if 0 < x.r < 8 and 0 < x.c < 7 and x.o is not None:
            t = (x.o + np.pi / 2) % np.pi
            step = np.array([np.sin(t), np.cos(t)]) / max(abs(np.sin(t)), abs(np.cos(t)))

            def at(p):
                low = np.floor(p + 1e-12).astype(int)
                f = p - low
                return sum(val[low[0] + i, low[1] + j] * abs(1 - i - f[0]) * abs(1 - j - f[1]) for i in (0, 1) for j in (0, 1) if abs(1 - i - f[0]) > 1e-9 and abs(1 - j - f[1]) > 1e-9)

            here = np.array([x.r, x.c], float)
            want = x.val if max(at(here + step), at(here - step)) <= x.val + 1e-9 else 0.0
            kept += want > 0
        assert x.kept == want and x.d == 7
    assert 3 < kept < 40
