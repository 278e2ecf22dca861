"""Every registered query against its SQL in DuckDB, and brute force for the rest."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.functions import vectors as V
from fieldloom.operators import cluster, components, graph, order, rank, raster, sets, shared
from fieldloom.plans import catalog
from fieldloom.sources import bindings as B
from fieldloom.sources import runs, stage
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return con


def rows(df: pd.DataFrame):
    def one(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        if hasattr(x, "tolist"):
            x = x.tolist()
        return repr(float(x) + 0.0) if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def vec(spark, x, name="v"):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], f"vec_id long, {name} array<double>")


def test_kernel_identities(spark):
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 3.1, (10, 10)), rng.uniform(0, 4.7, (7, 10))
    p = vec(spark, x).crossJoin(vec(spark, y, "c").withColumnRenamed("vec_id", "word"))
    for dist, kern in (("l2", "kl2"), ("l1", "kl1"), ("chi2", "kchi2"), ("hell", "khell"), ("js", "kjs")):
        k = V.KERNELS[kern]
        a, b = F.col("v"), F.col("c")
        worst = p.select(F.max(F.abs(V.METRICS[dist](a, b) - k(a, a) - k(b, b) + 2 * k(a, b))).alias("e")).first().e
        assert worst < 1e-9


def test_feature_map_approximates_its_kernel(spark):
    ys = np.linspace(0.01, 2, 50)
    df = spark.createDataFrame([(float(y),) for y in ys], "y double")
    for kernel, name, n in (("chi2", "kchi2", 3), ("intersection", "kl1", 15), ("js", "kjs", 5)):
        m = lambda c: V.homogeneous_map(F.array(c), n, 0.4, kernel)
        d = df.select(V.KERNELS["kl2"](m(F.lit(0.5)), m(F.col("y"))).alias("a"), V.KERNELS[name](F.array(F.lit(0.5)), F.array("y")).alias("b")).toPandas()
        assert (d.a - d.b).abs().max() < (0.2 if kernel == "intersection" else 2e-2)


def test_literal_values(spark):
    assert [r[0] for r in spark.createDataFrame([(float(x),) for x in range(-11, 11)], "x double").select(S.bin_search(F.col("x"), [float(e) for e in range(-10, 11)])).collect()] == list(range(22))
    ones = spark.createDataFrame([("i", r, c, 1.0) for r in range(5) for c in range(6)], "image_id string, r int, c int, val double")
    assert all(x.integral == (x.r + 1) * (x.c + 1) for x in raster.integral(ones, "val", ["image_id"]).collect())
    dot = spark.createDataFrame([("i", r, c, -2.0 if (r, c) == (1, 1) else 0.0) for r in range(3) for c in range(3)], "image_id string, r int, c int, val double")
    got = {(x.r, x.c): x.dt for x in raster.distance_transform(dot, "val", 1, 0, 1, 0).collect()}
    assert got == {(r, c): -[[0, 1, 0], [1, 2, 1], [0, 1, 0]][r][c] for r in range(3) for c in range(3)}
    corners = vec(spark, [[0, 0], [0, 1], [1, 0], [1, 1]])
    c = cluster.kmeans(corners, corners.toDF("word", "c"), 3)
    assert sorted(tuple(r.c) for r in c.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    labs = S.xyz_to_rgb(*S.rgb_to_xyz(F.lit(0.2), F.lit(0.5), F.lit(0.7)))
    assert np.allclose(spark.range(1).select(*labs).first(), (0.2, 0.5, 0.7))


def mmr_brute(score, iou, lam):
    n, chosen, out = len(score), [], []
    left = set(range(n))
    while left:
        val = {i: lam * score[i] - (1 - lam) * max([iou[i, j] for j in chosen], default=0.0) for i in left}
        best = min(left, key=lambda i: (-val[i], i))
        out.append((best, val[best]))
        chosen.append(best)
        left.remove(best)
    return out


def test_diversified_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    segs, pairs, want = [], [], {}
    for image in "ab":
        s, m = np.round(rng.uniform(size=12), 2), np.zeros((12, 12))
        for a in range(12):
            for b in range(a + 1, 12):
                if rng.uniform() < 0.5:
                    m[a, b] = m[b, a] = round(float(rng.uniform()), 2)
                    pairs.append((image, a, b, float(m[a, b])))
        segs += [(image, i, float(x)) for i, x in enumerate(s)]
        want[image] = mmr_brute(s, m, 0.75)
    got = rank.diversified(spark.createDataFrame(segs, "image_id string, segment_id long, score double"), spark.createDataFrame(pairs, "image_id string, a long, b long, iou double")).toPandas()
    for image, w in want.items():
        own = got[got.image_id == image].sort_values("rank")
        assert list(own.segment_id) == [i for i, _ in w]
        assert np.allclose(own.value, [v for _, v in w])


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (40, 20), (200, 150), (300, 299)):
        e = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] if m != 299 else [(i, i + 1) for i in range(299)]
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in e:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
        assert got == {x: find(x) for x in root}


def test_mask_components_against_flood_fill(spark):
    rng = np.random.default_rng(6)
    grid = rng.uniform(size=(12, 12)) < 0.45
    df = spark.createDataFrame([("i", 1, r, c) for r, c in zip(*map(lambda v: v.tolist(), np.nonzero(grid)))], "image_id string, segment_id long, r int, c int")
    got = {(x.r, x.c): (x.cc, x.cr) for x in raster.masks_components(df, ["image_id", "segment_id"], tile=5).collect()}
    seen = {}
    for start in sorted(zip(*np.nonzero(grid)), key=lambda p: p[::-1]):
        if start in seen:
            continue
        todo = [start]
        while todo:
            p = todo.pop()
            if p in seen or not (0 <= p[0] < 12 and 0 <= p[1] < 12) or not grid[p]:
                continue
            seen[p] = start[::-1]
            todo += [(p[0] + a, p[1] + b) for a, b in raster.EIGHT]
    assert got == {tuple(map(int, k)): tuple(map(int, v)) for k, v in seen.items()}


def test_distances_and_orders(spark):
    e = spark.createDataFrame([("g", 1, 2, 1.0), ("g", 2, 3, 1.0), ("g", 1, 3, 5.0), ("g", 3, 4, 0.5), ("h", 7, 8, 2.0), ("h", 8, 7, 2.0)], "graph_id string, src long, dst long, w double")
    d = {(r.graph_id, r.node): r.d for r in graph.distances(e, spark.createDataFrame([("g", 1), ("h", 8)], "graph_id string, node long")).collect()}
    assert d == {("g", 1): 0, ("g", 2): 1, ("g", 3): 2, ("g", 4): 2.5, ("h", 8): 0, ("h", 7): 2}
    levels, left = graph.topological_levels(e)
    assert {r.node: r.level for r in levels.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.graph_id for r in left.collect()} == {"h"}
    assert [r.node for r in graph.ordered(levels).orderBy("place").collect()] == [1, 2, 3, 4]


def test_global_rank_and_sums(spark):
    x = spark.range(1, 501).select(((F.col("id") * 7919) % 503).alias("k"))
    r = order.running_sums(order.global_rank(x, F.col("k")), {"s": F.col("k")}, block=16).orderBy("rank").toPandas()
    assert list(r["rank"]) == list(range(1, 501)) and list(r.k) == sorted(r.k) and list(r.s) == list(np.cumsum(r.k))
    assert order.global_rank(x.limit(0), F.col("k")).count() == 0


def test_run_audit(spark):
    grid = spark.createDataFrame([("i", r, c) for r in range(2) for c in range(1, 4)], "image_id string, r int, c int")
    bad = spark.createDataFrame([("i", 0, 0, 1, 3), ("i", 9, 1, 1, 2), ("i", 1, 1, 2, 2), ("i", 1, 1, 5, 5)], 'image_id string, label int, row int, start int, end int')
    got = sorted((r.what, r.r, r.c) for r in runs.audit(bad, grid, 3).collect())
    assert got == [("label", 1, 1), ("range", 1, 5), ("twice", 1, 2), ("unassigned", 1, 3)]


def test_shortest_paths(spark, tmp_path):
    from fieldloom.sources.files import shortest_paths

    for name in ("img1.jpg", "img1.mask.png", "img10.png", "b.png", "b.gif", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    names = spark.createDataFrame([("img1",), ("b",), ("none",), ("img10",)], "name string")
    got = {r.name: (r.path.split("/")[-1], r.extension) for r in shortest_paths(names, str(tmp_path)).collect()}
    assert got == {"img1": ("img1.jpg", ".jpg"), "b": ("b.gif", ".gif"), "img10": ("img10.png", ".png")}


def test_stage_computes_once(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(df.count())
        return df

    df = spark.range(10).withColumnRenamed("id", "key")
    stage.materialize_once(df.where("key < 4"), compute, "key", str(tmp_path / "s"))
    assert stage.materialize_once(df, compute, "key", str(tmp_path / "s")).count() == 10
    assert seen == [4, 6]


def test_svm_resumes_where_it_stopped(spark):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(1, 0.3, (10, 2)), rng.normal(-1, 0.3, (10, 2))]
    df = spark.createDataFrame([([float(a) for a in r], 1.0 if i < 10 else -1.0) for i, r in enumerate(x)], "x array<double>, y double")
    whole = cluster.svm(df, 2, 0.1, 6)
    assert np.allclose(whole, cluster.svm(df, 2, 0.1, 3, cluster.svm(df, 2, 0.1, 3), 4))
    assert all((1 if i < 10 else -1) * (r @ whole[:2] + whole[2]) > 0 for i, r in enumerate(x))


def test_bottleneck_loses_least_first():
    joint = {0: [0.25, 0.0], 1: [0.24, 0.01], 2: [0.0, 0.25], 3: [0.01, 0.24]}
    out = cluster.bottleneck(joint)
    assert {out[0][1:3], out[1][1:3]} == {(0, 1), (2, 3)} and out[0][3] <= out[1][3] <= out[2][3]


def test_max_energy_keeps_a_floor(spark):
    s = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", i, 100.0 - i) for i in range(3)], "image_id string, segment_id long, energy double")
    got = sorted((r.image_id, r.segment_id) for r in sets.max_energy(s, 5.0, 2).collect())
    assert got == [("a", i) for i in range(6)] + [("b", 1), ("b", 2)]


def test_windowed_histogram_is_bounded(spark, tmp_path):
    from fieldloom.streaming import incremental

    ev = B.table(spark, SF, "events").select("ts", F.hour("ts").alias("bin"))
    ev.repartition(3).write.parquet(str(tmp_path / "ev"))
    q = incremental.windowed_histogram(incremental.stream_of(spark, str(tmp_path / "ev"), ev.schema, 3), "ts", "bin").writeStream.format("memory").queryName("wh").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    want = ev.groupBy(F.date_trunc("day", "ts").alias("d"), "bin").count()
    got = spark.table("wh").groupBy(F.col("w.start").alias("d"), "bin").agg(F.max("h").alias("count"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


# rows without SQL, against brute force
def frame(spark, name):
    df = catalog.QUERIES[name](spark, SF).toPandas()
    spark.catalog.clearCache()
    return df


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def overlaps(spark):
    """{image: {(a, b): iou}} and the segments of the word sets, counted one by one."""
    own = {}
    for r in B.seg_pixels(spark, SF).collect():
        own.setdefault(r.image_id, {}).setdefault(r.segment_id, set()).add(r.pixel_id)
    return own, {i: {(a, b): len(x & y) / len(x | y) for a, x in s.items() for b, y in s.items() if a < b and x & y} for i, s in own.items()}


def test_overlaps_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(sets, "BLOCK", 2)
    own, want = overlaps(spark)
    got = {}
    for r in sets.iou(B.seg_pixels(spark, SF)).collect():
        assert r.inter == len(own[r.image_id][r.a] & own[r.image_id][r.b])
        got.setdefault(r.image_id, {})[r.a, r.b] = r.iou
    assert got == {i: p for i, p in want.items() if p}
    classes, near = sets.near_classes(B.seg_pixels(spark, SF), 0.3)
    name = {(r.image_id, r.segment_id): r["class"] for r in classes.collect()}
    assert name == {(i, a): min(b for b in s if s[b] == s[a]) for i, s in own.items() for a in s}
    assert {(r.image_id, r.a, r.b): r.iou for r in near.collect()} == {(i, a, b): v for i, p in want.items() for (a, b), v in p.items() if v >= 0.3 and name[i, a] == a and name[i, b] == b}


def test_overlaps_repeat_sets_seldom(spark):
    """Sets of an image of 2,500 segments go to two blocks, where they were repeated ten times; counts by both ways are right."""
    rng = np.random.default_rng(16)
    has = [np.unique(np.r_[rng.integers(0, 3_000, 12), rng.integers(0, 4, 2)]) for _ in range(2_500)]
    rows = [("x", i, [int(v) for v in x]) for i, x in enumerate(has)] + [("x", 2_500, []), ("y", 2_501, [1])]
    m = spark.createDataFrame(rows, "image_id string, segment_id long, x array<long>").withColumn("energy", (-F.col("segment_id")).cast("double"))
    assert sets.cells(m).where("image_id = 'x'").count() == 2 * 2_501
    one = np.zeros((2_500, 3_000), np.float32)
    for i, x in enumerate(has):
        one[i, x] = 1
    inter = np.triu((one @ one.T).astype(int), 1)
    got = sets.iou(m, 4, 9, digits=6, features=("energy",)).toPandas()
    a, b = np.nonzero((inter >= 4) & (inter <= 9))
    got = got.sort_values(["a", "b"])
    assert len(a) and list(got.a) == list(a) and list(got.b) == list(b) and list(got.inter) == list(inter[a, b])
    assert np.allclose(got.iou, [round(i / (len(has[p]) + len(has[q]) - i), 6) for p, q, i in zip(a, b, inter[a, b])], atol=1.1e-6)
    assert list(got.n_a) == [len(has[p]) for p in a] and list(got.energy_b) == list(-b)


def test_cells_of_an_image_are_dealt(spark, monkeypatch):
    """Blocks and cells of one image go to several tasks; a join on the image had left them all in one."""
    monkeypatch.setattr(sets, "BLOCK", 16)
    rows = [("x", i, list(range(i % 7, i % 7 + 5))) for i in range(200)]
    pairs = sets.iou(spark.createDataFrame(rows, "image_id string, segment_id long, x array<long>"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pairs.select("a", "b").distinct().count() == pairs.count() > 0


@pytest.mark.parametrize("block", [8, sets.BLOCK])
def test_linkage_edges_are_few_and_enough(spark, monkeypatch, block):
    """The forest of the cells' edges is that of all pairs, with ties, equal sets, disjoint ones and images apart."""
    monkeypatch.setattr(sets, "BLOCK", block)
    rng = np.random.default_rng(17)
    rows = [(image, 1_000 * k + i, [int(v) for v in np.unique(rng.integers(0, 12, 4)) + 100 * (i % 2)]) for k, image in enumerate("ab") for i in range(40)]
    m = spark.createDataFrame(rows, "image_id string, segment_id long, x array<long>")
    edges = sets.linkage_edges(m)
    if block > 40:
        assert edges.count() <= 2 * 39 < sets.iou(m).count()
    want = {tuple(r) for r in cluster.spanning_forest(sets.iou(m)).collect()}
    assert {tuple(r) for r in cluster.spanning_forest(edges).collect()} == want and len(want) > 60


@pytest.mark.parametrize("top, limit", [(None, {"MAX_GROUP": 5}), (4, {"MAX_GROUP": 5}), (None, {"MAX_PAIRS": 20})])
def test_diversified_in_rounds(spark, monkeypatch, top, limit):
    rng = np.random.default_rng(14)
    segs, pairs, want = [], [], {}
    for image, n in (("a", 30), ("b", 12), ("c", 3)):
        s, m = np.round(rng.uniform(size=n), 1), np.zeros((n, n))
        for a in range(n):
            for b in range(a + 1, n):
                if rng.uniform() < 0.2:
                    m[a, b] = m[b, a] = round(float(rng.uniform()), 1)
                    pairs.append((image, a, b, float(m[a, b])))
        segs += [(image, i, float(x)) for i, x in enumerate(s)]
        want[image] = mmr_brute(s, m, 0.75)[:top]
    for name, value in limit.items():
        monkeypatch.setattr(rank, name, value)
    got = rank.diversified(spark.createDataFrame(segs, "image_id string, segment_id long, score double"), spark.createDataFrame(pairs, "image_id string, a long, b long, iou double"), top=top).toPandas()
    for image, w in want.items():
        own = got[got.image_id == image].sort_values("rank")
        assert list(own.segment_id) == [i for i, _ in w] and np.allclose(own.value, [v for _, v in w])


def test_diversified_top_equals_brute_force(spark):
    """Ties, equal sets, a common element, repeated rows, a segment without elements, one without a score, a short image."""
    rng = np.random.default_rng(15)
    segs, seg, want = [], [], {}
    for image, n in (("a", 40), ("b", 12), (None, 9), ("c", 2)):
        has = [set(rng.choice(30, size=int(rng.integers(1, 15)), replace=False).tolist()) | {99} for _ in range(n)]
        if n > 2:
            has[1], has[2] = set(has[0]), set()
        s = np.round(rng.uniform(size=n), 1)
        m = np.array([[len(x & y) / max(1, len(x | y)) for y in has] for x in has])
        segs += [(image, i, float(x)) for i, x in enumerate(s)] + [(image, 0, float(s[0])), (image, n, None)]
        seg += [(image, i, p) for i, x in enumerate(has) for p in x for _ in range(1 + p % 2)]
        want[image] = mmr_brute(s, m, 0.75)[:6]
    segs, seg = spark.createDataFrame(segs, "image_id string, segment_id long, score double"), spark.createDataFrame(seg, "image_id string, segment_id long, pixel_id long")
    got = rank.diversified_top(segs, seg, 6).toPandas()
    del want[None]
    assert set(got.image_id) == set(want)
    for image, w in want.items():
        own = got[got.image_id == image].sort_values("rank")
        assert list(own.segment_id) == [i for i, _ in w] and np.allclose(own.value, [v for _, v in w]), image
    assert rank.diversified_top(segs.limit(0), seg.limit(0), 6).isEmpty()


@pytest.mark.parametrize("limit, block", [(200_000, sets.BLOCK), (5, 8)])
def test_diversified_by_sets(spark, monkeypatch, limit, block):
    """Ranks by sets are those by all pairs, over wide and narrow scores, ties, equal sets and an empty one."""
    rng = np.random.default_rng(18)
    monkeypatch.setattr(sets, "BLOCK", block)
    monkeypatch.setattr(rank, "MAX_GROUP", limit)
    segs, seg, want = [], [], {}
    for image, n, wide in (("a", 40, 3.0), ("b", 30, 0.4), ("c", 1, 1.0)):
        has = [set(rng.choice(25, size=int(rng.integers(1, 12)), replace=False).tolist()) for _ in range(n)]
        if n > 2:
            has[1], has[2] = set(has[0]), set()
        s = np.round(rng.uniform(size=n) * wide, 1)
        m = np.array([[len(x & y) / max(1, len(x | y)) for y in has] for x in has])
        segs += [(image, i, float(x)) for i, x in enumerate(s)]
        seg += [(image, i, p) for i, x in enumerate(has) for p in x]
        want[image] = mmr_brute(s, m, 0.75)
    segs, seg = spark.createDataFrame(segs, "image_id string, segment_id long, score double"), spark.createDataFrame(seg, "image_id string, segment_id long, pixel_id long")
    got = rank.diversified_sets(segs, seg).toPandas()
    for image, w in want.items():
        own = got[got.image_id == image].sort_values("rank")
        assert list(own.segment_id) == [i for i, _ in w] and np.allclose(own.value, [v for _, v in w]), image


def test_diversified_by_sets_holds_few_pairs(spark, monkeypatch):
    """Scores that lie close leave the order of all pairs open: rounds of candidates rank them as brute force does, and few of the pairs are ever kept."""
    monkeypatch.setattr(rank, "FIRST", 8)
    monkeypatch.setattr(sets, "BLOCK", 40)
    seen, whole = [], rank.diversified
    monkeypatch.setattr(rank, "diversified", lambda segs, pairs, *a: whole(segs, seen.append(shared.stored(pairs)) or seen[-1], *a))
    rng = np.random.default_rng(31)
    segs, rows, want = [], [], {}
    for image, n in (("a", 150), ("b", 33), ("c", 1)):
        has = [np.unique(np.r_[rng.integers(0, 60, int(rng.integers(1, 20))), 99]).tolist() for _ in range(n)]
        for i in range(5, n, 7):
            has[i] = list(has[i - 5])
        if n > 2:
            has[2] = []
        s = np.round(rng.uniform(size=n) * 0.1, 2)
        m = np.array([[len(set(x) & set(y)) / max(1, len(set(x) | set(y))) for y in has] for x in has])
        segs += [(image, i, float(x)) for i, x in enumerate(s)]
        rows += [(image, i, x) for i, x in enumerate(has)]
        want[image] = mmr_brute(s, m, 0.75)
    segs += [(None, 1, 0.5), (None, 2, 1.0)]
    got = rank.diversified_sets(spark.createDataFrame(segs, "image_id string, segment_id long, score double"), spark.createDataFrame(rows, "image_id string, segment_id long, x array<long>")).toPandas()
    for image, w in want.items():
        own = got[got.image_id == image].sort_values("rank")
        assert list(own.segment_id) == [i for i, _ in w] and list(own["rank"]) == list(range(1, len(w) + 1)) and np.allclose(own.value, [v for _, v in w]), image
    assert list(got[got.image_id.isna()].sort_values("rank").segment_id) == [2, 1]
    assert len(seen) > 2 and 0 < sum(p.count() for p in seen) < 150 * 149 / 4


def test_sets_are_packed(spark):
    """Sets as bytes are the sets again, also with more than 128 and 16,384 elements between two, empty ones and one without a block's words."""
    rng = np.random.default_rng(32)
    has = [[], [5], list(range(-20_000, 20_000)), [-20_000, 19_999], [-1, 200], []] + [rng.choice(40_000, 30, replace=False).tolist() for _ in range(20)] + [[123, 200]] * 3
    rows = [("x", i, i % 3 // 2, x) for i, x in enumerate(has)]
    own = sets.packed(spark.createDataFrame(rows, "image_id string, segment_id long, block long, x array<long>"))
    x, size, code = sets._elements(own.toArrow())
    ids, ends = x["segment_id"].to_pylist(), np.r_[0, np.cumsum(size)]
    words = np.unique(np.concatenate([np.array(v, np.int64) for v in has]))
    got = {i: sorted(words[code[ends[k] : ends[k + 1]]].tolist()) for k, i in enumerate(ids)}
    assert got == {i: sorted(v) for i, v in enumerate(has)}
    assert own.select(F.sum(F.length("x"))).first()[0] < 2 * sum(map(len, has))


def test_box_overlaps_are_dealt_by_pairs(spark, monkeypatch):
    """Blocks of boxes of full cells meet in keys of their own; a small file's many rows in cells are not broadcast."""
    monkeypatch.setattr(sets, "BOXES", 5)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        x, y = (rng.integers(-9, 30, 2) / 2).tolist()
        rows.append((f"m{i % 2}", i, x, y, x + float(rng.choice([0.5, 3.0, 24.0])), y + float(rng.choice([-1.0, 0.0, 2.0, 7.5]))))
    df = spark.createDataFrame(rows, "image_id string, box_id long, x1 double, y1 double, x2 double, y2 double")
    out = sets.box_iou(df, df, digits=6)
    want = []
    for m, p, a1, b1, a2, b2 in rows:
        for n, q, c1, d1, c2, d2 in rows:
            w, h = min(a2, c2) - max(a1, c1), min(b2, d2) - max(b1, d1)
            if m == n and w > 0 and h > 0:
                want.append((m, p, q, w * h / ((a2 - a1) * (b2 - b1) + (c2 - c1) * (d2 - d1) - w * h)))
    got = sorted(map(tuple, out.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], atol=6e-7)
    pairs = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in pairs.lower() and sets.box_iou(df.limit(0), df).count() == 0


@pytest.mark.parametrize("block", [8_192, 12])
def test_two_hops_without_paths(spark, monkeypatch, block):
    """Paths over a hub's neighbours are not made, in one block or many; an empty block loses nothing."""
    monkeypatch.setattr(sets, "BLOCK", block)
    rng = np.random.default_rng(9)
    seg, want = [], set()
    for image, n, wide in (("a", 90, 60), ("b", 40, 400), ("c", 1, 9), ("d", 7, 5)):
        has = [set(rng.choice(wide, size=min(wide, int(rng.integers(1, 9))), replace=False).tolist()) for _ in range(n)]
        seg += [(image, 3 * i, p) for i, x in enumerate(has) for p in x]
        near = np.array([[i != j and 2 <= len(x & y) <= 4 for j, y in enumerate(has)] for i, x in enumerate(has)])
        want |= {(image, 3 * i, 3 * j) for i in range(n) for j in range(i + 1, n) if not has[i] & has[j] and (near[i] & near[j]).any()}
    df = spark.createDataFrame(seg, "image_id string, segment_id long, pixel_id long")
    got = [tuple(r) for r in sets.two_hops(df, 2, 4).collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
    assert sets.two_hops(df.limit(0), 2, 4).count() == 0


@pytest.mark.parametrize("few", [0, 1_000])
def test_first_few_of_sets(spark, monkeypatch, few):
    """The first few come from one row a set, with the chosen ones' elements broadcast or joined."""
    monkeypatch.setattr(rank.shared, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(21)
    segs, sets_, want = [], [], {}
    for image, n in (("a", 30), ("b", 12), ("c", 1)):
        has = [set(rng.choice(20, size=int(rng.integers(1, 12)), replace=False).tolist()) for _ in range(n)]
        s = np.round(rng.uniform(size=n), 1)
        segs += [(image, i, float(x)) for i, x in enumerate(s)]
        sets_ += [(image, i, sorted(x)) for i, x in enumerate(has)]
        m = np.array([[len(x & y) / len(x | y) for y in has] for x in has])
        want[image] = mmr_brute(s, m, 0.75)[:4]
    segs, x = spark.createDataFrame(segs, "image_id string, segment_id long, score double"), spark.createDataFrame(sets_, "image_id string, segment_id long, x array<long>")
    got = rank.diversified_top(segs, x, 4).toPandas()
    for image, w in want.items():
        own = got[got.image_id == image].sort_values("rank")
        assert list(own.segment_id) == [i for i, _ in w] and np.allclose(own.value, [v for _, v in w]), image


def test_diversified_keep_n_query(spark):
    own, near = overlaps(spark)
    energy = {r.segment_id: r.energy for r in B.segments(spark, SF).collect()}
    got = frame(spark, "k4_diversified_keep_n")
    for image, s in own.items():
        ids = sorted(s)
        m = np.zeros((len(ids), len(ids)))
        for (a, b), v in near[image].items():
            m[ids.index(a), ids.index(b)] = m[ids.index(b), ids.index(a)] = v
        want = mmr_brute([-energy[i] / 10000 for i in ids], m, 0.75)[:3]
        rows = got[got.image_id == image].sort_values("rank")
        assert list(rows.segment_id) == [ids[i] for i, _ in want]


def test_ranking_query(spark):
    """i38: no image loses segments but small ones and near copies, and ranks go with falling values."""
    own, near = overlaps(spark)
    got = frame(spark, "i38_ranking")
    for image, s in own.items():
        rows = got[got.image_id == image].sort_values("rank")
        assert list(rows["rank"]) == list(range(1, len(rows) + 1)) and (np.diff(rows.value) <= 1e-6).all()
        big = {a for a in s if len(s[a]) >= 5}
        root = {a: a for a in big}
        for (a, b), v in near[image].items():
            if a in big and b in big and 1 - v < 0.05:
                x, y = find(root, a), find(root, b)
                root[max(x, y)] = min(x, y)
        assert len(rows) == len({find(root, a) for a in big}) and set(rows.segment_id) <= big


def test_farthest_and_grid_queries(spark):
    from fieldloom.plans.q_sets import regions

    far, grid = frame(spark, "k6_farthest"), frame(spark, "k7_around_grid")
    for image, x in regions(spark, SF).toPandas().groupby("image_id"):
        x = x.sort_values(["n", "segment_id"], ascending=[False, True])
        p, ids, n = x[["cr", "cc"]].to_numpy(), list(x.segment_id), list(x.n)
        chosen = list(range(min(2, len(ids))))
        while len(chosen) < min(6, len(ids)):
            mean = {i: round(float(np.mean([np.hypot(*(p[i] - p[j])) for j in chosen])), 9) for i in range(len(ids)) if i not in chosen}
            chosen.append(max(mean, key=lambda i: (mean[i], n[i], -ids[i])))
        own = far[far.image_id == image].sort_values("rank")
        assert set(own.segment_id[:2]) == {ids[i] for i in chosen[:2]} and list(own.segment_id) == [ids[i] for i in chosen]
        taken, want = set(), []
        for k, q in enumerate((10.0 * i, 10.0 * j) for i in range(5) for j in range(5)):
            free = [i for i in range(len(ids)) if ids[i] not in taken]
            if free:
                i = min(free, key=lambda i: (round(float(((p[i] - q) ** 2).sum()), 9), ids[i]))
                taken.add(ids[i])
                want.append((k, ids[i]))
        own = grid[grid.image_id == image].sort_values("point")
        assert list(zip(own.point, own.segment_id)) == want


def test_at_most_k_query(spark):
    own, near = overlaps(spark)
    energy = {r.segment_id: r.energy for r in B.segments(spark, SF).collect()}
    image_of = {r.segment_id: r.image_id for r in B.segments(spark, SF).collect()}
    got = frame(spark, "i10_at_most_k")
    for image in set(image_of.values()):
        ids = sorted(a for a, i in image_of.items() if i == image)
        root, left = {a: a for a in ids}, len(ids)
        for (a, b), _ in sorted(near.get(image, {}).items(), key=lambda kv: (-kv[1], kv[0])):
            x, y = find(root, a), find(root, b)
            if left > 5 and x != y:
                root[max(x, y)] = min(x, y)
                left -= 1
        heads = sorted({find(root, a) for a in ids})
        clusters = {}
        for a in ids:
            clusters.setdefault(min(heads.index(find(root, a)), 4), []).append(a)
        assert sorted(got[got.image_id == image].segment_id) == sorted(min(c, key=lambda a: (energy[a], a)) for c in clusters.values())


def test_merge_dust(spark):
    from fieldloom.plans.q_raster import merge_dust

    text = ["aaaab", "aacab", "adaab", "aaaae", "fgfff", "fffff"]
    rows = [("i", r, c, ord(ch)) for r, line in enumerate(text) for c, ch in enumerate(line, 1)] + [("j", 0, 1, 7), ("j", 0, 2, 8), ("k", 0, 1, 1)]
    got = {(x.image_id, x.r, x.c): x.label for x in merge_dust(spark.createDataFrame(rows, "image_id string, r int, c int, label long"), 4).collect()}
    want = ["aaaaa", "aaaaa", "aaaaa", "aaaaa", "fffff", "fffff"]
    assert "".join(chr(got["i", r, c]) for r in range(6) for c in range(1, 6)) == "".join(want)
    assert (got["j", 0, 1], got["j", 0, 2], got["k", 0, 1]) == (7, 7, 1)
    lab = frame(spark, "i7_merge_dust")
    assert lab.groupby(["image_id", "label"]).size().min() >= 4 and len(lab) == B.raster(spark, SF).count()


def test_approximate_neighbours_recall(spark):
    """At least nine of ten true neighbours, on the larger table, for every row as a query in turn."""
    from fieldloom.operators import search

    v = B.vectors(spark, "/root/testdata/sf0.01")
    for q in (v.where("vec_id % 20 = 0"), v.where("vec_id % 20 = 7")):
        want = {(r.vec_id, r.other) for r in search.exact(q, v, 10).collect()}
        got = {(r.vec_id, r.other) for r in search.approximate(q, v, 10).collect()}
        assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)
    x = np.array([r.v for r in v.orderBy("vec_id").collect()])
    d = ((x[:, None] - x[None, ::20]) ** 2).sum(2)
    assert {(q, o) for q, o in want} and d.shape[0] == v.count()


def test_exact_neighbours_in_blocks(spark, monkeypatch):
    from fieldloom.operators import search

    monkeypatch.setattr(search, "BLOCK", 7)
    rng = np.random.default_rng(21)
    x = np.r_[rng.normal(size=(40, 3)).round(1), np.zeros((4, 3))]
    v = vec(spark, x)
    got = {}
    for r in search.exact(v.where("vec_id % 3 = 0"), v, 5).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.other, round(r.dist, 6))
    for q in range(0, 44, 3):
        d = sorted((round(float(((x[q] - x[i]) ** 2).sum()), 9), i) for i in range(44) if i != q)[:5]
        assert got[q] == {k + 1: (i, round(a, 6)) for k, (a, i) in enumerate(d)}
    assert {(r.vec_id, r.other) for r in search.pairs(v.limit(9), v).collect()} and search.pairs(v.where("vec_id < 9"), v).count() == 9 * 44


def lloyd(x, centers, rounds):
    c = dict(centers)
    for _ in range(rounds):
        word = [min(c, key=lambda w: (round(float(((v - c[w]) ** 2).sum()), 9), w)) for v in x]
        c = {w: np.round(np.mean([v for v, k in zip(x, word) if k == w], 0), 6) if w in word else c[w] for w in c}
    return c


def test_integer_and_hierarchical_kmeans_queries(spark):
    rows = sorted((r.vec_id, r.v) for r in B.vectors(spark, SF).collect())
    ids, x = [i for i, _ in rows], np.floor(np.array([v for _, v in rows]) * 127 + 128 + 0.5)
    start = dict(zip(ids[:8], x[:8]))
    c = lloyd(x, lloyd(x[[i % 3 == 0 for i in ids]], start, 2), 2)
    got = frame(spark, "i14_integer_kmeans").set_index("vec_id").dist
    want = [min(((v - m) ** 2).sum() for m in c.values()) for v in x]
    assert np.allclose(got.loc[ids], want, rtol=1e-6)
    v = B.vectors(spark, SF)
    paths, levels = cluster.hierarchical(v, 3, 2)
    path = {r.vec_id: r.path for r in paths.collect()}
    for depth, level in enumerate(levels):
        centers = [(tuple(r.path), r.word, np.array(r.c)) for r in level.collect()]
        for i, a in rows:
            own = {w: round(float(((np.array(a) - m) ** 2).sum()), 9) for p, w, m in centers if p == tuple(path[i][:depth])}
            assert path[i][depth] == min(own, key=lambda w: (own[w], w))


def test_iterative_likelihood_query(spark):
    got = frame(spark, "x14_iterative_likelihood")
    ras = B.raster(spark, SF).toPandas()
    one = lambda a, k: {i: np.array([q]) for i, q in enumerate(np.percentile(a, [100 * (i + 0.5) / k for i in range(k)]))}
    edge = ras[ras.r.isin([0, 23]) | ras.c.isin([1, 30])].val.to_numpy()
    back = lloyd(edge[:, None], one(edge, 20), 2)
    bg = np.array([min(round(abs(v - m[0]), 9) for m in back.values()) for v in ras.val])
    far = ras.assign(bg=bg)
    seeds = far[far.bg > 100]
    if len(seeds) < 20:
        seeds = far.sort_values(["bg", "image_id", "r", "c"], ascending=[False, True, True, True]).head(20)
    fore = lloyd(seeds.val.to_numpy()[:, None], one(seeds.val.to_numpy(), 20), 2)
    fg = np.array([min(round(abs(v - m[0]), 9) for m in fore.values()) for v in ras.val])
    both = far.assign(f=200 * np.exp(-0.01 * fg), b=200 * np.exp(-0.01 * bg)).merge(got, on=["image_id", "r", "c"])
    assert len(both) == len(ras) == len(got)
    assert np.allclose(both.f, both.fg, atol=1e-3) and np.allclose(both.b, both.bg_y, atol=1e-3)


def test_cut_and_segmentation_queries(spark):
    n = frame(spark, "i18_tree_cut")
    assert len(n) == 5 and n.n.sum() == B.table(spark, SF, "events").count()
    seg, flat = frame(spark, "i21_quick_segmentation"), frame(spark, "i20_flatten_forest")
    flat = flat.assign(r=(flat.node - 1) % B.ROWS, c=(flat.node - 1) // B.ROWS + 1)
    val = B.raster(spark, SF).toPandas()[["image_id", "r", "c", "val"]]
    x = seg.merge(flat, on=["image_id", "r", "c"]).merge(val, on=["image_id", "r", "c"])
    g = x.groupby(["image_id", "cluster"])
    assert len(x) == len(seg) and np.allclose(x["mean"], g.val.transform("mean"), atol=2e-5) and (x.n == g.val.transform("size")).all()


def test_lambda_sweep_query(spark):
    from fieldloom.plans.q_graph import edges

    e = edges(spark, SF).toPandas()
    got = frame(spark, "i31_lambda_sweep")
    for (image, t), rows in got.groupby(["graph_id", "t"]):
        own = e[(e.graph_id == image) & (e.w >= t)]
        root = {x: x for x in {*own.src, *own.dst}}
        for a, b in zip(own.src, own.dst):
            x, y = find(root, a), find(root, b)
            root[max(x, y)] = min(x, y)
        want = own.assign(region=[find(root, a) for a in own.src]).groupby("region").w.agg(["size", "mean"])
        rows = rows.set_index("region").sort_index()
        assert list(rows.index) == list(want.index) and list(rows.n_edges) == list(want["size"])
        assert np.allclose(rows.mean_w, want["mean"], atol=2e-5)
    assert got.groupby("t").n_edges.sum().is_monotonic_decreasing


def test_curvature_query(spark):
    got = frame(spark, "w14_curvature").set_index(["image_id", "r"]).curvature
    for (image, r), p in B.raster(spark, SF).toPandas().groupby(["image_id", "r"]):
        p, out = p.sort_values("c"), []
        xs, ys = p.c.to_numpy(float), p.val.to_numpy() / 20
        for i in range(len(p)):
            x, y = xs[max(0, i - 3) : i + 4], ys[max(0, i - 3) : i + 4]
            if len(x) < 5:
                continue
            u, v = x - x.mean(), y - y.mean()
            z = u * u + v * v
            xx, yy, xy, xz, yz, zz = (float((a * b).mean()) for a, b in ((u, u), (v, v), (u, v), (u, z), (v, z), (z, z)))
            mz, cov = xx + yy, xx * yy - xy * xy
            poly = np.array([4.0, 0.0, 4 * cov - 3 * mz * mz - zz, zz * mz + 4 * cov * mz - xz * xz - yz * yz - mz**3, xz * xz * yy + yz * yz * xx - zz * cov - 2 * xz * yz * xy + mz * mz * cov])
            t = 0.0
            for _ in range(60):
                slope = np.polyval(np.polyder(poly), t)
                t = t if abs(slope) < 1e-12 else t - np.polyval(poly, t) / slope
            det = t * t - t * mz + cov
            if abs(det) < 1e-12:
                out.append(0.0)
                continue
            cx, cy = (xz * (yy - t) - yz * xy) / det / 2, (yz * (xx - t) - xz * xy) / det / 2
            out.append(1 / np.sqrt(cx * cx + cy * cy + mz + 2 * t))
        assert abs(np.mean(out) - got[image, r]) < 2e-4


def test_kmeans_on_square_corners(spark):
    """Four tight groups at the corners of a square: each centre ends in its own, whatever the order of the rows."""
    rng = np.random.default_rng(3)
    corners = np.array([[0, 0], [0, 9], [9, 0], [9, 9]], float)
    x = np.concatenate([c + rng.normal(0, 0.1, (30, 2)) for c in corners])
    v = vec(spark, x)
    for metric in ("l2", "l1"):
        c = cluster.kmeans(v.repartition(3), vec(spark, corners * 0.5 + 2, "c").withColumnRenamed("vec_id", "word"), 5, metric)
        got = {r.word: r.c for r in c.collect()}
        for k in range(4):
            own = x[30 * k : 30 * k + 30]
            want = own.mean(0) if metric == "l2" else np.sort(own, 0)[14]
            assert np.allclose(got[k], want, atol=1e-6)
