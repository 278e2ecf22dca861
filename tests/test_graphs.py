"""Merge trees and spectral groups against sequential and dense versions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph as G
from fieldloom.plans import catalog
from fieldloom.plans.q_graph import edges, region_borders
from tests.conftest import SF


def merges_in_turn(spark, borders):
    """One merge after the other, always the least (mean, a, b), regions in the order of their hashes."""
    ids = spark.createDataFrame([(int(i),) for i in sorted({x for r in borders for x in r[:2]})], "i long")
    order = {r.i: (r.h, r.i) for r in ids.select("i", F.xxhash64("i").alias("h")).collect()}
    return [(a[1], b[1], h) for a, b, h in merges_of([(order[a], order[b], s, n) for a, b, s, n in borders])]


def merges_of(borders):
    e = collections.defaultdict(lambda: [0, 0])
    for a, b, s, n in borders:
        if a != b:
            x = e[min(a, b), max(a, b)]
            x[0] += s
            x[1] += n
    out = []
    while e:
        (a, b), (s, n) = min(e.items(), key=lambda kv: (kv[1][0] / kv[1][1], kv[0]))
        out.append((a, b, s / n))
        new = collections.defaultdict(lambda: [0, 0])
        for (x, y), (s, n) in e.items():
            x, y = (b if x == a else x), (b if y == a else y)
            if x != y:
                t = new[min(x, y), max(x, y)]
                t[0] += s
                t[1] += n
        e = new
    return out


def test_merge_tree_equals_one_merge_after_another(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, (nodes, m, top) in enumerate([(2, 1, 5), (9, 20, 3), (40, 90, 4), (60, 150, 1_000), (30, 29, 2)]):
        ends = rng.integers(0, nodes, (m, 2)) if m != 29 else [(i, i + 1) for i in range(29)]
        rows += [(g, int(a), int(b), int(rng.integers(0, top)) * int(k), int(k)) for a, b in ends for k in [rng.integers(1, 4)]]
    df = spark.createDataFrame([*rows, (0, 0, 1, None, 1)], "graph_id long, a long, b long, s long, n long").repartition(3)
    got = collections.defaultdict(list)
    for r in G.merge_tree(df).collect():
        got[r.graph_id].append((r.a, r.b, r.height))
    for g in range(5):
        want = merges_in_turn(spark, [r[1:] for r in rows if r[0] == g])
        assert sorted(got[g]) == sorted(want)
        assert [h for _, _, h in want] == sorted(h for _, _, h in want)  # heights never fall
    assert G.merge_tree(df.limit(0)).count() == 0


@pytest.mark.parametrize("regions", [6, 4_096])
def test_merges_inside_ranges_of_ids(spark, monkeypatch, regions):
    """Ranges give the tree of one merge after another; a chain of rising borders inside one takes one round, not one a border."""
    monkeypatch.setattr(G, "REGIONS", regions)
    rng = np.random.default_rng(12)
    rows = [(0, i, i + 1, 3 * i + 1, 1) for i in range(60)]
    rows += [(1, i, i + d, int(rng.integers(0, 30)), int(rng.integers(1, 4))) for i in range(40) for d in (1, 8)]
    rounds = []
    monkeypatch.setattr(G, "stored", lambda df, own=G.stored: rounds.append(1) or own(df))
    df = spark.createDataFrame(rows, "graph_id long, a long, b long, s long, n long")
    got = G.merge_tree(df).collect()
    for g in (0, 1):
        assert sorted((r.a, r.b, r.height) for r in got if r.graph_id == g) == sorted(merges_in_turn(spark, [r[1:] for r in rows if r[0] == g]))
    assert regions < 100 or len(rounds) <= 3


def test_merge_tree_query(spark):
    borders = region_borders(spark, SF).collect()
    got = catalog.QUERIES["i31_merge_tree"](spark, SF).collect()
    for g in {r.graph_id for r in borders}:
        own = [(r.absorbed, r.kept, r.height) for r in got if r.graph_id == g]
        want = merges_in_turn(spark, [(r.a, r.b, r.s, r.n) for r in borders if r.graph_id == g])
        own, want = sorted(own), sorted(want)
        assert [r[:2] for r in own] == [r[:2] for r in want] and len(own) > 50
        assert np.allclose([r[2] for r in own], [r[2] / 1e6 for r in want], atol=1e-6)
    spark.catalog.clearCache()


def dense(rows):
    rows = list(rows)
    ids = sorted({r[0] for r in rows})
    at = {x: i for i, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b, w in rows:
        m[at[a], at[b]] += w
    return ids, m


def test_lanczos_equals_dense_eigenvalues(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g, n in enumerate((2, 3, 12, 40)):
        a = np.round(rng.uniform(size=(n, n)) * (rng.uniform(size=(n, n)) < 0.6 if n > 3 else 1), 3)
        a = a + a.T
        rows += [(g, i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]]
    df = spark.createDataFrame(rows, "graph_id long, src long, dst long, w double")
    values, vectors = G.lanczos(df, 3, rounds=30, tolerance=1e-7)
    values = {r.graph_id: r for r in values.collect()}
    vectors = vectors.collect()
    for g in range(4):
        ids, m = dense([r[1:] for r in rows if r[0] == g])
        want, _ = np.linalg.eigh(m)
        k = min(3, len(ids))
        assert np.allclose(values[g].value, want[::-1][:k], atol=1e-6) and max(values[g].residual) < 2e-5
        x = np.array([r.x for i in ids for r in vectors if r.graph_id == g and r.node == i])
        assert np.allclose(m @ x, x * np.array(values[g].value), atol=1e-5) and np.allclose(x.T @ x, np.eye(k), atol=1e-6)


def test_spectral_groups_of_the_raster(spark):
    """After 60 rounds: a vector across the trivial one, whose quotient is the value, near the dense second eigenvalue."""
    got = catalog.QUERIES["i32_spectral_grouping"](spark, SF).toPandas()
    both = G.both_ways(edges(spark, SF)).toPandas()
    assert len(got) == 720 * both.graph_id.nunique()
    for g, own in got.groupby("graph_id"):
        ids, m = dense(both.loc[both.graph_id == g, ["src", "dst", "w"]].itertuples(index=False))
        deg = m.sum(0)
        root = np.sqrt(deg)
        second = np.linalg.eigvalsh(m / root[:, None] / root[None, :])[-2]
        x = own.set_index("node").loc[ids].x.to_numpy()
        assert own.value.nunique() == 1 and second - 5e-3 < own.value.iloc[0] < second + 2e-5
        assert abs((deg * x).sum()) < 0.05 * np.sqrt((deg * x * x).sum() * deg.sum())
        assert (x @ m @ x) / (deg * x * x).sum() == pytest.approx(own.value.iloc[0], abs=5e-3)
        assert ((own.cluster == 1) == (own.x >= 0))[own.x.abs() > 1e-4].all() and 0 < own.cluster.sum() < len(ids)


def test_two_blocks_are_told_apart(spark):
    rng = np.random.default_rng(1)
    n = 60
    side = rng.permutation(n) < 25
    rows = [(0, i, j, 1.0 if side[i] == side[j] else 0.02) for i in range(n) for j in range(n) if i != j and (side[i] == side[j] or rng.uniform() < 0.3)]
    rows = sorted({(0, a, b, w) for _, a, b, w in rows} | {(0, b, a, w) for _, a, b, w in rows})
    got = {r.node: r.cluster for r in G.spectral_halves(spark.createDataFrame(rows, "graph_id long, src long, dst long, w double"), rounds=10).collect()}
    assert len({(side[i], got[i]) for i in range(n)}) == 2
