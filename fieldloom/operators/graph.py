"""Weighted edge tables (graph_id, src, dst, w) and hyperedges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window as W

from fieldloom.operators.shared import checkpoint, sized, stored

KEY = ["graph_id", "src", "dst"]


def summed(edges: DataFrame) -> DataFrame:
    """Parallel edges as one, their weights added."""
    return edges.groupBy(*KEY).agg(F.sum("w").alias("w"))


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY, "w").unionByName(flipped(edges))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("src").alias("node")).union(edges.select("graph_id", "dst")).distinct()


def with_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels la and lb of their ends. labels: graph_id, node, label."""
    a = labels.select("graph_id", F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select("graph_id", F.col("node").alias("dst"), F.col("label").alias("lb"))
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])


def cut_energies(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Per set (graph_id, set_id, node): cut, cut ratio, normalized and unbalanced cut over directed edges, and the shares
    of crossing edges below .05, .1, .2 and .4 of the graph's largest weight."""
    total = edges.groupBy("graph_id").agg(F.sum("w").alias("all"), F.max("w").alias("top"))
    e = edges.withColumn("eid", F.struct("src", "dst"))
    out = e.join(sets.withColumnRenamed("node", "src"), ["graph_id", "src"]).select("graph_id", "set_id", "eid", "w", F.lit(1).alias("a"), F.lit(0).alias("b"))
    into = e.join(sets.withColumnRenamed("node", "dst"), ["graph_id", "dst"]).select("graph_id", "set_id", "eid", "w", F.lit(0).alias("a"), F.lit(1).alias("b"))
    side = out.union(into).groupBy("graph_id", "set_id", "eid").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.first("w").alias("w"))
    side = side.join(F.broadcast(total), "graph_id")  # one row a graph
    cross, inner = F.col("a") != F.col("b"), (F.col("a") == 1) & (F.col("b") == 1)
    n = side.groupBy("graph_id", "set_id", "all").agg(
        F.sum(F.when(F.expr("a = 0 and b = 1"), F.col("w")).otherwise(0.0)).alias("cut"),
        F.count(F.when(F.expr("a = 0 and b = 1 and w > 0"), 1)).alias("n_cut"),
        F.sum(F.when(inner, F.col("w")).otherwise(0.0)).alias("e11"),
        F.sum("w").alias("touched"),
        F.count(F.when(cross, 1)).alias("n"),
        *(F.count(F.when(cross & (F.col("w") < t * F.col("top")), 1)).alias(f"b{i}") for i, t in enumerate((0.05, 0.1, 0.2, 0.4))),
    )
    e00 = F.col("all") - F.col("touched")
    zero = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return n.select(
        "graph_id", "set_id", "cut", zero(F.col("cut"), F.col("n_cut")).alias("cut_ratio"),
        (F.col("cut") * (zero(F.lit(1.0), F.col("cut") + e00) + zero(F.lit(1.0), F.col("cut") + F.col("e11")))).alias("ncut"),
        F.when(F.col("e11") == 0, 10000.0).otherwise(F.least(F.lit(10000.0), F.col("cut") / F.col("e11"))).alias("unbalanced"),
        *(zero(F.col(f"b{i}"), F.col("n")).alias(f"healthy{i}") for i in range(4)),
    )


def linkage(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Sum of the weights between each two labels."""
    return with_labels(edges, labels).groupBy("graph_id", "la", "lb").agg(F.sum("w").alias("w"))


def distances(edges: DataFrame, start: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Shortest distances from each graph's start node (graph_id, node) by rounds of relaxation; only nodes that became
    nearer send on."""
    best = checkpoint(start.select("graph_id", "node", F.lit(0.0).alias("d")))
    front = best
    for _ in range(max_rounds):
        step = front.toDF("graph_id", "src", "d").join(edges, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("n"))
        step = step.groupBy("graph_id", "node").agg(F.min("n").alias("n"))
        new = checkpoint(best.join(step, ["graph_id", "node"], "full").select("graph_id", "node", F.least("d", "n").alias("d"), (F.col("d").isNull() | (F.col("n") < F.col("d") - 1e-12)).alias("up")))
        best, front = new.select("graph_id", "node", "d"), new.where("up").select("graph_id", "node", "d")
        if not front.limit(1).count():
            return best
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def topological_levels(edges: DataFrame, max_rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """(levels of the nodes that can be ordered, edges on or behind cycles): sources are peeled off round by round."""
    left, todo = checkpoint(edges.select(*KEY)), checkpoint(nodes(edges))
    done = None
    for level in range(max_rounds):
        free = todo.join(left.select("graph_id", F.col("dst").alias("node")).distinct(), ["graph_id", "node"], "left_anti")
        free = checkpoint(free)
        if not free.limit(1).count():
            break
        row = free.withColumn("level", F.lit(level).cast("long"))
        done = row if done is None else done.union(row)
        todo = checkpoint(todo.join(free, ["graph_id", "node"], "left_anti"))
        left = checkpoint(left.join(free.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_anti"))
    else:
        raise RuntimeError(f"more than {max_rounds} levels")
    if done is None:
        done = todo.withColumn("level", F.lit(0).cast("long")).limit(0)
    return done, left


def roots(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of a forest (node, parent; roots are their own parent) by pointer jumping: log rounds of the depth."""
    p = checkpoint(parents.select("node", F.col("parent").alias("root")))
    for _ in range(max_rounds):
        up = p.select(F.col("node").alias("root"), F.col("root").alias("r2"))
        new = checkpoint(p.join(up, "root").select("node", F.col("r2").alias("root"), (F.col("r2") != F.col("root")).alias("moved")))
        p = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return p
    raise RuntimeError("the parents hold a cycle")


def ordered(levels: DataFrame) -> DataFrame:
    w = W.partitionBy("graph_id").orderBy("level", "node")
    return levels.withColumn("place", F.row_number().over(w).cast("long"))


def star_expansion(hyper: DataFrame) -> DataFrame:
    """Each hyperedge (graph_id, edge_id, nodes, value) of more than two nodes becomes an auxiliary node linked to its
    members with value / size; pairs stay edges. Auxiliary nodes are numbered -edge_id - 1."""
    big = hyper.where("size(nodes) > 2").select("graph_id", (-F.col("edge_id") - 1).alias("src"), F.explode("nodes").alias("dst"), (F.col("value") / F.size("nodes")).alias("w"))
    pair = hyper.where("size(nodes) = 2").select("graph_id", F.get("nodes", F.lit(0)).alias("src"), F.get("nodes", F.lit(1)).alias("dst"), F.col("value").alias("w"))
    return big.unionByName(pair)


#: Regions of a range (about) whose inner merges are one task's.
REGIONS = 4_096


def _inner_merges(key: tuple[pa.Scalar, ...], x: pa.Table) -> pa.Table:
    """The merges (a, b, height, to: what a's region is named at last) among the regions of one range, with all borders
    of these regions: from a region to the neighbour over its weakest border, until two choose each other. A chain that
    leads out of the range waits."""
    part = key[1].as_py()
    near: dict = {}
    own = set()
    for r in x.to_pylist():
        a, b = ((r[e]["h"], r[e]["id"]) for e in "ab")
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = (r["s"], r["n"])
        own.update(v for v, c in ((a, r["pa"]), (b, r["pb"])) if c == part)
    merges, up, waits = [], {}, set()
    for start in sorted(own):
        chain = [start] if start in near else []
        while chain and chain[-1] not in waits and near[chain[-1]]:
            u = chain[-1]
            height, a, b = min((s / n, min(u, v), max(u, v)) for v, (s, n) in near[u].items())
            v = b if u == a else a
            if v not in own or v in waits:
                waits.update(chain)
            elif len(chain) < 2 or v != chain[-2]:
                chain.append(v)
            else:
                del chain[-2:]
                merges.append((a, b, height))
                up[a] = b
                del near[b][a]
                for w, (s, n) in near.pop(a).items():
                    if w != b:
                        del near[w][a]
                        s0, n0 = near[b].get(w, (0, 0))
                        near[b][w] = near[w][b] = (s + s0, n + n0)
                chain = chain or [b]
    out = []
    for a, b, height in merges:
        to = b
        while to in up:
            to = up[to]
        out.append((a, b, height, to))
    kind = x.schema.field("a").type
    name = lambda c: pa.array([{"h": r[c][0], "id": r[c][1]} for r in out], kind)
    graph = pa.array([key[0].as_py()] * len(out), x.schema.field("graph_id").type)
    return pa.table([graph, name(0), name(1), pa.array([r[2] for r in out], pa.float64()), name(3)], ["graph_id", "a", "b", "height", "to"])


def _ranges(e: DataFrame) -> DataFrame:
    """Borders with the ranges pa and pb of their regions: equal shares of a graph's span of ids, some REGIONS regions in each
    (of their hashes, where ids are no numbers)."""
    number = isinstance(e.schema["a"].dataType["id"].dataType, NumericType)
    at = lambda c: F.col(f"{c}.id").cast("double") if number else F.col(f"{c}.h").cast("double")
    v = e.select("graph_id", at("a").alias("v")).union(e.select("graph_id", at("b"))).distinct()
    v = v.groupBy("graph_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.ceil(F.count("*") / REGIONS).alias("parts"))
    place = lambda c: F.least(F.col("parts") - 1, F.floor((at(c) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.col("parts"))).cast("long")
    return e.join(v, "graph_id").withColumns({"pa": place("a"), "pb": place("b")}).drop("lo", "hi", "parts")


def merge_tree(borders: DataFrame) -> DataFrame:
    """The merges (graph_id, a, b, height) that join regions over their weakest mean border until none is left.

    borders: (graph_id, a, b, s, n): the regions a and b meet at n places whose strengths sum to s (integers, so that
    sums have one value in any order). A merge takes the border of least s / n (on ties the first by a, then b, where
    regions are in the order of their hashes, and a comes before b); b names both from then on, and borders to a third
    region are added up. Heights never fall along the tree, so the merges up to a height are that level's regions: an
    ultrametric tree.

    A border that is the least of both its regions stays so until it is merged, whatever is merged elsewhere: a mean of
    two borders is no less than the smaller, and a greater name comes later on ties. So each round merges all such
    borders at once, and gives the tree that one merge after another would. Those inside a range of ids (some REGIONS
    regions, whose borders one task sees whole) are merged there one after another, so a round leaves little but what
    waits for other ranges, and rounds grow with the logarithm of the regions where ids say what is near; a round without
    any merge inside a range takes the borders that are such over the whole table. Borders of a region with itself, nulls and
    repeated rows: the first are left out, nulls too, the last are added up.
    """
    e = borders.where("a <> b and s is not null and n > 0").select("graph_id", *(F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")).alias(c) for c in "ab"), "s", "n")
    e = e.select("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", "n")
    # as a table: a checkpoint keeps what the optimizer knows of its rows, which would double in every round
    e = stored(e.groupBy("graph_id", "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    tree = e.select("graph_id", "a", "b", (F.col("s") / F.col("n")).alias("height")).limit(0)
    kind, name = (e.schema[c].dataType.simpleString() for c in ("graph_id", "a"))
    schema = f"graph_id {kind}, a {name}, b {name}, height double, to {name}"

    def best_of_both(e, rows):
        key = F.struct((F.col("s") / F.col("n")).alias("h"), "a", "b").alias("k")
        ends = e.select("graph_id", F.col("a").alias("x"), key).union(e.select("graph_id", F.col("b").alias("x"), key))
        best = ends.groupBy("graph_id", "x").agg(F.min("k").alias("k"))
        both = best.groupBy("graph_id", "k").agg(F.count("*").alias("m")).where("m = 2")
        return checkpoint(sized(both.select("graph_id", "k.a", "k.b", F.col("k.h").alias("height"), F.col("k.b").alias("to")), rows))

    rows = e.count()
    while rows:
        e = sized(e, rows)
        both = _ranges(e).withColumn("part", F.explode(F.array_distinct(F.array("pa", "pb"))))
        both = stored(both.groupBy("graph_id", "part").applyInArrow(_inner_merges, schema))
        if both.isEmpty():
            both = best_of_both(e, rows)
        tree = tree.union(both.drop("to"))
        for end in ("a", "b"):
            up = both.select("graph_id", F.col("a").alias(end), "to")
            e = e.join(up, ["graph_id", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        e = e.where("a <> b").select("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", "n")
        e = stored(sized(e.groupBy("graph_id", "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), rows))
        rows = e.count()
    return tree.select("graph_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "height")


def normalized(edges: DataFrame) -> DataFrame:
    """Edges (both ways) with w divided by the roots of both ends' sums of weights, which must be positive."""
    deg = edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.sum("w").alias("_d"))
    out = edges.join(deg.toDF("graph_id", "src", "_a"), ["graph_id", "src"]).join(deg.toDF("graph_id", "dst", "_b"), ["graph_id", "dst"])
    return out.select(*KEY, (F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))).alias("w"))


def _ritz(k: int):
    """Rows (graph_id, alpha, beta) to the k largest eigenvalues of the tridiagonal matrix, the vectors, and the residuals."""

    def run(frames):
        for df in frames:
            out = []
            for g, a, b in zip(df["graph_id"], df["alpha"], df["beta"]):
                end = np.flatnonzero(np.asarray(b) < 1e-9)
                m = int(end[0]) + 1 if len(end) else len(a)  # from there on the space is exhausted
                t = np.diag(np.asarray(a, float)[:m]) + np.diag(np.asarray(b, float)[: m - 1], 1) + np.diag(np.asarray(b, float)[: m - 1], -1)
                value, vector = np.linalg.eigh(t)
                own = np.argsort(-value)[:k]
                out.append((g, value[own].tolist(), vector[:, own].T.tolist(), np.abs(b[m - 1] * vector[m - 1, own]).tolist()))
            yield pd.DataFrame(out, columns=["graph_id", "value", "vector", "residual"])

    return run


def lanczos(edges: DataFrame, k: int = 2, rounds: int = 60, tolerance: float = 1e-5, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(values, vectors) of the k largest eigenvalues of each graph's symmetric matrix (edges both ways).

    values: graph_id, value (array, falling), residual (array); vectors: graph_id, node, x (array, one entry a value). Lanczos
    iteration: a round is one product of the edges with the newest vector (a join on the node and sums, partial ones
    first) and its orthogonalisation against all earlier ones, whose coefficients are sums over the nodes; only these
    leave the tasks, one row a graph, in which the small tridiagonal problem is solved. It ends when the residuals of
    all graphs are within the tolerance, which is looked at every tenth round, or after `rounds`; the residuals tell. A
    graph with fewer nodes than k has fewer values. The start is drawn by a hash of the node, so runs repeat.
    """
    edges = stored(edges.select(*KEY, "w").repartition("graph_id", "dst"))
    start = nodes(edges).withColumn("x", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5)
    norm = start.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("l"))
    state = checkpoint(start.join(norm, "graph_id").select("graph_id", "node", F.array(F.col("x") / F.col("l")).alias("q")))
    kind = edges.schema["graph_id"].dataType.simpleString()
    numbers: list[DataFrame] = []  # a row a graph from each round
    ritz = None
    for j in range(rounds):
        last = state.select("graph_id", F.col("node").alias("dst"), F.element_at("q", -1).alias("x"))
        y = edges.join(last, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        s = state.join(y, ["graph_id", "node"], "left").fillna(0.0, ["y"])
        c = s.select("graph_id", "y", F.posexplode("q").alias("i", "x")).groupBy("graph_id", "i").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
        c = c.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda z: z["c"]).alias("c"))  # j + 1 numbers
        along = F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        # as a table, without what the optimizer knows of the rounds before
        s = stored(s.join(c, "graph_id").select("graph_id", "node", "q", (F.col("y") - along).alias("y"), F.element_at("c", -1).alias("a")))
        own = s.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("y") ** 2)).alias("b"), F.first("a").alias("a"))
        own = checkpoint(own)
        numbers.append(own.select("graph_id", F.lit(j).alias("j"), "a", "b"))
        state = s.join(own, "graph_id").select("graph_id", "node", F.concat("q", F.array(F.when(F.col("b") < 1e-9, 0.0).otherwise(F.col("y") / F.col("b")))).alias("q"))
        if j % 10 == 9 or j == rounds - 1:
            small = reduce(DataFrame.union, numbers).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("j", "a", "b"))).alias("t"))
            small = small.select("graph_id", F.col("t.a").alias("alpha"), F.col("t.b").alias("beta"))
            ritz = checkpoint(small.mapInPandas(_ritz(k), f"graph_id {kind}, value array<double>, vector array<array<double>>, residual array<double>"))
            if (ritz.agg(F.max(F.array_max("residual"))).first()[0] or 0.0) <= tolerance:
                break
    one = lambda v: F.aggregate(F.zip_with(F.slice("q", F.lit(1), F.size(v)), v, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    vectors = state.join(ritz, "graph_id").select("graph_id", "node", F.transform("vector", one).alias("x"))
    return ritz.select("graph_id", "value", "residual"), vectors


def spectral_halves(edges: DataFrame, **options) -> DataFrame:
    """(graph_id, node, value, x, cluster) of every node: the second eigenvalue of the normalized matrix of symmetric edges
    (both ways, positive), the node's entry in its generalized eigenvector, turned so that the entry of largest size (the
    smallest node on ties) is positive, and the side (0 or 1) that its sign says: a normalized cut of each graph."""
    deg = edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.sum("w").alias("_d"))
    values, vectors = lanczos(normalized(edges), 2, **options)
    v = vectors.where("size(x) > 1").join(deg, ["graph_id", "node"]).select("graph_id", "node", (F.get("x", F.lit(1)) / F.sqrt("_d")).alias("x"))
    v = checkpoint(v)
    top = v.groupBy("graph_id").agg(F.max(F.struct(F.round(F.abs("x"), 9).alias("size"), (-F.col("node")).alias("node"), F.signum("x").alias("s"))).alias("t"))
    v = v.join(top, "graph_id").join(values, "graph_id")
    x = F.col("x") * F.col("t.s")
    return v.select("graph_id", "node", F.get("value", F.lit(1)).alias("value"), x.alias("x"), F.when(x >= 0, 1).otherwise(0).alias("cluster"))
