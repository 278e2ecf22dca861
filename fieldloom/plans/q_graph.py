"""Queries over weighted graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.operators import graph as G
from fieldloom.operators import raster as R
from fieldloom.operators.components import connected_components
from fieldloom.operators.shared import stored
from fieldloom.plans.registry import query
from fieldloom.sources import bindings as B

r6 = lambda c: F.round(c, 6)

PIX = f"((c - 1) * {B.ROWS} + r + 1)::bigint"
BOTH = "bo as (select graph_id, src, dst, w from edge union all select graph_id, dst, src, w from edge)"
LAB = f"nl as (select image_id as graph_id, {PIX} as node, label from lab)"
SETS = f"st as (select image_id as graph_id, segment_id as set_id, {PIX} as node from mask)"


def edges(spark, d):
    return B.raster_graph(B.raster(spark, d))


def node_labels(spark, d):
    return B.label_map(B.raster(spark, d)).select(F.col("image_id").alias("graph_id"), B.pixel_id("r", "c").alias("node"), "label")


def node_sets(spark, d):
    return B.threshold_masks(B.raster(spark, d)).select(F.col("image_id").alias("graph_id"), F.col("segment_id").alias("set_id"), B.pixel_id("r", "c").alias("node"))


SIDE = """sd as (select e.graph_id, s.set_id, e.w, (a.node is not null)::int as a, (b.node is not null)::int as b, e.top, e.total
  from (select *, max(w) over (partition by graph_id) as top, sum(w) over (partition by graph_id) as total from bo) e join (select distinct graph_id, set_id from st) s using (graph_id)
  left join st a on a.graph_id = e.graph_id and a.set_id = s.set_id and a.node = e.src left join st b on b.graph_id = e.graph_id and b.set_id = s.set_id and b.node = e.dst),
en as (select graph_id, set_id, total, coalesce(sum(w) filter (a = 0 and b = 1), 0) as cut, count(*) filter (a = 0 and b = 1 and w > 0) as k, coalesce(sum(w) filter (a = 1 and b = 1), 0) as e11, coalesce(sum(w) filter (a = 0 and b = 0), 0) as e00,
  count(*) filter (a <> b) as n, count(*) filter (a <> b and w < 0.05 * top) as b0, count(*) filter (a <> b and w < 0.1 * top) as b1, count(*) filter (a <> b and w < 0.2 * top) as b2, count(*) filter (a <> b and w < 0.4 * top) as b3 from sd group by all)"""


@query(
    "a14_a18_cut_energies", B.RASTER, B.EDGES, BOTH, B.MASKS, SETS, SIDE,
    """select graph_id, set_id, round(cut, 6) as cut, round(case when k = 0 then 0 else cut / k end, 6) as cut_ratio,
       round(cut * (case when round(cut + e00, 6) = 0 then 0 else 1 / (cut + e00) end + case when round(cut + e11, 6) = 0 then 0 else 1 / (cut + e11) end), 5) as ncut,
       round(case when e11 = 0 then 10000.0 else least(10000.0, cut / e11) end, 5) as unbalanced,
       """ + ", ".join(f"round(case when n = 0 then 0 else b{i} / n end, 6) as healthy{i}" for i in range(4)) + " from en",
)
def a14(spark, d):
    """Cut, cut ratio, normalized cut, unbalanced cut and healthy-boundary shares of every mask."""
    e = G.cut_energies(G.both_ways(edges(spark, d)), node_sets(spark, d))
    return e.select("graph_id", "set_id", F.round("cut", 6).alias("cut"), r6("cut_ratio").alias("cut_ratio"), F.round("ncut", 5).alias("ncut"), F.round("unbalanced", 5).alias("unbalanced"), *(r6(f"healthy{i}").alias(f"healthy{i}") for i in range(4)))


LINK = "lk as (select e.graph_id, a.label as la, b.label as lb, sum(w) as w from bo e join nl a on a.graph_id = e.graph_id and a.node = src join nl b on b.graph_id = e.graph_id and b.node = dst group by all)"


@query("a22_linkage", B.RASTER, B.LABELMAP, B.EDGES, BOTH, LAB, LINK, "select graph_id, la, lb, round(w, 6) as w from lk")
def a22(spark, d):
    return G.linkage(G.both_ways(edges(spark, d)), node_labels(spark, d)).withColumn("w", F.round("w", 6))


PART = "pl as (select graph_id, la as label, sum(case when la = lb then w / 2 else w end) as degree, sum(case when la = lb then w / 2 else 0 end) as internal, sum(case when la <> lb then w else 0 end) as crossing, count(*) over (partition by graph_id) as k from lk group by graph_id, la)"


@query(
    "a23_partition_energy", B.RASTER, B.LABELMAP, B.EDGES, BOTH, LAB, LINK, PART,
    "select graph_id, round(sum(crossing), 6) as cut, round(sum(case when internal > 0 then crossing / internal end), 4) as sharon_ncut, round(sum(2 * crossing / degree), 5) as shi_cut from pl where k > 1 group by graph_id",
)
def a23(spark, d):
    """Energies of a partition into labels; graphs with a single label have none."""
    lk = G.linkage(G.both_ways(edges(spark, d)), node_labels(spark, d))
    same = F.col("la") == F.col("lb")
    pl = lk.groupBy("graph_id", "la").agg(F.sum(F.when(same, F.col("w") / 2).otherwise(F.col("w"))).alias("degree"), F.sum(F.when(same, F.col("w") / 2).otherwise(0.0)).alias("internal"), F.sum(F.when(~same, F.col("w")).otherwise(0.0)).alias("crossing"))
    out = pl.groupBy("graph_id").agg(F.count("*").alias("k"), F.round(F.sum("crossing"), 6).alias("cut"), F.round(F.sum(F.when(F.col("internal") > 0, F.col("crossing") / F.col("internal"))), 4).alias("sharon_ncut"), F.round(F.sum(2 * F.col("crossing") / F.col("degree")), 5).alias("shi_cut"))
    return out.where("k > 1").drop("k")


@query("a24_association", B.RASTER, B.LABELMAP, B.EDGES, BOTH, LAB, LINK, "s as (select graph_id, la, sum(case when la = lb then w else 0 end) / sum(w) as q from lk group by all)", "select graph_id, round(case when count(*) <= 1 then 0 else 1 - avg(q) end, 6) as ncut from s group by graph_id")
def a24(spark, d):
    lk = G.linkage(G.both_ways(edges(spark, d)), node_labels(spark, d))
    s = lk.groupBy("graph_id", "la").agg((F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("q"))
    return s.groupBy("graph_id").agg(r6(F.when(F.count("*") <= 1, 0.0).otherwise(1 - F.avg("q"))).alias("ncut"))


@query("a25_normalized_laplacian", B.RASTER, B.EDGES, BOTH, "dg as (select graph_id, src, sum(w) as d from bo group by all)", "select e.graph_id, e.src, e.dst, round(w / sqrt(a.d * b.d), 6) as w from bo e join dg a on a.graph_id = e.graph_id and a.src = e.src join dg b on b.graph_id = e.graph_id and b.src = e.dst")
def a25(spark, d):
    e = G.both_ways(edges(spark, d)).cache()
    deg = e.groupBy("graph_id", "src").agg(F.sum("w").alias("d"))
    j = e.join(deg.withColumnRenamed("d", "da"), ["graph_id", "src"]).join(deg.select("graph_id", F.col("src").alias("dst"), F.col("d").alias("db")), ["graph_id", "dst"])
    return j.select("graph_id", "src", "dst", r6(F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w"))


HYPER = "hy as (select 'o' as graph_id, l_orderkey as edge_id, list_sort(list_distinct(list(l_suppkey))) as nodes, round(sum(l_quantity), 2) as value from lineitem group by l_orderkey)"


def hyperedges(spark, d):
    """Orders as hyperedges over their suppliers."""
    li = B.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("edge_id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("nodes"), F.round(F.sum("l_quantity"), 2).alias("value")).withColumn("graph_id", F.lit("o"))


@query("a34_hyper_counts", HYPER, "select graph_id, count(*) filter (len(nodes) > 2) as n_hyperedges, count(*) filter (len(nodes) = 2) as n_links from hy group by graph_id")
def a34(spark, d):
    return hyperedges(spark, d).groupBy("graph_id").agg(F.count(F.when(F.size("nodes") > 2, 1)).alias("n_hyperedges"), F.count(F.when(F.size("nodes") == 2, 1)).alias("n_links"))


@query("i29_star_expansion", HYPER, "select graph_id, -edge_id - 1 as src, unnest(nodes) as dst, round(value / len(nodes), 6) as w from hy where len(nodes) > 2 union all select graph_id, nodes[1], nodes[2], round(value, 6) from hy where len(nodes) = 2")
def i29(spark, d):
    return G.star_expansion(hyperedges(spark, d)).withColumn("w", r6("w"))


@query("i30_pairwise_expansion", B.RASTER, B.EDGES, BOTH, "select * from bo")
def i30(spark, d):
    return G.both_ways(edges(spark, d))


@query("j19_edge_lookup", B.RASTER, B.EDGES, "q as (select image_id as graph_id, (c * 24 + r + 1)::bigint as src, (c * 24 + r + 1 + 24)::bigint as dst from ras)", "select q.graph_id, q.src, q.dst, coalesce(w, 0.0) as w from q left join edge using (graph_id, src, dst)")
def j19(spark, d):
    q = B.raster(spark, d).select(F.col("image_id").alias("graph_id"), (F.col("c") * 24 + F.col("r") + 1).cast("long").alias("src"), (F.col("c") * 24 + F.col("r") + 25).cast("long").alias("dst"))
    return q.join(edges(spark, d), G.KEY, "left").select(*G.KEY, F.coalesce("w", F.lit(0.0)).alias("w"))


@query("j21_group_expansion", B.RASTER, B.LABELMAP, LAB, B.MASKS, SETS, "select distinct l.graph_id, l.label, s.set_id from nl l join st s using (graph_id, node)")
def j21(spark, d):
    """The labels (superpixels) that touch each pixel set."""
    return node_labels(spark, d).join(node_sets(spark, d), ["graph_id", "node"]).select("graph_id", "label", "set_id").distinct()


@query("j28_matrix_vector", B.RASTER, B.EDGES, BOTH, f"x as (select image_id as graph_id, {PIX} as node, val from ras)", "select e.graph_id, e.src as node, round(sum(w * val) + 3e-8, 5) as y from bo e join x on x.graph_id = e.graph_id and x.node = e.dst group by all")
def j28(spark, d):
    x = B.raster(spark, d).select(F.col("image_id").alias("graph_id"), B.pixel_id("r", "c").alias("dst"), "val")
    y = G.both_ways(edges(spark, d)).join(x, ["graph_id", "dst"])
    return y.groupBy("graph_id", F.col("src").alias("node")).agg(F.round(F.sum(F.col("w") * F.col("val")) + 3e-8, 5).alias("y"))


@query("j29_project_lift", B.RASTER, B.LABELMAP, "select image_id, r, c, round(avg(val) over (partition by image_id, label) + 1e-9, 5) as mean, floor(round(avg(val) over (partition by image_id, label) + 1e-9, 5))::bigint as whole from ras join lab using (image_id, r, c)")
def j29(spark, d):
    """Pixel values to group means (and their floors), and back to the pixels."""
    px = B.raster(spark, d).cache()
    lab = B.label_map(px)
    full = px.join(lab, ["image_id", "r", "c"])
    mean = full.groupBy("image_id", "label").agg(F.round(F.avg("val") + 1e-9, 5).alias("mean"))
    return full.join(mean, ["image_id", "label"]).select("image_id", "r", "c", "mean", F.floor("mean").alias("whole"))


@query("o7_graph_sum", B.RASTER, B.EDGES, "select graph_id, src, dst, round(sum(w), 6) as w from (select * from edge union all select graph_id, src, dst, 2 * w from edge where src % 3 = 0 union all select graph_id, src, dst + 1000, w from edge where src % 50 = 0) group by all")
def o7(spark, d):
    e = edges(spark, d).cache()
    more = e.where("src % 3 = 0").withColumn("w", F.col("w") * 2).union(e.where("src % 50 = 0").withColumn("dst", F.col("dst") + 1000))
    return G.summed(e.union(more)).withColumn("w", r6("w"))


@query("o8_graph_merge", B.RASTER, B.EDGES, "m as (select graph_id, case when src % 2 = 0 then src else src + 1000 end as src, case when dst % 2 = 0 then dst else dst + 1000 end as dst, w from edge)", "select graph_id, src, dst, round(sum(w), 6) as w from (select * from edge union all select * from m) group by all")
def o8(spark, d):
    """Two graphs with half of their nodes identified: mapped ids, weights of parallel edges added."""
    e = edges(spark, d).cache()
    ids = G.nodes(e).select("graph_id", "node", F.when(F.col("node") % 2 == 0, F.col("node")).otherwise(F.col("node") + 1000).alias("new"))
    m = e.join(ids.toDF("graph_id", "src", "a"), ["graph_id", "src"]).join(ids.toDF("graph_id", "dst", "b"), ["graph_id", "dst"]).select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    return G.summed(e.select(*G.KEY, "w").union(m)).withColumn("w", r6("w"))


@query(
    "o9_induced_subgraph", B.RASTER, B.EDGES, "k as (select distinct graph_id, node from (select graph_id, src as node from edge union all select graph_id, dst from edge) where node % 3 <> 0)",
    "ids as (select graph_id, node, row_number() over (partition by graph_id order by node) as id from k)",
    "select e.graph_id, a.id as src, b.id as dst, w from edge e join ids a on a.graph_id = e.graph_id and a.node = src join ids b on b.graph_id = e.graph_id and b.node = dst",
)
def o9(spark, d):
    e = edges(spark, d).cache()
    ids = G.nodes(e).where("node % 3 <> 0").withColumn("id", F.dense_rank().over(W.partitionBy("graph_id").orderBy("node")).cast("long"))
    j = e.join(ids.toDF("graph_id", "src", "a"), ["graph_id", "src"]).join(ids.toDF("graph_id", "dst", "b"), ["graph_id", "dst"])
    return j.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "w")


@query("i22_contraction", B.RASTER, B.EDGES, "m as (select graph_id, case when src <= 48 then 1 else src end as src, case when dst <= 48 then 1 else dst end as dst, w from edge)", "select graph_id, src, dst, round(sum(w), 6) as w from m where src <> dst group by all")
def i22(spark, d):
    """The first two columns' pixels contracted into node 1; loops go, parallel edges are added."""
    to = lambda c: F.when(F.col(c) <= 48, 1).otherwise(F.col(c)).cast("long").alias(c)
    return G.summed(edges(spark, d).select("graph_id", to("src"), to("dst"), "w").where("src <> dst")).withColumn("w", r6("w"))


@query("i23_distances")
def i23(spark, d):
    """Shortest distances from pixel 1 of every raster, an edge costing 1.01 - w."""
    e = G.both_ways(edges(spark, d)).withColumn("w", 1.01 - F.col("w")).cache()
    return G.distances(e, G.nodes(e).where("node = 1")).withColumn("d", F.round("d", 5))


def dag(spark, d):
    """Parts, each linked to the parts of half and of a third of its key."""
    p = B.table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("dst"))
    return p.select(F.lit("s").alias("graph_id"), "src", "dst").distinct()


@query(
    "i24_cycle_test",
    "recursive e as (select distinct 's' as graph_id, p_partkey as src, unnest([p_partkey // 2, p_partkey // 3]) as dst from part where p_partkey > 0)",
    "g as (select * from e union all select 'back', src, dst from e union all select 'back', min(dst), max(src) from e)",
    "reach as (select graph_id, src, dst from g union select r.graph_id, r.src, g.dst from reach r join g on g.graph_id = r.graph_id and g.src = r.dst)",
    "select graph_id, bool_or(src = dst) as cyclic from reach group by graph_id",
)
def i24(spark, d):
    """Whether a graph has a cycle: what peeling leaves over. The second graph has an edge back."""
    a = dag(spark, d)
    b = a.withColumn("graph_id", F.lit("back"))
    b = b.union(b.agg(F.first("graph_id"), F.min("dst"), F.max("src")))
    both = a.union(b)
    _, left = G.topological_levels(both)
    ids = both.select("graph_id").distinct()
    return ids.join(left.select("graph_id", F.lit(True).alias("cyclic")).distinct(), "graph_id", "left").fillna(False, ["cyclic"])


@query("i25_topological_order")
def i25(spark, d):
    levels, _ = G.topological_levels(dag(spark, d))
    return G.ordered(levels)


@query(
    "i26_hamiltonian", B.RASTER, B.EDGES, BOTH,
    f"p as (select image_id as graph_id, r, c, {PIX} as node, row_number() over (partition by image_id order by c, case when c % 2 = 1 then r else 23 - r end) as k from ras)",
    "h as (select p.graph_id, p.node, lead(node) over (partition by graph_id order by k) as nxt from p)",
    f"select h.graph_id, count(*) = count(distinct node) and count(*) filter (nxt is not null) = count(w) filter (w > 0) as path, count(*) = count(distinct node) and count(*) = 24 * {B.LAST} as all_nodes from h left join bo e on e.graph_id = h.graph_id and e.src = node and e.dst = nxt group by h.graph_id",
)
def i26(spark, d):
    """Is the snake through the columns a path of distinct nodes along positive edges, and does it meet every node?"""
    e = G.both_ways(edges(spark, d)).select("graph_id", F.col("src").alias("node"), F.col("dst").alias("nxt"), "w")
    w = W.partitionBy("graph_id").orderBy("c", "k")
    ras, cols = B.raster_of(spark, d)
    p = ras.select(F.col("image_id").alias("graph_id"), "c", F.when(F.col("c") % 2 == 1, F.col("r")).otherwise(23 - F.col("r")).alias("k"), B.pixel_id("r", "c").alias("node"))
    h = p.withColumn("nxt", F.lead("node").over(w)).join(e, ["graph_id", "node", "nxt"], "left")
    n, u = F.count("*"), F.countDistinct("node")
    return h.groupBy("graph_id").agg(((n == u) & (F.count("nxt") == F.count(F.when(F.col("w") > 0, 1)))).alias("path"), ((n == u) & (n == B.ROWS * cols)).alias("all_nodes"))


@query(
    "i27_symmetry", B.RASTER, B.EDGES, BOTH,
    "g as (select 'whole' as kind, * from bo union all select 'half', * from edge)",
    "select a.kind, a.graph_id, count(*) = count(b.w) filter (a.w = b.w) as symmetric from g a left join g b on a.kind = b.kind and a.graph_id = b.graph_id and a.src = b.dst and a.dst = b.src group by all",
)
def i27(spark, d):
    """Symmetry of the symmetrized graph, and of the edges in one direction."""
    e = edges(spark, d).cache()
    g = G.both_ways(e).withColumn("kind", F.lit("whole")).unionByName(e.withColumn("kind", F.lit("half")))
    back = g.select("kind", "graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w2"))
    j = g.join(back, ["kind", *G.KEY], "left")
    return j.groupBy("kind", "graph_id").agg((F.count("*") == F.count(F.when(F.col("w") == F.col("w2"), 1))).alias("symmetric"))


@query("i28_bidirectional", B.RASTER, B.EDGES, "select graph_id, src, dst, w from edge union all select graph_id, dst, src, 1e-6::double from edge")
def i28(spark, d):
    """Reverse edges of weight eps where there are none."""
    e = edges(spark, d).cache()
    return e.select(*G.KEY, "w").union(G.flipped(e).join(e, G.KEY, "left_anti").select(*G.KEY, F.lit(1e-6)))


@query("i31_lambda_sweep")
def i31(spark, d):
    """Nested regions: components of the raster graph at every threshold of the edge weight, and their mean weight."""
    e = edges(spark, d)
    t = e.select("*", F.explode(F.array(*(F.lit(x) for x in (0.6, 0.7, 0.8, 0.9)))).alias("t")).where("w >= t")
    node = lambda p: F.struct("graph_id", "t", F.col(p).alias("pixel"))
    t = stored(t.select("graph_id", "t", "w", node("src").alias("u"), node("dst").alias("v")))
    t = t.join(connected_components(t), F.col("node") == F.col("u"))
    return t.groupBy("graph_id", "t", F.col("component.pixel").alias("region")).agg(F.count("*").alias("n_edges"), F.round(F.avg("w"), 5).alias("mean_w"))


def region_borders(spark, d):
    """Borders (graph_id, a, b, s, n) of the regions of equal value, named by their smallest pixels: s in millionths."""
    ras = stored(B.raster(spark, d))  # used twice: events are read once
    comp = R.masks_components(ras, ["image_id", "val"], R.FOUR)
    reg = stored(comp.select(F.col("image_id").alias("graph_id"), B.pixel_id("r", "c").alias("node"), B.pixel_id("cr", "cc").alias("label")))
    cross = G.with_labels(B.raster_graph(ras), reg).where("la <> lb")
    return cross.groupBy("graph_id", F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum(F.round((1 - F.col("w")) * 1_000_000).cast("long")).alias("s"), F.count("*").alias("n"))


@query("i31_merge_tree")
def i31_tree(spark, d):
    """Nested regions as a tree: regions of equal value merge over their weakest mean border, borders are averaged anew."""
    tree = G.merge_tree(region_borders(spark, d))
    return tree.select("graph_id", F.col("a").alias("absorbed"), F.col("b").alias("kept"), F.round(F.col("height") / 1_000_000, 6).alias("height"))


@query("i32_spectral_grouping")
def i32(spark, d):
    """Two groups of pixels of each raster: the signs of the second eigenvector of its normalized affinity matrix."""
    halves = G.spectral_halves(G.both_ways(stored(edges(spark, d))))  # used several times: events are read once
    return halves.select("graph_id", "node", F.round("value", 5).alias("value"), F.round("x", 4).alias("x"), "cluster")
