"""Queries over histograms, joint distributions and evaluation curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.functions.scalars import bin_search
from fieldloom.operators.order import global_rank, running_sums
from fieldloom.plans.q_vectors import quantized
from fieldloom.plans.registry import query
from fieldloom.sources import bindings as B

r6 = lambda c: F.round(c, 6)
EPS = 2.220446049250313e-16


def int_hist(df: DataFrame, x: str, n: int) -> DataFrame:
    """Counts of the integers 1..n, zeros included."""
    domain = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "bin")
    return domain.join(df.groupBy(F.col(x).cast("long").alias("bin")).agg(F.count("*").alias("n")), "bin", "left").fillna(0, ["n"])


@query("a1_int_hist", "select bin, count(p_size) as n from (select unnest(range(1, 61)) as bin) left join part on p_size = bin group by bin")
def a1(spark, d):
    return int_hist(B.table(spark, d, "part"), "p_size", 60)


def bin_sum(start: DataFrame, rows: DataFrame) -> DataFrame:
    """start (bin, h) plus rows (bin, x); bin 0 is skipped."""
    both = start.select("bin", F.col("h").alias("x")).unionByName(rows.where("bin > 0").select("bin", "x"))
    return both.groupBy("bin").agg(F.sum("x").alias("h"))


@query("a2_bin_sum", "select bin, round(sum(x), 2) as h from (select range as bin, range * 10.0::double as x from range(1, 51) union all select p_size, p_retailprice from part where p_size % 50 > 0 or p_size = 50) group by bin")
def a2(spark, d):
    start = spark.range(1, 51).select(F.col("id").alias("bin"), (F.col("id") * 10.0).alias("h"))
    rows = B.table(spark, d, "part").select(F.when((F.col("p_size") % 50 == 0) & (F.col("p_size") != 50), 0).otherwise(F.col("p_size")).cast("long").alias("bin"), F.col("p_retailprice").alias("x"))
    return bin_sum(start, rows).withColumn("h", F.round("h", 2))


@query("a3_indexed_sum", "select p_size - 10 as bin, round(sum(p_retailprice), 2) as h from part where p_size - 10 between 1 and 30 group by all")
def a3(spark, d):
    """Indexed sum that skips indices out of range."""
    p = B.table(spark, d, "part").select((F.col("p_size") - 10).alias("bin"), "p_retailprice")
    return p.where("bin between 1 and 30").groupBy("bin").agg(F.round(F.sum("p_retailprice"), 2).alias("h"))


EDGES = [0.0, 5.0, 10.0, 25.0, 50.0, 100.0, 200.0]


@query(
    "a4_weighted_hist", "v as (select case " + " ".join(f"when value >= {a} and value < {b} then {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:]), 1)) + f" when value = {EDGES[-1]} then {len(EDGES)} end as bin, user_id % 5 as w from events)",
    f"select range as bin, coalesce(h, 0)::bigint as h from range(1, {len(EDGES) + 1}) left join (select bin, sum(w) as h from v group by bin) on bin = range",
)
def a4(spark, d):
    """Weighted histogram; the last bin is the singleton of the last edge."""
    x = F.col("value")
    b = bin_search(x, EDGES)
    b = F.when(x > EDGES[-1], 0).otherwise(b)
    rows = B.table(spark, d, "events").where(~F.isnan("value")).select(b.alias("bin"), (F.col("user_id") % 5).alias("w")).where("bin > 0").groupBy("bin").agg(F.sum("w").alias("h"))
    return spark.range(1, len(EDGES) + 1).toDF("bin").join(rows, "bin", "left").fillna(0, ["h"])


@query(
    "a5_equal_width", "e as (select event_type, value, min(value) over (partition by event_type) as lo, max(value) over (partition by event_type) as hi from events)",
    "select event_type, least(14, floor((value - lo) / ((hi - lo) / 14)) + 1)::bigint as bin, count(*) as n from e group by all",
)
def a5(spark, d):
    """Fourteen bins over each group's own range."""
    e = B.table(spark, d, "events")
    lim = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    e = e.join(F.broadcast(lim), "event_type")  # one row a type
    return e.groupBy("event_type", F.least(F.lit(14), F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 14)) + 1).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "a6_bag_of_words", B.VLONG, B.CODE, "dist as (select v.vec_id, v.label, k.word, round(sum((v.x - k.m) * (v.x - k.m)), 9) as d from vlong v join code k using (i) group by all)",
    "q as (select vec_id, label, word from dist qualify row_number() over (partition by vec_id order by d, word) = 1)",
    "select s.label as segment_id, w.word, count(q.vec_id) as n from (select distinct label from vec) s cross join (select distinct word from code) w left join q on q.label = s.label and q.word = w.word group by all".replace("vec)", "embeddings)"),
)
def a6(spark, d):
    """Words of each segment's frames, zeros included; segments are labels."""
    v = B.vectors(spark, d)
    q = quantized(v, B.codebook(spark, d)).join(v.select("vec_id", F.col("label").alias("segment_id")), "vec_id")
    domain = v.select(F.col("label").alias("segment_id")).distinct().join(F.broadcast(v.select(F.col("label").alias("word")).distinct()))  # labels squared
    return domain.join(q.groupBy("segment_id", "word").agg(F.count("*").alias("n")), ["segment_id", "word"], "left").fillna(0, ["n"])


@query("a7_tree_paths", "select coalesce(event_type, '') as l1, coalesce(hour(ts)::int, -1) as l2, coalesce((user_id % 4)::bigint, -1) as l3, count(*) as n from events group by rollup(event_type, hour(ts)::int, (user_id % 4)::bigint)")
def a7(spark, d):
    """Counts of every path prefix, the root included; levels left out read "" or -1."""
    e = B.table(spark, d, "events").select(F.col("event_type").alias("l1"), F.hour("ts").alias("l2"), (F.col("user_id") % 4).alias("l3"))
    return e.rollup("l1", "l2", "l3").agg(F.count("*").alias("n")).fillna("", ["l1"]).fillna(-1, ["l2", "l3"])


@query("a8_marginals", "select coalesce(event_type, '') as event_type, coalesce(hour(ts)::int, -1) as h, count(*) as n from events group by grouping sets ((event_type), (hour(ts)::int), ())")
def a8(spark, d):
    e = B.table(spark, d, "events").select("event_type", F.hour("ts").alias("h"))
    return e.groupingSets([["event_type"], ["h"], []], "event_type", "h").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("h", F.lit(-1)).alias("h"), "n")


@query(
    "a9_tree_hist", "recursive up as (select 64 + hour(ts)::bigint as leaf, 64 + hour(ts)::bigint as node from (select distinct ts from events) union select leaf, node // 2 from up where node > 1)",
    "select node, count(*) as n from events join up on leaf = 64 + hour(ts) group by node",
)
def a9(spark, d):
    """A merge tree's nodes count the leaves' data below them (leaf 64 + hour, parent of k is k div 2)."""
    e = B.table(spark, d, "events").groupBy((F.lit(64) + F.hour("ts")).cast("long").alias("leaf")).agg(F.count("*").alias("n"))
    tree = spark.range(2, 128).select(F.col("id").alias("node"), F.floor(F.col("id") / 2).alias("parent"))
    up = e.select("leaf", F.col("leaf").alias("node"), "n")
    out = up
    for _ in range(7):  # the tree's height
        up = up.join(F.broadcast(tree), "node").select("leaf", F.col("parent").alias("node"), "n")
        out = out.union(up)
    return out.groupBy("node").agg(F.sum("n").alias("n"))


@query("a10_cut_hist", "select coalesce(case event_type when 'view' then 1 when 'click' then 1 when 'signup' then 2 end, 3) as bin, count(*) as n from events group by 1")
def a10(spark, d):
    """Counts after a map of labels; the unmapped get a bin of their own."""
    y = F.when(F.col("event_type").isin("view", "click"), 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    return B.table(spark, d, "events").groupBy(y.alias("bin")).agg(F.count("*").alias("n"))


@query(
    "a11_mutual_information", "c as (select event_type as c, hour(ts)::int as x, count(*) as n from events group by all)",
    "p as (select c, x, n / sum(n) over () as p, sum(n) over (partition by c) / sum(n) over () as pc, sum(n) over (partition by x) / sum(n) over () as px from c)",
    "select c, x, round(p, 8) as p, round(sum(p * ln(p / (px * pc))) over (), 8) as mi from p",
)
def a11(spark, d):
    n = B.table(spark, d, "events").groupBy(F.col("event_type").alias("c"), F.hour("ts").alias("x")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    n = n.join(F.broadcast(total))
    p = n.select("c", "x", (F.col("n") / F.col("t")).alias("p"), (F.sum("n").over(W.partitionBy("c")) / F.col("t")).alias("pc"), (F.sum("n").over(W.partitionBy("x")) / F.col("t")).alias("px"))
    mi = p.agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("pc")))), 8).alias("mi"))
    return p.select("c", "x", F.round("p", 8).alias("p")).join(F.broadcast(mi))


@query("a31_vector_counts", "select (user_id % 3)::bigint as a, hour(ts)::int as b, count(*) as n from events group by all")
def a31(spark, d):
    e = B.table(spark, d, "events").select(F.struct((F.col("user_id") % 3).alias("a"), F.hour("ts").alias("b")).alias("v"))
    return e.groupBy("v").agg(F.count("*").alias("n")).select("v.a", "v.b", "n")


@query(
    "a28_pyramid_hist", B.RASTER, "g as (select image_id, r, c, val, abs(r * 7 + c * 3) % 6 as o from ras)",
    f"l as (select image_id, l, floor(r / (24 // (1 << l)))::int as x, floor((c - 1) / (k // (1 << l)))::int as y, o, val from g, (select {B.LAST} as k), (select unnest(range(0, 3)) as l) where r < (24 // (1 << l)) * (1 << l) and c <= (k // (1 << l)) * (1 << l))",
    "select image_id, l::int as l, x, y, o, round(sum(val), 4) as h from l group by all",
)
def a28(spark, d):
    """Sums by pyramid level, cell and orientation bin; pixels beyond the last whole cell are left out."""
    ras, cols = B.raster_of(spark, d)
    g = ras.withColumn("o", F.abs(F.col("r") * 7 + F.col("c") * 3) % 6)
    g = g.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("k", F.expr("shiftleft(1, l)"))
    g = g.withColumn("h", F.expr("24 div k")).withColumn("w", F.expr(f"{cols} div k")).where("r < h * k and c <= w * k")
    return g.groupBy("image_id", "l", F.expr("cast(r div h as int)").alias("x"), F.expr("cast((c - 1) div w as int)").alias("y"), "o").agg(F.round(F.sum("val"), 4).alias("h"))


@query("a30_axial_mean", "select p_brand, round(atan2(avg(sin(2 * radians(p_size * 3))), avg(cos(2 * radians(p_size * 3)))) / 2, 6) as mean, round(min(least(abs(radians(p_size * 3) - 1) % pi(), pi() - abs(radians(p_size * 3) - 1) % pi())), 6) as nearest from part group by p_brand")
def a30(spark, d):
    """Mean of axial angles by their doubles, and the smallest difference modulo pi from one radian."""
    a = F.radians(F.col("p_size") * 3)
    diff = F.abs(a - 1) % F.lit(3.141592653589793)
    return B.table(spark, d, "part").groupBy("p_brand").agg(r6(F.atan2(F.avg(F.sin(2 * a)), F.avg(F.cos(2 * a))) / 2).alias("mean"), r6(F.min(F.least(diff, F.lit(3.141592653589793) - diff))).alias("nearest"))


@query("a27_image_means", B.RASTER, "select image_id, round(avg(val), 6) as mean, round(sum(val * r) / sum(val), 6) as cr, round(sum(val * c) / sum(val), 6) as cc from ras group by image_id")
def a27(spark, d):
    return B.raster(spark, d).groupBy("image_id").agg(r6(F.avg("val")).alias("mean"), r6(F.sum(F.col("val") * F.col("r")) / F.sum("val")).alias("cr"), r6(F.sum(F.col("val") * F.col("c")) / F.sum("val")).alias("cc"))


# evaluation curves
def pr_points(scored: DataFrame) -> DataFrame:
    """k (rows retrieved, from 0), tp, fp, recall, precision; ties in the score go by doc_id."""
    s = scored.withColumn("y", (F.col("y") == 1).cast("long"))
    curve = running_sums(global_rank(s.where("s > double('-inf')"), F.desc("s"), F.col("doc_id"), name="k"), {"tp": F.col("y"), "fp": 1 - F.col("y")}, "k")
    total = s.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"))
    rows = curve.select("k", "tp", "fp").union(scored.sparkSession.range(1).selectExpr("0L", "0L", "0L")).join(F.broadcast(total))
    return rows.select("k", "tp", "fp", (F.col("tp") / (F.col("p") + EPS)).alias("recall"), ((F.col("tp") + EPS) / (F.col("tp") + F.col("fp") + EPS)).alias("precision"))


PR = f"""o as (select row_number() over (order by s desc, doc_id) as k, (y = 1)::int as y from sc),
c as (select k, sum(y) over (order by k) as tp, sum(1 - y) over (order by k) as fp from o union all select 0, 0, 0),
pr as (select k, tp::bigint as tp, fp::bigint as fp, tp / ((select sum(y) from o) + {EPS!r}::double) as recall, (tp + {EPS!r}::double) / (tp + fp + {EPS!r}::double) as precision from c)"""


@query("w1_pr_curve", B.SCORED, PR, "select k, tp, fp, round(recall, 6) as recall, round(precision, 6) as precision from pr")
def w1(spark, d):
    return pr_points(B.scored(spark, d)).select("k", "tp", "fp", r6("recall").alias("recall"), r6("precision").alias("precision"))


@query(
    "w2_pr_summary", B.SCORED, PR, "a as (select (precision + lag(precision) over (order by k)) * (recall - lag(recall) over (order by k)) / 2 as a from pr)",
    "t as (select t / 10.0::double as t, coalesce(max(precision) filter (recall >= t / 10.0::double - 1e-12), 0) as p from pr, (select unnest(range(0, 11)) as t) group by t)",
    "select round((select sum(a) from a), 6) as auc, round((select sum(p) / 11 from t), 6) as ap",
)
def w2(spark, d):
    """Area under the curve and eleven-point average precision."""
    pr = pr_points(B.scored(spark, d)).cache()
    before = pr.select((F.col("k") + 1).alias("k"), F.col("recall").alias("r0"), F.col("precision").alias("p0"))
    auc = pr.join(before, "k").agg(r6(F.sum((F.col("precision") + F.col("p0")) * (F.col("recall") - F.col("r0")) / 2)).alias("auc"))
    best = pr.agg(*(F.coalesce(F.max(F.when(F.col("recall") >= t / 10 - 1e-12, F.col("precision"))), F.lit(0.0)).alias(f"t{t}") for t in range(11)))
    return auc.join(F.broadcast(best.select(r6(sum(F.col(f"t{t}") for t in range(11)) / 11).alias("ap"))))


def roc_points(scored: DataFrame) -> DataFrame:
    """j = 0..N: with the j lowest scores rejected, tp of the rest and tn; t is the score at j (-Infinity at 0)."""
    s = scored.withColumn("y", (F.col("y") == 1).cast("long"))
    up = running_sums(global_rank(s, F.col("s"), F.col("doc_id"), name="j"), {"pos": F.col("y"), "neg": 1 - F.col("y")}, "j")
    total = s.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("np"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("nn"))
    rows = up.select("j", "s", "pos", "neg").union(scored.sparkSession.range(1).selectExpr("0L", "double('-inf')", "0L", "0L")).join(F.broadcast(total))
    return rows.select("j", F.col("s").alias("t"), "np", "nn", ((F.col("np") - F.col("pos")) / (F.col("np") + EPS)).alias("tp"), (F.col("neg") / (F.col("nn") + EPS)).alias("tn"))


ROC = f"""o as (select row_number() over (order by s, doc_id) as j, s, (y = 1)::int as y from sc),
n as (select sum(y) as np, sum(1 - y) as nn from o),
u as (select j, s as t, sum(y) over (order by j) as pos, sum(1 - y) over (order by j) as neg from o union all select 0, '-inf'::double, 0, 0),
roc as (select j, t, np, nn, (np - pos) / (np + {EPS!r}::double) as tp, neg / (nn + {EPS!r}::double) as tn from u, n)"""


@query("w3_roc_curve", B.SCORED, ROC, "select j, round(tp, 6) as tp, round(tn, 6) as tn from roc")
def w3(spark, d):
    return roc_points(B.scored(spark, d)).select("j", r6("tp").alias("tp"), r6("tn").alias("tn"))


@query(
    "w4_roc_summary", B.SCORED, ROC, "x as (select *, round(tp + tn, 9) as u, round(tp * np + tn * nn, 9) as v from roc)",
    "a as (select sum((tp + p0) * (tn - n0) / 2) as area from (select tp, tn, lag(tp) over (order by j) as p0, lag(tn) over (order by j) as n0 from roc))",
    """select round((select area from a), 6) as auc, round(greatest((select tn from roc where tp >= tn order by j desc limit 1), (select tp from roc where tn >= tp order by j limit 1)), 6) as eer,
       (select t from x order by u desc, j limit 1) as ut, round((select (tp + tn) / 2 from x order by u desc, j limit 1), 6) as ur,
       (select t from x order by v desc, j limit 1) as nt, round((select (tp * np + tn * nn) / (np + nn) from x order by v desc, j limit 1), 6) as nr""",
)
def w4(spark, d):
    """Area, equal error rate and the operating points of the uniform and the natural prior (first maximum)."""
    roc = roc_points(B.scored(spark, d)).cache()
    before = roc.select((F.col("j") + 1).alias("j"), F.col("tp").alias("p0"), F.col("tn").alias("n0"))
    area = roc.join(before, "j").agg(r6(F.sum((F.col("tp") + F.col("p0")) * (F.col("tn") - F.col("n0")) / 2)).alias("auc"))
    u, v = F.round(F.col("tp") + F.col("tn"), 9), F.round(F.col("tp") * F.col("np") + F.col("tn") * F.col("nn"), 9)
    pick = lambda c, key: F.max_by(c, F.struct(key, -F.col("j")))
    half, mix = (F.col("tp") + F.col("tn")) / 2, (F.col("tp") * F.col("np") + F.col("tn") * F.col("nn")) / (F.col("np") + F.col("nn"))
    rest = roc.agg(
        r6(F.greatest(F.max_by(F.when(F.col("tp") >= F.col("tn"), F.col("tn")), F.when(F.col("tp") >= F.col("tn"), F.col("j"))), F.min_by(F.when(F.col("tn") >= F.col("tp"), F.col("tp")), F.when(F.col("tn") >= F.col("tp"), F.col("j"))))).alias("eer"),
        pick("t", u).alias("ut"), r6(pick(half, u)).alias("ur"), pick("t", v).alias("nt"), r6(pick(mix, v)).alias("nr"),
    )
    return area.join(F.broadcast(rest))


@query(
    "w5_thresholds", B.RASTER, "v as (select image_id, val, row_number() over (partition by image_id order by val, r, c) as k, count(*) over (partition by image_id) as n from ras where val > 0)",
    """select image_id, 'linear' as kind, i::bigint as i, i / 8.0::double as t from (select distinct image_id from ras), (select unnest(range(0, 9)) as i)
       union all select image_id, 'telescoping', i, round(m * i / 8, 6) from (select image_id, max(val) as m from ras group by 1), (select unnest(range(0, 9)) as i)
       union all select image_id, 'adaptive', i, val from v, (select unnest(range(1, 9)) as i) where k = greatest(1, (n * i) // 8)""",
)
def w5(spark, d):
    """Threshold levels of each image: even, scaled to the maximum, and at equal steps of its sorted non-zero values."""
    ras = B.raster(spark, d).cache()
    steps = lambda a: F.explode(F.sequence(F.lit(a), F.lit(8)))
    top = ras.groupBy("image_id").agg(F.max("val").alias("m"))
    even = top.select("image_id", "m", steps(0).alias("i"))
    w = W.partitionBy("image_id")
    v = ras.where("val > 0").select("image_id", "val", F.row_number().over(w.orderBy("val", "r", "c")).alias("k"), F.count("*").over(w).alias("n"))
    ada = v.select("image_id", "val", "k", "n", steps(1).alias("i")).where("k = greatest(1, (n * i) div 8)")
    out = even.select("image_id", F.lit("linear").alias("kind"), F.col("i").cast("long").alias("i"), (F.col("i") / 8.0).alias("t"))
    out = out.union(even.select("image_id", F.lit("telescoping"), F.col("i").cast("long"), r6(F.col("m") * F.col("i") / 8)))
    return out.union(ada.select("image_id", F.lit("adaptive"), F.col("i").cast("long"), "val"))


@query("w11_renumber", "select o_orderkey, dense_rank() over (order by o_custkey) - 1 as label from orders")
def w11(spark, d):
    """Used labels to 0..k-1 in their order: the distinct labels are ranked globally, then joined back."""
    o = B.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ids = global_rank(o.select("o_custkey").distinct(), F.col("o_custkey"), name="k")
    return o.join(ids, "o_custkey").select("o_orderkey", (F.col("k") - 1).alias("label"))


@query("w12_chunks", "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // (select ceil(count(*) / 7)::bigint from orders) as chunk from orders")
def w12(spark, d):
    """Seven near-equal chunks in order of the key; the last one is shorter."""
    o = global_rank(B.table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), name="k")
    n = o.count()
    size = -(-n // 7) if n >= 7 else max(1, n)
    return o.select("o_orderkey", F.floor((F.col("k") - 1) / size).alias("chunk"))


@query(
    "a33_boundary_counts", B.RASTER, "m as (select image_id, r, c, t from ras, (select unnest(range(1, 5)) as t) where val > 25 * t)", "h as (select image_id, r, c from ras where n > 0 and val > 60)",
    """select coalesce(a.image_id, b.image_id) as image_id, coalesce(a.t, b.t)::int as t, machine, hit_machine, human, hit_human from
       (select image_id, t, count(*) as machine, count(*) filter (exists (select 1 from h where h.image_id = m.image_id and (h.r - m.r) * (h.r - m.r) + (h.c - m.c) * (h.c - m.c) <= 2)) as hit_machine from m group by all) a
       join (select image_id, t, count(*) as human, count(*) filter (exists (select 1 from m where h.image_id = m.image_id and m.t = k.t and (h.r - m.r) * (h.r - m.r) + (h.c - m.c) * (h.c - m.c) <= 2)) as hit_human from h, (select unnest(range(1, 5)) as t) k group by all) b
       on a.image_id = b.image_id and a.t = b.t""",
)
def a33(spark, d):
    """Per threshold the machine and human boundary pixels, and those with a counterpart within sqrt(2)."""
    from fieldloom.operators.raster import within_radius

    ras = B.raster(spark, d).cache()
    m = ras.select("image_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("t"), "r", "c", "val").where("val > 25 * t").select("image_id", "t", "r", "c")
    h = ras.where("n > 0 and val > 60").select("image_id", "r", "c")
    near = within_radius(m, h, 2).cache()
    a = m.groupBy("image_id", "t").agg(F.count("*").alias("machine")).join(near.select("image_id", "t", "r", "c").distinct().groupBy("image_id", "t").agg(F.count("*").alias("hit_machine")), ["image_id", "t"], "left")
    b = near.select("image_id", "t", "r2", "c2").distinct().groupBy("image_id", "t").agg(F.count("*").alias("hit_human"))
    n = h.groupBy("image_id").agg(F.count("*").alias("human"))
    return a.join(n, "image_id").join(b, ["image_id", "t"], "left").fillna(0).select("image_id", "t", "machine", "hit_machine", "human", "hit_human")
