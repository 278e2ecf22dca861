"""Queries over rasters and masks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.operators import raster as R
from fieldloom.operators.shared import shared_folder
from fieldloom.plans.registry import query
from fieldloom.sources import bindings as B

r6 = lambda c: F.round(c, 6)
SEG = ["image_id", "segment_id"]
PIX = "((c - 1) * 24 + r + 1)::bigint"


@query("w6_integral_image", B.RASTER, "select a.image_id, a.r, a.c, round(sum(b.val), 4) as j from ras a join ras b on a.image_id = b.image_id and b.r <= a.r and b.c <= a.c group by all")
def w6(spark, d):
    return R.integral(B.raster(spark, d), "val", ["image_id"]).select("image_id", "r", "c", F.round("integral", 4).alias("j"))


LABELS5 = "dom as (select image_id, r, c, k::int as label from ras, (select unnest(range(1, 5)) as k))"


def integral_hist(spark, d):
    lab = B.label_map(B.raster(spark, d))
    full = lab.select("image_id", "r", "c", F.col("label").alias("own"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("label"))
    return R.integral(full.withColumn("x", (F.col("own") == F.col("label")).cast("long")), "x", ["image_id", "label"]).select("image_id", "label", "r", "c", F.col("integral").alias("h"))


IH = "ih as (select a.image_id, k as label, a.r, a.c, count(*) filter (b.label = k) as h from lab a join lab b on a.image_id = b.image_id and b.r <= a.r and b.c <= a.c, (select unnest(range(1, 5)) as k) group by all)"


@query("w7_integral_hist", B.RASTER, B.LABELMAP, IH, "select image_id, label::int as label, r, c, h from ih")
def w7(spark, d):
    return integral_hist(spark, d)


@query(
    "w8_box_hist", B.RASTER, B.LABELMAP, "bx as (select p_partkey as box_id, p_partkey % 20 as r1, p_partkey % 20 + p_size % 4 - 1 as r2, 1 + p_size % 25 as c1, 1 + p_size % 25 + p_partkey % 6 as c2 from part)",
    "select image_id, box_id, k::int as label, count(*) filter (label = k) as h from (select distinct image_id from ras) join bx on true cross join (select unnest(range(1, 5)) as k) left join lab using (image_id) where r is null or r between r1 and r2 and c between c1 and c2 group by all".replace(
        "left join lab using (image_id) where r is null or r between r1 and r2 and c between c1 and c2", "left join lab on lab.image_id = i.image_id and r between r1 and r2 and c between c1 and c2"
    ).replace("select image_id, box_id", "select i.image_id, box_id").replace("from ras) join", "from ras) i join"),
)
def w8(spark, d):
    """Box histograms by four corners of the integral histograms; an empty box counts 0."""
    h = integral_hist(spark, d).cache()
    box = B.table(spark, d, "part").selectExpr("p_partkey as box_id", "cast(p_partkey % 20 as int) as r1", "cast(p_partkey % 20 + p_size % 4 - 1 as int) as r2", "1 + p_size % 25 as c1", "cast(1 + p_size % 25 + p_partkey % 6 as int) as c2")
    full = box.join(F.broadcast(h.select("image_id", "label").distinct()))  # types times labels
    for n, (r, c) in enumerate((("r2", "c2"), ("r1 - 1", "c2"), ("r2", "c1 - 1"), ("r1 - 1", "c1 - 1"))):
        corner = h.select("image_id", "label", F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("h").alias(f"h{n}"))
        full = full.withColumn("_r", F.expr(r)).withColumn("_c", F.expr(c)).join(corner, ["image_id", "label", "_r", "_c"], "left").drop("_r", "_c")
    total = sum((s * F.coalesce(F.col(f"h{n}"), F.lit(0)) for n, s in enumerate((1, -1, -1, 1))), F.lit(0))
    return full.select("image_id", "box_id", "label", F.when((F.col("r1") > F.col("r2")) | (F.col("c1") > F.col("c2")), 0).otherwise(total).cast("long").alias("h"))


@query(
    "w9_gradient", B.RASTER,
    f"""select image_id, r, c, round(case when c = 1 then lead(val) over x - val when c = {B.LAST} then val - lag(val) over x else (lead(val) over x - lag(val) over x) / 2 end + 1e-9, 5) + 0.0 as gx,
       round(case when r = 0 then lead(val) over y - val when r = 23 then val - lag(val) over y else (lead(val) over y - lag(val) over y) / 2 end + 1e-9, 5) + 0.0 as gy
       from ras window x as (partition by image_id, r order by c), y as (partition by image_id, c order by r)""",
)
def w9(spark, d):
    """Central differences inside, one-sided at the borders."""
    def grad(w):
        low, high, own = F.lag("val").over(w), F.lead("val").over(w), F.col("val")
        return F.when(low.isNull(), high - own).when(high.isNull(), own - low).otherwise((high - low) / 2)

    x, y = W.partitionBy("image_id", "r").orderBy("c"), W.partitionBy("image_id", "c").orderBy("r")
    return B.raster(spark, d).select("image_id", "r", "c", (F.round(grad(x) + 1e-9, 5) + F.lit(0.0)).alias("gx"), (F.round(grad(y) + 1e-9, 5) + F.lit(0.0)).alias("gy"))


def local_maxima(ras, cols):
    """Pixels off the border that exceed all eight neighbours: the row-wise maxima of three, then those of three rows."""
    x, y = W.partitionBy("image_id", "r").orderBy("c"), W.partitionBy("image_id", "c").orderBy("r")
    p = ras.select("image_id", "r", "c", "val", F.lag("val").over(x).alias("a"), F.lead("val").over(x).alias("b"))
    p = p.withColumn("m", F.greatest("a", "b", "val"))
    p = p.select("*", F.lag("m").over(y).alias("up"), F.lead("m").over(y).alias("down"))
    return p.where(f"r between 1 and 22 and c between 2 and {cols - 1} and val > greatest(a, b, up, down)").select("image_id", "r", "c", "val")


LOCAL = f"""lm as (select a.image_id, a.r, a.c, a.val from ras a join ras b on a.image_id = b.image_id and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 and not (a.r = b.r and a.c = b.c)
  where a.r between 1 and 22 and a.c between 2 and {B.LAST} - 1 group by all having a.val > max(b.val))"""


@query("w10_local_maxima", B.RASTER, LOCAL, "select * from lm")
def w10(spark, d):
    return local_maxima(*B.raster_of(spark, d))


@query("k8_peaks", B.RASTER, LOCAL, "select image_id, r, c, val from lm qualify row_number() over (partition by image_id order by val desc, r, c) <= 10")
def k8(spark, d):
    w = W.partitionBy("image_id").orderBy(F.desc("val"), "r", "c")
    return local_maxima(*B.raster_of(spark, d)).withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k")


@query(
    "w13_contour_sampling", B.RASTER, "p as (select image_id, r, c, val, row_number() over (partition by image_id, r order by c) as k, avg(val) over (partition by image_id, r order by c rows between 2 preceding and 2 following) as m from ras)",
    "select image_id, r, c, round(m + 1e-9, 5) as m from p where (k - 1) % 4 = 0",
)
def w13(spark, d):
    """Every fourth point along an ordered contour (here a row), with the mean of a five-point window."""
    w = W.partitionBy("image_id", "r").orderBy("c")
    p = B.raster(spark, d).select("image_id", "r", "c", F.row_number().over(w).alias("k"), F.avg("val").over(w.rowsBetween(-2, 2)).alias("m"))
    return p.where("(k - 1) % 4 = 0").select("image_id", "r", "c", F.round(F.col("m") + 1e-9, 5).alias("m"))


@query("w14_curvature")
def w14(spark, d):
    """Mean curvature of circles fitted (by Pratt's method, Newton steps from 0) to seven-point windows of each contour."""
    w = W.partitionBy("image_id", "r").orderBy("c").rowsBetween(-3, 3)
    x, y = F.col("c").cast("double"), F.col("val") / 20
    p = B.raster(spark, d).select("image_id", "r", "c", x.alias("x"), y.alias("y"))
    mean = p.select("*", F.avg("x").over(w).alias("mx"), F.avg("y").over(w).alias("my"), F.collect_list(F.struct("x", "y")).over(w).alias("p"))
    z = lambda s: (s["x"] - F.col("mx")) ** 2 + (s["y"] - F.col("my")) ** 2
    def moment(f):
        return F.aggregate("p", F.lit(0.0), lambda a, s: a + f(s)) / F.size("p")
    u, v = (lambda s: s["x"] - F.col("mx")), (lambda s: s["y"] - F.col("my"))
    m = mean.select(
        "image_id", "r", "c", F.size("p").alias("n"), moment(lambda s: u(s) * u(s)).alias("xx"), moment(lambda s: v(s) * v(s)).alias("yy"), moment(lambda s: u(s) * v(s)).alias("xy"),
        moment(lambda s: u(s) * z(s)).alias("xz"), moment(lambda s: v(s) * z(s)).alias("yz"), moment(lambda s: z(s) * z(s)).alias("zz"),
    ).where("n >= 5")
    m = m.withColumn("mz", F.expr("xx + yy")).withColumn("cov", F.expr("xx * yy - xy * xy"))
    m = m.withColumn("a2", F.expr("4 * cov - 3 * mz * mz - zz")).withColumn("a1", F.expr("zz * mz + 4 * cov * mz - xz * xz - yz * yz - mz * mz * mz"))
    m = m.withColumn("a0", F.expr("xz * xz * yy + yz * yz * xx - zz * cov - 2 * xz * yz * xy + mz * mz * cov"))
    root = F.lit(0.0)
    m = m.withColumn("root", root)
    for _ in range(20):
        f, df = F.expr("a0 + root * (a1 + root * (a2 + 4 * root * root))"), F.expr("a1 + root * (2 * a2 + 16 * root * root)")
        m = m.withColumn("f", f).withColumn("df", df).withColumn("root", F.when(F.abs("df") < 1e-12, F.col("root")).otherwise(F.col("root") - F.col("f") / F.col("df"))).drop("f", "df")
    m = m.withColumn("det", F.expr("root * root - root * mz + cov"))
    m = m.withColumn("cx", F.expr("(xz * (yy - root) - yz * xy) / nullif(det, 0) / 2")).withColumn("cy", F.expr("(yz * (xx - root) - xz * xy) / nullif(det, 0) / 2"))
    m = m.withColumn("k", F.when(F.abs("det") < 1e-12, 0.0).otherwise(F.try_divide(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.expr("cx * cx + cy * cy + mz + 2 * root"))))))
    return m.groupBy("image_id", "r").agg(F.round(F.avg("k"), 5).alias("curvature"))


@query(
    "w17_non_max", B.RASTER,
    "g as (select image_id, r, c, val, lag(val) over x as w, lead(val) over x as e, lag(val) over y as n, lead(val) over y as s from ras window x as (partition by image_id, r order by c), y as (partition by image_id, c order by r))",
    "select image_id, r, c, case when ((r + c) % 2 = 0 and val > coalesce(w, 0) and val > coalesce(e, 0)) or ((r + c) % 2 = 1 and val > coalesce(n, 0) and val > coalesce(s, 0)) then val else 0.0 end as val from g",
)
def w17(spark, d):
    """Non-maximum suppression with an orientation per pixel: here along rows or columns by parity; outside counts 0."""
    x, y = W.partitionBy("image_id", "r").orderBy("c"), W.partitionBy("image_id", "c").orderBy("r")
    out = lambda f, w: F.coalesce(f("val").over(w), F.lit(0.0))
    p = B.raster(spark, d).select("image_id", "r", "c", "val", out(F.lag, x).alias("w"), out(F.lead, x).alias("e"), out(F.lag, y).alias("n"), out(F.lead, y).alias("s"))
    keep = F.expr("((r + c) % 2 = 0 and val > w and val > e) or ((r + c) % 2 = 1 and val > n and val > s)")
    return p.select("image_id", "r", "c", F.when(keep, F.col("val")).otherwise(0.0).alias("val"))


@query(
    "w18_focal", B.RASTER, "j as (select a.image_id, a.r, a.c, b.val from ras a join ras b on a.image_id = b.image_id and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4)",
    "select image_id, r, c, max(val) as top, list_sort(list(val))[(count(*) + 1) // 2] as median from j group by all",
)
def w18(spark, d):
    """Largest and (lower) median value in a disk of radius 2."""
    ras = B.raster(spark, d).select("image_id", "r", "c", "val")
    j = R.within_radius(ras.drop("val"), ras, 4.0).groupBy("image_id", "r", "c").agg(F.sort_array(F.collect_list("val2")).alias("v"))
    return j.select("image_id", "r", "c", F.array_max("v").alias("top"), F.get("v", F.expr("(size(v) + 1) div 2 - 1")).alias("median"))


BOUND = """bd as (select a.image_id, a.r, a.c from lab a left join lab e on e.image_id = a.image_id and e.r = a.r and e.c = a.c + 1 left join lab s on s.image_id = a.image_id and s.r = a.r + 1 and s.c = a.c
  left join lab x on x.image_id = a.image_id and x.r = a.r + 1 and x.c = a.c + 1 where e.label <> a.label or s.label <> a.label or x.label <> a.label)"""


def label_boundary(lab):
    """Pixels whose right, lower or lower-right neighbour has another label."""
    x, y = W.partitionBy("image_id", "r").orderBy("c"), W.partitionBy("image_id", "c").orderBy("r")
    p = lab.select("image_id", "r", "c", "label", F.lead("label").over(x).alias("e")).select("*", F.lead("label").over(y).alias("s"), F.lead("e").over(y).alias("x"))
    return p.where("e <> label or s <> label or x <> label").select("image_id", "r", "c")


@query("i4_label_boundary", B.RASTER, B.LABELMAP, BOUND, "select * from bd")
def i4(spark, d):
    return label_boundary(B.label_map(B.raster(spark, d)))


@query(
    "w19_orientation", B.RASTER, B.LABELMAP, BOUND,
    "j as (select a.image_id, a.r, a.c, var_pop(b.c) as vx, var_pop(b.r) as vy, avg(b.r * b.c) - avg(b.r) * avg(b.c) as cov from bd a join bd b on a.image_id = b.image_id and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9 group by all)",
    "o as (select image_id, r, c, 0.5 * atan2(round(2 * cov, 9) + 0.0, round(vx - vy, 9) + 0.0) as o from j)",
    "select image_id, r, c, round(case when o < 0 then o + pi() else o end, 4) as o from o",
)
def w19(spark, d):
    """Direction of largest variance of the boundary pixels within a radius of 3, in [0, pi)."""
    b = label_boundary(B.label_map(B.raster(spark, d))).cache()
    j = R.within_radius(b, b, 9.0).groupBy("image_id", "r", "c").agg(F.var_pop("c2").alias("vx"), F.var_pop("r2").alias("vy"), (F.avg(F.col("r2") * F.col("c2")) - F.avg("r2") * F.avg("c2")).alias("cov"))
    o = 0.5 * F.atan2(F.round(2 * F.col("cov"), 9) + F.lit(0.0), F.round(F.col("vx") - F.col("vy"), 9) + F.lit(0.0))
    return j.select("image_id", "r", "c", F.round(F.when(o < 0, o + math.pi).otherwise(o), 4).alias("o"))


@query(
    "w17_oriented_non_max", B.RASTER, B.LABELMAP, BOUND,
    "j as (select a.image_id, a.r, a.c, var_pop(b.c) as vx, var_pop(b.r) as vy, avg(b.r * b.c) - avg(b.r) * avg(b.c) as cov from bd a join bd b on a.image_id = b.image_id and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9 group by all)",
    "o as (select image_id, r, c, 0.5 * atan2(round(2 * cov, 9) + 0.0, round(vx - vy, 9) + 0.0) as o from j)",
    "t as (select image_id, r, c, round(case when o < 0 then o + pi() else o end, 4) + pi() / 2 as t from o)",
    "u as (select image_id, r, c, cos(t) as x, sin(t) as y from t)",
    """n as (select u.*, m.val, (abs(x) >= abs(y)) as flat, case when x * y >= 0 then 1 else -1 end as s, case when abs(x) >= abs(y) then abs(y / x) else abs(x / y) end as d from u join ras m using (image_id, r, c))""",
    """v as (select n.*, round((1 - d) * a.val + d * b.val + 1e-9, 6) as v1, round((1 - d) * e.val + d * f.val + 1e-9, 6) as v2 from n
      join ras a on a.image_id = n.image_id and a.r = n.r + (not flat)::int and a.c = n.c + flat::int
      join ras b on b.image_id = n.image_id and b.r = n.r + case when flat then s else 1 end and b.c = n.c + case when flat then 1 else s end
      join ras e on e.image_id = n.image_id and e.r = n.r - (not flat)::int and e.c = n.c - flat::int
      join ras f on f.image_id = n.image_id and f.r = n.r - case when flat then s else 1 end and f.c = n.c - case when flat then 1 else s end)""",
    "select ras.image_id, ras.r, ras.c, case when v1 <= round(v.val + 1e-9, 6) and v2 <= round(v.val + 1e-9, 6) then v.val else 0.0 end as val from ras left join v on v.image_id = ras.image_id and v.r = ras.r and v.c = ras.c",
)
def w17_oriented(spark, d):
    """Non-maximum suppression across the orientation of w19, neighbours interpolated in 3 x 3."""
    px = B.raster(spark, d).select("image_id", "r", "c", "val").join(w19(spark, d), ["image_id", "r", "c"], "left")
    return R.oriented_maxima(px, "val", "o").select("image_id", "r", "c", F.col("kept").alias("val"))


@query("j15_neighbour_edges", B.RASTER, B.EDGES, "select graph_id, src, dst from edge")
def j15(spark, d):
    return B.raster_graph(B.raster(spark, d)).select("graph_id", "src", "dst")


@query("j15_eight_neighbours", B.RASTER, "select a.image_id as graph_id, ((a.c - 1) * 24 + a.r + 1)::bigint as src, ((b.c - 1) * 24 + b.r + 1)::bigint as dst from ras a join ras b on a.image_id = b.image_id and ((b.r = a.r - 1 and abs(b.c - a.c) <= 1) or (b.r = a.r and b.c = a.c - 1))")
def j15_8(spark, d):
    """NW, N, NE and W pairs."""
    px = B.raster(spark, d).select("image_id", "r", "c")
    near = R.shifted(px, [(-1, -1), (-1, 0), (-1, 1), (0, -1)]).join(px, ["image_id", "r", "c"], "left_semi")
    return near.select(F.col("image_id").alias("graph_id"), B.pixel_id("r0", "c0").alias("src"), B.pixel_id("r", "c").alias("dst"))


@query("j16_radius_pairs", B.RASTER, B.MASKS, "select a.image_id, a.r, a.c, b.r as r2, b.c as c2 from mask a join mask b on a.image_id = b.image_id and a.segment_id = 3 and b.segment_id = 4 and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 6.25")
def j16(spark, d):
    m = B.threshold_masks(B.raster(spark, d)).cache()
    a, b = (m.where(f"segment_id = {k}").select("image_id", "r", "c") for k in (3, 4))
    return R.within_radius(a, b, 6.25)


@query("j25_neighbour_difference", B.RASTER, "select a.image_id, a.r as r0, a.c as c0, b.r, b.c, round(abs(a.val - b.val), 4) as diff from ras a join ras b on a.image_id = b.image_id and ((b.r = a.r and b.c = a.c + 1) or (b.r = a.r + 1 and b.c = a.c))")
def j25(spark, d):
    ras = B.raster(spark, d).select("image_id", "r", "c", "val")
    near = R.shifted(ras, [(0, 1), (1, 0)]).withColumnRenamed("val", "v0").join(ras, ["image_id", "r", "c"])
    return near.select("image_id", "r0", "c0", "r", "c", F.round(F.abs(F.col("v0") - F.col("val")), 4).alias("diff"))


@query("j26_distance_transform", B.RASTER, "al as (select a.image_id, a.r, a.c, b.r as v, b.c as u, round(b.val + 1.5 * (b.c - a.c - 1) * (b.c - a.c - 1) + 0.5 * (b.r - a.r) * (b.r - a.r), 9) as f from ras a join ras b using (image_id))", "select image_id, r, c, round(min(f), 4) as dt, arg_min(u, (f, v, u)) as u, arg_min(v, (f, v, u)) as v from al group by all")
def j26(spark, d):
    return R.distance_transform(B.raster(spark, d), "val", 1.5, 1.0, 0.5, 0.0).withColumn("dt", F.round("dt", 4))


@query(
    "i8_boundary_distance", B.RASTER, B.LABELMAP, BOUND,
    "select a.image_id, a.r, a.c, round(sqrt(min((b.c - a.c) * (b.c - a.c) + (b.r - a.r) * (b.r - a.r))), 6) as dist from ras a join bd b using (image_id) group by all",
)
def i8(spark, d):
    """Exact distance of every pixel to the label boundary: the distance transform of 0 on it and a large value off it."""
    ras = B.raster(spark, d).select("image_id", "r", "c").cache()
    on = label_boundary(B.label_map(B.raster(spark, d))).withColumn("f", F.lit(0.0))
    px = ras.join(on, ["image_id", "r", "c"], "left").fillna(1e9, ["f"])
    return R.distance_transform(px, "f", 1.0, 0.0, 1.0, 0.0).where("dt < 1e9").select("image_id", "r", "c", r6(F.sqrt("dt")).alias("dist"))


@query(
    "j27_intervening_contour", B.RASTER,
    "p as (select a.image_id, a.r, a.c, b.r as r2, b.c as c2 from ras a join ras b on a.image_id = b.image_id and a.n > 0 and b.n > 0 and a.val > 70 and b.val > 70 and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9 and (a.r, a.c) < (b.r, b.c))",
    "l as (select p.*, round(p.r + (p.r2 - p.r) * k / 4.0::double)::int as rr, round(p.c + (p.c2 - p.c) * k / 4.0::double)::int as cc from p, (select unnest(range(0, 5)) as k))",
    "select l.image_id, l.r, l.c, l.r2, l.c2, round(1 - max(ras.val / 500), 6) as ic from l join ras on ras.image_id = l.image_id and ras.r = rr and ras.c = cc group by all",
)
def j27(spark, d):
    """1 - the largest boundary strength on the line between two pixels, sampled at five points."""
    ras = B.raster(spark, d).cache()
    a = ras.where("n > 0 and val > 70").select("image_id", "r", "c")
    p = R.within_radius(a, a, 9.0).where("struct(r, c) < struct(r2, c2)")
    line = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    line = line.withColumn("rr", F.expr("cast(round(r + (r2 - r) * k / 4.0D) as int)")).withColumn("cc", F.expr("cast(round(c + (c2 - c) * k / 4.0D) as int)"))
    s = ras.select("image_id", F.col("r").alias("rr"), F.col("c").alias("cc"), "val")
    return line.join(s, ["image_id", "rr", "cc"]).groupBy("image_id", "r", "c", "r2", "c2").agg(r6(1 - F.max(F.col("val") / 500)).alias("ic"))


@query(
    "p13_contrast_weight", B.RASTER,
    "e as (select a.image_id, a.r as r0, a.c as c0, b.r, b.c, abs(a.val - b.val) as diff from ras a join ras b on a.image_id = b.image_id and ((b.r = a.r and b.c = a.c + 1) or (b.r = a.r + 1 and b.c = a.c)))",
    "w as (select *, 10 * exp(-diff * 0.02::double) + 0.5 + 0.007 as w from e)", "l as (select image_id, min(w) as lo, max(w) as hi from w group by 1)",
    "f as (select w.image_id, count(*) filter (least(10, floor((w - lo) / ((hi - lo) / 10)) + 1) = 2) > count(*) filter (least(10, floor((w - lo) / ((hi - lo) / 10)) + 1) = 1) as more from w join l using (image_id) group by 1)",
    "select image_id, r0, c0, r, c, round(10 * exp(-diff * (0.02::double + case when more then 0.07::double else 0 end)) + 0.5 + 0.007, 6) as w from w join f using (image_id)",
)
def p13(spark, d):
    """Contrast-sensitive weights; where the second of ten weight bins beats the first, the exponent grows by 0.07."""
    ras = B.raster(spark, d).select("image_id", "r", "c", "val")
    e = R.shifted(ras, [(0, 1), (1, 0)]).withColumnRenamed("val", "v0").join(ras, ["image_id", "r", "c"]).withColumn("diff", F.abs(F.col("v0") - F.col("val")))
    weight = lambda a: 10 * F.exp(-F.col("diff") * a) + 0.5 + 0.007
    w = e.withColumn("w", weight(F.lit(0.02)))
    lim = w.groupBy("image_id").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    b = w.join(F.broadcast(lim), "image_id").withColumn("bin", F.expr("least(10, floor((w - lo) / ((hi - lo) / 10)) + 1)"))
    flag = b.groupBy("image_id").agg((F.count(F.when(F.col("bin") == 2, 1)) > F.count(F.when(F.col("bin") == 1, 1))).alias("more"))
    return w.join(F.broadcast(flag), "image_id").select("image_id", "r0", "c0", "r", "c", r6(weight(F.lit(0.02) + F.when(F.col("more"), 0.07).otherwise(0.0))).alias("w"))


# morphology
GRID = "select image_id, r, c from ras"
DIL = "dil as (select distinct m.image_id, m.segment_id, g.r, g.c from mask m join ras g on g.image_id = m.image_id and abs(g.r - m.r) <= 1 and abs(g.c - m.c) <= 1)"
ERO = "ero as (select m.image_id, m.segment_id, m.r, m.c from mask m join ras g on g.image_id = m.image_id and abs(g.r - m.r) <= 1 and abs(g.c - m.c) <= 1 left join mask x on x.image_id = m.image_id and x.segment_id = m.segment_id and x.r = g.r and x.c = g.c group by all having count(*) = count(x.r))"


@query("i1_dilate", B.RASTER, B.MASKS, DIL, "select * from dil")
def i1(spark, d):
    ras = B.raster(spark, d).cache()
    return R.dilate(B.threshold_masks(ras), ras, R.square(1), SEG)


@query("i1_erode", B.RASTER, B.MASKS, ERO, "select * from ero")
def i1_erode(spark, d):
    ras = B.raster(spark, d).cache()
    return R.erode(B.threshold_masks(ras), ras, R.square(1), SEG)


@query("i2_opening", B.RASTER, B.MASKS, ERO, "select distinct m.image_id, m.segment_id, g.r, g.c from ero m join ras g on g.image_id = m.image_id and abs(g.r - m.r) <= 1 and abs(g.c - m.c) <= 1")
def i2(spark, d):
    ras = B.raster(spark, d).cache()
    return R.dilate(R.erode(B.threshold_masks(ras), ras, R.square(1), SEG), ras, R.square(1), SEG)


EDGE4 = "bnd as (select m.image_id, m.segment_id, m.r, m.c from mask m left join mask x on x.image_id = m.image_id and x.segment_id = m.segment_id and abs(x.r - m.r) + abs(x.c - m.c) = 1 group by all having count(x.r) < 4)"


@query("i3_mask_boundary", B.RASTER, B.MASKS, EDGE4, "select * from bnd")
def i3(spark, d):
    return R.boundary(B.threshold_masks(B.raster(spark, d)), SEG)


@query("i5_mask_components")
def i5(spark, d):
    """Components of every mask (8 neighbours) with at least 3 pixels: their size and smallest pixel."""
    comp = R.masks_components(B.threshold_masks(B.raster(spark, d)), SEG)
    n = comp.groupBy(*SEG, "cr", "cc").agg(F.count("*").alias("n")).where("n >= 3")
    return n.select(*SEG, B.pixel_id("cr", "cc").alias("first_pixel"), "n")


@query("i6_label_components")
def i6(spark, d):
    """Components of equal labels in a label map (4 neighbours), named by their smallest pixel."""
    comp = R.masks_components(B.label_map(B.raster(spark, d)), ["image_id", "label"], R.FOUR)
    return comp.select("image_id", "r", "c", "label", B.pixel_id("cr", "cc").alias("component"))


@query("i7_merge_dust")
def i7(spark, d):
    """Regions of under 4 pixels take the commonest label among their 8 neighbours outside (smallest on ties), in rounds."""
    from fieldloom.operators.shared import checkpoint

    return merge_dust(i6(spark, d).select("image_id", "r", "c", F.col("component").alias("label")), 4)


def merge_dust(lab, least: int):
    """lab (image_id, r, c, label) until every region has `least` pixels or no neighbour.

    In a round each smaller region votes for its commonest neighbour; what votes connect becomes one region: the one of
    them that is large enough, else the smallest label. So every round has fewer regions, and the loop ends."""
    from fieldloom.operators.components import connected_components
    from fieldloom.operators.shared import checkpoint

    while True:
        lab = checkpoint(lab)
        dust = lab.groupBy("image_id", "label").agg(F.count("*").alias("n")).where(F.col("n") < least).select("image_id", "label")
        votes = R.shifted(lab.join(dust, ["image_id", "label"], "left_semi"), R.EIGHT).join(lab.select("image_id", "r", "c", F.col("label").alias("other")), ["image_id", "r", "c"]).where("other <> label")
        best = votes.groupBy("image_id", "label", "other").agg(F.count("*").alias("k")).groupBy("image_id", "label").agg(F.max_by("other", F.struct("k", -F.col("other"))).alias("to"))
        best = checkpoint(best)
        if best.isEmpty():
            return lab
        # labels of all images as single numbers
        names = lab.select("image_id").distinct()
        names = names.withColumn("base", F.row_number().over(W.orderBy("image_id")) * F.lit(1 << 40))  # one row an image
        ends = best.join(names, "image_id").select("image_id", (F.col("base") + F.col("label")).alias("a"), (F.col("base") + F.col("to")).alias("b"))
        comp = connected_components(ends, "a", "b").join(ends.select(F.col("a").alias("node"), F.lit(True).alias("dust")), "node", "left")
        into = comp.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("dust").isNull(), F.col("node"))), F.min("node")).alias("into"))
        new = comp.join(into, "component").select(F.col("node").alias("key"), "into")
        lab = lab.join(names, "image_id").withColumn("key", F.col("base") + F.col("label")).join(new, "key", "left")
        lab = lab.select("image_id", "r", "c", F.coalesce(F.col("into") - F.col("base"), F.col("label")).alias("label"))


@query(
    "a12_region_properties", B.RASTER, B.MASKS,
    "m as (select image_id, segment_id, count(*) as area, avg(r) as cr, avg(c) as cc, min(r) as r1, max(r) as r2, min(c) as c1, max(c) as c2, var_pop(c) + 1 / 12.0::double as xx, var_pop(r) + 1 / 12.0::double as yy, avg(r * c) - avg(r) * avg(c) as xy from mask group by all)",
    "e as (select *, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) as k from m)",
    f"""select image_id, segment_id, area, round(cr, 5) as cr, round(cc, 5) as cc, r1, r2, c1, c2, round(2 * sqrt(2) * sqrt(xx + yy + k), 4) as major, round(2 * sqrt(2) * sqrt(greatest(0, xx + yy - k)), 4) as minor,
       round(sqrt(4 * area / pi()), 5) as diameter, round(area / ((r2 - r1 + 1) * (c2 - c1 + 1)), 6) as extent, round(sqrt((cr - 11.5) * (cr - 11.5) + (cc - mid) * (cc - mid)), 5) as off_centre from e, (select ({B.LAST} + 1) / 2.0::double as mid)""",
)
def a12(spark, d):
    ras, cols = B.raster_of(spark, d)
    m = B.threshold_masks(ras).groupBy(*SEG).agg(
        F.count("*").alias("area"), F.avg("r").alias("cr"), F.avg("c").alias("cc"), F.min("r").alias("r1"), F.max("r").alias("r2"), F.min("c").alias("c1"), F.max("c").alias("c2"),
        (F.var_pop("c") + 1 / 12).alias("xx"), (F.var_pop("r") + 1 / 12).alias("yy"), (F.avg(F.col("r") * F.col("c")) - F.avg("r") * F.avg("c")).alias("xy"),
    )
    k = F.sqrt(F.expr("(xx - yy) * (xx - yy) + 4 * xy * xy"))
    axis = lambda s: F.round(2 * math.sqrt(2) * F.sqrt(F.greatest(F.lit(0.0), F.col("xx") + F.col("yy") + s * k)), 4)
    return m.select(
        *SEG, "area", F.round("cr", 5).alias("cr"), F.round("cc", 5).alias("cc"), "r1", "r2", "c1", "c2", axis(1).alias("major"), axis(-1).alias("minor"), F.round(F.sqrt(4 * F.col("area") / math.pi), 5).alias("diameter"),
        r6(F.expr("area / ((r2 - r1 + 1) * (c2 - c1 + 1))")).alias("extent"), F.round(F.sqrt((F.col("cr") - 11.5) ** 2 + (F.col("cc") - (cols + 1) / 2) ** 2), 5).alias("off_centre"),
    )


@query(
    "a13_perimeter_euler", B.RASTER, B.MASKS,
    "s as (select m.image_id, m.segment_id, 4 * count(distinct (m.r, m.c)) - count(x.r) as perimeter from mask m left join mask x on x.image_id = m.image_id and x.segment_id = m.segment_id and abs(x.r - m.r) + abs(x.c - m.c) = 1 group by all)",
    "q as (select image_id, segment_id, r + dr as r, c + dc as c, count(*) as n, sum(dr * 2 + dc) as code from mask, (select unnest([0, 1]) as dr), (select unnest([0, 1]) as dc) group by all)",
    "e as (select image_id, segment_id, (count(*) filter (n = 1) - count(*) filter (n = 3) - 2 * count(*) filter (n = 2 and code = 3)) / 4 as euler from q group by all)",
    "select image_id, segment_id, perimeter, euler::bigint as euler from s join e using (image_id, segment_id)",
)
def a13(spark, d):
    """Crack length, and components minus holes (8-connected) from the 2 x 2 quads."""
    m = B.threshold_masks(B.raster(spark, d)).cache()
    near = R.shifted(m, R.FOUR).join(m, [*SEG, "r", "c"], "left_semi").groupBy(*SEG).agg(F.count("*").alias("inner"))
    s = m.groupBy(*SEG).agg(F.count("*").alias("area")).join(near, SEG, "left").select(*SEG, (4 * F.col("area") - F.coalesce("inner", F.lit(0))).alias("perimeter"))
    quad = R.shifted(m, [(0, 0), (0, 1), (1, 0), (1, 1)]).withColumn("code", (F.col("r") - F.col("r0")) * 2 + F.col("c") - F.col("c0")).groupBy(*SEG, "r", "c").agg(F.count("*").alias("n"), F.sum("code").alias("code"))
    e = quad.groupBy(*SEG).agg(F.expr("cast((count_if(n = 1) - count_if(n = 3) - 2 * count_if(n = 2 and code = 3)) / 4 as bigint)").alias("euler"))
    return s.join(e, SEG)


@query("a26_mean_per_label", B.RASTER, B.LABELMAP, "select image_id, r, c, round(avg(ras.val) over (partition by image_id, label) + 1e-9, 5) as mean from ras join lab using (image_id, r, c)")
def a26(spark, d):
    ras = B.raster(spark, d)
    lab = ras.select("image_id", "r", "c", "val", F.when(F.col("n") == 0, 255).otherwise(F.least(F.lit(4), F.floor(F.col("val") / 20).cast("int"))).alias("label"))
    mean = lab.groupBy("image_id", "label").agg(F.round(F.avg("val") + 1e-9, 5).alias("mean"))
    return lab.join(F.broadcast(mean), ["image_id", "label"]).select("image_id", "r", "c", "mean")  # labels of an image


@query(
    "a19_contour_energy", B.RASTER, B.MASKS, EDGE4, f"select b.image_id, b.segment_id, round(-avg(val) + 1e-9, 5) as energy from bnd b join ras using (image_id, r, c) where b.r between 1 and 22 and b.c between 2 and {B.LAST} - 1 group by all",
)
def a19(spark, d):
    """Minus the mean strength on the mask boundary, the image's frame left out."""
    ras, cols = B.raster_of(spark, d)
    ras = ras.cache()
    b = R.boundary(B.threshold_masks(ras), SEG).where(f"r between 1 and 22 and c between 2 and {cols - 1}")
    return b.join(ras, ["image_id", "r", "c"]).groupBy(*SEG).agg(F.round(-F.avg("val") + 1e-9, 5).alias("energy"))


@query(
    "a20_band_energy", B.RASTER, B.MASKS, DIL,
    "d5 as (select distinct m.image_id, m.segment_id, g.r, g.c from mask m join ras g on g.image_id = m.image_id and abs(g.r - m.r) <= 2 and abs(g.c - m.c) <= 2)",
    "co as (select s.image_id, s.segment_id, g.r, g.c from (select distinct image_id, segment_id from mask) s join ras g using (image_id) where (s.image_id, s.segment_id, g.r, g.c) not in (select (image_id, segment_id, r, c) from mask))",
    "e5 as (select distinct m.image_id, m.segment_id, g.r, g.c from co m join ras g on g.image_id = m.image_id and abs(g.r - m.r) <= 2 and abs(g.c - m.c) <= 2)",
    "band as (select image_id, segment_id, sum(val) as s from (select * from d5 intersect select * from e5) join ras using (image_id, r, c) group by all)",
    "ring as (select image_id, segment_id, count(*) as n from (select * from dil except select image_id, segment_id, r, c from mask) group by all)",
    "own as (select m.image_id, m.segment_id, sum(val) / count(*) as intra, count(*) as area from mask m join ras using (image_id, r, c) group by all)",
    "select image_id, segment_id, round(s, 3) as inter, round(s / n + 1e-9, 4) as inter_norm, round(intra + 1e-9, 5) as intra, round(intra / area + 1e-9, 6) as intra_norm from band join ring using (image_id, segment_id) join own using (image_id, segment_id)",
)
def a20(spark, d):
    """Strength on the band around the boundary (summed, and by the size of the outer ring) and inside the mask."""
    ras = B.raster(spark, d).cache()
    m = B.threshold_masks(ras).cache()
    d5, e5 = R.dilate(m, ras, R.square(2), SEG), R.dilate(R.complement(m, ras, SEG), ras, R.square(2), SEG)
    on = [*SEG, "r", "c"]
    val = ras.select("image_id", "r", "c", "val")
    band = d5.join(e5, on, "left_semi").join(val, ["image_id", "r", "c"]).groupBy(*SEG).agg(F.sum("val").alias("s"))
    ring = R.dilate(m, ras, R.square(1), SEG).join(m, on, "left_anti").groupBy(*SEG).agg(F.count("*").alias("n"))
    own = m.join(val, ["image_id", "r", "c"]).groupBy(*SEG).agg(F.avg("val").alias("intra"), F.count("*").alias("area"))
    return band.join(ring, SEG).join(own, SEG).select(*SEG, F.round("s", 3).alias("inter"), F.round(F.col("s") / F.col("n") + 1e-9, 4).alias("inter_norm"), F.round(F.col("intra") + 1e-9, 5).alias("intra"), r6(F.col("intra") / F.col("area") + 1e-9).alias("intra_norm"))


@query(
    "a21_dissimilarity", B.RASTER, B.MASKS,
    "t as (select s.segment_id, g.image_id, least(64, floor(g.val / 4))::int as bin, (m.r is not null) as fg from ras g join (select distinct image_id, segment_id from mask) s using (image_id) left join mask m on m.image_id = g.image_id and m.segment_id = s.segment_id and m.r = g.r and m.c = g.c)",
    f"h as (select image_id, segment_id, bin, count(*) filter (fg) / (sum(count(*) filter (fg)) over w + {2.220446049250313e-16!r}::double) as f, count(*) filter (not fg) / (sum(count(*) filter (not fg)) over w + {2.220446049250313e-16!r}::double) as b from t group by image_id, segment_id, bin window w as (partition by image_id, segment_id))",
    "select image_id, segment_id, round(sum(case when f + b = 0 then 0 else (f - b) * (f - b) / (f + b) end), 6) as chi2, count(*) filter (f > 1 / 300.0::double) as simplicity from h group by all",
)
def a21(spark, d):
    """Chi-square between the inside's and the outside's 65-bin histograms, and the bins that the inside fills."""
    ras = B.raster(spark, d).cache()
    m = B.threshold_masks(ras).cache()
    full = m.select(*SEG).distinct().join(ras, "image_id").join(m.withColumn("fg", F.lit(1)), [*SEG, "r", "c"], "left")
    h = full.groupBy(*SEG, F.least(F.lit(64), F.floor(F.col("val") / 4)).alias("bin")).agg(F.count("fg").alias("f"), (F.count("*") - F.count("fg")).alias("b"))
    w = W.partitionBy(*SEG)
    eps = 2.220446049250313e-16
    h = h.select(*SEG, (F.col("f") / (F.sum("f").over(w) + eps)).alias("f"), (F.col("b") / (F.sum("b").over(w) + eps)).alias("b"))
    return h.groupBy(*SEG).agg(r6(F.sum(F.when(F.col("f") + F.col("b") == 0, 0.0).otherwise((F.col("f") - F.col("b")) ** 2 / (F.col("f") + F.col("b"))))).alias("chi2"), F.count(F.when(F.col("f") > 1 / 300, 1)).alias("simplicity"))


# scalar rasters
@query("x10_chord_deviation", B.RASTER, "e as (select image_id, r, c, val, first(val) over w as v1, last(val) over w as v2 from ras window w as (partition by image_id, r order by c rows between unbounded preceding and unbounded following))", f"d as (select image_id, r, c, abs((v2 - v1) * (c - 1) - k * (val - v1)) / sqrt((v2 - v1) * (v2 - v1) + k * k) as dev from e, (select {B.LAST} - 1 as k))", "select image_id, r, round(max(dev), 4) as top, arg_max(c, (round(dev, 6), -c)) as at, round(sum(dev), 3) as total from d group by all")
def x10(spark, d):
    """Deviation of ordered points (a row's values) from the line through its end points."""
    w = W.partitionBy("image_id", "r").orderBy("c").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ras, cols = B.raster_of(spark, d)
    e = ras.select("image_id", "r", "c", "val", F.first("val").over(w).alias("v1"), F.last("val").over(w).alias("v2"))
    dev = F.abs((F.col("v2") - F.col("v1")) * (F.col("c") - 1) - (cols - 1) * (F.col("val") - F.col("v1"))) / F.sqrt((F.col("v2") - F.col("v1")) ** 2 + (cols - 1) ** 2)
    e = e.select("image_id", "r", "c", dev.alias("dev"))
    return e.groupBy("image_id", "r").agg(F.round(F.max("dev"), 4).alias("top"), F.max_by("c", F.struct(F.round("dev", 6), -F.col("c"))).alias("at"), F.round(F.sum("dev"), 3).alias("total"))


@query(
    "x11_scaling", B.RASTER, "select image_id, (r // 2)::int as r, ((c + 1) // 2)::int as c, round((val - min(val) over w) / (max(val) over w - min(val) over w), 6) as v from ras window w as (partition by image_id) qualify r % 2 = 0 and c % 2 = 1".replace("select image_id, (r // 2)::int as r, ((c + 1) // 2)::int as c,", "select image_id, (r // 2)::int as r2, ((c + 1) // 2)::int as c2,"),
)
def x11(spark, d):
    """Contrast stretch to 0..1, then every second row and column."""
    ras = B.raster(spark, d)
    lim = ras.groupBy("image_id").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    s = ras.join(F.broadcast(lim), "image_id").where("r % 2 = 0 and c % 2 = 1")
    return s.select("image_id", F.expr("cast(r div 2 as int)").alias("r2"), F.expr("cast((c + 1) div 2 as int)").alias("c2"), r6((F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))


@query("x12_frame_bias", B.RASTER, f"f as (select image_id, r, c, sqrt((r - 10) * (r - 10) + (c - 12) * (c - 12)) as d from ras where r in (0, 23) or c in (1, {B.LAST}))", "select image_id, r, c, round(d / max(d) over (partition by image_id), 6) as bias from f")
def x12(spark, d):
    """Distance of frame pixels from a seed's centroid over the largest."""
    ras, cols = B.raster_of(spark, d)
    f = ras.where(f"r in (0, 23) or c in (1, {cols})").withColumn("d", F.sqrt((F.col("r") - 10) ** 2 + (F.col("c") - 12) ** 2))
    top = f.groupBy("image_id").agg(F.max("d").alias("m"))
    return f.join(F.broadcast(top), "image_id").select("image_id", "r", "c", r6(F.col("d") / F.col("m")).alias("bias"))


@query("x13_seed_likelihood", B.RASTER, "select image_id, r, c, round(0.3 * 1000 * exp(-0.07 * least(abs(val - 10), abs(val - 40), abs(val - 70), abs(val - 100), abs(val - 160))), 4) as p from ras")
def x13(spark, d):
    """0.3 C exp(-0.07 L1 distance to the nearest of five seed centres)."""
    near = F.least(*(F.abs(F.col("val") - v) for v in (10, 40, 70, 100, 160)))
    return B.raster(spark, d).select("image_id", "r", "c", F.round(0.3 * 1000 * F.exp(-0.07 * near), 4).alias("p"))


@query("x15_radial_weight", B.RASTER, "d as (select *, sqrt((r - 10) * (r - 10) + (c - 12) * (c - 12)) as d from ras)", "select image_id, r, c, round(val * (1 - (d - min(d) over w) / (max(d) over w - min(d) over w)), 5) + 0.0 as v from d window w as (partition by image_id)")
def x15(spark, d):
    f = B.raster(spark, d).withColumn("d", F.sqrt((F.col("r") - 10) ** 2 + (F.col("c") - 12) ** 2))
    lim = f.groupBy("image_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return f.join(F.broadcast(lim), "image_id").select("image_id", "r", "c", (F.round(F.col("val") * (1 - (F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 5) + F.lit(0.0)).alias("v"))


# grids and windows
@query("i33_seed_grid", B.RASTER, f"select distinct image_id, i::int as i, j::int as j, greatest(0, least(23, 3 + 4 * i + a))::int as r, greatest(1, least({B.LAST}, 4 + ({B.LAST} // 6) * j + b))::int as c from (select distinct image_id from ras), (select unnest(range(0, 6)) as i), (select unnest(range(0, 6)) as j), (select unnest(range(-1, 2)) as a), (select unnest(range(-1, 2)) as b)")
def i33(spark, d):
    """A 6 x 6 grid of seeds of 3 x 3 pixels over the whole image, clamped to it."""
    seq = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    ras, cols = B.raster_of(spark, d)
    g = ras.select("image_id").distinct()
    for n, (a, b) in {"i": (0, 5), "j": (0, 5), "a": (-1, 1), "b": (-1, 1)}.items():
        g = g.select("*", seq(a, b).alias(n))
    return g.select("image_id", "i", "j", F.expr("greatest(0, least(23, 3 + 4 * i + a))").alias("r"), F.expr(f"greatest(1, least({cols}, 4 + {cols // 6} * j + b))").alias("c")).distinct()


WIN = f"win as (select image_id, i * 6 + j as w, greatest(1, 1 + (k // 6) * j - h)::int as x1, least(k, 1 + (k // 6) * j + h)::int as x2, greatest(0, 4 * i - h)::int as y1, least(23, 4 * i + h)::int as y2 from (select distinct image_id from ras), (select {B.LAST} as k, 3 * greatest(24, {B.LAST}) // 10 as h), (select unnest(range(0, 6)) as i), (select unnest(range(0, 6)) as j))"


def window_grid(spark, d):
    ras, cols = B.raster_of(spark, d)
    h, step = 3 * max(B.ROWS, cols) // 10, cols // 6
    g = ras.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    return g.selectExpr("image_id", "cast(i * 6 + j as bigint) as w", f"greatest(1, 1 + {step} * j - {h}) as x1", f"least({cols}, 1 + {step} * j + {h}) as x2", f"greatest(0, 4 * i - {h}) as y1", f"least(23, 4 * i + {h}) as y2")


@query("i34_window_grid", B.RASTER, WIN, "select * from win")
def i34(spark, d):
    """Floor(sqrt(40))^2 windows of side 0.6 max(H, W), clipped to the image."""
    return window_grid(spark, d)


@query("i35_window_pixels", B.RASTER, WIN, "select win.image_id, w, r, c from win join ras on ras.image_id = win.image_id and r between y1 and y2 and c between x1 and x2")
def i35(spark, d):
    w = window_grid(spark, d).select("image_id", "w", "x1", "x2", F.explode(F.sequence("y1", "y2")).alias("r"))
    return w.select("image_id", "w", "r", F.explode(F.sequence("x1", "x2")).alias("c"))


@query(
    "i36_hypotheses", B.RASTER, B.MASKS,
    f"fr as (select image_id, r, c from ras where r in (0, 23) or c in (1, {B.LAST}))",
    """select 'internal' as kind, image_id, segment_id as seed, r, c, 1::int as class, 1000.0 as unary from mask where segment_id >= 3
       union all select 'subframe', s.image_id, s.segment_id, f.r, f.c, 0, -1000.0 from (select distinct image_id, segment_id from mask where segment_id >= 3) s join fr f using (image_id)
       where (s.image_id, s.segment_id, f.r, f.c) not in (select (image_id, segment_id, r, c) from mask)""",
)
def i36(spark, d):
    """Per seed the rows of its own pixels (class 1) and of the frame outside it (class 0), with their strengths."""
    ras, cols = B.raster_of(spark, d)
    ras = ras.cache()
    m = B.threshold_masks(ras).where("segment_id >= 3").select("image_id", F.col("segment_id").alias("seed"), "r", "c").cache()
    frame = m.select("image_id", "seed").distinct().join(ras.where(f"r in (0, 23) or c in (1, {cols})").select("image_id", "r", "c"), "image_id").join(m, ["image_id", "seed", "r", "c"], "left_anti")
    row = lambda df, kind, k, u: df.select(F.lit(kind).alias("kind"), "image_id", "seed", "r", "c", F.lit(k).alias("class"), F.lit(u).alias("unary"))
    return row(m, "internal", 1, 1000.0).union(row(frame, "subframe", 0, -1000.0))


# run-length label maps
RUNS = "k as (select *, label <> lag(label, 1, -1) over (partition by image_id, r order by c) as new from lab), g as (select *, sum(new::int) over (partition by image_id, r order by c) as run from k)"


@query("s4_runs", B.RASTER, B.LABELMAP, RUNS, "select image_id, label, r as row, min(c) as start, max(c) as \"end\" from g group by image_id, label, r, run")
def s4(spark, d):
    from fieldloom.sources.runs import to_runs

    return to_runs(B.label_map(B.raster(spark, d)))


@query("s3_runs_round_trip", B.RASTER, B.LABELMAP, "select image_id, r, c, label from lab")
def s3(spark, d):
    """Write runs as text, read and expand them; the audit of the text must be empty."""
    import uuid

    from fieldloom.sources import runs

    out = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    runs.write_runs(runs.to_runs(B.label_map(B.raster(spark, d))), out)
    return runs.expand(runs.read_runs(spark, out))
