"""Queries over segments, masks, boxes and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.operators import rank, sets
from fieldloom.operators.shared import shared_folder, stored
from fieldloom.plans.registry import query
from fieldloom.sources import bindings as B

r6 = lambda c: F.round(c, 6)

NSEG = "n as (select image_id, segment_id, count(*) as n from seg group by all)"
PAIR = """pair as (select a.image_id, a.segment_id as a, b.segment_id as b, count(*) as inter
  from seg a join seg b on a.image_id = b.image_id and a.pixel_id = b.pixel_id and a.segment_id < b.segment_id group by all)"""
IOU = """iou as (select p.image_id, a, b, inter, inter / (x.n + y.n - inter) as iou
  from pair p join n x on x.image_id = p.image_id and x.segment_id = a join n y on y.image_id = p.image_id and y.segment_id = b)"""


@query("p18_min_size", B.SEG, NSEG, "select image_id, segment_id, n from n where n >= 150")
def p18(spark, d):
    return sets.min_size(B.seg_pixels(spark, d), 150)


@query(
    "p19_max_energy", B.SEGMENTS,
    """k as (select *, row_number() over (partition by image_id order by energy, segment_id) as rank,
       count(*) filter (energy <= -3000) over (partition by image_id) as good from segs)""",
    "select image_id, segment_id, energy from k where (good >= 5 and energy <= -3000) or (good < 5 and rank <= 5)",
)
def p19(spark, d):
    return sets.max_energy(B.segments(spark, d), -3000.0, 5)


@query("j1_intersection", B.SEG, PAIR, "select image_id, a, b, inter from pair union all select distinct image_id, segment_id, segment_id, 1::bigint from seg")
def j1(spark, d):
    return sets.intersections(B.seg_sets(spark, d))


@query("j2_iou", B.SEG, NSEG, PAIR, IOU, "select image_id, a, b, inter, round(iou, 6) as iou from iou")
def j2(spark, d):
    return sets.iou(B.seg_sets(spark, d), digits=6)


def gt_and_masks(spark, d):
    ras = B.raster(spark, d).cache()
    lab = B.label_map(ras)
    gt = lab.where("label not in (0, 255)").select("image_id", F.col("label").cast("long").alias("object_id"), "r", "c")
    return gt, B.threshold_masks(ras), lab.where("label = 255").select("image_id", "r", "c")


GT = "gt as (select image_id, label::bigint as object_id, r, c from lab where label not in (0, 255))"


def cross(gt: str, mask: str) -> str:
    return f"""cr as (select g.image_id, object_id, segment_id, ng, nm, coalesce(inter, 0)::bigint as inter
  from (select image_id, object_id, count(*) as ng from {gt} group by all) g join (select image_id, segment_id, count(*) as nm from {mask} group by all) m using (image_id)
  left join (select x.image_id, object_id, segment_id, count(*) as inter from {gt} x join {mask} y using (image_id, r, c) group by all) i using (image_id, object_id, segment_id))"""


VOIDED = """care as (select * from mask where (image_id, r, c) not in (select (image_id, r, c) from lab where label = 255)),
gtc as (select * from gt where (image_id, r, c) not in (select (image_id, r, c) from lab where label = 255))"""


@query("j3_iou_care", B.RASTER, B.LABELMAP, B.MASKS, GT, VOIDED, cross("gtc", "care"), "select image_id, object_id, segment_id, round(inter / (ng + nm - inter), 6) as q from cr")
def j3(spark, d):
    gt, m, void = gt_and_masks(spark, d)
    return sets.quality_care(gt, m, void, ["r", "c"]).select("image_id", "object_id", "segment_id", r6("q").alias("q"))


@query(
    "j4_pixel_f", B.RASTER, B.LABELMAP, B.MASKS, GT, cross("gt", "mask"),
    """select image_id, object_id, segment_id, round(inter / nm, 6) as precision, round(inter / ng, 6) as recall,
       case when inter = 0 then 0.0 else round((inter / ng) * (inter / nm) / (0.5 * (inter / ng + inter / nm)), 6) end as f from cr""",
)
def j4(spark, d):
    gt, m, _ = gt_and_masks(spark, d)
    return sets.precision_recall(gt, m, ["r", "c"]).select("image_id", "object_id", "segment_id", *(r6(c).alias(c) for c in ("precision", "recall", "f")))


@query(
    "j5_area_weighted", B.RASTER, B.LABELMAP, B.MASKS, GT, VOIDED, cross("gtc", "care"),
    f"select image_id, object_id, segment_id, round(inter / (ng + nm - inter) * (ng / ({B.ROWS}.0 * {B.LAST})), 6) as q from cr",
)
def j5(spark, d):
    gt, m, void = gt_and_masks(spark, d)
    cols = B.raster_of(spark, d)[1]
    q = sets.quality_care(gt, m, void, ["r", "c"])
    return q.select("image_id", "object_id", "segment_id", r6(F.col("q") * (F.col("ng") / (B.ROWS * cols))).alias("q"))


BOXIOU = """bi as (select a.image_id, a.box_id as a, b.box_id as b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i,
  (a.x2 - a.x1) * (a.y2 - a.y1) as sa, (b.x2 - b.x1) * (b.y2 - b.y1) as sb from box a join box b on a.image_id = b.image_id
  and least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1))"""


@query("j6_box_iou", B.BOXES, BOXIOU, "select image_id, a, b, round(i / (sa + sb - i), 6) as iou from bi")
def j6(spark, d):
    b = B.boxes(spark, d)
    return sets.box_iou(b, b, digits=6)


@query(
    "a29_best_overlap", B.RASTER, B.LABELMAP, B.MASKS, GT, VOIDED, cross("gtc", "care"),
    """q as (select *, inter / (ng + nm - inter) as q, row_number() over (partition by image_id, object_id order by inter / (ng + nm - inter) desc, segment_id) as k from cr)""",
    "select image_id, object_id, segment_id as best, round(q, 6) as q, round(avg(q) over (), 6) as mean_best from q where k = 1",
)
def a29(spark, d):
    gt, m, void = gt_and_masks(spark, d)
    cols = B.raster_of(spark, d)[1]
    q = sets.quality_care(gt, m, void, ["r", "c"])
    best = q.groupBy("image_id", "object_id").agg(F.min_by("segment_id", F.struct(-F.col("q"), "segment_id")).alias("best"), F.max("q").alias("q"))
    mean = best.agg(r6(F.avg("q")).alias("mean_best"))
    return best.join(F.broadcast(mean)).select("image_id", "object_id", "best", r6("q").alias("q"), "mean_best")


def cut_boxes(b: DataFrame, h: float, w: float) -> DataFrame:
    b = b.withColumn("x1", F.greatest(F.lit(1.0), "x1")).withColumn("y1", F.greatest(F.lit(1.0), "y1"))
    b = b.withColumn("x2", F.least(F.lit(w), "x2")).withColumn("y2", F.least(F.lit(h), "y2"))
    return b.where("x2 - x1 + 1 > 0 and y2 - y1 + 1 > 0")


CLIP = """clip as (select image_id, box_id, greatest(1.0, x1) as x1, greatest(1.0, y1) as y1, least(40.0, x2) as x2, least(45.0, y2) as y2, score from box
  where least(40.0, x2) - greatest(1.0, x1) + 1 > 0 and least(45.0, y2) - greatest(1.0, y1) + 1 > 0)"""


@query("p20_clip_boxes", B.BOXES, CLIP, "select * from clip")
def p20(spark, d):
    return cut_boxes(B.boxes(spark, d), 45.0, 40.0)


def enlarge(b: DataFrame, f: float) -> DataFrame:
    """Scale boxes about their centres."""
    dx, dy = (F.col("x2") - F.col("x1")) * (f - 1) / 2, (F.col("y2") - F.col("y1")) * (f - 1) / 2
    return b.select("image_id", "box_id", (F.col("x1") - dx).alias("x1"), (F.col("y1") - dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"), "score")


@query(
    "p21_enlarge_boxes", B.BOXES,
    "select image_id, box_id, round(x1 - (x2 - x1) * 0.25, 6) as x1, round(y1 - (y2 - y1) * 0.25, 6) as y1, round(x2 + (x2 - x1) * 0.25, 6) as x2, round(y2 + (y2 - y1) * 0.25, 6) as y2, score from box",
)
def p21(spark, d):
    return enlarge(B.boxes(spark, d), 1.5).select("image_id", "box_id", *(r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")), "score")


@query(
    "p22_postprocess_boxes", B.BOXES,
    "a as (select *, row_number() over (partition by image_id order by score desc, box_id) as k from box where (x2 - x1) * (y2 - y1) <= 60 * 60 / 4.0)",
    "b as (select image_id, box_id, x1 - (x2 - x1) * 0.05 as x1, y1 - (y2 - y1) * 0.05 as y1, x2 + (x2 - x1) * 0.05 as x2, y2 + (y2 - y1) * 0.05 as y2, score from a where k <= 40)",
    "c as (select *, (x2 - x1) * (y2 - y1) < 0.4 * 3600 as small, max(((x2 - x1) * (y2 - y1) < 0.4 * 3600)::int) over (partition by image_id) as any_small from b)",
    "e as (select image_id, box_id, x1 - (x2 - x1) * 0.05 as x1, y1 - (y2 - y1) * 0.05 as y1, x2 + (x2 - x1) * 0.05 as x2, y2 + (y2 - y1) * 0.05 as y2, score from c where small or any_small = 0)",
    """select image_id, box_id, round(greatest(1.0, x1), 6) as x1, round(greatest(1.0, y1), 6) as y1, round(least(60.0, x2), 6) as x2, round(least(60.0, y2), 6) as y2, score from e
       where least(60.0, x2) - greatest(1.0, x1) + 1 > 0 and least(60.0, y2) - greatest(1.0, y1) + 1 > 0""",
)
def p22(spark, d):
    side = 60.0
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    b = rank.top_k(B.boxes(spark, d).where(area <= side * side / 4), 40, by_id="box_id").drop("rank")
    b = enlarge(b, 1.1).withColumn("small", area < 0.4 * side * side)
    b = b.withColumn("some", F.max("small").over(W.partitionBy("image_id"))).where("small or not some").drop("small", "some")
    return cut_boxes(enlarge(b, 1.1), side, side).select("image_id", "box_id", *(r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")), "score")


@query("p23_tiny_windows", B.BOXES, "select * from box where abs(x1 - x2) >= 8 and abs(y1 - y2) >= 8")
def p23(spark, d):
    return B.boxes(spark, d).where("abs(x1 - x2) >= 8 and abs(y1 - y2) >= 8")


BBOX = "bb as (select image_id, segment_id, min(r) as r1, max(r) as r2, min(c) as c1, max(c) as c2 from mask group by all)"


def bounding(m: DataFrame) -> DataFrame:
    return m.groupBy("image_id", "segment_id").agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.min("c").alias("c1"), F.max("c").alias("c2"))


@query(
    "p24_square_boxes", B.RASTER, B.MASKS, BBOX,
    f"m as (select image_id, segment_id, greatest(0, r1 - 2) as r1, least(23, r2 + 2) as r2, greatest(1, c1 - 2) as c1, least({B.LAST}, c2 + 2) as c2 from bb)",
    "p as (select *, ceil(greatest(0, (c2 - c1) - (r2 - r1)) / 2)::int as pr, ceil(greatest(0, (r2 - r1) - (c2 - c1)) / 2)::int as pc from m)",
    "select image_id, segment_id, r1 - pr as r1, r2 + pr as r2, c1 - pc as c1, c2 + pc as c2 from p",
)
def p24(spark, d):
    ras, cols = B.raster_of(spark, d)
    m = bounding(B.threshold_masks(ras))
    m = m.select("image_id", "segment_id", F.greatest(F.lit(0), F.col("r1") - 2).alias("r1"), F.least(F.lit(23), F.col("r2") + 2).alias("r2"), F.greatest(F.lit(1), F.col("c1") - 2).alias("c1"), F.least(F.lit(cols), F.col("c2") + 2).alias("c2"))
    pr, pc = (F.ceil(F.greatest(F.lit(0), F.expr(e)) / 2).cast("int") for e in ("(c2 - c1) - (r2 - r1)", "(r2 - r1) - (c2 - c1)"))
    return m.select("image_id", "segment_id", (F.col("r1") - pr).alias("r1"), (F.col("r2") + pr).alias("r2"), (F.col("c1") - pc).alias("c1"), (F.col("c2") + pc).alias("c2"))


@query("p25_crop_to_frame", B.RASTER, B.MASKS, BBOX, "select m.image_id, m.segment_id, m.r - r1 + 1 as r, m.c - c1 + 1 as c from mask m join bb using (image_id, segment_id)")
def p25(spark, d):
    m = B.threshold_masks(B.raster(spark, d)).cache()
    return m.join(bounding(m), ["image_id", "segment_id"]).select("image_id", "segment_id", (F.col("r") - F.col("r1") + 1).alias("r"), (F.col("c") - F.col("c1") + 1).alias("c"))


@query("p17_ground_masks", B.RASTER, B.MASKS, "select g.image_id, k as segment_id, g.r, g.c from ras g, (select unnest(range(1, 5)) as k) where not (val > 20 * k)")
def p17(spark, d):
    ras = B.raster(spark, d).cache()
    m = B.threshold_masks(ras)
    grid = ras.select("image_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("segment_id"), "r", "c")
    return grid.join(m, ["image_id", "segment_id", "r", "c"], "left_anti")


@query("p15_points_inside", B.BOXES, B.RASTER, B.MASKS, """select m.image_id, segment_id, box_id from mask m join (select box_id, round((y1 + y2) / 2)::int % 24 as r, round((x1 + x2) / 2)::int % 30 + 1 as c from box) using (r, c)""")
def p15(spark, d):
    pts = B.boxes(spark, d).select("box_id", (F.round((F.col("y1") + F.col("y2")) / 2).cast("int") % 24).alias("r"), (F.round((F.col("x1") + F.col("x2")) / 2).cast("int") % 30 + 1).alias("c"))
    return B.threshold_masks(B.raster(spark, d)).join(pts, ["r", "c"]).select("image_id", "segment_id", "box_id")


@query(
    "p16_pairs_inside", B.BOXES, B.RASTER, B.MASKS,
    """select x.image_id, x.segment_id, box_id from (select box_id, y1::int % 24 as ra, x1::int % 30 + 1 as ca, y2::int % 24 as rb, x2::int % 30 + 1 as cb from box)
       join mask x on x.r = ra and x.c = ca join mask y on y.r = rb and y.c = cb and y.image_id = x.image_id and y.segment_id = x.segment_id""",
)
def p16(spark, d):
    m = B.threshold_masks(B.raster(spark, d)).cache()
    e = B.boxes(spark, d).selectExpr("box_id", "cast(y1 as int) % 24 as r", "cast(x1 as int) % 30 + 1 as c", "cast(y2 as int) % 24 as rb", "cast(x2 as int) % 30 + 1 as cb")
    first = m.join(e, ["r", "c"]).select("image_id", "segment_id", "box_id", F.col("rb").alias("r"), F.col("cb").alias("c"))
    return first.join(m, ["image_id", "segment_id", "r", "c"]).select("image_id", "segment_id", "box_id")


@query("k1_rank", B.BOXES, "select image_id, box_id as segment_id, score, row_number() over (partition by image_id order by score desc, box_id) as rank from box")
def k1(spark, d):
    return rank.ranked(B.boxes(spark, d).select("image_id", F.col("box_id").alias("segment_id"), "score"))


@query("k2_top_k", B.BOXES, "select image_id, box_id as segment_id, score, row_number() over (partition by image_id order by score desc, box_id) as rank from box qualify rank <= 40")
def k2(spark, d):
    return rank.top_k(B.boxes(spark, d).select("image_id", F.col("box_id").alias("segment_id"), "score"), 40)


@query("k3_mmr")
def k3(spark, d):
    m = stored(B.seg_sets(spark, d))  # used several times, and its texts are long
    s = m.select("image_id", "segment_id", (F.lit(0.1) + F.size("x").cast("long") * 0.01 + F.col("energy") * -0.0001).alias("score"))
    return rank.diversified_sets(s, m, 0.75).withColumn("value", r6("value"))


@query("k4_diversified_keep_n")
def k4(spark, d):
    m = stored(B.seg_sets(spark, d))  # used several times, and its texts are long
    s = B.segments(spark, d).join(m.select("image_id", "segment_id"), ["image_id", "segment_id"]).withColumn("score", -F.col("energy") / 10000)
    return rank.diversified_top(s, m, 3, 0.75).withColumn("value", r6("value"))


@query("k5_largest", B.SEG, NSEG, "select image_id, segment_id, n from (select *, row_number() over (partition by image_id order by n desc, segment_id) as k from n) where k <= 3")
def k5(spark, d):
    return rank.top_k(sets.sizes(B.seg_pixels(spark, d)), 3, "n").drop("rank")


def regions(spark, d):
    m = B.threshold_masks(B.raster(spark, d)).groupBy("image_id", "segment_id").agg(F.count("*").alias("n"), F.avg("r").alias("cr"), F.avg("c").alias("cc"))
    b = B.boxes(spark, d).select("image_id", F.col("box_id").alias("segment_id"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("long").alias("n"), ((F.col("y1") + F.col("y2")) / 2).alias("cr"), ((F.col("x1") + F.col("x2")) / 2).alias("cc"))
    return m.union(b)


@query("k6_farthest")
def k6(spark, d):
    return rank.farthest(regions(spark, d), 6)


@query("k7_around_grid")
def k7(spark, d):
    return rank.around_grid(regions(spark, d), [(10.0 * i, 10.0 * j) for i in range(5) for j in range(5)])


@query("k9_random_cap", B.BOXES, "select image_id, box_id, score from box qualify row_number() over (partition by image_id order by md5('1:' || box_id), box_id) <= 10")
def k9(spark, d):
    return rank.sample_k(B.boxes(spark, d), 10, ["image_id"], "box_id").select("image_id", "box_id", "score")


@query("k10_k_of_n", "select p_partkey from part order by md5('7:' || p_partkey), p_partkey limit 25")
def k10(spark, d):
    p = B.table(spark, d, "part").select("p_partkey")
    return p.orderBy(F.md5(F.concat_ws(":", F.lit("7"), F.col("p_partkey").cast("string"))), "p_partkey").limit(25)


DEDUPE = f"""recursive_pairs as (select image_id, a, b from iou where 1 - iou < 0.05)"""


def _deduped(keep: str) -> tuple[str, ...]:
    return (
        B.SEG, NSEG, PAIR, IOU, B.SEGMENTS,
        "e as (select a as u, b as v from iou where 1 - iou < 0.05 union all select b, a from iou where 1 - iou < 0.05)",
        "reach as (select segment_id as u, segment_id as v from segs union select r.u, e.v from reach r join e on r.v = e.u)",
        "comp as (select u as segment_id, min(v) as cluster from reach group by u)",
        keep,
    )


@query(
    "i9_near_duplicates",
    *("recursive " + x if i == 0 else x for i, x in enumerate(_deduped(
        """select image_id, segment_id, energy, cluster from (select *, row_number() over (partition by image_id, cluster order by energy, segment_id) as k
           from segs join comp using (segment_id)) where k = 1"""))),
)
def i9(spark, d):
    return sets.dissimilar(B.seg_sets(spark, d), B.segments(spark, d)).select("image_id", "segment_id", "energy", "cluster")


@query("i11_repeats", B.SEG, NSEG, PAIR, IOU, B.SEGMENTS, "select image_id, segment_id, energy from segs where (image_id, segment_id) not in (select (image_id, a) from iou where iou > 0.98)")
def i11(spark, d):
    return sets.without_repeats(B.seg_sets(spark, d), B.segments(spark, d))


@query(
    "i37_pool_merge", B.RASTER, B.MASKS,
    "pool as (select image_id, segment_id, r, c from mask union all select image_id, 100 + k, r, c from ras, (select unnest(range(1, 5)) as k) where val > 20 * k - 1)",
    "n as (select image_id, segment_id, count(*) as n from pool group by all)",
    "pair as (select x.image_id, x.segment_id as a, y.segment_id as b, count(*) as inter from pool x join pool y using (image_id, r, c) where x.segment_id < y.segment_id group by all)",
    "gone as (select p.image_id, a from pair p join n x on x.image_id = p.image_id and x.segment_id = a join n y on y.image_id = p.image_id and y.segment_id = b where inter / (x.n + y.n - inter) > 0.98)",
    "select image_id, segment_id, n, dense_rank() over (partition by image_id order by segment_id) as new_id from n where (image_id, segment_id) not in (select (image_id, a) from gone)",
)
def i37(spark, d):
    ras = B.raster(spark, d).cache()
    more = ras.select("image_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "r", "c", "val").where("val > 20 * k - 1")
    pool = B.threshold_masks(ras).union(more.select("image_id", (F.col("k") + 100).cast("long"), "r", "c"))
    pool = pool.select("image_id", "segment_id", F.struct("r", "c").alias("pixel_id"))
    left = sets.without_repeats(pool, sets.sizes(pool))
    return left.withColumn("new_id", F.dense_rank().over(W.partitionBy("image_id").orderBy("segment_id")).cast("long"))


@query("i38_ranking")
def i38(spark, d):
    """Features, scaling, linear score, overlaps, diversified ranking, order."""
    from fieldloom.plans import flagship

    return flagship.ranked_documents(spark, d)


@query("w15_representative", B.SEGMENTS, "select image_id, segment_id, energy from segs qualify row_number() over (partition by image_id order by energy, segment_id) = 1")
def w15(spark, d):
    return sets.lowest_energy(B.segments(spark, d), ["image_id"]).select("image_id", "segment_id", "energy")


@query("a32_region_sizes", B.RASTER, B.LABELMAP, "select image_id, label, count(*) as n from lab group by all")
def a32(spark, d):
    return B.label_map(B.raster(spark, d)).groupBy("image_id", "label").agg(F.count("*").alias("n"))


@query("j18_cartesian", "select r_regionkey, n_nationkey from region, nation")
def j18(spark, d):
    """All pairs of two small dimension tables."""
    return B.table(spark, d, "region").select("r_regionkey").crossJoin(B.table(spark, d, "nation").select("n_nationkey"))


ADJ = """big as (select a, b, image_id from pair where inter >= 20)"""


@query("j22_adjacent", B.SEG, PAIR, "select image_id, a, b, inter from pair where inter between 5 and 20")
def j22(spark, d):
    """Adjacent segments: a shared border of enough and an overlap of few enough elements."""
    return sets.iou(B.seg_sets(spark, d), 5, 20).select("image_id", "a", "b", "inter")


HOP1 = "hop as (select image_id, a, b from pair where inter between 5 and 20 union all select image_id, b, a from pair where inter between 5 and 20)"


@query(
    "j23_two_hops", B.SEG, PAIR, HOP1,
    """select distinct x.image_id, least(x.a, y.b) as a, greatest(x.a, y.b) as b from hop x join hop y on x.image_id = y.image_id and x.b = y.a and x.a <> y.b
       where (x.image_id, least(x.a, y.b), greatest(x.a, y.b)) not in (select (image_id, a, b) from pair)""",
)
def j23(spark, d):
    return sets.two_hops(B.seg_sets(spark, d), 5, 20)


@query("j24_pairwise_features", B.SEG, NSEG, PAIR, B.SEGMENTS, """select p.image_id, a, b, x.n - y.n as dn, s.energy - t.energy as denergy from pair p join n x on x.segment_id = a and x.image_id = p.image_id join n y on y.segment_id = b and y.image_id = p.image_id
  join segs s on s.segment_id = a join segs t on t.segment_id = b where inter between 5 and 20""")
def j24(spark, d):
    j = sets.iou(B.seg_sets(spark, d), 5, 20, features=("energy",))
    return j.select("image_id", "a", "b", (F.col("n_a") - F.col("n_b")).alias("dn"), (F.col("energy_a") - F.col("energy_b")).alias("denergy"))


# set operations over masks
@query("o1_difference", B.RASTER, B.MASKS, "select image_id, r, c from mask where segment_id = 1 except select image_id, r, c from mask where segment_id = 3")
def o1(spark, d):
    m = B.threshold_masks(B.raster(spark, d)).cache()
    return m.where("segment_id = 1").join(m.where("segment_id = 3"), ["image_id", "r", "c"], "left_anti").select("image_id", "r", "c")


@query("o2_intersection", B.RASTER, B.MASKS, "select image_id, r, c from mask where segment_id = 1 intersect select image_id, r, c from mask where segment_id = 3")
def o2(spark, d):
    m = B.threshold_masks(B.raster(spark, d)).cache()
    return m.where("segment_id = 1").join(m.where("segment_id = 3"), ["image_id", "r", "c"], "left_semi").select("image_id", "r", "c")


@query("o3_union", B.RASTER, B.MASKS, "select image_id, segment_id, r, c from mask union all select image_id, segment_id + 10, r, c from mask where segment_id > 2")
def o3(spark, d):
    m = B.threshold_masks(B.raster(spark, d)).cache()
    return m.unionByName(m.where("segment_id > 2").withColumn("segment_id", F.col("segment_id") + 10))


@query("o4_unique_pairs", "select distinct least(l_partkey % 97, l_suppkey) as a, greatest(l_partkey % 97, l_suppkey) as b from lineitem")
def o4(spark, d):
    x, y = F.col("l_partkey") % 97, F.col("l_suppkey")
    return B.table(spark, d, "lineitem").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


FRAMES = {"all": "r < 2 or r >= 22 or c <= 2 or c > 28", "horiz": "r < 2 or r >= 22", "vert": "c <= 2 or c > 28", "up": "r < 2", "down": "r >= 22", "all_but_down": "r < 2 or c <= 2 or c > 28"}


@query("o5_frame", B.RASTER, " union all ".join(f"select image_id, '{k}' as kind, r, c from ras where {v}" for k, v in FRAMES.items()))
def o5(spark, d):
    """Border pixels of width 2, by kind of frame."""
    ras = B.raster(spark, d).select("image_id", "r", "c")
    kinds = F.array_compact(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in FRAMES.items())))
    return ras.select("image_id", F.explode(kinds).alias("kind"), "r", "c")


@query("o6_complement", B.RASTER, B.MASKS, "select image_id, r, c from ras except select image_id, r, c from mask where segment_id = 2")
def o6(spark, d):
    ras = B.raster(spark, d).cache()
    return ras.select("image_id", "r", "c").join(B.threshold_masks(ras).where("segment_id = 2"), ["image_id", "r", "c"], "left_anti")


@query("o10_frame_lines", B.BOXES, "select image_id, box_id from box where not ((x1 <= 2 and x2 <= 12) or (y1 <= 2 and y2 <= 12) or x1 >= 45 or y1 >= 45)")
def o10(spark, d):
    return B.boxes(spark, d).where("not ((x1 <= 2 and x2 <= 12) or (y1 <= 2 and y2 <= 12) or x1 >= 45 or y1 >= 45)").select("image_id", "box_id")


# S1, S2, S5..S7
@query("s1_shortest_path", "select split_part(url, '/', 3) as prefix, arg_min(url, (length(url), url)) as path, right(arg_min(url, (length(url), url)), 4) as extension from pages group by 1")
def s1(spark, d):
    """Per prefix the shortest name (first by name on ties), and its last four characters."""
    p = B.table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("prefix"), "url")
    best = p.groupBy("prefix").agg(F.min_by("url", F.struct(F.length("url"), "url")).alias("path"))
    return best.withColumn("extension", F.right("path", F.lit(4)))


@query("s2_materialize_once", B.SEG, NSEG, "select image_id, segment_id, n from n")
def s2(spark, d):
    """Two runs over one stage table: the second computes only what the first left out."""
    import uuid

    from fieldloom.sources.stage import materialize_once

    out = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    seg = B.seg_pixels(spark, d)
    materialize_once(seg.where("segment_id % 2 = 0"), sets.sizes, "segment_id", out)
    return materialize_once(seg, sets.sizes, "segment_id", out)


@query("s5_coordinates", B.RASTER, "select image_id, r as i, c as j, val from ras where val <> 0")
def s5(spark, d):
    """Dense rows to (i, j, value) without zeros."""
    dense = B.raster(spark, d).groupBy("image_id", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "val"))), lambda s: s["val"]).alias("row"))
    return dense.select("image_id", F.col("r").alias("i"), F.posexplode("row").alias("j", "val")).where("val <> 0").select("image_id", "i", (F.col("j") + 1).alias("j"), "val")


@query("s6_feature_assembly", "select p_partkey, list_concat([p_size::double, p_retailprice], [length(p_name)::double]) as feats from part")
def s6(spark, d):
    p = B.table(spark, d, "part")
    groups = {"size": F.array(F.col("p_size").cast("double"), "p_retailprice"), "name": F.array(F.length("p_name").cast("double"))}
    return p.select("p_partkey", F.concat(*groups.values()).alias("feats"))


@query("s7_model_lookup", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def s7(spark, d):
    """A small parameter table joined to the data; Spark broadcasts it by its size."""
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return B.table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", "n_name")
