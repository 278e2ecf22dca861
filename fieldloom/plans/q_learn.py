"""Queries over clustering, learning and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.operators import cluster as C
from fieldloom.operators import graph as G
from fieldloom.operators import raster as R
from fieldloom.operators import sets
from fieldloom.operators.shared import shared_folder, stored
from fieldloom.plans.registry import query
from fieldloom.sources import bindings as B

r6 = lambda c: F.round(c, 6)


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def step_sql(i: int, median: bool = False) -> str:
    """One round of k-means: assignment q{i} to code{i}, then centres code{i+1}."""
    metric = "sum(abs(v.x - k.m))" if median else "sum((v.x - k.m) * (v.x - k.m))"
    new = (
        "select word, i, round(x, 6) as m from (select word, i, x, row_number() over (partition by word, i order by x) as k, count(*) over (partition by word, i) as n from q{0} join vlong using (vec_id)) where k = (n + 1) // 2"
        if median else "select word, i, round(avg(x), 6) as m from q{0} join vlong using (vec_id) group by word, i"
    ).format(i)
    return f"""d{i} as (select vec_id, word, round({metric}, 9) as d from vlong v join code{i} k using (i) group by all),
q{i} as (select vec_id, word, d from d{i} qualify row_number() over (partition by vec_id order by d, word) = 1),
n{i} as ({new}),
code{i + 1} as (select c.word, c.i, coalesce(n.m, c.m) as m from code{i} c left join n{i} n using (word, i))"""


CODE0 = "code0 as (select word, i, m from code)"


@query("i12_kmeans", B.VLONG, B.CODE, CODE0, step_sql(0), step_sql(1), "select word, i, m from code2")
def i12(spark, d):
    """Two rounds of L2 k-means from the label means; one row per word and element."""
    c = C.kmeans(B.vectors(spark, d), B.codebook(spark, d), 2)
    return c.select("word", F.posexplode("c").alias("i", "m")).select("word", (F.col("i") + 1).alias("i"), "m")


@query("i12_seeded_kmeans")
def i12_seeded(spark, d):
    """The best of three runs of k-means with ten centres that are drawn by distance, and its energy."""
    c, total = C.fitted(B.vectors(spark, d), 10)
    c = c.select("word", F.posexplode("c").alias("i", "m")).select("word", (F.col("i") + 1).alias("i"), "m")
    return c.withColumn("energy", F.lit(round(total, 6)))


@query("i13_kmeans_l1", B.VLONG, B.CODE, CODE0, step_sql(0, True), "select word, i, m from code1")
def i13(spark, d):
    c = C.kmeans(B.vectors(spark, d), B.codebook(spark, d), 1, "l1")
    return c.select("word", F.posexplode("c").alias("i", "m")).select("word", (F.col("i") + 1).alias("i"), "m")


@query("i14_integer_kmeans")
def i14(spark, d):
    """Integer vectors; a coarse run on a third of the rows (by id) gives the start of the full one."""
    v = B.vectors(spark, d).select("vec_id", F.transform("v", lambda x: F.round(x * 127 + 128)).alias("v"))
    start = v.orderBy("vec_id").limit(8).select(F.col("vec_id").alias("word"), F.col("v").alias("c"))
    coarse = C.kmeans(v.where("vec_id % 3 = 0"), start, 2)
    return C.assign(v, C.kmeans(v, coarse, 2)).select("vec_id", "word", r6("dist").alias("dist"))


@query("i15_hierarchical_kmeans")
def i15(spark, d):
    paths, _ = C.hierarchical(B.vectors(spark, d), 3, 3)
    return paths


@query("i10_at_most_k")
def i10(spark, d):
    return C.at_most_k(B.segments(spark, d), sets.linkage_edges(B.seg_sets(spark, d)), 5)


def events_joint(spark, d):
    """The joint distribution of type and hour: a table of 24 columns."""
    e = B.table(spark, d, "events").groupBy(F.hour("ts").alias("x"), "event_type").agg(F.count("*").alias("n"))
    rows = e.collect()
    names, total = sorted({r.event_type for r in rows}), sum(r.n for r in rows)
    joint = {r.x: [0.0] * len(names) for r in rows}
    for r in rows:
        joint[r.x][names.index(r.event_type)] = r.n / total
    return joint


@query("i17_bottleneck")
def i17(spark, d):
    """Merges of the hours by least loss of information on the event type."""
    out = C.bottleneck(events_joint(spark, d))
    return spark.createDataFrame(out, "step long, kept long, merged long, loss double").withColumn("loss", F.round("loss", 9))


@query("i18_tree_cut")
def i18(spark, d):
    """The clusters after all but four merges of i17: each event's hour to its cluster, counted."""
    merges = C.bottleneck(events_joint(spark, d), 5)
    p = spark.createDataFrame([(h, h) for h in range(24)], "node long, parent long")
    m = spark.createDataFrame([(b, a) for _, a, b, _ in merges], "node long, up long")
    roots = G.roots(p.join(m, "node", "left").select("node", F.coalesce("up", "parent").alias("parent")))
    ids = roots.withColumn("cluster", F.dense_rank().over(W.orderBy("root")).cast("long"))  # one row an hour
    e = B.table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("node")).agg(F.count("*").alias("n"))
    return e.join(F.broadcast(ids), "node").groupBy("cluster").agg(F.sum("n").alias("n"))


DENS = "den as (select a.image_id, a.r, a.c, a.val, round(sum(exp(-((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) + (a.val - b.val) * (a.val - b.val) / 400) / 8)), 6) as e from ras a join ras b on a.image_id = b.image_id and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 16 group by all)"
SHIFT = """qs as (select a.image_id, a.r, a.c, arg_min((b.c - 1) * 24 + b.r + 1, (round((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) + (a.val - b.val) * (a.val - b.val) / 400, 6), (b.c - 1) * 24 + b.r + 1)) filter (b.e > a.e) as parent
  from den a join den b on a.image_id = b.image_id and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9 group by all)"""


def quickshift(spark, d):
    """parent: the nearest pixel of higher density within radius 3 (smallest id on ties), null at roots."""
    ras = B.raster(spark, d).select("image_id", "r", "c", "val")
    far = F.expr("(r - r2) * (r - r2) + (c - c2) * (c - c2) + (val - val2) * (val - val2) / 400")
    den = R.within_radius(ras, ras, 16.0).groupBy("image_id", "r", "c", "val").agg(r6(F.sum(F.exp(-far / 8))).alias("e")).cache()
    near = R.within_radius(den, den, 9.0).withColumn("key", F.when(F.col("e2") > F.col("e"), F.struct(F.round(far, 6).alias("d"), B.pixel_id("r2", "c2").alias("p"))))
    return near.groupBy("image_id", "r", "c", "val").agg(F.min("key").alias("k")).select("image_id", "r", "c", "val", F.col("k.p").alias("parent"))


@query("i19_quickshift", B.RASTER, DENS, SHIFT, "select image_id, r, c, coalesce(parent, -1)::bigint as parent from qs")
def i19(spark, d):
    return quickshift(spark, d).select("image_id", "r", "c", F.coalesce("parent", F.lit(-1)).alias("parent"))


def quick_labels(spark, d):
    """The quickshift forest with each pixel's root; nodes are (image, pixel)."""
    q = quickshift(spark, d).select("image_id", "r", "c", "val", "parent")
    node = lambda p: F.struct("image_id", p.alias("pixel"))
    own = B.pixel_id("r", "c")
    f = stored(q.select("image_id", "r", "c", "val", node(own).alias("node"), node(F.coalesce("parent", own)).alias("parent")))
    return f.join(G.roots(f), "node")


@query(
    "i20_flatten_forest", "recursive " + B.RASTER, DENS, SHIFT, "t as (select image_id, ((c - 1) * 24 + r + 1)::bigint as node, coalesce(parent, (c - 1) * 24 + r + 1)::bigint as parent from qs)",
    "up as (select image_id, node, parent as at from t union select u.image_id, u.node, t.parent from up u join t on t.image_id = u.image_id and t.node = u.at)",
    "select image_id, node, dense_rank() over (partition by image_id order by root) as cluster from (select u.image_id, u.node, u.at as root from up u join t on t.image_id = u.image_id and t.node = u.at where t.parent = t.node)",
)
def i20(spark, d):
    """Roots of the quickshift forest, and clusters 1..k of each image in their order."""
    f = quick_labels(spark, d).select("image_id", F.col("node.pixel").alias("node"), F.col("root.pixel").alias("root"))
    ids = f.select("image_id", "root").distinct().withColumn("cluster", F.dense_rank().over(W.partitionBy("image_id").orderBy("root")).cast("long"))
    return f.join(ids, ["image_id", "root"]).select("image_id", "node", "cluster")


@query("i21_quick_segmentation")
def i21(spark, d):
    """Quickshift, flattened, each pixel with its region's mean value."""
    f = quick_labels(spark, d)
    mean = f.groupBy("root").agg(F.round(F.avg("val"), 5).alias("mean"), F.count("*").alias("n"))
    return f.join(mean, "root").select("image_id", "r", "c", "mean", "n")


def svm_rows(spark, d):
    """Quality as -1 or 1, and three scaled features of the document."""
    docs = B.table(spark, d, "documents").select("doc_id", (F.length("text") / 1000.0).alias("a"), (F.length(F.regexp_replace("text", "[^!*%$#&|]", "")) / 100.0).alias("b"), F.lit(1.0).alias("c"))
    lab = B.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("y"))
    return docs.join(lab, "doc_id").select("doc_id", F.array("a", "b", "c").alias("x"), "y")


@query("i16_linear_svm")
def i16(spark, d):
    """Weights after ten full-batch steps; the training share that they classify."""
    rows = svm_rows(spark, d).cache()
    w = C.svm(rows, 3, 0.1, 10)
    from fieldloom.functions.vectors import linear_score

    right = rows.agg(F.avg((F.signum(linear_score(F.col("x"), [w[-1], *w[:-1]])) == F.col("y")).cast("double")).alias("accuracy"))
    return right.select(*(F.lit(round(v, 6)).alias(f"w{i}") for i, v in enumerate(w)), r6("accuracy").alias("accuracy"))


@query("x14_iterative_likelihood")
def x14(spark, d):
    """Foreground and background likelihoods: clusters of the frame's values, then of the pixels far from them."""
    ras, cols = B.raster_of(spark, d)
    ras = ras.select("image_id", "r", "c", "val").cache()
    v = ras.select(F.struct("image_id", "r", "c").alias("vec_id"), F.array("val").alias("v"), "image_id", "r", "c")
    frame = v.where(f"r in (0, 23) or c in (1, {cols})")
    def seeds(df, k):
        """k values at equal steps of the sorted distinct values (a raster's values are few)."""
        q = df.select(F.explode("v").alias("x")).agg(F.percentile("x", [(i + 0.5) / k for i in range(k)]).alias("q"))
        return q.select(F.posexplode("q").alias("word", "x")).select("word", F.array("x").alias("c"))

    back = C.kmeans(frame, seeds(frame, 20), 2)
    b = C.assign(v, back, "l1").withColumnRenamed("dist", "bg").select("vec_id", "v", "bg")
    far = b.where("bg > 100").select("vec_id", "v")
    if far.limit(20).count() < 20:
        far = b.orderBy(F.desc("bg"), "vec_id").limit(20).select("vec_id", "v")
    fore = C.kmeans(far, seeds(far, 20), 2)
    f = C.assign(v, fore, "l1").select("vec_id", F.col("dist").alias("fg"))
    like = lambda c: F.round(0.2 * 1000 * F.exp(-0.01 * F.col(c)), 4)
    return b.join(f, "vec_id").select("vec_id.image_id", "vec_id.r", "vec_id.c", like("fg").alias("fg"), like("bg").alias("bg"))


@query("t1_incremental_histogram", "select (hour(ts) + 1)::int as bin, count(*) as h from events group by 1")
def t1(spark, d):
    """The histogram of the events as a stream of day files, after the last micro-batch."""
    from fieldloom.streaming import incremental as I

    src, sink, state = (folder(spark, x) for x in ("events", "hist", "state"))
    days = B.table(spark, d, "events").select((F.hour("ts") + 1).alias("bin"), (F.dayofyear("ts") % 3).alias("part"))
    days.write.partitionBy("part").parquet(src)
    stream = I.stream_of(spark, f"{src}/part=*", "bin int", files=4)

    def put(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    q = I.histogram(stream, "bin").writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(sink)
    return last.join(F.broadcast(last.agg(F.max("epoch").alias("epoch"))), "epoch").select("bin", "h")


@query("t1_value_counts", "select (user_id % 3)::bigint as a, hour(ts)::int as b, count(*) as n from events group by all")
def t1_values(spark, d):
    """The multiset of a31 as keyed state over a stream of files that is stopped and started again in between."""
    from fieldloom.streaming import incremental as I

    src, sink, state = (folder(spark, x) for x in ("events", "counts", "state"))
    ev = B.table(spark, d, "events").select((F.col("user_id") % 3).cast("long").alias("a"), F.hour("ts").alias("b"), (F.dayofyear("ts") % 3).alias("part"))
    schema = "a long, b int"

    def put(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    for part in ("part = 0", "part <> 0"):
        ev.where(part).select("a", "b").write.mode("append").parquet(src)
        counts = I.value_counts(I.stream_of(spark, src, schema, files=4), ["a", "b"])
        q = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return I.total_counts(spark.read.parquet(sink), ["a", "b"]).select("a", "b", "n")


@query("t2_warm_started_svm")
def t2(spark, d):
    """The SVM of i16 continued over micro-batches of the labelled rows."""
    from fieldloom.streaming import incremental as I

    src, state, ck = (folder(spark, x) for x in ("rows", "model", "state"))
    svm_rows(spark, d).select("x", "y").repartition(3, "y").write.parquet(src)
    I.warm_started_svm(I.stream_of(spark, src, "x array<double>, y double"), 3, state, ck)
    return spark.read.parquet(state).select("epoch", "t", F.transform("w", lambda v: F.round(v, 6)).alias("w"))
