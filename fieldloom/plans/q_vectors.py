"""Queries over vectors: scaling, feature maps, distances, quantization, neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import scalars as S
from fieldloom.functions import vectors as V
from fieldloom.operators import cluster as C
from fieldloom.operators import search
from fieldloom.operators.order import global_rank
from fieldloom.plans.registry import query
from fieldloom.sources import bindings as B

r6 = lambda c: F.round(c, 6)
rv = lambda c: F.transform(c, lambda x: F.round(x, 6))


def longer(df: DataFrame, col: str = "v") -> DataFrame:
    """Long form: vec_id, i (from 1), x."""
    return df.select("vec_id", F.posexplode(col).alias("i", "x")).select("vec_id", (F.col("i") + 1).alias("i"), "x")


MODEL = """model as (select i, avg(x) as m, stddev_samp(x) as s, min(x) as lo, max(x) as hi from vlong group by i)"""


def fit(df: DataFrame, kind: str) -> DataFrame:
    """One row: what to subtract from, and to multiply with, each dimension."""
    e = longer(df).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    a, b = (F.col("m"), 1 / F.col("s")) if kind == "zscore" else (F.col("lo"), 1 / (F.col("hi") - F.col("lo")))
    both = e.agg(F.sort_array(F.collect_list(F.struct("i", a.alias("a"), b.alias("b")))).alias("p"))
    return both.select(F.transform("p", lambda s: s["a"]).alias("subtract"), F.transform("p", lambda s: s["b"]).alias("factor"))


def as_rows(df: DataFrame, col: str) -> DataFrame:
    """Elements of a vector column, rounded, in long form; exact zeros keep one sign."""
    return longer(df, col).select("vec_id", "i", (r6("x") + F.lit(0.0)).alias("x"))


@query(
    "p1_sanitize", B.VLONG,
    "bad as (select vec_id, i, case when i % 17 = 0 and vec_id % 5 = 0 then 'inf'::double when i % 19 = 0 and vec_id % 7 = 0 then '-inf'::double when i % 23 = 0 then null else x end as x from vlong)",
    "flag as (select bool_or(x = '-inf'::double) as neg from bad)",
    "select vec_id, i, case when x is null then 0.0 when isinf(x) and neg then -1e6 when x = 'inf'::double then 1e6 else round(x, 6) end as x from bad, flag",
)
def p1(spark, d):
    """If any -Inf is present every Inf becomes -1e6, else +Inf 1e6; NaN and null 0."""
    bad = longer(B.vectors(spark, d)).withColumn(
        "x", F.expr("case when i % 17 = 0 and vec_id % 5 = 0 then double('inf') when i % 19 = 0 and vec_id % 7 = 0 then double('-inf') when i % 23 = 0 then double('nan') else x end")
    )
    return sanitized(bad).select("vec_id", "i", r6("x").alias("x"))


def sanitized(rows: DataFrame) -> DataFrame:
    inf = F.lit(float("inf"))
    flag = rows.agg(F.coalesce(F.bool_or(F.col("x") == -inf), F.lit(False)).alias("neg"))  # one row
    x = F.when(F.col("x").isNull() | F.isnan("x"), 0.0).when((F.abs("x") == inf) & F.col("neg"), -1e6).when(F.col("x") == inf, 1e6).otherwise(F.col("x"))
    return rows.join(F.broadcast(flag)).withColumn("x", x).drop("neg")


def _scaled(spark, d, kind):
    v = B.vectors(spark, d)
    return as_rows(v.join(F.broadcast(fit(v, kind))).select("vec_id", V.scaled(F.col("v"), F.col("subtract"), F.col("factor")).alias("f")), "f")


@query("p2_apply_scaling", B.VLONG, "select vec_id, i, round((x - i / 100.0::double) * 2.5, 6) as x from vlong")
def p2(spark, d):
    v = B.vectors(spark, d)
    sub = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i / F.lit(100.0))
    return as_rows(v.select("vec_id", V.scaled(F.col("v"), sub, F.transform(sub, lambda _: F.lit(2.5))).alias("f")), "f")


@query("p3_zscore", B.VLONG, MODEL, "select vec_id, i, round((x - m) / s, 6) + 0.0 as x from vlong join model using (i)")
def p3(spark, d):
    return _scaled(spark, d, "zscore")


@query("p4_zero_one", B.VLONG, MODEL, "select vec_id, i, round((x - lo) / (hi - lo), 6) + 0.0 as x from vlong join model using (i)")
def p4(spark, d):
    return _scaled(spark, d, "zero_one")


@query("p5_l1_normalize", B.VLONG, "select vec_id, i, round(abs(x) / sum(abs(x)) over (partition by vec_id), 6) as x from vlong")
def p5(spark, d):
    v = B.vectors(spark, d).select("vec_id", F.transform("v", F.abs).alias("v"))
    return as_rows(v.select("vec_id", V.normalized_l1(F.col("v")).alias("f")), "f")


@query("p6_linear_score", B.VLONG, "select vec_id, round(0.5 + sum(x * (i - 32) / 64.0::double), 6) as score from vlong group by vec_id")
def p6(spark, d):
    return B.vectors(spark, d).select("vec_id", r6(V.linear_score(F.col("v"), [0.5, *((i - 32) / 64 for i in range(1, 65))])).alias("score"))


def omegas(n: int = 4, dims: int = 64):
    """Frequencies and phases by a rule: the same in every engine."""
    return [[math.sin(1.3 * (j + 1) * (i + 1)) for i in range(dims)] for j in range(n)], [(j + 1) / (n + 1) for j in range(n)]


@query(
    "p7_random_fourier", B.VLONG,
    "select vec_id, j + 1 as i, round(sqrt(2) * cos(sum(x * sin(1.3 * (j + 1) * i)) + 2 * pi() * ((j + 1) / 5.0::double)), 6) + 0.0 as x from vlong, (select unnest(range(0, 4)) as j) group by vec_id, j",
)
def p7(spark, d):
    return as_rows(B.vectors(spark, d).select("vec_id", V.random_fourier(F.col("v"), *omegas()).alias("f")), "f")


MAP = {"chi2": lambda l: 2 / (math.exp(math.pi * l) + math.exp(-math.pi * l))}


def map_sql(src: str, n: int, step: float) -> str:
    """The chi2 map of the elements x >= 0 of src, j from 0 to 2 n."""
    parts = [f"select vec_id, i, 0 as j, sqrt({step} * x) as y from {src}"]
    for j in range(1, n + 1):
        k = math.sqrt(2 * MAP["chi2"](j * step))
        for odd, f in enumerate(("cos", "sin")):
            parts.append(f"select vec_id, i, {2 * j - 1 + odd}, case when x > 0 then {k!r}::double * sqrt({step} * x) * {f}({j * step!r}::double * ln(case when x > 0 then x else 1 end)) else 0.0 end from {src}")
    return " union all ".join(parts)


@query(
    "p8_kernel_mix", B.VLONG, "a as (select vec_id, i, abs(x) as x from vlong where i <= 16)", f"m as ({map_sql('a', 1, 0.4)})",
    "select vec_id, i, round(abs(x), 6) as x from vlong where i > 16 union all select vec_id, 100 + (i - 1) * 3 + j, round(y, 6) + 0.0 from m",
)
def p8(spark, d):
    """Blocks of 16 and 48 elements: the first mapped, the second as it is; positions tell them apart."""
    v = B.vectors(spark, d).select("vec_id", F.transform("v", F.abs).alias("v"))
    f = V.blockwise(F.col("v"), [16, 48], [lambda x: V.homogeneous_map(x, 1, 0.4, "chi2"), None])
    e = as_rows(v.select("vec_id", f.alias("f")), "f")
    return e.select("vec_id", F.when(F.col("i") <= 48, F.col("i") + 99).otherwise(F.col("i") - 32).alias("i"), "x")


@query("p9_kernel_map", B.VLONG, "a as (select vec_id, i, abs(x) as x from vlong)", f"m as ({map_sql('a', 2, 0.4)})", "select vec_id, (i - 1) * 5 + j + 1 as i, round(y, 6) + 0.0 as x from m")
def p9(spark, d):
    v = B.vectors(spark, d).select("vec_id", V.homogeneous_map(F.transform("v", F.abs), 2, 0.4, "chi2").alias("f"))
    return as_rows(v, "f")


def cues():
    return {"bp": F.col("l_discount") * 5, "tp": F.col("l_tax") * 5, "cp": F.col("l_quantity") / 50, "ic": F.col("l_quantity") / 100}


def affinity_sql(kind: str) -> str:
    sql = {"bp": "l_discount * 5", "tp": "l_tax * 5", "cp": "l_quantity / 50", "ic": "l_quantity / 100"}
    base, weights = S.AFFINITY[kind]
    return f"round(1 / (1 + exp(-({base}::double" + "".join(f" + ({sql[c]}) / {s}::double * ({w})::double" for c, (w, s) in weights.items()) + "))), 6)"


@query("p10_pair_affinity", "select l_orderkey, l_linenumber, " + ", ".join(f"{affinity_sql(k)} as {k.lower()}" for k in S.AFFINITY) + " from lineitem")
def p10(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(r6(S.affinity(k, cues())).alias(k.lower()) for k in S.AFFINITY))


@query("p11_contrast_sigmoid", "select event_id, round((1 / (1 + exp(-(-2.6433::double + 10.7998::double * greatest(0.0, least(1.0, 1.2 * (value / 400)))))) - 0.0667) / 0.9333, 6) as p from events")
def p11(spark, d):
    return B.table(spark, d, "events").select("event_id", r6(S.contrast_sigmoid(F.col("value") / 400)).alias("p"))


CUE_WEIGHTS = [0.3, 0.1, 0.05, 0.2, 0.02, 0.08, 0.04, 0.06, 0.03, 0.07, 0.02, 0.01, 0.02]


@query(
    "p12_cue_fusion", B.VLONG,
    "w as (select generate_subscripts(x, 1) as k, unnest(x) as w from (select " + str(CUE_WEIGHTS) + "::double[] as x))",
    "s as (select vec_id, o, sum(abs(v.x) * w.w) as s from vlong v, w, (select unnest(range(0, 4)) as o) where v.i = o * 13 + w.k group by vec_id, o)",
    "select vec_id, round(max(s), 6) as g from s group by vec_id",
)
def p12(spark, d):
    """Thirteen cues per orientation, weighted and summed; the largest of four orientations."""
    w = F.array(*(F.lit(x) for x in CUE_WEIGHTS))
    a = F.transform("v", F.abs)
    fused = F.array(*(V.KERNELS["kl2"](F.slice(a, o * 13 + 1, 13), w) for o in range(4)))
    return B.vectors(spark, d).select("vec_id", r6(F.array_max(fused)).alias("g"))


@query("p14_edge_cleanup", B.RASTER, B.EDGES, "select graph_id, src, dst, case when round(w * 10) >= 9 then 100.0 else round(w * 10) end as w from edge where round(w * 10) <> 0")
def p14(spark, d):
    """Weights rounded to tenths, large ones replaced, zeros dropped."""
    e = B.raster_graph(B.raster(spark, d)).withColumn("w", F.round(F.col("w") * 10))
    return e.where("w <> 0").withColumn("w", F.when(F.col("w") >= 9, 100.0).otherwise(F.col("w")))


@query("p26_column_subset", "n as (select vec_id, row_number() over (order by vec_id) as k, count(*) over () as n from embeddings)", "select vec_id from n where k in (select round(1 + (n - 1) * i / 9.0::double)::bigint from (select max(n) as n from n), (select unnest(range(0, 10)) as i))")
def p26(spark, d):
    """Ten equally spaced rows in order of id; places are global ranks."""
    ids = global_rank(B.vectors(spark, d).select("vec_id"), F.col("vec_id"), name="k")
    n = ids.count()
    at = [math.floor(1 + (n - 1) * i / 9 + 0.5) for i in range(10)] if n else []
    return ids.where(F.col("k").isin(at)).select("vec_id")


# pairs with the codebook
def with_codebook(spark, d, absolute=True):
    f = (lambda c: F.transform(c, F.abs)) if absolute else (lambda c: F.col(c))
    code = B.codebook(spark, d).select("word", f("c").alias("c"))  # one row a label
    return B.vectors(spark, d).select("vec_id", f("v").alias("v")).join(F.broadcast(code))


XY = "xy as (select v.vec_id, k.word, v.i, abs(v.x) as a, abs(k.m) as b from vlong v join code k using (i))"
LOGS = "(case when {0} = 0 then 0 else {0} * log2(1 + {1} / {0}) end)"
AB, BA = LOGS.format("a", "b"), LOGS.format("b", "a")
METRIC_SQL = {
    "linf": "max(abs(a - b))", "l2": "sum((a - b) * (a - b))", "l1": "sum(abs(a - b))", "l0": "sum((a <> b)::int)::double",
    "chi2": "sum(case when a + b = 0 then 0 else (a - b) * (a - b) / (a + b) end)", "hell": "sum((sqrt(a) - sqrt(b)) * (sqrt(a) - sqrt(b)))", "js": f"sum(a - {AB} + b - {BA})",
}
KERNEL_SQL = {"kl2": "sum(a * b)", "kl1": "sum(least(a, b))", "kchi2": "sum(case when a + b = 0 then 0 else 2 * a * b / (a + b) end)", "khell": "sum(sqrt(a * b))", "kjs": f"sum(({AB} + {BA}) / 2)"}
PDIST_SQL = {"euclidean": "sqrt(sum((a - b) * (a - b)))", "sqeuclidean": "sum((a - b) * (a - b))", "cosine": "1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b))", "chisq": METRIC_SQL["chi2"] + " / 2"}


def _select(table: dict) -> str:
    return "select vec_id, other, " + ", ".join(f"round({v}, 6) as {k}" for k, v in table.items()) + " from xx group by vec_id, other"


#: Queries of the searches: every row whose id is divisible by 20, against all rows.
ASKED = "vec_id % 20 = 0"
XX = f"xx as (select q.vec_id, v.vec_id as other, v.i, abs(q.x) as a, abs(v.x) as b from vlong q join vlong v using (i) where q.{ASKED})"


def _searched(spark, d, names):
    v = B.vectors(spark, d).select("vec_id", F.transform("v", F.abs).alias("v"))
    return search.measured(v.where(ASKED), v, list(names))


def _pairs(spark, d, table, names):
    p = with_codebook(spark, d)
    return p.select("vec_id", "word", *(r6(table[k](F.col("v"), F.col("c"))).alias(k) for k in names))


@query("j7_all_distances", B.VLONG, XX, _select(METRIC_SQL))
def j7(spark, d):
    return _searched(spark, d, METRIC_SQL)


@query("j8_all_kernels", B.VLONG, XX, _select(KERNEL_SQL))
def j8(spark, d):
    return _searched(spark, d, KERNEL_SQL)


@query("j9_pdist2", B.VLONG, XX, _select(PDIST_SQL))
def j9(spark, d):
    return _searched(spark, d, PDIST_SQL)


@query(
    "w16_emd", B.VLONG, B.CODE, XY, "cum as (select vec_id, word, i, sum(a) over w as a, sum(b) over w as b from xy window w as (partition by vec_id, word order by i))",
    "select vec_id, word, round(sum(abs(a - b)), 6) as emd from cum group by all",
)
def w16(spark, d):
    return _pairs(spark, d, V.METRICS, ["emd"])


@query("j10_chi2_rbf", B.VLONG, B.CODE, XY, f"dist as (select vec_id, word, {METRIC_SQL['chi2']} as d from xy group by all)", "select vec_id, word, round(d, 6) as d, round(exp(-0.5 * d / avg(d) over ()), 6) as k from dist")
def j10(spark, d):
    """Chi-square distances and the kernel scaled by their mean."""
    p = with_codebook(spark, d).select("vec_id", "word", V.METRICS["chi2"](F.col("v"), F.col("c")).alias("d"))
    mean = p.agg(F.avg("d").alias("mean"))
    return p.join(F.broadcast(mean)).select("vec_id", "word", r6("d").alias("d"), r6(F.exp(-0.5 * F.col("d") / F.col("mean"))).alias("k"))


@query("j11_bounded_chi2", B.VLONG, B.CODE, XY, "select vec_id, word, round(least(1.0, sum(case when a + b = 0 then 0 else (a - b) * (a - b) / (2 * (a + b)) end)), 6) as d from xy group by all")
def j11(spark, d):
    p = with_codebook(spark, d)
    return p.select("vec_id", "word", r6(V.METRICS["bounded_chi2"](F.col("v"), F.col("c"))).alias("d"))


def quantized(vec: DataFrame, code: DataFrame, metric: str = "l2") -> DataFrame:
    """The nearest centre of each vector (the smallest word on ties)."""
    return C.assign(vec, code, metric).select("vec_id", "word", "dist")


SIGNED = "sxy as (select v.vec_id, k.word, v.i, v.x as a, k.m as b from vlong v join code k using (i))"


def nearest_sql(expr: str) -> tuple[str, ...]:
    return (B.VLONG, B.CODE, SIGNED, f"dist as (select vec_id, word, round({expr}, 9) as d from sxy group by all)", "near as (select vec_id, word, d, row_number() over (partition by vec_id order by d, word) as k from dist)")


@query("j12_quantize", *nearest_sql("sum((a - b) * (a - b))"), "select vec_id, word, round(d, 6) as dist from near where k = 1")
def j12(spark, d):
    return quantized(B.vectors(spark, d), B.codebook(spark, d)).withColumn("dist", r6("dist"))


@query("j12_quantize_l1", *nearest_sql("sum(abs(a - b))"), "select vec_id, word, round(d, 6) as dist from near where k = 1")
def j12_l1(spark, d):
    return quantized(B.vectors(spark, d), B.codebook(spark, d), "l1").withColumn("dist", r6("dist"))


KNN = (
    B.VLONG, f"dist as (select q.vec_id, v.vec_id as other, sum((q.x - v.x) * (q.x - v.x)) as d from vlong q join vlong v using (i) where q.{ASKED} and q.vec_id <> v.vec_id group by all)",
    "near as (select vec_id, other, d, row_number() over (partition by vec_id order by round(d, 9), other) as k from dist)",
)


@query("j13_knn", *KNN, "select vec_id, other, k::bigint as rank, round(d, 6) as dist from near where k <= 10")
def j13(spark, d):
    """The ten nearest vectors of each query, in order."""
    v = B.vectors(spark, d)
    return search.exact(v.where(ASKED), v, 10).withColumn("dist", r6("dist"))


@query("j14_approximate_knn")
def j14(spark, d):
    """The same by an index over all rows."""
    v = B.vectors(spark, d)
    return search.approximate(v.where(ASKED), v, 10).withColumn("dist", r6("dist"))


#: The given vectors have no clusters and fill all dimensions, so a query has to look at most rows to find nine of ten, and
#: more trees only meet the same rows again.
FOREST_TREES, FOREST_SHARE = 1, 0.85


@query("j14_forest_knn")
def j14_forest(spark, d):
    """The same by a randomized forest whose leaves are searched best bin first, with a bound on compared rows."""
    v = B.vectors(spark, d)
    return search.Forest(v, FOREST_TREES).search(v.where(ASKED), 10, FOREST_SHARE).withColumn("dist", r6("dist"))


@query("j17_ratio_match", *KNN, "two as (select a.vec_id, a.other, a.d, b.d as d2 from near a left join near b on a.vec_id = b.vec_id and b.k = 2 where a.k = 1)", "select vec_id, other, round(d, 6) as dist from two where d2 is null or 1.05 * round(d, 9) <= round(d2, 9)")
def j17(spark, d):
    """The nearest vector of each query where it is nearer than the second by the ratio (on squared distances)."""
    v = B.vectors(spark, d)
    best = search.exact(v.where(ASKED), v, 2).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", F.round("dist", 9).alias("dist")))).alias("b"))  # two
    one, two = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return best.where(two.isNull() | (1.05 * one["dist"] <= two["dist"])).select("vec_id", one["other"].alias("other"), r6(one["dist"]).alias("dist"))


@query("j20_label_push", "select event_id, case event_type when 'view' then 1 when 'click' then 1 when 'signup' then 2 when 'purchase' then 2 else -1 end as y from events")
def j20(spark, d):
    m = spark.createDataFrame([("view", 1), ("click", 1), ("signup", 2), ("purchase", 2)], "event_type string, y int")
    return B.table(spark, d, "events").join(F.broadcast(m), "event_type", "left").select("event_id", F.coalesce("y", F.lit(-1)).alias("y"))


# scalar functions
EDGES10 = [float(x) for x in range(-10, 11)]


@query("x1_bin_search", "select event_id, (" + " + ".join(f"(value / 10 >= {e})::int" for e in EDGES10) + ") as bin from events")
def x1(spark, d):
    return B.table(spark, d, "events").select("event_id", S.bin_search(F.col("value") / 10, EDGES10).alias("bin"))


@query(
    "x2_x4_densities",
    """select event_id, round(1 / (1 + exp(-x)), 6) as sigmoid, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) as dsigmoid, round(exp(-0.5 * x * x) / sqrt(2 * pi()), 6) as g,
       round(-x * exp(-0.5 * x * x) / sqrt(2 * pi()), 6) + 0.0 as dg, round((x * x - 1) * exp(-0.5 * x * x) / sqrt(2 * pi()), 6) + 0.0 as ddg,
       round(case when x < 0.6 then 1.0 when x <= 1 then 0.5 * (1 + cos((0.6 - x) / 0.4 * pi())) else 0.0 end, 6) as rc from (select event_id, value / 50 - 1 as x from events)""",
)
def x2(spark, d):
    x = F.col("value") / 50 - 1
    cols = {"sigmoid": S.sigmoid(x), "dsigmoid": S.dsigmoid(x), "g": S.gaussian(x), "dg": S.dgaussian(x), "ddg": S.ddgaussian(x), "rc": S.raised_cosine(x, 0.4)}
    return B.table(spark, d, "events").select("event_id", *((r6(c) + F.lit(0.0)).alias(k) for k, c in cols.items()))


def _rgb():
    return [F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_quantity") / 50]


def colour_sql() -> str:
    lin = ["pow(l_discount * 10, 2.2)", "pow(l_tax * 12, 2.2)", "pow(l_quantity / 50, 2.2)"]
    xyz = [" + ".join(f"{w!r}::double * {c}" for w, c in zip(row, lin)) for row in S.SPACES["CIE"]]
    return f"col as (select l_orderkey, l_linenumber, l_discount, l_tax, l_quantity, {xyz[0]} as x, {xyz[1]} as y, {xyz[2]} as z from lineitem)"


def light_sql(e: str) -> str:
    return f"(case when {e} > 0.00856 then pow({e}, 1 / 3.0::double) else (903.3 * {e} + 16) / 116 end)"


@query(
    "x5_colour", colour_sql(),
    f"lab as (select *, {light_sql('x')} as fx, {light_sql('y')} as fy, {light_sql('z')} as fz, x + 15 * y + 3 * z as s from col)",
    """select l_orderkey, l_linenumber, round(x, 5) as x, round(y, 5) as y, round(z, 5) as z, round(116 * fy - 16, 5) as l, round(500 * (fx - fy), 5) + 0.0 as a, round(200 * (fy - fz), 5) + 0.0 as b,
       round(case when s = 0 then 0 else 13 * (116 * fy - 16) * (4 * x / s - 4 / 19.0::double) end, 5) + 0.0 as u, round(case when s = 0 then 0 else 13 * (116 * fy - 16) * (9 * y / s - 9 / 19.0::double) end, 5) + 0.0 as v,
       round(l_discount * 10, 4) + 0.0 as red, round(l_tax * 12, 4) + 0.0 as green, round(l_quantity / 50, 4) + 0.0 as blue from lab""",
)
def x5(spark, d):
    c = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(e.alias(n) for e, n in zip(S.rgb_to_xyz(*_rgb()), "xyz")))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    lab, luv = S.xyz_to_lab(x, y, z), S.xyz_to_luv(x, y, z)
    out = {"x": x, "y": y, "z": z, "l": lab[0], "a": lab[1], "b": lab[2], "u": luv[1], "v": luv[2]}
    back = dict(zip(("red", "green", "blue"), S.xyz_to_rgb(x, y, z)))
    return c.select("l_orderkey", "l_linenumber", *((F.round(e, 5) + F.lit(0.0)).alias(k) for k, e in out.items()), *((F.round(e, 4) + F.lit(0.0)).alias(k) for k, e in back.items()))


@query("x6_x9_geometry", "select p_partkey, round(p_size + 0.3 * (p_retailprice - p_size)) as blend, ((p_size - 1) * 24 + p_partkey % 24)::bigint as id, round(radians(p_size), 6) as rad, round(sqrt(p_size * p_size + (p_partkey % 7) * (p_partkey % 7)), 6) as length, case when p_partkey % 7 = 0 then round(pi() / 2, 6) else round(atan(p_size / (p_partkey % 7)::double), 6) end as angle, p_size / 2 as cx, round(pi() - radians(p_size), 6) as mirrored from part")
def x6(spark, d):
    g = S.segment_geometry(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"))
    return B.table(spark, d, "part").select(
        "p_partkey", S.alpha_blend(F.col("p_retailprice"), F.col("p_size"), F.lit(0.3)).alias("blend"), S.to_id(F.col("p_partkey") % 24, F.col("p_size"), 24).cast("long").alias("id"),
        r6(F.radians("p_size")).alias("rad"), r6(g["length"]).alias("length"), r6(g["angle"]).alias("angle"), g["cx"].alias("cx"),
        r6(S.reflected(F.radians("p_size"), F.lit(math.pi / 2))).alias("mirrored"),
    )
