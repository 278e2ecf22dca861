"""Mixing sources to target weights through a domain-language-source tree.

Budgets go from the root down. At each node the budget is dealt to the children by weight, a child getting at most what
its leaves can give: tokens x MAX_EPOCHS of those whose weights are above 0 on their whole path. What a child cannot use
goes to its siblings by their weights. As no node gets more than its leaves may give, a shortage passes to the ancestors'
other branches only when all siblings are full. Each leaf is then read in seeded epochs: in epoch e its documents go by
md5(seed:e:doc_id), and the token-prefix that fills the budget is taken; the document in which the budget ends is kept
whole.

Leaf totals are one small table, joined back by leaf. A leaf is never sorted as a whole: the digits of the order are
taken DIGITS at a time, tokens are summed in the 16^DIGITS ranges that they name, and only the range in which the budget
ends is looked into, until it holds ROWS documents at most (or one place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.operators.shared import BROADCAST_ROWS, bounded_batches, checkpoint

LEVELS = ("domain", "lang", "source")
MAX_EPOCHS = 2
SEED = 20
#: Hex digits of the order that are looked at together, of 32, and the documents that one window sorts.
DIGITS, ROWS = 3, 4_096


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: 32 hex digits, the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")))


def allocate(leaves: DataFrame, weights: dict[str, dict], budget: float | None, share: float, levels=LEVELS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (levels..., tokens) with their budget.

    weights: level to {name: weight}, 1 where not named, none below 0. budget in tokens; if None, share of all tokens.
    One row a leaf; windows run over the children of a node.
    """
    spark = leaves.sparkSession
    own = leaves.withColumn("root", F.lit(0))
    open_ = F.lit(True)
    for k, level in enumerate(levels):
        named = [(str(n), float(w)) for n, w in weights.get(level, {}).items()]
        if named:  # as many rows as the caller wrote down
            own = own.join(F.broadcast(spark.createDataFrame(named, f"{level} string, w{k} double")), level, "left")
        own = own.withColumn(f"w{k}", F.coalesce(f"w{k}", F.lit(1.0)) if named else F.lit(1.0))
        open_ = open_ & (F.col(f"w{k}") > 0)
    own = own.withColumn("cap", F.when(open_, F.col("tokens") * F.lit(float(max_epochs))).otherwise(0.0))
    top = own.groupBy("root").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = F.lit(float(budget)) if budget is not None else F.col("tokens") * F.lit(float(share))
    given = top.select("root", F.least(total, "cap").alias("budget"))
    parents = ["root"]
    for k, level in enumerate(levels):
        keys = [*parents, level]
        child = own.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.first(f"w{k}").alias("w")).join(given, parents)
        # full children first: the share of the rest is what is left over their weights
        by = W.partitionBy(*parents)
        child = child.withColumn("rank", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
        line = by.orderBy("rank", level)
        child = child.withColumn("before", F.coalesce(F.sum("cap").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        child = child.withColumn("rest", F.sum("w").over(line.rowsBetween(0, W.unboundedFollowing)))
        child = child.withColumn("rate", F.when(F.col("rest") > 0, (F.col("budget") - F.col("before")) / F.col("rest")).otherwise(0.0))
        child = child.withColumn("full", (F.col("w") > 0) & (F.col("rank") <= F.col("rate")))
        child = child.withColumn("used", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0.0)))
        child = child.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0.0)))
        got = F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, F.least("cap", F.col("w") * (F.col("budget") - F.col("used")) / F.col("open"))).otherwise(0.0)
        given = child.select(*keys, F.greatest(F.lit(0.0), got).alias("budget"))
        parents = keys
    return leaves.join(given.drop("root"), list(levels))


def _cuts(slim: DataFrame, part: DataFrame, names: list[str], seed: int, digits: int, hint) -> DataFrame:
    """names..., epoch, cut: the last place of each leaf's token-prefix. slim: names..., n, id; part: names..., epoch, want."""
    leaf = [*names, "epoch"]
    rows = slim.join(hint(part), names).select(*leaf, "n", place(seed, F.col("epoch"), F.col("id")).alias("at"))
    found = part.select(*leaf, "want", F.lit("").alias("start"), F.lit(0).cast("long").alias("before"))
    for upto in range(digits, 33, digits):
        inside = rows.join(hint(found), leaf).where(F.substring("at", 1, upto - digits) == F.col("start"))
        bins = inside.groupBy(*leaf, "want", "before", F.substring("at", 1, upto).alias("bin")).agg(F.sum("n").alias("m"), F.count("*").alias("rows"))
        line = W.partitionBy(*leaf).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("before") + F.coalesce(F.sum("m").over(line), F.lit(0)))
        last = checkpoint(bins.where("before < want and before + m >= want").select(*leaf, "want", F.col("bin").alias("start"), "before", "rows"))
        found = last.drop("rows")
        if last.where(F.col("rows") > ROWS).limit(1).count() == 0:
            break
    inside = rows.join(hint(found), leaf).where(F.col("at").startswith(F.col("start")))
    inside = inside.groupBy(*leaf, "want", "before", "at").agg(F.sum("n").alias("m"))
    line = W.partitionBy(*leaf).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("sum", F.col("before") + F.coalesce(F.sum("m").over(line), F.lit(0)))
    return inside.where("sum < want").groupBy(*leaf).agg(F.max("at").alias("cut"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, dict] | None = None,
    budget: float | None = None,
    share: float = 0.5,
    levels: tuple[str, ...] = LEVELS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    tokens: str = "n_tokens",
    digits: int = DIGITS,
) -> DataFrame:
    """The documents of the mixture: all columns of docs, and their epoch (from 0; a column of that name is replaced).

    docs has the levels, `tokens` and doc_id; further columns, whatever their names, go along. A null level is a branch
    of its own (named ""), null token counts are 0, rows without an id form one tie; rows of one leaf with equal ids
    stand or fall together; an empty table stays empty. Texts are not looked at: a document of any length counts as
    many tokens as its row says, and a leaf's last one is taken whole.
    """
    bounded_batches(docs.sparkSession)
    names = [f"l{k}" for k in range(len(levels))]
    clean = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names)]
    # the given row is one column, so none of its names can clash
    base = docs.select(F.struct("*").alias("row"), *clean, F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("n"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    slim = checkpoint(base.select(*names, "n", "id"))
    leaves = slim.groupBy(*names).agg(F.sum("n").alias("tokens"))
    named = {n: (weights or {}).get(c, {}) for c, n in zip(levels, names)}
    asked = allocate(leaves, named, budget, share, names, max_epochs)
    # whole epochs first, then a prefix of the last one
    epochs = asked.where("tokens > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    epochs = epochs.withColumn("want", F.least(F.col("tokens").cast("double"), F.col("budget") - F.col("epoch") * F.col("tokens"))).where("want > 0")
    epochs = checkpoint(epochs.select(*names, "epoch", "want", (F.col("want") >= F.col("tokens")).alias("whole")))
    small = epochs.count() <= BROADCAST_ROWS // 10  # some 100 bytes a row
    hint = F.broadcast if small else (lambda x: x)
    cut = _cuts(slim, epochs.where("not whole").select(*names, "epoch", "want"), names, seed, digits, hint)
    cuts = checkpoint(epochs.join(cut, [*names, "epoch"], "left").select(*names, "epoch", "whole", "cut"))
    out = base.join(hint(cuts), names).where(F.col("whole") | (place(seed, F.col("epoch"), F.col("id")) <= F.col("cut")))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "epoch"), F.col("epoch").cast("long").alias("epoch"))


def word_count(text: Column) -> Column:
    """Words, the token count of queries that name no tokenizer."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def domain(source: Column) -> Column:
    """The domain that a source belongs to: its number modulo four, "other" without a number."""
    number = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("int"), F.lit(4)).cast("string")))
