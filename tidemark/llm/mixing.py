"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut


#: Parts into which the rows of a source are dealt where sources are too many for a broadcast.
SALTS = 32


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """Adds the target of each source to (source, source_size).

    Sources in the order of their code points, null last, take the weights in turn and share the sum of
    all sizes. No target exceeds max_epochs times its source's size: what is left over is shared by weight
    among the others. That fixed point is found in closed form: with sources sorted by size to weight, the
    first one whose fair share fits under its cap fixes the level for all later ones. The windows here run
    over one row per source.
    """
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open_w"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    *,
    source: str = "source",
    size: Column | None = None,
    weight: Column | None = None,
    key: Sequence[str] = ("doc_id",),
    seed: int = 17,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_epochs: float = 3.0,
    broadcast_sources: int = 20_000,
    edge_rows: int = 200_000,
) -> DataFrame:
    """Adds mix_size, mix_source_size, mix_target and mix_copies to docs.

    A source whose target is r times its size takes floor(r) complete epochs; the rest of the budget goes to
    the documents with the smallest exponential keys -ln(u) / weight (u: a hash of the key columns and seed,
    so that reruns agree), as many as fit by prefix sum. One more goes on top, that which ends nearest to the budget, if that is nearer than without.

    The prefix sum needs no task that holds a source: the keys of a source of n rows fall into the square root
    of n bins, sizes are summed by (source, bin), and the bin in which the budget ends is cut into bins again until it has at most edge_rows rows,
    which are sorted row by row. Weights crowd keys at one end, which takes a second pass at most in practice. What comes
    back to the rows is one cut per source, broadcast if there are at most broadcast_sources of them and
    joined by source and a salt otherwise.

    Null text counts 0 words, a null source is a source of its own (last in order), null and repeated keys
    get equal random numbers and are told apart by size only: of rows equal in
    key and size, all or none are taken. Empty texts have no words and are never taken, long ones are counted whole. Weights that are null, not
    finite or not positive count as 1. An empty table gives an empty table. Columns of docs named
    mix_size, mix_source_size, mix_target or mix_copies are replaced.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    size = word_count(F.col("text")) if size is None else size
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    weight = F.when((weight > 0) & (weight < float("inf")), weight).otherwise(1.0)
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key], F.lit(str(seed))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    # the order of u ** (1 / weight), largest first, is that of the exponential keys, and it lies in (0, 1)
    rank = 1.0 - F.pow(u, F.lit(1.0) / weight)
    tie = F.substring(digest, 14, 13)
    own = docs.select(F.struct("*").alias("__row"), F.col(source).alias("__src"), size.alias("__size"), rank.alias("__rank"), F.struct(tie.alias("t"), size.alias("s")).alias("__tie"))
    slim = cut(own.select("__src", "__size", "__rank", "__tie"))

    totals = slim.groupBy("__src").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.max("__rank").alias("top")).withColumnRenamed("__src", "source")
    totals = cut(totals)
    plan = source_targets(totals.select("source", "source_size"), weights, max_epochs)
    plan = (
        plan.join(totals.select(F.col("source").alias("s2"), "rows"), F.col("source").eqNullSafe(F.col("s2")))
        .drop("s2")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
        .withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    )
    plan = cut(plan.withColumnRenamed("source", "__k"))
    few = plan.count() <= broadcast_sources

    def by_source(df: DataFrame, side: DataFrame) -> DataFrame:
        """Rows with the columns that `side` has for their source (__k): broadcast, or beyond that number joined by source and a salt, as one source may hold a third of all rows."""
        same = F.col("__src").eqNullSafe(F.col("__k"))
        if few:
            return df.join(F.broadcast(side), same).drop("__k")
        side = side.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return df.withColumn("__l", F.pmod(F.xxhash64("__tie"), F.lit(SALTS)).cast("int")).join(side, same & (F.col("__l") == F.col("__m"))).drop("__k", "__l", "__m")

    placed = by_source(slim, plan.select("__k", "epochs", "budget", "rows")).where("budget > 0 and epochs < " + str(float(max_epochs))).select("__src", "__size", "__rank", "__tie", "budget")
    # where each source's budget ends: among all its rows, then among those of the bin of the cut, until these are few
    ends = plan.select("__k", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0).cast("long").alias("before"), F.col("rows").alias("inside"))
    most = None
    while True:
        inside = by_source(placed, ends).where("__rank between lo and hi").withColumn("bins", F.ceil(F.sqrt("inside")))
        inside = inside.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("__rank") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)).otherwise(0))
        by_bin = inside.groupBy("__src", "bin").agg(F.sum("__size").alias("in_bin"), F.count(F.lit(1)).alias("n"), F.min("__rank").alias("lo"), F.max("__rank").alias("hi"), F.first("budget").alias("budget"), F.first("before").alias("start"))
        before = F.col("start") + F.coalesce(F.sum("in_bin").over(W.partitionBy("__src").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ends = by_bin.withColumn("before", before).where("before <= budget and before + in_bin > budget")
        ends = cut(ends.select(F.col("__src").alias("__k"), "lo", "hi", "before", F.col("n").alias("inside")))
        last, most = most, ends.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("inside")))).first()[0]
        if most is None or most <= edge_rows or most == last:
            break
    edge = by_source(placed, ends).where("__rank between lo and hi")
    upto = F.sum("__size").over(W.partitionBy("__src").orderBy("__rank", "__tie").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    here = F.struct("__rank", "__tie")
    fits = F.col("upto") <= F.col("budget")
    cuts = edge.withColumn("upto", upto).groupBy(F.col("__src").alias("__k")).agg(F.max(F.when(fits, here)).alias("cut"), F.max(F.when(fits, F.col("upto"))).alias("filled"), F.max("before").alias("before"), F.max("lo").alias("cut_from"))
    cuts = cut(cuts.select("__k", "cut", "cut_from", F.coalesce("filled", "before").alias("filled")))

    def within(cut_key: Column, cut_from: Column) -> Column:
        """Whether a row lies before the cut; where no row of the last bin fits, that bin's lower end is the cut."""
        return F.when(cut_key.isNotNull(), here <= cut_key).otherwise(F.col("__rank") < cut_from)

    # one more document, that which ends nearest to the budget, if it ends nearer than none
    left = by_source(placed, cuts).where(~within(F.col("cut"), F.col("cut_from")))
    left = left.withColumn("gap", F.col("budget") - F.col("filled")).withColumn("off", F.abs(F.col("__size") - F.col("gap"))).where("off < gap")
    nearest = left.groupBy(F.col("__src").alias("__k")).agg(F.min("off").alias("least"))
    top_up = by_source(left, nearest).where("off = least").groupBy(F.col("__src").alias("__t")).agg(F.min(here).alias("top_up"))
    p = plan.select("__k", "source_size", "target", "epochs", "budget")
    p = p.join(cuts.drop("filled").withColumnRenamed("__k", "__c"), F.col("__k").eqNullSafe(F.col("__c")), "left").drop("__c").join(top_up, F.col("__k").eqNullSafe(F.col("__t")), "left").drop("__t")
    p = cut(p)
    extra = (
        F.when(F.col("budget") <= 0, 0)
        .when(F.col("cut_from").isNull(), 1)  # the budget takes all
        .otherwise((within(F.col("cut"), F.col("cut_from")) | F.coalesce(here == F.col("top_up"), F.lit(False))).cast("int"))
    )
    copies = F.least(F.col("epochs") + extra, F.lit(int(max_epochs)))
    out = by_source(own, p)
    return out.select(
        "__row.*",
        F.col("__size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.when(F.col("__size") > 0, copies).otherwise(0).cast("int").alias("mix_copies"),
    )


def quality_weights(docs: DataFrame, labels: DataFrame, good: float = 2.0, bad: float = 0.5, broadcast_labels: int = 1_000_000) -> DataFrame:
    """Adds mix_weight: good or bad by the label of a document, 1 without one. A document with several labels takes the best.

    Up to broadcast_labels labels (some 50 bytes each) are broadcast, so that texts stay where they are; beyond that documents are joined by their id.
    """
    best = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q"))
    w = F.when(F.col("__q") >= 1, good).when(F.col("__q") < 1, bad).otherwise(1.0)
    best = F.broadcast(best) if labels.count() <= broadcast_labels else best
    return docs.join(best, F.col("doc_id") == F.col("__id"), "left").withColumn("mix_weight", w).drop("__id", "__q")
