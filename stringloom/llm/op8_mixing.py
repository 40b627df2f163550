"""Mixing sources to target weights by capped water-filling.

Targets: each source gets its share by weight of all words, but at most `epochs` times its own; what is over goes to the
others by weight until no target is above its cap. Sorted by cap per weight, the capped sources come first, so two running
sums over the sources give the final water level without a loop.

A source's ratio of target to size is a number of whole repetitions for all its documents and a fraction of one more. The
fraction is sampled by a seeded hash of doc_id: documents are taken in hash order until the target is met. Two histograms over
the hash, one within the other, find the place where that happens, so of a source only 1 in 2**24 is sorted. The plan has a row
per source and is made in one task.

Defined results: a null or empty text has size 0 and is taken 0 times over in words. Null is a source of its own, the last
one. Rows that share a doc_id share their hash and so their repetitions. If there are no words, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage, table

WEIGHTS = (5, 2, 1)


def place(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per source: source, source_size, target, whole (repetitions of all) and cut (the last hash that has one more; null: none)."""
    by = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by) - 1) % len(weights)) + 1)
    total = F.sum("source_size").over(Window.partitionBy())
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"w": weight, "nth": F.row_number().over(by), "total": total})
    src = src.withColumn("cap", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    src = src.withColumn("full", F.col("level") * F.col("w") > F.col("cap"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("cap") / F.col("w"))).over(Window.partitionBy())
    src = src.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.coalesce(level, F.lit(0.0)) * F.col("w"), F.col("cap"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    src = stage(src.select("source", "source_size", "target", whole.cast("long").alias("whole")), "op8-sources")

    more = F.col("target") - F.col("whole") * F.col("source_size")
    at, upper = src.select(F.col("source").alias("__s"), F.lit(0.0).alias("below"), more.alias("more")), None
    for shift in (52, 40):  # the 4096th part of a source in which the target is met, then the 4096th part of that
        rows = sized.withColumn("bucket", F.shiftright(place(seed), shift))
        if upper is not None:
            rows = rows.join(at.select(F.col("__s").alias("__t"), F.col("bucket").alias("__up")), F.col("source").eqNullSafe(F.col("__t")) & (F.shiftright("bucket", 12) == F.col("__up")))
        hist = rows.groupBy(F.col("source").alias("__t"), "bucket").agg(F.sum("size").alias("n")).join(at.drop("bucket"), F.col("__s").eqNullSafe(F.col("__t")))
        hist = hist.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("__s").orderBy("bucket"))).where(F.col("upto") > F.col("more"))
        at = hist.groupBy("__s").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("below"), "more"), "bucket").alias("x")).select("__s", "x.*")
        at = upper = stage(at, "op8-cuts")

    edge = sized.withColumns({"u": place(seed), "__b": F.shiftright(place(seed), 40)}).join(at, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("bucket")))
    edge = edge.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("__s").orderBy("u")))
    inside = edge.where(F.col("upto") - F.col("size") / 2 <= F.col("more")).groupBy("__s").agg(F.max("u").alias("inside"))
    lowest = F.shiftleft(F.col("bucket").cast("long"), 40) - 1  # just below the bucket
    cuts = at.select("__s", "bucket", "more").join(inside.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left")
    cuts = cuts.select("__s", F.when(F.col("more") > 0, F.coalesce("inside", F.when(F.col("bucket") > -(1 << 23), lowest))).alias("cut"))
    return stage(src.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), "op8-plan")


def repetitions(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """docs with __target, __source_size and __copies. The plan has a row per source; Spark broadcasts it when it is small enough."""
    p = plan.select(*(F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "whole", "cut")))
    more = F.coalesce((place(seed) <= F.col("__cut")).cast("long"), F.lit(0))
    return docs.join(p, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", F.col("__whole") + more)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows: each document as often as the mix has it."""
    names = docs.columns
    out = repetitions(docs, plan(stage(sizes(docs), "op8-sizes"), **how), how.get("seed", 17))
    return out.withColumn("__nth", F.explode(F.expr("CASE WHEN __copies > 0 THEN sequence(1L, __copies) ELSE array() END"))).select(*(F.col(f"`{c}`") for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stage(sizes(table(spark, sf_dir, "documents")), "op8-sizes")
    out = repetitions(sized, plan(sized))
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"), "source", F.col("__copies").alias("copies"))
