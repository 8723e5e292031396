"""Orders over tables of any size: ranks, exact quantiles and runs of consecutive numbers without a task that sees every row.

A rank is a row's place in its bucket plus the rows of the buckets before; buckets lie between cuts that a bounded sketch gives, and any
cuts give the same ranks. A quantile is read from the values between two bounds that a sketch gives and a count confirms. Runs are found within blocks of numbers and joined where they touch the blocks' ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a ranking; a quantile's bounds are 2 / ACCURACY of the rows away from it; numbers in a block of runs.
BUCKETS, ACCURACY, BLOCK = 64, 100_000, 1 << 20


def bucket(c: Column, cuts: Sequence) -> Column:
    """The number of cuts (ascending) that c exceeds, by bisection."""
    if not len(cuts):
        return F.lit(0)
    mid = len(cuts) // 2
    above = bucket(c, cuts[mid + 1 :]) + F.lit(mid + 1)
    return F.when(c <= F.lit(cuts[mid]), bucket(c, cuts[:mid])).otherwise(above)


def ranked(df: DataFrame, by: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """df with out, the place of each row in the order of a numeric column without nulls, from 0."""
    cuts = df.agg(F.percentile_approx(by, [k / buckets for k in range(1, buckets)], 10_000).alias("c")).first()["c"] or []
    own = df.withColumn("_bucket", bucket(F.col(by), sorted(set(cuts))))
    counts = own.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_before"))  # a row for each bucket
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(by)) - 1
    return own.join(F.broadcast(before), "_bucket").withColumn(out, F.col("_before") + place).drop("_bucket", "_before")


def exact_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = (), out: str = "quantile") -> DataFrame:
    """by and out: of each group the quantile q of a column without nulls, interpolated between its two neighbours. A sketch gives bounds, a
    count confirms them (else they are the group's least and largest value), and only the distinct values between them meet, counted."""
    keys = list(by) or ["_one"]
    own = df.select(*(by or [F.lit(0).alias("_one")]), F.col(value).cast("double").alias("_v"))
    off, v = 2.0 / ACCURACY, F.col("_v")
    grid = F.percentile_approx("_v", [max(0.0, q - off), min(1.0, q + off)], ACCURACY)
    bounds = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), grid.alias("_g"))
    bounds = bounds.select(*keys, "_n", F.floor((F.col("_n") - 1) * F.lit(q)).alias("_k"), "_least", "_most", F.col("_g")[0].alias("_low"), F.col("_g")[1].alias("_high"))

    def met(of: DataFrame) -> DataFrame:
        """The values beside their group's row; a null key is a key."""
        both = own.withColumnsRenamed({k: f"_own_{k}" for k in keys}).join(of, reduce(lambda x, y: x & y, [F.col(f"_own_{k}").eqNullSafe(F.col(k)) for k in keys]))
        return both.drop(*[f"_own_{k}" for k in keys])

    below, upto = F.sum((v < F.col("_low")).cast("long")), F.sum((v <= F.col("_high")).cast("long"))
    checked = met(bounds).groupBy(*bounds.columns).agg(below.alias("_below"), upto.alias("_upto"))
    sure = (F.col("_below") <= F.col("_k")) & (F.col("_upto") >= F.least(F.col("_k") + 2, F.col("_n")))
    pick = lambda a, b, c: F.when(sure, F.col(a)).otherwise(b).alias(c)
    final = checked.select(*keys, "_n", "_k", pick("_low", F.col("_least"), "_low"), pick("_high", F.col("_most"), "_high"), pick("_below", F.lit(0).cast("long"), "_below"))
    group = [*keys, "_n", "_k", "_below"]
    counted = met(final).filter(v.between(F.col("_low"), F.col("_high"))).groupBy(*group, "_v").agg(F.count("*").alias("c"))
    values = counted.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_v", "c"))).alias("_values"))
    none = F.lit(None).cast("double")
    start = F.struct(F.col("_below").alias("seen"), none.alias("a"), none.alias("b"))

    def step(s: Column, x: Column) -> Column:
        seen = s["seen"] + x["c"]
        first = lambda name, place: F.when(s[name].isNull() & (seen > place), x["_v"]).otherwise(s[name]).alias(name)
        return F.struct(seen.alias("seen"), first("a", F.col("_k")), first("b", F.least(F.col("_k") + 1, F.col("_n") - 1)))

    part = (F.col("_n") - 1) * F.lit(q) - F.col("_k")
    return values.withColumn("_s", F.aggregate("_values", start, step)).select(*by, (F.col("_s.a") + part * (F.col("_s.b") - F.col("_s.a"))).alias(out))


def islands(df: DataFrame, s: str, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """by, first, last and n of each run of consecutive whole numbers. A block's runs are found in one task; only those that touch an end
    of their block, two at most, meet the runs of other blocks."""
    k = F.col(s).cast("long")
    own = df.select(*by, k.alias("_k"), F.floor(k / F.lit(block)).alias("_b")).filter("_k IS NOT NULL").distinct()
    local = own.withColumn("_i", F.col("_k") - F.row_number().over(W.partitionBy(*by, "_b").orderBy("_k")))
    local = local.groupBy(*by, "_b", "_i").agg(F.min("_k").alias("first"), F.max("_k").alias("last"), F.count("*").alias("n"))
    at_end = (F.col("first") == F.col("_b") * block) | (F.col("last") == (F.col("_b") + 1) * block - 1)
    order = W.partitionBy(*by).orderBy("first")
    ends = local.filter(at_end).withColumn("_new", F.coalesce(F.lag("last").over(order) + 1 != F.col("first"), F.lit(True)).cast("int"))
    joined = ends.withColumn("_g", F.sum("_new").over(order)).groupBy(*by, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return local.filter(~at_end).select(*by, "first", "last", "n").unionByName(joined.select(*by, "first", "last", "n"))
