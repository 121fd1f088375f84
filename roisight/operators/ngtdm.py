"""Neighbouring-tone-difference features: theta joins of the small per-level table with itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roisight.functions import KEY

#: Levels of a region that meet all of its levels in one task.
PART_LEVELS = 500
NAMES = ("Coarseness", "Contrast", "Busyness", "Complexity", "Strength")


def ngtdm(matrix: DataFrame) -> DataFrame:
    """From rows (region, g, n, s); the join is an equi-join on the region, over its levels only.

    A region of many levels is split: ``PART_LEVELS`` of them meet all in one task.
    """
    total = matrix.groupBy(*KEY).agg(F.sum("n").alias("all"), F.count("*").alias("ngp"), F.sum("s").alias("ssum"))
    rows = matrix.join(total, KEY).withColumn("p", F.col("n") / F.col("all"))
    one = rows.select(*KEY, F.col("g").cast("double").alias("a"), F.col("p").alias("pa"), F.col("s").alias("sa"), "all", "ngp", "ssum")
    parts = F.ceil(F.col("ngp") / PART_LEVELS).cast("int")
    one = one.withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int"))
    two = rows.select(*KEY, F.col("g").cast("double").alias("b"), F.col("p").alias("pb"), F.col("s").alias("sb"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    a, b, pa, pb = (F.col(c) for c in ("a", "b", "pa", "pb"))
    d = a - b
    made = one.join(two, [*KEY, "part"]).groupBy(*KEY).agg(
        F.max("all").alias("all"), F.max("ngp").alias("ngp"), F.max("ssum").alias("ssum"), F.sum(pa * pb * d * d).alias("spread"), F.sum(F.abs(a * pa - b * pb)).alias("busy"),
        F.sum(F.abs(d) * (pa * F.col("sa") + pb * F.col("sb")) / (pa + pb)).alias("complex"), F.sum((pa + pb) * d * d).alias("strong"),
    )
    own = rows.groupBy(*KEY).agg(F.sum(F.col("p") * F.col("s")).alias("ps"))
    ngp, ssum, ps = F.col("ngp"), F.col("ssum"), F.col("ps")
    return made.join(own, KEY).select(
        *KEY,
        F.when(ps == 0, 1e6).otherwise(F.try_divide(F.lit(1.0), ps)).alias("Coarseness"),
        F.when(ngp <= 1, 0.0).otherwise(F.try_divide(F.col("spread") * ssum / F.col("all"), ngp * (ngp - 1))).alias("Contrast"),
        F.when(F.col("busy") == 0, 0.0).otherwise(F.try_divide(ps, F.col("busy"))).alias("Busyness"),
        (F.col("complex") / F.col("all")).alias("Complexity"),
        F.when(ssum == 0, 0.0).otherwise(F.try_divide(F.col("strong"), ssum)).alias("Strength"),
    )
