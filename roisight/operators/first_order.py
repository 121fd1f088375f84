"""First-order statistics: aggregates over a region's intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roisight.functions import EPS_FIRST_ORDER, KEY, entropy_term

NAMES = (
    "energy", "total_energy", "entropy", "minimum", "maximum", "range", "mean", "median", "percentile10", "percentile90", "interquartile_range",
    "mean_absolute_deviation", "robust_mean_absolute_deviation", "root_mean_squared", "skewness", "kurtosis", "variance", "uniformity", "standard_deviation",
)


def _rank(share: float, n: Column) -> Column:
    """Nearest rank, halves to even."""
    return F.greatest(F.lit(1).cast("bigint"), F.least(n, F.bround(F.lit(share) * n).cast("bigint")))


def quantiles(rois: DataFrame) -> DataFrame:
    """Nearest-rank quantiles from value counts: only distinct values are ordered, and no list is built.

    A region's distinct values are ranked by a running sum; ties are one row.
    """
    from pyspark.sql import Window

    counts = rois.groupBy(*KEY, "v").agg(F.count("*").alias("c"))
    up = Window.partitionBy(*KEY).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*KEY)))
    at = lambda share: F.min(F.when(F.col("upto") >= _rank(share, F.col("n")), F.col("v")))
    return ranked.groupBy(*KEY).agg(at(0.10).alias("p10"), at(0.25).alias("p25"), at(0.50).alias("p50"), at(0.75).alias("p75"), at(0.90).alias("p90"))


def first_order(levels: DataFrame, spacing: DataFrame) -> DataFrame:
    """One row per region with the 19 features.

    A NaN intensity is an error.  Skewness and kurtosis of a constant region and
    the sample deviation of one voxel are NaN.
    """
    v = F.col("v")
    checked = levels.withColumn("v", F.when(F.isnan("v"), F.raise_error(F.lit("first_order: NaN intensity in a region"))).otherwise(v))
    nan = F.lit(float("nan"))
    basic = checked.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.sum(v * v).alias("energy"), F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.avg("v").alias("mean"),
        F.var_pop("v").alias("variance"), F.stddev_samp("v").alias("sd"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"),
    )
    known = basic.join(quantiles(checked), KEY)
    spread = checked.join(known.select(*KEY, "mean", "p10", "p90"), KEY)
    inside = F.col("v").between(F.col("p10"), F.col("p90"))
    deviations = spread.groupBy(*KEY).agg(F.avg(F.abs(v - F.col("mean"))).alias("mad"), F.avg(F.when(inside, v)).alias("inner_mean"))
    robust = spread.where(inside).join(deviations.select(*KEY, "inner_mean"), KEY).groupBy(*KEY).agg(F.avg(F.abs(v - F.col("inner_mean"))).alias("rmad"))
    bins = levels.groupBy(*KEY, "g").agg(F.count("*").alias("c"))
    shares = bins.join(basic.select(*KEY, "n"), KEY).withColumn("p", F.col("c") / F.col("n"))
    histogram = shares.groupBy(*KEY).agg(entropy_term(F.col("p"), F.col("p"), EPS_FIRST_ORDER).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("uniformity"))
    every = known.join(deviations, KEY).join(robust, KEY, "left").join(histogram, KEY).join(spacing, ["image_id", "plane"])
    return every.select(
        *KEY, "energy", (F.col("energy") * F.col("sx") * F.col("sy") * F.col("sz")).alias("total_energy"), "entropy", "minimum", "maximum",
        (F.col("maximum") - F.col("minimum")).alias("range"), "mean", F.col("p50").alias("median"), F.col("p10").alias("percentile10"), F.col("p90").alias("percentile90"),
        (F.col("p75") - F.col("p25")).alias("interquartile_range"), F.col("mad").alias("mean_absolute_deviation"), F.coalesce("rmad", F.lit(0.0)).alias("robust_mean_absolute_deviation"),
        F.sqrt(F.col("energy") / F.col("n")).alias("root_mean_squared"), F.coalesce("skew", nan).alias("skewness"), F.coalesce(F.col("kurt") + 3, nan).alias("kurtosis"),
        "variance", "uniformity", F.coalesce("sd", nan).alias("standard_deviation"),
    )
