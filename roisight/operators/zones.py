"""Features of matrices that count (level, size): runs, zones, dependences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roisight.functions import EPS_RUNS, KEY
from roisight.operators.glcm import weights_by_direction

RUN_NAMES = (
    "ShortRunEmphasis", "LongRunEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "RunLengthNonUniformity", "RunLengthNonUniformityNormalized",
    "RunPercentage", "GrayLevelVariance", "RunVariance", "RunEntropy", "LowGrayLevelRunEmphasis", "HighGrayLevelRunEmphasis", "ShortRunLowGrayLevelEmphasis",
    "ShortRunHighGrayLevelEmphasis", "LongRunLowGrayLevelEmphasis", "LongRunHighGrayLevelEmphasis",
)
ZONE_NAMES = (
    "SmallAreaEmphasis", "LargeAreaEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "SizeZoneNonUniformity", "SizeZoneNonUniformityNormalized",
    "ZonePercentage", "GrayLevelVariance", "ZoneVariance", "ZoneEntropy", "LowGrayLevelZoneEmphasis", "HighGrayLevelZoneEmphasis", "SmallAreaLowGrayLevelEmphasis",
    "SmallAreaHighGrayLevelEmphasis", "LargeAreaLowGrayLevelEmphasis", "LargeAreaHighGrayLevelEmphasis",
)
DEPENDENCE_NAMES = (
    "SmallDependenceEmphasis", "LargeDependenceEmphasis", "GrayLevelNonUniformity", "DependenceNonUniformity", "DependenceNonUniformityNormalized", "GrayLevelVariance",
    "DependenceVariance", "DependenceEntropy", "LowGrayLevelEmphasis", "HighGrayLevelEmphasis", "SmallDependenceLowGrayLevelEmphasis",
    "SmallDependenceHighGrayLevelEmphasis", "LargeDependenceLowGrayLevelEmphasis", "LargeDependenceHighGrayLevelEmphasis",
)


def emphasis(matrix: DataFrame, group: list[str], size: str, eps: float) -> DataFrame:
    """The measures that all three families share, from rows (group, g, size, n)."""
    own = Window.partitionBy(*group)
    n, i, j = F.col("n").cast("double"), F.col("g").cast("double"), F.col(size).cast("double")
    rows = matrix.withColumn("all", F.sum(n).over(own)).withColumn("mi", F.sum(i * n).over(own) / F.col("all")).withColumn("mj", F.sum(j * n).over(own) / F.col("all"))
    rows = rows.withColumn("pg", F.sum(n).over(Window.partitionBy(*group, "g"))).withColumn("pj", F.sum(n).over(Window.partitionBy(*group, size)))
    total, p = F.max("all"), n / F.col("all")
    by = lambda e: F.sum(e) / total
    entropy = -F.sum(p * F.log2(p + F.lit(eps))) if eps else -F.sum(p * F.log2(p))
    return rows.groupBy(*group).agg(
        by(n / (j * j)).alias("small"), by(n * j * j).alias("large"), by(n * F.col("pg")).alias("gln"), by(n * F.col("pj")).alias("sn"),
        (by(n * F.col("pg")) / total).alias("glnn"), (by(n * F.col("pj")) / total).alias("snn"), (total / F.sum(n * j)).alias("share"),
        by(n * (i - F.col("mi")) * (i - F.col("mi"))).alias("glv"), by(n * (j - F.col("mj")) * (j - F.col("mj"))).alias("sv"), entropy.alias("entropy"),
        by(n / (i * i)).alias("low"), by(n * i * i).alias("high"), by(n / (i * i * j * j)).alias("small_low"), by(n * i * i / (j * j)).alias("small_high"),
        by(n * j * j / (i * i)).alias("large_low"), by(n * i * i * j * j).alias("large_high"),
    )


_RUN_ORDER = ("small", "large", "gln", "glnn", "sn", "snn", "share", "glv", "sv", "entropy", "low", "high", "small_low", "small_high", "large_low", "large_high")
_DEPENDENCE_ORDER = ("small", "large", "gln", "sn", "snn", "glv", "sv", "entropy", "low", "high", "small_low", "small_high", "large_low", "large_high")


def glrlm_matrix(runs: DataFrame, spacing: DataFrame | None = None, norm: str | None = None, ndim: int = 3) -> DataFrame:
    """Run counts by direction; under any norm one matrix (dir -1) over all directed angles.

    A weight is the direction's length; ``no_weighting`` weighs one and merges too.
    A direction and its opposite give the same runs, hence the factor two.
    """
    counts = runs.withColumn("n", F.col("n").cast("double"))
    if norm is None:
        return counts
    if norm == "no_weighting":
        weighted = counts.withColumn("n", 2 * F.col("n"))
    else:
        weighted = counts.join(spacing, ["image_id", "plane"]).withColumn("n", 2 * F.col("n") * weights_by_direction(norm, ndim))
    return weighted.groupBy(*KEY, "g", "len").agg(F.sum("n").alias("n")).withColumn("dir", F.lit(-1)).select(*KEY, "dir", "g", "len", "n")


def glrlm(matrix: DataFrame) -> DataFrame:
    """Means over directions."""
    made = emphasis(matrix, [*KEY, "dir"], "len", EPS_RUNS)
    return made.groupBy(*KEY).agg(*(F.avg(a).alias(b) for a, b in zip(_RUN_ORDER, RUN_NAMES, strict=True)))


def glszm_matrix(zones: DataFrame) -> DataFrame:
    """Zone counts (region, g, size, n) from rows (region, g, zone, size)."""
    return zones.groupBy(*KEY, "g", "size").agg(F.count("*").alias("n"))


def glszm(matrix: DataFrame) -> DataFrame:
    made = emphasis(matrix, KEY, "size", EPS_RUNS)
    return made.select(*KEY, *(F.col(a).alias(b) for a, b in zip(_RUN_ORDER, ZONE_NAMES, strict=True)))


def gldm(matrix: DataFrame) -> DataFrame:
    made = emphasis(matrix, KEY, "dep", 0.0)
    return made.select(*KEY, *(F.col(a).alias(b) for a, b in zip(_DEPENDENCE_ORDER, DEPENDENCE_NAMES, strict=True)))
