"""The window pass that feeds the texture matrices.

Along each half direction every voxel belongs to one line and has a place on
it; the voxel before and after it, if the region holds them, are one lag and one
lead away.  One exchange on the line serves run lengths, co-occurrences and
neighbourhoods; a region of any size spreads over its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roisight.functions import KEY, half_directions

LINE = [*KEY, "dir", "lx", "ly", "lz"]


def along_lines(levels: DataFrame, ndim: int) -> DataFrame:
    """Rows (region, dir, line, t, x, y, z, g, pg, ng): ``pg`` and ``ng`` are levels of adjacent voxels, or null."""
    steps = F.array(*(F.struct(F.lit(k).alias("dir"), *(F.lit(c).alias(n) for n, c in zip(("dx", "dy", "dz"), d, strict=True))) for k, d in enumerate(half_directions(ndim))))
    spread = levels.select(*KEY, "x", "y", "z", "g", F.explode(steps).alias("s"))
    t = F.when(F.col("s.dx") != 0, F.col("x")).when(F.col("s.dy") != 0, F.col("y")).otherwise(F.col("z"))
    placed = spread.withColumn("t", t).select(
        *KEY, F.col("s.dir").alias("dir"), *((F.col(c) - F.col("t") * F.col(f"s.d{c}")).alias(f"l{c}") for c in "xyz"), "t", "x", "y", "z", "g"
    )
    line = Window.partitionBy(*LINE).orderBy("t")
    near = placed.withColumn("pt", F.lag("t").over(line)).withColumn("nt", F.lead("t").over(line)).withColumn("p", F.lag("g").over(line)).withColumn("q", F.lead("g").over(line))
    return near.select(*LINE, "t", "x", "y", "z", "g", F.when(F.col("pt") == F.col("t") - 1, F.col("p")).alias("pg"), F.when(F.col("nt") == F.col("t") + 1, F.col("q")).alias("ng"))


def pair_counts(lines: DataFrame) -> DataFrame:
    """Symmetric co-occurrence counts (region, dir, i, j, n)."""
    pairs = lines.where("pg IS NOT NULL").groupBy(*KEY, "dir", F.least("g", "pg").alias("lo"), F.greatest("g", "pg").alias("hi")).agg(F.count("*").alias("c"))
    same = F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j"), (2 * F.col("c")).alias("n")))
    both = F.array(F.struct(F.col("lo").alias("i"), F.col("hi").alias("j"), F.col("c").alias("n")), F.struct(F.col("hi").alias("i"), F.col("lo").alias("j"), F.col("c").alias("n")))
    return pairs.select(*KEY, "dir", F.explode(F.when(F.col("lo") == F.col("hi"), same).otherwise(both)).alias("e")).select(*KEY, "dir", "e.*")


def run_counts(lines: DataFrame) -> DataFrame:
    """Run-length counts (region, dir, g, len, n): a run begins where the voxel before is missing or differs."""
    begins = (F.col("pg").isNull() | (F.col("pg") != F.col("g"))).cast("int")
    up = Window.partitionBy(*LINE).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = lines.withColumn("run", F.sum(begins).over(up)).groupBy(*LINE, "run", "g").agg(F.count("*").alias("len"))
    return runs.groupBy(*KEY, "dir", "g", "len").agg(F.count("*").alias("n"))


def neighbourhoods(lines: DataFrame, a: int = 0) -> DataFrame:
    """For each voxel: 1 + neighbours within ``a`` levels, and the sum and number of its neighbours' levels."""
    close = lambda c: F.coalesce((F.abs(F.col(c) - F.col("g")) <= a).cast("int"), F.lit(0))
    here = lambda c: F.col(c).isNotNull().cast("int")
    level = lambda c: F.coalesce(F.col(c), F.lit(0))
    return lines.groupBy(*KEY, "x", "y", "z", "g").agg(
        (F.sum(close("pg") + close("ng")) + 1).alias("dep"), F.sum(level("pg") + level("ng")).alias("near_sum"), F.sum(here("pg") + here("ng")).alias("near_n")
    )


def dependence_counts(near: DataFrame) -> DataFrame:
    return near.groupBy(*KEY, "g", "dep").agg(F.count("*").alias("n"))


def tone_differences(near: DataFrame) -> DataFrame:
    """(region, g, n, s): voxels with neighbours, and summed distances from the neighbours' mean."""
    mean = F.col("near_sum") / F.col("near_n")
    return near.where("near_n > 0").groupBy(*KEY, "g").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("g") - mean)).alias("s"))
