"""Connected components of voxels: 26 neighbours in 3D, 8 in 2D.

Regions of up to ``LOCAL_VOXELS`` voxels are labelled each in one task by array
union-find; larger ones by star contraction over the edges between neighbours,
which spreads one region over all tasks.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roisight.functions import KEY, half_directions

LOCAL_VOXELS = 4_000_000
_SCHEMA = "image_id long, label int, plane int, slice_idx int, g int, x int, y int, z int, zone long"


def flood(x: np.ndarray, y: np.ndarray, z: np.ndarray, g: np.ndarray, ndim: int) -> np.ndarray:
    """For each voxel the rank (x fastest, then y, z) of the first voxel of its component."""
    order = np.lexsort((x, y, z))
    c = np.stack([x, y, z], 1)[order].astype(np.int64)
    low, high = c.min(0) - 1, c.max(0) + 2
    sx, sy = high[0] - low[0], high[1] - low[1]
    code = (c[:, 0] - low[0]) + sx * ((c[:, 1] - low[1]) + sy * (c[:, 2] - low[2]))
    level = g[order]
    a, b = [], []
    for dx, dy, dz in half_directions(ndim):
        want = code + dx + sx * (dy + sy * dz)
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        ok = (code[at] == want) & (level[at] == level)
        a.append(np.flatnonzero(ok)), b.append(at[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(code))
    while len(a):
        ra, rb = root[a], root[b]
        low_root, high_root = np.minimum(ra, rb), np.maximum(ra, rb)
        differ = low_root < high_root
        a, b = a[differ], b[differ]
        np.minimum.at(root, high_root[differ], low_root[differ])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    out = np.empty(len(code), np.int64)
    out[order] = root
    return out


def label_components(levels: DataFrame, ndim: int, same_level: bool = True, local_voxels: int = LOCAL_VOXELS) -> DataFrame:
    """Adds ``zone``, equal within a component; only voxels of one level connect if ``same_level``."""
    rows = levels.select(*KEY, F.col("g").cast("int").alias("g") if same_level else F.lit(0).alias("g"), *(F.col(c).cast("int").alias(c) for c in "xyz"))

    def solve(table: pa.Table) -> pa.Table:
        x, y, z, g = (table.column(c).to_numpy() for c in "xyzg")
        return table.append_column("zone", pa.array(flood(x, y, z, g, ndim)))

    sizes = rows.groupBy(*KEY).count()
    large = sizes.where(F.col("count") > local_voxels)
    if large.isEmpty():
        return rows.groupBy(*KEY).applyInArrow(solve, _SCHEMA)
    small = rows.join(large.select(*KEY), KEY, "left_anti").groupBy(*KEY).applyInArrow(solve, _SCHEMA)
    return small.unionByName(spread_components(rows.join(large.select(*KEY), KEY, "left_semi"), ndim))


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint()


def spread_components(rows: DataFrame, ndim: int) -> DataFrame:
    """Labels by iterated least neighbours with shortcuts, all as joins; ``zone`` packs the first voxel's place."""
    place = lambda x, y, z: ((z.cast("bigint") + 1048576) * 2097152 + (y + 1048576)) * 2097152 + (x + 1048576)
    node = rows.withColumn("node", place(F.col("x"), F.col("y"), F.col("z")))
    steps = F.array(*(F.struct(*(F.lit(c).alias(n) for n, c in zip(("dx", "dy", "dz"), d, strict=True))) for d in half_directions(ndim)))
    reach = node.select(*KEY, "g", F.col("node").alias("a"), "x", "y", "z", F.explode(steps).alias("s"))
    reach = reach.withColumn("node", place(F.col("x") + F.col("s.dx"), F.col("y") + F.col("s.dy"), F.col("z") + F.col("s.dz")))
    one = reach.join(node.select(*KEY, "g", "node"), [*KEY, "g", "node"]).select(*KEY, "a", F.col("node").alias("b"))
    edges = _cut(one.unionByName(one.select(*KEY, F.col("b").alias("a"), F.col("a").alias("b"))))
    state = _cut(node.select(*KEY, "node", F.col("node").alias("zone")))
    while True:
        told = edges.join(state.select(*KEY, F.col("node").alias("b"), "zone"), [*KEY, "b"]).groupBy(*KEY, F.col("a").alias("node")).agg(F.min("zone").alias("least"))
        lower = state.join(told, [*KEY, "node"], "left").select(*KEY, "node", F.col("zone").alias("old"), F.least("zone", F.coalesce("least", "zone")).alias("zone"))
        # a component takes the least zone that any of its voxels has heard of
        heard = lower.groupBy(*KEY, F.col("old").alias("zone")).agg(F.min("zone").alias("best"))
        now = _cut(lower.select(*KEY, "node", "old").join(heard.withColumnRenamed("zone", "old"), [*KEY, "old"]).select(*KEY, "node", "old", F.col("best").alias("zone")))
        state = now.drop("old")
        if now.where("old <> zone").isEmpty():
            break
    return node.join(state, [*KEY, "node"]).select(*KEY, "g", "x", "y", "z", "zone")


def zone_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*KEY, "g", "zone").agg(F.count("*").alias("size"))


def island_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*KEY).agg(F.countDistinct("zone").cast("int").alias("islands"))


def largest_component(labelled: DataFrame) -> DataFrame:
    """Voxels of each region's largest component; of equal ones, that with the first voxel (x fastest)."""
    sizes = labelled.groupBy(*KEY, "zone").agg(F.count("*").alias("size"), F.min(F.struct("z", "y", "x")).alias("first"))
    best = sizes.groupBy(*KEY).agg(F.min_by("zone", F.struct((-F.col("size")).alias("s"), "first")).alias("zone"))
    return labelled.join(best, [*KEY, "zone"], "left_semi")


def island_sizes(labelled: DataFrame) -> DataFrame:
    """Regions of more than one component, with the sizes of the ten largest."""
    sizes = labelled.groupBy(*KEY, "zone").agg(F.count("*").alias("size"))
    rank = Window.partitionBy(*KEY).orderBy(F.desc("size"), "zone")
    ranked = sizes.withColumn("rank", F.row_number().over(rank)).withColumn("islands", F.count("*").over(Window.partitionBy(*KEY)))
    return ranked.where("islands > 1 AND rank <= 10").groupBy(*KEY, "islands").agg(F.reverse(F.sort_array(F.collect_list("size"))).alias("sizes"))
