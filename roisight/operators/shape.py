"""Shape descriptors: meshes by corner fan-out, axes by covariance, exact diameters."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from roisight.functions import KEY
from roisight.functions.mesh import corner, cube_triangles, square_segments

SHAPE3D_NAMES = (
    "surface_area", "mesh_volume", "surface_volume_ratio", "sphericity", "maximum_3d_diameter", "least_axis_length", "minor_axis_length", "major_axis_length",
    "elongation", "flatness", "voxel_volume", "number_of_islands",
)
SHAPE2D_NAMES = (
    "perimeter", "mesh_surface", "maximum_diameter", "pixel_surface", "perimeter_surface_ratio", "sphericity", "major_axis_length", "minor_axis_length",
    "elongation", "number_of_islands",
)
_NAN = float("nan")


def cell_cases(rois: DataFrame, ndim: int) -> DataFrame:
    """Each voxel sets its corner's bit in all cells around it: (region, cx, cy, cz, case)."""
    corners = F.array(*(F.struct(*(F.lit(c).alias(n) for n, c in zip("xyz", corner(b), strict=True)), F.lit(1 << b).alias("bit")) for b in range(2**ndim)))
    spread = rois.select(*KEY, "x", "y", "z", F.explode(corners).alias("o"))
    return spread.groupBy(*KEY, *((F.col(c) - F.col(f"o.{c}")).alias(f"c{c}") for c in "xyz")).agg(F.sum("o.bit").cast("int").alias("case"))


def _case_column(ndim: int) -> Column:
    """The pieces of a case, from an array literal of fixed size (256 or 16 entries)."""
    empty = "array<struct<p:array<int>,q:array<int>,r:array<int>>>" if ndim == 3 else "array<struct<p:array<int>,q:array<int>>>"
    table = [cube_triangles(k) if ndim == 3 else square_segments(k) for k in range(2 ** (2**ndim))]
    text = "array(" + ",".join("array(" + ",".join("named_struct(" + ",".join(f"'{n}',array({x},{y},{z})" for n, (x, y, z) in zip("pqr", piece, strict=False)) + ")" for piece in row) + ")" if row else f"cast(array() as {empty})" for row in table) + ")"
    return F.expr(text)


def mesh_pieces(cells: DataFrame, ndim: int) -> DataFrame:
    """Triangles or segments with doubled integer coordinates (region, p, q[, r])."""
    spark = cells.sparkSession
    table = spark.range(1).select(F.posexplode(_case_column(ndim)).alias("case", "pieces")).where(F.size("pieces") > 0)
    mixed = cells.where((F.col("case") > 0) & (F.col("case") < 2 ** (2**ndim) - 1))
    base = F.array(*(F.col(f"c{c}") * 2 for c in "xyz"))
    moved = lambda n: F.zip_with(base, F.col(f"t.{n}"), lambda a, b: a + b).alias(n)
    # the table has at most 255 rows
    return mixed.join(F.broadcast(table), "case").select(*KEY, *(f"c{c}" for c in "xyz"), F.explode("pieces").alias("t")).select(*KEY, *(moved(n) for n in "pqr"[:ndim]))


def scaled(pieces: DataFrame, spacing: DataFrame, ndim: int) -> DataFrame:
    joined = pieces.join(spacing, ["image_id", "plane"])
    half = F.array(*(F.col(s) / 2 for s in ("sx", "sy", "sz")))
    return joined.select(*KEY, *(F.zip_with(n, half, lambda a, b: a * b).alias(n) for n in "pqr"[:ndim]))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)]


def mesh_metrics_3d(triangles: DataFrame) -> DataFrame:
    """Surface area and enclosed volume from scaled triangles."""
    p, q, r = ([F.col(n)[k] for k in range(3)] for n in "pqr")
    normal = _cross([b - a for a, b in zip(p, q, strict=True)], [b - a for a, b in zip(p, r, strict=True)])
    area = F.sqrt(normal[0] * normal[0] + normal[1] * normal[1] + normal[2] * normal[2]) / 2
    across = _cross(q, r)
    volume = (p[0] * across[0] + p[1] * across[1] + p[2] * across[2]) / 6
    return triangles.groupBy(*KEY).agg(F.sum(area).alias("surface_area"), F.abs(F.sum(volume)).alias("mesh_volume"))


def mesh_metrics_2d(segments: DataFrame) -> DataFrame:
    """Perimeter and enclosed surface from scaled segments."""
    p, q = ([F.col(n)[k] for k in range(2)] for n in "pq")
    length = F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))
    return segments.groupBy(*KEY).agg(F.sum(length).alias("perimeter"), F.abs(F.sum(p[0] * q[1] - p[1] * q[0]) / 2).alias("mesh_surface"))


def outer_vertices(pieces: DataFrame, ndim: int) -> DataFrame:
    """Distinct mesh vertices that are outermost on every axis-parallel line through them.

    A vertex between two others on a line is never one of a farthest pair.
    """
    points = pieces.select(*KEY, F.explode(F.array(*(F.col(n) for n in "pqr"[:ndim]))).alias("c"))
    kept = points.select(*KEY, *(F.col("c")[k].alias(n) for k, n in enumerate("xyz"))).distinct()
    for axis in "xyz"[:ndim]:
        line = Window.partitionBy(*KEY, *(c for c in "xyz" if c != axis))
        kept = kept.withColumn("lo", F.min(axis).over(line)).withColumn("hi", F.max(axis).over(line)).where((F.col(axis) == F.col("lo")) | (F.col(axis) == F.col("hi"))).select(*KEY, *"xyz")
    return kept


#: Vertices of a region that meet as many others in one task.
BLOCK_VERTICES = 4_000


def far_vertices(points: DataFrame) -> DataFrame:
    """The vertices that may end a farthest pair, in as many blocks as their number asks for.

    The extent along some directions is at most the diameter.  A vertex whose
    distance from the middle of the box, plus the largest such distance, is less than
    the longest extent found has no partner that far away.  The windows share one
    exchange.
    """
    region = Window.partitionBy(*KEY)
    middle = [((F.min(c).over(region) + F.max(c).over(region)) / 2).alias(f"m{c}") for c in "xyz"]
    boxed = points.select("*", *middle, F.greatest(*_extents(region)).alias("low"))
    away = boxed.withColumn("away", F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0))))
    kept = away.withColumn("top", F.max("away").over(region)).where(F.col("away") + F.col("top") >= F.col("low") * (1 - 1e-9))
    return kept.withColumn("blocks", F.ceil(F.count("*").over(region) / BLOCK_VERTICES).cast("int")).select(*KEY, *"xyz", "blocks")


def _extents(region: WindowSpec) -> list[Column]:
    steps = [d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
    along = [sum((F.col(c) * (n / math.sqrt(sum(v * v for v in d))) for c, n in zip("xyz", d, strict=True)), F.lit(0.0)) for d in steps]
    return [F.max(a).over(region) - F.min(a).over(region) for a in along]


def diameters(pieces: DataFrame, spacing: DataFrame, ndim: int, name: str) -> DataFrame:
    """The largest distance between mesh vertices, exactly; a region of many vertices is compared in pairs of blocks."""
    points = outer_vertices(pieces, ndim).join(spacing, ["image_id", "plane"]).select(*KEY, *((F.col(c) * F.col(f"s{c}") / 2).alias(c) for c in "xyz"))
    own = far_vertices(points).withColumn("own", F.pmod(F.xxhash64(*"xyz"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*KEY, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *"xyz")

    def farthest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        p = np.stack([table.column(c).to_numpy() for c in "xyz"[:ndim]], 1)
        best = 0.0
        for at in range(0, len(p), 512):
            d = p[at : at + 512, None, :] - p[None, at:, :]
            best = max(best, float((d * d).sum(2).max()))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.table([*(pa.array([k.as_py()], t) for k, t in zip(key, types, strict=False)), pa.array([math.sqrt(best)])], names=[*KEY, name])

    found = met.groupBy(*KEY, "i", "j").applyInArrow(farthest, f"image_id long, label int, plane int, slice_idx int, {name} double")
    return found.groupBy(*KEY).agg(F.max(name).alias(name))


def _eigen3(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues, ascending, of the symmetric matrix with diagonal a, b, c and off-diagonal d (ab), e (ac), f (bc)."""
    mean = (a + b + c) / 3
    spread = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2 * (d * d + e * e + f * f)) / 6)
    x, y, z = (F.try_divide(v - mean, spread) for v in (a, b, c))
    u, v, w = (F.try_divide(o, spread) for o in (d, e, f))
    half = (x * (y * z - w * w) - u * (u * z - w * v) + v * (u * w - y * v)) / 2
    angle = F.acos(F.least(F.greatest(F.coalesce(half, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))) / 3
    high = mean + 2 * spread * F.cos(angle)
    low = mean + 2 * spread * F.cos(angle + 2 * math.pi / 3)
    return low, 3 * mean - high - low, high


def principal_axes_3d(rois: DataFrame, spacing: DataFrame) -> DataFrame:
    """Axis lengths from the sample covariance; a direction without extent has length 0."""
    x, y, z = ((F.col(c) - 0.5) * F.col(f"s{c}") for c in "xyz")
    cov = rois.join(spacing, ["image_id", "plane"]).groupBy(*KEY).agg(
        F.count("*").alias("n"), *(F.coalesce(F.covar_samp(p, q), F.lit(0.0)).alias(k) for k, p, q in (("a", x, x), ("b", y, y), ("c", z, z), ("d", x, y), ("e", x, z), ("f", y, z)))
    )
    low, middle, high = _eigen3(*(F.col(k) for k in "abcdef"))
    made = cov.select(*KEY, "n", low.alias("l1"), middle.alias("l2"), high.alias("l3"))
    # rounding noise of flat regions is no extent
    clean = lambda c: F.when(F.col(c) > 1e-12 * F.col("l3"), F.col(c)).otherwise(0.0)
    made = made.select(*KEY, "n", clean("l1").alias("l1"), clean("l2").alias("l2"), F.greatest("l3", F.lit(0.0)).alias("l3"))
    ratio = lambda c: F.when((F.col(c) > 0) & (F.col("l3") > 0) & (F.col("n") > 1), F.sqrt(F.try_divide(F.col(c), F.col("l3")))).otherwise(_NAN)
    return made.select(
        *KEY, (4 * F.sqrt("l1")).alias("least_axis_length"), (4 * F.sqrt("l2")).alias("minor_axis_length"), (4 * F.sqrt("l3")).alias("major_axis_length"),
        ratio("l2").alias("elongation"), ratio("l1").alias("flatness"),
    )


def principal_axes_2d(rois: DataFrame, spacing: DataFrame) -> DataFrame:
    """Axis lengths from the population covariance."""
    x, y = ((F.col(c) - 1) * F.col(f"s{c}") for c in "xy")
    cov = rois.join(spacing, ["image_id", "plane"]).groupBy(*KEY).agg(F.covar_pop(x, x).alias("a"), F.covar_pop(y, y).alias("b"), F.covar_pop(x, y).alias("c"))
    a, b, c = (F.col(k) for k in "abc")
    root = F.sqrt((a - b) * (a - b) + 4 * c * c)
    made = cov.select(*KEY, ((a + b - root) / 2).alias("low"), ((a + b + root) / 2).alias("high"))
    low = F.when(F.abs("low") <= 1e-12 * F.col("high"), 0.0).otherwise(F.col("low"))
    made = made.select(*KEY, low.alias("low"), "high")
    return made.select(
        *KEY, (4 * F.sqrt("high")).alias("major_axis_length"), F.when(F.col("low") < 0, _NAN).otherwise(4 * F.sqrt("low")).alias("minor_axis_length"),
        F.coalesce(F.sqrt(F.try_divide(F.greatest("low", F.lit(0.0)), F.col("high"))), F.lit(_NAN)).alias("elongation"),
    )


def shape3d(rois: DataFrame, spacing: DataFrame, islands: DataFrame | None = None) -> DataFrame:
    """One row per region; ``rois`` are the voxels to measure, ``islands`` counts components (else 1)."""
    pieces = mesh_pieces(cell_cases(rois, 3), 3)
    mesh = mesh_metrics_3d(scaled(pieces, spacing, 3))
    size = rois.groupBy(*KEY).count().join(spacing, ["image_id", "plane"]).select(*KEY, (F.col("count") * F.col("sx") * F.col("sy") * F.col("sz")).alias("voxel_volume"))
    every = mesh.join(diameters(pieces, spacing, 3, "maximum_3d_diameter"), KEY).join(principal_axes_3d(rois, spacing), KEY).join(size, KEY)
    every = every.join(islands.withColumnRenamed("islands", "number_of_islands"), KEY) if islands is not None else every.withColumn("number_of_islands", F.lit(1))
    a, v = F.col("surface_area"), F.col("mesh_volume")
    return (
        every.withColumn("surface_volume_ratio", F.when(v > 0, F.try_divide(a, v)).otherwise(0.0))
        .withColumn("sphericity", F.when((a > 0) & (v > 0), F.try_divide(F.lit(math.pi ** (1 / 3)) * F.pow(6 * v, F.lit(2 / 3)), a)).otherwise(0.0))
        .select(*KEY, *SHAPE3D_NAMES)
    )


def shape2d(rois: DataFrame, spacing: DataFrame, islands: DataFrame | None = None) -> DataFrame:
    """One row per region; every measure is of the whole region, whatever its components."""
    pieces = mesh_pieces(cell_cases(rois, 2), 2)
    mesh = mesh_metrics_2d(scaled(pieces, spacing, 2))
    size = rois.groupBy(*KEY).count().join(spacing, ["image_id", "plane"]).select(*KEY, (F.col("count") * F.col("sx") * F.col("sy")).alias("pixel_surface"))
    every = mesh.join(diameters(pieces, spacing, 2, "maximum_diameter"), KEY).join(principal_axes_2d(rois, spacing), KEY).join(size, KEY)
    every = every.join(islands.withColumnRenamed("islands", "number_of_islands"), KEY) if islands is not None else every.withColumn("number_of_islands", F.lit(1))
    p, a = F.col("perimeter"), F.col("mesh_surface")
    return (
        every.withColumn("perimeter_surface_ratio", F.try_divide(p, a)).withColumn("sphericity", F.try_divide(2 * F.sqrt(F.lit(math.pi) * a), p)).select(*KEY, *SHAPE2D_NAMES)
    )
