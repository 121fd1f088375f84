"""Regions of interest: label and slice selection, boxes, discretization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roisight.functions import KEY
from roisight.plans.options import DEFAULT_BIN_WIDTH, Options


def select_labels(voxels: DataFrame, labels: list[int] | tuple[int, ...]) -> DataFrame:
    """Voxels of these labels; the predicate reaches the scan."""
    return voxels.where(F.col("label").isin(*labels))


def whole_images(voxels: DataFrame) -> DataFrame:
    return voxels.select("image_id", "label", F.lit(0).alias("plane"), F.lit(0).alias("slice_idx"), "x", "y", "z", "v")


def cut_slices(voxels: DataFrame, slices: tuple[tuple[int, int], ...]) -> DataFrame:
    """2D regions: each voxel once for each requested slice that it lies in, on the two axes left."""
    wanted = F.array(*(F.struct(F.lit(p).alias("plane"), F.lit(i).alias("slice_idx")) for p, i in slices))
    axis = lambda s: F.when(s["plane"] == 1, F.col("x")).when(s["plane"] == 2, F.col("y")).otherwise(F.col("z"))
    cut = voxels.withColumn("s", F.explode(F.filter(wanted, lambda s: axis(s) == s["slice_idx"])))
    plane = F.col("s.plane")
    return cut.select(
        "image_id", "label", plane.alias("plane"), F.col("s.slice_idx").alias("slice_idx"),
        F.when(plane == 1, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(plane == 3, F.col("y")).otherwise(F.col("z")).alias("y"),
        F.lit(1).alias("z"), "v",
    )


def spacings(images: DataFrame, slices: tuple[tuple[int, int], ...]) -> DataFrame:
    """Spacing by image and plane; the axis across a slice comes last and still counts in its volume."""
    s1, s2, s3 = F.col("sx"), F.col("sy"), F.col("sz")
    pick = lambda p, a, b, c: F.struct(F.lit(p).alias("plane"), a.alias("sx"), b.alias("sy"), c.alias("sz"))
    ways = [pick(0, s1, s2, s3), pick(1, s2, s3, s1), pick(2, s1, s3, s2), pick(3, s1, s2, s3)]
    planes = sorted({p for p, _ in slices}) or [0]
    return images.select("image_id", F.explode(F.array(*(ways[p] for p in planes))).alias("w")).select("image_id", "w.*")


def regions(voxels: DataFrame, options: Options) -> DataFrame:
    chosen = select_labels(voxels, options.labels)
    return cut_slices(chosen, options.slices_2d) if options.slices_2d else whole_images(chosen)


def region_sizes(rois: DataFrame) -> DataFrame:
    return rois.groupBy(*KEY).agg(F.count("*").alias("voxels"))


def missing_labels(voxels: DataFrame, images: DataFrame, labels: list[int] | tuple[int, ...]) -> DataFrame:
    """Requested (image, label) pairs without any voxel."""
    asked = images.select("image_id", F.explode(F.array(*(F.lit(x) for x in labels))).alias("label"))
    return asked.join(select_labels(voxels, labels).select("image_id", "label").distinct(), ["image_id", "label"], "left_anti")


def bounding_boxes(rois: DataFrame) -> DataFrame:
    return rois.groupBy(*KEY).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def crop(rois: DataFrame, margin: int = 0) -> DataFrame:
    """Coordinates relative to the region's box, from 1 + margin."""
    box = bounding_boxes(rois).select(*KEY, "min_x", "min_y", "min_z")
    moved = rois.join(box, KEY)
    return moved.select(*KEY, *((F.col(c) - F.col(f"min_{c}") + 1 + margin).alias(c) for c in "xyz"), *[c for c in rois.columns if c not in (*KEY, *"xyz")])


def discretize(rois: DataFrame, n_bins: int | None = None, bin_width: float | None = None) -> DataFrame:
    """Adds the gray level ``g``.  A fixed count spans the region's range; a fixed width is anchored at 0.

    The range comes from an aggregate that is joined back, so a region of any
    size is spread over tasks.
    """
    if n_bins is not None and bin_width is not None:
        raise ValueError("give n_bins or bin_width, not both")
    ends = rois.groupBy(*KEY).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    if n_bins is not None:
        width = (F.col("hi") - F.col("lo")) / F.lit(float(n_bins))
        scale = F.lit(1.0) / F.when(width == 0, 1.0).otherwise(width)
        level = F.least(F.floor((F.col("v") - F.col("lo")) * F.col("scale")) + 1, F.lit(n_bins).cast("bigint"))
    else:
        scale = F.lit(1.0) / F.lit(float(bin_width or DEFAULT_BIN_WIDTH))
        level = F.floor(F.col("v") * F.col("scale")) - F.floor(F.col("lo") * F.col("scale")) + 1
    return rois.join(ends.withColumn("scale", scale), KEY).withColumn("g", level.cast("int")).drop("lo", "hi", "scale")


def few_bins(rois: DataFrame, bin_width: float) -> DataFrame:
    """Regions that an explicit width cuts into fewer than three bins."""
    span = rois.groupBy(*KEY).agg((F.max("v") - F.min("v")).alias("span"))
    return span.withColumn("bins", F.ceil(F.col("span") / bin_width)).where("bins < 3")


def direction_weight(norm: str, sx, sy, sz, dx: int, dy: int, dz: int, ndim: int):
    """A direction's length under a norm, with spacing."""
    parts = [F.abs(F.lit(float(d))) * s for d, s in ((dx, sx), (dy, sy), (dz, sz))[:ndim]]
    if norm == "infinity":
        return F.greatest(*parts)
    if norm == "euclidean":
        return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    if norm == "manhattan":
        return sum(parts[1:], parts[0])
    return None


