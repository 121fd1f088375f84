"""Voxel tables from ordinary tables and from arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXELS = "image_id long, x int, y int, z int, v double, label int"
IMAGES = "image_id long, nx int, ny int, nz int, sx double, sy double, sz double"


def from_numpy(spark: SparkSession, image, mask, spacing, image_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """An image and its mask as (voxels, images); coordinates begin at 1, background is left out."""
    image, mask = np.asarray(image, float), np.asarray(mask)
    if image.ndim not in (2, 3) or image.shape != mask.shape:
        raise ValueError("image and mask need the same shape, of 2 or 3 dimensions")
    if not np.array_equal(mask, np.round(mask)):
        raise ValueError("mask values must be integers")
    spacing = [float(s) for s in spacing]
    if len(spacing) not in (2, 3) or len(spacing) < image.ndim:
        raise ValueError("spacing needs 2 or 3 values, one for each dimension at least")
    at = np.argwhere(mask != 0)
    table = pa.table({
        "image_id": pa.array(np.full(len(at), image_id), pa.int64()), **{c: pa.array((at[:, k] + 1 if k < image.ndim else np.ones(len(at))).astype(np.int32)) for k, c in enumerate("xyz")},
        "v": pa.array(image[mask != 0]), "label": pa.array(mask[mask != 0].astype(np.int32)),
    })
    shape, size = [*image.shape, 1][:3], [*spacing, 1.0][:3]
    return spark.createDataFrame(table.to_pandas(), VOXELS), spark.createDataFrame([(image_id, *shape, *size)], IMAGES)


def from_vectors(table: DataFrame, id_col: str, vector_col: str, width: int, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Vectors as square slices of ``width``; ``depth`` consecutive ids stack to a volume.  Labels: 1 above zero, else 2."""
    cells = table.select(F.col(id_col).alias("id"), F.posexplode(vector_col).alias("at", "e"))
    voxels = cells.select(
        F.floor(F.col("id") / depth).cast("bigint").alias("image_id"), (F.col("at") % width + 1).cast("int").alias("x"), (F.floor(F.col("at") / width) + 1).cast("int").alias("y"),
        (F.pmod(F.col("id"), F.lit(depth)) + 1).cast("int").alias("z"), F.col("e").cast("double").alias("v"), F.when(F.col("e") > 0, 1).otherwise(2).alias("label"),
    )
    images = table.select(F.floor(F.col(id_col) / depth).cast("bigint").alias("image_id")).distinct()
    return voxels, with_shape(images, (width, width, depth), (1.0, 1.0, 1.0))


def with_shape(images: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> DataFrame:
    return images.select("image_id", *(F.lit(n).alias(c) for c, n in zip(("nx", "ny", "nz"), shape, strict=True)), *(F.lit(float(s)).alias(c) for c, s in zip(("sx", "sy", "sz"), spacing, strict=True)))
