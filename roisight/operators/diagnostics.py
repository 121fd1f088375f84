"""What a result was made from: versions, options, sizes."""

from __future__ import annotations

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import roisight
from roisight.functions import KEY
from roisight.operators.roi import bounding_boxes
from roisight.plans.options import DEFAULT_BIN_WIDTH, Options


def diagnostics(rois: DataFrame, images: DataFrame, spacing: DataFrame, options: Options) -> DataFrame:
    """One row per region; sizes are arrays of as many parts as the region has dimensions."""
    box = bounding_boxes(rois)
    n = options.roi_ndim
    cropped = F.slice(F.array(*((F.col(f"max_{c}") - F.col(f"min_{c}") + 1).cast("int") for c in "xyz")), 1, n)
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    size = F.when(F.col("plane") == 1, F.array(ny, nz)).when(F.col("plane") == 2, F.array(nx, nz)).when(F.col("plane") == 3, F.array(nx, ny)).otherwise(F.slice(F.array(nx, ny, nz), 1, n))
    joined = box.join(images.select("image_id", *(F.col(c).cast("int").alias(c) for c in ("nx", "ny", "nz"))), "image_id").join(spacing, ["image_id", "plane"])
    text = lambda v: F.lit(v).cast("string")
    return joined.select(
        *KEY, text(roisight.__version__).alias("diagnosis_Version_of_engine"), text(pyspark.__version__).alias("diagnosis_Version_of_Spark"),
        F.lit(float(options.bin_width or DEFAULT_BIN_WIDTH)).alias("diagnosis_Bin_width"), F.lit(int(options.n_bins or 32)).alias("diagnosis_Number_of_bins"),
        text(options.weighting_norm or "no_weighting").alias("diagnosis_Weighting_norm"), F.lit(options.keep_largest_only).alias("diagnosis_Keep_largest_only"),
        F.array("sx", "sy", "sz").alias("diagnosis_Voxel_spacing"), size.alias("diagnosis_Image_size"), cropped.alias("diagnosis_Image_size_cropped"),
        size.alias("diagnosis_Mask_size"), cropped.alias("diagnosis_Mask_size_cropped"), F.lit(f"{n}D").alias("diagnosis_Dimensionality_of_image"),
        F.lit(rois.sparkSession.sparkContext.defaultParallelism).alias("diagnosis_Number_of_threads"),
    )
