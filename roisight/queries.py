"""Registered queries: each operator over whole driver tables rasterised to images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roisight.api import Extraction, extract_features
from roisight.functions import KEY
from roisight.operators import connectivity, first_order, glcm, lines, roi, shape, zones
from roisight.plans.options import Options
from roisight.sources.raster import from_vectors, with_shape

#: Discretization that suits the vectors' range of about -0.5 to 0.5.
BINS, WIDTH = 8, 0.05
SLICES = ((1, 2), (2, 5), (3, 4))
#: Cuts about half of the vectors' regions into two bins, the others into three.
FEW_BINS_WIDTH = 0.19


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; a nudge keeps values such as 1/128 off the ties, and negative zero is zero."""
    return df.select(*(F.round(F.col(c) + 1e-9, digits) + F.lit(0.0) if t == "double" else F.col(c) for c, t in df.dtypes)).toDF(*df.columns)


def embedding_volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 8, 8)


def lineitem_volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sparse volumes: one image for each supplier, mean quantity where lines fall together."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = [F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % 32 + 1).cast("int").alias("x"), (F.col("l_orderkey") % 32 + 1).cast("int").alias("y"), F.col("l_linenumber").alias("z")]
    voxels = items.groupBy(*at).agg(F.avg("l_quantity").alias("v")).withColumn("label", F.lit(1))
    return voxels, with_shape(items.select(F.col("l_suppkey").alias("image_id")).distinct(), (32, 32, 7), (1.0, 1.0, 2.5))


def _work(source, **options) -> Callable[[SparkSession, str], Extraction]:
    options = {"labels": (1, 2)} | options
    return lambda spark, sf_dir: Extraction(*source(spark, sf_dir), Options(**options))


_BINNED = _work(embedding_volumes, n_bins=BINS)
_FLAT = _work(embedding_volumes, n_bins=BINS, slices_2d=SLICES)


def _query(work, make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(make(work(spark, sf_dir)))


def _glcm(e: Extraction) -> DataFrame:
    return glcm.glcm(e.matrix("glcm"), e.levels, mcc=False)


def _components(e: Extraction, same_level: bool) -> DataFrame:
    """Each voxel with the first voxel of its component (x fastest)."""
    labelled = connectivity.label_components(e.levels if same_level else e.rois, e.options.roi_ndim, same_level)
    first = labelled.groupBy(*KEY, "zone").agg(F.min(F.struct("z", "y", "x")).alias("f"))
    return labelled.join(first, [*KEY, "zone"]).select(*KEY, "x", "y", "z", F.col("f.x").alias("first_x"), F.col("f.y").alias("first_y"), F.col("f.z").alias("first_z"))


def _islands(e: Extraction) -> DataFrame:
    return connectivity.label_components(e.rois, e.options.roi_ndim, same_level=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "label_filter": _query(_work(embedding_volumes, labels=(1,)), lambda e: roi.region_sizes(e.rois)),
        "multi_label": _query(_BINNED, lambda e: roi.region_sizes(e.rois)),
        "missing_labels": _query(_work(embedding_volumes, labels=(1, 2, 3)), lambda e: e.missing()),
        "slice_2d": _query(_FLAT, lambda e: e.rois),
        "slice_spacing": lambda s, d: Extraction(embedding_volumes(s, d)[0], lineitem_volumes(s, d)[1], Options(labels=(1, 2), slices_2d=SLICES)).spacing,
        "bounding_box": _query(_work(lineitem_volumes, labels=(1,)), lambda e: roi.bounding_boxes(e.rois)),
        "crop": _query(_work(lineitem_volumes, labels=(1,)), lambda e: roi.crop(e.rois, 1).select(*KEY, "x", "y", "z", "v")),
        "discretize_n_bins": _query(_BINNED, lambda e: e.levels.groupBy(*KEY, "g").agg(F.count("*").alias("voxels"))),
        "discretize_bin_width": _query(_work(embedding_volumes, bin_width=WIDTH), lambda e: e.levels.groupBy(*KEY, "g").agg(F.count("*").alias("voxels"))),
        "discretize_default": _query(_work(lineitem_volumes, labels=(1,)), lambda e: e.levels.groupBy(*KEY, "g").agg(F.count("*").alias("voxels"))),
        "binning_warning": _query(_work(embedding_volumes), lambda e: roi.few_bins(e.rois, FEW_BINS_WIDTH)),
        "first_order": _query(_BINNED, lambda e: e.family("first_order")),
        "first_order_bin_width": _query(_work(embedding_volumes, bin_width=WIDTH), lambda e: e.family("first_order")),
        "first_order_slices": _query(_FLAT, lambda e: e.family("first_order")),
        "first_order_sparse": _query(_work(lineitem_volumes, labels=(1,)), lambda e: e.family("first_order")),
        "first_order_quantiles": _query(_BINNED, lambda e: first_order.quantiles(e.rois)),
        "along_lines": _query(_BINNED, lambda e: e.lines.groupBy(*KEY, "dir").agg(F.count("*").alias("voxels"), F.count("pg").alias("pairs"), F.sum(F.coalesce("ng", F.lit(0))).alias("next_sum"))),
        "glcm_counts": _query(_BINNED, lambda e: lines.pair_counts(e.lines)),
        "glcm_matrix": _query(_BINNED, lambda e: e.matrix("glcm")),
        "glcm_features": _query(_BINNED, _glcm),
        "glcm_slices": _query(_FLAT, _glcm),
        "glcm_sparse": _query(_work(lineitem_volumes, labels=(1,), n_bins=BINS), _glcm),
        "glcm_mcc": _query(_BINNED, lambda e: glcm.correlation_coefficients(e.matrix("glcm"), glcm.level_spans(e.levels)).groupBy(*KEY).agg(F.avg("Mcc").alias("Mcc"))),
        "glrlm_matrix": _query(_BINNED, lambda e: e.matrix("glrlm")),
        "glrlm_features": _query(_BINNED, lambda e: e.family("glrlm")),
        "glrlm_slices": _query(_FLAT, lambda e: e.family("glrlm")),
        "glrlm_no_weighting": _query(_work(embedding_volumes, n_bins=BINS, weighting_norm="no_weighting"), lambda e: e.family("glrlm")),
        "connected_components": _query(_FLAT, lambda e: _components(e, False)),
        "level_components": _query(_FLAT, lambda e: _components(e, True)),
        "spread_components": _query(_FLAT, lambda e: connectivity.zone_sizes(connectivity.label_components(e.levels, 2, local_voxels=0)).groupBy(*KEY, "g", "size").agg(F.count("*").alias("n"))),
        "island_counts": _query(_FLAT, lambda e: connectivity.island_counts(_islands(e))),
        "largest_component": _query(_FLAT, lambda e: connectivity.largest_component(_islands(e)).select(*KEY, "x", "y", "z")),
        "glszm_matrix": _query(_FLAT, lambda e: e.matrix("glszm")),
        "glszm_features": _query(_FLAT, lambda e: e.family("glszm")),
        "glszm_volumes": _query(_BINNED, lambda e: e.family("glszm")),
        "gldm_matrix": _query(_BINNED, lambda e: e.matrix("gldm")),
        "gldm_features": _query(_BINNED, lambda e: e.family("gldm")),
        "gldm_near_levels": _query(_work(embedding_volumes, n_bins=BINS, gldm_a=1), lambda e: e.family("gldm")),
        "ngtdm_matrix": _query(_BINNED, lambda e: e.matrix("ngtdm")),
        "ngtdm_features": _query(_BINNED, lambda e: e.family("ngtdm")),
        "ngtdm_sparse": _query(_work(lineitem_volumes, labels=(1,), n_bins=BINS), lambda e: e.family("ngtdm")),
        "mesh_cells_2d": _query(_FLAT, lambda e: shape.cell_cases(e.rois, 2)),
        "mesh_metrics_2d": _query(_FLAT, lambda e: shape.mesh_metrics_2d(shape.scaled(shape.mesh_pieces(shape.cell_cases(e.rois, 2), 2), e.spacing, 2))),
        "diameter_2d": _query(_FLAT, lambda e: shape.diameters(shape.mesh_pieces(shape.cell_cases(e.rois, 2), 2), e.spacing, 2, "maximum_diameter")),
        "principal_axes_2d": _query(_FLAT, lambda e: shape.principal_axes_2d(e.rois, e.spacing)),
        "shape2d": _query(_FLAT, lambda e: e.family("shape2d")),
        "mesh_cells_3d": _query(_BINNED, lambda e: shape.cell_cases(e.rois, 3)),
        "mesh_metrics_3d": _query(_BINNED, lambda e: shape.mesh_metrics_3d(shape.scaled(shape.mesh_pieces(shape.cell_cases(e.rois, 3), 3), e.spacing, 3))),
        "diameter_3d": _query(_BINNED, lambda e: shape.diameters(shape.mesh_pieces(shape.cell_cases(e.rois, 3), 3), e.spacing, 3, "maximum_3d_diameter")),
        "principal_axes_3d": _query(_BINNED, lambda e: shape.principal_axes_3d(e.rois, e.spacing)),
        "shape3d": _query(_work(embedding_volumes, keep_largest_only=False), lambda e: e.family("shape3d")),
        "shape3d_largest": _query(_BINNED, lambda e: e.family("shape3d")),
        "diagnostics": _query(_BINNED, lambda e: e.diagnostics().select(*KEY, "diagnosis_Bin_width", "diagnosis_Number_of_bins", "diagnosis_Weighting_norm", "diagnosis_Keep_largest_only", "diagnosis_Dimensionality_of_image", *(F.array_join(c, "x").alias(c) for c in ("diagnosis_Voxel_spacing", "diagnosis_Image_size", "diagnosis_Image_size_cropped", "diagnosis_Mask_size", "diagnosis_Mask_size_cropped")))),
        "features_long": _query(_work(embedding_volumes, n_bins=BINS, features=("first_order", "ngtdm")), lambda e: e.long()),
        "extract_features": lambda s, d: rounded(extract_features(*embedding_volumes(s, d), features=["first_order", "gldm"], labels=[1, 2], n_bins=BINS).transform(lambda t: t.drop(*(c for c in t.columns if c.startswith("diagnosis_"))))),
        "features_json": lambda s, d: extract_features(*embedding_volumes(s, d), features="ngtdm", labels=1, n_bins=BINS).select(*KEY, F.to_json(F.struct("label_id", F.round("ngtdm_Contrast", 6).alias("ngtdm_Contrast"))).alias("features")),
    }
    for norm in ("infinity", "euclidean", "manhattan"):
        work = _work(lineitem_volumes, labels=(1,), n_bins=BINS, weighting_norm=norm)
        found[f"glcm_{norm}"] = _query(work, _glcm)
        found[f"glrlm_{norm}"] = _query(work, lambda e: zones.glrlm(e.matrix("glrlm")))
    return found
