"""Feature extraction over any number of images, labels and slices at once."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roisight.functions import KEY
from roisight.operators import connectivity, first_order, glcm, lines, ngtdm, roi, shape, zones
from roisight.operators.diagnostics import diagnostics
from roisight.plans.options import Options


@dataclass
class Extraction:
    """A lazy plan: each property is a DataFrame over all regions; only what is asked for is computed."""

    voxels: DataFrame
    images: DataFrame
    options: Options

    @cached_property
    def rois(self) -> DataFrame:
        return roi.regions(self.voxels, self.options)

    @cached_property
    def spacing(self) -> DataFrame:
        return roi.spacings(self.images, self.options.slices_2d)

    @cached_property
    def levels(self) -> DataFrame:
        return roi.discretize(self.rois, self.options.n_bins, self.options.bin_width)

    @cached_property
    def lines(self) -> DataFrame:
        return lines.along_lines(self.levels, self.options.roi_ndim)

    @cached_property
    def neighbourhoods(self) -> DataFrame:
        return lines.neighbourhoods(self.lines, self.options.gldm_a)

    def matrix(self, family: str) -> DataFrame:
        """The sparse matrix behind a texture family."""
        o = self.options
        if family == "glcm":
            return glcm.glcm_matrix(lines.pair_counts(self.lines), self.spacing, o.weighting_norm, o.roi_ndim)
        if family == "glrlm":
            return zones.glrlm_matrix(lines.run_counts(self.lines), self.spacing, o.weighting_norm, o.roi_ndim)
        if family == "glszm":
            return zones.glszm_matrix(connectivity.zone_sizes(connectivity.label_components(self.levels, o.roi_ndim)))
        if family == "gldm":
            return lines.dependence_counts(self.neighbourhoods)
        if family == "ngtdm":
            return lines.tone_differences(self.neighbourhoods)
        raise ValueError(f"no matrix for {family}")

    def family(self, name: str) -> DataFrame:
        """One row per region with a family's features, without prefix."""
        if name == "first_order":
            return first_order.first_order(self.levels, self.spacing)
        if name in ("shape2d", "shape3d"):
            return self._shape(name)
        matrix = self.matrix(name)
        if name == "glcm":
            return glcm.glcm(matrix, self.levels)
        return {"glrlm": zones.glrlm, "glszm": zones.glszm, "gldm": zones.gldm, "ngtdm": ngtdm.ngtdm}[name](matrix)

    def _shape(self, name: str) -> DataFrame:
        voxels, islands = self.rois.select(*KEY, *"xyz"), None
        if self.options.keep_largest_only:
            labelled = connectivity.label_components(voxels, self.options.roi_ndim, same_level=False)
            islands = connectivity.island_counts(labelled)
            if name == "shape3d":
                voxels = connectivity.largest_component(labelled).select(*KEY, *"xyz")
        return (shape.shape3d if name == "shape3d" else shape.shape2d)(voxels, self.spacing, islands)

    def long(self) -> DataFrame:
        """Rows (region, family, feature, value); names carry their family's prefix."""
        out = None
        for family in self.options.families:
            wide = self.family(family)
            names = [c for c in wide.columns if c not in KEY]
            prefix = "firstorder" if family == "first_order" else family
            pairs = F.array(*(F.struct(F.lit(f"{prefix}_{n}").alias("feature"), F.col(n).cast("double").alias("value")) for n in names))
            part = wide.select(*KEY, F.lit(family).alias("family"), F.explode(pairs).alias("f")).select(*KEY, "family", "f.*")
            out = part if out is None else out.unionByName(part)
        return out

    def wide(self) -> DataFrame:
        """One row per region, one column per feature; a family without a value for a region is null there."""
        out = self.rois.select(*KEY).distinct()
        for family in self.options.families:
            part = self.family(family)
            prefix = "firstorder" if family == "first_order" else family
            named = part.select(*KEY, *(F.col(c).alias(f"{prefix}_{c}") for c in part.columns if c not in KEY))
            out = out.join(named, KEY, "left")
        return out.withColumn("label_id", F.col("label"))

    def diagnostics(self) -> DataFrame:
        return diagnostics(self.rois, self.images, self.spacing, self.options)

    def missing(self) -> DataFrame:
        return roi.missing_labels(self.voxels, self.images, self.options.labels)


def extract_features(voxels: DataFrame, images: DataFrame, *, features=(), labels=None, n_bins=None, bin_width=None, weighting_norm=None, keep_largest_only=True,
                     slices_2d=None, gldm_a=0, ndim=3, get_raw_matrices=False, verbose=False):
    """Features of all regions in one wide DataFrame; with ``get_raw_matrices`` a dict of DataFrames instead.

    ``voxels``: image_id, x, y, z, v, label; ``images``: image_id, nx, ny, nz, sx, sy, sz.
    A single requested label that an image lacks is an error; of several labels
    those that are missing are left out with a warning.  With several labels, or
    ``verbose``, diagnostics are joined on.
    """
    begun = time.time()
    options = Options(features, labels, isinstance(labels, (list, tuple, set)), n_bins, bin_width, weighting_norm, keep_largest_only, tuple(slices_2d or ()), gldm_a, ndim)
    work = Extraction(voxels, images, options)
    missing = work.missing().limit(5).collect()
    if missing and not options.many_labels:
        raise ValueError(f"label {options.labels[0]} not found in image {missing[0]['image_id']}")
    if missing:
        warnings.warn(f"labels without voxels are left out: {[(r['image_id'], r['label']) for r in missing]} ...", stacklevel=2)
    if bin_width is not None and (few := roi.few_bins(work.rois, float(bin_width)).limit(1).collect()):
        warnings.warn(f"bin_width {bin_width} gives fewer than 3 bins, as in image {few[0]['image_id']}", stacklevel=2)
    if verbose and keep_largest_only and options.families and {"shape2d", "shape3d"} & {*options.families}:
        labelled = connectivity.label_components(work.rois.select(*KEY, *"xyz"), options.roi_ndim, same_level=False)
        for r in connectivity.island_sizes(labelled).limit(5).collect():
            warnings.warn(f"image {r['image_id']}, label {r['label']}: {r['islands']} islands, the largest of {r['sizes']} voxels", stacklevel=2)
    if get_raw_matrices:
        raw = {f: work.matrix(f) for f in options.families if f in ("glcm", "glrlm", "glszm", "gldm", "ngtdm")}
        return raw | {f: work.family(f) for f in options.families if f not in raw}
    out = work.wide()
    if verbose or options.many_labels:
        out = out.join(work.diagnostics(), KEY, "left").withColumn("diagnosis_Planning_seconds", F.lit(time.time() - begun))
    return out
