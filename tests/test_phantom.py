"""All published values of the phantom."""

import phantom
import pytest

from roisight.api import extract_features
from roisight.sources.raster import from_numpy


@pytest.mark.parametrize("slices,values", [(None, phantom.VALUES_3D), ([(3, 3)], phantom.VALUES_2D)], ids=["3d", "2d"])
def test_published_values(spark, slices, values):
    image, mask = phantom.phantom()
    voxels, images = from_numpy(spark, image, mask, [2.0, 2.0, 2.0])
    rows = extract_features(voxels, images, n_bins=6, keep_largest_only=False, slices_2d=slices).collect()
    assert len(rows) == 1
    got = rows[0].asDict()
    assert len([c for c in got if "_" in c and c.split("_")[0] in {"firstorder", "glcm", "glrlm", "glszm", "gldm", "ngtdm", "shape2d", "shape3d"}]) == len(values)
    wrong = [(f, got[f], v) for f, v, tolerance in values if not phantom.agrees(got[f], v, tolerance)]
    assert not wrong
    exact = [f for f, v, _ in values if slices and abs(got[f] - v) > 1e-9 * max(1, abs(v))]
    assert not exact
