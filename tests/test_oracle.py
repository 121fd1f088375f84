"""Image feature queries against their SQL on the smallest tables."""

import compare
import pytest

from roisight import oracle, queries

SMALL = "/root/testdata/sf0.001"
CHOSEN = ["missing_labels", "slice_2d", "discretize_bin_width", "first_order", "glcm_features", "glrlm_no_weighting", "glszm_features", "gldm_near_levels", "ngtdm_sparse", "shape2d", "glcm_euclidean", "features_long"]


@pytest.mark.parametrize("name", CHOSEN)
def test_rows(spark, name):
    compare.same_rows(spark, queries.queries()[name], oracle.oracle_sql()[name], SMALL)


def test_names():
    assert set(oracle.oracle_sql()) <= set(queries.queries())
