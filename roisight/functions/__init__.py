"""Column functions and names shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A region of interest: image, label, and the slice it was cut from (0, 0: the whole image).
KEY = ["image_id", "label", "plane", "slice_idx"]
#: Guards in logarithms, as fixed by the feature definitions.
EPS_FIRST_ORDER = 2.2204460492503131e-16
EPS_GLCM = 2.2e-16
EPS_RUNS = 1e-16


def entropy_term(p: Column, q: Column, eps: float) -> Column:
    return -F.sum(p * F.log2(q + F.lit(eps)))


def half_directions(ndim: int) -> list[tuple[int, int, int]]:
    """One of each pair of opposite neighbour offsets: the first non-zero part is positive."""
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in ((-1, 0, 1) if ndim == 3 else (0,))]
    return [d for d in steps if next((c for c in d if c), 0) > 0]
