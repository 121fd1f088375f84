"""Validated options of a feature extraction."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

#: The feature families and the weighting norms.
FAMILIES = ("first_order", "glcm", "glrlm", "glszm", "gldm", "ngtdm", "shape2d", "shape3d")
NORMS = ("infinity", "euclidean", "manhattan", "no_weighting")
#: Bin width where neither a width nor a number of bins is given.
DEFAULT_BIN_WIDTH = 25.0


@dataclass(frozen=True)
class Options:
    features: tuple[str, ...] = ()
    labels: tuple[int, ...] = (1,)
    many_labels: bool = False
    n_bins: int | None = None
    bin_width: float | None = None
    weighting_norm: str | None = None
    keep_largest_only: bool = True
    slices_2d: tuple[tuple[int, int], ...] = ()
    gldm_a: int = 0
    ndim: int = 3
    families: tuple[str, ...] = field(default=(), init=False)

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        named = [self.features] if isinstance(self.features, str) else list(self.features)
        named = [str(f).lower() for f in named]
        if unknown := [f for f in named if f not in (*FAMILIES, "all")]:
            raise ValueError(f"unknown feature families: {', '.join(unknown)}")
        put("features", tuple(named))
        labels = 1 if self.labels is None else self.labels
        put("many_labels", self.many_labels or isinstance(labels, (list, tuple, set)) and len(labels) > 1)
        put("labels", tuple(int(x) for x in labels) if isinstance(labels, Iterable) else (int(labels),))
        if self.n_bins is not None and self.bin_width is not None:
            raise ValueError("give n_bins or bin_width, not both")
        if self.n_bins is not None and int(self.n_bins) < 1 or self.bin_width is not None and not self.bin_width > 0:
            raise ValueError("n_bins and bin_width must be positive")
        if self.weighting_norm is not None and self.weighting_norm not in NORMS:
            raise ValueError(f"unknown weighting norm: {self.weighting_norm}")
        if self.ndim not in (2, 3):
            raise ValueError("images have 2 or 3 dimensions")
        slices = tuple((int(p), int(i)) for p, i in self.slices_2d or ())
        if any(p not in (1, 2, 3) for p, _ in slices):
            raise ValueError("planes are 1, 2 or 3")
        if slices and self.ndim != 3:
            raise ValueError("slices are cut from 3D images")
        put("slices_2d", slices)
        shape, other = ("shape2d", "shape3d") if self.roi_ndim == 2 else ("shape3d", "shape2d")
        chosen = FAMILIES if not named or "all" in named else named
        put("families", tuple(f for f in FAMILIES if f in chosen and f != other))

    @property
    def roi_ndim(self) -> int:
        return 2 if self.slices_2d else self.ndim
