"""Command line: features of one image and mask."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from roisight.api import extract_features
from roisight.sinks import FORMATS, diagnostics_report, write_features
from roisight.sources.nifti import read_nifti


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="roisight", description=__doc__)
    p.add_argument("image")
    p.add_argument("mask")
    p.add_argument("--output", "-o", default="features.csv")
    p.add_argument("--format", choices=FORMATS, default="csv")
    p.add_argument("--features", nargs="*", default=[])
    p.add_argument("--labels", nargs="*", type=int)
    p.add_argument("--slices", nargs="*", default=[], metavar="PLANE:INDEX")
    p.add_argument("--n_bins", type=int)
    p.add_argument("--bin_width", type=float)
    p.add_argument("--weighting_norm")
    p.add_argument("--keep_largest_only", type=_flag, default=True)
    p.add_argument("--get_raw_matrices", action="store_true")
    p.add_argument("--verbose", type=_flag, default=True)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("roisight").getOrCreate()
    voxels, images = read_nifti(spark, [(0, a.image, a.mask)])
    flat = images.select("nz").first()["nz"] == 1
    labels = None if not a.labels else a.labels if len(a.labels) > 1 else a.labels[0]
    slices = [tuple(map(int, s.split(":"))) for s in a.slices]
    out = extract_features(voxels, images, features=a.features, labels=labels, n_bins=a.n_bins, bin_width=a.bin_width, weighting_norm=a.weighting_norm, ndim=2 if flat else 3,
                           keep_largest_only=a.keep_largest_only, slices_2d=slices, get_raw_matrices=a.get_raw_matrices, verbose=a.verbose)
    for name, table in out.items() if isinstance(out, dict) else [("", out)]:
        write_features(table, f"{a.output}/{name}" if name else a.output, a.format, single=not name and a.format != "parquet")
    if a.verbose and not isinstance(out, dict):
        print(diagnostics_report(out))


if __name__ == "__main__":
    main()
