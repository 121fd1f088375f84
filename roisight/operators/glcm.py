"""Co-occurrence features from sparse pair counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roisight.functions import EPS_GLCM, KEY, entropy_term, half_directions
from roisight.operators.roi import direction_weight

NAMES = (
    "Autocorrelation", "ClusterProminence", "ClusterShade", "ClusterTendency", "Contrast", "Correlation", "JointEnergy", "JointEntropy", "Idm", "Idmn", "Id", "Idn",
    "InverseVariance", "MaximumProbability", "DifferenceAverage", "DifferenceEntropy", "DifferenceVariance", "SumAverage", "SumEntropy", "SumSquares", "JointAverage",
    "Imc1", "Imc2", "Mcc",
)
_DIR = [*KEY, "dir"]


def weights_by_direction(norm: str, ndim: int):
    """A column over ``dir`` and spacing columns: the length of each direction."""
    out = F.lit(None).cast("double")
    for k, d in enumerate(half_directions(ndim)):
        out = F.when(F.col("dir") == k, direction_weight(norm, F.col("sx"), F.col("sy"), F.col("sz"), *d, ndim)).otherwise(out)
    return out


def glcm_matrix(pairs: DataFrame, spacing: DataFrame | None = None, norm: str | None = None, ndim: int = 3) -> DataFrame:
    """Joint probabilities (region, dir, i, j, p).

    Each direction by itself; or, under a norm, one matrix (dir -1) of all
    directions weighted by exp of minus the squared length.
    """
    counts = pairs.withColumn("n", F.col("n").cast("double"))
    if norm not in (None, "no_weighting"):
        length = weights_by_direction(norm, ndim)
        weighted = counts.join(spacing, ["image_id", "plane"]).withColumn("n", F.col("n") * F.exp(-length * length))
        counts = weighted.groupBy(*KEY, "i", "j").agg(F.sum("n").alias("n")).withColumn("dir", F.lit(-1))
    whole = F.sum("n").over(Window.partitionBy(*_DIR))
    return counts.select(*_DIR, "i", "j", (F.col("n") / whole).alias("p"))


def level_spans(levels: DataFrame) -> DataFrame:
    """By region: how many levels occur, and how far they span."""
    seen = levels.select(*KEY, "g").distinct()
    return seen.groupBy(*KEY).agg(F.count("*").alias("ng"), (F.max("g") - F.min("g") + 1).alias("span"))


def correlation_coefficients(matrix: DataFrame, spans: DataFrame) -> DataFrame:
    """The second largest absolute eigenvalue of p / sqrt(px py), for each matrix; a few hundred levels at most."""
    rows = matrix.join(spans.select(*KEY, "ng"), KEY)
    types = {"image_id": pa.int64(), **{k: pa.int32() for k in ("label", "plane", "slice_idx", "dir")}}

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j, p = (table.column(c).to_numpy() for c in ("i", "j", "p"))
        names = np.unique(np.concatenate([i, j]))
        full = np.zeros((len(names), len(names)))
        full[np.searchsorted(names, i), np.searchsorted(names, j)] = p
        px = full.sum(1)
        scale = np.where(px > EPS_GLCM, 1 / np.sqrt(np.maximum(px, 1e-300)), 0.0)
        size = np.sort(np.abs(np.linalg.eigvalsh(scale[:, None] * full * scale[None, :])))
        many = table.column("ng")[0].as_py()
        value = 1.0 if many < 2 else (float(size[-2]) if len(size) > 1 else 0.0)
        return pa.table([*(pa.array([k.as_py()], t) for k, t in zip(key, types.values(), strict=True)), pa.array([value])], names=[*types, "Mcc"])

    return rows.groupBy(*_DIR).applyInArrow(solve, "image_id long, label int, plane int, slice_idx int, dir int, Mcc double")


def glcm_by_direction(matrix: DataFrame, spans: DataFrame) -> DataFrame:
    """All features but Mcc for each matrix: windows over one hash exchange, then one aggregate."""
    own = Window.partitionBy(*_DIR)
    part = lambda *c: Window.partitionBy(*_DIR, *c)
    i, j, p = F.col("i").cast("double"), F.col("j").cast("double"), F.col("p")
    rows = matrix.join(spans, KEY).withColumn("d", F.abs(F.col("i") - F.col("j"))).withColumn("k", F.col("i") + F.col("j"))
    rows = rows.withColumn("mu", F.sum(i * p).over(own)).withColumn("px", F.sum(p).over(part("i"))).withColumn("py", F.sum(p).over(part("j")))
    rows = rows.withColumn("pd", F.sum(p).over(part("d"))).withColumn("ps", F.sum(p).over(part("k")))
    mu, d, k, span = F.col("mu"), F.col("d").cast("double"), F.col("k").cast("double"), F.col("span").cast("double")
    s = k - 2 * mu
    log = lambda q: F.log2(q + F.lit(EPS_GLCM))
    made = rows.groupBy(*_DIR).agg(
        F.sum(i * j * p).alias("Autocorrelation"), F.sum(s * s * s * s * p).alias("ClusterProminence"), F.sum(s * s * s * p).alias("ClusterShade"), F.sum(s * s * p).alias("ClusterTendency"),
        F.sum(d * d * p).alias("Contrast"), F.sum((i - mu) * (j - mu) * p).alias("cov"), F.sum((i - mu) * (i - mu) * p).alias("SumSquares"), F.sum(p * p).alias("JointEnergy"),
        entropy_term(p, p, EPS_GLCM).alias("JointEntropy"), F.sum(p / (1 + d * d)).alias("Idm"), F.sum(p / (1 + (d / span) * (d / span))).alias("Idmn"), F.sum(p / (1 + d)).alias("Id"),
        F.sum(p / (1 + d / span)).alias("Idn"), F.coalesce(F.sum(F.when(d > 0, p / (d * d))), F.lit(0.0)).alias("InverseVariance"), F.max(p).alias("MaximumProbability"),
        F.sum(d * p).alias("DifferenceAverage"), (-F.sum(p * log(F.col("pd")))).alias("DifferenceEntropy"), F.sum(k * p).alias("SumAverage"), (-F.sum(p * log(F.col("ps")))).alias("SumEntropy"),
        F.max(mu).alias("JointAverage"), (-F.sum(p * log(F.col("px")))).alias("hx"), (-F.sum(p * log(F.col("px") * F.col("py")))).alias("hxy1"),
    )
    hx, hxy, da = F.col("hx"), F.col("JointEntropy"), F.col("DifferenceAverage")
    return (
        made.withColumn("Correlation", F.when(F.col("SumSquares") == 0, 0.0).otherwise(F.try_divide("cov", "SumSquares")))
        .withColumn("DifferenceVariance", F.col("Contrast") - da * da)
        .withColumn("Imc1", F.when(hx > 0, F.try_divide(hxy - F.col("hxy1"), hx)).otherwise(0.0))
        .withColumn("Imc2", F.when(2 * hx > hxy, F.sqrt(1 - F.exp(-2 * (2 * hx - hxy)))).otherwise(0.0))
        .drop("cov", "hx", "hxy1")
    )


def glcm(matrix: DataFrame, levels: DataFrame, mcc: bool = True) -> DataFrame:
    """Means over directions; regions without any pair have no row."""
    spans = level_spans(levels)
    by_direction = glcm_by_direction(matrix, spans)
    if mcc:
        by_direction = by_direction.join(correlation_coefficients(matrix, spans), _DIR)
    names = [n for n in NAMES if mcc or n != "Mcc"]
    return by_direction.groupBy(*KEY).agg(*(F.avg(n).alias(n) for n in names))
