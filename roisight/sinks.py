"""Where features go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roisight.functions import KEY

FORMATS = ("csv", "parquet", "json")


def write_features(features: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite", single: bool = False) -> None:
    """One row per region; CSV has a header, and arrays in it are JSON.

    A folder with a file for each task, or with ``single`` one file of that name,
    which one task writes: for the few regions of single images.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    if single:
        return _write_one_file(features, path, kind, mode)
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in features.dtypes]
        features.select(*flat).write.mode(mode).csv(path, header=True)
    else:
        features.write.mode(mode).format(kind).save(path)


def _write_one_file(features: DataFrame, path: str, kind: str, mode: str) -> None:
    spark = features.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) and mode != "overwrite":
        raise FileExistsError(path)
    folder = f"{path}.{uuid.uuid4().hex}"
    write_features(features.coalesce(1), folder, kind)
    parts = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))
    files.delete(target, True)
    files.rename(parts[0].getPath(), target)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def errors_json(images: DataFrame) -> DataFrame:
    """(image_id, json): an object with the reason for each image that could not be read."""
    return images.where("error IS NOT NULL").select("image_id", F.to_json(F.struct("error")).alias("json"))


def as_json(features: DataFrame) -> DataFrame:
    """(region, json): all features of a region as one JSON object."""
    names = [c for c in features.columns if c not in KEY]
    return features.select(*KEY, F.to_json(F.struct(*names)).alias("json"))


def report(features_long: DataFrame, rows: int = 200) -> str:
    """A text table of (feature, value), by name; for a look at a few regions."""
    lines = [f"{r['feature']:<35} {r['value']}" for r in features_long.orderBy(*KEY, "feature").limit(rows).collect()]
    return "\n".join(lines)


def diagnostics_report(features: DataFrame, rows: int = 20) -> str:
    """The diagnostics of a few regions as text, one line each."""
    names = [c for c in features.columns if c.startswith("diagnosis_")]
    blocks = []
    for r in features.orderBy(*KEY).limit(rows).collect():
        blocks += [f"Region {tuple(r[k] for k in KEY)}", *(f"  {n.removeprefix('diagnosis_').replace('_', ' '):<32} {r[n]}" for n in names)]
    return "\n".join(blocks)
