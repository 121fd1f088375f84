"""NIfTI-1 files as voxel tables: binary files are parsed in Arrow batches, one image to a row."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: NIfTI-1 datatype codes.
DATATYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_HEADER = 348


def parse_nifti(raw: bytes) -> tuple[np.ndarray, tuple[float, ...]]:
    """The array, indexed (x, y[, z]) with scaling applied, and its spacing."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) < _HEADER + 4:
        raise ValueError("not a NIfTI-1 file: too short")
    order = next((o for o in "<>" if struct.unpack(f"{o}i", raw[:4])[0] == _HEADER), None)
    if order is None or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file: bad header")
    dims = struct.unpack(f"{order}8h", raw[40:56])
    code = struct.unpack(f"{order}h", raw[70:72])[0]
    spacing = struct.unpack(f"{order}8f", raw[76:108])[1:4]
    start, slope, shift = struct.unpack(f"{order}3f", raw[108:120])
    if code not in DATATYPES:
        raise ValueError(f"NIfTI datatype {code} is not supported")
    shape = [n for n in dims[1 : 1 + dims[0]]]
    while len(shape) > 2 and shape[-1] == 1:
        shape.pop()
    if len(shape) not in (2, 3):
        raise ValueError("images have 2 or 3 dimensions")
    kind = np.dtype(DATATYPES[code]).newbyteorder(order)
    flat = np.frombuffer(raw, kind, int(np.prod(shape)), int(start))
    values = flat.reshape(shape, order="F")
    if slope not in (0.0, 1.0) or shift:
        values = values * (slope or 1.0) + shift
    return np.asarray(values), tuple(float(abs(s)) for s in spacing[: len(shape)])


def write_nifti(values: np.ndarray, spacing, compress: bool = False) -> bytes:
    """A minimal NIfTI-1 file of doubles or 32-bit integers."""
    values = np.asarray(values)
    code, kind = (8, "<i4") if values.dtype.kind in "iub" else (64, "<f8")
    head = bytearray(_HEADER + 4)
    struct.pack_into("<i", head, 0, _HEADER)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *([1] * (7 - values.ndim)))
    struct.pack_into("<2h", head, 70, code, np.dtype(kind).itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, *([1.0] * (7 - len(spacing))))
    struct.pack_into("<3f", head, 108, float(_HEADER + 4), 1.0, 0.0)
    head[344:348] = b"n+1\0"
    raw = bytes(head) + values.astype(kind).tobytes(order="F")
    return gzip.compress(raw) if compress else raw


VOXELS = "image_id long, x int, y int, z int, v double, label int"
IMAGES = "image_id long, nx int, ny int, nz int, sx double, sy double, sz double, error string"


def _checked(image_raw: bytes, mask_raw: bytes) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    image, spacing = parse_nifti(image_raw)
    mask, _ = parse_nifti(mask_raw)
    if image.shape != mask.shape:
        raise ValueError("image and mask have different shapes")
    return image, mask, spacing


def _voxels(report: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, image_raw, mask_raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                try:
                    image, mask, _ = _checked(image_raw.as_py(), mask_raw.as_py())
                except ValueError as e:
                    if report:
                        continue
                    raise ValueError(f"image {image_id}: {e}") from e
                at = np.argwhere(mask != 0)
                for lo in range(0, len(at), 1_000_000):
                    some = at[lo : lo + 1_000_000]
                    index, n = tuple(some.T), len(some)
                    coordinates = [some[:, k] + 1 if k < image.ndim else np.ones(n) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, image_id.as_py()), pa.int64()), *(pa.array(c.astype(np.int32)) for c in coordinates), pa.array(image[index].astype(float)), pa.array(np.round(mask[index]).astype(np.int32))],
                        names=[f.split()[0] for f in VOXELS.split(", ")],
                    )

    return run


def _images(report: bool):
    """A row for each image, whether its mask marks any voxel or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image_id, image_raw, mask_raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                try:
                    image, _, spacing = _checked(image_raw.as_py(), mask_raw.as_py())
                    rows.append([image_id.as_py(), *[*image.shape, 1][:3], *[*spacing, 1.0][:3], None])
                except ValueError as e:
                    if not report:
                        raise ValueError(f"image {image_id}: {e}") from e
                    rows.append([image_id.as_py(), *[None] * 6, str(e)])
            types = (pa.int64(), *[pa.int32()] * 3, *[pa.float64()] * 3, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[f.split()[0] for f in IMAGES.split(", ")])

    return run


def _qualified(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Each path as Spark lists it: relative ones start at the working folder of the default file system."""
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), {}
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        out[p] = where.getFileSystem(conf).makeQualified(where).toString()
    return out


def read_nifti(spark: SparkSession, pairs: list[tuple[int, str, str]] | DataFrame, *, on_error: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(voxels, images) from (image_id, image path, mask path) rows; files may be gzipped and lie in any store Spark reads.

    Every pair gives a row of ``images``, also one whose mask is all zero; a path
    without a file raises.  With ``on_error="report"`` a file that cannot be read as
    an image gives a row with the reason in ``error`` instead of an exception.
    """
    if on_error not in ("raise", "report"):
        raise ValueError("on_error is raise or report")
    listed = [(r["image_id"], r["image"], r["mask"]) for r in pairs.select("image_id", "image", "mask").collect()] if isinstance(pairs, DataFrame) else list(pairs)
    known = _qualified(spark, sorted({p for _, *two in listed for p in two}))
    names = spark.createDataFrame([(i, known[a], known[b]) for i, a, b in listed], "image_id long, image string, mask string")
    files = spark.read.format("binaryFile").load(sorted({*known.values()})).select(F.col("path").alias("file"), "content") if listed else spark.createDataFrame([], "file string, content binary")
    one = names.join(files.withColumnRenamed("content", "a"), F.col("image") == F.col("file"), "left").drop("file")
    both = one.join(files.withColumnRenamed("content", "b"), F.col("mask") == F.col("file"), "left").drop("file")
    lost = F.raise_error(F.concat(F.lit("no file was read for image "), F.col("image_id").cast("string"))).cast("binary")
    held = both.select("image_id", F.coalesce("a", lost).alias("a"), F.coalesce("b", lost).alias("b"))
    report = on_error == "report"
    images = held.mapInArrow(_images(report), IMAGES)
    return held.mapInArrow(_voxels(report), VOXELS), images if report else images.drop("error")
