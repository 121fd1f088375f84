"""Options, sources, sinks, edge cases and array cross-checks."""

import math
import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from roisight.api import Extraction, extract_features
from roisight.cli import main
from roisight.functions import KEY
from roisight.functions.mesh import cube_triangles, square_segments
from roisight.operators import connectivity, ngtdm, roi, shape
from roisight.plans.options import Options
from roisight.sinks import as_json, errors_json, report, write_features
from roisight.sources.nifti import parse_nifti, read_nifti, write_nifti
from roisight.sources.raster import from_numpy
from roisight.streaming import extract_stream


def cube(spark, labels=1):
    image = np.arange(1, 1001, dtype=float).reshape((10, 10, 10), order="F")
    mask = np.zeros((10, 10, 10), int)
    mask[2:7, 2:7, 2:7] = labels
    return from_numpy(spark, image, mask, [1, 1, 1])


def test_options():
    with pytest.raises(ValueError):
        Options(n_bins=3, bin_width=1.0)
    with pytest.raises(ValueError):
        Options(features=("nonsense",))
    with pytest.raises(ValueError):
        Options(slices_2d=((4, 1),))
    with pytest.raises(ValueError):
        Options(weighting_norm="unknown")
    assert "shape2d" not in Options(features="all").families and "shape3d" not in Options(ndim=2).families
    assert Options(features="GLCM").families == ("glcm",)
    assert Options(slices_2d=((1, 1),)).families[-1] == "shape2d"


def test_sources_reject_bad_input(spark):
    with pytest.raises(ValueError):
        from_numpy(spark, np.zeros((2, 2)), np.zeros((2, 3)), [1, 1])
    with pytest.raises(ValueError):
        from_numpy(spark, np.zeros((2, 2, 2)), np.ones((2, 2, 2)), [1, 1])
    with pytest.raises(ValueError):
        from_numpy(spark, np.zeros((2, 2)), np.full((2, 2), 0.5), [1, 1])
    with pytest.raises(ValueError):
        parse_nifti(b"short")


def test_discretize_rules(spark):
    image = np.array([[-30.0, -1.0, 0.0, 24.9, 25.0, 80.0]])
    voxels, images = from_numpy(spark, image, np.ones_like(image, dtype=int), [1, 1])
    rois = roi.whole_images(voxels)
    level = lambda **k: [r["g"] for r in roi.discretize(rois, **k).orderBy("y").collect()]
    assert level() == [1, 2, 3, 3, 4, 6]
    assert level(n_bins=2) == [1, 1, 1, 1, 2, 2]
    constant = roi.whole_images(voxels.withColumn("v", F.lit(7.0)))
    assert {r["g"] for r in roi.discretize(constant, n_bins=4).collect()} == {1}
    with pytest.raises(ValueError):
        roi.discretize(rois, 2, 2.0)


def test_missing_labels(spark):
    voxels, images = cube(spark)
    with pytest.raises(ValueError):
        extract_features(voxels, images, labels=5, features="ngtdm")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        rows = extract_features(voxels, images, labels=[1, 5], features="ngtdm").collect()
    assert [r["label"] for r in rows] == [1] and any("left out" in str(w.message) for w in told)
    assert rows[0]["diagnosis_Dimensionality_of_image"] == "3D"


def test_constant_and_single_voxel(spark):
    image, mask = np.full((3, 3, 3), 4.0), np.zeros((3, 3, 3), int)
    mask[1, 1, 1] = 1
    mask[0, :, :] = 2
    voxels, images = from_numpy(spark, image, mask, [1, 1, 2])
    e = Extraction(voxels, images, Options(labels=(1, 2), n_bins=4))
    first = {r["label"]: r for r in e.family("first_order").collect()}
    assert math.isnan(first[1]["standard_deviation"]) and math.isnan(first[2]["skewness"]) and first[2]["total_energy"] == 9 * 16 * 2
    assert [r["label"] for r in e.family("glcm").collect()] == [2]
    assert [r["label"] for r in e.matrix("ngtdm").collect()] == [2]
    assert {r["label"]: r["Coarseness"] for r in e.family("ngtdm").collect()} == {2: 1e6}
    assert {(r["label"], r["dep"]): r["n"] for r in e.matrix("gldm").collect()} == {(1, 1): 1, (2, 4): 4, (2, 6): 4, (2, 9): 1}
    flat = {r["label"]: r for r in e.family("shape3d").collect()}[2]
    assert math.isnan(flat["flatness"]) and flat["elongation"] > 0


def test_nan_is_an_error(spark):
    image = np.array([[1.0, float("nan")], [2.0, 3.0]])
    voxels, images = from_numpy(spark, image, np.ones((2, 2), int), [1, 1])
    with pytest.raises(Exception, match="NaN"):
        extract_features(voxels, images, features="first_order", ndim=2).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_agree(spark, seed):
    rng = np.random.default_rng(seed)
    image = rng.integers(1, 3, (7, 6, 5)).astype(float)
    mask = (rng.random((7, 6, 5)) < 0.6).astype(int)
    voxels, images = from_numpy(spark, image, mask, [1, 1, 1])
    levels = roi.discretize(roi.whole_images(voxels), n_bins=2)
    by_task = connectivity.zone_sizes(connectivity.label_components(levels, 3))
    spread = connectivity.zone_sizes(connectivity.label_components(levels, 3, local_voxels=0))
    sizes = lambda df: sorted((r["g"], r["size"]) for r in df.collect())
    seen, wanted = set(), []
    for start in zip(*np.nonzero(mask), strict=True):
        if start in seen:
            continue
        stack, size = [start], 0
        seen.add(start)
        while stack:
            at = stack.pop()
            size += 1
            for d in np.ndindex(3, 3, 3):
                near = tuple(int(a + b - 1) for a, b in zip(at, d, strict=True))
                if all(0 <= c < n for c, n in zip(near, mask.shape, strict=True)) and mask[near] and near not in seen and image[near] == image[at]:
                    seen.add(near)
                    stack.append(near)
        wanted.append((int(image[start]), size))
    assert sizes(by_task) == sizes(spread) == sorted(wanted)


def test_largest_component_ties_go_to_the_first(spark):
    mask = np.zeros((5, 5), int)
    mask[0, 0:2] = mask[3, 3:5] = 1
    voxels, images = from_numpy(spark, np.ones((5, 5)), mask, [1, 1])
    labelled = connectivity.label_components(roi.whole_images(voxels), 2, same_level=False)
    assert sorted((r["x"], r["y"]) for r in connectivity.largest_component(labelled).collect()) == [(1, 1), (1, 2)]
    assert connectivity.island_counts(labelled).first()["islands"] == 2


def test_mesh_tables_close():
    for case in range(256):
        edges = {}
        for t in cube_triangles(case):
            for a, b in zip(t, t[1:] + t[:1], strict=True):
                if sum(p == q and p in (0, 2) for p, q in zip(a, b, strict=True)) == 0:
                    edges[(a, b)] = edges.get((a, b), 0) + 1
        assert all(edges.get((b, a)) == n for (a, b), n in edges.items())
    assert not cube_triangles(0) and not cube_triangles(255) and len(square_segments(6)) == 2


def test_nifti_cli_and_sinks(spark, tmp_path):
    image = np.arange(1.0, 61.0).reshape(5, 4, 3)
    mask = np.ones((5, 4, 3), int)
    (tmp_path / "image.nii.gz").write_bytes(write_nifti(image, [2.0, 2.0, 3.0], compress=True))
    (tmp_path / "mask.nii").write_bytes(write_nifti(mask, [2.0, 2.0, 3.0]))
    values, spacing = parse_nifti((tmp_path / "image.nii.gz").read_bytes())
    assert np.array_equal(values, image) and spacing == (2.0, 2.0, 3.0)
    voxels, images = read_nifti(spark, [(3, str(tmp_path / "image.nii.gz"), str(tmp_path / "mask.nii"))])
    got = {(r["x"], r["y"], r["z"]): r["v"] for r in voxels.collect()}
    assert got == {(x + 1, y + 1, z + 1): image[x, y, z] for x, y, z in np.ndindex(image.shape)}
    assert images.first().asDict() == {"image_id": 3, "nx": 5, "ny": 4, "nz": 3, "sx": 2.0, "sy": 2.0, "sz": 3.0}
    main([str(tmp_path / "image.nii.gz"), str(tmp_path / "mask.nii"), "-o", str(tmp_path / "out"), "--features", "first_order", "--n_bins", "4", "--verbose", "false"], spark)
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["firstorder_maximum"] == "60.0"
    e = Extraction(voxels, images, Options(features=("ngtdm",), n_bins=4))
    assert '"ngtdm_Contrast"' in as_json(e.wide()).first()["json"] and "ngtdm_Busyness" in report(e.long())
    write_features(e.wide(), str(tmp_path / "parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    with pytest.raises(ValueError):
        write_features(e.wide(), str(tmp_path / "x"), "xml")


def test_slices_and_raw_matrices(spark):
    voxels, images = cube(spark)
    raw = extract_features(voxels, images, features=["glcm", "ngtdm", "shape2d"], n_bins=4, slices_2d=[(1, 4), (3, 4)], get_raw_matrices=True)
    assert set(raw) == {"glcm", "ngtdm", "shape2d"}
    total = {(r["plane"], r["dir"]): r["t"] for r in raw["glcm"].groupBy(*KEY, "dir").agg(F.sum("p").alias("t")).collect()}
    assert len(total) == 8 and all(abs(t - 1) < 1e-12 for t in total.values())


def test_stream(spark, tmp_path):
    voxels, images = cube(spark)
    voxels.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(voxels.schema).parquet(str(tmp_path / "in"))
    extract_stream(stream, images, lambda df, n: got.extend(df.collect()), str(tmp_path / "state"), features="ngtdm", n_bins=4).awaitTermination()
    assert len(got) == 1 and got[0]["ngtdm_Coarseness"] > 0


def nifti_pair(folder, name, image, mask):
    (folder / f"{name}.nii").write_bytes(write_nifti(image, [1, 1, 1]))
    (folder / f"{name}_mask.nii.gz").write_bytes(write_nifti(mask, [1, 1, 1], compress=True))
    return f"{name}.nii", f"{name}_mask.nii.gz"


def test_nifti_names_and_odd_files(spark, tmp_path):
    """Relative and absolute names, one mask for two images, an empty mask, lost and broken files."""
    rng = np.random.default_rng(1)
    image, mask = rng.normal(size=(4, 5, 6)), np.zeros((4, 5, 6), int)
    mask[1:3, 1:3, 1:3] = 1
    a, m = (str(tmp_path / n) for n in nifti_pair(tmp_path, "a", image, mask))
    b, zero = (str(tmp_path / n) for n in nifti_pair(tmp_path, "b", image, mask * 0))
    here = spark._jvm.java.lang.System.getProperty("user.dir")
    relative = os.path.relpath(a, here)
    voxels, images = read_nifti(spark, [(0, relative, m), (1, f"file://{a}", m), (2, b, zero)])
    assert {r["image_id"]: r["count"] for r in voxels.groupBy("image_id").count().collect()} == {0: 8, 1: 8}
    assert sorted((r["image_id"], r["nx"], r["ny"], r["nz"]) for r in images.collect()) == [(k, 4, 5, 6) for k in range(3)]
    with pytest.raises(ValueError, match="image 2"):
        extract_features(voxels, images, labels=1, features="ngtdm")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_nifti(spark, [(0, str(tmp_path / "none.nii"), m)])[0].count()
    (tmp_path / "bad.nii").write_bytes(b"no image")
    pairs = spark.createDataFrame([(0, a, m), (1, str(tmp_path / "bad.nii"), m)], "image_id long, image string, mask string")
    with pytest.raises(Exception, match="image 1: not a NIfTI-1 file"):
        read_nifti(spark, pairs)[1].collect()
    voxels, images = read_nifti(spark, pairs, on_error="report")
    assert voxels.select("image_id").distinct().count() == 1
    assert [(r["image_id"], r["json"]) for r in errors_json(images).collect()] == [(1, '{"error":"not a NIfTI-1 file: too short"}')]


def test_cli_writes_one_file(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    mask = np.zeros((5, 5, 5), int)
    mask[0, 0, 0], mask[2:5, 2:5, 2:5] = 1, 1
    image, marks = nifti_pair(tmp_path, "c", rng.normal(size=(5, 5, 5)), mask)
    out = tmp_path / "features.csv"
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        main([str(tmp_path / image), str(tmp_path / marks), "-o", str(out), "--features", "shape3d", "--n_bins", "4"], spark)
    assert out.is_file() and len(out.read_text().splitlines()) == 2
    assert any("2 islands, the largest of [27, 1]" in str(w.message) for w in told)
    assert "Dimensionality of image" in capsys.readouterr().out


def test_many_levels_and_vertices_in_parts(spark, monkeypatch):
    """Splitting a region's levels or vertices changes nothing."""
    rng = np.random.default_rng(3)
    image, mask = rng.normal(size=(9, 9, 9)), (rng.random((9, 9, 9)) < 0.6).astype(int)
    work = lambda: Extraction(*from_numpy(spark, image, mask, [1, 2, 3]), Options(labels=(1,), n_bins=30, keep_largest_only=False))
    whole = [work().family(f).first() for f in ("ngtdm", "shape3d")]
    monkeypatch.setattr(ngtdm, "PART_LEVELS", 4)
    monkeypatch.setattr(shape, "BLOCK_VERTICES", 7)
    for before, family in zip(whole, ("ngtdm", "shape3d"), strict=True):
        now = work().family(family).first()
        assert np.allclose([float(x) for x in before], [float(x) for x in now], rtol=1e-9)
    points = np.argwhere(mask) * [1, 2, 3]
    far = max(float(np.sqrt(((points - p) ** 2).sum(1)).max()) for p in points)
    assert far <= whole[1]["maximum_3d_diameter"] <= far + 2 * 3.75
