import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import errors
from rasterloom.cube import Grid
from rasterloom.functions import logic, maths, reducers
from rasterloom.operators import combine, imagery, pixels, resample, spatial, temporal

A = {"2024-01-01": {"a": [[1, 2], [3, None]]}, "2024-01-02": {"a": [[5, 6], [7, 8]]}}


def test_merge_times_and_overlap(make, image):
    b = make({"2024-01-02": {"a": [[10, 20], [None, 40]]}, "2024-01-03": {"a": [[1, 1], [1, 1]]}})
    out = combine.merge_cubes(make(A), b, lambda x, y, _: x + y)
    assert image(out, "2024-01-01")["a"] == [[1, 2], [3, None]]
    assert image(out, "2024-01-02")["a"] == [[15, 26], [None, 48]]
    assert image(out, "2024-01-03")["a"] == [[1, 1], [1, 1]]
    with pytest.raises(errors.OverlapResolverMissing):
        combine.merge_cubes(make(A), b)


def test_merge_bands(make, image):
    out = combine.merge_cubes(make(A), make({"2024-01-02": {"b": [[1, 2], [3, 4]]}}))
    assert out.bands == ("a", "b")
    assert image(out, "2024-01-01")["b"] == [[None, None], [None, None]]
    assert image(out, "2024-01-02") == {"a": [[5, 6], [7, 8]], "b": [[1, 2], [3, 4]]}


def test_mask(make, image):
    m = make({"2024-01-01": {"m": [[0, 1], [None, 1]]}})
    out = combine.mask(make(A), m, -1)
    assert image(out, "2024-01-01")["a"] == [[1, -1], [3, None]]
    assert image(out, "2024-01-02")["a"] == [[5, -1], [7, -1]]
    assert image(combine.mask(make(A), m), "2024-01-02")["a"] == [[5, None], [7, None]]
    with pytest.raises(errors.IncompatibleDataCubes):
        combine.mask(make(A), make({"2024-01-01": {"m": [[0, 1], [1, 1]], "n": [[0, 1], [1, 1]]}}))
    with pytest.raises(errors.IncompatibleDataCubes):
        combine.mask(make(A), make({"2024-01-01": {"m": [[0]]}, "2024-01-05": {"m": [[0]]}}, bounds=(0.0, 0.0, 2.0, 2.0)))
    with pytest.raises(errors.IncompatibleDataCubes):
        combine.mask(make(A), make({"2024-01-01": {"m": [[0, 1], [1, 1]]}}, bounds=(9.0, 0.0, 11.0, 2.0)))


def test_coarse_mask_is_resized(make, image):
    m = make({"2024-01-01": {"m": [[1, 0]]}}, bounds=(0.0, 0.0, 2.0, 2.0))
    assert image(combine.mask(make(A), m), "2024-01-02")["a"] == [[None, 6], [None, 8]]


def _square(w, s, e, n):
    return {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}


def test_mask_polygon(make, image):
    left = _square(0, 0, 1, 2)
    assert image(spatial.mask_polygon(make(A), left), "2024-01-02")["a"] == [[5, None], [7, None]]
    assert image(spatial.mask_polygon(make(A), left, 0, inside=True), "2024-01-01")["a"] == [[0, 2], [0, None]]
    assert spatial.mask_polygon(make(A), {"type": "FeatureCollection", "features": []}).df.count() == 8
    holed = {"type": "Polygon", "coordinates": [_square(0, 0, 2, 2)["coordinates"][0], _square(0, 0, 1, 1)["coordinates"][0]]}
    assert image(spatial.mask_polygon(make(A), holed), "2024-01-02")["a"] == [[5, 6], [None, 8]]


def test_aggregate_spatial_counts_touched_cells(make):
    shapes = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": _square(0.9, 0.9, 1.1, 1.1)}, {"type": "Feature", "properties": {}, "geometry": _square(50, 50, 51, 51)}]}
    rows = spatial.aggregate_spatial(make(A), shapes, lambda s, _: reducers.mean(s))
    found = {(r["feature_index"], r["t"].day): (r["value"], r["total_count"], r["valid_count"]) for r in rows.collect()}
    assert found == {(0, 1): (2, 4, 3), (0, 2): (6.5, 4, 4)}
    doc = spatial.feature_collection(rows, shapes, "n")
    assert len(doc["features"]) == 1
    assert doc["features"][0]["properties"]["values"]["2024-01-02T00:00:00"] == {"value": 6.5, "total_count": 4, "valid_count": 4}


def test_labels(make):
    c = make({"2024-01-01": {"a": [[1]], "b": [[2]]}})
    assert pixels.rename_labels(c, "bands", ["x", "y"]).bands == ("x", "y")
    assert pixels.rename_labels(c, "bands", ["z"], ["b"]).bands == ("a", "z")
    with pytest.raises(errors.LabelMismatch):
        pixels.rename_labels(c, "bands", ["x"])
    with pytest.raises(errors.LabelExists):
        pixels.rename_labels(c, "bands", ["a"], ["b"])
    with pytest.raises(errors.LabelNotAvailable):
        pixels.rename_labels(c, "bands", ["q"], ["nope"])
    with pytest.raises(errors.DimensionExists):
        pixels.add_dimension(c, "bands", "q", "bands")
    assert len(pixels.add_dimension(c, "t", "2025-01-01", "temporal").labels()) == 2
    with pytest.raises(IndexError):
        pixels.array_element_of_cube(c, 5)
    with pytest.raises(errors.ProcessParameterInvalid):
        pixels.image_indexes(c, [0])


def test_indices(make, image):
    c = make({"2024-01-01": {"B4_b1": [[1, 0]], "B8_b1": [[3, 0]]}})
    assert image(pixels.ndvi(c, "b8", "B4"))["ndvi"] == [[0.5, None]]
    assert pixels.ndvi(c, 2, "1", "v").bands == ("B4_b1", "B8_b1", "v")
    for wrong in (True, 3, "B9"):
        with pytest.raises(errors.ProcessParameterInvalid):
            pixels.ndvi(c, wrong, 1)


def test_resampling(make, image):
    c = make({"2024-01-01": {"a": [[1, 2, 3, 4], [5, 6, 7, None]]}})
    half = Grid(2, 1, c.grid.bounds)
    assert image(resample.to_grid(c, half, "average"))["a"] == [[3.5, 14 / 3]]
    assert image(resample.to_grid(c, half, "sum"))["a"] == [[14, 14]]
    twice = resample.to_grid(c, Grid(8, 4, c.grid.bounds), "near")
    assert image(twice)["a"][0] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert resample.resample_spatial(c) is c
    for method in ("bilinear", "cubic", "cubicspline", "lanczos"):
        flat = pixels.apply(c, lambda v, _: F.when(v.isNotNull(), 7.0))
        seen = image(resample.to_grid(flat, Grid(8, 4, c.grid.bounds), method))["a"]
        assert all(abs(v - 7) < 1e-9 for row in seen for v in row if v is not None)
    with pytest.raises(errors.ProcessParameterInvalid):
        resample.to_grid(c, half, "best")


def test_reprojection_round_trip(make, image):
    c = make({"2024-01-01": {"a": [[1, 2], [3, 4]]}})
    there = resample.resample_spatial(c, projection=3857)
    assert there.grid.crs == 3857
    assert image(resample.resample_cube_spatial(there, c))["a"] == [[1, 2], [3, 4]]
    with pytest.raises(errors.FeatureUnsupported):
        resample.resample_spatial(c, projection=2154)


def test_hillshade_against_numpy(make, image):
    rng = np.random.default_rng(1)
    z = rng.uniform(0, 50, (9, 10))
    x, y = np.gradient(z)
    slope, aspect = np.pi / 2 - np.arctan(np.hypot(x, y)), np.arctan2(-x, y)
    alt, az = math.radians(45), math.radians(315)
    shade = np.sin(alt) * np.sin(slope) + np.cos(alt) * np.cos(slope) * np.cos(az - aspect)
    want = np.floor(np.maximum(255 * (shade + 1) / 2, 0))[2:-2, 2:-2]
    out = imagery.hillshade(make({"2024-01-01": {"z": z.tolist()}}), buffer=2)
    assert np.abs(np.array(image(out)["hillshade"]) - want).max() <= 1
    assert (out.grid.width, out.grid.height) == (6, 5)


def test_backscatter(make, image):
    c = make({"2024-01-01": {"vv": [[10, 0, None, 3]], "vv_sigma0_lut": [[2, 2, 2, 2]], "vv_noise_lut": [[20, 1, 1, 50]]}})
    out = image(imagery.sar_backscatter(c, "sigma0-ellipsoid", mask=True))
    assert out == {"vv": [[20, None, None, 0]], "mask": [[1, None, None, 1]]}
    assert image(imagery.sar_backscatter(c, None, noise_removal=False))["vv"] == [[100, None, None, 9]]
    with pytest.raises(errors.FeatureUnsupported):
        imagery.sar_backscatter(c)
    with pytest.raises(errors.ProcessParameterInvalid):
        imagery.sar_backscatter(c, "beta0")


def test_colours(make, image):
    c = make({"2024-01-01": {"r": [[0, 255, None]], "g": [[0, 255, 1]], "b": [[0, 255, 2]]}})
    out = image(imagery.color_formula(c, "Gamma RGB 2 Saturation 1.5"))
    assert out["r"] == [[0, pytest.approx(255), None]]
    shown = image(imagery.colormap(c, {0: [1, 2, 3], 255: [9, 8, 7, 6]}))
    assert shown["red"] == [[1, 9, None]] and shown["alpha"] == [[255, 6, None]]
    assert imagery.get_colormap("gray")[255] == (255, 255, 255, 255)


def test_traps_of_numbers(spark):
    df = spark.createDataFrame([(-5.0,), (2.5,), (0.0,), (None,)], "v double")
    v = F.col("v")
    out = df.select(maths.mod(v, 3), maths.mod(v, -3), maths.divide(v, 0), maths.sqrt(v), maths.ln(v), maths.trunc(v), maths.clip(v, 0, 1), maths.round_(v)).collect()
    assert list(out[0]) == [1, -2, None, None, None, 251, 0, -5]
    assert list(out[1]) == [2.5, -0.5, None, pytest.approx(1.5811388), pytest.approx(0.9162907), 2, 1, 2]
    assert list(out[3]) == [None] * 8
    assert logic.if_(True, 1, 2) == 1 and logic.if_(1, 1, 2) == 2
    kept = df.select(logic.if_(logic.gt(v, 0), 5), logic.and_(v > 0, True), logic.or_(v > 0, v < 0)).collect()
    assert [tuple(r) for r in kept] == [(0, False, True), (5, True, True), (0, False, False), (0, False, False)]


def test_band_reducers(make, image):
    c = make({"2024-01-01": {"a": [[1]], "b": [[None]], "c": [[4]]}})
    got = {n: image(temporal.reduce_dimension(c, lambda b, _, n=n: reducers.PROCESSES[n](b), "bands"))["band1"][0][0] for n in ("max", "mean", "median", "count", "first", "last", "variance")}
    assert got == {"max": 4, "mean": 2.5, "median": 2.5, "count": 2, "first": 1, "last": 4, "variance": 4.5}
