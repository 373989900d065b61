import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import projections
from rasterloom.cube import Grid, reproject, reproject_bounds
from rasterloom.errors import FeatureUnsupported
from rasterloom.operators.resample import resample_spatial
from rasterloom.projections import ARRAYS, AXIS, FLATTENING, SCALE, transform


def meridian_arc(lat, steps=20000):
    """Length of the meridian from the equator by Simpson's rule."""
    e2 = FLATTENING * (2 - FLATTENING)
    phi = np.linspace(0, math.radians(lat), 2 * steps + 1)
    f = AXIS * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    return (phi[-1] / (6 * steps)) * (f[0] + f[-1] + 4 * f[1::2].sum() + 2 * f[2:-1:2].sum())


@pytest.mark.parametrize("lat", [-80, -33.3, 0.0, 12, 51.5, 83.9])
def test_true_length_along_the_central_meridian(lat):
    crs = 32633 if lat >= 0 else 32733
    x, y = transform(np.array([15.0]), np.array([lat]), 4326, crs, ARRAYS)
    assert abs(x[0] - 500000) < 1e-6
    assert abs(y[0] - (0 if lat >= 0 else 10_000_000) - SCALE * meridian_arc(lat)) < 1e-5


def test_angles_are_kept():
    """Equal scale in all directions (with the true meridian that makes the projection)."""
    e2 = FLATTENING * (2 - FLATTENING)
    lon, lat = (a.ravel() for a in np.meshgrid(np.linspace(11.5, 18.5, 9), np.linspace(-79, 83, 13)))
    d = 1e-6
    north = [np.subtract(*p) for p in zip(transform(lon, lat + d, 4326, 32633, ARRAYS), transform(lon, lat - d, 4326, 32633, ARRAYS))]
    east = [np.subtract(*p) for p in zip(transform(lon + d, lat, 4326, 32633, ARRAYS), transform(lon - d, lat, 4326, 32633, ARRAYS))]
    w = 1 - e2 * np.sin(np.radians(lat)) ** 2
    span = 2 * math.radians(d)
    per_north = np.hypot(*north) / (AXIS * (1 - e2) / w**1.5 * span)
    per_east = np.hypot(*east) / (AXIS / np.sqrt(w) * np.cos(np.radians(lat)) * span)
    # finite differences carry about 1e-9 m / 0.2 m
    assert np.abs(per_north / per_east - 1).max() < 2e-6
    assert np.abs(north[0] * east[0] + north[1] * east[1]).max() < 1e-6 * 0.25


def test_there_and_back_within_a_millimetre():
    rng = np.random.default_rng(0)
    lon, lat = rng.uniform(6, 24, 500), rng.uniform(-80, 84, 500)
    for crs in (32633, 32733):
        x, y = transform(lon, lat, 4326, crs, ARRAYS)
        back = transform(x, y, crs, 4326, ARRAYS)
        metres = np.hypot((back[0] - lon) * np.cos(np.radians(lat)), back[1] - lat) * 111_320
        assert metres.max() < 1e-4
    x, y = transform(lon, lat, 4326, 3857, ARRAYS)
    assert np.abs(np.array(transform(x, y, 3857, 4326, ARRAYS)) - [lon, lat]).max() < 1e-12


def test_columns_are_the_same_formulas(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(12, 18, 50), rng.uniform(-60, 60, 50))]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for crs in (32633, 32733, 3857):
        x, y = reproject(F.col("lon"), F.col("lat"), 4326, crs)
        got = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        lon, lat = reproject(F.col("x"), F.col("y"), crs, 4326)
        for r in got.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
            want = transform(np.array([r["lon"]]), np.array([r["lat"]]), 4326, crs, ARRAYS)
            assert abs(r["x"] - want[0][0]) < 1e-6 and abs(r["y"] - want[1][0]) < 1e-6
            assert abs(r["lon2"] - r["lon"]) < 1e-10 and abs(r["lat2"] - r["lat"]) < 1e-10


def test_a_box_is_as_wide_as_its_curved_sides():
    box = reproject_bounds((9.0, 50.0, 21.0, 60.0), 4326, 32633)
    inner = transform(np.array([9.0, 21.0, 9.0, 21.0, 15.0]), np.array([50.0, 50.0, 60.0, 60.0, 50.0]), 4326, 32633, ARRAYS)
    # the southern side bends down in the middle, below its corners
    assert box[1] == pytest.approx(inner[1][4], abs=1) and box[1] < inner[1][0] - 1000
    assert reproject_bounds(box, 32633, 32633) == box
    with pytest.raises(FeatureUnsupported):
        reproject_bounds((0, 0, 1, 1), 4326, 2154)


def test_resampling_to_a_zone(make, image):
    side = 12
    values = [[10.0 * y + x for x in range(side)] for y in range(side)]
    cube = make({"2024-01-01": {"b1": values}}, bounds=(14.0, 49.0, 16.0, 51.0))
    out = resample_spatial(cube, projection=32633, resolution=20000)
    assert out.grid.crs == 32633
    got = image(out)["b1"]
    grid: Grid = out.grid
    hits = 0
    for y in range(grid.height):
        for x in range(grid.width):
            lon, lat = transform(np.array([grid.bounds[0] + (x + 0.5) * grid.dx]), np.array([grid.bounds[3] - (y + 0.5) * grid.dy]), 32633, 4326, ARRAYS)
            row, col = math.floor((51 - lat[0]) * 6), math.floor((lon[0] - 14) * 6)
            inside = 0 <= row < side and 0 <= col < side
            hits += inside
            assert got[y][x] == (values[row][col] if inside else None)
    assert hits > 60 and projections.zone(32633) == (15.0, 0.0)
