import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.cube import Grid
from rasterloom.errors import ProcessParameterInvalid
from rasterloom.operators import geocode
from rasterloom.operators.geocode import inverse_map, load_radar, sample, solve, splines, warp
from rasterloom.projections import ARRAYS, transform

POINTS = "item_id string, line double, pixel double, x double, y double"


def polar(line, pixel):
    """A strip in radar geometry near the pole: coordinates of a tilted plane seen from above, 10 m a pixel."""
    r, a = np.asarray(line) * 10.0, np.asarray(pixel) * 10.0
    tilt = math.radians(31)
    north, east = 1_300_000 - r * math.cos(tilt) + a * math.sin(tilt), 250_000 + r * math.sin(tilt) + a * math.cos(tilt) + 2e-8 * a * a
    lon = np.degrees(np.arctan2(east, north))
    lat = 90 - np.degrees(2 * np.arctan(np.hypot(east, north) / (2 * 6371000.0)))
    return lon, lat


def control(lines=20000, pixels=25000, n=11, m=21):
    line, pixel = (a.ravel() for a in np.meshgrid(np.linspace(0, lines, n), np.linspace(0, pixels, m), indexing="ij"))
    return line, pixel, *polar(line, pixel)


def test_round_trip_on_a_polar_strip_within_a_third_of_a_metre(spark):
    line, pixel, lon, lat = control()
    rows = [("a", *map(float, r)) for r in zip(line, pixel, lon, lat)]
    row = splines(spark.createDataFrame(rows, POINTS)).first()
    assert len(row["knots_x"]) == 11 * 21

    def metres(want):
        x, y = polar(*want.T)
        terms = geocode._terms((x - row["x0"]) / row["scale"], (y - row["y0"]) / row["scale"], np.array(row["knots_x"]), np.array(row["knots_y"]))
        return np.hypot(*(terms @ np.column_stack([row["line"], row["pixel"]]) - want).T) * 10

    assert metres(np.column_stack([line, pixel])).max() < 0.3
    # between the points, where meridians converge, the spline bends; most cells are near
    rng = np.random.default_rng(0)
    inner = metres(np.column_stack([rng.uniform(2000, 18000, 400), rng.uniform(1250, 23750, 400)]))
    assert np.median(inner) < 3, np.median(inner)


@pytest.mark.parametrize("crs", [4326, 3857, 32633])
def test_map_of_all_cells_against_the_formula(spark, crs, monkeypatch):
    monkeypatch.setattr(geocode, "CELLS", 5)
    line, pixel = (a.ravel() for a in np.meshgrid(np.linspace(0, 40, 5), np.linspace(0, 60, 6), indexing="ij"))
    place = lambda i, l, p: (14 + i + 0.02 * p + 0.004 * l, 50 - 0.015 * l + 0.002 * p)
    rows = [(f"i{i}", float(l), float(p), *map(float, place(i, l, p))) for i in range(2) for l, p in zip(line, pixel)]
    box = {4326: (13.9, 49.2, 16.4, 50.2), 3857: (1546000, 6310000, 1826000, 6480000), 32633: (420000, 5452000, 605000, 5562000)}[crs]
    grid = Grid(23, 17, tuple(map(float, box)), crs)
    out = inverse_map(splines(spark.createDataFrame(rows, POINTS)), grid).collect()
    seen = {}
    for r in out:
        lon, lat = transform(np.array([grid.bounds[0] + (r["x"] + 0.5) * grid.dx]), np.array([grid.bounds[3] - (r["y"] + 0.5) * grid.dy]), crs, 4326, ARRAYS)
        i = int(r["item_id"][1])
        # the two coordinates of a plane, solved for line and pixel
        p, l = np.linalg.solve([[0.02, 0.004], [0.002, -0.015]], [lon[0] - 14 - i, lat[0] - 50])
        assert abs(r["line"] - l) < 1e-6 and abs(r["pixel"] - p) < 1e-6
        seen[r["item_id"], r["y"], r["x"]] = 0 <= l < 40 and 0 <= p < 60
    assert len(seen) == len(out) and sum(seen.values()) > 100
    # no cell inside of an image is left out
    for i in range(2):
        for y in range(grid.height):
            for x in range(grid.width):
                lon, lat = transform(np.array([grid.bounds[0] + (x + 0.5) * grid.dx]), np.array([grid.bounds[3] - (y + 0.5) * grid.dy]), crs, 4326, ARRAYS)
                p, l = np.linalg.solve([[0.02, 0.004], [0.002, -0.015]], [lon[0] - 14 - i, lat[0] - 50])
                if 0 <= l < 40 and 0 <= p < 60:
                    assert seen.get((f"i{i}", y, x))


def test_few_and_odd_points(spark):
    rows = [("one", 5.0, 6.0, 1.0, 2.0), ("line", 0.0, 0.0, 0.0, 0.0), ("line", 10.0, 20.0, 1.0, 1.0), ("line", 10.0, 20.0, 1.0, 1.0), ("line", None, 1.0, 1.0, 1.0), ("line", float("nan"), 1.0, 1.0, 1.0), ("none", 1.0, 1.0, float("inf"), 0.0)]
    got = {r["item_id"]: r for r in splines(spark.createDataFrame(rows, POINTS)).collect()}
    assert set(got) == {"one", "line"}
    kx, ky, c, (x0, y0, scale) = solve(np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.array([[0.0, 0.0], [10.0, 20.0]]))
    assert np.allclose(geocode._terms((np.array([0.5]) - x0) / scale, (np.array([0.5]) - y0) / scale, kx, ky) @ c, [[5.0, 10.0]])
    assert splines(spark.createDataFrame([], POINTS)).count() == 0
    assert inverse_map(splines(spark.createDataFrame([], POINTS)), Grid(4, 4, (0.0, 0.0, 1.0, 1.0))).count() == 0


def test_too_many_points(spark, monkeypatch):
    monkeypatch.setattr(geocode, "MAX_POINTS", 3)
    with pytest.raises(Exception, match="control points at most"):
        splines(spark.createDataFrame([("a", 1.0, 1.0, float(i), 0.0) for i in range(4)], POINTS)).collect()


def plain_sample(image, line, pixel, method):
    reach, kernel = geocode.KERNELS[method]
    r, c = math.floor(line), math.floor(pixel)
    if not (0 <= r < len(image) and 0 <= c < len(image[0])) or image[r][c] is None:
        return None
    if not reach:
        return image[r][c]
    total = weight = 0.0
    for i in range(math.floor(line - 0.5) + 1 - reach, math.floor(line - 0.5) + reach + 1):
        for j in range(math.floor(pixel - 0.5) + 1 - reach, math.floor(pixel - 0.5) + reach + 1):
            if 0 <= i < len(image) and 0 <= j < len(image[0]) and image[i][j] is not None:
                w = float(kernel(np.abs(np.array(line - 0.5 - i))) * kernel(np.abs(np.array(pixel - 0.5 - j))))
                total, weight = total + w * image[i][j], weight + w
    return total / weight if weight else None


@pytest.mark.parametrize("method", list(geocode.KERNELS))
def test_warp_against_plain_python(spark, method, monkeypatch):
    monkeypatch.setattr(geocode, "PIXELS", 8)
    rng = np.random.default_rng(2)
    images = {k: [[None if rng.random() < 0.1 else float(rng.integers(100)) for _ in range(21)] for _ in range(19)] for k in ("a", "b")}
    pixels = [(k, i, j, v, None if v is None else -v) for k, m in images.items() for i, row in enumerate(m) for j, v in enumerate(row)]
    places = [("a" if n % 3 else "b", n, n + 1, float(rng.uniform(-2, 21)), float(rng.uniform(-2, 23))) for n in range(500)]
    places += [("a", 900, 0, None, 1.0), ("zz", 901, 0, 1.0, 1.0), ("a", 902, 0, float("nan"), 1.0), ("a", 903, 0, 1e6, 1e6)]
    out = warp(spark.createDataFrame(pixels, "item_id string, line int, pixel int, v double, w double"), spark.createDataFrame(places, "item_id string, y int, x int, line double, pixel double"), ["v", "w"], method)
    got = {r["y"]: r for r in out.collect()}
    assert not {900, 901, 902, 903} & set(got)
    for k, y, x, line, pixel in places[:500]:
        want = plain_sample(images[k], line, pixel, method)
        assert (got[y]["v"] if y in got else None) == (None if want is None else pytest.approx(want, abs=1e-9)), (k, line, pixel)
        if y in got:
            assert got[y]["item_id"] == k and got[y]["x"] == x and (got[y]["w"] is None) == (got[y]["v"] is None)


def test_methods(spark):
    with pytest.raises(ProcessParameterInvalid):
        warp(spark.range(1), spark.range(1), ["v"], "average")
    assert np.isnan(sample(np.ones((1, 2, 2)), np.array([-0.1, 2.0]), np.array([0.5, 0.5]), "bilinear")).all()


def test_radar_cube_on_a_map_grid(spark):
    """Two images of one day and one of another, each with its own geometry."""
    grid = Grid(12, 10, (0.0, 0.0, 12.0, 10.0))
    geometry = {"a": (0.0, 10.0), "b": (5.0, 8.0), "c": (1.0, 9.0)}
    points, pixels = [], []
    for k, (west, north) in geometry.items():
        for line in (0.0, 3.0, 6.0):
            for pixel in (0.0, 3.0, 6.0):
                points.append((k, line, pixel, west + pixel, north - line))
        pixels += [(k, i, j, float(ord(k) * 100 + 10 * i + j)) for i in range(6) for j in range(6)]
    items = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 2))], "id string, datetime timestamp_ntz")
    cube = load_radar(items, spark.createDataFrame(pixels + [("zz", 0, 0, 1.0)], "item_id string, line int, pixel int, vv double"), spark.createDataFrame(points, POINTS), ["vv"], grid, method="near")
    got = {(r["t"].day, r["y"], r["x"]): r["vv"] for r in cube.df.collect()}
    assert len(got) == 2 * 120
    for (day, y, x), v in got.items():
        want = None
        for k in ("ab", "c")[day - 1]:
            west, north = geometry[k]
            i, j = y - int(10 - north), x - int(west)
            if want is None and 0 <= i < 6 and 0 <= j < 6:
                want = float(ord(k) * 100 + 10 * i + j)
        assert v == want
    assert cube.df.where(F.col("vv").isNotNull()).count() > 60
