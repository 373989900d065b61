import json
from datetime import datetime

import pytest

from rasterloom.cube import Grid
from rasterloom.errors import FeatureUnsupported, OutputLimitExceeded
from rasterloom.sources.catalog import BandInfo, load_collection
from rasterloom.sources.images import FRAMES, Images, estimate_grid, places, resolutions, stac_frames

ITEMS = "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>"


def items(spark, *rows):
    return spark.createDataFrame([(i, "c", datetime(2025, 1, 1 + day), *map(float, box), {}) for i, day, box in rows], ITEMS)


def frames(spark, *rows):
    return spark.createDataFrame([(*r, False) if len(r) == 6 else r for r in rows], FRAMES)


def test_resolutions_of_bands_and_items(spark):
    it = items(spark, ("a", 0, (0, 0, 10, 10)), ("b", 0, (3, 0, 3.2, 0.2)))
    fr = frames(spark, ("a", "B02", None, [0.1, 0.0, 0.0, 0.0, -0.1, 10.0], 100, 100), ("b", "B01", 32631, [10.0, 0.0, 500000.0, 0.0, -10.0, 22000.0], 2000, 2000), ("a", "none", 4326, None, 1, 1))
    got = {(r["item_id"], r["band"]): (r["dx"], r["dy"]) for r in resolutions(fr, it, 32631).collect()}
    assert set(got) == {("a", "B02"), ("b", "B01")} and got["b", "B01"] == (10.0, 10.0)
    # a tenth of a degree at 5 degrees north
    assert 11000 < got["a", "B02"][0] < 11200 and 11000 < got["a", "B02"][1] < 11200
    got = {r["band"]: (r["dx"], r["dy"]) for r in resolutions(fr, it, 4326).collect()}
    assert got["B02"] == (0.1, 0.1) and got["B01"][0] == pytest.approx(10 / 111_320, rel=1e-2)
    with pytest.raises(FeatureUnsupported):
        resolutions(frames(spark, ("a", "x", 2154, [1.0, 0.0, 0.0, 0.0, -1.0, 0.0], 1, 1)), it, 4326)


def test_grid_of_the_finest_cells(spark):
    it = items(spark, ("a", 0, (0, 0, 10, 10)), ("b", 1, (10, 0, 12, 10)))
    fr = frames(spark, ("a", "B1", 4326, [0.1, 0.0, 0.0, 0.0, -0.2, 10.0], 100, 50), ("b", "B1", 4326, [0.5, 0.0, 10.0, 0.0, -0.1, 10.0], 4, 100), ("b", "B2", 4326, [0.01, 0.0, 10.0, 0.0, -0.01, 10.0], 200, 1000))
    assert estimate_grid(fr, it, bands=["B1"]) == Grid(120, 100, (0.0, 0.0, 12.0, 10.0), 4326)
    assert estimate_grid(fr, it, bands=["B1"], width=60) == Grid(60, 50, (0.0, 0.0, 12.0, 10.0), 4326)
    assert estimate_grid(fr, it, bands=["B1"], height=200).width == 240
    assert estimate_grid(fr, it).width == 1200
    extent = {"west": 0, "south": 0, "east": 1, "north": 1}
    assert (estimate_grid(fr, it, extent, ["B1"]).width, estimate_grid(fr, it, extent, ["B1"], target_crs="EPSG:3857").crs) == (10, 3857)
    tiny = {"west": 0, "south": 0, "east": 0.001, "north": 0.001}
    assert (estimate_grid(fr, it, tiny, ["B1"]).width, estimate_grid(fr, it, tiny, ["B1"]).height) == (1, 1)
    assert estimate_grid(fr, it, extent, ["none"]).width == 1024
    with pytest.raises(OutputLimitExceeded):
        estimate_grid(fr, it, bands=["B1"], max_pixels=120 * 100 * 2 - 1)
    assert estimate_grid(fr, it, bands=["B1"], max_pixels=120 * 100 * 2).width == 120


def test_the_first_trusted_projection_is_the_cubes(spark):
    it = items(spark, ("a", 0, (3, 0, 3.1, 0.1)), ("b", 0, (3, 0, 3.1, 0.1)))
    utm, degrees = ("a", "B", 32631, [10.0, 0.0, 500000.0, 0.0, -10.0, 11000.0], 1100, 1100), ("b", "B", 4326, [0.01, 0.0, 3.0, 0.0, -0.01, 0.1], 10, 10)
    assert estimate_grid(frames(spark, utm, degrees), it).crs == 32631
    radar = (*utm[:3], [1e-9, 0.0, 0.0, 0.0, -1e-9, 0.0], 1, 1, True)
    assert estimate_grid(frames(spark, radar, degrees), it) == Grid(10, 10, (3.0, 0.0, 3.1, 0.1), 4326)
    assert estimate_grid(frames(spark, radar), it).width == 1024


def test_frames_out_of_documents(spark, tmp_path):
    one = {"type": "Feature", "id": "s2", "properties": {"proj:epsg": 32631, "proj:shape": [5, 6]}, "assets": {"B1": {"href": "x", "proj:transform": [10, 0, 5, 0, -10, 7]}, "B2": {"href": "y", "proj:code": "EPSG:4326", "proj:transform": [1, 0, 0, 0, -1, 0], "proj:shape": [2, 3]}, "doc": {"href": "z"}}}
    two = {"type": "Feature", "id": "s1", "properties": {"sar:instrument_mode": "IW", "proj:epsg": 4326, "proj:transform": [1, 0, 0, 0, -1, 0], "proj:shape": [9, 9]}, "assets": {"vv": {"href": "v"}}}
    for k, item in enumerate((one, two)):
        (tmp_path / f"{k}.json").write_text(json.dumps(item))
    got = {(r["item_id"], r["band"]): r for r in stac_frames(spark, str(tmp_path)).collect()}
    assert (got["s2", "B1"]["epsg"], got["s2", "B1"]["width"], got["s2", "B1"]["height"]) == (32631, 6, 5) and got["s2", "B1"]["transform"][2] == 5
    assert (got["s2", "B2"]["epsg"], got["s2", "B2"]["width"]) == (4326, 3) and got["s2", "doc"]["transform"] is None
    assert got["s1", "vv"]["untrusted"] and not got["s2", "B1"]["untrusted"]


def test_rotated_frames(spark):
    """An image turned by 90 degrees: columns run north."""
    fr = frames(spark, ("a", "B", 4326, [0.0, 1.0, 2.0, 1.0, 0.0, 3.0], 4, 2))
    got = {(r["y"], r["x"]): (r["line"], r["pixel"]) for r in places(fr, Grid(10, 10, (0.0, 0.0, 10.0, 10.0))).collect()}
    inside = {k: v for k, v in got.items() if v[0] < 2 and v[1] < 4}
    assert inside == {(9 - y, x): (x + 0.5 - 2, y + 0.5 - 3) for x in (2, 3) for y in range(3, 7)}


def test_a_cube_of_bands_with_grids_of_their_own(spark):
    """Two bands of an item at 1 and 2 units, scaled, with a missing value; a second item behind the first."""
    it = items(spark, ("a", 0, (0, 0, 4, 4)), ("b", 0, (0, 0, 4, 4)))
    fr = frames(spark, ("a", "fine", 4326, [1.0, 0.0, 0.0, 0.0, -1.0, 4.0], 4, 4), ("a", "coarse", 4326, [2.0, 0.0, 0.0, 0.0, -2.0, 4.0], 2, 2), ("b", "fine", 4326, [4.0, 0.0, 0.0, 0.0, -4.0, 4.0], 1, 1))
    pixels = [("a", "fine", i, j, 0.0 if (i, j) == (1, 1) else 10.0 * i + j + 1) for i in range(4) for j in range(4)]
    pixels += [("a", "coarse", i, j, 100.0 * i + j) for i in range(2) for j in range(2)] + [("b", "fine", 0, 0, 77.0), ("zz", "fine", 0, 0, 1.0)]
    images = Images(fr, spark.createDataFrame(pixels, "item_id string, band string, line int, pixel int, value double"))
    c = images.collection("c", it, {"fine": BandInfo(scale=2.0, offset=1.0, nodata=0.0), "coarse": BandInfo()})
    assert c.grid == Grid(4, 4, (0.0, 0.0, 4.0, 4.0), 4326)
    got = {(r["y"], r["x"]): (r["fine"], r["coarse"]) for r in load_collection(c, bands=["fine", "coarse"]).df.collect()}
    assert len(got) == 16
    for (y, x), v in got.items():
        assert v == ((77.0 if (y, x) == (1, 1) else 10.0 * y + x + 1) * 2 + 1, 100.0 * (y // 2) + x // 2)
