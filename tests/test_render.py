from datetime import datetime

import pytest

from rasterloom import errors
from rasterloom.cube import Grid
from rasterloom.operators import spatial
from rasterloom.plans.graph import execute, session_loaders
from rasterloom.services.render import check_tile, render_tile, scoped, tile_parameters
from rasterloom.sources.catalog import BandInfo, Collection

GRAPH = {"process_graph": {"l": {"process_id": "load_collection", "arguments": {"id": "c", "spatial_extent": None, "bands": ["a"]}, "result": True}}, "parameters": [{"name": "unused", "default": 1}]}
A = {"2024-01-01": {"a": [[1, 2], [3, None]]}}


def square(w, s, e, n):
    return {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}


@pytest.fixture(scope="module")
def loaders(spark):
    items = spark.createDataFrame([("i", "c", datetime(2024, 1, 1), 0.0, 0.0, 8.0, 8.0, {})], "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>")
    pixels = spark.createDataFrame([("i", y, x, float(10 * y + x)) for y in range(8) for x in range(8)], "item_id string, y int, x int, a double")
    return session_loaders(spark, {"c": Collection("c", items, pixels, Grid(8, 8, (0.0, 0.0, 8.0, 8.0)), {"a": BandInfo()})})


def test_a_tile_is_cut_in_the_projection_of_the_map(loaders, image):
    out = render_tile(scoped(GRAPH), 16, 15, 5, loaders, configuration={"tile_size": 4, "extent": [0, 0, 8, 8]})
    assert out.grid.crs == 3857 and out.grid.bounds[3] == pytest.approx(1252344.271)
    assert image(out)["a"] == [[None] * 4, [1, 4, 7, None], [31, 34, 37, None], [61, 64, 67, None]]
    assert GRAPH["process_graph"]["l"]["arguments"]["spatial_extent"] is None
    west = render_tile(scoped(GRAPH), 16, 15, 5, loaders, {"target_crs": 4326}, {"tile_size": 2})
    assert west.grid.crs == 4326 and (west.grid.width, west.grid.height) == (2, 2)


def test_tiles_that_are_refused(loaders):
    with pytest.raises(errors.ProcessParameterRequired):
        render_tile(GRAPH, 16, 15, 5, loaders)
    with pytest.raises(errors.TileOutsideBounds):
        render_tile(scoped(GRAPH), 0, 0, 5, loaders, configuration={"extent": [0, 0, 8, 8]})
    with pytest.raises(errors.TileOutsideBounds):
        check_tile(4, 0, 2)
    with pytest.raises(errors.ProcessParameterInvalid):
        check_tile(0, 0, 2, minzoom=3)
    with pytest.raises(errors.ProcessParameterInvalid):
        check_tile(0, 0, 9, maxzoom=8)
    check_tile(16, 15, 5, [0, 0, 8, 8])
    assert tile_parameters(16, 15, 5)["spatial_extent_crs"] == 3857


def test_cutlines(make, image):
    left, low = square(0, 0, 1, 2), square(0, 0, 2, 1)
    assert image(spatial.cutline(make(A), left))["a"] == [[1, None], [3, None]]
    assert image(spatial.cutline(make(A), [left, None, low]))["a"] == [[1, None], [3, None]]
    assert image(spatial.cutline(make({"2024-01-01": {"a": [[1, 2], [3, 4]]}}), [left, low]))["a"] == [[1, None], [3, 4]]
    for nothing in ([None], [], {"type": "Point", "coordinates": [0.5, 0.5]}):
        assert image(spatial.cutline(make(A), nothing))["a"] == [[None, None], [None, None]]
    assert image(spatial.cutline(make(A), spatial.union_of_footprints([left, None])))["a"] == A["2024-01-01"]["a"]
    assert spatial.union_of_footprints([]) is None and spatial.union_of_footprints([left]) == [left]


def test_array_apply_in_a_graph(make, image):
    child = {"s": {"process_id": "multiply", "arguments": {"x": {"from_parameter": "x"}, "y": {"from_parameter": "context"}}, "result": True}}
    inner = {"a": {"process_id": "array_apply", "arguments": {"data": {"from_parameter": "data"}, "process": {"process_graph": child}}, "result": True}}
    graph = {"p": {"process_id": "apply_dimension", "arguments": {"data": {"from_parameter": "c"}, "dimension": "bands", "context": 2, "process": {"process_graph": inner}}, "result": True}}
    assert image(execute(graph, {"c": make(A)}))["a"] == [[2, 4], [6, None]]
    inner["a"]["arguments"]["context"] = 5
    assert image(execute(graph, {"c": make(A)}))["a"] == [[5, 10], [15, None]]
