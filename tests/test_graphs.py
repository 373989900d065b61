import json
import struct
import zlib

import numpy as np
import pytest

from rasterloom import errors
from rasterloom.plans.graph import execute, validate
from rasterloom.plans.params import get_param_item
from rasterloom.services import tiles
from rasterloom.services.store import GraphStore
from rasterloom.sinks.save import pixels, save_result

DATA = {"2024-01-01": {"red": [[1, 2]], "nir": [[3, 4]]}, "2024-01-02": {"red": [[5, 6]], "nir": [[15, 6]]}}
GRAPH = {
    "l": {"process_id": "load", "arguments": {}},
    "m": {"process_id": "reduce_dimension", "arguments": {"data": {"from_node": "l"}, "dimension": "t", "reducer": {"process_graph": {"a": {"process_id": "max", "arguments": {"data": {"from_parameter": "data"}}}, "b": {"process_id": "add", "arguments": {"x": {"from_node": "a"}, "y": {"from_parameter": "plus"}}, "result": True}}}}},
    "n": {"process_id": "ndvi", "arguments": {"data": {"from_node": "m"}, "nir": "nir", "red": "red"}, "result": True},
}


def test_callbacks_see_outer_parameters(make, image):
    c = make(DATA)
    out = execute({"process_graph": GRAPH, "parameters": [{"name": "plus", "default": 1}]}, loaders={"load": lambda: c})
    assert image(out)["ndvi"] == [[10 / 22, 0]]
    with pytest.raises(errors.ProcessParameterRequired):
        execute(GRAPH, loaders={"load": lambda: c})


def test_errors_of_graphs():
    assert validate(GRAPH, ("load",)) == []
    wrong = {"a": {"process_id": "nothing", "arguments": {"data": {"from_node": "z"}}}}
    assert {e["code"] for e in validate(wrong)} == {"ProcessParameterInvalid", "ProcessUnsupported"}
    with pytest.raises(errors.ProcessUnsupported):
        execute({"a": {"process_id": "nothing", "arguments": {}, "result": True}})
    loop = {"a": {"process_id": "absolute", "arguments": {"x": {"from_node": "a"}}, "result": True}}
    with pytest.raises(errors.ProcessParameterInvalid):
        execute(loop)


def test_paths():
    doc = {"a": [{"b": 1}, {"b": 2}], "e": []}
    assert get_param_item(doc, "$.a[1].b") == 2
    assert get_param_item(doc, "$['a'][*]['b']") == 1
    assert get_param_item(doc, "$.e[0]") is None
    assert get_param_item({}, "$.a") is None
    with pytest.raises(errors.ProcessParameterRequired):
        get_param_item(doc, "$.z")
    with pytest.raises(errors.ProcessParameterInvalid):
        get_param_item(doc, "$.a[?]")


def test_images(make):
    c = make({"2024-01-01": {"red": [[1, None]], "green": [[3, 4]], "blue": [[5, 300]]}})
    data = save_result(c, "PNG").data
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (2, 1)
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : -16])
    assert list(raw) == [0, 1, 3, 5, 255, 0, 4, 255, 0]
    t = save_result(c, "GTiff").data
    assert t[:4] == b"II*\0"
    body = np.frombuffer(t[-48:], "<f8").reshape(3, 1, 2)
    assert body[1].tolist() == [[3, 4]] and np.isnan(body[0, 0, 1])
    with pytest.raises(errors.ProcessParameterInvalid):
        save_result(make(DATA), "png")
    two, times = pixels(make(DATA))
    assert two.shape == (2, 2, 1, 2) and len(times) == 2
    assert save_result(make(DATA), "gtiff").media_type.startswith("image/tiff")


def test_documents(make, tmp_path, spark):
    collection = {"type": "FeatureCollection", "features": [{"properties": {"values": {"2024-01-01": 1.5}}}]}
    assert save_result(collection, "csv").data == b"date,feature_index,value\n2024-01-01,0,1.5\n"
    assert json.loads(save_result({"a": 1}, "json").data) == {"a": 1}
    assert save_result(3, "txt").data == b"3"
    assert json.loads(save_result(make(DATA), "metajson").data)["bands"] == ["red", "nir"]
    where = save_result(make(DATA), "parquet", {"path": str(tmp_path / "cube")}).data
    assert spark.read.parquet(where).count() == 4


def test_tiles(spark):
    s = tiles.empty(spark.range(1))
    s, one = tiles.claim(s, "s", "ann", 3, (0, 1), (0, 0))
    s, again = tiles.claim(s, "s", "ann", 3, (0, 1), (0, 0))
    assert (one["x"], one["y"]) == (again["x"], again["y"])
    s, two = tiles.claim(s, "s", "bob", 3, (0, 1), (0, 0))
    assert two["x"] != one["x"]
    with pytest.raises(errors.NoTileAvailable):
        tiles.claim(s, "s", "cat", 3, (0, 1), (0, 0))
    s, _ = tiles.tile_assignment(s, 3, (0, 1), (0, 0), "update", "s", "ann", '{"k": 1}')
    s, _ = tiles.submit(s, "s", "ann")
    for f in (tiles.submit, tiles.release):
        with pytest.raises(errors.TileAlreadyLocked):
            f(s, "s", "ann")
    s, _ = tiles.tile_assignment(s, 3, (0, 1), (0, 0), "force-release", "s", "ann")
    assert [r["user_id"] for r in tiles.tiles_summary(s, "s").collect()] == ["bob"]
    with pytest.raises(errors.TileNotAssigned):
        tiles.release(s, "s", "ann")
    with pytest.raises(errors.ProcessParameterInvalid):
        tiles.tile_assignment(s, 3, (0, 1), (0, 0), "steal", "s", "ann")


def test_stored_graphs(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graphs"))
    g = {"a": {"process_id": "pi", "arguments": {}, "result": True}}
    store.put("ann", "g", g)
    store.put("ann", "g", g | {"b": {"process_id": "e", "arguments": {}}})
    assert set(store.get("ann", "g")) == {"a", "b"}
    assert [r["id"] for r in store.list("ann").collect()] == ["g"]
    store.delete("ann", "g")
    with pytest.raises(errors.NotFound):
        store.get("ann", "g")
    with pytest.raises(errors.ProcessParameterInvalid):
        store.put("ann", "h", {"a": {"process_id": "nope", "arguments": {}, "result": True}})


def test_zonal_statistics_are_saved(make, tmp_path, spark):
    box = lambda w, s, e, n: {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}}
    features = {"type": "FeatureCollection", "features": [box(0, 0, 1, 1), box(0, 0, 2, 1), box(50, 50, 51, 51)]}
    mean = {"process_graph": {"m": {"process_id": "mean", "arguments": {"data": {"from_parameter": "data"}}, "result": True}}}
    graph = {"l": {"process_id": "load", "arguments": {}}, "z": {"process_id": "aggregate_spatial", "arguments": {"data": {"from_node": "l"}, "geometries": features, "reducer": mean}}}

    def save(kind, **options):
        done = graph | {"s": {"process_id": "save_result", "arguments": {"data": {"from_node": "z"}, "format": kind, "options": options}, "result": True}}
        return execute(done, loaders={"load": lambda: make(DATA)})

    doc = json.loads(save("json").data)
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == 2
    assert doc["features"][1]["properties"]["values"] == {"2024-01-01T00:00:00": 1.5, "2024-01-02T00:00:00": 5.5}
    assert save("geojson").media_type == "application/geo+json"
    assert b"date,feature_index,value\n2024-01-01T00:00:00,0,1.0\n" in save("csv").data
    save("csv", path=str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4
    assert validate(graph | {"s": {"process_id": "save_result", "arguments": {"data": {"from_node": "z"}, "format": "json"}, "result": True}}, ("load",)) == []


def test_many_features_are_a_table(make):
    import time

    from rasterloom.functions import reducers
    from rasterloom.operators import spatial

    tiny = [{"type": "Polygon", "coordinates": [[[x / 5000, 0], [(x + 1) / 5000, 0], [(x + 1) / 5000, 1], [x / 5000, 1], [x / 5000, 0]]]} for x in range(10_000)]
    features = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": g} for g in tiny]}
    start = time.time()
    rows = spatial.aggregate_spatial(make(DATA), features, lambda s, _: reducers.mean(s))
    rows._jdf.queryExecution().executedPlan()
    assert time.time() - start < 20
    assert rows.count() == 20_000
    masked = spatial.mask_polygon(make(DATA), {"type": "GeometryCollection", "geometries": tiny[:5000]})
    assert {(r["x"], r["red"] is None) for r in masked.df.collect()} == {(0, False), (1, True)}


def test_tiles_as_processes(spark, tmp_path):
    from rasterloom.plans.graph import session_loaders

    store = tiles.Assignments(spark, str(tmp_path / "tiles"))

    def run(user, stage, **more):
        args = {"zoom": 3, "x_range": [0, 1], "y_range": [0, 0], "stage": stage, **more}
        return execute({"t": {"process_id": "tile_assignment", "arguments": args, "result": True}}, loaders=session_loaders(spark, assignments=store, service_id="s", user_id=user))

    first, second = run("ann", "claim"), run("bob", "claim")
    assert {(first["x"], first["y"]), (second["x"], second["y"])} == {(0, 0), (1, 0)}
    assert run("ann", "claim") == first
    with pytest.raises(errors.NoTileAvailable):
        run("cem", "claim")
    assert run("ann", "update", data={"note": 1})["data"] == '{"note": 1}'
    assert run("ann", "submit")["stage"] == "submitted"
    with pytest.raises(errors.TileAlreadyLocked):
        run("ann", "release")
    summary = execute({"t": {"process_id": "tiles_summary", "arguments": {}, "result": True}}, loaders=session_loaders(spark, assignments=store, service_id="s", user_id="bob"))
    assert {(r["user_id"], r["stage"]) for r in summary.collect()} == {("ann", "submitted"), ("bob", "claimed")}
    run("ann", "force-release")
    run("bob", "release")
    assert store.state().count() == 0


def test_validate_sees_what_execute_would():
    graph = {"a": {"process_id": "load_collection", "arguments": {"id": "x"}}, "b": {"process_id": "ndvi", "arguments": {"data": {"from_node": "c"}}}, "c": {"process_id": "apply", "arguments": {"data": {"from_node": "b"}}, "result": True}}
    assert {e["code"] for e in validate(graph)} == {"ProcessParameterInvalid", "ProcessParameterRequired"}


def test_tiffs_of_whole_numbers(make):
    c = make({"2024-01-01": {"red": [[1, None]], "nir": [[300, -4]]}})

    def tags(data):
        (at,) = struct.unpack("<I", data[4:8])
        return {t: (kind, n, value) for t, kind, n, value in (struct.unpack("<HHII", data[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(struct.unpack("<H", data[at : at + 2])[0]))}

    data = save_result(c, "GTiff", {"dtype": "int16", "nodata": -9999}).data
    assert np.frombuffer(data[-8:], "<i2").tolist() == [1, -9999, 300, -4]
    assert tags(data)[258][2] & 0xFFFF == 16 and tags(data)[339][2] & 0xFFFF == 2
    assert b"-9999\0" in data
    assert np.frombuffer(save_result(c, "GTiff", {"dtype": "uint8"}).data[-4:], "u1").tolist() == [1, 0, 255, 0]
    assert np.isnan(np.frombuffer(save_result(c, "GTiff", {"dtype": "float32"}).data[-16:], "<f4")[1])
    with pytest.raises(errors.ProcessParameterInvalid):
        save_result(c, "GTiff", {"dtype": "uint8", "nodata": -1})
