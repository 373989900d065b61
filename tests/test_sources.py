from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rasterloom import errors
from rasterloom.cube import Grid
from rasterloom.functions import reducers
from rasterloom.sources.catalog import BandInfo, Collection, load_collection, load_stac, load_table, normalize_summaries, output_size, search
from rasterloom.streaming.windows import windowed

GRID = Grid(2, 1, (0.0, 0.0, 2.0, 1.0))


@pytest.fixture(scope="module")
def collection(spark):
    items = spark.createDataFrame(
        [("i1", "c", datetime(2024, 1, 1), 0.0, 0.0, 2.0, 1.0, {"cloud": "5", "p": "S2_x"}), ("i2", "c", datetime(2024, 1, 1), 0.0, 0.0, 2.0, 1.0, {"cloud": "50"}), ("i3", "c", datetime(2024, 1, 2), 5.0, 0.0, 6.0, 1.0, {"cloud": "1"})],
        "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>",
    )
    pixels = spark.createDataFrame([("i1", 0, 0, 9.0, float("nan")), ("i1", 0, 1, 0.0, 3.0), ("i2", 0, 0, 1.0, 4.0), ("i2", 0, 1, 2.0, 5.0), ("i3", 0, 0, 7.0, 7.0)], "item_id string, y int, x int, a double, b double")
    return Collection("c", items, pixels, GRID, {"a": BandInfo(scale=2.0, offset=1.0, nodata=0.0), "b": BandInfo(like="a")})


def test_mosaic_scale_and_nodata(collection, image):
    c = load_collection(collection, temporal_extent=["2024-01-01", "2024-01-02"], bands=["a", "b"])
    assert image(c) == {"a": [[19, 5]], "b": [[4, 3]]}
    assert load_collection(collection).bands == ("a",)
    assert len(load_collection(collection).labels()) == 2


def test_limits(collection):
    with pytest.raises(errors.ItemsLimitExceeded):
        load_collection(collection, max_items=2)
    with pytest.raises(errors.OutputLimitExceeded):
        load_collection(collection, width=100, height=100, max_pixels=1000)
    with pytest.raises(errors.NoDataAvailable):
        load_collection(collection, temporal_extent=["2030", None])
    with pytest.raises(errors.TemporalExtentEmpty):
        search(collection, temporal_extent=[None, None])
    with pytest.raises(errors.ProcessParameterInvalid):
        load_collection(collection, bands=["z"])


def _rule(process, **args):
    return {"process_graph": {"r": {"process_id": process, "arguments": {"x": {"from_parameter": "value"}, **args}, "result": True}}}


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        ({"cloud": _rule("lte", y=5)}, {"i1", "i3"}), ({"cloud": 50}, {"i2"}), ({"cloud": _rule("between", min=2, max=60)}, {"i1", "i2"}), ({"p": _rule("starts_with", y="S2")}, {"i1"}),
        ({"p": _rule("is_null")}, {"i2", "i3"}), ({"p": _rule("contains", pattern="_")}, {"i1"}), ({"cloud": _rule("in", values=["1", "50"])}, {"i2", "i3"}), ({"cloud": _rule("neq", y=5), "p": _rule("is_null")}, {"i2", "i3"}),
        ({"cloud": _rule("gt", y={"from_parameter": "limit"})}, {"i1", "i2", "i3"}), ({"cloud": {"from_parameter": "limit"}}, {"i1", "i2", "i3"}), ({"properties.cloud": _rule("eq", y=5)}, {"i1"}),
    ],
)
def test_property_rules(collection, rule, expected):
    assert {r["id"] for r in search(collection, properties=rule).collect()} == expected


def test_extent_reaches_the_items(collection, image):
    assert {r["id"] for r in search(collection, {"west": 4, "south": 0, "east": 7, "north": 1}).collect()} == {"i3"}
    one = load_collection(collection, {"west": 0, "south": 0, "east": 1, "north": 1}, ["2024-01-01", "2024-01-02"], ["a"])
    assert image(one) == {"a": [[19]]}


def test_sizes_and_summaries(collection):
    assert output_size((0, 0, 10, 5), 1, 1) == (10, 5)
    assert output_size((0, 0, 10, 5), 1, 1, width=20) == (20, 10)
    assert output_size((0, 0, 10, 5), None, None) == (1024, 1024)
    assert normalize_summaries({"a": 1, "b": [2], "c": {"minimum": 0}}) == {"a": [1], "b": [2], "c": {"minimum": 0}}
    assert collection.describe()["cube:dimensions"]["x"]["extent"] == [0, 6]


def test_item_documents(spark, tmp_path, collection, image):
    (tmp_path / "i.json").write_text('{"id": "i1", "collection": "c", "bbox": [0, 0, 2, 1], "properties": {"datetime": "2024-01-01T00:00:00Z"}}')
    c = load_stac(spark, str(tmp_path / "i.json"), collection.pixels, GRID, {"a": BandInfo()}, bands=["a"])
    assert image(c, "2024-01-01") == {"a": [[9, 0]]}
    collection.pixels.where("item_id = 'i1'").drop("item_id").write.parquet(str(tmp_path / "t"))
    assert load_table(spark, str(tmp_path / "t"), ["a", "b"], GRID).df.where("b is null").count() == 1


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1, h), 0, 0, float(h)) for h in range(12)], "t timestamp, y int, x int, v double").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["v"], reducers.mean, "3 hours", late="1 hour")
    q = stream.writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in windowed(df, ["v"], reducers.mean, "3 hours").collect()}
    assert {tuple(r) for r in spark.table("means").collect()} == want
    assert len(want) == 4
    assert {r["v"] for r in spark.table("means").where(F.col("y") == 0).collect()} == {1, 4, 7, 10}


def test_predicates_reach_the_scan(spark, tmp_path):
    """Items found, rows and columns of the extent are predicates on the stored pixels."""
    data = [(f"i{k}", y, x, float(k)) for k in range(6) for y in range(8) for x in range(8)]
    spark.createDataFrame(data, "item_id string, y int, x int, a double").write.parquet(str(tmp_path / "p"))
    items = spark.createDataFrame([(f"i{k}", "c", datetime(2024, 1, k + 1), 0.0, 0.0, 8.0, 8.0, {}) for k in range(6)], "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>")
    c = Collection("c", items, spark.read.parquet(str(tmp_path / "p")), Grid(8, 8, (0.0, 0.0, 8.0, 8.0)), {"a": BandInfo()})
    cube = load_collection(c, {"west": 2, "south": 1, "east": 5, "north": 7}, ["2024-01-02", "2024-01-04"])
    assert (cube.grid.width, cube.grid.height) == (3, 6) and cube.labels() == [datetime(2024, 1, 2), datetime(2024, 1, 3)]
    plan = cube.df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "In(item_id" in pushed and "GreaterThanOrEqual(y" in pushed and "LessThanOrEqual(y" in pushed
    assert sorted({r["a"] for r in cube.df.collect()}) == [1.0, 2.0] and cube.df.count() == 36


def test_another_projection_and_a_buffer(spark, tmp_path):
    data = [("i", y, x, float(10 * y + x)) for y in range(8) for x in range(8)]
    items = spark.createDataFrame([("i", "c", datetime(2024, 1, 1), 0.0, 0.0, 8.0, 8.0, {})], "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>")
    c = Collection("c", items, spark.createDataFrame(data, "item_id string, y int, x int, a double"), Grid(8, 8, (0.0, 0.0, 8.0, 8.0)), {"a": BandInfo()})
    web = load_collection(c, target_crs="EPSG:3857")
    assert web.grid.crs == 3857 and (web.grid.width, web.grid.height) == (8, 8) and abs(web.grid.bounds[2] - 890555.9) < 1
    assert sorted(r["a"] for r in web.df.collect()) == [r[3] for r in data]
    wide = load_collection(c, {"west": 2, "south": 2, "east": 6, "north": 6}, tile_buffer=3)
    assert (wide.grid.width, wide.grid.height, wide.grid.bounds) == (10, 10, (-1.0, -1.0, 9.0, 9.0))
    assert wide.df.where("a is not null").count() == 64
    with pytest.raises(errors.ProcessParameterInvalid):
        load_collection(c, target_crs="nowhere")


def test_static_catalogues_and_tables_as_processes(spark, tmp_path):
    import json

    from rasterloom.plans.graph import execute, session_loaders

    (tmp_path / "cat" / "items").mkdir(parents=True)
    (tmp_path / "cat" / "catalog.json").write_text(json.dumps({"type": "Catalog", "id": "c", "links": []}))
    for k in range(3):
        doc = {"type": "Feature", "id": f"i{k}", "collection": "c", "bbox": [0, 0, 4, 4], "properties": {"datetime": f"2024-01-0{k + 1}T00:00:00Z", "cloud": str(10 * k)}}
        (tmp_path / "cat" / "items" / f"i{k}.json").write_text(json.dumps(doc, indent=1))
    pixels = spark.createDataFrame([(f"i{k}", y, x, float(k)) for k in range(3) for y in range(4) for x in range(4)], "item_id string, y int, x int, a double")
    loaders = session_loaders(spark, stac={"pixels": pixels, "grid": Grid(4, 4, (0.0, 0.0, 4.0, 4.0)), "known": {"a": BandInfo()}})
    load = lambda url, **more: execute({"l": {"process_id": "load_stac", "arguments": {"url": str(url), **more}, "result": True}}, loaders=loaders)
    assert len(load(tmp_path / "cat" / "catalog.json").labels()) == 3
    assert load(tmp_path / "cat" / "items" / "i1.json").labels() == [datetime(2024, 1, 2)]
    assert len(load(tmp_path / "cat" / "catalog.json", properties={"cloud": "20"}).labels()) == 1
    spark.createDataFrame([(y, x, 1.0 * y, None) for y in range(2) for x in range(3)], "y int, x int, a double, b double").write.parquet(str(tmp_path / "t"))
    one = execute({"l": {"process_id": "load_url", "arguments": {"url": str(tmp_path / "t")}, "result": True}}, loaders=loaders)
    assert one.bands == ("a", "b") and (one.grid.width, one.grid.height) == (3, 2)
    with pytest.raises(errors.ProcessUnsupported):
        execute({"l": {"process_id": "load_url", "arguments": {"url": "x"}, "result": True}})


def test_of_equal_orders_the_first_row_is_taken(spark, tmp_path):
    """As the SQL does with threads = 1: the order number leaves it open, the place in the table tells."""
    from rasterloom.queries_geometry import _images
    from rasterloom.sources.tables import scenes

    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    day = datetime(2024, 1, 5)
    parts = [[(9, 1, 3, 4, 8.0, 1.0, 0.1, 0.0, day), (7, 1, 3, 4, None, 2.0, 0.1, 0.0, day), (7, 1, 3, 4, 5.0, 3.0, 0.1, 0.0, day)], [(7, 1, 3, 4, 6.0, 4.0, 0.1, 0.0, day), (8, 1, 3, 4, 9.0, 5.0, 0.1, 0.0, day)]]
    for files in (1, 2):
        d = tmp_path / str(files)
        (d / "lineitem.parquet").mkdir(parents=True)
        for i, rows in enumerate(parts if files == 2 else [parts[0] + parts[1]]):
            one = spark.createDataFrame(rows, schema).coalesce(1)
            one.write.parquet(str(tmp_path / f"{files}-{i}"))
            next((tmp_path / f"{files}-{i}").glob("part-*.parquet")).rename(d / "lineitem.parquet" / f"{i}.parquet")
        pixels, _ = _images(spark, str(d))
        assert [tuple(r) for r in pixels.collect()] == [("1", 3, 4, 5.0)]
        assert [(r["quantity"], r["price"]) for r in scenes(spark, str(d)).pixels.collect()] == [(5.0, 2.0)]
