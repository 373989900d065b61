import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rasterloom.cube import Cube, Footprints, Grid
from rasterloom.functions import reducers
from rasterloom.operators import combine, pixels, resample, spatial, temporal
from rasterloom.operators.footprints import cells_of_geometries, edges_of, rings_of
from rasterloom.sources.catalog import BandInfo, Collection, load_collection, stac_items

D1, D2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def box(w, s, e, n):
    return json.dumps({"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]})


def marked(make, rows, days=("2024-01-01", "2024-01-02")):
    cube = make({d: {"b1": [[1.0 + k] * 4 for _ in range(4)]} for k, d in enumerate(days)})
    table = cube.df.sparkSession.createDataFrame(rows, "t timestamp_ntz, geometry string")
    return Cube(cube.df, cube.bands, cube.grid, times=cube.times, footprints=Footprints(table))


def seen(cube):
    return {(r["t"], r["y"], r["x"]) for r in cube.df.collect() if r[cube.bands[0]] is not None}


LEFT, RIGHT, TOP = box(0, 0, 2, 4), box(2, 0, 4, 4), box(0, 2, 4, 4)


def cells(t, keep):
    return {(t, y, x) for y in range(4) for x in range(4) if keep(y, x)}


def test_geometries(spark):
    multi = json.dumps({"type": "MultiPolygon", "coordinates": [json.loads(LEFT)["coordinates"], [[[2.5, 0], [4, 0], [4, 1.2]]]]})
    feature = json.dumps({"type": "Feature", "properties": {}, "geometry": json.loads(TOP)})
    hole = json.dumps({"type": "Polygon", "coordinates": [json.loads(box(0, 0, 4, 4))["coordinates"][0], json.loads(box(1, 1, 3, 3))["coordinates"][0]]})
    rows = [("multi", multi), ("feature", feature), ("hole", hole), ("point", '{"type": "Point", "coordinates": [1, 1]}'), ("null", None), ("text", "no json"), ("far", box(90, 10, 91, 11))]
    df = spark.createDataFrame(rows, "k string, geometry string")
    n = {r["k"]: r["n"] for r in df.select("k", F.size(rings_of(F.col("geometry"))).alias("n")).collect()}
    assert n == {"multi": 2, "feature": 1, "hole": 2, "point": None, "null": None, "text": None, "far": 1}
    assert df.where("k = 'multi'").select(F.size(edges_of(F.col("geometry")))).first()[0] == 5 + 3
    got = {}
    for r in cells_of_geometries(df, Grid(4, 4, (0.0, 0.0, 4.0, 4.0)), ["k"]).collect():
        got.setdefault(r["k"], set()).add((r["y"], r["x"]))
    assert got["feature"] == {(y, x) for y in (0, 1) for x in range(4)}
    assert got["hole"] == {(y, x) for y in range(4) for x in range(4) if not (y in (1, 2) and x in (1, 2))}
    assert got["multi"] == {(y, x) for y in range(4) for x in (0, 1)} | {(3, 3)}
    assert set(got) == {"multi", "feature", "hole"}


def test_slices_are_cut_to_their_own_footprints(make):
    cube = spatial.cutline(marked(make, [(D1, LEFT), (D1, TOP), (D2, RIGHT)]))
    assert seen(cube) == cells(D1, lambda y, x: x < 2 or y < 2) | cells(D2, lambda y, x: x >= 2)


def test_absent_footprints_mean_everything(make):
    assert seen(spatial.cutline(marked(make, [(D1, LEFT), (D1, None), (D2, RIGHT)]))) == cells(D1, lambda y, x: True) | cells(D2, lambda y, x: x >= 2)
    # a slice without any row, and a cube without footprints
    assert seen(spatial.cutline(marked(make, [(D1, LEFT)]))) == cells(D1, lambda y, x: x < 2) | cells(D2, lambda y, x: True)
    assert seen(spatial.cutline(marked(make, []))) == cells(D1, lambda y, x: True) | cells(D2, lambda y, x: True)
    plain = make({"2024-01-01": {"b1": [[1.0]]}})
    assert spatial.cutline(plain) is plain


def test_reducers_join_footprints(make):
    one = datetime(1900, 1, 1)
    cube = marked(make, [(D1, LEFT), (D2, TOP)])
    for c in (temporal.reduce_dimension(cube, lambda s, _: reducers.mean(s), "t"), temporal.apply_pixel_selection(cube, "first")):
        assert seen(spatial.cutline(c)) == cells(one, lambda y, x: x < 2 or y < 2)
    everything = temporal.apply_pixel_selection(marked(make, [(D1, LEFT), (D2, None)]), "mean")
    assert seen(spatial.cutline(everything)) == cells(one, lambda y, x: True)


def test_intervals_labels_merges_and_grids(make):
    cube = marked(make, [(D1, LEFT), (D2, TOP)])
    weeks = temporal.aggregate_temporal(cube, [["2024-01-01", "2024-01-02"], ["2024-01-01", "2024-01-03"]], lambda s, _: reducers.mean(s), ["2024-02-01", "2024-02-02"])
    assert seen(spatial.cutline(weeks)) == cells(datetime(2024, 2, 1), lambda y, x: x < 2) | cells(datetime(2024, 2, 2), lambda y, x: x < 2 or y < 2)
    named = pixels.rename_labels(cube, "t", ["2024-03-01", "2024-03-02"])
    assert seen(spatial.cutline(named)) == cells(datetime(2024, 3, 1), lambda y, x: x < 2) | cells(datetime(2024, 3, 2), lambda y, x: y < 2)
    other = marked(make, [(D1, RIGHT)], ("2024-01-01",))
    merged = combine.merge_cubes(cube, other, lambda a, b, _: a)
    assert seen(spatial.cutline(merged)) == cells(D1, lambda y, x: True) | cells(D2, lambda y, x: y < 2)
    assert combine.merge_cubes(cube, make({"2024-01-05": {"b1": [[1.0] * 4] * 4}})).footprints is None
    finer = resample.to_grid(cube, Grid(8, 8, cube.grid.bounds), "near")
    assert len(seen(spatial.cutline(finer))) == 32 + 32
    doubled = pixels.apply(cube, lambda x, _: x * 2)
    assert seen(spatial.cutline(doubled)) == seen(spatial.cutline(cube))
    listed = spatial.cutline(cube, json.loads(RIGHT))
    assert seen(listed) == cells(D1, lambda y, x: x >= 2) | cells(D2, lambda y, x: x >= 2)


def test_items_bring_their_geometries(spark, tmp_path):
    for k, g in enumerate((LEFT, None, TOP)):
        item = {"type": "Feature", "id": f"i{k}", "collection": "c", "bbox": [0, 0, 4, 4], "geometry": g and json.loads(g), "properties": {"datetime": f"2024-01-0{min(k, 1) + 1}T00:00:00Z"}}
        (tmp_path / f"{k}.json").write_text(json.dumps(item))
    items = stac_items(spark, str(tmp_path))
    rows = [(f"i{k}", y, x, float(k)) for k in range(3) for y in range(4) for x in range(4)]
    c = Collection("c", items, spark.createDataFrame(rows, "item_id string, y int, x int, b1 double"), Grid(4, 4, (0.0, 0.0, 4.0, 4.0)), {"b1": BandInfo()})
    cube = load_collection(c)
    assert seen(spatial.cutline(cube)) == cells(D1, lambda y, x: x < 2) | cells(D2, lambda y, x: True)


@pytest.mark.parametrize("crs", [3857, 32631])
def test_footprints_are_degrees_on_any_grid(make, crs):
    cube = marked(make, [(D1, box(0, 0, 2, 4)), (D2, box(0, 0, 4, 4))])
    other = resample.resample_spatial(cube, projection=crs, resolution=50_000)
    got = seen(spatial.cutline(other))
    ones, alls = {k[1:] for k in got if k[0] == D1}, {k[1:] for k in got if k[0] == D2}
    assert ones < alls and 0.4 < len(ones) / len(alls) < 0.6


def test_items_are_read_once_for_all_their_footprints(spark):
    """The cells, the times and the items without a footprint all come from one reading of the items."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def shape(i):
        read.add(1)
        return '{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 2], [0, 2]]]}'

    items = spark.range(3, numPartitions=1).selectExpr(
        "cast(id as string) as id", "'c' as collection", "timestamp_ntz'2024-01-01' as datetime", "0.0 as west", "0.0 as south", "2.0 as east", "2.0 as north", "map('a', 'b') as properties"
    )
    pixels = spark.createDataFrame([("0", 0, 0, 1.0), ("1", 0, 1, 2.0)], "item_id string, y int, x int, a double")
    c = load_collection(Collection("c", items.withColumn("geometry", shape("id")), pixels, Grid(2, 2, (0.0, 0.0, 2.0, 2.0)), {"a": BandInfo()}))
    got = {(r["y"], r["x"]): r["a"] for r in spatial.cutline(c).df.collect()}
    assert got == {(0, 0): 1.0, (0, 1): None, (1, 0): None, (1, 1): None}
    assert read.value == 3
