import itertools
import json
import math
import random
from datetime import datetime

import pytest

from rasterloom.cube import Grid
from rasterloom.errors import ProcessParameterInvalid
from rasterloom.sources import intersects
from rasterloom.sources.catalog import Collection, search
from rasterloom.sources.intersects import intersecting, segments

ITEMS = "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>, geometry string"


def collection(spark, rows):
    out = []
    for i, g, props in rows:
        pts = [p for r in (g["coordinates"] if g["type"] == "Polygon" else [x for p in g["coordinates"] for x in p]) for p in r]
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        out.append((i, "c", datetime(2024, 1, 1 + len(out) % 20), float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)), props, json.dumps(g)))
    return Collection("c", spark.createDataFrame(out, ITEMS), spark.range(0), Grid(1, 1, (0.0, 0.0, 1.0, 1.0)))


def poly(*rings):
    return {"type": "Polygon", "coordinates": [[list(p) for p in r] for r in rings]}


def box(w, s, e, n):
    return poly([(w, s), (e, s), (e, n), (w, n), (w, s)])


SQUARE_WITH_HOLE = poly([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(3, 3), (7, 3), (7, 7), (3, 7), (3, 3)])


@pytest.mark.parametrize(
    ("query", "want"),
    [
        (SQUARE_WITH_HOLE, {"crossing", "inside", "around", "touching", "two"}),
        ({"type": "Point", "coordinates": [5, 5]}, {"hole", "around"}),
        ({"type": "Point", "coordinates": [30.5, 30.5]}, {"two"}),
        ({"type": "Point", "coordinates": [10, 10]}, {"around", "touching"}),
        ({"type": "LineString", "coordinates": [[-1, 1.5], [1.5, 1.5]]}, {"inside", "around"}),
        ({"type": "LineString", "coordinates": [[4.2, 4.2], [4.4, 4.4]]}, {"hole", "around"}),
        ({"type": "MultiPolygon", "coordinates": [box(30.2, 30.2, 30.4, 30.4)["coordinates"], box(4.1, 4.1, 4.2, 4.2)["coordinates"]]}, {"hole", "two", "around"}),
        (box(50, 50, 51, 51), set()),
        ({"type": "GeometryCollection", "geometries": []}, set()),
        ({"type": "Feature", "geometry": box(29, 29, 40, 40), "properties": {}}, {"two"}),
    ],
)
def test_geometries_that_meet(spark, query, want):
    rows = [
        ("hole", box(4, 4, 6, 6), {}), ("inside", box(1, 1, 2, 2), {}), ("crossing", box(9, 2, 12, 4), {}), ("touching", box(10, 10, 11, 11), {}), ("around", box(-20, -20, 25, 25), {}), ("far", box(11, 0, 12, 1), {}),
        ("two", {"type": "MultiPolygon", "coordinates": [box(30, 30, 31, 31)["coordinates"], box(0.1, 0.1, 0.2, 0.2)["coordinates"]]}, {}),
    ]
    got = search(collection(spark, rows), intersects=query)
    assert {r["id"] for r in got.collect()} == want and got.columns == [c.split()[0] for c in ITEMS.split(", ")]


def inside(p, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def cut(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def star(rng, x, y, size, n):
    import math

    return [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_many_edges_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(intersects, "EDGES", 3)
    rng = random.Random(4)
    shapes = [star(rng, rng.uniform(0, 20), rng.uniform(0, 20), rng.choice([0.3, 2, 9]), rng.randrange(3, 12)) for _ in range(80)]
    asked = star(rng, 10, 10, 6, 90)
    want = set()
    for i, s in enumerate(shapes):
        edges = itertools.product(zip(s, s[1:] + s[:1]), zip(asked, asked[1:] + asked[:1]))
        if any(cut(*a, *b) for a, b in edges) or inside(s[0], asked) or inside(asked[0], s):
            want.add(f"i{i}")
    c = collection(spark, [(f"i{i}", poly(s), {}) for i, s in enumerate(shapes)])
    assert {r["id"] for r in intersecting(c.items, poly(asked)).collect()} == want and 10 < len(want) < 70
    assert len(segments(poly(asked))[0]) == 90


def test_bounding_boxes_stand_in_for_geometries(spark):
    c = collection(spark, [("a", box(0, 0, 2, 2), {}), ("b", box(5, 5, 6, 6), {})])
    bare = c.items.drop("geometry")
    assert [r["id"] for r in intersecting(bare, box(1, 1, 1.5, 1.5)).collect()] == ["a"]
    null = c.items.selectExpr(*[x for x in bare.columns], "cast(null as string) as geometry")
    assert [r["id"] for r in intersecting(null, box(5.5, 5.5, 9, 9)).collect()] == ["b"]


def test_ids_order_fields_and_limit(spark):
    rows = [(f"i{k}", box(k, 0, k + 1, 1), {"cloud": v} if v else {}) for k, v in enumerate(["9", "10", None, "2", "2"])]
    c = collection(spark, rows)
    ids = lambda **how: [r["id"] for r in search(c, **how).collect()]
    assert set(ids(ids=["i1", "i3", "none"])) == {"i1", "i3"}
    assert ids(sortby="properties.cloud") == ["i3", "i4", "i0", "i1", "i2"]
    assert ids(sortby=["-properties.cloud", "-id"]) == ["i1", "i0", "i3", "i4", "i2"] or ids(sortby=["-properties.cloud", "-id"]) == ["i1", "i0", "i4", "i3", "i2"]
    assert ids(sortby="-datetime", limit=2) == ["i4", "i3"]
    assert ids(limit=3) == ["i0", "i1", "i2"] and ids(limit=0) == []
    assert search(c, fields=["id", "west"], ids=["i2"]).collect()[0].asDict() == {"id": "i2", "west": 2.0}
    with pytest.raises(ProcessParameterInvalid):
        search(c, sortby="colour")
    assert len(ids(ids=[f"i{k}" for k in range(2000)])) == 5


def test_a_search_by_geometry_is_a_filter(spark):
    """Items are not moved, joined or held, whatever their number."""
    df = spark.range(50).selectExpr("cast(id as string) as id", "id * 1.0 as west", "id * 1.0 as south", "id + 1.0 as east", "id + 1.0 as north")
    ring = [[25 + 20 * math.cos(a / 50 * math.pi), 25 + 20 * math.sin(a / 50 * math.pi)] for a in range(100)]
    found = intersecting(df, {"type": "Polygon", "coordinates": [[*ring, ring[0]]]})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Join", "Aggregate"))
    assert {int(r["id"]) for r in found.collect()} == set(range(10, 40))
