"""Queries in radar geometry and other projections; they are registered beside those of ``queries``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import projections
from rasterloom.cube import Cube, Grid
from rasterloom.functions import reducers
from rasterloom.operators import geocode, pixels, resample, spatial, temporal
from rasterloom.plans.graph import bind, execute
from rasterloom.queries import EV, SCENES, _each, query, r, rows
from rasterloom.sinks.tiles import tiles_of
from rasterloom.sources import annotation
from rasterloom.sources.bandsources import Radar
from rasterloom.sources.catalog import BandInfo, load_collection, search
from rasterloom.sources.images import FRAMES, Images
from rasterloom.sources.tables import SCENE_BANDS, events_cube, first_by_order, order_catalog, scene_cube, scenes, table, with_row_order

# Radar images out of line items: one per line number, lines by part and pixels by supplier.  Their control
# points lie on a bent sheet whose bend is the image's mean discount.

RADAR_SIDE = 32
RADAR_GRID = Grid(20, 16, (9.9, 49.4, 11.0, 50.2), 4326)
RADAR_WEB = Grid(18, 14, (1104000.0, 6345000.0, 1221000.0, 6462000.0), 3857)

RADAR = f"""
p as (select l_linenumber::varchar as item, l_partkey % {RADAR_SIDE} as line, l_suppkey % {RADAR_SIDE} as pixel, arg_min(l_quantity, l_orderkey) as dn from lineitem group by all),
bend as (select l_linenumber::varchar as item, 10 * avg(l_discount) as c from lineitem group by all),
gcp as (
  select item, u * 8.0::double as line, v * 8.0::double as pixel,
    10 + 0.02::double * v * 8 + 0.004::double * u * 8 + 0.0003::double * c * u * v * 64 as x, 50 - 0.015::double * u * 8 + 0.003::double * v * 8 + 0.0002::double * c * u * u * 64 as y
  from bend, range(5) a(u), range(5) b(v)),
knots as (select item, list(x order by line, pixel) as kx, list(y order by line, pixel) as ky, list(line order by line, pixel) as ls, list(pixel order by line, pixel) as ps from gcp group by item),
""".strip()

# The spline's equations, solved by elimination with row pivots: a step per unknown.
_BENT = "case when {s} > 0 then 0.5 * {s} * ln({s}) else 0 end"
SPLINE = f"""
system as (
  select item, kx, ky, list_concat(
    list_transform(range(1, len(kx) + 1), lambda i: list_concat(
      list_transform(range(1, len(kx) + 1), lambda j: {_BENT.format(s="((kx[i] - kx[j]) ** 2 + (ky[i] - ky[j]) ** 2)")}), [1.0::double, kx[i], ky[i], ls[i], ps[i]])),
    [list_concat(list_transform(kx, lambda v: 1.0::double), [0.0::double, 0, 0, 0, 0]), list_concat(kx, [0.0::double, 0, 0, 0, 0]), list_concat(ky, [0.0::double, 0, 0, 0, 0])]) as m
  from knots),
step(item, k, m) as (
  select item, 0, m from system
  union all
  select item, k, list_transform(s, lambda row, i: case when i = k then q else list_transform(row, lambda v, j: v - row[k] * q[j]) end)
  from (
    select item, k, list_transform(m[p], lambda v: v / m[p][k]) as q, list_transform(m, lambda row, i: case when i = p then m[k] else row end) as s
    from (
      select item, k + 1 as k, m, k + list_position(list_transform(m[k + 1:], lambda row: abs(row[k + 1])), list_max(list_transform(m[k + 1:], lambda row: abs(row[k + 1])))) as p
      from step where k < len(m)))),
curve as (
  select s.item, kx, ky, list_transform(m, lambda row: row[len(m) + 1]) as wl, list_transform(m, lambda row: row[len(m) + 2]) as wp from step s join system using (item) where k = len(s.m)),
"""
SPLINE = SPLINE.replace("select s.item, kx, ky, list_transform(m, lambda row: row[len(m) + 1]) as wl, list_transform(m, lambda row: row[len(m) + 2]) as wp", "select s.item, kx, ky, list_transform(s.m, lambda row: row[len(s.m) + 1]) as wl, list_transform(s.m, lambda row: row[len(s.m) + 2]) as wp")


def _place_sql(grid: Grid, lon: str, lat: str) -> str:
    """Line and pixel of every cell in every image."""
    west, _, _, north = grid.bounds
    value = "list_sum(list_transform(range(1, len(kx) + 1), lambda j: {w}[j] * (" + _BENT.format(s="((lon - kx[j]) ** 2 + (lat - ky[j]) ** 2)") + "))) + {w}[len(kx) + 1] + {w}[len(kx) + 2] * lon + {w}[len(kx) + 3] * lat"
    return f"""
cells as (select v.y::int as y, u.x::int as x, ({west}::double + (u.x + 0.5) * {grid.dx!r}::double) as px, ({north}::double - (v.y + 0.5) * {grid.dy!r}::double) as py from range({grid.height}) v(y), range({grid.width}) u(x)),
located as (select y, x, {lon} as lon, {lat} as lat from cells),
placed as (select item, y, x, {value.format(w="wl")} as line, {value.format(w="wp")} as pixel from curve, located)
"""


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pixels and control points of the radar images."""
    li = table(spark, sf_dir, "lineitem")
    item = F.col("l_linenumber").cast("string").alias("item_id")
    pixels = with_row_order(li, "l_orderkey").groupBy(item, (F.col("l_partkey") % RADAR_SIDE).alias("line"), (F.col("l_suppkey") % RADAR_SIDE).alias("pixel")).agg(first_by_order("l_quantity").alias("dn"))
    bend = li.groupBy(item).agg((10 * F.avg("l_discount")).alias("c"))
    at = F.explode(F.array(*[F.lit(8.0 * i) for i in range(5)]))
    points = bend.withColumn("line", at).withColumn("pixel", at)
    line, pixel, c = F.col("line"), F.col("pixel"), F.col("c")
    x = 10 + 0.02 * pixel + 0.004 * line + 0.0003 * c * line * pixel
    y = 50 - 0.015 * line + 0.003 * pixel + 0.0002 * c * line * line
    return pixels, points.select("item_id", "line", "pixel", x.alias("x"), y.alias("y"))


_INSIDE = f"line >= 0 and line < {RADAR_SIDE} and pixel >= 0 and pixel < {RADAR_SIDE}"


@query(
    "geocode_spline",
    f"with recursive {RADAR} {SPLINE} {_place_sql(RADAR_WEB, f'degrees(px / {projections.SPHERE})', f'degrees(2 * atan(exp(py / {projections.SPHERE})) - pi() / 2)')}"
    f" select item as item_id, y, x, {r('line', 'line')}, {r('pixel', 'pixel')} from placed where {_INSIDE}",
)
def geocode_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and pixels of the cells of a web map in every image that holds them."""
    _, points = _images(spark, sf_dir)
    return rows(geocode.inverse_map(geocode.splines(points), RADAR_WEB).where(_INSIDE))


@query(
    "geocode_bilinear",
    f"""with recursive {RADAR} {SPLINE} {_place_sql(RADAR_GRID, "px", "py")},
inside as (select * from placed where {_INSIDE}),
near as (select i.item, i.y, i.x, p.dn, (1 - abs(i.line - 0.5 - p.line)) * (1 - abs(i.pixel - 0.5 - p.pixel)) as w, floor(i.line) = p.line and floor(i.pixel) = p.pixel as here
  from inside i join p on p.item = i.item and abs(i.line - 0.5 - p.line) < 1 and abs(i.pixel - 0.5 - p.pixel) < 1),
g as (select item as item_id, y, x, sum(w * dn) / sum(w) as dn from near group by all having bool_or(here))
select item_id, y, x, {r("dn", "dn")} from g""",
)
def geocode_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images on a map grid, bilinear between their own lines and pixels."""
    images, points = _images(spark, sf_dir)
    return rows(geocode.geocode(images, points, ["dn"], RADAR_GRID))


# zones of UTM


def _sum_sql(rows_: tuple, sign: str, angle: str, a: str, b: str, xi: str, eta: str) -> str:
    return "".join(f" {sign} {c!r}::double * {a}({2 * j} * {xi}) * {b}({2 * j} * {eta})" for j, c in enumerate(projections.series(rows_), 1)) + angle


def _from_zone_sql(crs: int) -> str:
    """``lon, lat`` of ``cells(px, py)`` in a zone, a step of the series in each table."""
    meridian, north = projections.zone(crs)
    size = projections.SCALE * projections._RADIUS
    p = _sum_sql(projections.INVERSE, "-", "", "sin", "cosh", "xi", "eta")
    q = _sum_sql(projections.INVERSE, "-", "", "cos", "sinh", "xi", "eta")
    lat = "".join(f" + {d!r}::double * sin({2 * j} * chi)" for j, d in enumerate(projections.series(projections.LATITUDE), 1))
    return f"""
scaled as (select *, (py - {north}) / {size!r}::double as xi, (px - {projections.FALSE_EAST}) / {size!r}::double as eta from cells),
summed as (select *, xi {p} as p, eta {q} as q from scaled),
conformal as (select *, asin(sin(p) / cosh(q)) as chi from summed),
located as (select *, {meridian} + degrees(atan2(sinh(q), cos(p))) as lon, degrees(chi {lat}) as lat from conformal)
"""


ZONE = 32631
UTM_GRID = Grid(15, 18, (100_000.0, 0.0, 1_000_000.0, 900_000.0), ZONE)


@query(
    "resample_utm",
    f"""{EV},
cells as (select v.y::int as y, u.x::int as x, {UTM_GRID.bounds[0]}::double + (u.x + 0.5) * {UTM_GRID.dx!r}::double as px, {UTM_GRID.bounds[3]}::double - (v.y + 0.5) * {UTM_GRID.dy!r}::double as py from range({UTM_GRID.height}) v(y), range({UTM_GRID.width}) u(x)),
{_from_zone_sql(ZONE)},
times as (select distinct t from c)
select times.t, l.y, l.x, {_each("c.{b}")} from times cross join located l left join c on c.t = times.t and c.y = floor(8 - l.lat) and c.x = floor(l.lon)""",
)
def resample_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an 8 by 8 degree grid on cells of 60 by 50 km of a UTM zone."""
    return rows(resample.to_grid(events_cube(spark, sf_dir), UTM_GRID, "near"))


@query(
    "resample_utm_average",
    f"""{SCENES},
corners as (select u.v as lon, w.v as lat from range(17) u(v), range(17) w(v)),
centres as (select y, x, x + 0.5 as lon, 16 - (y + 0.5) as lat from (select distinct y, x from s)),
angles as (select *, radians(lon - 9) as lam, sin(radians(lat)) as sn from centres),
flat as (select *, sinh(atanh(sn) - {projections._E!r}::double * atanh({projections._E!r}::double * sn)) as tt from angles),
turned as (select *, atan2(tt, cos(lam)) as xi, asinh(sin(lam) / sqrt(tt * tt + cos(lam) * cos(lam))) as eta from flat),
mapped as (select y, x, 500000 + {projections.SCALE * projections._RADIUS!r}::double * (eta {_sum_sql(projections.FORWARD, "+", "", "cos", "sinh", "xi", "eta")}) as px,
  {projections.SCALE * projections._RADIUS!r}::double * (xi {_sum_sql(projections.FORWARD, "+", "", "sin", "cosh", "xi", "eta")}) as py from turned),
k as (select y as oy, x as ox, floor((1800000 - py) / 300000)::int as y, floor((px + 500000) / 300000)::int as x from mapped),
frame as (select t, v.y::int as y, u.x::int as x from (select distinct t from s), range(6) v(y), range(7) u(x)),
a as (select s.t, k.y, k.x, {", ".join(f"avg({b}) as {b}" for b in SCENE_BANDS)} from s join k on s.y = k.oy and s.x = k.ox group by all)
select f.t, f.y, f.x, {_each("a.{b}", SCENE_BANDS)} from frame f left join a on a.t = f.t and a.y = f.y and a.x = f.x""",
)
def resample_utm_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes averaged on cells of 300 km of a UTM zone."""
    return rows(resample.to_grid(scene_cube(spark, sf_dir), Grid(7, 6, (-500_000.0, 0.0, 1_600_000.0, 1_800_000.0), 32632), "average"))




# Annotations of every image: three range vectors, and five azimuth blocks that overlap, from the image's number of line items.

_COUNT = "c as (select l_linenumber::varchar as item, count(*) % 7 as c from lineitem group by 1)"
_NODES = (0, 8, 20, 32)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, asset, value``: a calibration and a noise document of each image."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("item_id")).agg((F.count("*") % 7).cast("int").alias("c"))
    nodes = " ".join(map(str, _NODES))

    def text(parts: list) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def values(add: int, i: int, k: int) -> list:
        return [x for j in range(4) for x in (F.col("c") + add + k * i * i + 2 * j * j, " ")]

    noise: list = ["<noise><noiseRangeVectorList>"]
    calibration: list = ["<calibration><calibrationVectorList>"]
    for i in range(3):
        noise += [f"<noiseRangeVector><line>{16 * i}</line><pixel>{nodes}</pixel><noiseRangeLut>", *values(100, i, 3), "</noiseRangeLut></noiseRangeVector>"]
        calibration += [f'<calibrationVector><line>{16 * i}</line><pixel count="4">{nodes}</pixel><sigmaNought count="4">', *values(20, i, 5), "</sigmaNought></calibrationVector>"]
    noise += ["</noiseRangeVectorList><noiseAzimuthVectorList>"]
    for k in range(5):
        ends = f"<firstAzimuthLine>{6 * k}</firstAzimuthLine><lastAzimuthLine>{6 * k + 9}</lastAzimuthLine><firstRangeSample>{5 * k}</firstRangeSample><lastRangeSample>{5 * k + 14}</lastRangeSample>"
        noise += [f"<noiseAzimuthVector>{ends}<line>{6 * k} {6 * k + 4} {6 * k + 9}</line><noiseAzimuthLut>", 1 + F.col("c") / 8, f" 2 {1 + k / 4}</noiseAzimuthLut></noiseAzimuthVector>"]
    noise += ["</noiseAzimuthVectorList></noise>"]
    calibration += ["</calibrationVectorList></calibration>"]
    both = [F.struct(F.lit(f"schema-{n}-dn").alias("asset"), text(d).alias("value")) for n, d in (("calibration", calibration), ("noise", noise))]
    return c.select("item_id", F.explode(F.array(*both)).alias("d")).select("item_id", "d.asset", "d.value")


def _annotated_sql(source: str) -> str:
    """``lut``: noise and calibration of ``source(item, line, pixel)``."""
    at = lambda add, k: f"({add} + c + {k} * i * i + 2 * j * j) * (1 - tl) * (1 - tp) + ({add} + c + {k} * i * i + 2 * (j + 1) * (j + 1)) * (1 - tl) * tp + ({add} + c + {k} * (i + 1) * (i + 1) + 2 * j * j) * tl * (1 - tp) + ({add} + c + {k} * (i + 1) * (i + 1) + 2 * (j + 1) * (j + 1)) * tl * tp"
    return f"""{_COUNT},
spot as (select *, case when line < 16 then 0 else 1 end as i, case when pixel < 8 then 0 when pixel < 20 then 1 else 2 end as j from {source} join c using (item)),
share as (select *, greatest(0, least(1, (line - 16 * i) / 16.0)) as tl, greatest(0, least(1, (pixel - [0, 8, 20][j + 1]) / [8.0, 12.0, 12.0][j + 1])) as tp from spot),
factor as (
  select item, line, pixel, arg_max(case when line <= 6 * k + 4 then (1 + c / 8.0) + (1 - c / 8.0) * (line - 6 * k) / 4.0 else 2 + (k / 4.0 - 1) * (line - 6 * k - 4) / 5.0 end, k) as f
  from (select distinct item, line, pixel, c from spot) join range(5) b(k) on line between 6 * k and 6 * k + 9 and pixel between 5 * k and 5 * k + 14 group by all),
lut as (select share.*, ({at(100, 3)}) * coalesce(f, 1) as noise, {at(20, 5)} as gain from share left join factor using (item, line, pixel))"""


@query(
    "noise_blocks",
    f"""with q as (select l_orderkey, l_linenumber, l_linenumber::varchar as item, (l_partkey % 32) + 0.5::double as line, (l_suppkey % 32) + 0.25::double as pixel from lineitem),
{_annotated_sql("q")} select l_orderkey, l_linenumber, {r("noise", "noise")} from lut""",
)
def noise_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise at every line item's place in its image, by range vectors and overlapping azimuth blocks of all images."""
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("item_id"), (F.col("l_partkey") % 32 + 0.5).alias("line"), (F.col("l_suppkey") % 32 + 0.25).alias("pixel"))
    documents = _documents(spark, sf_dir).where("asset = 'schema-noise-dn'")
    return rows(annotation.noise_of(points, documents, "noise", item="item_id").select("l_orderkey", "l_linenumber", "noise"))


BACKSCATTER = {
    "load": {"process_id": "load_collection", "arguments": {"id": "radar", "bands": ["vv"], "spatial_extent": {"west": 9.9, "south": 49.4, "east": 11.0, "north": 50.2}, "width": 20, "height": 16}},
    "sar": {"process_id": "sar_backscatter", "arguments": {"data": {"from_node": "load"}, "coefficient": "sigma0-ellipsoid"}, "result": True},
}


@query(
    "radar_backscatter",
    f"""with recursive {RADAR} {SPLINE} {_place_sql(RADAR_GRID, "px", "py")},
inside as (select item, y, x, line, pixel from placed where {_INSIDE}),
{_annotated_sql("inside")},
valued as (select lut.item, lut.y, lut.x, nullif(p.dn, 0) as dn, noise, gain from lut join p on p.item = lut.item and p.line = floor(lut.line) and p.pixel = floor(lut.pixel)),
m as (select y, x, arg_min(dn, item) as dn, arg_min(noise, item) as noise, arg_min(gain, item) as gain from valued where dn is not null group by all),
g as (select v.y::int as y, u.x::int as x from range({RADAR_GRID.height}) v(y), range({RADAR_GRID.width}) u(x))
select timestamp '2024-01-01' as t, g.y, g.x, {r("greatest(dn * dn - noise, 0) / (gain * gain)", "vv")} from g left join m on m.y = g.y and m.x = g.x""",
)
def radar_backscatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that names backscatter only: control points, calibration and noise of the images are found and used."""
    images, points = _images(spark, sf_dir)
    west, south, east, north = RADAR_GRID.bounds
    box = [F.lit(v).alias(n) for n, v in zip(("west", "south", "east", "north"), (west, south, east, north), strict=True)]
    items = points.select("item_id").distinct().select(F.col("item_id").alias("id"), F.lit("sentinel-1-grd").alias("collection"), F.lit("2024-01-01").cast("timestamp_ntz").alias("datetime"), *box, F.lit(None).cast("map<string,string>").alias("properties"))
    documents = _documents(spark, sf_dir).withColumn("asset", F.regexp_replace("asset", "-dn$", "-vv"))
    href = F.concat_ws("/", "item_id", "asset").alias("href")
    assets = documents.select("item_id", F.lit("sentinel-1-grd").alias("collection"), "asset", F.lit("application/xml").alias("media_type"), F.array(F.lit("metadata")).alias("roles"), href)
    radar = Radar(images.withColumnRenamed("dn", "vv"), points, assets, documents.select(href, "value"))
    radar = radar.collection("radar", items, RADAR_GRID, ["vv"])
    return rows(execute(BACKSCATTER, loaders={"load_collection": bind(load_collection, {"radar": radar})}))


# Footprints: the scenes of lines 1 and 2 lie in a triangle and in two squares, those of line 2 in some months anywhere.

_TRIANGLE = '{"type": "Polygon", "coordinates": [[[0, 0], [15.3, 0], [0, 15.3]]]}'
_SQUARES = '{"type": "MultiPolygon", "coordinates": [[[[8.2, 8.2], [12.2, 8.2], [12.2, 12.2], [8.2, 12.2], [8.2, 8.2]]], [[[2.2, 11.2], [4.2, 11.2], [4.2, 15.2], [2.2, 15.2]]]]}'
_IN_TRIANGLE = "x + 0.5 + 16 - (y + 0.5) < 15.3"
_IN_SQUARES = "((x + 0.5 between 8.2 and 12.2 and 15.5 - y between 8.2 and 12.2) or (x + 0.5 between 2.2 and 4.2 and 15.5 - y between 11.2 and 15.2))"
_OF_LINES = SCENES.replace("from p group by all", "from p where item like '%-1' or item like '%-2' group by all").replace("(select distinct t from p)", "(select distinct t from p where item like '%-1' or item like '%-2')")


def _scenes_with_footprints(spark: SparkSession, sf_dir: str, anywhere: bool) -> Cube:
    c = scenes(spark, sf_dir)
    line = F.col("properties")["line"]
    open_ = F.lit(anywhere) & (F.month("datetime") % 4 == 0)
    shape = F.when(line == "1", _TRIANGLE).when((line == "2") & ~open_, _SQUARES)
    c = replace(c, items=c.items.withColumn("geometry", shape), narrow=None)
    return load_collection(c, bands=["quantity"], properties={"line": {"process_graph": {"r": {"process_id": "in", "arguments": {"x": {"from_parameter": "value"}, "values": ["1", "2"]}, "result": True}}}}, max_items=100_000)


@query(
    "cutline_of_items",
    f"""{_OF_LINES}, found as (select distinct t, split_part(item, '-', 3) as line from p where item like '%-1' or item like '%-2'),
held as (select t, bool_or(line = '1') as one, bool_or(line = '2') as two from found group by t)
select s.t, y, x, {r(f"case when (one and {_IN_TRIANGLE}) or (two and (month(s.t) % 4 = 0 or {_IN_SQUARES})) then quantity end", "quantity")} from s join held on held.t = s.t""",
)
def cutline_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices cut to the footprints of their own items; a slice with an item that has none is not cut."""
    return rows(spatial.cutline(_scenes_with_footprints(spark, sf_dir, True)))


@query("cutline_reduced", f"{_OF_LINES} select y, x, {r(f'case when {_IN_TRIANGLE} or {_IN_SQUARES} then avg(quantity) end', 'quantity')} from s group by y, x")
def cutline_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints of all slices together after time is reduced."""
    c = temporal.reduce_dimension(_scenes_with_footprints(spark, sf_dir, False), lambda s, _: reducers.mean(s), "t")
    return rows(spatial.cutline(c), time=False)


# Searches by geometry and by order over the catalogue of orders.

_TRI = ((-140.3, -40.7), (60.2, 10.9), (-80.6, 60.1))


def _separated_sql(corners: tuple) -> str:
    """Whether no axis separates a triangle from the box of an order (side 1, centre ``cx, cy``)."""
    axes = [(1.0, 0.0), (0.0, 1.0)] + [(b[1] - a[1], a[0] - b[0]) for a, b in zip(corners, (*corners[1:], corners[0]), strict=True)]
    tests = []
    for nx, ny in axes:
        along = [nx * x + ny * y for x, y in corners]
        middle, half = f"({nx!r}::double * cx + {ny!r}::double * cy)", (abs(nx) + abs(ny)) / 2
        tests.append(f"{middle} + {half!r} >= {min(along)!r}::double and {middle} - {half!r} <= {max(along)!r}::double")
    return " and ".join(tests)


@query(
    "catalog_intersects",
    f"select id, datetime from (select o_orderkey::varchar as id, o_orderdate::timestamp as datetime, o_custkey % 360 - 179.5 as cx, o_custkey % 180 - 89.5 as cy from orders) where {_separated_sql(_TRI)}",
)
def catalog_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose box shares a point with a triangle."""
    triangle = {"type": "Polygon", "coordinates": [[list(p) for p in (*_TRI, _TRI[0])]]}
    return search(order_catalog(spark, sf_dir), intersects=triangle).select("id", "datetime")


@query("catalog_newest", "select o_orderkey::varchar as id, o_orderdate::timestamp as datetime from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey::varchar limit 100")
def catalog_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred dearest orders of a status."""
    return search(order_catalog(spark, sf_dir), properties={"status": "F"}, sortby="-properties.totalprice", limit=100, fields=["id", "datetime"])


# Images of three frames: cells of a degree, of half a degree, and of 100 km on the web map.

_FRAMES = [("1", "quantity", 4326, [1.0, 0.0, 0.0, 0.0, -1.0, 8.0], 8, 8, False), ("2", "quantity", 4326, [0.5, 0.0, 2.0, 0.0, -0.5, 6.0], 8, 8, False), ("3", "quantity", 3857, [100000.0, 0.0, 0.0, 0.0, -100000.0, 900000.0], 9, 9, False)]
_BOXES = [("1", 0.0, 0.0, 8.0, 8.0), ("2", 2.0, 2.0, 6.0, 6.0), ("3", 0.0, 0.0, 8.08, 8.05)]


@query(
    "load_mixed_grids",
    f"""with v as (
  select 1 + l_linenumber % 3 as item, l_partkey % 9 as line, l_suppkey % 9 as pixel, max(case when l_quantity > 25 then l_quantity end) as v from lineitem group by all),
cells as (select y::int as y, x::int as x, (x + 0.5) * 0.5 as lon, 8 - (y + 0.5) * 0.5 as lat from range(16) a(y), range(16) b(x)),
spot as (
  select y, x, 1 as item, floor(8 - lat) as line, floor(lon) as pixel from cells
  union all select y, x, 2, floor((6 - lat) / 0.5), floor((lon - 2) / 0.5) from cells where lat between 2 and 6 and lon between 2 and 6
  union all select y, x, 3, floor((900000 - ln(tan(pi() / 4 + radians(lat) / 2)) * {projections.SPHERE}) / 100000), floor(radians(lon) * {projections.SPHERE} / 100000) from cells),
found as (select spot.y, spot.x, arg_min(v, spot.item) as v from spot join v on v.item = spot.item and v.line = spot.line and v.pixel = spot.pixel and v is not null group by all)
select timestamp '2024-01-01' as t, cells.y, cells.x, {r("v", "quantity")} from cells left join found on found.y = cells.y and found.x = cells.x""",
)
def load_mixed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic of images of different projections and resolutions, on the grid that the finest of them asks for."""
    li = table(spark, sf_dir, "lineitem")
    quantity = F.max(F.when(F.col("l_quantity") > 25, F.col("l_quantity")))
    pixels_ = li.groupBy((F.col("l_linenumber") % 3 + 1).cast("string").alias("item_id"), F.lit("quantity").alias("band"), (F.col("l_partkey") % 9).alias("line"), (F.col("l_suppkey") % 9).alias("pixel")).agg(quantity.alias("value"))
    items = spark.createDataFrame(_BOXES, "id string, west double, south double, east double, north double")
    items = items.select("id", F.lit("mixed").alias("collection"), F.lit("2024-01-01").cast("timestamp_ntz").alias("datetime"), "west", "south", "east", "north", F.lit(None).cast("map<string,string>").alias("properties"))
    images = Images(spark.createDataFrame(_FRAMES, FRAMES), pixels_)
    extent = {"west": 0, "south": 0, "east": 8, "north": 8}
    c = images.over(images.collection("mixed", items, {"quantity": BandInfo()}), items, spatial_extent=extent)
    return rows(load_collection(c, spatial_extent=extent))


@query(
    "map_tiles",
    f"""{EV},
m as (select y, x, avg(click) as v from c group by y, x),
dots as (select 32 + u // 32 as tx, 30 + v // 32 as ty, degrees((-pi() * {projections.SPHERE} + (32 + (u + 0.5) / 32) * 2 * pi() * {projections.SPHERE} / 64) / {projections.SPHERE}) as lon,
  degrees(2 * atan(exp((pi() * {projections.SPHERE} - (30 + (v + 0.5) / 32) * 2 * pi() * {projections.SPHERE} / 64) / {projections.SPHERE})) - pi() / 2) as lat from range(64) a(u), range(64) b(v))
select distinct 6::int as z, tx::int as x, ty::int as y from dots join m on m.y = floor(8 - lat) and m.x = floor(lon) and m.v is not null""",
)
def map_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of a zoom level that a map of mean clicks has; each is encoded as PNG by a task."""
    c = temporal.reduce_dimension(pixels.image_indexes(events_cube(spark, sf_dir), [1]), lambda s, _: reducers.mean(s), "t")
    return tiles_of(c, 6, 32).where("length(png) > 0").select("z", "x", "y")
