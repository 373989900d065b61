"""Queries over the star-schema tables, one or more per operator, with DuckDB SQL beside each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.cube import REDUCED, Cube, Grid
from rasterloom.functions import arrays, logic, maths, reducers
from rasterloom.operators import combine, imagery, pixels, resample, spatial, temporal
from rasterloom.plans.graph import bind, execute, session_loaders
from rasterloom.services import render, tiles
from rasterloom.sources import annotation
from rasterloom.sources.catalog import BandInfo, Collection, load_collection, search
from rasterloom.sources.tables import EVENT_BANDS, EVENT_GRID, SCENE_BANDS, events_cube, order_catalog, scene_cube, scenes, table
from rasterloom.streaming.windows import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PLACES = 6
#: Added before rounding, so that a mean of prices with two decimals is never half way.
NUDGE = 1.7e-8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def rows(data: Cube | DataFrame, time: bool = True) -> DataFrame:
    """A result as a table, numbers to six places."""
    df = data.df if isinstance(data, Cube) else data
    keep = [c for c in df.columns if time or c != "t"]
    kind = dict(df.dtypes)
    return df.select(*[(F.round(F.col(f"`{c}`") + NUDGE, PLACES) + 0.0).alias(c) if kind[c] == "double" else F.col(f"`{c}`") for c in keep])


def r(expression: str, name: str | None = None) -> str:
    """SQL of a rounded number."""
    return f"round(({expression})::double + {NUDGE}, {PLACES}) + 0.0" + (f" as {name}" if name else "")


def _mean_sql(event: str) -> str:
    return f"avg(case when event_type = '{event}' then value end) as {event}"


def _events_sql(hours: int = 24) -> str:
    at = "date_trunc('day', ts)::timestamp" if hours == 24 else f"(date_trunc('day', ts)::timestamp + to_hours((hour(ts) // {hours}) * {hours}))"
    return f"""
with e as (select {at} as t, (user_id % 8)::int as y, ((user_id // 8) % 8)::int as x, event_type, value from events),
a as (select t, y, x, {", ".join(map(_mean_sql, EVENT_BANDS))} from e group by all),
g as (select t, y::int as y, x::int as x from (select distinct t from e), range(8) u(y), range(8) v(x)),
c as (select g.t, g.y, g.x, {", ".join(EVENT_BANDS)} from g left join a on a.t = g.t and a.y = g.y and a.x = g.x)
"""


EV = _events_sql()
SCENES = """
with p as (
  select strftime(l_shipdate, '%Y-%m') || '-' || l_linenumber as item, min(date_trunc('month', l_shipdate)::timestamp) as t, (l_partkey % 16)::int as y, (l_suppkey % 16)::int as x,
    arg_min(l_quantity, l_orderkey) as quantity, arg_min(l_extendedprice, l_orderkey) as price, arg_min(l_discount, l_orderkey) as discount, arg_min(l_tax, l_orderkey) as tax
  from lineitem group by item, y, x),
m as (select t, y, x, arg_min(quantity, item) as quantity, arg_min(price, item) as price, arg_min(discount, item) as discount, arg_min(tax, item) as tax from p group by all),
g as (select t, y::int as y, x::int as x from (select distinct t from p), range(16) u(y), range(16) v(x)),
s as (select g.t, g.y, g.x, quantity, price, discount, tax from g left join m on m.t = g.t and m.y = g.y and m.x = g.x)
"""


def _each(expression: str, bands=EVENT_BANDS) -> str:
    """The same rounded expression of every band; ``{b}`` is the band."""
    return ", ".join(r(expression.format(b=b), b) for b in bands)


def _apply(name: str, f: Callable, expression: str) -> None:
    @query(name, f"{EV} select t, y, x, {_each(expression)} from c")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(pixels.apply(events_cube(spark, sf_dir), lambda x, _: f(x)))


# the minimum slice: load, filter, index, reduce

FLAGSHIP = {
    "process_graph": {
        "load": {"process_id": "load_events", "arguments": {"temporal_extent": ["2024-01-01", "2024-01-20"]}},
        "when": {"process_id": "filter_temporal", "arguments": {"data": {"from_node": "load"}, "extent": ["2024-01-05", None]}},
        "index": {
            "process_id": "reduce_dimension",
            "arguments": {
                "data": {"from_node": "when"}, "dimension": "bands",
                "reducer": {"process_graph": {
                    "p": {"process_id": "array_element", "arguments": {"data": {"from_parameter": "data"}, "label": "purchase"}},
                    "c": {"process_id": "array_element", "arguments": {"data": {"from_parameter": "data"}, "label": "click"}},
                    "nd": {"process_id": "normalized_difference", "arguments": {"x": {"from_node": "p"}, "y": {"from_node": "c"}}, "result": True},
                }},
            },
        },
        "mean": {
            "process_id": "reduce_dimension",
            "arguments": {"data": {"from_node": "index"}, "dimension": "t", "reducer": {"process_graph": {"m": {"process_id": "mean", "arguments": {"data": {"from_parameter": "data"}}, "result": True}}}},
            "result": True,
        },
    }
}


@query("flagship_nd_mean", f"{EV} select y, x, {r('avg((purchase - click) / nullif(purchase + click, 0))', 'nd')} from c where t >= '2024-01-05' and t < '2024-01-20' group by y, x")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execute(FLAGSHIP, loaders={"load_events": lambda temporal_extent: events_cube(spark, sf_dir, temporal_extent=temporal_extent)})
    return rows(out.df.select("y", "x", F.col("band1").alias("nd")))


# filters along time


@query("filter_temporal_halfopen", f"{EV} select t, y, x, {_each('{b}')} from c where t >= '2024-01-10' and t < '2024-01-12'")
def filter_temporal_halfopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(temporal.filter_temporal(events_cube(spark, sf_dir), ["2024-01-10", "2024-01-12"]))


@query("filter_temporal_open", f"{EV} select t, y, x, {_each('{b}')} from c where t >= '2024-01-28'")
def filter_temporal_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(temporal.filter_temporal(events_cube(spark, sf_dir), ["2024-01-28T00:00:00Z", None]))


@query("filter_time_of_day", f"{_events_sql(6)} select t, y, x, {_each('{b}')} from c where hour(t) >= 18 or hour(t) < 6")
def filter_time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(temporal.filter_temporal(events_cube(spark, sf_dir, 6), ["18:00:00", "06:00:00"]))


@query("filter_labels", f"{EV} select t, y, x, {_each('{b}')} from c where t in ('2024-01-03', '2024-01-07')")
def filter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(temporal.filter_labels(events_cube(spark, sf_dir), ["2024-01-03", "2024-01-07"]))


# functions of one value

_apply("apply_linear_scale", lambda x: maths.linear_scale_range(x, 50, 400, 0, 255), "(greatest(least({b}, 400), 50) - 50) / 350 * 255 + {b} * 0")
_apply("apply_linear_scale_inverted", lambda x: maths.linear_scale_range(x, 400, 50), "(400 - greatest(least({b}, 400), 50)) / 350 + {b} * 0")
_apply("apply_clip", lambda x: maths.clip(x, 100, 200), "case when {b} is not null then greatest(least({b}, 200), 100) end")
_apply("apply_trig", lambda x: maths.add(maths.sin(x), maths.multiply(maths.cos(x), maths.tan(maths.divide(x, 1000)))), "sin({b}) + cos({b}) * tan({b} / 1000)")
_apply("apply_arc", lambda x: maths.add(maths.arcsin(maths.divide(x, 400)), maths.arccos(maths.divide(x, 400))), "case when abs({b} / 400) <= 1 then asin({b} / 400) + acos({b} / 400) end")
_apply("apply_arctan", lambda x: maths.add(maths.arctan(x), maths.arctan2(x, 200)), "atan({b}) + atan2({b}, 200)")
_apply("apply_hyperbolic", lambda x: maths.add(maths.add(maths.sinh(maths.divide(x, 100)), maths.cosh(maths.divide(x, 100))), maths.tanh(maths.divide(x, 100))), "sinh({b} / 100) + cosh({b} / 100) + tanh({b} / 100)")
_apply("apply_area", lambda x: maths.add(maths.arsinh(x), maths.arcosh(maths.divide(x, 100))), "case when {b} / 100 >= 1 then asinh({b}) + acosh({b} / 100) end")
_apply("apply_artanh", lambda x: maths.artanh(maths.divide(x, 300)), "case when abs({b} / 300) < 1 then atanh({b} / 300) end")
_apply("apply_log_domain", lambda x: maths.add(maths.ln(maths.subtract(x, 200)), maths.log(x, 10)), "case when {b} > 200 then ln({b} - 200) + ln({b}) / ln(10) end")
_apply("apply_exp_sqrt", lambda x: maths.add(maths.exp(maths.divide(x, 500)), maths.sqrt(maths.subtract(x, 100))), "case when {b} >= 100 then exp({b} / 500) + sqrt({b} - 100) end")
_apply("apply_power_sgn", lambda x: maths.multiply(maths.power(x, 2), maths.sgn(maths.subtract(x, 250))), "pow({b}, 2) * sign({b} - 250)")
_apply("apply_mod", lambda x: maths.mod(x, -7), "{b} - (-7) * floor({b} / (-7))")
_apply("apply_floor_ceil", lambda x: maths.subtract(maths.ceil(x), maths.floor(maths.absolute(maths.subtract(x, 250)))), "ceil({b}) - floor(abs({b} - 250))")
_apply("apply_trunc", maths.trunc, "trunc({b})::bigint % 256")
_apply("apply_divide_zero", lambda x: maths.divide(x, maths.floor(maths.divide(x, 250))), "{b} / nullif(floor({b} / 250), 0)")
_apply("apply_constants", lambda x: maths.add(maths.multiply(x, maths.pi()), maths.add(maths.e(), maths.constant(1))), "{b} * pi() + exp(1) + 1")
_apply("apply_if_mask", lambda x: logic.if_(logic.gt(x, 250), x), "case when {b} > 250 then {b} else 0 end")
_apply("apply_if_reject", lambda x: logic.if_(logic.or_(logic.lt(x, 100), logic.gte(x, 400)), -1, x), "case when {b} < 100 or {b} >= 400 then -1 else {b} end")
_apply("apply_comparisons", lambda x: logic.if_(logic.and_(logic.gte(x, 100), logic.lte(x, 300)), 1, 0), "case when {b} >= 100 and {b} <= 300 then 1 else 0 end")
_apply("apply_equal", lambda x: logic.if_(logic.eq(maths.floor(x), 250, delta=50), 2, logic.if_(logic.neq(maths.floor(x), 100), 1, 0)), "case when abs(floor({b}) - 250) <= 50 then 2 when floor({b}) <> 100 then 1 else 0 end")


@query("band_arithmetic", f"{EV} select t, y, x, {r('(purchase * 2 - click) / nullif(view + error, 0)', 'band1')} from c")
def band_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(b, _):
        at = lambda n: arrays.array_element(b, label=n)
        return maths.divide(maths.subtract(maths.multiply(at("purchase"), 2), at("click")), maths.add(at("view"), at("error")))

    return rows(temporal.reduce_dimension(events_cube(spark, sf_dir), f, "bands"))


# reducers along time and bands

_SQL_T = {
    "min": "min({b})", "max": "max({b})", "mean": "avg({b})", "median": "median({b})", "sd": "stddev_samp({b})", "variance": "var_samp({b})", "count": "count({b})",
    "first": "arg_min_null({b}, t)", "last": "arg_max_null({b}, t)", "firstpixel": "arg_min({b}, t)", "highestpixel": "max({b})", "lowestpixel": "min({b})",
}


def _reduce_t(name: str) -> None:
    @query(f"reduce_t_{name}", f"{EV} select y, x, {_each(_SQL_T[name])} from c group by y, x")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(temporal.reduce_dimension(events_cube(spark, sf_dir), lambda s, _: reducers.PROCESSES[name](s), "t"), time=False)


for _n in _SQL_T:
    _reduce_t(_n)


@query("reduce_t_max_strict", f"{EV} select y, x, {_each('case when count({b}) = count(*) then max({b}) end')} from c group by y, x")
def reduce_t_max_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(temporal.reduce_dimension(events_cube(spark, sf_dir), lambda s, _: reducers.max_(s, ignore_nodata=False), "t"), time=False)


@query("reduce_t_count_condition", f"{EV} select y, x, {_each('count(*) filter (where {b} > 250)')} from c group by y, x")
def reduce_t_count_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(temporal.reduce_dimension(events_cube(spark, sf_dir), lambda s, _: reducers.count(s, lambda v: logic.gt(v, 250)), "t"), time=False)


@query("reduce_t_range", f"{EV} select y, x, {_each('max({b}) - min({b})')} from c group by y, x")
def reduce_t_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(temporal.reduce_dimension(events_cube(spark, sf_dir), lambda s, _: maths.subtract(reducers.max_(s), reducers.min_(s)), "t"), time=False)


@query("reduce_t_element", f"{EV} select y, x, {_each('list({b} order by t)[3]')} from c group by y, x")
def reduce_t_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(temporal.reduce_dimension(events_cube(spark, sf_dir), lambda s, _: arrays.array_element(s, 2), "t"), time=False)


_LIST = f"[{', '.join(EVENT_BANDS)}]"
_SQL_B = {
    "max": f"list_max({_LIST})", "min": f"list_min({_LIST})", "mean": f"list_avg({_LIST})", "count": f"list_count({_LIST})", "median": f"list_median({_LIST})",
    "sd": f"list_stddev_samp({_LIST})", "variance": f"list_var_samp({_LIST})", "first": "click", "last": "view", "firstpixel": "coalesce(click, error, purchase, signup, view)",
}


def _reduce_b(name: str) -> None:
    @query(f"reduce_bands_{name}", f"{EV} select t, y, x, {r(_SQL_B[name], 'band1')} from c")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(temporal.reduce_dimension(events_cube(spark, sf_dir), lambda b, _: reducers.PROCESSES[name](b), "bands"))


for _n in _SQL_B:
    _reduce_b(_n)


# whole-pixel selections over scenes

_LAST = ", ".join(r(f"p.{b}", b) for b in SCENE_BANDS)
_PIXEL = {
    "first": f"select y, x, {_each('arg_min({b}, t)', SCENE_BANDS)} from s group by y, x", "highest": f"select y, x, {_each('max({b})', SCENE_BANDS)} from s group by y, x",
    "lowest": f"select y, x, {_each('min({b})', SCENE_BANDS)} from s group by y, x", "mean": f"select y, x, {_each('avg({b})', SCENE_BANDS)} from s group by y, x",
    "median": f"select y, x, {_each('median({b})', SCENE_BANDS)} from s group by y, x", "stdev": f"select y, x, {_each('stddev_samp({b})', SCENE_BANDS)} from s group by y, x",
    "count": f"select y, x, {_each('count({b})', SCENE_BANDS)} from s group by y, x",
    "lastbandlow": f"select q.y, q.x, {_LAST} from (select distinct y, x from s) q left join (select *, row_number() over (partition by y, x order by tax, t) as n from s where tax is not null) p on p.y = q.y and p.x = q.x and n = 1",
    "lastbandhight": f"select q.y, q.x, {_LAST} from (select distinct y, x from s) q left join (select *, row_number() over (partition by y, x order by tax desc, t) as n from s where tax is not null) p on p.y = q.y and p.x = q.x and n = 1",
}


def _pixel(name: str) -> None:
    @query(f"pixel_{name}", SCENES + _PIXEL[name])
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(temporal.apply_pixel_selection(scene_cube(spark, sf_dir), name), time=False)


for _n in _PIXEL:
    _pixel(_n)


# intervals


def _intervals(name: str, intervals: list, reducer: str, labels: list | None = None) -> None:
    at = temporal.interval_labels(intervals, labels)
    parts = []
    for (a, b), label in zip(intervals, at, strict=True):
        where = " and ".join(([f"t >= '{a}'"] if a else []) + ([f"t < '{b}'"] if b else []))
        parts.append(
            f"select timestamp '{label}' as t, g.y, g.x, {_each(_SQL_T[reducer].replace('{b}', 'c.{b}').replace(', t)', ', c.t)'))} "
            f"from (select distinct y, x from c) g left join (select * from c where {where}) c on c.y = g.y and c.x = g.x group by g.y, g.x"
        )

    @query(name, EV + " union all ".join(parts))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(temporal.aggregate_temporal(events_cube(spark, sf_dir), intervals, lambda s, _: reducers.PROCESSES[reducer](s), labels))


_intervals("aggregate_temporal_weekly", [[f"2024-01-{d:02d}", f"2024-01-{d + 7:02d}"] for d in (1, 8, 15, 22)], "mean")
_intervals("aggregate_temporal_overlap", [["2024-01-01", "2024-01-11"], ["2024-01-06", "2024-01-16"], ["2024-01-10", None]], "max")
_intervals("aggregate_temporal_empty", [["2023-01-01", "2023-02-01"], ["2024-01-01", "2024-02-01"]], "median")
_intervals("aggregate_temporal_labels", [["2024-01-01", "2024-01-15"], ["2024-01-15", "2024-02-01"]], "sd", ["early", "late"])
_intervals("aggregate_temporal_first", [["2024-01-01", "2024-01-08"], ["2024-01-08", "2024-01-15"]], "firstpixel")


# two cubes


@query("merge_disjoint_t", f"{EV} select t, y, x, {_each('{b}')} from c where t < '2024-01-03' or t >= '2024-01-28'")
def merge_disjoint_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events_cube(spark, sf_dir)
    return rows(combine.merge_cubes(temporal.filter_temporal(c, [None, "2024-01-03"]), temporal.filter_temporal(c, ["2024-01-28", None])))


@query("merge_disjoint_bands", f"{EV} select t, y, x, {r('click', 'click')}, {r('case when t < ' + chr(39) + '2024-01-15' + chr(39) + ' then view end', 'view')} from c")
def merge_disjoint_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events_cube(spark, sf_dir)
    return rows(combine.merge_cubes(pixels.image_indexes(c, [1]), temporal.filter_temporal(pixels.image_indexes(c, [5]), [None, "2024-01-15"])))


@query(
    "merge_overlap_add",
    f"{EV} select t, y, x, {r('case when t < ' + chr(39) + '2024-01-10' + chr(39) + ' then click when t < ' + chr(39) + '2024-01-20' + chr(39) + ' then click + click else click end', 'click')}, "
    f"{r('case when t < ' + chr(39) + '2024-01-20' + chr(39) + ' then view end', 'view')} from c",
)
def merge_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events_cube(spark, sf_dir)
    one = temporal.filter_temporal(pixels.image_indexes(c, [1, 5]), [None, "2024-01-20"])
    two = temporal.filter_temporal(pixels.image_indexes(c, [1]), ["2024-01-10", None])
    return rows(combine.merge_cubes(one, two, lambda x, y, _: maths.add(x, y)))


def _flags(c: Cube) -> Cube:
    return pixels.apply(pixels.image_indexes(c, [5]), lambda x, _: logic.if_(logic.gt(x, 250), 1, 0))


@query("mask_raster_broadcast", f"{EV}, m as (select y, x, max(case when view > 490 then 1 else 0 end) as m from c group by y, x) select c.t, c.y, c.x, {_each('case when m = 0 then {b} end')} from c join m on m.y = c.y and m.x = c.x")
def mask_raster_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events_cube(spark, sf_dir)
    high = pixels.apply(pixels.image_indexes(c, [5]), lambda x, _: logic.if_(logic.gt(x, 490), 1, 0))
    return rows(combine.mask(c, temporal.reduce_dimension(high, lambda s, _: reducers.max_(s), "t")))


@query("mask_raster_value", f"{EV} select t, y, x, {_each('case when {b} is not null and view > 250 then -9999 else {b} end')} from c")
def mask_raster_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events_cube(spark, sf_dir)
    return rows(combine.mask(c, _flags(c), -9999))


TRIANGLE = {"type": "Polygon", "coordinates": [[[0.2, 0.2], [7.9, 0.3], [0.1, 7.8], [0.2, 0.2]]]}
#: Cell centres below the long side of the triangle and right of and above its short ones.
_IN = "((x + 0.5) - 7.9) * (7.8 - 0.3) < (0.1 - 7.9) * ((8 - (y + 0.5)) - 0.3)"


@query("mask_polygon_out", f"{EV} select t, y, x, {_each('case when ' + _IN + ' then {b} end')} from c")
def mask_polygon_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spatial.mask_polygon(events_cube(spark, sf_dir), TRIANGLE))


@query("mask_polygon_in", f"{EV} select t, y, x, {_each('case when {b} is not null and ' + _IN + ' then 0 else {b} end')} from c")
def mask_polygon_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spatial.mask_polygon(events_cube(spark, sf_dir), TRIANGLE, 0, inside=True))


def _box(w: float, s: float, e: float, n: float) -> dict:
    return {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}}


BOXES = [(0.0, 0.0, 3.0, 2.0), (2.5, 1.5, 6.2, 7.9), (7.0, 7.0, 8.0, 8.0)]
FEATURES = {"type": "FeatureCollection", "features": [_box(*b) for b in BOXES]}
_BOX_SQL = f"f(i, w, s, e, n) as (values {', '.join(str((i, *b)) for i, b in enumerate(BOXES))})"


def _zonal(name: str, reducer: Callable, expression: str) -> None:
    @query(
        name,
        f"{EV}, {_BOX_SQL} select i::int as feature_index, t, {r(expression, 'value')}, count(*) as total_count, count(click) as valid_count from c join f on x < e and x + 1 > w and 8 - y > s and 7 - y < n group by i, t",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spatial.aggregate_spatial(events_cube(spark, sf_dir), FEATURES, lambda s, _: reducer(s)))


_zonal("aggregate_spatial_mean", reducers.mean, "avg(click)")
_zonal("aggregate_spatial_max", reducers.max_, "max(click)")
_zonal("aggregate_spatial_median", reducers.median, "median(click)")


# dimensions and labels


@query("apply_dimension_t_array_apply", f"{EV}, n as (select *, row_number() over (partition by y, x order by t) - 1 as i from c) select t, y, x, {_each('{b} * 2 + i')} from n")
def apply_dimension_t_array_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(data, _):
        return arrays.array_apply(data, lambda v, i: maths.add(maths.multiply(v, 2), i.cast("double")))

    return rows(pixels.apply_dimension(events_cube(spark, sf_dir), f, "t"))


@query("apply_dimension_t_to_bands", f"{EV} select y, x, " + ", ".join(r(f"max({b}) filter (where t = '2024-01-0{d}')", f'"{b}_2024-01-0{d}T00:00:00"') for b in ("click", "view") for d in (1, 2, 3)) + " from c group by y, x")
def apply_dimension_t_to_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = temporal.filter_temporal(pixels.image_indexes(events_cube(spark, sf_dir), [1, 5]), ["2024-01-01", "2024-01-04"])
    return rows(pixels.apply_dimension(c, lambda data, _: data, "t", target_dimension="bands"), time=False)


@query("apply_dimension_bands", f"{EV} select t, y, x, {_each('{b} - list_avg(' + _LIST + ')')} from c")
def apply_dimension_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(data, _):
        m = reducers.mean(data)
        return arrays.array_apply(data, lambda v, i: maths.subtract(v, m))

    return rows(pixels.apply_dimension(events_cube(spark, sf_dir), f, "bands"))


@query("rename_bands", f"{EV} select t, y, x, {r('click', 'tap')}, {r('error', 'error')}, {r('purchase', 'purchase')}, {r('signup', 'signup')}, {r('view', 'look')} from c")
def rename_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pixels.rename_labels(events_cube(spark, sf_dir), "bands", ["tap", "look"], ["click", "view"]))


@query("rename_times", f"{EV} select case when t = '2024-01-01' then timestamp '2020-06-01' else t end as t, y, x, {_each('{b}')} from c")
def rename_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pixels.rename_labels(events_cube(spark, sf_dir), "t", ["2020-06-01"], ["2024-01-01"]))


@query("add_dimension_band", f"{EV} select t, y, x, {r('click', 'only')} from c")
def add_dimension_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pixels.add_dimension(pixels.image_indexes(events_cube(spark, sf_dir), [1]), "bands", "only", "bands"))


@query("add_dimension_slice", f"{EV} select t, y, x, {_each('{b}')} from c union all select timestamp '2025-01-01', y, x, null, null, null, null, null from c where t = '2024-01-01'")
def add_dimension_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pixels.add_dimension(events_cube(spark, sf_dir), "t", "2025-01-01", "temporal"))


@query("image_indexes", f"{EV} select t, y, x, {r('view', 'view')}, {r('click', 'click')} from c")
def image_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pixels.image_indexes(events_cube(spark, sf_dir), [5, 1]))


@query("array_element_cube", f"{EV} select t, y, x, {r('purchase', 'purchase')} from c")
def array_element_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pixels.array_element_of_cube(events_cube(spark, sf_dir), 2))


@query("ndvi_append_band", f"{SCENES} select t, y, x, {_each('{b}', SCENE_BANDS)}, {r('(price - quantity) / nullif(price + quantity, 0)', 'vegetation')} from s")
def ndvi_append_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pixels.ndvi(scene_cube(spark, sf_dir), "PRICE", 1, "vegetation"))


@query("ndwi", f"{SCENES} select t, y, x, {r('(discount - tax) / nullif(discount + tax, 0)', 'ndwi')} from s")
def ndwi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(pixels.ndwi(scene_cube(spark, sf_dir), "discount", "tax"))


# other grids

HALF = Grid(4, 4, EVENT_GRID.bounds)
DOUBLE = Grid(16, 16, EVENT_GRID.bounds)
_COARSE = {
    "average": "avg({b})", "max": "max({b})", "min": "min({b})", "med": "median({b})", "sum": "sum({b})", "rms": "sqrt(avg({b} * {b}))", "q1": "quantile_cont({b}, 0.25)",
    "q3": "quantile_cont({b}, 0.75)", "mode": "min({b})",
}


def _resample(name: str) -> None:
    sql = f"{EV} select t, y // 2 as y, x // 2 as x, {_each(_COARSE[name])} from c group by 1, 2, 3"
    if name == "mode":  # the most frequent value, ties to the smallest
        sql = (
            f"{EV}, l as (select t, y // 2 as y, x // 2 as x, unnest({list(EVENT_BANDS)}) as band, unnest({_LIST}) as v from c), n as (select t, y, x, band, floor(v / 100) as v, count(*) as k from l where v is not null group by all), "
            "o as (select *, row_number() over (partition by t, y, x, band order by k desc, v) as i from n), q as (select distinct t, y, x from l) "
            "select q.t, q.y, q.x, " + ", ".join(r(f"max(v) filter (where band = '{b}')", b) for b in EVENT_BANDS) + " from q left join o on o.t = q.t and o.y = q.y and o.x = q.x and i = 1 group by q.t, q.y, q.x"
        )

    @query(f"resample_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = events_cube(spark, sf_dir)
        if name == "mode":
            c = pixels.apply(c, lambda x, _: maths.floor(maths.divide(x, 100)))
        return rows(resample.to_grid(c, HALF, name))


for _n in _COARSE:
    _resample(_n)


@query("resample_near", f"{EV} select t, v.y::int as y, u.x::int as x, {_each('{b}')} from c, range(16) v(y), range(16) u(x) where c.y = v.y // 2 and c.x = u.x // 2")
def resample_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(resample.to_grid(events_cube(spark, sf_dir), DOUBLE, "near"))


@query(
    "resample_bilinear",
    f"{EV}, k as (select v.y::int as y, u.x::int as x, (v.y + 0.5) / 2 - 0.5 as fy, (u.x + 0.5) / 2 - 0.5 as fx from range(16) v(y), range(16) u(x)), "
    "w as (select k.y, k.x, c.t, floor(fy + 0.5) = c.y and floor(fx + 0.5) = c.x as near, (1 - abs(fy - c.y)) * (1 - abs(fx - c.x)) as w, "
    + ", ".join(EVENT_BANDS)
    + " from k join c on abs(fy - c.y) < 1 and abs(fx - c.x) < 1) "
    + f"select t, y, x, {_each('case when bool_or(near and {b} is not null) then sum(w * {b}) / nullif(sum(w) filter (where {b} is not null), 0) end')} from w group by t, y, x",
)
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(resample.to_grid(events_cube(spark, sf_dir), DOUBLE, "bilinear"))


def _kernel(name: str, radius: int, weight: str) -> None:
    """``weight`` is SQL of a distance ``d``."""
    w = f"({weight.format(d='abs(fy - c.y)')}) * ({weight.format(d='abs(fx - c.x)')})"

    @query(
        f"resample_{name}",
        f"{EV}, k as (select v.y::int as y, u.x::int as x, (v.y + 0.5) / 2 - 0.5 as fy, (u.x + 0.5) / 2 - 0.5 as fx from range(16) v(y), range(16) u(x)), "
        f"w as (select k.y, k.x, c.t, floor(fy + 0.5) = c.y and floor(fx + 0.5) = c.x as near, {w} as w, {', '.join(EVENT_BANDS)} from k join c on abs(fy - c.y) < {radius} and abs(fx - c.x) < {radius}) "
        f"select t, y, x, {_each('case when bool_or(near and {b} is not null) then sum(w * {b}) / nullif(sum(w) filter (where {b} is not null), 0) end')} from w group by t, y, x",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(resample.to_grid(events_cube(spark, sf_dir), DOUBLE, name))


_kernel("cubic", 2, "case when {d} <= 1 then 1.5 * {d} ** 3 - 2.5 * {d} ** 2 + 1 else -0.5 * {d} ** 3 + 2.5 * {d} ** 2 - 4 * {d} + 2 end")
_kernel("cubicspline", 2, "case when {d} <= 1 then 2.0 / 3 - {d} ** 2 + {d} ** 3 / 2 else (2 - {d}) ** 3 / 6 end")
_kernel("lanczos", 3, "case when {d} = 0 then 1 else 3 * sin(pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d}) ** 2 end")


@query(
    "resample_reproject",
    f"{EV}, o as (select 6378137.0 as r, 6378137.0 * ln(tan(pi() / 4 + radians(8) / 2)) as top), "
    "k as (select v.y::int as y, floor(8 - degrees(2 * atan(exp(top * (1 - (v.y + 0.5) / 8) / r)) - pi() / 2))::int as source from o, range(8) v(y)) "
    f"select c.t, k.y, c.x, {_each('c.{b}')} from k join c on c.y = k.source",
)
def resample_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(resample.resample_spatial(events_cube(spark, sf_dir), projection=3857))


# terrain, radar, colour

_Z = "z as (select t, y, x, coalesce(quantity, 0) as z from s)"


@query(
    "hillshade",
    f"""{SCENES}, {_Z},
d as (
  select t, y, x,
    case when y = 0 then lead(z) over wy - z when y = 15 then z - lag(z) over wy else (lead(z) over wy - lag(z) over wy) / 2 end as r,
    case when x = 0 then lead(z) over wx - z when x = 15 then z - lag(z) over wx else (lead(z) over wx - lag(z) over wx) / 2 end as c
  from z window wy as (partition by t, x order by y), wx as (partition by t, y order by x)),
h as (select t, y, x, sin(radians(45)) * sin(pi() / 2 - atan(sqrt(r * r + c * c))) + cos(radians(45)) * cos(pi() / 2 - atan(sqrt(r * r + c * c))) * cos(radians(315) - atan2(-r, c)) as s from d)
select t, y - 3 as y, x - 3 as x, floor(greatest(255 * (s + 1) / 2, 0) + 1e-9)::double as hillshade from h where y between 3 and 12 and x between 3 and 12""",
)
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scene_cube(spark, sf_dir)
    z = c.select({"z": F.coalesce(c.band("quantity"), F.lit(0.0))})
    out = imagery.hillshade(z)
    return rows(out)


@query(
    "sar_calibrate",
    f"{SCENES} select t, y, x, {r('case when price > 0 then greatest(price * price - quantity * 1e6, 0) / pow(100 + quantity, 2) end', 'vv')}, {r('case when price > 0 then 1 end', 'mask')} from s",
)
def sar_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scene_cube(spark, sf_dir)
    d = c.select({"vv": c.band("price"), "vv_sigma0_lut": c.band("quantity") + 100, "vv_noise_lut": c.band("quantity") * 1e6})
    return rows(imagery.sar_backscatter(d, "sigma0-ellipsoid", mask=True))


LUT = [(line, pixel, 100.0 + 3.0 * line + 2.0 * pixel + 0.25 * line * pixel) for line in (0.0, 4.0, 10.0) for pixel in (0.0, 5.0, 12.0)]


@query(
    "lut_bilinear",
    f"""with l(line, pixel, v) as (values {", ".join(map(str, LUT))}),
q as (select l_orderkey, l_linenumber, (l_partkey % 12)::double as line, (l_suppkey % 15)::double as pixel from lineitem),
c as (select *, case when line <= 4 then 0.0 else 4.0 end as l0, case when line <= 4 then 4.0 else 10.0 end as l1, case when pixel <= 5 then 0.0 else 5.0 end as p0, case when pixel <= 5 then 5.0 else 12.0 end as p1 from q),
w as (select *, greatest(0, least(1, (line - l0) / (l1 - l0))) as tl, greatest(0, least(1, (pixel - p0) / (p1 - p0))) as tp from c)
select l_orderkey, l_linenumber, w.line, w.pixel, {r("a.v * (1 - tl) * (1 - tp) + b.v * (1 - tl) * tp + d.v * tl * (1 - tp) + e.v * tl * tp", "gain")}
from w join l a on a.line = l0 and a.pixel = p0 join l b on b.line = l0 and b.pixel = p1 join l d on d.line = l1 and d.pixel = p0 join l e on e.line = l1 and e.pixel = p1""",
)
def lut_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 12).cast("double").alias("line"), (F.col("l_suppkey") % 15).cast("double").alias("pixel"))
    lut = spark.createDataFrame(LUT, "line double, pixel double, value double")
    return rows(imagery.lut_bilinear(points, lut, "gain"))


_SIG = "(1 / (1 + exp(10 * (0.3 - {v}))) - 1 / (1 + exp(3))) / (1 / (1 + exp(-7)) - 1 / (1 + exp(3)))"
_GAM = "pow({b} / 2 / 255.0, 1 / 1.5)"


@query("color_formula", f"{EV} select t, y, x, {_each('greatest(0, least(255, 255 * (' + _SIG.format(v=_GAM) + '))) + {b} * 0', ('click', 'error', 'purchase'))} from c")
def color_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pixels.apply(pixels.image_indexes(events_cube(spark, sf_dir), [1, 2, 3]), lambda x, _: maths.divide(x, 2))
    return rows(imagery.color_formula(c, "Gamma RGB 1.5 Sigmoidal RGB 10 0.3 Saturation 1"))


@query("colormap", f"{EV} select t, y, x, {r('case when click is not null then 255 - floor(click / 2) end', 'red')}, {r('case when click is not null then 0 end', 'green')}, {r('floor(click / 2)', 'blue')}, {r('case when click is not null then 255 end', 'alpha')} from c")
def colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pixels.apply(pixels.image_indexes(events_cube(spark, sf_dir), [1]), lambda x, _: maths.floor(maths.divide(x, 2)))
    return rows(imagery.colormap(c, {v: (255 - v, 0, v, 255) for v in range(256)}))


# loading


@query("load_mosaic_first", f"{SCENES} select t, y, x, {_each('{b}', SCENE_BANDS)} from s where t >= '1996-03-01' and t < '1996-05-01'")
def load_mosaic_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(load_collection(scenes(spark, sf_dir), temporal_extent=["1996-03-01", "1996-05-01"], bands=list(SCENE_BANDS)))


@query(
    "load_scale_offset",
    SCENES.replace("arg_min(l_tax, l_orderkey) as tax", "nullif(arg_min(l_tax, l_orderkey), 0) as tax").replace("arg_min(l_discount, l_orderkey) as discount", "arg_min(l_discount, l_orderkey) * 100 + 1 as discount")
    + f"select t, y, x, {_each('{b}', ('discount', 'tax'))} from s where t = '1996-03-01'",
)
def load_scale_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scenes(spark, sf_dir)
    c = Collection(c.id, c.items, c.pixels, c.grid, c.bands | {"discount": BandInfo(scale=100.0, offset=1.0), "tax": BandInfo(nodata=0.0)})
    return rows(load_collection(c, temporal_extent=["1996-03-01", "1996-04-01"], bands=["discount", "tax"]))


@query("load_property", f"{SCENES.replace('from p group by all', 'from p where item like ' + chr(39) + '%-1' + chr(39) + ' group by all')} select t, y, x, {r('quantity', 'quantity')} from s where t >= '1996-03-01' and t < '1996-09-01'")
def load_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(load_collection(scenes(spark, sf_dir), temporal_extent=["1996-03-01", "1996-09-01"], bands=["quantity"], properties={"line": "1"}))


def _rule(process: str, **args: object) -> dict:
    return {"process_graph": {"r": {"process_id": process, "arguments": {"x": {"from_parameter": "value"}, **args}, "result": True}}}


def _catalog(name: str, where: str, **how: object) -> None:
    @query(name, f"select o_orderkey::varchar as id, o_orderdate::timestamp as datetime from orders where {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(order_catalog(spark, sf_dir), **how).select("id", "datetime")


_catalog("catalog_property_filter", "o_orderstatus = 'F' and o_totalprice between 50000 and 150000", properties={"status": _rule("eq", y="F"), "totalprice": _rule("between", min=50000, max=150000)})
_catalog("catalog_in_prefix", "o_orderstatus in ('F', 'P') and o_orderpriority like '1%'", properties={"status": _rule("in", values=["F", "P"]), "priority": _rule("starts_with", y="1")})
_catalog("catalog_compare", "o_totalprice > 200000 and o_totalprice <= 300000 and not o_orderpriority like '%LOW'", properties={
    "totalprice": {"process_graph": {"a": {"process_id": "gt", "arguments": {"x": {"from_parameter": "value"}, "y": 200000}}, "b": {"process_id": "lte", "arguments": {"x": {"from_parameter": "value"}, "y": 300000}}, "c": {"process_id": "and", "arguments": {"expressions": [{"from_node": "a"}, {"from_node": "b"}]}, "result": True}}},
    "priority": {"process_graph": {"a": {"process_id": "ends_with", "arguments": {"x": {"from_parameter": "value"}, "y": "LOW"}}, "n": {"process_id": "not", "arguments": {"expression": {"from_node": "a"}}, "result": True}}},
})
_catalog("catalog_extent", "(o_custkey % 360 - 180) < 10 and (o_custkey % 360 - 179) > -10 and (o_custkey % 180 - 90) < 45 and (o_custkey % 180 - 89) > 0 and o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01'",
         spatial_extent={"west": -10, "south": 0, "east": 10, "north": 45}, temporal_extent=["1996-01-01", "1997-01-01"])


# arrays


@query("array_element", f"select vec_id, {r('embedding[4]', 'value')} from embeddings")
def array_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return rows(e.select("vec_id", arrays.array_element(reducers.Values(F.col("embedding")), 3).cast("double").alias("value")))


@query("array_create", f"{EV} select t, y, x, {r('click', 'band1')}, {r('7', 'band2')}, {r('view', 'band3')} from c")
def array_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(b, _):
        return arrays.array_create([arrays.array_element(b, 0), 7, arrays.array_element(b, label="view")])

    return rows(temporal.reduce_dimension(events_cube(spark, sf_dir), f, "bands"))


@query("array_apply_index", f"select vec_id, {r('list_sum(list_transform(embedding, lambda v, i: v::double * (i - 1)))', 'value')} from embeddings")
def array_apply_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = arrays.array_apply(reducers.Values(F.col("embedding").cast("array<double>")), lambda v, i: maths.multiply(v, i.cast("double")))
    return rows(e.select("vec_id", F.aggregate(a.array(), F.lit(0.0), lambda s, v: s + v).alias("value")))


@query("array_reducers", f"select vec_id, {r('list_max(embedding)', 'highest')}, {r('list_avg(embedding)', 'average')}, {r('list_median(embedding)', 'middle')}, {r('list_stddev_samp(embedding)', 'spread')} from embeddings")
def array_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = reducers.Values(F.col("embedding").cast("array<double>"))
    return rows(table(spark, sf_dir, "embeddings").select("vec_id", reducers.max_(v).alias("highest"), reducers.mean(v).alias("average"), reducers.median(v).alias("middle"), reducers.sd(v).alias("spread")))


# tiles


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey <= 40")
    return c.select(
        F.concat(F.lit("s"), (F.col("c_custkey") % 2).cast("string")).alias("service_id"), F.col("c_name").alias("user_id"), (F.col("c_custkey") % 8).cast("int").alias("x"), F.expr("cast(c_custkey div 8 as int)").alias("y"),
        F.lit(5).alias("z"), F.when(F.col("c_custkey") % 3 == 0, "submitted").otherwise("claimed").alias("stage"), F.lit(None).cast("string").alias("data"),
    )


@query("tile_claim_available", "select x::int as x, y::int as y from range(8) u(x), range(6) v(y) where not exists (select 1 from customer where c_custkey <= 40 and c_custkey % 2 = 0 and c_custkey % 8 = x and c_custkey // 8 = y)")
def tile_claim_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.available(_state(spark, sf_dir), "s0", 5, (0, 7), (0, 5))


@query("tiles_summary", "select (c_custkey % 8)::int as x, (c_custkey // 8)::int as y, 5::int as z, case when c_custkey % 3 = 0 then 'submitted' else 'claimed' end as stage, c_name as user_id, null::varchar as data from customer where c_custkey <= 40 and c_custkey % 2 = 1")
def tiles_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tiles_summary(_state(spark, sf_dir), "s1")


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile for every customer: two services, eight tiles to a row, as many rows as it takes."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), (key % 2).cast("string")).alias("service_id"), F.col("c_name").alias("user_id"), (key % 8).cast("int").alias("x"), F.expr("cast(c_custkey div 8 as int)").alias("y"),
        F.lit(5).alias("z"), F.when(key % 3 == 0, "submitted").otherwise("claimed").alias("stage"), F.lit(None).cast("string").alias("data"),
    )


@query("tile_claim_available_all", "select x::int as x, y::int as y from range(8) u(x), (select unnest(range(max(c_custkey) // 8 + 2)) as y from customer) v where not exists (select 1 from customer where c_custkey % 2 = 0 and c_custkey % 8 = x and c_custkey // 8 = y)")
def tile_claim_available_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _assignments(spark, sf_dir)
    last = state.agg(F.max("y")).first()[0]
    return tiles.available(state, "s0", 5, (0, 7), (0, -1 if last is None else last + 1))


@query("tiles_summary_all", "select (c_custkey % 8)::int as x, (c_custkey // 8)::int as y, 5::int as z, case when c_custkey % 3 = 0 then 'submitted' else 'claimed' end as stage, c_name as user_id, null::varchar as data from customer where c_custkey % 2 = 1")
def tiles_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tiles_summary(_assignments(spark, sf_dir), "s1")


@query("xyz_to_bbox", f"select z::int as z, {r('-20037508.342789244 + 3 * 2 * 20037508.342789244 / pow(2, z)', 'west')}, {r('20037508.342789244 - 2 * 20037508.342789244 / pow(2, z)', 'south')} from range(2, 12) t(z)")
def xyz_to_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = [(z, spatial.xyz_to_bbox({"x": 3, "y": 0, "z": z})) for z in range(2, 12)]
    return rows(spark.createDataFrame([(z, b["west"], b["south"]) for z, b in boxes], "z int, west double, south double"))


# windows of a stream, run over the table at rest


@query(
    "stream_window_mean",
    f"select time_bucket(interval '6 hours', ts) as t, (user_id % 8)::int as y, ((user_id // 8) % 8)::int as x, {r('avg(value)', 'value')}, from events group by 1, 2, 3",
)
def stream_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("t"), (F.col("user_id") % 8).cast("int").alias("y"), (F.expr("user_id div 8") % 8).cast("int").alias("x"), "value")
    out = windowed(ev, ["value"], reducers.mean, "6 hours")
    return rows(out.withColumn("t", F.col("t").cast("timestamp_ntz")))


# a graph end to end

RGB = {
    "parameters": [{"name": "when", "optional": True, "default": ["1996-03-01", "1996-06-01"]}],
    "process_graph": {
        "load": {"process_id": "load_collection", "arguments": {"id": "scenes", "temporal_extent": {"from_parameter": "when"}, "bands": ["quantity", "discount", "tax"], "properties": {"line": _rule("lte", y=5)}}},
        "first": {"process_id": "reduce_dimension", "arguments": {"data": {"from_node": "load"}, "dimension": "t", "reducer": {"process_graph": {"f": {"process_id": "firstpixel", "arguments": {"data": {"from_parameter": "data"}}, "result": True}}}}},
        "scale": {"process_id": "apply", "arguments": {"data": {"from_node": "first"}, "process": {"process_graph": {
            "s": {"process_id": "linear_scale_range", "arguments": {"x": {"from_parameter": "x"}, "inputMin": 0, "inputMax": 50, "outputMin": 0, "outputMax": 255}},
            "t": {"process_id": "trunc", "arguments": {"x": {"from_node": "s"}}, "result": True},
        }}}},
        "color": {"process_id": "color_formula", "arguments": {"data": {"from_node": "scale"}, "formula": "Gamma RGB 1.5 Sigmoidal RGB 10 0.3 Saturation 1"}, "result": True},
    },
}


_RGB_IN = "((trunc(greatest(least({b}, 50), 0) / 50 * 255)::bigint % 256) / 255.0)"
_RGB_OUT = "255 * (" + _SIG.format(v="pow(" + _RGB_IN + ", 1 / 1.5)") + ")"


@query(
    "graph_json_rgb",
    SCENES.replace("from p group by all", "from p where right(item, 1)::int <= 5 group by all")
    + ", f as (select y, x, arg_min(quantity, t) as quantity, arg_min(discount, t) as discount, arg_min(tax, t) as tax from s where t >= '1996-03-01' and t < '1996-06-01' group by y, x) "
    + f"select y, x, {_each('case when {b} is not null then greatest(0, least(255, ' + _RGB_OUT + ')) end', ('quantity', 'discount', 'tax'))} from f",
)
def graph_json_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(execute(RGB, loaders={"load_collection": bind(load_collection, {"scenes": scenes(spark, sf_dir)})}), time=False)


ZONAL = {
    "load": {"process_id": "load_collection", "arguments": {"id": "scenes", "temporal_extent": ["1996-03-01", "1996-06-01"], "bands": ["price"], "properties": {"line": _rule("lte", y=5)}}},
    "zones": {"process_id": "aggregate_spatial", "arguments": {"data": {"from_node": "load"}, "geometries": FEATURES, "reducer": {"process_graph": {"m": {"process_id": "mean", "arguments": {"data": {"from_parameter": "data"}}, "result": True}}}}, "result": True},
}


@query(
    "graph_zonal",
    SCENES.replace("from p group by all", "from p where right(item, 1)::int <= 5 group by all")
    + f", {_BOX_SQL} select i::int as feature_index, t, {r('avg(price)', 'value')}, count(*) as total_count, count(price) as valid_count from s join f on x < e and x + 1 > w and 16 - y > s.s_ and 15 - y < n where t >= '1996-03-01' and t < '1996-06-01' group by i, t".replace("s.s_", "f.s"),
)
def graph_zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(execute(ZONAL, loaders=session_loaders(spark, {"scenes": scenes(spark, sf_dir)})).rows)


@query(
    "load_extent_window",
    f"{SCENES} select t, (y - 4)::int as y, (x - 3)::int as x, {_each('{b}', ('quantity', 'tax'))} from s where t >= '1996-03-01' and t < '1996-05-01' and x between 3 and 9 and y between 4 and 13",
)
def load_extent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = {"west": 3, "south": 2, "east": 10, "north": 12}
    return rows(load_collection(scenes(spark, sf_dir), extent, ["1996-03-01", "1996-05-01"], ["quantity", "tax"]))


@query(
    "load_scale_offset_all",
    SCENES.replace("arg_min(l_tax, l_orderkey) as tax", "nullif(arg_min(l_tax, l_orderkey), 0) as tax").replace("arg_min(l_discount, l_orderkey) as discount", "arg_min(l_discount, l_orderkey) * 100 + 1 as discount")
    + f"select t, y, x, {_each('{b}', ('discount', 'tax'))} from s",
)
def load_scale_offset_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenes: as many items as there are months and line numbers."""
    c = scenes(spark, sf_dir)
    c = Collection(c.id, c.items, c.pixels, c.grid, c.bands | {"discount": BandInfo(scale=100.0, offset=1.0), "tax": BandInfo(nodata=0.0)}, c.narrow)
    return rows(load_collection(c, bands=["discount", "tax"], max_items=100_000))


@query("load_property_all", f"{SCENES.replace('from p group by all', 'from p where item like ' + chr(39) + '%-1' + chr(39) + ' group by all').replace('select distinct t from p', 'select distinct t from p where item like ' + chr(39) + '%-1' + chr(39))} select t, y, x, {r('quantity', 'quantity')} from s")
def load_property_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scenes of one line number."""
    return rows(load_collection(scenes(spark, sf_dir), bands=["quantity"], properties={"line": "1"}, max_items=100_000))


_CALIBRATION = """<calibration><calibrationVectorList>
<calibrationVector><line>0</line><pixel count="2">0 7</pixel><sigmaNought count="2">20 27</sigmaNought></calibrationVector>
<calibrationVector><line>7</line><pixel count="2">0 7</pixel><sigmaNought count="2">34 55</sigmaNought></calibrationVector>
</calibrationVectorList></calibration>"""
_NOISE = """<noise><noiseVectorList>
<noiseVector><line>0</line><pixel>0 7</pixel><noiseLut>100 107</noiseLut></noiseVector>
<noiseVector><line>7</line><pixel>0 7</pixel><noiseLut>114 121</noiseLut></noiseVector>
</noiseVectorList></noise>"""


@query(
    "sar_chain",
    f"{EV} select t, y, x, {r('case when click > 0 then greatest(click * click - (100 + x + 2 * y), 0) / pow((1 - y / 7.0) * ((1 - x / 7.0) * 20 + x / 7.0 * 27) + y / 7.0 * ((1 - x / 7.0) * 34 + x / 7.0 * 55), 2) end', 'vv')} from c",
)
def sar_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From annotation documents to backscatter."""
    c = events_cube(spark, sf_dir)
    one = lambda text: spark.createDataFrame([(text,)], "value string")
    c = annotation.with_annotations(c.select({"vv": c.band("click")}), {"vv": one(_CALIBRATION)}, {"vv": one(_NOISE)})
    return rows(imagery.sar_backscatter(c, "sigma0-ellipsoid"))


@query("create_data_cube", "select timestamp '1900-01-01' as t, 0::int as y, 0::int as x where false")
def create_data_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.create_data_cube(spark.range(0)).df


@query("to_image", f"{EV} select timestamp '1900-01-01' as t, y, x, {r('click', 'click')} from c where t = '2024-01-02'")
def to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pixels.image_indexes(events_cube(spark, sf_dir), [1])
    return rows(pixels.to_image(temporal.filter_labels(c, [datetime(2024, 1, 2)]), REDUCED))


@query("cutline_footprints", f"{EV}, {_BOX_SQL} select t, y, x, {_each('case when exists (select 1 from f where x + 0.5 between w and e and 7.5 - y between s and n) then {b} end')} from c")
def cutline_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in the footprints of three items together."""
    return rows(spatial.cutline(events_cube(spark, sf_dir), spatial.union_of_footprints(FEATURES["features"])))


_TILE_GRAPH = render.scoped({
    "load": {"process_id": "load_collection", "arguments": {"id": "scenes", "temporal_extent": ["1996-03-01", "1996-05-01"], "bands": ["quantity"]}},
    "double": {"process_id": "apply", "arguments": {"data": {"from_node": "load"}, "process": {"process_graph": {"m": {"process_id": "multiply", "arguments": {"x": {"from_parameter": "x"}, "y": 2}, "result": True}}}}, "result": True},
})


@query(
    "graph_map_tile",
    f"""{SCENES}, seen as (select * from s where t >= '1996-03-01' and t < '1996-05-01'),
tile as (select j::int as y, i::int as x, floor((i + 0.5) / 8 * 22.5)::int as sx,
floor(16 - degrees(2 * atan(exp((7.5 - j) / 8 * 2 * pi() / 16)) - pi() / 2))::int as sy from range(8) a(i), range(8) b(j))
select d.t, tile.y, tile.x, {r('seen.quantity * 2', 'quantity')} from (select distinct t from seen) d cross join tile left join seen on seen.t = d.t and seen.x = tile.sx and seen.y = tile.sy""",
)
def graph_map_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for one tile of the web map grid, which reaches beyond the scenes."""
    loaders = session_loaders(spark, {"scenes": scenes(spark, sf_dir)})
    return rows(render.render_tile(_TILE_GRAPH, 8, 7, 4, loaders, configuration={"tile_size": 8, "extent": [0, 0, 16, 16]}))


_ELEMENTS = {
    "a": {"process_id": "array_apply", "arguments": {"data": {"from_parameter": "data"}, "context": {"by": 3}, "process": {"process_graph": {
        "w": {"process_id": "get_param_item", "arguments": {"parameter": {"from_parameter": "context"}, "path": "$.by"}},
        "m": {"process_id": "multiply", "arguments": {"x": {"from_parameter": "x"}, "y": {"from_node": "w"}}},
        "s": {"process_id": "add", "arguments": {"x": {"from_node": "m"}, "y": {"from_parameter": "index"}}, "result": True},
    }}}, "result": True},
}


@query("graph_array_apply", f"{EV}, n as (select *, row_number() over (partition by y, x order by t) - 1 as i from c) select t, y, x, {_each('{b} * 3 + i')} from n")
def graph_array_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = {"p": {"process_id": "apply_dimension", "arguments": {"data": {"from_parameter": "cube"}, "dimension": "t", "process": {"process_graph": _ELEMENTS}}, "result": True}}
    return rows(execute(graph, {"cube": events_cube(spark, sf_dir)}))
