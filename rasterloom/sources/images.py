"""Collections whose images differ in projection and resolution.

An image is an item's band with its own frame: ``item_id, band, epsg, transform ARRAY, width, height``, six numbers
that lead from columns and rows to coordinates as STAC's ``proj:transform`` does.  Pixels are rows ``item_id, band, line, pixel, value``.
A cube's grid is estimated from all frames in one aggregation, and each image is sampled on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import projections
from rasterloom.cube import Cube, Grid, reproject, reproject_bounds
from rasterloom.errors import FeatureUnsupported, OutputLimitExceeded
from rasterloom.operators import geocode
from rasterloom.sources.catalog import MAX_PIXELS, BandInfo, Collection, output_size, parse_crs

#: Columns of a table of frames; ``untrusted`` ones say nothing true about where an image lies.
FRAMES = "item_id string, band string, epsg int, transform array<double>, width int, height int, untrusted boolean"
_MARK = "\x1f"


def stac_frames(spark: SparkSession, url: str) -> DataFrame:
    """Frames out of item documents: of an asset or else of its item; assets without a transform have none.

    Radar items (with ``sar:`` properties) whose assets are in no projection of their own are untrusted: catalogues state one
    that was made of a bounding box.
    """
    asset = "struct<`proj:epsg`: int, `proj:code`: string, `proj:transform`: array<double>, `proj:shape`: array<int>, `sar:polarizations`: array<string>>"
    fields = f"type string, id string, properties struct<`proj:epsg`: int, `proj:code`: string, `proj:transform`: array<double>, `proj:shape`: array<int>, `sar:instrument_mode`: string, `sar:product_type`: string>, assets map<string, {asset}>"
    raw = spark.read.schema(fields).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(url)
    rows = raw.where("type = 'Feature' and assets is not null").select("id", "properties", F.explode("assets").alias("band", "a"))

    def either(name: str) -> Column:
        return F.coalesce(F.col("a")[name], F.col("properties")[name])

    code = F.regexp_extract(F.coalesce(F.col("a")["proj:code"], F.col("properties")["proj:code"], F.lit("")), "([0-9]+)$", 1)
    epsg = F.coalesce(F.col("a")["proj:epsg"], F.nullif(code, F.lit("")).cast("int"), F.col("properties")["proj:epsg"])
    radar = F.coalesce(F.col("properties")["sar:instrument_mode"], F.col("properties")["sar:product_type"]).isNotNull()
    shape = either("proj:shape")
    return rows.select(F.col("id").alias("item_id"), "band", epsg.alias("epsg"), either("proj:transform").alias("transform"), F.get(shape, F.lit(1)).alias("width"), F.get(shape, F.lit(0)).alias("height"), radar.alias("untrusted"))


def _crs_of(frames: DataFrame) -> list[int]:
    """The projections of frames, of which only known ones can be many."""
    found = sorted(r[0] for r in frames.select(F.coalesce("epsg", F.lit(4326)).alias("epsg")).distinct().limit(1000).collect())
    for crs in found:
        if not projections.known(crs):
            raise FeatureUnsupported(f"no transformation from {crs}")
    return found


def resolutions(frames: DataFrame, items: DataFrame, crs: int) -> DataFrame:
    """``item_id, band, dx, dy``: the size of each image's cells in a projection, at the middle of its item.

    Untrusted frames and those without a transform are left out.
    """
    known = frames.where("not coalesce(untrusted, false) and size(transform) >= 6")
    middle = items.select(F.col("id").alias("item_id"), ((F.col("west") + F.col("east")) / 2).alias("lon"), ((F.col("south") + F.col("north")) / 2).alias("lat"))
    out = None
    for source in _crs_of(known):
        own = known.where(F.coalesce("epsg", F.lit(4326)) == source).join(middle, "item_id")
        dx, dy = F.abs(F.get("transform", F.lit(0))), F.abs(F.get("transform", F.lit(4)))
        if source != crs:
            x, y = reproject(F.col("lon"), F.col("lat"), 4326, source)
            own = own.withColumns({"x": x, "y": y})
            corners = [reproject(F.col("x") + dx * i, F.col("y") + dy * j, source, crs) for i in (0, 1) for j in (0, 1)]
            dx, dy = (F.greatest(*[c[i] for c in corners]) - F.least(*[c[i] for c in corners]) for i in (0, 1))
        rows = own.select("item_id", "band", dx.alias("dx"), dy.alias("dy"))
        out = rows if out is None else out.unionByName(rows)
    return items.sparkSession.createDataFrame([], "item_id string, band string, dx double, dy double") if out is None else out


def estimate_grid(
    frames: DataFrame, items: DataFrame, spatial_extent: dict | None = None, bands: list[str] | None = None, width: int | None = None, height: int | None = None,
    target_crs: int | str | None = None, max_pixels: int | None = MAX_PIXELS,
) -> Grid:
    """The grid of a cube of items: the finest cells of all their images, over the extent or all items together.

    Without ``target_crs`` the projection is that of the first item (by id) that states one, else degrees.  Without any resolution
    a side that is not given is 1024 cells.
    """
    own = frames.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    if bands:
        own = own.where(F.col("band").isin(bands))
    trusted = own.where("not coalesce(untrusted, false)")
    if target_crs is None:
        first = trusted.where("epsg is not null").agg(F.min_by("epsg", F.struct("item_id", "band"))).first()[0]
        crs = first or 4326
    else:
        crs = parse_crs(target_crs)
    if spatial_extent:
        given, source = tuple(float(spatial_extent[k]) for k in ("west", "south", "east", "north")), parse_crs(spatial_extent.get("crs") or 4326)
    else:
        given, source = tuple(items.agg(F.min("west"), F.min("south"), F.max("east"), F.max("north")).first()), 4326
    bounds = reproject_bounds(given, source, crs)
    r = resolutions(own, items, crs).agg(F.min("dx"), F.min("dy"), F.count_distinct("band")).first()
    w, h = output_size(bounds, r[0], r[1], width, height)
    if max_pixels is not None:
        times = items.select("datetime").distinct().count()
        n = len(bands) if bands else max(1, r[2])
        if w * h * times * n > max_pixels:
            raise OutputLimitExceeded(f"{w} x {h} cells at {times} times in {n} bands are more than {max_pixels} values")
    return Grid(w, h, bounds, crs)


def places(frames: DataFrame, grid: Grid) -> DataFrame:
    """``item_id, band, y, x, line, pixel``: where the cells of a grid lie in each image that they meet."""
    out = None
    usable = frames.where("not coalesce(untrusted, false) and size(transform) >= 6 and width > 0 and height > 0")
    for crs in _crs_of(usable):
        t = [F.get("transform", F.lit(i)) for i in range(6)]
        edge = [(F.col("width") * i, F.col("height") * j) for i in (0, 1) for j in (0, 1)]
        corners = [(t[0] * c + t[1] * r + t[2], t[3] * c + t[4] * r + t[5]) for c, r in edge]
        own = usable.where(F.coalesce("epsg", F.lit(4326)) == crs)
        own = own.withColumns({n: f(*[p[i] for p in corners]) for n, f, i in (("west", F.least, 0), ("south", F.least, 1), ("east", F.greatest, 0), ("north", F.greatest, 1))})
        y0, y1, x0, x1 = geocode.box_on(grid, crs, 0.0)
        own = own.withColumns({"y0_": y0, "y1_": y1, "x0_": x0, "x1_": x1}).where("y0_ <= y1_ and x0_ <= x1_")
        own = own.withColumn("y", F.explode(F.sequence("y0_", "y1_"))).repartition("item_id", "band", "y").withColumn("x", F.explode(F.sequence("x0_", "x1_")))
        px, py = reproject(*grid.centre(), grid.crs, crs)
        own = own.withColumns({"px": px - t[2], "py": py - t[5]})
        det = t[0] * t[4] - t[1] * t[3]
        pixel, line = (t[4] * F.col("px") - t[1] * F.col("py")) / det, (t[0] * F.col("py") - t[3] * F.col("px")) / det
        rows = own.select("item_id", "band", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), line.alias("line"), pixel.alias("pixel"))
        rows = rows.where((F.col("line") >= 0) & (F.col("pixel") >= 0))
        out = rows if out is None else out.unionByName(rows)
    return frames.sparkSession.createDataFrame([], "item_id string, band string, y int, x int, line double, pixel double") if out is None else out


@dataclass(frozen=True)
class Images:
    """Frames and pixels of a collection's images."""

    frames: DataFrame
    pixels: DataFrame  #: ``item_id, band, line, pixel, value``
    #: The pixels within windows ``item_id, window ARRAY`` (first and last line and pixel), where files can be read in part.
    part: Callable[[DataFrame], DataFrame] | None = None

    def collection(self, id_: str, items: DataFrame, bands: dict[str, BandInfo], grid: Grid | None = None) -> Collection:
        """A collection whose grid is estimated over all items, unless it is given."""
        return Collection(id_, items, self.pixels, grid or estimate_grid(self.frames, items, max_pixels=None), bands, reader=self.read)

    def over(self, collection: Collection, items: DataFrame, **how) -> Collection:
        """The collection on the grid that some of its items ask for."""
        return replace(collection, grid=estimate_grid(self.frames, items, **how))

    def read(self, items: DataFrame, names: list[str], infos: dict[str, BandInfo], grid: Grid, method: str) -> Cube:
        """A cube of the given items: each image sampled on the grid, then the first valid value by item id at each time."""
        asked = items.select(F.col("id").alias("item_id"))
        key = F.concat_ws(_MARK, "item_id", "band")
        of = lambda df: df.join(asked, "item_id", "left_semi").where(F.col("band").isin(names))
        at = places(of(self.frames), grid).withColumn("item_id", key)
        # files are decoded only where the grid meets them, a kernel's reach wider
        reach = geocode.KERNELS.get(method, (3,))[0] + 1
        ends = [(f(n) + d).cast("int") for n in ("line", "pixel") for f, d in ((lambda c: F.floor(F.min(c)), -reach), (lambda c: F.floor(F.max(c)), reach))]
        source = self.pixels if self.part is None else self.part(places(of(self.frames), grid).groupBy("item_id").agg(F.array(*ends).alias("window")))
        raw = of(source).select(key.alias("item_id"), "band", "line", "pixel", F.col("value").cast("double").alias("value"))
        value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
        for b in names:
            if infos[b].nodata is not None:
                value = F.when((F.col("band") == b) & (F.col("value") == F.lit(float(infos[b].nodata))), None).otherwise(value)
        found = geocode.warp(raw.withColumn("value", value), at, ["value"], method).where("value is not null")
        parts = F.split("item_id", _MARK)
        found = found.select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("band"), "y", "x", "value").join(items, "id")
        one = {b: F.min_by("value", F.when(F.col("band") == b, F.col("id"))) * infos[b].scale + infos[b].offset for b in names}
        df = found.groupBy(F.col("datetime").alias("t"), "y", "x").agg(*[c.alias(b) for b, c in one.items()])
        return Cube(df, tuple(names), grid)
