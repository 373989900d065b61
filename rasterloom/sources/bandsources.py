"""Bands that no image file holds: which asset of an item gives which band, and radar collections that have them.

A rule says, by patterns on the collection and on the key of an asset, which bands come out of a document; groups of the
asset's pattern fill the names.  Rules become one projection over the table of assets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.cube import Cube, Grid
from rasterloom.errors import ProcessParameterInvalid
from rasterloom.operators import geocode
from rasterloom.sources import annotation
from rasterloom.sources.catalog import BandInfo, Collection, mosaic

#: Columns of a table of assets.
ASSETS = "item_id string, collection string, asset string, media_type string, roles array<string>, href string"


@dataclass(frozen=True)
class BandSource:
    """One rule.

    ``collection`` is searched in a collection's id, ``asset`` has to match a whole key; of the media types and
    roles one has to be the asset's.  ``bands`` are pairs of a name and of what is read; ``sibling`` is
    the band whose image shares the geometry.  Names hold groups of ``asset`` in braces.
    """

    collection: str
    asset: str
    bands: tuple[tuple[str, str], ...]
    media_types: tuple[str, ...] = ("application/xml",)
    roles: tuple[str, ...] = ("metadata",)
    sibling: str | None = None

    def fill(self, template: str) -> Column:
        """A name with its groups out of the key."""
        number = re.compile(self.asset).groupindex
        parts = re.split(r"{(\w+)}", template)
        return F.concat(*[F.regexp_extract("asset", f"^(?:{_plain(self.asset)})$", number[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    def offers(self) -> Column:
        """The bands of a row of the table of assets, an empty array where the rule does not hold."""
        holds = F.col("collection").rlike(self.collection) & F.col("media_type").isin(*self.media_types) & F.arrays_overlap("roles", F.array(*map(F.lit, self.roles))) & F.col("asset").rlike(f"^(?:{_plain(self.asset)})$")
        sibling = F.lit(None).cast("string") if self.sibling is None else self.fill(self.sibling)
        found = F.array(*[F.struct(self.fill(n).alias("band"), F.lit(q).alias("quantity"), sibling.alias("sibling")) for n, q in self.bands])
        return F.when(F.coalesce(holds, F.lit(False)), found).otherwise(F.slice(found, 1, 0))


def _plain(pattern: str) -> str:
    """Named groups as the JVM writes them."""
    return pattern.replace("(?P<", "(?<")


# How catalogues of Sentinel-1 GRD name their annotations.
SENTINEL_1 = (
    BandSource("sentinel-1-grd", "schema-calibration-(?P<pol>[a-z]{2})", (("{pol}_sigma0_lut", "sigma0_lut"), ("{pol}_beta0_lut", "beta0_lut"), ("{pol}_gamma0_lut", "gamma0_lut"), ("{pol}_dn_lut", "dn_lut"), ("{pol}_ellipsoid_incidence_angle", annotation.ANGLE)), sibling="{pol}"),
    BandSource("sentinel-1-grd", "schema-noise-(?P<pol>[a-z]{2})", (("{pol}_noise_lut", "noise"),), sibling="{pol}"),
)


def offered(assets: DataFrame, rules: tuple[BandSource, ...] = SENTINEL_1) -> DataFrame:
    """``item_id, band, quantity, sibling, href``: what the assets give by the rules; of several assets for a band the first key's."""
    found = assets.select("item_id", "asset", "href", F.explode(F.flatten(F.array(*[r.offers() for r in rules]))).alias("b"))
    first = F.min_by(F.struct("b.quantity", "b.sibling", "href"), "asset")
    return found.groupBy("item_id", F.col("b.band").alias("band")).agg(first.alias("f")).select("item_id", "band", "f.*")


def derived_bands(assets: DataFrame, rules: tuple[BandSource, ...] = SENTINEL_1) -> list[str]:
    """Names of all bands that the rules find, in order."""
    return [r[0] for r in offered(assets, rules).select("band").distinct().orderBy("band").collect()]


def stac_assets(spark: SparkSession, url: str) -> DataFrame:
    """Assets of item documents, hrefs that are relative resolved against their document's folder."""
    fields = "type string, id string, collection string, assets map<string, struct<href: string, type: string, roles: array<string>>>"
    reader = spark.read.schema(fields).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    raw = reader.json(url).select("*", F.col("_metadata.file_path").alias("path")).where("type = 'Feature' and assets is not null")
    rows = raw.select("id", "collection", "path", F.explode("assets").alias("asset", "a"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    href = F.when(F.col("a.href").rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:|/)"), F.col("a.href")).otherwise(F.concat(folder, F.lit("/"), F.regexp_replace("a.href", r"^\./", "")))
    return rows.select(F.col("id").alias("item_id"), "collection", "asset", F.col("a.type").alias("media_type"), "a.roles", href.alias("href"))


def read_hrefs(spark: SparkSession, folder: str, glob: str = "*.xml") -> DataFrame:
    """``href, value``: the documents below a folder, by their paths."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    return files.select(F.col("_metadata.file_path").alias("href"), "value")


@dataclass(frozen=True)
class Radar:
    """What a radar collection has beside its items: pixels by line, control points, assets and their documents."""

    pixels: DataFrame  #: ``item_id, line, pixel`` and a column per polarisation
    points: DataFrame  #: ``item_id, line, pixel, x, y``, coordinates in ``crs``
    assets: DataFrame
    documents: DataFrame  #: ``href, value``
    crs: int = 4326
    rules: tuple[BandSource, ...] = SENTINEL_1

    def collection(self, id_: str, items: DataFrame, grid: Grid, bands: list[str]) -> Collection:
        """A collection on a map grid whose bands are those stored and all that the rules find.

        Projections that items state are not used: only control points say where an image lies.
        """
        stored = {b: BandInfo(nodata=0.0) for b in bands}
        more = {r["band"]: BandInfo(like=r["sibling"]) for r in offered(self.assets, self.rules).groupBy("band").agg(F.min("sibling").alias("sibling")).collect()}
        return Collection(id_, items, self.pixels, grid, {**more, **stored}, reader=self.read)

    def read(self, items: DataFrame, names: list[str], infos: dict[str, BandInfo], grid: Grid, method: str) -> Cube:
        """A cube of the given items: stored bands sampled at the cells' places in each image, others evaluated there.

        A derived band is missing where its sibling is.
        """
        asked = items.select(F.col("id").alias("item_id"))
        stored = [b for b in self.pixels.columns if b in infos and b not in ("item_id", "line", "pixel")]
        derived = [b for b in names if b not in stored]
        siblings = {infos[b].like for b in derived} - {None}
        if siblings - set(stored):
            raise ProcessParameterInvalid(f"the band {min(siblings - set(stored))} is missing")
        read = [b for b in stored if b in names or b in siblings]
        pixels = self.pixels.join(asked, "item_id", "left_semi").select("item_id", "line", "pixel", *[F.nullif(F.col(f"`{b}`").cast("double"), F.lit(infos[b].nodata)).alias(b) if infos[b].nodata is not None else F.col(f"`{b}`") for b in read])
        places = geocode.inverse_map(geocode.splines(self.points.join(asked, "item_id", "left_semi")), grid, self.crs)
        found = geocode.warp(pixels, places, read, method)
        links = offered(self.assets.join(asked, "item_id", "left_semi"), self.rules)
        quantity = {r["band"]: r["quantity"] for r in links.where(F.col("band").isin(derived)).groupBy("band").agg(F.min("quantity").alias("quantity")).collect()} if derived else {}
        for b in derived:
            documents = links.where(F.col("band") == b).join(self.documents, "href").select("item_id", "value")
            q = quantity.get(b)
            if q is None:
                raise ProcessParameterInvalid(f"no item has a document for the band {b}")
            if q == "noise":
                found = annotation.noise_of(found, documents, b, item="item_id")
            elif q == annotation.ANGLE:
                found = annotation.angle_of(found, documents, b, item="item_id")
            else:
                found = annotation.evaluate(found, annotation.calibration(documents, q), b, item="item_id")
            if infos[b].like:
                found = found.withColumn(b, F.when(F.col(f"`{infos[b].like}`").isNotNull(), F.col(f"`{b}`")))
        return mosaic(items, found.select("item_id", "y", "x", *[f"`{b}`" for b in names]), names, grid)
