"""The datacube: a wide table of pixels and what the driver knows about it.

Rows are ``t TIMESTAMP_NTZ, y INT, x INT`` and a DOUBLE column per band; NULL is a missing
value.  A cube is dense: each of its timestamps has a row for every cell of the grid.  A
cube whose time was reduced holds the one timestamp ``REDUCED`` and ``has_t`` is false.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import projections
from rasterloom.errors import DimensionNotAvailable
from rasterloom.projections import SPHERE  # noqa: F401

REDUCED = datetime(1900, 1, 1)
KEYS = ("t", "y", "x")
TIME_NAMES = {"t", "temporal", "time"}
BAND_NAMES = {"bands", "spectral"}
SPACE_NAMES = {"x", "y", "spatial"}


@dataclass(frozen=True)
class Grid:
    """Cells of equal size; row 0 is at the top."""

    width: int
    height: int
    bounds: tuple[float, float, float, float]
    crs: int = 4326

    @property
    def dx(self) -> float:
        return (self.bounds[2] - self.bounds[0]) / self.width

    @property
    def dy(self) -> float:
        return (self.bounds[3] - self.bounds[1]) / self.height

    def centre(self) -> tuple[Column, Column]:
        """Coordinates of the centre of the cell ``(x, y)``."""
        return self.bounds[0] + (F.col("x") + 0.5) * self.dx, self.bounds[3] - (F.col("y") + 0.5) * self.dy

    def cells(self, spark: SparkSession) -> DataFrame:
        """A row ``(y, x)`` for every cell, made in parallel."""
        n = spark.range(self.width * self.height)
        return n.select(F.expr(f"cast(id div {self.width} as int)").alias("y"), (F.col("id") % self.width).cast("int").alias("x"))

    def shift(self, other: Grid) -> tuple[int, int] | None:
        """Rows and columns from the other grid's first cell to this one's, if their cells coincide."""
        if self.crs != other.crs or not math.isclose(self.dx, other.dx, rel_tol=1e-12) or not math.isclose(self.dy, other.dy, rel_tol=1e-12):
            return None
        down, right = (other.bounds[3] - self.bounds[3]) / other.dy, (self.bounds[0] - other.bounds[0]) / other.dx
        at = round(down), round(right)
        return at if abs(down - at[0]) < 1e-9 and abs(right - at[1]) < 1e-9 else None

    def window(self, bounds: tuple[float, float, float, float], margin: int = 0) -> tuple[int, int, int, int]:
        """First and last row and column of the cells that meet an extent, and ``margin`` more on each side."""
        y = math.floor((self.bounds[3] - bounds[3]) / self.dy) - margin, math.ceil((self.bounds[3] - bounds[1]) / self.dy) - 1 + margin
        x = math.floor((bounds[0] - self.bounds[0]) / self.dx) - margin, math.ceil((bounds[2] - self.bounds[0]) / self.dx) - 1 + margin
        return *y, *x

    @classmethod
    def covering(cls, bounds: tuple[float, float, float, float], resolution: float, crs: int) -> Grid:
        """Cells of one resolution from the upper left corner on."""
        w, h = (max(1, math.ceil((bounds[i + 2] - bounds[i]) / resolution - 1e-9)) for i in (0, 1))
        return cls(w, h, (bounds[0], bounds[3] - h * resolution, bounds[0] + w * resolution, bounds[3]), crs)


def dimension(name: str) -> str:
    """``t`` or ``bands``, whatever of its names is used."""
    low = name.lower()
    if low in TIME_NAMES:
        return "t"
    if low in BAND_NAMES:
        return "bands"
    raise DimensionNotAvailable(f"there is no dimension {name!r} to work along")


@dataclass(frozen=True)
class Footprints:
    """Where a cube has data: ``t, geometry`` of the items that it is made of."""

    df: DataFrame

    def at_all_times(self) -> Footprints:
        """Of slices that were reduced: each footprint counts for the result."""
        return Footprints(self.df.select(F.lit(None).cast("timestamp_ntz").alias("t"), "geometry").distinct())

    def relabelled(self, labels: Column) -> Footprints:
        """Each footprint at the times (an array) that its own has become."""
        kept = self.df.where("t is null")
        return Footprints(self.df.where("t is not null").select(F.explode(labels).alias("t"), "geometry").unionByName(kept).distinct())

    def joined(self, other: Footprints | None) -> Footprints | None:
        """Of two cubes together; one that has none covers everything."""
        return None if other is None else Footprints(self.df.unionByName(other.df).distinct())


@dataclass(frozen=True)
class Cube:
    """A lazy cube."""

    df: DataFrame
    bands: tuple[str, ...]
    grid: Grid
    has_t: bool = True
    has_bands: bool = True
    times: tuple[datetime, ...] | None = None  #: the timestamps in order, where they are known
    footprints: Footprints | None = None  #: where the items lie that the cube is made of; None is everywhere

    def with_df(self, df: DataFrame, bands: tuple[str, ...] | list[str] | None = None, **more) -> Cube:
        """Other rows; their timestamps are unknown unless given.

        Where time is reduced, the footprints of all slices count together.
        """
        if self.footprints is not None and self.has_t and more.get("has_t") is False and "footprints" not in more:
            more["footprints"] = self.footprints.at_all_times()
        return replace(self, df=df, bands=tuple(self.bands if bands is None else bands), **{"times": None} | more)

    def select(self, columns: dict[str, Column], **more) -> Cube:
        """Keys and new bands, as one projection."""
        out = self.df.select(*KEYS, *[c.cast("double").alias(name) for name, c in columns.items()])
        return self.with_df(out, list(columns), **{"times": self.times} | more)

    def band(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def labels(self) -> list[datetime]:
        """The timestamps in order; a job over one column, unless they are known."""
        if self.times is not None:
            return list(self.times)
        return [r[0] for r in self.df.select("t").distinct().orderBy("t").collect()]

    def long(self) -> DataFrame:
        """One row per band: ``t, y, x, band, value``."""
        return self.df.unpivot(list(KEYS), [f"`{b}`" for b in self.bands], "band", "value")

    def dense(self, times: list[datetime] | DataFrame) -> Cube:
        """With a row for every cell at every one of ``times``, whose number reaches the driver."""
        spark = self.df.sparkSession
        if not isinstance(times, list):
            times = [r[0] for r in times.select("t").distinct().orderBy("t").collect()]
        labels = F.array(*[F.lit(t).cast("timestamp_ntz") for t in times]).cast("array<timestamp_ntz>")
        frame = self.grid.cells(spark).select(F.explode(labels).alias("t"), "y", "x")
        return self.with_df(frame.join(self.df, list(KEYS), "left").select(*KEYS, *[self.band(b) for b in self.bands]), times=tuple(sorted(set(times))))


def column_names(df: DataFrame, n: int, *other: str) -> list[str]:
    """Names that a table does not have yet, and that are none of some others."""
    taken = {c.lower() for c in (*df.columns, *other)}
    return [name for name in (f"_n{i}" for i in range(n + len(taken))) if name not in taken][:n]


def clean(value: Column) -> Column:
    """DOUBLE, with NaN as NULL."""
    v = value.cast("double")
    return F.when(~F.isnan(v), v)


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one projection in another."""
    return projections.transform(x, y, source, target, projections.COLUMNS)


def reproject_bounds(b: tuple[float, float, float, float], source: int, target: int) -> tuple[float, float, float, float]:
    """The box of a box in another projection."""
    return projections.box_in(b, source, target)
