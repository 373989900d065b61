import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def make(spark):
    """A cube out of ``{date: {band: rows of values}}``."""
    from rasterloom.cube import Cube, Grid

    def build(slices, crs=4326, bounds=None, **more):
        bands = list(next(iter(slices.values())))
        out = []
        for day, images in slices.items():
            first = images[bands[0]]
            for y in range(len(first)):
                for x in range(len(first[0])):
                    out.append((datetime.fromisoformat(day), y, x, *[None if images[b][y][x] is None else float(images[b][y][x]) for b in bands]))
        h, w = len(first), len(first[0])
        df = spark.createDataFrame(out, "t timestamp_ntz, y int, x int, " + ", ".join(f"`{b}` double" for b in bands))
        return Cube(df, tuple(bands), Grid(w, h, bounds or (0.0, 0.0, float(w), float(h)), crs), **more)

    return build


@pytest.fixture(scope="session")
def image():
    """A slice of a cube as ``{band: rows of values}``."""

    def read(cube, day=None):
        rows = [r for r in cube.df.collect() if day is None or r["t"] == datetime.fromisoformat(day)]
        out = {b: [[None] * cube.grid.width for _ in range(cube.grid.height)] for b in cube.bands}
        assert len(rows) == cube.grid.width * cube.grid.height
        for r in rows:
            for b in cube.bands:
                out[b][r["y"]][r["x"]] = r[b]
        return out

    return read
