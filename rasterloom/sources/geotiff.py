"""Images out of GeoTIFF files, read by tasks.

A file is a row; tasks read its directory of tags, and of its strips or tiles only those that meet the window
asked for.  Numbers of all sizes, chunky or planar, uncompressed or deflated (with horizontal differences) are read.  What
comes out are the frames and pixels of ``sources.images``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.cube import REDUCED, Cube, Grid
from rasterloom.errors import NoDataAvailable
from rasterloom.operators.temporal import parse_time
from rasterloom.sources.images import FRAMES, Images

# Sizes and codes of the field types of TIFF, and kinds of numbers by sample format.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_PIXELS = "item_id string, band string, line int, pixel int, value double"


def tags(data: bytes) -> dict[int, Any]:
    """The fields of the first directory: tuples of numbers, or texts."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("the file is no TIFF")
    (at,) = struct.unpack(f"{order}I", data[4:8])
    (n,) = struct.unpack(f"{order}H", data[at : at + 2])
    out: dict[int, Any] = {0: order}
    for i in range(n):
        entry = at + 2 + 12 * i
        tag, kind, count = struct.unpack(f"{order}HHI", data[entry : entry + 8])
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = count * struct.calcsize(code)
        place = entry + 8 if size <= 4 else struct.unpack(f"{order}I", data[entry + 8 : entry + 12])[0]
        raw = data[place : place + size]
        out[tag] = raw.rstrip(b"\0").decode() if code == "s" else struct.unpack(f"{order}{count}{code}", raw)
    return out


def frame(t: dict[int, Any]) -> tuple[int | None, list[float], int, int]:
    """Projection, transform, width and height."""
    sx, sy, _ = t.get(33550, (1.0, 1.0, 0.0))
    i, j, _, x, y, _ = t.get(33922, (0.0,) * 6)[:6]
    keys = t.get(34735, ())
    epsg = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = epsg.get(3072) or epsg.get(2048)
    transform = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy] if 33550 in t else [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    return (int(code) if code else None), transform, int(t[256][0]), int(t[257][0])


def band_names(t: dict[int, Any]) -> list[str]:
    """Names by the descriptions in the file, others by number."""
    n = t.get(277, (1,))[0]
    told = dict(re.findall(r'name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)<', t.get(42112, "")))
    return [told.get(str(i)) or f"band{i + 1}" for i in range(n)]


def parts(data: bytes, t: dict[int, Any], window: tuple[int, int, int, int] | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """First band, line and pixel of each strip or tile that meets a window (first and last line and pixel), and its numbers (lines, pixels, bands)."""
    _, _, width, height = frame(t)
    n, planar, packing = t.get(277, (1,))[0], t.get(284, (1,))[0], t.get(259, (1,))[0]
    if packing not in (1, 8, 32946):
        raise ValueError(f"compression {packing} is not read")
    kind = np.dtype(f"{t[0]}{_KINDS[t.get(339, (1,))[0]]}{t.get(258, (8,))[0] // 8}")
    tiled = 322 in t
    pw, ph = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, (height,))[0], height))
    starts, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    across, down = -(-width // pw), -(-height // ph)
    deep = n if planar == 1 else 1
    l0, l1, p0, p1 = window or (0, height - 1, 0, width - 1)
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        band, place = divmod(k, across * down)
        line, pixel = place // across * ph, place % across * pw
        if line > l1 or line + ph <= l0 or pixel > p1 or pixel + pw <= p0:
            continue
        raw = data[start : start + size]
        raw = raw if packing == 1 else zlib.decompress(raw)
        lines = ph if tiled else min(ph, height - line)
        block = np.frombuffer(raw, dtype=kind, count=lines * pw * deep).reshape(lines, pw, deep)
        if t.get(317, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        yield band, line, pixel, block[: height - line, : width - pixel]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item_id", pa.string()), ("band", pa.string()), ("epsg", pa.int32()), ("transform", pa.list_(pa.float64())), ("width", pa.int32()), ("height", pa.int32()), ("untrusted", pa.bool_())])
    for batch in batches:
        for name, data in zip(batch.column("item_id").to_pylist(), batch.column("content"), strict=True):
            t = tags(data.as_buffer().to_pybytes())
            place = frame(t)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, b, *place, False), strict=True)) for b in band_names(t)], schema=schema)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows = batch.column("window").to_pylist()
        for name, data, window in zip(batch.column("item_id").to_pylist(), batch.column("content"), windows, strict=True):
            raw = data.as_buffer().to_pybytes()
            t = tags(raw)
            names = band_names(t)
            missing = float(t[42113]) if 42113 in t else float("nan")
            l0, l1, p0, p1 = window or (0, t[257][0] - 1, 0, t[256][0] - 1)
            for band, line, pixel, block in parts(raw, t, (l0, l1, p0, p1)):
                for k in range(block.shape[2]):
                    value = block[:, :, k].astype(np.float64)
                    i, j = np.nonzero(~np.isnan(value) & (value != missing))
                    at = (i + line >= l0) & (i + line <= l1) & (j + pixel >= p0) & (j + pixel <= p1)
                    i, j = i[at], j[at]
                    for s in range(0, len(i), 1 << 16):
                        a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                        cols = [pa.array([name] * len(a), pa.string()), pa.array([names[band + k]] * len(a), pa.string()), pa.array(a + line, pa.int32()), pa.array(b + pixel, pa.int32()), pa.array(value[a, b])]
                        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "band", "line", "pixel", "value"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, content``: files by their names without folder and ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1).alias("item_id"), "content")


def read_pixels(files: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """``item_id, band, line, pixel, value`` of the pixels that are not missing; of the files in ``windows(item_id, window ARRAY)``
    only between the first and last line and the first and last pixel given there.
    """
    none = F.lit(None).cast("array<int>").alias("window")
    asked = files.withColumn("window", none) if windows is None else files.join(windows.select("item_id", "window"), "item_id")
    return asked.select("item_id", "content", "window").mapInArrow(_pixels, _PIXELS)


def read_images(spark: SparkSession, path: str) -> Images:
    """Frames and pixels of the GeoTIFF files of a folder, or of one."""
    files = read_files(spark, path)
    return Images(files.mapInArrow(_frames, FRAMES), read_pixels(files), lambda windows: read_pixels(files, windows))


def load_image(spark: SparkSession, path: str, bands: list[str] | None = None, at: Any = REDUCED) -> Cube:
    """One file as a cube on its own grid, which has to be upright."""
    files = read_files(spark, path)
    rows = files.mapInArrow(_frames, FRAMES).collect()
    if not rows:
        raise NoDataAvailable(f"there is no image at {path}")
    names, r = [b for b in (x["band"] for x in rows) if not bands or b in bands], rows[0]
    dx, _, x, _, dy, y = r["transform"]
    grid = Grid(r["width"], r["height"], (x, y + dy * r["height"], x + dx * r["width"], y) if dy < 0 else (0.0, 0.0, float(r["width"]), float(r["height"])), r["epsg"] or 4326)
    found = read_pixels(files).groupBy(F.col("line").alias("y"), F.col("pixel").alias("x"))
    df = found.agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in names])
    when = parse_time(at)
    cube = Cube(df.select(F.lit(when).cast("timestamp_ntz").alias("t"), "y", "x", *[f"`{b}`" for b in names]), tuple(names), grid, has_t=False)
    return cube.dense([when])
