import struct
import zlib
from datetime import datetime

import numpy as np
import pytest

from rasterloom.cube import Grid
from rasterloom.errors import FeatureUnsupported, NoDataAvailable, ProcessParameterInvalid
from rasterloom.operators.resample import to_grid
from rasterloom.plans.graph import bind
from rasterloom.services.render import render_tile
from rasterloom.sinks.save import png, save_result
from rasterloom.sinks.tiles import HALF, tiles_of, zoom_grid
from rasterloom.sources import geotiff
from rasterloom.sources.catalog import BandInfo, Collection, load_collection, load_url
from rasterloom.sources.geotiff import frame, parts, read_images, tags


def sample(make, **more):
    values = {"red": [[1.0, 2.0, 3.0], [4.0, None, 6.0]], "nir": [[10.0, 20.0, 30.0], [40.0, 50.0, None]]}
    return make({"2024-01-01": values}, bounds=(5.0, 40.0, 8.0, 42.0), **more), values


@pytest.mark.parametrize(("dtype", "nodata"), [(None, None), ("float32", -1.0), ("uint8", 255), ("int16", None)])
def test_what_is_saved_is_loaded_again(spark, make, image, tmp_path, dtype, nodata):
    cube, values = sample(make)
    (tmp_path / "a.tif").write_bytes(save_result(cube, "GTiff", {"dtype": dtype, "nodata": nodata}).data)
    for how in ({}, {"format": "GTiff"}):
        back = load_url(spark, str(tmp_path / "a.tif"), **how)
        assert back.bands == ("red", "nir") and back.grid == cube.grid and image(back) == values
    assert load_url(spark, str(tmp_path / "a.tif"), options={"bands": ["nir"]}).bands == ("nir",)
    with pytest.raises(FeatureUnsupported):
        load_url(spark, "x.zarr", "zarr")
    (tmp_path / "none").mkdir()
    with pytest.raises(NoDataAvailable):
        geotiff.load_image(spark, str(tmp_path / "none"))


def encoded(image, tile=None, deflate=False, predictor=False, order="<", rows=2):
    """A TIFF of (bands, lines, pixels), chunky, in strips of some rows or in tiles."""
    n, h, w = image.shape
    kind = image.dtype.newbyteorder(order)
    if tile:
        blocks = [np.pad(image[:, y : y + tile, x : x + tile], ((0, 0), (0, max(0, y + tile - h)), (0, max(0, x + tile - w)))) for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        blocks = [image[:, y : y + rows] for y in range(0, h, rows)]
    bodies = []
    for b in blocks:
        b = np.moveaxis(b, 0, -1)
        if predictor:
            b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1]))
        raw = b.astype(kind).tobytes()
        bodies.append(zlib.compress(raw) if deflate else raw)
    starts, at = [], 8
    for b in bodies:
        starts.append(at)
        at += len(b)
    fields = [(256, "H", [w]), (257, "H", [h]), (258, "H", [8 * kind.itemsize] * n), (259, "H", [8 if deflate else 1]), (277, "H", [n]), (317, "H", [2 if predictor else 1]), (339, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n)]
    sizes = [len(b) for b in bodies]
    fields += [(322, "H", [tile]), (323, "H", [tile]), (324, "I", starts), (325, "I", sizes)] if tile else [(273, "I", starts), (278, "H", [rows]), (279, "I", sizes)]
    fields.sort()
    head, extra, extra_at = struct.pack(f"{order}H", len(fields)), b"", at + 2 + 12 * len(fields) + 4
    for tag, code, v in fields:
        packed = struct.pack(f"{order}{len(v)}{code}", *v)
        head += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[code], len(v))
        if len(packed) > 4:
            head += struct.pack(f"{order}I", extra_at + len(extra))
            extra += packed
        else:
            head += packed.ljust(4, b"\0")
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, at) + b"".join(bodies) + head + b"\0" * 4 + extra


@pytest.mark.parametrize("how", [{}, {"tile": 16}, {"tile": 16, "deflate": True, "predictor": True}, {"order": ">"}, {"deflate": True, "rows": 5}])
@pytest.mark.parametrize("dtype", ["u1", "i2", "f8"])
def test_layouts(how, dtype):
    if how.get("predictor") and dtype == "f8":
        pytest.skip("differences are of whole numbers")
    rng = np.random.default_rng(0)
    image = rng.integers(0, 100, (3, 37, 21)).astype(dtype)
    data = encoded(image, **how)
    t = tags(data)
    assert frame(t)[2:] == (21, 37) and geotiff.band_names(t) == ["band1", "band2", "band3"]
    whole = np.zeros_like(image)
    for _, line, pixel, block in parts(data, t):
        whole[:, line : line + block.shape[0], pixel : pixel + block.shape[1]] = np.moveaxis(block, -1, 0)
    assert (whole == image).all()
    some = [(line, pixel) for _, line, pixel, _ in parts(data, t, (17, 18, 3, 4))]
    assert some == ([(16, 0)] if how.get("tile") else [(line, 0) for line in range(0, 37, how.get("rows", 2)) if line <= 18 and line + how.get("rows", 2) > 17])
    with pytest.raises(ValueError, match="no TIFF"):
        tags(b"PK\3\4" + bytes(20))


def test_a_window_of_files_makes_a_cube(spark, make, tmp_path, image):
    """Two files side by side; only strips that the extent meets are decoded."""
    one, values = sample(make)
    two = make({"2024-01-01": {"red": [[7.0] * 3] * 2, "nir": [[8.0] * 3] * 2}}, bounds=(8.0, 40.0, 11.0, 42.0))
    for name, c in (("one", one), ("two", two)):
        (tmp_path / f"{name}.tif").write_bytes(save_result(c, "GTiff").data)
    items = spark.createDataFrame([(n, "c", datetime(2024, 1, 1), w, 40.0, w + 3, 42.0, {}) for n, w in (("one", 5.0), ("two", 8.0))], "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>")
    images = read_images(spark, str(tmp_path))
    c = images.collection("c", items, {"red": BandInfo(), "nir": BandInfo(scale=0.1)})
    assert c.grid == Grid(6, 2, (5.0, 40.0, 11.0, 42.0), 4326)
    got = image(load_collection(c, bands=["red", "nir"]))
    assert got["red"] == [[1.0, 2.0, 3.0, 7.0, 7.0, 7.0], [4.0, None, 6.0, 7.0, 7.0, 7.0]] and got["nir"][0][1] == pytest.approx(2.0)
    part = load_collection(c, {"west": 7, "south": 41, "east": 9, "north": 42}, bands=["red"])
    assert part.grid.width == 2 and image(part)["red"] == [[3.0, 7.0]]
    windows = spark.createDataFrame([("one", [0, 0, 1, 2])], "item_id string, window array<int>")
    assert sorted((r["line"], r["pixel"], r["value"]) for r in images.part(windows).where("band = 'red'").collect()) == [(0, 1, 2.0), (0, 2, 3.0)]


def pixels_of(data):
    """The rows of a PNG of one band with opacity."""
    w, h = struct.unpack(">II", data[16:24])
    kind = data[25]
    depth = {4: 2, 6: 4}[kind]
    body, at = b"", 8
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body += data[at + 8 : at + 8 + n] if name == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * depth)[:, 1:].reshape(h, w, depth)


def test_all_tiles_of_a_zoom_level_equal_single_ones(spark):
    side, size, z = 2 * HALF / 2**4, 8, 4
    rows = [("i", y, x, float(10 * y + x)) for y in range(12) for x in range(20)]
    grid = Grid(20, 12, (-1.3 * side, 0.2 * side, 1.7 * side, 2.1 * side), 3857)
    items = spark.createDataFrame([("i", "c", datetime(2024, 1, 1), -180.0, -85.0, 180.0, 85.0, {})], "id string, collection string, datetime timestamp_ntz, west double, south double, east double, north double, properties map<string,string>")
    c = Collection("c", items, spark.createDataFrame(rows, "item_id string, y int, x int, b1 double"), grid, {"b1": BandInfo()})
    whole = load_collection(c)
    tiles = {(r["x"], r["y"]): r["png"] for r in tiles_of(whole, z, size).collect()}
    assert set(tiles) == {(x, y) for x in (6, 7, 8, 9) for y in (5, 6, 7)}
    graph = {"load": {"process_id": "load_collection", "arguments": {"id": "c", "spatial_extent": {"from_parameter": "bounding_box"}}, "result": True}}
    for x, y in ((6, 5), (8, 7)):
        one = render_tile(graph, x, y, z, {"load_collection": bind(load_collection, {"c": c})}, configuration={"tile_size": size})
        assert (pixels_of(save_result(one, "png").data) == pixels_of(tiles[x, y])).all()
    target, x0, y0 = zoom_grid(grid, z, size)
    values = np.full((target.height, target.width), np.nan)
    for r in to_grid(whole, target, "near").df.where("b1 is not null").collect():
        values[r["y"], r["x"]] = r["b1"]
    for (x, y), data in tiles.items():
        cells = values[(y - y0) * size : (y - y0 + 1) * size, (x - x0) * size : (x - x0 + 1) * size]
        assert (pixels_of(data) == pixels_of(png(cells[None]))).all()


def test_tiles_need_one_slice(make):
    cube = make({"2024-01-01": {"b": [[1.0]]}, "2024-01-02": {"b": [[1.0]]}})
    with pytest.raises(ProcessParameterInvalid):
        tiles_of(cube, 3)
    with pytest.raises(ProcessParameterInvalid):
        tiles_of(cube, 3, 5000)
