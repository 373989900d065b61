"""Web map tiles of a graph: its loading nodes are cut to the tile before anything is read."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from rasterloom.cube import reproject_bounds
from rasterloom.errors import ProcessParameterInvalid, ProcessParameterRequired, TileOutsideBounds
from rasterloom.operators.spatial import xyz_to_bbox
from rasterloom.plans.graph import execute

#: Nodes that read the images of an extent.
IMAGE_LOADERS = ("load_collection", "load_stac")
TILE_SIZE = 256
MAX_ZOOM = 24


def _with_loaders(graph: dict, change: Callable[[str, dict], dict]) -> dict:
    """A graph whose loading nodes have other arguments; the given one is left as it is."""
    nodes = graph.get("process_graph", graph)
    new = {n: v | {"arguments": change(n, v.get("arguments") or {})} if v.get("process_id") in IMAGE_LOADERS else v for n, v in nodes.items()}
    return new if nodes is graph else graph | {"process_graph": new}


def scoped(graph: dict) -> dict:
    """A graph whose loading nodes take their extent from the parameter ``bounding_box``."""
    return _with_loaders(graph, lambda _, args: args | {"spatial_extent": {"from_parameter": "bounding_box"}})


def tile_parameters(x: int, y: int, z: int) -> dict:
    """What a graph may ask about the tile that it is run for."""
    box = xyz_to_bbox({"x": x, "y": y, "z": z})
    edges = {f"spatial_extent_{side}": box[side] for side in ("west", "south", "east", "north", "crs")}
    return edges | {"bounding_box": box, "target_crs": box["crs"], "tile_x": x, "tile_y": y, "tile_z": z}


def check_tile(x: int, y: int, z: int, extent: list | None = None, minzoom: int | None = None, maxzoom: int | None = None) -> None:
    """A tile lies within the zoom levels and shares an area with the extent (west, south, east, north in degrees)."""
    low, high = minzoom or 0, maxzoom or MAX_ZOOM
    if not low <= z <= high:
        raise ProcessParameterInvalid(f"zoom level {z} is not between {low} and {high}")
    if not (0 <= x < 2**z and 0 <= y < 2**z):
        raise TileOutsideBounds(f"zoom level {z} has no tile {x}, {y}")
    if extent:
        box = xyz_to_bbox({"x": x, "y": y, "z": z})
        west, south, east, north = reproject_bounds((box["west"], box["south"], box["east"], box["north"]), 3857, 4326)
        if west >= extent[2] or east <= extent[0] or south >= extent[3] or north <= extent[1]:
            raise TileOutsideBounds(f"the tile {x}, {y} of zoom level {z} does not meet the service's extent")


def render_tile(graph: dict, x: int, y: int, z: int, loaders: dict[str, Callable], parameters: dict[str, Any] | None = None, configuration: dict | None = None) -> Any:
    """The result of a graph for one tile of the web map grid.

    Loading nodes must have a spatial extent; they give ``tile_size`` cells each way, in the map's projection
    unless they name another.  ``configuration`` may hold ``tile_size``, ``minzoom``, ``maxzoom``
    and ``extent``.  Given parameters go before those of the tile, and those before the graph's defaults.
    """
    how = configuration or {}
    check_tile(x, y, z, how.get("extent"), how.get("minzoom"), how.get("maxzoom"))
    size = int(how.get("tile_size") or TILE_SIZE)

    def sized(name: str, args: dict) -> dict:
        if not args.get("spatial_extent"):
            raise ProcessParameterRequired(f"{name} has no spatial extent")
        return {"target_crs": {"from_parameter": "target_crs"}} | args | {"width": size, "height": size}

    return execute(_with_loaders(graph, sized), tile_parameters(x, y, z) | (parameters or {}), loaders)
