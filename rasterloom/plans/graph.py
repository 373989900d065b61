"""Evaluation of process graphs.

Nodes are evaluated from the result backwards, each once; an operator adds to a DataFrame's
plan.  Only what the driver has to know (items found, labels, sizes) runs as a job of its own while the plan is
built.  Bands that processes need are added to the nodes that load beforehand.  Child graphs become functions that
build column expressions from columns.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import SparkSession

from rasterloom.cube import Cube
from rasterloom.errors import CubeError, ProcessParameterInvalid, ProcessParameterRequired, ProcessUnsupported
from rasterloom.functions import arrays, logic, maths, reducers
from rasterloom.operators import combine, imagery, pixels, resample, spatial, temporal
from rasterloom.plans.params import get_param_item, with_defaults
from rasterloom.plans.requirements import with_requirements
from rasterloom.services.tiles import Assignments, tile_processes
from rasterloom.sinks.save import save_result
from rasterloom.sources import catalog
from rasterloom.sources.catalog import Collection

#: Processes that are bound to the tables of a session.
LOADERS = ("load_collection", "load_stac", "load_url", "tile_assignment", "tiles_summary")
#: Parameters that hold a child graph, and the names of its parameters.
CALLBACKS = {
    ("apply", "process"): ("x", "context"), ("apply_dimension", "process"): ("data", "context"), ("array_apply", "process"): ("x", "index", "label", "context"),
    ("reduce_dimension", "reducer"): ("data", "context"), ("aggregate_temporal", "reducer"): ("data", "context"), ("aggregate_spatial", "reducer"): ("data", "context"),
    ("merge_cubes", "overlap_resolver"): ("x", "y", "context"), ("count", "condition"): ("x",),
}


def _either(of_cube: Callable, of_value: Callable) -> Callable:
    """An operator whose meaning depends on whether it is given a cube."""

    def run(data: Any = None, **args: Any) -> Any:
        return of_cube(data, **args) if isinstance(data, Cube) else of_value(data, **args)

    run.__signature__ = inspect.signature(of_value)
    return run


def _array_apply(data: Any, process: Callable, context: Any = None) -> Any:
    """The child graph sees no label, and the context of the node or else that of the graph around."""
    more = (None,) if context is None else (None, context)
    return arrays.array_apply(data, lambda x, i: process(x, i, *more))


def processes() -> dict[str, Callable]:
    """All operators by name."""
    out: dict[str, Callable] = {**maths.PROCESSES, **logic.PROCESSES, **arrays.PROCESSES, **imagery.PROCESSES, "array_apply": _array_apply, "get_param_item": get_param_item}
    out |= {n: _either(temporal.slice_reducer(n), f) for n, f in reducers.PROCESSES.items()}
    for n in ("lastbandlow", "lastbandhight"):
        out[n] = temporal.slice_reducer(n)
    out["array_element"] = _either(pixels.array_element_of_cube, arrays.array_element)
    out |= {
        f.__name__: f
        for f in (
            temporal.filter_temporal, temporal.reduce_dimension, temporal.aggregate_temporal, temporal.apply_pixel_selection, pixels.apply, pixels.apply_dimension, pixels.image_indexes,
            pixels.ndvi, pixels.ndwi, pixels.add_dimension, pixels.rename_labels, pixels.create_data_cube, pixels.to_image, combine.merge_cubes, combine.mask, resample.resample_spatial,
            resample.resample_cube_spatial, spatial.mask_polygon, spatial.xyz_to_bbox, spatial.xyz_to_tileinfo, save_result,
        )
    }
    out["to_array"] = lambda data: data
    out["aggregate_spatial"] = spatial.zonal_statistics
    return out


class Evaluation:
    """One run of a graph with its parameters."""

    def __init__(self, registry: dict[str, Callable], parameters: dict[str, Any]):
        self.registry, self.parameters = registry, parameters

    def run(self, nodes: dict[str, dict]) -> Any:
        last = [n for n, v in nodes.items() if v.get("result")]
        if len(last) != 1:
            raise ProcessParameterInvalid("one node of a graph is its result")
        return self.node(nodes, last[0], {}, ())

    def node(self, nodes: dict, name: str, done: dict, above: tuple) -> Any:
        if name in done:
            return done[name]
        if name in above:
            raise ProcessParameterInvalid(f"the node {name} needs itself")
        if name not in nodes:
            raise ProcessParameterInvalid(f"there is no node {name}")
        process = nodes[name].get("process_id")
        if process in LOADERS and process not in self.registry:
            raise ProcessUnsupported(f"{process} is not bound to the tables of a session")
        if process not in self.registry:
            raise ProcessUnsupported(f"no process is named {process!r}")
        args = {}
        for key, value in nodes[name].get("arguments", {}).items():
            if isinstance(value, dict) and "process_graph" in value and (process, key) in CALLBACKS:
                args[key] = self.callback(value["process_graph"], CALLBACKS[process, key])
            else:
                args[key] = self.value(value, nodes, done, (*above, name))
        done[name] = self.call(process, args)
        return done[name]

    def value(self, v: Any, nodes: dict, done: dict, above: tuple) -> Any:
        if isinstance(v, dict):
            if set(v) == {"from_node"}:
                return self.node(nodes, v["from_node"], done, above)
            if set(v) == {"from_parameter"}:
                if v["from_parameter"] not in self.parameters:
                    raise ProcessParameterRequired(f"the parameter {v['from_parameter']} is missing")
                return self.parameters[v["from_parameter"]]
            if "process_graph" in v:
                return v
            return {k: self.value(x, nodes, done, above) for k, x in v.items()}
        if isinstance(v, list):
            return [self.value(x, nodes, done, above) for x in v]
        return v

    def callback(self, nodes: dict, names: tuple[str, ...]) -> Callable:
        def run(*given: Any) -> Any:
            return Evaluation(self.registry, self.parameters | dict(zip(names, given, strict=False))).run(nodes)

        return run

    def call(self, process: str, args: dict) -> Any:
        f = self.registry[process]
        known = inspect.signature(f).parameters
        if not any(p.kind is p.VAR_KEYWORD for p in known.values()):
            missing = [n for n, p in known.items() if p.default is p.empty and n not in args and p.kind is not p.VAR_POSITIONAL]
            if missing:
                raise ProcessParameterRequired(f"{process} needs {missing[0]}")
            extra = [n for n in args if n not in known]
            if extra and set(extra) <= {"context", "ignore_nodata"}:
                args = {n: v for n, v in args.items() if n in known}
            elif extra:
                raise ProcessParameterInvalid(f"{process} has no parameter {extra[0]}")
        return f(**args)


def execute(graph: dict, parameters: dict | None = None, loaders: dict[str, Callable] | None = None) -> Any:
    """The result of a graph.

    ``graph`` is a mapping of nodes, or holds one as ``process_graph`` with declared
    ``parameters``.  ``loaders`` bind the processes that read data, such as
    ``load_collection``, to the tables of a session.
    """
    nodes = graph.get("process_graph", graph)
    given = with_defaults(graph.get("parameters") if nodes is not graph else None, parameters)
    return Evaluation(processes() | (loaders or {}), given).run(with_requirements(nodes, given))


def _needs(v: Any) -> set[str]:
    """Names of the nodes that a value is made of."""
    if isinstance(v, dict):
        if "from_node" in v:
            return {v["from_node"]}
        return set() if "process_graph" in v else {n for x in v.values() for n in _needs(x)}
    return {n for x in v for n in _needs(x)} if isinstance(v, list) else set()


def validate(graph: dict, loaders: tuple[str, ...] = LOADERS) -> list[dict]:
    """Errors of a graph that show without data; an empty list if there are none.

    ``loaders`` name the processes that will be bound to tables.
    """
    nodes, found = graph.get("process_graph", graph), []
    registry = processes()
    known = set(registry) | set(loaders)
    needs = {name: _needs(node.get("arguments", {})) & set(nodes) for name, node in nodes.items()}
    while ready := [n for n, of in needs.items() if not of & set(needs)]:
        for n in ready:
            del needs[n]
    if needs:
        found.append({"code": ProcessParameterInvalid.__name__, "message": f"the node {min(needs)} needs itself"})
    for name, node in nodes.items():
        f = registry.get(node.get("process_id"))
        for p in [] if f is None else inspect.signature(f).parameters.values():
            if p.default is p.empty and p.kind is p.POSITIONAL_OR_KEYWORD and p.name not in node.get("arguments", {}):
                found.append({"code": ProcessParameterRequired.__name__, "message": f"{name}: {node['process_id']} needs {p.name}"})

    def note(e: CubeError) -> None:
        found.append({"code": e.code, "message": str(e)})

    if sum(bool(v.get("result")) for v in nodes.values()) != 1:
        note(ProcessParameterInvalid("one node of a graph is its result"))
    for name, node in nodes.items():
        if node.get("process_id") not in known:
            note(ProcessUnsupported(f"{name}: no process is named {node.get('process_id')!r}"))
        for value in node.get("arguments", {}).values():
            for v in value if isinstance(value, list) else [value]:
                if isinstance(v, dict) and "from_node" in v and v["from_node"] not in nodes:
                    note(ProcessParameterInvalid(f"{name}: there is no node {v['from_node']}"))
                if isinstance(v, dict) and "process_graph" in v:
                    found.extend(validate(v["process_graph"], loaders))
    return found


def session_loaders(spark: SparkSession, collections: dict[str, Collection] | None = None, stac: dict[str, Any] | None = None, assignments: Assignments | None = None, service_id: str = "", user_id: str = "") -> dict[str, Callable]:
    """All processes that read or write tables, for ``execute``.

    ``stac`` holds the ``pixels``, ``grid`` and ``known`` bands of ``load_stac``; without ``assignments``
    the processes of tiles are left out.
    """

    def load_stac(url: str, **args: Any) -> Cube:
        if stac is None:
            raise ProcessUnsupported("load_stac is not bound to a table of pixels")
        return catalog.load_stac(spark, url, **stac, **{k: v for k, v in args.items() if k != "named_parameters"})

    out = {"load_collection": bind(catalog.load_collection, collections or {}), "load_stac": load_stac, "load_url": partial(catalog.load_url, spark)}
    return out | (tile_processes(assignments, service_id, user_id) if assignments else {})


def bind(loader: Callable, tables: dict[str, Any]) -> Callable:
    """``load_collection`` over named collections."""

    def load(id: str, **args: Any) -> Any:  # noqa: A002
        if id not in tables:
            raise ProcessParameterInvalid(f"no collection is named {id!r}")
        return partial(loader, tables[id])(**{k: v for k, v in args.items() if k != "named_parameters"})

    return load
