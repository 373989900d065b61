"""What processes need from the nodes that load their data.

A process may name bands that the collections which feed it have to bring.  Before a graph runs, a pass over it
gathers for each loading node the needs of all nodes downstream of it and adds the bands to that node's arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from rasterloom.operators.imagery import COEFFICIENTS, POLARISATIONS

LOADING = ("load_collection", "load_stac")

#: Bands that a process needs: of its own arguments and those of the node that loads.
Needs = Callable[[dict[str, Any], dict[str, Any]], set[str]]


def _backscatter(own: dict[str, Any], loading: dict[str, Any]) -> set[str]:
    coefficient = own.get("coefficient", "gamma0-terrain")
    pols = [b for b in loading.get("bands") or [] if isinstance(b, str) and b.lower() in POLARISATIONS]
    out = {f"{p}_{COEFFICIENTS[coefficient]}" for p in pols} if coefficient in COEFFICIENTS else set()
    if own.get("noise_removal", True):
        out |= {f"{p}_noise_lut" for p in pols}
    if own.get("ellipsoid_incidence_angle") and pols:
        out.add(f"{pols[0]}_ellipsoid_incidence_angle")
    return out


NEEDS: dict[str, Needs] = {"sar_backscatter": _backscatter}


def _sources(value: Any) -> set[str]:
    """Nodes that an argument takes data from, those named within child graphs' own scope left out."""
    if isinstance(value, dict):
        if "from_node" in value:
            return {value["from_node"]}
        return set() if "process_graph" in value else {n for v in value.values() for n in _sources(v)}
    return {n for v in value for n in _sources(v)} if isinstance(value, list) else set()


def _known(value: Any, parameters: dict[str, Any]) -> Any:
    """An argument with references to given parameters replaced."""
    if isinstance(value, dict) and set(value) == {"from_parameter"}:
        return parameters.get(value["from_parameter"], value)
    return [_known(v, parameters) for v in value] if isinstance(value, list) else value


def requirements(nodes: dict[str, dict], parameters: dict[str, Any] | None = None, needs: dict[str, Needs] | None = None) -> dict[str, set[str]]:
    """The bands that each loading node has to add, by its name; nodes without any are left out."""
    given, needs = parameters or {}, NEEDS if needs is None else needs
    feeds: dict[str, set[str]] = {}
    for name, node in nodes.items():
        for source in _sources(list(node.get("arguments", {}).values())):
            feeds.setdefault(source, set()).add(name)
    out = {}
    for name, node in nodes.items():
        if node.get("process_id") not in LOADING:
            continue
        own = {k: _known(v, given) for k, v in node.get("arguments", {}).items()}
        seen, ahead, found = set(), [name], set()
        while ahead:
            for n in feeds.get(ahead.pop(), set()) - seen:
                seen.add(n)
                ahead.append(n)
                if nodes[n].get("process_id") in needs:
                    found |= needs[nodes[n]["process_id"]]({k: _known(v, given) for k, v in nodes[n].get("arguments", {}).items()}, own)
        bands = own.get("bands")
        if found and (bands is None or (isinstance(bands, list) and all(isinstance(b, str) for b in bands))):
            more = found - set(bands or [])
            if more:
                out[name] = more
    return out


def with_requirements(nodes: dict[str, dict], parameters: dict[str, Any] | None = None, needs: dict[str, Needs] | None = None) -> dict[str, dict]:
    """The graph with the bands that are needed; the same object if there are none."""
    found = requirements(nodes, parameters, needs)
    if not found:
        return nodes
    given, out = parameters or {}, dict(nodes)
    for name, more in found.items():
        arguments = dict(nodes[name].get("arguments", {}))
        arguments["bands"] = [*(_known(arguments.get("bands"), given) or []), *sorted(more)]
        out[name] = {**nodes[name], "arguments": arguments}
    return out
