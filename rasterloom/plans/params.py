"""Parameters of graphs."""

from __future__ import annotations

import re
from typing import Any

from rasterloom.errors import ProcessParameterInvalid, ProcessParameterRequired

_STEP = re.compile(r"\.(\w+)|\[(?:'([^']*)'|\"([^\"]*)\"|(-?\d+)|(\*))\]")


def get_param_item(parameter: Any, path: str) -> Any:
    """The first match of a path of names, places and ``*``, such as ``$.a[0]['b']``.

    An empty mapping gives none, and so does a place in an empty list.
    """
    if not isinstance(parameter, (dict, list)):
        raise ProcessParameterInvalid("the parameter is neither a mapping nor a list")
    if parameter == {}:
        return None
    text = path if path.startswith("$") else "$." + path
    at, values = 1, [parameter]
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ProcessParameterInvalid(f"{path!r} is no path")
        name = next((m[i] for i in (1, 2, 3) if m[i] is not None), None)
        found = []
        for v in values:
            if name is not None and isinstance(v, dict) and name in v:
                found.append(v[name])
            elif m[4] is not None and isinstance(v, list):
                if not v:
                    return None
                if -len(v) <= int(m[4]) < len(v):
                    found.append(v[int(m[4])])
            elif m[5] and isinstance(v, (list, dict)):
                found += v if isinstance(v, list) else list(v.values())
        if not found:
            raise ProcessParameterRequired(f"nothing is at {path!r}")
        values, at = found, m.end()
    return values[0]


def with_defaults(declared: list[dict] | None, given: dict | None) -> dict:
    """Given values and the defaults of the others; a required one must be given."""
    out = dict(given or {})
    for p in declared or []:
        if p["name"] not in out:
            if "default" in p or p.get("optional"):
                out[p["name"]] = p.get("default")
            else:
                raise ProcessParameterRequired(f"the parameter {p['name']} is missing")
    return out
