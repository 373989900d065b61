"""Projections: geographic coordinates (4326), web maps (3857), the zones of UTM (32601 to 32660, 32701 to 32760).

One set of formulas serves columns, numpy arrays and plain numbers; what differs is where the elementary
functions come from.  Transverse Mercator is Krueger's series to the sixth power of the third flattening,
exact to nanometres within a zone and its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.errors import FeatureUnsupported

#: Radius of the sphere of web maps, in metres, and the latitude where its square ends.
SPHERE, EDGE = 6378137.0, 85.0511287798066
#: Points along each side of a box whose image is sought.
SIDE_POINTS = 21



def _bound(f: Callable, *values: Column) -> Column:
    """``f`` of values that are each computed once, however often it names them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])), lambda s: f(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


_NAMES = ("sin", "cos", "tan", "sinh", "cosh", "exp", "sqrt", "radians", "degrees")
COLUMNS = SimpleNamespace(**{n: getattr(F, n) for n in _NAMES}, ln=F.ln, asin=F.asin, atan=F.atan, atan2=F.atan2, asinh=F.asinh, atanh=F.atanh, bound=_bound)
ARRAYS = SimpleNamespace(**{n: getattr(np, n) for n in _NAMES}, ln=np.log, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, asinh=np.arcsinh, atanh=np.arctanh, bound=lambda f, *values: f(*values))

# The WGS 84 ellipsoid, UTM's scale and false coordinates, and the coefficients of three
# series, of which row j has those of n^j, n^(j+1), ... up to n^6.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)
#: From the conformal latitude to the geographic one.
LATITUDE = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175),
    (4174 / 315, -144838 / 6237),
    (601676 / 22275,),
)

_N = FLATTENING / (2 - FLATTENING)
_E = (FLATTENING * (2 - FLATTENING)) ** 0.5
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def series(rows: tuple[tuple[float, ...], ...]) -> list[float]:
    """Coefficients of a series for the ellipsoid."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


def zone(crs: int) -> tuple[float, float] | None:
    """Central meridian and false northing of a zone of UTM, or None."""
    if 32601 <= crs <= 32660 or 32701 <= crs <= 32760:
        return (crs % 100) * 6.0 - 183.0, FALSE_NORTH if crs > 32700 else 0.0
    return None


def known(crs: int) -> bool:
    return crs in (4326, 3857) or zone(crs) is not None


def geographic(crs: int) -> bool:
    return crs == 4326


def _sum(start: Any, rows: tuple, a: Callable, b: Callable, xi: Any, eta: Any, sign: int = 1) -> Any:
    for j, c in enumerate(series(rows), 1):
        start = start + a(xi * (2 * j)) * b(eta * (2 * j)) * (sign * c)
    return start


def _to_zone(lon: Any, lat: Any, crs: int, m: SimpleNamespace) -> tuple[Any, Any]:
    meridian, north = zone(crs)

    def angles(lam: Any, s: Any, end: Callable) -> Any:
        t = m.sinh(m.atanh(s) - m.atanh(s * _E) * _E)
        return m.bound(lambda t, c: m.bound(end, m.atan2(t, c), m.asinh(m.sin(lam) / m.sqrt(t * t + c * c))), t, m.cos(lam))

    ends = (lambda xi, eta: _sum(eta, FORWARD, m.cos, m.sinh, xi, eta)), (lambda xi, eta: _sum(xi, FORWARD, m.sin, m.cosh, xi, eta))
    x, y = (m.bound(lambda lam, s, end=end: angles(lam, s, end), m.radians(lon - meridian), m.sin(m.radians(lat))) for end in ends)
    return x * (SCALE * _RADIUS) + FALSE_EAST, y * (SCALE * _RADIUS) + north


def _from_zone(x: Any, y: Any, crs: int, m: SimpleNamespace) -> tuple[Any, Any]:
    meridian, north = zone(crs)

    def conformal(end: Callable) -> Any:
        sums = lambda xi, eta: m.bound(end, _sum(xi, INVERSE, m.sin, m.cosh, xi, eta, -1), _sum(eta, INVERSE, m.cos, m.sinh, xi, eta, -1))
        return m.bound(sums, (y - north) / (SCALE * _RADIUS), (x - FALSE_EAST) / (SCALE * _RADIUS))

    def latitude(chi: Any) -> Any:
        lat = chi
        for j, d in enumerate(series(LATITUDE), 1):
            lat = lat + m.sin(chi * (2 * j)) * d
        return lat

    lon = conformal(lambda p, q: m.atan2(m.sinh(q), m.cos(p)))
    lat = conformal(lambda p, q: m.bound(latitude, m.asin(m.sin(p) / m.cosh(q))))
    return m.degrees(lon) + meridian, m.degrees(lat)


def transform(x: Any, y: Any, source: int, target: int, m: SimpleNamespace) -> tuple[Any, Any]:
    """Coordinates of one projection in another; ``m`` is COLUMNS or ARRAYS."""
    if source == target:
        return x, y
    for crs in (source, target):
        if not known(crs):
            raise FeatureUnsupported(f"no transformation from {source} to {target}")
    if source == 3857:
        x, y = m.degrees(x / SPHERE), m.degrees(m.atan(m.exp(y / SPHERE)) * 2 - np.pi / 2)
    elif source != 4326:
        x, y = _from_zone(x, y, source, m)
    if target == 3857:
        return m.radians(x) * SPHERE, m.ln(m.tan(m.radians(y) / 2 + np.pi / 4)) * SPHERE
    return (x, y) if target == 4326 else _to_zone(x, y, target, m)


def edges(box: tuple[float, float, float, float], source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Points along the sides of a box, in another projection."""
    west, south, east, north = box
    if source == 4326 and target == 3857:
        south, north = (max(-EDGE, min(EDGE, v)) for v in (south, north))
    along = np.linspace(0, 1, SIDE_POINTS)
    lon, lat = west + (east - west) * along, south + (north - south) * along
    x = np.concatenate([lon, lon, np.full(SIDE_POINTS, west), np.full(SIDE_POINTS, east)])
    y = np.concatenate([np.full(SIDE_POINTS, south), np.full(SIDE_POINTS, north), lat, lat])
    return transform(x, y, source, target, ARRAYS)


def box_in(box: tuple[float, float, float, float], source: int, target: int) -> tuple[float, float, float, float]:
    """The box of a box's image, by points along its sides, as they don't stay straight."""
    if source == target:
        return box
    x, y = edges(box, source, target)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())
