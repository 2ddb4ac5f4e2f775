"""Map projections as column expressions from published series.

Geographic WGS84 / ETRS89 (EPSG:4326, 4258), UTM north zones (EPSG:326zz, 258zz), Web Mercator
(EPSG:3857) and LAEA Europe (EPSG:3035). WGS84 and ETRS89 are treated as equal. UTM uses
Krueger's series to the fourth order in n (well below a millimetre inside a zone and its
neighbours).

A projection is a list of steps from one struct of named values to the next. Each step is evaluated once per vertex; one
plain expression would repeat what it reads several times, and chains of projections would multiply that.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow.errors import DataError

_A_WGS, _F_WGS = 6378137.0, 1 / 298.257223563
_A_GRS, _F_GRS = 6378137.0, 1 / 298.257222101
_K0 = 0.9996


def _series(flattening: float):
    n = flattening / (2 - flattening)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
             13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
             61 * n**3 / 240 - 103 * n**4 / 140,
             49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
             7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
             56 * n**3 / 15 - 136 * n**4 / 35,
             4279 * n**4 / 630]
    rectifying = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    return n, alpha, beta, delta, rectifying


def _total(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _utm_forward(zone: int, flattening: float) -> list:
    n, alpha, _, _, rectifying = _series(flattening)
    e = 2 * math.sqrt(n) / (1 + n)
    scale = _K0 * _A_WGS * rectifying

    def conformal(p):
        sine = F.sin(F.radians(p["y"]))
        return {"t": F.sinh(F.atanh(sine) - e * F.atanh(e * sine)), "lam": F.radians(p["x"]) - math.radians(zone * 6 - 183)}

    def sphere(p):
        t, lam = p["t"], p["lam"]
        return {"xi": F.atan2(t, F.cos(lam)), "eta": F.atanh(F.sin(lam) / F.sqrt(1 + t * t))}

    def plane(p):
        xi, eta = p["xi"], p["eta"]
        return {"x": 500000.0 + scale * (eta + _total([a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)])),
                "y": scale * (xi + _total([a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)]))}
    return [conformal, sphere, plane]


def _utm_inverse(zone: int, flattening: float) -> list:
    _, _, beta, delta, rectifying = _series(flattening)
    scale = _K0 * _A_WGS * rectifying

    def scaled(p):
        return {"xi": p["y"] / scale, "eta": (p["x"] - 500000.0) / scale}

    def sphere(p):
        xi, eta = p["xi"], p["eta"]
        return {"xi": xi - _total([b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1)]),
                "eta": eta - _total([b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1)])}

    def conformal(p):
        return {"chi": F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])), "lam": F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))}

    def geographic(p):
        chi = p["chi"]
        phi = chi + _total([d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)])
        return {"x": F.degrees(p["lam"]) + (zone * 6 - 183), "y": F.degrees(phi)}
    return [scaled, sphere, conformal, geographic]


def _mercator_forward() -> list:
    return [lambda p: {"x": _A_WGS * F.radians(p["x"]), "y": _A_WGS * F.log(F.tan(math.pi / 4 + F.radians(p["y"]) / 2))}]


def _mercator_inverse() -> list:
    return [lambda p: {"x": F.degrees(p["x"] / _A_WGS), "y": F.degrees(2 * F.atan(F.exp(p["y"] / _A_WGS)) - math.pi / 2)}]


# LAEA Europe: centre 10 E, 52 N, false origin (4321000, 3210000).
_E2 = 2 * _F_GRS - _F_GRS**2
_E = math.sqrt(_E2)


def _q_number(s: float) -> float:
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


_PHI0, _LAM0 = math.radians(52.0), math.radians(10.0)
_QP = _q_number(1.0)
_BETA0 = math.asin(_q_number(math.sin(_PHI0)) / _QP)
_RQ = _A_GRS * math.sqrt(_QP / 2)
_D = _A_GRS * math.cos(_PHI0) / (math.sqrt(1 - _E2 * math.sin(_PHI0) ** 2) * _RQ * math.cos(_BETA0))


def _laea_forward() -> list:
    def sine(p):
        return {"s": F.sin(F.radians(p["y"])), "lam": F.radians(p["x"]) - _LAM0}

    def authalic(p):
        s = p["s"]
        q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
        return {"beta": F.asin(q / _QP), "lam": p["lam"]}

    def parts(p):
        return {"sb": F.sin(p["beta"]), "cb": F.cos(p["beta"]), "sl": F.sin(p["lam"]), "cl": F.cos(p["lam"])}

    def radius(p):
        b = _RQ * F.sqrt(2 / (1 + math.sin(_BETA0) * p["sb"] + math.cos(_BETA0) * p["cb"] * p["cl"]))
        return {"b": b, **{n: p[n] for n in ("sb", "cb", "sl", "cl")}}

    def plane(p):
        x = p["b"] * _D * p["cb"] * p["sl"]
        y = p["b"] / _D * (math.cos(_BETA0) * p["sb"] - math.sin(_BETA0) * p["cb"] * p["cl"])
        return {"x": 4321000.0 + x, "y": 3210000.0 + y}
    return [sine, authalic, parts, radius, plane]


def _laea_inverse() -> list:
    def centred(p):
        return {"dx": (p["x"] - 4321000.0) / _D, "dy": (p["y"] - 3210000.0) * _D}

    def polar(p):
        return {"rho": F.sqrt(p["dx"] * p["dx"] + p["dy"] * p["dy"]), "dx": p["dx"], "dy": p["dy"]}

    def turned(p):
        return {"angle": 2 * F.asin(p["rho"] / (2 * _RQ)), **{n: p[n] for n in ("rho", "dx", "dy")}}

    def sphere(p):
        rho, dx, dy, angle = p["rho"], p["dx"], p["dy"], p["angle"]
        sine = F.when(rho == 0, F.lit(math.sin(_BETA0))).otherwise(
            F.cos(angle) * math.sin(_BETA0) + F.try_divide(dy * F.sin(angle) * math.cos(_BETA0), rho))
        lam = F.when(rho == 0, F.lit(0.0)).otherwise(F.atan2(
            dx * F.sin(angle), rho * math.cos(_BETA0) * F.cos(angle) - dy * math.sin(_BETA0) * F.sin(angle)))
        return {"sine": sine, "lam": lam}

    def authalic(p):
        return {"beta": F.asin(p["sine"]), "sine": p["sine"], "lam": p["lam"]}

    def series(p):
        beta, e2, e4, e6 = p["beta"], _E2, _E2**2, _E2**3
        phi = (beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
               + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
               + (761 * e6 / 45360) * F.sin(6 * beta))
        return {"phi": phi, "sine": p["sine"], "lam": p["lam"]}

    def widths(p):
        s = F.sin(p["phi"])
        return {"s": s, "w": 1 - _E2 * s * s, **{n: p[n] for n in ("phi", "sine", "lam")}}

    def corrected(p):
        # one Newton step takes the series' last millimetre
        s, w, q = p["s"], p["w"], _QP * p["sine"]
        phi = p["phi"] + w * w / (2 * F.cos(p["phi"])) * (
            q / (1 - _E2) - s / w + F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
        return {"x": F.degrees(p["lam"] + _LAM0), "y": F.degrees(phi)}
    return [centred, polar, turned, sphere, authalic, series, widths, corrected]


def _pair(epsg: int) -> tuple[list, list]:
    """Steps from geographic coordinates to the code's and back."""
    if epsg in (4326, 4258):
        return [], []
    if epsg == 3857:
        return _mercator_forward(), _mercator_inverse()
    if epsg == 3035:
        return _laea_forward(), _laea_inverse()
    for base, flattening in ((32600, _F_WGS), (25800, _F_GRS)):
        zone = epsg - base
        if 1 <= zone <= 60:
            return _utm_forward(zone, flattening), _utm_inverse(zone, flattening)
    raise DataError(f"EPSG:{epsg} is not supported")


def _stepped(line: Column, source: int, target: int) -> Column:
    """A vertex array after all steps from one code to the other, over geographic coordinates."""
    def each(step):
        return lambda p: F.struct(*[v.alias(n) for n, v in step(p).items()])

    for step in _pair(source)[1] + _pair(target)[0]:
        line = F.transform(line, each(step))
    return line


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates from one EPSG code to another, over geographic coordinates."""
    if source == target:
        return x, y
    found = F.element_at(_stepped(F.array(F.struct(x.alias("x"), y.alias("y"))), source, target), 1)
    return found["x"], found["y"]


def transform_parts(parts: Column, source: int, target: int) -> Column:
    """The same for every vertex of a ``parts`` or ``rings`` value."""
    if source == target:
        return parts
    return F.transform(parts, lambda line: _stepped(line, source, target))


def is_metric(epsg: int) -> bool:
    """Projected codes measure in metres; geographic ones do not."""
    _pair(epsg)
    return epsg not in (4326, 4258)
