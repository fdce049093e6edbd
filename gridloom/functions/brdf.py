"""Correction of reflectance for the directions of sun and view: solar position, swath geometry from footprints, and the kernels
of volume (Ross-thick) and geometry (Li-thin). All angles are radians, all functions columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the isotropic, geometric and volume part of each band.
COEFFICIENTS = {
    "blue": (0.0774, 0.0079, 0.0372),
    "green": (0.1306, 0.0178, 0.0580),
    "red": (0.1690, 0.0227, 0.0574),
    "nir": (0.3093, 0.0330, 0.1535),
    "swir1": (0.3430, 0.0453, 0.1154),
    "swir2": (0.2658, 0.0387, 0.0639),
}
# Height of the second satellite family in metres, and terms of the equation of time, of the declination and of the
# sun's zenith that results are normalised to (degrees by latitude).
ALTITUDE = 786_000.0
TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.001480)
ZENITH = (31.0076, -0.1272, 0.01187, 2.40e-05, -9.48e-07, -1.95e-09, 6.15e-11)
METRES = 111_320.0


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def _wave(terms: tuple[float, ...], angle: Column) -> Column:
    """c0 + c1 cos a + s1 sin a + c2 cos 2a + s2 sin 2a + ..."""
    out = F.lit(terms[0])
    for i, c in enumerate(terms[1:]):
        f = F.cos if i % 2 == 0 else F.sin
        out = out + c * f((i // 2 + 1) * angle)
    return out


def sun_angles(year_share: Column, hour: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Azimuth and zenith of the sun, from the share of the year that is over, the hour of day (GMT) and a place in degrees."""
    turn, phi = year_share * (2 * math.pi), F.radians(lat)
    difference = _wave(TIME, turn) * (12 * 60 / math.pi)  # minutes between true and mean solar time
    angle = F.radians((hour + lon / 15 + difference / 60 - 12) * 15)
    delta = _wave(DECLINATION, turn)
    zenith = F.acos(_clamped(F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.cos(angle)))
    sine = _clamped(F.cos(delta) * F.sin(angle) / F.sin(zenith))
    cosine = (-F.cos(phi) * F.sin(delta) + F.sin(phi) * F.cos(delta) * F.cos(angle)) / F.sin(zenith)
    west = F.asin(sine)
    west = F.when(cosine <= 0, math.pi - west).when(sine <= 0, 2 * math.pi + west).otherwise(west)
    azimuth = west + math.pi
    return F.when(azimuth > 2 * math.pi, azimuth - 2 * math.pi).otherwise(azimuth), zenith


def sun_zenith_out(lat: Column) -> Column:
    """Zenith of the sun that a scene is normalised to, by the latitude of its middle."""
    return F.radians(sum((c * F.pow(lat, F.lit(float(k))) for k, c in enumerate(ZENITH[1:], 1)), F.lit(ZENITH[0])))


def corners(ring: Column) -> dict[str, Column]:
    """Corners of a footprint (array of ``x, y``): of its points those nearest to the corners of its bounds, along the axes."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    ends = {"x": (F.array_min(xs), F.array_max(xs)), "y": (F.array_min(ys), F.array_max(ys))}
    out = {}
    for name, i, j in (("lower_left", 0, 0), ("lower_right", 1, 0), ("upper_right", 1, 1), ("upper_left", 0, 1)):
        off = lambda p, i=i, j=j: F.abs(p["x"] - ends["x"][i]) + F.abs(p["y"] - ends["y"][j])
        out[name] = F.array_min(F.transform(ring, lambda p: F.struct(off(p).alias("off"), p["x"].alias("x"), p["y"].alias("y"))))
    return out


def view_azimuth(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Azimuth across the flight line from (x0, y0) to (x1, y1)."""
    slope = (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0))
    return math.pi / 2 - F.atan(F.coalesce(-1 / F.nullif(slope, F.lit(0.0)), F.lit(0.0)))


def distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Metres from a point to a line segment, all in degrees, on a plane at the point's latitude."""
    wide = F.cos(F.radians(y)) * METRES
    ax, ay, bx, by = (x0 - x) * wide, (y0 - y) * METRES, (x1 - x) * wide, (y1 - y) * METRES
    dx, dy = bx - ax, by - ay
    share = F.least(F.greatest(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    share = F.coalesce(share, F.lit(0.0))
    return F.hypot(ax + share * dx, ay + share * dy)


def swath_angles(x: Column, y: Column, at: dict[str, Column], max_zenith: float) -> tuple[Column, Column]:
    """View azimuth and zenith of a point in a footprint with corners ``at``: from ``-max_zenith`` degrees at its left edge to as
    many at its right one."""
    middle = lambda a, b: tuple((at[a][c] + at[b][c]) / 2 for c in "xy")
    low, high = middle("lower_left", "lower_right"), middle("upper_left", "upper_right")
    edge = lambda a, b: distance(x, y, at[a]["x"], at[a]["y"], at[b]["x"], at[b]["y"])
    left, right = edge("upper_left", "lower_left"), edge("upper_right", "lower_right")
    return view_azimuth(*low, *high), F.radians(right * (2 * max_zenith) / F.nullif(right + left, F.lit(0.0)) - max_zenith)


def orbit_angles(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """View azimuth and zenith of a point beside the ground track from (x0, y0) to (x1, y1): negative on its left."""
    side = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
    away = F.atan(distance(x, y, x0, y0, x1, y1) / ALTITUDE)
    return view_azimuth(x0, y0, x1, y1), F.when(side > 0, -away).otherwise(away)


def _phase(sun: Column, view: Column, azimuth: Column) -> Column:
    return _clamped(F.cos(sun) * F.cos(view) + F.sin(sun) * F.sin(view) * F.cos(azimuth))


def ross_thick(sun: Column, view: Column, azimuth: Column) -> Column:
    cosine = _phase(sun, view, azimuth)
    angle = F.acos(cosine)
    return ((math.pi / 2 - angle) * cosine + F.sin(angle)) / (F.cos(sun) + F.cos(view)) - math.pi / 4


def li_thin(sun: Column, view: Column, azimuth: Column, height: float = 2.0, shape: float = 1.0) -> Column:
    """Quirks of the recipes are kept: the overlap is not above 0, and the cosine of the phase is put into a cosine again."""
    sun, view = (F.atan(F.greatest(shape * F.tan(a), F.lit(0.0))) for a in (sun, view))
    a, b = F.tan(sun), F.tan(view)
    apart = F.sqrt(F.greatest(a * a + b * b - 2 * a * b * F.cos(azimuth), F.lit(0.0)))
    secants = 1 / F.cos(sun) + 1 / F.cos(view)
    cosine = _clamped(height * F.sqrt(apart * apart + F.pow(a * b * F.sin(azimuth), F.lit(2.0))) / secants)
    t = F.acos(cosine)
    overlap = F.least((t - F.sin(t) * cosine) * secants / math.pi, F.lit(0.0))
    return overlap - secants + (1 + F.cos(_phase(sun, view, azimuth))) / 2 / F.cos(sun) / F.cos(view)


def corrected(bands: dict[str, Column], sun: tuple[Column, Column], view: tuple[Column, Column], lat: Column, multiplier: float = 4.0) -> dict[str, Column]:
    """Bands as they would be seen from above under the normal sun of the scene's latitude ``lat``; the volume part counts
    ``multiplier`` times. ``sun`` and ``view`` are (azimuth, zenith); masked angles mask the band, other bands stay as they are."""
    azimuth, normal, zero = sun[0] - view[0], sun_zenith_out(lat), F.lit(0.0)
    kernels = [(ross_thick(s, v, a), li_thin(s, v, a)) for s, v, a in ((sun[1], view[1], azimuth), (normal, zero, zero))]
    out = {}
    for name, band in bands.items():
        if name not in COEFFICIENTS:
            out[name] = band
            continue
        iso, geo, vol = COEFFICIENTS[name]
        seen, straight = (iso + multiplier * vol * volume + geo * geometry for volume, geometry in kernels)
        out[name] = band * straight / seen
    return out
