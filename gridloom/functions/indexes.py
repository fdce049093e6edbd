"""Spectral indexes, band combinations, the tasseled cap and quality scores over reflectance columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masks import ratio

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
#: Tasseled-cap rows (brightness, greenness, wetness, fourth, fifth, sixth) over BANDS: fixed values.
TASSELED_CAP = {
    "brightness": (0.3037, 0.2793, 0.4743, 0.5585, 0.5082, 0.1863),
    "greenness": (-0.2848, -0.2435, -0.5436, 0.7243, 0.0840, -0.1800),
    "wetness": (0.1509, 0.1973, 0.3279, 0.3406, -0.7112, -0.4572),
    "fourth": (-0.8242, 0.0849, 0.4392, -0.0580, 0.2012, -0.2768),
    "fifth": (-0.3280, 0.0549, 0.1075, 0.1855, -0.4357, 0.8085),
    "sixth": (0.1084, -0.9022, 0.4120, 0.0573, -0.0251, 0.0238),
}
#: Endmembers (rows) over BANDS for the normalised degradation fraction index: fixed values.
ENDMEMBERS = {
    "gv": (0.05, 0.09, 0.04, 0.61, 0.3, 0.1),
    "shade": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "npv": (0.14, 0.17, 0.22, 0.3, 0.55, 0.3),
    "soil": (0.2, 0.3, 0.34, 0.58, 0.6, 0.58),
    "cloud": (0.9, 0.96, 0.8, 0.78, 0.72, 0.65),
}


def normalized(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def scaled(x: Column, low: float, high: float) -> Column:
    """``x`` from [low, high] to [0, 1], clamped; low may exceed high."""
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def _ibi(b: dict[str, Column]) -> Column:
    ndbi, rest = INDEXES["ndbi"](b), (INDEXES["savi"](b) + INDEXES["mndwi"](b)) / 2
    return ratio(ndbi - rest, ndbi + rest)


def _kndvi(b: dict[str, Column]) -> Column:
    k = F.exp(-F.pow(b["nir"] - b["red"], F.lit(2.0)) / (2 * 0.2 * 0.2))
    return (1 - k) / (1 + k)


#: Index formulas over reflectance columns in [0, 1] by band name.
INDEXES = {
    "ndvi": lambda b: normalized(b["nir"], b["red"]),
    "ndmi": lambda b: normalized(b["nir"], b["swir1"]),
    "ndwi": lambda b: normalized(b["green"], b["nir"]),
    "mndwi": lambda b: normalized(b["green"], b["swir1"]),
    "evi": lambda b: ratio(2.5 * (b["nir"] - b["red"]), b["nir"] + 6 * b["red"] - 7.5 * b["blue"] + 1),
    "evi2": lambda b: ratio(2.5 * (b["nir"] - b["red"]), b["nir"] + 2.4 * b["red"] + 1),
    "savi": lambda b: ratio(1.5 * (b["nir"] - b["red"]), b["nir"] + b["red"] + 0.5),
    "nbr": lambda b: normalized(b["nir"], b["swir2"]),
    "mvi": lambda b: F.least(F.greatest(ratio(0.1 * (b["nir"] - b["green"]), F.abs(b["swir1"] - b["green"])), F.lit(-1.0)), F.lit(1.0)),
    "ui": lambda b: normalized(b["swir2"], b["nir"]),
    "ndbi": lambda b: normalized(b["swir1"], b["nir"]),
    "ibi": _ibi,
    "nbi": lambda b: ratio(b["red"] * b["swir1"], b["nir"]),
    "ebbi": lambda b: ratio(b["swir1"] - b["nir"], 10 * F.sqrt(b["swir1"] + b["thermal"])),
    "bui": lambda b: normalized(b["red"], b["swir1"]) + normalized(b["swir2"], b["swir1"]),
    "kndvi": _kndvi,
}


def tasseled_cap(b: dict[str, Column]) -> dict[str, Column]:
    return {name: sum(c * b[band] for c, band in zip(row, BANDS, strict=True)) for name, row in TASSELED_CAP.items()}


def pairwise(names: list[str], operations: tuple[str, ...] = ("ratio", "normalized_difference", "difference", "distance", "angle")) -> dict[str, Column]:
    """Combinations of each two bands, in order, as ``<first>_<second>_<operation>``.

    ``distance`` is the arc tangent over pi and ``angle`` the hypotenuse, the names that existing models expect.
    """
    makes = {
        "ratio": ratio,
        "normalized_difference": normalized,
        "difference": lambda a, b: a - b,
        "distance": lambda a, b: F.atan2(a, b) / F.pi(),
        "angle": F.hypot,
    }
    return {f"{a}_{b}_{op}": makes[op](F.col(a), F.col(b)) for a, b in combinations(names, 2) for op in operations}


def shadow_score(b: dict[str, Column]) -> Column:
    return F.sqrt((b["green"] * b["green"] + b["red"] * b["red"] + b["nir"] * b["nir"]) / 3)


def snow(b: dict[str, Column]) -> Column:
    ndsi = INDEXES["mndwi"](b)
    parts = (scaled(ndsi, 0.2, 0.42), scaled(b["nir"], 0.15, 0.35), scaled(ratio(b["blue"], b["red"]), 0.18, 0.22), scaled(ndsi, 0.85, 0.95))
    return parts[0] * parts[1] * parts[2] * parts[3] > 0.12


def water(b: dict[str, Column]) -> Column:
    return ~snow(b) & ((ratio(b["blue"], b["swir1"]) > 4) | (INDEXES["ndwi"](b) > 0.15))


def soil(b: dict[str, Column]) -> Column:
    return (ratio(b["blue"], b["swir1"]) < 0.55) | (ratio(b["nir"], b["swir1"]) < 0.90)


def cloud_score(b: dict[str, Column], aerosol: Column | float = 0.0, cirrus: Column | float = 0.0) -> Column:
    """Least of brightness in the blue (or aerosol, cirrus), the visible, the infrared, and of not being snow."""
    a, c = (x if isinstance(x, Column) else F.lit(x) for x in (aerosol, cirrus))
    bright = F.greatest(scaled(b["blue"], 0.1, 0.5), scaled(a, 0.1, 0.5), scaled(c, 0.1, 0.3))
    seen, infrared = b["red"] + b["green"] + b["blue"], b["nir"] + b["swir1"] + b["swir2"]
    return F.least(bright, scaled(seen, 0.2, 0.8), scaled(infrared, 0.3, 0.8), scaled(INDEXES["mndwi"](b), 0.8, 0.6))
