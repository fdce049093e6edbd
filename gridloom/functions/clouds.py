"""Masks and corrections of single optical observations, and the order in which they are applied."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits, indexes
from .masks import ratio


def quality_flags(qa: Column, how: str = "MODERATE") -> dict[str, Column]:
    """Fill, dilated cloud, and cloud, shadow and cirrus at full (MODERATE) or at least half (AGGRESSIVE) confidence."""
    sure = lambda bit: bits.field(qa, bit, bit + 1) == 3 if how == "MODERATE" else bits.field(qa, bit, bit + 1) >= 2
    return {"fill": bits.field(qa, 0) == 1, "dilated": bits.field(qa, 1) == 1, "cloud": sure(8), "shadow": sure(10), "cirrus": sure(14)}


def quality_mask(qa: Column, how: str = "MODERATE", dilated: bool = True, cirrus: bool = True) -> Column:
    """Whether the flags leave an observation."""
    f = quality_flags(qa, how)
    bad = f["fill"] | f["cloud"] | f["shadow"]
    bad = bad | f["dilated"] if dilated else bad
    return ~(bad | f["cirrus"] if cirrus else bad)


def by_probability(probability: Column, most: float) -> Column:
    """Cloud where the probability (per cent) exceeds the threshold."""
    return probability > most


def by_score_plus(score: Column, target: float) -> Column:
    """Cloud where the share of clear sky (0 to 1) is below the target."""
    return score < target


def haze_score(b: Mapping[str, Column], aerosol: Column, cirrus: Column) -> Column:
    """1 for clear, 0 for hazy observations at the top of the atmosphere."""
    haze = F.least(50 * F.greatest(b["blue"] - 0.5 * b["red"] - 0.06, F.lit(0.0)), F.lit(1.0))
    mean = (b["blue"] + b["green"] + b["red"]) / 3
    whiteness = sum(F.abs(ratio(b[n] - mean, mean)) for n in ("blue", "green", "red"))
    ndvi, ndsi = indexes.INDEXES["ndvi"](b), indexes.INDEXES["mndwi"](b)
    variability = F.least(1 - F.greatest(F.greatest(F.abs(ndvi), F.abs(ndsi)), whiteness), F.lit(0.1))
    variability = F.when(variability > -0.5, variability)
    thick = F.greatest(100 * F.pow(aerosol - 0.15, F.lit(2.0)), F.lit(0.0))
    return F.when(variability.isNotNull(), F.greatest(1 - (haze + variability + cirrus / 0.04 + thick) / 10, F.lit(0.0)))


def cloud_by_score(b: Mapping[str, Column], threshold: float, aerosol: Column, haze: Column) -> Column:
    """Cloud by score: neither soil nor snow, and bright, or somewhat bright under much aerosol, or all haze."""
    score = indexes.cloud_score(dict(b), aerosol)
    return ~indexes.soil(dict(b)) & ~indexes.snow(dict(b)) & ((score > threshold / 100) | ((score > 0) & (aerosol > 0.2)) | (haze == 0))


def clear_codes(code: Column) -> Column:
    """Cloud from the codes of a rule cascade: 37 and all from 50 on count as clear."""
    return F.when((code == 37) | (code >= 50), 0).otherwise(code) != 0


def cascade(rules: Sequence[tuple[Column, int]], default: int = 0) -> Column:
    """The code of the last rule that holds: later rules overwrite earlier ones."""
    out = F.lit(default)
    for test, code in rules:
        out = F.when(test, code).otherwise(out)
    return out


def pan_sharpened(red: Column, green: Column, blue: Column, pan: Column) -> tuple[Column, Column, Column]:
    """Hue and saturation kept, value replaced by the panchromatic band: the colours scaled by it over their largest."""
    share = pan / F.nullif(F.greatest(red, green, blue), F.lit(0.0))
    return tuple(F.when(share.isNull() & c.isNotNull() & pan.isNotNull(), pan).otherwise(c * share) for c in (red, green, blue))


#: Order of the steps that prepare an observation; a caller gives those it wants.
ORDER = (
    "normalize", "missing_bands", "indexes", "snow", "water", "shadow", "haze", "soil", "cloud", "buffer", "mask_snow", "mask_clouds", "calibrate", "brdf", "pan_sharpen",
    "int16", "dates", "orbit", "tile",
)


def prepared(df: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``df`` after the given steps, in their fixed order whatever the order given; an unknown step raises."""
    unknown = set(steps) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    for name in ORDER:
        if name in steps:
            df = df.transform(steps[name])
    return df
