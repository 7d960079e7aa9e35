"""Spectral and radar indices as column expressions: null for a missing band or a zero denominator, clipped where stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x held to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def normalised_difference(a: Column, b: Column) -> Column:
    return clip(ratio(a - b, a + b), -1.0, 1.0)


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def evi(nir: Column, red: Column, blue: Column, gain: float = 2.5, c1: float = 6.0, c2: float = 7.5, canopy: float = 1.0) -> Column:
    return clip(ratio(gain * (nir - red), nir + c1 * red - c2 * blue + canopy), -1.0, 1.5)


def ndmi(nir: Column, swir1: Column) -> Column:
    return normalised_difference(nir, swir1)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return clip(ratio((1 + soil) * (nir - red), nir + red + soil), -1.0, 1.5)


def msavi2(nir: Column, red: Column) -> Column:
    """Null where the radicand is negative."""
    line = 2 * nir + 1
    inside = line * line - 8 * (nir - red)
    return clip((line - F.sqrt(F.when(inside >= 0, inside))) / 2, -1.0, 1.0)


def nirv(nir: Column, red: Column) -> Column:
    return clip(nir * ndvi(nir, red), -1.0, 1.0)


def gcvi(nir: Column, green: Column) -> Column:
    return clip(ratio(nir, green) - 1, -1.0, 12.0)


def ndbi(swir1: Column, nir: Column) -> Column:
    return normalised_difference(swir1, nir)


def bsi(swir1: Column, red: Column, nir: Column, blue: Column) -> Column:
    return normalised_difference(swir1 + red, nir + blue)


def mndwi(green: Column, swir1: Column) -> Column:
    return normalised_difference(green, swir1)


def ndwi(green: Column, nir: Column) -> Column:
    return normalised_difference(green, nir)


def kndvi(nir: Column, red: Column) -> Column:
    return clip(F.tanh(F.pow(ndvi(nir, red), F.lit(2.0))), 0.0, 1.0)


def ndre(nir: Column, edge: Column) -> Column:
    return normalised_difference(nir, edge)


def cire(last_edge: Column, first_edge: Column) -> Column:
    return ratio(last_edge, first_edge) - 1


def psri(red: Column, blue: Column, edge: Column) -> Column:
    return ratio(red - blue, edge)


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def rvi(vv: Column, vh: Column) -> Column:
    return clip(ratio(4 * vh, vv + vh), 0.0, 1.0)


def cross_ratio(vv: Column, vh: Column) -> Column:
    return clip(ratio(vh, vv), 0.0, 5.0)


def scaled(x: Column, low: float, high: float) -> Column:
    """x on a fixed range as [0, 1]."""
    if low >= high:
        raise ValueError("the range is empty")
    return clip((x - low) / (high - low), 0.0, 1.0)


def weighted_available(terms: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the values that are there; null if none is."""
    total = sum((F.when(x.isNotNull(), x * w).otherwise(0.0) for x, w in terms[1:]), F.when(terms[0][0].isNotNull(), terms[0][0] * terms[0][1]).otherwise(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in terms[1:]), F.when(terms[0][0].isNotNull(), terms[0][1]).otherwise(0.0))
    return F.try_divide(total, weight)


def vigour(nd: Column, ev: Column, moisture: Column) -> Column:
    """.5, .3 and .2 of three indices, the missing ones stood in for by the first."""
    return 0.5 * nd + 0.3 * F.coalesce(ev, nd) + 0.2 * F.coalesce(moisture, 0.7 * nd)


def bin_quality(valid: Column, cloud: Column, area_ha: Column, least_ha: float = 0.15) -> Column:
    """Valid share times clear share times a factor for small parcels."""
    size = clip(0.5 + 0.5 * F.sqrt(area_ha / least_ha) / F.sqrt(F.lit(10.0)), 0.4, 1.0)
    return clip(valid, 0.0, 1.0) * (1 - clip(cloud, 0.0, 1.0)) * size
