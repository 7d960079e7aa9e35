"""Weather, geography, units and score columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilth.functions.spectral import clip

EARTH_KM = 6371.0


def gdd(tmax: Column, tmin: Column, base: float = 10.0, low: float = 10.0, high: float = 35.0) -> Column:
    """Growing degree days with both temperatures held to the caps."""
    return F.greatest((clip(tmax, low, high) + clip(tmin, low, high)) / 2 - base, F.lit(0.0))


def gdd_mean_capped(tmax: Column, tmin: Column, base: float = 10.0, high: float = 35.0) -> Column:
    """The other usual form: only the mean is capped."""
    return F.greatest(F.least((tmax + tmin) / 2, F.lit(high)) - base, F.lit(0.0))


def radiation(latitude: Column, day_of_year: Column) -> Column:
    """Extraterrestrial radiation, MJ per square metre and day."""
    phi = F.radians(latitude)
    turn = 2 * math.pi * day_of_year / 365
    near = 1 + 0.033 * F.cos(turn)
    tilt = 0.409 * F.sin(turn - 1.39)
    sunset = F.acos(clip(-F.tan(phi) * F.tan(tilt), -1.0, 1.0))
    return 24 * 60 / math.pi * 0.0820 * near * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))


def hargreaves(tmax: Column, tmin: Column, latitude: Column, day_of_year: Column) -> Column:
    """Reference evapotranspiration in mm a day."""
    spread = F.sqrt(F.greatest(tmax - tmin, F.lit(0.0)))
    return F.greatest(0.0023 * 0.408 * radiation(latitude, day_of_year) * ((tmax + tmin) / 2 + 17.8) * spread, F.lit(0.0))


def saturation(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def vapour_deficit(tmean: Column, humidity: Column) -> Column:
    """kPa, from the relative humidity in per cent."""
    return F.greatest(saturation(tmean) * (1 - humidity / 100), F.lit(0.0))


def haversine(lat_1: Column, lon_1: Column, lat_2: Column, lon_2: Column) -> Column:
    """Kilometres along the sphere."""
    a = F.pow(F.sin(F.radians(lat_2 - lat_1) / 2), F.lit(2.0)) + F.cos(F.radians(lat_1)) * F.cos(F.radians(lat_2)) * F.pow(F.sin(F.radians(lon_2 - lon_1) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ring_area_ha(ring: Column) -> Column:
    """Hectares of a closed ring array<struct<lon,lat>>, by the shoelace on a local plane."""
    n = F.size(ring)
    lat0 = F.radians(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / n)
    pairs = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    degree = math.pi / 180 * EARTH_KM * 1000
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)) / 2 * degree * degree * F.cos(lat0) / 10000


def cell(lat: Column, lon: Column, step: float = 0.25) -> Column:
    """The name of the grid cell that holds a point."""
    return F.concat_ws("_", F.floor(lat / step).cast("string"), F.floor(lon / step).cast("string"))


def tonnes_per_hectare(value: Column, unit: Column) -> Column:
    """From quintals or kilograms an acre, or quintals a hectare; other units give null."""
    acre = 0.40468564224
    return F.when(unit == "t/ha", value).when(unit == "q/ha", value / 10).when(unit == "q/acre", value / 10 / acre).when(unit == "kg/acre", value / 1000 / acre)


def score_of(index: Column) -> Column:
    """The 300 to 900 scale of a 0 to 100 index."""
    return F.bround(300 + 600 * index / 100, 0).cast("int")


def risk_band(index: Column) -> Column:
    return F.when(index >= 70, "LOW").when(index >= 50, "MEDIUM").when(index >= 30, "HIGH").when(index.isNotNull(), "VERY_HIGH")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share, held to [0, 1]; null without trials."""
    p = F.try_divide(hits, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / scale
    return clip(centre - half, 0.0, 1.0), clip(centre + half, 0.0, 1.0)
