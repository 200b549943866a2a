"""Scalar functions of weather, radiation, soil, time and coordinates, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLAR = 0.0820  # MJ m-2 min-1
TWO_PI = 2 * math.pi


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def flux(joules: Column, seconds: float) -> Column:
    """J/m2 over a period to W/m2."""
    return joules / seconds


def saturation_pressure(t: Column) -> Column:
    """kPa at t degrees Celsius (Tetens)."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def vapour_deficit(t: Column, dew: Column) -> Column:
    """kPa; the dew point counts as at most the temperature."""
    return F.greatest(saturation_pressure(t) - saturation_pressure(F.least(dew, t)), F.lit(0.0))


def relative_humidity(t: Column, dew: Column) -> Column:
    return F.least(100 * saturation_pressure(F.least(dew, t)) / saturation_pressure(t), F.lit(100.0))


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def photon_flux(sw: Column, factor: float = 2.04) -> Column:
    """Photosynthetic photon flux of short-wave radiation, not below 0."""
    return F.greatest(sw * factor, F.lit(0.0))


def declination(doy: Column, days: Column) -> Column:
    """Solar declination in radians (Spencer's series)."""
    g = TWO_PI * (doy - 1) / days
    return 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)


def equation_of_time(doy: Column, days: Column) -> Column:
    """Minutes (Spencer's series)."""
    g = TWO_PI * (doy - 1) / days
    return 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))


def sunset_angle(lat: Column, dec: Column) -> Column:
    """Hour angle of sunset; 0 in polar night, pi in polar day."""
    x = -F.tan(F.radians(lat)) * F.tan(dec)
    return F.acos(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def extraterrestrial(lat: Column, doy: Column, days: Column) -> Column:
    """Daily extraterrestrial radiation, MJ m-2."""
    dec, phi = declination(doy, days), F.radians(lat)
    ws = sunset_angle(lat, dec)
    dr = 1 + 0.033 * F.cos(TWO_PI * doy / days)
    return 24 * 60 / math.pi * SOLAR * dr * (ws * F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.sin(ws))


def day_length(lat: Column, doy: Column, p: float = 0.8333) -> Column:
    """Hours of daylight (CBM model: revolution angle, declination and a sunrise angle of p degrees)."""
    theta = 0.2163108 + 2 * F.atan(0.9671396 * F.tan(0.00860 * (doy - 186)))
    phi = F.asin(0.39795 * F.cos(theta))
    lat_r = F.radians(lat)
    x = (math.sin(math.radians(p)) + F.sin(lat_r) * F.sin(phi)) / (F.cos(lat_r) * F.cos(phi))
    return 24 - 24 / math.pi * F.acos(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))


def solar_elevation(lat: Column, doy: Column, days: Column, solar_hour: Column) -> Column:
    """Degrees above the horizon at a solar hour."""
    dec, phi = declination(doy, days), F.radians(lat)
    h = F.radians(15 * (solar_hour - 12))
    return F.degrees(F.asin(F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(h)))


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a place in a period."""
    return F.sin(TWO_PI * x / period), F.cos(TWO_PI * x / period)


def rain_over_demand(p: Column, pet: Column) -> Column:
    """P/PET clipped to 0..10; without demand 0 for next to no rain, else 10."""
    return F.when(pet > 1e-6, F.least(F.greatest(p / pet, F.lit(0.0)), F.lit(10.0))).when(p < 1e-6, 0.0).otherwise(10.0)


def hydraulics(sand: Column, clay: Column, om: Column) -> dict[str, Column]:
    """Wilting point and field capacity (volume shares) of Saxton and Rawls' two-step regressions; sand and clay as shares, om in percent."""
    w = -0.024 * sand + 0.487 * clay + 0.006 * om + 0.005 * sand * om - 0.013 * clay * om + 0.068 * sand * clay + 0.031
    f = -0.251 * sand + 0.195 * clay + 0.011 * om + 0.006 * sand * om - 0.027 * clay * om + 0.452 * sand * clay + 0.299
    return {"wilting": w + 0.14 * w - 0.02, "capacity": f + 1.283 * f * f - 0.374 * f - 0.015}


def extractable_water(theta: Column, wilting: Column, capacity: Column) -> Column:
    """Relative extractable water, clipped to 0..1.5."""
    return F.when(capacity > wilting, F.least(F.greatest((theta - wilting) / (capacity - wilting), F.lit(0.0)), F.lit(1.5)))


def reference_et(t: Column, rn: Column, u2: Column, es: Column, ea: Column, altitude: Column) -> Column:
    """FAO-56 Penman-Monteith, mm a day; rn in MJ m-2 a day, pressures in kPa, not below 0."""
    delta = 4098 * saturation_pressure(t) / F.pow(t + 237.3, 2)
    gamma = 0.000665 * 101.3 * F.pow((293 - 0.0065 * altitude) / 293, 5.26)
    return F.greatest((0.408 * delta * rn + gamma * 900 / (t + 273) * u2 * (es - ea)) / (delta + gamma * (1 + 0.34 * u2)), F.lit(0.0))


def water_potential(theta: Column, sand: Column, clay: Column) -> Column:
    """Soil water potential (kPa, clipped to -5000..0), Campbell's curve with Cosby's regressions; sand and clay in percent."""
    b = 2.91 + 0.159 * clay
    sat = 0.489 - 0.00126 * sand
    psi = -10 * F.pow(F.lit(10.0), 1.88 - 0.0131 * sand) / 1000 * 9.81 * F.pow(F.greatest(theta, F.lit(1e-3)) / sat, -b) / 10
    return F.least(F.greatest(psi, F.lit(-5000.0)), F.lit(0.0))


def texture(sand: Column, clay: Column) -> Column:
    return F.when(clay >= 40, "clay").when(sand >= 70, "sandy").when((clay >= 27) & (sand < 45), "clay loam").when(sand < 20, "silty").otherwise("loam")


def compass(aspect: Column, slope: Column, flat: float = 1.0) -> Column:
    """Eight-way class of an aspect in degrees; slopes under ``flat`` are flat."""
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    k = F.pmod(F.floor((F.pmod(aspect, F.lit(360.0)) + 22.5) / 45), F.lit(8)).cast("int")
    return F.when(slope < flat, "flat").otherwise(F.get(names, k))


def quality_bits(code: Column, mask: int) -> Column:
    """Whether none of the mask's bits is set."""
    return code.bitwiseAND(F.lit(mask)) == 0


def zone_shift(code: Column, hours: dict[str, float]) -> Column:
    """Seconds that a zone code is ahead; an unknown code is an error."""
    out = F.raise_error(F.concat(F.lit("unknown zone "), code)).cast("double")
    for k, h in hours.items():
        out = F.when(code == k, h * 3600).otherwise(out)
    return out


def tile(lat: Column, lon: Column, size: float = 5.0) -> tuple[Column, Column]:
    """Row from the north and column from the west of a tile of ``size`` degrees, clamped to the globe."""
    row = F.least(F.greatest(F.floor((90 - lat) / size), F.lit(0)), F.lit(int(180 / size) - 1))
    col = F.least(F.greatest(F.floor((lon + 180) / size), F.lit(0)), F.lit(int(360 / size) - 1))
    return row.cast("long"), col.cast("long")


def wrap_longitude(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def transforms(x: Column) -> dict[str, Column]:
    """Target transforms; the logarithms are of 1 + x and of a shifted x."""
    yj = lambda lam: F.when(x >= 0, (F.pow(x + 1, lam) - 1) / lam).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return {"log1p": F.log1p(x), "sqrt": F.sqrt(x), "box_cox": (F.pow(x + 1e-6, 0.5) - 1) / 0.5, "yeo_johnson": yj(0.5)}


def inverse_log1p(z: Column) -> Column:
    """Back from log1p, the argument clipped to +-20."""
    return F.expm1(F.least(F.greatest(z, F.lit(-20.0)), F.lit(20.0)))
