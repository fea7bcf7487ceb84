"""Sun and sky as columns: position from the Fourier series of Spencer (1971), the split of Erbs (1982) and the
transposition of Hay and Davies (1980). Elevations are without refraction."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLAR_CONSTANT = 1366.1


def _series(angle: Column, constant: float, *pairs: tuple[float, float]) -> Column:
    """constant + sum of a cos(k angle) + b sin(k angle)."""
    out = F.lit(constant)
    for k, (a, b) in enumerate(pairs, 1):
        out = out + a * F.cos(k * angle) + b * F.sin(k * angle)
    return out


def day_angle(day_of_year: Column) -> Column:
    return 2 * math.pi * (day_of_year - 1) / 365.0


# Fixed values of the Fourier series.
def declination(angle: Column) -> Column:
    return _series(angle, 0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))


def equation_of_time_minutes(angle: Column) -> Column:
    return 229.18 * _series(angle, 0.0000075, (0.001868, -0.032077), (-0.014615, -0.040849))


def extra_radiation(angle: Column) -> Column:
    return SOLAR_CONSTANT * _series(angle, 1.00011, (0.034221, 0.00128), (0.000719, 0.000077))


def hour_angle(utc_minutes: Column, angle: Column, longitude: Column) -> Column:
    """Radians from solar noon, of minutes since midnight UTC."""
    return F.radians((utc_minutes + equation_of_time_minutes(angle) + 4.0 * longitude) / 4.0 - 180.0)


def sin_elevation(hour: Column, dec: Column, latitude: Column) -> Column:
    return F.sin(F.radians(latitude)) * F.sin(dec) + F.cos(F.radians(latitude)) * F.cos(dec) * F.cos(hour)


def diffuse_share(kt: Column) -> Column:
    """Erbs: share of diffuse in global irradiance by clearness. Fixed values of the polynomial."""
    middle = 0.9511 - 0.1604 * kt + 4.388 * kt * kt - 16.638 * kt * kt * kt + 12.336 * kt * kt * kt * kt
    return F.when(kt <= 0.22, 1 - 0.09 * kt).when(kt <= 0.8, middle).otherwise(0.165)
