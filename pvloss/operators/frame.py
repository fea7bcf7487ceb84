"""The daily analysis frame: energy beside weather, the physical model, and the performance index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import KEYS, dealt, spine, true
from ..functions.settings import DEFAULT, Settings


ENERGY, WEATHER = ("energy_kwh", "valid"), ("ghi", "clear_ghi", "clearness", "t2m_c", "precip_mm")
FRAME = ("date", *ENERGY, *WEATHER, "model_kwh")  # of build_frame(), beside keys, pi and clear


def clearness(weather: DataFrame) -> DataFrame:
    """Adds clearness = ghi / clear_ghi where clear_ghi is above zero."""
    return weather.withColumn("clearness", F.when(F.col("clear_ghi") > 0, F.try_divide("ghi", "clear_ghi")))


def day_length_hours(date: Column, latitude: Column) -> Column:
    """Hours between sunrise and sunset from the declination of the day of the year."""
    declination = F.radians(F.lit(23.45)) * F.sin(2 * math.pi * (284 + F.dayofyear(date)) / 365.0)
    cosine = -F.tan(F.radians(latitude)) * F.tan(declination)
    return 24.0 / math.pi * F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def daily_model_kwh(s: Settings = DEFAULT) -> Column:
    """Energy of an ideal array from ghi, t2m_c, latitude and capacity_kwp."""
    irradiance = F.col("ghi") * 1000.0 / day_length_hours(F.col("date"), F.col("latitude"))
    cell = F.col("t2m_c") + (s.noct_c - 20.0) / 800.0 * irradiance
    return F.col("ghi") * F.col("capacity_kwp") * (1.0 + s.temp_coeff_per_c * (cell - 25.0))


def on_calendar(daily: DataFrame, keys=KEYS, rows: int | None = None) -> DataFrame:
    """Daily rows on a calendar without gaps; days without a row are invalid and unknown. The number of `rows`, where it is
    told, keeps tasks small."""
    days = spine(daily, keys)
    days, daily = (dealt(d, [*keys, "date"], rows) if rows else d for d in (days, daily))
    return days.join(daily, [*keys, "date"], "left").withColumn("valid", true(F.col("valid")))


def build_frame(daily: DataFrame, weather: DataFrame, systems: DataFrame, s: Settings = DEFAULT, model: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """daily (keys, date, energy_kwh, valid) left-joined with weather (keys, date, ...) and the model:
    the daily one, or `model` (keys, date, model_kwh) where hourly weather was used."""
    f = daily.select(*keys, "date", *ENERGY).join(clearness(weather).select(*keys, "date", *WEATHER), [*keys, "date"], "left")
    if model is not None:
        return performance_index(f.join(model, [*keys, "date"], "left"), s)
    sites = systems.select("system_id", "latitude", "capacity_kwp")
    return performance_index(f.join(sites, "system_id", "left").withColumn("model_kwh", daily_model_kwh(s)).drop("latitude", "capacity_kwp"), s)


def performance_index(f: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds pi (measured / modelled energy on usable days) and clear."""
    usable = true(F.col("valid") & F.col("energy_kwh").isNotNull() & (F.col("ghi") >= s.min_daily_irradiation) & (F.col("model_kwh") > 0))
    return f.withColumn("pi", F.when(usable, F.try_divide("energy_kwh", "model_kwh"))).withColumn("clear", usable & true(F.col("clearness") >= s.clear_day_min_clearness))
