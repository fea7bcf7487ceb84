"""Sun windows and the hourly model, all in columns: one row a system and hour, no shuffle of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import solar
from ..functions.common import KEYS, true
from ..functions.settings import DEFAULT, Settings
from .intervals import HOUR_US, at, us

GRID_MINUTES = 5


def sun_windows(days: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """days (system_id, date, latitude, longitude, utc_offset_hours) -> system_id, date, rise, set in local
    microseconds: first and last grid point with the sun up, the end one step later. Days without sun go."""
    sites = days.select("latitude", "longitude", "utc_offset_hours", "date").distinct()
    d = sites.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(24 * 60 - GRID_MINUTES), F.lit(GRID_MINUTES))))
    angle = solar.day_angle(F.dayofyear("date"))
    hour = solar.hour_angle(F.col("m") - 60.0 * F.col("utc_offset_hours"), angle, F.col("longitude"))
    up = F.degrees(F.asin(solar.sin_elevation(hour, solar.declination(angle), F.col("latitude")))) > s.daylight_min_elevation_deg
    lit = d.where(up).groupBy(*sites.columns).agg(F.min("m").cast("bigint").alias("a"), F.max("m").cast("bigint").alias("b"))
    midnight = us(F.col("date").cast("timestamp"))
    found = days.join(lit, sites.columns)
    minute = HOUR_US // 60
    return found.select("system_id", "date", (midnight + F.col("a") * minute).alias("rise"), (midnight + (F.col("b") + GRID_MINUTES) * minute).alias("set"))


def hourly_model(weather: DataFrame, systems: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """weather (system_id, hour_utc, ghi in W/m2, t2m_c) -> system_id, hour_ts (local), elevation, model_kwh. The
    sun is that of the middle of the hour; null irradiation stays unknown. Systems without orientation go."""
    sites = systems.where("tilt_deg is not null and azimuth_deg is not null").select("system_id", "latitude", "longitude", "tilt_deg", "azimuth_deg", "capacity_kwp", "utc_offset_hours")
    d = weather.join(sites, "system_id")
    angle = solar.day_angle(F.dayofyear("hour_utc"))
    d = d.withColumns({"_dec": solar.declination(angle), "_h": solar.hour_angle(F.hour("hour_utc") * 60.0 + 30.0, angle, F.col("longitude")), "_extra": solar.extra_radiation(angle)})
    d = d.withColumn("_up", solar.sin_elevation(F.col("_h"), F.col("_dec"), F.col("latitude")))
    # Clearness of the sky, against a sun no lower than a small angle; beam only while the sun is up.
    kt = F.greatest(F.least(F.try_divide("ghi", F.col("_extra") * F.greatest("_up", F.lit(0.065))), F.lit(1.0)), F.lit(0.0))
    d = d.withColumn("_dhi", F.col("ghi") * solar.diffuse_share(kt))
    beam = F.when(F.col("_up") > 0.052, F.greatest((F.col("ghi") - F.col("_dhi")) / F.col("_up"), F.lit(0.0))).otherwise(0.0)
    d = d.withColumn("_dni", F.when(F.col("ghi").isNotNull(), beam)).withColumn("_dhi", F.when(F.col("_dni") > 0, F.col("_dhi")).otherwise(F.col("ghi")))
    # Sun vector: east, north, up; the array's normal in the same frame.
    lat, tilt, az = F.radians("latitude"), F.radians("tilt_deg"), F.radians("azimuth_deg")
    east = -F.cos("_dec") * F.sin("_h")
    north = F.sin(F.col("_dec")) * F.cos(lat) - F.cos(F.col("_dec")) * F.sin(lat) * F.cos(F.col("_h"))
    facing = F.greatest(F.sin(tilt) * F.sin(az) * east + F.sin(tilt) * F.cos(az) * north + F.cos(tilt) * F.col("_up"), F.lit(0.0))
    around = F.col("_dni") / F.col("_extra")
    sky = F.col("_dhi") * (around * facing / F.greatest("_up", F.lit(0.01745)) + (1.0 - around) * (1.0 + F.cos(tilt)) / 2.0)
    ground = F.col("ghi") * 0.25 * (1.0 - F.cos(tilt)) / 2.0
    d = d.withColumn("_poa", F.col("_dni") * facing + sky + ground)
    cell = F.col("t2m_c") + (s.noct_c - 20.0) / 800.0 * F.col("_poa")
    power = F.col("_poa") / 1000.0 * F.col("capacity_kwp") * (1.0 + s.temp_coeff_per_c * (cell - 25.0))
    shift = (F.col("utc_offset_hours") * HOUR_US).cast("bigint")
    return d.select("system_id", at(us(F.col("hour_utc")) + shift).alias("hour_ts"), F.degrees(F.asin(F.col("_up"))).alias("elevation"), F.when(power.isNotNull(), F.greatest(power, F.lit(0.0))).alias("model_kwh"))


def daily_sums(hours: DataFrame, keys=KEYS) -> DataFrame:
    """keys, date, model_kwh: null on days without all 24 hours."""
    got = hours.groupBy(*keys, F.to_date("hour_ts").alias("date")).agg(F.count("model_kwh").alias("n"), F.sum("model_kwh").alias("e"))
    return got.select(*keys, "date", F.when(F.col("n") == 24, F.col("e")).alias("model_kwh"))


def modes(systems: DataFrame, resolution: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """resolution (system_id, subdaily) -> system_id, mode, note: hourly only for sub-daily input of systems with
    an orientation, and if the settings allow it."""
    oriented = F.col("tilt_deg").isNotNull() & F.col("azimuth_deg").isNotNull()
    allowed, fine = F.lit(s.mode in ("auto", "hourly")), true(F.col("subdaily"))
    note = F.when(fine & allowed & ~oriented, "no tilt or azimuth").when(~fine & F.lit(s.mode == "hourly"), "input is daily")
    return systems.join(resolution, "system_id", "left").select("system_id", F.when(fine & allowed & oriented, "hourly").otherwise("daily").alias("mode"), note.alias("note"))


def model_by_mode(mode: DataFrame, hourly_days: DataFrame, daily_days: DataFrame) -> DataFrame:
    """system_id, date, model_kwh from the model of each system's mode."""
    pick = lambda d, m: d.select("system_id", "date", "model_kwh").join(mode.where(F.col("mode") == m).select("system_id"), "system_id", "left_semi")
    return pick(hourly_days, "hourly").unionByName(pick(daily_days, "daily"))
