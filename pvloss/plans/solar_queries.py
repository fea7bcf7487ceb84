"""Queries on the sun, the hourly model, and the choice between models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import z
from ..functions.settings import DEFAULT as S
from ..operators import detect, hourly_model, reference
from ..operators.frame import performance_index
from . import chain, feeds
from .chain import statement
from .daily_queries import rounded

QUERIES, SQL = {}, {}
_G = "(2e0 * pi() * (doy - 1) / 365e0)"
_DEC = f"(0.006918 - 0.399912 * cos({_G}) + 0.070257 * sin({_G}) - 0.006758 * cos(2 * {_G}) + 0.000907 * sin(2 * {_G}) - 0.002697 * cos(3 * {_G}) + 0.00148 * sin(3 * {_G}))"
_EOT = f"(229.18 * (0.0000075 + 0.001868 * cos({_G}) - 0.032077 * sin({_G}) - 0.014615 * cos(2 * {_G}) - 0.040849 * sin(2 * {_G})))"
_EXTRA = f"(1366.1 * (1.00011 + 0.034221 * cos({_G}) + 0.00128 * sin({_G}) + 0.000719 * cos(2 * {_G}) + 0.000077 * sin(2 * {_G})))"
MORE = f"""
sw AS (SELECT system_id, date, mi, degrees(asin(sin(radians(latitude)) * sin(dec) + cos(radians(latitude)) * cos(dec) * cos(radians((mi - 60 * utc_offset_hours + eot + 4 * longitude) / 4 - 180)))) AS el
  FROM (SELECT *, {_DEC}::DOUBLE AS dec, {_EOT}::DOUBLE AS eot FROM (SELECT f.system_id, f.date, dayofyear(f.date) AS doy, s.latitude, s.longitude, s.utc_offset_hours, unnest(range(0, 1440, 5)) AS mi FROM feed_daily f JOIN systems s USING (system_id)) q) r),
hw AS (SELECT system_id, date_trunc('day', date) + to_hours(CAST(h AS INT)) AS hour_utc, dayofyear(date) AS doy, h, ghi * 1000e0 * (36 - (h - 7) * (h - 7)) / 286e0 AS ghi, t2m_c FROM (SELECT *, unnest(range(2, 13)) AS h FROM feed_daily) q
  UNION ALL SELECT system_id, date_trunc('day', date) + to_hours(CAST(h AS INT)), dayofyear(date), h, 0e0, t2m_c FROM (SELECT *, unnest([0, 1, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23]) AS h FROM feed_daily) q),
hm0 AS (SELECT w.*, s.* EXCLUDE (system_id), {_DEC}::DOUBLE AS dec, radians((h * 60e0 + 30 + {_EOT} + 4 * longitude) / 4 - 180) AS ha, {_EXTRA}::DOUBLE AS ex FROM hw w JOIN systems s USING (system_id)),
hm1 AS (SELECT *, sin(radians(latitude)) * sin(dec) + cos(radians(latitude)) * cos(dec) * cos(ha) AS up FROM hm0),
hm2 AS (SELECT *, greatest(least(ghi / (ex * greatest(up, 0.065)), 1), 0) AS kt FROM hm1),
hm3 AS (SELECT *, ghi * CASE WHEN kt <= 0.22 THEN 1 - 0.09 * kt WHEN kt <= 0.8 THEN 0.9511 - 0.1604 * kt + 4.388 * kt ** 2 - 16.638 * kt ** 3 + 12.336 * kt ** 4 ELSE 0.165 END AS d0 FROM hm2),
hm4 AS (SELECT *, CASE WHEN up > 0.052 THEN greatest((ghi - d0) / up, 0) ELSE 0 END AS dni FROM hm3),
hm5 AS (SELECT *, CASE WHEN dni > 0 THEN d0 ELSE ghi END AS dhi, radians(tilt_deg) AS ti, radians(azimuth_deg) AS az, radians(latitude) AS la FROM hm4),
hm6 AS (SELECT *, greatest(sin(ti) * sin(az) * -cos(dec) * sin(ha) + sin(ti) * cos(az) * (sin(dec) * cos(la) - cos(dec) * sin(la) * cos(ha)) + cos(ti) * up, 0) AS fc FROM hm5),
hm7 AS (SELECT *, dni * fc + dhi * (dni / ex * fc / greatest(up, 0.01745) + (1 - dni / ex) * (1 + cos(ti)) / 2) + ghi * 0.25 * (1 - cos(ti)) / 2 AS poa FROM hm6),
hm AS (SELECT system_id, hour_utc + INTERVAL 330 MINUTE AS hour_ts, degrees(asin(up)) AS elevation, greatest(poa / 1000 * capacity_kwp * (1 + {S.temp_coeff_per_c!r} * (t2m_c + {(S.noct_c - 20) / 800!r} * poa - 25)), 0) AS model_kwh FROM hm7),
hd AS (SELECT system_id, CAST(hour_ts AS DATE) AS date, CASE WHEN count(model_kwh) = 24 THEN sum(model_kwh) END AS model_kwh FROM hm GROUP BY 1, 2),
md AS (SELECT system_id, CASE WHEN system_id = 'S1' THEN 'daily' WHEN system_id = 'S2' THEN 'daily' ELSE 'hourly' END AS mode, CASE WHEN system_id = 'S1' THEN 'no tilt or azimuth' END AS note FROM systems)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = statement(sql, MORE)
        return f

    return add


def hourly_weather(spark, d, days=None):
    """The feed's days (or `days`, where the caller has dealt them out) spread over UTC hours 2 to 12 by a parabola, dark elsewhere."""
    h = (feeds.daily(spark, d) if days is None else days).select("system_id", "date", "ghi", "t2m_c", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    ghi = F.when(F.col("h").between(2, 12), F.col("ghi") * 1000.0 * (36 - (F.col("h") - 7) * (F.col("h") - 7)) / 286.0).otherwise(0.0)
    return h.select("system_id", (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))).alias("hour_utc"), ghi.alias("ghi"), "t2m_c")


def hours(spark, d):
    return hourly_model.hourly_model(hourly_weather(spark, d), feeds.systems(spark, d))


def chosen(spark, d):
    """S1 seen without orientation, S2 with daily input."""
    s = feeds.systems(spark, d)
    blind = s.withColumn("tilt_deg", F.when(F.col("system_id") != "S1", F.col("tilt_deg")))
    return hourly_model.modes(blind, s.select("system_id", (F.col("system_id") != "S2").alias("subdaily")))


@query("i11_daylight_window", "SELECT system_id, date, epoch_us(date::TIMESTAMP) + min(mi) * 60000000 AS rise, epoch_us(date::TIMESTAMP) + (max(mi) + 5) * 60000000 AS set FROM sw WHERE el > 5 GROUP BY 1, 2")
def _(spark, d):
    return hourly_model.sun_windows(feeds.daily(spark, d).select("system_id", "date").join(feeds.systems(spark, d).select("system_id", "latitude", "longitude", "utc_offset_hours"), "system_id"))


@query("m04_hourly_model", "SELECT system_id, hour_ts, round(elevation, 4) AS elevation, round(model_kwh, 5) AS model_kwh FROM hm")
def _(spark, d):
    return hours(spark, d).select("system_id", "hour_ts", F.round("elevation", 4).alias("elevation"), F.round("model_kwh", 5).alias("model_kwh"))


@query("m05_hourly_to_daily", "SELECT system_id, date, round(model_kwh, 4) AS model_kwh FROM hd")
def _(spark, d):
    return rounded(hourly_model.daily_sums(hours(spark, d)), "model_kwh", digits=4)


@query("m07_mode_choice", "SELECT m.system_id, mode, note, count(model_kwh) AS days, round(sum(model_kwh), 2) AS model_kwh FROM md m JOIN (SELECT h.system_id, h.model_kwh FROM hd h JOIN md USING (system_id) WHERE mode = 'hourly' UNION ALL SELECT f.system_id, f.model_kwh FROM fb f JOIN md USING (system_id) WHERE mode = 'daily') x USING (system_id) GROUP BY 1, 2, 3")
def _(spark, d):
    m = chosen(spark, d)
    both = hourly_model.model_by_mode(m, hourly_model.daily_sums(hours(spark, d)), chain.base(spark, d))
    return both.groupBy("system_id").agg(F.count("model_kwh").alias("days"), F.round(F.sum("model_kwh"), 2).alias("model_kwh")).join(m, "system_id")


_W0, _W1 = S.windows_days
_HOURLY = f"""WITH hf AS (SELECT f.* EXCLUDE (usable, model_kwh), h.model_kwh, coalesce(valid AND energy_kwh IS NOT NULL AND ghi >= {S.min_daily_irradiation} AND h.model_kwh > 0, false) AS usable FROM f3 f LEFT JOIN hd h USING (system_id, date)),
hfb AS (SELECT *, CASE WHEN usable THEN energy_kwh / model_kwh END AS pi, usable AND coalesce(clearness >= {S.clear_day_min_clearness}, false) AS clear FROM hf),
hfo0 AS (SELECT *, median(CASE WHEN clear THEN pi END) OVER (PARTITION BY system_id) AS typical FROM hfb),
hfo AS (SELECT *, CASE WHEN clear AND NOT coalesce(valid AND clearness >= {S.outage_min_clearness} AND pi < {S.outage_max_fraction} * typical, false) THEN pi END AS pi_clear FROM hfo0),
{chain.noise_steps(_W0, "hfo", "h")}, {chain.noise_steps(_W1, "hfo", "h")}
SELECT system_id, 'daily' AS scenario_id, window_days, se, threshold, detection_limit FROM noise
UNION ALL SELECT system_id, 'hourly', {_W0}, round(se, 5), round(th, 5), round(th + {z(S.power)!r} * se, 5) FROM hnse{_W0}
UNION ALL SELECT system_id, 'hourly', {_W1}, round(se, 5), round(th, 5), round(th + {z(S.power)!r} * se, 5) FROM hnse{_W1}"""


@query("p06_daily_mode_noise", f"SELECT * FROM ({_HOURLY}) q")
def _(spark, d):
    """The noise floor with the hourly model beside that with the daily one, as scenarios of one analysis."""
    f = chain.base(spark, d).drop("pi", "clear")
    other = f.drop("model_kwh").join(hourly_model.daily_sums(hours(spark, d)), ["system_id", "date"], "left")
    both = f.withColumn("scenario_id", F.lit("daily")).unionByName(other.withColumn("scenario_id", F.lit("hourly")))
    keys = ("system_id", "scenario_id")
    return detect.noise_profile(reference.find_outages(performance_index(both), keys=keys), keys=keys)
