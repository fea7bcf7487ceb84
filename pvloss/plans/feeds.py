"""Feeds: the driver's tables seen as daily energy with weather, irregular readings, and measured and
modelled hours. The same text runs in Spark and in DuckDB (integer sums, one final division)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


DAILY = """
WITH p AS (SELECT CAST(greatest(1, floor(count(*) / 12000.0)) AS INT) AS n_sys FROM lineitem),
li AS (
  SELECT l_suppkey % n_sys AS s, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS d100, sum(CAST(round(l_tax * 100) AS BIGINT)) AS t100,
         sum(CAST(round(l_quantity) AS BIGINT)) AS q1
  FROM lineitem CROSS JOIN p GROUP BY 1, 2),
w AS (
  SELECT concat('S', CAST(s AS STRING)) AS system_id, date, n,
         CAST(7500 - floor(4000e0 * abs(dayofyear(date) - 172) / 194e0) AS BIGINT) AS clear_m,
         CAST(least(1000, 500 + floor(100e0 * t100 / n)) AS BIGINT) AS k_m,
         CAST(77000 + floor(600e0 * d100 / n) AS BIGINT) AS perf_u,
         CAST(greatest(0, floor(10e0 * q1 / n) - 300) AS BIGINT) AS rain_d,
         CASE WHEN date BETWEEN DATE '1996-06-10' AND DATE '1996-06-12' THEN 0
              WHEN date BETWEEN DATE '1998-02-01' AND DATE '1998-02-25' AND s % 3 = 1 THEN 65
              WHEN date BETWEEN DATE '1997-03-01' AND DATE '1997-04-14' THEN 88 ELSE 100 END AS f_pct
  FROM li)
SELECT system_id, date, n AS n_samples, n >= 2 AS valid, clear_m * k_m / 1e6 AS ghi, clear_m / 1e3 AS clear_ghi,
       25e0 AS t2m_c, rain_d / 1e1 AS precip_mm, clear_m * k_m * perf_u * f_pct / 1e12 AS energy_kwh
FROM w"""

READINGS = """
WITH p AS (SELECT CAST(greatest(5, floor(count(*) / 2000.0)) AS INT) AS n_sys FROM events),
e AS (
  SELECT concat('S', CAST(user_id % n_sys AS STRING)) AS system_id, event_id AS row_no, ts, CAST(ts AS DATE) AS date,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v
  FROM events CROSS JOIN p)
SELECT system_id, row_no, ts, v / 5e1 AS power_kw,
       CASE WHEN v IS NULL THEN NULL ELSE round(sum(v) OVER (PARTITION BY system_id, date >= DATE '2024-01-16'
         ORDER BY ts, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) END AS counter_kwh,
       CASE WHEN v IS NULL THEN NULL ELSE round(sum(v) OVER (PARTITION BY system_id, date
         ORDER BY ts, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) END AS today_kwh
FROM e"""

#: Hours of January; every other day is moved to June, but for every fifth system, which has one season only.
HOURS = """
WITH p AS (SELECT CAST(greatest(5, floor(count(*) / 2000.0)) AS INT) AS n_sys FROM events),
h AS (
  SELECT s, CAST(date_trunc('hour', ts) AS {ntz}) AS t, hour(ts) AS hr, day(ts) AS dom, CAST(floor(1e0 * sum(CAST(round(value * 100) AS BIGINT)) / count(*)) AS BIGINT) AS v100
  FROM (SELECT *, user_id % n_sys AS s FROM events CROSS JOIN p) q GROUP BY 1, 2, 3, 4)
SELECT concat('S', CAST(s AS STRING)) AS system_id, s, CASE WHEN dom % 2 = 1 AND s % 5 <> 4 THEN t + INTERVAL 150 DAY ELSE t END AS hour_ts, hr, dom, v100 FROM h"""

#: Measured and modelled energy. Every fifth system's 16:00 is low on all days, every fifth's 9:00 on cloudy days only.
HOURLY = """
SELECT system_id, hour_ts, CAST(90 - 15 * abs(hr - 12) AS DOUBLE) AS elevation, greatest(0, 40 - (hr - 12) * (hr - 12)) / 4e0 AS model_kwh,
       greatest(0, 40 - (hr - 12) * (hr - 12)) * (78000 + least(v100, 20000) * 2 / 5e0)
         * CASE WHEN hr IN (16, 17) AND s % 5 = 1 THEN 7 WHEN hr = 9 AND s % 5 = 2 AND (dom + s) % 6 = 0 THEN 2 ELSE 10 END / 4e6 AS actual_kwh
FROM ({hours}) q"""

#: Which of these days are clear, and which a fault spoils.
CLEAR = """
SELECT DISTINCT system_id, CAST(hour_ts AS DATE) AS date, (dom + s) % 6 <> 0 AS clear, dom % 14 = 0 AS fault FROM ({hours}) q"""

SYSTEMS = """
SELECT system_id, concat('plant ', system_id) AS name, 10e0 AS capacity_kwp, 26.77e0 AS latitude, 75.85e0 AS longitude,
       26e0 AS tilt_deg, 180e0 AS azimuth_deg, '1994-06-01' AS commissioning_date,
       CASE WHEN system_id <> 'S3' THEN 7.5e0 END AS tariff, CASE WHEN system_id <> 'S4' THEN 150e0 END AS cleaning_cost,
       5.5e0 AS utc_offset_hours,
       CASE WHEN system_id IN ('S0', 'S1', 'S2') THEN 'Public dataset: A' ELSE 'Real system data' END AS data_label
FROM (SELECT DISTINCT system_id FROM feed_daily) q"""

EVENTS = """
SELECT * FROM (VALUES ('S0', DATE '1997-04-15', 'cleaning', ''), ('S1', DATE '1998-02-26', 'repair', 'string back')) AS v(system_id, date, type, note)"""

TABLES = ("lineitem", "events")


def _view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    df = spark.sql(sql)
    df.createOrReplaceTempView(name)
    return df


def daily(spark, sf_dir):
    return _view(spark, sf_dir, "feed_daily", DAILY)


def readings(spark, sf_dir):
    return _view(spark, sf_dir, "feed_readings", READINGS)


def hourly(spark, sf_dir):
    return _view(spark, sf_dir, "feed_hourly", HOURLY.format(hours=HOURS.format(ntz="TIMESTAMP_NTZ")))


def clear_days(spark, sf_dir):
    return _view(spark, sf_dir, "feed_clear", CLEAR.format(hours=HOURS.format(ntz="TIMESTAMP_NTZ")))


def systems(spark, sf_dir, feed=daily):
    """The systems of the daily feed; feed(spark, sf_dir) gives its rows, which the caller may have stored."""
    feed(spark, sf_dir).createOrReplaceTempView("feed_daily")
    return spark.sql(SYSTEMS)


def events(spark, sf_dir):
    return spark.sql(EVENTS)



#: The feeds as leading parts of a DuckDB statement.
CTES = f"feed_daily AS ({DAILY}), feed_readings AS ({READINGS}), feed_hourly AS ({HOURLY.format(hours=HOURS.format(ntz='TIMESTAMP'))}), feed_clear AS ({CLEAR.format(hours=HOURS.format(ntz='TIMESTAMP'))}), systems AS ({SYSTEMS}), dated AS ({EVENTS})"
