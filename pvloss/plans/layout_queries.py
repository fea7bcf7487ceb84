"""Queries on raw exports of several layouts: written to the shared folder, read back, and taken to intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import fresh
from ..functions.settings import DEFAULT as S
from ..operators import layout
from ..sources import files
from . import chain, feeds
from .daily_queries import rounded
from .interval_queries import CTES

QUERIES, SQL = {}, {}
CAPACITY = 10.0
#: Files, dealt out by the system's number: lifetime counters with an id column; counters that start again every day, the id in the
#: file's name; power in watts, in kilowatts from the 25th of January on; power of two inverters.
MORE = f"""{CTES},
exports AS (SELECT system_id, k, ts, row_no, power_kw, counter_kwh, today_kwh, CASE WHEN k < 2 THEN 'export_' || system_id WHEN k = 2 THEN 'roof ' || lower(system_id) || '-2024' ELSE 'Plant_' || system_id || '_power' END AS file FROM (SELECT *, CAST(substr(system_id, 2) AS INT) % 5 AS k FROM feed_readings) q),
watts AS (SELECT *, power_kw * CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 1e3 ELSE 1e0 END AS w FROM (SELECT * REPLACE (ts + INTERVAL 16 DAY AS ts) FROM exports WHERE k = 3) q),
peaks AS (SELECT file, CAST(ts AS DATE) AS date, max(w) AS peak FROM watts WHERE w IS NOT NULL GROUP BY 1, 2),
told AS (SELECT *, CASE WHEN peak < 0.05 * 10 THEN NULL WHEN peak <= 1.5 * 10 THEN 'kW' ELSE 'W' END AS u FROM peaks),
layouts AS (
  SELECT file, system_id, CASE WHEN avg((v >= p)::INT) > {S.counter_min_rising_share} AND count(v) >= 10 AND arg_max(v, (ts, row_no)) > arg_min(v, (ts, row_no)) THEN 'counter' ELSE 'interval energy' END AS kind, 'E-Total (kWh)__12' AS columns,
         (arg_max(v, (ts, row_no)) - arg_min(v, (ts, row_no))) / greatest((epoch_us(max(all_end)) - epoch_us(min(all_start))) / 8.64e10, 1) AS counter_size, sum(v) / greatest((epoch_us(max(all_end)) - epoch_us(min(all_start))) / 8.64e10, 1) AS sum_size
  FROM (SELECT *, counter_kwh AS v, lag(counter_kwh) OVER (PARTITION BY file ORDER BY ts, row_no) AS p, max(ts) OVER (PARTITION BY file) AS all_end, min(ts) OVER (PARTITION BY file) AS all_start FROM (SELECT * FROM exports WHERE counter_kwh IS NOT NULL AND k < 2) c) q GROUP BY 1, 2)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = MORE + sql
        return f

    return add


@chain.shared
def export_rows(spark, d):
    """The feed's readings as raw exports of four layouts, read back."""
    path = fresh(spark, "exports")
    r = feeds.readings(spark, d).withColumn("k", F.substring("system_id", 2, 9).cast("int") % 5)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    service = F.when(F.col("row_no") % 2 == 0, "2024-01-01").otherwise("none")
    total = r.where("k < 2").select(F.concat(F.lit("export_"), "system_id").alias("file"), "system_id", service.alias("date of service"), F.col("row_no").alias("time_s"), stamp.alias("measured_on"), F.col("counter_kwh").alias("E-Total (kWh)__12"), F.col("power_kw").alias("power factor"))
    today = r.where("k = 2").select(F.concat(F.lit("roof "), F.lower("system_id"), F.lit("-2024")).alias("file"), F.col("today_kwh").alias("E-Today (kWh)__13"), F.lit("ok").alias("state"), stamp.alias("Logged"))
    # Sixteen days later, so that the change of unit on the 25th has a month on either side.
    late = r.where("k = 3").withColumn("ts", F.col("ts") + F.expr("interval 16 days"))
    watts = F.col("power_kw") * F.when(F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz"), 1000.0).otherwise(1.0)
    power = late.select(F.concat(F.lit("Plant_"), "system_id", F.lit("_power")).alias("file"), stamp.alias("Timestamp"), watts.alias("ac_power__7"), F.col("power_kw").alias("inverter 1 power"), (F.col("power_kw") * 2).alias("dc_power__8"))
    pair = r.where("k = 4").select(F.concat(F.lit("Plant_"), "system_id", F.lit("_power")).alias("file"), stamp.alias("Time"), (F.col("power_kw") / 2).alias("inv1_pac"), (F.col("power_kw") / 2).alias("inv2_pac"))
    for k, group in enumerate((total, today, power, pair)):
        group.repartition("file").write.partitionBy("file").option("header", True).csv(f"{path}/{k}")
    rows = files.read_export_rows(spark, [f"{path}/{k}" for k in range(4)], r"file=([^/]+)/")
    # Folders of a written table escape blanks.
    return rows.withColumn("file", F.url_decode("file"))


def systems(spark, d):
    return feeds.readings(spark, d).select("system_id").distinct().withColumn("capacity_kwp", F.lit(CAPACITY))


@chain.shared
def layouts(spark, d):
    return layout.infer(export_rows(spark, d), systems(spark, d))


@chain.shared
def energies(spark, d):
    return layout.file_energies(export_rows(spark, d), layouts(spark, d), systems(spark, d))


@query("l02_time_column", "SELECT DISTINCT file, CASE k WHEN 0 THEN 'measured_on' WHEN 1 THEN 'measured_on' WHEN 2 THEN 'Logged' WHEN 3 THEN 'Timestamp' ELSE 'Time' END AS time_column FROM exports")
def _(spark, d):
    return layout.time_columns(layout.columns_of(export_rows(spark, d)))


@query("l03_system_ids", "SELECT DISTINCT file, system_id, CASE WHEN k < 2 THEN 'column' ELSE 'file name' END AS id_from FROM exports")
def _(spark, d):
    return layout.system_ids(layout.columns_of(export_rows(spark, d)), systems(spark, d)).select("file", "system_id", "id_from")


_UNIT = "(SELECT arg_min(u, (abs(ln(greatest({0} * k, 1e-12) / 10e0 / sqrt({1}))), i)) FROM (VALUES {2}) o(u, k, i))"
_ENERGY_UNIT = _UNIT.format("{0}", f"{S.plausible_daily_yield[0]}e0 * {S.plausible_daily_yield[1]}e0", "('kWh', 1e0, 0), ('Wh', 1e-3, 1), ('MWh', 1e3, 2)")
_POWER_UNIT = _UNIT.format("{0}", f"{S.plausible_peak_fraction[0]}e0 * {S.plausible_peak_fraction[1]}e0", "('kW', 1e0, 0), ('hW', 1e-1, 1), ('W', 1e-3, 2)")


@query("l10_layouts", f"""SELECT file, system_id, kind, columns, {_ENERGY_UNIT.format("size")} AS unit FROM (SELECT *, CASE WHEN kind = 'counter' THEN counter_size ELSE sum_size END AS size FROM layouts) l
UNION ALL SELECT file, system_id, 'daily reset counter', 'E-Today (kWh)__13', {_ENERGY_UNIT.format("m")} FROM (SELECT file, system_id, avg(x) AS m FROM (SELECT file, system_id, max(today_kwh) AS x FROM exports WHERE k = 2 AND today_kwh IS NOT NULL GROUP BY file, system_id, CAST(ts AS DATE)) q GROUP BY 1, 2) r
UNION ALL SELECT file, system_id, 'power', 'ac_power__7', {_POWER_UNIT.format("m")} FROM (SELECT file, system_id, quantile_cont(w, {S.unit_peak_quantile}) AS m FROM watts GROUP BY 1, 2) r
UNION ALL SELECT file, system_id, 'power', 'inv1_pac,inv2_pac', {_POWER_UNIT.format("m")} FROM (SELECT file, system_id, quantile_cont(power_kw, {S.unit_peak_quantile}) AS m FROM exports WHERE k = 4 GROUP BY 1, 2) r""")
def _(spark, d):
    return layouts(spark, d).select("file", "system_id", "kind", F.array_join("columns", ",").alias("columns"), "unit")


@query("l11_unit_changes", """SELECT file, date, unit, CASE unit WHEN 'kW' THEN 1e0 ELSE 1e-3 END AS scale FROM (SELECT file, date, coalesce(last_value(u IGNORE NULLS) OVER (PARTITION BY file ORDER BY date), first_value(u IGNORE NULLS) OVER (PARTITION BY file ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS unit FROM told) q""")
def _(spark, d):
    return layout.unit_changes(layout.summed_power(export_rows(spark, d), layouts(spark, d)), systems(spark, d))


@query("i08_file_intervals")
def _(spark, d):
    return rounded(layout.combined(energies(spark, d), layouts(spark, d)), "energy_kwh", "hours")
