"""Queries from readings to hours and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.settings import DEFAULT as S
from ..operators import intervals as iv
from ..operators import layout
from . import feeds
from .daily_queries import rounded

QUERIES, SQL = {}, {}
CAPACITY = 40.0  # bites on some of the feed's readings


def _counter(value, part, reset):
    return f"""SELECT system_id, ts, CASE WHEN NOT coalesce(el > {S.max_counter_gap_hours}, false) THEN CASE WHEN coalesce(st < 0, false) THEN {reset} ELSE st END END AS energy,
      coalesce(st < 0, false) AS is_reset, coalesce(el > {S.max_counter_gap_hours}, false) AS long_gap, el AS elapsed_h
    FROM (SELECT system_id, ts, v, v - lag(v) OVER w AS st, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS el
      FROM (SELECT system_id, ts, arg_max({value}, row_no) AS v FROM feed_readings WHERE {value} IS NOT NULL GROUP BY 1, 2) q WINDOW w AS (PARTITION BY system_id ORDER BY ts)) r"""


CTES = f"""WITH feed_daily AS ({feeds.DAILY}), feed_readings AS ({feeds.READINGS}),
i1 AS ({_counter("counter_kwh", "", "NULL")}), i2 AS ({_counter("today_kwh", "", "v")}),
k AS (SELECT system_id, ts, arg_max(power_kw, row_no) AS power_kw FROM feed_readings WHERE power_kw IS NOT NULL GROUP BY 1, 2),
e0 AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY system_id ORDER BY ts))) / 3.6e9 AS el, CAST(ts AS DATE) AS day FROM k),
e1 AS (SELECT *, coalesce(median(el) OVER (PARTITION BY system_id, day), median(el) OVER (PARTITION BY system_id)) AS step_h FROM e0),
e2 AS (SELECT *, coalesce(CASE WHEN el <= {S.logging_gap_step_factor} * step_h THEN el END, step_h) AS hours FROM e1),
e3 AS (SELECT *, power_kw * hours AS energy0, {CAPACITY}e0 * hours * {S.max_capacity_factor} AS lim FROM e2),
e4 AS (SELECT *, CASE WHEN energy0 < 0 AND energy0 >= -{S.negative_clip_fraction} * lim THEN 0 ELSE energy0 END AS clipped FROM e3),
e5 AS (SELECT *, coalesce(clipped < 0 OR clipped > lim, false) AS impossible, CASE WHEN NOT coalesce(clipped < 0 OR clipped > lim, false) THEN clipped END AS energy_kwh,
         epoch_us(ts) AS t1, epoch_us(ts) - CAST(round(hours * 3600000000) AS BIGINT) AS t0 FROM e4),
e6 AS (SELECT *, make_timestamp(t0 + ((t1 - t0) >> 1)) AS mid FROM e5),
e7 AS (SELECT *, CAST(mid AS DATE) AS date, CAST(make_timestamp(t0) AS DATE) AS d0, CAST(ts AS DATE) AS d1 FROM e6),
e8 AS (SELECT *, greatest(least(t1, epoch_us(d1::TIMESTAMP) + 64800000000) - greatest(t0, epoch_us(d1::TIMESTAMP) + 21600000000), 0) / 3.6e9 AS h1,
         CASE WHEN d0 <> d1 THEN greatest(least(t1, epoch_us(d0::TIMESTAMP) + 64800000000) - greatest(t0, epoch_us(d0::TIMESTAMP) + 21600000000), 0) / 3.6e9 ELSE 0 END AS h0 FROM e7),
e9 AS (SELECT * REPLACE (CASE WHEN NOT (h1 > {S.straddle_min_hours} AND h0 > {S.straddle_min_hours}) THEN energy_kwh END AS energy_kwh) FROM e8),
cov AS (SELECT system_id, date, least(sum(h) / 12e0, 1e0) AS coverage FROM (SELECT system_id, d1 AS date, h1 AS h FROM e9 WHERE energy_kwh IS NOT NULL UNION ALL SELECT system_id, d0, h0 FROM e9 WHERE energy_kwh IS NOT NULL) q GROUP BY 1, 2),
hr AS (SELECT system_id, date_trunc('hour', mid) AS hour_ts, CASE WHEN sum(CASE WHEN energy_kwh IS NOT NULL THEN hours ELSE 0 END) BETWEEN 0.9 AND 1.1 AND max(hours) <= 1 THEN sum(energy_kwh) END AS energy_kwh FROM e9 GROUP BY 1, 2),
days AS (SELECT system_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM e9 GROUP BY 1),
dd0 AS (SELECT s.system_id, s.date, g.raw AS energy_kwh_raw, coalesce(g.n, 0) AS n_samples, coalesce(g.bad, 0) AS n_impossible, coalesce(c.coverage, 0) AS coverage FROM days s
  LEFT JOIN (SELECT system_id, date, sum(energy_kwh) AS raw, count(energy_kwh) AS n, count(*) FILTER (impossible) AS bad FROM e9 GROUP BY 1, 2) g USING (system_id, date) LEFT JOIN cov c USING (system_id, date)),
dd1 AS (SELECT *, max(i) OVER w AS n, min(CASE WHEN n_samples > 2 THEN i END) OVER w AS a, max(CASE WHEN n_samples > 2 THEN i END) OVER w AS b
  FROM (SELECT *, date - min(date) OVER (PARTITION BY system_id) + 1 AS i FROM dd0) q WINDOW w AS (PARTITION BY system_id)),
dd2 AS (SELECT *, n_samples = 0 OR coverage = 0 AS flag_gap, n_impossible > 0 OR coalesce(energy_kwh_raw / {CAPACITY}e0 > {S.max_daily_specific_yield}, false) AS flag_impossible
  FROM (SELECT *, greatest(1, least(coalesce(a, n - 1), n - 1)) AS first_i FROM dd1) q WHERE i BETWEEN first_i AND least(n, greatest(coalesce(b, 0), first_i + 1))),
dd AS (SELECT *, NOT flag_gap AND coverage < {S.min_daylight_coverage} AS flag_partial, NOT (flag_gap OR flag_impossible OR (NOT flag_gap AND coverage < {S.min_daylight_coverage})) AS valid FROM dd2)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = CTES + sql
        return f

    return add


def systems(r):
    return r.select("system_id").distinct().withColumn("capacity_kwp", F.lit(CAPACITY))


def energies(spark, d):
    r = feeds.readings(spark, d)
    k = iv.sample_hours(iv.keep_last(r.where("power_kw is not null").select("system_id", "ts", "row_no", "power_kw")))
    return k.withColumn("energy_kwh", F.col("power_kw") * F.col("hours")), systems(r)


def cleaned(spark, d):
    e, s = energies(spark, d)
    return iv.dated(iv.flag_impossible(e, s)), s


def daylight(df):
    """06:00 to 18:00 on every day of the readings and the days beside."""
    days = df.select("system_id", F.explode(F.array(F.date_sub("date", 1), "date", F.date_add("date", 1))).alias("date")).distinct()
    start = iv.us(F.col("date").cast("timestamp_ntz"))
    return days.select("system_id", "date", (start + 6 * iv.HOUR_US).alias("rise"), (start + 18 * iv.HOUR_US).alias("set"))


def covered(spark, d):
    df, s = cleaned(spark, d)
    readings, per_day = iv.coverage(df, daylight(df))
    return readings, per_day, s


def day_table(spark, d):
    readings, per_day, s = covered(spark, d)
    return iv.daily(readings, per_day, s)


_COUNTER = "SELECT system_id, ts, round(energy, 4) AS energy, is_reset, long_gap, round(elapsed_h, 6) AS elapsed_h FROM {}"


@query("i01_counter_to_interval", _COUNTER.format("i1"))
def _(spark, d):
    return rounded(rounded(iv.counter_to_interval(feeds.readings(spark, d), "counter_kwh"), "energy", digits=4), "elapsed_h", digits=6)


@query("i02_daily_reset_counter", _COUNTER.format("i2"))
def _(spark, d):
    return rounded(rounded(iv.counter_to_interval(feeds.readings(spark, d), "today_kwh", resets_daily=True), "energy", digits=4), "elapsed_h", digits=6)


@query("i03_add_members", "SELECT system_id, ts, round(CASE WHEN count(energy) = 2 THEN sum(energy) END, 4) AS energy, round(max(CASE WHEN m = 0 THEN elapsed_h END), 6) AS elapsed_h FROM (SELECT *, 0 AS m FROM i1 UNION ALL SELECT *, 1 FROM i2) q GROUP BY 1, 2")
def _(spark, d):
    r = feeds.readings(spark, d)
    parts = iv.counter_to_interval(r, "counter_kwh").withColumn("member", F.lit(0)).unionByName(iv.counter_to_interval(r, "today_kwh", resets_daily=True).withColumn("member", F.lit(1)))
    return rounded(rounded(iv.add_members(parts, 2), "energy", digits=4), "elapsed_h", digits=6)


@query("i04_keep_last", "SELECT * FROM k")
def _(spark, d):
    return iv.keep_last(feeds.readings(spark, d).where("power_kw is not null").select("system_id", "ts", "row_no", "power_kw")).drop("row_no")


@query("i05_sample_hours", "SELECT system_id, ts, round(step_h, 6) AS step_h, round(hours, 6) AS hours FROM e2")
def _(spark, d):
    return rounded(energies(spark, d)[0].select("system_id", "ts", "step_h", "hours"), "step_h", "hours", digits=6)


@query("i06_power_to_energy", "SELECT system_id, ts, round(energy0, 5) AS energy_kwh FROM e3")
def _(spark, d):
    return rounded(energies(spark, d)[0].select("system_id", "ts", "energy_kwh"), "energy_kwh")


@query("i07_step_profile", "SELECT system_id, minutes, count(*) AS days FROM (SELECT system_id, day, round_even(min(step_h) * 60, 0) AS minutes FROM e1 GROUP BY 1, 2) q GROUP BY 1, 2 HAVING count(*) >= 5")
def _(spark, d):
    return iv.step_profile(energies(spark, d)[0])


@query("i08_combine_files", "SELECT system_id, round(median(step_h) * 60, 3) AS minutes, round(median(step_h) * 60, 3) < 1439 AS subdaily FROM (SELECT system_id, day, min(step_h) AS step_h FROM e1 GROUP BY 1, 2) q GROUP BY 1")
def _(spark, d):
    return iv.nominal_minutes(energies(spark, d)[0])


@query("i09_impossible", "SELECT system_id, ts, round(energy_kwh, 5) AS energy_kwh, impossible FROM e5")
def _(spark, d):
    return rounded(cleaned(spark, d)[0].select("system_id", "ts", "energy_kwh", "impossible"), "energy_kwh")


@query("i10_midpoint_date", "SELECT system_id, ts, mid, date FROM e7")
def _(spark, d):
    return cleaned(spark, d)[0].select("system_id", "ts", "mid", "date")


@query("i12_coverage", "SELECT system_id, date, round(coverage, 5) AS coverage FROM cov WHERE coverage > 0")
def _(spark, d):
    return rounded(covered(spark, d)[1].where("coverage > 0"), "coverage")


@query("i13_complete_hours", "SELECT system_id, hour_ts, round(energy_kwh, 5) AS energy_kwh FROM hr WHERE energy_kwh IS NOT NULL")
def _(spark, d):
    return rounded(iv.hourly(covered(spark, d)[0]).where("energy_kwh is not null"), "energy_kwh")


@query("i14_daily_totals", "SELECT system_id, date, round(energy_kwh_raw, 4) AS energy_kwh_raw, n_samples, n_impossible FROM dd")
def _(spark, d):
    return rounded(day_table(spark, d).select("system_id", "date", "energy_kwh_raw", "n_samples", "n_impossible"), "energy_kwh_raw", digits=4)


@query("i15_trimmed_ends", "SELECT system_id, min(date) AS first_day, max(date) AS last_day FROM dd GROUP BY 1")
def _(spark, d):
    return day_table(spark, d).groupBy("system_id").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("i16_quality_flags", "SELECT system_id, date, flag_gap, flag_partial, flag_impossible, valid FROM dd")
def _(spark, d):
    return day_table(spark, d).select("system_id", "date", "flag_gap", "flag_partial", "flag_impossible", "valid")


@query("i17_completeness", f"""SELECT system_id, min(date) AS period_start, max(date) AS period_end, count(*) AS calendar_days, count(*) FILTER (valid) AS valid_days, count(*) FILTER (flag_gap) AS gap_days, count(*) FILTER (flag_partial) AS partial_days, count(*) FILTER (flag_impossible) AS impossible_days, round(100 * avg(valid::INT), 1) AS completeness_pct, any_value(v.impossible_values) AS impossible_values, any_value(c.counter_resets) AS counter_resets, any_value(c.gaps + v.undatable) AS unassignable_gaps
  FROM dd JOIN (SELECT system_id, count(*) FILTER (impossible) AS impossible_values, count(*) FILTER (h1 > {S.straddle_min_hours} AND h0 > {S.straddle_min_hours} AND known) AS undatable FROM (SELECT *, energy_kwh IS NOT NULL AS known FROM e8) q GROUP BY 1) v USING (system_id)
  JOIN (SELECT system_id, count(*) FILTER (is_reset) AS counter_resets, count(*) FILTER (long_gap) AS gaps FROM i1 GROUP BY 1) c USING (system_id) GROUP BY 1""")
def _(spark, d):
    readings, per_day, s = covered(spark, d)
    return iv.completeness(iv.daily(readings, per_day, s), readings, iv.counter_to_interval(feeds.readings(spark, d), "counter_kwh"))


def fleet(spark, d):
    """Systems with readings of every kind beside systems with one reading a day, stamped at midnight, in one frame."""
    fine, sites = energies(spark, d)
    parts = fine.select(F.concat("system_id", F.lit(".csv")).alias("file"), "system_id", "ts", "energy_kwh", "hours", "step_h")
    days = feeds.daily(spark, d).select(F.concat(F.lit("D"), "system_id").alias("system_id"), F.col("date").cast("timestamp_ntz").alias("ts"), "energy_kwh")
    coarse = iv.sample_hours(days).select(F.concat("system_id", F.lit("_daily.csv")).alias("file"), "system_id", "ts", "energy_kwh", "hours", "step_h")
    small = coarse.select("system_id").distinct().withColumn("capacity_kwp", F.lit(5.0))  # bites on some of the feed's days
    return layout.combined(parts.unionByName(coarse)), sites.unionByName(small)


@query("i18_mixed_fleet", f"""SELECT system_id, date, round(energy_kwh_raw, 4) AS energy_kwh_raw, n_samples, round(coverage, 5) AS coverage, flag_gap, flag_partial, flag_impossible, valid, round(CASE WHEN valid THEN energy_kwh_raw END, 4) AS energy_kwh FROM dd
UNION ALL SELECT system_id, date, e, n, CASE WHEN n > 0 THEN 1e0 END, n = 0, false, bad, n > 0 AND NOT bad, CASE WHEN n > 0 AND NOT bad THEN e END
FROM (SELECT *, CASE WHEN NOT over THEN energy_kwh END AS e, CASE WHEN NOT over AND energy_kwh IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n, over OR coalesce(energy_kwh / 5e0 > {S.max_daily_specific_yield} AND NOT over, false) AS bad
  FROM (SELECT 'D' || s.system_id AS system_id, s.date, f.energy_kwh, coalesce(f.energy_kwh < 0 OR f.energy_kwh > 5e0 * 24 * {S.max_capacity_factor}, false) AS over
    FROM (SELECT system_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM feed_daily GROUP BY 1) s LEFT JOIN feed_daily f USING (system_id, date)) q) r""")
def _(spark, d):
    readings, sites = fleet(spark, d)
    marked = iv.dated(iv.flag_impossible(readings, sites))
    found, per_day = iv.coverage(marked, daylight(marked))
    out = iv.daily(found, per_day, sites).select("system_id", "date", "energy_kwh_raw", "n_samples", "coverage", "flag_gap", "flag_partial", "flag_impossible", "valid", "energy_kwh")
    # Sums over readings are rounded; one reading a day is exact.
    several = ~F.startswith("system_id", F.lit("D"))
    return rounded(out.withColumns({c: F.when(several, F.round(c, 4)).otherwise(F.col(c)) for c in ("energy_kwh_raw", "energy_kwh")}), "coverage")
