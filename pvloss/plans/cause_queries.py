"""Queries on causes, layouts and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import z
from ..functions.settings import DEFAULT as S
from ..operators import causes, frame, layout, validation
from . import chain, event_queries, feeds
from .chain import statement
from .daily_queries import rounded

QUERIES, SQL = {}, {}
MORE = event_queries.MORE + f""",
cuts AS (SELECT system_id, dn FROM fault WHERE precip_mm >= {S.heavy_rain_mm} UNION SELECT system_id, date - DATE '1970-01-01' FROM dated WHERE type = 'cleaning'),
pts0 AS (SELECT f.system_id, f.date, f.dn, f.ratio AS y, coalesce(f.ghi, 0) AS ghi, (SELECT count(*) FROM cuts c WHERE c.system_id = f.system_id AND c.dn <= f.dn) AS part,
         (SELECT max(c.dn) FROM cuts c WHERE c.system_id = f.system_id AND c.dn <= f.dn) AS cut_dn FROM fault f WHERE clear AND NOT fault AND ratio IS NOT NULL),
pts AS (SELECT *, coalesce(cut_dn, min(dn) OVER (PARTITION BY system_id)) AS opens FROM pts0),
ivl0 AS (SELECT *, count(*) OVER w AS n, min(date) OVER w AS first_day, max(date) OVER w AS last_day FROM pts WINDOW w AS (PARTITION BY system_id, part)),
ivl AS (SELECT *, date - first_day AS x FROM ivl0 WHERE n >= {S.soiling_min_points} AND last_day - first_day >= {S.soiling_min_days}),
sen AS (SELECT a.system_id, a.part, median((b.y - a.y) / (b.x - a.x)) AS raw FROM ivl a JOIN ivl b ON a.system_id = b.system_id AND a.part = b.part AND a.x < b.x GROUP BY 1, 2),
slopes AS (SELECT s.*, l.level, l.n, l.first_day, l.last_day, raw / level AS slope FROM sen s JOIN (SELECT system_id, part, median(y) AS level, count(*) AS n, min(first_day) AS first_day, max(last_day) AS last_day FROM ivl GROUP BY 1, 2) l USING (system_id, part)),
soil AS (SELECT system_id, sum(CASE WHEN slope IS NULL THEN 1 ELSE greatest(least(1 + least(slope, 0) * (dn - opens), 1), 0) END * ghi) / sum(ghi) AS sr
  FROM pts LEFT JOIN slopes USING (system_id, part) GROUP BY 1 HAVING count(slope) > 0),
slist AS (SELECT i.system_id, i.part, list_sort(list((j.y - i.y) / (j.x - i.x))) AS l FROM ivl i JOIN ivl j ON i.system_id = j.system_id AND i.part = j.part AND i.x < j.x GROUP BY 1, 2),
ties AS (SELECT system_id, part, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT system_id, part, y, count(*) AS t FROM ivl GROUP BY ALL) q GROUP BY 1, 2),
band0 AS (SELECT system_id, part, slope, level, l, len(l) AS m, {z((1 + S.slope_band) / 2)!r} * sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18e0) AS half FROM slopes JOIN slist USING (system_id, part) JOIN ties USING (system_id, part)),
band AS (SELECT system_id, part, slope, greatest((l[CAST(least(round_even((m + half) / 2, 0), m - 1) AS INT) + 1] - l[CAST(greatest(round_even((m - half) / 2, 0) - 1, 0) AS INT) + 1]) / 2 / level, 1e-9) AS sd FROM band0),
sdraw0 AS (SELECT *, concat_ws('|', '{S.seed}', system_id, CAST(part AS VARCHAR), CAST(replicate AS VARCHAR)) AS id FROM (SELECT *, unnest(range({S.soiling_reps})) AS replicate FROM band) q),
sdraw AS (SELECT system_id, part, replicate, slope + sd * sqrt(-2e0 * ln(1e0 - CAST('0x' || substr(md5(id || '|a'), 1, 12) AS BIGINT) / 281474976710656e0)) * cos(2e0 * pi() * (CAST('0x' || substr(md5(id || '|b'), 1, 12) AS BIGINT) / 281474976710656e0)) AS g FROM sdraw0),
srep AS (SELECT system_id, replicate, 1 - sum((1 - greatest(least(1 + least(g, 0) * (dn - opens), 1), 0)) * ghi) / any_value(total) AS sr
  FROM pts JOIN sdraw USING (system_id, part) JOIN (SELECT system_id, sum(ghi) AS total FROM pts GROUP BY 1) t USING (system_id) GROUP BY 1, 2),
srange AS (SELECT system_id, 100 * (1 - quantile_cont(sr, 0.975)) AS loss_lo, 100 * (1 - quantile_cont(sr, 0.025)) AS loss_hi FROM srep GROUP BY 1),
yp AS (SELECT a.system_id, a.dn, 100 * (b.pi / a.pi - 1) AS change, row_number() OVER (PARTITION BY a.system_id ORDER BY a.dn) - 1 AS idx FROM fault a JOIN fault b ON a.system_id = b.system_id AND b.dn = a.dn + 365
  WHERE a.clear AND NOT a.fault AND b.clear AND NOT b.fault),
yoy AS (SELECT system_id, count(*) AS pairs, median(change) AS m FROM yp GROUP BY 1),
sb AS (SELECT *, CAST(hour_ts AS DATE) AS date, CAST(hour(hour_ts) AS INT) AS hour, CAST(month(hour_ts) AS INT) AS month, actual_kwh / model_kwh AS r FROM feed_hourly h WHERE EXISTS (SELECT 1 FROM feed_clear c WHERE c.system_id = h.system_id AND c.date = CAST(h.hour_ts AS DATE) AND c.clear AND NOT c.fault) AND elevation >= {S.shading_min_elevation_deg} AND model_kwh > 0 AND actual_kwh IS NOT NULL),
sh0 AS (SELECT *, row_number() OVER (PARTITION BY system_id, date ORDER BY model_kwh DESC, hour) AS k FROM sb),
sh AS (SELECT *, r / median(CASE WHEN k <= {S.midday_hours} THEN r END) OVER (PARTITION BY system_id, date) AS shape FROM sh0),
clk0 AS (SELECT system_id, date, month, sum(actual_kwh * (hour + 0.5)) / sum(actual_kwh) - sum(model_kwh * (hour + 0.5)) / sum(model_kwh) AS h FROM sb GROUP BY 1, 2, 3),
clk AS (SELECT system_id, 60 * median(h) AS o, 60 * median(h) FILTER (month BETWEEN 5 AND 8) AS su, 60 * median(h) FILTER (month >= 11 OR month <= 2) AS wi FROM clk0 GROUP BY 1),
clk1 AS (SELECT *, coalesce(abs(o) <= {S.clock_max_offset_minutes} AND abs(su - wi) <= {S.clock_max_seasonal_minutes}, false) AS ok FROM clk),
dip AS (SELECT system_id, month, hour, count(*) AS days, median(shape) AS ms, avg((shape < {1 - S.dip_fraction})::INT) AS share FROM sh WHERE shape IS NOT NULL GROUP BY 1, 2, 3),
dip1 AS (SELECT *, days >= {S.shading_min_clear_days} AND share >= {S.dip_min_share_of_days} AS is_dip FROM dip),
sym AS (SELECT system_id, median(shape) FILTER (hour < peak) AS am, median(shape) FILTER (hour > peak) AS pm FROM sh JOIN (SELECT system_id, date, arg_min(hour, (-model_kwh, hour)) AS peak FROM sb GROUP BY 1, 2) p USING (system_id, date) WHERE elevation < {S.shading_min_elevation_deg + S.symmetry_band_deg} GROUP BY 1),
xd AS (SELECT f.system_id, r.run, f.date, f.dn, f.ratio, coalesce(f.ghi, 0) AS ghi, row_number() OVER (PARTITION BY f.system_id, r.run ORDER BY f.dn) AS p,
  row_number() OVER (PARTITION BY f.system_id, r.run ORDER BY CAST('0x' || substr(md5(concat_ws('|', '{S.seed}', f.system_id, CAST(r.run AS VARCHAR), CAST(f.date AS VARCHAR))), 1, 12) AS BIGINT), f.dn) AS q
  FROM fault f CROSS JOIN (SELECT unnest(range({S.soiling_shuffle_runs})) AS run) r WHERE clear AND NOT fault AND ratio IS NOT NULL),
xpts0 AS (SELECT a.system_id, a.run, a.date, a.dn, b.ratio AS y, a.ghi, o.part, o.cut_dn FROM xd a JOIN xd b ON a.system_id = b.system_id AND a.run = b.run AND a.p = b.q JOIN pts0 o ON o.system_id = a.system_id AND o.dn = a.dn),
xpts AS (SELECT *, coalesce(cut_dn, min(dn) OVER (PARTITION BY system_id)) AS opens FROM xpts0),
xivl0 AS (SELECT *, count(*) OVER w AS n, min(date) OVER w AS first_day, max(date) OVER w AS last_day FROM xpts WINDOW w AS (PARTITION BY system_id, run, part)),
xivl AS (SELECT *, date - first_day AS x FROM xivl0 WHERE n >= {S.soiling_min_points} AND last_day - first_day >= {S.soiling_min_days}),
xsen AS (SELECT a.system_id, a.run, a.part, median((b.y - a.y) / (b.x - a.x)) AS raw FROM xivl a JOIN xivl b ON a.system_id = b.system_id AND a.run = b.run AND a.part = b.part AND a.x < b.x GROUP BY 1, 2, 3),
xslopes AS (SELECT s.*, raw / level AS slope FROM xsen s JOIN (SELECT system_id, run, part, median(y) AS level FROM xivl GROUP BY 1, 2, 3) l USING (system_id, run, part)),
xsoil AS (SELECT system_id, run, sum(CASE WHEN slope IS NULL THEN 1 ELSE greatest(least(1 + least(slope, 0) * (dn - opens), 1), 0) END * ghi) / sum(ghi) AS sr
  FROM xpts LEFT JOIN xslopes USING (system_id, run, part) GROUP BY 1, 2 HAVING count(slope) > 0),
lng AS (SELECT system_id AS file, ts, row_no, unnest(['E-Total (kWh)__12', 'E-Today (kWh)__13', 'AC Power (W)__14', 'dc_power__15']) AS "column", unnest([counter_kwh, today_kwh, power_kw, power_kw]) AS value FROM feed_readings),
st AS (SELECT *, lag(value) OVER (PARTITION BY file, "column" ORDER BY ts, row_no) AS p FROM lng WHERE value IS NOT NULL),
mag AS (SELECT m.*, d.daily_max FROM (SELECT file, "column", (arg_max(value, (ts, row_no)) FILTER (value IS NOT NULL) - arg_min(value, (ts, row_no)) FILTER (value IS NOT NULL)) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10, 1) AS counter_per_day,
    sum(value) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10, 1) AS sum_per_day, quantile_cont(value, {S.unit_peak_quantile}) AS peak FROM lng GROUP BY 1, 2) m
  JOIN (SELECT file, "column", avg(m) AS daily_max FROM (SELECT file, "column", CAST(ts AS DATE) AS d, max(value) AS m FROM lng WHERE value IS NOT NULL GROUP BY 1, 2, 3) q GROUP BY 1, 2) d USING (file, "column"))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = statement(sql, MORE)
        return f

    return add


def long_readings(spark, d):
    r = feeds.readings(spark, d)
    names = {"counter_kwh": "E-Total (kWh)__12", "today_kwh": "E-Today (kWh)__13", "power_kw": "AC Power (W)__14", "dc": "dc_power__15"}
    wide = r.withColumn("dc", F.col("power_kw")).select(F.col("system_id").alias("file"), "ts", "row_no", *[F.col(c).alias(n) for c, n in names.items()])
    return wide.unpivot(["file", "ts", "row_no"], [f"`{n}`" for n in names.values()], "column", "value")


@chain.shared
def points(spark, d):
    """The clear days with the interval between cleanings that they lie in."""
    f = event_queries.faulty(spark, d)
    return causes.soiling_points(f, causes.cleaning_dates(f, feeds.events(spark, d)))


@chain.shared
def slopes(spark, d):
    """The slope of each usable interval."""
    return causes.theil_sen(points(spark, d).where("usable"))


@chain.shared
def soiling_draws(spark, d):
    return causes.soiling_draws(points(spark, d), slopes(spark, d))


@chain.shared
def nulls(spark, d):
    f = event_queries.faulty(spark, d)
    return causes.shuffled_losses(f, causes.cleaning_dates(f, feeds.events(spark, d)))


@query("c01_runs", 'SELECT system_id, min(date) AS start, max(date) AS "end", count(*) AS days FROM (SELECT system_id, date, dn - row_number() OVER (PARTITION BY system_id ORDER BY dn) AS g FROM fo WHERE outage) q GROUP BY system_id, g')
def _(spark, d):
    return causes.runs(chain.outages(spark, d), "outage")


@query("c02_outage_evidence", f"SELECT system_id, count(*) FILTER (outage) AS outage_days, count(*) FILTER (fault AND NOT outage) AS deep_days, any_value(g.gaps) AS gap_days, round(median(smooth_ratio) FILTER (fault AND NOT outage), 5) AS deep_level, count(*) FILTER (outage AND t2m_c < {S.cold_below_c}) AS cold_outage_days, CASE WHEN bool_or(fault) THEN 'indicated' ELSE 'not indicated' END AS status FROM fault JOIN (SELECT s.system_id, count(*) - count(f.date) AS gaps FROM spine s LEFT JOIN feed_daily f USING (system_id, date) GROUP BY 1) g USING (system_id) GROUP BY 1")
def _(spark, d):
    days = frame.on_calendar(feeds.daily(spark, d).select("system_id", "date", "n_samples", "valid")).withColumn("flag_gap", F.col("n_samples").isNull())
    return rounded(causes.outage_evidence(event_queries.faulty(spark, d), days), "deep_level")


@query("c04_soiling_intervals", "SELECT system_id, first_day, last_day, count(*) AS n FROM ivl GROUP BY ALL")
def _(spark, d):
    return points(spark, d).where("usable").groupBy("system_id", "first_day", "last_day").agg(F.count("*").alias("n"))


@query("c05_theil_sen", "SELECT system_id, first_day, n, round(slope, 7) AS slope, round(level, 6) AS level FROM slopes")
def _(spark, d):
    return slopes(spark, d).select("system_id", "first_day", "n", F.round("slope", 7).alias("slope"), F.round("level", 6).alias("level"))


@query("c06_soiling_ratio", "SELECT system_id, round(sr, 6) AS soiling_ratio, round(100 * (1 - sr), 4) AS soiling_loss_pct FROM soil")
def _(spark, d):
    r = causes.soiling_ratio(points(spark, d), slopes(spark, d))
    return r.select("system_id", F.round("soiling_ratio", 6).alias("soiling_ratio"), F.round("soiling_loss_pct", 4).alias("soiling_loss_pct"))


@query("c07_soiling_range", "SELECT system_id, round(loss_lo, 4) AS loss_lo, round(loss_hi, 4) AS loss_hi FROM srange")
def _(spark, d):
    return rounded(causes.soiling_range(soiling_draws(spark, d)), "loss_lo", "loss_hi", digits=4)


@query("c08_shuffled_losses", "SELECT system_id, CAST(run AS INT) AS run, round(100 * (1 - sr), 4) AS soiling_loss_pct FROM xsoil")
def _(spark, d):
    return rounded(nulls(spark, d), "soiling_loss_pct", digits=4)


@query("c09_soiling_status", f"""SELECT system_id, clear_days, loss_lo, round(floor_pct, 4) AS floor_pct, CASE WHEN clear_days < {S.soiling_min_clear_days} OR loss_lo IS NULL THEN 'insufficient data' WHEN loss_lo > floor_pct THEN 'indicated' ELSE 'not indicated' END AS status, coalesce(tested, 0) AS tested, coalesce(rises, 0) AS rises
  FROM (SELECT system_id, count(*) AS clear_days FROM pts GROUP BY 1) p LEFT JOIN (SELECT system_id, round(loss_lo, 2) AS loss_lo FROM srange) r USING (system_id)
  JOIN (SELECT s.system_id, greatest({S.soiling_min_loss_pct}e0, max(100 * (1 - sr))) AS floor_pct FROM systems s LEFT JOIN xsoil x USING (system_id) GROUP BY 1) n USING (system_id)
  LEFT JOIN (SELECT system_id, count(*) AS tested, count(*) FILTER (lo > 0 AND change_pct > 0) AS rises FROM cmp JOIN evi USING (system_id, start, "end", type) GROUP BY 1) e USING (system_id)""")
def _(spark, d):
    seen = event_queries.observed(spark, d).where("status = 'ok'")
    r = causes.soiling_status(points(spark, d), causes.soiling_range(soiling_draws(spark, d)), events=seen, nulls=nulls(spark, d))
    return rounded(r, "floor_pct", digits=4)


_YU = f"CAST('0x' || substr(md5(concat_ws('|', '{S.seed}', system_id, CAST(replicate AS VARCHAR), CAST(block_no AS VARCHAR))), 1, 12) AS BIGINT) / 281474976710656e0"


@query("c11_year_on_year_range", f"""SELECT system_id, round(lo, 4) AS change_lo, round(hi, 4) AS change_hi, CASE WHEN hi < 0 THEN 'indicated' ELSE 'not indicated' END AS status FROM (
  SELECT system_id, quantile_cont(med, 0.025) AS lo, quantile_cont(med, 0.975) AS hi FROM (
    SELECT b.system_id, b.replicate, median(y.change) AS med FROM (
      SELECT *, start + o AS idx, block_no * b + o AS place FROM (SELECT *, CAST(floor({_YU} * (m - b + 1)) AS INT) AS start, unnest(range(b)) AS o FROM (
        SELECT *, unnest(range(CAST(ceil(m::DOUBLE / b) AS BIGINT))) AS block_no FROM (
          SELECT y.system_id, pairs AS m, least({S.degradation_block_days}, pairs) AS b, unnest(range({S.samples})) AS replicate FROM yoy y JOIN (SELECT system_id, (max(date) - min(date)) / 365.25e0 AS years FROM fault GROUP BY 1) p USING (system_id)
          WHERE pairs >= {S.degradation_min_pairs} AND years > {S.degradation_min_years}) q) r) s) b
    JOIN yp y ON y.system_id = b.system_id AND y.idx = b.idx WHERE place < m GROUP BY 1, 2) t GROUP BY 1) u""")
def _(spark, d):
    return rounded(causes.year_on_year_range(event_queries.faulty(spark, d)), "change_lo", "change_hi", digits=4)


@query("c10_year_on_year", "SELECT s.system_id, coalesce(pairs, 0) AS pairs, round(CASE WHEN ok THEN m END, 4) AS change_pct_per_year, CASE WHEN ok THEN 'ok' ELSE 'insufficient data' END AS status FROM (SELECT p.system_id, y.pairs, y.m, coalesce(y.pairs >= 30 AND p.years > 2, false) AS ok FROM (SELECT system_id, (max(date) - min(date)) / 365.25e0 AS years FROM fault GROUP BY 1) p LEFT JOIN yoy y USING (system_id)) s")
def _(spark, d):
    return rounded(causes.year_on_year(event_queries.faulty(spark, d)), "change_pct_per_year", digits=4)


def shading(spark, d):
    h = feeds.hourly(spark, d)
    return causes.shading_base(h.select("system_id", "hour_ts", "actual_kwh"), h.select("system_id", "hour_ts", "elevation", "model_kwh"), feeds.clear_days(spark, d))


def shaped(spark, d):
    return causes.daily_shape(shading(spark, d))


@query("c12_shading_base", "SELECT system_id, date, hour, round(r, 5) AS r FROM sb")
def _(spark, d):
    return rounded(shading(spark, d).select("system_id", "date", "hour", "r"), "r")


@query("c13_daily_shape", "SELECT system_id, date, hour, round(shape, 5) AS shape FROM sh")
def _(spark, d):
    return rounded(shaped(spark, d).select("system_id", "date", "hour", "shape"), "shape")


@query("c14_clock_check", "SELECT system_id, round(o, 4) AS offset_min, round(su, 4) AS summer_min, round(wi, 4) AS winter_min, ok AS clock_ok FROM clk1")
def _(spark, d):
    return rounded(causes.clock_check(shading(spark, d)), "offset_min", "summer_min", "winter_min", digits=4)


@query("c15_recurring_dips", "SELECT system_id, month, hour, days, round(ms, 5) AS median_shape, round(share, 5) AS dip_share, is_dip FROM dip1")
def _(spark, d):
    return rounded(causes.recurring_dips(shaped(spark, d)), "median_shape", "dip_share")


@query("c15_dip_hours", "SELECT system_id, hour, array_to_string(list(month ORDER BY month), ',') AS months, round(100 * (1 - median(ms)), 4) AS dip_pct FROM dip1 WHERE is_dip GROUP BY 1, 2")
def _(spark, d):
    return rounded(causes.dip_hours(causes.recurring_dips(shaped(spark, d))).withColumn("months", F.array_join("months", ",")), "dip_pct", digits=4)


@query("c16_symmetry", f"SELECT system_id, round(am, 5) AS morning, round(pm, 5) AS afternoon, round(am - pm, 5) AS difference, coalesce(abs(am - pm) >= {S.symmetry_min_difference}, false) AS indicated FROM sym")
def _(spark, d):
    return rounded(causes.symmetry(shaped(spark, d)), "morning", "afternoon", "difference")


@query("c16_shading_status", f"""SELECT system_id, status, round(o, 4) AS offset_min, round(su, 4) AS summer_min, round(wi, 4) AS winter_min, CASE WHEN status LIKE '%indicated' THEN dips END AS dips,
  CASE WHEN status LIKE '%indicated' AND dips > 0 THEN side END AS side, CASE WHEN status LIKE '%indicated' AND dips > 0 THEN round(am, 5) END AS morning, CASE WHEN status LIKE '%indicated' AND dips > 0 THEN round(pm, 5) END AS afternoon FROM (
  SELECT s.system_id, c.o, c.su, c.wi, k.dips, m.am, m.pm, CASE WHEN last_hour < 12 THEN 'morning' WHEN first_hour >= 12 THEN 'afternoon' ELSE 'both ends of the day' END AS side,
    CASE WHEN s.system_id = 'S3' THEN 'cannot be assessed' WHEN k.dips IS NULL THEN 'insufficient data' WHEN NOT c.ok THEN 'cannot be assessed' WHEN k.dips > 0 AND abs(am - pm) >= {S.symmetry_min_difference} THEN 'indicated' ELSE 'not indicated' END AS status
  FROM (SELECT DISTINCT system_id FROM feed_clear UNION SELECT 'none') s LEFT JOIN clk1 c USING (system_id) LEFT JOIN sym m USING (system_id)
  LEFT JOIN (SELECT system_id, count(*) FILTER (is_dip) AS dips, min(hour) FILTER (is_dip) AS first_hour, max(hour) FILTER (is_dip) AS last_hour FROM dip1 GROUP BY 1) k USING (system_id)) q""")
def _(spark, d):
    """S3 counts as a system with daily input; one system has no hours at all."""
    systems = feeds.clear_days(spark, d).select("system_id").distinct().unionByName(spark.range(1).select(F.lit("none").alias("system_id"))).withColumn("subdaily", F.col("system_id") != "S3")
    return rounded(rounded(causes.shading_status(systems, shaped(spark, d)), "morning", "afternoon"), "offset_min", "summer_min", "winter_min", digits=4)


@query("l01_base_name", """SELECT DISTINCT "column", regexp_replace(lower(trim("column")), '__\\d+$', '') AS base FROM lng""")
def _(spark, d):
    return long_readings(spark, d).select("column", layout.base_name(F.col("column")).alias("base")).distinct()


# The patterns that names of energy and power columns must match for the same columns to be found.
_ENERGY, _DC = "kwh|energy|yield|generation|e_total|etotal|e_day", "(^|_)dc(_|$)"
_POWER, _NOT_POWER = "power|(^|_)p_?ac|(^|_)kw($|_|ac)", "factor|kwh"


@query("l04_candidates", f"""SELECT "column", regexp_matches(b, '{_ENERGY}') AND NOT regexp_matches(b, '{_DC}') AS energy_like, regexp_matches(b, '{_POWER}') AND NOT regexp_matches(b, '{_NOT_POWER}') AND NOT regexp_matches(b, '{_DC}') AS power_like FROM (SELECT DISTINCT "column", regexp_replace(lower(trim("column")), '__\\d+$', '') AS b FROM lng) q""")
def _(spark, d):
    return long_readings(spark, d).select("column").distinct().select("column", layout.energy_like(F.col("column")).alias("energy_like"), layout.power_like(F.col("column")).alias("power_like"))


@query("l05_nominal_step", "SELECT file, round(coalesce(median(s) FILTER (s > 0), 1440), 6) AS minutes FROM (SELECT system_id AS file, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY system_id ORDER BY ts))) / 6e7 AS s FROM feed_readings) q GROUP BY 1")
def _(spark, d):
    return rounded(layout.nominal_step(feeds.readings(spark, d).withColumnRenamed("system_id", "file")), "minutes", digits=6)


@query("l06_lifetime_counters", f"""SELECT file, "column", count(*) AS n, round(avg((value - p >= 0)::INT), 6) AS rising_share, count(*) >= 10 AND coalesce(avg((value - p >= 0)::INT) > {S.counter_min_rising_share}, false) AND arg_max(value, (ts, row_no)) > arg_min(value, (ts, row_no)) AS is_counter FROM st GROUP BY 1, 2""")
def _(spark, d):
    return rounded(layout.lifetime_counters(long_readings(spark, d)).drop("first", "last"), "rising_share", digits=6)


@query("l07_daily_reset_counters", f"""SELECT file, "column", round(drops::DOUBLE / days, 6) AS drops_per_day, round(restart, 6) AS restart, n >= 20 AND days >= 3 AND drops > 0 AND rising >= {S.daily_reset_min_rising_share} AND drops::DOUBLE / days BETWEEN 0.5 AND 1.5 AND coalesce(restart <= {S.daily_reset_max_restart}, false) AS resets_daily FROM (SELECT file, "column", count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, avg((value - p >= 0)::INT) AS rising, count(*) FILTER (value < p) AS drops, median(value / p) FILTER (value < p AND p > 0) AS restart FROM st GROUP BY 1, 2) q""")
def _(spark, d):
    return rounded(layout.daily_reset_counters(long_readings(spark, d)).select("file", "column", "drops_per_day", "restart", "resets_daily"), "drops_per_day", "restart", digits=6)


_UNIT = "arg_min(u, (abs(ln(greatest(daily_max * k, 1e-12) / 40e0 / sqrt(0.3e0 * 9e0))), i))"


@query("l08_pick_unit", f"""SELECT file, "column", {_UNIT} AS unit, {_UNIT.replace('arg_min(u', 'arg_min(k')} AS scale FROM mag CROSS JOIN (VALUES ('kWh', 1e0, 0), ('Wh', 1e-3, 1), ('MWh', 1e3, 2)) o(u, k, i) GROUP BY 1, 2""")
def _(spark, d):
    m = layout.magnitudes(long_readings(spark, d))
    return layout.pick_unit(m, "daily_max", F.lit(40.0), S.plausible_daily_yield).select("file", "column", "unit", "scale")


@query("l09_magnitudes", """SELECT file, "column", round(counter_per_day, 4) AS counter_per_day, round(sum_per_day, 4) AS sum_per_day, round(peak, 4) AS peak, round(daily_max, 4) AS daily_max FROM mag""")
def _(spark, d):
    return rounded(layout.magnitudes(long_readings(spark, d)), "counter_per_day", "sum_per_day", "peak", "daily_max", digits=4)


X01 = f"""SELECT system_id, date AS start, e AS "end", round(fs, 6) AS flagged_share FROM (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY round(fs, 9), round(off, 9), date) AS k FROM (
  SELECT system_id, date, row_number() OVER (PARTITION BY system_id ORDER BY dn) AS rn, count(*) OVER w AS n, max(date) OVER w AS e, sum(outage::INT) OVER w AS o, avg(valid::INT) OVER w AS vs, avg(clear::INT) OVER w AS cs, avg(flagged::INT) OVER w AS fs, avg(abs(smooth_ratio - 1)) OVER w AS off
  FROM fd WINDOW w AS (PARTITION BY system_id ORDER BY dn ROWS BETWEEN CURRENT ROW AND {S.stretch_days - 1} FOLLOWING)) q
  WHERE n = {S.stretch_days} AND (rn - 1) % {S.stretch_step_days} = 0 AND o = 0 AND vs >= {S.stretch_min_valid_share} AND cs >= {S.stretch_min_clear_share}) r WHERE k = 1"""


@query("x01_clean_stretch", X01)
def _(spark, d):
    return rounded(validation.clean_stretch(chain.analysed(spark, d)), "flagged_share", digits=6)


@query("x02_inject_ramp", f"""SELECT system_id, round(sum(energy_kwh * (1 - factor)), 4) AS injected_kwh, count(*) FILTER (factor < 1) AS ramp_days FROM (SELECT f.system_id, f.energy_kwh, CASE WHEN t >= 0 AND t < {S.ramp_days} THEN 1 - {S.ramp_fraction} * (t + 1) / {S.ramp_days}e0 ELSE 1e0 END AS factor FROM (SELECT f.*, f.date - s.start - {S.ramp_offset_days} AS t FROM fd f JOIN ({{X01}}) s ON s.system_id = f.system_id AND f.date BETWEEN s.start AND s."end") f) q GROUP BY 1""".replace("{X01}", X01))
def _(spark, d):
    f = chain.analysed(spark, d)
    got = validation.inject_ramp(f, validation.clean_stretch(f))
    return got.groupBy("system_id").agg(F.round(F.sum("lost_kwh"), 4).alias("injected_kwh"), F.count_if(F.col("factor") < 1).alias("ramp_days"))
