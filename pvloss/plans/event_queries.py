"""Queries on events, money and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.settings import DEFAULT as S
from ..operators import detect, events, loss_bootstrap, money, reference
from . import chain, feeds, range_queries
from .chain import statement
from .daily_queries import rounded

QUERIES, SQL = {}, {}
STRETCH = ", ".join(repr(float(events.stretch(n, S))) if n > 1 else "1e0" for n in range(1, max(S.days_before, S.days_after) + 1))

MORE = f"""
fault AS (SELECT *, outage OR (flagged AND loss_fraction > {S.deep_fraction}) AS fault FROM fd),
wet AS (SELECT system_id, date, precip_mm, dn - row_number() OVER (PARTITION BY system_id ORDER BY dn) AS island FROM fault WHERE precip_mm >= {S.heavy_rain_mm}),
rain AS (SELECT system_id, min(date) AS start, max(date) AS "end", sum(precip_mm) AS rain_mm, 'natural rain' AS type FROM wet GROUP BY system_id, island),
chosen AS (SELECT system_id, date AS start, date AS "end", CAST(NULL AS DOUBLE) AS rain_mm, type FROM dated
           UNION ALL SELECT * FROM rain WHERE system_id NOT IN (SELECT system_id FROM dated)),
eday AS (SELECT c.start, c."end", c.type, f.*, CASE WHEN f.date < c.start THEN f.date - c.start WHEN f.date > c."end" THEN f.date - c."end" ELSE 0 END AS rel,
                clear AND NOT fault AND ratio IS NOT NULL AS fit
  FROM chosen c JOIN fault f ON f.system_id = c.system_id AND f.date BETWEEN c.start - {S.days_before} AND c."end" + {S.days_after}),
cmp0 AS (SELECT system_id, start, "end", type, count(*) FILTER (fit AND rel < 0) AS n_before, count(*) FILTER (fit AND rel > 0) AS n_after,
    avg(ratio) FILTER (fit AND rel < 0) AS mean_before, avg(ratio) FILTER (fit AND rel > 0) AS mean_after, avg(expected_kwh) AS mean_expected,
    count(*) FILTER (rel <> 0 AND precip_mm >= {S.heavy_rain_mm}) AS other_rain_days FROM eday GROUP BY ALL),
cmp AS (SELECT *, CASE WHEN ok THEN 'ok' ELSE 'too few clear days' END AS status, CASE WHEN ok THEN 100 * (mean_after / mean_before - 1) END AS change_pct,
    CASE WHEN ok THEN (mean_after - mean_before) * mean_expected END AS kwh_per_day
  FROM (SELECT *, n_before >= {S.min_clear_days_each_side} AND n_after >= {S.min_clear_days_each_side} AS ok FROM cmp0) q),
evs AS (SELECT system_id, start, "end", type, side, list(ratio ORDER BY date) AS l FROM (SELECT *, CASE WHEN rel < 0 THEN 'b' ELSE 'a' END AS side FROM eday WHERE fit AND rel <> 0) q GROUP BY ALL),
evd0 AS (SELECT e.*, len(l) AS n, unnest(range({S.samples})) AS rep FROM evs e JOIN cmp USING (system_id, start, "end", type) WHERE status = 'ok'),
evd1 AS (SELECT system_id, start, "end", type, side, rep, n, any_value(m) AS m, avg(l[CAST(floor(CAST('0x' || substr(md5(concat_ws('|', '{S.seed}', system_id, CAST(start AS VARCHAR), side, CAST(rep AS VARCHAR), CAST(i AS VARCHAR))), 1, 12) AS BIGINT) / 281474976710656e0 * n) AS INT) + 1]) AS drawn
  FROM (SELECT *, list_sum(l) / n AS m, unnest(range(n)) AS i FROM evd0) q GROUP BY ALL),
evd AS (SELECT *, m + (drawn - m) * [{STRETCH}][n] AS mean FROM (SELECT system_id, start, "end", type, side, rep, n, m, drawn FROM evd1) q),
evi AS (SELECT system_id, start, "end", type, quantile_cont(change, {(1 - S.confidence) / 2}) AS lo, quantile_cont(change, {1 - (1 - S.confidence) / 2}) AS hi, quantile_cont(gain, {(1 - S.confidence) / 2}) AS glo, quantile_cont(gain, {1 - (1 - S.confidence) / 2}) AS ghi
  FROM (SELECT a.system_id, a.start, a."end", a.type, 100 * (a.mean / b.mean - 1) AS change, (a.mean - b.mean) * c.mean_expected AS gain FROM evd a JOIN evd b ON a.system_id = b.system_id AND a.start = b.start AND a."end" = b."end" AND a.type = b.type AND a.rep = b.rep AND a.side = 'a' AND b.side = 'b'
        JOIN cmp c ON c.system_id = a.system_id AND c.start = a.start AND c."end" = a."end" AND c.type = a.type) q GROUP BY ALL),
lossd AS (SELECT l.*, last_day - first_day + 1 AS period_days, s.tariff, s.cleaning_cost, s.data_label FROM loss l JOIN systems s USING (system_id)),
eco AS (SELECT *, period_days / {S.days_per_month!r}::DOUBLE AS m FROM lossd)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = statement(sql, MORE)
        return f

    return add


def faulty(spark, d):
    """The analysed frame with the fault mask: outages and deep drops."""
    return chain.analysed(spark, d).withColumn("fault", F.col("outage") | (F.col("flagged") & (F.col("loss_fraction") > S.deep_fraction)))


def chosen(spark, d, f=None):
    f = faulty(spark, d) if f is None else f
    return events.chosen_events(feeds.events(spark, d), events.rain_events(f), feeds.systems(spark, d, chain.daily))


@chain.shared
def loss_rows(spark, d):
    f = chain.analysed(spark, d)
    days = f.groupBy("system_id").agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("period_days"))
    return detect.estimate_loss(f).join(days, "system_id")


@chain.shared
def intervals(spark, d):
    """V5's intervals of all chosen events."""
    f = faulty(spark, d)
    return events.event_intervals(f, chosen(spark, d, f))


@chain.shared
def compared(spark, d):
    f = faulty(spark, d)
    return events.compare(f, chosen(spark, d, f))


EVENT = ["system_id", "start", "end", "type"]


def observed(spark, d):
    """The comparison of each event with its interval."""
    return compared(spark, d).join(intervals(spark, d).select(*EVENT, "change_lo", "change_hi", "distinguishable"), EVENT, "left")


@chain.shared
def rivals(spark, d):
    """observed() of the events that may be the clearest of their system, and so of its dataset; only theirs are drawn."""
    rows = events.rivals(compared(spark, d))
    found = events.event_intervals(faulty(spark, d), rows)
    return rows.join(found.select(*EVENT, "change_lo", "change_hi", "distinguishable"), EVENT, "left")


@query("c03_fault_mask", "SELECT system_id, date FROM fault WHERE fault")
def _(spark, d):
    return faulty(spark, d).where("fault").select("system_id", "date")


@query("v01_rain_events", 'SELECT system_id, start, "end", round(rain_mm, 4) AS rain_mm, type FROM rain')
def _(spark, d):
    return rounded(events.rain_events(chain.base(spark, d)), "rain_mm", digits=4)


@query("v02_dated_events", "SELECT system_id, date, type, note FROM dated JOIN systems USING (system_id)")
def _(spark, d):
    return feeds.events(spark, d).join(feeds.systems(spark, d, chain.daily).select("system_id"), "system_id")


@query("v03_chosen_events", 'SELECT system_id, start, "end", round(rain_mm, 4) AS rain_mm, type FROM chosen')
def _(spark, d):
    return rounded(chosen(spark, d, chain.base(spark, d)), "rain_mm", digits=4)


@query("v04_before_after", 'SELECT system_id, start, "end", type, n_before, n_after, round(mean_before, 5) AS mean_before, round(mean_after, 5) AS mean_after, status, round(change_pct, 4) AS change_pct, round(kwh_per_day, 4) AS kwh_per_day FROM cmp')
def _(spark, d):
    r = compared(spark, d).drop("mean_expected", "other_rain_days")
    return rounded(rounded(r, "mean_before", "mean_after"), "change_pct", "kwh_per_day", digits=4)


@query("v05_event_intervals", 'SELECT system_id, start, "end", type, round(lo, 4) AS change_lo, round(hi, 4) AS change_hi, round(glo, 4) AS kwh_lo, round(ghi, 4) AS kwh_hi, lo > 0 OR hi < 0 AS distinguishable FROM evi')
def _(spark, d):
    return rounded(intervals(spark, d), "change_lo", "change_hi", "kwh_lo", "kwh_hi", digits=4)


@query("v06_other_rain", 'SELECT system_id, start, "end", other_rain_days FROM cmp')
def _(spark, d):
    return compared(spark, d).select("system_id", "start", "end", "other_rain_days")


_BEST = """SELECT {0}, start, n_before, n_after FROM (SELECT c.*, s.data_label, row_number() OVER (PARTITION BY {0} ORDER BY least(n_before, n_after) DESC, round(hi - lo, 9), start, system_id) AS n FROM cmp c JOIN evi USING (system_id, start, "end", type) JOIN systems s USING (system_id) WHERE status = 'ok') q WHERE n = 1"""


@query("v07_clearest_event", _BEST.format("system_id"))
def _(spark, d):
    return events.clearest(rivals(spark, d)).select("system_id", "start", "n_before", "n_after")


@query("v08_headline_event", _BEST.format("data_label"))
def _(spark, d):
    r = rivals(spark, d).join(feeds.systems(spark, d, chain.daily).select("system_id", "data_label"), "system_id")
    return events.clearest(r, ["data_label"]).select("data_label", "start", "n_before", "n_after")


@query("p10_event_day", 'SELECT system_id, start, date, CAST(rel AS INT) AS rel, round(ratio, 5) AS ratio FROM eday WHERE fit')
def _(spark, d):
    f = faulty(spark, d)
    return events.event_days(f, chosen(spark, d, f)).where("usable").select("system_id", "start", "date", "rel", F.round("ratio", 5).alias("ratio"))


def ranged_rows(spark, d):
    """Losses with their ranges, by system."""
    rows = loss_rows(spark, d)
    ranges = loss_bootstrap.loss_ranges(range_queries.replicates(spark, d), rows)
    return rows.join(ranges.select("system_id", "lost_lo", "lost_hi", "moderate_lo", "moderate_hi"), "system_id", "left")


@query("e01_money", "SELECT system_id, round(m, 1) AS months, tariff IS NOT NULL AS has_tariff, round_even(lost_kwh * tariff, 0) AS money_lost, round_even(lost_kwh * tariff / m, 0) AS money_lost_per_month FROM eco")
def _(spark, d):
    return money.economics(loss_rows(spark, d), feeds.systems(spark, d, chain.daily)).select("system_id", "months", "has_tariff", "money_lost", "money_lost_per_month")


@query("e01_money_ranges")
def _(spark, d):
    return money.economics(ranged_rows(spark, d), feeds.systems(spark, d, chain.daily)).select("system_id", "money_lost", *money.MONEY_RANGES)


@query("e02_verdict")
def _(spark, d):
    return money.economics(ranged_rows(spark, d), feeds.systems(spark, d, chain.daily)).select("system_id", "verdict")


@query("e03_emissions", "SELECT system_id, round(0.71e0 * lost_kwh, 4) AS emissions_kg FROM eco")
def _(spark, d):
    return rounded(money.emissions(loss_rows(spark, d), 0.71).select("system_id", "emissions_kg"), "emissions_kg", digits=4)


@query("e03_emission_ranges")
def _(spark, d):
    return rounded(money.emissions(ranged_rows(spark, d), 0.71).select("system_id", "emissions_kg", "emissions_kg_lo", "emissions_kg_hi"), "emissions_kg", "emissions_kg_lo", "emissions_kg_hi", digits=4)


@query("p01_portfolio", "SELECT data_label, count(*) AS systems, round(sum(lost_kwh), 4) AS lost_kwh, round(sum(expected_kwh), 4) AS expected_kwh, round(100 * sum(lost_kwh) / sum(expected_kwh), 4) AS loss_pct FROM eco WHERE expected_kwh > 0 GROUP BY 1")
def _(spark, d):
    rows = loss_rows(spark, d).join(feeds.systems(spark, d, chain.daily).select("system_id", "data_label"), "system_id").withColumn("status", F.when(F.col("expected_kwh") > 0, "ok").otherwise("too few clear days"))
    return rounded(money.portfolio(rows), "lost_kwh", "expected_kwh", "loss_pct", digits=4)


@query("p04_most_complete", "SELECT data_label, system_id, completeness_pct FROM (SELECT data_label, system_id, completeness_pct, row_number() OVER (PARTITION BY data_label ORDER BY completeness_pct DESC, system_id) AS n FROM (SELECT system_id, round(100 * avg(valid::INT), 1) AS completeness_pct FROM fb GROUP BY 1) c JOIN systems USING (system_id)) q WHERE n = 1")
def _(spark, d):
    share = chain.base(spark, d).groupBy("system_id").agg(F.round(100 * F.avg(F.col("valid").cast("int")), 1).alias("completeness_pct"))
    return money.most_complete(share.join(feeds.systems(spark, d, chain.daily).select("system_id", "data_label"), "system_id"))


@query("p05_run_quality", f"SELECT f.*, coalesce(b.months, '1,2,3,4,5,6,7,8,9,10,11,12') AS borrowed_months FROM (SELECT system_id, count(*) FILTER (ghi IS NULL) AS days_without_weather, count(*) FILTER (valid AND smooth_ratio IS NULL AND NOT outage) AS not_assessable, count(*) FILTER (flagged AND loss_fraction > {S.deep_fraction}) AS deep_drop_days FROM fd GROUP BY 1) f LEFT JOIN (SELECT system_id, array_to_string(list_filter(range(1, 13), lambda x: NOT list_contains(list(month), x)), ',') AS months FROM monthly WHERE value IS NOT NULL GROUP BY 1) b USING (system_id)")
def _(spark, d):
    f = chain.analysed(spark, d)
    return money.run_quality(f, reference.monthly_reference(f))


@query("p07_headline", f"""SELECT data_label, count(*) AS systems, min(first_day) AS period_start, max(last_day) AS period_end, CAST(round_even(max(last_day - first_day) / {S.days_per_month!r}::DOUBLE, 0) AS BIGINT) AS months,
  CASE WHEN bool_and(subdaily) THEN 'hourly' ELSE 'daily' END AS resolution, string_agg(DISTINCT place, '; ' ORDER BY place) AS locations, min(detection_limit) AS limit_min, max(detection_limit) AS limit_max, string_agg(system_id, ',' ORDER BY system_id) AS system_ids
  FROM (SELECT l.*, n.detection_limit, l.system_id <> 'S2' AS subdaily, format('{{:.2f}}°, {{:.2f}}°', s.latitude, s.longitude) AS place FROM lossd l JOIN noise n USING (system_id) JOIN systems s USING (system_id) WHERE window_days = {S.windows_days[0]}) q GROUP BY 1""")
def _(spark, d):
    f = chain.outages(spark, d)
    ends = f.groupBy("system_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    # S2 counts as a system with daily input.
    systems = feeds.systems(spark, d, chain.daily).select("system_id", "data_label", "latitude", "longitude", F.lit(None).cast("string").alias("location"), (F.col("system_id") != "S2").alias("subdaily"))
    rows = ends.join(detect.noise_profile(f).where(F.col("window_days") == S.windows_days[0]), "system_id").join(systems, "system_id")
    return money.headline(rows)


_MEAN = "CASE WHEN count({0}) OVER w >= 3 THEN avg({0}) OVER w END"


@query("p08_expected_vs_actual", f"SELECT system_id, date, round(a, 4) AS actual, round(e, 4) AS expected, round(CASE WHEN a < e THEN e - a END, 4) AS gap FROM (SELECT system_id, date, {_MEAN.format('energy_kwh')} AS a, {_MEAN.format('expected_kwh')} AS e FROM fc WINDOW w AS (PARTITION BY system_id ORDER BY dn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) q")
def _(spark, d):
    return rounded(money.expected_vs_actual(chain.calibrated(spark, d)), "actual", "expected", "gap", digits=4)


@query("p09_normalised_series", "SELECT system_id, count(clear_ratio) AS points, count(*) FILTER (precip_mm >= 1) AS rain_days, count(*) FILTER (clear_ratio < 0.4) AS below_floor FROM fc GROUP BY 1")
def _(spark, d):
    return money.normalised_series(chain.calibrated(spark, d))


SOURCES = "SELECT * FROM (VALUES (1, 'Public dataset: A', 'S0,S1,S2'), (2, 'Public dataset: B', 'S2,S9')) AS v(source_no, name, ids)"


@query("s08_data_labels", f"SELECT s.system_id, coalesce(l.label, '{money.DEFAULT_LABEL}') AS data_label FROM systems s LEFT JOIN (SELECT arg_min(name, source_no) AS label, system_id FROM (SELECT source_no, name, unnest(string_split(ids, ',')) AS system_id FROM ({SOURCES}) q) r GROUP BY system_id) l USING (system_id)")
def _(spark, d):
    sources = spark.sql(SOURCES).select("source_no", "name", F.split("ids", ",").alias("system_ids"))
    return money.data_labels(sources, feeds.systems(spark, d, chain.daily).select("system_id"))
