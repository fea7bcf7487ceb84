"""Queries on replicates, readers and writers. Files go to the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import fresh
from ..functions.settings import DEFAULT as S
from ..operators import bootstrap, causes, detect, events, frame, intervals, loss_bootstrap, money, validation
from ..sources import files
from . import cause_queries, chain, event_queries, feeds, range_queries
from .chain import statement
from .daily_queries import rounded

QUERIES, SQL = {}, {}
_U = f"CAST('0x' || substr(md5(concat_ws('|', '{S.seed}', system_id, CAST(replicate AS VARCHAR), CAST(block_no AS VARCHAR))), 1, 12) AS BIGINT) / 281474976710656e0"
MORE = event_queries.MORE + f""",
dl AS (SELECT system_id, date, dn, expected_kwh * loss_fraction AS lost FROM fd WHERE valid AND expected_kwh IS NOT NULL AND NOT outage),
dn0 AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY dn) - 1 AS idx FROM dl),
bs AS (SELECT system_id, m, least({S.block_days}, m) AS b, unnest(range({S.samples})) AS replicate FROM (SELECT system_id, count(*) AS m FROM dl GROUP BY 1) q),
bb AS (SELECT *, unnest(range(CAST(ceil(m::DOUBLE / b) AS BIGINT))) AS block_no FROM bs),
bd AS (SELECT *, CAST(floor({_U} * (m - b + 1)) AS INT) AS start, unnest(range(b)) AS o FROM bb),
bi AS (SELECT system_id, CAST(replicate AS INT) AS replicate, CAST(block_no * b + o AS INT) AS place, CAST(start + o AS INT) AS idx FROM bd WHERE block_no * b + o < m),
rep AS (SELECT system_id, replicate, sum(lost) AS lost FROM bi JOIN dn0 USING (system_id, idx) GROUP BY 1, 2),
bp0 AS (SELECT system_id, dn, expected_kwh AS expected, CASE WHEN outage THEN 0 ELSE expected_kwh * loss_fraction END AS held, CASE WHEN outage THEN coalesce(greatest(expected_kwh - energy_kwh, 0), 0) ELSE 0 END AS gone, loss_fraction > {S.deep_fraction} AS is_deep FROM fd WHERE valid AND expected_kwh IS NOT NULL),
bp AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY dn) - 1 AS idx FROM bp0),
bb1 AS (SELECT *, unnest(range(CAST(ceil(m::DOUBLE / b) AS BIGINT))) AS block_no FROM (SELECT system_id, m, least({S.block_days}, m) AS b, unnest(range({S.samples})) AS replicate FROM (SELECT system_id, count(*) AS m FROM bp GROUP BY 1) q) r),
bd1 AS (SELECT *, CAST(floor({_U} * (m - b + 1)) AS INT) AS start, unnest(range(b)) AS o FROM bb1),
brep AS (SELECT d.system_id, d.replicate, sum(held + gone) AS lost, sum(CASE WHEN is_deep THEN 0 ELSE held END) AS moderate, sum(expected) AS expected FROM bd1 d JOIN bp ON bp.system_id = d.system_id AND bp.idx = d.start + d.o WHERE block_no * b + o < m GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = statement(sql, MORE)
        return f

    return add


def daily_lost(spark, d):
    f = chain.analysed(spark, d).where("valid and expected_kwh is not null and not outage")
    return f.select("system_id", "date", (F.col("expected_kwh") * F.col("loss_fraction")).alias("lost"))


def replicates(spark, d):
    return bootstrap.resampled_totals(daily_lost(spark, d), "lost", S.samples)


def loss_status(spark, d):
    return event_queries.loss_rows(spark, d).withColumn("status", F.when(F.col("expected_kwh") > 0, "ok").otherwise("too few clear days"))


def portfolio_ranges(spark, d, replicates):
    r = money.portfolio_ranges(replicates, loss_status(spark, d), feeds.systems(spark, d, chain.daily))
    return rounded(r, "lost_kwh", "expected_kwh", "lost_lo", "lost_hi", "money_lo", "money_hi", digits=3).withColumns({c: F.round(c, 4) for c in ("loss_pct", "loss_pct_lo", "loss_pct_hi")})


@chain.shared
def block_replicates(spark, d):
    return bootstrap.block_replicates(chain.analysed(spark, d))


@query("d10_block_indices", "SELECT system_id, replicate, count(*) AS draws, sum(idx) AS places, sum(place * idx) AS in_order FROM bi GROUP BY 1, 2")
def _(spark, d):
    """The draws of every replicate, as sums over its places."""
    return bootstrap.block_index_sums(daily_lost(spark, d).groupBy("system_id").agg(F.count("*").alias("m")), S.samples, S.block_days)


@query("d11_percentile_interval", "SELECT system_id, round(quantile_cont(lost, 0.025), 3) AS lo, round(quantile_cont(lost, 0.975), 3) AS hi FROM rep GROUP BY 1")
def _(spark, d):
    return rounded(money.percentile_interval(replicates(spark, d), ["system_id"], "lost"), "lo", "hi", digits=3)


@query("p02_portfolio_range")
def _(spark, d):
    r = portfolio_ranges(spark, d, range_queries.replicates(spark, d))
    return r.select("data_label", "systems", "lost_kwh", F.col("lost_lo").alias("lo"), F.col("lost_hi").alias("hi"), "loss_pct", "loss_pct_lo", "loss_pct_hi")


@query("p03_portfolio_money")
def _(spark, d):
    """The money of every replicate, of datasets whose systems that are ok all have replicates."""
    systems = feeds.systems(spark, d, chain.daily)
    ok = event_queries.loss_rows(spark, d).where("expected_kwh > 0").select("system_id")
    bare = ok.join(range_queries.replicates(spark, d).select("system_id").distinct(), "system_id", "left_anti")
    whole = systems.join(systems.join(bare, "system_id").select("data_label").distinct(), "data_label", "left_anti")
    return money.portfolio_replicates(range_queries.replicates(spark, d), whole, tariff=True).select("data_label", "replicate", F.round("lost", 3).alias("money"))


@query("p03_money_range")
def _(spark, d):
    return portfolio_ranges(spark, d, range_queries.replicates(spark, d)).select("data_label", "money_lost", "money_lo", "money_hi")


_PORTFOLIO = f"""(SELECT t.data_label, systems, round(t.lost, 3) AS lost_kwh, round(t.expected, 3) AS expected_kwh, round(100 * t.lost / t.expected, 4) AS loss_pct, money AS money_lost,
  round(CASE WHEN n = systems THEN least(llo, t.lost) END, 3) AS lost_lo, round(CASE WHEN n = systems THEN greatest(lhi, t.lost) END, 3) AS lost_hi,
  round(CASE WHEN n = systems THEN least(plo, 100 * t.lost / t.expected) END, 4) AS loss_pct_lo, round(CASE WHEN n = systems THEN greatest(phi, 100 * t.lost / t.expected) END, 4) AS loss_pct_hi,
  round(CASE WHEN n = systems AND money IS NOT NULL THEN least(mlo, money) END, 3) AS money_lo, round(CASE WHEN n = systems AND money IS NOT NULL THEN greatest(mhi, money) END, 3) AS money_hi
  FROM (SELECT data_label, count(*) AS systems, sum(lost_kwh) AS lost, sum(expected_kwh) AS expected, CASE WHEN bool_and(tariff IS NOT NULL) THEN sum(round_even(lost_kwh * tariff, 0)) END AS money FROM eco WHERE expected_kwh > 0 GROUP BY 1) t
  LEFT JOIN (SELECT data_label, min(n) AS n, quantile_cont(lost, 0.025) AS llo, quantile_cont(lost, 0.975) AS lhi, quantile_cont(100 * lost / expected, 0.025) AS plo, quantile_cont(100 * lost / expected, 0.975) AS phi, quantile_cont(money, 0.025) AS mlo, quantile_cont(money, 0.975) AS mhi
    FROM (SELECT data_label, replicate, count(*) AS n, sum(b.lost) AS lost, sum(b.expected) AS expected, sum(b.lost * tariff) AS money FROM brep b JOIN eco USING (system_id) WHERE eco.expected_kwh > 0 GROUP BY 1, 2) r GROUP BY 1) q USING (data_label))"""


@query("p02_block_range", f"SELECT data_label, systems, lost_kwh, lost_lo, lost_hi, loss_pct, loss_pct_lo, loss_pct_hi FROM {_PORTFOLIO} q")
def _(spark, d):
    """The ranges of datasets over replicates that SQL can draw too."""
    return portfolio_ranges(spark, d, block_replicates(spark, d)).select("data_label", "systems", "lost_kwh", "lost_lo", "lost_hi", "loss_pct", "loss_pct_lo", "loss_pct_hi")


@query("p03_block_money", f"SELECT data_label, money_lost, money_lo, money_hi FROM {_PORTFOLIO} q")
def _(spark, d):
    return portfolio_ranges(spark, d, block_replicates(spark, d)).select("data_label", "money_lost", "money_lo", "money_hi")


def block_ranged(spark, d):
    rows = event_queries.loss_rows(spark, d)
    ranges = loss_bootstrap.loss_ranges(block_replicates(spark, d), rows)
    return rows.join(ranges.select("system_id", "lost_lo", "lost_hi", "moderate_lo", "moderate_hi"), "system_id", "left")


_RANGED = "(SELECT e.*, least(q.l0, lost_kwh) AS l0, greatest(q.l1, lost_kwh) AS l1, least(q.m0, moderate_kwh) AS m0, greatest(q.m1, moderate_kwh) AS m1 FROM eco e LEFT JOIN (SELECT system_id, quantile_cont(lost, 0.025) AS l0, quantile_cont(lost, 0.975) AS l1, quantile_cont(moderate, 0.025) AS m0, quantile_cont(moderate, 0.975) AS m1 FROM brep GROUP BY 1) q USING (system_id))"


@query("e01_block_money_ranges", f"""SELECT system_id, round_even(lost_kwh * tariff, 0) AS money_lost, round_even(l0 * tariff, 0) AS money_lost_lo, round_even(l1 * tariff, 0) AS money_lost_hi, round_even(l0 * tariff / m, 0) AS money_lost_per_month_lo, round_even(l1 * tariff / m, 0) AS money_lost_per_month_hi,
  round_even(m0 * tariff / m, 0) AS moderate_per_month_lo, round_even(m1 * tariff / m, 0) AS moderate_per_month_hi FROM {_RANGED} r""")
def _(spark, d):
    return money.economics(block_ranged(spark, d), feeds.systems(spark, d, chain.daily)).select("system_id", "money_lost", *money.MONEY_RANGES)


@query("e02_block_verdict", f"SELECT system_id, CASE WHEN tariff IS NULL OR cleaning_cost IS NULL THEN 'not available' WHEN m0 * tariff / m > cleaning_cost THEN 'pays' WHEN m1 * tariff / m < cleaning_cost THEN 'does not pay' ELSE 'uncertain' END AS verdict FROM {_RANGED} r")
def _(spark, d):
    return money.economics(block_ranged(spark, d), feeds.systems(spark, d, chain.daily)).select("system_id", "verdict")


@query("e03_block_emissions", f"SELECT system_id, round(0.71e0 * lost_kwh, 4) AS emissions_kg, round(0.71e0 * l0, 4) AS emissions_kg_lo, round(0.71e0 * l1, 4) AS emissions_kg_hi FROM {_RANGED} r")
def _(spark, d):
    return rounded(money.emissions(block_ranged(spark, d), 0.71).select("system_id", "emissions_kg", "emissions_kg_lo", "emissions_kg_hi"), "emissions_kg", "emissions_kg_lo", "emissions_kg_hi", digits=4)


@query("x05_step_of_rates", f"""SELECT system_id, window_days, min(step) FILTER (least_above >= {S.power}) AS reliable_step FROM (
  SELECT *, min(rate) OVER (PARTITION BY system_id, window_days ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS least_above FROM (
    SELECT system_id, CASE WHEN row_no % 2 = 0 THEN 14 ELSE 30 END AS window_days, (hour(ts) + 1) / 100e0 AS step, avg((row_no * 7 % 24 <= hour(ts) + 4)::INT) AS rate FROM feed_readings GROUP BY 1, 2, 3) q) r GROUP BY 1, 2""")
def _(spark, d):
    """The step rule on rates that SQL has too: shares of readings by hour."""
    r = feeds.readings(spark, d).withColumns({"window_days": F.when(F.col("row_no") % 2 == 0, 14).otherwise(30), "step": (F.hour("ts") + 1) / 100.0, "hit": (F.col("row_no") * 7 % 24 <= F.hour("ts") + 4).cast("int")})
    return validation.reliable_step(r.groupBy("system_id", "window_days", "step").agg(F.avg("hit").alias("rate")))


@query("x05_reliable_step")
def _(spark, d):
    """The smallest step that the sweep finds with the power asked for."""
    return rounded(validation.reliable_step(range_queries.rates(spark, d)), "reliable_step")


@query("s01_read_systems", "SELECT system_id, capacity_kwp, latitude, longitude, tilt_deg, azimuth_deg, tariff, cleaning_cost, CASE WHEN system_id = 'S0' THEN 5e0 ELSE 5.5e0 END AS utc_offset_hours, '' AS location FROM systems")
def _(spark, d):
    path = fresh(spark, "systems")
    s = feeds.systems(spark, d, chain.daily)
    s.withColumn("utc_offset_hours", F.when(F.col("system_id") != "S0", F.col("utc_offset_hours"))).write.option("header", True).csv(path)
    return files.read_systems(spark, path).select("system_id", "capacity_kwp", "latitude", "longitude", "tilt_deg", "azimuth_deg", "tariff", "cleaning_cost", "utc_offset_hours", "location")


@query("s01_price_warnings", "SELECT system_id, concat_ws(',', CASE WHEN tariff IS NULL THEN 'tariff' END, CASE WHEN cleaning_cost IS NULL THEN 'cleaning_cost' END) AS missing FROM systems WHERE tariff IS NULL OR cleaning_cost IS NULL")
def _(spark, d):
    path = fresh(spark, "systems")
    feeds.systems(spark, d, chain.daily).write.option("header", True).csv(path)
    return files.economic_warnings(files.read_systems(spark, path)).withColumn("missing", F.array_join("missing", ","))


@query("s02_read_events", "SELECT s.system_id, coalesce(d.date, DATE '1996-01-01') AS date, coalesce(d.type, 'other') AS type, coalesce(d.note, '') AS note FROM systems s LEFT JOIN dated d USING (system_id)")
def _(spark, d):
    path = fresh(spark, "events")
    both = feeds.systems(spark, d, chain.daily).select("system_id").join(feeds.events(spark, d), "system_id", "left")
    both.select(F.concat(F.lit(" "), "system_id").alias("system_id"), F.coalesce("date", F.lit("1996-01-01").cast("date")).alias("date"), F.upper("type").alias("type"), "note").write.option("header", True).csv(path)
    return files.read_events(spark, path)


@query("s10_interval_table", "SELECT system_id, ts, power_kw FROM feed_readings WHERE power_kw IS NOT NULL")
def _(spark, d):
    path = fresh(spark, "intervals")
    files.write_by_system(feeds.readings(spark, d).where("power_kw is not null").select("system_id", "ts", "power_kw"), path)
    return spark.read.parquet(path)


@query("s11_daily_table", "SELECT system_id, date, round(pi, 5) AS pi, round(ratio, 5) AS ratio, round(loss_fraction, 5) AS loss_fraction, flagged, outage FROM fd")
def _(spark, d):
    path = fresh(spark, "daily")
    files.write_daily(chain.analysed(spark, d).select("system_id", "date", "pi", "ratio", "loss_fraction", "flagged", "outage"), path)
    return spark.read.parquet(path)


def records(spark, d, ranged):
    """The whole result of every system, from the parts that other queries check one by one."""
    f = chain.analysed(spark, d)
    systems = feeds.systems(spark, d, chain.daily).withColumn("subdaily", F.col("system_id") != "S2")
    days = frame.on_calendar(chain.daily(spark, d).select("system_id", "date", "n_samples", "valid"))
    days = days.withColumns({"flag_gap": F.col("n_samples").isNull(), "flag_partial": F.col("n_samples").isNotNull() & ~F.col("valid"), "flag_impossible": F.lit(False)})
    faulty = event_queries.faulty(spark, d)
    found = {"outage or fault": causes.outage_evidence(faulty, days), "ageing": causes.year_on_year(faulty), "shading": causes.shading_status(systems, cause_queries.shaped(spark, d))}
    status = [t.select("system_id", F.lit(k).alias("cause"), "status") for k, t in found.items()]
    best = events.clearest(event_queries.rivals(spark, d)).select("system_id", "start", "end", "type", "n_before", "n_after", "change_pct", "change_lo", "change_hi", "distinguishable")
    return money.system_records(systems, intervals.completeness(days), ranged, chain.noise(spark, d), detect.episodes(f), status[0].unionByName(status[1]).unionByName(status[2]), best, 0.71)


@query("s12_summary_json", f"""SELECT e.system_id, e.data_label, round(e.lost_kwh, 4) AS lost_kwh, round(e.l0, 4) AS lost_lo, round(e.l1, 4) AS lost_hi, round(e.loss_pct, 4) AS loss_pct, e.days_assessed, e.first_day AS period_start, e.last_day AS period_end, coalesce(p.n, 0) AS episodes, p.worst AS worst_shortfall_pct,
    v.valid_days, v.gap_days, v.partial_days, o.status AS outage_status, y.status AS ageing_status, b.start AS recovery_start, round_even(e.lost_kwh * e.tariff, 0) AS money_lost,
    CASE WHEN e.tariff IS NULL OR e.cleaning_cost IS NULL THEN 'not available' WHEN e.m0 * e.tariff / e.m > e.cleaning_cost THEN 'pays' WHEN e.m1 * e.tariff / e.m < e.cleaning_cost THEN 'does not pay' ELSE 'uncertain' END AS verdict,
    round(0.71e0 * e.l1, 4) AS emissions_kg_hi, q.systems AS dataset_systems, q.lost_kwh AS dataset_lost_kwh, q.loss_pct_hi AS dataset_loss_pct_hi, q.money_lo AS dataset_money_lo
  FROM {_RANGED} e LEFT JOIN (SELECT system_id, count(*) AS n, max(max_shortfall_pct) AS worst FROM episodes GROUP BY 1) p USING (system_id) JOIN {_PORTFOLIO} q USING (data_label)
  JOIN (SELECT s.system_id, count(*) FILTER (f.valid) AS valid_days, count(*) - count(f.date) AS gap_days, count(*) FILTER (NOT f.valid) AS partial_days FROM spine s LEFT JOIN feed_daily f USING (system_id, date) GROUP BY 1) v USING (system_id)
  JOIN (SELECT system_id, CASE WHEN bool_or(fault) THEN 'indicated' ELSE 'not indicated' END AS status FROM fault GROUP BY 1) o USING (system_id)
  JOIN (SELECT p.system_id, CASE WHEN coalesce(y.pairs >= {S.degradation_min_pairs} AND p.years > {S.degradation_min_years}, false) THEN 'ok' ELSE 'insufficient data' END AS status FROM (SELECT system_id, (max(date) - min(date)) / 365.25e0 AS years FROM fault GROUP BY 1) p
        LEFT JOIN (SELECT a.system_id, count(*) AS pairs FROM fault a JOIN fault b ON a.system_id = b.system_id AND b.dn = a.dn + 365 WHERE a.clear AND NOT a.fault AND b.clear AND NOT b.fault GROUP BY 1) y USING (system_id)) y USING (system_id)
  LEFT JOIN ({event_queries._BEST.format("system_id")}) b USING (system_id)""")
def _(spark, d):
    """One object a system and one a dataset with all their parts nested; read back and laid flat."""
    path = fresh(spark, "summary")
    rows = event_queries.loss_rows(spark, d)
    ranges = loss_bootstrap.loss_ranges(block_replicates(spark, d), rows)
    systems = records(spark, d, rows.join(ranges, "system_id", "left"))
    files.write_summary(systems, f"{path}/systems")
    totals = money.portfolio_ranges(block_replicates(spark, d), loss_status(spark, d), feeds.systems(spark, d, chain.daily))
    files.write_summary(totals, f"{path}/datasets")
    back, datasets = spark.read.schema(systems.schema).json(f"{path}/systems"), spark.read.schema(totals.schema).json(f"{path}/datasets")
    of = lambda cause: F.get(F.filter("causes", lambda c: c["cause"] == cause), F.lit(0))["status"]
    flat = back.select(
        "system_id", "data_label", "estimated_loss.lost_kwh", "estimated_loss.lost_lo", "estimated_loss.lost_hi", "estimated_loss.loss_pct", "estimated_loss.days_assessed", F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"),
        F.size("episodes").cast("bigint").alias("episodes"), F.array_max("episodes.max_shortfall_pct").alias("worst_shortfall_pct"), "completeness.valid_days", "completeness.gap_days", "completeness.partial_days",
        of("outage or fault").alias("outage_status"), of("ageing").alias("ageing_status"), F.col("recovery.start").alias("recovery_start"), "money.money_lost", "verdict", "emissions.emissions_kg_hi",
    )
    parts = datasets.select("data_label", F.col("systems").alias("dataset_systems"), F.round("lost_kwh", 3).alias("dataset_lost_kwh"), F.col("loss_pct_hi").alias("dataset_loss_pct_hi"), F.round("money_lo", 3).alias("dataset_money_lo"))
    return flat.join(parts, "data_label")


@query("s13_validation_json")
def _(spark, d):
    """The records of the datasets with the validation of their systems: ranges, detection rates, reliable steps."""
    path = fresh(spark, "validation")
    totals = money.portfolio_ranges(range_queries.replicates(spark, d), loss_status(spark, d), feeds.systems(spark, d, chain.daily))
    rates = range_queries.rates(spark, d)
    rows = money.dataset_records(feeds.systems(spark, d, chain.daily), totals, range_queries.validated(spark, d), rates, validation.reliable_step(rates))
    files.write_summary(rows, path)
    return spark.read.schema(rows.schema).json(path)
