"""Readings to interval energy, hours and days with quality flags. The stamp of a reading marks the end
of its interval; the session time zone is UTC, stamps are local standard time.

A fleet may mix systems with several readings a day and systems with one. From dated() on, a column `subdaily`
tells them apart, as combined() and nominal_minutes() give it; a table without it holds sub-daily systems only. One reading a day
stands for the day of its stamp: it has no midpoint, no daylight to cover, no hours, and its ends aren't trimmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import KEYS, spine, true
from ..functions.settings import DEFAULT, Settings

HOUR_US = 3_600_000_000


def us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def at(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def keep_last(df: DataFrame, keys=KEYS) -> DataFrame:
    """One row for each stamp: the one that comes last in the file. Aggregated, not sorted."""
    rest = [c for c in df.columns if c not in (*keys, "ts")]
    return df.groupBy(*keys, "ts").agg(F.max_by(F.struct(*rest), "row_no").alias("m")).select(*keys, "ts", "m.*")


def counter_to_interval(df: DataFrame, value: str, s: Settings = DEFAULT, resets_daily: bool = False, keys=KEYS) -> DataFrame:
    """keys, ts, energy, is_reset, long_gap, elapsed_h of the readings that are known."""
    known = keep_last(df.where(F.col("ts").isNotNull() & F.col(value).isNotNull()).select(*keys, "ts", "row_no", value), keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    step, elapsed = F.col(value) - F.lag(value).over(w), (us(F.col("ts")) - us(F.lag("ts").over(w))) / HOUR_US
    d = known.select(*keys, "ts", F.col(value).alias("_v"), step.alias("_step"), elapsed.alias("elapsed_h"))
    reset, gap = true(F.col("_step") < 0), true(F.col("elapsed_h") > s.max_counter_gap_hours)
    energy = F.when(~gap, F.when(reset, F.col("_v") if resets_daily else F.lit(None)).otherwise(F.col("_step")))
    return d.select(*keys, "ts", energy.alias("energy"), reset.alias("is_reset"), gap.alias("long_gap"), "elapsed_h")


def add_members(parts: DataFrame, n_members: int, keys=KEYS) -> DataFrame:
    """parts (keys, ts, member, energy, elapsed_h): sums over members; a stamp without all is unknown,
    hours are those of the first member."""
    return parts.groupBy(*keys, "ts").agg(F.when(F.count("energy") == n_members, F.sum("energy")).alias("energy"), F.max(F.when(F.col("member") == 0, F.col("elapsed_h"))).alias("elapsed_h"))


def sample_hours(df: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Adds step_h (the day's median step) and hours (what a reading stands for)."""
    d = df.withColumn("_day", F.to_date("ts")).withColumn("_e", (us(F.col("ts")) - us(F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts")))) / HOUR_US)
    step = F.coalesce(F.median("_e").over(Window.partitionBy(*keys, "_day")), F.median("_e").over(Window.partitionBy(*keys)))
    d = d.withColumn("step_h", step)
    return d.withColumn("hours", F.coalesce(F.when(F.col("_e") <= s.logging_gap_step_factor * F.col("step_h"), F.col("_e")), F.col("step_h"))).drop("_e", "_day")


def step_profile(df: DataFrame, least_days: int = 5, keys=KEYS) -> DataFrame:
    """keys, minutes, days: how many days have which sampling step, rare ones left out."""
    per_day = df.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.bround(F.min("step_h") * 60, 0).alias("minutes"))
    return per_day.groupBy(*keys, "minutes").agg(F.count("*").alias("days")).where(F.col("days") >= least_days)


def nominal_minutes(df: DataFrame, keys=KEYS) -> DataFrame:
    """keys, minutes: median over days of the day's step."""
    per_day = df.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.min("step_h").alias("step_h"))
    return per_day.groupBy(*keys).agg(F.round(F.median("step_h") * 60, 3).alias("minutes")).withColumn("subdaily", F.col("minutes") < 1439)


def flag_impossible(df: DataFrame, systems: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Small negatives become zero; other negatives and more than the plant can make are unknown."""
    limit = F.col("capacity_kwp") * F.col("hours") * s.max_capacity_factor
    d = df.join(systems.select("system_id", "capacity_kwp"), "system_id").withColumn("_limit", limit)
    e = F.when((F.col("energy_kwh") < 0) & (F.col("energy_kwh") >= -s.negative_clip_fraction * F.col("_limit")), 0.0).otherwise(F.col("energy_kwh"))
    d = d.withColumn("energy_kwh", e).withColumn("impossible", true((F.col("energy_kwh") < 0) | (F.col("energy_kwh") > F.col("_limit"))))
    return d.withColumn("energy_kwh", F.when(~F.col("impossible"), F.col("energy_kwh"))).drop("_limit", "capacity_kwp")


def subdaily(df: DataFrame) -> Column:
    """Whether a row's system has several readings a day; unknown counts as one a day."""
    return true(F.col("subdaily")) if "subdaily" in df.columns else F.lit(True)


def dated(df: DataFrame) -> DataFrame:
    """Adds t0 and t1 (microseconds), mid and date: a reading belongs to the day of its midpoint, one that stands for
    a day to that of its stamp."""
    d = df.withColumn("t1", us(F.col("ts"))).withColumn("t0", F.col("t1") - F.round(F.col("hours") * HOUR_US).cast("bigint"))
    d = d.withColumn("mid", at(F.when(subdaily(df), F.col("t0") + F.shiftright(F.col("t1") - F.col("t0"), 1)).otherwise(F.col("t1"))))
    return d.withColumn("date", F.to_date("mid"))


def coverage(df: DataFrame, daylight: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """df (dated) and daylight (keys, date, rise, set in microseconds) -> readings whose energy lies in two
    days' daylight made unknown, and keys, date, coverage of sub-daily systems. A reading touches its end day and its
    start day, so two equi-joins do the work of an overlap join."""
    light = daylight.select(*keys, F.col("date").alias("_d"), "rise", "set")
    d = df.withColumns({"_d1": F.to_date(at(F.col("t1"))), "_d0": F.to_date(at(F.col("t0")))})
    for end in ("_d1", "_d0"):
        side = light.select(*keys, F.col("_d").alias(end), F.col("rise").alias(f"{end}r"), F.col("set").alias(f"{end}s"))
        d = d.join(side, [*keys, end], "left")
        lit = F.greatest(F.least(F.col("t1"), F.col(f"{end}s")) - F.greatest(F.col("t0"), F.col(f"{end}r")), F.lit(0)) / HOUR_US
        d = d.withColumn(f"{end}h", F.when(F.col(f"{end}s").isNotNull(), lit).otherwise(0.0))
    d = d.withColumn("_d0h", F.when(F.col("_d0") != F.col("_d1"), F.col("_d0h")).otherwise(0.0))
    d = d.withColumn("straddles", subdaily(df) & (F.col("_d1h") > s.straddle_min_hours) & (F.col("_d0h") > s.straddle_min_hours))
    d = d.withColumn("undatable", F.col("straddles") & F.col("energy_kwh").isNotNull()).withColumn("energy_kwh", F.when(~F.col("straddles"), F.col("energy_kwh")))
    known = d.where(F.col("energy_kwh").isNotNull() & subdaily(df))
    parts = known.select(*keys, F.explode(F.array(F.struct(F.col("_d1").alias("date"), F.col("_d1h").alias("h")), F.struct(F.col("_d0").alias("date"), F.col("_d0h").alias("h")))).alias("p")).select(*keys, "p.*")
    per_day = parts.groupBy(*keys, "date").agg(F.sum("h").alias("h")).join(daylight.select(*keys, "date", "rise", "set"), [*keys, "date"])
    per_day = per_day.select(*keys, "date", F.least(F.try_divide("h", (F.col("set") - F.col("rise")) / HOUR_US), F.lit(1.0)).alias("coverage"))
    return d.drop("_d0", "_d1", "_d0r", "_d0s", "_d1r", "_d1s", "_d0h", "_d1h"), per_day


def hourly(df: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, hour_ts, energy_kwh on a full grid of hours; only hours that readings cover are known. Systems with one
    reading a day have none."""
    df = df.where(subdaily(df))
    d = df.withColumn("hour_ts", F.date_trunc("hour", "mid").cast("timestamp_ntz"))
    lo, hi = s.hourly_coverage
    got = d.groupBy(*keys, "hour_ts").agg(F.sum(F.when(F.col("energy_kwh").isNotNull(), F.col("hours")).otherwise(0.0)).alias("lit"), F.max("hours").alias("longest"), F.sum("energy_kwh").alias("e"))
    got = got.select(*keys, "hour_ts", F.when(F.col("lit").between(lo, hi) & (F.col("longest") <= 1.0), F.col("e")).alias("energy_kwh"))
    days = spine(df, keys)
    grid = days.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"), "date").select(*keys, (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))).alias("hour_ts"))
    return grid.join(got, [*keys, "hour_ts"], "left")


def trimmed(d: DataFrame, least: int = 2, keys=KEYS) -> DataFrame:
    """A full calendar without the days of `least` samples or fewer at its ends: first those at the start go, then those
    at the end, as long as more than two days are left. Series with one reading a day (subdaily false) stay whole."""
    w = Window.partitionBy(*keys)
    rn = F.datediff("date", F.min("date").over(w)) + 1
    d = d.withColumn("_i", rn).withColumns({"_n": F.max("_i").over(w), "_a": F.min(F.when(F.col("n_samples") > least, F.col("_i"))).over(w), "_b": F.max(F.when(F.col("n_samples") > least, F.col("_i"))).over(w)})
    first = F.greatest(F.lit(1), F.least(F.coalesce("_a", F.col("_n") - 1), F.col("_n") - 1))
    last = F.least(F.col("_n"), F.greatest(F.coalesce("_b", F.lit(0)), first + 1))
    return d.where(~subdaily(d) | F.col("_i").between(first, last)).drop("_i", "_n", "_a", "_b")


def daily(df: DataFrame, cover: DataFrame, systems: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Days on a full calendar with quality flags; days at the ends of sub-daily series with two samples or fewer go. A day
    of a system with one reading a day is covered if it has a sample, and its coverage is unknown if not."""
    got = df.groupBy(*keys, "date").agg(F.sum("energy_kwh").alias("energy_kwh_raw"), F.count("energy_kwh").alias("n_samples"), F.count_if("impossible").alias("n_impossible"))
    modes = df.groupBy(*keys).agg(F.max(subdaily(df)).alias("subdaily"))
    d = spine(df, keys).join(got, [*keys, "date"], "left").join(cover, [*keys, "date"], "left").na.fill(0, ["n_samples", "n_impossible"]).join(modes, [*keys])
    d = d.withColumn("coverage", F.when(F.col("subdaily"), F.coalesce("coverage", F.lit(0.0))).when(F.col("n_samples") > 0, 1.0))
    d = trimmed(d, keys=keys)
    d = d.join(systems.select("system_id", "capacity_kwp"), "system_id")
    d = d.withColumn("flag_gap", (F.col("n_samples") == 0) | (F.col("subdaily") & (F.col("coverage") == 0)))
    d = d.withColumn("flag_partial", ~F.col("flag_gap") & true(F.col("coverage") < s.min_daylight_coverage))
    d = d.withColumn("flag_impossible", (F.col("n_impossible") > 0) | true(F.col("energy_kwh_raw") / F.col("capacity_kwp") > s.max_daily_specific_yield))
    d = d.withColumn("valid", ~(F.col("flag_gap") | F.col("flag_partial") | F.col("flag_impossible")))
    return d.withColumn("energy_kwh", F.when(F.col("valid"), F.col("energy_kwh_raw"))).drop("capacity_kwp", "subdaily")


def completeness(days: DataFrame, readings: DataFrame | None = None, steps: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """The record of a system: its days by flag, and with readings (coverage()'s first result) and steps
    (counter_to_interval() of lifetime counters, or file_energies()) its counter resets, the gaps whose energy
    belongs to no day, and values that can't be."""
    got = days.groupBy(*keys).agg(
        F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.count("*").alias("calendar_days"), F.count_if("valid").alias("valid_days"),
        F.count_if("flag_gap").alias("gap_days"), F.count_if("flag_partial").alias("partial_days"), F.count_if("flag_impossible").alias("impossible_days"),
        F.round(100 * F.avg(F.col("valid").cast("int")), 1).alias("completeness_pct"),
    )
    none = F.lit(0).cast("bigint")
    if readings is not None:
        got = got.join(readings.groupBy(*keys).agg(F.count_if("undatable").alias("_undatable"), F.count_if("impossible").alias("impossible_values")), [*keys], "left")
    else:
        got = got.withColumns({"_undatable": none, "impossible_values": none})
    if steps is not None:
        resets, gaps = (F.sum("resets"), F.sum("long_gaps")) if "resets" in steps.columns else (F.count_if("is_reset"), F.count_if("long_gap"))
        got = got.join(steps.groupBy(*keys).agg(resets.alias("counter_resets"), gaps.alias("_gaps")), [*keys], "left")
    else:
        got = got.withColumns({"counter_resets": none, "_gaps": none})
    got = got.na.fill(0, ["_undatable", "impossible_values", "counter_resets", "_gaps"])
    return got.withColumn("unassignable_gaps", F.col("_gaps") + F.col("_undatable")).drop("_gaps", "_undatable")
