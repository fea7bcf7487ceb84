"""Noise floor, sustained shortfalls, episodes, and the loss they amount to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import KEYS, by, dealt, islands, odd, robust_sigma, stored, true, z
from ..functions.rolling import Running, with_running_medians
from ..functions.settings import DEFAULT, Settings
from .reference import calibrate, find_outages, with_residuals


def trend_widths(s: Settings = DEFAULT) -> dict[int, int]:
    """The days of the trend that each window's noise is measured around."""
    return {w: max(s.trend_window_days, odd(s.trend_window_multiple * w)) for w in s.windows_days}


def noise_profile(f: DataFrame, s: Settings = DEFAULT, keys=KEYS, rows: int | None = None) -> DataFrame:
    """keys, window_days, se, threshold, detection_limit, rounded to five decimals as they are used. f has
    every calendar day; residuals that it holds already are taken as they are."""
    trend = trend_widths(s)
    missing = [t for t in trend.values() if f"resid{t}" not in f.columns]
    d = with_residuals(f.select(*keys, "date", "pi_clear", *[f"resid{t}" for t in set(trend.values()) if t not in missing]), missing, s, keys)
    d = with_running_medians(d, [Running(f"_m{w}", f"resid{t}", odd(w), s.smoothing_min_clear_days) for w, t in trend.items()], keys, rows)
    medians = []
    for w, t in trend.items():
        resid, own = F.col(f"resid{t}"), by(keys, None)
        first, last = (end(F.when(resid.isNotNull(), F.col("date"))).over(own) for end in (F.min, F.max))
        median = F.when(F.col("date").between(first, last), F.col(f"_m{w}"))
        medians.append(F.struct(F.lit(w).alias("window_days"), median.alias("m")))
    long = d.select(*keys, F.array(*medians).alias("ms")).select(*keys, F.explode("ms").alias("m")).select(*keys, "m.*")
    all_keys = f.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, s.windows_days))).alias("window_days"))
    se = all_keys.join(robust_sigma(long, "m", [*keys, "window_days"], "se"), [*keys, "window_days"], "left")
    threshold = F.when(F.col("se").isNotNull(), F.greatest(F.lit(s.min_shortfall_fraction), z(1 - s.false_alarm_rate) * F.col("se")))
    return se.select(*keys, "window_days", F.round("se", 5).alias("se"), F.round(threshold, 5).alias("threshold"), F.round(threshold + z(s.power) * F.col("se"), 5).alias("detection_limit"))


def day_noise(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, day_sigma, clear_share."""
    name = f"resid{s.trend_window_days}"
    known = f if name in f.columns else with_residuals(f, [s.trend_window_days], s, keys)
    share = f.groupBy(*keys).agg(F.round(F.count_if("clear") / F.greatest(F.count_if("valid"), F.lit(1)), 3).alias("clear_share"))
    return share.join(robust_sigma(known, name, keys, "day_sigma"), [*keys], "left").withColumn("day_sigma", F.round("day_sigma", 5))


def smooth(f: DataFrame, value: str, windows: dict[str, int], s: Settings = DEFAULT, keys=KEYS, rows: int | None = None) -> DataFrame:
    """Adds for each name of `windows` the centred running median of `value` over so many days; inner gaps are bridged for
    the first days by the line to the other side, the rest stays unknown. f has every calendar day."""
    return with_running_medians(f, [Running(name, value, odd(days), s.smoothing_min_clear_days, bridge=s.max_bridge_days) for name, days in windows.items()], keys, rows)


def triggers(f: DataFrame, noise: DataFrame, s: Settings = DEFAULT, keys=KEYS, rows: int | None = None) -> DataFrame:
    """Adds below (under 1 - threshold at any window), smooth_ratio (shortest window first) and release."""
    wide = noise.groupBy(*keys).agg(*[F.max(F.when(F.col("window_days") == w, F.col("threshold"))).alias(f"t{w}") for w in s.windows_days])
    f = smooth(f, "clear_ratio", {f"sm{w}": w for w in s.windows_days}, s, keys, rows).join(dealt(wide, keys, rows) if rows else wide, [*keys], "left")
    for w in s.windows_days:
        f = f.withColumn(f"sm{w}", F.when(F.col(f"t{w}").isNotNull(), F.col(f"sm{w}")))
    below = reduce(lambda a, b: a | b, [true(F.col(f"sm{w}") < 1.0 - F.col(f"t{w}")) for w in s.windows_days])
    least = F.least(*[f"t{w}" for w in s.windows_days])
    return f.withColumn("below", below).withColumn("smooth_ratio", F.coalesce(*[f"sm{w}" for w in sorted(s.windows_days)])).withColumn("release", s.release_ratio * least)


def long_runs(f: DataFrame, flag: str, name: str, least: int, keys=KEYS) -> DataFrame:
    """Adds `name`: flag on days that belong to a run of at least `least` days. So many days in a row end on such a day or on one of the
    least - 1 rows after it: short frames in the order that the series has anyway."""
    own, back = by(keys), least - 1
    row = (F.sum(F.col(flag).cast("int")).over(own.rowsBetween(-back, 0)) == least) & (F.datediff("date", F.lag("date", back).over(own)) == back)
    f = f.withColumn("_ends", true(row))
    return f.withColumn(name, F.col(flag) & F.max("_ends").over(own.rowsBetween(0, back))).drop("_ends")


def extend(f: DataFrame, seed: str, allowed: str, name: str, keys=KEYS) -> DataFrame:
    """Adds `name`: seeds, and every run of allowed days with a seed in it or right beside it."""
    before, after = F.lag(seed).over(by(keys)), F.lead(seed).over(by(keys))
    f = f.withColumn("_touch", F.col(seed) | true(before) | true(after))
    f = f.withColumn("_isle", F.sum(F.when(F.col(allowed), 0).otherwise(1)).over(by(keys).rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.max(F.col("_touch") & F.col(allowed)).over(Window.partitionBy(*keys, "_isle", allowed))
    return f.withColumn(name, F.col(seed) | (F.col(allowed) & inside)).drop("_touch", "_isle")


def find_shortfalls(f: DataFrame, noise: DataFrame, s: Settings = DEFAULT, keys=KEYS, rows: int | None = None) -> DataFrame:
    """Adds smooth_ratio, loss_fraction and flagged."""
    f = long_runs(triggers(f, noise, s, keys, rows), "below", "seed", s.min_episode_days, keys)
    f = f.withColumn("allowed", true(F.col("smooth_ratio") < 1.0 - F.col("release")))
    f = extend(f, "seed", "allowed", "keep", keys)
    fraction = F.when(F.col("keep"), F.coalesce(F.least(F.greatest(1.0 - F.col("smooth_ratio"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    f = f.withColumn("loss_fraction", fraction)
    return f.withColumn("flagged", F.col("keep") & (F.col("loss_fraction") > 0)).drop("keep", "release", *[f"t{w}" for w in s.windows_days], *[f"sm{w}" for w in s.windows_days])


def episodes(f: DataFrame, keys=KEYS) -> DataFrame:
    """keys, start, end, days, mean_shortfall_pct, max_shortfall_pct: one row for each run of flagged days."""
    return islands(f, "flagged", keys).groupBy(*keys, "island").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"),
        F.round(100 * F.avg("loss_fraction"), 1).alias("mean_shortfall_pct"), F.round(100 * F.max("loss_fraction"), 1).alias("max_shortfall_pct"),
    ).drop("island")


def estimate_loss(f: DataFrame, s: Settings = DEFAULT, keys=KEYS, period: tuple[str, str] | None = None) -> DataFrame:
    """One row for each series: lost energy by kind, expected energy, days assessed, percent."""
    if period:
        f = f.where(F.col("date").between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date")))
    countable = F.col("valid") & F.col("expected_kwh").isNotNull()
    sustained = countable & ~F.col("outage")
    part = F.col("expected_kwh") * F.col("loss_fraction")
    deep = sustained & (F.col("loss_fraction") > s.deep_fraction)
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    got = f.groupBy(*keys).agg(
        total(countable, F.col("expected_kwh")).alias("expected_kwh"), total(sustained, part).alias("sustained_kwh"),
        total(countable & F.col("outage"), F.greatest(F.col("expected_kwh") - F.col("energy_kwh"), F.lit(0.0))).alias("outage_kwh"),
        total(deep, part).alias("deep_kwh"), F.count_if(deep).alias("deep_days"), F.count_if(countable).alias("days_assessed"),
    )
    got = got.withColumn("moderate_kwh", F.col("sustained_kwh") - F.col("deep_kwh")).withColumn("lost_kwh", F.col("sustained_kwh") + F.col("outage_kwh"))
    return got.withColumn("loss_pct", F.when(F.col("expected_kwh") > 0, 100 * F.col("lost_kwh") / F.col("expected_kwh")))


def analyse_frame(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """A frame with pi and clear -> the analysed frame: outages, reference, noise and shortfalls."""
    return analyse_with_noise(f, s, keys)[0]


def analyse_with_noise(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """The analysed frame and its noise_profile().

    Each step reads the frame several times. The calibrated frame (with the residuals that both the reference
    and the noise need) and the noise profile are written to the shared folder, so that the plan stays as
    long as one step and doesn't grow with every analysis of an analysed frame."""
    # A series is few bytes but much work; parts grow with the rows, so that what a task sorts for its windows doesn't.
    rows = f.count()
    known = with_residuals(find_outages(dealt(f, keys, rows), s, keys), {s.trend_window_days, *trend_widths(s).values()}, s, keys)
    c = stored(calibrate(stored(known, "outages"), s, keys, rows), "calibrated")
    noise = stored(noise_profile(c, s, keys, rows), "noise")
    return find_shortfalls(c.drop(*[x for x in c.columns if x.startswith("resid")]), noise, s, keys, rows), noise
