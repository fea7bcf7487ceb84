"""Outage days, sustained performance, and the self-calibrated reference of each system."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import KEYS, by, dealt, percentile, robust_sigma, true, z
from ..functions.rolling import Running, with_running_medians
from ..functions.settings import DEFAULT, Settings

MID_MONTH = (15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349)


def find_outages(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Adds outage (valid, bright, next to no output) and pi_clear (index of clear days without outage)."""
    typical = F.median(F.when(F.col("clear"), F.col("pi"))).over(by(keys, None))
    f = f.withColumn("outage", true(F.col("valid") & (F.col("clearness") >= s.outage_min_clearness) & (F.col("pi") < s.outage_max_fraction * typical)))
    return f.withColumn("pi_clear", F.when(F.col("clear") & ~F.col("outage"), F.col("pi")))


def sustained(df: DataFrame, value: str, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, date, sustained: median over consecutive known days, null if they span too long."""
    known = df.where(F.col(value).isNotNull()).select(*keys, "date", value)
    running = Running("sustained", value, s.sustained_days, s.sustained_min_days, rows=True, span=s.sustained_max_span_days)
    return with_running_medians(known, [running], keys).select(*keys, "date", "sustained")


def relative_residuals(df: DataFrame, value: str, window_days: int, min_n: int, keys=KEYS) -> DataFrame:
    """keys, date, resid: value over its centred running median minus one, on days that have both."""
    known = df.where(F.col(value).isNotNull()).select(*keys, "date", value)
    d = with_running_medians(known, [Running("_trend", value, window_days, min_n)], keys)
    return d.select(*keys, "date", (F.try_divide(F.col(value), F.col("_trend")) - 1.0).alias("resid")).where("resid is not null")


def with_residuals(f: DataFrame, widths, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """f (with pi_clear) and resid<width> of each width: relative_residuals() as columns, all of them in one
    pass over the series; null where unknown."""
    widths = sorted(set(widths))
    if not widths:
        return f
    d = with_running_medians(f, [Running(f"_t{w}", "pi_clear", w, s.trend_min_clear_days) for w in widths], keys)
    return d.withColumns({f"resid{w}": F.try_divide(F.col("pi_clear"), F.col(f"_t{w}")) - 1.0 for w in widths}).drop(*[f"_t{w}" for w in widths])


def luck_allowance(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, se_sustained, luck: what a high quantile of noise sits above the truth by chance."""
    name = f"resid{s.trend_window_days}"
    known = f if name in f.columns else with_residuals(f, [s.trend_window_days], s, keys)
    se = robust_sigma(sustained(known, name, s, keys), "sustained", keys, "se_sustained")
    all_keys = f.select(*keys).distinct()
    return all_keys.join(se, [*keys], "left").withColumn("luck", F.coalesce(z(s.reference_quantile) * F.col("se_sustained"), F.lit(0.0)))


def monthly_reference(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, month, n, raw, value: high quantile of sustained values per calendar month, less luck."""
    got = sustained(f, "pi_clear", s, keys).where("sustained is not null").groupBy(*keys, F.month("date").alias("month"))
    got = got.agg(F.count("*").alias("n"), percentile(F.col("sustained"), s.reference_quantile).alias("q"))
    got = got.join(luck_allowance(f, s, keys).select(*keys, "luck"), [*keys])
    raw = F.when(F.col("n") >= s.reference_min_days, F.col("q"))
    return got.select(*keys, "month", "n", raw.alias("raw"), (raw * (1.0 - F.col("luck"))).alias("value"))


def yearly_curve(monthly: DataFrame, keys=KEYS, value: str = "value") -> DataFrame:
    """keys, doy (1..365), reference: monthly values joined by lines through mid-months, around the
    year's end; missing months borrow from their neighbours."""
    mids = F.element_at(F.array(*map(F.lit, MID_MONTH)), F.col("month"))
    anchors = monthly.where(F.col(value).isNotNull()).select(*keys, F.explode(F.array(mids - 365, mids, mids + 365)).alias("doy"), F.col(value).alias("at"))
    days = anchors.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(365))).alias("doy"))
    both = anchors.unionByName(days.withColumn("at", F.lit(None).cast("double")))
    # Several rows share a day where an anchor lies on it: frames over days see them all.
    back = Window.partitionBy(*keys).orderBy("doy").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("doy")).rangeBetween(Window.unboundedPreceding, 0)
    known = lambda: F.when(F.col("at").isNotNull(), F.struct("doy", "at"))
    both = both.withColumn("p", F.max(known()).over(back)).withColumn("q", F.min(known()).over(ahead))
    line = F.col("p.at") + (F.col("q.at") - F.col("p.at")) * F.try_divide(F.col("doy") - F.col("p.doy"), F.col("q.doy") - F.col("p.doy"))
    return both.where("at is null").select(*keys, "doy", F.coalesce(line, F.col("p.at")).alias("reference"))


def calibrate(f: DataFrame, s: Settings = DEFAULT, keys=KEYS, rows: int | None = None) -> DataFrame:
    """Adds reference, expected_kwh, ratio and clear_ratio (ratio of clear days without outage). Systems
    without any month keep null there. The number of `rows`, where it is told, keeps tasks small."""
    f = dealt(f, keys, rows) if rows else f
    curve = yearly_curve(monthly_reference(f, s, keys), keys)
    f = f.withColumn("doy", F.least(F.dayofyear("date"), F.lit(365)))
    f, curve = (dealt(d, [*keys, "doy"], rows) if rows else d for d in (f, curve))
    f = f.join(curve, [*keys, "doy"], "left").drop("doy")
    f = f.withColumn("expected_kwh", F.col("model_kwh") * F.col("reference")).withColumn("ratio", F.try_divide("pi", "reference"))
    return f.withColumn("clear_ratio", F.when(F.col("clear") & ~F.col("outage"), F.col("ratio")))
