"""Before and after: rain spells, dated events, comparison windows, the best-observed event."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import KEYS, dealt, islands, true, z
from ..functions.settings import DEFAULT, Settings
from .bootstrap import pairs, uniforms


def rain_events(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, start, end, rain_mm, type: consecutive days of heavy rain are one event."""
    wet = f.withColumn("_wet", true(F.col("precip_mm") >= s.heavy_rain_mm))
    got = islands(wet, "_wet", keys).groupBy(*keys, "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.sum("precip_mm").alias("rain_mm"))
    return got.drop("island").withColumn("type", F.lit("natural rain"))


def chosen_events(dated: DataFrame, rain: DataFrame, systems: DataFrame, keys=KEYS) -> DataFrame:
    """Dated events where a system has any, else its rain events."""
    mine = dated.join(systems.select("system_id"), "system_id", "left_semi").select("system_id", F.col("date").alias("start"), F.col("date").alias("end"), F.lit(None).cast("double").alias("rain_mm"), "type")
    return mine.unionByName(rain.join(mine.select("system_id").distinct(), "system_id", "left_anti").select("system_id", "start", "end", "rain_mm", "type"))


def event_days(f: DataFrame, events: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Each event beside the days of its windows: an equi-join on the days it spans, never a range join.
    rel is the day number before (negative) or after (positive) the event, 0 within."""
    days = events.select(*keys, "start", "end", "type", F.explode(F.sequence(F.date_sub("start", s.days_before), F.date_add("end", s.days_after))).alias("date"))
    both = days.join(f, [*keys, "date"])
    rel = F.when(F.col("date") < F.col("start"), F.datediff("date", "start")).when(F.col("date") > F.col("end"), F.datediff("date", "end")).otherwise(0)
    return both.withColumn("rel", rel).withColumn("usable", F.col("clear") & ~F.col("fault") & F.col("ratio").isNotNull())


def compare(f: DataFrame, events: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """One row for each event: days, means and change of the ratio, energy a day, other heavy rain.
    f has fault, the days that outages or deep drops spoil."""
    d = event_days(f, events, s, keys)
    before, after = F.col("usable") & (F.col("rel") < 0), F.col("usable") & (F.col("rel") > 0)
    got = d.groupBy(*keys, "start", "end", "type").agg(
        F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"),
        F.avg(F.when(before, F.col("ratio"))).alias("mean_before"), F.avg(F.when(after, F.col("ratio"))).alias("mean_after"),
        F.avg("expected_kwh").alias("mean_expected"), F.count_if((F.col("rel") != 0) & true(F.col("precip_mm") >= s.heavy_rain_mm)).alias("other_rain_days"),
    )
    enough = (F.col("n_before") >= s.min_clear_days_each_side) & (F.col("n_after") >= s.min_clear_days_each_side)
    got = got.withColumn("status", F.when(enough, "ok").otherwise("too few clear days"))
    change = F.when(enough, 100 * (F.col("mean_after") / F.col("mean_before") - 1))
    return got.withColumn("change_pct", change).withColumn("kwh_per_day", F.when(enough, (F.col("mean_after") - F.col("mean_before")) * F.col("mean_expected")))


def student_t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution function (Simpson's rule on the density)."""
    from math import gamma, pi, sqrt

    c = gamma((df + 1) / 2) / (sqrt(df * pi) * gamma(df / 2))
    density = lambda t: c * (1 + t * t / df) ** (-(df + 1) / 2)

    def cdf(x, n=400):
        h = x / n
        return 0.5 + h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * density(i * h) for i in range(n + 1))

    lo, hi = 0.0, 700.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid, 2000 if mid > 50 else 400) < p else (lo, mid)
    return (lo + hi) / 2


def stretch(n: int, s: Settings = DEFAULT) -> float:
    """What the deviation of a mean of n redrawn values is stretched by, so that small samples aren't too narrow."""
    p = 1 - (1 - s.confidence) / 2
    return student_t_quantile(p, n - 1) / z(p) * (n / (n - 1)) ** 0.5


def event_intervals(f: DataFrame, events: DataFrame, s: Settings = DEFAULT, keys=KEYS, samples: int | None = None) -> DataFrame:
    """Events that are ok -> change_lo, change_hi (percent), kwh_lo, kwh_hi (energy a day), distinguishable. Each
    side's mean is drawn again with replacement and stretched, inside the row of its event. Draws depend on the event and
    the replicate alone."""
    p, reps = 1 - (1 - s.confidence) / 2, samples or s.samples
    factor = {n: stretch(n, s) for n in range(2, max(s.days_before, s.days_after) + 1)}
    d = event_days(f, events, s, keys)
    side = lambda cond: F.sort_array(F.collect_list(F.when(F.col("usable") & cond, F.struct("date", "ratio"))))["ratio"]
    own = [*keys, "start", "end", "type"]
    sides = d.groupBy(*own).agg(side(F.col("rel") < 0).alias("b"), side(F.col("rel") > 0).alias("a"), F.avg("expected_kwh").alias("expected"))
    sides = sides.where((F.size("b") >= s.min_clear_days_each_side) & (F.size("a") >= s.min_clear_days_each_side))
    ends = ("change_lo", "change_hi", "kwh_lo", "kwh_hi")
    schema = T.StructType([*sides.select(*own).schema.fields, *[T.StructField(c, T.DoubleType()) for c in ends]])

    def redrawn(row: dict, side: str) -> np.ndarray:
        x = np.array(row[side])
        u = uniforms((s.seed, *[row[k] for k in keys], row["start"], side), pairs(range(reps), range(len(x))))
        mean = x.sum() / len(x)
        return mean + (x[np.floor(u * len(x)).astype(int)].reshape(reps, -1).sum(axis=1) / len(x) - mean) * factor[len(x)]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, b = redrawn(row, "a"), redrawn(row, "b")
                with np.errstate(divide="ignore", invalid="ignore"):
                    change = 100 * (a / b - 1)
                kwh = (a - b) * (np.nan if row["expected"] is None else row["expected"])
                out.append(np.concatenate([np.percentile(x, [100 * (1 - p), 100 * p]) for x in (change, kwh)]))
            numbers = np.array(out).reshape(-1, len(ends))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *[pa.array(numbers[:, k], pa.float64(), mask=np.isnan(numbers[:, k])) for k in range(len(ends))]], names=schema.names)

    got = dealt(sides, own).mapInArrow(run, schema)
    return got.withColumn("distinguishable", (F.col("change_lo") > 0) | (F.col("change_hi") < 0))


def rivals(results: DataFrame, keys=KEYS) -> DataFrame:
    """The rows of compare() that clearest() chooses between by their intervals: with most clear days on the weaker side. The
    intervals of the others, by far the most, bear on nothing."""
    weaker = F.least("n_before", "n_after")
    return results.where("status = 'ok'").withColumn("_most", F.max(weaker).over(Window.partitionBy(*keys))).where(weaker == F.col("_most")).drop("_most")


def clearest(results: DataFrame, keys=KEYS) -> DataFrame:
    """Of each series (or dataset) the event with most clear days on its weaker side, then the narrowest
    interval, then the earliest."""
    order = [F.least("n_before", "n_after").desc(), F.round(F.col("change_hi") - F.col("change_lo"), 9).asc_nulls_last(), F.col("start"), F.col("system_id")]
    return results.where("status = 'ok'").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
