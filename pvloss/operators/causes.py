"""Evidence for causes: outages, soiling, ageing, shading."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import KEYS, dealt, draw, islands, true, z
from ..functions.settings import DEFAULT, Settings
from ..functions.slopes import ranked_slopes
from .bootstrap import block_medians, resampled, uniforms


def runs(f: DataFrame, flag: str, keys=KEYS) -> DataFrame:
    """keys, start, end, days of each run of flagged days."""
    return islands(f, flag, keys).groupBy(*keys, "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")).drop("island")


def outage_evidence(f: DataFrame, days: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """The analysed frame and its days (keys, flag_gap: nothing usable was recorded) -> days of outage, of deep drops and
    of gaps, the level of the deep days, cold outage days, status. Days that are partial or impossible are no gaps."""
    deep = F.col("flagged") & ~F.col("outage") & (F.col("loss_fraction") > s.deep_fraction)
    got = f.groupBy(*keys).agg(
        F.count_if("outage").alias("outage_days"), F.count_if(deep).alias("deep_days"),
        F.median(F.when(deep, F.col("smooth_ratio"))).alias("deep_level"), F.count_if(F.col("outage") & (F.col("t2m_c") < s.cold_below_c)).alias("cold_outage_days"),
    )
    got = got.join(days.groupBy(*keys).agg(F.count_if("flag_gap").alias("gap_days")), [*keys], "left").na.fill(0, ["gap_days"])
    return got.withColumn("status", F.when((F.col("outage_days") > 0) | (F.col("deep_days") > 0), "indicated").otherwise("not indicated"))


def cleaning_dates(f: DataFrame, dated: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, date of heavy rain or a recorded cleaning, each once."""
    rain = f.where(true(F.col("precip_mm") >= s.heavy_rain_mm)).select(*keys, "date")
    return rain.unionByName(dated.where("type = 'cleaning'").select(*keys, "date")).distinct()


def soiling_points(f: DataFrame, cuts: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Clear fault-free days with the interval between cleanings they lie in: part, opens (the cleaning
    before, or the first clear day), first_day, last_day, n, x (days since first_day), and usable where the
    interval has enough points and days. Days without irradiation weigh nothing."""
    points = f.where("clear and not fault and ratio is not null").select(*keys, "date", F.col("ratio").alias("y"), F.coalesce("ghi", F.lit(0.0)).alias("ghi"))
    none = F.lit(None).cast("double")
    both = points.withColumn("_cut", F.lit(None).cast("date")).unionByName(cuts.select(*keys, "date", none.alias("y"), none.alias("ghi"), F.col("date").alias("_cut")))
    # A cut opens a new interval on its own day.
    w = Window.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(Window.unboundedPreceding, 0)
    d = both.withColumns({"part": F.count("_cut").over(w), "opens": F.max("_cut").over(w)}).where("y is not null").drop("_cut")
    d = d.withColumn("opens", F.coalesce("opens", F.min("date").over(Window.partitionBy(*keys))))
    w = Window.partitionBy(*keys, "part")
    d = d.withColumn("n", F.count("*").over(w)).withColumn("first_day", F.min("date").over(w)).withColumn("last_day", F.max("date").over(w))
    usable = (F.col("n") >= s.soiling_min_points) & (F.datediff("last_day", "first_day") >= s.soiling_min_days)
    return d.withColumn("x", F.datediff("date", "first_day")).withColumn("usable", usable)


def soiling_intervals(f: DataFrame, cuts: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """The points of intervals that are long enough for a slope."""
    return soiling_points(f, cuts, s, keys).where("usable").drop("usable")


def theil_sen(points: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, part, slope (median of pairwise slopes over the interval's median), level, n, first_day, last_day, and
    sd: half the rank-based band of the slope (Sen 1968, ties allowed for) over the median. A series meets in one group, which
    works through its intervals; slopes are selected by rank, in memory linear in the points."""
    rows = points.select(*keys, "part", "x", "y", "first_day", "last_day")
    types = dict(points.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in (*keys, "part")), *(f"{k} {t}" for k, t in RESULT.items())])

    def work(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("x", "ascending")])
        part, x, y = t.column("part").to_numpy(), t.column("x").to_numpy().astype(float), t.column("y").to_numpy().astype(float)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(first[1:], len(part))
        some = ends - first > 1
        first, ends = first[some], ends[some]
        numbers = np.array([_slope(x[a:b], y[a:b], s) for a, b in zip(first, ends, strict=True)]).reshape(-1, 4)
        raw, over, level, sd = (pa.array(numbers[:, k], pa.float64(), from_pandas=True) for k in range(4))
        of = t.take(pa.array(first))
        n = pa.array(ends - first, pa.int64())
        return pa.table([*[pa.repeat(k, len(first)) for k in key], of.column("part"), raw, over, level, n, of.column("first_day"), of.column("last_day"), sd], names=[*keys, "part", *RESULT])

    return dealt(rows, keys).groupBy(*keys).applyInArrow(work, schema)


def _slope(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[float, float, float, float]:
    """raw, slope, level and sd of the points of one interval in order of x."""
    n = len(x)
    m = n * (n - 1) // 2
    spread = lambda k: k * (k - 1) * (2 * k + 5)
    ties = spread(np.unique(y, return_counts=True)[1].astype(float)).sum()
    half, level = z((1 + s.slope_band) / 2) * np.sqrt((spread(float(n)) - ties) / 18.0), float(np.median(y))
    ranks = [(m - 1) // 2, m // 2, int(max(np.rint((m - half) / 2) - 1, 0)), int(min(np.rint((m + half) / 2), m - 1))]
    below, above, lo, hi = ranked_slopes(x, y, ranks)
    middle = (below + above) / 2
    over = lambda v: v / level if level else np.nan
    return middle, over(middle), level, max(over((hi - lo) / 2), 1e-9)


RESULT = {"raw": "double", "slope": "double", "level": "double", "n": "bigint", "first_day": "date", "last_day": "date", "sd": "double"}


def _kept(slope: Column) -> Column:
    """What soiling leaves of a day's energy; all of it outside usable intervals."""
    lost = 1.0 + F.least(slope, F.lit(0.0)) * F.datediff("date", "opens")
    return F.coalesce(F.greatest(F.least(lost, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def soiling_ratio(points: DataFrame, slopes: DataFrame, keys=KEYS) -> DataFrame:
    """points (all of soiling_points) and slopes -> keys, soiling_ratio, soiling_loss_pct: 1 + min(slope, 0) x
    days since the interval opened, weighted by irradiation; 1 on days outside usable intervals."""
    d = points.join(slopes.select(*keys, "part", "slope"), [*keys, "part"], "left")
    got = d.groupBy(*keys).agg(F.try_divide(F.sum(_kept(F.col("slope")) * F.col("ghi")), F.sum("ghi")).alias("soiling_ratio"), F.count("slope").alias("_n")).where("_n > 0").drop("_n")
    return got.withColumn("soiling_loss_pct", 100 * (1 - F.col("soiling_ratio")))


def soiling_draws(points: DataFrame, slopes: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, replicate, soiling_ratio with every slope drawn again from a normal of its own band. The points of a series
    meet its slopes once, and the draws are made beside them."""
    both = points.join(slopes.select(*keys, "part", "slope", "sd"), [*keys, "part"], "left")
    rows = both.select(*keys, "part", F.datediff("date", "opens").alias("_x"), "ghi", "slope", "sd")
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("replicate", T.IntegerType()), T.StructField("soiling_ratio", T.DoubleType())])

    def work(key: tuple, t: pa.Table) -> pa.Table:
        own, reps = [k.as_py() for k in key], np.arange(s.soiling_reps)
        ghi, known = t.column("ghi").to_numpy(), np.asarray(t.column("slope").is_valid())
        part, x = t.column("part").to_numpy()[known], t.column("_x").to_numpy()[known]
        parts, first, of = np.unique(part, return_index=True, return_inverse=True)
        slope, sd = (t.column(c).to_numpy()[known][first] for c in ("slope", "sd"))
        ratio = np.full(len(reps), np.nan)
        if len(parts) and ghi.sum():
            texts = np.array([f"{p}|{r}|".encode() for r in reps for p in parts.tolist()])
            u = [uniforms((s.seed, *own), np.strings.add(texts, name)).reshape(len(reps), -1) for name in (b"a", b"b")]
            drawn = slope + np.sqrt(-2.0 * np.log(1.0 - u[0])) * np.cos(2 * math.pi * u[1]) * sd
            kept = ((1.0 - np.clip(1.0 + np.minimum(d, 0.0)[of] * x, 0.0, 1.0)) @ ghi[known] for d in drawn)
            ratio = 1.0 - np.fromiter(kept, float, len(reps)) / ghi.sum()
        some = np.flatnonzero(np.isfinite(ratio))
        return pa.table([*[pa.repeat(k, len(some)) for k in key], pa.array(reps[some].astype(np.int32)), pa.array(ratio[some])], names=schema.names)

    return dealt(rows, keys).groupBy(*keys).applyInArrow(work, schema)


def soiling_range(draws: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, loss_lo, loss_hi in percent."""
    tail = (1 - s.confidence) / 2
    return draws.groupBy(*keys).agg((100 * (1 - F.percentile("soiling_ratio", 1 - tail))).alias("loss_lo"), (100 * (1 - F.percentile("soiling_ratio", tail))).alias("loss_hi"))


def shuffled_losses(f: DataFrame, cuts: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, run, soiling_loss_pct of the same clear-day ratios in a drawn order: what scatter alone gives."""
    own = [*keys, "run"]
    runs = F.explode(F.sequence(F.lit(0), F.lit(s.soiling_shuffle_runs - 1))).alias("run")
    days = f.where("clear and not fault and ratio is not null").select(*keys, "date", "ratio", "ghi", runs)
    order = draw(F.lit(str(s.seed)), *[F.col(k) for k in keys], F.col("run").cast("string"), F.col("date").cast("string"))
    days = days.withColumn("_p", F.row_number().over(Window.partitionBy(*own).orderBy("date"))).withColumn("_q", F.row_number().over(Window.partitionBy(*own).orderBy(order, "date")))
    values = days.select(*own, F.col("_q").alias("_p"), "ratio")
    mixed = days.drop("ratio", "_q").join(values, [*own, "_p"]).withColumns({"clear": F.lit(True), "fault": F.lit(False)})
    points = soiling_points(mixed, cuts.select(*keys, "date", runs), s, own)
    return soiling_ratio(points, theil_sen(points.where("usable"), s, own), own).select(*own, "soiling_loss_pct")


def soiling_status(points: DataFrame, ranges: DataFrame, s: Settings = DEFAULT, keys=KEYS, events: DataFrame | None = None, nulls: DataFrame | None = None) -> DataFrame:
    """keys, clear_days, loss_lo, floor_pct, status, and with events (keys, change_pct, distinguishable) the
    tested ones and the rises among them. nulls (shuffled_losses) can only raise the floor."""
    d = points.groupBy(*keys).agg(F.count("*").alias("clear_days")).join(ranges.select(*keys, F.round("loss_lo", 2).alias("loss_lo")), [*keys], "left")
    floor = F.lit(s.soiling_min_loss_pct)
    if nulls is not None:
        d = d.join(nulls.groupBy(*keys).agg(F.max("soiling_loss_pct").alias("_null")), [*keys], "left")
        floor = F.greatest(floor, "_null")
    known = (F.col("clear_days") >= s.soiling_min_clear_days) & F.col("loss_lo").isNotNull()
    d = d.withColumn("floor_pct", floor).withColumn("status", F.when(~known, "insufficient data").when(F.col("loss_lo") > F.col("floor_pct"), "indicated").otherwise("not indicated"))
    if events is not None:
        seen = events.groupBy(*keys).agg(F.count("*").alias("tested"), F.count_if(true(F.col("distinguishable") & (F.col("change_pct") > 0))).alias("rises"))
        d = d.join(seen, [*keys], "left").na.fill(0, ["tested", "rises"])
    return d.drop("_null")


def year_pairs(f: DataFrame, keys=KEYS) -> DataFrame:
    """keys, date, change: percent from each clear fault-free day to the day 365 days later."""
    p = f.where("clear and not fault and pi is not null").select(*keys, "date", "pi")
    later = p.select(*keys, F.date_sub("date", 365).alias("date"), F.col("pi").alias("after"))
    return p.join(later, [*keys, "date"]).select(*keys, "date", (100 * (F.try_divide("after", "pi") - 1)).alias("change")).where("change is not null")


def year_on_year_range(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, change_lo, change_hi, status of series that year_on_year can measure: medians of pairs drawn again
    in blocks; ageing is indicated where the whole range is below zero."""
    ok = year_on_year(f, s, keys).where("status = 'ok'").select(*keys)
    drawn = resampled(year_pairs(f, keys).join(ok, [*keys], "left_semi"), {"change": "_m"}, block_medians, s.samples, s.degradation_block_days, s, keys)
    tail = (1 - s.confidence) / 2
    got = drawn.groupBy(*keys).agg(F.percentile("_m", tail).alias("change_lo"), F.percentile("_m", 1 - tail).alias("change_hi"))
    return got.withColumn("status", F.when(F.col("change_hi") < 0, "indicated").otherwise("not indicated"))


def year_on_year(f: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, pairs, change_pct_per_year, status: the median of year_pairs, if the series is long enough."""
    pairs = year_pairs(f, keys).groupBy(*keys).agg(F.count("*").alias("pairs"), F.median("change").alias("m"))
    span = f.groupBy(*keys).agg((F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"))
    enough = (F.col("pairs") >= s.degradation_min_pairs) & (F.col("years") > s.degradation_min_years)
    return span.join(pairs, [*keys], "left").select(*keys, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(true(enough), F.col("m")).alias("change_pct_per_year"), F.when(true(enough), "ok").otherwise("insufficient data").alias("status"))


def shading_base(measured: DataFrame, model: DataFrame, days: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """measured (keys, hour_ts, actual_kwh), model (keys, hour_ts, elevation, model_kwh) and days (keys, date, clear, fault) ->
    hours known in both, on clear days without fault, with the sun high enough and a model: ratio r of measured to
    modelled energy. Cloudy days would show the weather and not the site."""
    both = measured.select(*keys, "hour_ts", "actual_kwh").join(model.select(*keys, "hour_ts", "elevation", "model_kwh"), [*keys, "hour_ts"])
    d = both.where((F.col("elevation") >= s.shading_min_elevation_deg) & (F.col("model_kwh") > 0) & F.col("actual_kwh").isNotNull())
    d = d.withColumns({"date": F.to_date("hour_ts"), "hour": F.hour("hour_ts"), "month": F.month("hour_ts"), "r": F.col("actual_kwh") / F.col("model_kwh")})
    good = days.where(true(F.col("clear")) & ~true(F.col("fault"))).select(*keys, "date")
    return d.join(good, [*keys, "date"], "left_semi")


def daily_shape(base: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """Adds shape: the hour's ratio over the median ratio of the day's strongest hours."""
    rank = F.row_number().over(Window.partitionBy(*keys, "date").orderBy(F.desc("model_kwh"), "hour"))
    d = base.withColumn("_k", rank)
    midday = F.median(F.when(F.col("_k") <= s.midday_hours, F.col("r"))).over(Window.partitionBy(*keys, "date"))
    return d.withColumn("shape", F.try_divide("r", midday)).drop("_k")


def clock_check(base: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, offset, summer and winter offsets in minutes, clock_ok: where the day's energy is centred. Without days of
    both seasons the clock can't be trusted."""
    day = base.groupBy(*keys, "date", "month").agg((F.try_divide(F.sum(F.col("actual_kwh") * F.col("hour")), F.sum("actual_kwh")) - F.try_divide(F.sum(F.col("model_kwh") * F.col("hour")), F.sum("model_kwh"))).alias("h"))
    m = lambda months: 60 * F.median(F.when(F.col("month").isin(*months), F.col("h")))
    got = day.groupBy(*keys).agg((60 * F.median("h")).alias("offset_min"), m(s.summer_months).alias("summer_min"), m(s.winter_months).alias("winter_min"))
    seasonal = F.abs(F.col("summer_min") - F.col("winter_min")) <= s.clock_max_seasonal_minutes
    return got.withColumn("clock_ok", true(F.abs("offset_min") <= s.clock_max_offset_minutes) & true(seasonal))


def recurring_dips(shaped: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, month, hour, days, median_shape, dip_share, is_dip."""
    got = shaped.where("shape is not null").groupBy(*keys, "month", "hour").agg(F.count("*").alias("days"), F.median("shape").alias("median_shape"), F.avg((F.col("shape") < 1 - s.dip_fraction).cast("int")).alias("dip_share"))
    return got.withColumn("is_dip", (F.col("days") >= s.shading_min_clear_days) & (F.col("dip_share") >= s.dip_min_share_of_days))


def dip_hours(dips: DataFrame, keys=KEYS) -> DataFrame:
    """recurring_dips() -> keys, hour, months (in order), dip_pct: what the hours with dips lose, as the median over months."""
    return dips.where("is_dip").groupBy(*keys, "hour").agg(F.sort_array(F.collect_set("month")).alias("months"), (100 * (1 - F.median("median_shape"))).alias("dip_pct"))


def symmetry(shaped: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """keys, morning, afternoon, difference, indicated: the shape at low sun before and after the day's peak of the model.
    A model's errors at low sun lower both alike, an obstruction one of them."""
    peak = shaped.groupBy(*keys, "date").agg(F.max_by("hour", F.struct("model_kwh", -F.col("hour"))).alias("peak"))
    low = shaped.where(F.col("elevation") < s.shading_min_elevation_deg + s.symmetry_band_deg).join(peak, [*keys, "date"])
    got = low.groupBy(*keys).agg(F.median(F.when(F.col("hour") < F.col("peak"), F.col("shape"))).alias("morning"), F.median(F.when(F.col("hour") > F.col("peak"), F.col("shape"))).alias("afternoon"))
    return got.withColumn("difference", F.col("morning") - F.col("afternoon")).withColumn("indicated", true(F.abs("difference") >= s.symmetry_min_difference))


def shading_status(systems: DataFrame, shaped: DataFrame, s: Settings = DEFAULT, keys=KEYS) -> DataFrame:
    """systems (keys, subdaily) and daily_shape() -> one verdict for each: daily input can't be assessed, nor can a clock that
    is off; without hours there are too few data; recurring dips that lie on one side of the day are indicated. dips
    counts months and hours with dips, side tells where they lie."""
    dips = recurring_dips(shaped, s, keys)
    hours = dip_hours(dips, keys).groupBy(*keys).agg(F.min("hour").alias("_a"), F.max("hour").alias("_b"))
    count = dips.groupBy(*keys).agg(F.count_if("is_dip").alias("dips"))
    d = systems.select(*keys, "subdaily").join(clock_check(shaped, s, keys), [*keys], "left").join(count, [*keys], "left").join(hours, [*keys], "left").join(symmetry(shaped, s, keys), [*keys], "left")
    side = F.when(F.col("_b") < 12, "morning").when(F.col("_a") >= 12, "afternoon").when(F.col("_a").isNotNull(), "both ends of the day")
    status = (
        F.when(~true(F.col("subdaily")), "cannot be assessed").when(F.col("dips").isNull(), "insufficient data").when(~F.col("clock_ok"), "cannot be assessed")
        .when((F.col("dips") > 0) & true(F.col("indicated")), "indicated").otherwise("not indicated")
    )
    tested = status.isin("indicated", "not indicated")
    dipped = tested & (F.col("dips") > 0)
    return d.select(*keys, status.alias("status"), "offset_min", "summer_min", "winter_min", F.when(tested, F.col("dips")).alias("dips"), F.when(dipped, side).alias("side"), F.when(dipped, F.col("morning")).alias("morning"), F.when(dipped, F.col("afternoon")).alias("afternoon"))
