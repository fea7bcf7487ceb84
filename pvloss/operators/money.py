"""Money, emissions, labels and totals of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import row_window
from ..functions.settings import DEFAULT, Settings

DEFAULT_LABEL = "Real system data"


def data_labels(sources: DataFrame, systems: DataFrame, default: str = DEFAULT_LABEL) -> DataFrame:
    """systems with data_label: the name of the first source that lists the system, else the default.
    sources (source_no, name, system_ids) are a short list and are aggregated before the join."""
    first = sources.select("source_no", "name", F.explode("system_ids").alias("system_id")).groupBy("system_id").agg(F.min_by("name", "source_no").alias("_label"))
    return systems.join(first, "system_id", "left").withColumn("data_label", F.coalesce("_label", F.lit(default))).drop("_label")


MONEY_RANGES = ("money_lost_lo", "money_lost_hi", "money_lost_per_month_lo", "money_lost_per_month_hi", "moderate_per_month_lo", "moderate_per_month_hi")


def economics(loss: DataFrame, systems: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """loss (system_id, lost_kwh, moderate_kwh, period_days[, lost_lo, lost_hi, moderate_lo, moderate_hi]) ->
    months, money lost in all and a month, their ranges, cleaning verdict: the range of what the moderate
    shortfall costs a month against the price of a cleaning. No tariff or price: not available; no range:
    uncertain. Money is rounded half to even."""
    m = F.col("period_days") / s.days_per_month
    got = loss.join(systems.select("system_id", "tariff", "cleaning_cost"), "system_id", "left")
    end = lambda name: F.col(name) if name in loss.columns else F.lit(None).cast("double")
    worth = lambda kwh, by=F.lit(1.0): kwh * F.col("tariff") / by
    verdict = (
        F.when(F.col("tariff").isNull() | F.col("cleaning_cost").isNull(), "not available")
        .when(worth(end("moderate_lo"), m) > F.col("cleaning_cost"), "pays")
        .when(worth(end("moderate_hi"), m) < F.col("cleaning_cost"), "does not pay")
        .otherwise("uncertain")
    )
    values = {"money_lost": worth(F.col("lost_kwh")), "money_lost_per_month": worth(F.col("lost_kwh"), m), "moderate_per_month": worth(F.col("moderate_kwh"), m)}
    for e in ("lo", "hi"):
        values |= {f"money_lost_{e}": worth(end(f"lost_{e}")), f"money_lost_per_month_{e}": worth(end(f"lost_{e}"), m), f"moderate_per_month_{e}": worth(end(f"moderate_{e}"), m)}
    return got.withColumns({"months": F.round(m, 1), "verdict": verdict, "has_tariff": F.col("tariff").isNotNull(), **{k: F.bround(v, 0) for k, v in values.items()}})


def emissions(loss: DataFrame, factor_kg_per_kwh: float | None) -> DataFrame:
    """Adds emissions_kg of the lost energy, and its range where lost_lo and lost_hi are there; null where no
    factor is known."""
    factor = F.lit(factor_kg_per_kwh).cast("double")
    ranges = {f"emissions_kg_{e}": factor * F.col(f"lost_{e}") for e in ("lo", "hi") if f"lost_{e}" in loss.columns}
    return loss.withColumns({"emissions_kg": factor * F.col("lost_kwh"), **ranges})


def portfolio(loss: DataFrame) -> DataFrame:
    """loss (data_label, status, lost_kwh, expected_kwh) -> totals of each label over systems that are ok."""
    got = loss.where("status = 'ok'").groupBy("data_label").agg(F.count("*").alias("systems"), F.sum("lost_kwh").alias("lost_kwh"), F.sum("expected_kwh").alias("expected_kwh"))
    return got.withColumn("loss_pct", F.when(F.col("expected_kwh") > 0, 100 * F.col("lost_kwh") / F.col("expected_kwh")))


def portfolio_ranges(replicates: DataFrame, loss: DataFrame, systems: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """replicates (system_id, replicate, lost, expected), loss (system_id, status, lost_kwh, expected_kwh) and systems
    (system_id, data_label, tariff) -> portfolio() of each label with lost_lo, lost_hi, loss_pct_lo, loss_pct_hi, money_lost, money_lo,
    money_hi. Replicates are added index by index over the systems that are ok, lost and expected of one draw together, and ranges
    are widened to hold their points. A label has ranges only if each such system has replicates, and money only if
    each has a tariff: its point adds the systems' rounded sums, its replicates are worth each system's own tariff."""
    ok = loss.where("status = 'ok'").select("system_id", "status", "lost_kwh", "expected_kwh").join(systems.select("system_id", "data_label", "tariff"), "system_id")
    money = ok.groupBy("data_label").agg(F.when(F.bool_and(F.col("tariff").isNotNull()), F.sum(F.bround(F.col("lost_kwh") * F.col("tariff"), 0))).alias("money_lost"))
    points = portfolio(ok).join(money, "data_label")
    r = replicates.join(ok.select("system_id", "data_label", "tariff"), "system_id")
    summed = r.groupBy("data_label", "replicate").agg(F.count("*").alias("n"), F.sum("lost").alias("lost"), F.sum("expected").alias("expected"), F.sum(F.col("lost") * F.col("tariff")).alias("money"))
    summed = summed.withColumn("loss_pct", F.try_divide(100 * F.col("lost"), F.col("expected")))
    tail = (1 - s.confidence) / 2
    kinds = ("lost", "loss_pct", "money")
    ends = summed.groupBy("data_label").agg(F.min("n").alias("_n"), *[F.percentile(c, [tail, 1 - tail]).alias(f"_{c}") for c in kinds])
    ends = ends.select("data_label", "_n", *[F.col(f"_{c}")[n].alias(f"_{c}_{e}") for c in kinds for n, e in enumerate(("lo", "hi"))])
    d = points.join(ends, "data_label", "left")
    whole = F.col("_n") == F.col("systems")
    known = {"lost": ("lost_kwh", whole), "loss_pct": ("loss_pct", whole), "money": ("money_lost", whole & F.col("money_lost").isNotNull())}
    widened = [F.when(have, f(f"_{c}_{e}", point)).alias(f"{c}_{e}") for c, (point, have) in known.items() for e, f in (("lo", F.least), ("hi", F.greatest))]
    return d.select("data_label", "systems", "lost_kwh", "expected_kwh", "loss_pct", "money_lost", *widened)


def portfolio_replicates(replicates: DataFrame, systems: DataFrame, tariff: bool = False) -> DataFrame:
    """replicates (system_id, replicate, lost) -> data_label, replicate, lost: added index by index; with
    tariff each system's money, null for labels with a system that has none."""
    r = replicates.join(systems.select("system_id", "data_label", "tariff"), "system_id")
    value = F.col("lost") * F.col("tariff") if tariff else F.col("lost")
    total = F.sum(value)
    return r.groupBy("data_label", "replicate").agg((F.when(F.bool_and(value.isNotNull()), total)).alias("lost"))


def percentile_interval(samples: DataFrame, keys, value: str, confidence: float = DEFAULT.confidence) -> DataFrame:
    """keys -> lo, hi: the central share of the replicates, nulls skipped."""
    tail = (1 - confidence) / 2
    both = samples.groupBy(*keys).agg(F.percentile(value, [tail, 1 - tail]).alias("_ends"))
    return both.select(*keys, F.col("_ends")[0].alias("lo"), F.col("_ends")[1].alias("hi"))


def most_complete(systems: DataFrame) -> DataFrame:
    """data_label -> the system with the highest completeness, the first id on ties."""
    first = F.row_number().over(Window.partitionBy("data_label").orderBy(F.desc("completeness_pct"), "system_id"))
    return systems.withColumn("_n", first).where("_n = 1").drop("_n")


def run_quality(f: DataFrame, monthly: DataFrame, s: Settings = DEFAULT, keys=("system_id",)) -> DataFrame:
    """keys -> days without weather, valid days whose state can't be told, deep-drop days, and the months that
    borrow their reference from others. monthly: monthly_reference()."""
    deep = F.col("flagged") & (F.col("loss_fraction") > s.deep_fraction)
    got = f.groupBy(*keys).agg(
        F.count_if(F.col("ghi").isNull()).alias("days_without_weather"),
        F.count_if(F.col("valid") & F.col("smooth_ratio").isNull() & ~F.col("outage")).alias("not_assessable"),
        F.count_if(deep).alias("deep_drop_days"),
    )
    own = monthly.where("value is not null").groupBy(*keys).agg(F.collect_set("month").alias("_own"))
    borrowed = F.array_except(F.sequence(F.lit(1), F.lit(12)), F.coalesce("_own", F.array().cast("array<int>")))
    return got.join(own, [*keys], "left").withColumn("borrowed_months", F.concat_ws(",", borrowed.cast("array<string>"))).drop("_own")


def headline(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """rows (data_label, system_id, start, end, subdaily, location, latitude, longitude, detection_limit) ->
    headline figures of each dataset. Months are those of the longest series; places are named, or given by
    coordinates where no system has a name."""
    named = F.sort_array(F.collect_set(F.when(F.trim("location") != "", F.trim("location"))))
    placed = F.sort_array(F.collect_set(F.format_string("%.2f°, %.2f°", "latitude", "longitude")))
    return rows.groupBy("data_label").agg(
        F.count("*").alias("systems"), F.min("start").alias("period_start"), F.max("end").alias("period_end"),
        F.bround(F.max(F.datediff("end", "start")) / s.days_per_month, 0).cast("bigint").alias("months"),
        F.when(F.bool_and("subdaily"), "hourly").otherwise("daily").alias("resolution"),
        F.array_join(F.when(F.size(named) > 0, named).otherwise(placed), "; ").alias("locations"),
        F.min("detection_limit").alias("limit_min"), F.max("detection_limit").alias("limit_max"),
        F.concat_ws(",", F.sort_array(F.collect_set("system_id"))).alias("system_ids"),
    )


def running_mean(value: str, keys, rows: int = 7, least: int = 3) -> Column:
    w = row_window(keys, rows)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def expected_vs_actual(f: DataFrame, keys=("system_id",)) -> DataFrame:
    """Centred running means of measured and expected energy, and the gap where measured is lower."""
    known = f.withColumn("a", running_mean("energy_kwh", keys)).withColumn("e", running_mean("expected_kwh", keys))
    return known.select(*keys, "date", F.col("a").alias("actual"), F.col("e").alias("expected"), F.when(F.col("a") < F.col("e"), F.col("e") - F.col("a")).alias("gap"))


def normalised_series(f: DataFrame, rain_mm: float = 1.0, floor: float = 0.4, keys=("system_id",)) -> DataFrame:
    """keys -> points shown, days with rain, points under the floor."""
    return f.groupBy(*keys).agg(F.count("clear_ratio").alias("points"), F.count_if(F.col("precip_mm") >= rain_mm).alias("rain_days"), F.count_if(F.col("clear_ratio") < floor).alias("below_floor"))


def nested(base: DataFrame, structs: dict[str, DataFrame], arrays: dict[str, DataFrame], key: str) -> DataFrame:
    """base with each part of `structs` (one row a key) as a struct column, null where the key has none, and each part of
    `arrays` (some rows a key, few) as an array of structs in the order of their columns, empty where there is none."""
    whole = lambda part: F.struct(*[c for c in part.columns if c != key])
    for name, part in structs.items():
        base = base.join(part.select(key, whole(part).alias(name)), key, "left")
    for name, part in arrays.items():
        rows = part.groupBy(key).agg(F.sort_array(F.collect_list(whole(part))).alias(name))
        base = base.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return base


LOSS = ("loss_pct", "lost_kwh", "sustained_kwh", "deep_kwh", "moderate_kwh", "outage_kwh", "expected_kwh", "days_assessed")
RANGES = tuple(f"{k}_{e}" for k in ("loss_pct", "lost", "sustained", "deep", "moderate", "outage") for e in ("lo", "hi"))
MONEY = ("months", "money_lost", "money_lost_per_month", "moderate_per_month", *MONEY_RANGES)


def system_records(systems: DataFrame, completeness: DataFrame, loss: DataFrame, noise: DataFrame, episodes: DataFrame, causes: DataFrame, recovery: DataFrame, factor: float | None, s: Settings = DEFAULT) -> DataFrame:
    """The whole result of each system as one nested row. systems (system_id, name, data_label, tariff, cleaning_cost, subdaily),
    loss (estimate_loss() with the columns of loss_ranges() and period_days), causes (system_id, cause, status), recovery (the clearest
    event of a system). Systems without an estimate have their period and completeness, and nulls beside."""
    priced = emissions(economics(loss, systems, s), factor)
    have = lambda names: [c for c in names if c in priced.columns]
    ok = F.when(F.col("estimated_loss.expected_kwh") > 0, "ok").otherwise("no estimate")
    period = completeness.select("system_id", F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.round(F.datediff("period_end", "period_start") / s.days_per_month, 1).alias("months"))
    base = systems.select("system_id", "name", "data_label", F.when(F.col("subdaily"), "hourly").otherwise("daily").alias("input_resolution"))
    structs = {"period": period, "completeness": completeness, "estimated_loss": priced.select("system_id", *have((*LOSS, *RANGES))).withColumn("confidence", F.lit(s.confidence)), "recovery": recovery, "money": priced.select("system_id", *have(MONEY)), "emissions": priced.select("system_id", *have(("emissions_kg", "emissions_kg_lo", "emissions_kg_hi")))}
    d = nested(base, structs, {"detection_limit": noise, "episodes": episodes, "causes": causes}, "system_id")
    return d.join(priced.select("system_id", "verdict"), "system_id", "left").withColumn("status", ok)


def dataset_records(systems: DataFrame, totals: DataFrame, validation: DataFrame, rates: DataFrame, steps: DataFrame) -> DataFrame:
    """One nested row for each dataset: its systems, its totals (portfolio_ranges()) and the validation of each of its systems:
    validate(), the detection rates and the reliable steps."""
    labelled = lambda part: part.join(systems.select("system_id", "data_label"), "system_id").select("data_label", *part.columns)
    base = systems.groupBy("data_label").agg(F.sort_array(F.collect_list("system_id")).alias("system_ids"))
    return nested(base, {"totals": totals}, {"validation": labelled(validation), "detection_rates": labelled(rates), "reliable_steps": labelled(steps)}, "data_label")
