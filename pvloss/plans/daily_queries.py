"""Queries over the daily analysis, each with its statement for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, frame, reference
from . import chain, feeds
from .chain import statement

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, more: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = statement(sql, more)
        return f

    return add


def rounded(df, *columns, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("m01_clearness", "SELECT system_id, date, round(clearness, 5) AS clearness FROM f0 WHERE ghi IS NOT NULL")
def _(spark, d):
    return rounded(frame.clearness(feeds.daily(spark, d)).select("system_id", "date", "clearness"), "clearness")


@query("m02_day_length", "SELECT DISTINCT date, round(day_hours, 6) AS day_hours FROM f1 WHERE ghi IS NOT NULL")
def _(spark, d):
    f = feeds.daily(spark, d).select("date").distinct()
    return f.select("date", F.round(frame.day_length_hours(F.col("date"), F.lit(26.77)), 6).alias("day_hours"))


@query("m03_daily_model", "SELECT system_id, date, round(model_kwh, 5) AS model_kwh FROM f2")
def _(spark, d):
    return rounded(chain.base(spark, d).select("system_id", "date", "model_kwh"), "model_kwh")


@query("m06_build_frame", "SELECT system_id, date, energy_kwh, valid, ghi, clear_ghi, t2m_c, precip_mm FROM f2")
def _(spark, d):
    return chain.base(spark, d).select("system_id", "date", "energy_kwh", "valid", "ghi", "clear_ghi", "t2m_c", "precip_mm")


@query("m08_performance_index", "SELECT system_id, date, round(pi, 5) AS pi, clear FROM fb")
def _(spark, d):
    return rounded(chain.base(spark, d).select("system_id", "date", "pi", "clear"), "pi")


@query("i14_calendar", "SELECT system_id, date FROM spine")
def _(spark, d):
    return chain.base(spark, d).select("system_id", "date")


@query("d01_outages", "SELECT system_id, date FROM fo WHERE outage")
def _(spark, d):
    return chain.outages(spark, d).where("outage").select("system_id", "date")


@query("r01_robust_sigma", f"SELECT system_id, round({chain._sigma('pi_clear')}, 6) AS sigma FROM fo WHERE pi_clear IS NOT NULL GROUP BY 1")
def _(spark, d):
    from ..functions.common import robust_sigma

    return rounded(robust_sigma(chain.outages(spark, d), "pi_clear", ["system_id"], "sigma"), "sigma", digits=6)


@query("r02_sustained", "SELECT system_id, date, round(sustained, 6) AS sustained FROM sus")
def _(spark, d):
    return rounded(reference.sustained(chain.outages(spark, d), "pi_clear"), "sustained", digits=6)


@query("r03_relative_residuals", "SELECT system_id, date, round(resid, 6) AS resid FROM res")
def _(spark, d):
    return rounded(reference.relative_residuals(chain.outages(spark, d), "pi_clear", 61, 10), "resid", digits=6)


@query("r04_luck_allowance", "SELECT system_id, round(se_sustained, 6) AS se_sustained, round(luck, 6) AS luck FROM luck")
def _(spark, d):
    return rounded(reference.luck_allowance(chain.outages(spark, d)), "se_sustained", "luck", digits=6)


@query("r05_monthly_reference", "SELECT system_id, month, n, round(raw, 6) AS raw, round(value, 6) AS value FROM monthly")
def _(spark, d):
    return rounded(reference.monthly_reference(chain.outages(spark, d)), "raw", "value", digits=6)


@query("r06_yearly_curve", "SELECT system_id, doy, round(reference, 6) AS reference FROM curve")
def _(spark, d):
    return rounded(reference.yearly_curve(reference.monthly_reference(chain.outages(spark, d))), "reference", digits=6)


@query("r07_expected", "SELECT system_id, date, round(expected_kwh, 4) AS expected_kwh, round(ratio, 5) AS ratio FROM fc")
def _(spark, d):
    f = chain.calibrated(spark, d).select("system_id", "date", "expected_kwh", "ratio")
    return f.withColumn("expected_kwh", F.round("expected_kwh", 4)).withColumn("ratio", F.round("ratio", 5))


@query("d02_noise_profile", "SELECT * FROM noise")
def _(spark, d):
    return detect.noise_profile(chain.outages(spark, d))


@query("d02_day_noise", f"SELECT system_id, c.clear_share, round(n.day_sigma, 5) AS day_sigma FROM (SELECT system_id, round(count(*) FILTER (clear)::DOUBLE / greatest(count(*) FILTER (valid), 1), 3) AS clear_share FROM fo GROUP BY 1) c LEFT JOIN (SELECT system_id, {chain._sigma('resid')} AS day_sigma FROM res GROUP BY 1) n USING (system_id)")
def _(spark, d):
    return detect.day_noise(chain.outages(spark, d))


@query("d03_smooth_ratio", f"SELECT system_id, date, round(v, 6) AS smooth FROM sm{chain.W0}")
def _(spark, d):
    return detect.smooth(chain.calibrated(spark, d), "clear_ratio", {"smooth": chain.W0}).select("system_id", "date", F.round("smooth", 6).alias("smooth"))


@query("d04_trigger", "SELECT system_id, date, below, round(smooth_ratio, 6) AS smooth_ratio FROM tr")
def _(spark, d):
    f = chain.calibrated(spark, d)
    return rounded(detect.triggers(f, detect.noise_profile(f)).select("system_id", "date", "below", "smooth_ratio"), "smooth_ratio", digits=6)


@query("d05_long_runs", "SELECT system_id, date FROM run1 WHERE seed")
def _(spark, d):
    return chain.analysed(spark, d).where("seed").select("system_id", "date")


@query("d06_extend", "SELECT system_id, date FROM ext WHERE keep")
def _(spark, d):
    return detect.extend(chain.analysed(spark, d), "seed", "allowed", "keep").where("keep").select("system_id", "date")


@query("d07_loss_fraction", "SELECT system_id, date, round(loss_fraction, 6) AS loss_fraction, flagged FROM fd")
def _(spark, d):
    return rounded(chain.analysed(spark, d).select("system_id", "date", "loss_fraction", "flagged"), "loss_fraction", digits=6)


@query("d08_episodes", "SELECT * FROM episodes")
def _(spark, d):
    return detect.episodes(chain.analysed(spark, d))


LOSS = ("expected_kwh", "sustained_kwh", "outage_kwh", "deep_kwh", "moderate_kwh", "lost_kwh", "loss_pct")
LOSS_SQL = ", ".join(f"round({c}, 4) AS {c}" for c in LOSS)


@query("d09_estimate_loss", f"SELECT system_id, deep_days, days_assessed, {LOSS_SQL} FROM loss")
def loss(spark, d):
    return rounded(detect.estimate_loss(chain.analysed(spark, d)), *LOSS, digits=4)


@query("x07_analyse_frame", "SELECT system_id, date, round(reference, 5) AS reference, round(expected_kwh, 4) AS expected_kwh, round(smooth_ratio, 5) AS smooth_ratio, round(loss_fraction, 5) AS loss_fraction, flagged, outage FROM fd")
def _(spark, d):
    f = chain.analysed(spark, d).select("system_id", "date", F.round("reference", 5).alias("reference"), F.round("expected_kwh", 4).alias("expected_kwh"), F.round("smooth_ratio", 5).alias("smooth_ratio"), F.round("loss_fraction", 5).alias("loss_fraction"), "flagged", "outage")
    return f
