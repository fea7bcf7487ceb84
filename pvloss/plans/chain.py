"""The daily analysis as steps over the feeds: frames for Spark, statements for DuckDB."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from ..functions.common import dealt, odd, stored, z
from ..functions.settings import DEFAULT as S
from ..operators import detect, frame, reference
from . import feeds

_kept: dict[tuple, object] = {}


def state(spark, sf_dir) -> tuple:
    """What the feeds read: number and bytes of the files, and a hash of their names, sizes and times. One row comes to the driver."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in feeds.TABLES]).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def shared(build):
    """build(spark, sf_dir), a table or some tables, written to the shared folder once for each session and state of the files below
    sf_dir; queries of the session read them. Nothing is held in memory."""

    @wraps(build)
    def get(spark, sf_dir):
        key = (build, spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir))
        if key not in _kept:
            made = build(spark, sf_dir)
            _kept[key] = tuple(stored(t, build.__name__) for t in made) if isinstance(made, tuple) else stored(made, build.__name__)
        return _kept[key]

    return get


def forget() -> None:
    """Later queries write their tables anew."""
    _kept.clear()


@shared
def daily(spark, sf_dir):
    """The daily feed, written once, so that its calendar, weather and systems don't scan lineitem each."""
    return feeds.daily(spark, sf_dir)


@shared
def base(spark, sf_dir):
    """The frame with the performance index."""
    feed = daily(spark, sf_dir)
    rows = feed.count()
    days = frame.on_calendar(feed.select("system_id", "date", "energy_kwh", "valid"), rows=rows)
    weather = dealt(feed.select("system_id", "date", "ghi", "clear_ghi", "t2m_c", "precip_mm"), ["system_id", "date"], rows)
    return frame.build_frame(days, weather, feeds.systems(spark, sf_dir, daily))


def outages(spark, sf_dir):
    return reference.find_outages(base(spark, sf_dir))


@shared
def calibrated(spark, sf_dir):
    return reference.calibrate(outages(spark, sf_dir))


@shared
def analysis(spark, sf_dir):
    return detect.analyse_with_noise(base(spark, sf_dir))


def analysed(spark, sf_dir):
    return analysis(spark, sf_dir)[0]


@shared
def measured_noise(spark, sf_dir):
    return detect.noise_profile(analysed(spark, sf_dir))


def noise(spark, sf_dir):
    """The noise_profile() of analysed(): what the analysis has made anyway, or else measured on the frame."""
    f = analysed(spark, sf_dir)
    made = [t[1] for t in _kept.values() if isinstance(t, tuple) and t[0] is f]
    return made[0] if made else measured_noise(spark, sf_dir)


def _resid(name, source, value, days, least):
    return f"""{name} AS (SELECT system_id, date, dn, v / t - 1e0 AS resid FROM (
      SELECT system_id, date, dn, {value} AS v,
             CASE WHEN count(*) OVER w >= {least} THEN median({value}) OVER w END AS t
      FROM {source} WHERE {value} IS NOT NULL
      WINDOW w AS (PARTITION BY system_id ORDER BY dn RANGE BETWEEN {days // 2} PRECEDING AND {days // 2} FOLLOWING)) q WHERE t IS NOT NULL)"""


def _sustained(name, source, value):
    return f"""{name} AS (SELECT system_id, date, dn, CASE WHEN count(*) OVER w >= {S.sustained_min_days}
             AND max(dn) OVER w - min(dn) OVER w <= {S.sustained_max_span_days} THEN median({value}) OVER w END AS sustained
      FROM {source} WHERE {value} IS NOT NULL
      WINDOW w AS (PARTITION BY system_id ORDER BY dn ROWS BETWEEN {S.sustained_days // 2} PRECEDING AND {S.sustained_days // 2} FOLLOWING))"""


def _sigma(value):
    return f"CASE WHEN count({value}) >= 5 THEN 1.4826e0 * mad({value}) END"


def noise_steps(w, source="fo", p=""):
    """Residuals, medians and threshold of one window; names begin with p."""
    trend = max(S.trend_window_days, odd(S.trend_window_multiple * w))
    return f"""{_resid(f"{p}nres{w}", source, "pi_clear", trend, S.trend_min_clear_days)},
    {p}nmed{w} AS (SELECT system_id, CASE WHEN count(resid) OVER w >= {S.smoothing_min_clear_days} THEN median(resid) OVER w END AS m
      FROM (SELECT f.system_id, f.dn, r.resid FROM {source} f JOIN (SELECT system_id, min(dn) AS a, max(dn) AS b FROM {p}nres{w} GROUP BY 1) e
              ON f.system_id = e.system_id AND f.dn BETWEEN e.a AND e.b
            LEFT JOIN {p}nres{w} r ON r.system_id = f.system_id AND r.dn = f.dn) q
      WINDOW w AS (PARTITION BY system_id ORDER BY dn RANGE BETWEEN {odd(w) // 2} PRECEDING AND {odd(w) // 2} FOLLOWING)),
    {p}nse{w} AS (SELECT s.system_id, n.se, CASE WHEN n.se IS NOT NULL THEN greatest({S.min_shortfall_fraction!r}, {z(1 - S.false_alarm_rate)!r} * n.se) END AS th
      FROM (SELECT DISTINCT system_id FROM {source}) s LEFT JOIN (SELECT system_id, {_sigma("m")} AS se FROM {p}nmed{w} GROUP BY 1) n USING (system_id))"""


def _smooth(w):
    return f"""sr{w} AS (SELECT system_id, date, dn, CASE WHEN count(clear_ratio) OVER w >= {S.smoothing_min_clear_days} THEN median(clear_ratio) OVER w END AS raw
      FROM fc WINDOW w AS (PARTITION BY system_id ORDER BY dn RANGE BETWEEN {odd(w) // 2} PRECEDING AND {odd(w) // 2} FOLLOWING)),
    sp{w} AS (SELECT *, last_value(raw IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN raw IS NOT NULL THEN dn END IGNORE NULLS) OVER b AS pd,
                first_value(raw IGNORE NULLS) OVER a AS qv, first_value(CASE WHEN raw IS NOT NULL THEN dn END IGNORE NULLS) OVER a AS qd FROM sr{w}
      WINDOW b AS (PARTITION BY system_id ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS (PARTITION BY system_id ORDER BY dn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    sm{w} AS (SELECT system_id, date, coalesce(raw, CASE WHEN qd IS NOT NULL AND dn - pd <= {S.max_bridge_days} THEN pv + (qv - pv) * ((dn - pd)::DOUBLE / (qd - pd)) END) AS v FROM sp{w})"""


MID = ", ".join(map(str, reference.MID_MONTH))
W0, W1 = S.windows_days
CTES = f"""
spine AS (SELECT system_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM feed_daily GROUP BY system_id),
f0 AS (SELECT s.system_id, s.date, s.date - DATE '1970-01-01' AS dn, f.energy_kwh, coalesce(f.valid, false) AS valid, f.ghi, f.clear_ghi,
              CASE WHEN f.clear_ghi > 0 THEN f.ghi / f.clear_ghi END AS clearness, f.t2m_c, f.precip_mm
       FROM spine s LEFT JOIN feed_daily f USING (system_id, date)),
f1 AS (SELECT *, 24e0 / pi() * acos(least(greatest(-tan(radians(latitude)) * tan(radians(23.45e0) * sin(2e0 * pi() * (284 + dayofyear(date)) / 365e0)), -1e0), 1e0)) AS day_hours
       FROM f0 JOIN (SELECT system_id, latitude, capacity_kwp FROM systems) s USING (system_id)),
f2 AS (SELECT *, ghi * capacity_kwp * (1e0 + {S.temp_coeff_per_c!r} * (t2m_c + {(S.noct_c - 20) / 800!r} * (ghi * 1000e0 / day_hours) - 25e0)) AS model_kwh FROM f1),
f3 AS (SELECT *, coalesce(valid AND energy_kwh IS NOT NULL AND ghi >= {S.min_daily_irradiation} AND model_kwh > 0, false) AS usable FROM f2),
fb AS (SELECT *, CASE WHEN usable THEN energy_kwh / model_kwh END AS pi, usable AND coalesce(clearness >= {S.clear_day_min_clearness}, false) AS clear FROM f3),
fo0 AS (SELECT *, median(CASE WHEN clear THEN pi END) OVER (PARTITION BY system_id) AS typical FROM fb),
fo1 AS (SELECT *, coalesce(valid AND clearness >= {S.outage_min_clearness} AND pi < {S.outage_max_fraction} * typical, false) AS outage FROM fo0),
fo AS (SELECT *, CASE WHEN clear AND NOT outage THEN pi END AS pi_clear FROM fo1),
{_sustained("sus", "fo", "pi_clear")},
{_resid("res", "fo", "pi_clear", S.trend_window_days, S.trend_min_clear_days)},
{_sustained("susres", "res", "resid")},
luck AS (SELECT s.system_id, l.se AS se_sustained, coalesce({z(S.reference_quantile)!r} * l.se, 0e0) AS luck FROM (SELECT DISTINCT system_id FROM fo) s
         LEFT JOIN (SELECT system_id, {_sigma("sustained")} AS se FROM susres GROUP BY 1) l USING (system_id)),
monthly AS (SELECT m.system_id, m.month, m.n, CASE WHEN n >= {S.reference_min_days} THEN q END AS raw, CASE WHEN n >= {S.reference_min_days} THEN q END * (1e0 - luck) AS value
  FROM (SELECT system_id, CAST(month(date) AS INT) AS month, count(*) AS n, quantile_cont(sustained, {S.reference_quantile}) AS q FROM sus WHERE sustained IS NOT NULL GROUP BY 1, 2) m JOIN luck USING (system_id)),
anchors AS (SELECT system_id, unnest([-365, 0, 365]) + [{MID}][month] AS doy, value AS at FROM monthly WHERE value IS NOT NULL),
curve0 AS (SELECT d.system_id, d.doy, max(a.doy) FILTER (a.doy <= d.doy) AS pd, arg_max(a.at, a.doy) FILTER (a.doy <= d.doy) AS pv,
                  min(a.doy) FILTER (a.doy >= d.doy) AS qd, arg_min(a.at, a.doy) FILTER (a.doy >= d.doy) AS qv
  FROM (SELECT DISTINCT system_id, unnest(range(1, 366)) AS doy FROM anchors) d JOIN anchors a USING (system_id) GROUP BY 1, 2),
curve AS (SELECT system_id, CAST(doy AS INT) AS doy, CASE WHEN qd = pd THEN pv ELSE pv + (qv - pv) * ((doy - pd)::DOUBLE / (qd - pd)) END AS reference FROM curve0),
fc0 AS (SELECT f.*, c.reference, f.model_kwh * c.reference AS expected_kwh, f.pi / c.reference AS ratio FROM fo f LEFT JOIN curve c ON c.system_id = f.system_id AND c.doy = least(dayofyear(f.date), 365)),
fc AS (SELECT *, CASE WHEN clear AND NOT outage THEN ratio END AS clear_ratio FROM fc0),
{noise_steps(W0)}, {noise_steps(W1)},
noise AS (SELECT system_id, {W0} AS window_days, round(se, 5) AS se, round(th, 5) AS threshold, round(th + {z(S.power)!r} * se, 5) AS detection_limit FROM nse{W0}
          UNION ALL SELECT system_id, {W1}, round(se, 5), round(th, 5), round(th + {z(S.power)!r} * se, 5) FROM nse{W1}),
{_smooth(W0)}, {_smooth(W1)},
tr0 AS (SELECT f.*, t0.threshold AS t0, t1.threshold AS t1, CASE WHEN t0.threshold IS NOT NULL THEN a.v END AS s0, CASE WHEN t1.threshold IS NOT NULL THEN b.v END AS s1
  FROM fc f JOIN sm{W0} a USING (system_id, date) JOIN sm{W1} b USING (system_id, date)
  JOIN (SELECT * FROM noise WHERE window_days = {W0}) t0 ON t0.system_id = f.system_id JOIN (SELECT * FROM noise WHERE window_days = {W1}) t1 ON t1.system_id = f.system_id),
tr AS (SELECT *, coalesce(s0 < 1e0 - t0, false) OR coalesce(s1 < 1e0 - t1, false) AS below, coalesce(s0, s1) AS smooth_ratio,
              {S.release_ratio} * least(t0, t1) AS release FROM tr0),
run0 AS (SELECT *, CASE WHEN below THEN dn - sum(below::INT) OVER (PARTITION BY system_id ORDER BY dn) END AS run FROM tr),
run1 AS (SELECT *, below AND count(*) OVER (PARTITION BY system_id, run) >= {S.min_episode_days} AS seed, coalesce(smooth_ratio < 1e0 - release, false) AS allowed FROM run0),
ext0 AS (SELECT *, seed OR coalesce(lag(seed) OVER w, false) OR coalesce(lead(seed) OVER w, false) AS touch,
                sum(CASE WHEN allowed THEN 0 ELSE 1 END) OVER w AS isle FROM run1 WINDOW w AS (PARTITION BY system_id ORDER BY dn)),
ext AS (SELECT *, seed OR (allowed AND bool_or(touch AND allowed) OVER (PARTITION BY system_id, isle, allowed)) AS keep FROM ext0),
fd0 AS (SELECT *, CASE WHEN keep THEN coalesce(least(greatest(1e0 - smooth_ratio, 0e0), 1e0), 0e0) ELSE 0e0 END AS loss_fraction FROM ext),
fd AS (SELECT *, keep AND loss_fraction > 0 AS flagged FROM fd0),
isl AS (SELECT *, dn - row_number() OVER (PARTITION BY system_id ORDER BY dn) AS island FROM fd WHERE flagged),
episodes AS (SELECT system_id, min(date) AS start, max(date) AS "end", count(*) AS days, round(100 * avg(loss_fraction), 1) AS mean_shortfall_pct, round(100 * max(loss_fraction), 1) AS max_shortfall_pct
  FROM isl GROUP BY system_id, island),
loss0 AS (SELECT *, valid AND expected_kwh IS NOT NULL AS countable FROM fd),
loss1 AS (SELECT system_id, coalesce(sum(expected_kwh) FILTER (countable), 0) AS expected_kwh,
    coalesce(sum(expected_kwh * loss_fraction) FILTER (countable AND NOT outage), 0) AS sustained_kwh,
    coalesce(sum(greatest(expected_kwh - energy_kwh, 0)) FILTER (countable AND outage), 0) AS outage_kwh,
    coalesce(sum(expected_kwh * loss_fraction) FILTER (countable AND NOT outage AND loss_fraction > {S.deep_fraction}), 0) AS deep_kwh,
    count(*) FILTER (countable AND NOT outage AND loss_fraction > {S.deep_fraction}) AS deep_days, count(*) FILTER (countable) AS days_assessed,
    min(date) AS first_day, max(date) AS last_day FROM loss0 GROUP BY 1),
loss AS (SELECT *, sustained_kwh - deep_kwh AS moderate_kwh, sustained_kwh + outage_kwh AS lost_kwh,
                CASE WHEN expected_kwh > 0 THEN 100 * (sustained_kwh + outage_kwh) / expected_kwh END AS loss_pct FROM loss1)"""


def statement(select: str, more: str = "") -> str:
    """A DuckDB statement over the feeds and the steps above, with `more` steps after them."""
    return f"WITH {feeds.CTES}, {CTES}{', ' + more if more else ''}\n{select}"
