"""Queries over daily and monthly series of events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.geo import duration_normalize
from tessera.operators import detect, filters, joins, quantiles, ranking, series
from tessera.plans.registry import r6, rd, register, rounded, table

#: Daily medians per event type: the series most queries here run on.
DAILY_SQL = "SELECT event_type, CAST(ts AS DATE) AS day, median(value) AS x, stddev_samp(value) / sqrt(count(*)) AS s, count(*) AS n FROM events GROUP BY 1, 2"
#: Cells of a day x hour grid per event type, with a noise estimate; the factor keeps rounding away from ties.
CELL_SQL = "SELECT event_type, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hr, avg(value) * 0.7310585786 AS x, 5.0 / sqrt(count(*)) AS s FROM events GROUP BY 1, 2, 3"
SPLIT = "2024-01-21"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.median("value").alias("x"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("s"), F.count("*").alias("n")
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hr")).agg(
        (F.avg("value") * 0.7310585786).alias("x"), (5.0 / F.sqrt(F.count("*"))).alias("s")
    )


def baseline():
    return F.col("day") < F.lit(SPLIT).cast("date")


MODEL_SQL = f"""base AS (SELECT * FROM c WHERE day < DATE '{SPLIT}' AND x IS NOT NULL AND s > 0),
m1 AS (SELECT event_type, hr, count(*) AS n, median(x) AS center, median(s) AS ms FROM base GROUP BY 1, 2),
m2 AS (SELECT event_type, hr, 1.4826 * median(abs(x - center)) AS scale FROM base JOIN m1 USING (event_type, hr) GROUP BY 1, 2),
m AS (SELECT event_type, hr, n, n >= 15 AS supported, center, scale, ms, sqrt(greatest(scale * scale - ms * ms, 0)) AS excess FROM m1 JOIN m2 USING (event_type, hr))"""


@register(f"SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {rd('median(l_extendedprice)')} AS med, count(*) AS n FROM lineitem GROUP BY 1, 2")
def spatial_median_series(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date(F.trunc("l_shipdate", "month")).alias("month"), "l_extendedprice")
    m = quantiles.grouped_quantile(li, ["l_returnflag", "month"], "l_extendedprice", out="med")
    return m.select("l_returnflag", "month", r6("med").alias("med"), "n")


@register(
    f"""WITH l AS (SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_extendedprice AS v FROM lineitem),
c AS (SELECT l_returnflag, month, median(v) AS center FROM l GROUP BY 1, 2)
SELECT l_returnflag, month, count(*) AS n, {rd('1.4826 * median(abs(v - center))')} AS mad_sigma FROM l JOIN c USING (l_returnflag, month) GROUP BY 1, 2"""
)
def spatial_mad_series(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date(F.trunc("l_shipdate", "month")).alias("month"), F.col("l_extendedprice").alias("v"))
    m = stats.median_and_mad(li, ["l_returnflag", "month"], "v", most=quantiles.MOST)
    return m.select("l_returnflag", "month", "n", r6(stats.MAD_TO_SIGMA * F.col("mad")).alias("mad_sigma"))


@register(
    f"""WITH c AS ({CELL_SQL}), {MODEL_SQL}
SELECT event_type, hr, n, supported, CASE WHEN supported THEN {rd('center')} END AS center, CASE WHEN supported THEN {rd('scale')} END AS scale,
CASE WHEN supported THEN {rd('ms')} END AS median_sigma, CASE WHEN supported THEN {rd('excess')} END AS excess FROM m"""
)
def robust_baseline(spark, sf_dir):
    m = detect.robust_baseline(cells(spark, sf_dir), ["event_type", "hr"], "x", "s", baseline(), 15)
    return rounded(m, "center", "scale", "median_sigma", "excess")


@register(
    f"""WITH c AS ({CELL_SQL}), {MODEL_SQL}
SELECT event_type, hr, day, CASE WHEN supported THEN {rd('(x - center) / sqrt(s * s + excess * excess)')} END AS z FROM c LEFT JOIN m USING (event_type, hr)"""
)
def standardized_innovation(spark, sf_dir):
    c = cells(spark, sf_dir)
    model = detect.robust_baseline(c, ["event_type", "hr"], "x", "s", baseline(), 15)
    return rounded(detect.standardized(c, model, ["event_type", "hr"], "x", "s").select("event_type", "hr", "day", "z"), "z")


@register(
    f"""WITH c AS ({CELL_SQL}), b AS (SELECT * FROM c WHERE day < DATE '{SPLIT}'),
t AS (SELECT h.event_type, h.hr, h.day AS held, t.x, t.s FROM (SELECT DISTINCT event_type, hr, day FROM b) h JOIN b t ON h.event_type = t.event_type AND h.hr = t.hr AND h.day <> t.day),
m1 AS (SELECT event_type, hr, held, count(*) AS n, median(x) AS center, median(s) AS ms FROM t GROUP BY 1, 2, 3),
m2 AS (SELECT event_type, hr, held, 1.4826 * median(abs(x - center)) AS scale FROM t JOIN m1 USING (event_type, hr, held) GROUP BY 1, 2, 3),
m AS (SELECT * FROM m1 JOIN m2 USING (event_type, hr, held) WHERE n >= 10)
SELECT b.event_type, b.hr, b.day, {rd('(b.x - center) / sqrt(b.s * b.s + greatest(scale * scale - ms * ms, 0))')} AS z
FROM b LEFT JOIN m ON b.event_type = m.event_type AND b.hr = m.hr AND b.day = m.held"""
)
def leave_one_out_innovations(spark, sf_dir):
    c = cells(spark, sf_dir)
    out = detect.leave_one_out_z(c, ["event_type", "hr"], "day", "x", "s", baseline(), 10)
    return rounded(out.select("event_type", "hr", "day", "z"), "z")


@register(
    f"""WITH c AS ({CELL_SQL}), {MODEL_SQL}
SELECT day, {rd('quantile_cont(abs((x - center) / sqrt(s * s + excess * excess)), 0.9)')} AS energy FROM c JOIN m USING (event_type, hr) WHERE supported GROUP BY 1"""
)
def strain_energy(spark, sf_dir):
    c = cells(spark, sf_dir)
    model = detect.robust_baseline(c, ["event_type", "hr"], "x", "s", baseline(), 15)
    z = detect.standardized(c, model, ["event_type", "hr"], "x", "s").where("z IS NOT NULL")
    return rounded(detect.energy(z, ["day"], "z"), "energy")


@register(
    f"""WITH d AS ({DAILY_SQL}), m AS (SELECT event_type, median(x) AS c FROM d GROUP BY 1),
v AS (SELECT event_type, count(*) AS n, var_samp(x) AS v, median(power(greatest(s, 0), 2)) AS noise, median(abs(x - c)) AS mad FROM d JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, n, {rd('CASE WHEN n < 3 THEN 1.0 ELSE greatest(1.0, greatest(v, power(1.4826 * mad, 2)) - noise) END')} AS sill FROM v"""
)
def interval_sill(spark, sf_dir):
    return rounded(stats.interval_sill(daily(spark, sf_dir), ["event_type"], "x", "s"), "sill")


@register(
    f"""WITH l AS (SELECT l_returnflag, l_extendedprice AS x, 1 + l_quantity AS s FROM lineitem), w AS (SELECT l_returnflag, x, 1 / (s * s) AS w FROM l),
a AS (SELECT l_returnflag, sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * w) AS sww FROM w GROUP BY 1)
SELECT l_returnflag, {rd('sx / sw')} AS mean, {rd('sqrt(1 / sw)')} AS formal, round(sxx / sw - (sx / sw) * (sx / sw), 1) AS variance, {rd('sw * sw / sww')} AS n_eff FROM a"""
)
def inverse_variance_mean(spark, sf_dir):
    m = stats.inverse_variance_mean(F.col("l_extendedprice"), 1 + F.col("l_quantity"))
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[m[k].alias(k) for k in ("mean", "formal", "variance", "n_eff")])
    return rounded(out, "mean", "formal", "n_eff").withColumn("variance", F.round("variance", 1))


@register(
    f"""WITH a AS (SELECT p_brand, sum(p_size) AS sw, sum(p_size * x) / sum(p_size) AS mx, sum(p_size * y) / sum(p_size) AS my,
sum(p_size * x * x) / sum(p_size) AS xx, sum(p_size * x * y) / sum(p_size) AS xy, sum(p_size * y * y) / sum(p_size) AS yy
FROM (SELECT p_brand, p_size, (p_partkey % 101) / 10.0 AS x, p_retailprice / 1000 AS y FROM part) GROUP BY 1)
SELECT p_brand, {rd('mx')} AS mean_x, {rd('my')} AS mean_y, {rd('xx - mx * mx')} AS cov_xx, {rd('xy - mx * my')} AS cov_xy, {rd('yy - my * my')} AS cov_yy FROM a"""
)
def weighted_covariance(spark, sf_dir):
    c = stats.weighted_covariance(F.col("p_partkey") % 101 / F.lit(10.0), F.col("p_retailprice") / 1000, F.col("p_size"))
    out = table(spark, sf_dir, "part").groupBy("p_brand").agg(*[v.alias(k) for k, v in c.items()])
    return rounded(out, *c)


@register(
    f"""WITH l AS (SELECT l_returnflag AS g, l_extendedprice AS o, l_quantity * 1000 AS p, 1000 + 100 * l_linenumber AS s FROM lineitem)
SELECT g, {rd('least(greatest(quantile_cont(abs(o - p) / greatest(s, 1e-6), 0.9) / 1.64485, 0.25), 4.0)')} AS scale FROM l GROUP BY 1"""
)
def calibrate_uncertainty(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    scale = stats.uncertainty_scale(F.col("l_extendedprice"), F.col("l_quantity") * 1000, 1000.0 + 100 * F.col("l_linenumber"))
    return rounded(li.groupBy(F.col("l_returnflag").alias("g")).agg(scale.alias("scale")), "scale")


@register(
    f"""SELECT l_shipmode AS g, {rd('quantile_cont(v, 0.025)')} AS low, {rd('quantile_cont(v, 0.5)')} AS mid, {rd('quantile_cont(v, 0.975)')} AS high,
{rd('0.7413 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))')} AS scale FROM (SELECT l_linestatus AS l_shipmode, l_extendedprice AS v FROM lineitem) GROUP BY 1"""
)
def quantile_band(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), F.col("l_extendedprice").alias("v"))
    return rounded(quantiles.quantile_bands(prices, ["g"], "v"), "low", "mid", "high", "scale")


@register(
    f"""WITH o AS (SELECT o_orderpriority AS g, o_totalprice / 1000 AS t, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey / 10.0 END AS p FROM orders)
SELECT g, count(p) AS n, {rd('count(p) / count(t)')} AS coverage, {rd('avg(abs(p - t))')} AS mae, {rd('sqrt(avg((p - t) * (p - t)))')} AS rmse, {rd('avg(p - t)')} AS bias,
{rd('corr(CASE WHEN p IS NOT NULL THEN t END, p)')} AS r FROM o GROUP BY 1"""
)
def prediction_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = stats.prediction_metrics(F.col("o_totalprice") / 1000, F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") / F.lit(10.0)))
    out = o.groupBy(F.col("o_orderpriority").alias("g")).agg(*[v.alias(k) for k, v in m.items()])
    return rounded(out, "coverage", "mae", "rmse", "bias", "r")


METRIC_SQL = f"""count(e) AS n, {rd('median(e)')} AS median_bias, {rd('avg(abs(e))')} AS mae, {rd('sqrt(avg(e * e))')} AS rmse,
{rd('sqrt(avg(e * e / (s * s)))')} AS standardized_rms, {rd('avg(CASE WHEN abs(e / s) <= 1.64485 THEN 1.0 ELSE 0.0 END)')} AS coverage_90"""


@register(
    f"""WITH l AS (SELECT l_returnflag AS track, l_suppkey AS station, l_shipdate AS t, l_extendedprice / 1000 - l_quantity AS e, 10.0 + l_linenumber AS s FROM lineitem),
p AS (SELECT * FROM (VALUES ('all', DATE '1990-01-01', DATE '2010-01-01'), ('early', DATE '1995-01-01', DATE '1997-12-31'), ('middle', DATE '1997-01-01', DATE '1999-12-31'), ('late', DATE '1999-01-01', DATE '2001-12-31')) v(period, a, b)),
x AS (SELECT track, station, period, e, s FROM l JOIN p ON CAST(t AS DATE) BETWEEN a AND b)
SELECT track, period, coalesce(CAST(station AS VARCHAR), 'ALL') AS station, {METRIC_SQL} FROM x GROUP BY GROUPING SETS ((track, period), (track, period, station))
HAVING grouping(station) = 1 OR period = 'all'"""
)
def metric_rollup(spark, sf_dir):
    """Overlapping periods are exploded once; one grouping-sets aggregation serves all levels."""
    li = table(spark, sf_dir, "lineitem")
    periods = {"all": ("1990-01-01", "2010-01-01"), "early": ("1995-01-01", "1997-12-31"), "middle": ("1997-01-01", "1999-12-31"), "late": ("1999-01-01", "2001-12-31")}
    masks = filters.period_masks(F.to_date("l_shipdate"), periods)
    x = li.select(
        F.col("l_returnflag").alias("track"), F.col("l_suppkey").alias("station"), (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("e"),
        (10.0 + F.col("l_linenumber")).alias("s"), F.explode(F.array_compact(F.array(*[F.when(m, k) for k, m in masks.items()]))).alias("period"),
    )
    m = stats.residual_metrics(F.col("e"), F.col("s"), F.col("e"), F.col("e"))
    names = ["n", "median_bias", "mae", "rmse", "standardized_rms", "coverage_90"]
    g = x.groupingSets([["track", "period"], ["track", "period", "station"]], "track", "period", "station").agg(
        *[m[k].alias(k) for k in names], F.grouping("station").alias("top")
    )
    g = g.where((F.col("top") == 1) | (F.col("period") == "all"))
    return rounded(g.select("track", "period", F.coalesce(F.col("station").cast("string"), F.lit("ALL")).alias("station"), *names), *names[1:])


@register(
    f"""WITH sc AS (SELECT p_size AS bandwidth, avg(p_retailprice) / 100 AS rmse, stddev_samp(p_retailprice) / 100 / sqrt(count(*)) AS se FROM part GROUP BY 1 HAVING count(*) > 1),
b AS (SELECT rmse + se AS lim FROM sc ORDER BY rmse, bandwidth LIMIT 1) SELECT max(bandwidth) AS bandwidth FROM sc, b WHERE rmse <= lim"""
)
def one_standard_error(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    scores = p.groupBy(F.col("p_size").alias("bandwidth")).agg(
        (F.avg("p_retailprice") / 100).alias("rmse"), (F.stddev_samp("p_retailprice") / 100 / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n")
    ).where("n > 1")
    return ranking.one_standard_error(scores, "bandwidth", "rmse", "se")


CENTRED_SQL = f"d AS ({DAILY_SQL}), k AS (SELECT event_type, median(x) AS c FROM d GROUP BY 1), y AS (SELECT event_type, day, x - c AS x FROM d JOIN k USING (event_type))"


def centred(spark, sf_dir):
    d = daily(spark, sf_dir)
    c = d.groupBy("event_type").agg(F.median("x").alias("c"))
    return d.join(c, "event_type").select("event_type", "day", (F.col("x") - F.col("c")).alias("x"))


@register(
    f"""WITH {CENTRED_SQL}, s AS (SELECT *, sum(x - 0.5) OVER (PARTITION BY event_type ORDER BY day) AS s FROM y)
SELECT event_type, day, {rd('s - least(0, min(s) OVER (PARTITION BY event_type ORDER BY day))')} AS cusum FROM s"""
)
def page_cusum(spark, sf_dir):
    return rounded(series.page_cusum(centred(spark, sf_dir), "x", "day", ["event_type"]).select("event_type", "day", "cusum"), "cusum")


@register(
    f"""WITH {CENTRED_SQL}, b AS (SELECT event_type, day, max(x) OVER w AS m, count(*) OVER w AS n FROM y WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT event_type, day, {rd('m')} AS block_max FROM b WHERE n = 3"""
)
def sliding_block_maximum(spark, sf_dir):
    return rounded(series.sliding_block_maximum(centred(spark, sf_dir), "x", "day", 3, ["event_type"]).select("event_type", "day", "block_max"), "block_max")


@register(
    f"""WITH {CENTRED_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM y),
b AS (SELECT a.event_type, a.day, a.i AS st, b.i, b.x FROM i a JOIN i b ON a.event_type = b.event_type AND b.i BETWEEN a.i AND a.i + 3 WHERE a.i <= a.n - 3),
s AS (SELECT *, sum(x - 0.5) OVER (PARTITION BY event_type, st ORDER BY i) AS s FROM b),
c AS (SELECT event_type, day, s - least(0, min(s) OVER (PARTITION BY event_type, st ORDER BY i)) AS c FROM s)
SELECT event_type, day, {rd('max(c)')} AS block_cusum FROM c GROUP BY 1, 2"""
)
def sliding_block_cusum(spark, sf_dir):
    return rounded(series.sliding_block_cusum(centred(spark, sf_dir), "x", "day", 4, ["event_type"]).select("event_type", "day", "block_cusum"), "block_cusum")


@register(
    f"""WITH {CENTRED_SQL}, nl AS (SELECT round(x, 6) AS v FROM y WHERE day < DATE '{SPLIT}'), o AS (SELECT event_type, day, round(x, 6) AS v FROM y WHERE day >= DATE '{SPLIT}')
SELECT o.event_type, o.day, {rd('(1 + (SELECT count(*) FROM nl WHERE nl.v >= o.v)) / (1 + (SELECT count(*) FROM nl))')} AS p FROM o"""
)
def empirical_upper_tail(spark, sf_dir):
    y = rounded(centred(spark, sf_dir), "x")
    out = series.empirical_p(y.where(baseline()), y.where(~baseline()), "x", "x")
    return rounded(out.select("event_type", "day", "p"), "p")


@register(
    f"""WITH p AS (SELECT c_nationkey, c_custkey, (1 + (c_custkey * 7919) % 9973) / 10000.0 AS p FROM customer),
q AS (SELECT *, (count(*) OVER (PARTITION BY c_nationkey) - row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) + 1) * p AS q FROM p)
SELECT c_nationkey, c_custkey, {rd('least(1.0, max(q) OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey ROWS UNBOUNDED PRECEDING))')} AS p_holm FROM q"""
)
def holm_adjust(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", ((1 + F.col("c_custkey") * 7919 % 9973) / 10000.0).alias("p"))
    return rounded(series.holm_adjust(p, "p", ["c_nationkey"], tie="c_custkey").select("c_nationkey", "c_custkey", "p_holm"), "p_holm")


@register(
    f"""WITH {CENTRED_SQL}, i AS (SELECT event_type, day, x, count(*) OVER w AS n1, sum(x) OVER w AS s1, count(*) OVER (PARTITION BY event_type) AS n, sum(x) OVER (PARTITION BY event_type) AS s,
lead(day) OVER (PARTITION BY event_type ORDER BY day) AS split FROM y WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)),
r AS (SELECT event_type, split, n1, n1 * (n - n1) / CAST(n AS DOUBLE) * power((s - s1) / nullif(n - n1, 0) - s1 / n1, 2) AS red FROM i WHERE n1 >= 5 AND n - n1 >= 3)
SELECT event_type, split, {rd('red')} AS reduction FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY red DESC, n1) AS k FROM r) WHERE k = 1"""
)
def breakpoint_scan(spark, sf_dir):
    return rounded(series.best_mean_shift(centred(spark, sf_dir), "x", "day", ["event_type"], 5, 3), "reduction")


@register(
    f"""WITH {CENTRED_SQL}, g AS (SELECT event_type, day, CASE WHEN day(day) % 11 <> 0 THEN x END AS x FROM y)
SELECT event_type, day, CASE WHEN count(*) FILTER (x IS NULL) OVER w = 0 THEN {rd('sum(x) OVER w')} END AS cumulative FROM g WINDOW w AS (PARTITION BY event_type ORDER BY day)"""
)
def strict_cumulative(spark, sf_dir):
    g = centred(spark, sf_dir).withColumn("x", F.when(F.dayofmonth("day") % 11 != 0, F.col("x")))
    return rounded(series.strict_cumulative(g, "x", "day", ["event_type"]).select("event_type", "day", "cumulative"), "cumulative")


@register("SELECT c_custkey, c_nationkey, group_count FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS group_count FROM customer) WHERE group_count >= 5")
def full_groups(spark, sf_dir):
    return series.keep_full_groups(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 5).select("c_custkey", "c_nationkey", "group_count")


@register(
    f"""WITH d AS ({DAILY_SQL}), c AS (SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS DOUBLE) / sum(n) OVER (PARTITION BY event_type) AS c FROM d)
SELECT event_type, min(CASE WHEN c >= 0.025 - 1e-12 THEN day END) AS ci_low, min(CASE WHEN c >= 0.975 - 1e-12 THEN day END) AS ci_high FROM c GROUP BY 1"""
)
def credible_interval(spark, sf_dir):
    return series.credible_interval(daily(spark, sf_dir), "n", "day", ["event_type"]).select("event_type", "ci_low", "ci_high")


@register(f"WITH d AS ({DAILY_SQL}) SELECT event_type, day, {rd('x - lag(x) OVER (PARTITION BY event_type ORDER BY day)')} AS difference FROM d")
def first_differences(spark, sf_dir):
    return rounded(series.first_differences(daily(spark, sf_dir), "x", "day", ["event_type"]).select("event_type", "day", "difference"), "difference")


@register(
    """WITH RECURSIVE d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT a.d FROM d a JOIN d b ON b.d = a.d + 12),
g AS (SELECT min(d) AS s FROM p UNION ALL SELECT (SELECT min(p.d) FROM p WHERE p.d >= g.s + 24) FROM g WHERE g.s IS NOT NULL)
SELECT s AS start_date, s + 12 AS end_date FROM g WHERE s IS NOT NULL"""
)
def greedy_controls(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), F.lit(1).alias("one"))
    return series.greedy_intervals(d, "d", ["one"]).select("start_date", "end_date")


@register(
    f"""WITH {CENTRED_SQL}, r AS (SELECT event_type, sum(x * b) / sum(b * b) AS rho FROM (SELECT event_type, x, lag(x) OVER (PARTITION BY event_type ORDER BY day) AS b FROM y) WHERE b IS NOT NULL GROUP BY 1),
q AS (SELECT event_type, least(greatest(rho, -0.8), 0.8) AS rho FROM r)
SELECT event_type, day, {rd('rho')} AS rho, {rd('CASE WHEN row_number() OVER w = 1 THEN sqrt(1 - rho * rho) * x ELSE x - rho * lag(x) OVER w END')} AS whitened
FROM y JOIN q USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY day)"""
)
def prewhitened_series(spark, sf_dir):
    y = centred(spark, sf_dir)
    rho = series.lag_one_coefficient(y, "x", "day", ["event_type"])
    out = series.prewhiten(y.join(rho, "event_type"), "x", "day", F.col("rho"), ["event_type"])
    return rounded(out.select("event_type", "day", "rho", "whitened"), "rho", "whitened")


@register(
    f"""WITH {CENTRED_SQL}, t AS (SELECT i AS template, i + k AS dom, 1 / sqrt(5.0) AS g FROM range(1, 27) a(i), range(0, 5) b(k)),
s AS (SELECT event_type, template, sum(x * g) AS score FROM y JOIN t ON day(day) = dom GROUP BY 1, 2), e AS (SELECT event_type, sum(x * x) AS sse FROM y GROUP BY 1)
SELECT event_type, template, {rd('score')} AS score, {rd('CASE WHEN sse > score * score THEN score * score / ((sse - score * score) / 25) END')} AS statistic FROM s JOIN e USING (event_type)"""
)
def matched_filter(spark, sf_dir):
    y = centred(spark, sf_dir).select(F.col("event_type").alias("patch"), F.dayofmonth("day").alias("t"), F.col("x").alias("r"))
    t = spark.range(1, 27).select(F.col("id").alias("template"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    t = t.select("template", (F.col("template") + F.col("k")).cast("int").alias("t"), (1 / F.sqrt(F.lit(5.0))).alias("g"))
    out = series.matched_filter(y, t, 25).select(F.col("patch").alias("event_type"), "template", "score", "statistic")
    return rounded(out, "score", "statistic")


@register(
    f"""WITH d AS ({DAILY_SQL}), l AS (SELECT unnest([7, 12]) AS lag)
SELECT a.event_type, b.day AS start_date, a.day AS end_date, CAST(lag AS INT) AS lag, {rd('a.x - b.x')} AS change, {rd('sqrt(2.0) * a.s')} AS sigma
FROM d a CROSS JOIN l JOIN d b ON a.event_type = b.event_type AND b.day = a.day - CAST(lag AS INT)"""
)
def exact_lag_innovations(spark, sf_dir):
    out = joins.exact_lag_pairs(daily(spark, sf_dir), "day", "x", [7, 12], ["event_type"], "s")
    return rounded(out.select("event_type", "start_date", "end_date", "lag", "change", "sigma"), "change", "sigma")


@register(
    f"""WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2), l AS (SELECT o_custkey, day AS start_date, lead(day) OVER w AS end_date, lead(x) OVER w - x AS change FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day))
SELECT o_custkey, start_date, end_date, {rd('change')} AS change FROM l WHERE end_date - start_date = 12"""
)
def consecutive_gap_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    return rounded(joins.consecutive_pairs(d, "day", "x", ["o_custkey"], 12), "change")


@register(
    f"""WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2), l AS (SELECT o_custkey, day AS start_date, lead(day) OVER w AS end_date, lead(x) OVER w - x AS change FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day))
SELECT o_custkey, start_date, end_date, {rd('change / 3 / (end_date - start_date)')} AS rate FROM l WHERE end_date IS NOT NULL"""
)
def interval_rates(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    pairs = joins.consecutive_pairs(d, "day", "x", ["o_custkey"])
    rate, _ = duration_normalize(F.col("change") / 3, F.lit(1.0), F.datediff("end_date", "start_date"))
    return rounded(pairs.select("o_custkey", "start_date", "end_date", rate.alias("rate")), "rate")


@register(
    f"""WITH v AS (SELECT user_id, ts, avg(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1, 2), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
b AS (SELECT event_id, e.ts, max(v.ts) AS before_at, max_by(v.v, v.ts) AS before_value FROM e JOIN v ON e.user_id = v.user_id AND v.ts <= e.ts GROUP BY 1, 2),
a AS (SELECT event_id, min(v.ts) AS after_at, min_by(v.v, v.ts) AS after_value FROM e JOIN v ON e.user_id = v.user_id AND v.ts >= e.ts GROUP BY 1)
SELECT e.event_id, {rd('''CASE WHEN before_at = e.ts THEN before_value ELSE before_value + (epoch_us(e.ts) - epoch_us(before_at)) / nullif(CAST(epoch_us(after_at) - epoch_us(before_at) AS DOUBLE), 0) * (after_value - before_value) END''')} AS value
FROM e LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id)"""
)
def bracket_interpolation(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    right = ev.where("event_type <> 'error'").groupBy("user_id", "ts").agg(F.avg("value").alias("v"))
    left = ev.where("event_type = 'error'").select("event_id", "user_id", "ts")
    out = joins.interpolate_bracket(joins.bracket(left, right, ["user_id"], "ts", "v"), "ts")
    return rounded(out.select("event_id", "value"), "value")


@register(
    f"""WITH d AS ({DAILY_SQL}), t AS (SELECT event_type, day, date_diff('day', DATE '2024-01-01', day) AS t, x, 1 / (s * s) AS w FROM d WHERE s > 0),
a AS (SELECT event_type, sum(w) AS s, sum(w * t) AS st, sum(w * x) AS sy, sum(w * t * t) AS stt, sum(w * t * x) AS sty FROM t GROUP BY 1)
SELECT event_type, {rd('(stt * sy - st * sty) / (s * stt - st * st)')} AS intercept, {rd('(s * sty - st * sy) / (s * stt - st * st)')} AS slope,
{rd('(stt * sy - st * sty) / (s * stt - st * st) + 31 * (s * sty - st * sy) / (s * stt - st * st)')} AS predicted,
{rd('sqrt((stt - 62 * st + 961 * s) / (s * stt - st * st))')} AS sigma FROM a"""
)
def weighted_trend_endpoint(spark, sf_dir):
    t = F.datediff("day", F.lit("2024-01-01"))
    line = stats.weighted_line(t, F.col("x"), 1 / (F.col("s") * F.col("s")))
    fit = daily(spark, sf_dir).where("s > 0").groupBy("event_type").agg(*[v.alias(k) for k, v in line.items()])
    sigma = F.sqrt(F.col("var_intercept") + 62 * F.col("cov_intercept_slope") + 961 * F.col("var_slope"))
    return rounded(fit.select("event_type", "intercept", "slope", (F.col("intercept") + 31 * F.col("slope")).alias("predicted"), sigma.alias("sigma")), "intercept", "slope", "predicted", "sigma")


@register(
    f"""WITH d AS ({DAILY_SQL}), b AS (SELECT event_type, median(x) FILTER (day BETWEEN DATE '2024-01-03' AND DATE '2024-01-12') AS m, count(x) FILTER (day BETWEEN DATE '2024-01-03' AND DATE '2024-01-12') AS baseline_count FROM d GROUP BY 1)
SELECT event_type, day, baseline_count, CASE WHEN baseline_count >= 3 THEN {rd('x - m')} END AS referenced FROM d JOIN b USING (event_type)"""
)
def baseline_removed(spark, sf_dir):
    out = filters.remove_baseline_median(daily(spark, sf_dir), "x", "day", "2024-01-03", "2024-01-12", ["event_type"])
    return rounded(out.select("event_type", "day", "baseline_count", "referenced"), "referenced")


@register(
    f"""WITH c AS ({CELL_SQL})
SELECT day, {rd('median(x)')} AS med, {rd('quantile_cont(x, 0.25)')} AS q25, {rd('quantile_cont(x, 0.75)')} AS q75, count(*) AS n FROM c GROUP BY 1"""
)
def regional_series(spark, sf_dir):
    q = stats.quantile(F.col("x"), [0.25, 0.5, 0.75])
    g = cells(spark, sf_dir).groupBy("day").agg(q.alias("q"), F.count("*").alias("n"))
    return rounded(g.select("day", F.col("q")[1].alias("med"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "n"), "med", "q25", "q75")


@register(
    f"""WITH d AS ({DAILY_SQL}), w AS (SELECT event_type, day, x, row_number() OVER (PARTITION BY event_type ORDER BY x DESC, day) AS k FROM d)
SELECT event_type, day, {rd('x')} AS x, CAST(k AS INT) AS rank FROM w WHERE k <= 5"""
)
def ranked_days(spark, sf_dir):
    top = ranking.top_k(daily(spark, sf_dir), 5, [F.desc("x"), F.col("day")], ["event_type"])
    return rounded(top.select("event_type", "day", "x", "rank"), "x")


@register(
    f"""WITH {CENTRED_SQL}, i AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, x FROM y)
SELECT event_type, CAST(i AS INT) AS position, {rd('x')} AS x FROM i"""
)
def ordered_positions(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("day")) - 1
    return rounded(centred(spark, sf_dir).select("event_type", i.alias("position"), "x"), "x")


@register(
    f"""WITH {CENTRED_SQL} SELECT event_type, CAST(r AS INT) AS replicate, (SELECT count(*) FROM y z WHERE z.event_type = e.event_type) AS n
FROM (SELECT DISTINCT event_type FROM y) e, range(0, 20) t(r)"""
)
def moving_block_replicates(spark, sf_dir):
    """Replicates hold as many values as the series; block choice is hash-seeded."""
    out = series.block_resample(centred(spark, sf_dir), "x", "day", 20, 4, 2024, ["event_type"])
    return out.groupBy("event_type", "replicate").agg(F.count("*").alias("n"))
