"""Queries of the summaries, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import summaries
from tessera.plans.registry import rd, register, rounded, table


def daily(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day"), (F.col("user_id") % 40).alias("cell")).agg(F.avg("value").alias("x"), F.max("event_id").alias("m"))


DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, user_id % 40 AS cell, avg(value) AS x, max(event_id) AS m FROM events GROUP BY 1, 2, 3"


@register(f"SELECT event_type, day, count(x) AS n, {rd('median(x)')} AS median, {rd('quantile_cont(x, 0.25)')} AS q25, {rd('quantile_cont(x, 0.75)')} AS q75 FROM ({DAILY}) GROUP BY 1, 2")
def band_summary(spark, sf_dir):
    return rounded(summaries.band_summary(daily(spark, sf_dir), ["event_type", "day"], "x"), "median", "q25", "q75")


@register(
    f"""WITH l AS (SELECT l_returnflag, unnest(['l_quantity', 'l_tax', 'l_discount']) AS component, unnest([CAST(l_quantity AS DOUBLE), l_tax, l_discount]) AS v FROM lineitem)
SELECT l_returnflag, component, count(v) AS n, {rd('median(v)')} AS median, {rd('quantile_cont(v, 0.25)')} AS q25, {rd('quantile_cont(v, 0.75)')} AS q75 FROM l GROUP BY 1, 2"""
)
def component_series(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax", "l_discount")])
    return rounded(summaries.component_series(li, ["l_returnflag"], ["l_quantity", "l_tax", "l_discount"]), "median", "q25", "q75")


@register(
    f"SELECT l_linestatus, l_returnflag, count(*) AS n, {rd('median(abs(l_tax - 0.04))')} AS median_abs, {rd('median(l_tax - 0.04)')} AS median, count(*) FILTER (l_quantity > 25) AS large FROM lineitem WHERE l_discount > 0.02 GROUP BY 1, 2"
)
def interval_strain_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_tax") - 0.04)
    out = summaries.interval_summary(li, ["l_linestatus", "l_returnflag"], "d", valid=F.col("l_discount") > 0.02, flags={"large": F.col("l_quantity") > 25})
    return rounded(out, "median_abs", "median")


@register(
    f"""WITH s AS (SELECT l_suppkey, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), th AS (SELECT quantile_cont(v, 0.2) AS lo, quantile_cont(v, 0.8) AS hi FROM s),
f AS (SELECT l_suppkey, CASE WHEN v <= lo THEN 'lower' WHEN v >= hi THEN 'upper' END AS lobe FROM s, th)
SELECT lobe, l_returnflag, count(*) AS n, {rd('median(l_quantity)')} AS median, {rd('sqrt(avg(l_quantity * l_quantity))')} AS rms, {rd('avg(CASE WHEN abs(l_quantity) >= 1.96 * 20 THEN 1.0 ELSE 0.0 END)')} AS beyond FROM lineitem JOIN f USING (l_suppkey) WHERE lobe IS NOT NULL GROUP BY 1, 2"""
)
def lobe_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("sigma", F.lit(20.0))
    ref = li.where("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("v"))
    out = summaries.lobe_summary(li, summaries.frozen_members(ref, ["l_suppkey"], "v"), ["l_suppkey"], ["l_returnflag"], "l_quantity", "sigma")
    return rounded(out, "median", "rms", "beyond")


@register(
    f"""WITH r AS (SELECT o_orderpriority, CAST(o_custkey % 5 AS VARCHAR) AS station, o_totalprice / 1000 AS v, o_orderdate AS d FROM orders), m AS (SELECT o_orderpriority, unnest([station, 'ALL']) AS station, v, d FROM r),
p AS (SELECT *, 'all' AS period FROM m UNION ALL SELECT *, 'late' FROM m WHERE d >= TIMESTAMP '1995-01-01' UNION ALL SELECT *, 'last' FROM m WHERE d >= TIMESTAMP '1997-01-01')
SELECT o_orderpriority, period, station, count(*) AS n, {rd('avg(v)')} AS mean, {rd('max(v)')} AS largest FROM p GROUP BY 1, 2, 3"""
)
def period_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 5).alias("station"), (F.col("o_totalprice") / 1000).alias("v"), F.col("o_orderdate").alias("d"))
    since = lambda day: F.col("d") >= F.lit(day).cast("timestamp")
    out = summaries.rollup(
        o, ["o_orderpriority"], "station", {"n": F.count("*"), "mean": F.avg("v"), "largest": F.max("v")}, periods={"all": F.lit(True), "late": since("1995-01-01"), "last": since("1997-01-01")}
    )
    return rounded(out, "mean", "largest")


@register(f"SELECT event_type, count(DISTINCT cell) AS members, count(*) AS n, min(day) AS first, max(day) AS last FROM ({DAILY}) GROUP BY 1")
def product_summary(spark, sf_dir):
    return summaries.product_summary(daily(spark, sf_dir), ["event_type"], "cell", "day")


@register(
    f"""WITH a AS (SELECT cell, day, x FROM ({DAILY}) WHERE event_type = 'click'), b AS (SELECT cell, day, x FROM ({DAILY}) WHERE event_type = 'view'), j AS (SELECT a.x AS a, b.x AS b, b.x - a.x AS d FROM a JOIN b USING (cell, day))
SELECT count(*) AS n, {rd('sqrt(avg(d * d))')} AS rms, {rd('max(abs(d))')} AS worst, {rd('median(d)')} AS median, {rd('median(abs(d))')} AS median_abs, {rd('quantile_cont(abs(d), 0.95)')} AS p95_abs, {rd('quantile_cont(d, 0.02)')} AS p02, {rd('quantile_cont(d, 0.98)')} AS p98,
{rd('corr(a, b)')} AS r, {rd('sum(a * b) / sum(a * a)')} AS slope, {rd('avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0.0 END)')} AS sign_agreement FROM j"""
)
def product_differences(spark, sf_dir):
    d = daily(spark, sf_dir)
    side = lambda k: d.where(F.col("event_type") == k).select("cell", "day", "x")
    out = summaries.paired_differences(side("click"), side("view"), ["cell", "day"], "x")
    return rounded(out, *[c for c in out.columns if c != "n"])


@register(
    f"""WITH p AS (SELECT p_brand, p_size, p_retailprice AS v, p_size % 3 <> 0 AS ok FROM part), q AS (SELECT p_brand, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM p WHERE ok GROUP BY 1)
SELECT p_brand, p_size, v, {rd('CASE WHEN b > a THEN 1 - least(greatest((v - a) / (b - a), 0), 1) ELSE 0 END')} AS score FROM p LEFT JOIN q USING (p_brand)"""
)
def eligible_unit_score(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", F.col("p_retailprice").alias("v"))
    return rounded(summaries.unit_score(p, "v", eligible=F.col("p_size") % 3 != 0, invert=True, keys=["p_brand"]), "score")


@register("SELECT day FROM (SELECT CAST(ts AS DATE) AS day FROM events INTERSECT SELECT CAST(DATE '2024-01-05' + CAST(l_linenumber AS INT) AS DATE) FROM lineitem)")
def common_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    li = table(spark, sf_dir, "lineitem").select(F.date_add(F.lit("2024-01-05").cast("date"), F.col("l_linenumber").cast("int")).alias("day"))
    return summaries.common_values([e, li], "day")


@register(
    f"""WITH d AS ({DAILY}), s AS (SELECT cell, median(1 + m % 7) AS sigma FROM d WHERE day < DATE '2024-01-15' GROUP BY 1),
i AS (SELECT day, count(*) AS n, var_samp(x) AS v, median(power(1 + m % 7, 2)) AS noise, median(x) AS c FROM d WHERE day < DATE '2024-01-15' GROUP BY 1), k AS (SELECT day, median(abs(x - c)) AS mad FROM d JOIN i USING (day) GROUP BY 1),
sill AS (SELECT median(CASE WHEN n < 3 THEN 1.0 ELSE greatest(1.0, greatest(v, power(1.4826 * mad, 2)) - noise) END) AS sill, count(*) AS n_intervals FROM i JOIN k USING (day))
SELECT cell, {rd('sigma')} AS sigma, {rd('sill')} AS sill, n_intervals FROM s, sill"""
)
def frozen_medians(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("s", (1 + F.col("m") % 7).cast("double"))
    sigmas, sills = summaries.frozen_medians(d, ["cell"], "day", "x", "s", before=F.col("day") < F.lit("2024-01-15").cast("date"))
    return rounded(sigmas.join(F.broadcast(sills), F.lit(True)), "sigma", "sill")


@register(
    f"""WITH l AS (SELECT l_returnflag AS k, l_linenumber AS e, CAST(l_quantity AS DOUBLE) AS x, l_quantity * 0.2 + l_discount * 100 AS y FROM lineitem), m AS (SELECT k, e, median(x) AS mx, median(y) AS my FROM l GROUP BY 1, 2),
c AS (SELECT k, x - mx AS x, y - my AS y FROM l JOIN m USING (k, e)), s AS (SELECT k, greatest(0.7413 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 5.0) AS sx, greatest(0.7413 * (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)), 5.0) AS sy FROM c GROUP BY 1),
w AS (SELECT k, sx, sy, least(greatest(x, -1.2 * sx), 1.2 * sx) AS u, least(greatest(y, -1.2 * sy), 1.2 * sy) AS v FROM c JOIN s USING (k)), g AS (SELECT k, sx, sy, count(*) AS n, var_samp(u) AS a, covar_samp(u, v) AS b, var_samp(v) AS d FROM w GROUP BY 1, 2, 3),
l2 AS (SELECT *, (a + d) / 2 AS mean, sqrt(power((a - d) / 2, 2) + b * b) AS half FROM g), f AS (SELECT *, greatest(mean + half, 25.0) AS p, greatest(mean - half, 25.0) AS q FROM l2)
SELECT k, n, {rd('sx')} AS scale_x, {rd('sy')} AS scale_y, {rd('(p + q) / 2 + (p - q) / 2 * (a - d) / 2 / half')} AS cov_xx, {rd('(p - q) / 2 * b / half')} AS cov_xy, {rd('(p + q) / 2 - (p - q) / 2 * (a - d) / 2 / half')} AS cov_yy FROM f"""
)
def pooled_covariance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("e"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_quantity") * 0.2 + F.col("l_discount") * 100).alias("y")
    )
    return rounded(summaries.pooled_covariance(li, ["e"], "x", "y", keys=["k"], clip=1.2), "scale_x", "scale_y", "cov_xx", "cov_xy", "cov_yy")


@register(
    f"""WITH d AS (SELECT cell, day, x, day < DATE '2024-01-20' AS cal FROM ({DAILY}) WHERE event_type = 'click'), c AS (SELECT cell, median(x) AS c FROM d WHERE cal GROUP BY 1), s AS (SELECT day, count(*) AS n, median(abs(x - c)) AS statistic, bool_and(cal) AS cal FROM d JOIN c USING (cell) GROUP BY 1)
SELECT day, n, {rd('statistic')} AS statistic, cal AS calibration, {rd('(1.0 + (SELECT count(*) FROM s o WHERE o.cal AND o.day <> s.day AND o.statistic >= s.statistic)) / (1 + (SELECT count(*) FROM s o WHERE o.cal AND o.day <> s.day))')} AS p FROM s"""
)
def median_change_p(spark, sf_dir):
    d = daily(spark, sf_dir).where("event_type = 'click'")
    return rounded(summaries.median_change_p(d, ["cell"], "day", "x", calibration=F.col("day") < F.lit("2024-01-20").cast("date")), "statistic", "p")


@register(
    f"""WITH f AS (SELECT l_partkey AS s, bool_or(l_discount > 0.08) AS flag FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT l_suppkey AS t, l_partkey AS s FROM lineitem)
SELECT t AS t_id, count(*) AS n, {rd('avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END)')} AS fraction FROM p JOIN f USING (s) GROUP BY 1"""
)
def lineage_fraction(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select(F.col("l_suppkey").alias("t_id"), F.col("l_partkey").alias("s_id")).distinct()
    return rounded(summaries.lineage_fraction(pairs, li.select(F.col("l_partkey").alias("s_id"), (F.col("l_discount") > 0.08).alias("imputed"))), "fraction")


@register(
    f"""WITH r AS (SELECT o_orderpriority AS product, o_orderstatus AS unit, o_orderdate AS d, o_totalprice AS s, (o_custkey % 100) / 100.0 AS p, unnest([DATE '1995-01-01', DATE '1997-06-01', DATE '2000-01-01']) AS cut FROM orders), k AS (SELECT * FROM r WHERE CAST(d AS DATE) <= cut),
u AS (SELECT product, cut, unit, max(s) AS s, min(p) AS p FROM k GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY product, cut ORDER BY s DESC, unit) AS place FROM u)
SELECT product, cut, count(*) AS n, {rd('min(p)')} AS least_p, count(*) FILTER (p <= 0.05) AS n_significant, max(unit) FILTER (place = 1) AS strongest, max(s) AS statistic FROM b GROUP BY 1, 2"""
)
def product_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("product"), F.col("o_orderstatus").alias("unit"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("s"), ((F.col("o_custkey") % 100) / 100.0).alias("p")
    )
    units = summaries.cut_offs(o, "d", ["1995-01-01", "1997-06-01", "2000-01-01"]).groupBy("product", "cut", "unit").agg(F.max("s").alias("s"), F.min("p").alias("p"))
    return rounded(summaries.product_comparison(units, ["product", "cut"], "unit", "s", "p"), "least_p")


@register(
    f"""WITH d AS (SELECT event_type AS k, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, median(value) / 10 AS v FROM events GROUP BY 1, 2), w AS (SELECT k, v - lag(v) OVER (PARTITION BY k ORDER BY day) AS s FROM d WHERE day >= TIMESTAMP '2024-01-25' - INTERVAL 45 DAYS AND day < TIMESTAMP '2024-01-25'),
c AS (SELECT k, count(*) AS n, median(s) AS c FROM w GROUP BY 1), m AS (SELECT k, n, median(abs(s - c)) AS mad FROM w JOIN c USING (k) GROUP BY 1, 2)
SELECT k, n, {rd('CASE WHEN n >= 6 THEN greatest(0.001, 1.4826 * mad / sqrt(2.0)) ELSE 0.001 END')} AS noise FROM m"""
)
def daily_noise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.groupBy(F.col("event_type").alias("k"), F.to_date("ts").cast("timestamp").alias("day")).agg((F.median("value") / 10).alias("v"))
    return rounded(summaries.daily_noise(d, ["k"], "day", "v", end="2024-01-25", floor=0.001), "noise")


@register(
    f"""WITH a AS (SELECT l_shipmode_key AS a, l_linenumber AS b, l_returnflag AS c, l_linestatus AS d, avg(l_tax) AS s FROM (SELECT l_suppkey % 4 AS l_shipmode_key, * FROM lineitem) WHERE l_quantity < 25 GROUP BY 1, 2, 3, 4),
b AS (SELECT l_shipmode_key AS a, l_linenumber AS b, l_returnflag AS c, l_linestatus AS d, avg(l_tax) AS s FROM (SELECT l_suppkey % 4 AS l_shipmode_key, * FROM lineitem) WHERE l_quantity >= 25 GROUP BY 1, 2, 3, 4)
SELECT a.a, a.b, a.c, a.d, {rd('a.s')} AS s_asc, {rd('b.s')} AS s_desc, {rd('(a.s + b.s) / 2')} AS s FROM a JOIN b USING (a, b, c, d)"""
)
def averaged_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("a"), F.col("l_linenumber").alias("b"), F.col("l_returnflag").alias("c"), F.col("l_linestatus").alias("d"), "l_tax", "l_quantity")
    keys = ["a", "b", "c", "d"]
    side = lambda where: li.where(where).groupBy(*keys).agg(F.avg("l_tax").alias("s"))
    out = summaries.averaged_scores(side("l_quantity < 25"), side("l_quantity >= 25"), keys, ["s"], ("asc", "desc"))
    return rounded(out, "s_asc", "s_desc", "s")


@register(
    f"""SELECT e.l_orderkey, e.l_linenumber, {rd('e.l_tax')} AS l_tax_event, {rd('c.l_tax')} AS l_tax_control, {rd('e.l_tax - c.l_tax')} AS l_tax_change
FROM (SELECT * FROM lineitem WHERE l_quantity > 10) e JOIN (SELECT * FROM lineitem WHERE l_quantity > 10) c ON c.l_orderkey = e.l_orderkey + 1 AND c.l_linenumber = e.l_linenumber"""
)
def event_against_control(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", (F.col("l_quantity") > 10).alias("valid"))
    out = summaries.event_against_control(li, li.withColumn("l_orderkey", F.col("l_orderkey") - 1), ["l_orderkey", "l_linenumber"], ["l_tax"])
    return rounded(out, "l_tax_event", "l_tax_control", "l_tax_change")


@register(
    f"""WITH t AS (SELECT event_type, CAST(user_id % 12 AS INT) AS row, CAST(user_id // 12 % 9 AS INT) AS col, avg(value) AS v FROM events GROUP BY 1, 2, 3)
SELECT k.event_type, CAST(r AS INT) AS row, CAST(c AS INT) AS col, {rd('v')} AS v FROM (SELECT DISTINCT event_type FROM t) k, range(0, 12) a(r), range(0, 9) b(c) LEFT JOIN t ON t.event_type = k.event_type AND t.row = r AND t.col = c"""
)
def targets_on_grid(spark, sf_dir):
    u = F.col("user_id")
    t = table(spark, sf_dir, "events").groupBy("event_type", (u % 12).cast("int").alias("row"), (F.floor(u / 12) % 9).cast("int").alias("col")).agg(F.avg("value").alias("v"))
    return rounded(summaries.scatter_to_grid(t, 12, 9, ["v"], ["event_type"]), "v")


@register(
    f"""SELECT s_suppkey AS station, {rd("1000 * (-0.62769383 * s_acctbal / 1e4 - 0.11233934 * s_nationkey / 10 + 0.77031184 * 0.5)")} AS los_mm, {rd("1000 * sqrt(power(0.62769383 * 0.001, 2) + power(0.11233934 * 0.002, 2) + power(0.77031184 * 0.003 * (1 + s_suppkey % 3), 2))")} AS sigma_mm FROM supplier"""
)
def projected_history(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station"), F.lit(1).alias("day"), (F.col("s_acctbal") / 1e4).alias("east"), (F.col("s_nationkey") / 10).alias("north"), F.lit(0.5).alias("up"),
        F.lit(0.001).alias("sig_e"), F.lit(0.002).alias("sig_n"), (0.003 * (1 + F.col("s_suppkey") % 3)).alias("sig_u"),
    )
    out = summaries.project_history(s, (-0.62769383, -0.11233934, 0.77031184), ["station"], "day")
    return rounded(out.select("station", "los_mm", "sigma_mm"), "los_mm", "sigma_mm")


@register(
    f"""WITH e AS (SELECT p_brand, p_retailprice / 100 - 10 AS e, 2 + p_size / 25.0 AS s, p_size AS d FROM part WHERE p_size > 18)
SELECT p_brand, count(*) AS n, {rd('sqrt(avg(e * e))')} AS rmse, {rd('avg(CASE WHEN abs(e / s) <= 1.64485 THEN 1.0 ELSE 0.0 END)')} AS coverage,
sqrt(avg(e * e)) <= 1.10 * 6 AND avg(CASE WHEN abs(e / s) <= 1.64485 THEN 1.0 ELSE 0.0 END) BETWEEN 0.65 AND 1 AND count(*) >= 8 AS passed FROM e GROUP BY 1"""
)
def far_field_gates(spark, sf_dir):
    e = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") / 100 - 10).alias("e"), (2 + F.col("p_size") / 25.0).alias("s"), F.col("p_size").alias("d"))
    return rounded(summaries.accuracy_gates(e, "e", "s", baseline_rmse=6.0, keys=["p_brand"], subset=F.col("d") > 18, least=8), "rmse", "coverage")
