"""Queries of filters, relational joins, rankings, set operations and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars, stats
from tessera.operators import filters, joins, ranking
from tessera.plans.registry import rd, register, rounded, table
from tessera.plans.series_queries import DAILY_SQL, daily


@register("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def persistent_users(spark, sf_dir):
    return filters.persistent(table(spark, sf_dir, "events"), "user_id", "event_type")


@register(
    """SELECT CASE WHEN NOT l_quantity >= 10 THEN 'quantity' WHEN NOT l_discount <= 0.05 THEN 'discount' WHEN NOT l_tax > 0 THEN 'tax' ELSE 'passed' END AS reason, count(*) AS n FROM lineitem GROUP BY 1"""
)
def first_failure(spark, sf_dir):
    reason = filters.first_failure({"quantity": F.col("l_quantity") >= 10, "discount": F.col("l_discount") <= 0.05, "tax": F.col("l_tax") > 0})
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@register("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount >= 0.03 AND l_tax <= 0.05 AND l_quantity <= 30 GROUP BY 1")
def quality_mask(spark, sf_dir):
    mask = filters.quality_mask({"l_discount": (">=", 0.03), "l_tax": ("<=", 0.05), "l_quantity": ("<=", 30.0)})
    return table(spark, sf_dir, "lineitem").where(mask).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@register(
    """SELECT CASE WHEN l_quantity BETWEEN 1 AND 5 THEN 0 WHEN l_quantity > 5 AND l_quantity <= 10 THEN 1 WHEN l_quantity > 10 AND l_quantity <= 18 THEN 2 WHEN l_quantity > 18 THEN 3 END AS band,
CASE WHEN l_discount > 0.08 THEN 'high' WHEN l_tax > 0.05 THEN 'taxed' ELSE 'plain' END AS category, count(*) AS n FROM lineitem GROUP BY 1, 2"""
)
def bands_and_categories(spark, sf_dir):
    band = filters.band_of(F.col("l_quantity"), [1, 5, 10, 18])
    category = filters.last_category({"taxed": F.col("l_tax") > 0.05, "high": F.col("l_discount") > 0.08}, "plain")
    return table(spark, sf_dir, "lineitem").groupBy(band.alias("band"), category.alias("category")).agg(F.count("*").alias("n"))


@register("SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 AND l_suppkey % 2 = 0 GROUP BY 1")
def sub_lattice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where(filters.sub_lattice("l_linenumber", "l_suppkey")).groupBy("l_linenumber").agg(F.count("*").alias("n"))


@register(f"SELECT s_suppkey, {rd('s_acctbal / ((1 + s_suppkey % 4) * 1000.0)')} AS z, abs(s_acctbal / ((1 + s_suppkey % 4) * 1000.0)) >= 1.96 AS resolved FROM supplier")
def resolved_flags(spark, sf_dir):
    flags = filters.resolved_flags(F.col("s_acctbal"), (1 + F.col("s_suppkey") % 4) * 1000.0)
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", *[v.alias(k) for k, v in flags.items()]), "z")


@register(
    """SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 1 AND count(*) FILTER (o_orderstatus = 'O') = 1
THEN round(max(o_totalprice) FILTER (o_orderstatus = 'F') - max(o_totalprice) FILTER (o_orderstatus = 'O'), 2) + 0.0 END AS difference FROM orders GROUP BY 1"""
)
def paired_difference(spark, sf_dir):
    out = joins.paired_difference(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", "F", "O")
    return out.withColumn("difference", F.round("difference", 2))


@register(
    f"""WITH a AS (SELECT l_partkey, avg(l_quantity) AS v, 1 + count(*) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey, avg(l_quantity) AS v, 2 + count(*) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_partkey, {rd('a.v - b.v')} AS difference, {rd('sqrt(a.s * a.s + b.s * b.s)')} AS sigma, {rd('(a.v - b.v) / sqrt(a.s * a.s + b.s * b.s)')} AS z FROM a JOIN b USING (l_partkey)"""
)
def difference_with_error(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda flag, k: li.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.avg("l_quantity").alias("v"), (k + F.count("*")).alias("s"))
    return rounded(joins.hypot_difference(side("A", 1), side("R", 2), ["l_partkey"], "v", "s"), "difference", "sigma", "z")


@register(
    f"""WITH d AS ({DAILY_SQL}) SELECT a.event_type, a.day AS held_out, {rd('avg(b.x)')} AS mean, count(*) AS n FROM d a JOIN d b ON a.event_type = b.event_type AND a.day <> b.day GROUP BY 1, 2"""
)
def leave_one_out(spark, sf_dir):
    out = joins.leave_one_out(daily(spark, sf_dir), ["event_type"], "day")
    return rounded(out.groupBy("event_type", "held_out").agg(F.avg("x").alias("mean"), F.count("*").alias("n")), "mean")


@register(
    f"""WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS a, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 END AS m1, 2.0 AS m0 FROM supplier)
SELECT s_suppkey, {rd('coalesce(a, m1, m0)')} AS value, CASE WHEN a IS NOT NULL THEN 'observed' WHEN m1 IS NOT NULL THEN 'conditioned' ELSE 'spatial' END AS source FROM o"""
)
def fill_only_missing(spark, sf_dir):
    k = F.col("s_suppkey")
    value, source = joins.fill_missing(F.when(k % 3 != 0, F.col("s_acctbal")), ("conditioned", F.when(k % 2 == 0, F.lit(1.0))), ("spatial", F.lit(2.0)))
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", value.alias("value"), source.alias("source")), "value")


_ENDPOINTS = """e AS (SELECT o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'start' ELSE 'end' END AS endpoint, avg(o_totalprice / 3) AS value, 1.0 + count(*) AS sigma FROM orders GROUP BY 1, 2),
w AS (SELECT o_custkey, max(value) FILTER (endpoint = 'start') AS sv, max(value) FILTER (endpoint = 'end') AS ev, max(sigma) FILTER (endpoint = 'start') AS ss, max(sigma) FILTER (endpoint = 'end') AS es FROM e GROUP BY 1)"""


def _endpoints(spark, sf_dir):
    side = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "start").otherwise("end")
    e = table(spark, sf_dir, "orders").groupBy("o_custkey", side.alias("endpoint")).agg(F.avg(F.col("o_totalprice") / 3).alias("value"), (1.0 + F.count("*")).alias("sigma"))
    return e.withColumn("method", F.lit("mean"))


@register(f"WITH {_ENDPOINTS} SELECT o_custkey, round(ev - sv, 4) + 0.0 AS increment, {rd('sqrt(ss * ss + es * es)')} AS sigma FROM w WHERE sv IS NOT NULL AND ev IS NOT NULL")
def interval_table(spark, sf_dir):
    good, _ = joins.interval_table(_endpoints(spark, sf_dir), ["o_custkey"])
    return good.select("o_custkey", F.round("increment", 4).alias("increment"), F.round("sigma", 6).alias("sigma"))


@register(f"WITH {_ENDPOINTS} SELECT o_custkey, CASE WHEN sv IS NULL THEN 'start' ELSE 'end' END || ' has no sample' AS reason FROM w WHERE sv IS NULL OR ev IS NULL")
def interval_rejects(spark, sf_dir):
    return joins.interval_table(_endpoints(spark, sf_dir), ["o_custkey"])[1]


@register("SELECT p.p_partkey, l.l_orderkey, l.l_quantity FROM part p LEFT JOIN (SELECT l_partkey, min_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey, min_by(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM lineitem GROUP BY 1) l ON p.p_partkey = l.l_partkey")
def align_to_canonical(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return joins.align_to_canonical(table(spark, sf_dir, "part").select("p_partkey"), li, "p_partkey", "o").select("p_partkey", "l_orderkey", "l_quantity")


@register("SELECT CAST(i AS INT) AS position, n_nationkey, n_name FROM nation JOIN (SELECT unnest(range(0, 3)) AS i, unnest(['FRANCE', 'NATION_3', 'BRAZIL']) AS n_name) USING (n_name)")
def ordered_lookup(spark, sf_dir):
    out = joins.ordered_lookup(table(spark, sf_dir, "nation"), "n_name", ["FRANCE", "NATION_3", "BRAZIL"])
    return out.select("position", "n_nationkey", "n_name")


@register(
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem"""
)
def common_dates(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return a.intersect(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")))


@register(
    """WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT k, 'left' AS side FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM (SELECT DISTINCT k FROM b)) UNION ALL SELECT k, 'right' FROM (SELECT DISTINCT k FROM b EXCEPT SELECT k FROM a)"""
)
def difference_both_ways(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    return joins.difference_both_ways(a, b)


@register("SELECT n_name AS name, n_regionkey AS region, NULL AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_of_unlike(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@register("SELECT p_brand, p_type, p_partkey, selected FROM (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS selected FROM part)")
def best_per_group(spark, sf_dir):
    out = ranking.flag_best(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], ["p_brand"])
    return out.select("p_brand", "p_type", "p_partkey", "selected")


@register("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1")
def argmax_per_group(spark, sf_dir):
    return ranking.argmax(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", ["c_nationkey"])


@register(
    f"""SELECT o_orderpriority, {rd('corr(o_totalprice, o_custkey)')} AS r, {rd('sum(o_custkey * (o_totalprice / 1000)) / sum(o_custkey * o_custkey)')} AS slope, {rd('sqrt(avg(power(o_totalprice / 1000 - o_custkey, 2)))')} AS rms, {rd('max(abs(o_totalprice / 1000 - o_custkey))')} AS worst,
{rd('avg(CASE WHEN sign(o_totalprice - 150000) = sign(o_custkey - 500) THEN 1.0 ELSE 0.0 END)')} AS sign_agreement FROM orders GROUP BY 1"""
)
def pattern_audit(spark, sf_dir):
    p, c = F.col("o_totalprice"), F.col("o_custkey").cast("double")
    d = p / 1000 - c
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.corr(p, c).alias("r"), stats.through_origin_slope(c, p / 1000).alias("slope"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("worst"),
        F.avg((F.signum(p - 150000) == F.signum(c - 500)).cast("double")).alias("sign_agreement"),
    )
    return rounded(out, "r", "slope", "rms", "worst", "sign_agreement")


@register(
    f"""WITH l AS (SELECT l_suppkey, l_shipdate, l_extendedprice AS v FROM lineitem), th AS (SELECT quantile_cont(v, 0.2) AS lo, quantile_cont(v, 0.8) AS hi FROM (SELECT l_suppkey, avg(v) AS v FROM l WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1)),
f AS (SELECT l_suppkey, CASE WHEN avg(v) <= lo THEN 'lower' WHEN avg(v) >= hi THEN 'upper' END AS lobe FROM l, th WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_suppkey, lo, hi)
SELECT lobe, CAST(year(l_shipdate) AS INT) AS yr, count(*) AS n, {rd('median(v)')} AS med, round(sqrt(avg(v * v)), 3) AS rms FROM l JOIN f USING (l_suppkey) WHERE lobe IS NOT NULL GROUP BY 1, 2"""
)
def frozen_lobe_summary(spark, sf_dir):
    """Thresholds at the reference period freeze the member sets; later years only aggregate them."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", F.col("l_extendedprice").alias("v"))
    ref = li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).groupBy("l_suppkey").agg(F.avg("v").alias("m"))
    limits = F.broadcast(ref.agg(F.percentile("m", F.lit(0.2)).alias("lo"), F.percentile("m", F.lit(0.8)).alias("hi")))
    lobe = F.when(F.col("m") <= F.col("lo"), "lower").when(F.col("m") >= F.col("hi"), "upper")
    members = ref.join(limits, F.lit(True)).select("l_suppkey", lobe.alias("lobe")).where("lobe IS NOT NULL")
    out = li.join(members, "l_suppkey").groupBy("lobe", F.year("l_shipdate").alias("yr")).agg(
        F.count("*").alias("n"), F.median("v").alias("med"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms")
    )
    return out.withColumns({"med": F.round("med", 6), "rms": F.round("rms", 3)})


@register(
    f"""WITH q AS (SELECT quantile_cont(p_retailprice, 0.05) AS a, quantile_cont(p_retailprice, 0.95) AS b FROM part) SELECT p_partkey, {rd('least(greatest((p_retailprice - a) / (b - a), 0), 1)')} AS score,
{rd('1 - least(greatest((p_retailprice - a) / (b - a), 0), 1)')} AS inverted FROM part, q"""
)
def robust_unit_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = F.broadcast(p.agg(F.percentile("p_retailprice", F.lit(0.05)).alias("a"), F.percentile("p_retailprice", F.lit(0.95)).alias("b")))
    s = F.least(F.greatest((F.col("p_retailprice") - F.col("a")) / (F.col("b") - F.col("a")), F.lit(0.0)), F.lit(1.0))
    return rounded(p.join(q, F.lit(True)).select("p_partkey", s.alias("score"), (1 - s).alias("inverted")), "score", "inverted")


@register(
    f"""SELECT event_type, {rd('avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END)')} AS available, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1"""
)
def availability(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.avg((F.col("value") > 20).cast("double")).alias("available"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return rounded(e, "available")


@register(
    f"""SELECT event_id, {rd("CAST(json_extract_string(props, '$.k') AS DOUBLE)")} AS k, strftime(ts, '%Y%m%d') || '.txt' AS name, CAST(ts AS DATE) AS day, upper(event_type) || '_' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS label FROM events"""
)
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("name", F.concat(F.date_format("ts", "yyyyMMdd"), F.lit(".txt")))
    label = F.concat(F.upper("event_type"), scalars.numbered("_", F.col("event_id") % 100))
    out = e.select("event_id", scalars.json_number(F.col("props"), "$.k").alias("k"), "name", scalars.epoch_date_of_path(F.col("name")).alias("day"), label.alias("label"))
    return rounded(out, "k")


@register(
    f"""WITH a AS (SELECT l_suppkey, avg(l_quantity) AS e, avg(l_tax) * 100 AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_suppkey, avg(l_quantity) AS e, avg(l_tax) * 100 AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT {rd('sqrt(avg(power(a.e - b.e, 2) + power(a.n - b.n, 2)))')} AS rms, {rd('quantile_cont(a.e - b.e, 0.02)')} AS p2, {rd('quantile_cont(a.e - b.e, 0.98)')} AS p98, {rd('quantile_cont(abs(a.e - b.e), 0.95)')} AS p95_abs, count(*) AS n FROM a JOIN b USING (l_suppkey)"""
)
def timing_mismatch(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda s: li.where(F.col("l_linestatus") == s).groupBy("l_suppkey").agg(F.avg("l_quantity").alias(f"e{s}"), (F.avg("l_tax") * 100).alias(f"n{s}"))
    j = side("F").join(side("O"), "l_suppkey").select((F.col("eF") - F.col("eO")).alias("d"), (F.col("nF") - F.col("nO")).alias("h"))
    q = stats.quantile(F.col("d"), [0.02, 0.98])
    out = j.agg(F.sqrt(F.avg(F.col("d") * F.col("d") + F.col("h") * F.col("h"))).alias("rms"), q.alias("q"), stats.quantile(F.abs("d"), 0.95).alias("p95_abs"), F.count("*").alias("n"))
    return rounded(out.select("rms", F.col("q")[0].alias("p2"), F.col("q")[1].alias("p98"), "p95_abs", "n"), "rms", "p2", "p98", "p95_abs")


@register(
    f"""WITH e AS (SELECT p_partkey, p_retailprice / 100 - 10 AS e, 2 + p_size / 25.0 AS s, p_size * 1.0 AS d FROM part), g AS (SELECT sqrt(avg(e * e)) AS rmse, avg(CASE WHEN abs(e / s) <= 1.64485 THEN 1.0 ELSE 0.0 END) AS coverage,
sqrt(avg(e * e) FILTER (d > 18)) AS far_rmse, avg(CASE WHEN abs(e / s) <= 1.64485 THEN 1.0 ELSE 0.0 END) FILTER (d > 18) AS far_coverage, count(*) FILTER (d > 18) AS far_n FROM e)
SELECT {rd('rmse')} AS rmse, {rd('coverage')} AS coverage, {rd('far_rmse')} AS far_rmse, {rd('far_coverage')} AS far_coverage, far_n, rmse <= 1.10 * 6 AND coverage BETWEEN 0.65 AND 1 AS passed, far_rmse <= 1.10 * 6 AND far_coverage BETWEEN 0.65 AND 1 AND far_n >= 8 AS far_passed FROM g"""
)
def validation_gates(spark, sf_dir):
    e = table(spark, sf_dir, "part").select((F.col("p_retailprice") / 100 - 10).alias("e"), (2 + F.col("p_size") / 25.0).alias("s"), F.col("p_size").alias("d"))
    inside, far = (F.abs(F.col("e") / F.col("s")) <= 1.64485).cast("double"), F.col("d") > 18
    m2 = F.col("e") * F.col("e")
    g = e.agg(
        F.sqrt(F.avg(m2)).alias("rmse"), F.avg(inside).alias("coverage"), F.sqrt(F.avg(F.when(far, m2))).alias("far_rmse"), F.avg(F.when(far, inside)).alias("far_coverage"), F.count_if(far).alias("far_n")
    )
    ok = lambda r, c: (F.col(r) <= 1.10 * 6) & F.col(c).between(0.65, 1.0)
    g = g.select("*", ok("rmse", "coverage").alias("passed"), (ok("far_rmse", "far_coverage") & (F.col("far_n") >= 8)).alias("far_passed"))
    return rounded(g, "rmse", "coverage", "far_rmse", "far_coverage")
