"""Queries of reference areas, endpoint regimes and trace sampling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import endpoints, reference, traces
from tessera.plans.geometry_queries import POINT_SQL, STATION_SQL, points, stations
from tessera.plans.registry import rd, register, rounded, table
from tessera.plans.series_queries import DAILY_SQL, daily

STEPS = [datetime(2024, 1, 15, 5), datetime(2024, 1, 18, 12)]


@register(
    f"""WITH h AS (SELECT event_type, day, x, greatest(s, 0.5) AS s FROM ({DAILY_SQL}) WHERE s IS NOT NULL),
e AS (SELECT event_id, event_type, ts, CAST(ts AS DATE) AS d, TIMESTAMP '{STEPS[0]}' AS e1, TIMESTAMP '{STEPS[1]}' AS e2 FROM events),
r AS (SELECT *, CASE WHEN d = CAST(e1 AS DATE) AND ts < e1 THEN e1 WHEN d = CAST(e2 AS DATE) AND ts < e2 THEN e2 END AS nxt, CASE WHEN ts > e2 THEN e2 WHEN ts > e1 THEN e1 END AS past FROM e),
m AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN 'trend_before_step' WHEN past IS NOT NULL THEN 'trend_after_step' ELSE 'between_days' END AS method,
CASE WHEN nxt IS NOT NULL THEN CAST(nxt AS DATE) - 11 ELSE greatest(CAST(past AS DATE) + 2, d - 8) END AS d0, CASE WHEN nxt IS NOT NULL THEN CAST(nxt AS DATE) - 1 ELSE d END AS d1 FROM r),
j AS (SELECT event_id, method, (epoch(CAST(day AS TIMESTAMP)) - epoch(ts)) / 86400.0 AS t, x, 1 / (s * s) AS w FROM m JOIN h USING (event_type) WHERE method <> 'between_days' AND day BETWEEN d0 AND d1),
a AS (SELECT event_id, count(*) AS n, sum(w) AS s, sum(w * t) AS st, sum(w * x) AS sx, sum(w * t * t) AS stt, sum(w * t * x) AS stx FROM j GROUP BY 1),
f AS (SELECT event_id, n, (stt * sx - st * stx) / nullif(s * stt - st * st, 0) AS b0, (s * stx - st * sx) / nullif(s * stt - st * st, 0) AS b1, stt / nullif(s * stt - st * st, 0) AS v0 FROM a),
q AS (SELECT event_id, x - b0 - b1 * t AS res FROM j JOIN f USING (event_id)), c AS (SELECT event_id, median(res) AS c FROM q GROUP BY 1),
g AS (SELECT event_id, 1.4826 * median(abs(res - c)) AS mad FROM q JOIN c USING (event_id) GROUP BY 1),
tr AS (SELECT event_id, method, CASE WHEN n >= (CASE method WHEN 'trend_before_step' THEN 7 ELSE 5 END) THEN b0 END AS value,
CASE WHEN n >= (CASE method WHEN 'trend_before_step' THEN 7 ELSE 5 END) THEN sqrt(greatest(v0, 0) + power(greatest(mad, 0.5), 2)) END AS sigma,
CASE WHEN coalesce(n, 0) < (CASE method WHEN 'trend_before_step' THEN 7 ELSE 5 END) THEN 'too few days' END AS reason FROM m LEFT JOIN f USING (event_id) LEFT JOIN g USING (event_id) WHERE method <> 'between_days'),
n AS (SELECT event_id, ts, max(day) FILTER (CAST(day AS TIMESTAMP) <= ts) AS l, min(day) FILTER (CAST(day AS TIMESTAMP) >= ts) AS r FROM m LEFT JOIN h USING (event_type) WHERE method = 'between_days' GROUP BY 1, 2),
k AS (SELECT n.event_id, n.ts, l, r, a.x AS xa, a.s AS sa, b.x AS xb, b.s AS sb, CASE WHEN l = r THEN 0 ELSE (epoch(n.ts) - epoch(CAST(l AS TIMESTAMP))) / 86400.0 / date_diff('day', l, r) END AS f
FROM n JOIN events e USING (event_id) LEFT JOIN h a ON a.event_type = e.event_type AND a.day = l LEFT JOIN h b ON b.event_type = e.event_type AND b.day = r),
z AS (SELECT *, CASE WHEN l IS NULL OR r IS NULL THEN 'not bracketed' WHEN (CAST(l AS TIMESTAMP) < TIMESTAMP '{STEPS[0]}' AND TIMESTAMP '{STEPS[0]}' < CAST(r AS TIMESTAMP)) THEN 'step between neighbours' END AS reason FROM k)
SELECT event_id, method, {rd('value')} AS value, {rd('sigma')} AS sigma, reason FROM tr UNION ALL
SELECT event_id, CASE WHEN CAST(l AS TIMESTAMP) = ts THEN 'same_time' ELSE 'between_days' END, CASE WHEN reason IS NULL THEN {rd('xa + f * (xb - xa)')} END,
CASE WHEN reason IS NULL THEN {rd('greatest(sqrt(power((1 - f) * sa, 2) + power(f * sb, 2)), 0.5)')} END, reason FROM z"""
)
def endpoint_regimes(spark, sf_dir):
    """Every event's time on its type's daily series, with two steps."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = endpoints.sample_endpoints(
        e, daily(spark, sf_dir), keys=["event_type"], target_id="event_id", at="ts", day="day", value="x", sigma="s", events=STEPS, floor=0.5, pre_days=10, post_days=8
    )
    return rounded(out, "value", "sigma")


PIXEL_SQL = "SELECT CAST(year(l_shipdate) AS INT) AS epoch, l_quantity AS x, l_discount * 100 AS y, l_extendedprice * 0.7310585786 / 100 AS v, l_tax * 0.7310585786 AS tax FROM lineitem"


def pixels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("epoch"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") * 0.7310585786 / 100).alias("v"), (F.col("l_tax") * 0.7310585786).alias("tax")
    )


@register(
    f"""WITH p AS ({PIXEL_SQL}), l AS (SELECT epoch, median(v) FILTER (x <= 20) AS a, count(v) FILTER (x <= 20) AS n_area, median(v) FILTER (tax >= 0.051) AS r, count(v) FILTER (tax >= 0.051) AS n_reference FROM p GROUP BY 1),
s AS (SELECT epoch, 1.4826 * median(abs(v - a)) AS s FROM p JOIN l USING (epoch) WHERE x <= 20 GROUP BY 1)
SELECT epoch, {rd('a - r')} AS value, {rd('s')} AS sigma, n_area, n_reference FROM l JOIN s USING (epoch)"""
)
def referenced_series(spark, sf_dir):
    out = reference.referenced_series(pixels(spark, sf_dir), "epoch", "v", area=F.col("x") <= 20, reference=F.col("tax") >= 0.051)
    return rounded(out, "value", "sigma")


@register(
    f"""WITH p AS ({PIXEL_SQL}), r AS (SELECT epoch, median(v) AS r FROM p WHERE tax >= 0.051 GROUP BY 1)
SELECT epoch, CAST(floor(x / 10) AS BIGINT) AS bx, CAST(floor((y + 0.5) / 10) AS BIGINT) AS by, {rd('median(v) - any_value(r)')} AS value, count(v) AS n, {rd('avg(tax)')} AS tax FROM p JOIN r USING (epoch) GROUP BY 1, 2, 3 HAVING count(v) >= 50"""
)
def patch_series(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("y", F.col("y") + 0.5)
    return rounded(reference.patch_series(p, "epoch", "v", size=10.0, reference=F.col("tax") >= 0.051, carry=["tax"]), "value", "tax")


EPOCH_SQL = f"SELECT id, x, y, CAST(e AS INT) AS epoch, v * (1 + e) + ((id * (3 + e)) % 19) * 0.37310585786 AS v FROM ({POINT_SQL}), range(0, 3) r(e)"


def epochs(spark, sf_dir):
    k, e = F.col("id"), F.col("epoch")
    p = points(spark, sf_dir).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return p.select("id", "x", "y", "epoch", (F.col("v") * (1 + e) + k * (3 + e) % 19 * 0.37310585786).alias("v"))


@register(
    f"""WITH p AS ({EPOCH_SQL}), t AS ({STATION_SQL}), r AS (SELECT epoch, median(v) AS r FROM p WHERE x <= 10 GROUP BY 1),
g AS (SELECT t.id AS point, epoch, median(p.v) AS m, count(p.v) AS n FROM t JOIN p ON sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) <= 4 GROUP BY 1, 2)
SELECT point, epoch, CASE WHEN n >= 30 THEN {rd('m - r')} END AS value, n FROM g JOIN r USING (epoch)"""
)
def point_series(spark, sf_dir):
    out = reference.point_series(stations(spark, sf_dir), epochs(spark, sf_dir), "epoch", "v", radius=4.0, reference=F.col("x") <= 10)
    return rounded(out, "value")


@register(
    f"""WITH p AS (SELECT l_orderkey AS cell, CASE WHEN l_discount > 0 THEN l_quantity END AS v, l_tax AS c, l_discount AS s FROM lineitem WHERE l_linenumber <= 3)
SELECT cell, CASE WHEN count(v) = 3 THEN {rd('sum(v)')} END AS value, count(v) = 3 AS valid, CASE WHEN count(v) = 3 THEN {rd('min(c)')} END AS coherence, CASE WHEN count(v) = 3 THEN {rd('sqrt(sum(s * s))')} END AS scale FROM p GROUP BY 1"""
)
def referenced_pair_sum(spark, sf_dir):
    """Three pairs, the first three lines of an order, summed where all are valid."""
    p = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(
        F.col("l_orderkey").alias("cell"), F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("v"), F.col("l_tax").alias("c"), F.col("l_discount").alias("s")
    )
    return rounded(reference.sum_pairs(p, ["cell"], "v", n_pairs=3, coherence="c", scale="s"), "value", "coherence", "scale")


_AUDIT_SQL = f"""p AS ({POINT_SQL}), t AS (SELECT *, v * -0.6 AS east, x - 20 AS north, y / 7 AS up FROM ({STATION_SQL})),
l AS (SELECT t.id, median(p.v) AS o, median(-0.6 - p.id % 7 / 100.0) AS le, median(-0.11 + p.id % 5 / 100.0) AS ln, median(0.77 - p.id % 3 / 50.0) AS lu, count(*) AS n_pixels FROM t JOIN p ON sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) <= 4 GROUP BY 1),
q AS (SELECT id, o, le * east + ln * north + lu * up AS pr, sqrt(power(le * 2, 2) + power(ln * 3, 2) + power(lu * 5, 2)) AS sg, n_pixels FROM l JOIN t USING (id)),
c AS (SELECT count(*) AS n, corr(o, pr) AS raw_r FROM q), a AS (SELECT *, CASE WHEN raw_r >= 0 THEN 1 ELSE -1 END AS sn FROM q, c), f AS (SELECT median(sn * o - pr) AS f FROM a),
z AS (SELECT *, sn * o AS al, sn * o - pr - f AS res FROM a, f)"""


def looks(spark, sf_dir):
    k = F.col("id")
    return points(spark, sf_dir).select(
        "x", "y", F.col("v").alias("value"), (-0.6 - k % 7 / F.lit(100.0)).alias("look_e"), (-0.11 + k % 5 / F.lit(100.0)).alias("look_n"), (0.77 - k % 3 / F.lit(50.0)).alias("look_u")
    )


def audit(spark, sf_dir):
    s = stations(spark, sf_dir).select(
        "id", "x", "y", (F.col("v") * -0.6).alias("east"), (F.col("x") - 20).alias("north"), (F.col("y") / 7).alias("up"), F.lit(2.0).alias("sigma_e"), F.lit(3.0).alias("sigma_n"), F.lit(5.0).alias("sigma_u")
    )
    return reference.sign_audit(s, looks(spark, sf_dir), radius=4.0)


@register(
    f"WITH {_AUDIT_SQL} SELECT id, {rd('o')} AS observed, {rd('pr')} AS projected, {rd('sg')} AS sigma, n_pixels, {rd('al')} AS aligned, {rd('res')} AS residual, {rd('res / greatest(sg, 1)')} AS standardized FROM z"
)
def sign_audit_stations(spark, sf_dir):
    return rounded(audit(spark, sf_dir)[0], "observed", "projected", "sigma", "aligned", "residual", "standardized")


@register(
    f"WITH {_AUDIT_SQL} SELECT any_value(n) AS n, {rd('any_value(raw_r)')} AS raw_r, any_value(sn) AS sign, {rd('any_value(f)')} AS offset, {rd('sqrt(avg(res * res))')} AS rmse, {rd('avg(abs(res))')} AS mae, {rd('corr(al, pr)')} AS aligned_r FROM z"
)
def sign_audit_summary(spark, sf_dir):
    return rounded(audit(spark, sf_dir)[1], "raw_r", "offset", "rmse", "mae", "aligned_r")


@register(
    f"""WITH {_AUDIT_SQL}, k AS (SELECT id, le / sqrt(le * le + ln * ln + lu * lu) AS e, ln / sqrt(le * le + ln * ln + lu * lu) AS n, lu / sqrt(le * le + ln * ln + lu * lu) AS u, n_pixels FROM l)
SELECT id, {rd('e')} AS look_e, {rd('n')} AS look_n, {rd('u')} AS look_u, n_pixels, round(degrees(acos(least(1, greatest(-1, (0.54711975 * e - 0.09799853 * n + 0.83129853 * u) / sqrt(power(0.54711975, 2) + power(0.09799853, 2) + power(0.83129853, 2)))))), 5) + 0.0 AS angle FROM k"""
)
def look_audit(spark, sf_dir):
    out = reference.look_audit(stations(spark, sf_dir), looks(spark, sf_dir), radius=4.0, expected=(0.54711975, -0.09799853, 0.83129853))
    return rounded(out, "look_e", "look_n", "look_u").withColumn("angle", F.round("angle", 5))


@register(
    f"""WITH p AS ({EPOCH_SQL}), c AS (SELECT id, p.x, p.epoch, p.v - z.v AS c FROM p JOIN (SELECT id, v FROM p WHERE epoch = 0) z USING (id)), m AS (SELECT epoch, median(c) AS m FROM c WHERE x > 30 GROUP BY 1)
SELECT id, {rd('sqrt(avg(power(c - m, 2)))')} AS rms, count(*) AS n FROM c JOIN m USING (epoch) GROUP BY 1 HAVING count(*) = 3"""
)
def temporal_rms(spark, sf_dir):
    return rounded(reference.temporal_rms(epochs(spark, sf_dir), ["id"], "epoch", "v", F.col("x") > 30), "rms")


@register(
    f"""WITH p AS ({EPOCH_SQL}), g AS (SELECT id, max(v) FILTER (epoch = 2) - max(v) FILTER (epoch = 0) AS c, bool_or(x <= 10) AS r FROM p GROUP BY 1)
SELECT id, {rd('c - (SELECT median(c) FROM g WHERE r)')} AS change FROM g"""
)
def change_between(spark, sf_dir):
    return rounded(reference.change_between(epochs(spark, sf_dir), ["id"], "epoch", "v", F.col("x") <= 10), "change")


@register(f"WITH p AS ({EPOCH_SQL}) SELECT id, epoch, {rd('v - first_value(v) OVER (PARTITION BY id ORDER BY epoch)')} AS v FROM p WHERE epoch >= 1")
def truncated_series(spark, sf_dir):
    kept = spark.range(1, 3).select(F.col("id").cast("int").alias("epoch"))
    return rounded(reference.truncate_series(epochs(spark, sf_dir).select("id", "epoch", "v"), ["id"], "epoch", "v", kept), "v")


_SCORE = {"rms": "p_retailprice / 10", "coherence": "p_size / 50.0", "residual": "(p_partkey % 23) / 10.0", "gaps": "(p_partkey % 3) * 1.0", "loops": "(p_partkey % 11) * 1.0"}
_UNIT = {c: f"CASE WHEN h{c} > l{c} THEN {'1 - ' if c == 'coherence' else ''}least(greatest(({c} - l{c}) / (h{c} - l{c}), 0), 1) ELSE 0 END" for c in _SCORE}


@register(
    f"""WITH p AS (SELECT p_partkey AS id, {', '.join(f'{v} AS {k}' for k, v in _SCORE.items())} FROM part),
b AS (SELECT {', '.join(f'quantile_cont({c}, 0.05) AS l{c}, quantile_cont({c}, 0.95) AS h{c}' for c in _SCORE)} FROM p WHERE coherence >= 0.2)
SELECT id, CASE WHEN coherence >= 0.2 THEN {rd(' + '.join(f'{w} * ({_UNIT[c]})' for c, w in reference.SCORE_WEIGHTS.items()))} END AS score FROM p, b"""
)
def reference_score(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[F.expr(v).alias(k) for k, v in _SCORE.items()])
    return rounded(reference.reference_score(p, F.col("coherence") >= 0.2).select("id", "score"), "score")


TRACE_SQL = """SELECT CASE s_suppkey % 2 WHEN 0 THEN 'north' ELSE 'west' END AS label, (s_suppkey % 2) * 40 + s_suppkey * (0.3 - (s_suppkey % 2) * 0.9) AS x1, s_suppkey * 0.8 + (s_suppkey % 5) / 7.0 AS y1,
(s_suppkey % 2) * 40 + s_suppkey * (0.3 - (s_suppkey % 2) * 0.9) + (s_suppkey % 3) * 0.7 AS x2, s_suppkey * 0.8 + (s_suppkey % 5) / 7.0 + 1.9 AS y2 FROM supplier"""
_AXIS = "count(*) AS n, sum(w * x) / sum(w) AS ox, sum(w * y) / sum(w) AS oy, atan2(2 * (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)), (sum(w * x * x) / sum(w) - power(sum(w * x) / sum(w), 2)) - (sum(w * y * y) / sum(w) - power(sum(w * y) / sum(w), 2))) / 2 AS th"
_NODE_SQL = f"""s AS (SELECT *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS l FROM ({TRACE_SQL})), k AS (SELECT *, greatest(CAST(ceil(l) AS BIGINT), 1) AS c FROM s WHERE l > 1e-5),
d AS (SELECT label, x1 + (i + 0.5) / c * (x2 - x1) AS x, y1 + (i + 0.5) / c * (y2 - y1) AS y, l / c AS w FROM (SELECT *, unnest(range(0, c)) AS i FROM k)),
g0 AS (SELECT label, {_AXIS} FROM d GROUP BY 1), g AS (SELECT label, ox, oy, CASE WHEN sin(th) < 0 THEN -cos(th) ELSE cos(th) END AS gx, CASE WHEN sin(th) < 0 THEN -sin(th) ELSE sin(th) END AS gy FROM g0),
a AS (SELECT d.*, gx, gy, (x - ox) * gx + (y - oy) * gy AS al FROM d JOIN g USING (label)), e AS (SELECT label, CAST(ceil(quantile_cont(al, 0.01) / 5) AS BIGINT) AS k0, CAST(floor(quantile_cont(al, 0.99) / 5) AS BIGINT) AS k1 FROM a GROUP BY 1),
t AS (SELECT label, k0, unnest(range(k0, k1 + 1)) AS k FROM e), h AS (SELECT label, k - k0 + 1 AS seq, {_AXIS}, any_value(gx) AS gx, any_value(gy) AS gy FROM a JOIN t USING (label) WHERE abs(al - k * 5) <= 2.5 GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN n = 1 THEN gx WHEN cos(th) * gx + sin(th) * gy < 0 THEN -cos(th) ELSE cos(th) END AS tx, CASE WHEN n = 1 THEN gy WHEN cos(th) * gx + sin(th) * gy < 0 THEN -sin(th) ELSE sin(th) END AS ty,
label || (CASE WHEN seq < 10 THEN '0' ELSE '' END) || seq AS node_id, degrees(atan2(gx, gy)) AS az FROM h)"""


def nodes(spark, sf_dir):
    k = F.col("s_suppkey")
    x1, y1 = k % 2 * 40 + k * (0.3 - k % 2 * 0.9), k * 0.8 + k % 5 / F.lit(7.0)
    s = table(spark, sf_dir, "supplier").select(
        F.when(k % 2 == 0, "north").otherwise("west").alias("label"), x1.alias("x1"), y1.alias("y1"), (x1 + k % 3 * 0.7).alias("x2"), (y1 + 1.9).alias("y2")
    )
    return traces.trace_nodes(s)


@register(
    f"WITH {_NODE_SQL} SELECT label, node_id, {rd('ox')} AS x, {rd('oy')} AS y, {rd('CASE WHEN az < 0 THEN az + 360 ELSE az END')} AS bearing, {rd('tx')} AS tx, {rd('ty')} AS ty, {rd('-ty')} AS nx, {rd('tx')} AS ny FROM u"
)
def trace_nodes(spark, sf_dir):
    return rounded(nodes(spark, sf_dir), "x", "y", "bearing", "tx", "ty", "nx", "ny")


@register(
    f"""WITH {_NODE_SQL} SELECT node_id || '_' || side AS point_id, node_id, side, CAST(o AS DOUBLE) AS offset, {rd('ox - o * ty')} AS x, {rd('oy + o * tx')} AS y FROM u, (VALUES ('minus', -2), ('plus', 2)) v(side, o)"""
)
def trace_side_points(spark, sf_dir):
    return rounded(traces.side_points(nodes(spark, sf_dir)), "x", "y")
