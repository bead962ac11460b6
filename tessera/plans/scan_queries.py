"""Queries over series without a key, quantiles at several levels, and stations left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import interpolate, quantiles, scans, validate
from tessera.operators.spatial import radius_join
from tessera.plans.geometry_queries import POINT_SQL, STATION_SQL, points, stations
from tessera.plans.registry import r6, rd, register, rounded, table

#: All events as one series, in order of time (the factor keeps rounding away from ties); every 701st increment is missing in the strict sum.
_SERIES = "SELECT event_id, ts, value * 0.0117310585786 AS x FROM events"


def _series(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", (F.col("value") * 0.0117310585786).alias("x"), "event_type")


@register(
    f"""WITH e AS ({_SERIES}), s AS (SELECT event_id, ts, sum(x - 0.8) OVER (ORDER BY ts, event_id) AS s FROM e), m AS (SELECT *, min(s) OVER (ORDER BY ts, event_id) AS low FROM s)
SELECT event_id, {rd('s - least(0, low)')} AS cusum FROM m"""
)
def long_cusum(spark, sf_dir):
    """One series of all events, scanned over range partitions."""
    return rounded(scans.page_cusum(_series(spark, sf_dir), "x", ["ts", "event_id"], reference=0.8).select("event_id", "cusum"), "cusum")


@register(
    f"""WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 701 <> 700 THEN value * 0.0117310585786 END AS x FROM events),
s AS (SELECT event_id, sum(x) OVER w AS s, count(*) FILTER (x IS NULL) OVER w AS gone FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, CASE WHEN gone = 0 THEN {rd('s')} END AS cumulative FROM s"""
)
def long_strict_sum(spark, sf_dir):
    e = _series(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 701 != 700, F.col("x")))
    return rounded(scans.strict_cumulative(e, "x", ["ts", "event_id"], ["event_type"]).select("event_id", "cumulative"), "cumulative")


@register(
    """WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT ts, max(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1),
b AS (SELECT l.event_id, r.ts AS bt, r.v AS bv FROM l ASOF LEFT JOIN r ON l.ts >= r.ts), a AS (SELECT l.event_id, r.ts AS at_, r.v AS av FROM l ASOF LEFT JOIN r ON l.ts <= r.ts)
SELECT event_id, bt AS before_at, bv AS before_value, at_ AS after_at, av AS after_value FROM b JOIN a USING (event_id)"""
)
def long_bracket(spark, sf_dir):
    """Every error between the other events next to it, of one series without a key."""
    e = table(spark, sf_dir, "events")
    right = e.where("event_type <> 'error'").groupBy("ts").agg(F.max("value").alias("v"))
    out = scans.bracket(e.where("event_type = 'error'").select("event_id", "ts"), right, "ts", "v")
    return out.select("event_id", "before_at", "before_value", "after_at", "after_value")


@register(
    f"""WITH e AS (SELECT ts, avg(value * 0.0117310585786) AS x FROM events GROUP BY 1), p AS (SELECT ts, row_number() OVER w - 1 AS n1, sum(x) OVER w - x AS s1, count(*) OVER () AS n, sum(x) OVER () AS s FROM e WINDOW w AS (ORDER BY ts)),
d AS (SELECT ts, n1 * (n - n1) / CAST(n AS DOUBLE) * power((s - s1) / (n - n1) - s1 / n1, 2) AS reduction FROM p WHERE n1 >= 20 AND n - n1 >= 3)
SELECT arg_max(ts, reduction) AS split, {rd('max(reduction)')} AS reduction FROM d"""
)
def long_mean_shift(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("ts").agg(F.avg(F.col("value") * 0.0117310585786).alias("x"))
    return rounded(scans.best_mean_shift(e, "x", "ts"), "reduction")


_LEVELS = "GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag), ())"


def _levels_sql(measure: str) -> str:
    q = ", ".join(f"{rd(f'quantile_cont({measure}, {v})')} AS q{int(100 * v)}" for v in (0.1, 0.5, 0.9))
    return f"SELECT CAST(grouping(l_returnflag) + grouping(l_linenumber) AS INT) AS level, l_returnflag, l_linenumber, '{measure}' AS measure, count({measure}) AS n, {q} FROM lineitem GROUP BY {_LEVELS}"


@register(f"{_levels_sql('l_extendedprice')} UNION ALL {_levels_sql('l_quantity')}")
def quantile_levels(spark, sf_dir):
    """Two measures, three quantiles and three grouping levels in the same passes."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice", "l_quantity")
    out = quantiles.quantile_table(li, [["l_returnflag", "l_linenumber"], ["l_returnflag"], []], ["l_extendedprice", "l_quantity"], [0.1, 0.5, 0.9], most=5_000)
    q = [r6(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q90"))]
    return out.select("level", "l_returnflag", "l_linenumber", "measure", "n", *q)


#: Fixed look, and motion of places that is affine in position: up is what the other stations must give back.
_LOOK = (0.62, -0.11, 0.77)
_MOTION_SQL = "e / 2.0 * (2 * x + 3 * y) AS up, 0.1 * e * x AS east, -0.2 * e * y AS north"


def _motion(df):
    e = F.col("epoch")
    return df.withColumns({"up": e / 2.0 * (2 * F.col("x") + 3 * F.col("y")), "east": 0.1 * e * F.col("x"), "north": -0.2 * e * F.col("y")})


@register(
    f"""WITH st AS ({STATION_SQL}), p AS ({POINT_SQL}), c AS (SELECT * FROM st WHERE id = 0),
pix AS (SELECT st.id AS station, p.id, p.x, p.y FROM st JOIN p ON sqrt(power(p.x - st.x, 2) + power(p.y - st.y, 2)) <= 2.5 WHERE st.id <> 0),
ref AS (SELECT p.id, p.x, p.y FROM p, c WHERE sqrt(power(p.x - c.x, 2) + power(p.y - c.y, 2)) <= 6),
t AS (SELECT station, false AS area, id, x, y FROM pix UNION ALL SELECT station, true, ref.id, ref.x, ref.y FROM (SELECT DISTINCT station FROM pix), ref),
ok AS (SELECT t.station, t.area, t.id, t.x, t.y, count(*) AS n FROM t JOIN st ON st.id <> t.station AND sqrt(power(st.x - t.x, 2) + power(st.y - t.y, 2)) <= 16 GROUP BY ALL HAVING count(*) >= 8),
k AS (SELECT *, {_MOTION_SQL} FROM ok, range(0, 3) r(e)),
lev AS (SELECT station, e, median({_LOOK[2]} * up) AS level, count(*) AS n_reference FROM k WHERE area GROUP BY 1, 2 HAVING count(*) >= 5),
g AS (SELECT station, e, count(*) AS n_pixels, min(n) AS n_support, min(n_reference) AS n_reference, median({_LOOK[0]} * east + {_LOOK[1]} * north + level) AS horizontal, median(up) AS up_predicted FROM k JOIN lev USING (station, e) WHERE NOT area GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (SELECT id, CAST(e AS BIGINT) AS e, {_MOTION_SQL} FROM st, range(0, 3) r(e))
SELECT g.station AS id, CAST(g.e AS INT) AS epoch, n_pixels, n_reference, CAST(n_support AS INT) AS n_support, round(horizontal, 4) + 0.0 AS horizontal, round(up_predicted, 4) + 0.0 AS up_predicted,
round({_LOOK[0]} * (m.east - z.east) + {_LOOK[1]} * (m.north - z.north), 4) + 0.0 AS station
FROM g JOIN m ON m.id = g.station AND m.e = g.e JOIN m z ON z.id = 0 AND z.e = g.e"""
)
def station_validation(spark, sf_dir):
    """Each station left out of a field that is affine, which universal kriging gives back exactly."""
    st, p = stations(spark, sf_dir).select("id", "x", "y"), points(spark, sf_dir).select("id", "x", "y")
    look = [F.lit(v).alias(n) for v, n in zip(_LOOK, ("look_e", "look_n", "look_u"), strict=True)]
    disk = lambda centres, radius: radius_join(centres, p, radius)
    pixels = disk(st.where("id <> 0"), 2.5).select(F.col("t_id").alias("station"), F.col("s_id").alias("id"), F.col("s_x").alias("x"), F.col("s_y").alias("y"), *look)
    area = disk(st.where("id = 0"), 6.0).select(F.col("s_id").alias("id"), F.col("s_x").alias("x"), F.col("s_y").alias("y"), *look)
    epochs = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("epoch")
    seen = _motion(p.select("id", "x", "y", epochs))
    seen = seen.select("id", "epoch", (_LOOK[0] * F.col("east") + _LOOK[1] * F.col("north") + _LOOK[2] * F.col("up")).alias("value"))
    motion = _motion(st.select("id", "x", "y", epochs)).select("id", "epoch", "east", "north", "up", F.lit(1.0).alias("sigma_e"), F.lit(1.0).alias("sigma_n"))
    rows, _ = validate.station_validation(
        pixels, area, seen, st.withColumn("sigma", F.lit(0.5)), motion, reference_station=0, radii=[16.0], family="uk_matern32", length=20.0, sill=25.0, nugget=0.0, look_sigma=1.0,
        least_pixels=3, least_reference=5, min_stations=8, min_sectors=1, require_hull=False,
    )
    numbers = [F.round(c, 4).alias(c) for c in ("horizontal", "up_predicted", "station")]
    return rows.select("id", "epoch", "n_pixels", "n_reference", "n_support", *numbers)


@register(
    f"""WITH st AS (SELECT *, id // 100 AS interval, 1.0 + id % 3 AS s FROM ({STATION_SQL})), r AS (SELECT unnest([9.0, 14.0, 25.0]) AS radius),
pairs AS (SELECT a.interval, radius, a.id, a.v AS observed, a.s AS own, b.v, 1 / power(b.s, 2) AS w FROM st a JOIN r ON true JOIN st b ON b.interval = a.interval AND b.id <> a.id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= radius),
mean AS (SELECT interval, radius, id, observed, own, count(*) AS n, sum(w * v) / sum(w) AS p, sum(w) AS sw, sum(w * w) AS sww, sum(w * v * v) / sum(w) AS m2 FROM pairs GROUP BY ALL HAVING count(*) >= 3),
held AS (SELECT interval, radius, count(*) AS n_held FROM st, r GROUP BY ALL),
pred AS (SELECT *, greatest(m2 - p * p, 0) AS scatter FROM mean), z AS (SELECT *, sqrt(power(greatest(sqrt(scatter + 1 / sw), sqrt(scatter * sww / (sw * sw))), 2) + own * own) AS sigma FROM pred),
score AS (SELECT interval, radius, n_held, count(p) AS n, avg(0.5 * (ln(2 * pi() * sigma * sigma) + power((p - observed) / sigma, 2))) AS nlpd, sqrt(avg(power(p - observed, 2))) AS rmse FROM held LEFT JOIN z USING (interval, radius) GROUP BY ALL)
SELECT interval, radius, n / CAST(n_held AS DOUBLE) AS coverage, {rd('nlpd')} AS nlpd, {rd('rmse')} AS rmse,
n = n_held AND row_number() OVER (PARTITION BY interval ORDER BY n = n_held DESC, round(nlpd, 9), round(rmse, 9), radius) = 1 AS selected FROM score"""
)
def full_coverage_selection(spark, sf_dir):
    """Search radii of a weighted mean: the best one that predicts every station of its tile."""
    st = stations(spark, sf_dir).select("id", "x", "y", F.col("v").alias("value"), (1.0 + F.col("id") % 3).alias("sigma"), F.floor(F.col("id") / 100).alias("interval"))
    p = interpolate.leave_one_out_predictions(st, keys=["interval"], families=["local_constant"], lengths=[1.0], nuggets=[0.0], radii=[9.0, 14.0, 25.0], least=3, missing=True)
    return rounded(interpolate.select_of_full_coverage(p, keys=["interval"]).select("interval", "radius", "coverage", "nlpd", "rmse", "selected"), "nlpd", "rmse")
