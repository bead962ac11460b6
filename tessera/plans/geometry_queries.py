"""Queries over points, segments, grids and looks derived from parts, customers and line items."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import geo, scalars
from tessera.operators import detect, filters, ranking, spatial
from tessera.plans.registry import rd, register, rounded, table
from tessera.plans.series_queries import CELL_SQL, MODEL_SQL, baseline, cells

#: Points in km from parts and stations from suppliers: one tile of the plane per 2,000 parts or 100
#: suppliers, so the density is the same at every size (the factor keeps means away from ties); positions in degrees from customers.
POINT_SQL = "SELECT p_partkey AS id, p_size + (p_partkey % 17) / 17.0 AS x, (p_partkey * 37 % 1009) / 20.0 + (p_partkey % 13) / 13.0 + (p_partkey // 2000) * 60.0 AS y, p_retailprice / 100 AS v FROM part"
STATION_SQL = "SELECT s_suppkey AS id, 1 + (s_suppkey * 37 % 101) / 2.0 + (s_suppkey % 7) / 23.0 AS x, (s_suppkey * 73 % 103) / 2.0 + (s_suppkey % 11) / 29.0 + (s_suppkey // 100) * 60.0 AS y, s_acctbal * 0.007310585786 AS v FROM supplier"
LONLAT_SQL = "SELECT c_custkey AS id, -117.55 + (c_custkey * 31 % 997 - 498) / 500.0 AS lon, 35.74 + (c_custkey * 57 % 991 - 495) / 700.0 AS lat FROM customer"
#: Fixed wall used by the barrier queries: (x1, y1, x2, y2).
WALLS = [(10.2, 5.1, 30.7, 40.3), (35.4, 2.2, 36.1, 48.9)]
WALL_SQL = "SELECT * FROM (VALUES " + ", ".join(map(str, WALLS)) + ") w(x1, y1, x2, y2)"


def points(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (F.col("p_size") + k % 17 / F.lit(17.0)).alias("x"), (k * 37 % 1009 / F.lit(20.0) + k % 13 / F.lit(13.0) + F.floor(k / 2000) * 60.0).alias("y"),
        (F.col("p_retailprice") / 100).alias("v"),
    )


def stations(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), (1 + k * 37 % 101 / F.lit(2.0) + k % 7 / F.lit(23.0)).alias("x"), (k * 73 % 103 / F.lit(2.0) + k % 11 / F.lit(29.0) + F.floor(k / 100) * 60.0).alias("y"),
        (F.col("s_acctbal") * 0.007310585786).alias("v"),
    )


def positions(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (-117.55 + (k * 31 % 997 - 498) / F.lit(500.0)).alias("lon"), (35.74 + (k * 57 % 991 - 495) / F.lit(700.0)).alias("lat")
    )


def walls(spark):
    return spark.createDataFrame(WALLS, "x1 double, y1 double, x2 double, y2 double")


LOOK_SQL = "SELECT s_suppkey AS id, -10.146887 + (s_suppkey % 7) / 10.0 AS h, 39.6181 + (s_suppkey % 11) / 10.0 AS i FROM supplier"


def look_inputs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), (-10.146887 + F.col("s_suppkey") % 7 / F.lit(10.0)).alias("h"), (39.6181 + F.col("s_suppkey") % 11 / F.lit(10.0)).alias("i")
    )


@register(
    f"""WITH l AS ({LOOK_SQL}), v AS (SELECT id, -sin(radians(i)) * cos(radians(h)) AS e, sin(radians(i)) * sin(radians(h)) AS n, cos(radians(i)) AS u FROM l)
SELECT id, {rd('e')} AS e, {rd('n')} AS n, {rd('u')} AS u, {rd('degrees(atan2(n, -e))')} AS heading, {rd('degrees(acos(u / sqrt(e * e + n * n + u * u)))')} AS incidence FROM v"""
)
def look_vectors(spark, sf_dir):
    e, n, u = geo.look_vector(F.col("h"), F.col("i"))
    v = look_inputs(spark, sf_dir).select("id", e.alias("e"), n.alias("n"), u.alias("u"))
    h, i = geo.heading_incidence(F.col("e"), F.col("n"), F.col("u"))
    return rounded(v.select("*", h.alias("heading"), i.alias("incidence")), "e", "n", "u", "heading", "incidence")


@register(
    f"""WITH l AS ({LOOK_SQL}), v AS (SELECT id, -sin(radians(i)) * cos(radians(h)) AS e, sin(radians(i)) * sin(radians(h)) AS n, cos(radians(i)) AS u FROM l),
d AS (SELECT *, id % 13 - 6.0 AS de, id % 5 - 2.0 AS dn, id % 3 - 1.0 AS du, 1 + id % 4 AS se, 2 + id % 3 AS sn, 5.0 AS su FROM v)
SELECT id, {rd('de * e + dn * n + du * u')} AS los,
{rd('sqrt(greatest(power(e * se, 2) + power(n * sn, 2) + power(u * su, 2) + 2 * (e * n * 0.3 * se * sn + e * u * -0.2 * se * su + n * u * 1.0 * sn * su), 0))')} AS sigma FROM d"""
)
def los_projection(spark, sf_dir):
    look = geo.look_vector(F.col("h"), F.col("i"))
    k = F.col("id")
    los = geo.project_enu(k % 13 - 6.0, k % 5 - 2.0, k % 3 - 1.0, look)
    sigma = geo.project_enu_sigma(1 + k % 4, 2 + k % 3, F.lit(5.0), look, 0.3, -0.2, 1.7)
    return rounded(look_inputs(spark, sf_dir).select("id", los.alias("los"), sigma.alias("sigma")), "los", "sigma")


@register(
    f"""WITH v AS (SELECT l_orderkey AS id, l_linenumber AS k, l_discount * 8 AS e, l_tax * 9 AS n, l_quantity / 60 AS u FROM lineitem), w AS (SELECT *, sqrt(e * e + n * n + u * u) AS m FROM v)
SELECT id, k, CASE WHEN m > 0.5 THEN {rd('e / m')} END AS e, CASE WHEN m > 0.5 THEN {rd('n / m')} END AS n, CASE WHEN m > 0.5 THEN {rd('u / m')} END AS u FROM w"""
)
def normalized_looks(spark, sf_dir):
    e, n, u = geo.normalize_look(F.col("l_discount") * 8, F.col("l_tax") * 9, F.col("l_quantity") / 60)
    out = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), e.alias("e"), n.alias("n"), u.alias("u"))
    return rounded(out, "e", "n", "u")


@register(
    f"""WITH p AS ({LONLAT_SQL}), h AS (SELECT *, power(sin((radians(lat) - radians(35.74)) / 2), 2) + cos(radians(lat)) * cos(radians(35.74)) * power(sin(radians(lon + 117.55) / 2), 2) AS a,
(lon + 117.55) * 111.195 * cos(radians(35.74)) AS x, (lat - 35.74) * 111.195 AS y FROM p)
SELECT id, {rd('x')} AS x, {rd('y')} AS y, {rd('sqrt(x * x + y * y)')} AS flat_km, {rd('2 * 6371.0088 * asin(sqrt(least(greatest(a, 0), 1)))')} AS great_circle_km,
{rd('lon')} AS lon, {rd('lat')} AS lat, CAST(round_even(lat * 1e6, 0) AS BIGINT) * 1000000000 + CAST(round_even(lon * 1e6, 0) AS BIGINT) AS key FROM h"""
)
def distances(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    x, y = geo.lonlat_to_xy(lon, lat, -117.55, 35.74)
    p = positions(spark, sf_dir).withColumns({"x": x, "y": y})
    lon2, lat2 = geo.xy_to_lonlat(F.col("x"), F.col("y"), -117.55, 35.74)
    out = p.select(
        "id", "x", "y", geo.distance_km(lat, lon, 35.74, -117.55).alias("flat_km"), geo.haversine_km(lat, lon, 35.74, -117.55).alias("great_circle_km"),
        lon2.alias("lon"), lat2.alias("lat"), geo.coordinate_key(lat, lon).alias("key"),
    )
    return rounded(out, "x", "y", "flat_km", "great_circle_km", "lon", "lat")


@register(f"WITH p AS ({LONLAT_SQL}) SELECT id, {rd('lon')} AS lon, {rd('lat')} AS lat FROM p")
def utm_round_trip(spark, sf_dir):
    e, n = geo.to_utm_km(F.col("lon"), F.col("lat"))
    p = positions(spark, sf_dir).select("id", e.alias("e"), n.alias("n"))
    lon, lat = geo.from_utm_km(F.col("e"), F.col("n"))
    return rounded(p.select("id", lon.alias("lon"), lat.alias("lat")), "lon", "lat")


@register(
    f"""WITH p AS ({LONLAT_SQL}) SELECT id FROM p WHERE lat BETWEEN {35.74 - 21.5 / 110.574!r} AND {35.74 + 21.5 / 110.574!r}
AND 2 * 6371.0088 * asin(sqrt(power(sin((radians(lat) - radians(35.74)) / 2), 2) + cos(radians(lat)) * cos(radians(35.74)) * power(sin(radians(lon + 117.55) / 2), 2))) <= 20"""
)
def disk_mask(spark, sf_dir):
    a, b, c, d = geo.crop_box(35.74, -117.55, 20.0)
    box = F.col("lat").between(a, b) & F.col("lon").between(c, d)
    return positions(spark, sf_dir).where(box & filters.disk_mask(F.col("lat"), F.col("lon"), 35.74, -117.55, 20.0)).select("id")


TRACK_SQL = """SELECT l_orderkey AS id, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice / 1000 END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice / 1000 END) AS d,
max(CASE WHEN l_linenumber = 1 THEN 1 + l_tax END) AS sa, max(CASE WHEN l_linenumber = 2 THEN 1 + l_discount END) AS sd FROM lineitem GROUP BY 1"""


@register(
    f"""WITH t AS ({TRACK_SQL}), k AS (SELECT *, -0.62769383 AS ae, -0.11233934 AS an, 0.54711975 AS de, -0.09799853 - (id % 3) / 10.0 AS dn FROM t),
q AS (SELECT *, ae * dn - an * de AS det, ae * ae + an * an + de * de + dn * dn AS tot FROM k),
r AS (SELECT *, (tot + sqrt(greatest(tot * tot - 4 * det * det, 0))) / (2 * abs(det)) AS cond, sa * sa + 4 AS va, sd * sd + 9 AS vd, 0.5 * 2 * 3 AS vx FROM q),
s AS (SELECT *, abs(det) > 1e-6 AND cond <= 8 AND a IS NOT NULL AND d IS NOT NULL AS valid FROM r)
SELECT id, coalesce(valid, false) AS valid, CASE WHEN valid THEN {rd('(dn * a - an * d) / det')} END AS east, CASE WHEN valid THEN {rd('(ae * d - de * a) / det')} END AS north,
CASE WHEN valid THEN {rd('sqrt(dn * dn * va + an * an * vd - 2 * dn * an * vx) / abs(det)')} END AS sigma_east,
CASE WHEN valid THEN {rd('sqrt(de * de * va + ae * ae * vd - 2 * de * ae * vx) / abs(det)')} END AS sigma_north,
CASE WHEN valid THEN {rd('(-dn * de * va - an * ae * vd + (dn * ae + an * de) * vx) / (det * det)')} END AS cov_en, CASE WHEN valid THEN {rd('cond')} END AS condition FROM s"""
)
def two_track_inversion(spark, sf_dir):
    pick = lambda n, c: F.max(F.when(F.col("l_linenumber") == n, c))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        pick(1, F.col("l_extendedprice") / 1000).alias("a"), pick(2, F.col("l_extendedprice") / 1000).alias("d"),
        pick(1, 1 + F.col("l_tax")).alias("sa"), pick(2, 1 + F.col("l_discount")).alias("sd"),
    )
    looks = (F.lit(-0.62769383), F.lit(-0.11233934)), (F.lit(0.54711975), -0.09799853 - F.col("id") % 3 / F.lit(10.0))
    out = geo.solve_two_track(F.col("a"), F.col("d"), *looks, F.col("sa"), F.col("sd"), 2.0, 3.0, 0.5)
    return rounded(t.select("id", *[v.alias(k) for k, v in out.items()]), *[k for k in out if k != "valid"])


@register(
    f"""WITH l AS (SELECT s_suppkey AS id, s_acctbal / 100 AS los, 0.77 + (s_suppkey % 5) / 50.0 AS u, (s_suppkey % 9) * 1.5 AS v, 2.0 + s_suppkey % 3 AS sv FROM supplier),
r AS (SELECT median(u * v) AS ref, 1.4826 * median(abs(u * v - m)) AS mad FROM l, (SELECT median(u * v) AS m FROM l))
SELECT id, {rd('u * v - ref')} AS vertical_term, {rd('los - (u * v - ref)')} AS corrected, {rd('sqrt(u * u * sv * sv + mad * mad)')} AS sigma FROM l, r"""
)
def vertical_correction(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        k.alias("id"), (F.col("s_acctbal") / 100).alias("los"), (0.77 + k % 5 / F.lit(50.0)).alias("u"), (k % 9 * 1.5).alias("v"), (2.0 + k % 3).alias("sv"), F.lit(1).alias("one")
    )
    from tessera.functions.stats import MAD_TO_SIGMA, median_and_mad

    ref = median_and_mad(s.withColumn("p", F.col("u") * F.col("v")), ["one"], "p")
    j = s.join(F.broadcast(ref), "one")
    out = geo.correct_vertical(F.col("los"), F.col("u"), F.col("v"), F.col("sv"), F.col("center"), MAD_TO_SIGMA * F.col("mad"))
    return rounded(j.select("id", *[v.alias(n) for n, v in out.items()]), *out)


@register(
    f"""WITH g AS (SELECT p_brand, regr_slope(v, x) AS ex, regr_slope(v, y) AS ey, regr_slope(w, x) AS nx, regr_slope(w, y) AS ny FROM
(SELECT p_brand, p_size AS x, (p_partkey % 101) / 10.0 AS y, p_retailprice / 10 AS v, (p_partkey * 7 % 53) * 1.0 AS w FROM part) GROUP BY 1),
s AS (SELECT p_brand, 1000 * ex AS xx, 1000 * ny AS yy, 500 * (ey + nx) AS xy, 500 * (nx - ey) AS rot FROM g)
SELECT p_brand, {rd('xx')} AS exx, {rd('yy')} AS eyy, {rd('xy')} AS exy, {rd('2 * xy')} AS gamma, {rd('xx + yy')} AS dilatation, {rd('rot')} AS rotation,
{rd('sqrt(power((xx - yy) / 2, 2) + xy * xy)')} AS max_shear, {rd('(xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy)')} AS principal_1,
{rd('(xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy)')} AS principal_2,
{rd('CASE WHEN atan2(2 * xy, xx - yy) < 0 THEN degrees(atan2(2 * xy, xx - yy) / 2) + 180 ELSE degrees(atan2(2 * xy, xx - yy) / 2) END')} AS azimuth FROM s"""
)
def strain_invariants(spark, sf_dir):
    k = F.col("p_partkey")
    x, y, v, w = F.col("p_size"), k % 101 / F.lit(10.0), F.col("p_retailprice") / 10, (k * 7 % 53).cast("double")
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.regr_slope(v, x).alias("ex"), F.regr_slope(v, y).alias("ey"), F.regr_slope(w, x).alias("nx"), F.regr_slope(w, y).alias("ny")
    )
    out = geo.strain_invariants(F.col("ex"), F.col("ey"), F.col("nx"), F.col("ny"), scale=1000.0)
    return rounded(g.select("p_brand", *[c.alias(n) for n, c in out.items()]), *out)


TRIANGLE_SQL = f"WITH p AS ({POINT_SQL}), t AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM p a JOIN p b ON b.id = a.id + 1 JOIN p c ON c.id = a.id + 2)"


def triangles(spark, sf_dir):
    p = points(spark, sf_dir)
    shift = lambda k: p.select((F.col("id") - k).alias("id"), F.col("x").alias(f"x{k + 1}"), F.col("y").alias(f"y{k + 1}"))
    return shift(0).join(shift(1), "id").join(shift(2), "id")


CORNERS = tuple((f"x{i}", f"y{i}") for i in (1, 2, 3))


def corners():
    return tuple((F.col(a), F.col(b)) for a, b in CORNERS)


@register(
    f"""{TRIANGLE_SQL}, e AS (SELECT *, abs((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)) AS det, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS a, sqrt(power(x3 - x2, 2) + power(y3 - y2, 2)) AS b,
sqrt(power(x1 - x3, 2) + power(y1 - y3, 2)) AS c, power(x2 - x1, 2) + power(y2 - y1, 2) + power(x3 - x1, 2) + power(y3 - y1, 2) AS tot FROM t)
SELECT id, {rd('det / 2')} AS area, {rd('greatest(a, b, c)')} AS longest_edge, {rd('least(a, b, c)')} AS shortest_edge,
round(degrees(least(acos(least(1, greatest(-1, (a * a + c * c - b * b) / (2 * a * c)))), acos(least(1, greatest(-1, (a * a + b * b - c * c) / (2 * a * b)))), acos(least(1, greatest(-1, (b * b + c * c - a * a) / (2 * b * c)))))), 3) + 0.0 AS min_angle,
round((tot + sqrt(greatest(tot * tot - 4 * det * det, 0))) / (2 * det), 3) + 0.0 AS condition FROM e WHERE det > 0.01"""
)
def triangle_metrics(spark, sf_dir):
    t = triangles(spark, sf_dir)
    out = t.select("id", *[v.alias(k) for k, v in geo.triangle_metrics(corners()).items()]).where("area > 0.005")
    return rounded(out, "area", "longest_edge", "shortest_edge").withColumns({k: F.round(k, 3) for k in ("min_angle", "condition")})


@register(
    f"""{TRIANGLE_SQL}, w AS (SELECT *, x3 + 2 AS x4, y3 - 1 AS y4 FROM t), o AS (SELECT *, (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) AS o1, (x2 - x1) * (y4 - y1) - (y2 - y1) * (x4 - x1) AS o2,
(x4 - x3) * (y1 - y3) - (y4 - y3) * (x1 - x3) AS o3, (x4 - x3) * (y2 - y3) - (y4 - y3) * (x2 - x3) AS o4, power(x2 - x1, 2) + power(y2 - y1, 2) AS len FROM w),
d AS (SELECT *, least(1, greatest(0, ((x3 - x1) * (x2 - x1) + (y3 - y1) * (y2 - y1)) / len)) AS s FROM o)
SELECT id, {rd('o1')} AS orientation, (o1 > 0) <> (o2 > 0) AND (o3 > 0) <> (o4 > 0) AS crosses, {rd('sqrt(power(x3 - x1 - s * (x2 - x1), 2) + power(y3 - y1 - s * (y2 - y1), 2))')} AS distance FROM d"""
)
def segment_predicates(spark, sf_dir):
    a, b, c = corners()
    d = (c[0] + 2, c[1] - 1)
    out = triangles(spark, sf_dir).select(
        "id", geo.orientation(a, b, c).alias("orientation"), geo.segments_intersect(a, b, c, d).alias("crosses"), geo.point_segment_distance(c, a, b).alias("distance")
    )
    return rounded(out, "orientation", "distance")


@register(
    f"""WITH p AS ({POINT_SQL})
SELECT t.id AS target, count(*) AS n, {rd('sum(p.v)')} AS total, {rd('max(sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)))')} AS farthest
FROM p t JOIN p ON sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) <= 6 GROUP BY 1"""
)
def radius_join(spark, sf_dir):
    p = points(spark, sf_dir)
    j = spatial.radius_join(p.select("id", "x", "y"), p, 6.0)
    g = j.groupBy(F.col("t_id").alias("target")).agg(F.count("*").alias("n"), F.sum("s_v").alias("total"), F.max("distance").alias("farthest"))
    return rounded(g, "total", "farthest")


@register(
    f"""WITH p AS ({POINT_SQL}), t AS ({STATION_SQL}), d AS (SELECT t.id AS t_id, p.id AS p_id, sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) AS distance FROM t, p)
SELECT t_id, p_id, {rd('distance')} AS distance, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY distance, p_id) AS k FROM d) WHERE k <= 3"""
)
def nearest_join(spark, sf_dir):
    out = spatial.nearest_join(stations(spark, sf_dir), points(spark, sf_dir), target_id="id", point_id="id", k=3, cell=2.0)
    return rounded(out, "distance")


@register(
    f"""WITH p AS ({POINT_SQL}), d AS (SELECT t.id AS t_id, p.id AS s_id, sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) AS distance FROM p t, p)
SELECT t_id, s_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY round(distance, 9), s_id) AS k FROM d WHERE distance <= 12) WHERE k <= 48"""
)
def nearest_donors(spark, sf_dir):
    p = points(spark, sf_dir)
    out = spatial.nearest_join(p, p, target_id="id", point_id="id", k=48, cell=4.0, within=12.0, digits=9)
    return out.select("t_id", F.col("p_id").alias("s_id"), "rank")


def barrier_links(spark, sf_dir):
    p = points(spark, sf_dir)
    j = spatial.radius_join(p.select("id", "x", "y"), p.select("id", "x", "y"), 5.0)
    return j.select("t_id", "s_id", F.col("t_x").alias("x0"), F.col("t_y").alias("y0"), F.col("s_x").alias("x1"), F.col("s_y").alias("y1"))


_LINK_SQL = f"""WITH p AS ({POINT_SQL}), w AS ({WALL_SQL}), l AS (SELECT t.id AS t_id, p.id AS s_id, t.x AS px, t.y AS py, p.x AS qx, p.y AS qy FROM p t JOIN p ON sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) <= 5),
o AS (SELECT t_id, s_id, (qx - px) * (y1 - py) - (qy - py) * (x1 - px) AS o1, (qx - px) * (y2 - py) - (qy - py) * (x2 - px) AS o2, (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) AS o3,
(x2 - x1) * (qy - y1) - (y2 - y1) * (qx - x1) AS o4 FROM l, w), b AS (SELECT DISTINCT t_id, s_id FROM o WHERE o1 * o2 < 0 AND o3 * o4 < 0)
SELECT t_id, count(*) AS n_visible FROM l ANTI JOIN b USING (t_id, s_id) GROUP BY 1"""


@register(_LINK_SQL)
def barrier_anti_join(spark, sf_dir):
    """Links that no wall blocks (closed rule; no link here touches a wall's end)."""
    kept = spatial.visible_links(barrier_links(spark, sf_dir), walls(spark), ["t_id", "s_id"])
    return kept.groupBy("t_id").agg(F.count("*").alias("n_visible"))


@register(_LINK_SQL)
def barrier_open_ends(spark, sf_dir):
    kept = spatial.visible_links(barrier_links(spark, sf_dir), walls(spark), ["t_id", "s_id"], rule="open_ends")
    return kept.groupBy("t_id").agg(F.count("*").alias("n_visible"))


@register(
    f"""WITH p AS ({POINT_SQL}), w AS (SELECT (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) / 2 AS h FROM ({WALL_SQL}))
SELECT id AS t_id, {rd('greatest(min(sqrt(power(x - mx, 2) + power(y - my, 2))) - (SELECT max(h) FROM w), 0)')} AS bound FROM p, w GROUP BY 1"""
)
def distance_lower_bound(spark, sf_dir):
    return rounded(spatial.segment_distance_lower_bound(points(spark, sf_dir), walls(spark), cell=8.0), "bound")


GRID_SQL = "SELECT CAST(l_linenumber - 1 AS INT) AS row, CAST(round(l_discount * 100) AS INT) AS col, avg(l_extendedprice) / 1000 AS v, max(l_tax) > 0.01 AS valid FROM lineitem GROUP BY 1, 2"


@register(
    f"""WITH g AS ({GRID_SQL}), t AS (SELECT s_suppkey AS t_id, (s_suppkey % 50) / 10.0 AS r, (s_suppkey % 83) / 10.0 AS c FROM supplier),
k AS (SELECT t_id, CAST(floor(r) AS INT) + i AS row, CAST(floor(c) AS INT) + j AS col, (CASE i WHEN 1 THEN r - floor(r) ELSE 1 - r + floor(r) END) * (CASE j WHEN 1 THEN c - floor(c) ELSE 1 - c + floor(c) END) AS w
FROM t, range(0, 2) a(i), range(0, 2) b(j)), s AS (SELECT t_id, w, v, coalesce(valid, false) AND v IS NOT NULL AS ok FROM k LEFT JOIN g USING (row, col) WHERE w > 0)
SELECT t_id, {rd('sum(CASE WHEN ok THEN w ELSE 0 END)')} AS support,
CASE WHEN sum(CASE WHEN ok THEN w ELSE 0 END) >= 0.999 THEN {rd('sum(CASE WHEN ok THEN w * v END) / sum(CASE WHEN ok THEN w ELSE 0 END)')} END AS v FROM s GROUP BY 1"""
)
def bilinear_resample(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("row"), F.round(F.col("l_discount") * 100).cast("int").alias("col")).agg(
        (F.avg("l_extendedprice") / 1000).alias("v"), (F.max("l_tax") > 0.01).alias("valid")
    )
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 50 / F.lit(10.0)).alias("row"), (k % 83 / F.lit(10.0)).alias("col"))
    return rounded(spatial.bilinear_resample(g, t, values=["v"]), "support", "v")


@register(
    f"""WITH t AS ({POINT_SQL}), s AS ({STATION_SQL}),
r AS (SELECT unnest([6.0, 12.0, 20.0]) AS radius), d AS (SELECT t.id AS t_id, radius, s.id AS s_id, s.x - t.x AS dx, s.y - t.y AS dy FROM t, s, r WHERE sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2)) <= radius),
a AS (SELECT *, atan2(dy, dx) AS a FROM d), g AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY t_id, radius ORDER BY a), min(a) OVER (PARTITION BY t_id, radius) + 2 * pi()) - a AS gap FROM a),
c AS (SELECT t_id, radius, count(*) AS n, count(DISTINCT CAST(floor((CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END) / (pi() / 4)) AS INT)) AS sectors, max(gap) <= pi() + 1e-9 AS hull FROM g GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY radius) AS k FROM c WHERE n >= 6 AND sectors >= 3 AND hull)
SELECT t_id, CAST(radius AS DOUBLE) AS radius, CAST(n AS INT) AS n, sectors FROM f WHERE k = 1"""
)
def adaptive_support(spark, sf_dir):
    out = spatial.adaptive_support(points(spark, sf_dir), stations(spark, sf_dir), [6.0, 12.0, 20.0])
    return out.select("t_id", "radius", "n", "sectors")


_HOT_SQL = f"""c AS ({CELL_SQL}), {MODEL_SQL}, z AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', day) AS BIGINT) AS row, CAST(hr AS BIGINT) AS col, (x - center) / sqrt(s * s + excess * excess) AS z
FROM c JOIN m USING (event_type, hr) WHERE supported), hot AS (SELECT *, CAST(sign(z) AS INT) AS sg, event_type || '|' || CAST(sign(z) AS INT) || '|' || (row * 100 + col) AS cell FROM z WHERE abs(z) >= 0.8)"""


def z_grid(spark, sf_dir):
    c = cells(spark, sf_dir)
    model = detect.robust_baseline(c, ["event_type", "hr"], "x", "s", baseline(), 15)
    z = detect.standardized(c, model, ["event_type", "hr"], "x", "s").where("z IS NOT NULL")
    return z.select("event_type", F.datediff("day", F.lit("2024-01-01")).alias("row"), F.col("hr").alias("col"), "z")


@register(
    f"""WITH RECURSIVE {_HOT_SQL}, e AS (SELECT a.cell AS a, b.cell AS b FROM hot a JOIN hot b ON a.event_type = b.event_type AND a.sg = b.sg AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
w AS (SELECT cell AS c0, cell AS c1 FROM hot UNION SELECT w.c0, e.b FROM w JOIN e ON w.c1 = e.a), lab AS (SELECT c0 AS cell, min(c1) AS root FROM w GROUP BY 1)
SELECT event_type, sg AS sign, {rd('sum(abs(z) - 0.8)')} AS mass, count(*) AS n_cells, {rd('max(abs(z))')} AS peak, {rd('avg(col)')} AS east, {rd('avg(row)')} AS north
FROM hot JOIN lab USING (cell) GROUP BY event_type, sg, root HAVING count(*) >= 4"""
)
def signed_clusters(spark, sf_dir):
    z = z_grid(spark, sf_dir).withColumns({"e": F.col("col").cast("double"), "n": F.col("row").cast("double"), "target": F.col("row") * 100 + F.col("col")})
    out = detect.signed_clusters(z, ["event_type"], "z", "e", "n", "target", threshold=0.8)
    return rounded(out.select("event_type", "sign", "mass", "n_cells", "peak", "east", "north"), "mass", "peak", "east", "north")


@register(
    f"""WITH RECURSIVE {_HOT_SQL}, e AS (SELECT a.cell AS a, b.cell AS b FROM hot a JOIN hot b ON a.event_type = b.event_type AND a.sg = b.sg AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
w AS (SELECT cell AS c0, cell AS c1 FROM hot UNION SELECT w.c0, e.b FROM w JOIN e ON w.c1 = e.a), lab AS (SELECT c0 AS cell, min(c1) AS root FROM w GROUP BY 1),
k AS (SELECT event_type, sum(abs(z) - 0.8) AS mass FROM hot JOIN lab USING (cell) GROUP BY event_type, sg, root HAVING count(*) >= 4)
SELECT event_type, {rd('coalesce(max(mass), 0)')} AS max_mass FROM (SELECT DISTINCT event_type FROM z) LEFT JOIN k USING (event_type) GROUP BY 1"""
)
def maximum_cluster_mass(spark, sf_dir):
    z = z_grid(spark, sf_dir).withColumns({"e": F.col("col").cast("double"), "n": F.col("row").cast("double"), "target": F.col("row") * 100 + F.col("col")})
    clusters = detect.signed_clusters(z, ["event_type"], "z", "e", "n", "target", threshold=0.8)
    return rounded(detect.maximum_cluster_mass(z, clusters, ["event_type"]), "max_mass")


@register(
    f"""WITH c AS ({CELL_SQL}), g AS (SELECT event_type, date_diff('day', DATE '2024-01-01', day) AS row, hr AS col, x FROM c)
SELECT a.event_type, CAST(a.row AS INT) AS row, a.col, {rd('sum(b.x) / count(b.x)')} AS local_mean, {rd('count(b.x) / 9.0')} AS coverage
FROM g a JOIN g b ON a.event_type = b.event_type AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3"""
)
def local_mean(spark, sf_dir):
    from tessera.operators.series import local_mean as box

    g = cells(spark, sf_dir).select("event_type", F.datediff("day", F.lit("2024-01-01")).alias("row"), F.col("hr").alias("col"), "x")
    out = box(g, "x", 3, ["event_type"])
    return rounded(out.select("event_type", "row", "col", "local_mean", "coverage"), "local_mean", "coverage")


@register(
    f"""WITH p AS (SELECT p_brand, median(p_size) AS a, avg(p_size) AS c11, covar_samp(p_size, p_retailprice / 100) AS c12, var_samp(p_retailprice / 100) AS c22 FROM part GROUP BY 1 HAVING count(*) > 2),
f AS (SELECT *, greatest(1.0, 1e-6 * ((c11 + c22) / 2 + sqrt(power((c11 - c22) / 2, 2) + c12 * c12))) AS fl, (c11 + c22) / 2 AS m, sqrt(power((c11 - c22) / 2, 2) + c12 * c12) AS h, atan2(2 * c12, c11 - c22) / 2 AS th FROM p),
l AS (SELECT *, greatest(m + h, fl) AS l1, greatest(m - h, fl) AS l2 FROM f)
SELECT p_brand, {rd('power(cos(th), 2) / l1 + power(sin(th), 2) / l2')} AS p11, {rd('cos(th) * sin(th) * (1 / l1 - 1 / l2)')} AS p12, {rd('power(sin(th), 2) / l1 + power(cos(th), 2) / l2')} AS p22 FROM l"""
)
def regularized_precision(spark, sf_dir):
    y = F.col("p_retailprice") / 100
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.avg("p_size").alias("c11"), F.covar_samp(F.col("p_size"), y).alias("c12"), F.var_samp(y).alias("c22"), F.count("*").alias("n")
    ).where("n > 2")
    out = geo.regularized_precision(F.col("c11"), F.col("c12"), F.col("c22"))
    return rounded(g.select("p_brand", *[v.alias(k) for k, v in out.items()]), *out)


@register(
    f"""WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 37) * 1.0 AS x, (s_suppkey % 41) * 1.0 AS y, (s_suppkey * 29 % 180) * 1.0 AS st, 4.0 AS len FROM supplier), u AS (SELECT *, sin(radians(st)) AS sn, cos(radians(st)) AS cs FROM s)
SELECT id, {rd('x - sn * len / 2')} AS x1, {rd('y - cs * len / 2')} AS y1, {rd('x + sn * len / 2')} AS x2, {rd('y + cs * len / 2')} AS y2, {rd('x * sn + y * cs')} AS parallel, {rd('-x * cs + y * sn')} AS normal FROM u"""
)
def strike_segments(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 37).cast("double").alias("x"), (k % 41).cast("double").alias("y"), (k * 29 % 180).cast("double").alias("st"))
    (x1, y1), (x2, y2) = geo.segment_from_strike(F.col("x"), F.col("y"), F.col("st"), F.lit(4.0))
    rot = geo.rotate_to_strike(F.col("x"), F.col("y"), F.col("st"))
    out = s.select("id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), *[v.alias(n) for n, v in rot.items()])
    return rounded(out, "x1", "y1", "x2", "y2", "parallel", "normal")


@register(
    f"""SELECT s_suppkey AS id, {rd('0.12 + 0.76 * i / 13')} AS fraction, {rd('s_acctbal / 100 + (0.12 + 0.76 * i / 13) * 3')} AS x FROM supplier, range(0, 14) t(i)"""
)
def aperture_samples(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal", F.explode(scalars.linspace(0.12, 0.88, 14)).alias("fraction"))
    return rounded(s.select("id", "fraction", (F.col("s_acctbal") / 100 + F.col("fraction") * 3).alias("x")), "fraction", "x")


@register(
    f"""WITH p AS ({LONLAT_SQL}), h AS (SELECT *, 2 * 6371.0088 * asin(sqrt(power(sin((radians(lat) - radians(35.74)) / 2), 2) + cos(radians(lat)) * cos(radians(35.74)) * power(sin(radians(lon + 117.55) / 2), 2))) AS d0 FROM p),
c AS (SELECT lat AS la, lon AS lo FROM h ORDER BY d0, id LIMIT 1),
n AS (SELECT id AS station, 2 * 6371.0088 * asin(sqrt(power(sin((radians(lat) - radians(la)) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * power(sin(radians(lon - lo) / 2), 2))) AS d FROM p, c)
SELECT station, {rd('d')} AS distance FROM n ORDER BY d, station LIMIT 10"""
)
def station_circle(spark, sf_dir):
    s = positions(spark, sf_dir).withColumnRenamed("id", "station")
    return rounded(ranking.station_circle(s, 35.74, -117.55).select("station", "distance"), "distance")


@register(
    f"""SELECT s_suppkey AS id, CASE kind WHEN 0 THEN {rd('exp(-d / 8)')} WHEN 1 THEN {rd('(1 + sqrt(3.0) * d / 8) * exp(-sqrt(3.0) * d / 8)')} ELSE {rd('exp(-0.5 * d * d / 64)')} END AS k,
CAST(kind AS INT) AS kind FROM (SELECT s_suppkey, (s_suppkey % 60) / 2.0 AS d FROM supplier), range(0, 3) t(kind)"""
)
def kernels(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 60 / F.lit(2.0)).alias("d"))
    all_three = F.array(*[geo.kernel(n, F.col("d"), 8.0) for n in ("exponential", "matern32", "rbf")])
    return rounded(s.select("id", F.posexplode(all_three).alias("kind", "k")), "k")


