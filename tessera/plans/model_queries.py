"""Queries of the dense operators.

Where a field is affine the estimators must return it exactly, so SQL can state
the expected rows.  What has no SQL rests on tests of its operators: kriging,
cokriging and strain weights and errors against NumPy on noisy fields, robust
fits and segmentation against plain loops, change points, transients and the
matched filter on planted series, gates on planted predictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dense
from tessera.operators import interpolate, regress, strain
from tessera.operators.filters import persistent
from tessera.plans.geometry_queries import POINT_SQL, STATION_SQL, points, stations, walls
from tessera.plans.registry import rd, register, rounded, table
from tessera.plans.series_queries import centred
from tessera.runtime import cut_lineage


def affine_epochs(df):
    """Three epochs of east = f(2x + 3y), north = f(4y - x), f = 0, 0.5, 1."""
    e = df.select("id", "x", "y", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("epoch"))
    f = F.col("epoch") / 2
    return e.select("id", "epoch", (f * (2 * F.col("x") + 3 * F.col("y"))).alias("east"), (f * (4 * F.col("y") - F.col("x"))).alias("north"))


#: Fields sampled at the points are estimated at the stations; those known at stations, at the points.
_SUPPORT = f"t AS ({STATION_SQL}), s AS ({POINT_SQL})"
_NETWORK = f"t AS ({POINT_SQL}), st AS ({STATION_SQL})"


@register(
    f"""WITH {_SUPPORT}, ok AS (SELECT t.id, t.x, t.y FROM t JOIN s ON sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2)) <= 9 GROUP BY 1, 2, 3 HAVING count(*) >= 16)
SELECT id AS t_id, CAST(e AS INT) AS epoch, {rd('e / 2.0 * (2 * x + 3 * y)')} AS east, {rd('e / 2.0 * 2')} AS exx, {rd('e / 2.0 * 4')} AS eyy, {rd('e / 2.0 * 2')} AS gamma, {rd('e / 2.0 * 6')} AS dilatation,
{rd('e / 2.0 * -2')} AS rotation FROM ok, range(0, 3) r(e)"""
)
def joint_mls_strain(spark, sf_dir):
    s = points(spark, sf_dir).select("id", "x", "y", F.lit(1.0).alias("p11"), F.lit(0.2).alias("p12"), F.lit(0.5).alias("p22"))
    operator, _ = strain.joint_mls(s, stations(spark, sf_dir).select("id", "x", "y"), radius=9.0, bandwidth=4.0, least=16, max_condition=1e12)
    out = strain.evaluate_joint_mls(operator, affine_epochs(s))
    names = ["east", "exx", "eyy", "gamma", "dilatation", "rotation"]
    return rounded(out.select("t_id", "epoch", *names), *names)


@register(
    f"""WITH {_SUPPORT}, ok AS (SELECT t.id FROM t JOIN s ON sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2)) <= 9 GROUP BY 1 HAVING count(*) >= 16)
SELECT id AS t_id, 2000.0 AS exx, 4000.0 AS eyy, 1000.0 AS exy, 6000.0 AS dilatation FROM ok"""
)
def robust_plane_strain(spark, sf_dir):
    s = points(spark, sf_dir)
    s = s.select("id", "x", "y", (2 * F.col("x") + 3 * F.col("y")).alias("east"), (4 * F.col("y") - F.col("x")).alias("north"), F.lit(1.0).alias("sigma_e"), F.lit(2.0).alias("sigma_n"))
    out = strain.robust_plane_strain(s, stations(spark, sf_dir).select("id", "x", "y"), radius=9.0, bandwidth=4.0, least=16, max_condition=1e9).where("valid")
    return rounded(out.select("t_id", "exx", "eyy", "exy", "dilatation"), "exx", "eyy", "exy", "dilatation").withColumns(
        {c: F.col(c).cast("decimal(5,1)") for c in ("exx", "eyy", "exy", "dilatation")}
    )


@register(
    f"""WITH {_SUPPORT}, ok AS (SELECT t.id, t.x, t.y FROM t JOIN s ON sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2)) <= 9 GROUP BY 1, 2, 3 HAVING count(*) >= 12)
SELECT id AS t_id, CAST(e AS INT) AS epoch, round(e / 2.0 * (2 * x + 3 * y), 4) + 0.0 AS east, round(e / 2.0 * (4 * y - x), 4) + 0.0 AS north FROM ok, range(0, 3) r(e)"""
)
def cokriging(spark, sf_dir):
    """An affine field is in the drift, so weights reproduce it at every target."""
    looks = {"fe": -0.62769383, "fn": -0.11233934, "se": 0.54711975, "sn": -0.09799853}
    look = [F.lit(v).alias(k) for k, v in looks.items()]
    s = points(spark, sf_dir).select("id", "x", "y", *look, F.lit(4.0).alias("fvar"), F.lit(4.0).alias("svar"))
    t = stations(spark, sf_dir).select("id", "x", "y", *look, F.lit(4.0).alias("fvar"))
    w, _ = interpolate.cokriging_weight_relation(s, t, latent=[[100.0, 10.0], [10.0, 60.0]], radius=9.0, condition=False, least=12, most=48)
    obs = affine_epochs(s).select(
        "id", "epoch", (looks["fe"] * F.col("east") + looks["fn"] * F.col("north")).alias("first"), (looks["se"] * F.col("east") + looks["sn"] * F.col("north")).alias("second")
    )
    out = interpolate.evaluate_cokriging(w, obs)
    return out.select("t_id", "epoch", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"))


@register()
def cokriging_barrier(spark, sf_dir):
    """The same with walls and target conditioning: diagnostics of every target."""
    look = [F.lit(v).alias(k) for k, v in {"fe": -0.62769383, "fn": -0.11233934, "se": 0.54711975, "sn": -0.09799853}.items()]
    s = points(spark, sf_dir).select("id", "x", "y", *look, F.lit(4.0).alias("fvar"), F.lit(4.0).alias("svar"))
    t = stations(spark, sf_dir).select("id", "x", "y", *look, F.lit(4.0).alias("fvar"))
    _, d = interpolate.cokriging_weight_relation(s, t, latent=[[100.0, 10.0], [10.0, 60.0]], radius=9.0, segments=walls(spark), exclusion=1.0, least=12, most=48)
    return rounded(d.select("t_id", "n", "valid", "sigma_east", "sigma_north"), "sigma_east", "sigma_north")


@register(
    f"""WITH {_NETWORK}, ok AS (SELECT t.id, t.x, t.y, count(*) AS n FROM t JOIN st ON sqrt(power(st.x - t.x, 2) + power(st.y - t.y, 2)) <= 16 GROUP BY 1, 2, 3 HAVING count(*) >= 8)
SELECT id AS t_id, CAST(e AS INT) AS epoch, CAST(n AS INT) AS n, round(e / 2.0 * (2 * x + 3 * y), 4) + 0.0 AS predicted FROM ok, range(0, 3) r(e)"""
)
def universal_kriging(spark, sf_dir):
    """Linear drift is reproduced exactly by universal kriging weights."""
    st = stations(spark, sf_dir).withColumn("sigma", F.lit(0.5))
    pairs = interpolate.local_pairs(points(spark, sf_dir).select("id", "x", "y"), st, 16.0, least=8)
    w = interpolate.kriging_weight_relation(pairs, "uk_matern32", length=20.0, sill=25.0, nugget=0.0)
    obs = affine_epochs(st).withColumnRenamed("east", "value")
    out = interpolate.evaluate_weights(w, obs)
    return out.select("t_id", "epoch", "n", F.round("predicted", 4).alias("predicted"))


@register(
    f"""WITH {_NETWORK}, j AS (SELECT t.id AS t_id, st.v, 1 / power(1 + st.id % 3, 2) AS w FROM t JOIN st ON sqrt(power(st.x - t.x, 2) + power(st.y - t.y, 2)) <= 16)
SELECT t_id, CAST(count(*) AS INT) AS n, {rd('sum(w * v) / sum(w)')} AS predicted FROM j GROUP BY 1 HAVING count(*) >= 8"""
)
def local_constant(spark, sf_dir):
    st = stations(spark, sf_dir).withColumn("sigma", (1 + F.col("id") % 3).cast("double"))
    pairs = interpolate.local_pairs(points(spark, sf_dir).select("id", "x", "y"), st, 16.0, least=8)
    w = interpolate.kriging_weight_relation(pairs, "local_constant", length=20.0, sill=25.0, nugget=0.0)
    out = interpolate.evaluate_weights(w, st.select("id", F.lit(0).alias("epoch"), F.col("v").alias("value")))
    return rounded(out.select("t_id", "n", "predicted"), "predicted")


@register()
def vertical_model_selection(spark, sf_dir):
    """Leave-one-out grid search over all families, lengths and nuggets; accepted and selected flags.

    An interval is a tile of 100 stations.
    """
    st = stations(spark, sf_dir).select(F.floor(F.col("id") / 100).cast("string").alias("interval"), "id", "x", "y", F.col("v").alias("value"), F.lit(1.0).alias("sigma"))
    p = interpolate.leave_one_out_predictions(st, keys=["interval"], families=list(dense.FAMILIES), lengths=[20.0, 40.0], nuggets=[0.0, 2.0], least=2)
    p = cut_lineage(p)
    return rounded(interpolate.score_candidates(p, gains=interpolate.predictive_gains(p)), "nlpd", "rmse", "coverage", "gain_lower95")


@register()
def fixed_model_evaluation(spark, sf_dir):
    """One fixed model on the tiles of 100 stations as intervals, with all gates."""
    st = stations(spark, sf_dir).select(F.floor(F.col("id") / 100).cast("string").alias("interval"), "id", "x", "y", F.col("v").alias("value"), F.lit(1.0).alias("sigma"))
    p = cut_lineage(interpolate.leave_one_out_predictions(st, keys=["interval"], families=["local_constant", "ok_matern32"], lengths=[20.0], nuggets=[2.0], least=2))
    out = interpolate.evaluate_fixed_model(p)
    return rounded(out, "rmse", "baseline_rmse", "nlpd", "baseline_nlpd", "coverage", "gain_lower95")


@register()
def change_point_summary(spark, sf_dir):
    e = regress.change_evidence(centred(spark, sf_dir), ["event_type"], "day", "x", min_before=10, min_after=3)
    out = regress.change_summary(cut_lineage(regress.change_posterior(e, ["event_type"])), ["event_type"])
    p = F.col("class_probability")
    return rounded(out.select("event_type", p["step"].alias("p_step"), p["hinge"].alias("p_hinge"), "log_bayes_factor", "best_model", "best_date", "date_low", "date_high"), "p_step", "p_hinge", "log_bayes_factor")


@register()
def transient_curves(spark, sf_dir):
    x = centred(spark, sf_dir)
    e = regress.change_evidence(x, ["event_type"], "day", "x", models=("hinge", "hinge2"), min_before=10, min_after=4, prior_scale=3.0, autocorrelated=True, window=("2024-01-12", "2024-01-24"))
    out = regress.posterior_curves(x, regress.change_posterior(e, ["event_type"]), ["event_type"], "day", "x")
    return rounded(out, "low", "mid", "high", "p_positive")


@register()
def bandwidth_selection(spark, sf_dir):
    s = stations(spark, sf_dir)
    s = s.select("id", "x", "y", (F.col("v") + 0.2 * F.col("x")).alias("east"), (F.col("v") - 0.1 * F.col("y")).alias("north"), F.lit(1.0).alias("sigma_e"), F.lit(1.0).alias("sigma_n"))
    return rounded(strain.leave_one_out_bandwidths(s, [6.0, 10.0, 16.0]), "rmse", "se")


@register()
def triangle_strain(spark, sf_dir):
    """An affine field over the Delaunay networks of all stations, one for each tile, with a wall buffer."""
    s = stations(spark, sf_dir).select(F.floor(F.col("id") / 100).alias("network"), "id", "x", "y")
    s = s.select("*", (2 * F.col("x") + 3 * F.col("y")).alias("east"), (4 * F.col("y") - F.col("x")).alias("north"), F.lit(1.0).alias("sigma_e"), F.lit(1.0).alias("sigma_n"))
    out = strain.triangle_strain(s, keys=["network"], segments=walls(spark), buffer=0.5, spacing=1.0, min_angle=5.0, max_condition=50.0)
    return rounded(out.select("network", "triangle", "a", "b", "c", "valid", "reason", "exx", "eyy", "exy", "rotation"), "exx", "eyy", "exy", "rotation")


@register()
def change_point_scan(spark, sf_dir):
    return rounded(regress.scan_change_points(centred(spark, sf_dir), ["event_type"], "day", "x", min_before=10, min_after=3), "delta_bic", "amplitude")


@register()
def change_point_posterior(spark, sf_dir):
    e = regress.change_evidence(centred(spark, sf_dir), ["event_type"], "day", "x", min_before=10, min_after=3)
    return rounded(regress.change_posterior(e, ["event_type"]), "log_evidence", "probability", "class_probability")


@register()
def transient_posterior(spark, sf_dir):
    e = regress.change_evidence(
        centred(spark, sf_dir), ["event_type"], "day", "x", models=("hinge", "hinge2"), min_before=10, min_after=4, prior_scale=3.0, autocorrelated=True, window=("2024-01-12", "2024-01-24")
    )
    return rounded(regress.change_posterior(e, ["event_type"]), "log_evidence", "probability", "class_probability")


@register()
def change_point_bootstrap(spark, sf_dir):
    return rounded(regress.change_point_bootstrap(centred(spark, sf_dir), ["event_type"], "day", "x", min_before=14, min_after=8), "observed", "p")


@register()
def breakpoint_bootstrap(spark, sf_dir):
    return rounded(regress.mean_shift_bootstrap(centred(spark, sf_dir), ["event_type"], "day", "x", min_before=10), "observed", "p")


@register()
def mean_shift_segments(spark, sf_dir):
    out = regress.segment_mean_shifts(centred(spark, sf_dir), ["event_type"], "day", "x")
    return rounded(out.withColumn("breakpoints", F.array_join(F.col("breakpoints").cast("array<string>"), ";")), "penalty", "objective")


@register()
def robust_curve(spark, sf_dir):
    return rounded(regress.robust_curve(centred(spark, sf_dir), ["event_type"], "day", "x"), "fitted")


@register()
def event_response(spark, sf_dir):
    return rounded(regress.event_response(centred(spark, sf_dir), ["event_type"], "day", "x", first_post="2024-01-16"), "step", "decay")


@register()
def spatial_matched_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.groupBy((F.col("user_id") % 7).alias("patch"), F.dayofmonth("ts").alias("t")).agg(F.avg("value").alias("r"))
    full = persistent(r, "patch", "t")
    return rounded(regress.best_templates(r.join(full, "patch"), min_before=8), "statistic", "coefficient", "endpoint", "p")


@register("SELECT 1 AS k, 2.0 AS plane_offset, 0.5 AS plane_x, -0.25 AS plane_y")
def far_field_plane(spark, sf_dir):
    """A plane with one outlier in 17 rows is recovered to rounding."""
    p = points(spark, sf_dir).withColumn("k", F.lit(1))
    p = p.withColumn("value", 2 + 0.5 * F.col("x") - 0.25 * F.col("y") + F.when(F.col("id") % 17 == 0, 40.0).otherwise(0.0))
    out = regress.far_field_plane(p, ["k"], "x", "y", "value", F.lit(True), least=30)
    return out.select("k", F.round("plane_offset", 2).cast("decimal(4,1)").alias("plane_offset"), F.round("plane_x", 2).cast("decimal(4,1)").alias("plane_x"), F.round("plane_y", 2).cast("decimal(4,2)").alias("plane_y"))
