"""Joins and groups that must not grow in the driver or in one task, whatever the planner thinks of their size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dense
from tessera.operators import interpolate, quantiles, spatial, summaries
from tessera.runtime import cut_lineage


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scattered(spark, n, step=1):
    k = F.col("id")
    return spark.range(n).select((k * step).alias("id"), (k * 37 % 101 / F.lit(9.0)).alias("x"), (k * 73 % 103 / F.lit(9.0)).alias("y"))


def test_radius_join_broadcasts_neither_side_and_repeats_either(spark):
    t, s = scattered(spark, 90), scattered(spark, 120, 2)
    a, b = {r.id: r for r in t.collect()}, {r.id: r for r in s.collect()}
    wanted = {(i, j) for i, p in a.items() for j, q in b.items() if math.hypot(p.x - q.x, p.y - q.y) <= 1.7}
    for side in ("targets", "samples"):
        found = spatial.radius_join(t, s, 1.7, repeat=side)
        assert "Broadcast" not in plan_of(found)
        rows = [(r.t_id, r.s_id) for r in found.collect()]
        assert len(rows) == len(wanted) and set(rows) == wanted


def nearest(a, b, k):
    return {(i, j, n + 1) for i, p in a.items() for n, (_, j) in enumerate(sorted((math.hypot(p.x - q.x, p.y - q.y), j) for j, q in b.items())[:k])}


def test_rounds_of_the_nearest_search_broadcast_nothing_that_grows(spark, monkeypatch):
    plans = []
    cut = spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: plans.append(plan_of(df)) or cut(df))
    few, many = scattered(spark, 80), scattered(spark, 200, 3)
    a, b = ({r.id: r for r in df.collect()} for df in (few, many))
    for t, p, left, right in ((few, many, a, b), (many, few, b, a)):
        found = spatial.nearest_join(t, p, target_id="id", point_id="id", k=3, cell=0.4)
        assert {(r.t_id, r.p_id, r.rank) for r in found.collect()} == nearest(left, right, 3)
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_few_points_meet_all_targets_without_a_round(spark, monkeypatch):
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: 1 / 0)
    targets = scattered(spark, 300).withColumn("y", F.col("y") + F.col("id") * 50)
    walls = spark.createDataFrame([(0.0, 0.0, 2.0, 0.0), (5.0, 9.0, 5.0, 15.0)], "x1 double, y1 double, x2 double, y2 double")
    got = {r.t_id: r.bound for r in spatial.segment_distance_lower_bound(targets, walls, cell=1.0).collect()}
    want = {r.id: max(min(math.hypot(r.x - 1, r.y), math.hypot(r.x - 5, r.y - 12)) - 3, 0) for r in targets.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want)
    a, b = {r.id: r for r in targets.collect()}, {r.id: r for r in scattered(spark, 5).collect()}
    found = spatial.nearest_join(targets, scattered(spark, 5), target_id="id", point_id="id", k=9, digits=9)
    assert {(r.t_id, r.p_id, r.rank) for r in found.collect()} == nearest(a, b, 9)
    near = spatial.nearest_join(targets, scattered(spark, 5), target_id="id", point_id="id", k=9, within=4.0).collect()
    assert {(r.t_id, r.p_id) for r in near} == {(i, j) for i, p in a.items() for j, q in b.items() if math.hypot(p.x - q.x, p.y - q.y) <= 4.0}


def test_only_counted_cells_of_walls_are_broadcast(spark, monkeypatch):
    p = scattered(spark, 60)
    links = spatial.radius_join(p, p, 3.0).select("t_id", "s_id", F.col("t_x").alias("x0"), F.col("t_y").alias("y0"), F.col("s_x").alias("x1"), F.col("s_y").alias("y1"))
    walls = spark.createDataFrame([(1.05, 1.0, 6.13, 7.2), (3.02, 9.1, 8.0, 2.3)], "x1 double, y1 double, x2 double, y2 double")
    few = spatial.visible_links(links, walls, ["t_id", "s_id"], cell=2.0)
    assert plan_of(few).count("BroadcastExchange") == 1
    monkeypatch.setattr(spatial, "BROADCAST_CELLS", 0)
    many = spatial.visible_links(links, walls, ["t_id", "s_id"], cell=2.0)
    assert "Broadcast" not in plan_of(many)
    seen = [{(r.t_id, r.s_id) for r in df.collect()} for df in (few, many)]
    assert seen[0] == seen[1] and 60 < len(seen[0]) < links.count()


@pytest.mark.parametrize("family", list(dense.FAMILIES))
def test_stacked_kriging_is_kriging_of_each_target(family):
    rng = np.random.default_rng(5)
    xy, sigma, at, sill = rng.uniform(0, 30, (9, 12, 2)), rng.uniform(0.5, 2, (9, 12)), rng.uniform(0, 30, (9, 2)), rng.uniform(2, 20, 9)
    xy[3] = xy[3, :1] + np.arange(12)[:, None]  # on a line: no plane
    if family != "gp_matern32":
        xy[5, 1], sigma[5, :2] = xy[5, 0], 0.0  # a station twice, without noise
    w, variance, known = dense.stacked_kriging_weights(family, xy, sigma, at, length=9.0, sill=sill, nugget=0.0)
    for i in range(9):
        found = dense.kriging_weights(family, xy[i], sigma[i], at[i], length=9.0, sill=sill[i], nugget=0.0)
        assert known[i] == (found is not None)
        if found is not None:
            assert np.allclose(w[i], found[0], atol=1e-9) and np.isclose(variance[i], found[1], atol=1e-9)


@pytest.mark.parametrize("sill", ["interval", "kept", "all"])
@pytest.mark.parametrize("family", ["local_constant", "ok_matern32", "uk_rbf", "gp_matern32"])
def test_all_stations_left_out_at_once_as_one_by_one(family, sill):
    rng = np.random.default_rng(8)
    xy, v, s = rng.uniform(0, 30, (25, 2)), rng.normal(0, 5, 25), rng.uniform(0.5, 2, 25)
    p, e, n = dense.left_out_predictions(family, xy, v, s, length=12.0, radius=14.0, nugget=1.0, least=3, sill=sill)
    for i in range(25):
        keep = (np.arange(25) != i) & (np.linalg.norm(xy - xy[i], axis=1) <= 14.0)
        want = math.nan, math.nan
        if keep.sum() >= 3:
            power = dense.interval_sill(v[keep], s[keep]) if sill == "interval" else max(float(np.var(v[keep] if sill == "kept" else v, ddof=1)), 1.0)
            want = dense.kriging_predict(family, xy[keep], v[keep], s[keep], xy[i], length=12.0, sill=power, nugget=1.0)
        assert n[i] == keep.sum() and np.allclose((p[i], e[i]), want, atol=1e-9, equal_nan=True)


def test_values_common_to_frames_are_reduced_before_the_shuffle(spark):
    a = spark.range(4000).select(F.when(F.col("id") > 9, F.col("id") % 7).alias("d"))
    b = spark.range(3000).select((F.col("id") % 5 + 3).alias("d"))
    found = summaries.common_values([a, b], "d")
    assert [r.d for r in found.collect()] == [3, 4, 5, 6] and "Join" not in plan_of(found)


def test_quantile_bands_of_large_groups_and_of_groups_without_values(spark):
    k = F.col("id")
    df = spark.range(3000).select(F.when(k % 3 > 0, k % 3).alias("g"), F.when(k % 3 < 2, k * 7919 % 3001 / F.lit(8.0)).alias("v"))
    got = {r.g: r for r in quantiles.quantile_bands(df, ["g"], "v", most=100).collect()}
    rows = df.collect()
    assert got.keys() == {None, 1, 2} and got[2].mid is None and got[2].scale is None
    for g in (None, 1):
        q = np.quantile([r.v for r in rows if r.g == g], [0.025, 0.5, 0.975, 0.25, 0.75])
        assert np.allclose([got[g].low, got[g].mid, got[g].high, got[g].scale], [*q[:3], 0.7413 * (q[4] - q[3])])


def test_groups_are_matched_on_one_long(spark):
    """Other keys cost a page of 16 MB for each table, whatever its size."""
    rows = spark.range(60).select((F.col("id") % 3).cast("int").alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("j"), "id")
    state = cut_lineage(rows.groupBy("k", "j").agg(F.sum("id").alias("t")))
    for keys in (["k"], ["k", "j"]):
        own = state.groupBy(*keys).agg(F.sum("t").alias("t"))
        found = quantiles.match_groups(rows, own, keys)
        assert "HashedRelationBroadcastMode(List(xxhash64(" in plan_of(found) and "isnull" not in plan_of(found).split("HashedRelationBroadcastMode")[1].split("\n")[0]
        want = {tuple(r[k] for k in keys): r.t for r in own.collect()}
        got = found.collect()
        assert len(got) == 60 and all(want[tuple(r[k] for k in keys)] == r.t for r in got)


def test_left_out_groups_are_dealt_over_tasks_by_their_number(spark):
    st = scattered(spark, 40).select((F.col("id") % 4).alias("interval"), "id", "x", "y", F.col("x").alias("value"), F.lit(1.0).alias("sigma"))
    p = interpolate.leave_one_out_predictions(st, keys=["interval"], families=["ok_matern32"], lengths=[5.0, 9.0], nuggets=[1.0])
    assert "REPARTITION_BY_NUM" in plan_of(p) and p.count() == 80


def test_observations_are_broadcast_only_when_counted(spark, monkeypatch):
    w = spark.createDataFrame([(1, 5, 0.25, 1.0, 2), (1, 6, 0.75, 1.0, 2), (2, 6, 1.0, 4.0, 1)], "t_id long, s_id long, w double, variance double, n int")
    obs = spark.createDataFrame([(5, 0, 4.0), (6, 0, 8.0), (6, 1, 2.0)], "id long, epoch int, value double")
    for most in (200_000, 2):
        monkeypatch.setattr(interpolate, "BROADCAST_OBSERVATIONS", most)
        out = interpolate.evaluate_weights(w, obs)
        assert ("Broadcast" in plan_of(out)) == (most > 2)
        assert sorted((r.t_id, r.epoch, r.predicted) for r in out.collect()) == [(1, 0, 7.0), (1, 1, None), (2, 0, 8.0), (2, 1, 2.0)]
    looks = scattered(spark, 12).select("id", F.lit(0).alias("epoch"), F.col("x").alias("first"), F.col("y").alias("second"))
    long = spark.range(3).select(F.lit(0).cast("long").alias("t_id"), F.col("id").alias("s_id"), F.lit("first").alias("kind"), F.col("id").cast("int").alias("output"), F.lit(1.0).alias("w"), F.lit(1).alias("n_obs"))
    assert "Broadcast" not in plan_of(interpolate.evaluate_cokriging(long, looks))
