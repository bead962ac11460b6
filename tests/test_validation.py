"""Held-out weights, station validation, robust planes, choices and cell indexes against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dense
from tessera.operators import interpolate, joins, reference, spatial, strain, validate


def test_held_out_weights_equal_plain_solutions():
    rng = np.random.default_rng(1)
    for family in dense.FAMILIES:
        for n in (6, 11):
            xy, sigma = rng.uniform(-20, 20, (n, 2)), rng.uniform(0.3, 3, n)
            targets, held = rng.uniform(-20, 20, (9, 2)), rng.integers(-1, n, 9)
            w, variance = dense.held_out_weights(family, xy, sigma, targets, held, length=15, sill=30, nugget=1.5)
            for t in range(9):
                kept = np.arange(n) != held[t]
                want = dense.kriging_weights(family, xy[kept], sigma[kept], targets[t], length=15, sill=30, nugget=1.5)
                assert np.allclose(w[t, kept], want[0], atol=1e-9) and variance[t] == pytest.approx(want[1], abs=1e-9)
                assert held[t] < 0 or w[t, held[t]] == 0
    line = np.column_stack([np.arange(7.0), np.zeros(7)])  # collinear: no universal drift
    assert np.isnan(dense.held_out_weights("uk_rbf", line, np.ones(7), np.zeros((2, 2)), np.array([-1, 3]), length=5, sill=1, nugget=0)[1]).all()
    double = np.array([[0, 0], [0, 0], [4.0, 1], [1, 5], [6, 6], [2, 2]])  # two stations in one place without noise: singular
    w, variance = dense.held_out_weights("ok_matern32", double, np.zeros(6), np.array([[3.0, 3], [1, 1]]), np.array([0, -1]), length=5, sill=1, nugget=0)
    want = dense.kriging_weights("ok_matern32", double[1:], np.zeros(5), np.array([3.0, 3]), length=5, sill=1, nugget=0)
    assert np.allclose(w[0, 1:], want[0], atol=1e-8) and variance[0] == pytest.approx(want[1], abs=1e-8)


def test_station_validation_equals_leaving_each_station_out(spark, monkeypatch):
    monkeypatch.setattr(validate, "TARGETS", 7)
    rng = np.random.default_rng(2)
    names = [f"s{i:02d}" for i in range(11)]
    xy = rng.uniform(0, 40, (11, 2))
    xy[10] = (300.0, 300.0)  # no support
    sigma = rng.uniform(0.5, 2, 11)
    look = lambda n: np.column_stack([rng.normal(0.6, 0.02, n), rng.normal(-0.1, 0.02, n), rng.normal(0.75, 0.02, n)])
    pixels = {s: (xy[i] + rng.normal(0, 0.5, (6, 2)), look(6)) for i, s in enumerate(names) if s != "s09"}
    area, area_look = xy[0] + rng.normal(0, 1, (8, 2)), look(8)
    epochs = range(3)
    motion = {(s, e): (*rng.normal(0, 10, 3), *rng.uniform(0.5, 2, 2)) for s in names for e in epochs}
    del motion["s04", 1]
    seen = {(s, k, e): float(rng.normal(0, 5)) for s in pixels for k in range(6) for e in epochs if rng.random() > 0.1}
    columns = "look_e double, look_n double, look_u double"
    f = lambda v: [float(x) for x in v]
    rows, excluded = validate.station_validation(
        spark.createDataFrame([(s, f"{s}-{k}", *f(p[k]), *f(v[k])) for s, (p, v) in pixels.items() for k in range(6)], f"station string, id string, x double, y double, {columns}"),
        spark.createDataFrame([(f"r{k}", *f(area[k]), *f(area_look[k])) for k in range(8)], f"id string, x double, y double, {columns}"),
        spark.createDataFrame([(f"{s}-{k}", e, v) for (s, k, e), v in seen.items()], "id string, epoch int, value double"),
        spark.createDataFrame([(s, *f(xy[i]), float(sigma[i])) for i, s in enumerate(names)], "id string, x double, y double, sigma double"),
        spark.createDataFrame([(s, e, *f(v)) for (s, e), v in motion.items()], "id string, epoch int, east double, north double, up double, sigma_e double, sigma_n double"),
        reference_station="s00", radii=[100.0], family="ok_matern32", length=20.0, sill=40.0, nugget=1.0, look_sigma=3.0, least_pixels=4, least_reference=5, least_epochs=2,
        min_stations=6, min_sectors=1, require_hull=False,
    )
    got = {(r.id, r.epoch): r for r in rows.collect()}
    want = {}
    for i, s in enumerate(names):
        if s in ("s00", "s09", "s10"):
            continue
        use = [k for k in range(10) if k != i]
        weights = lambda p, use=use: dense.kriging_weights("ok_matern32", xy[use], sigma[use], p, length=20, sill=40, nugget=1.0)
        for e in epochs:
            if any((names[k], e) not in motion for k in use) or (s, e) not in motion:
                continue
            up = np.array([motion[names[k], e][2] for k in use])
            at = [weights(p) for p in area]
            level = np.median([area_look[k, 2] * (w @ up) for k, (w, _) in enumerate(at)])
            level_sigma = np.median([abs(area_look[k, 2]) * math.sqrt(v) for k, (_, v) in enumerate(at)])
            p, v = pixels[s]
            ks = [k for k in range(6) if (s, k, e) in seen]
            if len(ks) < 4:
                continue
            solved = [weights(p[k]) for k in ks]
            moved = np.array([v[k, 2] * (w @ up) - level for k, (w, _) in zip(ks, solved, strict=True)])
            o = np.array([seen[s, k, e] for k in ks])
            le, ln = np.median(v[ks, 0]), np.median(v[ks, 1])
            m, r = motion[s, e], motion["s00", e]
            re, rn = np.median(area_look[:, 0]), np.median(area_look[:, 1])
            station = le * m[0] + ln * m[1] - re * r[0] - rn * r[1]
            hs = math.sqrt(9 + np.median([abs(v[k, 2]) * math.sqrt(var) for k, (_, var) in zip(ks, solved, strict=True)]) ** 2 + level_sigma**2)
            ss = math.sqrt((le * m[3]) ** 2 + (ln * m[4]) ** 2 + (re * r[3]) ** 2 + (rn * r[4]) ** 2)
            want[s, e] = (len(ks), np.median(o - moved), hs, station, ss, np.median([w @ up for w, _ in solved]))
    few = {s for s, _ in want if sum(k[0] == s for k in want) < 2}
    want = {k: v for k, v in want.items() if k[0] not in few}
    assert got.keys() == want.keys() and len(want) > 12
    for k, (n, h, hs, station, ss, up) in want.items():
        r = got[k]
        assert (r.n_pixels, r.n_reference, r.n_support) == (n, 8, 9)
        assert (r.horizontal, r.horizontal_sigma, r.station, r.station_sigma, r.up_predicted) == pytest.approx((h, hs, station, ss, up), abs=1e-9)
        assert r.residual == pytest.approx(h - station) and r.standardized == pytest.approx((h - station) / math.hypot(hs, ss))
    why = {r.id: r.reason for r in excluded.collect()}
    assert why["s00"] == "reference station" and why["s09"] == "too few pixels" and why["s10"] == "no support without it" and all(why[s] == "too few epochs" for s in few)


def test_stations_far_from_the_reference_area_share_its_level(spark, monkeypatch):
    """Two clusters of stations: reference pixels are solved anew only for stations within reach, and the rows are those of plain loops."""
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.uniform(0, 24, (14, 2)), rng.uniform(0, 24, (22, 2)) + (500, 300)])
    sigma, radius, n = rng.uniform(0.5, 2, 36), 12.0, 36
    area = xy[0] + rng.uniform(-6, 6, (7, 2))
    pixels = {i: xy[i] + rng.normal(0, 0.5, (4, 2)) for i in range(1, n)}
    up, seen = rng.normal(1000, 10, (n, 2)), rng.normal(0, 5, (n, 4, 2))
    up[20, 1] = np.nan  # missing below
    f = lambda v: [float(x) for x in v]
    look = ["0.6D AS look_e", "-0.1D AS look_n", "0.8D AS look_u"]
    held, whole = [], validate.adaptive_support

    def counted(targets, *rest, **options):
        held.append(targets.count())
        return whole(targets, *rest, **options)

    monkeypatch.setattr(validate, "adaptive_support", counted)
    monkeypatch.setattr(validate, "TARGETS", 11)  # cells are dealt out in shares
    rows, excluded = validate.station_validation(
        spark.createDataFrame([(i, 10 * i + k, *f(p[k])) for i, p in pixels.items() for k in range(4)], "station long, id long, x double, y double").selectExpr("*", *look),
        spark.createDataFrame([(k, *f(p)) for k, p in enumerate(area)], "id long, x double, y double").selectExpr("*", *look),
        spark.createDataFrame([(10 * i + k, e, float(seen[i, k, e])) for i in pixels for k in range(4) for e in range(2)], "id long, epoch int, value double"),
        spark.createDataFrame([(i, *f(xy[i]), float(sigma[i])) for i in range(n)], "id long, x double, y double, sigma double"),
        spark.createDataFrame([(i, e, 0.0, 0.0, None if np.isnan(up[i, e]) else float(up[i, e]), 1.0, 1.0) for i in range(n) for e in range(2)], "id long, epoch int, east double, north double, up double, sigma_e double, sigma_n double"),
        reference_station=0, radii=[radius], family="ok_matern32", length=20.0, sill=40.0, nugget=1.0, look_sigma=3.0, least_pixels=2, least_reference=3, min_stations=4, min_sectors=1, require_hull=False,
    )
    got = {(r.id, r.epoch): r for r in rows.collect()}
    why = {r.id: r.reason for r in excluded.collect()}
    close = sum(np.hypot(*(p - xy[i])) <= radius for p in area for i in range(1, n))
    assert held == [4 * (n - 1) + len(area) + close] and 0 < close < 13 * len(area)

    def field(p, left, e):
        use = [k for k in range(n) if k != left and np.hypot(*(xy[k] - p)) <= radius]
        if len(use) < 4:
            return None
        w, v = dense.kriging_weights("ok_matern32", xy[use], sigma[use], p, length=20, sill=40, nugget=1.0)
        return w @ up[use, e], v, len(use)

    want, there = {}, {}
    for i in range(1, n):
        there[i] = sum(field(p, i, 0) is not None for p in area)
        for e in range(2):
            at = [a for p in area if (a := field(p, i, e)) is not None and not np.isnan(a[0])]
            here = [(k, a) for k, p in enumerate(pixels[i]) if (a := field(p, i, e)) is not None and not np.isnan(a[0])]
            if len(at) >= 3 and len(here) >= 2:
                level, error = np.median([0.8 * a[0] for a in at]), np.median([0.8 * math.sqrt(a[1]) for a in at])
                rest = [seen[i, k, e] - 0.8 * a[0] + level for k, a in here]
                want[i, e] = (len(here), len(at), min(a[2] for _, a in here), np.median(rest), np.median([0.8 * a[0] - level for _, a in here]), math.sqrt(9 + np.median([0.8 * math.sqrt(a[1]) for _, a in here]) ** 2 + error**2))
    want = {k: v for k, v in want.items() if k[0] not in why}
    assert got.keys() == want.keys() and {i < 14 for i, _ in want} == {True, False} and {v[1] for v in want.values()} != {len(area)}
    for k, v in want.items():
        r = got[k]
        assert (r.n_pixels, r.n_reference, r.n_support, r.horizontal, r.vertical, r.horizontal_sigma) == pytest.approx(v, abs=1e-8)
    assert {i for i, x in why.items() if x == "no reference support without it"} <= {i for i in there if there[i] < 3}


def test_robust_planes_rest_where_reweighting_does():
    rng, same = np.random.default_rng(3), 0
    for median in (True, False):
        for _ in range(25):
            n = int(rng.integers(8, 60))
            offset, sigma = rng.uniform(-9, 9, (n, 2)), rng.uniform(0.2, 3, n)
            y = 4 + offset @ rng.normal(0, 1, 2) + rng.standard_t(2, n) * 2
            got = dense.robust_affine(offset, y, sigma, 5.0, sigma_floor=0.25, scale_floor=0.25, use_median_sigma=median)
            s = np.maximum(sigma, 0.25)
            base = np.exp(-0.5 * ((offset / 5) ** 2).sum(1)) / s**2
            X = np.column_stack([np.ones(n), offset / 5])
            r = y - X @ got["beta"]
            bound = 1.345 * max(dense.mad_sigma(r), 0.25, float(np.median(s)) if median else 0)
            assert np.abs(X.T @ (base * np.clip(r, -bound, bound))).max() < 1e-10 * np.abs(X.T @ (base * np.abs(y))).max()  # at rest
            w, rested = base, False
            for _ in range(500):
                b = np.linalg.solve((X.T * w) @ X, (X.T * w) @ y)
                r = y - X @ b
                scale = max(dense.mad_sigma(r), 0.25, float(np.median(s)) if median else 0)
                new = base * np.minimum(1, 1.345 * scale / np.maximum(np.abs(r), 1e-300))
                rested = np.abs(new - w).max() <= 1e-13 * base.max()
                if rested:
                    break
                w = new
            if not rested:  # with the scale of its own residuals plain reweighting may go to and fro
                continue
            same += 1
            assert np.allclose(X @ got["beta"], X @ b, atol=1e-6)
            cov = np.linalg.inv((X.T * w) @ X) * max(1.0, float(w @ (r * r)) / (n - 3))
            assert np.allclose(got["cov"], cov, rtol=1e-4) and got["n_eff"] == pytest.approx(w.sum() ** 2 / (w @ w), rel=1e-4)
    assert same > 40


def test_vector_planes_and_strain_keep_failures(spark):
    rng = np.random.default_rng(4)
    pts = [(i, *map(float, rng.uniform(0, 20, 2))) for i in range(60)]
    rows = [(i, x, y, 2 * x + 3 * y + float(rng.normal(0, 0.5)), 4 * y - x + float(rng.normal(0, 0.5)), 0.5, 0.7) for i, x, y in pts]
    st = spark.createDataFrame(rows, "id long, x double, y double, east double, north double, sigma_e double, sigma_n double")
    targets = spark.createDataFrame([(1, 10.0, 10.0), (2, 31.0, 10.0), (3, 900.0, 0.0)], "id long, x double, y double")
    out = {r.t_id: r for r in strain.strain_grid(st, targets, bandwidth=4.0).collect()}
    assert out[3].n == 0 and not out[3].valid and out[3].east is None and out[3].exx is None and not out[2].valid
    near = [r for r in rows if math.hypot(r[1] - 10, r[2] - 10) <= 12]
    offset = np.array([(r[1] - 10, r[2] - 10) for r in near])
    fits = [dense.robust_affine(offset, np.array([r[k] for r in near]), np.full(len(near), s), 4.0, sigma_floor=0.25, scale_floor=0.25) for k, s in ((3, 0.5), (4, 0.7))]
    r = out[1]
    assert r.valid and r.n == len(near) and r.n_kernel == pytest.approx(fits[0]["n_kernel"])
    assert (r.east, r.east_x, r.east_y, r.north_x) == pytest.approx((fits[0]["beta"][0], fits[0]["beta"][1] / 4, fits[0]["beta"][2] / 4, fits[1]["beta"][1] / 4))
    s = [np.sqrt(np.diag(f["cov"])) / 4 for f in fits]
    assert (r.sigma_east_x, r.sigma_exy, r.sigma_dilatation) == pytest.approx((s[0][1], 500 * math.hypot(s[0][2], s[1][1]), 1000 * math.hypot(s[0][1], s[1][2])))
    assert r.exx == pytest.approx(1000 * r.east_x) and r.dilatation == pytest.approx(1000 * (r.east_x + r.north_y)) and abs(r.exx - 2000) < 300


def cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def meets(p, q, a, b):
    on = lambda o, u, v: cross(o, u, v) == 0 and min(o[0], u[0]) <= v[0] <= max(o[0], u[0]) and min(o[1], u[1]) <= v[1] <= max(o[1], u[1])
    d = [cross(a, b, p), cross(a, b, q), cross(p, q, a), cross(p, q, b)]
    return (d[0] > 0) != (d[1] > 0) and (d[2] > 0) != (d[3] > 0) and 0 not in d or on(a, b, p) or on(a, b, q) or on(p, q, a) or on(p, q, b)


def test_links_and_segments_meet_in_the_cells_they_touch(spark):
    rng = random.Random(5)
    whole = lambda: (float(rng.randrange(-12, 13)), float(rng.randrange(-12, 13)))
    free = lambda: (rng.uniform(-40, 40), rng.uniform(-40, 40))
    links = [(i, *p(), *p()) for i, p in enumerate([whole, free] * 60)]
    segments = [(*p(), *p()) for p in [whole, free] * 15] + [(-30.0, -30.0, 30.0, 30.0), (4.0, -30.0, 4.0, 30.0), (-30.0, 8.0, 30.0, 8.0)]
    ldf = spark.createDataFrame(links, "id int, x0 double, y0 double, x1 double, y1 double")
    sdf = spark.createDataFrame(segments, "x1 double, y1 double, x2 double, y2 double")
    want = {i for i, *l in links if any(meets(tuple(l[:2]), tuple(l[2:]), s[:2], s[2:]) for s in segments)}
    for cell in (1.0, 4.0, 50.0):
        assert {r.id for r in spatial.blocked_links(ldf, sdf, ["id"], cell=cell).collect()} == want
    diagonal = spark.createDataFrame([(0.5, 0.25, 1000.5, 990.25)], "x1 double, y1 double, x2 double, y2 double")
    assert spatial._cells_of_segment(diagonal, ("x1", "y1"), ("x2", "y2"), 1.0).count() < 2100  # not 1000 * 1000


def test_triangles_know_their_distance_to_segments(spark):
    rng = random.Random(6)
    point = lambda: (rng.uniform(-15, 15), rng.uniform(-15, 15))
    triangles = [(i, *point(), *point(), *point()) for i in range(25)] + [(99, 100.0, 100.0, 101.0, 100.0, 100.0, 101.0)]
    segments = [(*point(), *point()) for _ in range(4)]

    def apart(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    def distance(t, s):
        v, (a, b) = [t[:2], t[2:4], t[4:]], (s[:2], s[2:])
        turn = [cross(v[i], v[(i + 1) % 3], a) for i in range(3)]
        if all(x >= 0 for x in turn) or all(x <= 0 for x in turn) or any(meets(v[i], v[(i + 1) % 3], a, b) for i in range(3)):
            return 0.0
        return min([apart(p, a, b) for p in v] + [apart(p, v[i], v[(i + 1) % 3]) for p in (a, b) for i in range(3)])

    tdf = spark.createDataFrame(triangles, "id int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    sdf = spark.createDataFrame(segments, "x1 double, y1 double, x2 double, y2 double")
    for within in (0.5, 3.0, 40.0):
        got = {r.t_id: r.distance for r in spatial.triangle_to_segments_distance(tdf, sdf, within).collect()}
        want = {i: min(distance(t, s) for s in segments) for i, *t in triangles}
        assert got == pytest.approx({i: d for i, d in want.items() if d <= within}, abs=1e-9)


def test_long_event_lists_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, a, a + rng.choice([0, 1, 2, 9])) for i, a in enumerate(rng.randrange(60) for _ in range(150))] + [(900, None, 5), (901, 5, None)]
    df = spark.createDataFrame(rows, "i int, before_at int, after_at int")
    events = spark.createDataFrame([(t,) for t in (3, 10, 10, 31, 32, 59, None)], "t int")
    short = sorted(r.i for r in joins.without_event_between(df, events, "t").collect())
    monkeypatch.setattr(joins, "LITERAL_EVENTS", 2)
    assert sorted(r.i for r in joins.without_event_between(df, events, "t").collect()) == short
    assert short == sorted(i for i, a, b in rows if a is None or b is None or not any(a < t < b for t in (3, 10, 31, 32, 59)))


def test_selection_rules_equal_loops(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 30, (12, 2))
    xy[11] = (38.0, 38.0)
    v = 5 * np.sin(xy[:, 0] / 12) + rng.normal(0, 0.3, 12)
    st = spark.createDataFrame([(i, *map(float, xy[i]), float(v[i]), 0.4) for i in range(12)], "id int, x double, y double, value double, sigma double").withColumn("k", F.lit(1))
    p = interpolate.leave_one_out_predictions(
        st, keys=["k"], families=["local_constant", "ok_matern32", "gp_matern32"], lengths=[10.0, 30.0], nuggets=[0.0, 2.0], radii=[14.0, 60.0], least=4, sill="all", missing=True
    ).cache()
    rows = p.collect()
    assert len(rows) == 3 * 2 * 2 * 2 * 12
    sill = max(np.var(v, ddof=1), 1.0)
    for r in rows:
        keep = (np.arange(12) != r.id) & (np.linalg.norm(xy - xy[r.id], axis=1) <= r.radius)
        assert r.n == keep.sum() and (keep.sum() < 4) == (r.predicted is None)
        if keep.sum() >= 4:
            m, e = dense.kriging_predict(r.family, xy[keep], v[keep], np.full(keep.sum(), 0.4), xy[r.id], length=r.length, sill=sill, nugget=r.nugget)
            assert (r.predicted, r.sigma) == pytest.approx((m, math.hypot(e, 0.4)))
    by = {}
    for r in rows:
        by.setdefault((r.family, r.length, r.nugget, r.radius), []).append(r)
    loss = lambda r: 0.5 * (math.log(2 * math.pi * r.sigma**2) + ((r.observed - r.predicted) / r.sigma) ** 2)
    full = {c: (np.mean([loss(r) for r in g]), math.sqrt(np.mean([(r.observed - r.predicted) ** 2 for r in g]))) for c, g in by.items() if not any(r.predicted is None for r in g)}
    out = interpolate.select_of_full_coverage(p).collect()
    assert {(r.family, r.length, r.nugget, r.radius) for r in out if r.eligible} == full.keys() and 0 < len(full) < len(by)
    best = [r for r in out if r.selected]
    assert len(best) == 1 and best[0].nlpd == pytest.approx(min(x for x, _ in full.values())) and best[0].coverage == 1.0
    wide = p.where("radius = 60.0")
    chosen = interpolate.select_by_one_standard_error(wide).collect()
    base = {r.id: loss(r) for r in by["local_constant", 10.0, 0.0, 60.0]}
    base_rmse = full["local_constant", 10.0, 0.0, 60.0][1]
    for r in chosen:
        c = (r.family, r.length, r.nugget, r.radius)
        drop = [base[x.id] - loss(x) for x in by[c]]
        assert r.gain == pytest.approx(np.mean(drop)) and r.rmse_gain == pytest.approx(base_rmse - full[c][1])
        assert r.supported == (r.family == "local_constant" or (np.mean(drop) > np.std(drop, ddof=1) / math.sqrt(12) and base_rmse > full[c][1]))
    win = [r for r in chosen if r.selected]
    assert len(win) == 1 and win[0].nlpd == pytest.approx(min(r.nlpd for r in chosen if r.supported))


def test_reference_boxes_equal_loops(spark):
    rng = np.random.default_rng(9)
    n = 40
    names = list(reference.SCORE_WEIGHTS)
    layers = {"rms": rng.uniform(1, 9, (n, n)), "coherence": rng.uniform(0.4, 0.9, (n, n)), "residual": rng.uniform(0, 3, (n, n)), "gaps": rng.uniform(0, 0.15, (n, n)), "loops": rng.uniform(0, 6, (n, n))}
    layers["rms"][5, 5] = np.nan
    rows = [(r, c, c * 1.0, r * 1.0, *[None if np.isnan(layers[k][r, c]) else float(layers[k][r, c]) for k in names]) for r in range(n) for c in range(n)]
    df = spark.createDataFrame(rows, "row int, col int, x double, y double, " + ", ".join(f"{k} double" for k in names))
    far = F.hypot(F.col("x") - 20, F.col("y") - 20) >= 9
    chosen, boxes = reference.choose_reference(df, far, size=5, margin=4, count=4, distance=8.0, limits={"coverage": 0.9, "coherence": 0.6, "residual": 1.6, "gaps": 0.08, "loops": 3.2})
    r, c = np.indices((n, n))
    ok = (np.hypot(c - 20, r - 20) >= 9) & ~np.isnan(layers["rms"])
    score = np.zeros((n, n))
    for k, w in reference.SCORE_WEIGHTS.items():
        low, high = np.quantile(layers[k][ok], [0.05, 0.95])
        unit = np.clip((layers[k] - low) / (high - low), 0, 1)
        score += w * (1 - unit if k == "coherence" else unit)
    score[~ok] = np.nan

    def box(a):
        out, cover = np.full((n, n), np.nan), np.zeros((n, n))
        for i in range(n):
            for j in range(n):
                part = a[max(i - 2, 0) : i + 3, max(j - 2, 0) : j + 3]
                cover[i, j] = np.isfinite(part).sum() / 25
                out[i, j] = np.nanmean(part) if np.isfinite(part).any() else np.nan
        return out, cover

    (mean, cover), parts = box(score), {k: box(layers[k])[0] for k in names}
    good = (np.hypot(c - 20, r - 20) >= 9) & (r >= 4) & (r <= n - 5) & (c >= 4) & (c <= n - 5) & (cover >= 0.9) & (parts["coherence"] >= 0.6) & (parts["residual"] <= 1.6) & (parts["gaps"] <= 0.08) & (parts["loops"] <= 3.2)
    want = []
    for i, j in sorted(zip(*np.nonzero(good), strict=True), key=lambda p: (mean[p], p)):
        if len(want) < 4 and all(math.hypot(i - a, j - b) >= 8.0 for a, b in want):
            want.append((int(i), int(j)))
    got = sorted(chosen.collect(), key=lambda x: x.rank)
    assert [(x.row, x.col) for x in got] == want and len(want) >= 2 and [x["rank"] for x in got] == list(range(1, len(want) + 1))
    assert (got[0].box_score, got[0].box_rms) == pytest.approx((mean[want[0]], parts["rms"][want[0]])) and (got[0].r1, got[0].r2) == (want[0][0] - 2, want[0][0] + 3)
    assert boxes.where("eligible").count() == good.sum()
    worse = reference.worst_layers(df, df.withColumns({"rms": F.lit(5.0), "coherence": F.lit(0.7)})).where("row = 1 AND col = 2").first()
    assert worse.rms == max(5.0, layers["rms"][1, 2]) and worse.coherence == min(0.7, layers["coherence"][1, 2])
