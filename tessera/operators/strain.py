"""Strain estimators: fixed joint operators, robust local planes and triangles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dense
from tessera.functions.geo import strain_invariants, triangle_metrics
from tessera.operators.spatial import point_to_segments_distance, radius_join, triangle_sample_points, visible_links
from tessera.runtime import bucket, cut_lineage


def joint_mls(
    samples: DataFrame, targets: DataFrame, *, radius: float = 8.0, bandwidth: float = 4.0, least: int = 16, max_condition: float = 1e8, segments: DataFrame | None = None, tasks_of: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Operator relation (t_id, s_id, row, we, wn, n) and diagnostics of joint affine fits.

    samples: id, x, y, p11, p12, p22 (precision of east and north).  Rows 0-5 are
    east, its x and y derivative, north, its derivatives; derivatives are per unit
    of x and y.  The operator depends on geometry only and serves all epochs.
    """
    j = radius_join(targets.select("id", "x", "y"), samples, radius)
    if segments is not None:
        links = j.withColumns({"x0": F.col("t_x"), "y0": F.col("t_y"), "x1": F.col("s_x"), "y1": F.col("s_y")})
        j = visible_links(links, segments, ["t_id", "s_id"], rule="open_ends").drop("x0", "y0", "x1", "y1")
    kinds = dict(j.dtypes)
    unit = np.array([1.0, bandwidth, bandwidth, 1.0, bandwidth, bandwidth])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, one in g.groupby("t_id", sort=True):
            n, found = len(one), None
            if n >= least:
                p = one[["s_p11", "s_p12", "s_p12", "s_p22"]].to_numpy(float).reshape(n, 2, 2)
                offset = one[["s_x", "s_y"]].to_numpy(float) - one[["t_x", "t_y"]].iloc[0].to_numpy(float)
                found = dense.joint_mls_operator(offset, p, bandwidth, max_condition)
            row = {"t_id": t, "n": n, "valid": found is not None, "cov": None, "operator": None, "s_ids": None}
            if found:
                row |= {
                    "operator": (found["operator"] / unit[:, None]).ravel().tolist(), "cov": (found["covariance"] / np.outer(unit, unit)).ravel().tolist(),
                    "n_eff": found["n_eff"], "condition": found["condition"], "s_ids": one["s_id"].tolist(),
                }
            out.append(row)
        names = ["t_id", "n", "valid", "n_eff", "condition", "cov", "operator", "s_ids"]
        return pd.DataFrame(out).reindex(columns=names).astype({"n_eff": float, "condition": float})

    schema = f"t_id {kinds['t_id']}, n int, valid boolean, n_eff double, condition double, cov array<double>, operator array<double>, s_ids array<{kinds['s_id']}>"
    solved = cut_lineage(j.groupBy(bucket(j, "t_id", tasks_of=tasks_of).alias("__g")).applyInPandas(solve, schema))
    flat = solved.where("valid").select("t_id", "n", "operator", F.posexplode("s_ids").alias("k", "s_id"), F.lit(1).alias("__one"))
    flat = flat.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(5))))
    at = (F.col("row") * 2 * F.col("n") + 2 * F.col("k")).cast("int")
    operator = flat.select("t_id", "s_id", "row", F.get("operator", at).alias("we"), F.get("operator", at + 1).alias("wn"), "n")
    c = lambda i, k: F.col("cov")[6 * i + k]
    # Contrasts of correlated derivatives; rows 1, 2 are d east, rows 4, 5 d north.
    sigma = {
        "sigma_exx": c(1, 1), "sigma_eyy": c(5, 5), "sigma_gamma": c(2, 2) + c(4, 4) + 2 * c(2, 4),
        "sigma_dilatation": c(1, 1) + c(5, 5) + 2 * c(1, 5), "sigma_rotation": (c(2, 2) + c(4, 4) - 2 * c(2, 4)) / 4,
        "sigma_exy": (c(2, 2) + c(4, 4) + 2 * c(2, 4)) / 4,
    }
    diagnostics = solved.select("t_id", "n", "valid", "n_eff", "condition", *[F.sqrt(F.greatest(v, F.lit(0.0))).alias(k) for k, v in sigma.items()])
    return operator, diagnostics


def evaluate_joint_mls(operator: DataFrame, observations: DataFrame) -> DataFrame:
    """Strain per (t_id, epoch) by a join and sums; NULL where any neighbour is missing.

    observations: id, epoch, east, north.
    """
    obs = observations.select(F.col("id").alias("s_id"), "epoch", "east", "north")
    j = operator.join(obs, "s_id")
    term = F.col("we") * F.col("east") + F.col("wn") * F.col("north")
    g = j.groupBy("t_id", "epoch").agg(
        *[F.sum(F.when(F.col("row") == i, term)).alias(f"__b{i}") for i in range(6)], F.count(F.when(F.col("row") == 0, term)).alias("__n"), F.max("n").alias("n")
    )
    b = [F.when(F.col("__n") == F.col("n"), F.col(f"__b{i}")) for i in range(6)]
    parts = strain_invariants(b[1], b[2], b[4], b[5])
    return g.select("t_id", "epoch", b[0].alias("east"), b[3].alias("north"), *[v.alias(k) for k, v in parts.items()])


def robust_plane_strain(
    samples: DataFrame,
    targets: DataFrame,
    *,
    keys: Sequence[str] = (),
    radius: float = 8.0,
    bandwidth: float = 4.0,
    least: int = 16,
    max_condition: float = 100.0,
    sigma_floor: float = 1.0,
    scale_floor: float = 1.0,
    use_median_sigma: bool = True,
    scale: float = 1000.0,
    wrap: bool = True,
    tasks_of: int | None = None,
) -> DataFrame:
    """Strain (in 1/1000 of value units per km times ``scale``) from separate robust fits.

    samples: keys, id, x, y, east, north, sigma_e, sigma_n.  Targets without enough
    samples or with an ill-conditioned fit are kept with ``valid`` false.
    """
    j = radius_join(targets.select(*keys, "id", "x", "y"), samples, radius, keys=keys)
    kinds = dict(j.dtypes)
    names = ["n", "n_eff", "condition", "e", "ex", "ey", "nn", "nx", "ny", "sex", "sey", "snx", "sny"]

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        by = [f"t_{k}" for k in keys] + ["t_id"]
        for t, one in g.groupby(by, sort=True):
            row = dict(zip(by, t, strict=True)) | {"n": len(one)}
            if len(one) >= least:
                offset = one[["s_x", "s_y"]].to_numpy(float) - one[["t_x", "t_y"]].iloc[0].to_numpy(float)
                fit = [
                    dense.robust_affine(
                        offset, one[f"s_{v}"].to_numpy(float), one[f"s_{s}"].to_numpy(float), bandwidth, sigma_floor=sigma_floor, scale_floor=scale_floor, use_median_sigma=use_median_sigma
                    )
                    for v, s in (("east", "sigma_e"), ("north", "sigma_n"))
                ]
                s = [np.sqrt(np.maximum(np.diag(f["cov"]), 0)) / bandwidth for f in fit]
                b = [f["beta"] / np.array([1, bandwidth, bandwidth]) for f in fit]
                row |= dict(zip(names[1:], [min(f["n_eff"] for f in fit), max(f["condition"] for f in fit), *b[0], *b[1], s[0][1], s[0][2], s[1][1], s[1][2]], strict=True))
            out.append(row)
        return pd.DataFrame(out).reindex(columns=[*by, *names]).astype({c: float for c in names[1:]})

    schema = ", ".join([*[f"`t_{k}` {kinds[f't_{k}']}" for k in keys], f"t_id {kinds['t_id']}", "n int", *[f"{c} double" for c in names[1:]]])
    fits = j.groupBy(bucket(j, "t_id", tasks_of=tasks_of).alias("__g")).applyInPandas(solve, schema)
    fine = lambda c: F.when(~F.isnan(c), F.col(c))
    fits = fits.withColumns({c: fine(c) for c in names[1:]})
    ok = F.coalesce(F.col("condition") <= max_condition, F.lit(False))
    v = {c: F.when(ok, F.col(c)) for c in ("ex", "ey", "nx", "ny")}
    parts = strain_invariants(v["ex"], v["ey"], v["nx"], v["ny"], scale=scale, wrap=wrap)
    half = 0.5 * scale * F.hypot("sey", "snx")
    errors = {"sigma_exx": scale * F.col("sex"), "sigma_eyy": scale * F.col("sny"), "sigma_exy": half, "sigma_gamma": 2 * half, "sigma_rotation": half, "sigma_dilatation": scale * F.hypot("sex", "sny")}
    return fits.select(
        *[F.col(f"t_{k}").alias(k) for k in keys], "t_id", "n", "n_eff", "condition", ok.alias("valid"), *[c.alias(k) for k, c in parts.items()], *[F.when(ok, c).alias(k) for k, c in errors.items()]
    )


def vector_affine(
    stations: DataFrame, targets: DataFrame, *, bandwidth: float, keys: Sequence[str] = (), least: int = 6, sigma_floor: float = 0.25, scale_floor: float = 0.25, use_median_sigma: bool = True, tasks_of: int | None = None
) -> DataFrame:
    """Robust local planes of east and north at every target: predictions, gradients and the errors of both.

    Stations within three bandwidths count.  Columns: keys, t_id, n, n_kernel (the
    effective number by the kernel), condition (the worse of both planes), east,
    north and their gradients, each with ``sigma_``.  Targets with fewer than
    ``least`` stations are kept, with n and nothing else.
    """
    keys = list(keys)
    j = radius_join(targets.select(*keys, "id", "x", "y"), stations.select(*keys, "id", "x", "y", "east", "north", "sigma_e", "sigma_n"), 3.0 * bandwidth, keys=keys)
    kinds = dict(j.dtypes)
    parts = ["east", "east_x", "east_y", "north", "north_x", "north_y"]
    names = ["n_kernel", "condition", *parts, *[f"sigma_{p}" for p in parts]]
    by = [f"t_{k}" for k in keys] + ["t_id"]

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, one in g.groupby(by, sort=True, dropna=False):
            row = dict(zip(by, t, strict=True)) | {"n": len(one)}
            if len(one) >= least:
                one = one.sort_values("s_id")
                offset = one[["s_x", "s_y"]].to_numpy(float) - one[["t_x", "t_y"]].iloc[0].to_numpy(float)
                fits = [
                    dense.robust_affine(offset, one[f"s_{v}"].to_numpy(float), one[f"s_{e}"].to_numpy(float), bandwidth, sigma_floor=sigma_floor, scale_floor=scale_floor, use_median_sigma=use_median_sigma)
                    for v, e in (("east", "sigma_e"), ("north", "sigma_n"))
                ]
                per = np.array([1, bandwidth, bandwidth])
                value = [x for f in fits for x in f["beta"] / per]
                error = [x for f in fits for x in np.sqrt(np.maximum(np.diag(f["cov"]), 0)) / per]
                row |= dict(zip(names, [min(f["n_kernel"] for f in fits), max(f["condition"] for f in fits), *value, *error], strict=True))
            out.append(row)
        return pd.DataFrame(out).reindex(columns=[*by, "n", *names]).astype({c: float for c in names})

    schema = ", ".join([*[f"`t_{k}` {kinds[f't_{k}']}" for k in keys], f"t_id {kinds['t_id']}", "n int", *[f"{c} double" for c in names]])
    fits = j.groupBy(bucket(j, "t_id", tasks_of=tasks_of).alias("__g")).applyInPandas(solve, schema)
    fits = fits.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names}).withColumnsRenamed({f"t_{k}": f"__k_{k}" for k in keys} | {"t_id": "__t"})
    same = F.col("t_id").eqNullSafe(F.col("__t"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    every = targets.select(*keys, F.col("id").alias("t_id")).distinct().join(fits, same, "left")
    return every.select(*keys, "t_id", F.coalesce("n", F.lit(0)).alias("n"), *names)


def strain_grid(
    stations: DataFrame, targets: DataFrame, *, bandwidth: float, least_effective: float = 5.0, max_condition: float = 100.0, scale: float = 1000.0, **options
) -> DataFrame:
    """``vector_affine`` with strain and its errors; ``valid`` asks for enough effective stations and a fair condition.

    Strain is in 1/``scale`` of value units per km and kept where a fit exists, valid
    or not.
    """
    fits = vector_affine(stations, targets, bandwidth=bandwidth, **options)
    parts = strain_invariants(F.col("east_x"), F.col("east_y"), F.col("north_x"), F.col("north_y"), scale=scale, wrap=False)
    half = 0.5 * scale * F.hypot("sigma_east_y", "sigma_north_x")
    xx, yy = scale * F.col("sigma_east_x"), scale * F.col("sigma_north_y")
    errors = {"sigma_exx": xx, "sigma_eyy": yy, "sigma_exy": half, "sigma_dilatation": F.hypot(xx, yy), "sigma_rotation": half}
    ok = F.coalesce((F.col("n_kernel") >= least_effective) & (F.col("condition") <= max_condition), F.lit(False))
    return fits.select("*", ok.alias("valid"), *[v.alias(k) for k, v in parts.items()], *[v.alias(k) for k, v in errors.items()])


def leave_one_out_bandwidths(stations: DataFrame, bandwidths: Sequence[float], *, least: int = 6) -> DataFrame:
    """(bandwidth, n, rmse, se) of vector predictions at held-out stations.

    A station is predicted from all others whose kernel weight is at least
    exp(-4.5), i.e. within three bandwidths; stations are dealt out in buckets.
    """
    fields = ["east", "north", "sigma_e", "sigma_n"]

    def misses(h: float):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for _, one in g.groupby("t_id"):
                if len(one) < least:
                    continue
                one = one.sort_values("s_id")
                offset = one[["s_x", "s_y"]].to_numpy(float) - one[["t_x", "t_y"]].to_numpy(float)
                miss = [
                    one[f"t_{v}"].iloc[0] - dense.robust_affine(offset, one[f"s_{v}"].to_numpy(float), one[f"s_{s}"].to_numpy(float), h, sigma_floor=0.25, scale_floor=0.25, use_median_sigma=False)["beta"][0]
                    for v, s in (("east", "sigma_e"), ("north", "sigma_n"))
                ]
                rows.append((h, float(np.hypot(*miss))))
            return pd.DataFrame(rows, columns=["bandwidth", "miss"])

        return run

    each = None
    for h in map(float, bandwidths):
        pairs = radius_join(stations.select("id", "x", "y", "east", "north"), stations.select("id", "x", "y", *fields), 3.0 * h).where(F.col("t_id") != F.col("s_id"))
        some = pairs.groupBy(bucket(pairs, "t_id").alias("__g")).applyInPandas(misses(h), "bandwidth double, miss double")
        each = some if each is None else each.unionByName(some)
    m2 = F.col("miss") * F.col("miss")
    return each.groupBy("bandwidth").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(m2)).alias("rmse"), (F.stddev_samp(m2) / F.sqrt(F.count(F.lit(1))) / (2 * F.sqrt(F.avg(m2)))).alias("se")
    )


def triangle_strain(
    stations: DataFrame,
    *,
    segments: DataFrame | None = None,
    buffer: float = 5.0,
    spacing: float = 0.25,
    max_edge: float = 60.0,
    min_angle: float = 15.0,
    max_condition: float = 10.0,
    scale: float = 1000.0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Linear strain of Delaunay triangles of station networks; invalid ones stay, with the reason.

    Each network (``keys``; all stations are one without any) is triangulated in
    one task from its positions; everything after it is expressions.  ``triangle``
    counts within a network.
    """
    keys, kinds = list(keys), dict(stations.dtypes)

    def mesh(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        found = dense.delaunay(g[["x", "y"]].to_numpy(float)) if len(g) >= 3 else []
        ids = g["id"].to_numpy()
        out = pd.DataFrame([(i, *[int(ids[v]) for v in t]) for i, t in enumerate(found)], columns=["triangle", "a", "b", "c"])
        for i, k in enumerate(keys):
            out.insert(i, k, g[k].iloc[0])
        return out

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "triangle int, a long, b long, c long"])
    out = cut_lineage(stations.select(*keys, "id", "x", "y").groupBy(*keys).applyInPandas(mesh, schema))
    for i, corner in enumerate("abc", 1):
        s = stations.select(*keys, F.col("id").cast("long").alias(corner), *[F.col(c).alias(f"{c}{i}") for c in ("x", "y", "east", "north", "sigma_e", "sigma_n")])
        out = out.join(s, [*keys, corner])
    pts = tuple((F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3))
    out = out.withColumns(triangle_metrics(pts))
    (ax, ay), (bx, by), (cx, cy) = pts
    det = F.nullif((bx - ax) * (cy - ay) - (by - ay) * (cx - ax), F.lit(0.0))
    gx = [(by - cy) / det, (cy - ay) / det, (ay - by) / det]
    gy = [(cx - bx) / det, (ax - cx) / det, (bx - ax) / det]
    dot = lambda g, name: sum((g[i] * F.col(f"{name}{i + 1}") for i in range(3)), F.lit(0.0))
    var = lambda g, name: sum((F.pow(g[i] * F.col(f"{name}{i + 1}"), 2) for i in range(3)), F.lit(0.0))
    parts = strain_invariants(dot(gx, "east"), dot(gy, "east"), dot(gx, "north"), dot(gy, "north"), scale=scale, wrap=False)
    if segments is not None:
        out = out.withColumn("__t", F.struct(*keys, "triangle"))
        probe = triangle_sample_points(out.select(F.col("__t").alias("triangle"), *[f"{c}{i}" for i in (1, 2, 3) for c in "xy"]), spacing)
        probe = probe.select("triangle", F.col("px").alias("x"), F.col("py").alias("y")).withColumn("id", F.struct("triangle", "x", "y"))
        near = point_to_segments_distance(probe, segments, buffer).select(F.col("p_id.triangle").alias("__t")).distinct().withColumn("__near", F.lit(True))
        out = out.join(near, "__t", "left")
    else:
        out = out.withColumn("__near", F.lit(None).cast("boolean"))
    reason = (
        F.when(F.col("longest_edge") > max_edge, "edge").when(F.col("min_angle") < min_angle, "angle")
        .when(F.coalesce(F.col("condition"), F.lit(float("inf"))) > max_condition, "condition").when(F.col("__near"), "rupture")
    )
    errors = {"sigma_exx": var(gx, "sigma_e"), "sigma_eyy": var(gy, "sigma_n"), "sigma_exy": (var(gy, "sigma_e") + var(gx, "sigma_n")) / 4}
    out = out.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.select(
        *keys, "triangle", "a", "b", "c", "area", "longest_edge", "min_angle", "condition", ok.alias("valid"), "reason",
        *[F.when(ok, v).alias(k) for k, v in parts.items()], *[F.when(ok, scale * F.sqrt(v)).alias(k) for k, v in errors.items()],
    )
