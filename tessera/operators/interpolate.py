"""Spatial interpolation as weight relations.

Kriging weights depend on geometry and noise, not on values.  They are solved
once per target in Arrow groups and kept as a relation (target, sample, output,
w); every epoch is then a join and a sum.  A missing required observation gives
NULL, never a partial sum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dense
from tessera.functions.stats import gaussian_nlpd
from tessera.operators.spatial import radius_join, visible_links
from tessera.runtime import bucket, cut_lineage


#: Observations that go to the tasks of the weights; more are shuffled with them.
BROADCAST_OBSERVATIONS = 200_000


def local_pairs(targets: DataFrame, stations: DataFrame, radius: float, *, least: int = 1) -> DataFrame:
    """(t_id, t_x, t_y, s_id, s_x, s_y, s_sigma, distance) of targets with enough stations."""
    j = radius_join(targets.select("id", "x", "y"), stations.select("id", "x", "y", "sigma"), radius, repeat="samples")
    n = F.count(F.lit(1)).over(Window.partitionBy("t_id"))
    return j.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def support_pairs(targets: DataFrame, stations: DataFrame, support: DataFrame) -> DataFrame:
    """Pairs of an adaptive support table (t_id, station_ids) with positions."""
    s = support.select("t_id", F.explode("station_ids").alias("s_id"))
    t = targets.select(F.col("id").alias("t_id"), F.col("x").alias("t_x"), F.col("y").alias("t_y"))
    st = stations.select(F.col("id").alias("s_id"), F.col("x").alias("s_x"), F.col("y").alias("s_y"), F.col("sigma").alias("s_sigma"))
    return s.join(t, "t_id").join(st, "s_id")


def kriging_weight_relation(pairs: DataFrame, family: str, *, length: float, sill: float, nugget: float, tasks_of: int | None = None) -> DataFrame:
    """(t_id, s_id, w, variance, n) for every target whose model is determined.

    Targets are solved in groups of a hash bucket whose number follows from the
    number of targets, so a group amortises its Arrow transfer and stays small.
    """
    kinds = dict(pairs.dtypes)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        """Targets with equally many stations are solved together."""
        g = g[g["t_id"].notna()].sort_values(["t_id", "s_id"])
        t, xy, sigma, at = g["t_id"].to_numpy(), g[["s_x", "s_y"]].to_numpy(float), g["s_sigma"].to_numpy(float), g[["t_x", "t_y"]].to_numpy(float)
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
        count = np.diff(np.append(first, len(t)))
        w, variance, kept = np.zeros(len(t)), np.zeros(len(t)), np.zeros(len(t), dtype=bool)
        for n in np.unique(count):
            rows = first[count == n][:, None] + np.arange(n)
            found, error, known = dense.stacked_kriging_weights(family, xy[rows], sigma[rows], at[rows[:, 0]], length=length, sill=sill, nugget=nugget)
            w[rows], variance[rows], kept[rows] = found, error[:, None], known[:, None]
        out = pd.DataFrame({"t_id": t, "s_id": g["s_id"].to_numpy(), "w": w, "variance": variance, "n": np.repeat(count, count)})
        return out[kept]

    schema = f"t_id {kinds['t_id']}, s_id {kinds['s_id']}, w double, variance double, n int"
    return pairs.groupBy(bucket(pairs, "t_id", tasks_of=tasks_of).alias("__g")).applyInPandas(solve, schema)


def evaluate_weights(weights: DataFrame, observations: DataFrame, *, epoch: str = "epoch", value: str = "value") -> DataFrame:
    """(t_id, epoch, predicted, sigma, n): sum(w * value), NULL unless all are present."""
    obs = observations.select(F.col("id").alias("s_id"), F.col(epoch), F.col(value).alias("__v"))
    few = obs.limit(BROADCAST_OBSERVATIONS + 1).count() <= BROADCAST_OBSERVATIONS
    j = weights.join(F.broadcast(obs) if few else obs.hint("merge"), "s_id")
    return j.groupBy("t_id", epoch).agg(
        F.when(F.count("__v") == F.max("n"), F.sum(F.col("w") * F.col("__v"))).alias("predicted"), F.sqrt(F.max("variance")).alias("sigma"), F.max("n").alias("n")
    )


def leave_one_out_predictions(
    stations: DataFrame, *, keys: Sequence[str], families: Sequence[str], lengths: Sequence[float], nuggets: Sequence[float], radii: Sequence[float] = (float("inf"),), least: int = 3,
    sill: str = "interval", missing: bool = False,
) -> DataFrame:
    """(keys, family, length, nugget, radius, id, observed, predicted, sigma, n) of every candidate and holdout.

    ``sill`` is that of the stations kept with their noise taken off (``interval``),
    the variance of those kept (``kept``) or of all (``all``), at least 1.  With
    ``missing`` holdouts that a candidate can't predict are rows without a prediction.

    Candidates are a cross join of short lists; each (key, candidate) is one Arrow
    group over that key's stations.
    """
    spark = stations.sparkSession
    grid = [(f, float(le), float(nu), float(r)) for f in families for le in lengths for nu in nuggets for r in radii]
    candidates = spark.createDataFrame(grid, "family string, length double, nugget double, radius double")
    kinds = dict(stations.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        f, le, nu, r = (g[c].iloc[0] for c in ("family", "length", "nugget", "radius"))
        xy, v, s = g[["x", "y"]].to_numpy(float), g["value"].to_numpy(float), g["sigma"].to_numpy(float)
        p, e, n = dense.left_out_predictions(f, xy, v, s, length=le, radius=r, nugget=nu, least=least, sill=sill)
        rows = pd.DataFrame({**{k: g[k] for k in keys}, "family": f, "length": le, "nugget": nu, "radius": r, "id": g["id"], "observed": v, "predicted": p, "sigma": np.hypot(e, s), "n": n})
        return rows if missing else rows[n >= least]

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "family string, length double, nugget double, radius double", f"id {kinds['id']}, observed double, predicted double, sigma double, n int"])
    crossed = stations.select(*keys, "id", "x", "y", "value", "sigma").crossJoin(F.broadcast(candidates))
    groups = len(grid) * (stations.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] if keys else 1)
    by = [*keys, "family", "length", "nugget", "radius"]
    # Rows are few and their work is large, so tasks are counted by groups; left to their size they would be a handful.
    return crossed.repartition(max(64, -(-groups // 32)), *by).groupBy(*by).applyInPandas(run, schema)


def score_candidates(predictions: DataFrame, *, by: Sequence[str] = ("family", "length", "nugget", "radius"), baseline: str = "local_constant", relative_tolerance: float = 0.02, coverage: tuple[float, float] = (0.65, 1.0), gains: DataFrame | None = None) -> DataFrame:
    """NLPD, RMSE, coverage and acceptance of every candidate, best one flagged.

    A candidate is accepted if its RMSE is within tolerance of the best baseline,
    its NLPD is lower and its 90 % coverage lies in the given range; with ``gains``
    (of ``predictive_gains``) also only if the lower bootstrap bound of its mean
    gain is positive.  Ties are broken by every candidate parameter, so the choice
    is deterministic.
    """
    ok = F.col("predicted").isNotNull() & ~F.isnan("predicted")
    e = F.col("predicted") - F.col("observed")
    s = F.greatest(F.col("sigma"), F.lit(1e-6))
    scores = predictions.where(ok).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gaussian_nlpd(e, s)).alias("nlpd"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.abs(e / s) <= 1.64485).cast("double")).alias("coverage")
    )
    base = scores.where(F.col("family") == baseline).agg(F.min("rmse").alias("__r"), F.min("nlpd").alias("__l"))
    j = scores.join(F.broadcast(base), F.lit(True))
    accepted = F.col("__r").isNull() | ((F.col("rmse") <= (1 + relative_tolerance) * F.col("__r")) & (F.col("nlpd") < F.col("__l")) & F.col("coverage").between(*coverage))
    if gains is not None:
        j = j.join(bootstrap_lower_bound(gains, list(by), "gain").withColumnRenamed("lower", "gain_lower95"), list(by), "left")
        accepted &= F.coalesce(F.col("gain_lower95") > 0, F.lit(False))
    out = j.withColumn("accepted", (F.col("family") != baseline) & accepted).drop("__r", "__l")
    order = [F.desc("accepted"), F.round("nlpd", 9), F.round("rmse", 9), *[F.col(c) for c in by]]
    return out.withColumn("selected", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) == 1)


CANDIDATE = ("family", "length", "nugget", "radius")


def _candidate_scores(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    known = F.col("predicted").isNotNull() & ~F.isnan("predicted")
    e, s = F.when(known, F.col("predicted") - F.col("observed")), F.greatest(F.col("sigma"), F.lit(1e-6))
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_held"), F.count(e).alias("n"), F.avg(gaussian_nlpd(e, s)).alias("nlpd"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg((e / s) * (e / s))).alias("standardized_rms"), F.median(F.when(known, F.col("n"))).alias("stations"),
    )


def select_of_full_coverage(predictions: DataFrame, *, keys: Sequence[str] = (), by: Sequence[str] = CANDIDATE) -> DataFrame:
    """Scores of all candidates; selected is the best that predicts every held-out station.

    ``predictions`` has a row for each holdout, without a prediction where there is
    none, so that a candidate gains nothing by leaving out difficult stations.  Best
    is the lowest NLPD, then RMSE, then the candidate's parameters.
    """
    scores = _candidate_scores(predictions, [*keys, *by]).withColumn("coverage", F.col("n") / F.col("n_held")).withColumn("eligible", F.col("n") == F.col("n_held"))
    order = [F.desc("eligible"), F.col("nlpd"), F.col("rmse"), *[F.col(c) for c in reversed(by)]]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return scores.withColumn("selected", first & F.col("eligible"))


def select_by_one_standard_error(predictions: DataFrame, *, keys: Sequence[str] = (), by: Sequence[str] = CANDIDATE, baseline: str = "local_constant", unit: str = "id") -> DataFrame:
    """Scores of all candidates; a spatial one counts only if its gain exceeds its standard error and it lowers the RMSE.

    The gain is the mean drop of the NLPD against the baseline at the same holdouts.
    Adds gain, gain_se, rmse_gain, supported and selected (lowest NLPD, then RMSE,
    then the candidate's parameters; the baseline is always supported).
    """
    s = F.greatest(F.col("sigma"), F.lit(1e-6))
    known = predictions.where(F.col("predicted").isNotNull() & ~F.isnan("predicted")).withColumn("__l", gaussian_nlpd(F.col("predicted") - F.col("observed"), s))
    place = F.row_number().over(Window.partitionBy(*keys, unit).orderBy(*[F.col(c) for c in by if c != "family"]))
    base = known.where(F.col("family") == baseline).withColumn("__k", place).where("__k = 1")
    own = base.select(*keys, unit, F.col("__l").alias("__base"), (F.col("predicted") - F.col("observed")).alias("__e"))
    level = base.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("observed"), 2))).alias("__rmse"))
    drop = F.col("__base") - F.col("__l")
    gains = known.join(own, [*keys, unit]).groupBy(*keys, *by).agg(F.avg(drop).alias("gain"), (F.stddev_samp(drop) / F.sqrt(F.count(drop))).alias("gain_se"))
    scores = _candidate_scores(predictions, [*keys, *by]).join(gains, [*keys, *by], "left")
    scores = scores.join(level, list(keys)) if keys else scores.join(F.broadcast(level), F.lit(True))
    plain = F.col("family") == baseline
    better = F.coalesce((F.col("gain") > F.col("gain_se")) & (F.col("__rmse") > F.col("rmse")), F.lit(False))
    out = scores.withColumns({"rmse_gain": F.col("__rmse") - F.col("rmse"), "supported": plain | better}).drop("__rmse")
    order = [F.desc("supported"), F.col("nlpd"), F.col("rmse"), *[F.col(c) for c in by]]
    return out.withColumn("selected", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def bootstrap_lower_bound(gains: DataFrame, keys: Sequence[str], gain: str, *, replicates: int = 2000, seed: int = 640004, q: float = 0.05) -> DataFrame:
    """Lower quantile of bootstrap means of a short list of gains; -inf below two values."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g[gain].dropna().to_numpy(float)
        low = -np.inf if len(v) < 2 else float(np.quantile(np.random.default_rng(seed).choice(v, (replicates, len(v))).mean(1), q))
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "lower": [low]})

    kinds = dict(gains.dtypes)
    return gains.groupBy(*keys).applyInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "lower double"]))


def predictive_gains(predictions: DataFrame, *, model: Sequence[str] = ("family", "length", "nugget", "radius"), interval: str = "interval", baseline: str = "local_constant") -> DataFrame:
    """(model, interval, gain): mean drop of NLPD against the baseline at the same holdouts.

    The baseline is the candidate of family ``baseline`` with the same radius and
    the smallest length and nugget.
    """
    s = F.greatest(F.col("sigma"), F.lit(1e-6))
    scored = predictions.where(F.col("predicted").isNotNull() & ~F.isnan("predicted")).withColumn("nlpd", gaussian_nlpd(F.col("predicted") - F.col("observed"), s))
    place = F.row_number().over(Window.partitionBy(interval, "id", "radius").orderBy("length", "nugget"))
    base = scored.where(F.col("family") == baseline).withColumn("__k", place).where("__k = 1").select(interval, "id", "radius", F.col("nlpd").alias("__base"))
    pairs = scored.where(F.col("family") != baseline).join(base, [interval, "id", "radius"])
    return pairs.groupBy(*model, interval).agg(F.avg(F.col("__base") - F.col("nlpd")).alias("gain"))


def evaluate_fixed_model(
    predictions: DataFrame,
    *,
    expected: int | None = None,
    interval: str = "interval",
    baseline: str = "local_constant",
    relative_tolerance: float = 0.02,
    coverage: tuple[float, float] = (0.75, 0.99),
    scale: float = 1.0,
    seed: int = 640013,
) -> DataFrame:
    """One row: how a fixed model does on independent intervals, and whether it passes all gates.

    ``predictions`` holds the model and the baseline at each (interval, id), as
    ``leave_one_out_predictions`` gives them.  The model's errors are multiplied
    by ``scale``.  It passes if its RMSE is within tolerance of the baseline's, its
    NLPD lower, the lower 95 % bootstrap bound of its mean gain over intervals
    positive, its 90 % coverage in range, and no expected prediction is missing.
    """
    from tessera.functions.stats import Z90

    known = predictions.where(F.col("predicted").isNotNull() & ~F.isnan("predicted")).select(interval, "id", "family", "observed", "predicted", "sigma")
    base = known.where(F.col("family") == baseline).select(interval, "id", F.col("predicted").alias("base"), F.col("sigma").alias("base_sigma"))
    j = known.where(F.col("family") != baseline).join(base, [interval, "id"])
    e, b, s = F.col("observed") - F.col("predicted"), F.col("observed") - F.col("base"), scale * F.col("sigma")
    j = j.select(interval, e.alias("e"), b.alias("b"), s.alias("s"), gaussian_nlpd(e, s).alias("nlpd"), gaussian_nlpd(b, F.col("base_sigma")).alias("base_nlpd"))
    gains = j.groupBy(interval).agg(F.avg(F.col("base_nlpd") - F.col("nlpd")).alias("gain"))
    lower = bootstrap_lower_bound(gains.withColumn("__all", F.lit(0)), ["__all"], "gain", seed=seed).select(F.col("lower").alias("gain_lower95"))
    total = j.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(interval).alias("n_intervals"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.sqrt(F.avg(F.col("b") * F.col("b"))).alias("baseline_rmse"),
        F.avg("nlpd").alias("nlpd"), F.avg("base_nlpd").alias("baseline_nlpd"), F.avg((F.abs(F.col("e")) <= Z90 * F.col("s")).cast("double")).alias("coverage"),
    )
    out = total.join(F.broadcast(lower), F.lit(True), "left")
    complete = F.lit(True) if expected is None else F.col("n") == expected
    passed = (F.col("rmse") <= (1 + relative_tolerance) * F.col("baseline_rmse")) & (F.col("nlpd") < F.col("baseline_nlpd")) & (F.col("gain_lower95") > 0) & F.col("coverage").between(*coverage)
    return out.withColumn("complete", complete).withColumn("accepted", F.coalesce(F.col("complete") & passed, F.lit(False)))


def station_sets(present: DataFrame, *, interval: str = "interval", station: str = "id") -> tuple[DataFrame, DataFrame]:
    """Intervals by the set of stations they have: (interval, set_id) and (set_id, station).

    Supports and weights depend on the set alone; build them for the second table
    and join them to intervals by the first.
    """
    sets = present.groupBy(interval).agg(F.sort_array(F.collect_set(station)).alias("__s")).withColumn("set_id", F.sha2(F.to_json("__s"), 256))
    sets = cut_lineage(sets)
    return sets.select(interval, "set_id"), sets.dropDuplicates(["set_id"]).select("set_id", F.explode("__s").alias(station))


def weights_of_station_sets(targets: DataFrame, stations: DataFrame, present: DataFrame, family: str, *, radius: float, least: int = 1, interval: str = "interval", **model) -> DataFrame:
    """(interval, t_id, s_id, w, variance, n): kriging weights solved once for each distinct station set."""
    of, members = station_sets(present, interval=interval)
    pairs = local_pairs(targets, stations, radius)
    own = members.select("set_id", F.col("id").alias("s_id")).join(pairs, "s_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("set_id", "t_id"))
    own = own.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")
    own = own.withColumn("of", F.col("t_id")).withColumn("t_id", F.concat_ws("|", "set_id", F.col("t_id").cast("string")))
    names = own.select("t_id", "set_id", "of").distinct()
    w = kriging_weight_relation(own.drop("set_id", "of"), family, **model).join(names, "t_id")
    return of.join(w.select("set_id", F.col("of").alias("t_id"), "s_id", "w", "variance", "n"), "set_id").drop("set_id")


OBSERVED = ("first", "second", "target_first")


def cokriging_weight_relation(
    samples: DataFrame,
    targets: DataFrame,
    *,
    latent: Sequence[Sequence[float]],
    segments: DataFrame | None = None,
    length: float = 8.0,
    radius: float = 24.0,
    drift_scale: float | None = None,
    condition: bool = True,
    exclusion: float = 0.0,
    least: int = 8,
    most: int = 64,
    tasks_of: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Weights and diagnostics of two-look cokriging with barriers.

    samples: id, x, y, fe, fn, se, sn (looks), fvar, svar; targets: the same with
    fvar as the noise of the first look at the target.  Samples nearer than
    ``exclusion``, hidden behind a segment, or beyond the ``most`` nearest are left
    out.  Weights: (t_id, s_id, kind, output, w, n_obs); diagnostics one row per
    target with ``valid``.
    """
    C = np.array(latent, dtype=float)
    if np.linalg.eigvalsh((C + C.T) / 2)[0] <= 0:
        raise ValueError("the latent covariance must be positive definite")
    C = (C + C.T) / 2
    scale = drift_scale or radius
    j = radius_join(targets, samples, radius).where(F.col("distance") > exclusion if exclusion > 0 else F.lit(True))
    if segments is not None:
        links = j.withColumns({"x0": F.col("t_x"), "y0": F.col("t_y"), "x1": F.col("s_x"), "y1": F.col("s_y")})
        j = visible_links(links, segments, ["t_id", "s_id"]).drop("x0", "y0", "x1", "y1")
    near = F.row_number().over(Window.partitionBy("t_id").orderBy("distance", "s_id"))
    j = j.withColumn("__k", near).where(F.col("__k") <= most).drop("__k")
    kinds = dict(j.dtypes)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, one in g.groupby("t_id", sort=True):
            n = len(one)
            first = one.iloc[0]
            found = None
            if n >= least:
                pick = lambda *c: one[list(c)].to_numpy(float)  # noqa: B023, E731
                found = dense.cokriging_weights(
                    pick("s_x", "s_y"), first[["t_x", "t_y"]].to_numpy(float), (pick("s_fe", "s_fn"), pick("s_se", "s_sn")),
                    (first[["t_fe", "t_fn"]].to_numpy(float), first[["t_se", "t_sn"]].to_numpy(float)), C,
                    (one["s_fvar"].to_numpy(float), one["s_svar"].to_numpy(float)), float(first["t_fvar"]), condition=condition, length=length, drift_scale=scale,
                )
            row = {"t_id": t, "n": n, "valid": found is not None, "posterior": None, "weights": None, "s_ids": None}
            if found:
                row |= {
                    "weights": found["weights"].ravel().tolist(), "posterior": found["posterior"].ravel().tolist(),
                    **{k: found[k] for k in ("unbiasedness", "condition", "drift_condition", "jitter")}, "s_ids": one["s_id"].tolist(),
                }
            out.append(row)
        names = ["t_id", "n", "valid", "unbiasedness", "condition", "drift_condition", "jitter", "posterior", "weights", "s_ids"]
        return pd.DataFrame(out).reindex(columns=names).astype({c: float for c in names[3:7]})

    schema = f"t_id {kinds['t_id']}, n int, valid boolean, unbiasedness double, condition double, drift_condition double, jitter double, posterior array<double>, weights array<double>, s_ids array<{kinds['s_id']}>"

    solved = cut_lineage(j.groupBy(bucket(j, "t_id", tasks_of=tasks_of).alias("__g")).applyInPandas(solve, schema))
    post = F.col("posterior")
    diagnostics = solved.select(
        "t_id", "n", "valid", "unbiasedness", "condition", "drift_condition", "jitter", F.sqrt(post[0]).alias("sigma_east"), F.sqrt(post[4]).alias("sigma_north"), post[1].alias("cov_en")
    )
    per = F.size("weights") / 3
    flat = solved.where("valid").select("t_id", "n", "s_ids", per.cast("int").alias("n_obs"), F.posexplode("weights").alias("at", "w"))
    k = F.col("at") % F.col("n_obs")
    weights = flat.select(
        "t_id",
        F.when(k < 2 * F.col("n"), F.get("s_ids", (k % F.col("n")).cast("int"))).alias("s_id"),
        F.when(k < F.col("n"), OBSERVED[0]).when(k < 2 * F.col("n"), OBSERVED[1]).otherwise(OBSERVED[2]).alias("kind"),
        F.floor(F.col("at") / F.col("n_obs")).cast("int").alias("output"),
        "w",
        "n_obs",
    )
    return weights, diagnostics


def evaluate_cokriging(weights: DataFrame, observations: DataFrame, target_observations: DataFrame | None = None) -> DataFrame:
    """(t_id, epoch, east, north, second): NULL where any required look is missing.

    observations: id, epoch, first, second; target_observations: id, epoch, first.
    """
    long = observations.select(F.col("id").alias("o_id"), "epoch", F.expr("stack(2, 'first', first, 'second', second) AS (kind, v)"))
    if target_observations is not None:
        long = long.unionByName(target_observations.select(F.col("id").alias("o_id"), "epoch", F.lit("target_first").alias("kind"), F.col("first").alias("v")))
    w = weights.withColumn("o_id", F.when(F.col("kind") == "target_first", F.col("t_id")).otherwise(F.col("s_id")))
    j = w.join(long.hint("merge"), ["o_id", "kind"])  # repeated rows, which the planner takes for few
    g = j.groupBy("t_id", "epoch").agg(
        *[F.sum(F.when(F.col("output") == i, F.col("w") * F.col("v"))).alias(n) for i, n in enumerate(("east", "north", "second"))],
        F.count(F.when(F.col("output") == 0, F.col("v"))).alias("__n"),
        F.max("n_obs").alias("n_obs"),
    )
    return g.select("t_id", "epoch", *[F.when(F.col("__n") == F.col("n_obs"), F.col(c)).alias(c) for c in ("east", "north", "second")])
