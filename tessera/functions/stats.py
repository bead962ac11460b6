"""Robust aggregate expressions.

All of these are built-in aggregates or arithmetic over them, so they combine
on the map side where Catalyst can.  Exact medians and quantiles keep a value
count per group; give groups that would not fit an ``approx`` accuracy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 0.7413
Z90 = 1.64485


def quantile(x: Column, q: float | list[float], approx: int | None = None) -> Column:
    """Linearly interpolated quantile; a bounded sketch if ``approx`` is an accuracy."""
    which = F.array(*[F.lit(v) for v in q]) if isinstance(q, list) else F.lit(q)
    return F.percentile(x, which) if approx is None else F.percentile_approx(x, which, approx)


def robust_scale(x: Column) -> Column:
    """0.7413 times the interquartile range."""
    return IQR_TO_SIGMA * (quantile(x, 0.75) - quantile(x, 0.25))


def quantile_band(x: Column) -> dict[str, Column]:
    return {"low": quantile(x, 0.025), "mid": quantile(x, 0.5), "high": quantile(x, 0.975)}


def median_and_mad(df: DataFrame, keys: list[str], value: str, *, only: Column | None = None, most: int | None = None) -> DataFrame:
    """(keys, n, center, mad): two aggregations that share one partitioning.

    ``only`` restricts the rows that count, e.g. to a frozen baseline.  With
    ``most``, groups of more values are narrowed down instead of buffered (see
    ``operators.quantiles``).
    """
    rows = df.where(only) if only is not None else df
    if most is not None:
        from tessera.operators.quantiles import grouped_quantile, match_groups
        from tessera.runtime import cut_lineage

        rows = rows.where(F.col(value).isNotNull()).select(*keys, value)
        center = cut_lineage(grouped_quantile(rows, keys, value, most=most, out="center"))
        groups = center.count()
        apart = match_groups(rows, center.select(*keys, "center"), keys, groups=groups).withColumn("__d", F.abs(F.col(value) - F.col("center")))
        return match_groups(center, grouped_quantile(apart, keys, "__d", most=most, out="mad").drop("n"), keys, groups=groups)
    rows = rows.where(F.col(value).isNotNull()).select(*keys, value)
    center = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("center"))
    apart = rows.join(center, keys).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("center").alias("center"), F.median(F.abs(F.col(value) - F.col("center"))).alias("mad")
    )
    return apart


def bic(rss: Column, n: Column, parameters: Column | int) -> Column:
    k = parameters if isinstance(parameters, Column) else F.lit(parameters)
    return n * F.ln(F.greatest(rss / n, F.lit(2.2250738585072014e-308))) + k * F.ln(n)


def segment_cost(sum_x: Column, sum_xx: Column, n: Column) -> Column:
    """Squared error about the mean of a segment from its sums."""
    return F.greatest(sum_xx - sum_x * sum_x / n, F.lit(0.0))


def inverse_variance_mean(x: Column, sigma: Column, floor: float = 1e-12) -> dict[str, Column]:
    """Weighted mean, its formal error, scatter about it and effective count."""
    s = F.greatest(sigma, F.lit(floor))
    w = F.when(x.isNotNull(), 1 / (s * s))
    sw, sx, sxx, sww = F.sum(w), F.sum(w * x), F.sum(w * x * x), F.sum(w * w)
    mean = sx / sw
    variance = F.greatest(sxx / sw - mean * mean, F.lit(0.0))
    return {
        "mean": mean,
        "formal": F.sqrt(1 / sw),
        "variance": variance,
        "n_eff": sw * sw / sww,
        "sigma": F.sqrt(1 / sw + variance),
    }


def interval_sill(df: DataFrame, keys: list[str], value: str, sigma: str, floor: float = 1.0) -> DataFrame:
    """max(floor, max(sample variance, robust variance) - median noise variance); floor below 3 rows."""
    robust = median_and_mad(df, keys, value)
    plain = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.var_samp(value).alias("__v"), F.median(F.pow(F.greatest(F.col(sigma), F.lit(0.0)), 2)).alias("__noise")
    )
    signal = F.greatest(F.col("__v"), F.pow(MAD_TO_SIGMA * F.col("mad"), 2)) - F.col("__noise")
    return robust.join(plain, keys).select(
        *keys, "n", F.when(F.col("n") < 3, F.lit(floor)).otherwise(F.greatest(F.lit(floor), signal)).alias("sill")
    )


def prediction_metrics(truth: Column, predicted: Column) -> dict[str, Column]:
    """count, coverage, mae, rmse, bias and r over rows where both are known."""
    both = truth.isNotNull() & predicted.isNotNull()
    e = F.when(both, predicted - truth)
    t, p = F.when(both, truth), F.when(both, predicted)
    n = F.count(e)
    spread = (F.stddev_pop(t) > 0) & (F.stddev_pop(p) > 0) & (n >= 3)
    return {
        "n": n,
        "coverage": n / F.nullif(F.count(truth), F.lit(0)),
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "bias": F.avg(e),
        "r": F.when(spread, F.corr(t, p)),
    }


def residual_metrics(residual: Column, sigma: Column, observed: Column, modelled: Column) -> dict[str, Column]:
    """Accuracy of residuals and of the errors stated for them."""
    z = residual / F.nullif(sigma, F.lit(0.0))
    return {
        "n": F.count(residual),
        "r": F.corr(observed, modelled),
        "median_bias": F.median(residual),
        "mae": F.avg(F.abs(residual)),
        "rmse": F.sqrt(F.avg(residual * residual)),
        "standardized_rms": F.sqrt(F.avg(z * z)),
        "coverage_90": F.avg((F.abs(z) <= Z90).cast("double")),
    }


def uncertainty_scale(observed: Column, predicted: Column, sigma: Column, coverage: float = 0.9, low: float = 0.25, high: float = 4.0) -> Column:
    """Factor that brings stated errors to nominal coverage, clipped; NULL below 20 rows."""
    ratio = F.abs(observed - predicted) / F.greatest(sigma, F.lit(1e-6))
    normal = {0.9: Z90}.get(coverage) or _normal_quantile((1 + coverage) / 2)
    scale = F.least(F.greatest(quantile(ratio, coverage) / normal, F.lit(low)), F.lit(high))
    return F.when(F.count(ratio) >= 20, scale)


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def covariance_2x2_eigen(c11: Column, c12: Column, c22: Column) -> dict[str, Column]:
    """Eigenvalues (large, small) and direction of the large one, in degrees."""
    mean, half = (c11 + c22) / 2, F.hypot((c11 - c22) / 2, c12)
    return {"l1": mean + half, "l2": mean - half, "angle": F.degrees(F.atan2(2 * c12, c11 - c22) / 2)}


def weighted_covariance(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Weighted mean and 2x2 covariance from sums."""
    sw = F.sum(w)
    mx, my = F.sum(w * x) / sw, F.sum(w * y) / sw
    return {
        "mean_x": mx,
        "mean_y": my,
        "cov_xx": F.sum(w * x * x) / sw - mx * mx,
        "cov_xy": F.sum(w * x * y) / sw - mx * my,
        "cov_yy": F.sum(w * y * y) / sw - my * my,
    }


def weighted_line(t: Column, y: Column, w: Column) -> dict[str, Column]:
    """Weighted least-squares line from sums: intercept, slope and their covariance."""
    s, st, sy = F.sum(w), F.sum(w * t), F.sum(w * y)
    stt, sty = F.sum(w * t * t), F.sum(w * t * y)
    det = F.nullif(s * stt - st * st, F.lit(0.0))
    return {
        "intercept": (stt * sy - st * sty) / det,
        "slope": (s * sty - st * sy) / det,
        "var_intercept": stt / det,
        "cov_intercept_slope": -st / det,
        "var_slope": s / det,
    }


def through_origin_slope(x: Column, y: Column) -> Column:
    return F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))


def plus_one_p(exceeding: Column, n: Column) -> Column:
    """(1 + number of null values at or above the observed) / (n + 1)."""
    return (1 + exceeding) / (n + 1)


def log_sum_exp_weights(df: DataFrame, log_weight: str, keys: list[str], out: str = "probability") -> DataFrame:
    """Weights normalised over ``keys`` from their logarithms."""
    from pyspark.sql import Window

    w = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    top = F.max(log_weight).over(w)
    e = F.exp(F.col(log_weight) - top)
    return df.withColumn(out, e / F.sum(e).over(w))


def gaussian_nlpd(error: Column, sigma: Column) -> Column:
    """Negative log predictive density of one prediction."""
    return 0.5 * (F.log(2 * math.pi * sigma * sigma) + error * error / (sigma * sigma))
