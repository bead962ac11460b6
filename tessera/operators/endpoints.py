"""Values of a daily series at arbitrary times without crossing a step."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import MAD_TO_SIGMA, weighted_line
from tessera.operators.joins import bracket, interpolate_bracket


def _days(late: Column, early: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    return (micros(late) - micros(early)) / 86400e6


def regime(at: Column, events: Sequence[datetime], pre_days: int, post_days: int) -> dict[str, Column]:
    """Method of a time and the closed range of days its trend is fitted on.

    A time before a step of the same day takes the trend that ends the day before
    the (first such) step; a time after any step the trend that begins two days
    after the last one; every other time lies between its neighbours.
    """
    steps = F.array(*[F.lit(e).cast("timestamp") for e in events])
    coming = F.array_min(F.filter(steps, lambda e: (at < e) & (F.to_date(e) == F.to_date(at))))
    past = F.array_max(F.filter(steps, lambda e: e < at))
    if not events:
        coming = past = F.lit(None).cast("timestamp")
    before, after = F.date_sub(F.to_date(coming), 1), F.date_add(F.to_date(past), 2)
    return {
        "method": F.when(coming.isNotNull(), "trend_before_step").when(past.isNotNull(), "trend_after_step").otherwise("between_days"),
        "first_day": F.when(coming.isNotNull(), F.date_sub(before, pre_days)).when(past.isNotNull(), F.greatest(after, F.date_sub(F.to_date(at), post_days))),
        "last_day": F.when(coming.isNotNull(), before).when(past.isNotNull(), F.to_date(at)),
    }


def trend_at(targets: DataFrame, history: DataFrame, keys: Sequence[str], target_id: str, at: str, day: str, value: str, sigma: str, floor: float) -> DataFrame:
    """(target_id, n, value, sigma): weighted line over [first_day, last_day] at ``at``.

    The error joins the line's own with the robust scatter of its residuals, at
    least ``floor``.  Both passes group by the target, so they share one shuffle key.
    """
    h = history.select(*keys, F.col(day).alias("__day"), F.col(value).alias("__v"), F.greatest(F.col(sigma), F.lit(floor)).alias("__s"))
    rows = targets.join(h, list(keys)).where(F.col("__day").between(F.col("first_day"), F.col("last_day")))
    rows = rows.select(target_id, _days(F.col("__day"), F.col(at)).alias("__t"), "__v", (1 / (F.col("__s") * F.col("__s"))).alias("__w"))
    line = weighted_line(F.col("__t"), F.col("__v"), F.col("__w"))
    fit = rows.groupBy(target_id).agg(F.count(F.lit(1)).alias("n"), *[line[k].alias(f"__{k}") for k in ("intercept", "slope", "var_intercept")])
    apart = rows.join(fit, target_id).withColumn("__r", F.col("__v") - F.col("__intercept") - F.col("__slope") * F.col("__t"))
    middle = apart.groupBy(target_id).agg(F.median("__r").alias("__m"))
    scatter = apart.join(middle, target_id).groupBy(target_id).agg((MAD_TO_SIGMA * F.median(F.abs(F.col("__r") - F.col("__m")))).alias("__scatter"))
    spread = F.greatest(F.col("__scatter"), F.lit(floor))
    error = F.sqrt(F.greatest(F.col("__var_intercept"), F.lit(0.0)) + spread * spread)
    return fit.join(scatter, target_id).select(target_id, "n", F.col("__intercept").alias("value"), error.alias("sigma"))


def sample_endpoints(
    targets: DataFrame,
    history: DataFrame,
    *,
    keys: Sequence[str],
    target_id: str,
    at: str,
    day: str,
    value: str,
    sigma: str,
    events: Sequence[datetime] = (),
    floor: float = 0.002,
    pre_days: int = 30,
    post_days: int = 8,
    least_before: int = 7,
    least_after: int = 5,
) -> DataFrame:
    """(target_id, method, value, sigma, reason) of every target.

    History rows without a value or error take no part.  A target that cannot be
    sampled keeps NULLs and the reason: ``too few days``, ``not bracketed`` or
    ``step between neighbours``.
    """
    h = history.where(F.col(value).isNotNull() & F.col(sigma).isNotNull())
    t = targets.select(*keys, target_id, at).withColumns(regime(F.col(at), events, pre_days, post_days))
    fits = trend_at(t.where("method <> 'between_days'"), h, keys, target_id, at, day, value, sigma, floor)
    enough = F.coalesce(F.col("n"), F.lit(0)) >= F.when(F.col("method") == "trend_before_step", least_before).otherwise(least_after)
    trends = t.where("method <> 'between_days'").join(fits, target_id, "left").select(
        target_id, "method", F.when(enough, F.col("value")).alias("value"), F.when(enough, F.col("sigma")).alias("sigma"), F.when(~enough, "too few days").alias("reason")
    )
    known = h.select(*keys, F.col(day).cast("timestamp").alias(at), F.col(value).alias("__v"), F.greatest(F.col(sigma), F.lit(floor)).alias("__s"))
    near = interpolate_bracket(bracket(t.where("method = 'between_days'"), known, keys, at, "__v", "__s"), at, "__out")
    share = F.coalesce(_days(F.col(at), F.col("before_at")) / F.nullif(_days(F.col("after_at"), F.col("before_at")), F.lit(0.0)), F.lit(0.0))
    error = F.greatest(F.hypot((1 - share) * F.col("before_sigma"), share * F.col("after_sigma")), F.lit(floor))
    steps = F.array(*[F.lit(e).cast("timestamp") for e in events]) if events else F.array().cast("array<timestamp>")
    crossed = F.coalesce(F.exists(steps, lambda e: (e > F.col("before_at")) & (e < F.col("after_at"))), F.lit(False))
    reason = F.when(F.col("before_at").isNull() | F.col("after_at").isNull(), "not bracketed").when(crossed, "step between neighbours")
    between = near.withColumn("reason", reason).select(
        target_id,
        F.when(F.col("before_at") == F.col(at), "same_time").otherwise(F.col("method")).alias("method"),
        F.when(F.col("reason").isNull(), F.col("__out")).alias("value"),
        F.when(F.col("reason").isNull(), error).alias("sigma"),
        "reason",
    )
    return trends.unionByName(between)
