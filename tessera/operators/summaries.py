"""Summaries of series, intervals and products: aggregates that analyses share.

Each is one or two aggregations by the caller's keys; thresholds and centres
that must stay frozen are computed first and joined as a table of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats


def band_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, median, q25, q75) over known values."""
    q = stats.quantile(F.col(value), [0.25, 0.5, 0.75])
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q.alias("__q"))
    return out.select(*keys, "n", F.col("__q")[1].alias("median"), F.col("__q")[0].alias("q25"), F.col("__q")[2].alias("q75"))


def component_series(df: DataFrame, keys: Sequence[str], components: Sequence[str]) -> DataFrame:
    """(keys, component, n, median, q25, q75): wide columns as one series each."""
    long = df.unpivot(list(keys), list(components), "component", "value")
    return band_summary(long, [*keys, "component"], "value")


def interval_summary(df: DataFrame, keys: Sequence[str], value: str, *, valid: Column, flags: Mapping[str, Column]) -> DataFrame:
    """(keys, n, median_abs, median, one count a flag) over valid rows."""
    counts = [F.count_if(c).alias(name) for name, c in flags.items()]
    x = F.col(value)
    return df.where(valid).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(F.abs(x)).alias("median_abs"), F.median(x).alias("median"), *counts)


def frozen_members(reference: DataFrame, member: Sequence[str], value: str, *, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """(member, lobe): members at or beyond two quantiles of the reference values."""
    limits = reference.agg(stats.quantile(F.col(value), [low, high]).alias("__q"))
    lobe = F.when(F.col(value) <= F.col("__q")[0], "lower").when(F.col(value) >= F.col("__q")[1], "upper")
    return reference.join(F.broadcast(limits), F.lit(True)).select(*member, lobe.alias("lobe")).where(F.col("lobe").isNotNull())


def lobe_summary(df: DataFrame, members: DataFrame, member: Sequence[str], keys: Sequence[str], value: str, sigma: str | None = None) -> DataFrame:
    """(lobe, keys, n, median, rms, and the share of values beyond 1.96 sigma) of frozen members."""
    x = F.col(value)
    j = df.join(members, list(member))
    more = [F.avg((F.abs(x) >= 1.96 * F.col(sigma)).cast("double")).alias("beyond")] if sigma else []
    return j.groupBy("lobe", *keys).agg(F.count(x).alias("n"), F.median(x).alias("median"), F.sqrt(F.avg(x * x)).alias("rms"), *more)


def rollup(df: DataFrame, keys: Sequence[str], member: str, metrics: Mapping[str, Column], *, periods: Mapping[str, Column] | None = None) -> DataFrame:
    """Metrics of each member and of all together (member ``ALL``), also by periods that may overlap."""
    rows = df
    if periods:
        held = F.array(*[F.when(c, F.lit(name)) for name, c in periods.items()])
        rows = df.withColumn("period", F.explode(F.array_compact(held)))
        keys = [*keys, "period"]
    both = rows.withColumn("__m", F.explode(F.array(F.col(member).cast("string"), F.lit("ALL")))).drop(member)
    return both.groupBy(*keys, F.col("__m").alias(member)).agg(*[c.alias(k) for k, c in metrics.items()])


def product_summary(df: DataFrame, keys: Sequence[str], member: str, time: str) -> DataFrame:
    """(keys, members, n, first, last) of each product or track."""
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("members"), F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def availability(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, n_known, available, mean): how much of a field is known."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("n_known"), (F.count(x) / F.count(F.lit(1))).alias("available"), F.avg(x).alias("mean"))


def paired_differences(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Difference b - a where both are known: n, rms, worst, median, median_abs, p95_abs, p02, p98, r, slope, sign_agreement."""
    left = a.select(*on, *[k for k in keys if k not in on], F.col(value).alias("__a"))
    j = left.join(b.select(*on, F.col(value).alias("__b")), list(on)).where(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    d = F.col("__b") - F.col("__a")
    q = stats.quantile(d, [0.02, 0.5, 0.98])
    out = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("worst"), q.alias("__q"), F.median(F.abs(d)).alias("median_abs"), stats.quantile(F.abs(d), 0.95).alias("p95_abs"),
        F.corr("__a", "__b").alias("r"), stats.through_origin_slope(F.col("__a"), F.col("__b")).alias("slope"), F.avg((F.signum("__a") == F.signum("__b")).cast("double")).alias("sign_agreement"),
    )
    return out.select(*keys, "n", "rms", "worst", F.col("__q")[1].alias("median"), "median_abs", "p95_abs", F.col("__q")[0].alias("p02"), F.col("__q")[2].alias("p98"), "r", "slope", "sign_agreement")


def vector_mismatch(a: DataFrame, b: DataFrame, on: Sequence[str], components: Sequence[str]) -> DataFrame:
    """(n, rms): root mean squared length of the difference of two vectors at the same keys."""
    j = a.select(*on, *[F.col(c).alias(f"__a_{c}") for c in components]).join(b.select(*on, *[F.col(c).alias(f"__b_{c}") for c in components]), list(on))
    square = sum((F.pow(F.col(f"__a_{c}") - F.col(f"__b_{c}"), 2) for c in components), F.lit(0.0))
    return j.agg(F.count(square).alias("n"), F.sqrt(F.avg(square)).alias("rms"))


def accuracy_gates(
    df: DataFrame, error: str, sigma: str, *, baseline_rmse: Column | float, keys: Sequence[str] = (), subset: Column | None = None, tolerance: float = 1.10, coverage: tuple[float, float] = (0.65, 1.0), least: int = 1
) -> DataFrame:
    """(keys, n, rmse, coverage, passed) of all rows, or of a subset of them."""
    e, z = F.col(error), F.abs(F.col(error) / F.nullif(F.col(sigma), F.lit(0.0)))
    rows = df if subset is None else df.where(subset)
    out = rows.groupBy(*keys).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((z <= stats.Z90).cast("double")).alias("coverage"))
    limit = tolerance * (baseline_rmse if isinstance(baseline_rmse, Column) else F.lit(float(baseline_rmse)))
    return out.withColumn("passed", (F.col("rmse") <= limit) & F.col("coverage").between(*coverage) & (F.col("n") >= least))


def unit_score(df: DataFrame, value: str, *, eligible: Column | None = None, invert: bool = False, keys: Sequence[str] = (), out: str = "score") -> DataFrame:
    """Position between the 5th and 95th percentile of eligible values, cut to [0, 1].

    Without any spread, or without an eligible value, every score is 0; missing
    values have none.
    """
    x = F.col(value)
    ok = x.isNotNull() if eligible is None else x.isNotNull() & eligible
    grouped = df.where(ok).groupBy(*keys).agg(stats.quantile(x, [0.05, 0.95]).alias("__q"))
    j = df.join(F.broadcast(grouped), F.lit(True), "left") if not keys else df.join(grouped, list(keys), "left")
    low, high = F.col("__q")[0], F.col("__q")[1]
    raw = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    score = F.when(x.isNull(), F.lit(None)).when(F.coalesce(high > low, F.lit(False)), 1 - raw if invert else raw).otherwise(0.0)
    return j.withColumn(out, score).select(*df.columns, out)


def common_values(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """Sorted values that all frames have, e.g. dates of several stacks.

    Each frame is reduced to its distinct values in its tasks, so what is shuffled
    grows with the values, not with the rows.
    """
    values = [f.select(column).where(F.col(column).isNotNull()).withColumn("__f", F.lit(i)).distinct() for i, f in enumerate(frames)]
    every = values[0]
    for v in values[1:]:
        every = every.union(v)
    return every.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(frames)).select(column).orderBy(column)


def masked_median_series(df: DataFrame, keys: Sequence[str], value: str, mask: Column) -> DataFrame:
    """(keys, n, median) over the rows of ``mask``; a mask that holds no row is an error."""
    rows = df.where(mask)
    if rows.isEmpty():
        raise ValueError("the mask selects nothing")
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("median"))


def frozen_medians(df: DataFrame, station: Sequence[str], interval: str, value: str, sigma: str, *, before: Column, floor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(station, sigma): median sigma of each station over frozen intervals; and one row with the median of their sills."""
    rows = df.where(before)
    sigmas = rows.where(F.col(sigma).isNotNull()).groupBy(*station).agg(F.median(sigma).alias("sigma"))
    sills = stats.interval_sill(rows, [interval], value, sigma, floor).agg(F.median("sill").alias("sill"), F.count(F.lit(1)).alias("n_intervals"))
    return sigmas, sills


def pooled_covariance(df: DataFrame, epoch: Sequence[str], x: str, y: str, *, keys: Sequence[str] = (), scale_floor: float = 5.0, clip: float = 4.0, eigen_floor: float = 25.0) -> DataFrame:
    """(keys, n, scale_x, scale_y, cov_xx, cov_xy, cov_yy): covariance of two fields about their median of each epoch.

    Values are pooled over epochs, cut at ``clip`` robust scales (0.7413 times the
    interquartile range, at least ``scale_floor``), and eigenvalues of the sample
    covariance are raised to ``eigen_floor``.
    """
    centres = df.groupBy(*keys, *epoch).agg(F.median(x).alias("__mx"), F.median(y).alias("__my"))
    c = df.join(centres, [*keys, *epoch]).withColumns({"__x": F.col(x) - F.col("__mx"), "__y": F.col(y) - F.col("__my")}).where(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    c = c.select(*keys, "__x", "__y")
    scales = c.groupBy(*keys).agg(
        F.greatest(stats.robust_scale(F.col("__x")), F.lit(scale_floor)).alias("scale_x"), F.greatest(stats.robust_scale(F.col("__y")), F.lit(scale_floor)).alias("scale_y")
    )
    j = c.join(scales, list(keys)) if keys else c.join(F.broadcast(scales), F.lit(True))
    cut = lambda v, s: F.least(F.greatest(F.col(v), -clip * F.col(s)), clip * F.col(s))
    u, v = cut("__x", "scale_x"), cut("__y", "scale_y")
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("scale_x").alias("scale_x"), F.first("scale_y").alias("scale_y"), F.var_samp(u).alias("__xx"), F.covar_samp(u, v).alias("__xy"), F.var_samp(v).alias("__yy")
    )
    # Eigenvalues l1 >= l2 of a symmetric 2x2 matrix; raising them adds multiples of the two projectors.
    mean, half = (F.col("__xx") + F.col("__yy")) / 2, F.hypot((F.col("__xx") - F.col("__yy")) / 2, F.col("__xy"))
    l1, l2 = F.greatest(mean + half, F.lit(eigen_floor)), F.greatest(mean - half, F.lit(eigen_floor))
    cos2 = F.when(half > 0, (F.col("__xx") - F.col("__yy")) / 2 / half).otherwise(1.0)
    sin2 = F.when(half > 0, F.col("__xy") / half).otherwise(0.0)
    return g.select(
        *keys, "n", "scale_x", "scale_y", ((l1 + l2) / 2 + (l1 - l2) / 2 * cos2).alias("cov_xx"), ((l1 - l2) / 2 * sin2).alias("cov_xy"), ((l1 + l2) / 2 - (l1 - l2) / 2 * cos2).alias("cov_yy")
    )


def median_change_p(df: DataFrame, cell: Sequence[str], interval: str, value: str, *, calibration: Column) -> DataFrame:
    """(interval, n, statistic, calibration, p): median distance of an interval's cells from their centres.

    A cell's centre is its median over calibration intervals.  The p-value of an
    interval is plus-one among the calibration intervals (itself left out if it is
    one of them).
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("__cal", F.coalesce(calibration, F.lit(False)))
    centre = rows.where("__cal").groupBy(*cell).agg(F.median(value).alias("__c"))
    out = rows.join(centre, list(cell)).groupBy(interval).agg(
        F.count(F.lit(1)).alias("n"), F.median(F.abs(F.col(value) - F.col("__c"))).alias("statistic"), F.first("__cal").alias("calibration")
    )
    # The calibration intervals are a short list of one number each.
    null = out.where("calibration").agg(F.collect_list("statistic").alias("__null"))
    j = out.join(F.broadcast(null), F.lit(True))
    own = F.col("calibration").cast("int")
    above = F.size(F.filter("__null", lambda v: v >= F.col("statistic"))) - own
    return j.withColumn("p", stats.plus_one_p(above, F.size("__null") - own)).drop("__null")


def lineage_fraction(pairs: DataFrame, flags: DataFrame, *, target: str = "t_id", sample: str = "s_id", flag: str = "imputed") -> DataFrame:
    """(target, n, fraction): share of each target's samples that were ever flagged."""
    ever = flags.groupBy(F.col(sample)).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias("__f"))
    j = pairs.join(ever, sample, "left")
    return j.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("__f", F.lit(False)).cast("double")).alias("fraction"))


def product_comparison(results: DataFrame, keys: Sequence[str], unit: str, statistic: str, p: str, *, level: float = 0.05) -> DataFrame:
    """(keys, n, least_p, n_significant, strongest, statistic) of each product and cut-off; ties to the smaller unit."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(p).alias("least_p"), F.count_if(F.col(p) <= level).alias("n_significant"),
        F.min_by(unit, F.struct(-F.col(statistic), F.col(unit))).alias("strongest"), F.max(statistic).alias("statistic"),
    )


def cut_offs(df: DataFrame, date: str, cuts: Sequence[str]) -> DataFrame:
    """Each row once for each cut-off date that it does not pass."""
    options = F.array(*[F.lit(c).cast("date") for c in cuts])
    return df.withColumn("cut", F.explode(F.filter(options, lambda c: F.col(date).cast("date") <= c)))


def daily_noise(df: DataFrame, keys: Sequence[str], day: str, value: str, *, end: str, floor: float, days: int = 45, least: int = 6) -> DataFrame:
    """(keys, n, noise): scatter of one day from first differences of the days before ``end``, at least ``floor``."""
    stop = F.lit(end).cast("timestamp")
    known = df.where((F.col(day) >= stop - F.expr(f"INTERVAL {days} DAYS")) & (F.col(day) < F.date_trunc("day", stop)) & F.col(value).isNotNull())
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(day))
    spread = stats.median_and_mad(known.withColumn("__d", step), list(keys), "__d").select(*keys, F.col("mad").alias("__mad"))
    counts = df.groupBy(*keys).agg(F.lit(1).alias("__one")).join(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), list(keys), "left")
    noise = F.greatest(F.lit(floor), stats.MAD_TO_SIGMA * F.col("__mad") / F.sqrt(F.lit(2.0)))
    out = counts.join(spread, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.coalesce(noise, F.lit(floor))).otherwise(F.lit(floor)).alias("noise"))


def averaged_scores(a: DataFrame, b: DataFrame, on: Sequence[str], scores: Sequence[str], suffixes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Candidates that both sides scored: both scores with suffixes, and their mean."""
    side = lambda df, s: df.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in scores])
    j = side(a, suffixes[0]).join(side(b, suffixes[1]), list(on))
    return j.withColumns({c: (F.col(f"{c}_{suffixes[0]}") + F.col(f"{c}_{suffixes[1]}")) / 2 for c in scores})


def event_against_control(event: DataFrame, control: DataFrame, on: Sequence[str], values: Sequence[str], *, valid: str = "valid") -> DataFrame:
    """Rows valid on both sides: event and control values, and their differences."""
    e = event.where(F.col(valid)).select(*on, *[F.col(v).alias(f"{v}_event") for v in values])
    c = control.where(F.col(valid)).select(*on, *[F.col(v).alias(f"{v}_control") for v in values])
    return e.join(c, list(on)).withColumns({f"{v}_change": F.col(f"{v}_event") - F.col(f"{v}_control") for v in values})


def scatter_to_grid(targets: DataFrame, rows: int, cols: int, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every cell of a grid for every key, with the target's values where there is one.

    A target outside the grid, or two at one cell, is an error.
    """
    outside = ~(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    if not targets.where(F.coalesce(outside, F.lit(True))).isEmpty():
        raise ValueError("a target lies outside the grid")
    if not targets.groupBy(*keys, "row", "col").count().where("count > 1").isEmpty():
        raise ValueError("two targets share a cell")
    frame = targets.select(*keys).distinct() if keys else targets.sparkSession.range(1).select(F.lit(1).alias("__one"))
    frame = frame.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return frame.join(targets.select(*keys, "row", "col", *values), [*keys, "row", "col"], "left").select(*keys, "row", "col", *values)


def ascending_index(df: DataFrame, axis: str, index: str, keys: Sequence[str] = ()) -> DataFrame:
    """``index`` renumbered from 0 along ascending values of ``axis``; equal values share a number."""
    w = Window.partitionBy(*keys).orderBy(axis) if keys else Window.orderBy(axis)
    values = df.select(*keys, axis).distinct().withColumn("__i", F.row_number().over(w) - 1)
    return df.drop(index).join(values, [*keys, axis]).withColumnRenamed("__i", index)


def check_looks(df: DataFrame, columns: tuple[str, str, str], *, variance: str | None = None, tolerance: float = 1e-3) -> DataFrame:
    """``df`` with ``problem``: null where look vector and variance are usable, else what is wrong."""
    e, n, u = (F.col(c) for c in columns)
    known = e.isNotNull() & n.isNotNull() & u.isNotNull() & ~F.isnan(e) & ~F.isnan(n) & ~F.isnan(u)
    length = F.sqrt(e * e + n * n + u * u)
    problem = F.when(~known, "look missing").when(F.abs(length - 1) > tolerance, "look not of unit length")
    if variance is not None:
        v = F.col(variance)
        problem = problem.when(v.isNull() | F.isnan(v), "variance missing").when((v < 0) | (v == float("inf")), "variance out of range")
    return df.withColumn("problem", problem)


def project_history(history: DataFrame, look: tuple[float, float, float], keys: Sequence[str], day: str, names: Sequence[str] = ("east", "north", "up", "sig_e", "sig_n", "sig_u")) -> DataFrame:
    """(keys, day, los_mm, sigma_mm): a station's history in metres along a look vector, errors taken as independent."""
    axes, errors = [F.col(c) for c in names[:3]], [F.col(c) for c in names[3:]]
    los = sum((1000.0 * w * c for w, c in zip(look, axes, strict=True)), F.lit(0.0))
    sigma = F.sqrt(sum((F.pow(1000.0 * w * c, 2) for w, c in zip(look, errors, strict=True)), F.lit(0.0)))
    return history.select(*keys, day, los.alias("los_mm"), sigma.alias("sigma_mm")).orderBy(*keys, day)


def rupture_distance_bounds(samples: DataFrame, segments: DataFrame, target: str, *, spacing: float, cell: float = 4.0) -> DataFrame:
    """(target, lower, upper): bounds on the distance of an area from segments, by its sample points.

    Upper is the smallest distance of a sample to a segment's midpoint; lower is
    that less the diagonal of the sample spacing and the largest half length.
    """
    from tessera.operators.spatial import nearest_join

    mid = segments.select(
        F.monotonically_increasing_id().alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")
    )
    half = segments.agg(F.max(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / 2).first()[0]
    if half is None:
        return samples.select(target).distinct().select(target, F.lit(float("inf")).alias("lower"), F.lit(float("inf")).alias("upper"))
    probes = samples.withColumn("__id", F.struct(target, "x", "y"))
    near = nearest_join(probes, mid, target_id="__id", point_id="id", cell=cell)
    out = near.groupBy(F.col(f"t_id.{target}").alias(target)).agg(F.min("distance").alias("upper"))
    return out.select(target, F.greatest(F.col("upper") - F.lit(2.0**0.5 * spacing + half), F.lit(0.0)).alias("lower"), "upper")
