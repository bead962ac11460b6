"""Series of pixels relative to a reference area, and the choice of that area.

Pixels are rows (epoch, position, value); a mask is a boolean column, so masks of
static layers push down to the scan.  All medians are exact per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import angle_between, normalize_look
from tessera.functions.stats import MAD_TO_SIGMA, quantile
from tessera.operators.ranking import separated
from tessera.operators.series import local_mean
from tessera.operators.spatial import radius_join
from tessera.runtime import cut_lineage


def reference_level(pixels: DataFrame, epoch: str, value: str, reference: Column, least: int = 25) -> DataFrame:
    """(epoch, reference, n_reference): median over the reference area, NULL below ``least`` pixels."""
    v = F.when(reference, F.col(value))
    return pixels.groupBy(epoch).agg(F.when(F.count(v) >= least, F.median(v)).alias("reference"), F.count(v).alias("n_reference"))


def referenced_series(pixels: DataFrame, epoch: str, value: str, *, area: Column, reference: Column, least_area: int = 1, least_reference: int = 25) -> DataFrame:
    """(epoch, value, sigma, n_area, n_reference): median of an area minus the reference, with its robust scatter."""
    v, r = F.when(area, F.col(value)), F.when(reference, F.col(value))
    level = pixels.groupBy(epoch).agg(F.median(v).alias("__a"), F.count(v).alias("n_area"), F.median(r).alias("__r"), F.count(r).alias("n_reference"))
    scatter = pixels.where(area).join(level, epoch).groupBy(epoch).agg((MAD_TO_SIGMA * F.median(F.abs(F.col(value) - F.col("__a")))).alias("__s"))
    ok = (F.col("n_area") >= least_area) & (F.col("n_reference") >= least_reference)
    return level.join(scatter, epoch, "left").select(
        epoch, F.when(ok, F.col("__a") - F.col("__r")).alias("value"), F.when(ok, F.col("__s")).alias("sigma"), "n_area", "n_reference"
    )


def patch_series(
    pixels: DataFrame, epoch: str, value: str, *, size: float, reference: Column, least: int = 50, least_reference: int = 25, carry: Sequence[str] = (), x: str = "x", y: str = "y"
) -> DataFrame:
    """(epoch, bx, by, value, n, means of ``carry``): medians of square cells minus the reference.

    Cells with fewer than ``least`` pixels at an epoch are left out.
    """
    cells = pixels.withColumns({"bx": F.floor(F.col(x) / size), "by": F.floor(F.col(y) / size)}).groupBy(epoch, "bx", "by")
    g = cells.agg(F.median(value).alias("__v"), F.count(value).alias("n"), *[F.avg(c).alias(c) for c in carry]).where(F.col("n") >= least)
    level = reference_level(pixels, epoch, value, reference, least_reference)
    return g.join(level, epoch).select(epoch, "bx", "by", (F.col("__v") - F.col("reference")).alias("value"), "n", *carry)


def point_series(
    points: DataFrame, pixels: DataFrame, epoch: str, value: str, *, radius: float, reference: Column, least: int = 30, least_reference: int = 25, point_id: str = "id"
) -> DataFrame:
    """(point, epoch, value, n): median within ``radius`` of each point minus the reference; NULL below ``least``."""
    near = radius_join(points.select(F.col(point_id).alias("id"), "x", "y"), pixels.select("x", "y", epoch, value), radius)
    g = near.groupBy(F.col("t_id").alias("point"), F.col(f"s_{epoch}").alias(epoch)).agg(F.median(f"s_{value}").alias("__v"), F.count(f"s_{value}").alias("n"))
    level = reference_level(pixels, epoch, value, reference, least_reference)
    return g.join(level, epoch).select("point", epoch, F.when(F.col("n") >= least, F.col("__v") - F.col("reference")).alias("value"), "n")


def sum_pairs(pairs: DataFrame, cell: Sequence[str], value: str, *, n_pairs: int, coherence: str | None = None, scale: str | None = None) -> DataFrame:
    """Sum of consecutive pairs per cell where every one of ``n_pairs`` is valid; lowest coherence, joint scale."""
    whole = F.count(value) == n_pairs
    out = [F.when(whole, F.sum(value)).alias("value"), whole.alias("valid")]
    if coherence:
        out.append(F.when(whole, F.min(coherence)).alias("coherence"))
    if scale:
        out.append(F.when(whole, F.sqrt(F.sum(F.col(scale) * F.col(scale)))).alias("scale"))
    return pairs.groupBy(*cell).agg(*out)


LOOK = ("look_e", "look_n", "look_u")


def local_medians(points: DataFrame, pixels: DataFrame, names: Sequence[str], radius: float) -> DataFrame:
    """(id, medians of ``names``, n_pixels) within ``radius`` of each point, over pixels that have all of them."""
    full = pixels.select("x", "y", *names).dropna(subset=list(names))
    near = radius_join(points.select("id", "x", "y"), full, radius).groupBy(F.col("t_id").alias("id"))
    return near.agg(*[F.median(f"s_{c}").alias(c) for c in names], F.count(F.lit(1)).alias("n_pixels"))


def sign_audit(stations: DataFrame, pixels: DataFrame, *, radius: float, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Polarity of a track against stations: rows per station, and one summary row.

    stations: id, x, y, east, north, up, sigma_e, sigma_n, sigma_u; pixels: x, y,
    value and the look.  Only pixels with every field count.  The sign is that of
    the correlation; one median offset is removed; below ``least`` stations the
    summary has no sign.
    """
    names = ("value", *LOOK)
    j = local_medians(stations, pixels, names, radius).join(stations.drop("x", "y"), "id")
    parts = list(zip(LOOK, ("east", "north", "up"), ("sigma_e", "sigma_n", "sigma_u"), strict=True))
    projected = sum((F.col(k) * F.col(c) for k, c, _ in parts), F.lit(0.0))
    sigma = F.sqrt(sum((F.pow(F.col(k) * F.col(s), 2) for k, _, s in parts), F.lit(0.0)))
    t = j.select("id", F.col("value").alias("observed"), projected.alias("projected"), sigma.alias("sigma"), "n_pixels")
    r = F.corr("observed", "projected")
    sign = t.agg(F.when(F.count(F.lit(1)) >= least, F.when(r >= 0, 1).otherwise(-1)).alias("sign"), r.alias("raw_r"), F.count(F.lit(1)).alias("n"))
    aligned = t.join(F.broadcast(sign), F.lit(True)).withColumn("aligned", F.col("sign") * F.col("observed"))
    offset = aligned.agg(F.median(F.col("aligned") - F.col("projected")).alias("offset"))
    rows = aligned.join(F.broadcast(offset), F.lit(True)).withColumn("residual", F.col("aligned") - F.col("projected") - F.col("offset"))
    rows = rows.withColumn("standardized", F.col("residual") / F.greatest("sigma", F.lit(1.0)))
    summary = rows.agg(
        F.first("n").alias("n"), F.first("raw_r").alias("raw_r"), F.first("sign").alias("sign"), F.first("offset").alias("offset"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.avg(F.abs("residual")).alias("mae"), F.corr("aligned", "projected").alias("aligned_r"),
    )
    return rows.select("id", "observed", "projected", "sigma", "n_pixels", "aligned", "residual", "standardized"), summary


def temporal_rms(pixels: DataFrame, cell: Sequence[str], epoch: str, value: str, far: Column) -> DataFrame:
    """(cell, rms, n): scatter over epochs of the change since the first epoch, centred on the far field.

    Only cells present at every epoch are returned.
    """
    ends = pixels.agg(F.min(epoch).alias("__e0"), F.count_distinct(epoch).alias("__n"))
    p = pixels.where(F.col(value).isNotNull()).join(F.broadcast(ends), F.lit(True))
    first = p.where(F.col(epoch) == F.col("__e0")).select(*cell, F.col(value).alias("__v0"))
    change = p.join(first, list(cell)).withColumn("__c", F.col(value) - F.col("__v0"))
    middle = change.groupBy(epoch).agg(F.median(F.when(far, F.col("__c"))).alias("__m"))
    g = change.join(middle, epoch).withColumn("__d", F.col("__c") - F.col("__m")).groupBy(*cell)
    out = g.agg(F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("rms"), F.count(F.lit(1)).alias("n"), F.first("__n").alias("__n"))
    return out.where(F.col("n") == F.col("__n")).drop("__n")


def change_between(pixels: DataFrame, cell: Sequence[str], epoch: str, value: str, reference: Column) -> DataFrame:
    """(cell, change): last minus first epoch, relative to the median change of the reference area."""
    ends = pixels.agg(F.min(epoch).alias("__e0"), F.max(epoch).alias("__e1"))
    p = pixels.join(F.broadcast(ends), F.lit(True))
    at = lambda e: F.max(F.when(F.col(epoch) == F.col(e), F.col(value)))
    g = p.groupBy(*cell).agg((at("__e1") - at("__e0")).alias("__c"), F.bool_or(reference).alias("__ref")).where("__c IS NOT NULL")
    level = g.agg(F.median(F.when(F.col("__ref"), F.col("__c"))).alias("__m"))
    return g.join(F.broadcast(level), F.lit(True)).select(*cell, (F.col("__c") - F.col("__m")).alias("change"))


def truncate_series(series: DataFrame, keys: Sequence[str], epoch: str, value: str, epochs: DataFrame) -> DataFrame:
    """Only the listed epochs, with the first of them as zero."""
    kept = series.join(epochs.select(epoch).distinct(), epoch, "left_semi")
    zero = kept.groupBy(*keys).agg(F.min_by(value, epoch).alias("__z"))
    return kept.join(zero, list(keys)).withColumn(value, F.col(value) - F.col("__z")).drop("__z")


#: Fixed weights of the reference score: temporal scatter, coherence, residual, gaps, loop errors.
SCORE_WEIGHTS = {"rms": 0.45, "coherence": 0.25, "residual": 0.20, "gaps": 0.05, "loops": 0.05}


def reference_score(cells: DataFrame, eligible: Column) -> DataFrame:
    """``score`` of every eligible cell, 0 best to 1 worst: weighted ranks between the 5 % and 95 % quantiles."""
    ok = F.coalesce(eligible, F.lit(False))
    bounds = cells.where(ok).agg(*[quantile(F.col(c), [0.05, 0.95]).alias(f"__{c}") for c in SCORE_WEIGHTS])
    score = F.lit(0.0)
    for c, w in SCORE_WEIGHTS.items():
        low, high = F.col(f"__{c}")[0], F.col(f"__{c}")[1]
        unit = F.least(F.greatest((F.col(c) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        unit = F.when(high > low, 1 - unit if c == "coherence" else unit).otherwise(0.0)
        score = score + w * unit
    return cells.join(F.broadcast(bounds), F.lit(True)).withColumn("score", F.when(ok, score)).drop(*[f"__{c}" for c in SCORE_WEIGHTS])


def worst_layers(first: DataFrame, second: DataFrame, cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """Cells of two products with the worse of each layer: coherence the lower, residual, gaps, loops and rms the higher.

    A layer that either lacks is missing.
    """
    names = list(SCORE_WEIGHTS)
    b = second.select(*cell, *[F.col(c).alias(f"__{c}") for c in names])
    both = lambda c: F.when(F.col(c).isNotNull() & F.col(f"__{c}").isNotNull(), (F.least if c == "coherence" else F.greatest)(F.col(c), F.col(f"__{c}")))
    return first.join(b, list(cell)).withColumns({c: both(c) for c in names}).drop(*[f"__{c}" for c in names])


#: Fixed limits of a reference box: coverage and coherence at least; residual, gaps and loops at most.
BOX_LIMITS = {"coverage": 0.98, "coherence": 0.50, "residual": 2.0, "gaps": 0.10, "loops": 5.0}


def choose_reference(
    cells: DataFrame, far: Column, *, size: int, margin: int | None = None, count: int = 10, distance: float = 8.0, limits: dict[str, float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The best boxes for a reference area, in order, and the box means of all cells.

    cells: row, col, x, y (km) and the layers of ``SCORE_WEIGHTS``.  Cells in the far
    field with all layers are scored; box means of score and layers over ``size``
    cells decide: a box counts if it lies ``margin`` cells inside the lattice, its
    centre in the far field, and it keeps all ``limits``.  The lowest mean score is
    taken first, then the next at least ``distance`` km away.  Chosen: rank, row, col,
    x, y, score, the means, and the box r1:r2, c1:c2 (upper ends excluded).
    """
    half = size // 2
    margin = half + 30 if margin is None else margin
    limit = BOX_LIMITS | (limits or {})
    names = list(SCORE_WEIGHTS)
    whole = far
    for c in names:
        whole = whole & F.col(c).isNotNull()
    scored = cut_lineage(reference_score(cells.withColumn("__far", F.coalesce(far, F.lit(False))), whole))
    boxes = None
    for c in ("score", *names):
        mean = local_mean(scored.select("row", "col", c), c, size).select("row", "col", F.col("local_mean").alias(f"box_{c}"), F.col("coverage").alias(f"__{c}"))
        boxes = mean.withColumnRenamed("__score", "coverage") if boxes is None else boxes.join(mean.drop(f"__{c}"), ["row", "col"])
    bounds = scored.agg(F.min("row").alias("__r0"), F.max("row").alias("__r1"), F.min("col").alias("__c0"), F.max("col").alias("__c1"))
    boxes = cut_lineage(scored.select("row", "col", "x", "y", "__far").join(boxes, ["row", "col"]).join(F.broadcast(bounds), F.lit(True)))
    inside = F.col("row").between(F.col("__r0") + margin, F.col("__r1") - margin) & F.col("col").between(F.col("__c0") + margin, F.col("__c1") - margin)
    good = F.col("__far") & inside & (F.col("coverage") >= limit["coverage"]) & (F.col("box_coherence") >= limit["coherence"])
    for c in ("residual", "gaps", "loops"):
        good = good & (F.col(f"box_{c}") <= limit[c])
    boxes = boxes.withColumn("eligible", F.coalesce(good, F.lit(False))).drop("__far", "__r0", "__r1", "__c0", "__c1")
    tie = F.col("row").cast("long") * F.lit(1 << 31) + F.col("col")
    ask = boxes.where("eligible").select(tie.alias("tie"), "x", "y", (-F.col("box_score")).alias("__best"))
    taken = separated(ask, "__best", count=count, distance=distance, tie="tie").select("tie")
    chosen = boxes.withColumn("tie", tie).join(F.broadcast(taken), "tie")
    rank = F.row_number().over(Window.orderBy("box_score", "tie"))  # ``count`` rows
    chosen = chosen.withColumns({"rank": rank, "r1": F.col("row") - half, "r2": F.col("row") + half + 1, "c1": F.col("col") - half, "c2": F.col("col") + half + 1})
    return chosen.drop("tie", "eligible"), boxes


def look_audit(points: DataFrame, pixels: DataFrame, *, radius: float, expected: tuple[float, float, float]) -> DataFrame:
    """(id, local unit look, n_pixels, angle): angle in degrees between the local median look and the expected one."""
    local = local_medians(points, pixels, LOOK, radius)
    e, n, u = normalize_look(*[F.col(c) for c in LOOK])
    unit = local.select("id", e.alias("look_e"), n.alias("look_n"), u.alias("look_u"), "n_pixels")
    angle = angle_between(tuple(F.col(c) for c in LOOK), tuple(F.lit(v) for v in expected))
    return unit.withColumn("angle", angle)
