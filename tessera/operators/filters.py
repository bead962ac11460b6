"""Predicates, masks and their bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import haversine_km


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def quality_mask(limits: dict[str, tuple[str, float]]) -> Column:
    """Conjunction of finite-and-compared tests, e.g. ``{"coherence": (">=", 0.3)}``.

    Written as plain comparisons, so Parquet readers can push them down.
    """
    tests = {">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v}
    out = F.lit(True)
    for name, (how, value) in limits.items():
        c = F.col(name)
        out = out & c.isNotNull() & ~F.isnan(c) & tests[how](c, value)
    return out


#: Named limits of the quality masks in use.
STRICT = {"coherence": (">=", 0.30), "residual_rms": ("<=", 2.0), "n_gap": ("<=", 0.0), "n_loop_err": ("<=", 5.0)}
LOOSE = {"coherence": (">=", 0.25), "residual_rms": ("<=", 5.0), "n_gap": ("<=", 2.0), "n_loop_err": ("<=", 10.0)}
CUBE = {"coherence": (">=", 0.30), "residual_rms": ("<=", 5.0), "n_gap": ("<=", 2.0), "n_loop_err": ("<=", 10.0)}


def disk_mask(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float) -> Column:
    return haversine_km(lat, lon, lat0, lon0) <= radius_km


def persistent(df: DataFrame, key: str | list[str], over: str, valid: Column | None = None) -> DataFrame:
    """Relational division: keys that occur (validly) with every value of ``over``."""
    keys = [key] if isinstance(key, str) else key
    total = df.agg(F.count_distinct(over).alias("__total"))
    kept = df.where(valid) if valid is not None else df
    have = kept.groupBy(*keys).agg(F.count_distinct(over).alias("__have"))
    return have.join(F.broadcast(total), F.col("__have") == F.col("__total")).select(*keys)


def sub_lattice(row: str = "row", col: str = "col", step: int = 2) -> Column:
    return (F.col(row) % step == 0) & (F.col(col) % step == 0)


def band_of(x: Column, edges: Sequence[float]) -> Column:
    """Index of the band (edge[i], edge[i+1]]; the first band holds its lower edge too."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), 0)
    for i in range(1, len(edges) - 1):
        out = out.when((x > edges[i]) & (x <= edges[i + 1]), i)
    return out.when(x > edges[-1], len(edges) - 1)


def first_failure(tests: dict[str, Column], passed: str = "passed") -> Column:
    """Name of the first test that does not hold; each row is charged once."""
    out = None
    for name, test in tests.items():
        failed = ~F.coalesce(test, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise(passed)


def last_category(cases: dict[str, Column], default: str) -> Column:
    """Category of the last case that holds (later assignments overwrite earlier ones)."""
    out = None
    for name, test in reversed(cases.items()):
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def resolved_flags(delta: Column, sigma: Column, threshold: float = 1.96) -> dict[str, Column]:
    z = delta / F.greatest(sigma, F.lit(1e-12))
    return {"z": z, "resolved": F.abs(z) >= threshold}


def period_masks(date: Column, periods: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Closed date intervals as named boolean columns."""
    return {k: date.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for k, (a, b) in periods.items()}


def remove_baseline_median(df: DataFrame, value: str, date: str, start: str, end: str, keys: Sequence[str] = (), least: int = 3) -> DataFrame:
    """``value`` minus its median in [start, end], per key; NULL with fewer than ``least`` rows."""
    inside = F.col(date).between(F.lit(start), F.lit(end))
    base = df.groupBy(*keys).agg(
        F.median(F.when(inside, F.col(value))).alias("baseline_median"), F.count(F.when(inside, F.col(value))).alias("baseline_count")
    )
    both = df.join(base, list(keys)) if keys else df.join(F.broadcast(base), F.lit(True))
    centred = F.when(F.col("baseline_count") >= least, F.col(value) - F.col("baseline_median"))
    return both.withColumn("referenced", centred)
