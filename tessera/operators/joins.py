"""Temporal and relational joins.

None of these needs a cross join: exact lags and alignments are equi-joins,
nearest-in-time joins are one sort per key over the union of both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_lag_pairs(df: DataFrame, date: str, value: str, lags: Sequence[int], keys: Sequence[str] = (), sigma: str | None = None) -> DataFrame:
    """Differences over exactly ``lag`` days, only where both epochs exist."""
    keys = list(keys)
    now = df.select(*keys, F.col(date).alias("end_date"), F.col(value).alias("__v"), *([F.col(sigma).alias("__s")] if sigma else []))
    now = now.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).withColumn("start_date", F.date_sub("end_date", F.col("lag")))
    then = df.select(*keys, F.col(date).alias("start_date"), F.col(value).alias("__v0"))
    out = now.join(then, [*keys, "start_date"]).withColumn("change", F.col("__v") - F.col("__v0"))
    if sigma:
        out = out.withColumn("sigma", F.sqrt(F.lit(2.0)) * F.col("__s")).drop("__s")
    return out.drop("__v", "__v0")


def consecutive_pairs(df: DataFrame, date: str, value: str, keys: Sequence[str] = (), gap_days: int | None = None) -> DataFrame:
    """Differences of adjacent epochs; with ``gap_days`` only those exactly that far apart."""
    w = Window.partitionBy(*keys).orderBy(date)
    out = df.select(
        *keys,
        F.col(date).alias("start_date"),
        F.lead(date).over(w).alias("end_date"),
        (F.lead(value).over(w) - F.col(value)).alias("change"),
    ).where(F.col("end_date").isNotNull())
    return out if gap_days is None else out.where(F.datediff("end_date", "start_date") == gap_days)


def bracket(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, sigma: str | None = None) -> DataFrame:
    """Both as-of neighbours of each left row among the right rows of its key.

    Adds before_at, before_value, after_at, after_value: the last right row at or
    before, and the first at or after; with ``sigma`` also before_sigma and
    after_sigma.  One shuffle and one sort serve both directions.
    """
    keys = list(keys)
    names = left.columns
    error = F.col(sigma).cast("double") if sigma else F.lit(None).cast("double")
    tagged = left.withColumns({"__kind": F.lit(1), "__v": F.lit(None).cast("double"), "__s": F.lit(None).cast("double")}).unionByName(
        right.select(*keys, F.col(at), F.col(value).cast("double").alias("__v"), error.alias("__s")).withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    seen = F.when(F.col("__kind") == 0, F.struct(F.col(at).alias("at"), F.col("__v").alias("v"), F.col("__s").alias("s")))
    back = Window.partitionBy(*keys).orderBy(F.col(at), F.col("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.withColumns({"__b": F.last(seen, True).over(back), "__a": F.last(seen, True).over(ahead)}).where(F.col("__kind") == 1)
    return out.select(
        *names,
        F.col("__b.at").alias("before_at"),
        F.col("__b.v").alias("before_value"),
        F.col("__a.at").alias("after_at"),
        F.col("__a.v").alias("after_value"),
        *([F.col("__b.s").alias("before_sigma"), F.col("__a.s").alias("after_sigma")] if sigma else []),
    )


def interpolate_bracket(df: DataFrame, at: str, out: str = "value") -> DataFrame:
    """Exact match wins, else linear between the neighbours; NULL if unbracketed."""
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    share = (t(at) - t("before_at")) / F.nullif(t("after_at") - t("before_at"), F.lit(0.0))
    value = F.when(F.col("before_at") == F.col(at), F.col("before_value")).otherwise(
        F.col("before_value") + share * (F.col("after_value") - F.col("before_value"))
    )
    return df.withColumn(out, value)


#: Events that a literal holds; longer lists are met by a scan.
LITERAL_EVENTS = 10_000


def without_event_between(df: DataFrame, events: DataFrame, event_at: str, start: str = "before_at", end: str = "after_at") -> DataFrame:
    """Rows with no event strictly inside (start, end).

    A short list of events becomes an array literal.  With a longer one each row
    meets the first event after its start in one scan over both in order of time
    (``scans.next_after``), and stays unless that lies before its end.
    """
    from tessera.operators.scans import next_after

    known = events.where(F.col(event_at).isNotNull()).select(event_at).distinct()
    times = [r[0] for r in known.limit(LITERAL_EVENTS + 1).collect()]
    if len(times) > LITERAL_EVENTS:
        met = next_after(df, known, start, event_at, out="__next")
        return met.where(~F.coalesce(F.col("__next") < F.col(end), F.lit(False))).drop("__next")
    inside = F.lit(False)
    if times:
        inside = F.exists(F.array(*[F.lit(t) for t in times]), lambda t: (t > F.col(start)) & (t < F.col(end)))
    return df.where(~F.coalesce(inside, F.lit(False)))


def align_to_canonical(canonical: DataFrame, epoch: DataFrame, key: str, order: str) -> DataFrame:
    """Left join by key after keeping the first epoch row of each key."""
    first = epoch.groupBy(key).agg(F.min_by(F.struct(*[c for c in epoch.columns if c != key]), order).alias("__row"))
    return canonical.join(first, key, "left").select(canonical["*"], "__row.*")


def reindex(calendar: DataFrame, df: DataFrame, on: str | list[str]) -> DataFrame:
    return calendar.join(df, on, "left")


def ordered_lookup(df: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """Rows of the listed keys with their place in the list as ``position``."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, k) for i, k in enumerate(wanted)], f"position int, {key} string")
    return F.broadcast(table).join(df, key)


def difference_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in one of two tables, tagged by ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def paired_difference(df: DataFrame, keys: list[str], side: str, value: str, plus: str = "plus", minus: str = "minus") -> DataFrame:
    """plus - minus per key; NULL unless each side has exactly one row."""
    pick = lambda s: F.when(F.col(side) == s, F.col(value))
    counts = [F.count_if(F.col(side) == s) for s in (plus, minus)]
    return df.groupBy(*keys).agg(
        F.when((counts[0] == 1) & (counts[1] == 1), F.max(pick(plus)) - F.max(pick(minus))).alias("difference")
    )


def hypot_difference(a: DataFrame, b: DataFrame, on: list[str], value: str, sigma: str) -> DataFrame:
    """Joined difference with its propagated error and z."""
    left = a.select(*on, F.col(value).alias("__v1"), F.col(sigma).alias("__s1"))
    right = b.select(*on, F.col(value).alias("__v2"), F.col(sigma).alias("__s2"))
    d, s = F.col("__v1") - F.col("__v2"), F.hypot("__s1", "__s2")
    return left.join(right, on).select(*on, d.alias("difference"), s.alias("sigma"), (d / F.greatest(s, F.lit(1e-12))).alias("z"))


def leave_one_out(df: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Every row paired with each held-out unit of its key other than its own.

    Output grows with rows times units per key; ``held_out`` names the unit.
    """
    units = df.select(*keys, F.col(unit).alias("held_out")).distinct()
    return df.join(units, keys).where(F.col(unit) != F.col("held_out"))


def fill_missing(observed: Column, *fallbacks: tuple[str, Column]) -> tuple[Column, Column]:
    """Value and provenance: observations are never overwritten."""
    value, source = F.coalesce(observed, *[c for _, c in fallbacks]), F.when(observed.isNotNull(), "observed")
    for name, c in fallbacks:
        source = source.when(c.isNotNull(), name)
    return value, source


def interval_table(endpoints: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Increments and rejects from start/end samples (keys, endpoint, value, sigma, method).

    A key goes to the rejects, with the reason, if an endpoint has no value.
    """
    wide = endpoints.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("endpoint") == e, F.col(c))).alias(f"{e}_{c}")
            for e in ("start", "end")
            for c in ("value", "sigma", "method")
        ]
    )
    missing = F.when(F.col("start_value").isNull(), "start").when(F.col("end_value").isNull(), "end")
    good = wide.where(missing.isNull()).select(
        *keys,
        (F.col("end_value") - F.col("start_value")).alias("increment"),
        F.hypot("start_sigma", "end_sigma").alias("sigma"),
        "start_method",
        "end_method",
    )
    return good, wide.where(missing.isNotNull()).select(*keys, F.concat(missing, F.lit(" has no sample")).alias("reason"))
