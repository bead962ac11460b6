"""Sort, limit, top-k and argmax with total orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_best(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), out: str = "selected") -> DataFrame:
    """All rows with the first one of each key flagged; ``order`` must be total."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def top_k(df: DataFrame, k: int, order: Sequence[Column], keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key; Spark limits groups before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def argmax(df: DataFrame, value: str, tie: str, keys: Sequence[str]) -> DataFrame:
    """Row of the largest value per key, the smallest ``tie`` first; one aggregation."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t")))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def one_standard_error(scores: DataFrame, bandwidth: str, rmse: str, se: str) -> DataFrame:
    """Largest bandwidth whose rmse is within one standard error of the best."""
    best = scores.agg(F.min_by(F.col(rmse) + F.col(se), F.struct(rmse, bandwidth)).alias("limit"))
    return scores.join(F.broadcast(best), F.col(rmse) <= F.col("limit")).agg(F.max(bandwidth).alias(bandwidth))


def station_circle(stations: DataFrame, lat0: float, lon0: float, count: int = 10, margin_km: float = 0.2) -> DataFrame:
    """The ``count`` stations nearest to the station that is nearest to an event.

    Adds ``distance`` and the circle's ``radius`` (largest distance plus margin).
    """
    from tessera.functions.geo import haversine_km

    centre = stations.withColumn("__d", haversine_km(F.col("lat"), F.col("lon"), lat0, lon0)).orderBy("__d", "station").limit(1)
    centre = F.broadcast(centre.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("station").alias("centre")))
    near = stations.join(centre, F.lit(True)).withColumn("distance", haversine_km(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon")))
    kept = near.orderBy("distance", "station").limit(count).drop("__lat", "__lon")
    return kept.withColumn("radius", F.max("distance").over(Window.partitionBy("centre")) + margin_km)


def reference_station(stations: DataFrame, events: Sequence[tuple[float, float]]) -> DataFrame:
    """The station whose nearest event is farthest away."""
    from tessera.functions.geo import haversine_km

    d = [haversine_km(F.col("lat"), F.col("lon"), a, b) for a, b in events]
    clear = F.least(*d) if len(d) > 1 else d[0]
    return stations.withColumn("clearance", clear).orderBy(F.desc("clearance"), "station").limit(1)


def separated(df: DataFrame, score: str, *, count: int = 10, distance: float = 8.0, tie: str = "id") -> DataFrame:
    """Greedy best-first choice of points at least ``distance`` apart.

    A round takes every point that beats all rivals within reach (they cannot
    interfere with each other), so the number of jobs follows the longest chain of
    overlapping rivals; it stops once ``count`` points are certain.
    """
    from tessera.operators.spatial import radius_join
    from tessera.runtime import cut_lineage

    better = (F.col("s_score") > F.col("t_score")) | ((F.col("s_score") == F.col("t_score")) & (F.col("s_tie") < F.col("t_tie")))
    left = cut_lineage(df.select(F.col(tie).alias("tie"), "x", "y", F.col(score).alias("score")))
    taken = None
    while not left.isEmpty():
        near = radius_join(left, left, distance).where((F.col("t_tie") != F.col("s_tie")) & (F.col("distance") < distance))
        beaten = near.where(better).select(F.col("t_tie").alias("tie")).distinct()
        won = cut_lineage(left.join(beaten, "tie", "left_anti"))
        taken = won if taken is None else taken.unionByName(won)
        covered = radius_join(left, won, distance).where(F.col("distance") < distance).select(F.col("t_tie").alias("tie")).distinct()
        left = cut_lineage(left.join(covered, "tie", "left_anti"))
        if not left.isEmpty():
            limit = left.agg(F.max("score")).first()[0]
            if taken.where(F.col("score") > limit).limit(count).count() >= count:
                break
    if taken is None:
        return left
    return taken.orderBy(F.desc("score"), "tie").limit(count).withColumnRenamed("tie", tie).withColumnRenamed("score", score)
