"""Sampling nodes along mapped traces and paired points on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import covariance_2x2_eigen, quantile, weighted_covariance


def densify(segments: DataFrame, keys: list[str], step: float = 1.0) -> DataFrame:
    """(keys, x, y, w): midpoints of pieces no longer than ``step``, weighted by length."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = segments.withColumn("__l", F.hypot(dx, dy)).where("__l > 1e-5").withColumn("__n", F.greatest(F.ceil(F.col("__l") / step), F.lit(1)))
    s = s.withColumn("__f", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda i: (i + 0.5) / F.col("__n"))))
    return s.select(*keys, (F.col("x1") + F.col("__f") * dx).alias("x"), (F.col("y1") + F.col("__f") * dy).alias("y"), (F.col("__l") / F.col("__n")).alias("w"))


def _axis(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted centre and main axis of each group; ``n`` rows."""
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[v.alias(f"__{k}") for k, v in weighted_covariance(F.col("x"), F.col("y"), F.col("w")).items()])
    angle = F.radians(covariance_2x2_eigen(F.col("__cov_xx"), F.col("__cov_xy"), F.col("__cov_yy"))["angle"])
    return g.select(*keys, "n", F.col("__mean_x").alias("ox"), F.col("__mean_y").alias("oy"), F.cos(angle).alias("ax"), F.sin(angle).alias("ay"))


def trace_nodes(segments: DataFrame, label: str = "label", *, spacing: float = 5.0, step: float = 1.0, prefix: Column | None = None) -> DataFrame:
    """Nodes every ``spacing`` along each label's main axis, from its 1 % to its 99 % quantile.

    A node is the weighted centre of the pieces within half a spacing of its place;
    its tangent is their main axis (the label's, if there is one piece only), turned
    the label's way, which points north.  Places without a piece keep their number.
    """
    pieces = densify(segments, [label], step)
    whole = _axis(pieces, [label]).drop("n")
    turn = F.when(F.col("ay") < 0, -1.0).otherwise(1.0)
    whole = whole.withColumns({"gx": turn * F.col("ax"), "gy": turn * F.col("ay")}).drop("ax", "ay")
    placed = pieces.join(whole, label).withColumn("along", (F.col("x") - F.col("ox")) * F.col("gx") + (F.col("y") - F.col("oy")) * F.col("gy"))
    ends = placed.groupBy(label).agg(quantile(F.col("along"), [0.01, 0.99]).alias("__q")).select(
        label, F.ceil(F.col("__q")[0] / spacing).alias("__k0"), F.floor(F.col("__q")[1] / spacing).alias("__k1")
    )
    near = F.floor(F.col("along") / spacing)
    hits = placed.join(ends, label).withColumn("__k", F.explode(F.array(near, near + 1)))
    hits = hits.where(F.col("__k").between(F.col("__k0"), F.col("__k1")) & (F.abs(F.col("along") - F.col("__k") * spacing) <= spacing / 2))
    hits = hits.withColumn("seq", F.col("__k") - F.col("__k0") + 1)
    local = _axis(hits, [label, "seq"]).join(whole.select(label, "gx", "gy"), label)
    single = F.col("n") == 1
    forward = F.when(F.col("ax") * F.col("gx") + F.col("ay") * F.col("gy") < 0, -1.0).otherwise(1.0)
    tx, ty = F.when(single, F.col("gx")).otherwise(forward * F.col("ax")), F.when(single, F.col("gy")).otherwise(forward * F.col("ay"))
    name = F.concat(prefix if prefix is not None else F.col(label), F.lpad(F.col("seq").cast("string"), 2, "0"))
    name = F.when(F.col("seq") < 100, name).otherwise(F.concat(prefix if prefix is not None else F.col(label), F.col("seq").cast("string")))
    bearing = F.pmod(F.degrees(F.atan2(F.col("gx"), F.col("gy"))) + 360, F.lit(360.0))
    return local.select(
        label, name.alias("node_id"), F.col("ox").alias("x"), F.col("oy").alias("y"), bearing.alias("bearing"), tx.alias("tx"), ty.alias("ty"), (-ty).alias("nx"), tx.alias("ny")
    )


def side_points(nodes: DataFrame, offset: float = 2.0) -> DataFrame:
    """Two points a node, ``offset`` to either side along its normal."""
    sides = F.explode(F.array(F.struct(F.lit("minus").alias("side"), F.lit(-offset).alias("d")), F.struct(F.lit("plus").alias("side"), F.lit(offset).alias("d"))))
    p = nodes.withColumn("__s", sides)
    d = F.col("__s.d")
    return p.select(
        F.concat_ws("_", "node_id", "__s.side").alias("point_id"), "node_id", F.col("__s.side").alias("side"), d.alias("offset"),
        (F.col("x") + d * F.col("nx")).alias("x"), (F.col("y") + d * F.col("ny")).alias("y"),
    )
