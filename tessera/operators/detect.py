"""Change detection on lattices: frozen baselines, innovations and clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import MAD_TO_SIGMA, quantile
from tessera.operators.graph import connected_components, spanning
from tessera.operators.quantiles import held_out_median, match_groups, order_statistics
from tessera.runtime import cut_lineage

#: Cells along a side of a tile that is labelled at once; the neighbours that every cell asks.
TILE = 256
AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


def robust_baseline(df: DataFrame, keys: Sequence[str], value: str, sigma: str, baseline: Column, least: int) -> DataFrame:
    """Frozen model per key from baseline rows with a value and a positive error.

    center, 1.4826 * MAD, median error, excess scale sqrt(max(scale^2 - error^2, 0)),
    n, supported; an unsupported model has NULL parameters.
    """
    keys = list(keys)
    rows = df.where(baseline & F.col(value).isNotNull() & (F.col(sigma) > 0)).select(*keys, F.col(value).alias("__v"), F.col(sigma).alias("__s"))
    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("__v").alias("center"), F.median("__s").alias("median_sigma"))
    spread = rows.join(first.select(*keys, "center"), keys).groupBy(*keys).agg((MAD_TO_SIGMA * F.median(F.abs(F.col("__v") - F.col("center")))).alias("scale"))
    ok = F.col("n") >= least
    excess = F.sqrt(F.greatest(F.col("scale") * F.col("scale") - F.col("median_sigma") * F.col("median_sigma"), F.lit(0.0)))
    return first.join(spread, keys).select(
        *keys,
        "n",
        ok.alias("supported"),
        *[F.when(ok, F.col(c)).alias(c) for c in ("center", "scale", "median_sigma")],
        F.when(ok, excess).alias("excess"),
    )


def standardized(df: DataFrame, model: DataFrame, keys: Sequence[str], value: str, sigma: str, out: str = "z") -> DataFrame:
    """(x - center) / sqrt(error^2 + excess^2) where the model is supported."""
    m = model.where("supported").select(*keys, F.col("center").alias("__c"), F.col("excess").alias("__e"))
    scale = F.sqrt(F.col(sigma) * F.col(sigma) + F.col("__e") * F.col("__e"))
    z = F.when(F.col(sigma) > 0, (F.col(value) - F.col("__c")) / F.nullif(scale, F.lit(0.0)))
    return df.join(m, list(keys), "left").withColumn(out, z).drop("__c", "__e")


def leave_one_out_z(df: DataFrame, keys: Sequence[str], unit: str, value: str, sigma: str, baseline: Column, least: int) -> DataFrame:
    """Baseline rows scored by the model of all other baseline rows of their key.

    A unit has one row in a key.  Without one value a median is one of three, known
    from the order statistics around the middle; the distances from each of these
    (three a key at most) are ordered once, and the median distance without a row
    follows the same way.  So work and output grow with the rows, not with rows
    times units, and no key has to fit in a task.
    """
    keys = list(keys)
    names = df.columns
    usable = baseline & F.col(value).isNotNull() & (F.col(sigma) > 0)
    used = df.where(usable).select(*keys, F.col(unit).alias("__unit"), F.col(value).cast("double").alias("__v"), F.col(sigma).cast("double").alias("__s"))
    around = lambda rows, by, column, tag: order_statistics(rows, by, column, [0.5], beside=1).withColumnsRenamed(
        {"n": f"__n{tag}", "ranks": f"__r{tag}", "values": f"__x{tag}"}
    )
    held = lambda own, tag: held_out_median(F.col(own), f"__r{tag}", f"__x{tag}", f"__n{tag}")
    rows = match_groups(used, cut_lineage(around(used, keys, "__v", "v")), keys).withColumn("center", held("__v", "v"))
    rows = match_groups(rows, cut_lineage(around(used, keys, "__s", "s")), keys).withColumn("median_sigma", held("__s", "s"))
    rows = cut_lineage(rows.select(*keys, "__unit", "__v", "__s", (F.col("__nv") - 1).alias("n"), "center", "median_sigma"))
    centers = rows.where(F.col("center").isNotNull()).select(*keys, "center").distinct().groupBy(*keys).agg(F.collect_list("center").alias("__centers"))
    apart = match_groups(used, cut_lineage(centers), keys).select(*keys, "__v", F.explode("__centers").alias("center")).withColumn("__d", F.abs(F.col("__v") - F.col("center")))
    spread = cut_lineage(around(apart, [*keys, "center"], "__d", "d"))
    rows = match_groups(rows.withColumn("__d", F.abs(F.col("__v") - F.col("center"))), spread, [*keys, "center"]).withColumn("scale", MAD_TO_SIGMA * held("__d", "d"))
    excess2 = F.greatest(F.col("scale") * F.col("scale") - F.col("median_sigma") * F.col("median_sigma"), F.lit(0.0))
    z = (F.col("__v") - F.col("center")) / F.nullif(F.sqrt(F.col("__s") * F.col("__s") + excess2), F.lit(0.0))
    scores = rows.where(F.col("n") >= least).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__unit", z.alias("z"))
    same = F.col(unit) == F.col("__unit")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    base = df.where(baseline).drop("z")
    return base.join(scores, same, "left").select(*[c for c in names if c != "z"], "z")


def lattice(df: DataFrame, east: str, north: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank-compressed row and col of each position (dense ranks of the coordinates)."""
    place = lambda c: F.dense_rank().over(Window.partitionBy(*keys).orderBy(c)) - 1
    return df.withColumns({"col": place(east), "row": place(north)})


def cell_area(df: DataFrame, east: str, north: str) -> DataFrame:
    """One row: product of the median spacings of distinct coordinates."""
    step = lambda c: (
        df.select(F.col(c).alias("v")).distinct().select((F.lead("v").over(Window.orderBy("v")) - F.col("v")).alias("d")).agg(F.median("d").alias(f"d_{c}"))
    )
    return step(east).crossJoin(step(north)).select((F.col(f"d_{east}") * F.col(f"d_{north}")).alias("cell_area"))


def _tile_labels(cells: pa.Table) -> pa.Table:
    """Cells of one tile with the smallest cell number of their 8-neighbour component in it."""
    row, col, cell = (cells.column(c).to_numpy() for c in ("row", "col", "__cell"))
    width = TILE + 2
    code = (row - row.min()) * width + (col - col.min())
    order = np.argsort(code)
    code, cell = code[order], cell[order]
    a, b = [], []
    for dr, dc in AHEAD:
        ask = code + dr * width + dc
        at = np.minimum(np.searchsorted(code, ask), len(code) - 1)
        hit = code[at] == ask
        a.append(cell[hit])
        b.append(cell[at[hit]])
    child, root = spanning(np.concatenate(a), np.concatenate(b))
    label = cell.copy()
    by_cell = np.argsort(cell)
    label[by_cell[np.searchsorted(cell, child, sorter=by_cell)]] = root
    return pa.table({"__cell": cell, "__label": label})


def cluster_cells(df: DataFrame, keys: Sequence[str], z: str, *, threshold: float = 1.96) -> DataFrame:
    """Cells with |z| >= threshold labelled by 8-neighbour component per key and sign.

    ``root`` identifies the component.  Cells are (row, col), one a key.  Each tile
    of the lattice is labelled in one Arrow pass; only cells at tile borders ask
    their neighbours in other tiles, and the labels that touch are connected.
    """
    keys = list(keys)
    hot = df.where(F.abs(F.col(z)) >= threshold).withColumn("sign", F.signum(z).cast("int")).withColumn("__cell", F.monotonically_increasing_id())
    hot = cut_lineage(hot)
    tile = lambda c: F.floor(F.col(c) / TILE)
    place = hot.select(*keys, "sign", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "__cell")
    grouped = place.withColumns({"__tr": tile("row"), "__tc": tile("col")}).groupBy(*keys, "sign", "__tr", "__tc")
    labels = cut_lineage(grouped.applyInArrow(_tile_labels, "__cell long, __label long"))
    edge = lambda c: F.pmod(F.col(c), F.lit(TILE)).isin(0, TILE - 1)
    border = cut_lineage(place.where(edge("row") | edge("col")).join(labels, "__cell"))
    ahead = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in AHEAD]))
    step = lambda c, d: F.col(c) + F.col(f"d.{d}")
    ask = border.withColumn("d", ahead).where((F.floor(step("row", "dr") / TILE) != tile("row")) | (F.floor(step("col", "dc") / TILE) != tile("col")))
    ask = ask.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("sign").alias("__sign"), step("row", "dr").alias("__row"), step("col", "dc").alias("__col"), F.col("__label").alias("a"))
    same = (F.col("sign") == F.col("__sign")) & (F.col("row") == F.col("__row")) & (F.col("col") == F.col("__col"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    touching = border.join(ask, same).select("a", F.col("__label").alias("b"))
    joined = connected_components(touching)
    roots = labels.join(joined, F.col("__label") == F.col("node"), "left").select("__cell", F.coalesce("root", "__label").alias("root"))
    return hot.join(roots, "__cell").drop("__cell")


def signed_clusters(
    df: DataFrame, keys: Sequence[str], z: str, east: str, north: str, target: str, *, threshold: float = 1.96, min_cells: int = 4, cell_km2: float = 1.0
) -> DataFrame:
    """Clusters with their cells, mass sum(|z| - threshold), peak, centroid and area, ranked by mass (then by first cell)."""
    cells = cluster_cells(df, keys, z, threshold=threshold)
    out = cells.groupBy(*keys, "sign", "root").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.abs(F.col(z)) - threshold).alias("mass"),
        F.max(F.abs(F.col(z))).alias("peak"),
        F.avg(east).alias("east"),
        F.avg(north).alias("north"),
        F.array_join(F.transform(F.array_sort(F.collect_list(target)), lambda t: t.cast("string")), ";").alias("targets"),
        F.min(F.struct("row", "col")).alias("__first"),
    ).where(F.col("n_cells") >= min_cells)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mass"), "sign", "__first"))
    return out.withColumn("area", F.col("n_cells") * cell_km2).withColumn("rank", rank).drop("root", "__first")


def maximum_cluster_mass(df: DataFrame, clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest mass per key of ``df``, 0 where there is no cluster."""
    top = clusters.groupBy(*keys).agg(F.max("mass").alias("__m"))
    return df.select(*keys).distinct().join(top, list(keys), "left").select(*keys, F.coalesce("__m", F.lit(0.0)).alias("max_mass"))


def energy(df: DataFrame, keys: Sequence[str], z: str, q: float = 0.9) -> DataFrame:
    """Quantile of |z| pooled per key."""
    return df.groupBy(*keys).agg(quantile(F.abs(F.col(z)), q).alias("energy"))
