"""Spatial joins on an explicit grid.

Catalyst has no spatial predicates, so bins are written as columns and the
joins are equi-joins on them: radius, nearest and segment joins touch only
neighbouring cells, and skewed cells are split by adaptive execution.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import link_blocked_by_segment, link_crosses_segment, orientation, point_segment_distance, segment_triangle_distance
from tessera.runtime import cut_lineage


#: Points that every target meets directly in a nearest search; walls' cells that are broadcast.
FEW, BROADCAST_CELLS = 64, 100_000


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _around(x: Column, size: float) -> Column:
    return F.explode(F.sequence(_cell(x, size) - 1, _cell(x, size) + 1))


def radius_join(
    targets: DataFrame, samples: DataFrame, radius: float, *, xy: tuple[str, str] = ("x", "y"), keys: Sequence[str] = (), repeat: str = "targets"
) -> DataFrame:
    """All samples within ``radius`` (inclusive) of each target.

    Target columns get the prefix ``t_``, sample columns ``s_``; ``distance`` is
    added.  ``keys`` are columns both sides must share (e.g. an epoch).  The rows of
    ``repeat`` (``targets`` or ``samples``, best the fewer) go to the nine cells around
    them.  Both sides are shuffled by cell: the planner's size of a side knows neither
    that it is repeated nor how far its files are compressed, so it would broadcast
    sides of any size.
    """
    t = targets.select([F.col(c).alias(f"t_{c}") for c in targets.columns])
    s = samples.select([F.col(c).alias(f"s_{c}") for c in samples.columns])
    x, y = xy
    size = radius * (1 + 1e-9)  # so that rounding puts no neighbour two cells away
    around = lambda df, side: df.withColumn("__bx", _around(F.col(f"{side}_{x}"), size)).withColumn("__by", _around(F.col(f"{side}_{y}"), size))
    inside = lambda df, side: df.withColumns({"__bx": _cell(F.col(f"{side}_{x}"), size), "__by": _cell(F.col(f"{side}_{y}"), size)})
    t, s = (around(t, "t"), inside(s, "s")) if repeat == "targets" else (inside(t, "t"), around(s, "s"))
    on = (t["__bx"] == s["__bx"]) & (t["__by"] == s["__by"])
    for k in keys:
        on = on & (F.col(f"t_{k}") == F.col(f"s_{k}"))
    distance = F.hypot(F.col(f"t_{x}") - F.col(f"s_{x}"), F.col(f"t_{y}") - F.col(f"s_{y}"))
    return t.join(s.hint("merge"), on).drop("__bx", "__by").withColumn("distance", distance).where(F.col("distance") <= radius)


def nearest_join(
    targets: DataFrame, points: DataFrame, *, target_id: str, point_id: str, k: int = 1, cell: float = 1.0, xy: tuple[str, str] = ("x", "y"),
    within: float | None = None, digits: int | None = None,
) -> DataFrame:
    """The ``k`` nearest points of each target by (distance, id); exact.

    ``within`` leaves out points farther away (and ends the search there), with
    ``digits`` distances that agree to so many decimals are ties.

    Up to ``FEW`` points go to every target, and each picks from them.  More are
    counted in cells of size ``cell``; the first search radius is the one that holds
    somewhat more than ``k`` points at their mean density.  A target with ``k`` points
    within the radius is settled, the others go on with twice the radius, until none
    is left or it covers everything.  A round is a ``radius_join`` that repeats the
    fewer of targets and points; its results (``k`` rows a target) and the targets
    left are checkpointed, so no round repeats an earlier one.
    """
    x, y = xy
    p = points.select(F.col(point_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    left = targets.select(F.col(target_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    near_first = lambda d: d if digits is None else F.round(d, digits)
    total, cells = p.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(_cell(F.col("x"), cell), _cell(F.col("y"), cell)))).first()
    if total <= FEW:
        every = p.agg(F.collect_list(F.struct(F.col("id").alias("p_id"), F.col("x").alias("p_x"), F.col("y").alias("p_y"))).alias("__p"))
        apart = lambda q: F.hypot(F.col("x") - q["p_x"], F.col("y") - q["p_y"])
        ordered = F.transform("__p", lambda q: F.struct(near_first(apart(q)).alias("near"), q["p_id"].alias("p_id"), apart(q).alias("distance")))
        reached = F.filter(ordered, lambda q: q["distance"].isNotNull() & (q["distance"] <= (float("inf") if within is None else within)))
        best = left.join(F.broadcast(every), F.lit(True)).select("id", F.posexplode(F.slice(F.array_sort(reached), 1, k)).alias("at", "q"))
        return best.select(F.col("id").alias("t_id"), "q.p_id", "q.distance", (F.col("at") + 1).alias("rank"))
    box = p.select("x", "y").unionByName(left.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count(F.lit(1))).first()
    extent = math.hypot(*[v or 0.0 for v in box[:2]])
    waiting = box[2] - total
    density = total / (max(cells, 1) * cell * cell)
    radius = max(math.sqrt(1.4 * k / (math.pi * density)), 1e-9)
    out = None
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy(near_first(F.col("distance")), "p_id"))
    margin = 0.0 if digits is None else 10.0**-digits
    while True:
        radius = radius if within is None else min(radius, within)
        last = radius > extent or radius == within
        near = radius_join(left, p, radius, repeat="targets" if waiting <= total else "samples").withColumnRenamed("s_id", "p_id")
        ranked = cut_lineage(near.select("t_id", "p_id", "distance", rank.alias("rank")).where(F.col("rank") <= k))
        done = ranked if last else ranked.join(
            ranked.where((F.col("rank") == k) & (F.col("distance") <= radius - margin)).select("t_id").hint("merge"), "t_id", "left_semi"
        )
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = cut_lineage(left.join(done.select(F.col("t_id").alias("id")).distinct().hint("merge"), "id", "left_anti"))
        waiting = left.count()
        if not waiting:
            return out
        radius *= 2


def _cells_of_segment(df: DataFrame, a: tuple[str, str], b: tuple[str, str], size: float, reach: int = 0) -> DataFrame:
    """Every cell that the segment a-b touches, column by column: as many as its length, not as its box.

    The bounds are widened a little, so that a cell that is touched in a corner or
    along an edge is among them; ``reach`` adds that many cells on all sides.
    """
    (ax, ay), (bx, by) = ((F.col(p[0]), F.col(p[1])) for p in (a, b))
    wide = 1e-6 * size
    df = df.withColumn("__bx", F.explode(F.sequence(_cell(F.least(ax, bx) - 1e-9, size) - reach, _cell(F.greatest(ax, bx) + 1e-9, size) + reach)))
    span = F.nullif(bx - ax, F.lit(0.0))
    at = lambda x: F.coalesce(ay + F.least(F.greatest((x - ax) / span, F.lit(0.0)), F.lit(1.0)) * (by - ay), ay)
    one, two = at((F.col("__bx") - reach) * size - wide), at((F.col("__bx") + 1 + reach) * size + wide)
    low = F.when(span.isNull(), F.least(ay, by)).otherwise(F.least(one, two))
    high = F.when(span.isNull(), F.greatest(ay, by)).otherwise(F.greatest(one, two))
    return df.withColumn("__by", F.explode(F.sequence(_cell(low - 1e-9, size) - reach, _cell(high + 1e-9, size) + reach)))


def blocked_links(links: DataFrame, segments: DataFrame, link_id: Sequence[str], *, rule: str = "closed", cell: float = 8.0) -> DataFrame:
    """Distinct ids of links (x0, y0, x1, y1) that a segment (x1, y1, x2, y2) blocks.

    ``rule`` is ``closed`` (touching and overlap block) or ``open_ends`` (open at
    the link's ends, parallel lines never block).  The cells of the segments are
    counted: up to ``BROADCAST_CELLS`` go to the links' tasks, more are shuffled.
    """
    seg = segments.select(*[F.col(c).alias(f"f{c}") for c in ("x1", "y1", "x2", "y2")])
    l = _cells_of_segment(links, ("x0", "y0"), ("x1", "y1"), cell)  # noqa: E741
    s = _cells_of_segment(seg, ("fx1", "fy1"), ("fx2", "fy2"), cell)
    test = link_blocked_by_segment if rule == "closed" else link_crosses_segment
    hit = test(((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))), ((F.col("fx1"), F.col("fy1")), (F.col("fx2"), F.col("fy2"))))
    s = F.broadcast(s) if s.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else s.hint("merge")
    # One opaque predicate: split into its conjuncts it would multiply inferred constraints.
    return l.join(s, ["__bx", "__by"]).where(F.coalesce(hit, F.lit(False))).select(*link_id).distinct()


def visible_links(links: DataFrame, segments: DataFrame, link_id: Sequence[str], **options) -> DataFrame:
    return links.join(blocked_links(links, segments, link_id, **options).hint("merge"), list(link_id), "left_anti")


def segment_distance_lower_bound(targets: DataFrame, segments: DataFrame, *, target_id: str = "id", cell: float = 4.0) -> DataFrame:
    """Nearest midpoint distance minus the largest half length, at least 0.

    Infinite where there are no segments.
    """
    half = segments.agg((F.max(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / 2).alias("h")).first()[0]
    if half is None:
        return targets.select(F.col(target_id).alias("t_id"), F.lit(float("inf")).alias("bound"))
    mid = segments.select(
        F.monotonically_increasing_id().alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")
    )
    near = nearest_join(targets, mid, target_id=target_id, point_id="id", cell=cell)
    return near.select("t_id", F.greatest(F.col("distance") - half, F.lit(0.0)).alias("bound"))


def bilinear_resample(
    grid: DataFrame, targets: DataFrame, *, values: Sequence[str], target_id: str = "id", valid: str = "valid", minimum_weight: float = 0.999
) -> DataFrame:
    """Masked bilinear values at fractional (row, col) targets.

    sum(w * value) / sum(w) over valid corners, kept only where the valid weight
    is at least ``minimum_weight``; ``support`` is that weight (0 outside).
    """
    r0, c0 = F.floor("row").cast("int"), F.floor("col").cast("int")
    fr, fc = F.col("row") - r0, F.col("col") - c0
    corner = lambda dr, dc: F.struct(
        (r0 + dr).alias("r"), (c0 + dc).alias("c"), ((fr if dr else 1 - fr) * (fc if dc else 1 - fc)).alias("w")
    )
    corners = targets.select(F.col(target_id).alias("t_id"), F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("k"))
    corners = corners.select("t_id", "k.r", "k.c", "k.w").where(F.col("w") > 0)
    cells = grid.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(valid).alias("__ok"), *values)
    joined = corners.join(cells, ["r", "c"], "left")
    every = F.coalesce(F.col("__ok"), F.lit(False))
    for v in values:
        every = every & F.col(v).isNotNull()
    w = F.when(every, F.col("w")).otherwise(0.0)
    support = F.sum(w)
    return joined.groupBy("t_id").agg(
        support.alias("support"),
        *[F.when(support >= minimum_weight, F.sum(F.when(every, F.col("w") * F.col(v))) / support).alias(v) for v in values],
    )


def sector_of(dx: Column, dy: Column, sectors: int = 8) -> Column:
    two_pi = 2 * math.pi
    return F.floor(F.pmod(F.atan2(dy, dx), F.lit(two_pi)) / (two_pi / sectors)).cast("int")


def inside_hull(df: DataFrame, target: str, dx: str, dy: str) -> DataFrame:
    """(target, n, in_hull) from offsets of stations to targets.

    A target lies in the closed hull iff no gap between sorted directions exceeds
    a half turn.  Fewer than three stations or collinear ones make no hull; a
    target on a station lies in it.
    """
    at = F.col(dx).between(-1e-12, 1e-12) & F.col(dy).between(-1e-12, 1e-12)
    a = df.withColumn("__a", F.when(~at, F.atan2(dy, dx))).withColumn("__on", at)
    w = Window.partitionBy(target).orderBy(F.col("__a").asc_nulls_last())
    whole = Window.partitionBy(target)
    gap = F.coalesce(F.lead("__a").over(w), F.min("__a").over(whole) + 2 * math.pi) - F.col("__a")
    spread = a.withColumn("__gap", gap)
    sxx, syy = F.var_pop(dx), F.var_pop(dy)
    flat = sxx * syy - F.pow(F.covar_pop(dx, dy), 2) <= 1e-12 * F.greatest(sxx * syy, F.lit(1e-300))
    flat = flat | (sxx <= 1e-18) | (syy <= 1e-18)
    inside = F.bool_or("__on") | (F.max("__gap") <= math.pi + 1e-9)
    return spread.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"), (inside & (F.count(F.lit(1)) >= 3) & ~F.coalesce(flat, F.lit(True))).alias("in_hull")
    )


def adaptive_support(
    targets: DataFrame,
    stations: DataFrame,
    radii: Sequence[float],
    *,
    target_id: str = "id",
    station_id: str = "id",
    min_stations: int = 6,
    min_sectors: int = 3,
    sectors: int = 8,
    require_hull: bool = True,
    without: str | None = None,
) -> DataFrame:
    """First radius with enough stations and sectors around a target inside their hull.

    ``without`` is a target column that names a station it must not use.  Returns
    (t_id, radius, station_ids, n, sectors); targets without support are absent.
    """
    radii = sorted(radii)
    own = [] if without is None else [F.col(without).alias("without")]
    pairs = radius_join(targets.select(F.col(target_id).alias("id"), "x", "y", *own), stations.select(F.col(station_id).alias("id"), "x", "y"), radii[-1], repeat="samples")
    if without is not None:
        pairs = pairs.where(~F.col("s_id").eqNullSafe(F.col("t_without")))
    pairs = pairs.withColumns({"dx": F.col("s_x") - F.col("t_x"), "dy": F.col("s_y") - F.col("t_y")})
    tried = pairs.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii]))).where(F.col("distance") <= F.col("radius"))
    tried = tried.withColumn("key", F.struct(F.col("t_id"), F.col("radius")))
    counts = tried.groupBy("key").agg(
        F.array_sort(F.collect_list("s_id")).alias("station_ids"),
        F.size(F.collect_set(sector_of(F.col("dx"), F.col("dy"), sectors))).cast("long").alias("sectors"),
    )
    good = counts.where((F.size("station_ids") >= min_stations) & (F.col("sectors") >= min_sectors))
    if require_hull:
        hull = inside_hull(tried, "key", "dx", "dy").where("in_hull").select("key")
        good = good.join(hull, "key", "left_semi")
    first = Window.partitionBy("key.t_id").orderBy("key.radius")
    return good.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(
        "key.t_id", "key.radius", "station_ids", F.size("station_ids").alias("n"), "sectors"
    )


def interior_points(stations: DataFrame, station_id: str = "id") -> DataFrame:
    """Stations that lie inside the hull of all others (a short list: pairs are formed)."""
    a = stations.select(F.col(station_id).alias("t_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    b = stations.select(F.col(station_id).alias("s_id"), "x", "y")
    pairs = a.join(b, F.col("t_id") != F.col("s_id")).withColumns({"dx": F.col("x") - F.col("tx"), "dy": F.col("y") - F.col("ty")})
    return inside_hull(pairs, "t_id", "dx", "dy").where("in_hull").select("t_id")


def triangle_sample_points(triangles: DataFrame, spacing: float) -> DataFrame:
    """(triangle columns, px, py): lattice points inside, vertices and edge points."""
    v = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3)]
    low = [F.least(*[p[k] for p in v]) for k in (0, 1)]
    high = [F.greatest(*[p[k] for p in v]) for k in (0, 1)]
    steps = [F.sequence(F.lit(0), F.floor((high[k] - low[k]) / spacing).cast("int")) for k in (0, 1)]
    inner = triangles.withColumn("__i", F.explode(steps[0])).withColumn("__j", F.explode(steps[1]))
    inner = inner.withColumns({"px": low[0] + F.col("__i") * spacing, "py": low[1] + F.col("__j") * spacing}).drop("__i", "__j")
    p = (F.col("px"), F.col("py"))
    signs = [orientation(v[i], v[(i + 1) % 3], p) for i in range(3)]
    inner = inner.where(((signs[0] >= 0) & (signs[1] >= 0) & (signs[2] >= 0)) | ((signs[0] <= 0) & (signs[1] <= 0) & (signs[2] <= 0)))
    edges = None
    for i in range(3):
        (ax, ay), (bx, by) = v[i], v[(i + 1) % 3]
        n = F.greatest(F.ceil(F.hypot(bx - ax, by - ay) / spacing).cast("int"), F.lit(1))
        part = triangles.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        s = F.col("__k") / F.col("__n")
        part = part.withColumns({"px": ax + s * (bx - ax), "py": ay + s * (by - ay)}).drop("__n", "__k")
        edges = part if edges is None else edges.unionByName(part)
    return inner.unionByName(edges)


def point_to_segments_distance(points: DataFrame, segments: DataFrame, within: float, *, point_id: str = "id") -> DataFrame:
    """(id, distance) to the nearest segment no farther than ``within``."""
    p = points.select(F.col(point_id).alias("p_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    p = p.withColumns({"__bx": _cell(F.col("px"), within), "__by": _cell(F.col("py"), within)})
    segments = _cells_of_segment(segments, ("x1", "y1"), ("x2", "y2"), within, reach=1)
    d = point_segment_distance((F.col("px"), F.col("py")), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    return p.join(segments, ["__bx", "__by"]).groupBy("p_id").agg(F.min(d).alias("distance")).where(F.col("distance") <= within)


def triangle_to_segments_distance(triangles: DataFrame, segments: DataFrame, within: float, *, triangle_id: str = "id") -> DataFrame:
    """(id, distance) from each triangle to the nearest segment, where it is no farther than ``within``; 0 if they meet.

    Triangles and segments meet in the cells of side ``within`` that the triangle's
    edges touch or their neighbours, and in the cells of its box (which is as large
    as the triangle); the exact distance is taken of these pairs alone.
    """
    v = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3)]
    t = triangles.select(F.col(triangle_id).alias("t_id"), *[F.col(f"{c}{i}") for i in (1, 2, 3) for c in "xy"])
    for name, k in (("__bx", 0), ("__by", 1)):
        low, high = F.least(*[p[k] for p in v]), F.greatest(*[p[k] for p in v])
        t = t.withColumn(name, F.explode(F.sequence(_cell(low, within), _cell(high, within))))
    s = segments.select(*[F.col(c).alias(f"f{c}") for c in ("x1", "y1", "x2", "y2")])
    s = _cells_of_segment(s, ("fx1", "fy1"), ("fx2", "fy2"), within, reach=1)
    d = segment_triangle_distance((F.col("fx1"), F.col("fy1")), (F.col("fx2"), F.col("fy2")), tuple(v))
    return t.join(s, ["__bx", "__by"]).groupBy("t_id").agg(F.min(d).alias("distance")).where(F.col("distance") <= within)
