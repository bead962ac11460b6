"""Ordered-series operators as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import plus_one_p
from tessera.runtime import cut_lineage


def _w(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def page_cusum(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), reference: float = 0.5, out: str = "cusum") -> DataFrame:
    """Positive Page CUSUM max(0, C + x - k) in closed form.

    With S the running sum of x - k, C = S - min(0, running minimum of S).
    """
    upto = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("__s", F.sum(F.col(value) - reference).over(upto))
    return s.withColumn(out, F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(upto))).drop("__s")


def sliding_block_maximum(df: DataFrame, value: str, order: str, length: int, keys: Sequence[str] = (), out: str = "block_max") -> DataFrame:
    """Maximum of every full block of ``length`` rows, at the block's first row."""
    ahead = _w(keys, order).rowsBetween(0, length - 1)
    blocks = df.withColumns({out: F.max(value).over(ahead), "__n": F.count(F.lit(1)).over(ahead)})
    return blocks.where(F.col("__n") == length).drop("__n")


def sliding_block_cusum(
    df: DataFrame, value: str, order: str, length: int, keys: Sequence[str] = (), reference: float = 0.5, out: str = "block_cusum"
) -> DataFrame:
    """Largest Page CUSUM within every full block, restarted in each."""
    ahead = _w(keys, order).rowsBetween(0, length - 1)
    blocks = df.withColumn("__block", F.collect_list(value).over(ahead)).where(F.size("__block") == length)
    step = F.aggregate(
        "__block",
        F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("top")),
        lambda acc, x: F.struct(
            F.greatest(F.lit(0.0), acc["c"] + x - reference).alias("c"),
            F.greatest(acc["top"], acc["c"] + x - reference).alias("top"),
        ),
        lambda acc: acc["top"],
    )
    return blocks.withColumn(out, step).drop("__block")


def empirical_p(null: DataFrame, observed: DataFrame, null_value: str, value: str, out: str = "p") -> DataFrame:
    """Upper-tail plus-one p of each observed row against all null rows.

    Both sides are range-partitioned by value together; a window counts within
    each partition and the counts of the partitions before it are added, so no
    pair is formed and no task sorts everything.
    """
    ask = cut_lineage(observed.withColumn("__id", F.monotonically_increasing_id()))
    known = null.where(F.col(null_value).isNotNull()).select(F.col(null_value).cast("double").alias("__v"), F.lit(None).cast("long").alias("__id"))
    tagged = known.unionByName(ask.select(F.col(value).cast("double").alias("__v"), "__id")).repartitionByRange(F.col("__v").desc())
    placed = cut_lineage(tagged.withColumn("__p", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in placed.groupBy("__p").agg(F.count_if(F.col("__id").isNull())).collect()}  # a row per partition
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    offsets = F.broadcast(placed.sparkSession.createDataFrame(before, "__p int, __before long"))
    ahead = Window.partitionBy("__p").orderBy(F.col("__v").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("__ge", F.count_if(F.col("__id").isNull()).over(ahead)).where(F.col("__id").isNotNull())
    ranked = ranked.join(offsets, "__p").select("__id", (F.col("__ge") + F.col("__before")).alias("__ge"))
    return ask.join(ranked, "__id").withColumn(out, plus_one_p(F.col("__ge"), F.lit(total))).drop("__id", "__ge")


def holm_adjust(df: DataFrame, p: str, keys: Sequence[str] = (), out: str = "p_holm", tie: str | None = None) -> DataFrame:
    """Step-down adjustment: running maximum of (m - rank) * p, at most 1."""
    order = [F.col(p)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    step = df.withColumn("__q", (m - F.row_number().over(w) + 1) * F.col(p))
    run = F.max("__q").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn(out, F.least(F.lit(1.0), run)).drop("__q")


def strict_cumulative(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), out: str = "cumulative") -> DataFrame:
    """Running sum until the first missing increment, NULL from there on."""
    upto = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    missing = F.count_if(F.col(value).isNull()).over(upto)
    return df.withColumn(out, F.when(missing == 0, F.sum(value).over(upto)))


def prefix_sums(df: DataFrame, value: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    upto = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    return df.withColumns({"prefix_n": F.count(x).over(upto), "prefix_x": F.sum(x).over(upto), "prefix_xx": F.sum(x * x).over(upto)})


def best_mean_shift(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), min_before: int = 20, min_after: int = 3) -> DataFrame:
    """(keys, split, reduction): the split with the largest drop in squared error.

    From prefix sums alone: n1*n2/n * (mean difference)^2 at every split.
    """
    p = prefix_sums(df.where(F.col(value).isNotNull()), value, order, keys)
    whole = Window.partitionBy(*keys)
    n, s = F.count(F.lit(1)).over(whole), F.sum(value).over(whole)
    n1, s1 = F.col("prefix_n"), F.col("prefix_x")
    # The split is the first row of the later part.
    q = p.withColumns({"__n2": n - n1, "__m1": s1 / n1, "__m2": (s - s1) / F.nullif(n - n1, F.lit(0)), "split": F.lead(order).over(_w(keys, order))})
    q = q.where((n1 >= min_before) & (F.col("__n2") >= min_after)).withColumn(
        "reduction", n1 * F.col("__n2") / (n1 + F.col("__n2")) * F.pow(F.col("__m2") - F.col("__m1"), 2)
    )
    best = F.max_by(F.struct("split", "reduction"), F.struct("reduction", F.struct(-F.col("prefix_n")))).alias("b")
    return q.groupBy(*keys).agg(best).select(*keys, "b.split", "b.reduction")


def keep_full_groups(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows; ``group_count`` is added."""
    return df.withColumn("group_count", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("group_count") >= least)


def credible_interval(df: DataFrame, probability: str, order: str, keys: Sequence[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(keys, ci_low, ci_high, mode): first ordered value at which the cumulative probability reaches each bound."""
    upto = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    c = df.withColumn("__c", F.sum(probability).over(upto) / F.sum(probability).over(Window.partitionBy(*keys)))
    at = lambda q: F.coalesce(F.min(F.when(F.col("__c") >= q - 1e-12, F.col(order))), F.max(order))
    return c.groupBy(*keys).agg(at(low).alias("ci_low"), at(high).alias("ci_high"), F.max_by(order, F.struct(F.col(probability), F.col("__c"))).alias("mode"))


def first_differences(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), out: str = "difference") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(_w(keys, order)))


def greedy_intervals(df: DataFrame, date: str, keys: Sequence[str] = (), length: int = 12, gap: int = 12) -> DataFrame:
    """Non-overlapping (start, end) pairs exactly ``length`` days apart, scanned in order.

    A pair is accepted if it starts at least ``gap`` days after the last accepted
    end.  One key's dates are folded in one array; dates are at most one a day.
    """
    days = F.array_sort(F.collect_set(F.datediff(F.col(date), F.lit("1970-01-01"))))
    empty = F.array().cast("array<int>")
    fold = lambda d: F.aggregate(
        d,
        F.struct(empty.alias("kept"), F.lit(-(1 << 30)).alias("last")),
        lambda acc, x: F.when(
            F.array_contains(d, x + length) & (x >= acc["last"] + gap),
            F.struct(F.array_append(acc["kept"], x).alias("kept"), (x + length).alias("last")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    grouped = df.groupBy(*keys).agg(days.alias("__d"))
    starts = grouped.select(*keys, F.explode(fold(F.col("__d"))).alias("__s"))
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c)
    return starts.select(*keys, day(F.col("__s")).alias("start_date"), day(F.col("__s") + length).alias("end_date"))


def block_resample(df: DataFrame, value: str, order: str, replicates: int, block: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, replicate, position, value): concatenated random blocks of the series.

    Block starts are a hash of (seed, keys, replicate, block number), so the result
    does not depend on partitioning.
    """
    p = df.withColumn("__i", F.row_number().over(_w(keys, order)) - 1)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    plan = n.select(*keys, "__n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    plan = plan.withColumn("position", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    number, offset = F.floor(F.col("position") / block), F.col("position") % block
    first = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], F.col("replicate"), number), F.greatest(F.col("__n") - block + 1, F.lit(1)))
    plan = plan.withColumn("__i", (first + offset).cast("int"))
    return plan.join(p.select(*keys, "__i", F.col(value).alias("value")), [*keys, "__i"]).select(*keys, "replicate", "position", "value")


def local_mean(grid: DataFrame, value: str, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Box means of an odd ``size`` over finite cells, and the covered fraction.

    Adds local_mean and coverage to every row; absent cells and missing values
    count as missing.  Each cell adds its value to the cells of its box, in two
    steps (along rows, then along columns), so a task needs no neighbours and
    cells that are absent from the table still pass values on.
    """
    h = size // 2
    shift = F.explode(F.sequence(F.lit(-h), F.lit(h)))
    own = [F.col(k) for k in keys]
    cells = grid.where(F.col(value).isNotNull()).select(*own, F.col("row").alias("__row"), F.col("col").alias("__col"), F.col(value).alias("__x"))
    along = cells.groupBy(*keys, "__row", "__col").agg(F.sum("__x").alias("__s"), F.count("__x").alias("__n"))
    for axis in ("__col", "__row"):
        spread = along.withColumn("__d", shift).withColumn(axis, F.col(axis) + F.col("__d"))
        along = spread.groupBy(*keys, "__row", "__col").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    box = along.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__row", "__col", "__s", "__n")
    on = (F.col("row") == F.col("__row")) & (F.col("col") == F.col("__col"))
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = grid.join(box, on, "left").withColumns(
        {"local_mean": F.try_divide("__s", F.col("__n")), "coverage": F.coalesce("__n", F.lit(0)) / (size * size)}
    )
    return out.select(*grid.columns, "local_mean", "coverage")


def prewhiten(df: DataFrame, value: str, order: str, rho: float | Column, keys: Sequence[str] = (), out: str = "whitened") -> DataFrame:
    """AR(1): first row times sqrt(1 - rho^2), then x - rho * previous."""
    r = rho if isinstance(rho, Column) else F.lit(float(rho))
    before = F.lag(value).over(_w(keys, order))
    first = F.row_number().over(_w(keys, order)) == 1
    return df.withColumn(out, F.when(first, F.sqrt(1 - r * r) * F.col(value)).otherwise(F.col(value) - r * before))


def lag_one_coefficient(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), limit: float = 0.8) -> DataFrame:
    """Regression of residuals on their predecessors, clipped."""
    d = df.withColumn("__b", F.lag(value).over(_w(keys, order))).where(F.col("__b").isNotNull())
    rho = F.sum(F.col(value) * F.col("__b")) / F.nullif(F.sum(F.col("__b") * F.col("__b")), F.lit(0.0))
    return d.groupBy(*keys).agg(F.coalesce(F.least(F.greatest(rho, F.lit(-limit)), F.lit(limit)), F.lit(0.0)).alias("rho"))


def matched_filter(residual: DataFrame, templates: DataFrame, dof: int, *, time: str = "t", unit: str = "patch", template: str = "template") -> DataFrame:
    """score^2 / ((SSE - score^2) / dof) for every unit and unit-norm template."""
    sse = residual.groupBy(unit).agg(F.sum(F.col("r") * F.col("r")).alias("sse"))
    score = residual.join(templates, time).groupBy(unit, template).agg(F.sum(F.col("r") * F.col("g")).alias("score"))
    ss = F.col("score") * F.col("score")
    return score.join(sse, unit).withColumn("statistic", F.when(F.col("sse") > ss, ss / ((F.col("sse") - ss) / dof)))
