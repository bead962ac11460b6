"""Ordered scans over range partitions: no key has to fit in one task.

A window sorts all rows of a key (without keys: the whole table) in one task.
Here rows are dealt out by ranges of (keys, order) and sorted within each part;
a part is scanned alone, what it leaves behind is one row a part and key, and
those few rows are scanned to give each part what came before it.  The parts are
checkpointed, so both readings see the same ranges, also after a lost executor.

``order`` should tell rows apart: rows equal in it (and in the keys) are put in
any order, and all fall in one part.  Null keys are a key of their own.
``positions`` takes tables with columns of any names; for the scans with values,
names that begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut_lineage, fresh

PART, AT = "__part", "__at"
#: Bits of the place in ``monotonically_increasing_id``; the part number stands above them.
_ROWS = 33
#: Carried rows (one a part and key) are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000


def placed(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), part: str = PART, at: str = AT) -> DataFrame:
    """``df`` in parts by ranges of (keys, order), with part number and place in the part."""
    by = [*keys, *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    return cut_lineage(dealt).withColumn(part, F.shiftright(at, _ROWS))


def _join_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], *, small: bool = False) -> DataFrame:
    """Left join on equal or both null ``keys``, which ``right`` has once; a small right side is broadcast."""
    names = {k: fresh([*left.columns, *right.columns], f"__key_{i}") for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(F.broadcast(right) if small or not same else right, same or F.lit(True), "left").drop(*names.values())


def _join_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str], part: str = PART) -> DataFrame:
    """The rows with what their part and key got; a join on both never gathers more than a part."""
    carried = cut_lineage(carried)
    return _join_keyed(rows, carried, [part, *keys], small=carried.count() <= BROADCAST_ROWS)


def positions(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), out: str = "position", per_key: DataFrame | None = None
) -> DataFrame:
    """``df`` with the 0-based place of each row in the order of its key.

    ``per_key``, a table with a row a key, brings its other columns along: they are
    joined with the parts' counts, so that no key's rows meet in one task for them.
    """
    keys, taken = list(keys), [*df.columns, *(per_key.columns if per_key is not None else [])]
    part, at, first, n, shift = (fresh(taken, c) for c in (PART, AT, "__first", "__n", "__shift"))
    rows = placed(df, order, keys, part, at)
    ends = rows.groupBy(part, *keys).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(part, *keys, (F.coalesce(F.sum(n).over(earlier), F.lit(0)) - F.col(first)).alias(shift))
    if per_key is not None:
        carried = _join_keyed(carried, per_key, keys)
    return _join_carried(rows, carried, keys, part).withColumn(out, F.col(at) + F.col(shift)).drop(part, at, shift)


def scan(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str],
    local: Sequence[dict[str, Callable[[Window], Column]]],
    carry: Sequence[dict[str, Callable[[Window], Column]]],
    out: dict[str, Column],
    per_key: DataFrame | None = None,
) -> DataFrame:
    """The general scan: ``df`` with the columns ``out``, and those of ``per_key`` (see ``positions``).

    ``local`` are window expressions over a part's rows up to the current one;
    ``carry`` are window expressions over the earlier parts' last local values;
    each is a list of steps, so that a step may use columns of the one before.
    ``out`` joins both.  Where nothing came before, carried columns are null.
    """
    keys = list(keys)
    rows = placed(df, order, keys)
    upto = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    for step in local:
        rows = rows.withColumns({n: f(upto) for n, f in step.items()})
    kept = [n for step in local for n in step]
    ends = rows.groupBy(PART, *keys).agg(F.max_by(F.struct(*kept), AT).alias("__end")).select(PART, *keys, "__end.*")
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    for step in carry:
        ends = ends.withColumns({n: f(earlier) for n, f in step.items()})
    before = [n for step in carry for n in step]
    ends = ends.select(PART, *keys, *before)
    if per_key is not None:
        ends = _join_keyed(ends, per_key, keys)
    joined = _join_carried(rows, ends, keys)
    return joined.withColumns(out).drop(PART, AT, *kept, *before)


def running_sum(df: DataFrame, value: str | Column, order: Sequence[str | Column], keys: Sequence[str] = (), out: str = "running") -> DataFrame:
    """Sum of all values up to each row; null until the first value."""
    value = F.col(value) if isinstance(value, str) else value
    local = [{"__s": lambda w: F.sum(value).over(w)}]
    carry = [{"__s0": lambda w: F.sum("__s").over(w)}]
    both = F.when(F.col("__s").isNotNull() | F.col("__s0").isNotNull(), F.coalesce("__s", F.lit(0)) + F.coalesce("__s0", F.lit(0)))
    return scan(df, order, keys, local, carry, {out: both})


def page_cusum(df: DataFrame, value: str, order: Sequence[str | Column], keys: Sequence[str] = (), reference: float = 0.5, out: str = "cusum") -> DataFrame:
    """Positive Page CUSUM max(0, C + x - k) over series of any length.

    A part leaves its sum and its smallest prefix sum; the smallest prefix of all
    earlier parts is the least of theirs, each lifted by the sums before it.
    """
    local = [{"__s": lambda w: F.sum(F.col(value) - reference).over(w)}, {"__low": lambda w: F.min("__s").over(w)}]
    carry = [
        {"__s0": lambda w: F.coalesce(F.sum("__s").over(w), F.lit(0.0))},
        {"__low0": lambda w: F.min(F.col("__low") + F.col("__s0")).over(w)},
    ]
    lowest = F.least(F.lit(0.0), F.col("__low0"), F.col("__low") + F.col("__s0"))
    return scan(df, order, keys, local, carry, {out: F.coalesce("__s", F.lit(0.0)) + F.col("__s0") - lowest})


def strict_cumulative(df: DataFrame, value: str, order: Sequence[str | Column], keys: Sequence[str] = (), out: str = "cumulative") -> DataFrame:
    """Running sum until the first missing increment, null from there on."""
    local = [{"__s": lambda w: F.sum(value).over(w), "__gone": lambda w: F.count_if(F.col(value).isNull()).over(w)}]
    carry = [{"__s0": lambda w: F.sum("__s").over(w), "__gone0": lambda w: F.sum("__gone").over(w)}]
    whole = F.col("__gone") + F.coalesce("__gone0", F.lit(0)) == 0
    return scan(df, order, keys, local, carry, {out: F.when(whole, F.col("__s") + F.coalesce("__s0", F.lit(0)))})


def prefix_sums(df: DataFrame, value: str, order: Sequence[str | Column], keys: Sequence[str] = (), per_key: DataFrame | None = None) -> DataFrame:
    """Count, sum and sum of squares of the values up to each row."""
    x = F.col(value)
    local = [{"__n": lambda w: F.count(x).over(w), "__x": lambda w: F.sum(x).over(w), "__xx": lambda w: F.sum(x * x).over(w)}]
    carry = [{f"{c}0": (lambda w, c=c: F.sum(c).over(w)) for c in ("__n", "__x", "__xx")}]
    plus = lambda c: F.when(F.col(c).isNotNull() | F.col(f"{c}0").isNotNull(), F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}0", F.lit(0)))
    return scan(df, order, keys, local, carry, {"prefix_n": plus("__n"), "prefix_x": plus("__x"), "prefix_xx": plus("__xx")}, per_key)


def best_mean_shift(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), min_before: int = 20, min_after: int = 3) -> DataFrame:
    """(keys, split, reduction): the split with the largest drop in squared error, of series of any length.

    ``split`` is the first row of the later part; of equal drops the earliest counts.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, order, value)
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"), F.sum(value).alias("__sum"))
    # The sums before a row are those up to it without the row itself, so no row ahead is needed.
    p = prefix_sums(rows, value, [order], keys, per_key=whole)
    n1, s1 = F.col("prefix_n") - 1, F.col("prefix_x") - F.col(value)
    n, n2 = F.col("__all"), F.col("__all") - n1
    drop = n1 * n2 / n * F.pow((F.col("__sum") - s1) / n2 - s1 / n1, 2)
    q = p.where((n1 >= min_before) & (n2 >= min_after)).select(*keys, F.col(order).alias("split"), n1.alias("__n1"), drop.alias("reduction"))
    best = F.max_by(F.struct("split", "reduction"), F.struct("reduction", -F.col("__n1"))).alias("b")
    return q.groupBy(*keys).agg(best).select(*keys, "b.split", "b.reduction")


def _last_before(df: DataFrame, seen: Column, order: Sequence[Column], keys: Sequence[str], out: str) -> DataFrame:
    local = [{"__last": lambda w: F.last(seen, True).over(w)}]
    carry = [{"__last0": lambda w: F.last("__last", True).over(w)}]
    return scan(df, order, keys, local, carry, {out: F.coalesce("__last", "__last0")})


def bracket(left: DataFrame, right: DataFrame, at: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Both as-of neighbours of each left row among the right rows of its key, however many.

    Adds before_at, before_value, after_at, after_value: the last right row at or
    before, and the first at or after.  Null ``at`` has no neighbour.
    """
    keys = list(keys)
    tagged = left.withColumns({"__kind": F.lit(1), "__v": F.lit(None).cast("double")}).unionByName(
        right.where(F.col(at).isNotNull()).select(*keys, at, F.col(value).cast("double").alias("__v")).withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    seen = F.when(F.col("__kind") == 0, F.struct(F.col(at).alias("at"), F.col("__v").alias("v")))
    back = _last_before(tagged, seen, [F.col(at).asc_nulls_first(), F.col("__kind").asc()], keys, "__b")
    both = _last_before(back, seen, [F.col(at).desc_nulls_first(), F.col("__kind").asc()], keys, "__a").where(F.col("__kind") == 1)
    side = lambda c, f: F.col(f"__{c}.{f}")
    return both.select(
        *left.columns,
        side("b", "at").alias("before_at"),
        side("b", "v").alias("before_value"),
        side("a", "at").alias("after_at"),
        side("a", "v").alias("after_value"),
    )


def next_after(df: DataFrame, events: DataFrame, at: str, event_at: str, out: str = "next") -> DataFrame:
    """``df`` with the first event strictly later than ``at``, of any number of events; null if there is none."""
    tagged = df.withColumns({"__kind": F.lit(0), "__t": F.col(at)}).unionByName(
        events.where(F.col(event_at).isNotNull()).select(F.col(event_at).alias("__t")).withColumn("__kind", F.lit(1)), allowMissingColumns=True
    )
    # Backwards in time a row comes before the events of its own time, so it meets only later ones.
    seen = F.when(F.col("__kind") == 1, F.col("__t"))
    met = _last_before(tagged, seen, [F.col("__t").desc_nulls_first(), F.col("__kind").asc()], [], out)
    return met.where(F.col("__kind") == 0).select(*df.columns, out)
