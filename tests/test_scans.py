"""Ordered scans over range partitions against windows and plain loops."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import joins, scans, series


@pytest.fixture(scope="module")
def wide(spark):
    """One hot key, a small one and a null one, over many parts, with missing values."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    draw = random.Random(3)
    rows = [("hot" if i % 10 else ("cold" if i % 20 else None), i * 7 % 4001, round(draw.gauss(0.4, 1) * 64) / 64 if draw.random() > 0.05 else None) for i in range(4000)]
    yield spark.createDataFrame(rows, "k string, t int, x double").repartition(7).cache()
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(df, *names):
    return sorted((tuple(None if r[c] is None else r[c] for c in ("k", "t")) + tuple(None if r[c] is None else round(r[c], 9) + 0.0 for c in names) for r in df.collect()), key=str)


def test_parts_are_many_and_even(wide):
    sizes = [r["count"] for r in scans.placed(wide, ["t"], ["k"]).groupBy(scans.PART).count().collect()]
    assert len(sizes) >= 35 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def test_positions_equal_row_numbers(wide, spark):
    got = scans.positions(wide, ["t"], ["k"])
    want = wide.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1)
    assert table(got, "position") == table(want, "position")
    everything = scans.positions(wide, [F.col("t").desc()])
    assert sorted(r.position for r in everything.collect()) == list(range(4000)) and everything.where("position = 0").first().t == 4000
    named = scans.positions(wide.withColumns({"__part": F.lit(1), "__at": F.lit(2), "__key_0": F.lit(3)}), ["t"], ["k"], per_key=spark.createDataFrame([("hot", 5), (None, 6)], "k string, w int"))
    assert {(r.k, r.w, r["__part"], r["__at"], r["__key_0"]) for r in named.collect()} == {("hot", 5, 1, 2, 3), ("cold", None, 1, 2, 3), (None, 6, 1, 2, 3)}
    assert scans.positions(wide.limit(0), ["t"]).count() == 0


def test_positions_of_equal_rows_are_a_permutation(spark):
    same = spark.range(500).select(F.lit(1).alias("t"))
    assert sorted(r.position for r in scans.positions(same, ["t"]).collect()) == list(range(500))


@pytest.mark.parametrize("keys", [["k"], []])
def test_scans_equal_windows(wide, keys):
    known = wide.withColumn("x", F.coalesce("x", F.lit(0.0)))
    assert table(scans.page_cusum(known, "x", ["t"], keys), "cusum") == table(series.page_cusum(known, "x", "t", keys), "cusum")
    assert table(scans.strict_cumulative(wide, "x", ["t"], keys), "cumulative") == table(series.strict_cumulative(wide, "x", "t", keys), "cumulative")
    late = wide.withColumn("x", F.when(F.col("t") < 3000, F.coalesce("x", F.lit(1.0))).otherwise(F.col("x")))
    strict = scans.strict_cumulative(late, "x", ["t"], keys)
    assert table(strict, "cumulative") == table(series.strict_cumulative(late, "x", "t", keys), "cumulative") and strict.where("cumulative is null").count() > 500
    names = ("prefix_n", "prefix_x", "prefix_xx")
    assert table(scans.prefix_sums(wide, "x", ["t"], keys), *names) == table(series.prefix_sums(wide, "x", "t", keys), *names)
    got, want = (f(wide, "x", t, keys, 20, 3).collect() for f, t in ((scans.best_mean_shift, "t"), (series.best_mean_shift, "t")))
    assert [(r.split, round(r.reduction, 6)) for r in sorted(got, key=str)] == [(r.split, round(r.reduction, 6)) for r in sorted(want, key=str)]


def test_bracket_equals_the_window_form(wide):
    left = wide.select("k", (F.col("t") * 1.37 - 20).cast("int").alias("t")).unionByName(wide.limit(3).select("k", F.lit(None).cast("int").alias("t")))
    right = wide.where("x is not null and k is not null")
    names = ("before_at", "before_value", "after_at", "after_value")
    known = left.where("t is not null and k is not null")
    assert table(scans.bracket(known, right, "t", "x", ["k"]), *names) == table(joins.bracket(known, right, ["k"], "t", "x"), *names)
    whole = scans.bracket(left, wide.where("x is not null"), "t", "x")
    points = sorted((r.t, r.x) for r in wide.where("x is not null").collect())
    for r in whole.collect():
        before = [p for p in points if r.t is not None and p[0] <= r.t][-1:]
        after = [p for p in points if r.t is not None and p[0] >= r.t][:1]
        assert (r.before_at, r.before_value) == (before[0] if before else (None, None)) and (r.after_at, r.after_value) == (after[0] if after else (None, None))


def test_running_sum_keeps_leading_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7)], "t int, x int")
    assert [r.running for r in scans.running_sum(rows, "x", ["t"]).orderBy("t").collect()] == [None, 5, 5, 12]
