"""Order statistics, held-out models and tiled clusters against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import detect, quantiles


def test_order_statistics_of_any_size_and_value(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = {
        "a": rng.standard_normal(900), "inf": np.r_[np.arange(300.0), [np.inf] * 40, [-np.inf] * 3], "nan": np.r_[rng.uniform(0, 1, 200), [np.nan] * 150], "wide": np.r_[[-1.7e308, 1.7e308], rng.standard_normal(300)],
        "ties": np.repeat([1.0, 2.0, 3.0], [10, 900, 20]), "one": np.array([4.0]), "two": np.array([np.nan, 1.0]), None: np.exp(50 * rng.standard_normal(500)),
    }
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("a", None), ("none", None)], "k string, v double")
    qs = [0.0, 0.05, 0.5, 0.98]
    for most, slack in ((quantiles.MOST, 3), (20, 3), (20, 0)):  # without slack the sketch may miss, and the group is counted whole
        monkeypatch.setattr(quantiles, "SLACK", slack)
        got = {r.k: r for r in quantiles.order_statistics(df, ["k"], "v", qs, beside=1, most=most).collect()}
        assert got.keys() == data.keys()
        for k, x in data.items():
            x = np.sort(x)
            n = len(x)
            ranks = sorted({r for q in qs for r in range(max(0, math.floor(q * (n - 1)) - 1), min(n - 1, math.ceil(q * (n - 1)) + 1) + 1)})
            assert got[k].n == n and got[k].ranks == ranks, k
            assert np.array_equal(np.array(got[k]["values"]), x[ranks], equal_nan=True), (k, most)
    whole = quantiles.order_statistics(df.where("k = 'a'"), [], "v", [0.5], most=20).first()
    assert whole.n == 900 and quantiles.order_statistics(df.limit(0), ["k"], "v", [0.5]).count() == 0
    q = {r.k: r["quantile"] for r in quantiles.grouped_quantile(df, ["k"], "v", 0.999, most=20).collect()}
    assert q["inf"] == math.inf and math.isnan(q["nan"]) and q["one"] == 4.0


def test_quantiles_of_measures_and_levels_in_one_go(spark):
    rng = np.random.default_rng(9)
    rows = [("xy"[i % 2], i % 3, float(a), float(b)) for i, (a, b) in enumerate(rng.standard_normal((400, 2)))]
    df = spark.createDataFrame(rows, "k string, g int, a double, b double")
    out = quantiles.quantile_table(df, [["k", "g"], ["k"], []], ["a", "b"], [0.1, 0.5], most=50).collect()
    assert len(out) == 2 * (6 + 2 + 1)
    for r in out:
        v = [x[2 + "ab".index(r.measure)] for x in rows if r.k in (None, x[0]) and r.g in (None, x[1])]
        assert r.level == (r.k is None) + (r.g is None) and r.n == len(v) and r.quantiles == pytest.approx(list(np.quantile(v, [0.1, 0.5])))


def test_held_out_models_equal_refits(spark):
    rng = random.Random(4)
    rows = []
    for k, n in (("even", 14), ("odd", 15), ("ties", 12), ("few", 4), ("one", 1), (None, 9)):
        for day in range(n):
            x = rng.choice([1.0, 2.0, 2.5]) if k == "ties" else rng.gauss(0, 2)
            rows.append((k, day, None if k == "odd" and day == 3 else x, -1.0 if k == "even" and day == 2 else rng.uniform(0.1, 3), day < n - 1 or n < 5))
    df = spark.createDataFrame(rows, "k string, day int, x double, s double, early boolean")
    got = {(r.k, r.day): r.z for r in detect.leave_one_out_z(df, ["k"], "day", "x", "s", F.col("early"), 4).collect()}
    base = [r for r in rows if r[4]]
    assert got.keys() == {(r[0], r[1]) for r in base}
    for k, day, x, s, _ in base:
        others = [(r[2], r[3]) for r in base if r[0] == k and r[1] != day and r[2] is not None and r[3] > 0]
        if x is None or s <= 0 or len(others) < 4:
            assert got[k, day] is None
            continue
        v, e = (np.array(c) for c in zip(*others, strict=True))
        c = np.median(v)
        scale, ms = 1.4826 * np.median(np.abs(v - c)), np.median(e)
        assert got[k, day] == pytest.approx((x - c) / math.sqrt(s * s + max(scale**2 - ms**2, 0)), rel=1e-9), (k, day)


@pytest.mark.parametrize("tile", [1, 3, 256])
def test_clusters_do_not_depend_on_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(detect, "TILE", tile)
    rng = np.random.default_rng(5)
    cells = [(k, r, c, float(rng.normal(0, 2))) for k in ("p", None) for r in range(-4, 14) for c in range(17) if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "k string, row int, col int, z double")
    got = {}
    for r in detect.cluster_cells(df, ["k"], "z", threshold=1.0).collect():
        got.setdefault((r.k, r.sign, r.root), set()).add((r.row, r.col))
    want = []
    for k in ("p", None):
        for sign in (-1, 1):
            left = {(r, c) for kk, r, c, z in cells if kk == k and sign * z >= 1.0}
            while left:
                todo, part = [left.pop()], set()
                while todo:
                    r, c = todo.pop()
                    part.add((r, c))
                    near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                    left -= near
                    todo += near
                want.append((k, sign, frozenset(part)))
    assert {(k, s, frozenset(p)) for (k, s, _), p in got.items()} == set(want) and len(got) == len(want)
    masses = detect.signed_clusters(df.withColumns({"e": F.col("col"), "n": F.col("row"), "id": F.col("row") * 100 + F.col("col")}), ["k"], "z", "e", "n", "id", threshold=1.0, min_cells=3).collect()
    assert len(masses) == sum(len(p) >= 3 for _, _, p in want) and all(len(m.targets.split(";")) == m.n_cells for m in masses)
