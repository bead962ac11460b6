"""Readers and sinks, streaming and the small operators that no query reaches."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, scalars, stats
from tessera.operators import detect, interpolate, ranking, spatial
from tessera.sources import files
from tessera.streaming import online


def value(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_epoch_discovery_and_repeats(spark, tmp_path):
    with pytest.raises(ValueError):
        files.discover_epochs(spark, str(tmp_path))
    (tmp_path / "20190113.txt").write_text("5 35.2 -117.2\n6 35.2 -117.2\n")
    (tmp_path / "20190101.txt").write_text("1 35.1 -117.1\n2 35.2 -117.2\n")
    (tmp_path / "notes.txt").write_text("x")
    assert [str(r.date) for r in files.discover_epochs(spark, str(tmp_path)).collect()] == ["2019-01-01", "2019-01-13"]
    stack = files.read_epoch_stack(spark, str(tmp_path))
    assert {(str(r.date), r.lat): r.displacement for r in files.align_epochs(stack).collect()}["2019-01-13", 35.2] == 5.0
    with pytest.raises(ValueError):
        files.align_epochs(stack, repeats="error")
    (tmp_path / "20190125.txt").write_text("")
    with pytest.raises(ValueError):
        files.discover_epochs(spark, str(tmp_path))


def test_other_geometries_can_be_an_error(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"features":[{"properties":{"IdentityConfidence":"certain"},"geometry":{"type":"Point","coordinates":[0,0]}}]}')
    assert files.read_polylines(spark, str(tmp_path / "f.json")).count() == 0
    with pytest.raises(ValueError):
        files.read_polylines(spark, str(tmp_path / "f.json"), strict=True)


def test_arrays_csv_and_manifests_round_trip(spark, tmp_path):
    cube = np.arange(24, dtype=float).reshape(2, 3, 4)
    cube[1, 2, 3] = np.nan
    np.savez_compressed(tmp_path / "a.npz", cube=cube, days=np.array(["2019-01-01", "2019-01-13"], dtype="datetime64[D]"), names=np.array(["x", "yy"]), scalar=np.float32(2.5), other=np.zeros(1000))
    out = files.read_arrays(spark, str(tmp_path), ["cube", "days", "names", "scalar"], rows=7)
    got = {(r.name, tuple(r["index"])): (r.value, r.text) for r in out.collect()}
    assert len(got) == 24 + 2 + 2 + 1 and got["scalar", ()] == (2.5, None) and got["names", (1,)] == (None, "yy")
    assert all(got["cube", i][0] == (None if math.isnan(cube[i]) else cube[i]) for i in np.ndindex(cube.shape))
    assert date.fromordinal(date(1970, 1, 1).toordinal() + int(got["days", (1,)][0])) == date(2019, 1, 13)
    (tmp_path / "t.csv").write_text("day,x,k\n2019-01-01,1.5,a\n2019-13-01,nan,b\n2019-01-03,zz,c\n")
    rows = {r.k: (r.day, r.x) for r in files.read_dated_csv(spark, str(tmp_path / "t.csv"), "day date, x double, k string").collect()}
    assert rows == {"a": (date(2019, 1, 1), 1.5), "b": (None, None), "c": (date(2019, 1, 3), None)}
    files.write_manifest(spark, str(tmp_path / "m"), {"gate": True, "level": 0.5, "dates": ["2019-01-01"]})
    assert files.read_manifest(spark, str(tmp_path / "m")) == {"gate": True, "level": 0.5, "dates": ["2019-01-01"]}


def test_cubes_tables_and_product_comparison(spark, tmp_path):
    a = spark.createDataFrame([(1, "2019-01-01", 1.0), (2, "2019-01-01", None), (3, "2019-01-13", 3.0)], "cell int, date string, x double")
    files.write_cube(a, str(tmp_path / "cube"))
    back = spark.read.parquet(str(tmp_path / "cube"))
    assert back.where("date = '2019-01-13'").select("cell", "x").collect() == [(3, 3.0)] and back.count() == 3
    files.write_table(a, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3
    b = spark.createDataFrame([(1, "2019-01-01", 1.0 + 1e-12), (2, "2019-01-01", 0.0), (4, "2019-01-13", 3.0)], "cell int, date string, x double")
    assert {r.cell for r in files.same_product(a, b, ["cell", "date"], ["x"]).collect()} == {2, 3, 4} and files.same_product(a, a, ["cell", "date"], ["x"]).count() == 0
    state = {(r.cell, r.state) for r in files.missing_and_unexpected(a, b, "cell").collect()}
    assert state == {(4, "missing"), (3, "unexpected")}


def test_station_metadata_counts_rejects(spark):
    daily = spark.createDataFrame([("A", 1.0, 5.0), ("A", 2.0, 6.0), ("A", 9.0, 7.0), ("B", 1.0, 1.0)], "station string, lat double, lon double")
    rejects = spark.createDataFrame([("B", "x", "date"), ("C", "y", "up")], "station string, value string, reason string")
    got = {r.station: (r.lat, r.lon, r.records, r.rejected) for r in files.station_metadata(daily, rejects).collect()}
    assert got == {"A": (2.0, 6.0, 3, 0), "B": (1.0, 1.0, 1, 1), "C": (None, None, None, 1)}


def test_small_geometry_and_scalars(spark):
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    tri = (p(0, 0), p(4, 0), p(0, 4))
    r = value(
        spark, inside=geo.point_in_triangle(p(1, 1), tri), outside=geo.point_in_triangle(p(3, 3), tri), apart=geo.segment_distance(p(0, 0), p(1, 0), p(0, 2), p(1, 3)),
        cross=geo.segment_distance(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), t_in=geo.segment_triangle_distance(p(1, 1), p(9, 9), tri), t_out=geo.segment_triangle_distance(p(5, 0), p(9, 0), tri),
    )
    assert (r.inside, r.outside, r.apart, r.cross, r.t_in, r.t_out) == (True, False, 2.0, 0.0, 0.0, 1.0)
    assert value(spark, d=scalars.int_date(F.lit(20190704))).d == date(2019, 7, 4)
    assert value(spark, c=stats.segment_cost(F.lit(6.0), F.lit(14.0), F.lit(3))).c == pytest.approx(2.0)


def test_lattice_area_reference_and_separation(spark):
    pts = spark.createDataFrame([(i * 3 + j, float(j) * 2, float(i) * 5) for i in range(4) for j in range(3)], "id long, e double, n double")
    got = {r.id: (r.row, r.col) for r in detect.lattice(pts, "e", "n").collect()}
    assert got == {i * 3 + j: (i, j) for i in range(4) for j in range(3)} and detect.cell_area(pts, "e", "n").first().cell_area == 10.0
    st = spark.createDataFrame([("a", 35.0, -117.0), ("b", 36.0, -117.0), ("c", 35.5, -117.0)], "station string, lat double, lon double")
    assert ranking.reference_station(st, [(35.0, -117.0), (35.4, -117.0)]).first().station == "b"
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(rng.uniform(0, 30, (40, 3)).round(1))]
    chosen = []
    for i, x, y, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(math.hypot(x - a, y - b) >= 8 for _, a, b, _ in chosen):
            chosen.append((i, x, y, s))
    out = ranking.separated(spark.createDataFrame(rows, "id long, x double, y double, score double"), "score", count=5).collect()
    assert [r.id for r in out] == [c[0] for c in chosen[:5]]


def test_interior_points_and_support_pairs(spark):
    pts = [(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 0.0, 10.0), (3, 10.0, 10.0), (4, 5.0, 5.0)]
    st = spark.createDataFrame(pts, "id long, x double, y double")
    assert {r.t_id for r in spatial.interior_points(st).collect()} == {4}
    support = spark.createDataFrame([(7, [0, 3])], "t_id long, station_ids array<long>")
    targets = spark.createDataFrame([(7, 1.0, 2.0)], "id long, x double, y double")
    pairs = interpolate.support_pairs(targets, st.withColumn("sigma", F.lit(0.5)), support)
    assert {(r.t_id, r.s_id, r.t_x, r.s_x, r.s_sigma) for r in pairs.collect()} == {(7, 0, 1.0, 0.0, 0.5), (7, 3, 1.0, 10.0, 0.5)}


def test_streams_of_windows_and_scores(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, h), float(h % 5)) for h in range(24)] + [("a", datetime(2024, 1, 2, h), 9.0) for h in range(3)] + [("b", datetime(2024, 1, 1, 5), 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, x double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(build, name):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        q.option("checkpointLocation", str(tmp_path / f"ck-{name}")).start().awaitTermination(90)
        return spark.table(name).collect()

    first = [r for r in run(lambda s: online.windowed_innovations(s, time="ts", key="k", value="x"), "windows") if r.start == datetime(2024, 1, 1)]
    day = np.array([h % 5 for h in range(24)], dtype=float)
    got = {r.k: r for r in first}
    assert got["a"].n == 24 and got["a"].value == pytest.approx(day.mean()) and got["a"].sigma == pytest.approx(day.std(ddof=1) / math.sqrt(24)) and got["b"].n == 1
    model = detect.robust_baseline(df.withColumn("s", F.lit(1.0)), ["k"], "x", "s", F.lit(True), 4)
    scored = run(lambda s: online.score_stream(s.withColumn("s", F.lit(1.0)), model, ["k"], "x", "s"), "scores")
    want = {(r.k, r.ts): r.z for r in detect.standardized(df.withColumn("s", F.lit(1.0)), model, ["k"], "x", "s").collect()}
    assert {(r.k, r.ts): r.z for r in scored} == want and len(want) >= 27
