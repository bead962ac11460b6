"""Readers and writers for the file formats of stacked observations.

Readers return plain DataFrames with an explicit schema; values that do not
parse become NULL and are counted by the callers that care.  Nothing opens a
path outside Spark's own readers.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.geo import coordinate_key, finite, to_utm_km
from tessera.functions.scalars import compact_date, epoch_date_of_path, stem


def discover_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """(date, path, length) of the ``YYYYMMDD.txt`` files of a folder, in order of date.

    A folder without any, an empty file and two files of one date are errors.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "length")
    # Spark plans no read of an empty file: such a file is listed, and no row.
    listed = sum(bool(re.search(r"/[0-9]{8}\.txt$", name)) for name in files.inputFiles())
    found = files.withColumn("date", epoch_date_of_path(F.col("path"))).where("date IS NOT NULL AND length > 0").select("date", "path", "length")
    state = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("dates")).first()
    if not listed:
        raise ValueError(f"no epoch files in {folder}")
    if state.n < listed or state.dates < state.n:
        raise ValueError("an epoch file is empty" if state.n < listed else "two epoch files have one date")
    return found.orderBy("date")


def read_epoch_stack(spark: SparkSession, folder: str) -> DataFrame:
    """(date, displacement, lat, lon, line, key) of all ``YYYYMMDD.txt`` in a folder.

    Lines are whitespace separated: displacement, latitude, longitude; ``line``
    orders them within a file.
    """
    raw = spark.read.text(folder, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("path"))
    part = F.split(F.trim("value"), r"\s+")
    number = lambda i: finite(F.get(part, F.lit(i)).try_cast("double"))
    rows = raw.where(F.trim("value") != "").select(epoch_date_of_path(F.col("path")).alias("date"), number(0).alias("displacement"), number(1).alias("lat"), number(2).alias("lon"))
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    return rows.where("date IS NOT NULL").withColumn("key", coordinate_key(F.col("lat"), F.col("lon")))


def align_epochs(stack: DataFrame, *, repeats: str = "first") -> DataFrame:
    """Every epoch on the first epoch's grid: unmatched positions are NULL.

    Repeated positions of an epoch keep their first value, or are an error with
    ``repeats='error'``.  The result is dense, each cell at each date; the dates
    that are broadcast for it are days, some 36,500 in a century.
    """
    if repeats not in ("first", "error"):
        raise ValueError("repeats must be 'first' or 'error'")
    if repeats == "error" and not stack.groupBy("date", "key").count().where("count > 1").isEmpty():
        raise ValueError("an epoch holds a position twice")
    first = F.broadcast(stack.agg(F.min("date").alias("d0")))
    grid = stack.join(first, F.col("date") == F.col("d0")).select("key", "lat", "lon").dropDuplicates(["key"])
    dates = stack.select("date").distinct()
    one = stack.groupBy("date", "key").agg(F.min_by("displacement", "line").alias("displacement"))
    return grid.crossJoin(F.broadcast(dates)).join(one, ["date", "key"], "left")


def read_tenv3(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Daily station positions, and the rejected lines with the reason.

    Files are whitespace tables with a header line; the station is the file name.
    Correlations are read where the columns exist.
    """
    raw = spark.read.text(folder, pathGlobFilter="*.tenv3").select(F.trim("value").alias("value"), stem(F.col("_metadata.file_path")).alias("station"))
    cells = raw.withColumn("c", F.split("value", r"\s+"))
    header = cells.where(F.get("c", F.lit(0)).rlike("^[A-Za-z_]")).groupBy("station").agg(F.first("c").alias("h"))
    lines = cells.where(F.get("c", F.lit(0)).rlike("^[0-9]")).join(header, "station")
    pick = lambda name: F.get("c", (F.array_position("h", name) - 1).cast("int"))
    names = {
        "lat": "_latitude(deg)", "lon": "_longitude(deg)", "east": "__east(m)", "north": "__north(m)", "up": "____up(m)",
        "sigma_e": "sig_e(m)", "sigma_n": "sig_n(m)", "sigma_u": "sig_u(m)",
    }
    extra = {"corr_en": "__corr_en", "corr_eu": "__corr_eu", "corr_nu": "__corr_nu"}
    optional = {k: F.when(F.array_contains("h", v), finite(pick(v).try_cast("double"))) for k, v in extra.items()}
    out = lines.select("station", compact_date(pick("YYMMMDD")).alias("date"), *[finite(pick(v).try_cast("double")).alias(k) for k, v in names.items()], *[v.alias(k) for k, v in optional.items()], "value")
    missing = F.when(F.col("date").isNull(), "date")
    for k in names:
        missing = missing.when(F.col(k).isNull(), k)
    tagged = out.withColumn("reason", missing)
    return tagged.where("reason IS NULL").drop("reason", "value"), tagged.where("reason IS NOT NULL").select("station", "value", "reason")


def station_metadata(daily: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Median position and record count per station, with the number of rejected lines."""
    m = daily.groupBy("station").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count(F.lit(1)).alias("records"))
    if rejects is None:
        return m
    bad = rejects.groupBy("station").agg(F.count(F.lit(1)).alias("rejected"))
    return m.join(bad, "station", "full").withColumn("rejected", F.coalesce("rejected", F.lit(0).cast("long")))


_LINE = "struct<type:string,coordinates:array<array<double>>>"
_MULTI = "struct<type:string,coordinates:array<array<array<double>>>>"


def read_polylines(spark: SparkSession, path: str, *, certain_only: bool = True, strict: bool = False) -> DataFrame:
    """(line_id, label, confidence, vertex, lon, lat) of GeoJSON lines with at least two vertices.

    Other geometries are left out, or are an error with ``strict``.
    """
    text = spark.read.text(path, wholetext=True)
    shape = "features array<struct<properties:struct<Label:string,IdentityConfidence:string>,geometry:string>>"
    f = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f")).select(
        F.coalesce("f.properties.Label", F.lit("Unlabelled rupture")).alias("label"), F.col("f.properties.IdentityConfidence").alias("confidence"), F.col("f.geometry").alias("g")
    )
    kind = F.get_json_object("g", "$.type")
    lines = F.when(kind == "LineString", F.array(F.from_json("g", _LINE)["coordinates"])).when(kind == "MultiLineString", F.from_json("g", _MULTI)["coordinates"])
    if certain_only:
        f = f.where(F.col("confidence") == "certain")
    if strict and not f.where(lines.isNull()).isEmpty():
        raise ValueError("a feature is no line")
    each = f.select("label", "confidence", F.posexplode(lines).alias("part", "line"), F.xxhash64("g").alias("gid")).where(F.size("line") >= 2)
    each = each.withColumn("line_id", F.concat_ws(":", "gid", "part"))
    return each.select("line_id", "label", "confidence", F.posexplode("line").alias("vertex", "p")).select(
        "line_id", "label", "confidence", "vertex", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")
    )


def segments_of(polylines: DataFrame, *, zone: int = 11, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Consecutive-vertex segments in UTM kilometres, optionally overlapping (xmin, ymin, xmax, ymax)."""
    from pyspark.sql import Window

    x, y = to_utm_km(F.col("lon"), F.col("lat"), zone)
    p = polylines.withColumns({"x1": x, "y1": y})
    w = Window.partitionBy("line_id").orderBy("vertex")
    s = p.withColumns({"x2": F.lead("x1").over(w), "y2": F.lead("y1").over(w)}).where("x2 IS NOT NULL")
    if bounds:
        a, b, c, d = bounds
        s = s.where((F.greatest("x1", "x2") >= a) & (F.least("x1", "x2") <= c) & (F.greatest("y1", "y2") >= b) & (F.least("y1", "y2") <= d))
    return s.select("line_id", "label", "confidence", "vertex", "x1", "y1", "x2", "y2")


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of all files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def missing_and_unexpected(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``missing`` or ``unexpected``."""
    a, b = found.select(key).distinct(), expected.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("state", F.lit("unexpected")))


def same_product(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """Rows in which two products differ beyond tolerance or in what is missing."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("__a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("__b"))
    j = left.join(right, list(keys), "full")
    differs = F.col("__a").isNull() | F.col("__b").isNull()
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        differs = differs | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    return j.where(differs).drop("__a", "__b")


_CELL = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("index", T.ArrayType(T.IntegerType())),
        T.StructField("value", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)


def read_arrays(spark: SparkSession, path: str, names: Sequence[str] | None = None, *, rows: int = 65_536) -> DataFrame:
    """(path, name, index, value, text) of every element of the arrays in ``.npz`` files.

    Numbers, truth values and dates (as days since 1970) are in ``value``, with NaN
    as NULL; strings are in ``text``.  Only the arrays asked for are decompressed,
    and one array at a time is held.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    for name in held.files if names is None else [n for n in names if n in held.files]:
                        values = held[name]
                        flat = values.reshape(-1)
                        if np.issubdtype(flat.dtype, np.datetime64):
                            flat = flat.astype("datetime64[D]").astype(np.int64)
                        strings = flat.dtype.kind in "US"
                        for k in range(0, len(flat), rows):
                            part = flat[k : k + rows]
                            where = np.stack(np.unravel_index(np.arange(k, k + len(part)), values.shape or (1,)), axis=1)[:, : values.ndim].astype(np.int32)
                            text = [x.decode() if isinstance(x, bytes) else str(x) for x in part] if strings else [None] * len(part)
                            number = [None] * len(part) if strings else [None if np.isnan(x) else float(x) for x in part.astype(np.float64)]
                            yield pd.DataFrame({"path": at, "name": name, "index": list(where), "value": pd.Series(number, dtype=object), "text": text})

    return files.mapInPandas(work, _CELL)


def read_dated_csv(spark: SparkSession, path: str, schema: str, *, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header under an explicit schema; cells that don't parse, and NaN, are NULL."""
    out = spark.read.schema(schema).option("header", "true").option("dateFormat", date_format).option("mode", "PERMISSIVE").csv(path)
    return out.withColumns({c: finite(F.col(c)) for c, kind in out.dtypes if kind in ("double", "float")})


def read_manifest(spark: SparkSession, path: str) -> dict:
    """Parameters of a JSON manifest (one small object)."""
    import json

    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_cube(df: DataFrame, path: str, by: Sequence[str] = ("date",)) -> None:
    """One partition folder per value of ``by``, so epochs prune at the scan."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_manifest(spark: SparkSession, path: str, values: dict) -> None:
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
