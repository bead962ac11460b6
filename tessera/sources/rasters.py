"""GeoTIFF rasters as rows, decoded with NumPy in Arrow batches, one file at a time."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geo import haversine_km
from tessera.operators.regress import far_field_plane

#: Fixed values of the TIFF 6.0 and GeoTIFF 1.0 formats: field type -> struct code and tags in use.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, NO_DATA = 33550, 33922, 42113
KIND = {1: "u", 2: "i", 3: "f"}


def tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    (n,) = struct.unpack_from(order + "H", raw, at)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        code = FIELD.get(kind)
        if code is None:
            continue
        layout = f"{order}{count}s" if code == "s" else f"{order}{count * len(code)}{code[0]}"
        place = at + 10 + 12 * i
        if struct.calcsize(layout) > 4:
            (place,) = struct.unpack_from(order + "I", raw, place)
        out[tag] = struct.unpack_from(layout, raw, place)
    return order, out


def decode(raw: bytes) -> tuple[np.ndarray, dict]:
    """First band as float64 (no-data as NaN) and its header: axes of the first pixel's centre and steps.

    Strips or tiles, one sample a pixel, uncompressed or deflated, with or without
    horizontal differencing of integers.
    """
    order, t = tags(raw)
    one = lambda tag, default=None: t[tag][0] if tag in t else default
    if one(SAMPLES, 1) != 1:
        raise ValueError("one sample a pixel is expected")
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    kind = KIND[one(SAMPLE_FORMAT, 1)]
    if compression not in (1, 8, 32946) or predictor not in (1, 2) or (predictor == 2 and kind == "f"):
        raise ValueError("compression or predictor not supported")
    height, width = one(HEIGHT), one(WIDTH)
    dtype = np.dtype(f"{order}{kind}{one(BITS, 1) // 8}")
    tiled = TILE_OFFSETS in t
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    grid = np.empty((height, width))
    across = -(-width // bw)
    for k, (at, size) in enumerate(zip(t[TILE_OFFSETS if tiled else OFFSETS], t[TILE_COUNTS if tiled else COUNTS], strict=True)):
        data = raw[at : at + size]
        block = np.frombuffer(zlib.decompress(data) if compression != 1 else data, dtype)
        r, c = k // across * bh, k % across * bw
        block = block.reshape(-1, bw)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        h, w = min(bh, height - r, len(block)), min(bw, width - c)
        grid[r : r + h, c : c + w] = block[:h, :w]
    empty = t.get(NO_DATA)
    if empty:
        grid[grid == float(empty[0].split(b"\0")[0])] = np.nan
    header = {"lon0": None, "lat0": None, "dlon": None, "dlat": None}
    if PIXEL_SCALE in t and TIE_POINT in t:
        sx, sy = t[PIXEL_SCALE][:2]
        col, row, _, x, y = t[TIE_POINT][:5]
        header = {"lon0": x + (0.5 - col) * sx, "lat0": y - (0.5 - row) * sy, "dlon": sx, "dlat": -sy}
    return grid, header


def read_rasters(spark: SparkSession, folder: str, pattern: str = "*.tif", rows_per_batch: int = 256) -> DataFrame:
    """(path, row, col, lat, lon, value) of all rasters in a folder; no-data and NaN are NULL.

    A task holds one decoded file and hands it on in blocks of rows, so files are the
    unit of parallelism.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                grid, h = decode(content)
                cols = np.arange(grid.shape[1])
                for start in range(0, len(grid), rows_per_batch):
                    part = grid[start : start + rows_per_batch]
                    r, c = np.repeat(np.arange(start, start + len(part)), len(cols)), np.tile(cols, len(part))
                    v = part.ravel()
                    lat = h["lat0"] + r * h["dlat"] if h["lat0"] is not None else np.nan
                    lon = h["lon0"] + c * h["dlon"] if h["lon0"] is not None else np.nan
                    yield pd.DataFrame({"path": path, "row": r, "col": c, "lat": lat, "lon": lon, "value": v})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    out = files.mapInPandas(expand, "path string, row int, col int, lat double, lon double, value double")
    null = lambda c: F.when(~F.isnan(c), F.col(c))
    return out.withColumns({c: null(c) for c in ("lat", "lon", "value")})


def referenced_pair(
    phase: DataFrame, coherence: DataFrame, *, to_mm: float, coherence_min: float, events: list[tuple[float, float]], exclusion_km: float, reference: tuple[float, float, float],
    stride: int = 10, least_far: int = 1000, least_reference: int = 25,
) -> DataFrame:
    """(row, col, lat, lon, value, coherence): displacement of a pair without its far-field plane, relative to a disk.

    A pixel counts where the coherence (0 to 255) reaches ``coherence_min`` (0 to 1)
    and the phase is not 0.  The plane is fitted robustly to every ``stride``-th row
    and column outside ``exclusion_km`` of all events; ``reference`` is (lat, lon,
    radius km).  Without ``least_reference`` pixels there the value is NULL.
    """
    c = coherence.select("row", "col", (F.col("value") / 255).alias("coherence"))
    p = phase.where(F.col("value").isNotNull() & (F.col("value") != 0)).join(c.where(F.col("coherence") >= coherence_min), ["row", "col"])
    p = p.select("row", "col", "lat", "lon", "coherence", (F.col("value") * to_mm).alias("value"), F.lit(1).alias("k"))
    apart = [haversine_km(F.col("lat"), F.col("lon"), a, b) > exclusion_km for a, b in events]
    far = (F.col("row") % stride == 0) & (F.col("col") % stride == 0)
    for a in apart:
        far = far & a
    plane = far_field_plane(p, ["k"], "lon", "lat", "value", far, least=least_far)
    flat = F.col("value") - F.col("plane_offset") - F.col("plane_x") * F.col("lon") - F.col("plane_y") * F.col("lat")
    levelled = p.join(F.broadcast(plane), "k").withColumn("__v", flat)
    lat0, lon0, radius = reference
    inside = F.when(haversine_km(F.col("lat"), F.col("lon"), lat0, lon0) <= radius, F.col("__v"))
    level = levelled.agg(F.when(F.count(inside) >= least_reference, F.median(inside)).alias("__ref"))
    return levelled.join(F.broadcast(level), F.lit(True)).select("row", "col", "lat", "lon", (F.col("__v") - F.col("__ref")).alias("value"), "coherence")


def look_rasters(east: DataFrame, north: DataFrame, up: DataFrame, least: float = 0.5) -> DataFrame:
    """(row, col, lat, lon, look_e, look_n, look_u) of three component rasters, as unit vectors."""
    from tessera.functions.geo import normalize_look

    one = lambda d, n: d.select("row", "col", F.col("value").alias(n))
    j = east.select("row", "col", "lat", "lon", F.col("value").alias("__e")).join(one(north, "__n"), ["row", "col"]).join(one(up, "__u"), ["row", "col"])
    e, n, u = normalize_look(F.col("__e"), F.col("__n"), F.col("__u"), least)
    return j.select("row", "col", "lat", "lon", e.alias("look_e"), n.alias("look_n"), u.alias("look_u"))
