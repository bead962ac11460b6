"""Rasters written byte by byte and read back."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import rasters

X0, Y0, STEP = -117.8, 36.0, 0.01


def tiff(a, *, order="<", deflate=False, tile=None, predictor=1, no_data=None):
    """A classic TIFF of one band, in strips of two rows or in tiles."""
    h, w = a.shape
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    stored = a.astype(a.dtype.newbyteorder(order))
    if tile:
        padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), stored.dtype)
        padded[:h, :w] = stored
        blocks = [padded[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        blocks = [stored[r : r + 2] for r in range(0, h, 2)]
    if predictor == 2:
        blocks = [np.diff(b.astype(a.dtype), axis=1, prepend=np.zeros((len(b), 1), a.dtype)).astype(stored.dtype) for b in blocks]
    data = [zlib.compress(b.tobytes()) if deflate else b.tobytes() for b in blocks]
    offsets, at = [], 8
    for d in data:
        offsets.append(at)
        at += len(d)
    entries = [(256, "I", [w]), (257, "I", [h]), (258, "H", [a.itemsize * 8]), (259, "H", [8 if deflate else 1]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [kind])]
    entries += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", offsets), (325, "I", [len(d) for d in data])] if tile else [(273, "I", offsets), (278, "I", [2]), (279, "I", [len(d) for d in data])]
    entries += [(33550, "d", [STEP, STEP, 0.0]), (33922, "d", [0.0, 0.0, 0.0, X0, Y0, 0.0])]
    if no_data is not None:
        entries.append((42113, "s", f"{no_data}\0".encode()))
    entries.sort()
    types, start, extra = {"s": 2, "H": 3, "I": 4, "d": 12}, at + 2 + 12 * len(entries) + 4, b""
    directory = struct.pack(order + "H", len(entries))
    for tag, code, values in entries:
        packed = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        place = packed.ljust(4, b"\0")
        if len(packed) > 4:
            place = struct.pack(order + "I", start + len(extra))
            extra += packed
        directory += struct.pack(order + "HHI", tag, types[code], len(values)) + place
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + b"".join(data) + directory + b"\0" * 4 + extra


@pytest.mark.parametrize("options", [{}, {"order": ">"}, {"deflate": True}, {"tile": 16}, {"tile": 16, "deflate": True, "order": ">"}])
def test_decode_returns_every_pixel(options):
    a = np.random.default_rng(1).normal(size=(21, 19)).astype("f4")
    grid, header = rasters.decode(tiff(a, **options))
    assert np.array_equal(grid, a) and header == pytest.approx({"lon0": X0 + STEP / 2, "lat0": Y0 - STEP / 2, "dlon": STEP, "dlat": -STEP})


def test_decode_integers_differences_and_no_data():
    a = np.random.default_rng(2).integers(0, 256, (5, 7)).astype("u1")
    assert np.array_equal(rasters.decode(tiff(a, predictor=2, deflate=True))[0], a)
    a[0, 0] = 9
    grid, _ = rasters.decode(tiff(a, no_data=9))
    assert np.isnan(grid[0, 0]) and np.array_equal(np.isnan(grid), a == 9)
    with pytest.raises(ValueError, match="TIFF"):
        rasters.decode(b"PK\3\4 not a raster")


def test_pair_is_levelled_and_referenced(spark, tmp_path):
    r, c = np.mgrid[0:60, 0:60]
    phase = (3 + 0.02 * c - 0.05 * r + 4.0 * ((r - 30) ** 2 + (c - 30) ** 2 < 16)).astype("f4")
    coherence = np.full((60, 60), 200, "u1")
    coherence[0, :] = 10
    phase[1, 1] = 0
    (tmp_path / "unw.tif").write_bytes(tiff(phase, deflate=True))
    (tmp_path / "cc.tif").write_bytes(tiff(coherence, tile=16))
    p, k = (rasters.read_rasters(spark, str(tmp_path), n, rows_per_batch=7) for n in ("unw.tif", "cc.tif"))
    assert p.count() == 3600 and p.where("row = 2 AND col = 3").first().lon == pytest.approx(X0 + 3.5 * STEP)
    centre = (Y0 - 30.5 * STEP, X0 + 30.5 * STEP)
    out = rasters.referenced_pair(p, k, to_mm=2.0, coherence_min=0.3, events=[centre], exclusion_km=8.0, reference=(Y0 - 0.105, X0 + 0.105, 5.0), stride=2, least_far=100)
    v = {(x.row, x.col): x.value for x in out.collect()}
    assert len(v) == 3600 - 60 - 1 and v[30, 30] == pytest.approx(8.0, abs=0.02) and v[50, 50] == pytest.approx(0.0, abs=0.02)
    none = rasters.referenced_pair(p, k, to_mm=2.0, coherence_min=0.3, events=[centre], exclusion_km=8.0, reference=(0.0, 0.0, 1.0), stride=2, least_far=100)
    assert none.where(F.col("value").isNotNull()).count() == 0
    looks = rasters.look_rasters(p, p, p).where("row = 5 AND col = 5").first()
    assert looks.look_e == pytest.approx(3**-0.5)
