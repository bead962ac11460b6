"""Cubes written by hand in the file format, read back as rows."""

import datetime as dt
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import reference
from tessera.sources import hdf5

UNDEF = (1 << 64) - 1


class Writer:
    """Appends blocks to a file and knows their addresses; new: object headers and links of version 2."""

    def __init__(self, new: bool, start: int = 0):
        self.new, self.raw = new, bytearray(start + (48 if new else 96))
        self.start = start

    def put(self, block: bytes) -> int:
        self.raw += bytes(-len(self.raw) % 8)
        at = len(self.raw)
        self.raw += block
        return at - self.start

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        if self.new:
            half = len(messages) // 2  # the second half in a continuation block
            pack = lambda ms: b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in ms)
            rest = b"OCHK" + pack(messages[half:]) + bytes(4)
            place = self.put(rest)
            body = pack(messages[:half]) + struct.pack("<BHB", 0x10, 16, 0) + struct.pack("<QQ", place, len(rest))
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4))
        messages = [(k, d + bytes(-len(d) % 8)) for k, d in messages]
        pack = lambda ms: b"".join(struct.pack("<HHB3x", k, len(d), 0) + d for k, d in ms)
        rest = pack(messages[1:])
        place = self.put(rest)
        body = pack(messages[:1]) + struct.pack("<HHB3x", 0x10, 16, 0) + struct.pack("<QQ", place, len(rest))
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + 1, 1, len(body)) + body)

    def tree(self, kind: int, level: int, keys: list[bytes], children: list[int]) -> int:
        body = b"".join(k + struct.pack("<Q", c) for k, c in zip(keys, children, strict=False)) + keys[-1]
        return self.put(b"TREE" + struct.pack("<BBHQQ", kind, level, len(children), UNDEF, UNDEF) + body)

    def dataset(self, array: np.ndarray, chunk=None, filters=(), fill=None, drop=(), damage=()) -> int:
        dt_ = array.dtype
        bits = (dt_.byteorder == ">") | (8 if dt_.kind == "i" else 0)
        kind = struct.pack("<B3BI", 0x10 | (dt_.kind == "f"), bits, 0, 0, dt_.itemsize) + bytes(12 if dt_.kind == "f" else 4)
        space = struct.pack("<BBB5x", 1, array.ndim, 0) if not self.new else struct.pack("<BBBB", 2, array.ndim, 0, 1 if array.ndim else 0)
        space += b"".join(struct.pack("<Q", n) for n in array.shape)
        filled = array.dtype.type(0 if fill is None else fill).astype(dt_).tobytes()
        fills = struct.pack("<BB", 3, 0x20 if fill is not None else 0) + (struct.pack("<I", dt_.itemsize) + filled if fill is not None else b"")
        if not self.new:
            fills = struct.pack("<BBBB", 2, 2, 0, 1) + struct.pack("<I", dt_.itemsize) + filled
        messages = [(1, space), (3, kind), (5, fills)]
        if array.ndim == 0 or chunk == "compact":
            messages.append((8, struct.pack("<BBH", 3, 0, array.nbytes) + array.tobytes()))
        elif chunk is None:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(array.tobytes()), array.nbytes)))
        else:
            messages.append((8, struct.pack("<BBBQ", 3, 2, array.ndim + 1, self.chunks(array, chunk, filters, drop, damage)) + struct.pack(f"<{array.ndim + 1}I", *chunk, dt_.itemsize)))
            if filters:
                head = struct.pack("<BB", 2, len(filters)) if self.new else struct.pack("<BB6x", 1, len(filters))
                messages.append((0xB, head + b"".join(self.filter(f, dt_.itemsize) for f in filters)))
        return self.header(messages)

    def filter(self, f: int, size: int) -> bytes:
        values = {1: [6], 2: [size], 3: []}[f]
        if self.new:
            return struct.pack(f"<HHH{len(values)}I", f, 0, len(values), *values)
        name = b"filter\0\0"
        return struct.pack("<HHHH", f, len(name), 0, len(values)) + name + struct.pack(f"<{len(values) + len(values) % 2}I", *values, *[0] * (len(values) % 2))

    def chunks(self, array, chunk, filters, drop, damage) -> int:
        """A tree of two levels, three chunks a leaf."""
        entries = []
        for o in np.ndindex(*[-(-n // c) for n, c in zip(array.shape, chunk, strict=True)]):
            at = tuple(k * c for k, c in zip(o, chunk, strict=True))
            if at in drop:
                continue
            part = array[tuple(slice(k, k + c) for k, c in zip(at, chunk, strict=True))]
            block = np.zeros(chunk, array.dtype)
            block[tuple(slice(0, n) for n in part.shape)] = part
            raw = block.tobytes()
            for f in filters:
                if f == 2:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, array.itemsize).T.tobytes()
                raw = zlib.compress(raw) if f == 1 else raw + b"sums" if f == 3 else raw
            if at in damage:
                raw = b"damaged!"
            entries.append((struct.pack("<II", len(raw), 0) + struct.pack(f"<{len(at) + 1}Q", *at, 0), self.put(raw)))
        end = struct.pack("<II", 0, 0) + struct.pack(f"<{array.ndim + 1}Q", *[1 << 40] * array.ndim, 0)
        leaves = []
        for k in range(0, len(entries), 3):
            part = entries[k : k + 3]
            after = entries[k + 3][0] if k + 3 < len(entries) else end
            leaves.append((part[0][0], self.tree(1, 0, [*[e[0] for e in part], after], [e[1] for e in part])))
        return self.tree(1, 1, [*[x[0] for x in leaves], end], [x[1] for x in leaves])

    def group(self, members: dict[str, int]) -> int:
        if self.new:
            links = [(6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", at)) for n, at in members.items()]
            return self.header([(2, struct.pack("<BBQQ", 0, 0, UNDEF, UNDEF)), (0xA, bytes(2)), *links])
        names, places = bytearray(8), {}
        for n in sorted(members):
            places[n] = len(names)
            names += n.encode() + bytes(8 - len(n) % 8)
        data = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), UNDEF, data))
        nodes = []
        ordered = sorted(members)
        for k in range(0, len(ordered), 4):
            part = ordered[k : k + 4]
            entries = b"".join(struct.pack("<QQI4x16x", places[n], members[n], 0) for n in part)
            nodes.append(self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + entries))
        tree = self.tree(0, 0, [struct.pack("<Q", 0)] * (len(nodes) + 1), nodes)
        return self.header([(0x11, struct.pack("<QQ", tree, heap))])

    def close(self, root: int, path) -> str:
        end = len(self.raw)
        if self.new:
            head = hdf5.SIGNATURE + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, self.start, UNDEF, end, root, 0)
        else:
            head = hdf5.SIGNATURE + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, self.start, UNDEF, end, UNDEF)
            head += struct.pack("<QQI4x16x", 0, root, 0)
        self.raw[self.start : self.start + len(head)] = head
        path.write_bytes(bytes(self.raw))
        return str(path)


DATES = np.array([20190604, 20190616, 20190628, 20190704, 20190716, 20190728, 20190809])
NY, NX = 23, 31


def cube_arrays(seed=3):
    rng = np.random.default_rng(seed)
    cum = rng.normal(0, 5, (len(DATES), NY, NX)).astype("<f4")
    cum[rng.random(cum.shape) < 0.1] = np.nan
    layers = {"coh_avg": rng.uniform(0.1, 0.9, (NY, NX)).astype("<f4"), "resid_rms": rng.uniform(0, 4, (NY, NX)).astype("<f4")}
    layers |= {"n_gap": rng.integers(0, 3, (NY, NX)).astype("<i2"), "n_loop_err": rng.integers(0, 9, (NY, NX)).astype(">i4")}
    layers["coh_avg"][2, 3] = np.nan
    return cum, layers


def write(path, *, new=False, start=0, chunk=(2, 8, 10), filters=(2, 1), drop=(), damage=(), kind="<f4", fill=np.nan, nested=False):
    cum, layers = cube_arrays()
    w = Writer(new, start)
    members = {"cum": w.dataset(cum.astype(kind), chunk, filters, fill, drop, damage), "imdates": w.dataset(DATES.astype("<i4"), "compact")}
    for k, (n, v) in enumerate(layers.items()):
        members[n] = w.dataset(v, (9, 7) if k % 2 else None, (1,) if k % 2 else ())
    for n, v in {"corner_lat": 36.0, "corner_lon": -118.0, "post_lat": -0.01, "post_lon": 0.0125}.items():
        members[n] = w.dataset(np.array(v, "<f8"))
    if nested:
        members = {"inner": w.group(members)}
    return w.close(w.group(members), path), cum, layers


def rows_of(cum, layers=()):
    days = [dt.datetime.strptime(str(d), "%Y%m%d").date() for d in DATES]
    clean = lambda v: None if np.isnan(v) else float(v)
    return {
        (days[t], r, c): (clean(cum[t, r, c]), *[clean(np.float64(v[r, c])) for v in (layers.values() if layers else ())])
        for t in range(len(DATES)) for r in range(NY) for c in range(NX)
    }


def got(df, *names):
    return {(r.date, r.row, r.col): tuple(r[n] for n in ("value", *names)) for r in df.collect()}


@pytest.mark.parametrize(
    "how",
    [
        {}, {"new": True, "filters": (2, 1, 3)}, {"chunk": None}, {"new": True, "chunk": None}, {"filters": (), "kind": ">f8"}, {"start": 512, "chunk": (1, 23, 31)}, {"chunk": (7, 3, 4), "filters": (1,)},
    ],
)
def test_a_cube_gives_its_cells(spark, tmp_path, how):
    path, cum, layers = write(tmp_path / "c.h5", **how)
    df = hdf5.read_cube(spark, path, layers=list(layers))
    assert got(df, *layers) == rows_of(cum, layers)
    r = df.where("row = 5 AND col = 7").first()
    assert (r.cube, r.lat, r.lon) == ("c", pytest.approx(36.0 - 0.05), pytest.approx(-118 + 7 * 0.0125))


def test_absent_chunks_have_the_fill_value(spark, tmp_path):
    path, cum, _ = write(tmp_path / "c.h5", drop={(2, 8, 10), (4, 0, 0)}, fill=-7.5)
    for a, b, c in ((2, 8, 10), (4, 0, 0)):
        cum[a : a + 2, b : b + 8, c : c + 10] = -7.5
    assert got(hdf5.read_cube(spark, path)) == rows_of(cum)


def test_nested_groups_and_whole_files(spark, tmp_path):
    path, cum, layers = write(tmp_path / "c.h5", new=True, nested=True)
    file = hdf5.Hdf5(hdf5.open_range(f"file:{path}"))
    assert np.array_equal(file.dataset("inner/cum").whole(), cum, equal_nan=True) and np.array_equal(file.dataset("/inner/n_gap").window((3, 9), (20, 31)), layers["n_gap"][3:9, 20:31])
    with pytest.raises(KeyError):
        file.dataset("inner/none")
    plain, cum, _ = write(tmp_path / "d.h5")
    assert got(hdf5.read_cube(spark, plain, whole_files=True, rows=(3, 5))) == {k: v for k, v in rows_of(cum).items() if 3 <= k[1] <= 5}
    both = hdf5.read_cube(spark, [plain, write(tmp_path / "e.h5")[0]])
    assert both.groupBy("cube").count().orderBy("cube").collect() == [("d", cum.size), ("e", cum.size)]
    with pytest.raises(ValueError):
        hdf5.Hdf5(lambda at, size: b"nothing of the kind"[at : at + size])


def test_a_window_reads_only_its_chunks(spark, tmp_path):
    """All chunks but those of the window are damaged: a read of any of them would fail."""
    need = {(2, 8, 10), (2, 8, 20), (4, 8, 10), (4, 8, 20)}
    every = {(a, b, c) for a in range(0, 7, 2) for b in range(0, 23, 8) for c in range(0, 31, 10)}
    path, cum, _ = write(tmp_path / "c.h5", damage=every - need)
    want = {k: v for k, v in rows_of(cum).items() if dt.date(2019, 6, 28) <= k[0] <= dt.date(2019, 7, 28) and 9 <= k[1] <= 14 and 11 <= k[2] <= 25}
    between = (dt.date(2019, 6, 28), dt.date(2019, 7, 28))
    assert got(hdf5.read_cube(spark, path, between=between, rows=(9, 14), cols=(11, 25))) == want
    lat, lon = (36.0 - 0.145, 36.0 - 0.085), (-118 + 0.013 * 10.1, -118 + 25.2 * 0.0125)
    assert got(hdf5.read_cube(spark, path, between=between, lat=lat, lon=lon)) == want
    with pytest.raises(Exception, match="decompress"):
        hdf5.read_cube(spark, path).count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = hdf5.read_cube(spark, path)
        cut = df.where((F.col("date") >= F.lit(between[0])) & (F.col("date") < F.lit(dt.date(2019, 7, 29))) & F.col("row").between(9, 14) & (F.col("lon") > lon[0]) & (F.col("lon") <= lon[1]))
        assert got(cut) == want
        one = df.where((F.col("date") == F.lit(dt.date(2019, 7, 4))) & F.col("row").isin(9, 11) & (F.col("col") == 12))
        assert got(one) == {k: v for k, v in want.items() if k[0] == dt.date(2019, 7, 4) and k[1] in (9, 11) and k[2] == 12}
        assert df.where("row > 99").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_window_reads_few_bytes(tmp_path):
    path, _, _ = write(tmp_path / "c.h5", chunk=(1, 4, 4))
    read = hdf5.open_range(path)
    seen = []

    def counted(at, size):
        seen.append(size)
        return read(at, size)

    data = hdf5.Hdf5(counted).dataset("cum")
    seen.clear()
    found = list(data.entries((3, 8, 12), (3, 8, 12)))
    assert [e[0] for e in found] == [(3, 8, 12)] and len(seen) <= 2 * 3  # two levels, neighbours of the branch at most
    assert len(list(data.entries((0, 0, 0), (99, 99, 99)))) == int(np.prod(data.grid()))


def test_long_cubes_are_cut_into_partitions(spark, tmp_path, monkeypatch):
    path, cum, _ = write(tmp_path / "c.h5")
    reader = hdf5._CubeReader([path], hdf5.Layout(), hdf5.Window())
    monkeypatch.setattr(hdf5, "TASK_BYTES", 2 * 2 * 8 * 10 * 4)
    parts = reader.partitions()
    assert [(p.start, p.stop) for p in parts] == [(k, min(k + 2, 48)) for k in range(0, 48, 2)]
    rows = sum(b.num_rows for p in parts for b in reader.read(p))
    assert rows == cum.size


def test_unsupported_parts_are_named(tmp_path):
    w = Writer(False)
    bad = w.header([(1, struct.pack("<BBB5x", 1, 1, 0) + struct.pack("<Q", 3)), (3, struct.pack("<B3BI", 0x13, 0, 0, 0, 4)), (8, struct.pack("<BBQQ", 3, 1, UNDEF, 0))])
    newer = w.header([(1, struct.pack("<BBB5x", 1, 1, 0) + struct.pack("<Q", 3)), (3, struct.pack("<B3BI", 0x10, 8, 0, 0, 4) + bytes(4)), (8, struct.pack("<BB6x", 4, 2))])
    path = w.close(w.group({"text": bad, "newer": newer}), tmp_path / "x.h5")
    file = hdf5.Hdf5(hdf5.open_range(path))
    for name, said in (("text", "neither"), ("newer", "layout 4")):
        with pytest.raises(ValueError, match=said):
            file.dataset(name)


def test_series_of_a_cube_equal_numpy(spark, tmp_path):
    """The readers of areas, patches and points take a cube's rows."""
    path, cum, layers = write(tmp_path / "c.h5")
    df = hdf5.read_cube(spark, path, layers=list(layers))
    ok = hdf5.quality(0.3, 3.0, 1, 7)
    mask = (layers["coh_avg"] >= 0.3) & (layers["resid_rms"] <= 3.0) & (layers["n_gap"] <= 1) & (layers["n_loop_err"] <= 7)
    r, c = np.indices((NY, NX))
    area, ref = mask & (r < 12) & (c < 16), mask & (r >= 12) & (c >= 14)
    med = lambda m, t: np.nanmedian(cum[t][m].astype(float))
    out = reference.referenced_series(df, "date", "value", area=ok & (F.col("row") < 12) & (F.col("col") < 16), reference=ok & (F.col("row") >= 12) & (F.col("col") >= 14))
    rows = {x.date: x for x in out.collect()}
    for t, stamp in enumerate(DATES):
        x = rows[dt.datetime.strptime(str(stamp), "%Y%m%d").date()]
        assert x.value == pytest.approx(med(area, t) - med(ref, t))
        assert x.sigma == pytest.approx(1.4826 * np.nanmedian(np.abs(cum[t][area].astype(float) - med(area, t))))
    cells = df.where(ok).withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    patches = reference.patch_series(cells, "date", "value", size=8.0, reference=(F.col("row") >= 12) & (F.col("col") >= 14), least=10)
    got_ = {(x.date, x.bx, x.by): x.value for x in patches.collect()}
    t = 4
    for bx in range(4):
        for by in range(3):
            m = mask & (c // 8 == bx) & (r // 8 == by) & ~np.isnan(cum[t])
            key = (dt.date(2019, 7, 16), bx, by)
            assert (key in got_) == (m.sum() >= 10)
            if key in got_:
                assert got_[key] == pytest.approx(med(m, t) - med(ref, t))
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 25.0, 5.0)], "id int, x double, y double")
    near = reference.point_series(points, cells, "date", "value", radius=5.0, reference=(F.col("row") >= 12) & (F.col("col") >= 14), least=5)
    for x in near.where("date = DATE'2019-07-16'").collect():
        px, py = ((10, 10), (25, 5))[x.point - 1]
        m = mask & (np.hypot(c - px, r - py) <= 5.0) & ~np.isnan(cum[t])
        assert x.n == m.sum() and x.value == pytest.approx(med(m, t) - med(ref, t))
