"""HDF5 cubes as rows: a data source whose partitions are runs of chunks.

A cube holds a data set (epoch, row, col), the dates of its epochs as integers
``YYYYMMDD``, static layers (row, col) and the scalars of its grid.  A window of
dates, rows and columns (given, or pushed down from filters on date, row, col, lat
and lon) picks chunks; only these and the branches of the chunk index that lead to
them are read, each by its byte range, and decoded with NumPy.

Read are files of superblock 0 to 3, groups of symbol tables or compact links,
integers and floats, compact, contiguous and chunked data (version 1 index trees),
deflate, shuffle and checksum filters.  What else the format allows (dense groups,
newer chunk indexes, other filters and types) is an error that names it.  Chunks
that a file doesn't hold have its fill value.

Files are opened by ``pyarrow.fs``, which reads local and cloud stores and HDFS;
for other stores that only Spark reaches, ``whole_files`` hands each file to a
task as Spark read it (up to 2 GB each).
"""

from __future__ import annotations

import datetime as dt
import itertools
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format: signatures, message types, filters, undefined address.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, LINK_INFO, TYPE, OLD_FILL, FILL, LINK, LAYOUT, PIPELINE, CONTINUED, TABLE = 0x1, 0x2, 0x3, 0x4, 0x5, 0x6, 0x8, 0xB, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = 0xFFFFFFFFFFFFFFFF

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
ReadAt = Callable[[int, int], bytes]

#: Bytes of one block of contiguous data, and of the blocks that one task reads.
BLOCK_BYTES, TASK_BYTES = 4 << 20, 64 << 20


def _uint(raw: bytes, at: int, size: int) -> int:
    return int.from_bytes(raw[at : at + size], "little")


@dataclass(frozen=True)
class Dataset:
    """Shape, type and place of one data set."""

    read: ReadAt
    shape: tuple[int, ...]
    dtype: np.dtype
    fill: float
    chunk: tuple[int, ...]
    chunked: bool
    address: int
    inline: bytes | None
    filters: tuple[tuple[int, tuple[int, ...]], ...]

    def grid(self) -> tuple[int, ...]:
        """Number of chunks along each axis."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True))

    def entries(self, first: tuple[int, ...], last: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offset, address, size, filter mask) of the chunks from ``first`` to ``last``, in order of their offsets."""
        if self.address != NOWHERE:
            yield from self._branch(self.address, first, last)

    def _branch(self, at: int, first: tuple[int, ...], last: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        head = self.read(at, 24)
        if head[:4] != b"TREE" or head[4] != 1:
            raise ValueError("the chunk index is not a version 1 tree")
        level, used, rank = head[5], _uint(head, 6, 2), len(self.shape)
        step = 8 + 8 * (rank + 1) + 8
        raw = self.read(at + 24, used * step + step - 8)
        offset = lambda i: tuple(_uint(raw, i * step + 8 + 8 * k, 8) for k in range(rank))
        for i in range(used):
            low, child = offset(i), _uint(raw, (i + 1) * step - 8, 8)
            if low > last:
                return
            if level:
                if offset(i + 1) > first:  # a branch ends where the next one begins
                    yield from self._branch(child, first, last)
            elif low >= first:
                yield low, child, _uint(raw, i * step, 4), _uint(raw, i * step + 4, 4)

    def decoded(self, raw: bytes, mask: int = 0) -> np.ndarray:
        """A chunk's values."""
        for k, (kind, values) in reversed(list(enumerate(self.filters))):
            if mask >> k & 1:
                continue
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == SHUFFLE:
                size = values[0] if values else self.dtype.itemsize
                n = len(raw) // size
                raw = np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T.tobytes() + raw[n * size :]
            elif kind == CHECKSUM:
                raw = raw[:-4]
            else:
                raise ValueError(f"filter {kind} is not supported")
        count = int(np.prod(self.chunk, dtype=np.int64))
        return np.frombuffer(raw, self.dtype, count).reshape(self.chunk)

    def blocks(self, offsets: Sequence[tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """(offset, values) of the chunks at ``offsets``, which are in order; only these are read."""
        if not offsets:
            return
        if self.chunked:
            wanted = set(offsets)
            found = {o: place for o, *place in self.entries(offsets[0], offsets[-1]) if o in wanted}
            for o in offsets:
                if o in found:
                    address, size, mask = found[o]
                    yield o, self.decoded(self.read(address, size), mask)
                else:
                    yield o, np.full(self.chunk, self.fill, self.dtype)
            return
        size = self.dtype.itemsize
        strides = [size * int(np.prod(self.shape[k + 1 :], dtype=np.int64)) for k in range(len(self.shape))]
        for o in offsets:
            shape = tuple(min(c, n - k) for c, n, k in zip(self.chunk, self.shape, o, strict=True))
            at, count = sum(k * s for k, s in zip(o, strides, strict=True)), int(np.prod(shape, dtype=np.int64))
            if self.inline is not None:
                values = np.frombuffer(self.inline, self.dtype, count, at)
            elif self.address == NOWHERE:
                values = np.full(count, self.fill, self.dtype)
            else:
                values = np.frombuffer(self.read(self.address + at, count * size), self.dtype, count)
            yield o, values.reshape(shape)

    def window(self, *ranges: tuple[int, int]) -> np.ndarray:
        """Values of the half-open ranges, one for each axis."""
        out = np.full([b - a for a, b in ranges], self.fill, self.dtype.newbyteorder("="))
        steps = [range(a // c * c, b, c) for (a, b), c in zip(ranges, self.chunk, strict=True)]
        for o, block in self.blocks(list(itertools.product(*steps))):
            inner, outer = [], []
            for (a, b), k, n in zip(ranges, o, block.shape, strict=True):
                low, high = max(a, k), min(b, k + n)
                inner.append(slice(low - k, high - k))
                outer.append(slice(low - a, high - a))
            out[tuple(outer)] = block[tuple(inner)]
        return out

    def whole(self) -> np.ndarray:
        return self.window(*[(0, n) for n in self.shape])


class Hdf5:
    """The groups and data sets of one file, read through ``read(at, size)``."""

    def __init__(self, read: ReadAt):
        self.read = read
        at = 0
        while read(at, 8) != SIGNATURE:
            at = max(512, 2 * at)
            if len(read(at, 8)) < 8:
                raise ValueError("not an HDF5 file")
        version = read(at + 8, 1)[0]
        if version <= 1:
            head = read(at, 100)
            if head[13:15] != b"\x08\x08":
                raise ValueError("offsets and lengths of 8 bytes are expected")
            base = 24 + 4 * (version == 1)
            self.base, self.root = _uint(head, base, 8), _uint(head, base + 40, 8)
        elif version <= 3:
            head = read(at, 48)
            if head[9:11] != b"\x08\x08":
                raise ValueError("offsets and lengths of 8 bytes are expected")
            self.base, self.root = _uint(head, 12, 8), _uint(head, 36, 8)
        else:
            raise ValueError(f"superblock {version} is not supported")
        if self.base:
            self.read = lambda where, size: read(self.base + where, size)

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(type, data) of an object header."""
        head = self.read(at, 48)
        new = head[:4] == b"OHDR"
        if new:
            flags = head[5]
            start = 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width = 1 << (flags & 3)
            blocks, own = [(at + start + width, _uint(head, start, width))], 4 + 2 * bool(flags & 4)
        else:
            if head[0] != 1:
                raise ValueError("unknown object header")
            blocks, own = [(at + 16, _uint(head, 8, 4))], 8
        while blocks:
            place, size = blocks.pop(0)
            raw, k = self.read(place, size), 0
            while k + own <= len(raw):
                kind, length, flags = (raw[k], _uint(raw, k + 1, 2), raw[k + 3]) if new else (_uint(raw, k, 2), _uint(raw, k + 2, 2), raw[k + 4])
                data = raw[k + own : k + own + length]
                k += own + length
                if kind == CONTINUED:
                    where, span = _uint(data, 0, 8), _uint(data, 8, 8)
                    blocks.append((where + 4, span - 8) if new else (where, span))  # a signature in front, a checksum behind
                elif kind:
                    if flags & 2 and kind in (SPACE, TYPE, FILL, LAYOUT, PIPELINE):
                        raise ValueError("shared header messages are not supported")
                    yield kind, data

    def links(self, at: int) -> dict[str, int]:
        """Names in a group and their object headers."""
        out = {}
        for kind, data in self.messages(at):
            if kind == TABLE:
                heap = self.read(_uint(data, 8, 8), 32)
                names = self.read(_uint(heap, 24, 8), _uint(heap, 8, 8))
                out |= {names[a : names.index(b"\0", a)].decode(): b for a, b in self._symbols(_uint(data, 0, 8))}
            elif kind == LINK:
                flags, k = data[1], 2
                hard = not (flags & 8 and data[k])
                k += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                size, k = _uint(data, k, width), k + width
                if hard:
                    out[data[k : k + size].decode()] = _uint(data, k + size, 8)
            elif kind == LINK_INFO and _uint(data, 2 + 8 * (data[1] & 1), 8) != NOWHERE:
                raise ValueError("groups with dense links are not supported")
        return out

    def _symbols(self, at: int) -> Iterator[tuple[int, int]]:
        head = self.read(at, 24)
        if head[:4] == b"SNOD":
            used = _uint(head, 6, 2)
            raw = self.read(at + 8, 40 * used)
            yield from ((_uint(raw, 40 * i, 8), _uint(raw, 40 * i + 8, 8)) for i in range(used))
            return
        used = _uint(head, 6, 2)
        raw = self.read(at + 24, 16 * used + 8)
        for i in range(used):
            yield from self._symbols(_uint(raw, 16 * i + 8, 8))

    def dataset(self, path: str) -> Dataset:
        at = self.root
        for name in path.strip("/").split("/"):
            found = self.links(at)
            if name not in found:
                raise KeyError(f"no {path} in the file")
            at = found[name]
        return self._dataset(dict(self.messages(at)), path)

    def _dataset(self, m: dict[int, bytes], path: str) -> Dataset:
        space = m[SPACE]
        first = 8 if space[0] == 1 else 4
        shape = tuple(_uint(space, first + 8 * k, 8) for k in range(space[1]))
        kind, size = m[TYPE][0] & 15, _uint(m[TYPE], 4, 4)
        if kind > 1:
            raise ValueError(f"{path} is neither of integers nor of floats")
        letter = "f" if kind == 1 else "i" if m[TYPE][1] & 8 else "u"
        dtype = np.dtype(f"{'>' if m[TYPE][1] & 1 else '<'}{letter}{size}")
        filters = tuple(_filters(m[PIPELINE])) if PIPELINE in m else ()
        layout, inline, address, chunk, chunked = m[LAYOUT], None, NOWHERE, None, False
        version = layout[0]
        if version == 3:
            where = layout[1]
            if where == 0:
                inline = layout[4 : 4 + _uint(layout, 2, 2)]
            elif where == 1:
                address = _uint(layout, 2, 8)
            else:
                rank = layout[2]
                address, chunked = _uint(layout, 3, 8), True
                chunk = tuple(_uint(layout, 11 + 4 * k, 4) for k in range(rank - 1))
        elif version in (1, 2):
            rank, where = layout[1], layout[2]
            k = 8 + 8 * (where != 0)
            address = _uint(layout, 8, 8) if where else NOWHERE
            chunk, chunked = (tuple(_uint(layout, k + 4 * i, 4) for i in range(rank - 1)), True) if where == 2 else (None, False)
            inline = layout[k + 4 * rank + 4 :] if where == 0 else None
        else:
            raise ValueError(f"{path}: data layout {version} is not supported")
        if not chunked:  # blocks of some rows of the last two axes
            row = size * (shape[-1] if shape else 1)
            rows = max(1, min(shape[-2], BLOCK_BYTES // max(row, 1))) if len(shape) > 1 else 1
            chunk = (*[1] * (len(shape) - 2), rows, shape[-1]) if len(shape) > 1 else shape
        return Dataset(self.read, shape, dtype, _fill(m, dtype), tuple(max(c, 1) for c in chunk), chunked, address, inline, filters)


def _filters(data: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
    version, count = data[0], data[1]
    k = 8 if version == 1 else 2
    for _ in range(count):
        kind = _uint(data, k, 2)
        named = version == 1 or kind >= 256
        name = _uint(data, k + 2, 2) if named else 0
        k += 2 + 2 * named
        values = _uint(data, k + 2, 2)
        k += 4 + (-(-name // 8) * 8 if version == 1 else name)
        yield kind, tuple(_uint(data, k + 4 * i, 4) for i in range(values))
        k += 4 * (values + (values % 2 if version == 1 else 0))


def _fill(m: dict[int, bytes], dtype: np.dtype) -> float:
    data, size, at = m.get(FILL), 0, 0
    if data is not None:
        if data[0] == 3:
            size, at = (_uint(data, 2, 4), 6) if data[1] & 32 else (0, 0)
        elif data[0] == 1 or data[3]:
            size, at = _uint(data, 4, 4), 8
    elif OLD_FILL in m:
        size, at, data = _uint(m[OLD_FILL], 0, 4), 4, m[OLD_FILL]
    return np.frombuffer(data, dtype, 1, at)[0].item() if size == dtype.itemsize else 0


# -- cubes as rows --------------------------------------------------------------


@dataclass(frozen=True)
class Window:
    """Closed bounds; None is open."""

    date: tuple[int | None, int | None] = (None, None)  # days since 1970
    row: tuple[int | None, int | None] = (None, None)
    col: tuple[int | None, int | None] = (None, None)
    lat: tuple[float | None, float | None] = (None, None)
    lon: tuple[float | None, float | None] = (None, None)

    def narrowed(self, axis: str, low=None, high=None) -> Window:
        a, b = getattr(self, axis)
        a = low if a is None else a if low is None else max(a, low)
        b = high if b is None else b if high is None else min(b, high)
        return replace(self, **{axis: (a, b)})

    def holds(self, axis: str, values: np.ndarray) -> np.ndarray:
        a, b = getattr(self, axis)
        return (values >= (-np.inf if a is None else a)) & (values <= (np.inf if b is None else b))


@dataclass(frozen=True)
class Layout:
    """Names of a cube's parts."""

    value: str = "cum"
    dates: str = "imdates"
    layers: tuple[str, ...] = ()
    corner: tuple[str, str] = ("corner_lat", "corner_lon")
    post: tuple[str, str] = ("post_lat", "post_lon")


@dataclass
class Cube:
    """One open cube and the part of it that a window picks."""

    file: Hdf5
    names: Layout
    window: Window
    data: Dataset = field(init=False)

    def __post_init__(self) -> None:
        self.data = self.file.dataset(self.names.value)
        if len(self.data.shape) != 3:
            raise ValueError(f"{self.names.value} is no cube of epochs, rows and columns")
        stamp = self.file.dataset(self.names.dates).whole().astype(np.int64)
        text = np.char.mod("%08d", stamp)
        iso = np.array([f"{s[:4]}-{s[4:6]}-{s[6:]}" for s in text.tolist()], dtype="datetime64[D]") if len(stamp) else np.array([], dtype="datetime64[D]")
        self.days = iso.astype(np.int64)
        if len(self.days) != self.data.shape[0]:
            raise ValueError("the cube has another number of epochs than of dates")
        one = lambda name: float(self.file.dataset(name).whole().ravel()[0])
        (lat0, lon0), (dlat, dlon) = map(one, self.names.corner), map(one, self.names.post)
        rows, cols = np.arange(self.data.shape[1]), np.arange(self.data.shape[2])
        self.lat, self.lon = lat0 + rows * dlat, lon0 + cols * dlon
        w = self.window
        self.wanted = (w.holds("date", self.days), w.holds("row", rows) & w.holds("lat", self.lat), w.holds("col", cols) & w.holds("lon", self.lon))
        self._kept: dict[tuple, np.ndarray] = {}

    def offsets(self) -> list[list[int]]:
        """First indices, along each axis, of the chunks that the window touches."""
        return [sorted({int(i) // c * c for i in np.flatnonzero(want)}) for want, c in zip(self.wanted, self.data.chunk, strict=True)]

    def _layer(self, name: str, r: tuple[int, int], c: tuple[int, int]) -> np.ndarray:
        key = (name, *r, *c)
        if key not in self._kept:
            if len(self._kept) >= 4 * max(1, len(self.names.layers)):
                self._kept.clear()
            self._kept[key] = self.file.dataset(name).window(r, c).astype(float)
        return self._kept[key]

    def batches(self, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        """Rows of the wanted chunks ``start`` to ``stop`` in their order, a batch a chunk."""
        t, y, x = self.offsets()
        n = len(y) * len(x)
        picked = [(t[k // n], y[k % n // len(x)], x[k % len(x)]) for k in range(start, min(stop, len(t) * n))]
        for (e, r, c), block in self.data.blocks(picked):
            keep = [np.flatnonzero(want[k : k + size]) for want, k, size in zip(self.wanted, (e, r, c), block.shape, strict=True)]
            values = block[np.ix_(*keep)].astype(float)
            epochs, rows, cols = keep[0] + e, keep[1] + r, keep[2] + c
            grid = lambda v, axis, shape=values.shape: np.broadcast_to(v.reshape([-1 if k == axis else 1 for k in range(3)]), shape).ravel()
            known = lambda v: pa.array(np.ascontiguousarray(v).ravel(), from_pandas=True)
            columns = [
                pa.array(grid(self.days[epochs].astype(np.int32), 0)).cast(pa.date32()), pa.array(grid(rows.astype(np.int32), 1)), pa.array(grid(cols.astype(np.int32), 2)),
                pa.array(grid(self.lat[rows], 1)), pa.array(grid(self.lon[cols], 2)), known(values),
            ]
            for name in self.names.layers:
                layer = self._layer(name, (r, min(r + block.shape[1], self.data.shape[1])), (c, min(c + block.shape[2], self.data.shape[2])))
                columns.append(known(np.broadcast_to(layer[np.ix_(keep[1], keep[2])], values.shape)))
            yield pa.RecordBatch.from_arrays(columns, ["date", "row", "col", "lat", "lon", "value", *self.names.layers])


def _local(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", path)


def open_range(path: str) -> ReadAt:
    """Random access to a file of any store that ``pyarrow.fs`` knows."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(_local(path)) if "://" in _local(path) else (fs.LocalFileSystem(), path)
    handle = store.open_input_file(inner)
    return lambda at, size: handle.read_at(size, at)


def _stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2])


def _schema(layers: Sequence[str]) -> str:
    return ", ".join(["cube string, date date, row int, col int, lat double, lon double, value double", *[f"`{c}` double" for c in layers]])


def _with_name(name: str, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.add_column(0, "cube", pa.array([name] * batch.num_rows, pa.string()))


class _Run(InputPartition):
    def __init__(self, path: str, window: Window, start: int, stop: int):
        self.path, self.window, self.start, self.stop = path, window, start, stop


class _CubeReader(DataSourceReader):
    def __init__(self, paths: list[str], names: Layout, window: Window):
        self.paths, self.names, self.window = paths, names, window

    def partitions(self):
        out = []
        for path in self.paths:
            cube = Cube(Hdf5(open_range(path)), self.names, self.window)
            count = int(np.prod([len(k) for k in cube.offsets()], dtype=np.int64))
            size = cube.data.dtype.itemsize * int(np.prod(cube.data.chunk, dtype=np.int64))
            per = max(1, TASK_BYTES // max(size, 1))
            out += [_Run(path, self.window, k, min(k + per, count)) for k in range(0, count, per)]
        return out or [_Run("", self.window, 0, 0)]

    def read(self, partition: _Run):
        if partition.path:
            cube = Cube(Hdf5(open_range(partition.path)), self.names, partition.window)
            for batch in cube.batches(partition.start, partition.stop):
                yield _with_name(_stem(partition.path), batch)


class _FilteredReader(_CubeReader):
    """Spark refuses a reader with this method unless filters are to be pushed down."""

    def pushFilters(self, filters):
        """Narrows the window; Spark goes on to apply every filter itself."""
        for f in filters:
            axis, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if axis in Window.__dataclass_fields__ and value is not None:
                value = (value - dt.date(1970, 1, 1)).days if isinstance(value, dt.date) else value
                kind = type(f).__name__
                if kind in ("EqualTo", "EqualNullSafe"):
                    self.window = self.window.narrowed(axis, value, value)
                elif kind in ("GreaterThan", "GreaterThanOrEqual"):
                    self.window = self.window.narrowed(axis, low=value)
                elif kind in ("LessThan", "LessThanOrEqual"):
                    self.window = self.window.narrowed(axis, high=value)
                elif kind == "In" and all(v is not None for v in value):
                    days = [(v - dt.date(1970, 1, 1)).days if isinstance(v, dt.date) else v for v in value]
                    self.window = self.window.narrowed(axis, min(days), max(days))
            yield f


class CubeSource(DataSource):
    """Format ``hdf5_cube``; the options are those of ``read_cube``."""

    @classmethod
    def name(cls) -> str:
        return "hdf5_cube"

    def _names(self) -> Layout:
        o = self.options
        layers = tuple(x for x in o.get("layers", "").split(",") if x)
        pair = lambda key, default: tuple(o[key].split(",")) if key in o else default
        return Layout(o.get("value", "cum"), o.get("dates", "imdates"), layers, pair("corner", Layout.corner), pair("post", Layout.post))

    def schema(self) -> str:
        return _schema(self._names().layers)

    def reader(self, schema) -> DataSourceReader:
        window = Window()
        for axis, kind in (("date", int), ("row", int), ("col", int), ("lat", float), ("lon", float)):
            if axis in self.options:
                low, high = (kind(x) if x else None for x in self.options[axis].split(":"))
                window = window.narrowed(axis, low, high)
        kind = _FilteredReader if self.options.get("pushdown") == "true" else _CubeReader
        return kind([p for p in self.options["paths"].split("\n") if p], self._names(), window)


def read_cube(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    value: str = "cum",
    dates: str = "imdates",
    layers: Sequence[str] = (),
    between: tuple[dt.date | None, dt.date | None] = (None, None),
    rows: tuple[int | None, int | None] = (None, None),
    cols: tuple[int | None, int | None] = (None, None),
    lat: tuple[float | None, float | None] = (None, None),
    lon: tuple[float | None, float | None] = (None, None),
    whole_files: bool = False,
) -> DataFrame:
    """(cube, date, row, col, lat, lon, value, layers): the cells of one or several cubes.

    NaN is NULL.  The bounds are closed.  With
    ``spark.sql.python.filterPushdown.enabled`` filters on the result narrow the
    window as well.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    days = tuple(None if d is None else (d - dt.date(1970, 1, 1)).days for d in between)
    window = Window(days, tuple(rows), tuple(cols), tuple(lat), tuple(lon))
    names = Layout(value, dates, tuple(layers))
    if whole_files:
        return _read_whole(spark, paths, names, window)
    spark.dataSource.register(CubeSource)
    bounds = {"date": days, "row": rows, "col": cols, "lat": lat, "lon": lon}
    options = {k: ":".join("" if v is None else repr(v) for v in pair) for k, pair in bounds.items() if pair[0] is not None or pair[1] is not None}
    pushdown = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("hdf5_cube").options(paths="\n".join(paths), value=value, dates=dates, layers=",".join(layers), pushdown=pushdown, **options).load()


def _read_whole(spark: SparkSession, paths: list[str], names: Layout, window: Window) -> DataFrame:
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = memoryview(content.as_buffer())
                cube = Cube(Hdf5(lambda at, size, raw=raw: bytes(raw[at : at + size])), names, window)
                for rows in cube.batches(0, int(np.prod([len(k) for k in cube.offsets()], dtype=np.int64))):
                    yield _with_name(_stem(path), rows)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(expand, _schema(names.layers))


def quality(coherence: float, residual: float, gaps: float, loops: float) -> Column:
    """A cell's layers pass: coherence at least, residual, gaps and loop errors at most; a missing one fails."""
    ok = (F.col("coh_avg") >= coherence) & (F.col("resid_rms") <= residual) & (F.col("n_gap") <= gaps) & (F.col("n_loop_err") <= loops)
    return F.coalesce(ok, F.lit(False))
