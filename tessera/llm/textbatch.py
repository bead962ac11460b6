"""Arrow batch helpers shared by the text operators.

Every operator here works on ``mapInArrow`` batches.  A batch may hold very
long texts, so the Python side only ever materialises a bounded slice of it
(``SLICE_BYTES`` of text, or a single text if that alone is longer).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SLICE_ROWS = 512


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Split ``batch`` so that each part holds at most ``SLICE_BYTES`` of text."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    group = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    edges = np.flatnonzero(np.diff(group)) + 1
    start = 0
    for stop in [*edges.tolist(), batch.num_rows]:
        while start < stop:
            rows = min(SLICE_ROWS, stop - start)
            yield batch.slice(start, rows)
            start += rows


def map_slices(
    column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``work`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at).with_type(values.type), values)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one space between them, and each text's start."""
    flat = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    return flat, starts


def fresh(taken: Iterable[str], name: str) -> str:
    """``name`` for a helper column, lengthened until no column of ``taken`` has it (in any case of letters)."""
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name
