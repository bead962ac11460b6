"""Connected components: edges are contracted task by task, then pointers jump to their roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.scans import positions
from tessera.runtime import cut_lineage, release

#: Edges that a task holds at a time.
CHUNK = 1_000_000
_FOREST = "a long, b long, foreign boolean"


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (a, b) but the smallest of its component, and that smallest one."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = code[: len(a)], code[len(a) :]
    low = np.arange(len(nodes))
    while True:
        ru, rv = low[u], low[v]
        if np.array_equal(ru, rv):
            break
        np.minimum.at(low, np.maximum(ru, rv), np.minimum(ru, rv))  # the larger root hangs on the smaller
        while not np.array_equal(up := low[low], low):
            low = up
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    child, root = spanning(a, b)
    foreign = ~np.isin(child, a)
    return pa.RecordBatch.from_arrays([pa.array(child), pa.array(root), pa.array(foreign)], ["a", "b", "foreign"])


def _contract(batches: Iterator[pa.RecordBatch], *, by_child: bool) -> Iterator[pa.RecordBatch]:
    """Chunks of edges as forests; with ``by_child`` rows come ordered by a, and a chunk ends where a changes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append(_columns(batch))
        size += batch.num_rows
        if size < CHUNK:
            continue
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(a, a[-1])) if by_child else len(a)
        if cut:
            yield _forest(a[:cut], b[:cut])
        held, size = [(a[cut:], b[cut:])], len(a) - cut
    if size:
        yield _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between numbers in the order of the nodes, and (node, number)."""
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    nodes = cut_lineage(positions(known.select(F.col("a").alias("node")).union(known.select("b")).distinct(), ["node"], out="number"))
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("number").alias(f"n_{c}"))
    return known.join(end("a"), "a").join(end("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b")), nodes


def connected_components(edges: DataFrame, *, contracted: bool = False) -> DataFrame:
    """(node, root) over undirected edges (a, b): root is the smallest node connected.

    ``contracted``: ``edges`` are forests of their tasks already, as ``spanning`` gives them.

    Every task first replaces its own edges by a forest, a row a node at most, so
    that no node has more rows than there are tasks, however many edges it has.
    Rounds then shuffle by the larger end and contract again, until every node has
    one parent; pointers jump to their parents' parents until all point to roots.
    Rows only ever become fewer.  Lineage is cut after each step, and the step
    before is removed.  Nodes may be of any type with an order (other than integers
    are numbered first).  Nodes without an edge to another node are absent; edges
    with a null end are ignored.
    """
    if not isinstance(edges.schema["a"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        plain, names = _numbered(edges)
        found = connected_components(plain)
        node, root = names.select("node", F.col("number").alias("n")), names.select(F.col("node").alias("root"), F.col("number").alias("r"))
        numbers = found.select(F.col("node").alias("n"), F.col("root").alias("r"))
        return numbers.join(node, "n").join(root, "r").select("node", "root")
    ends = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    forest = ends if contracted else ends.mapInArrow(lambda batches: _contract(batches, by_child=False), _FOREST)
    before = None
    while True:
        dealt = forest.select("a", "b").repartition("a").sortWithinPartitions("a")
        forest = cut_lineage(dealt.mapInArrow(lambda batches: _contract(batches, by_child=True), _FOREST))
        if before is not None:
            release(before)
        before = forest
        if forest.where("foreign").isEmpty():
            break  # every node has been seen by one chunk: it has one parent
    tree = forest.select("a", "b")
    while not tree.isEmpty():
        parent = tree.select(F.col("a").alias("c"), F.col("b").alias("d"))
        # Many nodes may share a parent; adaptive execution splits such a partition of the left side.
        jumped = tree.join(parent, F.col("b") == F.col("c"), "left").select("a", F.coalesce("d", "b").alias("b"), F.col("d").isNotNull().alias("moved"))
        jumped = cut_lineage(jumped)
        release(before)
        before, tree = jumped, jumped.select("a", "b")
        if jumped.where("moved").isEmpty():
            break
    roots = tree.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
