"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are centred, scaled to unit length, padded to a power of two and
turned by fast Hadamard pseudo-rotations (three rounds of random signs and a
Hadamard transform).  A hash is the signed axis nearest to the result; a table's
key joins ``depth`` hashes of independent rotations.  ``depth`` grows with the
number of vectors, so that a key's bucket holds ``BUCKET`` vectors at most on
average.  A query probes the keys of each table whose axes fall short of the
nearest ones by the least (sum of squares), and all candidates are reranked by
their exact distance.

Vectors are dealt out by table and all axes of the key but the last; a query
goes there once with the list of keys that it probes there.  A place of any size
is split into blocks of bounded size on both sides, so no task holds an
unbounded bucket; only the best ``k + 1`` ids of each block leave it.

Exact copies are one class, hashed and compared once; a class keeps the
smallest ``k + 1`` of its ids, which is all that a top k by (distance, id) can
need.  Distances are Euclidean in double precision on the original vectors.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part, as query or candidate;
rows with a null id take no part; ties go to the smaller id; repeated rows count
once; an id that occurs with several vectors has the smallest distance of any
of them, as query and as neighbour, and each query id has each neighbour id
once; a query that meets no more than ``k`` ids by its probes is searched again
over all rows; fewer candidates than ``k`` give fewer rows; an empty table gives
none; columns other than id and vector take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import cut_lineage

#: Tables and probed keys of each, by depth; beyond the last depth the number of probes grows by the last factor.
TABLES = (16, 10, 16)
PROBES = (6, 300, 5000)
#: A key's bucket holds so many vectors at most on average.
BUCKET = 64
BLOCK = 8192
QUERY_BLOCK = 2048
#: Vectors of queries are broadcast up to so many bytes, and shipped to every place they ask in beyond.
QUERY_BYTES = 64 << 20
#: Recall to reach, what a measurement must exceed it by, and the queries that measure it against a full scan.
RECALL, MARGIN, MEASURED = 0.9, 0.02, 128
SCAN_BLOCK = 1024
#: Rows of the table of places that are broadcast at most; a larger one is joined by shuffle.
GRID = 200_000
SEED = 20240117


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, scaled to keep lengths."""
    rows, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(rows, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(rows, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` keys of ``depth`` independent hashes each, for vectors with ``dim`` components."""

    def __init__(self, dim: int, centre: np.ndarray, tables: int, depth: int = 1, seed: int = SEED):
        self.width = width_of(dim)
        self.dim, self.centre, self.tables, self.depth = dim, centre, tables, depth
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, depth, 3, self.width))

    def turned(self, vectors: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each table the scores of all signed axes (vector, axis) under each of its rotations."""
        x = np.zeros((len(vectors), self.width))
        x[:, : self.dim] = vectors - self.centre
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(norm > 0, norm, 1)
        for table in self.signs:
            out = []
            for rounds in table:
                y = x
                for signs in rounds:
                    y = hadamard(y * signs)
                out.append(np.concatenate((y, -y), axis=1))
            yield out

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, table) -> key: the nearest axes as digits of a number."""
        out = np.zeros((len(vectors), self.tables), dtype=np.int64)
        for t, scores in enumerate(self.turned(vectors)):
            for s in scores:
                out[:, t] = out[:, t] * (2 * self.width) + s.argmax(1)
        return out

    def probes(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """(vector, table, probe) -> key, those that fall short by the least."""
        axes = 2 * self.width
        count = min(count, axes**self.depth)
        near = min(axes, max(math.ceil((8 * count) ** (1 / self.depth)), math.ceil(count ** (1 / self.depth))))
        out = np.empty((len(vectors), self.tables, count), dtype=np.int64)
        for t, scores in enumerate(self.turned(vectors)):
            short, key = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), dtype=np.int64)
            for s in scores:
                axis = np.argpartition(-s, near - 1, axis=1)[:, :near]
                gap = (s.max(1, keepdims=True) - np.take_along_axis(s, axis, 1)) ** 2
                short = (short[:, :, None] + gap[:, None, :]).reshape(len(vectors), -1)
                key = (key[:, :, None] * axes + axis[:, None, :]).reshape(len(vectors), -1)
            best = np.argpartition(short, count - 1, axis=1)[:, :count]
            out[:, t] = np.take_along_axis(key, best, 1)
        return out


def width_of(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def search_plan(rows: int, dim: int, depth: int | None = None) -> tuple[int, int, int]:
    """(depth, tables, probes) for so many vectors, or for a given depth."""
    axes, deep = 2 * width_of(dim), depth or 1
    while depth is None and rows / axes**deep > BUCKET:
        deep += 1
    depth = deep
    at = min(depth, len(TABLES)) - 1
    return depth, TABLES[at], math.ceil(PROBES[at] * (PROBES[-1] / PROBES[-2]) ** (depth - 1 - at))


def usable(vector: Column, dim: int | None = None) -> Column:
    fine = vector.isNotNull() & (F.size(vector) > 0)
    if dim is not None:
        fine &= F.size(vector) == dim
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return fine & ~bad & F.exists(vector, lambda v: v != 0)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _with_keys(classes: DataFrame, model: CrossPolytope) -> DataFrame:
    """``classes`` with their keys, one for each table."""
    shared = classes.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys = m.keys(_vectors(batch.column("vec"), m.dim))
                starts = pa.array(np.arange(0, keys.size + 1, m.tables, dtype=np.int32))
                yield batch.append_column("keys", pa.ListArray.from_arrays(starts, pa.array(keys.reshape(-1))))

    return classes.mapInArrow(work, T.StructType([*classes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))


_PROBES = T.StructType(
    [T.StructField("tbl", T.IntegerType()), T.StructField("head", T.LongType()), T.StructField("tails", T.ArrayType(T.IntegerType()))]
)


def _with_probes(asking: DataFrame, model: CrossPolytope, probes: int) -> DataFrame:
    """``asking`` with the places that each class asks in: table, head and tails of the keys."""
    shared = asking.sparkSession.sparkContext.broadcast(model)
    rows = max(1, (1 << 21) // (model.tables * probes))  # probes held at once

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                keys = np.sort(m.probes(_vectors(batch.column("vec"), m.dim), probes), axis=2)
                head, tail = keys // (2 * m.width), (keys % (2 * m.width)).reshape(-1).astype(np.int32)
                first = np.ones(head.shape, dtype=bool)
                first[:, :, 1:] = head[:, :, 1:] != head[:, :, :-1]
                row, tbl, _ = np.nonzero(first)
                starts = np.append(np.flatnonzero(first.reshape(-1)), tail.size).astype(np.int32)
                tails = pa.ListArray.from_arrays(pa.array(starts), pa.array(tail))
                places = pa.StructArray.from_arrays([pa.array(tbl.astype(np.int32)), pa.array(head[first]), tails], names=_PROBES.names)
                each = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)
                yield batch.append_column("places", pa.ListArray.from_arrays(pa.array(each), places))

    return asking.mapInArrow(work, T.StructType([*asking.schema.fields, T.StructField("places", T.ArrayType(_PROBES))]))


class _Block:
    """Vectors of one block, in the order of the last axis of their key."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, pa.Array]], k: int):
        tail = np.concatenate([p[0] for p in parts])
        order = np.argsort(tail, kind="stable")
        self.tail, self.vectors, self.k = tail[order], np.concatenate([p[1] for p in parts])[order], k
        ids = pa.concat_arrays([p[2] for p in parts]).take(pa.array(order))
        self.starts = np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        self.ids = ids.flatten()
        self.repeats = len(self.ids.unique()) < len(self.ids)
        self.square = np.einsum("ij,ij->i", self.vectors, self.vectors)

    def nearest(self, vectors: np.ndarray, tails: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(query, score, id) of the first ``k + 1`` ids of each query, and of all that may tie with the last."""
        query, row = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        asked = np.repeat(np.arange(len(tails)), tails.value_lengths().to_numpy())
        wanted = np.zeros((len(tails), int(max(self.tail[-1], tails.flatten().to_numpy().max(initial=0))) + 1), dtype=bool)
        wanted[asked, tails.flatten().to_numpy()] = True
        step = max(1, (1 << 22) // len(self.tail))
        for at in range(0, len(vectors), step):
            part = vectors[at : at + step]
            # Squares by products only choose rows, with room for their rounding.
            rough = self.square + np.einsum("ij,ij->i", part, part)[:, None] - 2 * part @ self.vectors.T
            room = 1e-9 * (1 + np.abs(rough).max(1, keepdims=True))
            rough[~wanted[at : at + step][:, self.tail]] = np.inf
            if self.repeats:
                limit = np.array([[self._limit(r)] for r in rough])
            else:
                limit = np.partition(rough, self.k, axis=1)[:, [self.k]] if len(self.tail) > self.k else np.full((len(part), 1), np.inf)
            q, r = np.nonzero((rough <= limit + room) & np.isfinite(rough))
            query, row = np.append(query, q + at), np.append(row, r)
        score = np.empty(len(row))
        for at in range(0, len(row), 65_536):
            gap = self.vectors[row[at : at + 65_536]] - vectors[query[at : at + 65_536]]
            score[at : at + 65_536] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        count = self.starts[row + 1] - self.starts[row]
        each = np.repeat(self.starts[row] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(query, count), np.repeat(score, count), self.ids.take(pa.array(each))

    def _limit(self, rough: np.ndarray) -> float:
        """Square at which ``k + 1`` different ids are met."""
        seen: set = set()
        for i in np.argsort(rough, kind="stable").tolist():
            seen.update(self.ids[self.starts[i] : self.starts[i + 1]].to_pylist())
            if len(seen) > self.k:
                return rough[i]
        return np.inf


def _search(classes: DataFrame, asking: DataFrame, model: CrossPolytope, probes: int, k: int) -> DataFrame:
    """(qcls, score, id): at least the first ``k + 1`` ids found for each asking class."""
    dim = model.dim
    axes = 2 * model.width
    keyed, probing = cut_lineage(_with_keys(classes, model)), cut_lineage(_with_probes(asking, model, probes))
    base = keyed.select("cls", "vec", "ids", F.posexplode("keys").alias("tbl", "key")).select(
        "tbl", F.floor(F.col("key") / axes).alias("head"), (F.col("key") % axes).cast("int").alias("tail"), "cls", "vec", "ids"
    )
    few = asking.count() * dim * 8 <= QUERY_BYTES
    shared = asking.sparkSession.sparkContext.broadcast(_collected(asking, dim)) if few else None
    own = F.lit(None).cast(asking.schema["vec"].dataType).alias("vec") if few else F.col("vec")
    asks = probing.select("cls", own, F.explode("places").alias("p")).select("p.*", "cls", "vec")
    place = ["tbl", "head"]
    # Blocks of each place that both sides have, from its size on both sides.
    sizes = base.groupBy(*place).agg(F.count(F.lit(1)).alias("nb"))
    asked = asks.groupBy(*place).agg(F.count(F.lit(1)).alias("nq"))
    grid = cut_lineage(
        sizes.join(asked, place).select(
            *place, F.ceil(F.col("nb") / BLOCK).cast("int").alias("bs"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("qs")
        )
    )
    if grid.count() <= GRID:
        grid = F.broadcast(grid)
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = [*place, "b", "s"]
    base = base.join(grid, place).withColumn("b", mine("bs")).withColumn("s", each("qs"))
    asks = asks.join(grid, place).withColumn("s", mine("qs")).withColumn("b", each("bs"))
    ids = base.schema["ids"].dataType
    tagged = base.select(*cell, F.lit(False).alias("ask"), F.lit("").alias("cls"), "vec", "ids", F.array("tail").alias("tails")).unionByName(
        asks.select(*cell, F.lit(True).alias("ask"), "cls", "vec", F.array().cast(ids).alias("ids"), "tails")
    )
    dealt = tagged.repartition(*cell).sortWithinPartitions(*cell, "ask")
    schema = T.StructType([T.StructField("qcls", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("id", ids.elementType)])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_for, block = [], None, None
        for batch in batches:
            key = list(zip(*[batch.column(c).to_pylist() for c in cell], strict=True))
            ask = batch.column("ask").to_pylist()
            at = 0
            while at < len(key):
                to = at + 1
                while to < len(key) and key[to] == key[at] and ask[to] == ask[at]:
                    to += 1
                part = batch.slice(at, to - at)
                if key[at] != held_for:
                    held, held_for, block = [], key[at], None
                if not ask[at]:
                    held.append((part.column("tails").flatten().to_numpy(), _vectors(part.column("vec"), dim), part.column("ids")))
                elif held:
                    block = block or _Block(held, k)
                    for q in range(0, part.num_rows, 256):
                        some = part.slice(q, 256)
                        if shared is None:
                            vectors = _vectors(some.column("vec"), dim)
                        else:
                            at_, matrix = shared.value
                            vectors = matrix[[at_[c] for c in some.column("cls").to_pylist()]]
                        who, score, near = block.nearest(vectors, some.column("tails"))
                        if len(who):
                            yield pa.RecordBatch.from_arrays([some.column("cls").take(pa.array(who)), pa.array(score), near], names=schema.names)
                at = to

    return dealt.mapInArrow(rerank, schema)


def _collected(asking: DataFrame, dim: int) -> tuple[dict[str, int], np.ndarray]:
    """Names and vectors of a bounded number of queries."""
    table = asking.select("cls", "vec").toArrow()
    return {c: i for i, c in enumerate(table.column("cls").to_pylist())}, _vectors(table.column("vec"), dim)


def _scan(classes: DataFrame, asking: DataFrame, dim: int, k: int) -> DataFrame:
    """(qcls, score, id): the first ``k + 1`` ids of each asking class among each batch of all classes; blocks of queries are broadcast."""
    ids = classes.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("qcls", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("id", ids)])
    blocks = -(-asking.count() // SCAN_BLOCK) or 1
    out = None
    for b in range(blocks):
        part = asking.where(F.pmod(F.xxhash64(F.lit(SEED), "cls"), F.lit(blocks)) == b) if blocks > 1 else asking
        shared = asking.sparkSession.sparkContext.broadcast(_collected(part, dim))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            who_is = pa.array(list(names))
            tails = pa.array([[0]] * len(matrix), pa.list_(pa.int32()))
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(at, BLOCK)
                    if not len(matrix):
                        continue
                    block = _Block([(np.zeros(batch.num_rows, dtype=np.int32), _vectors(batch.column("vec"), dim), batch.column("ids"))], k)
                    who, score, near = block.nearest(matrix, tails)
                    yield pa.RecordBatch.from_arrays([who_is.take(pa.array(who)), pa.array(score), near], names=schema.names)

        one = classes.select("vec", "ids").mapInArrow(work, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _mean(rows: DataFrame, dim: int) -> np.ndarray:
    """Mean vector of all rows, from one partial sum of each task; rounded, so that their order has no say."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            total += _vectors(batch.column("vec"), dim).sum(0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total), pa.array(np.full(dim, n))], names=["at", "total", "n"])

    sums = rows.select("vec").mapInArrow(work, "at int, total double, n long").groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return np.round(np.array([r.mean for r in sums.orderBy("at").collect()]), 9)


def nearest(
    vectors: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    tables: int | None = None,
    probes: int | None = None,
    depth: int | None = None,
    recall: float = RECALL,
    exact: bool = False,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows found for each query row.

    ``queries`` is a condition on ``vectors`` that says which rows are queries; a
    query's own id is never its neighbour.  Depth, tables and probes follow from
    the number of different vectors (``search_plan``) where they are not given.
    Unless ``probes`` are given, they are doubled until ``MEASURED`` queries, picked
    by hash and compared with a full scan, find ``recall`` of their neighbours (and
    ``MARGIN`` more, for what a sample may err).
    ``exact`` scans all vectors for all queries instead.
    """
    spark = vectors.sparkSession
    out = f"query_id {dict(vectors.dtypes)[id_col]}, rank int, {id_col} {dict(vectors.dtypes)[id_col]}, score double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    widths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], out)
    dim = widths[0][0]
    # 128 bits name a class.
    cls = F.concat_ws(":", F.xxhash64("vec"), F.xxhash64(F.lit(SEED), "vec"))
    rows = rows.where(F.size("vec") == dim).withColumn("cls", cls)
    centre = _mean(rows, dim)
    # A class of exact copies with its smallest ids; the limit applies before the shuffle too.
    place = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
    members = rows.groupBy("cls", "id").agg(F.first("vec").alias("vec")).withColumn("place", place).where(F.col("place") <= k + 1)
    classes = cut_lineage(members.groupBy("cls").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids")))
    asking = cut_lineage(rows.where("q").select("cls", F.col("id").alias("query_id"), "vec").dropDuplicates(["cls", "query_id"]))
    asking_classes = cut_lineage(asking.dropDuplicates(["cls"]).select("cls", "vec"))
    planned = search_plan(classes.count(), dim, depth)
    measured = probes is None and not exact
    depth, tables, probes = (own or by_rule for own, by_rule in zip((depth, tables, probes), planned, strict=True))
    # Each id found once for each class, then the first k + 1 of them.
    first = F.row_number().over(Window.partitionBy("qcls").orderBy("score", "id"))
    cut = lambda found: cut_lineage(
        found.groupBy("qcls", "id").agg(F.min("score").alias("score")).withColumn("place", first).where(F.col("place") <= k + 1).drop("place")
    )
    model = CrossPolytope(dim, centre, tables, depth)
    if measured:
        some = cut_lineage(asking_classes.orderBy(F.xxhash64(F.lit(SEED), "cls"), "cls").limit(MEASURED))
        # Copies of the query share its keys and are always found; they would flatter the figure.
        true = cut_lineage(cut(_scan(classes, some, dim, k)).where("score > 0").select("qcls", "id"))
        wanted = min(recall + MARGIN, 1.0) * true.count()
        while probes < (2 * width_of(dim)) ** depth:
            if true.join(cut(_search(classes, some, model, probes, k)), ["qcls", "id"], "left_semi").count() >= wanted:
                break
            probes = min(2 * probes, (2 * width_of(dim)) ** depth)
    best = cut(_scan(classes, asking_classes, dim, k) if exact else _search(classes, asking_classes, model, probes, k))
    # Queries that met too few ids probe every axis of one table, which meets all rows.
    full = best.groupBy("qcls").count().where(F.col("count") > k).select(F.col("qcls").alias("cls"))
    short = cut_lineage(asking_classes.join(full, "cls", "left_anti"))
    if not short.isEmpty():
        rest = cut(_search(classes, short, CrossPolytope(dim, centre, 1), 2 * width_of(dim), k))
        best = best.join(short.select(F.col("cls").alias("qcls")), "qcls", "left_anti").unionByName(rest)
    # An id that asks with several vectors keeps the smallest distance to each other id.
    hits = asking.select("query_id", F.col("cls").alias("qcls")).join(best, "qcls").where(F.col("id") != F.col("query_id"))
    hits = hits.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return hits.select("query_id", rank.cast("int").alias("rank"), F.col("id").alias(id_col), "score").where(F.col("rank") <= k)
