"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. A scan hashes every text's word n-grams (64 bits).  Texts with equal sets
   are one class; one representative goes on, as a numbered set.
2. MinHash signatures are cut into bands.  Rows per band and band count follow
   from the threshold and the target recall (``band_plan``).
3. Sets are shuffled on band hashes.  Each bucket contributes a star (every
   member with its first one), never its pairs: a batch sends one row a bucket and
   a spanning forest of what it united itself, so a bucket of any size is a row a
   batch.  Connected components of the stars are coarse groups that hold every
   candidate pair.
4. The full n-gram sets of grouped representatives are fetched by a second scan,
   in which a bounded filter of keys (``membership``) drops most other texts
   before the join shuffles them.  A group is split into blocks of bounded size
   and dealt out as block pairs; within one, intersections are counted for all
   pairs at once by matrix products.  Pairs never become rows: a block pair
   returns for each member its number of links and the smallest member it is
   connected to.
5. The smallest member of a group in one block names its class; components over
   the verified links do for groups that were split.

Joins on a key that many rows share (a set of many copies, a class of many sets)
are plain equi-joins: adaptive execution splits such a partition at run time.

Words are runs of digits, a-z and characters beyond ASCII after lower-casing
A-Z.  A text with fewer words than ``n`` (but at least one) has one n-gram of
all of them.

Defined results: texts without words (null and empty ones too) link to nothing
and are classes of their own; rows with a null id are ignored; rows with the
same id and the same text are one document; different texts that share an id are
classes of their own, and their id gets the smaller class id and the larger
number of links; a class id is the smallest document id in it, ties between
sets that share it go to the smaller set hash; a similarity equal to the
threshold is a link; an empty table gives no rows; ids may be of any type with an
order and keep it; other columns take no part, whatever their names, and are kept
by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.decontam import words
from tessera.llm.membership import key_filter
from tessera.llm.textbatch import fresh, map_slices
from tessera.operators.graph import connected_components, spanning
from tessera.runtime import cut_lineage, release

NGRAM, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 128
BLOCK_GRAMS, BLOCK_ROWS = 4_000_000, 16_384
TILE = 2048
SEED = 11
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the steepest banding of at most ``most`` hashes whose chance to
    propose a pair at the threshold is at least ``recall``."""
    plan = None
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = math.ceil(math.log1p(-recall) / math.log1p(-chance)) if chance < 1 else 1
        if bands * rows <= most:
            plan = (bands, rows)
    if plan is None:
        raise ValueError("no banding of so few hashes reaches this recall")
    return plan


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hashed n-gram sets; a bounded cache keeps word hashes."""

    def __init__(self, n: int, entries: int = 200_000):
        self.n, self.entries, self.cache = n, entries, {}

    def _word(self, w: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self.cache) >= self.entries:
            self.cache.clear()
        self.cache[w] = value
        return value

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes."""
        found = words(text or b"")
        if not found:
            return np.zeros(0, dtype=np.uint64)
        get, miss = self.cache.get, self._word
        codes = np.array([v if (v := get(w)) is not None else miss(w) for w in found], dtype=np.uint64)
        n = min(self.n, len(codes))
        size = len(codes) - n + 1
        out = codes[:size].copy()
        for k in range(1, n):
            out = _mix(out) + codes[k : k + size]
        return np.unique(_mix(out + np.uint64(n)))


class Signature:
    def __init__(self, bands: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        count = bands * rows
        self.a = rng.integers(1, 1 << 62, size=(count, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size=(count, 1), dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """One signed 64-bit hash for each band."""
        low = np.full(self.bands * self.rows, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(grams), 4096):
            part = grams[at : at + 4096][None, :] * self.a + self.b
            part ^= part >> np.uint64(32)
            np.minimum(low, (part * _MIX1).min(1), out=low)
        out = np.arange(self.bands, dtype=np.uint64)
        for column in low.reshape(self.bands, self.rows).T:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        return out.view(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def features(source: DataFrame, n: int, plan: tuple[int, int]) -> DataFrame:
    """(id, text_hash, set_hash, n_grams, bands) of every row; no set and no bands without words."""
    sign = Signature(*plan)
    kept = [source.schema["id"], source.schema["text_hash"]]
    made = [T.StructField("set_hash", T.BinaryType()), T.StructField("n_grams", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([*kept, *made])

    def start():
        gram_set = Grams(n)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, sizes, bands = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                grams = gram_set(text)
                sizes.append(len(grams))
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                bands.append(sign(grams) if len(grams) else None)
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                names=schema.names,
            )

        return work

    return source.mapInArrow(lambda batches: map_slices("text", start())(batches), schema)


_LINKS = "node long, links long, low long, whole boolean"


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node) for the first node of each band hash of a batch.

    Other nodes of the hash are united with the first at once; the forest of these
    unions goes on as buckets of two, under hashes of their own.
    """
    for batch in batches:
        bands, node = batch.column("bands"), batch.column("node").to_numpy(zero_copy_only=False)
        width = np.diff(bands.offsets.to_numpy())
        h = bands.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(node, width)
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        child, root = spanning(of, of[first][place])
        pair = _mix(child.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _mix(root.astype(np.uint64))).view(np.int64)
        columns = np.concatenate((h[first], pair, pair)), np.concatenate((of[first], child, root))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node"])


def _bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each node with the first of its hash; rows come ordered by hash."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "node"))
        begins = np.concatenate(([True], h[1:] != h[:-1]))
        first = node[np.flatnonzero(begins)]
        if last is not None and last[0] == h[0]:
            first[0] = last[1]
        last = int(h[-1]), int(first[-1])
        child, root = spanning(node, first[np.cumsum(begins) - 1])
        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["a", "b"])


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted hash sets.

    Grams of many sets are counted by a matrix product, grams of few by their
    pairs; grams that one side lacks are skipped.
    """
    nl, nr = len(left), len(right)
    lf, rf = np.concatenate(left), np.concatenate(right)
    li = np.repeat(np.arange(nl), [len(x) for x in left])
    ri = np.repeat(np.arange(nr), [len(x) for x in right])
    names, code = np.unique(np.concatenate((lf, rf)), return_inverse=True)
    lc, rc = code[: len(lf)], code[len(lf) :]
    lcount, rcount = np.bincount(lc, minlength=len(names)), np.bincount(rc, minlength=len(names))
    out = np.zeros((nl, nr), dtype=np.float32)
    work = lcount * rcount
    dense = np.flatnonzero(work > max(64, nl * nr // 64))
    slot = np.full(len(names), -1)
    for at in range(0, len(dense), 512):
        part = dense[at : at + 512]
        slot[part] = np.arange(len(part))
        a, b = np.zeros((nl, len(part)), dtype=np.float32), np.zeros((nr, len(part)), dtype=np.float32)
        use = slot[lc] >= 0
        a[li[use], slot[lc[use]]] = 1
        use = slot[rc] >= 0
        b[ri[use], slot[rc[use]]] = 1
        out += a @ b.T
        slot[part] = -1
    sparse = (work > 0) & (work <= max(64, nl * nr // 64))
    lk, rk = sparse[lc], sparse[rc]
    if lk.any():
        lo, ro = np.argsort(lc[lk], kind="stable"), np.argsort(rc[rk], kind="stable")
        la, ra, key = li[lk][lo], ri[rk][ro], lc[lk][lo]
        begin = np.searchsorted(rc[rk][ro], np.arange(len(names) + 1))
        reps = (begin[key + 1] - begin[key]).astype(np.int64)
        for at in _even_parts(reps, 8_000_000):
            r = reps[at]
            first = np.repeat(begin[key[at]], r) + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
            flat = np.repeat(la[at], r) * nr + ra[first]
            out += np.bincount(flat, minlength=nl * nr).reshape(nl, nr)
    return out


def _even_parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield slice(a, b)


def link_block(
    weight: np.ndarray, half: np.ndarray, sets: list[np.ndarray], threshold: float, cross: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Links and first connected member of each member of one block pair.

    cross: the cell pairs two blocks, and only pairs across count, none if a
    block is empty; else all pairs do.  half: 0 or 1, the member's block.
    """
    n = len(sets)
    links, parent = np.zeros(n, dtype=np.int64), np.arange(n)
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    order = np.argsort(sizes, kind="stable")
    left = order[half[order] == 0] if cross else order
    right = order[half[order] == 1] if cross else order

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(0 if cross else i, len(right), TILE):
            b = right[j : j + TILE]
            # Sizes are sorted: a pair below the threshold by size alone ends the search.
            if min(sizes[a[-1]], sizes[b[-1]]) < threshold * max(sizes[a[0]], sizes[b[0]]):
                continue
            both = _shared_counts([sets[x] for x in a], [sets[x] for x in b])
            total = sizes[a][:, None] + sizes[b][None, :] - both
            linked = both >= np.float32(threshold) * total - 1e-4
            if not cross and i == j:
                np.fill_diagonal(linked, False)
            links[a] += linked @ weight[b]
            if cross or i != j:
                links[b] += linked.T @ weight[a]
            _unite(linked, a, b, parent, root)
    top = np.array([root(i) for i in range(n)])
    low = np.full(n, n)
    np.minimum.at(low, top, np.arange(n))
    return links, low[top]


def _unite(linked: np.ndarray, a: np.ndarray, b: np.ndarray, parent: np.ndarray, root) -> None:
    """Spanning links only: a column is joined to the first row it links, and so on."""
    seen = np.full(len(b), -1)
    for k in np.flatnonzero(linked.any(1)):
        row = np.flatnonzero(linked[k])
        ra = root(int(a[k]))
        fresh = row[seen[row] < 0]
        old = np.unique(seen[row[seen[row] >= 0]])
        for x in (*b[fresh].tolist(), *a[old].tolist()):
            rb = root(int(x))
            if rb != ra:
                parent[max(ra, rb)] = min(ra, rb)
                ra = min(ra, rb)
        seen[row] = k


def _numbered_sets(rows: DataFrame) -> DataFrame:
    """(node, set_hash, rep (id, text_hash), copies, n_grams, bands): a numbered row for each distinct set."""
    worded = rows.where(F.col("n_grams") > 0)
    first = worded.groupBy("set_hash").agg(
        F.min(F.struct("id", "text_hash")).alias("rep"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams")
    )
    ids = worded.select("set_hash", "id").distinct().groupBy("set_hash").agg(F.count(F.lit(1)).alias("copies"))
    return cut_lineage(first.join(ids, "set_hash").withColumn("node", F.monotonically_increasing_id()))


def _placed_members(sets: DataFrame) -> DataFrame:
    """Sets of coarse groups with their group (root), its number of blocks (parts) and their own block."""
    buckets = sets.select("node", "bands").mapInArrow(_bucket_rows, "h long, node long").repartition("h").sortWithinPartitions("h")
    coarse = connected_components(buckets.mapInArrow(_bucket_stars, "a long, b long"), contracted=True)
    members = sets.select("node", "set_hash", "rep", "copies", "n_grams").join(coarse, "node")
    load = members.groupBy("root").agg(F.sum("n_grams").alias("grams"), F.count(F.lit(1)).alias("size"))
    parts = F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("size") / BLOCK_ROWS)).cast("int")
    # Only the large groups need their number of blocks; the others have one.
    split = load.select("root", parts.alias("parts")).where(F.col("parts") > 1)
    placed = members.join(split, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return cut_lineage(placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))


def _fetched(source: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """(node, root, copies, parts, own, grams): the full n-gram sets of the members."""
    key = F.xxhash64("id", "text_hash")
    wanted = placed.select("node", "root", "copies", "parts", "own", "set_hash", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    near = key_filter(placed.select(F.xxhash64("rep.id", "rep.text_hash").alias("key")), "key")
    texts = source.where(near.may_hold(key))
    wanted = texts.join(wanted, (F.col("id") == F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
    wanted = wanted.select("node", "root", "copies", "parts", "own", "set_hash", "text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_set = Grams(n)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [gram_set(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            same = pa.array([hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in found], pa.binary()).equals(batch.column("set_hash").cast(pa.binary()))
            if not same:  # a text of the same id and hash that is another one
                keep = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() == h for g, h in zip(found, batch.column("set_hash").to_pylist(), strict=True)]
                batch, found = batch.filter(pa.array(keep)), [g for g, k in zip(found, keep, strict=True) if k]
            grams = pa.array([g.tobytes() for g in found], pa.binary())
            return batch.select(["node", "root", "copies", "parts", "own"]).append_column("grams", grams)

        yield from map_slices("text", work)(batches)

    return wanted.mapInArrow(fetch, "node long, root long, copies long, parts int, own int, grams binary")


def _verified(fetched: DataFrame, threshold: float) -> DataFrame:
    """(node, links, low, whole) of every member in every block pair; whole: the group is one block."""
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"), (o < F.col("own")).cast("int").alias("half")),
    )
    dealt = (
        fetched.select("node", "root", "copies", "parts", "grams", F.explode(cells).alias("c"))
        .select("root", "c.i", "c.j", "node", "copies", "c.half", "parts", "grams")
        .repartition("root", "i", "j")
        .sortWithinPartitions("root", "i", "j", "node")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            nodes, weight, half, grams = zip(*held, strict=True)
            links, low = link_block(np.array(weight), np.array(half), [np.frombuffer(g, dtype=np.uint64) for g in grams], threshold, key[1] != key[2])
            own = np.array(nodes)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(links), pa.array(own[low]), pa.array([key[3] == 1] * len(own))], ["node", "links", "low", "whole"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "parts", "node", "copies", "half", "grams")]
            for *cell, node, copies, half, grams in zip(*columns, strict=True):
                if cell != key:
                    out = close()
                    if out is not None:
                        yield out
                    held, key = [], cell
                if held and held[-1][0] == node:
                    continue  # a repeated row of the representative
                held.append((node, copies, half, grams))
        out = close()
        if out is not None:
            yield out

    return cut_lineage(dealt.mapInArrow(link, _LINKS))


def _classified(source: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """(id, text_hash, set_hash, lead, n_links) of every row of ``source``.

    ``lead`` (id, set_hash) is the first set of the row's class, by id; it is null
    for texts without words.
    """
    rows = cut_lineage(features(source, n, band_plan(threshold, recall)))
    sets = _numbered_sets(rows)
    placed = _placed_members(sets)
    links = _verified(_fetched(source, placed, n), threshold)
    classes = links.where("whole").select("node", F.col("links"), F.col("low").alias("root"))
    if not links.where(~F.col("whole")).isEmpty():
        many = links.where(~F.col("whole"))
        joined = connected_components(many.select(F.col("node").alias("a"), F.col("low").alias("b")))
        counted = many.groupBy("node").agg(F.sum("links").alias("links")).join(joined, "node", "left")
        classes = classes.unionByName(counted.select("node", "links", F.coalesce("root", "node").alias("root")))
    linked = sets.select("node", F.struct(F.col("rep.id").alias("id"), F.col("set_hash")).alias("own"), "copies").join(classes.where("links > 0"), "node", "left")
    grouped = linked.where(F.col("root").isNotNull())
    leads = grouped.groupBy("root").agg(F.min("own").alias("lead"))
    classes = linked.join(leads, "root", "left").select(
        F.col("own.set_hash").alias("set_hash"), F.coalesce("lead", "own").alias("lead"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    )
    out = cut_lineage(rows.select("id", "text_hash", "set_hash").join(classes, "set_hash", "left").select("id", "text_hash", "set_hash", "lead", "n_links"))
    for done in (rows, sets, placed, links):
        release(done)
    return out


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """(id, class_id, n_links) for every document with a non-null id.

    ``n_links`` counts the other documents whose n-gram sets have a Jaccard
    similarity of at least ``threshold``; ``class_id`` is the smallest id among
    those connected by links.
    """
    found = _classified(_source(docs, id_col, text_col), n, threshold, recall)
    return found.groupBy("id").agg(
        F.min(F.coalesce("lead.id", "id")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links")
    ).withColumnRenamed("id", id_col)


def drop_near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """``docs`` with one row of each class: one whose id names it.

    Rows with a null id stay.  Of rows with one id whose texts have the same
    n-gram set, one stays (of repeated rows that differ in other columns, the one
    whose columns hash lowest); texts without words stay, once for each id and text.
    """
    columns = docs.columns
    found = _classified(_source(docs, id_col, text_col), n, threshold, recall)
    first = F.col("set_hash").isNull() | ((F.col("lead.id") == F.col("id")) & (F.col("lead.set_hash") == F.col("set_hash")))
    # Of the rows that name a class, those with other texts of the same words and repeated rows.
    counts = found.where(first).groupBy("id", "set_hash").agg(F.min("text_hash").alias("least"), F.count(F.lit(1)).alias("rows"))
    counts = cut_lineage(counts.where(F.col("rows") > 1))
    gone = found.where(~first).select("id", "text_hash")
    repeated = not counts.isEmpty()
    if repeated:
        own = found.where(first & F.col("set_hash").isNotNull())
        gone = gone.unionByName(own.join(counts, ["id", "set_hash"]).where(F.col("text_hash") != F.col("least")).select("id", "text_hash"))
    id_, hash_ = fresh(columns, "gone_id"), fresh(columns, "gone_hash")
    gone = cut_lineage(gone.distinct().select(F.col("id").alias(id_), F.col("text_hash").alias(hash_)))
    own_hash = F.xxhash64(F.col(text_col))
    same = (F.col(id_col) == F.col(id_)) & (own_hash == F.col(hash_))
    # Rows that the filter knows not to be gone stay where they are; only the others are shuffled and looked up.
    maybe = key_filter(gone.select(F.xxhash64(id_, hash_).alias("key")), "key").may_hold(F.xxhash64(F.col(id_col), own_hash))
    kept = docs.where(~maybe).unionByName(docs.where(maybe).join(gone, same, "left_anti"))
    if not repeated:
        return kept
    many = found.where(first).groupBy("id", "text_hash").count().where(F.col("count") > 1).select(F.col("id").alias(id_), F.col("text_hash").alias(hash_))
    row, order = fresh(columns, "row"), fresh(columns, "order")
    once = (
        kept.join(many, same, "left_semi")
        .select(F.col(id_col), own_hash.alias(order), F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row))
        .groupBy(id_col, order)
        .agg(F.min_by(row, F.xxhash64(row)).alias(row))
        .select(f"{row}.*")
    )
    return kept.join(many, same, "left_anti").unionByName(once)
