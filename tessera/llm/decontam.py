"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are maximal runs of digits, a-z and any character beyond ASCII, after
lower-casing A-Z.  A benchmark item contributes every window of ``n``
consecutive words; an item with fewer words (but at least one) contributes a
single window of all its words.  Training texts are scanned with a rolling
64-bit hash; every hash hit is verified word by word before it counts.

The window index is broadcast only while the benchmark is at most ``BLOCK_BYTES``
of text.  The windows of a larger one are a table: one scan of the texts hashes
their windows and passes those that a bounded filter (``membership``) does not rule
out, once for each distinct text; these are joined with the table on hash, length
and words, which verifies them.  What is found stays with the text's digest, so
texts are never written or shuffled for it, whatever the benchmark's size; rows get
it by their digest.

Defined results for odd input: a null or empty text has no words and no hits;
a null or empty item has no windows, an empty benchmark hits nothing; repeated
item rows count once per item_id; an item with null item_id contributes hits but
no id (it counts as the id ``null``); repeated documents and null ids are
treated row by row; an empty table of documents gives no rows; texts are scanned
whole, in time linear in their length; extra columns pass through, whatever
their names (``find_windows`` replaces a column named as its ``out_col``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.membership import key_filter, may_hold
from tessera.llm.textbatch import fresh, map_slices, replace_column
from tessera.runtime import cut_lineage

WINDOW = 10
BLOCK_BYTES = 4 << 20

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else (b if b in _KEEP else 0x20) for b in range(256)
)
_WORD_AT = np.array([b != 0x20 for b in _FOLD])


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which each word begins and ends."""
    inside = np.concatenate(([False], _WORD_AT[np.frombuffer(text, dtype=np.uint8)], [False]))
    step = np.diff(inside.astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class WindowIndex:
    """Hash index of all windows of one benchmark block."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW, seed: int = 7):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            found = words(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            length = min(n, len(ids))
            if not length:
                continue
            table = by_length.setdefault(length, {})
            for i in range(len(ids) - length + 1):
                table.setdefault(tuple(ids[i : i + length]), set()).add(item)
        rng = np.random.default_rng(seed)
        while True:  # until no two windows of a length share a hash
            self.code = rng.integers(1, 1 << 63, size=len(self.vocabulary) + 1, dtype=np.uint64)
            self.factor = np.uint64(rng.integers(1, 1 << 62) * 2 + 1)
            self.tables = {}
            distinct = True
            for length, table in by_length.items():
                rows = np.array(list(table), dtype=np.int64).reshape(len(table), length)
                owners = [sorted(x) for x in table.values()]
                hashes = self.rolling(self.code[rows], length)[:, 0]
                order = np.argsort(hashes)
                distinct &= bool(np.all(np.diff(hashes[order]) != 0))
                self.tables[length] = (hashes[order], rows[order], [owners[i] for i in order])
            if distinct:
                return

    def rolling(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Hash of every window of ``length`` along the last axis."""
        size = codes.shape[-1] - length + 1
        out = codes[..., :size].copy()
        for k in range(1, length):
            out = out * self.factor + codes[..., k : k + size]
        return out

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open word ranges that are hit, and the items that hit them."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in found), dtype=np.int64, count=len(found))
        seen = np.concatenate(([0], np.cumsum(ids > 0)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for length, (hashes, rows, owners) in self.tables.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(seen[length:] - seen[:-length] == length)
            if not len(at):
                continue
            value = self.code[ids[at]].copy()
            for k in range(1, length):
                value = value * self.factor + self.code[ids[at + k]]
            slot = np.searchsorted(hashes, value)
            slot[slot == len(hashes)] = 0
            for i, s in zip(at[hashes[slot] == value].tolist(), slot[hashes[slot] == value].tolist(), strict=True):
                if np.array_equal(ids[i : i + length], rows[s]):  # verified on the words
                    spans.append((i, i + length))
                    items.update(owners[s])
        return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)
_FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("hit_spans", pa.list_(pa.list_(pa.int32()))), ("hit_items", pa.list_(pa.string()))]
)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, text) of the items with a text."""
    item = F.coalesce(F.col(item_col).cast("string"), F.lit("null"))
    return benchmark.select(item.alias("item"), F.col(text_col).alias("text")).where(F.length("text") > 0)


class WindowHashes:
    """Hashes of word windows that do not depend on the task; a bounded cache keeps word hashes."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, entries: int = 200_000):
        self.entries, self.cache = entries, {}

    def codes(self, found: list[bytes]) -> np.ndarray:
        out = np.empty(len(found), dtype=np.uint64)
        for i, w in enumerate(found):
            value = self.cache.get(w)
            if value is None:
                if len(self.cache) >= self.entries:
                    self.cache.clear()
                value = self.cache[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            out[i] = value
        return out

    def windows(self, codes: np.ndarray, length: int) -> np.ndarray:
        """One signed hash for each window of so many words."""
        if len(codes) < length:
            return np.zeros(0, dtype=np.int64)
        size = len(codes) - length + 1
        out = np.full(size, np.uint64(length))
        for k in range(length):
            out = out * self.FACTOR + codes[k : k + size]
        out ^= out >> np.uint64(29)
        return (out * self.FACTOR).view(np.int64)


_WINDOW = "h long, len int, words string"


def _benchmark_windows(items: DataFrame, n: int) -> DataFrame:
    """(h, len, words, item) of every window of every item, once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WindowHashes()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = words(text)
                length = min(n, len(found))
                if length:
                    h = hashes.windows(hashes.codes(found), length)
                    spelt = [b" ".join(found[i : i + length]).decode() for i in range(len(h))]
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([length] * len(h), pa.int32()), pa.array(spelt), pa.array([item] * len(h))], ["h", "len", "words", "item"])

    return items.mapInArrow(work, f"{_WINDOW}, item string").distinct()


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _hits_by_join(docs: DataFrame, items: DataFrame, text_col: str, n: int) -> DataFrame:
    """(digest, spans, items) of every distinct text with a hit."""
    table = cut_lineage(_benchmark_windows(items, n))
    lengths = sorted(r[0] for r in table.select("len").distinct().collect())  # n at most
    near = key_filter(table.select("h").distinct(), "h")
    shared, bits = near.shared, near.bits

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, rows, seen = WindowHashes(), [], set()
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if digest in seen or not text:
                continue
            seen.add(digest)
            found = words(text)
            codes = hashes.codes(found)
            for length in lengths:
                h = hashes.windows(codes, length)
                for i in np.flatnonzero(may_hold(h, shared.value, bits)).tolist():
                    rows.append((digest, i, int(h[i]), length, b" ".join(found[i : i + length]).decode()))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["digest", "at", "h", "len", "words"])

    texts = docs.select(_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    asked = texts.mapInArrow(map_slices("text", work), "digest string, at long, h long, len long, words string").distinct()
    hits = asked.withColumn("len", F.col("len").cast("int")).join(table, ["h", "len", "words"])
    spans = hits.select("digest", "at", "len").distinct().groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("len")).alias("b")))).alias("spans")
    )
    owners = hits.select("digest", "item").distinct().groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return cut_lineage(spans.join(owners, "digest"))


def _merged(spans: Column) -> Column:
    """Disjoint ranges [a, b] that cover the same places, from ranges in order of their begin."""
    none = F.array().cast("array<array<int>>")

    def put(acc: Column, x: Column) -> Column:
        span = F.array(x["a"].cast("int"), x["b"].cast("int"))
        last = F.element_at(acc, -1)
        joined = F.array(last[0], F.greatest(last[1], span[1]))
        apart = (F.size(acc) == 0) | (F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(2)) < span[0])
        return F.when(apart, F.array_append(acc, span)).otherwise(F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), joined))

    return F.aggregate(spans, none, put)


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    out_col: str = "window_hits",
) -> DataFrame:
    """``docs`` with a struct column ``out_col`` (n_words, hit_spans, hit_items)."""
    spark = docs.sparkSession
    out = docs.drop(out_col)
    items = _items(benchmark, item_col, item_text_col)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > block_bytes:
        return _joined(out, items, text_col, n, out_col)
    index = WindowIndex([(r.item, r.text.encode()) for r in items.distinct().toLocalIterator()], n)
    shared = spark.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(text_col).cast(pa.binary()).to_pylist():
            own = words(text or b"")
            spans, owners = shared.value.scan(own)
            found.append({"n_words": len(own), "hit_spans": spans, "hit_items": sorted(owners)})
        return batch.append_column(out_col, pa.array(found, type=_FOUND_ARROW))

    return out.mapInArrow(map_slices(text_col, work), T.StructType([*out.schema.fields, T.StructField(out_col, _FOUND)]))


def _joined(docs: DataFrame, items: DataFrame, text_col: str, n: int, out_col: str) -> DataFrame:
    """``find_windows`` for a benchmark of any size.

    Rows whose text surely has no hit get their empty struct where they are; only
    the others are shuffled by digest.
    """
    hits = _hits_by_join(docs, items, text_col, n)
    taken = [*docs.columns, out_col]
    digest, count = fresh(taken, "digest"), fresh(taken, "n_words")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [len(words(t or b"")) for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
        return batch.append_column(count, pa.array(found, pa.int64()))

    counted = docs.mapInArrow(map_slices(text_col, work), T.StructType([*docs.schema.fields, T.StructField(count, T.LongType())]))
    keyed = counted.withColumn(digest, _digest(F.col(text_col)))
    maybe = key_filter(hits.select(F.xxhash64("digest").alias("key")), "key").may_hold(F.xxhash64(F.col(digest)))
    struct = lambda spans, owners: F.struct(F.col(count).alias("n_words"), spans.alias("hit_spans"), owners.alias("hit_items")).cast(_FOUND).alias(out_col)
    none = struct(F.array().cast("array<array<int>>"), F.array().cast("array<string>"))
    found = hits.select(F.col("digest").alias("__digest"), "spans", "items").withColumnsRenamed({"spans": "__spans", "items": "__items"})
    met = keyed.where(maybe).join(found, F.col(digest) == F.col("__digest"), "left")
    known = F.when(F.col("__digest").isNotNull(), struct(_merged(F.col("__spans")), F.col("__items"))).otherwise(none).alias(out_col)
    return keyed.where(~maybe).select(*docs.columns, none).unionByName(met.select(*docs.columns, known))


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: word count, words hit, items found and whether any was."""
    column = fresh([id_col, text_col], "window_hits")
    found = find_windows(docs.select(id_col, text_col), benchmark, text_col=text_col, out_col=column, **options)
    hits = F.col(column)
    covered = F.aggregate(hits["hit_spans"], F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]).cast("long"))
    return found.select(
        F.col(id_col),
        hits["n_words"].alias("n_words"),
        covered.alias("n_hit"),
        F.size(hits["hit_items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["hit_items"], ",").cast("binary"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    begin, end = word_offsets(raw)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : begin[a]])
        at = int(end[b - 1])
    out.append(raw[at:])
    return b"".join(out).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", action: str = "drop", **options
) -> DataFrame:
    """``docs`` without contaminated rows (``action='drop'``) or spans (``'cut'``)."""
    if action not in ("drop", "cut"):
        raise ValueError("action must be 'drop' or 'cut'")
    column = fresh(docs.columns, "window_hits")
    found = find_windows(docs, benchmark, text_col=text_col, out_col=column, **options)
    if action == "drop":
        return found.where(F.size(F.col(column)["hit_spans"]) == 0).drop(column)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, hits = batch.column(text_col).to_pylist(), batch.column(column).to_pylist()
        clean = [cut_spans(t, h["hit_spans"]) if h["hit_spans"] else t for t, h in zip(texts, hits, strict=True)]
        out = replace_column(batch, text_col, pa.array(clean, type=pa.string()))
        return out.remove_column(out.schema.get_field_index(column))

    return found.mapInArrow(map_slices(text_col, work), docs.schema)
