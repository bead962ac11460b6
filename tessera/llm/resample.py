"""Importance resampling towards a target corpus by hashed n-gram features.

Features of a text are its runs of 1 to 3 consecutive words.  Each falls into one
of ``BUCKETS`` buckets by its bytes' CRC-32; a bucket's gain is the smoothed log
ratio of its share in the target (the benchmark) and in the raw corpus, in
thousandths.  A document's weight is the sum of its features' gains; a Gumbel
draw, fixed by id and seed, is added, and the highest scores are kept: a sample
without replacement with probability proportional to the exponential weight.

Hashing is by integers: a task gives every distinct word of its slice an id (the
dictionary), a bigram is a pair of ids and a trigram a pair of bigram and word
ids; distinct tuples are found with NumPy, the bytes of each are put together and
hashed once (the CRC of a tuple goes on from that of its prefix), and counts are
joined back by tuple number.  The dictionary is a slice's own: a global one would
shuffle every word of the corpus to save hashes that cost less than that.

Texts are read twice, for the bucket counts and for the weights, and never leave
a task.  A task sends a row a bucket at most; gains are a table of ``BUCKETS``
numbers, and that is all a broadcast holds.  Ranks come from a range partitioning
by score (``scans.positions``), so drawing any share never gathers rows in a task.

Defined results: null and empty texts have no features and weight 0; an empty
target gives every bucket a gain from the raw counts alone; repeated rows (null
ids too, whose draw is that of the empty id) are scored and ranked row by row, in
any order among themselves; ties go to the smaller id, null last; an empty table
gives no rows; a text is read whole in pieces of bounded size, and a single word
may be of any length; ``importance_weights`` keeps all columns,
whatever their names (those named as its own are replaced), as does ``resample``;
``resampling_report`` returns its own columns only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.copies import dealt, digest
from tessera.llm.decontam import _FOLD
from tessera.llm.textbatch import fresh, text_slices
from tessera.operators import scans
from tessera.runtime import cut_lineage

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 42, 20, 5
#: Bytes of text whose words have one dictionary.
PIECE = 4 << 20


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Groups of (row, words) of about ``PIECE`` bytes; a longer text goes over several groups, cut between words."""
    group, size = [], 0
    for row, text in enumerate(texts):
        folded, at = text.translate(_FOLD), 0
        while True:
            end = len(folded) if len(folded) - at <= PIECE else folded.rfind(b" ", at, at + PIECE) + 1 or folded.find(b" ", at + PIECE) + 1 or len(folded)
            group.append((row, folded[at:end].split()))
            size += end - at
            at = end
            if size >= PIECE:
                yield group
                group, size = [], 0
            if at == len(folded):
                break
    if group:
        yield group


def features(group: list[tuple[int, list[bytes]]], carried: tuple[int, list[bytes]] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tuples' buckets and, for every n-gram that ends in this group, its tuple's number and its row.

    ``carried`` are the last two words of the text that goes on from the group before.
    """
    dictionary: dict[bytes, int] = {}
    number = dictionary.setdefault
    ids: list[int] = []
    rows, old = [], []
    for k, (row, words) in enumerate(group):
        head = carried[1] if k == 0 and carried and carried[0] == row else []
        ids.extend([number(w, len(dictionary)) for w in (*head, *words)])
        rows.append(np.full(len(head) + len(words), row, dtype=np.int64))
        old.append(np.arange(len(head) + len(words)) < len(head))
    word, row, seen = np.array(ids, dtype=np.int64), np.concatenate(rows), np.concatenate(old)
    vocabulary = list(dictionary)
    behind = [b" " + w for w in vocabulary]
    crc = zlib.crc32
    one = [crc(w) for w in vocabulary]
    size = max(len(vocabulary), 1)
    # A tuple's key is its prefix's number and its last word's.
    first = np.flatnonzero(row[1:] == row[:-1])  # where a pair begins
    pairs, pair_of = np.unique(word[first] * size + word[first + 1], return_inverse=True)
    two = [crc(behind[w], one[p]) for p, w in zip(*(x.tolist() for x in np.divmod(pairs, size)), strict=True)]
    pair_at = np.full(len(word) + 1, -1, dtype=np.int64)
    pair_at[first] = pair_of
    start = np.flatnonzero((pair_at[:-2] >= 0) & (pair_at[1:-1] >= 0)) if len(word) > 2 else np.zeros(0, dtype=np.int64)
    triples, triple_of = np.unique(pair_at[start] * size + word[start + 2], return_inverse=True)
    three = [crc(behind[w], two[p]) for p, w in zip(*(x.tolist() for x in np.divmod(triples, size)), strict=True)]
    buckets = np.array([*one, *two, *three], dtype=np.int64) % BUCKETS
    numbers = np.concatenate((word, pair_of + len(one), triple_of + len(one) + len(two)))
    ends = np.concatenate((np.arange(len(word)), first + 1, start + 2))
    new = ~seen[ends]
    return buckets, numbers[new], row[ends[new]]


def _grouped(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, list[bytes]]], tuple[int, list[bytes]] | None]]:
    """Each group with the last two words of the text it goes on with."""
    carried = None
    for group in pieces(texts):
        yield group, carried
        row = group[-1][0]
        own = [words[-2:] for other, words in group if other == row]
        head = carried[1] if carried and carried[0] == row == group[0][0] else []
        carried = (row, [w for words in (head, *own) for w in words][-2:])


def _raw(batch: pa.RecordBatch, text_col: str) -> list[bytes]:
    return [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket; empty buckets are absent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for group, carried in _grouped(_raw(part, "text")):
                    buckets, numbers, _ = features(group, carried)
                    # Counts join back: one for each distinct tuple, then its bucket's.
                    np.add.at(total, buckets, np.bincount(numbers, minlength=len(buckets)))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text_col: str = "text") -> np.ndarray:
    """The gain of every bucket, from all rows of both tables."""
    both = bucket_counts(docs, text_col).withColumnRenamed("n", "s").join(bucket_counts(target, target_text_col).withColumnRenamed("n", "t"), "bucket", "full")
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in both.collect():  # BUCKETS rows at most
        s[r.bucket], t[r.bucket] = r.s or 0, r.t or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def importance_weights(
    docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text_col: str = "text", gains: np.ndarray | None = None, keep_text: bool = True
) -> DataFrame:
    """``docs`` with n_words, n_features and weight."""
    own = ("n_words", "n_features", "weight")
    base = docs.drop(*own)
    gains = bucket_gains(docs, target, text_col=text_col, target_text_col=target_text_col) if gains is None else gains
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    kept = [f for f in base.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in own]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                words, count, weight = (np.zeros(part.num_rows, dtype=np.int64) for _ in range(3))
                for group, carried in _grouped(_raw(part, text_col)):
                    for row, found in group:
                        words[row] += len(found)
                    buckets, numbers, rows = features(group, carried)
                    gain = shared.value[buckets]
                    np.add.at(count, rows, 1)
                    np.add.at(weight, rows, gain[numbers])
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *map(pa.array, (words, count, weight))], schema.names)

    return base.mapInArrow(work, schema)


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """A standard Gumbel draw in thousandths, rounded down, from the seed and the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(weighted: DataFrame, *, id_col: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``weighted`` with score and, for the drawn rows, rank from 1."""
    names = weighted.columns
    fit, place = (fresh([*names, "score", "rank"], n) for n in ("fit", "place"))
    scored = weighted.withColumns({"score": F.col("weight") + gumbel(F.col(id_col), seed), fit: F.col("n_words") >= min_words})
    scored = cut_lineage(scored)
    drawn = scored.agg(F.count_if(fit)).first()[0] * percent // 100
    order = [F.col(fit).desc(), F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    at = scans.positions(scored, order, out=place)
    return at.withColumn("rank", F.when(F.col(fit) & (F.col(place) < drawn), F.col(place) + 1).cast("long")).drop(fit, place)


def resampling_report(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", **options) -> DataFrame:
    """Every document's n_features, weight, score and rank."""
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    weighted = importance_weights(plain, target, text_col="__text", target_text_col=target_text_col, keep_text=False)
    out = ranked(weighted, id_col="__id", **options)
    return out.select(F.col("__id").alias(id_col), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", **options) -> DataFrame:
    """The drawn documents, with their own columns; ids and scores alone are ranked, texts are shuffled once."""
    key, many = fresh(docs.columns, "digest"), fresh(docs.columns, "many")
    keyed = docs.withColumn(key, digest(text_col))
    plain = keyed.select(F.col(id_col).alias("__id"), F.col(key).alias("__digest"), F.col(text_col).alias("__text"))
    weighted = importance_weights(plain, target, text_col="__text", target_text_col=target_text_col, keep_text=False)
    drawn = ranked(weighted, id_col="__id", **options).withColumn("drawn", F.col("rank").isNotNull().cast("long"))
    return dealt(keyed, drawn, {id_col: "__id", key: "__digest"}, "drawn", many).drop(key, many)
