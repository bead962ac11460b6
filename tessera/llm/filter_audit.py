"""How filters interact: what each removes at each step of every order.

A document fails some of n filters.  Applying the filters one after another is a
path through the lattice of subsets; the step that applies filter f after the
subset S is the edge (S, f), whatever the order inside S was.  So documents
contribute to n * 2^(n-1) edges (80 for five filters) and not to the n! * n steps
(600): they are counted by part and pattern of failed filters first (2^n rows a
part, with map-side partial sums, so a part that holds most rows is no hot key),
the patterns are summed into edges, and the edges are joined to the steps of all
permutations, a table that does not grow with the data.  A filter's Shapley sum
comes from the edges too: edge (S, f) lies on |S|! * (n-1-|S|)! paths.

The quality filters read the text once, in Arrow batches: the pattern of a text
and its digest leave the task, the text does not.  Exact copies need the smallest
id of each distinct text: a partial aggregate by digest; a row is the first of its
text if digest and id both equal that minimum.  The join back is on both, so that
copies of one text, however many, do not meet in one task.

Defined results: null texts are empty; an empty text has fewer than 50 words and
fails no other filter but copies; rows with a null id are copies of nothing and
nobody's original, and have no label; repeated rows count once each (rows that
share an id and a text are not each other's copy); of several labels of an id any
that is 1 counts, null labels are 0; the parts null and empty string are one; an
empty table gives no rows; texts are read whole, in blocks of words, and may be of
any length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textbatch import text_slices
from tessera.runtime import cut_lineage

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
# The limits of the quality filters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"

_SPACES = b" \t\n\v\f\r"
_CAPITALS = bytes(range(0x41, 0x5B))
#: Bytes of one text whose words are held at a time.
_BLOCK = 1 << 20


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Words (runs of other bytes than ASCII white space), some megabytes of text at a time."""
    at = 0
    while at < len(text):
        end = min(at + _BLOCK, len(text))
        while end < len(text) and text[end] not in _SPACES:
            more = text[end : end + 4096]
            end += min((i for i in map(more.find, (_SPACES[k : k + 1] for k in range(len(_SPACES)))) if i >= 0), default=len(more))
        yield text[at:end].split()
        at = end


def failed_by_text(text: bytes, length: int) -> int:
    """Bits of the text filters that fail: A words, B distinct words, C capitals, D signs."""
    if len(text) <= _BLOCK:
        found = text.split()
        n, distinct = len(found), len(set(found))
    else:
        n, seen = 0, set()
        for block in word_blocks(text):
            n += len(block)
            seen.update(block)
        distinct = len(seen)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    signs = len(text) - len(text.translate(None, SIGNS))
    return (n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * length) << 2 | (signs > 0) << 3


def failed_filters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, failed): per row the bits of all five filters it fails; E is an exact copy of a smaller id's text."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    id_field = plain.schema["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text"):
                texts = pc.fill_null(rows.column("text"), "")
                lengths = pc.utf8_length(texts).to_pylist()
                raw = texts.cast(pa.binary()).to_pylist()
                bits = [failed_by_text(t, n) for t, n in zip(raw, lengths, strict=True)]
                digests = [hashlib.sha256(t).digest() for t in raw]
                columns = [rows.column("id"), rows.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "bits", "digest"])

    kind = id_field.dataType.simpleString()
    read = cut_lineage(plain.mapInArrow(work, f"id {kind}, part string, bits int, digest binary"))
    first = read.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("first"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    joined = read.join(first, (F.col("digest") == F.col("of")) & (F.col("id") == F.col("first")), "left")
    return joined.select("id", "part", (F.col("bits") + F.when(copy, 16).otherwise(0)).alias("failed"))


def edges(n: int) -> Column:
    """All edges (subset, filter) of the lattice of n filters, as an array of structs of bits."""
    return F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(1 << f).alias("filter")) for f in range(n) for s in range(1 << n) if not s >> f & 1])


def steps(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(filter_order, step, subset, filter): every step of every order of the filters; n! * n rows, whatever the data."""
    bit = {x: 1 << k for k, x in enumerate(names)}
    rows = [("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[x]) for order in permutations(names) for k, x in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, filter int")


def edge_counts(patterns: DataFrame, n: int, *, part_col: str = "part") -> DataFrame:
    """Per part and edge the counts of ``COUNTS`` and shapley, from (part, failed, docs, good, toxic)."""
    on = patterns.withColumn("edge", F.explode(edges(n))).select("*", "edge.subset", "edge.filter")
    hit = lambda a, b: F.col(a).bitwiseAND(F.col(b)) != 0
    earlier, here = hit("failed", "subset"), hit("failed", "filter")
    total = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    removed = here & ~earlier
    counted = on.groupBy(part_col, "subset", "filter").agg(
        total(~earlier & ~here, "docs").alias("kept"),
        total(removed, "docs").alias("removed"),
        total(here & earlier, "docs").alias("redundant"),
        total(F.col("failed") == F.col("filter"), "docs").alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
    )
    paths = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("subset") + 1)
    sums = counted.groupBy(F.col(part_col).alias("__part"), F.col("filter").alias("__filter")).agg(F.sum(F.col("removed") * paths).cast("long").alias("shapley"))
    return counted.join(sums, (F.col(part_col) == F.col("__part")) & (F.col("filter") == F.col("__filter"))).drop("__part", "__filter")


def interaction_audit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", quality_col: str = "quality", toxic_col: str = "toxic"
) -> DataFrame:
    """One row per part, order of the five filters and step, with all counts (zeros included)."""
    failed = failed_filters(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    marked = lambda c, name: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(marked(quality_col, "good"), marked(toxic_col, "toxic"))
    known = failed.join(marks, F.col("id") == F.col("label_id"), "left")
    patterns = known.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    counted = edge_counts(patterns, len(FILTERS))
    paths = F.broadcast(steps(docs.sparkSession, FILTERS))
    return counted.join(paths, ["subset", "filter"]).select(F.col("part"), "filter_order", "step", *COUNTS, "shapley")
