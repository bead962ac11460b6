"""Mixing sources to target weights by systematic sampling.

Every source has a weight and a size (its words).  The mix takes ``share`` times
all words, dealt out by weight; a target above ``most`` times its source's size
is held there and the excess is dealt out again by weight among the others, until
none is above.  A document of a source is expected ``target / source size``
times.  Expected copies are prefix-summed within the source, one random offset
(a hash of seed and source) is added, and a document is taken once for every
integer that its own stretch of the sum crosses: the whole part of its expected
copies, or one more.

Documents stand in order of size, then id.  With it a source's taken words stay
within about one largest document of its target, as each stretch of the order is
sampled alike.  The order is a range partitioning by (source, size, id); a
position is its place in the part plus the rows of the parts before (see
``scans.positions``), so a source of any size is spread over all tasks and only
counts, a row a part and source, come together.  The sources themselves are a
table: targets are settled by rounds of aggregates over it, each of which sends
two numbers to the driver.

Defined results: null texts have size 0; a null source is a source of its own,
after all others; a source without words has target 0 and nothing is taken of it
but empty documents, whose ``copies`` are 0; repeated rows are documents of their
own, as are rows with a null id (which stand first among those of their size); an
empty table gives no rows; texts are read whole, in bounded slices; ``mix`` keeps
all columns, whatever their names (one named as its ``copies_col`` is replaced),
``mixture_report`` returns its own columns only.  A weight must be positive, and
a source that the weights lack is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.copies import dealt, digest
from tessera.llm.textbatch import fresh, text_slices
from tessera.operators import scans
from tessera.runtime import cut_lineage

SHARE, MOST, SEED = 1.5, 2.0, 42
#: The cycle of weights over the sources in order.
WEIGHTS = (3, 1, 2)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Runs of other bytes than ASCII white space in each text; null has none."""
    raw = texts.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = raw.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    inside = ~_SPACE[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = inside[first]  # a text's first byte follows no other
    seen = np.concatenate(([0], np.cumsum(begins)))
    return seen[ends[1:]] - seen[ends[:-1]]


def with_size(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``docs`` without its texts and with the number of words of each."""
    keep = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != text_col], T.StructField(out_col, T.LongType())])

    def work(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(word_counts(part.column(text_col)))], [*keep, out_col])

    return docs.mapInArrow(work, schema)


def cycled_weights(sources: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, weight): the weights in turn over the sources by code point, null last."""
    ranked = scans.positions(sources.select(source_col).distinct(), [F.col(source_col).asc_nulls_last()], out="__place")
    turn = F.element_at(F.lit(list(weights)), (F.col("__place") % len(weights) + 1).cast("int"))
    return ranked.select(source_col, turn.cast("double").alias("weight"))


def source_targets(sized: DataFrame, weights: DataFrame, *, source_col: str = "source", size_col: str = "size", share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of every source of ``sized``."""
    sizes = sized.groupBy(source_col).agg(F.sum(size_col).alias("source_size"))
    named = weights.select(F.col(source_col).alias("__source"), F.col("weight").cast("double").alias("weight"))
    table = cut_lineage(sizes.join(named, F.col(source_col).eqNullSafe(F.col("__source")), "left").drop("__source"))
    if table.where(~(F.coalesce("weight", F.lit(0.0)) > 0)).limit(1).count():
        raise ValueError("every source needs a positive weight")
    words = table.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * most
    level, held = None, -1  # words for a weight of 1; sources held at their limit
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level >= limit
        n, taken, rest = table.agg(F.count_if(above), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == held or not rest:
            break  # no further source is above
        level, held = (share * words - (taken or 0.0)) / rest, n
    target = limit if level is None else F.least(F.col("weight") * level, limit)
    return table.select(source_col, "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that hangs on the seed and the source alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def expected_copies(
    sized: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", seed: int = SEED, out_col: str = "copies"
) -> DataFrame:
    """``sized`` with source_size, target and the number of times each row is taken."""
    place = fresh([*sized.columns, "source_size", "target", out_col], "place")
    rows = scans.positions(sized, [F.col(size_col).asc(), F.col(id_col).asc_nulls_first()], [source_col], out=place, per_key=targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda k: F.floor(k * rate + offset(F.col(source_col), seed))
    copies = F.least(crossed(F.col(place) + 1) - crossed(F.col(place)), F.ceil(rate))  # rounding of large sums adds none
    return rows.withColumn(out_col, F.when(F.col(size_col) > 0, copies).otherwise(0).cast("long")).drop(place)


def mixture_report(
    docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: float = MOST, seed: int = SEED
) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes of it."""
    plain = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source_"), F.col(text_col).alias("__text"))
    sized = cut_lineage(with_size(plain, "__text", "size"))
    weights = cycled_weights(sized, "__source_") if weights is None else weights.withColumnRenamed(source_col, "__source_")
    targets = source_targets(sized, weights, source_col="__source_", share=share, most=most)
    taken = expected_copies(sized, targets, id_col="__id", source_col="__source_", seed=seed)
    return taken.select(
        F.col("__id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), F.col("copies")
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    copies_col: str | None = None,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, numbered from 0 in ``copies_col`` if named."""
    base = docs.drop(copies_col) if copies_col else docs
    key, many = (fresh([*base.columns, copies_col or ""], n) for n in ("digest", "many"))
    keyed = base.withColumn(key, digest(text_col))
    plain = keyed.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source_"), F.col(key).alias("__digest"), F.col(text_col).alias("__text"))
    sized = cut_lineage(with_size(plain, "__text", "size"))
    weights = cycled_weights(sized, "__source_") if weights is None else weights.withColumnRenamed(source_col, "__source_")
    targets = source_targets(sized, weights, source_col="__source_", share=share, most=most)
    taken = expected_copies(sized, targets, id_col="__id", source_col="__source_", seed=seed)
    out = dealt(keyed, taken, {id_col: "__id", source_col: "__source_", key: "__digest"}, "copies", many).drop(key)
    name = copies_col or fresh(out.columns, "copy")
    out = out.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))).drop(many)
    return out if copies_col else out.drop(name)
