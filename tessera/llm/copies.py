"""Giving rows of a table the number of times they are taken, decided on small rows without texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbatch import fresh
from tessera.operators import scans


def digest(text: str) -> Column:
    """What tells texts apart; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def dealt(docs: DataFrame, taken: DataFrame, keys: dict[str, str], copies: str, out_col: str) -> DataFrame:
    """Rows of ``docs`` that are taken, with ``out_col``, how often.

    ``keys`` maps columns of ``docs`` to those of ``taken``, which has a row for
    each row of ``docs``.  Rows equal in all keys share their copies: k rows with c
    copies together give c rows, row j those whose number is j modulo k.  The
    texts are shuffled once, for the join; rows equal in all keys once more.
    """
    names = fresh(docs.columns, "__total"), fresh(docs.columns, "__rows"), fresh(docs.columns, "__nth")
    total, rows, nth = names
    own = {k: fresh(docs.columns, f"__of_{i}") for i, k in enumerate(keys)}
    sums = (
        taken.groupBy(*[F.col(v).alias(own[k]) for k, v in keys.items()])
        .agg(F.sum(copies).alias(total), F.count(F.lit(1)).alias(rows))
        .where(F.col(total) > 0)
    )
    same = [F.col(k).eqNullSafe(F.col(own[k])) for k in keys]
    single = docs.join(sums.where(F.col(rows) == 1), same).withColumn(out_col, F.col(total))
    repeated = docs.join(sums.where(F.col(rows) > 1), same)
    repeated = scans.positions(repeated, [F.col(rows)], list(own.values()), out=nth)
    repeated = repeated.withColumn(out_col, F.floor((F.col(total) - F.col(nth) + F.col(rows) - 1) / F.col(rows)).cast("long")).drop(nth)
    return single.unionByName(repeated).where(F.col(out_col) > 0).drop(total, rows, *own.values())
