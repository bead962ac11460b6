"""Online scoring against a frozen baseline and Page CUSUM state per key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.detect import standardized


def windowed_innovations(stream: DataFrame, *, time: str, key: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean and error of each key in tumbling windows; later rows than ``late`` are left out."""
    w = F.window(time, window)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), F.col(key)).agg(F.avg(value).alias("value"), F.stddev_samp(value).alias("__s"), F.count(value).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "value", (F.col("__s") / F.sqrt("n")).alias("sigma"), "n")


def score_stream(stream: DataFrame, model: DataFrame, keys: list[str], value: str, sigma: str) -> DataFrame:
    """Stream joined with a static baseline model; stateless."""
    return standardized(stream, model, keys, value, sigma)


def online_cusum(stream: DataFrame, *, key: str, order: str, value: str, reference: float = 0.5) -> DataFrame:
    """Page CUSUM per key; the state is one double, rows of a batch are taken in order."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (c,) = state.get if state.exists else (0.0,)
        rows = pd.concat(list(batches)).sort_values(order)
        out: list[tuple[Any, ...]] = []
        for at, x in zip(rows[order], rows[value], strict=True):
            if pd.notna(x):
                c = max(0.0, c + float(x) - reference)
            out.append((k[0], at, c))
        state.update((c,))
        yield pd.DataFrame(out, columns=[key, order, "cusum"])

    return stream.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, cusum double", "c double", "append", GroupStateTimeout.NoTimeout
    )
