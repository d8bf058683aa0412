"""The engine on streams: stateless tokenising, windowed counts, a running trainer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import scan
from loomspan.session import shipped


def token_stream(docs: DataFrame, column: str = "text", *keep: str) -> DataFrame:
    """A row for each token of each arriving document, inside the JVM."""
    rows = docs.select(*keep, F.explode(scan.tokens_native(F.col(column))).alias("piece"))
    return rows.withColumn("kind", scan.native_kind(F.col("piece")))


def windowed_counts(pieces: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts of ``piece`` in tumbling or sliding windows; later rows than ``late`` are dropped.

    Works on a stream and, without its watermark having an effect, on a table.
    """
    marked = pieces.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = marked.groupBy(F.window(time, window, slide).alias("w") if slide else F.window(time, window).alias("w"), "piece")
    made = grouped.agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "piece", "n")


def running_weights(pieces: DataFrame) -> DataFrame:
    """A trainer that goes on observing: each piece's weight so far, given out whenever it changes.

    State is one number a piece. Use with output mode ``update``.
    """

    def observe(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        weight = (state.get[0] if state.exists else 0) + sum(int(b["weight"].sum()) for b in batches)
        state.update((weight,))
        yield pd.DataFrame({"piece": [key[0]], "weight": [weight]})

    return shipped(pieces).select("piece", F.col("weight").cast("long").alias("weight")).groupBy("piece").applyInPandasWithState(observe, "piece string, weight long", "weight long", "update", "NoTimeout")
