"""Summaries that are kept up to date as rows arrive, and answers that arrive more than once.

Beyond the tables that are loaded once: the same groups over a stream, by Structured Streaming's own state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.summarize import Agg, aggregate, group_key


def live_groups(stream: DataFrame, by: str, time: str, aggs: Sequence[Agg] = (Agg(),), names: Sequence[str] = ("n",), window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, names): groups in windows of time; rows later than ``late`` are dropped with their window's state."""
    keyed = stream.withColumn("key", group_key(stream, by)).withWatermark(time, late)
    made = keyed.groupBy(F.window(time, window).alias("w"), "key").agg(*[aggregate(stream, a).alias(n) for a, n in zip(aggs, names, strict=True)])
    return made.select(F.col("w.start").alias("start"), "key", *names)


def first_answers(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each answer once, however often it arrives within ``late``; older ids leave the state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what has arrived as Parquet and stops; the next call goes on from there."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
