"""Streaming forms: sessions, counters, keyed upserts and pause groups with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.operators.sequential import Pauses
from scriptloom.session import ship


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of ``user_id, ts``; late rows wait for the watermark. Batch frames work as well."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return (
        rows.groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    )


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per operation and time window; tumbling, or sliding by ``slide``."""
    rows = events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return (
        rows.groupBy(F.window("ts", size, slide).alias("w") if slide else F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("tokens"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "tokens")
    )


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Out-of-order batches merged into a Parquet table by key; a replayed batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        target = f"{path}/epoch={epoch}"
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("v")).select(*keys, "v.*")
        last.write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark, path: str, keys: list[str], order: str) -> DataFrame:
    """The table that :func:`upsert_batches` writes, newest row per key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order, "epoch")).alias("v")).select(*keys, "v.*")


def pause_groups(rows: DataFrame, max_gap_ms: int = 1500) -> DataFrame:
    """Pause groups over a stream of ``file_id, ord, start_ms, end_ms``; state is five pauses a file.

    Rows of a file must arrive in order.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(rows.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group, size, last_end, seen = state.get if state.exists else (0, 0, None, [])
        pauses = Pauses(max_gap_ms)
        pauses.seen.extend(seen)
        for frame in frames:
            ords, groups = [], []
            for ord_, start, end in frame.sort_values(["start_ms", "ord"])[["ord", "start_ms", "end_ms"]].itertuples(index=False):
                if last_end is not None and pauses.opens(int(start - last_end), size):
                    group, size = group + 1, 0
                size, last_end = size + 1, int(end)
                ords.append(ord_)
                groups.append(group)
            yield pd.DataFrame({"file_id": [key[0]] * len(ords), "ord": ords, "group_id": groups})
        state.update((group, size, last_end, list(pauses.seen)))

    return rows.groupBy("file_id").applyInPandasWithState(
        step,
        "file_id long, ord long, group_id long",
        "group long, size long, last_end long, seen array<long>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
