"""Structured Streaming forms: clicks, request log, rate limit, session statistics, politeness slots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiloom.config import CRAWL_DELAY_S, RATE_PER_MINUTE


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; ours are UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def valid_clicks(clicks: DataFrame, known_docs: DataFrame) -> DataFrame:
    """Clicks with all fields, on known documents: a stream-static semi join."""
    whole = clicks.filter(F.col("query").isNotNull() & F.col("doc_id").isNotNull() & F.col("position").isNotNull())
    return whole.join(known_docs.select("doc_id"), "doc_id", "left_semi")


def log_lines(rows: DataFrame, message: str) -> DataFrame:
    """One JSON line a row."""
    return rows.select(F.to_json(F.struct(F.lit("INFO").alias("level"), F.lit(message).alias("message"), F.struct(*rows.columns).alias("data"))).alias("value"))


def requests_per_minute(requests: DataFrame, client: str, late: str = "5 minutes", limit: int = RATE_PER_MINUTE) -> DataFrame:
    """``window, client, n, n_allowed`` a minute and client, over a watermark."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), F.col(client)).agg(F.count("*").alias("n"))
    return counted.withColumn("n_allowed", F.least("n", F.lit(limit)))


def session_stats(events: DataFrame, kind: str = "event_type", late: str = "5 minutes", gap: str = "30 minutes", user: str = "user_id") -> DataFrame:
    """Counts a session of a user."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), F.col(user)).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == "click").alias("n_clicks"))


def politeness(requests: DataFrame, delay: float = CRAWL_DELAY_S) -> DataFrame:
    """Slots of ``host, seq, at`` (seconds): each no sooner than ``delay`` after the host's last, kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        last = state.get[0] if state.exists else None
        slots = []
        for at in rows["at"]:
            last = at if last is None else max(at, last + delay)
            slots.append(last)
        state.update((last,))
        yield rows.assign(slot=slots)[["host", "seq", "at", "slot"]]

    return requests.groupBy("host").applyInPandasWithState(step, "host string, seq long, at double, slot double", "last double", "append", GroupStateTimeout.NoTimeout)


def append_sink(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """Everything there is now, in micro-batches, then stop; the checkpoint is where a crashed run goes on."""
    return stream.writeStream.format(kind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def upsert_sink(stream: DataFrame, merge, checkpoint: str):
    """Each micro-batch through ``merge(batch, id)``, which must do no harm when it is repeated."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
