"""Streams of requests and of document states."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lodestone.functions.understand import cache_ttl
from lodestone.operators import metrics
from lodestone.operators.admission import Gate
from lodestone.operators.cache import BASE_TTL, query_hash
from lodestone.operators.tenancy import STUCK


def admit(requests: DataFrame, per_minute: int, per_hour: int, idle_ms: int = 7_200_000) -> DataFrame:
    """Admission of a request stream (client, ts): one row per client and second of each micro-batch.

    The state of a client is what the last minute and hour used. Requests are counted by second
    as they arrive, so a busy client costs no more than its seconds.
    """
    ctype = requests.schema["client"].dataType.simpleString()
    state = "minute_s array<bigint>, minute_n array<bigint>, hour_s array<bigint>, hour_n array<bigint>"
    out = f"client {ctype}, second bigint, requests bigint, admitted bigint, refused_minute bigint, refused_hour bigint"

    def step(key, frames, store):
        if store.hasTimedOut:
            store.remove()
            return
        arrived: Counter = Counter()
        for frame in frames:
            for second, n in frame["second"].value_counts().items():
                arrived[int(second)] += int(n)
        kept = store.get if store.exists else ([], [], [], [])
        gate = Gate(per_minute, per_hour, zip(kept[0], kept[1]), zip(kept[2], kept[3]))
        rows = [(key[0], s, n, *gate.offer(s, n)) for s, n in sorted(arrived.items())]
        parts = [[x[i] for x in log] for log in gate.logs for i in (0, 1)]
        store.update(tuple(parts))
        store.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["client", "second", "requests", "admitted", "refused_minute", "refused_hour"])

    seconds = requests.select("client", F.unix_timestamp("ts").alias("second"))
    return seconds.groupBy("client").applyInPandasWithState(
        step, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def request_metrics(requests: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Request metrics per window; a window is final once the watermark passes it."""
    return metrics.request_metrics(requests.withWatermark("ts", late), window)


def first_asked(queries: DataFrame, ttl_seconds: int = BASE_TTL, late: str = "10 minutes") -> DataFrame:
    """Queries (ns, query, ts) whose answer is not in the cache: repeats within the lifetime of the query's class are dropped.

    The state of a query is when its answer expires. A repeat does not prolong it.
    """
    keyed = queries.select("ns", "query", "ts", query_hash(F.col("query")).alias("query_hash"), cache_ttl(F.col("query"), ttl_seconds).alias("ttl"))
    columns = ["ns", "query", "ts", "query_hash"]
    out = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in columns)

    def step(key, frames, store):
        if store.hasTimedOut:
            store.remove()
            return
        until = store.get[0] if store.exists else None
        for frame in frames:
            frame, first = frame.sort_values("ts", kind="stable"), []
            for i, (ts, ttl) in enumerate(zip(frame["ts"], frame["ttl"])):
                ms = int(pd.Timestamp(ts).timestamp() * 1000)
                if until is None or ms >= until:
                    until = ms + int(ttl) * 1000
                    first.append(i)
            if first:
                yield frame.iloc[first][columns]
        store.update((until,))
        store.setTimeoutTimestamp(max(until, store.getCurrentWatermarkMs() + 1))

    grouped = keyed.withWatermark("ts", late).groupBy("ns", "query_hash")
    return grouped.applyInPandasWithState(step, out, "until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stuck_documents(changes: DataFrame, minutes: int = 5, late: str = "0 seconds") -> DataFrame:
    """Error rows for documents that enter processing and report nothing more in time.

    `changes` holds (document_id, status, ts).
    """
    out = "document_id string, status string, error_message string"

    def step(key, frames, store):
        if store.hasTimedOut:
            store.remove()
            yield pd.DataFrame([(key[0], "error", STUCK)], columns=["document_id", "status", "error_message"])
            return
        last = store.get if store.exists else (None, None)
        for frame in frames:
            for ts, status in sorted(zip(frame["ts"], frame["status"])):
                ms = int(pd.Timestamp(ts).timestamp() * 1000)
                if last[0] is None or ms >= last[0]:
                    last = (ms, status)
        if last[1] == "processing":
            store.update(last)
            store.setTimeoutTimestamp(max(last[0] + minutes * 60_000, store.getCurrentWatermarkMs() + 1))
        elif store.exists:
            store.remove()

    keyed = changes.withWatermark("ts", late).groupBy("document_id")
    return keyed.applyInPandasWithState(
        step, out, "ms bigint, status string", "append", GroupStateTimeout.EventTimeTimeout
    )
