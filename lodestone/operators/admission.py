"""Sliding-window admission of requests, per client.

A request takes a minute slot if one is free, then an hour slot; only requests with both are
admitted, and a minute slot stays taken even if the hour is full. Times count in whole
seconds, so a client costs at most one row per second.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.operators.sequences import ordered_scan

# Limits (per minute, per hour) of the service, of chat and of uploads.
DEFAULT_LIMITS, CHAT_LIMITS, UPLOAD_LIMITS = (60, 1000), (150, 500), (10, 100)


class Gate:
    """Admission state of one client: counts of the last minute and hour, nothing older."""

    def __init__(self, per_minute: int, per_hour: int, minute=(), hour=()):
        self.limits = ((60, per_minute), (3600, per_hour))
        self.logs = (deque(map(tuple, minute)), deque(map(tuple, hour)))
        self.used = [sum(n for _, n in log) for log in self.logs]

    def _free(self, i: int, now: int) -> int:
        width, limit = self.limits[i]
        log = self.logs[i]
        while log and log[0][0] <= now - width:
            self.used[i] -= log.popleft()[1]
        return max(limit - self.used[i], 0)

    def _take(self, i: int, now: int, n: int) -> None:
        if n:
            self.logs[i].append((now, n))
            self.used[i] += n

    def offer(self, now: int, n: int) -> tuple[int, int, int]:
        """n requests in one second: (admitted, refused by the minute, refused by the hour)."""
        took = min(n, self._free(0, now))
        admitted = min(took, self._free(1, now))
        self._take(0, now, took)
        self._take(1, now, admitted)
        return admitted, n - took, took - admitted


def admit(requests: DataFrame, per_minute: int, per_hour: int) -> DataFrame:
    """(client, second, requests, admitted, refused_minute, refused_hour) of requests (client, ts).

    Where the requests of the last minute and hour stay within the limits, all are admitted
    and no order matters. Only stretches around busier minutes are walked through in order;
    each starts with an hour that is admitted whole, so stretches are independent.
    """
    seconds = requests.groupBy("client", F.unix_timestamp("ts").alias("second")).agg(F.count("*").alias("requests"))
    seconds = seconds.withColumn("minute", F.floor(F.col("second") / 60))
    minutes = seconds.groupBy("client", "minute").agg(F.sum("requests").alias("n"))
    by_time = W.partitionBy("client").orderBy("minute")
    busy = (F.sum("n").over(by_time.rangeBetween(-1, 0)) > per_minute) | (
        F.sum("n").over(by_time.rangeBetween(-60, 0)) > per_hour
    )
    minutes = minutes.withColumn("busy", busy)
    minutes = minutes.withColumn("contested", F.max("busy").over(by_time.rangeBetween(0, 60)))
    hot = minutes.where("contested").select("client", "minute")
    gap = F.col("minute") - F.lag("minute").over(by_time) > 60
    hot = hot.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int"))
    hot = hot.withColumn("stretch", F.sum("_new").over(by_time.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    marked = seconds.join(hot, ["client", "minute"], "left")
    free = marked.where("stretch IS NULL").select(
        "client", "second", "requests", F.col("requests").alias("admitted"),
        F.lit(0).cast("bigint").alias("refused_minute"), F.lit(0).cast("bigint").alias("refused_hour"),
    )
    ctype = seconds.schema["client"].dataType.simpleString()
    schema = f"client {ctype}, second bigint, requests bigint, admitted bigint, refused_minute bigint, refused_hour bigint"

    def scan(frames):
        key, gate = None, None
        for frame in frames:
            out = []
            for client, stretch, second, n in zip(frame["client"], frame["stretch"], frame["second"], frame["requests"]):
                if (client, stretch) != key:
                    key, gate = (client, stretch), Gate(per_minute, per_hour)
                out.append(gate.offer(second, n))
            result = frame[["client", "second", "requests"]].copy()
            result["admitted"], result["refused_minute"], result["refused_hour"] = zip(*out) if out else ([], [], [])
            yield result

    walked = ordered_scan(
        marked.where("stretch IS NOT NULL").select("client", "stretch", "second", "requests"),
        ["client", "stretch"], ["second"], scan, schema,
    )
    return free.unionByName(walked)


def label_requests(requests: DataFrame, decided: DataFrame, order: str) -> DataFrame:
    """Add `admitted` to every request: within a second the first ones get through."""
    place = F.row_number().over(W.partitionBy("client", "second").orderBy(order))
    numbered = requests.withColumn("second", F.unix_timestamp("ts")).withColumn("_n", place)
    return numbered.join(decided.select("client", "second", F.col("admitted").alias("_a")), ["client", "second"]).select(
        *requests.columns, (F.col("_n") <= F.col("_a")).alias("admitted")
    )
