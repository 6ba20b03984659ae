"""The answer cache as a table (ns, query_hash, query, vec, response, stored_at, expires_at)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import text as tx
from lodestone.functions import understand as un
from lodestone.operators import cosine_join
from lodestone.operators.sequences import carry_last, ordered_scan

# Default lifetime in seconds and the similarity a cached answer needs.
BASE_TTL = 86400
SIMILAR = 0.95
HOUR_MICROS = 3_600_000_000


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(tx.strip(F.lower(query)), 256), 1, 16)


def store(entries: DataFrame, base: int = BASE_TTL) -> DataFrame:
    """Add key and lifetime to entries (ns, query, stored_at, ..)."""
    expires = F.timestamp_seconds(F.unix_timestamp("stored_at") + un.cache_ttl(F.col("query"), base))
    return entries.withColumn("query_hash", query_hash(F.col("query"))).withColumn("expires_at", expires)


def live(cache: DataFrame, as_of: Column) -> DataFrame:
    """Entries stored by then and not yet expired."""
    return cache.where((F.col("stored_at") <= as_of) & (F.col("expires_at") > as_of))


def exact_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Add `hit` to requests (ns, query, ts, ..): the newest entry of the same query stored by then is still live.

    One row per request, however often a query was stored: requests and entries are lined up
    by time and the newest expiry is carried along, in segments of an hour.
    """
    def row(key: Column, at: str, late: int, request: Column, expiry: Column) -> list[Column]:
        place = F.unix_micros(F.col(at).cast("timestamp")) * 2 + late  # an entry counts for requests of the same moment
        return [F.concat_ws("|", key, "ns").alias("_key"), place.alias("_at"), request.alias("_request"), expiry.alias("_expiry")]

    asked = requests.select(*row(query_hash(F.col("query")), "ts", 1, F.struct(*requests.columns), F.lit(None).cast("timestamp")))
    none = F.lit(None).cast(asked.schema["_request"].dataType)
    lined = asked.unionByName(cache.select(*row(F.col("query_hash"), "stored_at", 0, none, F.col("expires_at"))))
    carried = carry_last(lined, "_key", "_at", F.col("_expiry").isNotNull(), "_expiry", "_live", 2 * HOUR_MICROS)
    hit = F.coalesce(F.col("_live") > F.col("_request.ts"), F.lit(False))
    return carried.where("_request IS NOT NULL").select(*(F.col("_request")[c].alias(c) for c in requests.columns), hit.alias("hit"))


def semantic_lookup(requests: DataFrame, cache: DataFrame, as_of: Column, threshold: float = SIMILAR) -> DataFrame:
    """Best live entry of the same namespace with enough similarity, for requests without an exact one.

    Both sides carry `vec`; requests need `query_id`, entries `entry_id`. Returns
    (query_id, entry_id, score).
    """
    usable = live(cache, as_of)
    asked = requests.withColumn("query_hash", query_hash(F.col("query")))
    open_ = asked.join(usable.select("ns", "query_hash"), ["ns", "query_hash"], "left_anti")
    # Equal vectors of a namespace are compared once; of equal entries the least id stands.
    kinds = open_.where(F.col("vec").isNotNull()).groupBy("ns", "vec").agg(F.min("query_id").alias("kind"))
    entries = usable.where(F.col("vec").isNotNull()).groupBy("ns", "vec").agg(F.min("entry_id").alias("entry_id"))
    near = cosine_join.join(kinds, entries, threshold, "kind", "entry_id", ("ns",))
    best = near.groupBy("kind").agg(F.min(F.struct((-F.col("score")).alias("far"), "entry_id")).alias("b"))
    found = open_.select("query_id", "ns", "vec").join(kinds, ["ns", "vec"]).join(best, "kind")
    return found.select("query_id", "b.entry_id", (-F.col("b.far")).alias("score"))


def replay(log: DataFrame, base: int = BASE_TTL) -> DataFrame:
    """Hits and misses of a query log (ns, query, ts): (ns, query_hash, second, requests, misses).

    A miss stores the answer; a hit does not prolong it. Times count in whole seconds, so a
    query costs at most one row per second however often it is asked, and the scan over these
    rows only keeps the current expiry.
    """
    seconds = (
        log.select(
            "ns", query_hash(F.col("query")).alias("query_hash"), F.unix_timestamp("ts").alias("second"),
            un.cache_ttl(F.col("query"), base).alias("ttl"),
        )
        .groupBy("ns", "query_hash", "second")
        .agg(F.count("*").alias("requests"), F.min("ttl").alias("ttl"))
    )
    schema = "ns string, query_hash string, second bigint, requests bigint, misses bigint"
    return ordered_scan(seconds, ["ns", "query_hash"], ["second"], _replay_scan, schema)


def _replay_scan(frames):
    current, expiry = None, None
    for frame in frames:
        misses = np.zeros(len(frame), dtype=np.int64)
        keys = pd.MultiIndex.from_frame(frame[["ns", "query_hash"]])
        seconds, ttl = frame["second"].to_numpy(), frame["ttl"].to_numpy()
        bounds = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1])]) if len(frame) else []
        for start, end in zip(bounds, [*bounds[1:], len(frame)]):
            if keys[start] != current:
                current, expiry = keys[start], -1
            at = start + np.searchsorted(seconds[start:end], expiry)
            while at < end:
                misses[at] = 1
                expiry = seconds[at] + ttl[at]
                at = start + np.searchsorted(seconds[start:end], expiry)
        yield frame[["ns", "query_hash", "second", "requests"]].assign(misses=misses)


def stats(cache: DataFrame, as_of: Column) -> DataFrame:
    expired = F.col("expires_at") <= as_of
    return cache.agg(
        F.count("*").alias("entries"), F.count_if(expired).alias("expired"), F.count_if(~expired).alias("active")
    )


def call_reduction(replayed: DataFrame) -> DataFrame:
    """Requests, hits and the share of model calls the cache saves."""
    asked, missed = F.sum("requests"), F.sum("misses")
    return replayed.agg(
        asked.alias("requests"),
        (asked - missed).alias("hits"),
        F.round((asked - missed) / F.greatest(asked, F.lit(1)), 6).alias("reduction"),
    )


def invalidate(cache: DataFrame, document_id: str | None = None) -> DataFrame:
    """Cache without its answers (keys that start with `rag:`), or without those citing a document."""
    answer = F.col("key").startswith("rag:")
    if document_id is not None:
        answer = answer & F.array_contains("cited", document_id)
    return cache.where(~answer)
