"""Counters, latency summaries and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.operators.sequences import newest

# Bucket bounds of the latency histogram.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def metric_key(name: Column, labels: Column) -> Column:
    """`name{a="1",b="2"}` with labels sorted by name."""
    pairs = F.transform(
        F.sort_array(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))
    )
    return F.when(labels.isNull() | (F.cardinality(labels) == 0), name).otherwise(
        F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    )


def counters(points: DataFrame) -> DataFrame:
    """Sum per key of points (name, labels, value)."""
    keyed = points.select(metric_key(F.col("name"), F.col("labels")).alias("key"), "value")
    return keyed.groupBy("key").agg(F.sum("value").alias("value"))


def gauges(points: DataFrame, order: Column) -> DataFrame:
    """Last value per key."""
    keyed = points.select(metric_key(F.col("name"), F.col("labels")).alias("key"), "value", order.alias("_o"))
    return keyed.groupBy("key").agg(F.max_by("value", "_o").alias("value"))


def latency_summary(points: DataFrame, key: str, value: str, order: list[str], kept: int | None = None, step: float = 1.0) -> DataFrame:
    """Statistics per key; percentiles are values at an index. `kept` leaves the newest observations of a key only.

    Values are counted in steps; of each step that holds a wanted index, and of no other, single
    values are ranked. So a key with very many observations is spread over its steps.
    """
    if kept is not None:
        points = newest(points.select(*dict.fromkeys([key, value, *order])), [key], order, kept)
    own = points.select(key, F.col(value).alias("_v"), F.floor(F.col(value) / step).alias("_step")).where("_v IS NOT NULL")
    whole = own.groupBy(key).agg(
        F.count("*").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.round(F.avg("_v"), 6).alias("avg")
    )
    n = F.col("count")
    wanted = [("p50", 0.5, 0), ("p95", 0.95, 20), ("p99", 0.99, 100)]
    places = [
        F.struct(F.lit(name).alias("name"), F.when(n >= least, F.floor(n * F.lit(share))).otherwise(n - 1).alias("at"))
        for name, share, least in wanted
    ]
    asked = whole.select(key, F.inline(F.array(*places)))
    upto = W.partitionBy(key).orderBy("_step").rowsBetween(W.unboundedPreceding, 0)
    steps = own.groupBy(key, "_step").agg(F.count("*").alias("_k")).withColumn("_end", F.sum("_k").over(upto))
    held = steps.join(asked, key).where("_end > at AND _end - _k <= at").select(key, "_step", "name", (F.col("at") - F.col("_end") + F.col("_k")).alias("at"))
    values = own.join(held.select(key, "_step").distinct(), [key, "_step"], "left_semi").groupBy(key, "_step", "_v").agg(F.count("*").alias("_k"))
    inside = W.partitionBy(key, "_step").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    found = values.withColumn("_end", F.sum("_k").over(inside)).join(held, [key, "_step"]).where("_end > at AND _end - _k <= at")
    named = found.groupBy(key).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name, _, _ in wanted))
    return whole.join(named, key)


def latency_buckets(points: DataFrame, key: str, value: Column) -> DataFrame:
    """Cumulative counts per bound, one pass over the points: (key, le, count)."""
    v = points.select(key, value.alias("_v"))
    counts = v.groupBy(key).agg(
        *[F.count_if(F.col("_v") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)], F.count("*").alias("b_all")
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(BOUNDS)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("b_all").alias("count")))
    return counts.select(key, F.inline(F.array(*rows)))


def plain(x: Column) -> Column:
    """Decimal text without exponent and without needless zeros."""
    return F.regexp_replace(F.format_string("%.6f", x), "0{1,5}$", "")


def exposition(counter_values: DataFrame, gauge_values: DataFrame, summaries: DataFrame, timers: DataFrame) -> DataFrame:
    """Text exposition as lines (key, seq, line).

    counter and gauge values: (key, value). summaries: (key, p50, p95 or null, count, sum).
    timers: (name, le, count, total, sum).
    """

    def name(c: str) -> Column:
        return F.split(c, r"\{")[0]

    def simple(df: DataFrame, kind: str, text: Column) -> DataFrame:
        lines = F.array(
            F.concat(F.lit("# TYPE "), name("key"), F.lit(f" {kind}")), F.concat("key", F.lit(" "), text)
        )
        return df.select("key", F.posexplode(lines).alias("seq", "line"))

    def quantile(q: str) -> Column:
        labelled = F.concat(F.regexp_replace("key", r"\}$", ""), F.lit(f',quantile="{q}"}}'))
        return F.when(F.col("key").contains("{"), labelled).otherwise(F.concat("key", F.lit(f'{{quantile="{q}"}}')))

    summary = F.array(
        F.concat(F.lit("# TYPE "), name("key"), F.lit(" summary")),
        F.concat(quantile("0.5"), F.lit(" "), plain(F.col("p50"))),
        F.concat(quantile("0.95"), F.lit(" "), plain(F.col("p95"))),
        F.concat(name("key"), F.lit("_count "), F.col("count")),
        F.concat(name("key"), F.lit("_sum "), plain(F.col("sum"))),
    )
    summary_lines = summaries.select("key", F.posexplode(F.filter(summary, lambda s: s.isNotNull())).alias("seq", "line"))
    metric = F.concat("name", F.lit("_seconds"))
    heads = timers.select("name", "total", "sum").distinct().select(
        F.col("name").alias("key"),
        F.posexplode(
            F.array(
                F.concat(F.lit("# TYPE "), metric, F.lit(" histogram")),
                F.concat(metric, F.lit("_count "), F.col("total")),
                F.concat(metric, F.lit("_sum "), plain(F.col("sum"))),
            )
        ).alias("seq", "line"),
    )
    place = F.array_position(F.array(*[F.lit(str(b)) for b in BOUNDS], F.lit("+Inf")), F.col("le"))
    buckets = timers.select(
        F.col("name").alias("key"),
        (place + 2).cast("int").alias("seq"),
        F.concat(metric, F.lit('_bucket{le="'), "le", F.lit('"} '), F.col("count")).alias("line"),
    )
    return (
        simple(counter_values, "counter", F.col("value").cast("string"))
        .unionByName(simple(gauge_values, "gauge", plain(F.col("value"))))
        .unionByName(summary_lines)
        .unionByName(heads)
        .unionByName(buckets)
    )


def request_metrics(requests: DataFrame, window: str = "1 hour") -> DataFrame:
    """Requests per window, path and status with their latencies; the same on a stream with a watermark."""
    return requests.groupBy(F.window("ts", window).alias("w"), "path", "status").agg(
        F.count("*").alias("requests"),
        F.round(F.avg("latency"), 6).alias("avg_latency"),
        F.max("latency").alias("max_latency"),
    )


def ratio(hits: Column, others: Column) -> Column:
    """Share of hits, zero when there is nothing at all."""
    return F.coalesce(hits / F.nullif(hits + others, F.lit(0)), F.lit(0.0))
