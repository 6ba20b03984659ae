"""Retrieval, grounding and answer quality as aggregations over labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import text as tx


def keyword_relevant(content: Column, keywords: Column, at_least: int = 2) -> Column:
    low = F.lower(content)
    return F.size(F.filter(keywords, lambda k: low.contains(F.lower(k)))) >= at_least


def contains_answer(text: Column, keys: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(keys, lambda k: low.contains(F.lower(k)))


def per_case(cases: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per case: hit, reciprocal rank, precision over k. Cases without results count as misses.

    `judged` holds (query_id, rank, relevant).
    """
    seen = judged.groupBy("query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.count_if("relevant").alias("relevant"),
        F.count("*").alias("retrieved"),
    )
    return cases.join(seen, "query_id", "left").select(
        *cases.columns,
        F.col("first").isNotNull().cast("int").alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("relevant", F.lit(0)) / k).alias("precision"),
        F.coalesce("retrieved", F.lit(0)).alias("retrieved"),
    )


def retrieval_summary(scored: DataFrame, by: str | None = None, digits: int = 6) -> DataFrame:
    """Means over all cases; with `by` also per value of that column, the total marked 'overall'."""
    means = [F.count("*").alias("n")] + [
        F.round(F.avg(c), digits).alias(c) for c in ("recall", "mrr", "precision") if c in scored.columns
    ]
    if by is None:
        return scored.agg(*means)
    label = F.when(F.grouping(by) == 1, "overall").otherwise(F.col(by))
    return scored.rollup(by).agg(label.alias("group"), *means).drop(by)


def label_accuracy(items: DataFrame, predicted: Column) -> DataFrame:
    """Accuracy overall and by gold label; any prediction but entailment fits any gold label but entailment."""
    ok = (F.col("label") == "entailment") == (predicted == "entailment")
    judged = items.withColumn("ok", ok)
    group = F.when(F.grouping("label") == 1, "overall").otherwise(F.col("label"))
    return judged.rollup("label").agg(
        group.alias("group"),
        F.count("*").alias("n"),
        F.count_if("ok").alias("ok"),
        F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"),
    ).drop("label")


def heldout_rates(items: DataFrame, predicted: Column) -> DataFrame:
    """Share of unsupported claims before and after the filter, and how many claims it keeps."""
    wrong = F.col("label") != "entailment"
    judged = items.withColumn("kept", predicted == "entailment")
    return judged.agg(
        F.count("*").alias("n"),
        F.round(F.count_if(wrong) / F.greatest(F.count("*"), F.lit(1)), 3).alias("unsupported_off"),
        F.round(F.count_if(wrong & F.col("kept")) / F.greatest(F.count_if("kept"), F.lit(1)), 3).alias("unsupported_on"),
        F.count_if("kept").alias("kept"),
    )


def normalized(text: Column) -> Column:
    flat = F.regexp_replace(tx.strip(F.lower(text)), f"{tx.WS}+", " ")
    return F.regexp_replace(flat, r"[^\p{L}\p{N}_\s.\-]", "")


def token_f1(pred: Column, truth: Column) -> Column:
    """F1 over distinct tokens."""

    def score(s: Column) -> Column:
        common = F.size(F.array_intersect(s["p"], s["t"]))
        p, r = common / F.size(s["p"]), common / F.size(s["t"])
        return F.when((F.size(s["p"]) == 0) | (F.size(s["t"]) == 0) | (common == 0), F.lit(0.0)).otherwise(
            2 * p * r / (p + r)
        )

    def distinct(c: Column) -> Column:
        return F.array_distinct(tx.words(normalized(c)))

    return tx.let(F.struct(distinct(pred).alias("p"), distinct(truth).alias("t")), score)


def keyword_recall(pred: Column, keywords: Column) -> Column:
    low = F.lower(pred)
    hits = F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
    return F.when(F.size(keywords) == 0, F.lit(0.0)).otherwise(hits / F.greatest(F.size(keywords), F.lit(1)))


def qa_summary(rows: DataFrame) -> DataFrame:
    """Exact match, token F1 and keyword recall over (pred, truth, keywords)."""
    return rows.agg(
        F.count("*").alias("n"),
        F.round(F.avg((normalized(F.col("pred")) == normalized(F.col("truth"))).cast("double")), 6).alias("em"),
        F.round(F.avg(token_f1(F.col("pred"), F.col("truth"))), 6).alias("f1"),
        F.round(F.avg(keyword_recall(F.col("pred"), F.col("keywords"))), 6).alias("keyword_recall"),
    )


def ab_report(naive: DataFrame, advanced: DataFrame) -> DataFrame:
    """One row per metric: naive, advanced and the difference."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        stack = "stack(3, 'recall', cast(recall as double), 'mrr', mrr, 'precision', precision) as (metric, value)"
        return df.selectExpr(stack).groupBy("metric").agg(F.avg("value").alias(name))

    both = tall(naive, "naive").join(tall(advanced, "advanced"), "metric")
    return both.select(
        "metric",
        F.round("naive", 6).alias("naive"),
        F.round("advanced", 6).alias("advanced"),
        F.round(F.col("advanced") - F.col("naive"), 6).alias("delta"),
    )
