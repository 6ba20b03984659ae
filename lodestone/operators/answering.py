"""From ranked chunks to context, citations and grounded answers.

The groups collected here are the ranked chunks of one query, whose number the search bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import grounding as gr
from lodestone.functions import text as tx


def _joined(ranked: DataFrame, piece, joiner: str, out: str) -> DataFrame:
    pieces = ranked.select("query_id", "rank", piece.alias("p")).where("p <> ''")
    return pieces.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "p"))), lambda s: s["p"]), joiner).alias(out)
    )


def context_blocks(ranked: DataFrame) -> DataFrame:
    """(query_id, context): numbered blocks of the ranked chunks."""
    kind = F.when(F.coalesce("chunk_type", F.lit("")) != "", F.col("chunk_type")).otherwise("text")
    header = F.format_string("[%d] (%s, relevance %.2f)", "rank", kind, "score")
    caption = F.when(
        (F.coalesce("caption", F.lit("")) != "") & ~F.col("content").contains(F.col("caption")),
        F.concat(F.lit("\nCaption: "), "caption"),
    ).otherwise("")
    block = F.concat(header, caption, F.lit("\n"), "content", F.lit("\n"))
    return _joined(ranked, block, "\n---\n", "context")


def evidence(ranked: DataFrame, chars_per_chunk: int | None = None) -> DataFrame:
    """(query_id, evidence): caption and text of the ranked chunks, as the support test reads them; whole unless cut."""
    words = tx.strip(F.concat_ws(" ", F.nullif(F.col("caption"), F.lit("")), F.nullif(F.col("content"), F.lit(""))))
    return _joined(ranked, words if chars_per_chunk is None else F.substring(words, 1, chars_per_chunk), "\n", "evidence")


def citations(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per cited chunk; a bounding box only where all four sides are known."""
    sides = [F.col(f"bbox_{s}") for s in ("x0", "y0", "x1", "y1")] if "bbox_x0" in ranked.columns else None
    if sides is None:
        box = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    else:
        known = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull()
        box = F.when(known, F.struct(*[s.cast("double").alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"))]))
    names = documents.select("document_id", F.col("name").alias("document_name"))
    return ranked.join(names, "document_id", "left").select(
        "query_id",
        "rank",
        F.concat(F.lit("cite-"), "rank").alias("id"),
        "chunk_id",
        "document_id",
        F.coalesce("document_name", F.lit("Unknown document")).alias("document_name"),
        tx.clip(F.col("content"), 200).alias("chunk_text"),
        F.col("score").alias("relevance"),
        F.when(F.coalesce("chunk_type", F.lit("")) != "", F.col("chunk_type")).otherwise("text").alias("chunk_type"),
        box.alias("bbox"),
    )


def label_claims(answers: DataFrame, model=gr.label) -> DataFrame:
    """One row per claim with its label. `model` is a slot: claim and evidence columns to a label column."""
    rows = answers.select("answer_id", "evidence", F.posexplode(gr.claims(F.col("answer"))).alias("pos", "claim"))
    return rows.withColumn("label", model(F.col("claim"), F.col("evidence")))


def filter_answers(answers: DataFrame, model=None) -> DataFrame:
    """(answer_id, text, kept, dropped, cites) of answers (answer_id, answer, evidence).

    Without a model everything happens on the answer's own row. With one, claims are labelled
    as rows and brought back together by answer, in their order.
    """
    if model is None:
        done = answers.select("answer_id", gr.filter_answer(F.col("answer"), F.col("evidence")).alias("f"))
    else:
        rows = label_claims(answers, model).groupBy("answer_id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "claim", "label"))).alias("items")
        )
        none = F.array().cast("array<struct<pos:int,claim:string,label:string>>")
        done = answers.select("answer_id").join(rows, "answer_id", "left").select(
            "answer_id", gr.keep_supported(F.coalesce("items", none)).alias("f")
        )
    return done.select("answer_id", "f.*")
