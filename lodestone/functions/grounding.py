"""Claims, evidence and the support test: column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone.functions import text as tx

# Words that carry no content in the support test.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "be", "been", "with",
    "as", "by", "at", "from", "that", "this", "it", "its", "if", "not", "but", "than", "then", "also", "may", "can",
    "will", "into", "their", "they", "them", "you", "your", "we",
]
CITATION = r"\[([0-9]+)\]"


def claims(answer: Column) -> Column:
    """Claims of an answer: headings whole, list items without their mark, prose by sentence."""

    def of_line(line: Column) -> Column:
        item = F.regexp_extract(line, f"^(?:[-*•]|[0-9]+[.)]){tx.WS}+([^\\n]+)", 1)
        parts = F.filter(
            F.transform(F.split(line, f"(?<=[.!?]){tx.WS}+(?=[A-Z0-9\"'])"), tx.strip), lambda p: p != ""
        )
        return (
            F.when(line.startswith("#"), F.array(line))
            .when(item != "", F.array(tx.strip(item)))
            .otherwise(parts)
        )

    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\r?\n"), tx.strip)
    return F.flatten(F.transform(F.filter(lines, lambda s: s != ""), of_line))


def content_tokens(text: Column) -> Column:
    return F.filter(tx.tokens(text), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 2))


def entailed(claim: Column, evidence: Column) -> Column:
    """Every number of the claim occurs in the evidence, and at least half of its content words do."""

    def test(low: Column) -> Column:
        numbers = F.forall(
            F.regexp_extract_all(claim, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda n: evidence.contains(n)
        )

        def found(t: Column) -> Column:
            return low.contains(t) | ((F.length(t) > 4) & low.contains(F.left(t, F.length(t) - 1)))

        words = tx.let(
            content_tokens(claim),
            lambda ts: (F.size(ts) == 0) | (F.size(F.filter(ts, found)) / F.greatest(F.size(ts), F.lit(1)) >= 0.5),
        )
        return numbers & words

    return tx.let(F.lower(evidence), test)


def label(claim: Column, evidence: Column) -> Column:
    return F.when((tx.strip(claim) != "") & entailed(claim, evidence), "entailment").otherwise("neutral")


def cited(claim: Column) -> Column:
    return F.transform(F.regexp_extract_all(claim, F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))


def keep_supported(labelled: Column) -> Column:
    """From an array of (claim, label): struct (text, kept, dropped, cites).

    Headings stay. If nothing stays, the first claim with a citation does, else the first one.
    """

    def supported(items: Column) -> Column:
        return F.filter(items, lambda c: c["claim"].startswith("#") | (c["label"] == "entailment"))

    def fallback(items: Column) -> Column:
        citing = F.filter(items, lambda c: F.size(cited(c["claim"])) > 0)
        return F.coalesce(F.get(citing, F.lit(0)), F.get(items, F.lit(0)))

    def build(items: Column) -> Column:
        return tx.let(
            F.struct(supported(items).alias("kept"), fallback(items).alias("back")),
            lambda s: F.when(
                (F.size(s["kept"]) > 0) | (F.size(items) == 0),
                result(
                    s["kept"],
                    F.filter(items, lambda c: ~(c["claim"].startswith("#") | (c["label"] == "entailment"))),
                    F.filter(s["kept"], lambda c: ~c["claim"].startswith("#")),
                ),
            ).otherwise(
                result(
                    F.array(s["back"]),
                    F.filter(items, lambda c: c["claim"] != s["back"]["claim"]),
                    F.array(s["back"]),
                )
            ),
        )

    def result(kept: Column, dropped: Column, citing: Column) -> Column:
        texts = F.transform(kept, lambda c: c["claim"])
        return F.struct(
            tx.strip(F.array_join(texts, " ")).alias("text"),
            texts.alias("kept"),
            F.transform(dropped, lambda c: c["claim"]).alias("dropped"),
            F.sort_array(F.array_distinct(F.flatten(F.transform(citing, lambda c: cited(c["claim"]))))).alias("cites"),
        )

    return tx.let(labelled, build)


def filter_answer(answer: Column, evidence: Column) -> Column:
    """Answer without its unsupported claims, by the default support test; no shuffle."""
    return keep_supported(
        F.transform(claims(answer), lambda c: F.struct(c.alias("claim"), label(c, evidence).alias("label")))
    )


def filter_citations(citations: Column, kept: Column) -> Column:
    """Citations whose number is kept; all of them when none is."""
    chosen = F.filter(citations, lambda c, i: F.array_contains(kept, (i + 1).cast("int")))
    return tx.let(chosen, lambda x: F.when((F.size(kept) > 0) & (F.size(x) > 0), x).otherwise(citations))


def extractive_answer(context: Column) -> Column:
    """First three sentences of the first context block, cited as [1]."""
    block = F.regexp_extract(context, r"(?s)\[[0-9]+\][^\n]*\n(.*?)(?:\n---|\z)", 1)
    flat = F.regexp_replace(tx.strip(block), f"{tx.WS}+", " ")
    head = F.array_join(F.filter(F.slice(tx.sentences(flat), 1, 3), lambda s: s != ""), " ")
    closed = F.when(head.rlike(r"[.?!]$"), head).otherwise(F.concat(head, F.lit(".")))
    return F.when(head == "", "I could not find that in the documents.").otherwise(F.concat(closed, F.lit(" [1]")))
