"""What a query asks for: column functions over the query text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone.functions import text as tx

# The phrase lists below decide classes and must stay as they are.
KEYWORD_TRIGGERS = [
    "list of", "all the", "names of", "steps to", "parts of", "symptoms of", "types of", "examples of", "kinds of",
    "what are", "who are", "where is", "when did", "number of", "calculate", "formula", "equation",
]
SEMANTIC_TRIGGERS = [
    "explain", "describe", "how does", "why does", "compare", "difference between", "relationship between",
    "meaning of", "overview of", "summary of", "analysis of",
]
VISUAL_TRIGGERS = [
    "figure", "diagram", "image", "photo", "chart", "plot", "picture", "illustration", "fig-", "fig ",
    "what does fig", "screenshot", "visual",
]
ROUTE_TRIGGERS = ["what is", "explain", "describe", "overview", "summary", "how does"]
INJECTION_PHRASES = [
    "ignore previous", "ignore all", "disregard", "you are now", "pretend you are", "act as", "bypass", "jailbreak",
    "dan ", "developer mode", "unfiltered", "without restrictions", "reveal your", "show your", "system prompt",
    "training data", "internal instructions", "be unfiltered", "no censorship", "ethical guidelines",
    "content policy", "you must", "i command you", "i order you", "forget all", "from now on", "###",
]
FACTUAL_PHRASES = [
    "what is", "what are", "how does", "how do", "define", "explain", "describe", "compare", "contrast",
    "difference between", "list the", "who is", "who was", "when did", "where is", "why does", "symptoms", "causes",
    "treatment", "definition", "meaning",
]
OPINION_PHRASES = [
    "think", "feel", "opinion", "best way", "suggest", "recommend", "should i", "would you", "personal",
    "your experience",
]
QUESTION_WORDS = ["what", "who", "where", "when", "why", "how", "is", "are", "do", "does"]
HEDGING_PHRASES = [
    "i think", "i believe", "may be", "might be", "could be", "it seems", "probably", "possibly", "in general",
    "typically", "often", "sometimes", "usually", "i'm not sure", "not certain", "your opinion", "you might",
    "you should", "i would recommend",
]
TIME_PHRASES = [
    "latest", "current", "recent", "newest", "updated", "news", "announcement", "2024", "2025", "2026", "as of",
    "as of today", "now",
]
STRATEGIES = ["SEMANTIC", "KEYWORD", "HYBRID"]


def hybrid_class(q: Column) -> Column:
    low = F.lower(q)
    words, meaning = tx.count_contained(low, KEYWORD_TRIGGERS), tx.count_contained(low, SEMANTIC_TRIGGERS)
    return F.when(words > meaning, "keyword_heavy").when(meaning > words, "semantic_heavy").otherwise("balanced")


def adaptive_weight(q: Column, fallback: float = 0.7) -> Column:
    kind = hybrid_class(q)
    return (
        F.when(kind == "keyword_heavy", max(0.4, fallback - 0.2))
        .when(kind == "semantic_heavy", min(0.85, fallback + 0.1))
        .otherwise(fallback)
    )


def wants_visual(q: Column) -> Column:
    return tx.contains_any(F.lower(F.coalesce(q, F.lit(""))), VISUAL_TRIGGERS)


def route(q: Column, override: Column | None = None) -> Column:
    """Strategy by simple rules; a valid override wins."""
    low = F.lower(tx.strip(q))
    lookup = low.rlike(r"\p{Nd}") | low.contains('"') | low.contains("'") | (F.size(tx.words(low)) <= 4)
    chosen = (
        F.when(low == "", "HYBRID")
        .when(lookup, "KEYWORD")
        .when(tx.contains_any(low, ROUTE_TRIGGERS), "SEMANTIC")
        .otherwise("HYBRID")
    )
    return chosen if override is None else F.when(override.isin(STRATEGIES), override).otherwise(chosen)


def is_injection(q: Column, longest: int = 10000) -> Column:
    return tx.contains_any(F.lower(q), INJECTION_PHRASES) | (F.length(q) > longest)


def sanitize(q: Column) -> Column:
    """Flagged queries lose long runs of markup symbols."""
    return F.when(is_injection(q), F.regexp_replace(q, r"#{3,}|\*{3,}|-{3,}", "")).otherwise(q)


def question_type(q: Column) -> Column:
    low = F.lower(q)
    facts, views = tx.count_contained(low, FACTUAL_PHRASES), tx.count_contained(low, OPINION_PHRASES)
    return F.when(facts > views, "factual").when(views > 0, "opinion").otherwise("neutral")


def is_simple(q: Column) -> Column:
    def test(w: Column) -> Column:
        asks = F.size(F.filter(w, lambda x: x.isin(QUESTION_WORDS)))
        return (F.size(w) <= 4) | (asks >= F.size(w) * F.lit(0.6))

    return tx.let(tx.words(F.lower(q)), test)


def hyde_count(q: Column) -> Column:
    return F.when((question_type(q) == "factual") & ~is_simple(q), 3).otherwise(2)


def hyde_usable(text: Column) -> Column:
    size = F.length(tx.strip(F.coalesce(text, F.lit(""))))
    return size.between(30, 600) & ~tx.contains_any(F.lower(F.coalesce(text, F.lit(""))), HEDGING_PHRASES)


def variations(query: Column, output: Column, n: int = 3) -> Column:
    """Query variations from a model's lines; the original comes first."""
    lines = F.filter(F.transform(F.split(output, "\n"), tx.strip), lambda s: F.length(s) > 5)
    return F.slice(F.array_distinct(F.concat(F.array(query), lines)), 1, n + 1)


def cache_ttl(q: Column, base: int = 86400, short: int = 3600) -> Column:
    return F.when(tx.contains_any(F.lower(q), TIME_PHRASES), min(short, base)).otherwise(base)


def parse_route(output: Column) -> Column:
    first = F.upper(F.get(tx.words(output), F.lit(0)))
    return F.when(first.isin(STRATEGIES), first).otherwise("HYBRID")


def json_field(output: Column, name: str, limit: int) -> Column:
    """A field of the JSON object inside free text; empty when there is none."""
    body = F.regexp_extract(output, r"(?s)\{.*\}", 0)
    return F.substring(tx.strip(F.coalesce(F.get_json_object(body, f"$.{name}"), F.lit(""))), 1, limit)


def slug(name: Column) -> Column:
    return F.replace(F.lower(tx.strip(name)), F.lit(" "), F.lit("_"))


def slug_error(s: Column) -> Column:
    bare = F.replace(s, F.lit("_"), F.lit(""))
    return (
        F.when(s == "", "empty")
        .when(F.length(s) > 64, "too long")
        .when(~bare.rlike(r"^[\p{L}\p{N}]+$"), "not alphanumeric")
    )
