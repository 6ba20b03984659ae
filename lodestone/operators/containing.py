"""Tables of requests: rows within many scopes at once, and texts that contain one of many terms.

A term is looked up by its rarest run of three characters within its scope, and only the texts that hold this run
are searched for the term itself. So neither all pairs nor one scan for each term is needed.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import text as tx

#: Characters of a gram. Terms that are shorter are grams themselves.
GRAM = 3


def by_scope(scopes: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of every different scope, with the scope's columns as `scope_<column>`.

    A scope narrows by each of `columns` that is not null in it; rows with a null there are outside. Every
    combination of given columns is an equality join; the scope that gives none is one row at most.
    """
    names = [f"scope_{c}" for c in columns]
    distinct = scopes.select(*[F.col(c).alias(n) for c, n in zip(columns, names)]).distinct()
    parts = []
    for given in product([True, False], repeat=len(columns)):
        test, on = F.lit(True), F.lit(True)
        for use, c, n in zip(given, columns, names):
            test = test & (F.col(n).isNotNull() if use else F.col(n).isNull())
            on = on & (rows[c] == F.col(n)) if use else on
        asked = distinct.where(test)
        parts.append(rows.join(asked, on) if any(given) else rows.join(F.broadcast(asked)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*names, *rows.columns)


def grams(text: Column, size: int = GRAM) -> Column:
    """Different runs of `size` characters of a text."""
    return tx.let(
        F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
        lambda c: F.array_distinct(
            F.transform(tx.runs(F.size(c) - (size - 1), lambda i: F.lit(True)), lambda i: F.concat(*[c[i + j] for j in range(size)]))
        ),
    )


def postings(texts: DataFrame, key: list[str], scope: list[str], text: str) -> DataFrame:
    """Rows (gram, scope, key), once for each text and gram of up to `GRAM` characters."""
    every = F.concat(*[grams(F.lower(text), size) for size in range(1, GRAM + 1)])
    return texts.select(*scope, *key, F.explode(every).alias("gram"))


def containing(terms: DataFrame, texts: DataFrame, key: list[str], scope: list[str], text: str) -> DataFrame:
    """Pairs (scope, term, key) of texts that contain a term of the same scope, in any case.

    `terms` has the columns scope and term, `texts` the columns scope, key and text; `key` is unique. Equal
    terms, after lower-casing, count once and come out in lower case. An empty term is in every text of its scope;
    null terms, texts and scopes match nothing.
    """
    sought = terms.select(*scope, F.lower("term").alias("term")).where("term IS NOT NULL").distinct()
    known = texts.select(*scope, *key, F.lower(text).alias("_text")).where("_text IS NOT NULL")
    parts = F.when(F.length("term") < GRAM, F.array("term")).otherwise(grams(F.col("term")))
    held = sought.where("term <> ''").select(*scope, "term", F.explode(parts).alias("gram"))
    places = postings(texts, key, scope, text).join(held.select(*scope, "gram").distinct(), [*scope, "gram"], "left_semi")
    counts = places.groupBy(*scope, "gram").agg(F.count("*").alias("_n"))
    # A gram that no text holds rules its term out.
    rarest = (
        held.join(counts, [*scope, "gram"], "left")
        .groupBy(*scope, "term")
        .agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    )
    found = places.join(rarest, [*scope, "gram"]).select(*scope, *key, "term")
    found = found.join(known, [*scope, *key]).where(F.col("_text").contains(F.col("term")))
    whole = known.join(sought.where("term = ''"), scope)
    return found.select(*scope, "term", *key).unionByName(whole.select(*scope, "term", *key))
