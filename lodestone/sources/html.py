"""Visible text of web pages, in column expressions.

A page becomes a list of tags and texts, and one walk over it carries how deep each position lies in the elements that
matter. Time is linear in the length of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import text as tx

# Elements whose text is not shown, elements that begin and end a line, and named characters.
HIDDEN = ["script", "style", "nav", "head"]
BLOCKS = ["p", "div", "h1", "h2", "h3", "h4", "li", "br", "article", "section", "tr"]
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": "\"", "nbsp": "\u00a0", "apos": "'"}

#: Where the text of a page is looked for, best first; "all" is the whole page.
CHAIN = ("article", "body", "all")

NO_TEXT = "No text content found in document"
MISSING = "Document is missing"


def tokens(html: Column) -> Column:
    """Tags and the texts between them; comments and the insides of scripts and styles are gone.

    A tag is `<` or `</`, a letter or `!`, and all up to the next `>`. Any other `<` is text.
    """
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    return F.regexp_extract_all(bare, F.lit(r"</?[A-Za-z!][^>]*>|[^<]+|<"), F.lit(0))


def _code_point(reference: Column) -> Column:
    """Character of `&#65;` or `&#x41;`; numbers that are no character give the replacement character."""
    digits = F.regexp_extract(reference, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
    base16 = reference.rlike("^&#[xX]")
    number = F.when(F.length(digits) > 8, -1).when(base16, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    safe = F.when(valid, number).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """Numeric and the usual named character references as characters, in one pass; others stay as written.

    The semicolon of a named one, but for `&apos;`, may be missing unless it ends a longer name.
    """
    names = "|".join(n for n in NAMED if n != "apos")
    pattern = f"&#[0-9]+;|&#[xX][0-9A-Fa-f]+;|&(?:{names})(?:;|(?![A-Za-z0-9]{{0,40}};))|&apos;|[^&]+|&"

    def character(part: Column) -> Column:
        named = F.when(part.rlike("^&#.+;$"), _code_point(part))
        for name, shown in NAMED.items():
            named = named.when(part.isin(f"&{name};", f"&{name}"), shown)
        return named.otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, character), "")).otherwise(text)


def _lines(text: Column) -> Column:
    """Lines with single blanks, no empty ones."""
    lines = F.transform(F.split(text, "\n"), lambda s: tx.strip(F.regexp_replace(s, f"{tx.WS}+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def visible(html: Column) -> Column:
    """Struct of the visible text within each element of `CHAIN`, a line for each block."""

    def described(token: Column) -> Column:
        tag = F.lower(F.regexp_extract(token, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
        change = F.when(token.endswith("/>"), 0).when(token.startswith("</"), -1).otherwise(1)
        markup = token.rlike("^</?[A-Za-z!]")
        shown = F.when(~markup, token).when(tag.isin(BLOCKS), "\n")
        return F.struct(tag.alias("tag"), change.alias("change"), shown.alias("shown"), markup.alias("markup"))

    def step(state: Column, t: Column) -> Column:
        def depth(name: str, tags: list[str]) -> Column:
            moved = state[name] + F.when(t["tag"].isin(tags), t["change"]).otherwise(0)
            return F.greatest(moved, F.lit(0)).alias(name)

        return F.struct(depth("hidden", HIDDEN), *[depth(name, [name]) for name in CHAIN[:-1]])

    def emit(state: Column, t: Column) -> Column:
        piece = F.struct(
            t["shown"].alias("shown"), t["markup"].alias("markup"), *[(state[name] > 0).alias(name) for name in CHAIN[:-1]]
        )
        return F.when(t["shown"].isNotNull() & (t["markup"] | (state["hidden"] == 0)), piece)

    def text_in(pieces: Column, name: str) -> Column:
        kept = pieces if name == "all" else F.filter(pieces, lambda p: p["markup"] | p[name])
        return _lines(F.array_join(F.transform(kept, lambda p: F.when(p["markup"], p["shown"]).otherwise(unescape(p["shown"]))), ""))

    start = F.struct(F.lit(0).alias("hidden"), *[F.lit(0).alias(name) for name in CHAIN[:-1]])
    kind = "struct<shown:string,markup:boolean," + ",".join(f"{name}:boolean" for name in CHAIN[:-1]) + ">"
    walked = tx.walk(F.transform(tokens(html), described), start, step, emit, kind)["out"]
    return tx.let(walked, lambda pieces: F.struct(*[text_in(pieces, name).alias(name) for name in CHAIN]))


def parse(raw: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each page (key, page_number, content, parser, error).

    The first element of `CHAIN` with any text gives the content. A page without any, or a null one, is a row
    with an error and nothing else. Rows of equal keys stay apart.
    """
    texts = tx.let(
        F.col(value),
        lambda html: tx.let(
            visible(html),
            lambda found: F.filter(
                F.array(*[F.struct(F.lit(name).alias("parser"), found[name].alias("content")) for name in CHAIN]),
                lambda c: c["content"] != "",
            ),
        ),
    )
    best = raw.select(key, F.col(value).isNull().alias("_missing"), F.when(F.col(value).isNotNull(), F.get(texts, F.lit(0))).alias("_best"))
    good = F.col("_best").isNotNull()
    return best.select(
        key,
        F.when(good, 1).alias("page_number"),
        F.col("_best.content").alias("content"),
        F.col("_best.parser").alias("parser"),
        F.when(F.col("_missing"), MISSING).when(~good, NO_TEXT).alias("error"),
    )
