"""Column functions on text. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space that Unicode-aware string handling recognises.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

# Lines that close a paragraph and stand on their own.
HEADING_PATTERNS = [
    r"^(?:#{1,6}\s+.+)$",
    r"^\s*\d+\.\s+[A-Z][^\n]+$",
    r"^(?:\*{2,}|_{2,})[^\n]+(?:\*{2,}|_{2,})$",
    r"^(?:[A-Z][A-Z\s]{3,}:)$",
    r"^\s*[-=]{3,}\s*$",
]


# The same white space, character by character.
WS_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def words(c: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Split after a full stop, exclamation or question mark."""
    return F.split(c, f"(?<=[.!?]){WS}+")


def is_heading(line: Column) -> Column:
    test = F.lit(False)
    for pattern in HEADING_PATTERNS:
        test = test | line.rlike(pattern)
    return test


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row.

    The optimizer may copy a column's expression into a lambda, where it would run
    once per element; a bound lambda variable cannot be copied.
    """
    return F.transform(F.array(value), body)[0]


def runs(n: Column, starts_run) -> Column:
    """Zero-based positions i below n at which `starts_run(i)` holds."""
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), starts_run)).otherwise(
        F.array().cast("array<int>")
    )


#: Elements a walk takes at a time.
BLOCK = 64


def walk(items: Column, start: Column, step, emit, kind: str) -> Column:
    """Struct (out, last): what a walk over `items` puts out, and its state at the end.

    `step(state, x)` is the next state, `emit(state, x)` an element of type `kind` or null for none. A fold
    copies its state at every step, so a list that grows in it costs n * n. Here a first fold carries the state over
    whole blocks and notes only where each block starts; the blocks then list their own elements.
    """

    def block(items: Column, b: Column) -> Column:
        return F.slice(items, b * BLOCK + 1, F.lit(BLOCK))

    def carried(items: Column) -> Column:
        states = F.struct(start.alias("state"), F.slice(F.array(start), 1, 0).alias("starts"))
        blocks = runs(F.ceil(F.size(items) / BLOCK).cast("int"), lambda b: F.lit(True))
        return F.aggregate(
            blocks,
            states,
            lambda a, b: F.struct(
                F.aggregate(block(items, b), a["state"], step).alias("state"),
                F.concat(a["starts"], F.array(a["state"])).alias("starts"),
            ),
        )

    def listed(items: Column, state: Column, b: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")

        def add(a: Column, x: Column) -> Column:
            element = emit(a["state"], x)
            out = F.when(element.isNotNull(), F.concat(a["out"], F.array(element))).otherwise(a["out"])
            return F.struct(step(a["state"], x).alias("state"), out.alias("out"))

        return F.aggregate(block(items, b), F.struct(state.alias("state"), none.alias("out")), add, lambda a: a["out"])

    def walked(items: Column) -> Column:
        return let(
            carried(items),
            lambda c: F.struct(
                F.flatten(F.transform(c["starts"], lambda state, b: listed(items, state, b))).alias("out"),
                c["state"].alias("last"),
            ),
        )

    return let(items, walked)


def paragraphs(c: Column) -> Column:
    """Paragraph and heading units of a text.

    Blank lines and headings end a paragraph; a heading is a unit of its own.
    A unit starts at a heading, or at a body line that follows anything but a body line.
    """
    lines = F.transform(
        F.transform(F.split(c, "\n"), strip),
        lambda s: F.struct(
            s.alias("s"), F.when(s == "", "blank").when(is_heading(s), "head").otherwise("body").alias("kind")
        ),
    )

    def units(rows: Column) -> Column:
        starts = runs(
            F.size(rows),
            lambda i: (rows[i]["kind"] == "head")
            | ((rows[i]["kind"] == "body") & ((i == 0) | (rows[F.greatest(i - 1, F.lit(0))]["kind"] != "body"))),
        )
        return let(starts, lambda at: F.transform(at, lambda start, j: unit(rows, at, start, j)))

    def unit(rows: Column, at: Column, start: Column, j: Column) -> Column:
        following = F.coalesce(F.get(at, j + 1), F.size(rows))
        body = F.filter(F.slice(rows, start + 1, following - start), lambda r: r["s"] != "")
        return F.array_join(F.transform(body, lambda r: r["s"]), " ")

    return let(lines, units)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def alnum_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")) / F.greatest(F.length(c), F.lit(1))


def unique_ratio(c: Column) -> Column:
    """Distinct share of the words that consist of letters and digits only."""
    plain = F.filter(words(F.lower(c)), lambda w: w.rlike(r"^[\p{L}\p{N}]+$"))
    return let(plain, lambda w: F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def contains_any(c: Column, needles: list[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | c.contains(needle)
    return test


def count_contained(c: Column, needles: list[str]) -> Column:
    total = F.lit(0)
    for needle in needles:
        total = total + c.contains(needle).cast("int")
    return total


def clip(c: Column, n: int) -> Column:
    """Cut to n characters and mark the cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
