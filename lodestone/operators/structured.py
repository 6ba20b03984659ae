"""Tables and figures: Markdown forms, geometry, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.functions import text as tx

# Reach of a caption, penalty for one below the image, smallest figure side.
REACH, SIDEWAYS, BELOW_PENALTY, CAPTION_CHARS, MIN_SIDE = 80.0, 8.0, 0.1, 400, 40.0


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_markdown(rows: Column) -> Column:
    """Markdown of an array of rows of cells; short rows are filled up, missing cells are empty."""
    clean = F.transform(
        rows,
        lambda r: F.transform(r, lambda c: tx.strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))),
    )

    def padded(cells: Column) -> Column:
        width = F.array_max(F.transform(cells, F.size))
        return tx.let(
            width,
            lambda w: F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))),
        )

    def lines(t: Column) -> Column:
        head = F.get(t, F.lit(0))
        rule = _line(F.transform(head, lambda c: F.lit("---")))
        body = F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1))), _line)
        return F.array_join(F.concat(F.array(_line(head), rule), body), "\n")

    return F.when(F.size(rows) == 0, "").otherwise(tx.let(tx.let(clean, padded), lines))


def pipe_count(md: Column) -> Column:
    return F.length(md) - F.length(F.replace(md, F.lit("|"), F.lit("")))


def table_content(rows: Column, raw: Column) -> Column:
    """Markdown, or the raw text of the table's area where the cells hold nothing."""
    filled = F.exists(rows, lambda r: F.exists(r, lambda c: tx.strip(F.coalesce(c, F.lit(""))) != ""))
    md = table_markdown(rows)
    return F.when((pipe_count(md) >= 4) & filled, md).otherwise(F.nullif(tx.strip(raw), F.lit("")))


def table_caption(rows: Column) -> Column:
    head = F.filter(F.get(rows, F.lit(0)), lambda c: F.coalesce(c, F.lit("")) != "")
    return F.when(F.size(F.get(rows, F.lit(0))) > 0, F.concat(F.lit("Table: "), F.array_join(F.transform(head, tx.strip), " | ")))


def row_markdown(rows: Column) -> Column:
    """For tables of more than two rows: each data row with the header repeated."""
    data = F.when(F.size(rows) > 2, F.slice(rows, F.lit(2), F.size(rows))).otherwise(F.slice(rows, 1, 0))
    each = F.transform(data, lambda r: table_markdown(F.array(F.get(rows, F.lit(0)), r)))
    return F.filter(each, lambda md: pipe_count(md) >= 4)


def flip_box(x0: Column, top: Column, x1: Column, bottom: Column, height: Column) -> Column:
    """Box measured from the top edge to one measured from the bottom edge, and back."""
    a, b = height - bottom, height - top
    return F.struct(x0.alias("x0"), F.least(a, b).alias("y0"), x1.alias("x1"), F.greatest(a, b).alias("y1"))


def nearest_caption(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Closest text block above or below each image: (image_id, caption), empty where there is none.

    images (image_id, page_id, x0, y0, x1, y1), blocks (page_id, x0, y0, x1, y1, text), measured
    from the top. Blocks meet images only in the height band that could match, so a page with
    very many blocks does not pair all of them.
    """

    def band(c: Column) -> Column:
        return F.floor(c / REACH)

    text = tx.strip(F.col("text"))
    b = blocks.where(text != "").select(
        "page_id", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"),
        text.alias("words"),
    )
    aligned = (F.col("bx1") >= F.col("x0") - SIDEWAYS) & (F.col("bx0") <= F.col("x1") + SIDEWAYS)
    above = images.select("*", F.explode(F.array(band(F.col("y0")), band(F.col("y0")) - 1)).alias("band")).join(
        b.withColumn("band", band(F.col("by1"))), ["page_id", "band"]
    )
    above = above.withColumn("gap", F.col("y0") - F.col("by1"))
    below = images.select("*", F.explode(F.array(band(F.col("y1")), band(F.col("y1")) + 1)).alias("band")).join(
        b.withColumn("band", band(F.col("by0"))), ["page_id", "band"]
    )
    # A block that counts as above is not weighed again as below.
    below = below.where(~(F.col("y0") - F.col("by1")).between(0, REACH)).withColumn("gap", F.col("by0") - F.col("y1"))
    cols = ["image_id", "gap", "rank_gap", "words"]
    near = (
        above.where(aligned & F.col("gap").between(0, REACH)).withColumn("rank_gap", F.col("gap")).select(cols)
        .unionByName(
            below.where(aligned & F.col("gap").between(0, REACH)).withColumn("rank_gap", F.col("gap") + BELOW_PENALTY).select(cols)
        )
    )
    best = near.groupBy("image_id").agg(F.min(F.struct(F.round("rank_gap", 6).alias("g"), "words")).alias("m"))
    return images.select("image_id").join(best, "image_id", "left").select(
        "image_id", F.coalesce(F.substring("m.words", 1, CAPTION_CHARS), F.lit("")).alias("caption")
    )


def figures(rects: DataFrame) -> DataFrame:
    """First rectangle per image and page, when both sides are large enough."""
    order = W.partitionBy("document_id", "page_number", "image_id").orderBy("seq")
    first = rects.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.where((F.col("x1") - F.col("x0") >= MIN_SIDE) & (F.col("y1") - F.col("y0") >= MIN_SIDE))


def figure_chunks(figs: DataFrame) -> DataFrame:
    """Chunk rows of figures (.., caption, page_number): the caption or a stand-in is the text."""
    label = F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.concat(F.lit("Figure on page "), "page_number"))
    content = F.concat(F.lit("[Figure] "), label)
    return figs.select(
        *[c for c in figs.columns if c != "caption"],
        label.alias("caption"),
        content.alias("content"),
        F.greatest(tx.token_estimate(content), F.lit(1)).alias("token_count"),
        F.lit("figure").alias("chunk_type"),
    )


def table_chunks(tables: DataFrame) -> DataFrame:
    """Chunk rows of tables (document_id, page_number, seq, rows, raw, image_key): whole table, then its rows."""
    parts = F.filter(
        F.concat(F.array(table_content(F.col("rows"), F.col("raw"))), row_markdown(F.col("rows"))), lambda c: c.isNotNull()
    )
    rows = tables.select(
        "document_id", "page_number", "seq", "image_key", table_caption(F.col("rows")).alias("caption"),
        F.posexplode(parts).alias("part", "content"),
    )
    return rows.select(
        "document_id", "page_number", F.struct("seq", "part").alias("seq"), "content",
        F.greatest(tx.token_estimate(F.col("content")), F.lit(1)).alias("token_count"),
        F.lit("table").alias("chunk_type"), "caption", "image_key",
    )
