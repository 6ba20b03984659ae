"""Pages to chunks: pack, prune, hash, de-duplicate, score, select.

A page is one row and its chunks are an array on that row until the very end, so a
corpus of one-page documents is ingested without any shuffle. Documents of several
pages are first brought together by document; the admission limit on file size bounds
that group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import text as tx
from lodestone.functions.counts import chunked, figures

CHARS_PER_TOKEN = 4


@dataclass(frozen=True)
class ChunkConfig:
    """The defaults of the ingest settings."""

    small_tokens: int = 300
    large_tokens: int = 700
    overlap_tokens: int = 75
    by_paragraph: bool = False
    multi_granularity: bool = True
    prune: bool = True
    min_tokens: int = 30
    max_tokens: int = 1200
    min_alnum: float = 0.6
    min_unique: float = 0.25
    dedup: bool = True
    selective: bool = True
    top_share: float = 0.4
    budget_share: float = 0.5
    budget_min: int = 12000
    budget_max: int = 30000


DEFAULT = ChunkConfig()


def pack_cuts(units: Column, limit: int, overlap: int, pad: int) -> Column:
    """Where to cut a list of units into chunks.

    The fold sees only unit lengths. A chunk is described by the units it draws on
    [lo, hi) and by its length: it is the last `len` characters of those units joined,
    because the overlap carried from the chunk before is always the text just in front.
    The time is linear in the units.
    """

    def length_of(a):
        return a["cur"] - F.when((a["ov"] > 0) | F.lit(pad == 0), 0).otherwise(pad)

    def state(i, first, lo, ov, cur):
        named = {"i": i, "first": first, "lo": lo, "ov": ov, "cur": cur}
        return F.struct(*[c.cast("int").alias(name) for name, c in named.items()])

    def cut(a):
        return F.struct(a["lo"].alias("lo"), a["i"].alias("hi"), length_of(a).cast("int").alias("len"))

    def full(a, n):
        return (a["cur"] + n > limit) & ((a["i"] > a["first"]) | (a["ov"] > 0))

    def step(a, n):
        ov = F.least(length_of(a), F.lit(overlap))
        fresh = length_of(a) - F.when(a["ov"] > 0, a["ov"] + 1).otherwise(0)
        lo = F.when(ov == 0, a["i"]).when(fresh >= ov, a["first"]).otherwise(a["lo"])
        return F.when(full(a, n), state(a["i"] + 1, a["i"], lo, ov, ov + n + pad)).otherwise(
            state(a["i"] + 1, a["first"], a["lo"], a["ov"], a["cur"] + n + pad)
        )

    zero = F.lit(0)
    return tx.let(
        tx.walk(
            F.transform(units, F.length),
            state(zero, zero, zero, zero, zero),
            step,
            lambda a, n: F.when(full(a, n), cut(a)),
            "struct<lo:int,hi:int,len:int>",
        ),
        lambda w: F.when(w["last"]["i"] > w["last"]["first"], F.concat(w["out"], F.array(cut(w["last"])))).otherwise(w["out"]),
    )


def _texts(units: Column, cuts: Column, joiner: str, exact: bool) -> Column:
    def text_of(c):
        joined = F.array_join(F.slice(units, c["lo"] + 1, c["hi"] - c["lo"]), joiner)
        return F.right(joined, c["len"]) if exact else joined

    return F.transform(cuts, text_of)


def _measured_chunks(content: Column, cfg: ChunkConfig, sizes: dict[str, int] | None) -> Column:
    """All chunks of a page with their figures, small ones first."""
    if sizes is None:
        sizes = {"small": cfg.small_tokens}
        if cfg.multi_granularity:
            sizes["large"] = cfg.large_tokens
    limits = {name: target * CHARS_PER_TOKEN for name, target in sizes.items()}
    return chunked(content, tx.paragraphs(content) if cfg.by_paragraph else None, limits, cfg.overlap_tokens * CHARS_PER_TOKEN)


def chunk_array(content: Column, cfg: ChunkConfig = DEFAULT, sizes: dict[str, int] | None = None) -> Column:
    """All chunks of a page, small ones first."""
    fields = ("granularity", "chunk_index", "content", "token_count")
    return F.transform(_measured_chunks(content, cfg, sizes), lambda c: F.struct(*(c[f].alias(f) for f in fields)))


def paragraph_packs(text: Column, limit: int = 400) -> Column:
    """Blank-line paragraphs packed up to `limit` characters, no overlap."""
    paras = F.filter(F.transform(F.split(text, "\n\n"), tx.strip), lambda p: p != "")
    return tx.let(paras, lambda ps: _texts(ps, pack_cuts(ps, limit, 0, 0), "\n\n", False))


def keep_chunk(
    content: Column,
    token_count: Column,
    chunk_type: Column,
    cfg: ChunkConfig = DEFAULT,
    alnum: Column | None = None,
    unique: Column | None = None,
) -> Column:
    """Whether a chunk is worth keeping. Tables and figures always are."""
    good = (
        token_count.between(cfg.min_tokens, cfg.max_tokens)
        & (content != "")
        & ((tx.alnum_ratio(content) if alnum is None else alnum) >= cfg.min_alnum)
        & ((tx.unique_ratio(content) if unique is None else unique) >= cfg.min_unique)
    )
    return chunk_type.isin("table", "figure") | good


def quality_score(
    content: Column, token_count: Column, alnum: Column | None = None, unique: Column | None = None
) -> Column:
    alnum = tx.alnum_ratio(content) if alnum is None else alnum
    unique = tx.unique_ratio(content) if unique is None else unique
    return F.when((content == "") | (token_count <= 0), F.lit(0.0)).otherwise(token_count * alnum * unique)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def keep_first(array: Column, key: str) -> Column:
    """Drop array elements whose `key` occurred before, in the array's own order.

    Sorting the keys once keeps the work near linear in the array size.
    """

    def dedupe(items: Column) -> Column:
        keyed = F.sort_array(F.transform(items, lambda c, i: F.struct(c[key].alias("k"), i.cast("int").alias("i"))))
        return tx.let(keyed, lambda order: F.transform(firsts(order), lambda i: items[i]))

    def firsts(order: Column) -> Column:
        starts = tx.runs(
            F.size(order), lambda j: (j == 0) | (order[j]["k"] != order[F.greatest(j - 1, F.lit(0))]["k"])
        )
        return F.sort_array(F.transform(starts, lambda j: order[j]["i"]))

    return tx.let(array, dedupe)


def select_for_embedding(array: Column, cfg: ChunkConfig = DEFAULT) -> Column:
    """Mark the elements to embed: the best share by score, as far as the budget allows.

    A chunk that does not fit is passed over and the walk goes on. Elements need the
    fields score, token_count and chunk_type. Beyond two sorts the time is linear in the elements.
    """
    if not cfg.selective:
        return F.transform(array, lambda c: c.withField("selected", F.lit(True)))

    def ranked(items: Column) -> Column:
        rest = F.filter(
            F.transform(
                items,
                lambda c, i: F.struct(
                    (-c["score"]).alias("s"),
                    i.cast("int").alias("i"),
                    c["token_count"].alias("t"),
                    c["chunk_type"].alias("y"),
                ),
            ),
            lambda r: ~r["y"].isin("table", "figure"),
        )
        return F.sort_array(rest)

    def budget(order: Column) -> Column:
        total = F.aggregate(order, F.lit(0).cast("bigint"), lambda s, r: s + r["t"])
        return F.greatest(F.lit(cfg.budget_min), F.least(F.floor(total * cfg.budget_share), F.lit(cfg.budget_max)))

    def picked(order: Column) -> Column:
        """Positions of the chosen elements, best first."""
        count = F.greatest(F.lit(1), F.floor(F.size(order) * F.lit(cfg.top_share)).cast("int"))
        return tx.let(
            budget(order),
            lambda limit: tx.walk(
                F.slice(order, F.lit(1), count),
                F.lit(0).cast("bigint"),
                lambda used, r: F.when(used + r["t"] <= limit, used + r["t"]).otherwise(used),
                lambda used, r: F.when(used + r["t"] <= limit, r["i"]),
                "int",
            )["out"],
        )

    def marks(items: Column, chosen: Column) -> Column:
        """One flag per element: chosen positions sorted among all positions come right behind their own."""
        every = F.transform(items, lambda c, i: F.struct(i.cast("int").alias("i"), F.lit(0).alias("chosen")))
        both = F.concat(every, F.transform(chosen, lambda i: F.struct(i.alias("i"), F.lit(1).alias("chosen"))))
        return tx.let(
            F.sort_array(both),
            lambda order: F.transform(
                tx.runs(F.size(order), lambda j: order[j]["chosen"] == 0),
                lambda j: F.coalesce(F.get(order, j + 1)["chosen"] == 1, F.lit(False)),
            ),
        )

    def mark(items: Column) -> Column:
        return tx.let(
            tx.let(tx.let(ranked(items), picked), lambda chosen: marks(items, chosen)),
            lambda flags: F.transform(
                items, lambda c, i: c.withField("selected", c["chunk_type"].isin("table", "figure") | flags[i])
            ),
        )

    return tx.let(array, mark)


def chunk_key(document_id: Column, page_number: Column, granularity: Column, index: Column) -> Column:
    """Readable chunk id; unlike the chunk index it is unique within a document."""
    return F.concat_ws("-", document_id, page_number.cast("string"), F.substring(granularity, 1, 1), index.cast("string"))


def chunk_rows(pages: DataFrame, cfg: ChunkConfig = DEFAULT, sizes: dict[str, int] | None = None) -> DataFrame:
    """One row per packed chunk, before any pruning."""
    made = pages.select("document_id", "page_number", F.inline(_measured_chunks(F.col("content"), cfg, sizes))).drop("alnum", "unique")
    return made.withColumn(
        "chunk_id",
        chunk_key(F.col("document_id"), F.col("page_number"), F.col("granularity"), F.col("chunk_index")),
    )


def _described(array: Column) -> Column:
    """Complete chunk structs: type, hash and score next to the text."""
    return F.transform(
        array,
        lambda c: F.struct(
            c["page_number"].alias("page_number"),
            c["granularity"].alias("granularity"),
            c["chunk_index"].alias("chunk_index"),
            c["content"].alias("content"),
            c["token_count"].alias("token_count"),
            c["chunk_type"].alias("chunk_type"),
            c["caption"].alias("caption"),
            c["image_key"].alias("image_key"),
            c["alnum"].alias("alnum"),
            c["unique"].alias("unique"),
            content_hash(c["content"]).alias("content_hash"),
            quality_score(c["content"], c["token_count"], c["alnum"], c["unique"]).alias("score"),
        ),
    )


def with_figures(chunks: Column) -> Column:
    """Add the figures of their content, alnum and unique, to an array of chunks."""
    measured = figures(F.transform(chunks, lambda c: c["content"]))
    return F.zip_with(chunks, measured, lambda c, m: c.withField("alnum", m["alnum"]).withField("unique", m["unique"]))


def finish_chunks(chunks: Column, cfg: ChunkConfig = DEFAULT) -> Column:
    """Prune, hash, de-duplicate and select the chunks of a document; they have their figures."""
    if cfg.prune:
        chunks = F.filter(
            chunks,
            lambda c: keep_chunk(c["content"], c["token_count"], c["chunk_type"], cfg, c["alnum"], c["unique"]),
        )
    chunks = _described(chunks)
    if cfg.dedup:
        chunks = keep_first(chunks, "content_hash")
    return select_for_embedding(chunks, cfg)


def documents_with_chunks(
    pages: DataFrame, cfg: ChunkConfig = DEFAULT, one_page: bool = False, structured: DataFrame | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Rows (document_id, carry.., chunks), with figures. `structured` adds table and figure chunks after the text ones.

    Columns of the document that its chunks need can be carried along, so that no join moves the texts.
    """
    df = pages.select(
        "document_id",
        *carry,
        "page_number",
        F.transform(
            _measured_chunks(F.col("content"), cfg, None),
            lambda c: F.struct(
                F.col("page_number").cast("int").alias("page_number"),
                c["granularity"].alias("granularity"),
                c["chunk_index"].alias("chunk_index"),
                c["content"].alias("content"),
                c["token_count"].alias("token_count"),
                F.lit("text").alias("chunk_type"),
                F.lit(None).cast("string").alias("caption"),
                F.lit(None).cast("string").alias("image_key"),
                c["alnum"].alias("alnum"),
                c["unique"].alias("unique"),
            ),
        ).alias("chunks"),
    )
    if one_page:
        df = df.select("document_id", *carry, "chunks")
    else:
        df = df.groupBy("document_id", *carry).agg(
            F.flatten(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("page_number", "chunks"))), lambda p: p["chunks"]
                )
            ).alias("chunks")
        )
    if structured is not None:
        extra = structured.groupBy("document_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct("seq", "page_number", "content", "token_count", "chunk_type", "caption", "image_key")
                )
            ).alias("_extra")
        ).select("document_id", with_figures(F.col("_extra")).alias("_extra"))
        none = F.array().cast(extra.schema["_extra"].dataType)
        df = df.join(extra, "document_id", "left").withColumn(
            "chunks", _append_structured(F.col("chunks"), F.coalesce("_extra", none))
        ).drop("_extra")
    return df


def _append_structured(chunks: Column, extra: Column) -> Column:
    """Table and figure chunks take the indexes that follow the text chunks."""
    return tx.let(
        chunks,
        lambda text: F.concat(
            text,
            F.transform(
                extra,
                lambda x, i: F.struct(
                    x["page_number"].cast("int").alias("page_number"),
                    F.lit("structured").alias("granularity"),
                    (F.size(text) + i).cast("int").alias("chunk_index"),
                    x["content"].alias("content"),
                    x["token_count"].cast("int").alias("token_count"),
                    x["chunk_type"].alias("chunk_type"),
                    x["caption"].alias("caption"),
                    x["image_key"].alias("image_key"),
                    x["alnum"].alias("alnum"),
                    x["unique"].alias("unique"),
                ),
            ),
        ),
    )


def ingest(
    pages: DataFrame, cfg: ChunkConfig = DEFAULT, one_page: bool = False, structured: DataFrame | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Final chunk table of a set of pages: one row per kept chunk, `selected` marks those to embed."""
    docs = documents_with_chunks(pages, cfg, one_page, structured, carry)
    done = docs.select("document_id", *carry, F.posexplode(finish_chunks(F.col("chunks"), cfg)).alias("position", "c"))
    return done.select(
        "document_id",
        *carry,
        chunk_key(F.col("document_id"), F.col("c.page_number"), F.col("c.granularity"), F.col("c.chunk_index")).alias("chunk_id"),
        "position",
        "c.*",
    )
