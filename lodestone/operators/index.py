"""The search index: chunk table, vectors, postings, term statistics, identifier anchors.

Built once per corpus and written as Parquet, each part when it is first asked for; every search reads only the
columns it needs. Postings are written as a list on the chunk's row. Equal texts are embedded once: `dense` and `visual` hold
the vector of the first chunk of a text, `copies` and `visual_copies` name the first chunk of every chunk. So do the
rows of `postings`, and only those of first chunks hold the terms, with the number of chunks they stand for.
"""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, fields
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions import vectors as vec
from lodestone.operators import knn, lexical
from lodestone.operators.sizes import is_small

SCOPE = ("document_id", "workspace_id", "user_id")


@dataclass
class Index:
    """`chunks` holds (chunk_id, scope.., content, caption, token_count, chunk_type, content_hash, selected)."""

    chunks: DataFrame
    copies: DataFrame
    dense: DataFrame
    visual_copies: DataFrame
    visual: DataFrame | None
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    anchors: DataFrame
    embed: Callable[[Column], Column] = vec.lexical_counts
    lists: knn.Lists | None = None
    places: DataFrame | None = None

    def without_images(self) -> Index:
        return _with(self, visual=None)


PARTS = [f.name for f in fields(Index) if f.name not in ("embed", "lists", "places")]


def _with(index: Index, **parts) -> Index:
    """A copy with other parts; parts nobody has asked for stay unwritten."""
    out = copy(index)
    for name, part in parts.items():
        setattr(out, name, part)
    return out


class Stored(Index):
    """An index of the chunks that `source` gives. `once(name, write)` writes a part unless it is there, and gives its path."""

    def __init__(self, spark: SparkSession, source: Callable[[], DataFrame], once: Callable[[str, Callable[[str], None]], str], embed=vec.lexical_counts):
        self.spark, self.source, self.once, self.embed = spark, source, once, embed

    def _file(self, name: str) -> DataFrame:
        def write(path: str) -> None:
            made = self.source() if name == "chunks" else _part(name, self.chunks, self._file, self.embed, path)
            _written(made, f"{path}/{name}", name)

        return self.spark.read.parquet(f"{self.once(name, write)}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in PARTS:
            raise AttributeError(name)
        setattr(self, name, self._file(name))
        return getattr(self, name)


def searchable_text() -> Column:
    return F.concat_ws(" ", "content", "caption")


def _seen(chunks: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """The chunks that have a vector in a part, and the text it is made of."""
    if name in ("dense", "copies"):
        return chunks.where("selected"), F.col("content")
    # Only chunks with an image: seen through the caption and the text next to it.
    return chunks.where("chunk_type = 'figure'"), F.concat_ws(" ", "caption", "content")


def _written(df: DataFrame, path: str, name: str) -> DataFrame:
    """The texts are most of the index and written smaller; of marks, files that are too small would make the planner broadcast them."""
    df.write.mode("overwrite").option("compression", "zstd" if name == "chunks" else "snappy").parquet(path)
    return df.sparkSession.read.parquet(path)


def _firsts(rows: DataFrame, marks: DataFrame, measured: bool) -> DataFrame:
    """The rows (chunk_id, ..) that are the first of their text by the `marks` (chunk_id, first).

    The rows hold texts, so they stay where they are if the marks of either kind, measured, can be sent to them.
    """
    own, others = (marks.where(test).select("chunk_id") for test in ("chunk_id = first", "chunk_id <> first"))
    if measured and is_small(own):
        return rows.join(F.broadcast(own), "chunk_id", "left_semi")
    if measured and is_small(others):
        return rows.join(F.broadcast(others), "chunk_id", "left_anti")
    return rows.join(own, "chunk_id", "left_semi")


def _part(name: str, chunks: DataFrame, made: Callable[[str], DataFrame], embed, path: str | None = None) -> DataFrame:
    """A part as it is written; `made` gives the parts it comes from. With a `path` these are written tables, and what it needs besides is written there."""
    if name == "chunks":
        return chunks
    if name in ("copies", "visual_copies"):
        rows, text = _seen(chunks, name)
        return knn.copies(rows.select("chunk_id", *SCOPE, text.alias("text"), "token_count"), ["text", "token_count"])
    if name in ("dense", "visual"):
        rows, text = _seen(chunks, name)
        marks = made("copies" if name == "dense" else "visual_copies")
        return _firsts(rows, marks, path is not None).select("chunk_id", *SCOPE, "token_count", embed(text).alias("vec"))
    if name == "postings":
        marks = knn.copies(chunks.select("chunk_id", *SCOPE, searchable_text().alias("text")), ["text"])
        return _term_lists(chunks, _written(marks, f"{path}/marks", "marks") if path else marks, path is not None)
    if name == "terms":
        return lexical.unpacked(made("postings").select("n", "terms")).groupBy("token").agg(F.sum("n").alias("df"))
    if name == "stats":
        return made("postings").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("dl")) / F.sum("n")).alias("avgdl"))
    return lexical.anchors(chunks, *SCOPE)


def _term_lists(chunks: DataFrame, marks: DataFrame, written: bool) -> DataFrame:
    """(chunk_id, scope.., first, n, dl, terms): n, dl and terms only where a chunk is the first of its text."""
    lists = lexical.term_lists(_firsts(chunks, marks, written), "chunk_id", searchable_text(), *SCOPE)
    several = marks.groupBy("first").agg(F.count("*").alias("n")).where("n > 1")
    if written and is_small(several):
        several = F.broadcast(several)
    lists = lists.join(several, F.col("chunk_id") == F.col("first"), "left").withColumns({"first": F.col("chunk_id"), "n": F.coalesce("n", F.lit(1).cast("long"))})
    return lists.unionByName(marks.where("chunk_id <> first"), allowMissingColumns=True)


def build(chunks: DataFrame, embed=vec.lexical_counts) -> Index:
    """The index as lazy plans, for small or one-off corpora."""
    made: dict[str, DataFrame] = {}
    for name in PARTS:
        made[name] = _part(name, chunks, made.get, embed)
    return Index(**made, embed=embed)


def write(chunks: DataFrame, path: str, embed=vec.lexical_counts) -> None:
    """Write all parts of the index. Later parts are computed from the written chunks and term lists."""
    spark = chunks.sparkSession
    stored = _written(chunks, f"{path}/chunks", "chunks")
    for name in PARTS[1:]:
        _written(_part(name, stored, lambda part: spark.read.parquet(f"{path}/{part}"), embed, path), f"{path}/{name}", name)


def read(spark: SparkSession, path: str, embed=vec.lexical_counts) -> Index:
    return Index(**{name: spark.read.parquet(f"{path}/{name}") for name in PARTS}, embed=embed)


def write_lists(index: Index, path: str, lists: int | None = None) -> None:
    """Add inverted lists of the dense vectors, one for each different text, to a written index, for approximate search."""
    knn.write_lists(index.dense, f"{path}/lists", "chunk_id", lists)


def with_lists(index: Index, path: str) -> Index:
    return _with(index, lists=knn.read_lists(index.chunks.sparkSession, f"{path}/lists"))


def write_places(index: Index, path: str) -> None:
    """Add positional postings to a written index, for ranking by cover density."""
    places = lexical.positional_postings(index.chunks, "chunk_id", searchable_text(), *SCOPE)
    places.write.mode("overwrite").parquet(f"{path}/places")


def with_places(index: Index, path: str) -> Index:
    return _with(index, places=index.chunks.sparkSession.read.parquet(f"{path}/places"))
