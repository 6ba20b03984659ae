"""Token counts of whole batches of texts, packed texts, and the figures of chunks: small steps behind Arrow columns."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from lodestone.functions.text import WS_CHARS

#: Every byte but those of a token becomes a blank.
_TOKEN_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
_NOT_ALNUM, _ASCII = bytes(b for b in range(128) if not chr(b).isalnum()), re.compile(r"[\x00-\x7f]+")
#: Texts whose tokens are held at once.
ROWS = 1000
#: Tokens whose slots a worker remembers.
HELD_WORDS = 200_000

_COUNTED = pa.struct([("token", pa.string()), ("tf", pa.int32())])


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every token (run of a-z and 0-9 in the lower-cased text) in order, and the tokens by code."""
    found = [(t or "").lower().encode() for t in texts]
    starts = np.cumsum([1, *(len(t) + 1 for t in found)])
    data = np.frombuffer(b" ".join([b"", *found, b""]).translate(_TOKEN_BYTES), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data[inside])).dictionary_encode()
    return np.searchsorted(starts, first, "right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _parts(texts: pa.Array) -> Iterator[list[str | None]]:
    for i in range(0, max(1, len(texts)), ROWS):
        yield texts.slice(i, ROWS).to_pylist()


@lru_cache(maxsize=HELD_WORDS)
def _digest(token: str) -> bytes:
    return hashlib.sha256(token.encode()).digest()[:16]


def hashed_rows(texts: list[str | None], dim: int) -> np.ndarray:
    """Signed slot counts of each text, as rows; small whole numbers, so float32 holds them exactly."""
    rows, codes, words = tokens_of(texts)
    none = np.flatnonzero(np.bincount(rows, minlength=len(texts)) == 0)
    rows, codes = np.concatenate([rows, none]), np.concatenate([codes, np.full(len(none), len(words))])
    head = np.frombuffer(b"".join(map(_digest, [*words.to_pylist(), "empty"])), ">u4").reshape(-1, 4).astype(np.int64)
    sign = np.where((head >> 24) % 2 == 0, 1.0, -1.0)
    slots = rows[:, None] * dim + (head % dim)[codes]
    return np.bincount(slots.ravel(), sign[codes].ravel(), len(texts) * dim).astype(np.float32).reshape(-1, dim)


def hashed_vector(text: Column, dim: int) -> Column:
    """`hashed_rows` of a column, as array<float>."""

    @arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        made = [hashed_rows(part, dim).ravel() for part in _parts(texts)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(np.concatenate(made)))

    return embed(text)


def term_counts(text: Column) -> Column:
    """(dl, terms): number of tokens of a text, and its different tokens with their counts, (token, tf), in no fixed order."""

    @arrow_udf("struct<dl:int,terms:array<struct<token:string,tf:int>>>")
    def count(texts: pa.Array) -> pa.Array:
        made = []
        for part in _parts(texts):
            rows, codes, words = tokens_of(part)
            keys, tf = np.unique(rows * max(1, len(words)) + codes, return_counts=True)
            home, code = np.divmod(keys, max(1, len(words)))
            ends = np.searchsorted(home, np.arange(len(part) + 1)).astype(np.int32)
            tokens = words.take(pa.array(code))
            terms = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([tokens, pa.array(tf.astype(np.int32))], fields=list(_COUNTED)))
            dl = pa.array(np.bincount(rows, minlength=len(part)).astype(np.int32))
            made.append(pa.StructArray.from_arrays([dl, terms], names=["dl", "terms"]))
        return pa.concat_arrays(made)

    return count(text)


#: Longest stretches an identifier could cover, from every place where one can begin.
_RUNS = re.compile(r"(?=((?:sku-|fig-)[a-z0-9-]+|site\s+[0-9]+))", re.ASCII)


def anchor_runs(text: Column) -> Column:
    """Stretches of the lower-cased text that an identifier could cover: array<string>."""

    @arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        low = (t.lower() for t in texts.to_pylist())
        return pa.array([_RUNS.findall(t) if "sku-" in t or "fig-" in t or "site" in t else [] for t in low], pa.list_(pa.string()))

    return find(text)


def figures_of(text: str) -> tuple[float, float]:
    """Share of letters and digits among the characters, and of different words among those of only letters and digits."""
    ascii_part = text.encode("ascii", "ignore")
    other = "" if len(ascii_part) == len(text) else _ASCII.sub("", text)
    plain = list(filter(str.isalnum, text.lower().split()))
    count = len(ascii_part.translate(None, _NOT_ALNUM)) + sum(map(str.isalnum, other))
    return count / max(1, len(text)), len(set(plain)) / max(1, len(plain))


def figures(texts: Column) -> Column:
    """`figures_of` each text of an array column: array<struct<alnum, unique>>."""

    @arrow_udf("array<struct<alnum:double,unique:double>>")
    def measure(lists: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int32)
        found = [figures_of(t) for t in lists.flatten().to_pylist()]
        alnum, unique = (pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([alnum, unique], names=["alnum", "unique"]))

    return measure(texts)


#: A sentence end and the white space behind it.
_BREAK, _BLANK = re.compile(f"[.!?][{WS_CHARS}]+"), re.compile(f"[{WS_CHARS}]*")


def sentences_of(text: str) -> list[str]:
    """Split after a full stop, exclamation or question mark."""
    ends, starts = [], [0]
    for m in _BREAK.finditer(text):
        ends.append(m.start() + 1)
        starts.append(m.end())
    return [text[a:b] for a, b in zip(starts, [*ends, len(text)])]


def packs_of(units: list[str], limit: int, overlap: int) -> tuple[str, list[tuple[int, int]]]:
    """The units joined by blanks, and start and end of every chunk in it.

    A chunk takes units while it has at most `limit` characters, one at least; it begins with the last `overlap` characters of
    the chunk before, which are the text just in front. Every cut is found by bisection among the ends of units.
    """
    starts = list(accumulate((len(u) + 1 for u in units), initial=0))
    cuts, first, carried = [], 0, 0
    while first < len(units):
        last = max(first + 1, bisect_right(starts, limit + 1 + starts[first] - carried) - 1)
        cut = (starts[first] - (carried + 1 if carried else 0), starts[last] - 1)
        cuts.append(cut)
        first, carried = last, min(cut[1] - cut[0], overlap)
    return " ".join(units), cuts


def chunked(text: Column, units: Column | None, sizes: dict[str, int], overlap: int) -> Column:
    """Chunks of a text with their figures, by granularity and its limit in characters: array<struct>. Without `units` sentences are packed."""
    kind = "array<struct<granularity:string,chunk_index:int,content:string,token_count:int,alnum:double,unique:double>>"

    def rows_of(found: list[str]) -> Iterator[tuple]:
        for granularity, limit in sizes.items():
            joined, cuts = packs_of(found, limit, overlap)
            for i, (a, b) in enumerate(cuts):
                content = joined[a:b]
                if not _BLANK.fullmatch(content):
                    yield granularity, i, content, len(content) // 4, *figures_of(content)

    @arrow_udf(kind)
    def pack(items: pa.Array) -> pa.Array:
        ends, columns = [0], [[] for _ in range(6)]
        for x in items.to_pylist():
            for row in rows_of(sentences_of(x) if isinstance(x, str) else x or []):
                for column, value in zip(columns, row):
                    column.append(value)
            ends.append(len(columns[0]))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64())
        names = ["granularity", "chunk_index", "content", "token_count", "alnum", "unique"]
        made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, mask=items.is_null() if items.null_count else None)

    return pack(text if units is None else units)
