"""Shared parts of the corpus operators: the shared folder, materialised tables, byte-level tokenising and stable hashes.

Everything that works on text runs on whole Arrow string buffers: the bytes of many
documents lie end to end, and words are found and hashed with numpy over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.ship import ship
from graphloom.plans.tables import materialize, shared_dir

SLICE_BYTES = 1 << 20
"""Text bytes that one vectorised step works on; a longer document is one step of its own."""

ROOT_ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column has already, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as (bytes, offsets); null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_slices(offsets: np.ndarray, size: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `size` bytes and at most `most` documents; each document whole."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, at + most, max(at + 1, to))
        yield at, to
        at = to


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 arithmetic wraps."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix64(x: np.ndarray) -> np.ndarray:
    return _mix(np.asarray(x, np.uint64))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """One random-looking odd 64-bit value a byte, A-Z folded onto a-z."""
    v = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(ROOT_ODD)) | np.uint64(1)
    v[65:91] = v[97:123]
    return v


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.uint64(ROOT_ODD)
    inv = np.uint64(pow(ROOT_ODD, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, r, np.uint64))), dtype=np.uint64)
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inv, np.uint64))), dtype=np.uint64)
    return up, down


def _class(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    if chars == "alnum":
        # a-z, A-Z, 0-9 and every byte of a non-ASCII code point
        m[48:58] = m[65:91] = m[97:123] = True
        m[128:] = True
    else:
        # all but space and \t to \r
        m[:] = True
        m[32] = False
        m[9:14] = False
    return m


IS_WORD = {"alnum": _class("alnum"), "space": _class("space")}


class Words:
    """Words of a run of documents: byte starts and ends, 64-bit hashes (A-Z folded), and each document's first word."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: str, hashes: bool = True):
        n = len(raw)
        m = IS_WORD[kind][raw]
        lead = m.copy()
        lead[1:] &= ~m[:-1]
        tail = m.copy()
        tail[:-1] &= ~m[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        lead[inner] = m[inner]
        tail[inner - 1] = m[inner - 1]
        self.start = np.flatnonzero(lead)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hash(raw) if hashes else None

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = 1 << max(20, int(len(raw)).bit_length())
        up, down = _powers(size)
        with np.errstate(over="ignore"):
            c = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_byte_values()[raw] * up[: len(raw)], out=c[1:])
            h = (c[self.end] - c[self.start]) * down[self.start]
            return _mix(h + (self.end - self.start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
        return _mix(h)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def arrow_rows(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in schema], schema=schema)


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each document's range."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def text_batches(batch: pa.RecordBatch, column: int, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of a batch's texts, in slices of whole documents."""
    text = batch.column(column)
    raw, off = column_bytes(text)
    for a, b in doc_slices(off, most=most):
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]


__all__ = ["Words", "arrow_rows", "as_long", "column_bytes", "crc_mod", "doc_slices", "materialize", "mix64", "per_doc", "read_table", "shared_dir", "shingle_hashes", "shuffle_width", "spare", "text_batches"]
