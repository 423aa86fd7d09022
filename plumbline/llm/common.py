"""Helpers shared by the text operators: scratch tables, checked joins, vectorised words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_folder

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only when it has been counted and has at most so many rows
#: of a few numbers each (some 8 MB); beyond that the join shuffles both sides.
BROADCAST_ROWS = 400_000
#: Text is handled in slices of about this many bytes, so that temporary arrays stay small.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables below the shared folder: each is computed once and ends its lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = scratch_folder(spark)
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.made}"
        self.made += 1
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def join_checked(
    big: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join with a side of a known number of rows: broadcast if few, else by shuffling."""
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


# ---------------------------------------------------------------- words as arrays

_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, UTF-8 bytes, row offsets in them); null counts as empty.

    A run holds up to ``limit`` bytes, or one longer row.
    """
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(first + 1, last), len(column))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; white space is ``[\\x20\\x09-\\x0D]``."""
    solid = _SOLID[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:len(data)]
    end[:-1] &= ~solid[1:] | edge[1:len(data)]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


_up, _down = np.ones(0, np.uint64), np.ones(0, np.uint64)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept, and grown by doubling."""
    global _up, _down
    if len(_up) < count:
        size = 1 << max(20, int(count).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _up, _down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _up, _down


def byte_codes(seed: int, fold_case: bool) -> np.ndarray:
    """A random 64-bit code for each byte; A-Z as a-z when folding case."""
    codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) | np.uint64(1)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


_FOLDED, _EXACT = byte_codes(5, True), byte_codes(7, False)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span follows in two look-ups."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes[data] * _powers(len(data))[0][:len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * _powers(len(prefix))[1][starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    return span_hashes(prefix_hashes(data, _FOLDED if fold_case else _EXACT), starts, ends)


_PLACE = [np.uint64(v | 1) for v in np.random.default_rng(11).integers(1, 1 << 63, 64, np.int64).tolist()]


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``width`` words; a shorter row gives one run of all its words."""
    count = len(hashes)
    with np.errstate(over="ignore"):
        if count >= width:
            total = np.zeros(count - width + 1, np.uint64)
            for k in range(width):
                total += hashes[k:count - width + 1 + k] * _PLACE[k]
            whole = rows[:count - width + 1] == rows[width - 1:]
            full, full_rows = total[whole], rows[:count - width + 1][whole]
        else:
            full, full_rows = np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if count else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, count])
        short = np.zeros(len(first), np.uint64)
        for k in range(width - 1):
            has = length > k
            short[has] += hashes[first[has] + k] * _PLACE[k]
        few = length < width
    hashes = mix(np.r_[full, short[few] + np.uint64(1)])
    rows = np.r_[full_rows, rows[first[few]]]
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]
