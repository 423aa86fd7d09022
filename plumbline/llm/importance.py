"""Target-distribution importance resampling over hashed word and word-pair features.

Features are the words of a text and its runs of two, hashed by CRC-32 into buckets.  The
gain of a bucket compares how often the target texts and the raw texts fall into it; a
document's weight is the mean gain of its features; adding Gumbel noise to the weights and
taking the highest draws documents without replacement in proportion to them.

How a slice of texts becomes buckets: its different words, each bounded by delimiters, are
the patterns of an Aho-Corasick automaton.  A scan of the slice emits the number of each
word as it ends, and with it the word's payload: its CRC and its length.  The CRC of a pair
is composed from the payloads of two adjacent words (CRCs are linear, so the first one is
carried over the length of the second by a table) without touching the text again.

Spark sums the buckets of all tasks (partial sums of fixed size first), so the gains are
those of the whole corpus; they are one number per bucket, and go to the second pass with
the task.  Ranks come from a sort by ranges and counts per range, so no task sees more than
its range.

A null text has no words.  Documents without features weigh 0.  A null key counts as an
empty one in the noise; rows with equal keys have equal noise.  Rows that are alike in score
and key are drawn in any order, which shows in no result.  Empty tables of documents give no
rows, an empty target gives gains as the formula has them.  Other columns, also those named
like the results, are ignored.  A very long text is a slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Scratch, slices

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
_SLICE = 1 << 20
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x30:0x3A] = np.arange(0x30, 0x3A)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
#: Stands between texts: no word holds it.
_TEXT_END = "\n"


@lru_cache(maxsize=4096)
def _carry(length: int) -> np.ndarray:
    """How ``length`` zero bytes after a string change its CRC: one table per byte of the CRC."""
    def apply(m: np.ndarray, values: np.ndarray) -> np.ndarray:
        bits = (values[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        return np.bitwise_xor.reduce(np.where(bits == 1, m, np.uint32(0)), axis=1).astype(np.uint32)

    # the register after one more zero bit, for each single bit of the register; then a byte
    step = np.array([0xEDB88320] + [1 << k for k in range(31)], np.uint32)
    for _ in range(3):
        step = apply(step, step)
    result = np.uint32(1) << np.arange(32, dtype=np.uint32)
    while length:
        if length & 1:
            result = apply(step, result)
        step, length = apply(step, step), length >> 1
    values = np.arange(256, dtype=np.uint32)
    return np.stack([apply(result, values << np.uint32(8 * k)) for k in range(4)])


def compose(crcs: np.ndarray, lengths: np.ndarray, next_crcs: np.ndarray) -> np.ndarray:
    """CRCs of strings joined: the first ones' CRCs, the lengths and CRCs of what follows."""
    kinds, which = np.unique(lengths, return_inverse=True)
    tables = np.stack([_carry(int(n)) for n in kinds]) if len(kinds) else np.zeros((0, 4, 256), np.uint32)
    out = next_crcs.copy()
    for k in range(4):
        out ^= tables[which, k, (crcs >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _word_numbers(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a normalised slice: numbers of the words in order (0 ends a text); their payloads.

    The payloads are the CRC of the word, of the word with a space, and its length.
    """
    words = [w for w in set(text.split()) if w != b"\n"]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    automaton.add_word(_TEXT_END, 0)
    for number, word in enumerate(words, 1):
        automaton.add_word(f" {word.decode('latin-1')} ", number)
    automaton.make_automaton()
    numbers = np.fromiter((n for _, n in automaton.iter(text.decode("latin-1"))), np.int64)
    plain = np.array([0, *map(zlib.crc32, words)], np.uint32)
    spaced = np.array([0, *(zlib.crc32(b" ", zlib.crc32(w)) for w in words)], np.uint32)
    return numbers, plain, spaced, np.array([0, *map(len, words)], np.int64)


def features(column: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, rows, bucket and row of each feature, words of each row."""
    for first, data, offsets in slices(column, _SLICE):
        rows = len(offsets) - 1
        # each text between spaces, and an end after it
        spread = np.full(len(data) + 3 * rows, 0x20, np.uint8)
        spread[np.arange(len(data)) + np.repeat(3 * np.arange(rows) + 1, np.diff(offsets))] = _LETTERS[data]
        spread[offsets[1:] + 3 * np.arange(rows) + 2] = ord(_TEXT_END)
        numbers, plain, spaced, lengths = _word_numbers(spread.tobytes())
        ends = numbers == 0
        row = np.cumsum(ends) - ends
        here = ~ends
        pairs = np.flatnonzero(here[:-1] & here[1:])
        left, right = numbers[pairs], numbers[pairs + 1]
        single = plain[numbers[here]]
        double = compose(spaced[left], lengths[right], plain[right])
        crc = np.concatenate([single, double]).astype(np.int64) % buckets
        yield first, rows, crc, np.concatenate([row[here], row[pairs]]), np.bincount(row[here], minlength=rows)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket, _, _ in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the counts of raw and target texts."""
    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = f"(cast(t + 1 as double) * cast({sums.s + buckets} as double)) / (cast(s + 1 as double) * cast({sums.t + buckets} as double))"
    return both.selectExpr("bucket", f"cast(floor(1000 * ln({ratio})) as bigint) as gain")


def weights(docs: DataFrame, gain: list[int], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_features, n_words, weight) of each row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for batch in batches:
            count, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, rows, bucket, row, n_words in features(batch.column(1), buckets):
                part = slice(first, first + rows)
                count[part] = np.bincount(row, minlength=rows)
                words[part] = n_words
                # exact: sums of whole numbers far below 2^53
                total[part] = np.bincount(row, table[bucket], minlength=rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (count, words, total // np.maximum(count, 1)))],
                names=["doc_id", "n_features", "n_words", "weight"],
            )

    rows = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, n_features bigint, n_words bigint, weight bigint")


def noisy(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight and noise that depends on the seed and the key only."""
    h = f"cast(conv(substr(sha2(concat('{seed}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10) as double)"
    return weighted.withColumn("score", F.expr(f"weight + cast(floor(-1000 * ln(-ln(({h} + 0.5) / 4294967296D))) as bigint)"))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` to the drawn rows: the highest scores of those with enough words.

    Rows are sorted by ranges; a row's place is that in its range and the rows of all ranges
    before it.  Only the counts of the ranges are brought together.
    """
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    late = F.col("n_words") < least_words
    # the last two keys part rows that tie in score and key, of which any order will do
    keys = ["_late", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    placed = Scratch(spark).keep(
        scored.withColumn("_late", late).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    )
    # one row per range: an unpartitioned window over as many rows as there were partitions
    counted = placed.groupBy("_range").agg(F.count("*").alias("n"), F.count(F.when(~F.col("_late"), 1)).alias("fit"))
    sums = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = counted.select("_range", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("_before"), F.sum("fit").over(whole).alias("_fit"))
    rank = F.col("_before") + F.col("_place") + 1
    return placed.join(F.broadcast(before), "_range").select(
        "doc_id", "n_features", "weight", "score",
        F.when(~F.col("_late") & (rank <= F.expr(f"_fit * {percent} div 100")), rank).cast("bigint").alias("rank"),
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; undrawn ranks are null."""
    scratch = Scratch(docs.sparkSession)
    table = gains(scratch.keep(bucket_counts(docs)), scratch.keep(bucket_counts(target)))
    gain = [row.gain for row in sorted(table.collect())]  # BUCKETS numbers, whatever the input
    return ranked(scratch.keep(noisy(weights(docs, gain), seed)), percent, least_words)
