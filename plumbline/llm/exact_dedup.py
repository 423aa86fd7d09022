"""Exact duplicates: look-ups in a minimal perfect hash over the digests seen before.

Texts are equal when they are identical after deleting white space ``[\\x20\\x09-\\x0D]``;
a null text is an empty one.  Of equal texts the one with the most code points stays,
then the smallest ``doc_id`` (null last).

An *index* has one row per shard of the digest space.  A shard's function maps its n
digests one-to-one onto n slots; a slot holds the full SHA-256 digest and the locator,
length and group size of the text that stays.  A look-up goes to one slot and counts as
a hit only if all 32 bytes agree.  Digests outside the index form groups of their own.

Scale: copies are counted by digest before anything is dealt to shards (with partial
aggregation), so a text that makes up a third of all rows is one row by then.  Digests
are uniform, hence shards are of even size; their number follows from counts.

Empty tables give no rows; repeated rows count as copies, also those that repeat an id with
another text; other columns are ignored.  Of rows alike in id and bare text the longest stays
(``decide`` marks them all).  A very long text is hashed where it lies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, join_checked, mix, text_or_empty

SHARD_DIGESTS = 8192
INDEX_SCHEMA = "shard int, pilots binary, digests binary, keep_id array<bigint>, length array<bigint>, group_size array<bigint>"
_TRIES = np.arange(4096, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_sha256, length) of each row."""
    bare = F.translate(text_or_empty(text), " \t\n\x0b\x0c\r", "")
    return docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.sha2(bare.cast("binary"), 256).alias("text_sha256"),
        F.length(text_or_empty(text)).cast("bigint").alias("length"),
    )


def groups(digest_rows: DataFrame) -> DataFrame:
    """One row per distinct digest: the row that stays, its length, the number of rows."""
    rank = F.struct("length", F.col("doc_id").isNotNull(), (-F.col("doc_id")).alias("low"))
    return digest_rows.groupBy("text_sha256").agg(
        F.max(rank).alias("best"), F.count("*").alias("group_size")
    ).select("text_sha256", (-F.col("best.low")).alias("keep_id"), F.col("best.length").alias("length"), "group_size")


def shard_of(shards: int):
    return F.pmod(F.conv(F.substring("text_sha256", 50, 15), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def _words(hexes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(hexes)), np.uint8).reshape(-1, 32)
    return raw, raw.view(">u8").astype(np.uint64)


def _slot(words: np.ndarray, pilots: np.ndarray, count: int) -> np.ndarray:
    bucket = (words[:, 0] % np.uint64(len(pilots))).astype(np.int64)
    with np.errstate(over="ignore"):
        return (mix(words[:, 1] + pilots[bucket].astype(np.uint64) * _STEP) % np.uint64(count)).astype(np.int64)


def perfect_pilots(words: np.ndarray) -> np.ndarray:
    """A pilot per bucket (of some 4 digests) such that all digests get different slots."""
    count = len(words)
    pilots = np.zeros(max(1, count // 4), np.uint32)
    bucket = (words[:, 0] % np.uint64(len(pilots))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(len(pilots) + 1))
    free = np.ones(count, bool)
    for b in np.argsort(-np.diff(first), kind="stable"):
        keys = words[order[first[b]:first[b + 1]], 1]
        if not len(keys):
            break
        start = np.uint64(0)
        while True:
            with np.errstate(over="ignore"):
                slots = mix(keys[None, :] + (start + _TRIES)[:, None] * _STEP) % np.uint64(count)
            good = free[slots.astype(np.int64)].all(1)
            for t in np.flatnonzero(good):
                if len(np.unique(slots[t])) == len(keys):
                    break
            else:
                start += np.uint64(len(_TRIES))
                continue
            pilots[b] = start + _TRIES[t]
            free[slots[t].astype(np.int64)] = False
            break
    return pilots


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    raw, words = _words(rows["text_sha256"])
    pilots = perfect_pilots(words)
    at = np.empty(len(rows), np.int64)
    at[_slot(words, pilots, len(rows))] = np.arange(len(rows))
    rows = rows.iloc[at]
    whole = lambda name: [None if pd.isna(x) else int(x) for x in rows[name]]
    return pd.DataFrame({
        "shard": [int(rows["shard"].iloc[0])], "pilots": [pilots.tobytes()], "digests": [raw[at].tobytes()],
        "keep_id": [whole("keep_id")], "length": [whole("length")], "group_size": [whole("group_size")],
    })


def build_index(known: DataFrame, shards: int) -> DataFrame:
    """The index over the distinct digests of ``groups()``."""
    return known.withColumn("shard", shard_of(shards)).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def _better(a: tuple, b: tuple) -> tuple:
    """(keep_id, length): the longer text, then the smaller id, null last."""
    rank = lambda x: (-x[1], x[0] is None, x[0] or 0)
    return min(a, b, key=rank)


def _resolve(key: tuple, index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard after ``new`` arrived: all slots, then the digests outside."""
    hexes, keep, length, size, seen = [], [], [], [], []
    if len(index):
        shard = index.iloc[0]
        stored = np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)
        pilots = np.frombuffer(shard["pilots"], np.uint32)
        joined = shard["digests"].hex()
        hexes = [joined[i:i + 64] for i in range(0, len(joined), 64)]
        keep, length, size = ([None if x is None or x != x else int(x) for x in shard[c]] for c in ("keep_id", "length", "group_size"))
        seen = [True] * len(hexes)
    if len(new):
        raw, words = _words(new["text_sha256"])
        slot = _slot(words, pilots, len(stored)) if len(index) else np.zeros(len(new), np.int64)
        hit = (stored[slot] == raw).all(1) if len(index) else np.zeros(len(new), bool)
        fields = zip(new["text_sha256"], new["keep_id"], new["length"], new["group_size"], slot, hit, strict=True)
        for digest, doc, chars, copies, at, member in fields:
            doc = None if pd.isna(doc) else int(doc)
            if member:
                keep[at], length[at] = _better((keep[at], length[at]), (doc, int(chars)))
                size[at] += int(copies)
            else:
                hexes.append(digest)
                keep.append(doc)
                length.append(int(chars))
                size.append(int(copies))
                seen.append(False)
    return pd.DataFrame({"text_sha256": hexes, "keep_id": pd.array(keep, "Int64"), "length": length, "group_size": size, "seen_before": seen})


def resolve(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """Look the arrivals' digests up; all groups with their sizes and winners."""
    new = arrivals.withColumn("shard", shard_of(shards))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(
        _resolve, "text_sha256 string, keep_id bigint, length bigint, group_size bigint, seen_before boolean"
    )


def decide(docs: DataFrame) -> DataFrame:
    """Every row with the row of its group that stays.

    The lower half of the id range is the history, for which an index is built; the rest
    arrives later and is looked up.  The result is the same for any such division.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(digests(docs))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(0 if low is None else low + (high - low) // 2), F.lit(False))
    history, arrivals = scratch.keep(groups(rows.filter(old))), scratch.keep(groups(rows.filter(~old)))
    shards = max(1, math.ceil(max(history.count(), arrivals.count()) / SHARD_DIGESTS))
    index = scratch.keep(build_index(history, shards))
    found = resolve(index, arrivals, shards).select("text_sha256", "keep_id", "group_size")
    return rows.join(found, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns: one of each group of equal texts.

    Rows are told apart by id and digest, so rows that repeat an id with different texts do not
    stand for each other, and rows without an id are copies like any.  The text is not sorted:
    what goes is joined, and rows alike in id and digest are thinned to the longest text only
    where there are such rows.
    """
    scratch = Scratch(docs.sparkSession)
    same = F.struct("doc_id", "text_sha256").alias("__same")
    marked = scratch.keep(decide(docs).select("kept", same))
    dropped = scratch.keep(marked.filter(~F.col("kept")).select("__same").distinct())
    again = scratch.keep(marked.filter("kept").groupBy("__same").count().filter("count > 1").select("__same"))
    bare = F.translate(text_or_empty(), " \t\n\x0b\x0c\r", "").cast("binary")
    own = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(bare, 256).alias("text_sha256"))
    rows = join_checked(docs.withColumn("__same", own), dropped, "__same", "left_anti", dropped.count())
    repeats = again.count()
    if repeats:
        once = join_checked(rows, again, "__same", "left_anti", repeats)
        several = join_checked(rows, again, "__same", "left_semi", repeats)
        whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns))
        longest = several.groupBy("__same").agg(F.max_by(whole, F.length(text_or_empty())).alias("__row"))
        rows = once.select(docs.columns).unionByName(longest.select("__row.*").select(docs.columns))
    return rows.select(docs.columns)
