"""Removal of long repeated substrings over all documents, by suffix sorting of shards.

Every byte covered by a ``length``-byte string that also starts anywhere else (in any
document, overlaps included) is removed.  Matches do not cross documents.

A suffix array of everything would compare mostly text that never repeats, so work is cut
down and dealt out first, without losing a repeat:

1. Anchors.  Of the 64-byte strings inside each window of ``length`` bytes the one with
   the least hash is the window's anchor.  Equal windows have equal anchors at the same
   offset, so windows are grouped by anchor; consecutive windows with one anchor are a
   *region*.  Only (anchor, digest of the region, place) leaves the scan.
2. Regions that occur twice are covered as a whole.  Anchors with one digest are done.
3. Of the others one region per digest goes, with its text, to the anchor's shard.  A
   shard's texts are suffix-sorted by induced sorting (``suffix_array``), and neighbours
   with a common prefix of ``length`` or more are repeats.
4. Anchors with more than SHARD_REGIONS different regions are divided first: by halves of
   the offset range and by what the windows of a half have in common, until the parts are
   small; a part of one window has one text.  So no group is gathered in one task whole.

Texts meet their regions and spans by shuffles, at every size.  Digests have 128 bits.  The external memory of the method is Spark's: sorted runs and
merges are its shuffles, which spill to disk, in place of priority queues on disk.

Null texts are empty; texts shorter than ``length`` keep all bytes; a repeated row is a
second occurrence of its whole text; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import _EXACT, Scratch, byte_codes, mix, prefix_hashes, slices, span_hashes, text_or_empty
from plumbline.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 400, 64
SHARD_REGIONS = 2048
SHARD_BYTES = 1 << 20
_SECOND = byte_codes(13, False)
_LEVELS = 9  # halvings of 512 offsets
_REGION = "grp bigint, d1 bigint, d2 bigint, low int, high int, base int"


def _sliding(values: np.ndarray, width: int, function: np.ufunc, fill: int) -> np.ndarray:
    """``function`` over each run of ``width`` values: block-wise forward and backward scans."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, fill, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = function.accumulate(blocks, axis=1).reshape(-1)
    back = function.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return function(back[:count], ahead[width - 1:width - 1 + count])


def regions(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of a text; its windows in order."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    prefix = prefix_hashes(data, _EXACT)
    starts = np.arange(len(data) - gram + 1)
    hashes = span_hashes(prefix, starts, starts + gram)
    width = length - gram + 1
    least = _sliding(hashes, width, np.minimum, np.iinfo(np.uint64).max)
    # the leftmost place in each window with the least hash
    is_least = np.flatnonzero(hashes == _sliding_max_over(least, len(hashes), width))
    window = np.arange(len(least))
    at = np.searchsorted(is_least, window)
    place = is_least[np.minimum(at, len(is_least) - 1)]
    wrong = np.flatnonzero(hashes[place] != least)
    while len(wrong):
        at[wrong] += 1
        place[wrong] = is_least[at[wrong]]
        wrong = wrong[hashes[place[wrong]] != least[wrong]]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(place)] - 1
    return hashes[place[new]], place[new], new, last


def _sliding_max_over(least: np.ndarray, count: int, width: int) -> np.ndarray:
    """For each place the greatest of the minima of the windows that hold it."""
    padded = np.zeros(count + width - 1, least.dtype)
    padded[width - 1:width - 1 + len(least)] = least
    return _sliding(padded, width, np.maximum, 0)[:count]


def _digest(prefixes: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [span_hashes(p, starts, ends) for p in prefixes]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, two keys that are equal for equal rows only, and the text."""
    known = text_or_empty(text)
    return docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 62))).alias("k1"),
        F.xxhash64(known).alias("k2"), known.alias("text"),
    )


def occurrences(rows: DataFrame, length: int) -> DataFrame:
    """All regions: group (anchor), digest, offsets of the first and last window, anchor's place.

    A window's offset is the anchor's place less its start: 0 to length - 64.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
            for first, data, offsets in slices(batch.column(2)):
                prefixes = prefix_hashes(data, _EXACT), prefix_hashes(data, _SECOND)
                parts = []
                for r in range(len(offsets) - 1):
                    anchor, place, low, high = regions(data[offsets[r]:offsets[r + 1]], length)
                    if len(anchor):
                        digest = _digest(prefixes, low + offsets[r], high + length + offsets[r])
                        parts.append((np.full(len(anchor), first + r), anchor, *digest, place - high, place - low, place))
                if parts:
                    # the digest names text and offsets
                    row, anchor, d1, d2, low, high, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[row]), pa.array(k2[row]), _signed(anchor), _signed(mix(d1 ^ (low.astype(np.uint64) << np.uint64(40)))), _signed(d2),
                         *[pa.array(x.astype(np.int32)) for x in (low, high, place)]],
                        names=["k1", "k2", "grp", "d1", "d2", "low", "high", "base"],
                    )

    return rows.select("k1", "k2", "text").mapInArrow(run, f"k1 bigint, k2 bigint, {_REGION}")


def _texts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The text of each wanted region (k1, k2, grp, d1, d2, low, high, base)."""
    listed = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("grp", "d1", "d2", "low", "high", "base")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(1)
            flat = of.flatten()
            size = np.diff(of.offsets.to_numpy())
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            low, high, base = (flat.field(k).to_numpy() for k in (3, 4, 5))
            cut = [
                texts[r][b - h:b - lo + length]
                for r, b, h, lo in zip(np.repeat(np.arange(len(size)), size).tolist(), base.tolist(), high.tolist(), low.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*[flat.field(k) for k in range(5)], pa.array(cut, pa.binary())], names=["grp", "d1", "d2", "low", "high", "text"]
            )

    joined = rows.select("k1", "k2", "text").join(listed, ["k1", "k2"])
    return joined.select("text", "of").mapInArrow(run, "grp bigint, d1 bigint, d2 bigint, low int, high int, text binary")


def _repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of its windows that another place of the texts repeats."""
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    order = suffix_array(data, length)
    room = np.repeat(ends, sizes) - np.arange(len(data))
    order = order[room[order] >= length]  # a window must end inside its text
    shared = common_prefixes(data, order, length) >= length
    repeated = np.zeros(len(data), bool)
    at = np.flatnonzero(shared)
    repeated[order[at]] = repeated[order[at - 1]] = True
    return [np.flatnonzero(repeated[e - s:e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _spans(sorted_: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_):
        return []
    cut = np.flatnonzero(np.diff(sorted_) > 1)
    return list(zip(sorted_[np.r_[0, cut + 1]].tolist(), sorted_[np.r_[cut, len(sorted_) - 1]].tolist(), strict=True))


_PART = "grp bigint, e1 bigint, e2 bigint, d1 bigint, d2 bigint, low int, high int, text binary"


def _sorted_shards(parts: DataFrame, length: int) -> DataFrame:
    """Suffix-sort whole groups, several per shard; (d1, d2, low, high): runs of repeated offsets."""
    def resolve(held: list[tuple]) -> pa.RecordBatch:
        out = []
        for (_, _, _, d1, d2, _, high, _), starts in zip(held, _repeated_windows([x[7] for x in held], length), strict=True):
            out += [(d1, d2, high - b, high - a) for a, b in _spans(starts)]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["d1", "d2", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield resolve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield resolve(held)

    names = [x.split()[0] for x in _PART.split(", ")]
    dealt = parts.select(*names).repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "d1 bigint, d2 bigint, low int, high int")


def _halved(parts: DataFrame, level: int, length: int) -> DataFrame:
    """Parts cut at offsets that are multiples of 512 / 2^level, regrouped by what their windows share."""
    span = 512 >> level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grp, _, _, d1, d2, low, high, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for at in range(low // span * span, high + 1, span):
                    lo, hi = max(low, at), min(high, at + span - 1)
                    cut = text[high - hi:high - lo + length]
                    # common to all windows of the range, present or not
                    core = text[high - at:high - at - span + 1 + length]
                    mark = hashlib.blake2b(core, digest_size=8, key=f"{grp}/{at}".encode()).digest()
                    same = hashlib.blake2b(cut, digest_size=16, key=f"{lo}".encode()).digest()
                    out.append((int.from_bytes(mark, "big", signed=True), *np.frombuffer(same, np.int64).tolist(), d1, d2, lo, hi, cut))
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary())
            names = [x.split()[0] for x in _PART.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return parts.mapInArrow(run, _PART)


def covered(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, start, end) of text that occurs elsewhere; intervals of a row may overlap."""
    every = scratch.keep(occurrences(rows, length))
    place = F.struct("k1", "k2", "low", "high", "base")
    kinds = every.groupBy("grp", "d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    kinds = kinds.withColumn("many", F.col("n") > 1)
    per = kinds.groupBy("grp").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).filter("kinds > 1 or most > 1")
    kinds = scratch.keep(kinds.join(per, "grp"))
    whole = every.join(kinds.filter("many").select("grp", "d1", "d2"), ["grp", "d1", "d2"], "left_semi")
    found = [whole.select("k1", "k2", (F.col("base") - F.col("high")).alias("start"), (F.col("base") - F.col("low") + length).alias("end"))]
    mixed = scratch.keep(kinds.filter("kinds > 1").select("grp", "d1", "d2", "n", "kinds", "at.*"))
    texts = _texts(rows, mixed.drop("n", "kinds"), length)
    parts = texts.select("grp", F.lit(0).cast("bigint").alias("e1"), F.lit(0).cast("bigint").alias("e2"), "d1", "d2", "low", "high", "text")
    parts = scratch.keep(parts.join(mixed.groupBy("grp").agg(F.max("kinds").alias("kinds")), "grp"))
    runs, level = [], 0
    while True:
        runs.append(scratch.keep(_sorted_shards(parts.filter(F.col("kinds") <= SHARD_REGIONS), length)))
        large = parts.filter(F.col("kinds") > SHARD_REGIONS).drop("kinds")
        if level == _LEVELS or large.isEmpty():
            break
        level += 1
        cut = scratch.keep(_halved(large, level, length))
        kinds_cut = cut.groupBy("grp", "e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2")).alias("at"))
        kinds_cut = scratch.keep(kinds_cut)
        runs.append(cut.join(kinds_cut.filter("n > 1").select("grp", "e1", "e2"), ["grp", "e1", "e2"], "left_semi").select("d1", "d2", "low", "high"))
        sizes = kinds_cut.groupBy("grp").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        firsts = kinds_cut.join(sizes, "grp").select("grp", "e1", "e2", F.col("at.d1").alias("d1"), F.col("at.d2").alias("d2"), "kinds")
        parts = scratch.keep(cut.join(firsts, ["grp", "e1", "e2", "d1", "d2"]).select("grp", "e1", "e2", "d1", "d2", "low", "high", "text", "kinds"))
    spans = runs[0]
    for other in runs[1:]:
        spans = spans.unionByName(other)
    # d1, d2 name a region; those that occur once have one place
    single = mixed.filter("n = 1").select("d1", "d2", "k1", "k2", "base")
    found.append(spans.join(single, ["d1", "d2"]).select(
        "k1", "k2", (F.col("base") - F.col("high")).alias("start"), (F.col("base") - F.col("low") + length).alias("end")
    ))
    return found[0].unionByName(found[1])


def remove(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row."""
    scratch = Scratch(docs.sparkSession)
    rows = _keyed(docs, text, key)
    spans = covered(rows, length, scratch).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = scratch.keep(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            sizes, removed, counts, digests, kept = [], [], [], [], []
            for raw, cover in zip(texts, batch.column(2), strict=True):
                raw = raw.as_py()
                merged: list[list[int]] = []
                for start, end in sorted((x["start"], x["end"]) for x in cover.as_py() or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                rest, at = [], 0
                for start, end in merged:
                    rest.append(raw[at:start])
                    at = end
                rest = b"".join([*rest, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                counts.append(len(merged))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, counts)], pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
