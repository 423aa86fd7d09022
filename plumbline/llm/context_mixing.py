"""Language-model scores by online logistic context mixing.

Texts are lower-cased (A-Z) token sequences: words, then one end.  A token is coded by up to
three bits: does it follow the two tokens before it somewhere in the training texts (crc32 of
doc_id modulo 10 not 0), else does it follow the one before it, else does it occur at all.  A
bit that says yes leaves the token to the frequencies of that context; after three times no
its bytes are coded one by one, each after the one before it.

Predictors.  Each hashed context tells how often it was seen (n) and how many different tokens
followed (t); both give the log-odds that the next token is among them.  Counts are exact and
come from all training documents.  For a training document the token at hand is taken out of
its own counts, and its spelt bytes out of theirs; else the mixer would learn to trust what it has
merely memorised.

Mixer.  The log-odds of the contexts are added with the weights of a gate (which bit, how much
its context has seen) and refined by an adaptive map of all levels.  Documents meet the mixer in
16 slices (by hash of id and text); the weights take one damped step per slice, online, and the
map is fitted last.  What a slice teaches is a histogram of levels of bounded size, so weights
are learnt once, from all training documents, whatever the partitioning; then every document is
scored with them.  The sum of the log-probabilities is the score; bits per byte divide it by the
text's UTF-8 bytes (by 1 if there are none).

Base.  ``base_score`` is the unigram score with all token counts of the training documents.

Scale.  Contexts and counts grow with the corpus and are never gathered in one place.  Texts are
dealt to blocks of about 4 MB by hash of id and text; a block sends its different (context,
token) pairs with counts to shards of the hash space and gets totals back.  Shard and
block numbers follow the counted bytes, so groups keep their size as the corpus grows; a pair of
any frequency is one entry per block.  A context is known by 28 bits within its shard, a token
there by 22: some contexts in a thousand share their counts with another, at any size.
Rows equal in id and text share a block; only a single text can make a block larger.

Null texts are empty (one end token); rows without a doc_id count as held out; repeated rows
are scored each; very long texts are scored whole by one task; empty tables give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import _FOLDED, Scratch, mix, prefix_hashes, slices, span_hashes, text_or_empty, word_spans

#: Bytes of text in a block, and of text whose names meet in a shard, on average.
BLOCK_BYTES, SHARD_BYTES = 1 << 22, 1 << 23
END, GAP = 0x0A, 0x20
END_HASH = np.uint64(0xE17A1465D0C3AB29)
#: Slices in which the mixer meets the documents.
SLICES = 16
CONTEXT_BITS, TOKEN_BITS = 28, 22
#: Levels of how often a context was seen, and of followers per sight, with their middles.
SEEN, SEEN_MIDDLE = (1, 2, 3, 5, 9, 33), np.array([0, 1, 2, 3.5, 6.5, 18, 80])
FRESH, FRESH_MIDDLE = (0.2, 0.5, 0.7, 0.999), np.array([0.1, 0.35, 0.6, 0.85, 1.0])
STATES = len(SEEN_MIDDLE) * len(FRESH_MIDDLE)
#: Cells: (bit, state of the longer context, state of the shorter one, outcome), then pairs of bytes.
CELLS = 3 * STATES * STATES
PAIRS = 2 * CELLS
SYMBOLS = PAIRS + (1 << 16)
#: Sights of a pair of bytes before the first one.
UNSEEN = 0.05
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_G1, _G2, _G3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"), (remainder != 0).alias("train"))


# ---------------------------------------------------------------- tokens and contexts

class Tokens:
    """Different tokens of a slice (the end is one), and the sequence of all tokens."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _FOLD[data]
        starts, ends, rows = word_spans(data, offsets)
        hashes = span_hashes(prefix_hashes(data, _FOLDED), starts, ends)
        docs = len(offsets) - 1
        words = np.bincount(rows, minlength=docs)
        self.count = words + 1
        last = np.cumsum(self.count) - 1
        every = np.empty(len(starts) + docs, np.uint64)
        is_end = np.zeros(len(every), bool)
        is_end[last] = True
        every[is_end], every[~is_end] = END_HASH, hashes
        self.every, self.row = every, np.repeat(np.arange(docs), self.count)
        self.start, self.end = np.full(len(every), -1), np.full(len(every), -1)
        self.start[~is_end], self.end[~is_end] = starts, ends
        self.data = data
        nth = np.arange(len(every)) - np.repeat(last - words, self.count)
        one, two = np.full(len(every), END_HASH), np.full(len(every), END_HASH)
        one[1:], two[2:] = every[:-1], every[:-2]
        one[nth == 0] = END_HASH
        two[nth <= 1] = END_HASH
        with np.errstate(over="ignore"):
            short = mix(one * _G2 + _G1)
            self.contexts = mix(short + mix(two + _G3)), short

    def spelt(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, pair) of the bytes of some tokens; a word's last byte is a gap, the end's only one a mark."""
        size = np.where(self.start[which] < 0, 1, self.end[which] - self.start[which] + 1)
        first = np.cumsum(size) - size
        out = np.full(int(size.sum()), GAP, np.int64)
        place = np.arange(len(out)) - np.repeat(first, size)
        inner = place < np.repeat(size - 1, size)
        out[inner] = self.data[(np.repeat(self.start[which], size) + place)[inner]]
        out[first[self.start[which] < 0]] = END
        before = np.r_[np.int64(GAP), out[:-1]]
        before[first] = GAP
        return np.repeat(self.row[which], size), before << 8 | out


def _pairs(t: Tokens, order: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and name of each (context, token)."""
    context = t.contexts[order]
    name = context >> np.uint64(64 - CONTEXT_BITS) << np.uint64(TOKEN_BITS) | t.every >> np.uint64(64 - TOKEN_BITS)
    return (context & np.uint64(0xFFFFFFFF)) % np.uint64(shards), name


def _distinct(shard: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the different (shard, name): shards, names and each entry's number."""
    order = np.lexsort((name, shard))
    s, v = shard[order], name[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    return s[new], v[new], number


class Block:
    """All tokens of a block with the different names that it asks shards for."""

    def __init__(self, table: pa.Table, shards: int):
        self.train = table.column("train").combine_chunks().to_numpy(zero_copy_only=False)
        self.slices = [(first, len(o) - 1, Tokens(data, o)) for first, data, o in slices(table.column("text").combine_chunks(), 1 << 22)]
        learnt = [self.train[first:first + size][t.row] for first, size, t in self.slices]
        self.learnt = np.concatenate([np.zeros(0, bool), *learnt])
        self.asked = []
        every = np.concatenate([np.zeros(0, np.uint64), *[t.every for *_, t in self.slices]])
        self.asked.append(_distinct(every % np.uint64(shards), every))
        for order in (0, 1):
            shard, name = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in zip(*[_pairs(t, order, shards) for *_, t in self.slices], strict=True))
            self.asked.append(_distinct(shard, name))


def _planes(x: np.ndarray, kind: type) -> bytes:
    """Compressed: bytes of equal weight side by side, as high ones are mostly zero."""
    x = np.ascontiguousarray(x, kind)
    flat = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(flat).to_bytes(8, "little") + pa.compress(flat, "zstd", asbytes=True)


def _joined(data: bytes, kind: type) -> np.ndarray:
    flat = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _flat(x: np.ndarray) -> bytes:
    """Four-byte numbers in planes; the file's own codec does the rest."""
    return x.view(np.uint8).reshape(-1, 4).T.tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


PACKED = "block bigint, rows binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, compressed: texts travel once, and in less room than Spark's codec takes."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0, True]) if len(order) else []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            some = batch.take(pa.array(order[lo:hi]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
                out.write_batch(some)
            yield pa.RecordBatch.from_arrays([some.column("block").slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])


def _unpack(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("rows").to_pylist()])


ASKED = "shard bigint, block bigint, what int, names binary, counts binary"
ANSWERED = "block bigint, shard bigint, what int, own binary, seen binary, fresh binary, kinds bigint, tokens bigint"


def _ask(table: pa.Table, shards: int) -> pa.Table:
    block, rows = Block(_unpack(table), shards), []
    number = table.column("block")[0].as_py()
    for what, (shard, name, which) in enumerate(block.asked):
        counts = np.bincount(which[block.learnt], minlength=len(name))
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            rows.append((int(shard[lo]), number, what, _planes(np.diff(name[lo:hi], prepend=np.uint64(0)), np.uint64), _planes(counts[lo:hi], np.uint32)))
    shard, number, what, names, counts = zip(*rows, strict=True)
    return pa.table({
        "shard": pa.array(shard, pa.int64()), "block": pa.array(number, pa.int64()), "what": pa.array(what, pa.int32()),
        "names": pa.array(names, pa.binary()), "counts": pa.array(counts, pa.binary()),
    })


def _first_of_context(names: np.ndarray) -> np.ndarray:
    context = names >> np.uint64(TOKEN_BITS)
    return np.r_[True, context[1:] != context[:-1]]


def _answer(table: pa.Table) -> pa.Table:
    """For each asking block the totals of its names: of the pair, of its context, and different tokens after it."""
    kinds_of = table.column("what").to_numpy()
    rows = []
    for what in np.unique(kinds_of).tolist():
        part = table.filter(pa.array(kinds_of == what))
        with np.errstate(over="ignore"):
            names = [np.cumsum(_joined(x, np.uint64), dtype=np.uint64) for x in part.column("names").to_pylist()]
        counts = np.concatenate([_joined(x, np.uint32) for x in part.column("counts").to_pylist()])
        value, which = np.unique(np.concatenate(names), return_inverse=True)
        own = np.bincount(which, counts, len(value)).astype(np.uint64)
        if what:
            context = value >> np.uint64(TOKEN_BITS)
            number = np.cumsum(np.r_[False, context[1:] != context[:-1]])
            seen = np.bincount(number, own).astype(np.uint64)[number]
            fresh = np.bincount(number, own > 0).astype(np.uint64)[number]
        ends = np.cumsum([len(x) for x in names]).tolist()
        for block, shard, x, end in zip(part.column("block").to_pylist(), part.column("shard").to_pylist(), names, ends, strict=True):
            at = which[end - len(x):end]
            once = at[_first_of_context(x)] if what else at
            more = (_planes(seen[once], np.uint64), _planes(fresh[once], np.uint64)) if what else (b"", b"")
            rows.append((block, shard, what, _planes(own[at], np.uint64), *more, 0, 0))
        if not what:
            rows.append((None, None, 0, b"", b"", b"", int((own > 0).sum()), int(own.sum())))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = ("block", "shard", "what", "own", "seen", "fresh", "kinds", "tokens")
    return pa.table({n: pa.array(x, t) for n, t, x in zip(names, types, zip(*rows, strict=True), strict=True)})


# ---------------------------------------------------------------- bits and their cells

def _state(seen: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    level = np.searchsorted(SEEN, seen, "right")
    return level * len(FRESH_MIDDLE) + np.searchsorted(FRESH, fresh / np.maximum(seen, 1), "right")


CODED = (
    "doc_id bigint, train boolean, slice int, n_bytes bigint, n_tokens bigint, n_known bigint, base double, within double, plain bigint,"
    " cells binary, times binary, kinds bigint, tokens bigint"
)


def _code(left: pa.Table, right: pa.Table, shards: int) -> pa.Table:
    """What scoring needs of each document: sums that depend on counts alone, and a histogram of its cells."""
    if not len(left):  # the answers' totals
        none = {n: pa.nulls(len(right), t) for n, t in (
            ("doc_id", pa.int64()), ("train", pa.bool_()), ("slice", pa.int32()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("base", pa.float64()), ("within", pa.float64()), ("plain", pa.int64()), ("cells", pa.binary()), ("times", pa.binary()))}
        return pa.table({**none, "kinds": right.column("kinds"), "tokens": right.column("tokens")})
    left = _unpack(left)
    block = Block(left, shards)
    right = right.sort_by([("what", "ascending"), ("shard", "ascending")])
    what = right.column("what").to_numpy()
    given = []
    for k, (shard, name, which) in enumerate(block.asked):
        part = right.filter(pa.array(what == k))
        columns = ("own", "seen", "fresh") if k else ("own",)
        got = [np.concatenate([np.zeros(0, np.uint64), *[_joined(x, np.uint64) for x in part.column(c).to_pylist()]]).astype(np.int64) for c in columns]
        if k:  # a context's totals come once
            new = _first_of_context(name) | np.r_[True, shard[1:] != shard[:-1]]
            number = np.cumsum(new) - 1
            if any(len(x) != number[-1] + 1 for x in got[1:]):
                raise RuntimeError("shards answered other contexts than those asked for")
            got[1:] = [x[number] for x in got[1:]]
        if any(len(x) != len(name) for x in got):
            raise RuntimeError("shards answered other names than those asked for")
        given.append([x[which] for x in got])
    (total,), (own2, seen2, fresh2), (own1, seen1, fresh1) = given
    base, known = np.log10(total + 0.1), total > 0
    # a training document does not learn from itself
    taught = block.learnt
    fresh2, fresh1 = fresh2 - (taught & (own2 == 1)), fresh1 - (taught & (own1 == 1))
    own2, seen2, own1, seen1, total = (x - taught for x in (own2, seen2, own1, seen1, total))
    states = _state(seen2, fresh2) * STATES + _state(seen1, fresh1)
    asks2 = seen2 > 0
    hit2 = own2 > 0
    asks1 = ~hit2 & (seen1 > 0)
    hit1 = asks1 & (own1 > 0)
    asks0 = ~hit2 & ~hit1
    hit0 = asks0 & (total > 0)
    within = np.zeros(len(total))
    within[hit2] = np.log10(own2[hit2] / seen2[hit2])
    within[hit1] = np.log10(own1[hit1] / seen1[hit1])
    within[hit0] = np.log10(total[hit0])
    out: list[tuple[np.ndarray, ...]] = []
    cells, times = [], []
    at = 0
    for _, size, t in block.slices:
        here = slice(at, at + len(t.every))
        at += len(t.every)
        rows, symbols = [], []
        for bit, (asks, hit) in enumerate(((asks2, hit2), (asks1, hit1), (asks0, hit0))):
            some = asks[here]
            rows.append(t.row[some])
            symbols.append(((bit * STATES * STATES + states[here][some]) << 1) | hit[here][some])
        row, pair = t.spelt(np.flatnonzero((asks0 & ~hit0)[here]))
        rows.append(row)
        symbols.append(PAIRS + pair)
        value, n = np.unique(np.concatenate(rows) * SYMBOLS + np.concatenate(symbols), return_counts=True)
        ends = np.searchsorted(value, np.arange(size + 1) * SYMBOLS)
        symbol, n = (value % SYMBOLS).astype(np.uint32), n.astype(np.uint32)
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            cells.append(_flat(symbol[lo:hi]))
            times.append(_flat(n[lo:hi]))
        out.append((
            t.count, np.bincount(t.row, known[here], size), np.bincount(t.row, base[here], size),
            np.bincount(t.row, within[here], size), np.bincount(t.row, hit0[here], size),
        ))
    count, known_n, base_sum, within_sum, plain = (np.concatenate(x) for x in zip(*out, strict=True))
    whole = lambda x: pa.array(x.astype(np.int64))
    nought = pa.array(np.zeros(len(left), np.int64))
    return pa.table({
        "doc_id": left.column("doc_id"), "train": left.column("train"), "slice": left.column("slice"), "n_bytes": left.column("n_bytes"),
        "n_tokens": whole(count), "n_known": whole(known_n), "base": pa.array(base_sum), "within": pa.array(within_sum), "plain": whole(plain),
        "cells": pa.array(cells, pa.binary()), "times": pa.array(times, pa.binary()), "kinds": nought, "tokens": nought,
    })


# ---------------------------------------------------------------- the mixer

def _lessons(coded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Histograms of the training documents: of bits by slice, of pairs of bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pairs = np.zeros((SLICES, PAIRS), np.int64), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for k, cells, times in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                symbol, n = _wide(cells), _wide(times)
                cut = int(np.searchsorted(symbol, PAIRS))
                bits[k, symbol[:cut]] += n[:cut]
                pairs[symbol[cut:] - PAIRS] += n[cut:]
        for k, counts in enumerate((*bits, pairs)):
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["k", "cell", "n"])

    got = coded.filter("train").select("slice", "cells", "times").mapInArrow(run, "k int, cell int, n bigint").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    bits, pairs = np.zeros((SLICES, PAIRS)), np.zeros(1 << 16)
    k, cell, n = (got.column(c).to_numpy() for c in ("k", "cell", "n"))
    bits[k[k < SLICES], cell[k < SLICES]] = n[k < SLICES]
    pairs[cell[k == SLICES]] = n[k == SLICES]
    return bits.reshape(SLICES, CELLS, 2), pairs


class Mixer:
    """Gated weights of the contexts' log-odds and the adaptive map over cells."""

    def __init__(self) -> None:
        cell = np.arange(CELLS)
        bit, longer, shorter = cell // STATES**2, cell // STATES % STATES, cell % STATES
        seen = [s // len(FRESH_MIDDLE) for s in (longer, shorter)]
        odds = []
        for s, n in zip((longer, shorter), seen, strict=True):
            n_middle = SEEN_MIDDLE[n]
            escape = (FRESH_MIDDLE[s % len(FRESH_MIDDLE)] * n_middle + 0.5) / (n_middle + 1)
            odds.append(np.where(n > 0, np.log((1 - escape).clip(0.02) / escape.clip(0.02)), 0.0))
        self.x = np.stack([*odds, np.ones(CELLS)])
        self.gate = bit * len(SEEN_MIDDLE) + np.where(bit == 0, seen[0], seen[1])
        self.weights = np.tile([0.5, 0.5, 0.0], (3 * len(SEEN_MIDDLE), 1))
        self.map = np.zeros(CELLS)

    def odds(self) -> np.ndarray:
        return np.clip((self.weights[self.gate].T * self.x).sum(0) + self.map, -20, 20)

    def learn(self, counts: np.ndarray) -> None:
        """One damped Newton step of each gate from the bits of a slice."""
        n, ones = counts.sum(1), counts[:, 1]
        p = 1 / (1 + np.exp(-self.odds()))
        wrong, open_ = ones - n * p, n * p * (1 - p)
        for g in np.unique(self.gate[n > 0]).tolist():
            own = self.gate == g
            x = self.x[:, own]
            self.weights[g] += 0.5 * np.linalg.solve((x * open_[own]) @ x.T + np.eye(len(x)) * 5, x @ wrong[own])
        self.weights = np.clip(self.weights, -8, 8)

    def refine(self, counts: np.ndarray) -> None:
        """The map's own correction of each cell; cells that saw little stay near the mixture."""
        n, ones = counts.sum(1), counts[:, 1]
        for _ in range(8):
            p = 1 / (1 + np.exp(-self.odds()))
            self.map = np.clip(self.map + (ones - n * p - self.map) / (n * p * (1 - p) + 1), -8, 8)


def _log_table(bits: np.ndarray) -> np.ndarray:
    """log10 probability of every outcome of a cell."""
    mixer = Mixer()
    for counts in bits:
        mixer.learn(counts)
    mixer.refine(bits.sum(0))
    odds = mixer.odds()
    return np.stack([-np.logaddexp(0, odds), -np.logaddexp(0, -odds)], 1).ravel() / np.log(10)


def _spelling(pairs: np.ndarray, pair: np.ndarray, times: np.ndarray, own: bool) -> float:
    """log10 probability of a document's spelt bytes; its ``own`` are taken out of the counts."""
    before = pair >> 8
    here, all_ = pairs[pair], pairs.reshape(256, 256).sum(1)[before]
    if own:
        here, all_ = here - times, all_ - np.bincount(before, times, 256)[before]
    return float(times @ np.log10((here + UNSEEN) / (all_ + 256 * UNSEEN)))


# ---------------------------------------------------------------- scores

def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)."""
    scratch = Scratch(docs.sparkSession)
    rows = _rows(docs, text, key).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    size = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = -(-size // SHARD_BYTES) or 1
    dealt = F.xxhash64("doc_id", "text")
    number = F.pmod(F.xxhash64(dealt), F.lit(-(-size // BLOCK_BYTES) or 1))
    rows = rows.withColumn("slice", F.pmod(dealt, F.lit(SLICES)).cast("int")).withColumn("block", number)
    # both uses of the texts are one exchange
    blocks = rows.mapInArrow(_pack, PACKED)
    asked = blocks.groupBy("block").applyInArrow(lambda t: _ask(t, shards), ASKED)
    answers = asked.groupBy("shard").applyInArrow(_answer, ANSWERED)
    coded = scratch.keep(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _code(a, b, shards), CODED))
    kinds, tokens = coded.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    floor = float(np.log10(tokens + 0.1 * (kinds + 1)))
    given = coded.filter("n_tokens is not null")
    bits, pairs = _lessons(given)
    logs = _log_table(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False)
            mixed = []
            for own, cells, times in zip(train.tolist(), batch.column("cells").to_pylist(), batch.column("times").to_pylist(), strict=True):
                symbol, n = _wide(cells), _wide(times)
                cut = int(np.searchsorted(symbol, PAIRS))
                spelt = _spelling(pairs, symbol[cut:] - PAIRS, n[cut:], own) if cut < len(symbol) else 0.0
                mixed.append(float(logs[symbol[:cut]] @ n[:cut]) + spelt)
            n, known, plain, size = (batch.column(c).to_numpy() for c in ("n_tokens", "n_known", "plain", "n_bytes"))
            scores = np.array(mixed) + batch.column("within").to_numpy() - plain * np.log10(np.maximum(tokens - train, 1))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": pa.array(~train), "n_tokens": pa.array(n), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(n), tokens, np.int64)), "base_score": pa.array(batch.column("base").to_numpy() - n * floor),
                "score": pa.array(scores), "bits_per_byte": pa.array(-scores * np.log2(10) / np.maximum(size, 1)),
            })

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return given.mapInArrow(run, schema)
