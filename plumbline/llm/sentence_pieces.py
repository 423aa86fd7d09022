"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A slice of texts is cut into pre-tokens (runs of word marks with what follows), each
different one is encoded once.  The symbols of all of them lie in one flat numpy array.  A
round takes, per word, the least rank of its adjacent pairs (a segmented minimum), merges all
leftmost occurrences of that pair at the same time and compacts the arrays, until no pair is
left.  Words are cut further between characters that stand together in no piece, which no
merge can cross.

The library merges one pair at a time.  Merging several of one word at once gives the same
unless a merge makes a pair of a rank as good as the current one; each round checks that
(``_eager``) and such a word then merges its leftmost pair only.  Words of very many symbols
keep their pairs in buckets by rank, so that a round costs what it merges and not the word's
length.

Models with a normaliser that changes texts, unused pieces, marks inside pieces or without
all byte pieces are refused with ``ValueError``; user-defined pieces are not supported.

A null text counts as empty and gives the end id only; so does an empty text.  Very long
texts are a slice of their own: memory grows with the longest text, as it does for the row
itself.  Repeated rows and repeated or null keys are encoded each; empty tables give no
rows; the given columns are read by name, others are ignored.  Rows are independent: there is
no shuffle.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_MARK = MARK.encode()
_NONE = np.int32(2**31 - 1)
_SLICE = 4 << 20
#: Words of more symbols keep their pairs in buckets.
LONG_WORD = 512
_PROBES = ("a", " a", "a  b", "\t", "a\n b", " ", "Ａ", "é", "①", "\x00", "A‍b", "a b ")


@dataclass(frozen=True)
class Pieces:
    """What encoding and decoding need of a model, as arrays of a few MB."""

    size: int
    end: int
    first_byte: int
    chars: np.ndarray        # code points that occur in pieces, sorted
    char_symbols: np.ndarray
    neighbours: np.ndarray   # characters (by their place in chars) that stand together in some piece
    pairs: np.ndarray        # (left symbol, right symbol) that merge, sorted
    merged: np.ndarray       # the symbol they give; one more entry for "no pair"
    ranks: np.ndarray        # its rank, 0 first; _NONE for "no pair"
    surfaces: list[bytes]    # of each id, then of each id at the start of a text
    silent: np.ndarray       # ids that decode to nothing
    sheds: np.ndarray        # ids that lose their mark at the start of a text
    symbols: int


def pieces(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
    bytes_ = [i for i in range(size) if model.is_byte(i)]
    plain = [i for i in range(size) if not special[i] and not model.is_byte(i)]
    if any(model.is_unused(i) for i in range(size)) or any(MARK in names[i].lstrip(MARK) for i in plain):
        raise ValueError("unused pieces or marks inside pieces")
    if [names[i] for i in bytes_] != [f"<0x{b:02X}>" for b in range(256)] or bytes_[-1] - bytes_[0] != 255:
        raise ValueError("byte pieces are missing or out of order")
    if any(model.normalize(x) != MARK + x.replace(" ", MARK) for x in _PROBES):
        raise ValueError("the normaliser changes texts")

    symbol = {names[i]: i for i in plain}
    for c in sorted({c for i in plain for c in names[i]}):
        symbol.setdefault(c, size + len(symbol))
    count = max(symbol.values()) + 1
    scores = np.array([model.get_score(i) for i in plain])
    rank = dict(zip(plain, np.unique(-scores, return_inverse=True)[1].tolist()))
    table = {}
    for i in plain:
        name = names[i]
        for k in range(1, len(name)):
            left, right = symbol.get(name[:k]), symbol.get(name[k:])
            if left is not None and right is not None:
                table[left * count + right] = i
    pairs = np.array(sorted(table), np.int64)
    merged = np.array([table[x] for x in pairs.tolist()] + [-1], np.int32)
    single = sorted(c for c in symbol if len(c) == 1)
    place = {c: k for k, c in enumerate(single)}
    beside = np.array(sorted({(place[a], place[b]) for i in plain for a, b in zip(names[i], names[i][1:])}), np.int32)
    unknown = model.decode([model.unk_id()]).encode()
    surfaces = [
        b"" if model.is_control(i) else unknown if special[i] else bytes([i - bytes_[0]]) if model.is_byte(i)
        else names[i].replace(MARK, " ").encode()
        for i in range(size)
    ]
    sheds = np.array([not special[i] and names[i].startswith(MARK) for i in range(size)])
    return Pieces(
        size, model.eos_id(), bytes_[0],
        np.array([ord(c) for c in single], np.int64), np.array([symbol[c] for c in single], np.int32),
        beside.reshape(-1, 2), pairs, merged,
        np.array([rank[x] for x in merged[:-1].tolist()] + [_NONE], np.int32),
        surfaces + [s[1:] if shed else s for s, shed in zip(surfaces, sheds)],
        np.array([model.is_control(i) for i in range(size)]), sheds, count,
    )


@lru_cache(maxsize=1)
def _tables(p_chars: bytes, p_beside: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code point, and whether two places stand together in some piece."""
    chars, beside = np.frombuffer(p_chars, np.int64), np.frombuffer(p_beside, np.int32).reshape(-1, 2)
    place = np.full(0x110000, len(chars), np.int32)
    place[chars] = np.arange(len(chars))
    together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    together[beside[:, 0], beside[:, 1]] = True
    return place, together


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or the number of keys where it is missing."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, len(sorted_keys)) if len(sorted_keys) else np.zeros(len(keys), np.int64)


def _pair(p: Pieces, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Index in the pair table; unknown characters (negative) pair with nothing."""
    return np.where((left < 0) | (right < 0), len(p.pairs), _find(p.pairs, left.astype(np.int64) * p.symbols + right))


def _leftmost(hits: np.ndarray) -> np.ndarray:
    """Of positions in order, those left after each in turn claims its right neighbour."""
    if not len(hits):
        return hits
    index = np.arange(len(hits))
    begins = np.r_[True, hits[1:] != hits[:-1] + 1]
    return hits[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]


def _merge_words(p: Pieces, symbols: np.ndarray, starts: np.ndarray, origin: np.ndarray):
    """Rounds over all words at once; returns symbols, their words and first characters."""
    last = np.zeros(len(symbols), bool)
    last[np.r_[starts[1:], len(symbols)] - 1] = True
    word = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(symbols)]))
    pair = np.full(len(symbols), len(p.pairs), np.int64)
    inner = np.flatnonzero(~last)
    pair[inner] = _pair(p, symbols[inner], symbols[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, last[:-1]])
        lengths = np.diff(np.r_[starts, len(symbols)])
        rank = p.ranks[pair]
        least = np.minimum.reduceat(rank, starts)
        ended = np.repeat(least == _NONE, lengths)
        if ended.any():
            done.append((symbols[ended], word[ended], origin[ended]))
            stay = ~ended
            symbols, word, origin, last, pair, rank = (x[stay] for x in (symbols, word, origin, last, pair, rank))
            lengths, least = lengths[least != _NONE], least[least != _NONE]
            if not len(symbols):
                break
        hits = _leftmost(np.flatnonzero(rank == np.repeat(least, lengths)))
        hits = hits[~_eager(p, symbols, word, last, pair, hits)]
        symbols[hits] = p.merged[pair[hits]]
        last[hits] = last[hits + 1]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        moved = (np.cumsum(keep) - 1)[hits]
        symbols, word, origin, last, pair = (x[keep] for x in (symbols, word, origin, last, pair))
        before = moved - 1
        touched = np.zeros(len(symbols), bool)
        touched[moved] = True
        touched[before[(before >= 0) & (word[before] == word[moved])]] = True
        pair[touched & last] = len(p.pairs)
        changed = np.flatnonzero(touched & ~last)
        pair[changed] = _pair(p, symbols[changed], symbols[changed + 1])
    if not done:
        return symbols, word, origin
    symbols, word, origin = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order], origin[order]


def _eager(p: Pieces, symbols, word, last, pair, hits: np.ndarray) -> np.ndarray:
    """Which merges must wait: words with several, where one makes a pair of no worse rank."""
    out = np.zeros(len(hits), bool)
    if not len(hits):
        return out
    owner = word[hits]
    first = np.r_[True, owner[1:] != owner[:-1]]
    several = ~(first & np.r_[first[1:], True])
    at = np.flatnonzero(several)
    if not len(at):
        return out
    h = hits[at]
    result, rank = p.merged[pair[h]], p.ranks[pair[h]]
    left = symbols[np.maximum(h - 1, 0)].copy()
    chained = (at > 0) & (hits[at - 1] == h - 2)
    left[chained] = p.merged[pair[hits[at[chained] - 1]]]
    with_left = (h > 0) & (word[np.maximum(h - 1, 0)] == owner[at])
    beyond = np.minimum(h + 2, len(symbols) - 1)
    with_right = ~last[h + 1]
    risky = with_left & (p.ranks[_pair(p, left, result)] <= rank)
    risky |= with_right & (p.ranks[_pair(p, result, symbols[beyond])] <= rank)
    out[several] = np.isin(owner[at], owner[at][risky]) & ~first[at]
    return out


def _merge_long(p: Pieces, symbols: np.ndarray) -> np.ndarray:
    """The same for one long word; returns the positions of the symbols that are left.

    ``symbols`` is changed in place.
    """
    count = len(symbols)
    after, before = np.arange(1, count + 1), np.arange(-1, count - 1)
    alive = np.ones(count, bool)
    pair = np.full(count, len(p.pairs), np.int64)
    pair[:-1] = _pair(p, symbols[:-1], symbols[1:])
    buckets: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def put(at: np.ndarray) -> None:
        at = at[pair[at] < len(p.pairs)]
        rank = p.ranks[pair[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        for part in np.split(at, np.flatnonzero(np.diff(rank)) + 1):
            if len(part):
                value = int(p.ranks[pair[part[0]]])
                if value not in buckets:
                    heapq.heappush(queue, value)
                    buckets[value] = []
                buckets[value].append(part)

    put(np.arange(count))
    while queue:
        value = heapq.heappop(queue)
        at = np.unique(np.concatenate(buckets.pop(value)))
        at = at[alive[at] & (p.ranks[pair[at]] == value)]
        if not len(at):
            continue
        # an occurrence is claimed by its left neighbour if that one is merged
        index = np.arange(len(at))
        begins = np.r_[True, after[at[:-1]] != at[1:]]
        hits = at[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
        result = p.merged[pair[hits]]
        if len(hits) > 1:
            left_at, right_at = before[hits], after[after[hits]]
            left = symbols[np.maximum(left_at, 0)].copy()
            chained = np.r_[False, after[after[hits[:-1]]] == hits[1:]]
            left[chained] = result[np.flatnonzero(chained) - 1]
            right = symbols[np.minimum(right_at, count - 1)]
            risky = (left_at >= 0) & (p.ranks[_pair(p, left, result)] <= value)
            risky |= (right_at < count) & (p.ranks[_pair(p, result, right)] <= value)
            if risky.any():
                hits, result = hits[:1], result[:1]
        gone = after[hits]
        symbols[hits] = result
        alive[gone] = False
        after[hits] = after[gone]
        inside = after[hits] < count
        before[after[hits][inside]] = hits[inside]
        changed = np.unique(np.r_[hits, before[hits][before[hits] >= 0]])
        ends = changed[after[changed] >= count]
        changed = changed[after[changed] < count]
        pair[ends] = len(p.pairs)
        pair[changed] = _pair(p, symbols[changed], symbols[after[changed]])
        put(changed)
        left_over = at[alive[at] & (p.ranks[pair[at]] == value)]
        if len(left_over):
            put(left_over)
    return np.flatnonzero(alive)


def encode_words(p: Pieces, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and the offset of each word in them."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, np.int64)
    place, together = _tables(p.chars.tobytes(), p.neighbours.tobytes())
    at = place[points]
    symbols = np.r_[p.char_symbols, np.int32(-1)][at]
    # cut where no piece reaches across
    apart = np.ones(len(points), bool)
    if len(points) > 1:
        apart[1:] = ~together[at[:-1], at[1:]]
    apart[starts] = True
    cuts = np.flatnonzero(apart)
    spans = np.diff(np.r_[cuts, len(points)])
    short = np.repeat(spans <= LONG_WORD, spans)
    origin = np.flatnonzero(short)
    short_spans = spans[spans <= LONG_WORD]
    parts = []
    if len(origin):
        begin = np.r_[0, np.cumsum(short_spans)[:-1]]
        got, _, first = _merge_words(p, symbols[origin], begin, origin)
        parts.append((got, first))
    for k in np.flatnonzero(spans > LONG_WORD):
        own = symbols[cuts[k]:cuts[k] + spans[k]].copy()
        left = _merge_long(p, own)
        parts.append((own[left], left + cuts[k]))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    ids = np.concatenate([x[0] for x in parts])
    first = np.concatenate([x[1] for x in parts])
    order = np.argsort(first, kind="stable")
    ids, first = ids[order], first[order]
    # characters outside the vocabulary become the byte pieces of their UTF-8 form
    odd = np.flatnonzero((ids < 0) | (ids >= p.size))
    if len(odd):
        spelt = [chr(c).encode() for c in points[first[odd]].tolist()]
        wide = np.ones(len(ids), np.int64)
        wide[odd] = [len(x) for x in spelt]
        begin = np.cumsum(wide) - wide
        ids, first = np.repeat(ids, wide), np.repeat(first, wide)
        spots = np.repeat(begin[odd], wide[odd]) + np.arange(wide[odd].sum()) - np.repeat(np.cumsum(wide[odd]) - wide[odd], wide[odd])
        ids[spots] = np.frombuffer(b"".join(spelt), np.uint8).astype(np.int32) + p.first_byte
    return ids.astype(np.int32), np.searchsorted(first, np.r_[starts, len(points)])


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def encode_texts(p: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts with an end id each, and the offset of each text in them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    marked = pc.replace_substring(texts, " ", MARK)
    marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string())))
    marked = marked.combine_chunks() if isinstance(marked, pa.ChunkedArray) else marked
    _, offsets, data = marked.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(marked) + 1, marked.offset * 8)
    raw = np.frombuffer(data, np.uint8)[:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    counts = np.zeros(len(marked), np.int64)
    if len(raw) == 0:
        return np.full(len(marked), p.end, np.int32), np.arange(len(marked) + 1)
    mark = np.zeros(len(raw), bool)
    mark[:-2] = (raw[:-2] == _MARK[0]) & (raw[1:-1] == _MARK[1]) & (raw[2:] == _MARK[2])
    begins = mark.copy()
    begins[3:] &= ~mark[:-3]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    begins[:offsets[0]] = False
    begins = np.flatnonzero(begins)
    bounds = np.ascontiguousarray(np.r_[begins, len(raw)].astype(np.int64))
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), data).dictionary_encode()
    ids, places = encode_words(p, words.dictionary)
    index = words.indices.to_numpy()
    lengths = np.diff(places)[index]
    flat = ids[_ragged(places[index], lengths)]
    ends = np.r_[0, np.cumsum(lengths)]
    first_word = np.searchsorted(begins, offsets)
    counts = np.diff(ends[first_word]) + 1
    out_offsets = np.r_[0, np.cumsum(counts)]
    out = np.full(out_offsets[-1], p.end, np.int32)
    body = np.ones(len(out), bool)
    body[out_offsets[1:] - 1] = False
    out[body] = flat
    return out, out_offsets


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def decode_ids(p: Pieces, surfaces: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of the id lists; every byte that is no valid UTF-8 becomes U+FFFD."""
    shown = ~p.silent[ids]
    places = np.r_[0, np.cumsum(shown)][offsets]
    index = ids[shown].astype(np.int64)
    first = places[:-1][places[:-1] < places[1:]]
    index[first] += np.where(p.sheds[index[first]], p.size, 0)
    parts = pa.LargeListArray.from_arrays(pa.array(places, pa.int64()), surfaces.take(pa.array(index)))
    joined = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
    try:
        return joined.cast(pa.large_string())
    except pa.ArrowInvalid:
        codecs.register_error("each_byte", _each_byte)
        return pa.array([x.decode("utf-8", "each_byte") for x in joined.to_pylist()], pa.large_string())


def _cut(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` together, or one larger row."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield first, last
        first = last


def encode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of each row: the ids of its whole text with the end id."""
    p = pieces(model_path)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, last in _cut(sizes, _SLICE):
                part = batch.slice(first, last - first)
                ids, offsets = encode_texts(p, part.column(1))
                lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists.cast(pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, ids, text) of each row; null or empty ids give an empty text."""
    p = pieces(model_path)
    kind = encoded.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = pa.array(p.surfaces, pa.large_binary())
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, last in _cut(sizes, _SLICE):
                part = batch.slice(first, last - first)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False)
                offsets = np.r_[0, np.cumsum(sizes[first:last], dtype=np.int64)]
                texts = decode_ids(p, surfaces, values, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts.cast(pa.string())], names=[key, "ids", "text"])

    rows = encoded.select(F.col(key), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, text string")


def digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return decode(encode(docs, model_path, text, key), model_path, "ids", key).select(
        key,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
