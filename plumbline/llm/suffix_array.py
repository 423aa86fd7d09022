"""Suffix sorting by induction, on whole arrays: buckets are queues that are emptied in bulk."""

from __future__ import annotations

import numpy as np

from plumbline.llm.common import _EXACT, mix, prefix_hashes, span_hashes


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type)."""
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    step[-1] = 1
    known = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]
    return step[known] > 0


class _Queues:
    """A queue of positions for each first character; positions come in order of their suffixes."""

    def __init__(self, letters: int):
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(letters)]

    def put(self, positions: np.ndarray, letters: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(letters, kind="stable")
        positions, letters = positions[order], letters[order]
        cut = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        for part, letter in zip(np.split(positions, cut), letters[np.r_[0, cut]].tolist(), strict=True):
            self.waiting[letter].append(part)

    def take(self, letter: int) -> np.ndarray:
        parts, self.waiting[letter] = self.waiting[letter], []
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes from that of the leftmost S ones (``seeds``)."""
    by_letter = np.argsort(text[seeds], kind="stable")
    seeds = seeds[by_letter]
    first = np.searchsorted(text[seeds], np.arange(letters + 1))
    queues, large = _Queues(letters), []

    def before(positions: np.ndarray, want_small: bool) -> np.ndarray:
        previous = positions[positions > 0] - 1
        return previous[small[previous] == want_small]

    for c in range(letters):
        done, now = [], queues.take(c)
        while len(now):
            done.append(now)
            previous = before(now, False)
            letter = text[previous]
            queues.put(previous[letter != c], letter[letter != c])
            now = previous[letter == c]
        previous = before(seeds[first[c]:first[c + 1]], False)
        queues.put(previous, text[previous])
        large.append(np.concatenate(done) if done else np.zeros(0, np.int64))
    out: list[np.ndarray] = []
    for c in range(letters - 1, -1, -1):
        done, now = [], queues.take(c)
        if c == text[-1] and not len(now):
            now = np.array([len(text) - 1])
        while len(now):
            done.append(now)
            previous = before(now, True)
            letter = text[previous]
            queues.put(previous[letter != c], letter[letter != c])
            now = previous[letter == c]
        back = large[c][::-1]
        previous = before(back, True)
        queues.put(previous, text[previous])
        out += [*done, back]
    return np.concatenate(out)[::-1]


def _rank_by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by at least ``depth`` names."""
    rank, width = names.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:max(0, len(rank) - width)] = rank[width:] + 1
        pair = rank * (int(rank.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.r_[0, np.cumsum(pair[order][1:] != pair[order][:-1])]
        rank = np.empty(len(order), np.int64)
        rank[order] = new
        width *= 2
        if width >= depth or new[-1] == len(order) - 1:
            return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte array in the order of (at least) their first ``depth`` bytes.

    Leftmost S suffixes are sorted by their substrings, by induction; their names form a
    string of about a third of the length, whose suffixes are ranked to the needed depth;
    a second induction gives the order of all.
    """
    if len(text) < 2:
        return np.arange(len(text))
    whole = np.r_[text.astype(np.int64) + 1, 0]
    small = _types(whole)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = _induce(whole, small, left, 257)
    is_left = np.zeros(len(whole), bool)
    is_left[left] = True
    order = order[is_left[order]]
    nth = np.zeros(len(whole), np.int64)
    nth[left] = np.arange(len(left))
    ends = np.r_[left[1:] + 1, len(whole)]
    prefix = prefix_hashes(np.r_[text, 0].astype(np.uint8), _EXACT)
    named = span_hashes(prefix, left, np.minimum(ends, len(whole)))
    with np.errstate(over="ignore"):
        named = mix(named + (ends - left).astype(np.uint64))
    in_order = named[nth[order]]
    names = np.empty(len(left), np.int64)
    names[nth[order]] = np.r_[0, np.cumsum(in_order[1:] != in_order[:-1])]
    ranked = left[_rank_by_doubling(names, depth)]
    return _induce(whole, small, ranked, 257)[1:]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before in order, up to ``most``.

    Found by doubling steps over span hashes, all suffixes at once.
    """
    prefix = prefix_hashes(text, _EXACT)
    a, b = order[1:], order[:-1]
    room = np.minimum(len(text) - np.maximum(a, b), most)
    known = np.zeros(len(a), np.int64)
    step = 1 << (int(most).bit_length() - 1)
    while step:
        try_ = known + step
        fits = np.flatnonzero(try_ <= room)
        same = span_hashes(prefix, a[fits] + known[fits], a[fits] + try_[fits]) == span_hashes(prefix, b[fits] + known[fits], b[fits] + try_[fits])
        known[fits[same]] += step
        step >>= 1
    return np.r_[0, known]
