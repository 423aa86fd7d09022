"""Cheapest edit scripts of symbol strings, by a grammar of their common parts.

Strings of role/fault symbols are compressed together by Re-Pair: the most frequent pair of
neighbours becomes a rule, again and again.  Each rule carries one min-plus matrix over the
states of the role grammar ``(s?(ua)+)?``; an entry is the least cost of going from one state
to another over the rule's rows, with the rope of the least edit letters among the cheapest.
A rule's matrix is the product of its two parts' matrices and is made once, however many
strings use it.

Two different scripts of equal cost for the same rows are never one the beginning of the
other (the surplus would be insertions, which cost), so the least script of a concatenation
is the concatenation of least scripts, and ropes may be compared wherever they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np

#: States: nothing emitted, after s (u must follow), after a (u may follow), after u (a must follow).
STATES = 4
_FINAL = (0, 2)
#: (state, next state) of an emitted role.
_MOVES = {"s": [(0, 1)], "u": [(0, 3), (1, 3), (2, 3)], "a": [(3, 2)], "o": []}
#: Symbols: role class (s, u, a, other) and fault (none, truncated), or a row that must go.
SYMBOLS = [role + fault for role in "suao" for fault in "-t"] + ["x"]
_COST = {"K": 0, "R": 2, "D": 3, "I": 2}
_TRUNCATED = 1
#: A rule must save something: its pair occurs at least so often.
LEAST_USES = 4

Rope = tuple | str
Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def letters(rope: Rope) -> Iterator[str]:
    """The pieces of a rope from left to right."""
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def _before(a: Rope, b: Rope) -> bool:
    """Whether rope ``a`` spells an earlier string than ``b``; stops at the first difference."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right, x, y = letters(a), letters(b), "", ""
    while True:
        if not x:
            x = next(left, "")
        if not y:
            y = next(right, "")
        if not x or not y:
            return not x and bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def _join(a: Rope, b: Rope) -> Rope:
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 64:
        return a + b
    return (a, b) if a and b else a or b


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; ties go to the least letters."""
    out = []
    for row in a:
        new: list[Entry] = [None] * STATES
        for middle, left in enumerate(row):
            if left is None:
                continue
            for state, right in enumerate(b[middle]):
                if right is None:
                    continue
                cost, best = left[0] + right[0], new[state]
                if best is not None and cost > best[0]:
                    continue
                rope = _join(left[1], right[1])
                if best is None or cost < best[0] or _before(rope, best[1]):
                    new[state] = (cost, rope)
        out.append(new)
    return out


def _identity() -> Matrix:
    return [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]


def _insertions() -> Matrix:
    """Up to two insertions; a third would only repeat the first at a higher cost."""
    one = _identity()
    for role in "ua":
        for i, j in _MOVES[role]:
            one[i][j] = (_COST["I"], "I")
    return product(one, one)


INSERTIONS = _insertions()


def _symbol_matrix(name: str) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]

    def offer(i: int, j: int, cost: int, letter: str) -> None:
        if out[i][j] is None or (cost, letter) < out[i][j]:
            out[i][j] = (cost, letter)

    for i in range(STATES):
        offer(i, i, _COST["D"], "D")
    if name != "x":
        extra = _TRUNCATED if name[1] == "t" else 0
        for i, j in _MOVES[name[0]]:
            offer(i, j, _COST["K"] + extra, "K")
        for role in "ua":
            for i, j in _MOVES[role]:
                offer(i, j, _COST["R"] + extra, "R")
    return product(INSERTIONS, out)


MATRICES = [_symbol_matrix(x) for x in SYMBOLS]
CODES = {x: k for k, x in enumerate(SYMBOLS)}


def re_pair(flat: np.ndarray, least: int = LEAST_USES) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Symbols with rules for frequent pairs; -1 ends a string and joins no pair.

    Rule k stands for ``len(SYMBOLS) + k``.
    """
    rules: list[tuple[int, int]] = []
    while len(flat) > 1:
        size = len(SYMBOLS) + len(rules)
        valid = (flat[:-1] >= 0) & (flat[1:] >= 0)
        pair = flat[:-1] * size + flat[1:]
        counts = np.bincount(pair[valid], minlength=1) if size * size < 1 << 20 else None
        if counts is not None:
            best = int(counts.argmax())
            if counts[best] < least:
                break
        else:
            kinds, times = np.unique(pair[valid], return_counts=True)
            if not len(times) or times.max() < least:
                break
            best = int(kinds[times.argmax()])
        hits = np.flatnonzero(valid & (pair == best))
        index = np.arange(len(hits))
        begins = np.r_[True, hits[1:] != hits[:-1] + 1]
        hits = hits[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
        flat = flat.copy()
        flat[hits] = size
        rules.append((best // size, best % size))
        flat = np.delete(flat, hits + 1)
        if len(hits) < least:
            break
    return flat, rules


def _fold(symbols: list[int], matrices: list[Matrix]) -> tuple[int, str]:
    """Cost and letters of one string.

    What the scripts of all states have in common is set aside after each step, so that the
    strings which are compared and copied stay short.
    """
    row: list[tuple[int, str] | None] = [(0, ""), None, None, None]
    common: list[str] = []

    def step(matrix: Matrix) -> list[tuple[int, str] | None]:
        new: list[tuple[int, str] | None] = [None] * STATES
        for left, entries in zip(row, matrix):
            if left is None:
                continue
            for state, right in enumerate(entries):
                if right is not None and (new[state] is None or left[0] + right[0] <= new[state][0]):
                    offer = (left[0] + right[0], left[1] + right[1])
                    if new[state] is None or offer < new[state]:
                        new[state] = offer
        return new

    for symbol in symbols:
        row = step(matrices[symbol])
        shared = commonprefix([x[1] for x in row if x])
        if shared:
            common.append(shared)
            row = [x and (x[0], x[1][len(shared):]) for x in row]
    row = step(INSERTIONS)
    cost, rest = min(row[k] for k in _FINAL if row[k])
    return cost, "".join(common) + rest


def _flat(matrix: Matrix) -> Matrix:
    return [[x and (x[0], "".join(letters(x[1]))) for x in row] for row in matrix]


def cheapest(strings: list[bytes]) -> list[tuple[int, str]]:
    """(cost, letters) of each string of symbol codes; the strings share one grammar."""
    flat = np.frombuffer(b"".join(x + b"\xff" for x in strings), np.uint8).astype(np.int64)
    flat[flat == 255] = -1
    flat, rules = re_pair(flat)
    matrices = list(MATRICES)
    for left, right in rules:
        matrices.append(product(matrices[left], matrices[right]))
    used = set(flat.tolist())
    spelt = [_flat(x) if k in used else x for k, x in enumerate(matrices)]
    out, begin = [], 0
    for end in np.flatnonzero(flat < 0).tolist():
        out.append(_fold(flat[begin:end].tolist(), spelt))
        begin = end + 1
    return out
