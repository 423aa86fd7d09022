"""Context mixing against a plain-Python count of every context."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import prose
from plumbline.llm import context_mixing as cm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id bigint, text string, block string, slice string"


def corpus():
    texts = ["", None, "one", "A a a a a", "é 日本 🎉 é 日本", prose(3, 4000)] + [prose(k, 40 + k) for k in range(60)]
    texts += [prose(7, 90)] * 3 + [" ".join(f"q{k}zzy" for k in range(60))]
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)]
    return [*rows, (None, "A a", "x", "y"), (None, None, "x", "y"), rows[9], rows[9]]


def level(value, bounds):
    return sum(value >= b for b in bounds)


def brute(rows, slices):
    """(score, base) of each row: contexts are tuples of words in dictionaries."""
    tokens = [WORD.findall((t or "").translate(FOLD)) + ["\n"] for _, t, *_ in rows]
    train = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, *_ in rows]
    after, single = defaultdict(Counter), Counter()
    for ws, learnt in zip(tokens, train, strict=True):
        for a, b, w in zip(["\n", "\n", *ws], ["\n", *ws], ws, strict=False):
            if learnt:
                after[a, b][w] += 1
                after[b][w] += 1
                single[w] += 1
    total, kinds = sum(single.values()), len(single)
    bits, pairs, parts = np.zeros((cm.SLICES, cm.CELLS, 2)), np.zeros(1 << 16), []
    for ws, own, k in zip(tokens, train, slices, strict=True):
        found, within = Counter(), 0.0
        for a, b, w in zip(["\n", "\n", *ws], ["\n", *ws], ws, strict=False):
            state, seen = 0, []
            for context in ((a, b), b):
                c, n, t = after[context][w] - own, sum(after[context].values()) - own, sum(x > 0 for x in after[context].values())
                t -= own and c == 0
                seen.append((c, n))
                state = state * cm.STATES + level(n, cm.SEEN) * 5 + level(t / max(n, 1), cm.FRESH)
            c0, done = single[w] - own, False
            for bit, (c, n) in enumerate(seen):
                if n > 0 and not done:
                    found[(bit * cm.STATES**2 + state) * 2 + (c > 0)] += 1
                    if c > 0:
                        within, done = within + math.log10(c / n), True
            if not done:
                found[(2 * cm.STATES**2 + state) * 2 + (c0 > 0)] += 1
                if c0 > 0:
                    within += math.log10(c0 / max(total - own, 1))
                else:
                    spelt = w.encode() + b" " * (w != "\n")
                    for x, y in zip(b" " + spelt, spelt, strict=False):
                        found[cm.PAIRS + x * 256 + y] += 1
        parts.append((found, within))
        if own:
            for symbol, n in found.items():
                if symbol < cm.PAIRS:
                    bits[k, symbol // 2, symbol % 2] += n
                else:
                    pairs[symbol - cm.PAIRS] += n
    logs = cm._log_table(bits)
    first = pairs.reshape(256, 256).sum(1)

    def cost(found, own):
        sums = Counter()
        for s, n in found.items():
            if s >= cm.PAIRS:
                sums[(s - cm.PAIRS) // 256] += n * own
        out = sum(logs[s] * n for s, n in found.items() if s < cm.PAIRS)
        for s, n in found.items():
            if s >= cm.PAIRS:
                before = (s - cm.PAIRS) // 256
                out += n * math.log10((pairs[s - cm.PAIRS] - n * own + 0.05) / (first[before] - sums[before] + 0.05 * 256))
        return out

    base = [sum(math.log10((single[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws) for ws in tokens]
    return [(within + cost(found, own), b) for (found, within), own, b in zip(parts, train, base, strict=True)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_score_equals_brute_force_in_any_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(cm, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(cm, "SHARD_BYTES", 2 * block_bytes)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    k = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(cm.SLICES))
    slices = [r.k for r in df.select(k.alias("k")).collect()]
    want = sorted((i is None, i or 0, round(s, 6), round(b, 6)) for (i, *_), (s, b) in zip(rows, brute(rows, slices), strict=True))
    for parts in (1, 7):
        got = cm.score(df.repartition(parts)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6), round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)


def test_bits_are_probabilities_and_lessons_count():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 50, (cm.SLICES, cm.CELLS, 2)) * (rng.random((1, cm.CELLS, 1)) < 0.1)
    p = 10 ** cm._log_table(bits)
    assert np.allclose(p.reshape(-1, 2).sum(1), 1)
    pairs, one = rng.integers(0, 3, 1 << 16).astype(float), np.ones(1, np.uint32)
    assert abs(sum(10 ** cm._spelling(pairs, np.array([97 * 256 + b]), one, False) for b in range(256)) - 1) < 1e-9
    sure = np.zeros((cm.SLICES, cm.CELLS, 2))
    sure[:, 0, 1] = 1000
    assert 10 ** cm._log_table(sure)[1] > 0.99


def test_mixture_beats_the_unigram_base_on_held_out_copies_and_prose(spark):
    rows = [(k, prose(k % 150, 120)) for k in range(300)]
    got = cm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("held_out")
    score, base = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.5 * base


def test_empty_table_gives_no_rows(spark):
    assert cm.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
