"""Automaton, composed CRCs, gains and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import importance
from plumbline.llm.queries import op12_importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return words, [zlib.crc32(x.encode()) % importance.BUCKETS for x in runs]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(brute_features(text)[1])
    for text in target:
        t.update(brute_features(text)[1])
    S, T, b = sum(s.values()), sum(t.values()), importance.BUCKETS
    gain = [math.floor(1000 * math.log((float(t[k] + 1) * float(S + b)) / (float(s[k] + 1) * float(T + b)))) for k in range(b)]
    rows = []
    for key, text in docs:
        words, buckets = brute_features(text)
        weight = sum(gain[x] for x in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = {id(r): k for k, r in enumerate(fit[:25 * len(fit) // 100], 1)}
    return sorted((tuple([*r[:4], drawn.get(id(r))]) for r in rows), key=repr)


def test_composed_crcs():
    draw = random.Random(1)
    a = [draw.randbytes(draw.randrange(1, 9)) for _ in range(200)]
    b = [draw.randbytes(draw.choice([1, 2, 5, 31, 70000])) for _ in range(200)]
    crcs = [np.array(list(map(zlib.crc32, x)), np.uint32) for x in (a, b)]
    got = importance.compose(crcs[0], np.array(list(map(len, b))), crcs[1])
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_features_of_random_texts():
    draw = random.Random(2)
    texts = [None, "", " ", "A", "\x7f{`@[/:", "é", "x" * 5000, "a\nb\n\nc", "Äß日本 ab"]
    texts += ["".join(draw.choice("aB0 \n.é日\x00-") for _ in range(draw.randrange(80))) for _ in range(200)]
    got = [Counter() for _ in texts]
    for first, rows, bucket, row, words in importance.features(pa.array(texts, pa.string())):
        for b, r in zip(bucket.tolist(), row.tolist()):
            got[first + r][b] += 1
        for k in range(rows):
            assert words[k] == len(brute_features(texts[first + k])[0])
    assert got == [Counter(brute_features(x)[1]) for x in texts]


def test_small_corpora(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(importance, "_SLICE", 200)
    docs = [(x.doc_id, x.text) for x in awkward.collect()]
    frame = awkward.withColumnsRenamed({"value": "weight", "keep": "rank", "size": "score"})
    for target in (["one two three", None], []):
        wanted = brute(docs, target)
        got = importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"))
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=repr) == wanted
    assert importance.resample(nothing, awkward).count() == 0


def test_ranks_over_many_ranges(spark):
    """Equal scores and repeated keys included; more partitions than rows in some ranges."""
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(300)]), draw.randrange(9), draw.choice([19, 20, 50]), 0, draw.randrange(40)) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, n_features bigint, n_words bigint, weight bigint, score bigint").repartition(7)
    fit = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1]))
    wanted = [(k, r[4], r[0], r[1]) for k, r in enumerate(fit[:len(fit) * 25 // 100], 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    got = importance.ranked(frame).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(got) == len(rows)
    assert sorted((x["rank"], x.score, x.doc_id, x.n_features) for x in got if x["rank"] is not None) == wanted


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_on_whole_table(spark, folder):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [x.text for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(map(tuple, op12_importance(spark, folder).collect()), key=repr) == brute(docs, target)
