import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from texts import prose
from plumbline.llm import exact_dedup, minhash, repeats
from plumbline.llm.suffix_array import common_prefixes, suffix_array


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_groups_match_brute_force(spark, awkward, nothing):
    groups = defaultdict(list)
    for i, t in rows_of(awkward):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for bare, found in groups.items():
        keep = min(found)[3]
        for _, _, _, i in found:
            want[(i, keep, len(found), i == keep, hashlib.sha256(bare.encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup.decide(awkward).collect())) == want
    kept = exact_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 6, 7, 8, 9, 10]
    assert exact_dedup.decide(nothing).count() == 0 and exact_dedup.keep_one(nothing).count() == 0


def test_perfect_hash_uses_each_slot_once():
    for count in (1, 2, 5, 100, 3000):
        words = np.random.default_rng(count).integers(0, 1 << 63, (count, 4)).astype(np.uint64)
        pilots = exact_dedup.perfect_pilots(words)
        assert sorted(exact_dedup._slot(words, pilots, count)) == list(range(count))


def test_near_classes_match_brute_force(spark):
    base = [prose(k, 60).split() for k in range(6)]
    rows = []
    for k, words in enumerate(base):
        for j in range(5):
            some = list(words)
            for at in range(j):
                some[7 * at] = f"new{k}{j}{at}"
            rows.append((100 * k + j, " ".join(some)))
    rows += [(900, "a b"), (901, "a b"), (902, "a c"), (903, None), (904, ""), (905, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    idf = minhash.idf_table(*minhash.document_frequencies(df))
    weights = []
    for _, t in rows:
        (_, data, offsets), = minhash.slices(pa.array([t]))
        h, _, n = minhash._counted(data, offsets)
        weights.append(dict(zip(h.tolist(), (n * idf[minhash._bucket(h)]).tolist(), strict=True)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = sum(min(w, weights[b][h]) for h, w in weights[a].items() if h in weights[b])
            total = sum(weights[a].values()) + sum(weights[b].values()) - both
            if rows[a][1] == rows[b][1] or total and both / total >= 0.8:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[root(k) if t else t].append(i)
    groups[""] = sorted(groups.pop(None) + groups[""])  # null counts as empty
    want = {i: (min(g), len(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.class_id, r.class_size) for r in minhash.classes(df).collect()} == want


def test_block_division_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", 3)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 4)
    words = prose(5, 200).split()
    rows = [(k, " ".join(words[:50] + [f"w{k}"] + words[51:])) for k in range(30)] + [(99, prose(77, 100))]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {**{k: 0 for k in range(30)}, 99: 99}


def test_awkward_rows_pass_near_dedup(spark, awkward, nothing):
    assert minhash.classes(awkward).count() == awkward.count()
    kept = minhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 7, 9, 10, None} and 8 not in {r.doc_id for r in kept.collect()}
    assert minhash.classes(nothing).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (60, 2), (400, 3), (3000, 2), (500, 200), (700, 1)):
        text = rng.integers(0, k, n).astype(np.uint8)
        raw = text.tobytes()
        order = suffix_array(text, n + 1)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        for at, length in enumerate(common_prefixes(text, order, 40)[1:].tolist(), 1):
            a, b = raw[order[at - 1]:], raw[order[at]:]
            assert length == next((m for m in range(min(len(a), len(b), 40)) if a[m] != b[m]), min(len(a), len(b), 40))


def brute_repeats(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()


def test_repeats_match_brute_force(spark, awkward, nothing, monkeypatch):
    core = prose(3, 120)
    rows = rows_of(awkward) + [(100 + k, prose(200 + k, 20 + k) + core[: 760 - 9 * k] + prose(300 + k, 30)) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter((r[0], *b) for r, b in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 400), strict=True))
    for most in (2048, 2):  # whole groups, and groups divided down to single windows
        monkeypatch.setattr(repeats, "SHARD_REGIONS", most)
        assert Counter(map(tuple, repeats.remove(df).collect())) == want
    assert repeats.remove(nothing).count() == 0


REPEATED = [(6, "A"), (6, "B"), (5, "B"), (None, "C"), (None, "C"), (None, "C"), (7, "D"), (7, "D"), (8, "E e"), (8, "E  e"), (9, "F")]


def test_repeated_and_missing_ids_lose_no_text(spark):
    df = spark.createDataFrame(REPEATED, "doc_id bigint, text string").selectExpr("*", "1 AS __id", "2 AS times", "3 AS digest", "4 AS node", "5 AS class")
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [
        (5, "B"), (6, "A"), (7, "D"), (8, "E  e"), (9, "F"), (None, "C")]
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    # white space between words is no difference of shingles
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert len(got) == 6 and got[:3] == [(5, "B"), (6, "A"), (7, "D")] and got[4:] == [(9, "F"), (None, "C")] and got[3][0] == 8


def test_repeated_ids_are_compared_by_text(spark):
    """Both texts of a repeated id take part; the class of one is not that of the other."""
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, prose(3, 80))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.classes(df).collect())
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 1)]
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(df).collect()) == sorted([(1, a), (1, b), (4, prose(3, 80))])
