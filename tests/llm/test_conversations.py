"""Edit scripts against exhaustive search, conversations against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversations, grammar
from plumbline.llm.queries import op13_conversations

WELL_FORMED = re.compile(r"(s?(ua)+)?")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def exhaustive(rows):
    """Least (cost, letters) over every way to edit a few (role initial, fault) rows."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    options = []
    for initial, fault in rows:
        extra = fault == "truncated"
        options.append([(3, "D", "")] + ([] if fault in ("blank", "duplicate") else
                       [(extra, "K", initial), (2 + extra, "R", "u"), (2 + extra, "R", "a")]))
    for edits in itertools.product(*options):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            roles = inserted[0] + "".join(e[2] + g for e, g in zip(edits, inserted[1:]))
            if any(c not in "sua" for c in roles) or not WELL_FORMED.fullmatch(roles):
                continue
            letters = "I" * len(inserted[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(edits, inserted[1:]))
            offer = (sum(e[0] for e in edits) + 2 * sum(map(len, inserted)), letters)
            best = offer if best is None or offer < best else best
    return best


def table_search(rows):
    """The same for long conversations: least (cost, letters) by rows taken and state."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    def fill(states):
        for _ in range(2):
            for state, (cost, text) in list(states.items()):
                for role in "ua":
                    to = step.get((state, role))
                    if to and (to not in states or (cost + 2, text + "I") < states[to]):
                        states[to] = (cost + 2, text + "I")
        return states
    states = fill({"": (0, "")})
    for initial, fault in rows:
        new, extra = {}, fault == "truncated"
        for state, (cost, text) in states.items():
            offers = [(state, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                offers += [(step.get((state, initial)), cost + extra, "K")]
                offers += [(step.get((state, r)), cost + 2 + extra, "R") for r in "ua"]
            for to, price, letter in offers:
                if to is not None and (to not in new or (price, text + letter) < new[to]):
                    new[to] = (price, text + letter)
        states = fill(new)
    return min(states[x] for x in ("", "a") if x in states)


def brute(rows):
    """Result rows of (conv_id, turn, role, text) rows."""
    talks = {}
    for conv, turn, role, text in rows:
        talk = talks.setdefault(conv, [])
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        talk += [(turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    out = []
    for conv, talk in talks.items():
        talk.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in talk:
            solid = SOLID.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = table_search([(r[:1], f) for (_, r, _), f in zip(talk, faults)])
        lines, left, want = [], list(talk), "u"
        for letter in audit:
            name = {"u": "user", "a": "assistant"}[want]
            if letter == "I":
                lines.append(f"{name}:")
            else:
                _, role, text = left.pop(0)
                if letter == "D":
                    continue
                lines.append(f"{role if letter == 'K' else name}:{text}")
            want = "a" if lines[-1][0] == "u" else "u"
        turns = {t for t, _, _ in talk if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(talk, talk[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def codes(rows):
    return bytes(grammar.CODES["x" if f in ("blank", "duplicate") else (r if r in ("s", "u", "a") else "o") + ("t" if f == "truncated" else "-")] for r, f in rows)


def test_scripts_of_few_rows():
    kinds = [(r, f) for r in "suao" for f in ("", "truncated")] + [("u", "blank")]
    cases = [list(x) for n in range(3) for x in itertools.product(kinds, repeat=n)]
    draw = random.Random(1)
    cases += [[draw.choice(kinds) for _ in range(3)] for _ in range(40)]
    got = grammar.cheapest([codes(x) for x in cases])
    for case, answer in zip(cases, got):
        assert answer == exhaustive(case) == table_search(case), case


@pytest.mark.parametrize("kinds", [2, 9])
def test_scripts_of_many_rows(kinds):
    """Shared and private rules, repeated parts, one very long string."""
    draw = random.Random(kinds)
    every = ([(r, f) for r in "suao" for f in ("", "truncated")] + [("u", "blank")])[:kinds]
    parts = [[draw.choice(every) for _ in range(draw.randrange(1, 7))] for _ in range(8)]
    cases = [[row for _ in range(draw.randrange(12)) for row in draw.choice(parts)] for _ in range(150)] + [parts[0] * 700, [draw.choice(every) for _ in range(3000)]]
    assert grammar.cheapest([codes(x) for x in cases]) == [table_search(x) for x in cases]


def test_rules_are_shared():
    import numpy as np

    flat, rules = grammar.re_pair(np.array(([2, 4] * 50 + [-1]) * 20))
    assert 1 <= len(rules) <= 8 and len(flat) < 200


def test_ropes_compare_as_their_strings():
    draw = random.Random(4)
    def rope(text):
        if len(text) < 2 or draw.random() < 0.3:
            return text
        cut = draw.randrange(1, len(text))
        return rope(text[:cut]), rope(text[cut:])
    for _ in range(500):
        a, b = ("".join(draw.choice("DI") for _ in range(draw.randrange(1, 9))) for _ in range(2))
        assert grammar._before(rope(a), rope(b)) == (a < b)


def random_rows(seed, count, convs):
    draw = random.Random(seed)
    texts = ["Hello there.", "What?", "no end", " ", "", None, "Yes!\n", "é日 . x", "a", "A:b\nuser:c"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "user", "assistant"]
    return [(draw.choice(convs), draw.choice([None, *range(12)]), draw.choice(roles), draw.choice(texts) or draw.choice([None, "q" + str(draw.random())]))
            for _ in range(count)]


def result(frame):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert frame.columns == names
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("piece", [4096, 3])
def test_random_conversations(spark, monkeypatch, piece):
    """Many ranges, so that conversations are cut; nulls, ties, repeats and a large one."""
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece)
    rows = random_rows(1, 900, [None, *range(150)]) + random_rows(2, 700, [7]) + [(1000 + k, k % 3, "user", None) for k in range(60)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS kind", "'x' AS copy", "true AS dropped")
    for partitions in ("3", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = result(conversations.repair(conversations.damaged(frame)))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert got == brute(rows)


def test_empty_and_long(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, k, "user" if k % 2 else "assistant", "word. " * 40000) for k in range(4)]
    assert result(conversations.repair(conversations.damaged(spark.createDataFrame(rows, schema)))) == brute(rows)
    kept = conversations.repair(conversations.undamaged(spark.createDataFrame([(5, 0, "user", "Hi."), (5, 1, "assistant", "Yes.")], schema))).collect()
    assert (kept[0].cost, kept[0].audit) == (0, "KK")


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op13_conversations(spark, folder)) == brute(rows)
