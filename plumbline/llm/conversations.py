"""Conversation structure repair: faults, and the cheapest edits to a well-formed dialogue.

A conversation is repaired so that its roles read ``(s?(ua)+)?``.  Keeping a row costs 0,
giving it another role 2, deleting it 3 (blank rows and duplicates must go), inserting an
empty row 2; a truncated row that stays adds 1.  Costs and edit letters come from
``grammar.cheapest``: strings of role/fault symbols are compressed by Re-Pair, one min-plus
matrix per rule is evaluated bottom-up and shared by all conversations of a task's slice.

Rows are sorted by ranges of (conversation, turn, role, text), so a conversation of any size
is spread over tasks, which stream their range.  Conversations inside a range are finished
there.  Those at a range's edge and those of very many rows leave pieces of one byte a row,
which are put together per conversation: as much as its letters, which are a cell of the
result.  The SHA-256 of such a conversation's repaired text is a chain over its rows in
order, so one task reads them, one batch at a time.

Whether a row repeats an earlier one follows from the first turn of each (role, text) digest
that occurs more than once, found by grouping; the copies a damage adds are known as such.

Definitions: null fields count as one space.  Rows of one turn are taken by role, then text
(by code points), null turns first.  All rows of a null ``conv_id`` are one conversation.
Repeated rows are duplicates.  Roles are judged by their first character; an empty role fits
nothing.  Empty tables give no rows; other columns are ignored.  Rows that are alike in
conversation, turn, role and the first characters of the text share a task, which streams
them.  A very long text costs its own size in the task that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import grammar
from plumbline.llm.common import Scratch, join_checked

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
DROP, EMPTY, UNSTOP, REPEAT, USER = range(5)
DAMAGE_ONE_IN = 20
#: A conversation with more rows or bytes leaves pieces.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
_SLICE_ROWS, _SLICE_BYTES = 20_000, 16 << 20
#: Repeated texts are broadcast up to so many (a digest and two numbers each, some 8 MB).
_REPEATED_ROWS = 100_000
_SIDE = 64
_FIELDS = (
    "conv_id bigint, whole boolean, part bigint, seq bigint, codes binary, first_role string, last_role string, "
    "lo bigint, hi bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_TYPES = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _FIELDS.split(", ")])
_LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with seeded faults: (conv_id, turn, role, text, copy, dropped).

    A dropped row stays, marked, so that its conversation is known.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    act = F.col("act")
    return (
        rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"),
                    (F.crc32(key.cast("binary")) % DAMAGE_ONE_IN).alias("act"))
        .select(
            "conv_id", "turn",
            F.when(act == USER, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(act.isin(DROP, EMPTY), F.lit("")).when(act == UNSTOP, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(act == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
            (act == DROP).alias("dropped"),
        )
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the form that ``repair`` takes."""
    space = F.lit(" ")
    return rows.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role"), space).alias("role"),
        F.coalesce(F.col("text"), space).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"),
    )


def _is_blank() -> Column:
    return F.length(F.rtrim(F.col("text"), F.lit(BLANKS))) == 0


def labelled(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds blank, cut (the last character is no stop) and again (an earlier turn has role and text)."""
    digest = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256))
    marked = rows.withColumns({"blank": _is_blank(), "digest": digest})
    first = (
        marked.filter(~F.col("dropped") & ~F.col("blank") & (F.col("copy") == 0)).groupBy("conv_id", "digest")
        .agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced"))
        .filter("n > 1").select(F.struct("conv_id", "digest").alias("same"), "least", "unplaced")
    )
    first = scratch.keep(first)
    marked = marked.withColumn("same", F.struct("conv_id", "digest"))
    joined = join_checked(marked, first, "same", "left", first.count(), _REPEATED_ROWS)
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    again = F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("least")))
    return joined.select(
        "conv_id", "turn", "role", "text", "copy", "dropped", "blank",
        (~last.isin(*STOPS)).alias("cut"), ((F.col("copy") > 0) | F.coalesce(again, F.lit(False))).alias("again"),
    )


class _Piece:
    """Rows of one conversation in order, or a part of them."""

    __slots__ = ("conv", "part", "seq", "whole", "codes", "rows", "size", "roles", "lo", "hi", "turns", "counts", "illegal", "last")

    def __init__(self, conv, part: int, seq: int, whole: bool):
        self.conv, self.part, self.seq, self.whole = conv, part, seq, whole
        self.codes, self.rows, self.size = bytearray(), [], 0
        self.roles = [None, None]
        self.lo = self.hi = None
        self.turns = self.illegal = 0
        self.counts = [0, 0, 0]

    def add(self, turn, role: str, text: str, fault: int) -> None:
        """``fault``: 0 blank, 1 duplicate, 2 truncated, 3 none."""
        if turn is not None and turn != self.hi:
            self.turns += 1
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        initial = role[:1]
        if self.roles[1] is not None and self.roles[1] + initial not in _LEGAL:
            self.illegal += 1
        self.roles = [initial if self.roles[0] is None else self.roles[0], initial]
        if fault < 3:
            self.counts[fault] += 1
        kind = initial if initial in ("s", "u", "a") else "o"
        self.codes.append(grammar.CODES["x" if fault < 2 else kind + ("t" if fault == 2 else "-")])
        self.rows.append((role, text))
        self.size += len(text)

    def row(self, cost=None, audit=None, sha=None) -> tuple:
        return (self.conv, self.whole, self.part, self.seq, bytes(self.codes), *self.roles, self.lo, self.hi, self.turns, *self.counts,
                self.illegal, cost, audit, sha)


def _repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines of the repaired conversation."""
    expected = "u"
    for letter in audit:
        if letter == "I":
            initial, line = expected, ("user:" if expected == "u" else "assistant:")
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                initial, line = expected, ("user:" if expected == "u" else "assistant:") + text
            else:
                initial, line = role[:1], f"{role}:{text}"
        expected = "a" if initial == "u" else "u"
        yield line


def _digest(lines: Iterator[str]) -> str:
    sha, rest = hashlib.sha256(), False
    for line in lines:
        sha.update((("\n" if rest else "") + line).encode())
        rest = True
    return sha.hexdigest()


def _finish(pieces: list[_Piece]) -> pa.RecordBatch:
    """Result rows of whole conversations, rows without result of pieces."""
    strings = sorted({bytes(x.codes) for x in pieces if x.whole})
    known = dict(zip(strings, grammar.cheapest(strings))) if strings else {}
    rows = []
    for x in pieces:
        if x.whole:
            cost, audit = known[bytes(x.codes)]
            rows.append(x.row(cost, audit, _digest(_repaired(audit, iter(x.rows)))))
        else:
            rows.append(x.row())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], names=_NAMES)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range to results of its inner conversations and pieces of the others."""
    part = TaskContext.get().partitionId()
    ready: list[_Piece] = []
    current: _Piece | None = None
    held = held_rows = 0
    before = None
    for batch in batches:
        for conv, turn, role, text, dropped, blank, cut, again in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or conv != current.conv or len(current.codes) >= PIECE_ROWS or current.size >= PIECE_BYTES:
                if current is not None:
                    follows = conv == current.conv
                    current.whole = current.whole and not follows
                    ready.append(current)
                    held, held_rows = held + current.size, held_rows + len(current.codes) + 1
                    if held > _SLICE_BYTES or held_rows > _SLICE_ROWS:
                        yield _finish(ready)
                        ready, held, held_rows = [], 0, 0
                    current = _Piece(conv, part, current.seq + 1, not follows)
                else:
                    current = _Piece(conv, part, 0, False)
            if dropped:
                continue
            same = (conv, turn, role, text)
            fault = 0 if blank else 1 if again or same == before else 2 if cut else 3
            before = same
            current.add(turn, role, text, fault)
    if current is not None:
        current.whole = False
        yield _finish([*ready, current])


def _assemble(table: pa.Table) -> pa.Table:
    """One conversation from its pieces."""
    pieces = table.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
    cost, audit = grammar.cheapest([b"".join(x["codes"] for x in pieces)])[0]
    out = {k: sum(x[k] for x in pieces) for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
    lo = hi = role = None
    for x in pieces:
        if x["lo"] is not None:
            out["turns"] -= x["lo"] == hi
            lo, hi = x["lo"] if lo is None else lo, x["hi"]
        if x["first_role"] is not None:
            out["illegal"] += role is not None and role + x["first_role"] not in _LEGAL
            role = x["last_role"]
    row = {"conv_id": pieces[0]["conv_id"], "whole": True, "lo": lo, "hi": hi, "cost": cost, "audit": audit, **out}
    return pa.Table.from_pylist([{k: row.get(k) for k in _NAMES}], schema=_SCHEMA)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation a script and then its rows in order, to the digest of the repaired text."""
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    stream = rows()
    ahead: list[tuple] = []

    def own() -> Iterator[tuple[str, str]]:
        for _, kind, role, text in stream:
            if kind == 0:
                ahead.append((_, kind, role, text))
                return
            yield role, text

    while True:
        head = ahead.pop() if ahead else next(stream, None)
        if head is None:
            return
        mine = own()
        sha = _digest(_repaired(head[3], mine))
        for _ in mine:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([head[0]], pa.int64()), pa.array([sha])], names=["conv_id", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged`` or ``undamaged`` rows.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)
    """
    scratch = Scratch(rows.sparkSession)
    keys = ["conv_id", "turn", "role"]
    ordered = (
        labelled(rows, scratch).withColumn("side", F.substring("text", 1, _SIDE))
        .repartitionByRange(*keys, "side").sortWithinPartitions(*keys, "text", "copy")
        .select(*keys, "text", "dropped", "blank", "cut", "again")
    )
    found = scratch.keep(ordered.mapInArrow(_stream, _FIELDS))
    joined = scratch.keep(found.filter(~F.col("whole")).groupBy("conv_id").applyInArrow(_assemble, _FIELDS))
    open_ = joined.select(F.struct("conv_id").alias("same"))
    # scripts, and the rows they apply to; one task streams a conversation, as its digest is a chain
    scripts = joined.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                            F.col("audit").alias("text"), F.lit(0).alias("copy"))
    body = join_checked(rows.filter(~F.col("dropped")).withColumn("same", F.struct("conv_id")), open_, "same", "left_semi", joined.count(), _REPEATED_ROWS)
    body = body.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copy")
    chained = (
        scripts.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text", "copy")
        .select("conv_id", "kind", "role", "text").mapInArrow(_chain, "conv_id bigint, repaired_sha256 string")
    )
    digests = scratch.keep(chained.select(F.struct("conv_id").alias("same"), "repaired_sha256"))
    late = joined.drop("repaired_sha256").withColumn("same", F.struct("conv_id")).join(digests, "same").select(*_NAMES)
    every = found.filter("whole").select(*_NAMES).unionByName(late)
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    return every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
