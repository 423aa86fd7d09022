"""Mixing sources to target weights: pivotal dependent rounding over a reduction tree.

A document's size is its number of words (null text: 0).  Sources in code-point order,
null last, weigh 5, 2, 1, repeating, and share 150 % of all sizes; a target stops at
twice its source's size and the excess is shared anew by weight.  The expected number of
copies of a document is target / source size, at most 2; its whole part is certain.

The fractional parts are rounded in pairs: the first of two open documents gains words
and the other loses as many, or the reverse, until one of them is settled; the odds
keep each document's expectation, and the transfer keeps the source's number of words.
Within a block of some 256 documents one stays open; blocks meet in further levels until
a source has one open document, so a source misses its target by less than one document.
Draws are hashes of ids, so reruns agree.

Scale: blocks are hash buckets inside a source, so a source that holds a third of all
rows is thousands of blocks.  Each level is written once.  Only the table of sources is
ordered as a whole; it has one row per source.

``doc_id`` names a document; rows that repeat an id are separate documents in ``mix`` and
fall into one block.  Documents without words are never taken.  Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_CLASS, Scratch, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 256
_OPEN = "struct<doc_id:bigint,size:bigint,frac:double>"
_SETTLED = "array<struct<doc_id:bigint,size:bigint,up:int>>"


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(source).alias("source"),
        F.regexp_count(text_or_empty(text), F.lit(WORD_CLASS)).cast("bigint").alias("size"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, documents, target): shares by weight, filled up to the caps."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(most)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - before) / rest
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    first = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct("place", "level"))).over(whole)
    per = per.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return per.select(
        "source", "source_size", "documents", F.when(capped, cap).otherwise(F.col("first.level") * F.col("weight")).alias("target")
    )


def _draw(seed: int, *columns: str) -> Column:
    bits = F.expr(f"xxhash64({', '.join(map(str, (seed, *columns)))})")
    return (F.pmod(bits, F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("draw")


def _step(level: int) -> str:
    """One pairing inside aggregate(): acc = (open, settled), x = the next open document."""
    draw = f"pmod(xxhash64({level}, acc.open.doc_id, x.doc_id), {1 << 53}L) / {float(1 << 53)}D"
    gain = "least(1D - acc.open.frac, x.frac * x.size / acc.open.size)"
    loss = "least(acc.open.frac, (1D - x.frac) * x.size / acc.open.size)"
    settled = lambda who, up: f"concat(acc.settled, array(named_struct('doc_id', {who}.doc_id, 'size', {who}.size, 'up', {up})))"
    left = lambda who, frac: f"named_struct('doc_id', {who}.doc_id, 'size', {who}.size, 'frac', {frac})"
    state = lambda who, frac, other, up: f"named_struct('open', {left(who, frac)}, 'settled', {settled(other, up)})"
    up = (
        f"if(1D - acc.open.frac <= x.frac * x.size / acc.open.size, "
        f"{state('x', 'x.frac - (1D - acc.open.frac) * acc.open.size / x.size', 'acc.open', 1)}, "
        f"{state('acc.open', 'acc.open.frac + x.frac * x.size / acc.open.size', 'x', 0)})"
    )
    down = (
        f"if(acc.open.frac <= (1D - x.frac) * x.size / acc.open.size, "
        f"{state('x', 'x.frac + acc.open.frac * acc.open.size / x.size', 'acc.open', 0)}, "
        f"{state('acc.open', 'acc.open.frac - (1D - x.frac) * x.size / acc.open.size', 'x', 1)})"
    )
    first = f"named_struct('open', x, 'settled', acc.settled)"
    return f"(acc, x) -> if(acc.open is null, {first}, if({draw} * ({gain} + {loss}) < {loss}, {up}, {down}))"


def _level(open_rows: DataFrame, level: int) -> DataFrame:
    """One open document per (source, block), larger ones first so that a small one stays open."""
    block = F.pmod(F.xxhash64(F.lit(level), "doc_id"), F.col("blocks"))
    rows = open_rows.groupBy("source", block.alias("block")).agg(
        F.max("blocks").alias("blocks"),
        F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "doc_id", "size", "frac"))).alias("rows"),
    )
    start = f"named_struct('open', cast(null as {_OPEN}), 'settled', cast(array() as {_SETTLED}))"
    items = "transform(rows, r -> named_struct('doc_id', r.doc_id, 'size', r.size, 'frac', r.frac))"
    return rows.select("source", "blocks", F.expr(f"aggregate({items}, {start}, {_step(level)})").alias("done"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, **columns: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(sizes(docs, **columns))
    per = scratch.keep(targets(sized, weights, share, most))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).select(
        "doc_id", sized["source"], "size", F.floor(expected).cast("int").alias("whole"),
        (expected - F.floor(expected)).alias("frac"), F.ceil(F.col("documents") / BLOCK).alias("blocks"),
    )
    is_open = (F.col("size") > 0) & (F.col("frac") > 0)
    settled = [rows.filter(~is_open).select("doc_id", "source", "size", F.lit(0).alias("up"))]
    left, level = rows.filter(is_open).select("doc_id", "source", "size", "frac", "blocks"), 0
    most_blocks = per.agg(F.max(F.ceil(F.col("documents") / BLOCK))).first()[0] or 1
    while True:
        done = scratch.keep(_level(left, level))
        settled.append(done.select("source", F.inline("done.settled")).select("doc_id", "source", "size", "up"))
        left = done.select("done.open.*", "source", F.ceil(F.col("blocks") / BLOCK).alias("blocks"))
        if most_blocks <= 1:
            break
        most_blocks, level = -(-most_blocks // BLOCK), level + 1
    settled.append(left.select("doc_id", "source", "size", (_draw(-1, "doc_id") < F.col("frac")).cast("int").alias("up")))
    every = reduce(DataFrame.unionByName, settled)
    copies = (F.when(F.col("size") > 0, F.floor(expected).cast("int")).otherwise(0) + F.col("up")).alias("copies")
    return every.join(per, every["source"].eqNullSafe(per["source"])).select(
        "doc_id", every["source"], "size", "source_size", "target", copies,
        (copies * F.col("size")).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with the number of ``copies``.

    Rows that share doc_id, source and size share a decision, the largest of theirs.
    """
    taken = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    taken = taken.filter("copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")
    )
    size = F.regexp_count(text_or_empty(), F.lit(WORD_CLASS)).cast("bigint")
    rows = docs.join(
        taken, docs["doc_id"].eqNullSafe(F.col("__id")) & docs["source"].eqNullSafe(F.col("__source")) & (size == F.col("__size"))
    )
    return rows.select(*[docs[c] for c in docs.columns if c != "copies"], F.col("__copies").alias("copies"))
