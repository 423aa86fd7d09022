"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: runs of letters, numbers (with inner ``.,:/``), and
nothing else.  Numbers, names (a capital and small letters right after a word) and units
after a number turn into typed placeholders; other tokens are lower-cased.  A question
whose numbers, names or units were changed keeps its template.

1. An item of n tokens of which SHARE match at one shift leaves room for n // 5 misses, so
   its longest unbroken run has at least ``width`` tokens (``_widths``: 4, less for some
   items of up to 15 tokens).  All windows of that width, of the benchmark and at every
   token of the documents, are hashed and joined: (document, item, shift).
2. For these alone the two token sequences are laid over each other at the shift.  A
   position matches if the template tokens agree; placeholders match only if the slots are
   consistent: equal benchmark values stand for equal values in the document (if
   not all are, those inside runs of ``width`` are tried, as other positions match by chance
   behind an inserted or dropped word).
3. The matches of all shifts found are united, without a floor per shift: those of shifts
   that differ by up to a fifth of the item, or NEAR (a place), and from anywhere those that
   match at least FAR of the item.  Short chance matches spread over a long document
   therefore do not add up.  A document is contaminated by an item if SHARE of the item's positions match.  A piece
   shorter than ``width`` that stands at a shift of its own is not found.

Scale: only hits leave the first pass; texts of candidates alone are read again, and of them
only stretches as long as the item are kept.  Sides are broadcast only after counting.  All
expressions run in the JVM.

Windows may consist of placeholders alone.  So that not every run of numbers is a leak, a
match needs a literal, or LEAST_EQUAL slots equal as written (all of a shorter item).  So an
item without literals is found as written; its template alone says nothing.  Null or empty texts and
items match nothing; an empty benchmark gives no rows; repeated rows are one document if
they share doc_id; rows without a doc_id are not reported.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, Scratch, join_checked, text_or_empty

SHARE = 0.8
#: Shifts that differ by so much are always one place; those that match FAR of the item count wherever they stand.
NEAR, FAR = 4, 0.3
#: A match without any literal must have so many slots equal as written.
LEAST_EQUAL = 3
NUMBER, NAME, UNIT = "", "", ""
UNITS = (
    "km", "cm", "mm", "m", "kg", "mg", "g", "lb", "lbs", "oz", "l", "ml", "mph", "kmh", "km/h", "ft", "in", "yd",
    "mi", "s", "sec", "min", "h", "hr", "hrs", "hours", "hour", "minutes", "minute", "seconds", "days", "weeks",
    "months", "years", "miles", "meters", "metres", "feet", "inches", "pounds", "dollars", "euros", "cents", "usd", "eur",
)
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_UNIT = rf"(?i)({_NUMBER})[ ]?(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
_NAME = r"(?<=[\p{L}0-9,;][ ])\p{Lu}\p{Ll}+(?![\p{L}])"
_BREAK = rf"[^\p{{L}}\p{{M}}{NUMBER}-{UNIT}]+"


def _whole(tokens: Column) -> Column:
    """Without the empty strings that splitting leaves at both ends."""
    return F.filter(tokens, lambda t: t != "")


def template(text: Column) -> Column:
    """Template tokens."""
    text = F.regexp_replace(text, rf"[{NUMBER}-{UNIT}]", " ")
    text = F.regexp_replace(text, _NAME, NAME)
    text = F.regexp_replace(text, _UNIT, f" {NUMBER} {UNIT} ")
    text = F.regexp_replace(text, _NUMBER, f" {NUMBER} ")
    return _whole(F.split(F.lower(text), _BREAK))


def surface(text: Column) -> Column:
    """The tokens of ``template`` as written, one for one."""
    text = F.regexp_replace(text, rf"[{NUMBER}-{UNIT}]", " ")
    text = F.regexp_replace(text, _UNIT, r"$0 ")
    return F.regexp_extract_all(text, F.lit(rf"{_NUMBER}|[\p{{L}}\p{{M}}]+"), F.lit(0))


def _misses(n: str) -> str:
    """How many of n positions may differ; the small number is for rounding."""
    return f"cast(floor({n} * {1 - SHARE} + 1e-6) as int)"


def _widths(n: str) -> Column:
    """The run of matches that misses cannot prevent."""
    return F.expr(f"cast(ceil(({n} - {_misses(n)}) / ({_misses(n)} + 1)) as int)")


def _windows(df: DataFrame, tokens: str, widths: list[int], *keys: str) -> DataFrame:
    """Keys, pos and (width, hash) of the windows that start at each token."""
    df = df.select(*keys, F.transform(tokens, lambda t: F.xxhash64(t)).alias("__h")).filter(F.size("__h") > 0)
    df = df.select(*keys, "__h", F.explode(F.sequence(F.lit(0), F.size("__h") - 1)).alias("pos"))

    def window(width: int) -> Column:
        hashed = F.xxhash64(F.lit(width), *(F.get("__h", F.col("pos") + k) for k in range(width)))
        return F.when(F.col("pos") + width <= F.size("__h"), hashed)

    if len(widths) == 1:
        return df.select(*keys, "pos", F.lit(widths[0]).alias("width"), window(widths[0]).alias("hash"))
    kinds = F.array(*(F.struct(F.lit(w).alias("width"), window(w).alias("hash")) for w in widths))
    return df.select(*keys, "pos", F.inline(kinds))


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, NAME, UNIT)


def _runs(at: Column, width: Column) -> Column:
    """Those of the sorted positions that lie in runs of ``width``."""
    starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + width - 1) == x + width - 1, F.lit(False)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda x: F.sequence(x, x + width - 1))))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, verbatim) of contaminated documents."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select(F.col(item).alias("item_id"), text_or_empty(text).alias("text")).select(
        "item_id", template(F.col("text")).alias("item_template"), surface(F.col("text")).alias("item_surface")
    )
    items = items.withColumn("item_tokens", F.size("item_template")).filter("item_tokens > 0")
    items = scratch.keep(items.withColumn("item_width", _widths("item_tokens")))
    n_items = items.count()
    widths = sorted(r.item_width for r in items.select("item_width").distinct().collect()) or [1]
    sought = _windows(items, "item_template", widths, "item_id", "item_tokens", "item_width").filter("width = item_width and hash is not null")
    sought = scratch.keep(sought.select("hash", "item_id", "item_tokens", F.col("pos").alias("at")))
    seen = docs.select(F.col(key).alias("doc_id"), template(text_or_empty(text)).alias("tokens")).filter("doc_id is not null")
    seen = _windows(seen, "tokens", widths, "doc_id").drop("width")
    found = join_checked(seen, sought, "hash", "inner", sought.count()).select(
        "doc_id", "item_id", "item_tokens", (F.col("pos") - F.col("at")).alias("shift")
    )
    found = scratch.keep(found.distinct())
    shifts = scratch.keep(found.select("doc_id").distinct())
    texts = join_checked(docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text")), shifts, "doc_id", "left_semi", shifts.count())
    texts = texts.select("doc_id", template(F.col("text")).alias("tokens"), surface(F.col("text")).alias("words"))
    pairs = join_checked(texts, found, "doc_id", "inner", found.count())
    # only the stretch under the item goes on
    pairs = pairs.withColumn("from", F.greatest(F.lit(0), -F.col("shift")))
    part = lambda name: F.slice(name, F.col("shift") + F.col("from") + 1, F.col("item_tokens") - F.col("from"))
    pairs = pairs.select("doc_id", "item_id", "shift", "from", part("tokens").alias("tokens"), part("words").alias("words"))
    pairs = join_checked(pairs, items, "item_id", "inner", n_items * 64)
    # lay the item over the document: both cut to the overlap
    over = lambda name: F.slice(name, F.col("from") + 1, F.size("tokens"))
    laid = F.arrays_zip(
        F.col("tokens").alias("t"), F.col("words").alias("w"), over("item_template").alias("u"), over("item_surface").alias("v"),
        F.sequence(F.col("from"), F.col("from") + F.size("tokens") - 1).alias("at"),
    )
    pairs = pairs.filter(F.size("tokens") > 0).select(
        "doc_id", "item_id", "item_tokens", "item_width", "shift", F.filter(laid, lambda x: x["t"] == x["u"]).alias("same")
    )
    pairs = pairs.withColumn("runs", _runs(F.transform("same", lambda x: x["at"]), F.col("item_width")))
    pairs = pairs.withColumn("inner", F.filter("same", lambda x: ~_is_slot(x["t"]) | F.array_contains("runs", x["at"])))

    def consistent(matches: str) -> Column:
        slots = F.filter(matches, lambda x: _is_slot(x["t"]))
        return F.size(F.array_distinct(F.transform(slots, lambda x: F.struct(x["t"], x["v"])))) == F.size(
            F.array_distinct(F.transform(slots, lambda x: F.struct(x["t"], x["v"], x["w"])))
        )

    literal = F.filter("same", lambda x: ~_is_slot(x["t"]))
    pairs = pairs.withColumn("good", F.when(consistent("same"), F.col("same")).when(consistent("inner"), F.col("inner")).otherwise(literal))
    of = ["doc_id", "item_id", "item_tokens"]
    pairs = pairs.select(
        *of, "shift", F.transform("good", lambda x: x["at"]).alias("at"),
        F.transform(F.filter("good", lambda x: ~_is_slot(x["t"])), lambda x: x["at"]).alias("literal"),
        F.transform(F.filter("good", lambda x: x["v"] == x["w"]), lambda x: x["at"]).alias("same_text"),
        F.size(F.filter("good", lambda x: x["v"] == x["w"])).alias("equal"),
    ).withColumn("far", F.when(F.size("at") >= FAR * F.col("item_tokens"), F.col("at")).otherwise(F.array().cast("array<int>")))
    # two rows of places, half a place apart: shifts that differ by up to ``near`` share one
    near = f"greatest({NEAR}, {_misses('item_tokens')})"
    places = F.expr(f"array(floor(shift / (2 * {near})) * 2, floor((shift + {near}) / (2 * {near})) * 2 + 1)")
    united = lambda name: F.array_distinct(F.flatten(F.collect_set(name))).alias(name)
    pairs = pairs.select("*", F.explode(places).alias("place")).groupBy(*of, "place").agg(
        united("at"), united("far"), united("same_text"), F.max(F.size("literal")).alias("literal"), F.max("equal").alias("equal")
    )
    union = pairs.groupBy(*of).agg(
        F.collect_set("at").alias("places"), united("far"), united("same_text"), F.max("literal").alias("literal"), F.max("equal").alias("equal")
    )
    union = union.filter((F.col("literal") > 0) | (F.size("same_text") >= F.least(F.lit(LEAST_EQUAL), F.col("item_tokens"))))
    best = F.array_max(F.transform("places", lambda at: F.size(F.array_union(at, F.col("far")))))
    return union.withColumn("matched", best).filter(F.col("matched") >= SHARE * F.col("item_tokens")).select(
        "doc_id", "item_id", "matched", "item_tokens", (F.col("equal") == F.col("item_tokens")).alias("verbatim")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of documents that no item contaminates, with their columns."""
    scratch = Scratch(docs.sparkSession)
    leaks = scratch.keep(contaminated(docs, benchmark, text, key).select(F.col("doc_id").alias("__id")).distinct())
    side = F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks
    return docs.join(side, docs[key] == F.col("__id"), "left_anti")
