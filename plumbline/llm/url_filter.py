"""URL verdicts: rules by host and path, then a block list behind a blocked Bloom filter.

The list holds canonical URLs (host without ``www.``, path without its last ``/``, query
without tracking parameters and in order; no scheme, no fragment).  Its Bloom filter is a
table of blocks, each eight 64-bit words of which a URL sets one bit per word.  A URL looks
up one block; only URLs whose eight bits are all set go to an exact join with the list,
which removes the false positives.  Rules come first: the longest that fits decides.

Scale: the filter grows with the list and is broadcast only after its blocks have been
counted; possible hits alone are shuffled.  All expressions run in the JVM.

A null or scheme-less url has empty host and path, fits no rule and is never listed:
allowed.  Empty tables give no rows; an empty list blocks nothing; repeated rows are judged
each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_checked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule)
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
#: Sites whose pages make up the block list of the query.
LISTED_SITES = ("ads-track", "cheap-pills", "spam-farm")
TRACKING = "(utm_[a-z]+|ref)(=.*)?"
WORDS = 8
KEYS_PER_BLOCK = 32  # 512 bits: 16 a key


def _after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical_of(url: str = "url") -> Column:
    query = F.regexp_extract(_after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"(?s)^{TRACKING}$")))
    return F.concat(
        F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")),
    )


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        site, at = rule.split("/", 1)
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{at}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), url), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    return F.shiftright(F.xxhash64(F.lit(2), url), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_blocks(listed: DataFrame, keys: int, column: str = "canonical") -> tuple[DataFrame, int]:
    """The filter as (block, w0..w7) rows, and its number of blocks."""
    blocks = max(1, math.ceil(keys / KEYS_PER_BLOCK))
    bits = listed.select(
        _block(F.col(column), blocks).alias("block"), *[_bit(F.col(column), k).alias(f"b{k}") for k in range(WORDS)]
    )
    return bits.groupBy("block").agg(*[F.expr(f"bit_or(shiftleft(1L, b{k}))").alias(f"w{k}") for k in range(WORDS)]), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of each row; ``listed``: distinct (canonical)."""
    keys = listed.count()
    bloom, blocks = bloom_blocks(listed, keys)
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    parts = named.select(
        "page_id", host_of("url").alias("host"), path_of("url").alias("path"), canonical_of("url").alias("canonical"),
        _block(canonical_of("url"), blocks).alias("block"),
    )
    probed = join_checked(parts, bloom, "block", "left", blocks)
    all_set = F.lit(True)
    for k in range(WORDS):
        all_set = all_set & F.expr(f"(shiftrightunsigned(w{k}, b{k}) & 1L) <=> 1L")
    probed = probed.withColumns({f"b{k}": _bit(F.col("canonical"), k) for k in range(WORDS)})
    probed = probed.select("page_id", "host", "path", "canonical", all_set.alias("possible"))
    exact = probed.filter("possible").join(listed.select("canonical", F.lit(True).alias("found")), "canonical", "left")
    columns = ["page_id", "host", "path", F.coalesce("found", F.lit(False)).alias("listed")]
    judged = exact.select(*columns).unionByName(
        probed.filter(~F.col("possible")).select("page_id", "host", "path", F.lit(False).alias("listed"))
    ).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for said, rule in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def listed_urls(pages: DataFrame, sites: tuple[str, ...] = LISTED_SITES, url: str = "url") -> DataFrame:
    """Distinct canonical URLs of the pages on sites that have one of these labels."""
    named = pages.select(F.col(url).alias("url")).filter(
        F.arrays_overlap(F.split(host_of("url"), r"\."), F.array(*map(F.lit, sites)))
    )
    return named.select(canonical_of("url").alias("canonical")).distinct()
