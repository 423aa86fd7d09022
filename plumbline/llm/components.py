"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id that each id of the links (a, b) is connected with.

    Alternates two star steps: each node links its larger neighbours, then its smaller
    ones, to its smallest neighbour.  A node with very many neighbours costs one row per
    neighbour; minima are pre-aggregated, and each round is written to the shared folder.
    """
    edges = scratch.keep(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        edges = scratch.keep(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return scratch.keep(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()))
