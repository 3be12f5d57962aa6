"""Connected components of a graph of merges, by alternating stars: every task sees a link at a time, no component whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algorithms import saved


def _stars(links: DataFrame, smaller: bool) -> DataFrame:
    """Every node hands the smallest id that it knows to its neighbours: to the larger ones, or to the smaller ones and itself."""
    both = links if smaller else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
    known = both.join(least, "a")
    if smaller:  # links go from the larger id to the smaller one
        out = known.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    else:
        out = known.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the smallest id that links reach.

    Null ends link nothing; loops and doubled links change nothing; ids need an order. The rounds grow with the logarithm
    of the longest chain, and end when no link changes."""
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    nodes = saved(ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id"))).distinct())
    now = saved(ends.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = None
    while (after := mark(now)) != before:
        before = after
        now = saved(_stars(_stars(now, smaller=False), smaller=True))
    return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def merged_ids(found: list[DataFrame], persons: DataFrame) -> DataFrame:
    """(old, new) for graph.remapped, of several lists of merges (target, others) that may chain: all ids of a component become one.

    That is the person (id, deg) of the largest degree, the first of equals; ids that no person has don't stay."""
    links = None
    for f in found:
        pairs = f.select(F.explode("others").alias("a"), F.col("target").alias("b"))
        links = pairs if links is None else links.unionByName(pairs)
    of = components(links).join(persons.select("id", "deg"), "id", "left")
    rank = F.struct(F.col("deg").isNull().alias("unknown"), (-F.col("deg")).alias("deg"), "id")
    new = of.groupBy("component").agg(F.min_by("id", rank).alias("new"))
    return of.join(new, "component").where("id != new").select(F.col("id").alias("old"), "new")
