"""Iterative graph measures over weighted edges (source, target, weight)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import fresh, shared

#: Edges in a bucket, about, and nodes that are broadcast in a round.
BUCKET, NODES = 1 << 20, 1 << 20


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage at files in the shared folder, whose size says how a table is best joined."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, rows: int) -> DataFrame:
    """The table in buckets of a column, so that sums by it need no exchange, however often they are made."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET))
    name = f"plenaria_{uuid.uuid4().hex}"
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).sortBy(by).option("path", fresh(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


def _beside(df: DataFrame, nodes: int) -> DataFrame:
    """A table with a row a node, broadcast unless there are too many."""
    return F.broadcast(df) if nodes <= NODES else df


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds; a node passes its rank on by the weight of its edges."""
    e = stored(edges.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("weight").cast("double").alias("w")), "edges")
    out = e.groupBy("s").agg(F.sum("w").alias("sum"))
    nodes = stored(e.select(F.explode(F.array("s", "t")).alias("id")).distinct().join(out.withColumnRenamed("s", "id"), "id", "left"), "nodes")
    size = nodes.count()
    e = bucketed(e, "t", e.count())
    rank = nodes.select("id", F.lit(1.0 - damping).alias("rank"), "sum")
    for _ in range(rounds):
        # A round reads the edges once, in place, all of a target in one task: what moves is a rank for each node.
        passed = rank.where("sum IS NOT NULL").select(F.col("id").alias("s"), (F.col("rank") / F.col("sum")).alias("r"))
        got = e.join(_beside(passed, size), "s").groupBy(F.col("t").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("in"))
        rank = stored(nodes.join(got, "id", "left").select("id", (F.lit(1.0 - damping) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"), "sum"), "ranks")
    return rank.select("id", "rank")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree, weight) over both directions."""
    both = edges.select(F.explode(F.array("source", "target")).alias("id"), "weight")
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation: a node takes the label of the largest weight among its neighbours and
    itself, the smallest of equals. Deterministic, and cheaper than louvain."""
    e = stored(edges.select("source", "target", F.col("weight").cast("double").alias("w")), "edges")
    nodes = stored(e.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "nodes")
    size = nodes.count()
    ends = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b"))))
    # A node's own vote stands among its neighbours' in the same bucket.
    both = e.select(ends.alias("e"), "w").select("e.a", "e.b", "w").unionAll(nodes.select("id", "id", F.lit(0.5)))
    both = bucketed(both, "a", 2 * e.count() + size)
    label = None
    for _ in range(rounds):
        # In the first round every node is a community of its own.
        of = both.join(_beside(label.select(F.col("id").alias("b"), "community"), size), "b") if label is not None else both.withColumn("community", F.col("b"))
        sums = of.groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"), F.max(F.col("a") == F.col("b")).alias("own"))
        chosen = F.min_by("community", F.struct((-F.col("w")).alias("w"), F.col("community")))
        label = stored(sums.groupBy("id").agg(chosen.alias("community"), F.max(F.when(F.col("own"), F.col("community"))).alias("was")), "labels")
        if label.where("community != was").isEmpty():  # no round to come would change a label
            break
    return label.select("id", "community") if label is not None else nodes.withColumn("community", F.col("id"))


def louvain(edges: DataFrame, levels: int = 4, rounds: int = 8, least: float = 1e-9) -> DataFrame:
    """(id, community) by the Louvain method: nodes move to the neighbouring community that raises modularity most, then
    communities become the nodes of the next level, until no node moves.

    Nodes move at the same time, in each round those of one half by hash, so that neighbours don't trade places for ever;
    of equal gains the smallest community wins, so the result is the same for any layout. A community is named by one of
    its nodes. All steps are joins and sums by node, neighbour and community."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").cast("double").alias("w"))
    # Both directions; a loop counts twice in its node's strength, as two ends.
    e = saved(e.unionAll(e.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    total = e.agg(F.sum("w")).first()[0]
    out = e.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
    if not total:
        return out
    for level in range(levels):
        k = e.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
        own = saved(k.withColumn("c", F.col("id")))
        moved_any = False
        still = 0
        for i in range(rounds):
            inside = own.groupBy("c").agg(F.sum("k").alias("t"))
            near = e.where("a != b").join(own.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
            mine = own.select("id", "k", F.col("c").alias("old"))
            ways = near.unionByName(own.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w")).join(mine, "id").join(inside, "c")
            gain = F.col("w") - F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)) / total
            best = ways.withColumn("g", F.round(gain, 9)).groupBy("id").agg(F.min_by("c", F.struct((-F.col("g")).alias("g"), F.col("c"))).alias("new"), F.max("g").alias("g"), F.max(F.when(F.col("c") == F.col("old"), F.col("g"))).alias("g0"))
            turn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == i % 2
            goes = turn & (F.col("g") > F.col("g0") + least)
            own = saved(own.join(best, "id").select("id", "k", F.when(goes, F.col("new")).otherwise(F.col("c")).alias("c"), goes.alias("went"))).select("id", "k", "c", "went")
            if own.where("went").limit(1).count():
                moved_any, still = True, 0
            else:
                still += 1
            own = own.drop("went")
            if still == 2:  # neither half moves
                break
        if not moved_any:
            break
        out = saved(out.join(own.select(F.col("id").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))
        of = own.select("id", "c")
        e = e.join(of.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        e = saved(e.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    return out


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling."""
    e = edges.join(label.select(F.col("id").alias("source"), F.col("community").alias("ca")), "source").join(label.select(F.col("id").alias("target"), F.col("community").alias("cb")), "target")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("l"))
    d = degree(edges).join(label, "id").groupBy(F.col("community").alias("c")).agg(F.sum("weight").alias("d"))
    m = edges.agg(F.sum("weight").alias("m"))
    return d.join(inside, "c", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


