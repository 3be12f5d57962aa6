"""A stored full-text index: postings in blocks with the largest part of each, and the best documents of many queries at once.

Documents are dealt to ranges by the hash of their key; a block is a term's postings in one range, so blocks are bounded
whatever a term's frequency. A range is in one place from its texts to its blocks and again in a search, so what moves are
texts once when the index is made, and the blocks of asked terms once when it is asked. What a range can give a query at most
is the sum of its blocks' largest parts. The ranges that promise most are scored first; their last place that counts says
which of the others can still matter, and only their blocks are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .algorithms import saved

#: Documents of a range, and queries that a block is sent for once.
RANGE, GROUP = 1024, 1024


def build(docs: DataFrame, path: str, key: str = "id", text: str = "text", k1: float = 1.2, b: float = 0.75, size: int = RANGE) -> None:
    """Writes the index of docs to path: blocks (term, range, keys, parts, most) and terms (term, idf).

    Null texts and texts without tokens aren't in it. A posting holds its key and the part of the score that doesn't
    depend on the query (Robertson and Zaragoza's BM25, without the term's rarity)."""
    n, mean = docs.select(F.size(X.tokens(F.col(text))).alias("n")).where("n > 0").agg(F.count(F.lit(1)), F.avg("n")).first()
    ranges = max(1, -(-n // size))
    dealt = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int").alias("range")).repartition("range")
    toks = dealt.select("key", "range", X.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    tf = toks.select("range", "key", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("range", "key", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean or 1))))
    postings = tf.select("term", "range", F.struct("key", part.alias("part")).alias("doc"))
    blocks = postings.groupBy("range", "term").agg(F.sort_array(F.collect_list("doc")).alias("docs"), F.max("doc.part").alias("most"))
    blocks.select("term", "range", F.col("docs.key").alias("keys"), F.col("docs.part").alias("parts"), "most").sortWithinPartitions("term", "range").write.mode("overwrite").parquet(f"{path}/blocks")
    df = docs.sparkSession.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum(F.size("keys")).alias("df"))
    df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")


def _scored(ranges: DataFrame, wanted: DataFrame, blocks: DataFrame, top: int) -> DataFrame:
    """(query, range, key, score): the best documents of each query in each of its ranges.

    A block is sent to the place of its range once for GROUP queries, and meets there those that ask for both its term and its range."""
    group = F.pmod(F.xxhash64("query"), F.lit(wanted.select(F.count_distinct("query")).first()[0] // GROUP + 1)).alias("group")
    asked = ranges.select("range", "query", group).groupBy("range", "group").agg(F.collect_list("query").alias("own"))
    terms = wanted.groupBy("term", group).agg(F.first("idf").alias("idf"), F.collect_list("query").alias("queries"))
    opened = blocks.select("range", "term", "keys", "parts").join(F.broadcast(ranges.select("range").distinct()), "range", "left_semi")  # a number for each range
    hits = opened.join(terms, "term").join(asked, ["range", "group"]).select("range", "group", "idf", "keys", "parts", F.explode(F.array_intersect("queries", "own")).alias("query"))
    scores = hits.select("range", "group", "query", "idf", F.explode(F.arrays_zip("keys", "parts")).alias("d")).groupBy("range", "group", "query", F.col("d.keys").alias("key")).agg(F.round(F.sum(F.col("idf") * F.col("d.parts")), 6).alias("score"))
    nth = F.row_number().over(W.partitionBy("range", "group", "query").orderBy(F.desc("score"), "key"))
    return scores.where("score > 0").withColumn("nth", nth).where(F.col("nth") <= top).select("query", "range", "key", "score")


def promised(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms of queries (query, text) that the index has, with their rarity, and (query, range, at_most)."""
    q = queries.select("query", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    wanted = q.join(spark.read.parquet(f"{path}/terms"), "term")
    blocks = spark.read.parquet(f"{path}/blocks")
    promise = wanted.join(blocks.select("term", "range", "most"), "term").groupBy("query", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("at_most"))
    return wanted, promise


def search(spark: SparkSession, path: str, queries: DataFrame, top: int, first: int = 2) -> DataFrame:
    """(query, rank, key, score): the top documents of every query (query, text), ties by key; queries without a hit have no row.

    Exact: a range is left out only if it can give no score of the last place found in the first ranges."""
    wanted, promise = promised(spark, path, queries)
    blocks = spark.read.parquet(f"{path}/blocks")
    promise = saved(promise.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy(F.desc("at_most"), "range"))))
    wanted = saved(wanted)
    best = W.partitionBy("query").orderBy(F.desc("score"), "key")
    begun = saved(_scored(promise.where(F.col("nth") <= first), wanted, blocks, top))
    least = begun.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == top).select("query", F.col("score").alias("least"))
    rest = promise.where(F.col("nth") > first).join(least, "query", "left").where(F.col("least").isNull() | (F.col("at_most") + 1e-6 >= F.col("least")))
    both = begun.unionByName(_scored(rest, wanted, blocks, top))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query", "rank", "key", "score")
