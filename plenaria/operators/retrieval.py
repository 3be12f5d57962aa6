"""Full-text and vector retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def inverted_index(docs: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((term, key, tf), (key, length)) of documents that have tokens."""
    toks = docs.select(key, X.tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    return toks.select(key, F.explode("t").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf")), toks.select(key, F.size("t").alias("length"))


def bm25(docs: DataFrame, terms: list[str], top: int, key: str = "id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the best documents for any of the terms (Robertson and Zaragoza's BM25), ties by key."""
    toks = docs.select(key, X.tokens(F.col(text)).alias("t")).where(F.size("t") > 0)
    hits = toks.select(key, F.size("t").alias("length"), F.explode(F.filter("t", lambda w: w.isin(terms))).alias("term"))
    tf = hits.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = toks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    s = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total)).groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))  # a row for each term, and one row
    return s.where("score > 0").orderBy(F.desc("score"), key).limit(top)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], top: int = 6, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The vectors of largest cosine similarity to one query vector; one pass, only top rows of each task move."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector).isNotNull()).select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(top)


def stale(segments: DataFrame, model: str) -> DataFrame:
    """Segments that need a vector: none yet, or one of another model; empty texts need none."""
    return segments.where((F.coalesce(F.trim("text"), F.lit("")) != "") & (F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))))


def embedded(segments: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, batch: int = 64) -> DataFrame:
    """(id, embedding, embedding_model) of segments (id, text) by a function from texts to vectors, in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": embed(part["text"].tolist()), "embedding_model": model})

    return segments.select("id", "text").mapInPandas(run, "id string, embedding array<float>, embedding_model string")
