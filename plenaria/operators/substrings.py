"""Which of many keys stand in which texts, inside words too, as a join: no table of keys goes through the driver or to every task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .algorithms import saved

#: Code points of a gram; a shorter key is a gram of its own length.
GRAM = 6
#: A bit table of grams has 2 to this many bits (2 MiB). A full table lets more grams through to the join, which tells them apart.
BITS = 24
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _grams(text: str, length: int) -> np.ndarray:
    """64-bit hashes of the grams of a length in a text, one for each place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for i in range(length):
        h = h * _ODD + codes[i : i + n] + np.uint64(1)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _places(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _key_grams(keys: pd.Series) -> pd.Series:
    """The distinct grams of a key that isn't empty."""
    return pd.Series([np.unique(_grams(k, min(len(k), GRAM))).view(np.int64) for k in keys], dtype=object)


def _text_grams(grams: DataFrame, lengths: list[int]) -> Callable[[Column], Column]:
    """A function of texts to their distinct grams that the table (gram) may hold; BITS bounds what the driver gets and sends."""
    spark = grams.sparkSession
    place = F.col("gram").bitwiseAND((1 << BITS) - 1)
    words = grams.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(gram & 63 AS INT))")).alias("bits")).toPandas()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("array<long>")
    def found(texts: pd.Series) -> pd.Series:
        table, out = sent.value, []
        for t in texts:
            h = np.unique(np.concatenate([_grams(t, n) for n in lengths]))
            at = _places(h)
            out.append(h[(table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1].view(np.int64))
        return pd.Series(out, dtype=object)

    return found


def keys_in_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(tid, key) for every key of keys (key) that texts (tid, text) hold, both distinct; null and empty keys and null texts are left out.

    Each key is found by its anchor: of its grams the one that the fewest texts hold. Grams of texts that no key has end in
    the task that makes them, at a bit table of fixed size; the others are joined by hash, and every pair is held against
    the whole text. A frequent gram is no key's anchor unless the key has no rarer one."""
    texts = texts.where("text IS NOT NULL")
    grams = saved(keys.where("key <> ''").select("key", F.explode(_key_grams("key")).alias("gram")))
    lengths = [r[0] for r in grams.select(F.least(F.length("key"), F.lit(GRAM))).distinct().collect()]  # GRAM rows at most
    if not lengths:
        return texts.select("tid", F.lit("").alias("key")).where(F.lit(False))
    of = _text_grams(grams, lengths)
    counts = texts.select(F.explode(of(F.col("text"))).alias("gram")).groupBy("gram").count()
    rarest = F.min_by(F.struct("gram", "count"), F.struct("count", "gram"))
    # A key with a gram that no text holds is in none.
    counted = grams.join(counts, "gram", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    anchors = saved(counted.groupBy("key").agg(rarest.alias("a")).where("a.count > 0").select("key", F.col("a.gram").alias("gram")))
    of = _text_grams(anchors, lengths)
    met = texts.select("tid", F.explode(of(F.col("text"))).alias("gram")).join(anchors, "gram").select("tid", "key")
    return met.join(texts, "tid").where(F.contains("text", "key")).select("tid", "key")
