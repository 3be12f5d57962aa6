"""A stored vector index: inverted lists by nearest centroid, some lists probed for each query, exact similarities within them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that the centroids are fitted on at most, lists at most, rounds of fitting.
SAMPLE, LISTS, ROUNDS = 20_000, 2048, 10

#: Share of the true nearest ten that the probed lists must hold, over so many sample rows as queries.
TARGET, TRIED = 0.98, 500

#: Vectors of a part, queries that meet a part at a time, and rows that are taken from a batch at a time.
PART, BLOCK, STEP = 8192, 256, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _centroids(rows: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from evenly picked rows; a list that gets no row keeps its centroid."""
    c = rows[np.linspace(0, len(rows) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(rows[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(rows), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, rows)
        full = np.bincount(own, minlength=lists) > 0
        c[full] = _unit(sums[full])
    return c


def _probes(rows: np.ndarray, centroids: np.ndarray) -> int:
    """How many lists must be probed so that TARGET of the nearest ten of a sample row are found among the sample.

    Neighbours in all vectors are nearer than those in the sample, so that fewer lists hold them: the number errs upwards."""
    q = rows[:: max(1, len(rows) // TRIED)][:TRIED]
    own = np.concatenate([(rows[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(rows), 4096)])
    nearest = np.argsort(-(q @ rows.T), axis=1, kind="stable")[:, :10]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list among those of a query
    needed = np.sort(np.take_along_axis(place, own[nearest], axis=1).reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _given(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the vectors that have a direction."""
    some = vectors.where(F.size(F.filter(F.col(vector), lambda x: x != 0)) > 0)
    return some.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))


def _listed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, vector of length 1, list): each vector with the list of its nearest centroid."""
    kind = vectors.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                x = _unit(_matrix(part.column(1)))
                own = (x @ centroids.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), _rows(x), pa.array(own)], names=["key", "v", "list"])

    return vectors.mapInArrow(run, f"key {kind}, v array<double>, list int")


def _rows(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _dealt(sizes: list[int]) -> list[tuple[int, int]]:
    """(first part, number of parts) of each list: small lists share a part of some PART vectors, large ones have several."""
    out, part, held = [], 0, 0
    for n in sizes:
        if held and held + n > PART:
            part, held = part + 1, 0
        several = max(1, -(-n // PART))
        out.append((part, several))
        part, held = (part + several, 0) if several > 1 else (part, held + n)
    return out


def _asked(queries: DataFrame, centroids: np.ndarray, dealt: list[tuple[int, int]], probes: int | None) -> DataFrame:
    """(part, key, v of length 1, lists): each query once for each part that holds one of the lists it probes; all of them without probes."""
    kind = queries.schema["key"].dataType.simpleString()
    parts = sum(dealt[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                some = b.slice(at, STEP)
                x = _unit(_matrix(some.column(1)))
                part, row, lists = [], [], []
                if probes is None:
                    part, row = np.tile(np.arange(parts), len(x)).tolist(), np.repeat(np.arange(len(x)), parts).tolist()
                    lists = [[]] * len(part)
                else:
                    best = np.argpartition(-(x @ centroids.T), probes - 1, axis=1)[:, :probes] if probes < len(centroids) else np.tile(np.arange(len(centroids)), (len(x), 1))
                    for i, own in enumerate(np.sort(best, axis=1).tolist()):
                        to: dict[int, list[int]] = {}
                        for c in own:
                            for p in range(dealt[c][0], sum(dealt[c])):
                                to.setdefault(p, []).append(c)
                        part += to
                        row += [i] * len(to)
                        lists += to.values()
                for lo in range(0, len(part), STEP):
                    own = np.array(row[lo : lo + STEP], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part[lo : lo + STEP], pa.int32()), some.column(0).take(pa.array(own)), _rows(x[own]), pa.array(lists[lo : lo + STEP], pa.list_(pa.int32()))], names=["part", "key", "v", "lists"])

    return queries.mapInArrow(run, f"part int, key {kind}, v array<double>, lists array<int>")


def build(vectors: DataFrame, path: str, key: str = "id", vector: str = "embedding") -> None:
    """Writes all vectors to path, each in the list of its nearest centroid, and the centroids with the lists to probe
    and the parts that a list's vectors are dealt to.

    Centroids are fitted on the SAMPLE rows of smallest hash at most; there are as many as the square root of the
    vectors, up to LISTS. Null, empty and zero vectors aren't in the index."""
    own = _given(vectors, key, vector)
    n = own.count()
    some = own.select(F.xxhash64("key").alias("h"), "v").orderBy("h", "v").limit(SAMPLE).collect()
    rows = _unit(np.array([r.v for r in some], np.float64)) if some else np.zeros((0, 1))
    c = _centroids(rows, max(1, min(LISTS, len(rows), math.isqrt(n)))) if some else rows
    spark = vectors.sparkSession
    probes = _probes(rows, c) if len(rows) else 0
    _listed(own, c).write.mode("overwrite").parquet(f"{path}/vectors")
    sizes = dict(spark.read.parquet(f"{path}/vectors").groupBy("list").count().collect()) if some else {}  # LISTS rows at most
    dealt = _dealt([sizes.get(i, 0) for i in range(len(c))])
    held = [(i, [float(x) for x in row], probes, *at) for i, (row, at) in enumerate(zip(c, dealt, strict=True))]
    spark.createDataFrame(held, "list int, v array<double>, probes int, part int, parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def _best(s: np.ndarray, top: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the top of each row by six decimals, ties by order; what is -inf is left out."""
    least = -np.partition(-s, top - 1, axis=1)[:, top - 1 : top] if s.shape[1] > top else np.full((len(s), 1), -2.0)
    row, col = np.nonzero((s >= least - 2e-6) & (s > -2))
    v = s[row, col]
    at = np.lexsort((order[col], -np.copysign(np.floor(np.abs(v) * 1e6 + 0.5), v), row))
    row, col = row[at], col[at]
    begin = np.searchsorted(row, np.arange(len(s)))
    some = np.arange(len(row)) - begin[row] < top
    return row[some], col[some]


def search(spark: SparkSession, path: str, queries: DataFrame, top: int, exact: bool = False, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query, rank, key, score): the top vectors by cosine similarity for every query (key, vector), ties by key.

    As many lists are probed for each query as the index says; exact searches all of them. A query goes once to each part
    of some PART vectors that it needs, where blocks of queries and vectors are multiplied and the top of each part go on,
    so what moves are queries by parts, not pairs. Scores have six decimals."""
    held = sorted(spark.read.parquet(f"{path}/centroids").collect())  # LISTS rows at most
    kind = queries.schema[key].dataType.simpleString()
    if not held:
        return spark.createDataFrame([], f"query {kind}, rank int, key {kind}, score double")
    dealt = [(r.part, r.parts) for r in held]
    asked = _asked(_given(queries, key, vector), np.array([r.v for r in held]), dealt, None if exact else held[0].probes)
    lists = spark.read.schema(f"key {kind}, v array<double>, list int").parquet(f"{path}/vectors")
    first, several = (F.array(*[F.lit(x) for x in xs])[F.col("list")] for xs in zip(*dealt, strict=True))
    stored = lists.select((first + F.pmod(F.xxhash64("key"), several)).cast("int").alias("part"), F.lit(0).alias("side"), "key", "v", F.array("list").alias("lists"))
    both = stored.unionByName(asked.withColumn("side", F.lit(1))).repartition("part").sortWithinPartitions("part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, vecs, owns, ready = None, [], [], [], False
        for b in batches:
            part, side = (b.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (side[1:] != side[:-1])))) if len(part) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(part)], strict=True):
                if part[lo] != now:
                    now, keys, vecs, owns, ready = part[lo], [], [], [], False
                if side[lo] == 0:
                    own = b.slice(lo, hi - lo)
                    keys.append(own.column(2))
                    vecs.append(_matrix(own.column(3)))
                    owns.append(own.column(4).flatten().to_numpy())
                    continue
                if not vecs:
                    continue
                if not ready:
                    all_keys, v, own_list, ready = pa.concat_arrays(keys), np.concatenate(vecs), np.concatenate(owns), True
                    order = np.empty(len(all_keys), np.int64)
                    order[pc.sort_indices(all_keys).to_numpy()] = np.arange(len(all_keys))
                for at in range(lo, hi, BLOCK):
                    q = b.slice(at, min(BLOCK, hi - at))
                    s = _matrix(q.column(3)) @ v.T
                    if not exact:
                        wanted = np.zeros((len(s), len(held_lists)), bool)
                        mine = q.column(4)
                        wanted[np.repeat(np.arange(len(s)), pc.list_value_length(mine).to_numpy()), mine.flatten().to_numpy()] = True
                        s[~wanted[:, own_list]] = -np.inf
                    row, col = _best(s, top, order)
                    yield pa.RecordBatch.from_arrays([q.column(2).take(pa.array(row)), all_keys.take(pa.array(col)), pa.array(s[row, col])], names=["query", "key", "score"])

    held_lists = range(len(held))
    found = both.mapInArrow(run, f"query {kind}, key {kind}, score double").withColumn("score", F.round("score", 6))
    best = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query", "rank", "key", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, hits, wanted, recall) of the keys found against the exact ones."""
    both = exact.select("query", "key").join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    g = both.groupBy("query").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count(F.lit(1)).alias("wanted"))
    return g.withColumn("recall", F.col("hits") / F.col("wanted"))
