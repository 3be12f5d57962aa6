"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams (of its code points, A-Z in lower case) that occur in it. Each is
scaled by the log ratio of its smoothed document counts in toxic and clean training texts, and a logistic
regression is trained on the scaled presences (Wang and Manning's interpolated NBSVM, with a logistic loss).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, staged, table, without

GRAMS = (3, 4, 5)
BITS = 18
#: At most so many labelled texts of each class are used to fit, those of smallest hash.
FIT_ROWS = 2000
THRESHOLD = 0.7

FIELDS = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]


def features(text: bytes, grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> np.ndarray:
    """Sorted indices of the hashed character n-grams that occur in the text (ASCII upper case folded, white space runs as one space)."""
    folded = b" " + b" ".join(text.lower().split()) + b" "
    c = np.frombuffer(folded.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    seen = np.zeros(1 << bits, bool)
    if len(c) < 3:
        return np.empty(0, np.int32)
    h = c * np.uint32(0x9E3779B1)
    for n in range(2, max(grams) + 1):
        if len(c) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n - 1 :] * np.uint32(0xC2B2AE3D)
        if n in grams:
            seen[(h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(f: np.ndarray) -> bytes:
    """Sorted indices as compressed gaps."""
    return zlib.compress(np.diff(f, prepend=0).astype(np.uint32).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), np.uint32).astype(np.int32))


class Model:
    """intercept + the sum of the weights of a text's features, through the logistic function."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.fromiter((self.weights[features(t)].sum(dtype=np.float64) for t in texts), np.float64, len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z + self.intercept, -50, 50)))


def fit(rows: list[tuple[bytes, int]], bits: int = BITS, smooth: float = 1.0, least: float = 2.5, decay: float = 1e-3, epochs: int = 80, rate: float = 0.05) -> Model:
    """Fits rows of (packed features, label): log-count ratios, then full-batch Adagrad on the class-balanced logistic loss with an L2 penalty.

    N-grams whose ratio is less than `least` standard errors from 0 get no weight. The same rows give the same model."""
    y = np.array([label for _, label in rows], np.float64)
    if not len(y) or y.min() == y.max():  # one class only: no evidence for the other
        return Model(np.zeros(1 << bits, np.float32), 3.0 if len(y) and y[0] == 1 else -3.0)
    p, q = np.full(1 << bits, smooth), np.full(1 << bits, smooth)
    for f, label in rows:
        (p if label == 1 else q)[unpacked(f)] += 1
    ratio = np.log((p / (y.sum() + 2 * smooth)) / (q / ((1 - y).sum() + 2 * smooth)))
    ratio[np.abs(ratio) < least * np.sqrt(1 / p + 1 / q)] = 0.0
    used = np.flatnonzero(ratio)
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    r = ratio[used].astype(np.float32)
    blocks = []  # of some texts at a time, so that no array over all features of all texts is made
    for lo in range(0, len(rows), 256):
        own = [(x := place[unpacked(f)])[x >= 0] for f, _ in rows[lo : lo + 256]]
        blocks.append((lo, np.array([len(x) for x in own]), np.concatenate(own)))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(len(used)), 0.0
    gw, gb = np.full(len(used), 1e-8), 1e-8
    for _ in range(epochs):
        d, db, scaled = decay * w, 0.0, (w * r).astype(np.float32)
        for lo, n, own in blocks:
            at = np.repeat(np.arange(len(n)), n)
            z = np.bincount(at, scaled[own], minlength=len(n)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[lo : lo + len(n)]) * share[lo : lo + len(n)]
            d += np.bincount(own, g[at], minlength=len(used)) * r
            db += g.sum()
        gw += d * d
        gb += db * db
        w -= rate * d / np.sqrt(gw)
        b -= 10 * rate * db / np.sqrt(gb)
    out = np.zeros(1 << bits, np.float32)
    out[used] = w * r
    return Model(out, float(b))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) mod 3 is not 1: of each class the fit_rows of smallest hash.

    Only ids that docs has are drawn. An id of several labels is toxic if one says so; of an id's several texts one
    counts, so that repeated rows weigh nothing and no more than 2 * fit_rows rows reach the driver. Null ids and null
    labels are left out; null texts are empty; without labels of both classes every text gets the score of the one."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (held_out(F.col("doc_id")) == F.lit(False))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.join(docs.select("doc_id"), "doc_id", "left_semi")
    y = staged(y.withColumn("h", F.xxhash64("doc_id", F.lit("fit"))), "toxicity-labels")
    many = {r[0]: r[1] for r in y.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    parts = []
    for label in (0, 1):
        own = y.where(F.col("toxic") == label)
        if many.get(label, 0) > 2 * fit_rows:  # the smallest hashes are among these; the others need not be sorted
            own = own.where(F.col("h") < int(-(1 << 63) + 2.0 * fit_rows / many[label] * (1 << 64)))
        parts.append(own.orderBy("h", "doc_id").limit(fit_rows))
    some = parts[0].unionByName(parts[1])
    some = F.broadcast(some.select("doc_id", "toxic"))  # 2 * fit_rows rows at most
    rows = map_text(docs.select("doc_id", text).join(some, "doc_id"), text, ["doc_id", "toxic"], [T.StructField("f", T.BinaryType())], lambda texts: [pa.array([packed(features(t)) for t in texts], pa.binary())])
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("f").alias("f"))
    t = rows.toArrow()  # 2 * fit_rows rows at most, some kilobytes each
    found = sorted(zip(*(t.column(i).to_pylist() for i in range(3)), strict=True))
    return fit([(f, label) for _, label, f in found])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts get the score of a text without features. Texts are scored whole, rows on their own: repeated
    rows get equal scores, an empty table an empty result. Columns of docs named like result columns are replaced."""

    def work(texts: list[bytes]) -> list[pa.Array]:
        s = model.scores(texts)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return map_text(docs, text, without(docs, [f.name for f in FIELDS]), FIELDS, work)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxic(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
