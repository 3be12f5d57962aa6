"""Benchmark decontamination by winnowing.

Of every run of k-grams that a shared span of the window's length must hold, the smallest hash is kept on both
sides; equal fingerprints of a document and a benchmark item are joined and extended word by word. A shared span
of `window` words has window - k + 1 k-grams in common, and both sides keep the same one of them, so no such
span is missed. Items shorter than the window are one span of their own length, matched by their one n-gram.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batch, map_text, minimizers, signed, staged, steps, table, trimmed, without

#: Bytes below 128 that are no word characters become a space, A-Z become lower case, other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text up to which every task gets the whole index; a larger benchmark is joined by a shuffle.
BROADCAST_BYTES = 4 << 20

FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("n_items", T.LongType(), False),
    T.StructField("item_ids", T.ArrayType(T.StringType()), False),
    T.StructField("items_sha256", T.StringType(), False),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), False),
    T.StructField("contaminated", T.BooleanType(), False),
]


def winnowed(batch: Batch, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and where they start: the smallest k-gram hashes of every window inside a text."""
    h, at = batch.grams(k)
    keep = minimizers(h, at, batch.text_of(at), window - k + 1)
    return h[keep], at[keep]


class Index:
    """Fingerprints of benchmark items by span length: the window, and the length of each shorter item."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, k: int):
        batch = Batch([t for _, t in items], _FOLD)
        self.ids, self.window, self.k = [i for i, _ in items], window, k
        self.items = [batch.hashes[a:b] for a, b in zip(batch.starts[:-1], batch.starts[1:], strict=True)]
        self.posts: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        h, at = winnowed(batch, window, k)
        for fp, p, i in zip(h.tolist(), at.tolist(), batch.text_of(at).tolist(), strict=True):
            self.posts[window][fp].append((i, p - int(batch.starts[i])))
        for n in sorted({len(w) for w in self.items if 0 < len(w) < window}):
            h, at = batch.grams(n)
            for fp, i in zip(h.tolist(), batch.text_of(at).tolist(), strict=True):
                if len(self.items[i]) == n:
                    self.posts[n][fp].append((i, 0))
        self.keys = {n: np.array(sorted(p), np.uint64) for n, p in self.posts.items()}

    def hits(self, batch: Batch) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end) of each span of a text that an item has too, at least as long as the item's window."""
        for n, keys in self.keys.items():
            h, at = winnowed(batch, n, self.k) if n == self.window else batch.grams(n)
            near = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = np.flatnonzero(keys[near] == h)
            done: dict[tuple[int, int, int], int] = {}
            for fp, p, d in zip(h[found].tolist(), at[found].tolist(), batch.text_of(at[found]).tolist(), strict=True):
                lo, hi = int(batch.starts[d]), int(batch.starts[d + 1])
                for i, q in self.posts[n][fp]:
                    if done.get((d, i, p - q), -1) > p:
                        continue
                    item, doc = self.items[i], batch.hashes
                    a, b = 0, 0
                    if n == self.window:
                        back, ahead = min(p - lo, q), min(hi - p, len(item) - q)
                        same = doc[p - back : p] == item[q - back : q]
                        a = int(np.argmin(same[::-1])) if not same.all() else back
                        same = doc[p : p + ahead] == item[q : q + ahead]
                        b = int(np.argmin(same)) if not same.all() else ahead
                    elif (doc[p : p + n] == item).all():
                        b = n
                    done[d, i, p - q] = p + b
                    if a + b >= n:
                        yield d, i, p - a - lo, p + b - lo


def _report(counts: np.ndarray, hits: list[tuple[int, str | None, int, int]]) -> list[pa.Array]:
    marks = [None] * len(counts)
    items: list[set[str]] = [set() for _ in counts]
    for d, name, a, b in hits:
        if marks[d] is None:
            marks[d] = np.zeros(counts[d] + 1, np.int32)
        marks[d][a] += 1
        marks[d][b] -= 1
        if name is not None:
            items[d].add(name)
    n_hit, spans = [], []
    for m in marks:
        if m is None:
            n_hit.append(0)
            spans.append([])
            continue
        on = np.concatenate(([0], (np.cumsum(m) > 0).astype(np.int8), [0]))
        a, b = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
        n_hit.append(int((b - a).sum()))
        spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    names = [sorted(x) for x in items]
    return [
        pa.array(counts, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in names], pa.int64()),
        pa.array(names, pa.list_(pa.string())),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array([n > 0 for n in n_hit]),
    ]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, k: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids, items_sha256, spans (of hit words) and contaminated.

    A benchmark of up to broadcast_bytes of text goes to every task as an index, so documents are not shuffled; a
    larger one is joined with the documents' fingerprints by a shuffle, with the same results.
    Null and empty texts have no words and no hits; null and empty items have no window; repeated rows each get their
    result; an item without an id marks words but isn't counted; equal ids count once. An empty table on either side
    is allowed. Columns of docs named like result columns are replaced."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("item"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 16), F.lit(0))).first()[0]
    keep = without(docs, [f.name for f in FIELDS])
    if size > broadcast_bytes:
        return _joined(docs, items, text, keep, window, k)
    index = Index([(r[0], bytes(r[1])) for r in items.collect()], window, k)

    def work(texts: list[bytes]) -> list[pa.Array]:
        batch = Batch(texts, _FOLD)
        return _report(batch.counts, [(d, index.ids[i], a, b) for d, i, a, b in index.hits(batch)])

    index.posts = {n: dict(p) for n, p in index.posts.items()}
    return map_text(docs, text, keep, FIELDS, work)


def _fingerprints(df: DataFrame, key: str, text: str, window: int, k: int, lengths: list[int]) -> DataFrame:
    """(key, n, fp): distinct fingerprints of each text, for spans of the window (n = window) and of the shorter lengths."""
    source = df.select(key, F.col(text).cast("binary").alias("t"))
    schema = T.StructType([source.schema[0], T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType())])

    @trimmed
    def run(batches):
        for b in batches:
            for at, count in steps(b.column(1)):
                keys = b.column(0).slice(at, count)
                batch = Batch([x or b"" for x in b.column(1).slice(at, count).to_pylist()], _FOLD)
                for n in [window, *lengths]:
                    h, p = winnowed(batch, n, k) if n == window else batch.grams(n)
                    d = batch.text_of(p)
                    one = np.unique(np.stack([d.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(one[0].astype(np.int64))), pa.array(np.full(one.shape[1], n, np.int32)), signed(one[1])], names=schema.names)

    return source.mapInArrow(run, schema)


def _joined(docs: DataFrame, items: DataFrame, text: str, keep: list[str], window: int, k: int) -> DataFrame:
    """The same for a benchmark of any size: candidate (document, item) pairs by a shuffle join of fingerprints."""
    docs = staged(docs.select(*keep, *([] if text in keep else [text])).withColumn("__rid__", F.monotonically_increasing_id()), "winnow-docs")
    items = staged(items.withColumn("iid", F.monotonically_increasing_id()), "winnow-items")
    counts = items.select(F.size(F.split(F.trim(F.regexp_replace(F.lower(F.col("item").cast("string")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), " ")).alias("n"))
    lengths = [r[0] for r in counts.where((F.col("n") < window) & (F.col("n") > 0)).distinct().collect()]  # at most window - 1 rows
    ours = _fingerprints(docs, "__rid__", text, window, k, lengths)
    theirs = _fingerprints(items, "iid", "item", window, k, lengths)
    # A fingerprint of very many documents is a key of this join alone, which Spark can split.
    pairs = ours.join(theirs, ["n", "fp"]).select("__rid__", "iid").distinct()
    found = pairs.join(items, "iid").select("__rid__", F.lit(1).alias("__kind__"), "item_id", "item")
    rows = docs.select(*keep, F.col(text).cast("binary").alias("__text__"), "__rid__", F.lit(0).alias("__kind__"))
    both = rows.unionByName(found, allowMissingColumns=True).repartition("__rid__").sortWithinPartitions("__rid__", "__kind__")
    schema = T.StructType([rows.schema[i] for i in range(len(keep))] + FIELDS)
    at = len(keep)

    @trimmed
    def run(batches):
        """A document, then its candidate items one by one."""
        head, batch, hits = None, None, []

        def done():
            return pa.RecordBatch.from_arrays([head.column(c) for c in range(at)] + _report(batch.counts, hits), names=schema.names)

        for b in batches:
            for i in range(b.num_rows):
                if b.column(at + 2)[i].as_py() == 0:
                    if head is not None:
                        yield done()
                    head, batch, hits = b.slice(i, 1), Batch([b.column(at)[i].as_py() or b""], _FOLD), []
                else:
                    index = Index([(b.column(at + 3)[i].as_py(), b.column(at + 4)[i].as_py())], window, k)
                    hits += [(0, index.ids[x], a, e) for _, x, a, e in index.hits(batch)]
        if head is not None:
            yield done()

    return both.mapInArrow(run, schema)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.r, bw.item_id, dw.i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN ids USING (r)
"""
