"""What the corpus operators share: staged tables, bounded Arrow batches, byte tokenisers and rolling hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Bytes of text that one numpy step works on, so that its arrays stay small whatever an Arrow batch holds.
STEP_BYTES = 1 << 20

#: Bytes of text whose postings a shuffle partition holds, at first and at most, and the partitions beyond which they grow.
PART_BYTES, LARGE_PART, MANY_PARTS = 4 << 20, 64 << 20, 4096

_own: dict[str, str] = {}
_written: list[str] = []


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, as a batch of long documents must fit into a Python worker beside the JVM; and the package for the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    ship(spark)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset and
    the driver runs the tasks itself. On a cluster without that setting this is an error: no local folder is shared there."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = sc.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="plenaria-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        sc.setCheckpointDir(_own[app])
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written() -> int:
    """How many tables this driver's calls have written so far."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes what this driver's calls wrote to the shared folder after the first `since` tables, but for those of the
    names in keep; results that still read it must be saved before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in _written[since:] if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in keep]
    for p in gone:
        _written.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage, and a lost executor loses none of it.

    The shuffle files of the write go as soon as it ends."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        # Small row groups: a writer holds one in memory, beside the Python workers.
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(docs: DataFrame, text: str) -> int:
    """Partitions for shuffles of what is gathered from the texts, by their counted bytes: so many that one holds PART_BYTES
    of text, up to LARGE_PART where that would be more than MANY_PARTS; no fewer than the session's."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    per = min(max(PART_BYTES, -(-size // MANY_PARTS)), LARGE_PART)
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // per))


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of df that don't clash with result columns; a result column replaces an input column of its name."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def trimmed(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives its memory back when its task ends: idle workers stay beside the JVM."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run


def map_text(
    df: DataFrame,
    text: str,
    keep: list[str],
    fields: list[T.StructField],
    work: Callable[..., list[pa.Array]],
    also: str | None = None,
) -> DataFrame:
    """One row out for each row in: the kept columns, then what work returns for the texts.

    work gets the UTF-8 bytes of at most about STEP_BYTES of texts (one text, however long, is never cut); null is empty.
    With also it gets the strings of that column beside them, null as empty."""
    more = [F.coalesce(F.col(f"`{also}`").cast("string"), F.lit("")).alias("__also__")] if also else []
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text__"), *more)
    schema = T.StructType([source.schema[i] for i in range(len(keep))] + fields)
    beside = len(more)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for at, n in steps(texts):
                given = [[x or b"" for x in texts.slice(at, n).to_pylist()]] + [batch.column(len(keep) + 1).slice(at, n).to_pylist() for _ in range(beside)]
                own = work(*given)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, n) for i in range(len(keep))] + own, names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive slices of at most STEP_BYTES, or of one row."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + STEP_BYTES, "right")))
        yield at, to - at
        at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words: at i the run that starts there; empty if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return mixed(out)


#: A-Z become lower case and ASCII white space becomes a space; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))

_BASE = np.uint64(0xD6E8FEB86659FD93)
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    if len(_powers[0]) < n:
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words between spaces, where they start), without making a string of any word.

    The hash of a word is a polynomial in the base over a table of its bytes, taken from prefix sums over all bytes."""
    hashes, places, at = [], [], 0
    while at < len(data):
        to = len(data)
        if to - at > STEP_BYTES:  # blocks end at a space; a longer word is a block of its own
            to = data.rfind(b" ", at, at + STEP_BYTES) + 1
            if to <= at:
                to = (data.find(b" ", at) + 1) or len(data)
        c = np.frombuffer(data, np.uint8, to - at, at)
        word = np.zeros(len(c) + 2, np.int8)
        word[1:-1] = c != 32
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power_tables(len(c))
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(_VALUES[c] * up[: len(c)], out=sums[1:])
        h = (sums[end] - sums[start]) * down[start]
        hashes.append(mixed(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        places.append(start + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


class Batch:
    """The words of several texts as one array of hashes, with the place where each text starts.

    fold maps each byte to itself, its lower case, or a space between words."""

    def __init__(self, texts: list[bytes], fold: bytes = LOWER):
        self.hashes, at = word_hashes(b" ".join([t.translate(fold) for t in texts]))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.starts = np.concatenate(([0], np.searchsorted(at, ends)))
        self.counts = np.diff(self.starts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words inside a text, and where they start."""
        h = gram_hashes(self.hashes, k)
        if not len(h):
            return h, np.empty(0, np.int64)
        inside = np.zeros(len(self.hashes) + 1, np.int32)
        ok = self.counts >= k
        np.add.at(inside, self.starts[:-1][ok], 1)
        np.add.at(inside, (self.starts[1:] - k + 1)[ok], -1)
        at = np.flatnonzero(np.cumsum(inside[:-1])[: len(h)] > 0)
        return h[at], at

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def minimizers(h: np.ndarray, at: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Which k-mers are the smallest of a window of span consecutive ones of one text (all, if several are equal)."""
    n = len(h)
    if n < span:
        return np.zeros(n, bool)
    low, width = h.copy(), 1
    while width < span:  # low[i]: the least of width k-mers from i
        step = min(width, span - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    whole = (at[span - 1 :] - at[: n - span + 1] == span - 1) & (owner[span - 1 :] == owner[: n - span + 1])
    low = np.where(whole, low, 0)
    high, width = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64))), 1
    while width < span:  # high[i]: the greatest of the least of the windows that hold k-mer i
        step = min(width, span - width)
        high = np.maximum(high[: len(high) - step], high[step:])
        width += step
    return high[:n] == h


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Spark's bigint."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))
