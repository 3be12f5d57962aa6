"""Media columns with content-defined chunking.

A payload is stored as 8-bit samples of a WAV file. A rolling gear hash cuts the file's bytes into chunks; chunks
that occur more than once in the corpus are stored once, found by joining their digests, and every file is an
ordered list of chunk digests. Reading puts the files together from the chunks and verifies each digest.

A pack (the row of one file) holds the chunks that only this file has, so that a corpus with few repeats moves few
bytes. Which digests repeat is told to all tasks by a bit table of fixed size; a digest that shares its bit with a
repeated one is moved to the shared chunks too, which costs a little space and changes no result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, steps, table, trimmed

UNIT = 64
LEAST, MASK_BITS, MOST = 2048, 13, 65536
#: Bits of the table of repeated digests (2 MiB for every task, whatever the corpus holds).
TABLE_BITS = 24


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zeros up to the next positive multiple of UNIT."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples; the format ends at 4 GiB, a binary value of Spark at 2."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a file that wav() made."""
    size = struct.unpack_from("<I", media, 40)[0]
    if media[:4] != b"RIFF" or media[36:40] != b"data" or size != len(media) - 44:
        raise ValueError("not a WAV file of this module")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the hash of the last 32 bytes has MASK_BITS leading zeros, LEAST to MOST bytes apart."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # after each step h covers twice as many bytes
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at, i = [], 0, 0
    while n - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        at = min(at + MOST, n, int(marks[i]) if i < len(marks) else n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(data):
        out.append(data[at:end])
        at = end
    return out


def feature(payload: bytes) -> str:
    """Mean, deviation, crossings of the middle and peak of the samples."""
    x = np.frombuffer(payload, np.uint8)
    mid = x.astype(np.int16) - 128
    return f"mean={x.mean():.6f};std={x.std():.6f};crossings={int((np.diff(mid >= 0)).sum())};peak={int(np.abs(mid).max())}"


_BITS = T.StructType([T.StructField("key", T.LongType())])
_PACK = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("digests", T.ArrayType(T.BinaryType())),
    T.StructField("lens", T.ArrayType(T.IntegerType())),
    T.StructField("own", T.BinaryType()),
    T.StructField("shared", T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("data", T.BinaryType())]))),
]
_SHARED = pa.list_(pa.struct([("ord", pa.int32()), ("digest", pa.binary()), ("data", pa.binary())]))


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "little") & ((1 << TABLE_BITS) - 1)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        for at, n in steps(b.column(column)):
            part = b.slice(at, n)
            yield part, [x or b"" for x in part.column(column).to_pylist()]


def repeated(texts: DataFrame) -> np.ndarray:
    """The bit table of the digests that occur more than once; texts has the one column text (binary).

    Bytes stay where they are: only 8 bytes of each chunk's digest are counted."""

    @trimmed
    def run(batches):
        for _, own in _texts(batches, 0):
            keys = [int.from_bytes(hashlib.sha256(c).digest()[:8], "little", signed=True) for t in own for c in chunks(wav(payload_of(t)))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    many = texts.mapInArrow(run, _BITS).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit = F.col("key").bitwiseAND((1 << TABLE_BITS) - 1)
    words = many.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key & 63 AS INT))")).alias("bits"))
    out = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    t = words.toArrow()  # 2^(TABLE_BITS - 6) rows at most
    out[t.column(0).to_numpy()] = t.column(1).to_numpy()
    return out.view(np.uint64)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stores each text's media: (packs, shared chunks), written to the shared folder.

    Equal chunks of several files are stored once; a join with the first occurrence of each digest picks the one."""
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    known = repeated(source.select("text"))

    @trimmed
    def run(batches):
        for part, own in _texts(batches, 2):
            rows, sent = [], set()
            for t in own:
                parts = chunks(wav(payload_of(t)))
                digests = [hashlib.sha256(c).digest() for c in parts]
                far = [bool(known[(b := _bit(d)) >> 6] >> np.uint64(b & 63) & np.uint64(1)) for d in digests]
                shared = []
                for i, (c, d, f) in enumerate(zip(parts, digests, far, strict=True)):
                    if f:
                        shared.append({"ord": i, "digest": d, "data": None if d in sent else c})
                        sent.add(d)
                rows.append((len(t), digests, [len(c) for c in parts], b"".join(c for c, f in zip(parts, far, strict=True) if not f), shared))
            cols = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), _SHARED]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)] + [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

    schema = T.StructType([source.schema[0], source.schema[1], *_PACK])
    packs = staged(source.mapInArrow(run, schema), "media-packs")
    found = packs.select("rid", F.explode("shared").alias("s")).select("rid", "s.ord", "s.digest", "s.data").where("data IS NOT NULL")
    first = found.groupBy("digest").agg(F.min(F.struct("rid", "ord")).alias("f")).select(F.col("digest").alias("d"), F.col("f.rid").alias("r"), F.col("f.ord").alias("o"))
    kept = found.join(first, (F.col("rid") == F.col("r")) & (F.col("ord") == F.col("o")) & (F.col("digest") == F.col("d")), "left_semi")
    return packs, staged(kept.select("digest", "data"), "media-chunks")


_READ = [
    T.StructField("n_bytes", T.LongType(), False),
    T.StructField("payload_bytes", T.LongType(), False),
    T.StructField("payload_sha256", T.StringType(), False),
    T.StructField("tail_crc32", T.LongType(), False),
    T.StructField("media_bytes", T.LongType(), False),
    T.StructField("media_sha256", T.StringType(), False),
    T.StructField("feature", T.StringType(), False),
]


def load(packs: DataFrame, shared: DataFrame, media: bool = False) -> DataFrame:
    """Files put together from their chunks, each chunk verified against its digest: key and the columns of _READ, and the bytes if media is set.

    A chunk that is missing or has other bytes than its digest says raises an error."""
    refs = packs.select("rid", F.explode("shared").alias("s")).select("rid", "s.ord", "s.digest")
    data = refs.join(shared, "digest").groupBy("rid").agg(F.collect_list(F.struct("ord", "data")).alias("got"))
    plain = packs.where(F.size("shared") == 0).drop("shared").withColumn("got", F.lit(None).cast(data.schema["got"].dataType))
    mixed = packs.where(F.size("shared") > 0).drop("shared").join(data, "rid", "left")
    both = plain.unionByName(mixed).drop("rid").select("key", "n_bytes", "digests", "lens", "own", "got")
    schema = T.StructType([both.schema[0], *_READ] + ([T.StructField("media", T.BinaryType())] if media else []))

    @trimmed
    def run(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                n, digests, lens, own, got = (b.column(c)[i].as_py() for c in range(1, 6))
                far, parts, at = {x["ord"]: x["data"] for x in got or []}, [], 0
                for o, (d, k) in enumerate(zip(digests, lens, strict=True)):
                    if o in far:
                        c = far[o]
                    else:
                        c, at = own[at : at + k], at + k
                    if hashlib.sha256(c).digest() != d:
                        raise ValueError("a chunk's bytes don't have its digest")
                    parts.append(c)
                whole = b"".join(parts)
                p = samples(whole)
                rows.append([n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(whole), hashlib.sha256(whole).hexdigest(), feature(p)] + ([whole] if media else []))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 7 + media]
    return both.mapInArrow(run, schema)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", media: bool = False) -> DataFrame:
    """Stores the texts of docs as media and reads them back: one row for each row of docs.

    A null text is empty; empty texts have a payload of UNIT zeros; repeated rows each have a file, made of the same
    chunks; a null key stays null; an empty table gives an empty result. Other columns of docs are left out."""
    packs, shared = store(docs, key, text)
    return load(packs, shared, media).withColumnRenamed("key", key)


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
