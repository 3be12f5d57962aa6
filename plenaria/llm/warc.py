"""WARC archives written and read by Spark, with boundary-chain verification.

The writer turns each row into one record and lets Spark's text writer put the records one after another. The
reader lets Spark's text source split the files at the record magic, so that any task can start anywhere; a piece
between two magics is a candidate record, and its header names the offset of its successor. Payloads may hold the
magic too, so candidates are only believed if a chain of successors reaches them from the start of their file. A
task follows the chains inside a split and leaves a link from where each comes in to where it goes out; pointer jumping
over these few links doubles their reach in each round and tells where the file's own chain enters each split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, staged, table

MAGIC = "WARC/1.1\r\n"
#: Payloads of fewer bytes are always stored.
DEDUP_BYTES = 1000
#: Digests of repeated payloads up to this many are broadcast to the writer; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; control characters, which would end the line, are percent-encoded, each as its own code."""
    given = value.cast("string")
    clean = given
    for c in [*range(32), 127]:
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    clean = F.when(given.rlike(r"[\x00-\x1F\x7F]"), clean).otherwise(given)
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", dedup_bytes: int = DEDUP_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Writes one record for each row: the payload in UTF-8, or a revisit of an equal payload.

    Of the rows with equal payloads of at least dedup_bytes that of the largest key is stored; rows that repeat both
    key and payload are all stored. A null payload is empty, a null url or key has no header. Payloads may hold
    anything, the magic included."""
    body = F.coalesce(F.col(payload), F.lit(""))
    d = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    groups = d.where(F.col("n") >= dedup_bytes).groupBy("digest", "n").agg(F.count(F.lit(1)).alias("copies"), F.max("key").alias("first"))
    groups = staged(groups.where("copies > 1").select(F.col("digest").alias("g_digest"), F.col("n").alias("g_n"), "first"), "warc-groups")
    if groups.limit(broadcast_rows + 1).count() <= broadcast_rows:
        groups = F.broadcast(groups)
    d = d.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("n") == F.col("g_n")), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("key").cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("body")),
    )
    d.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _header(name: str) -> Column:
    """The value of a header line of a piece; null if it has none."""
    return F.nullif(F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics: its file, the split and place it was read from, its bytes, their hash, and its header up to the blank line.

    seq only orders the pieces of one split in one scan. Splits depend on how many cores there are just now, so a second
    scan finds pieces by file and hash: a magic ends a piece wherever splits begin."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    head = F.when(F.col("value").contains("\r\n\r\n"), F.substring_index("value", "\r\n\r\n", 1))
    return raw.select("file", "block", "seq", F.col("value").cast("binary").alias("piece"), F.sha1(F.col("value").cast("binary")).alias("mark"), head.alias("head"))


#: Of a piece with columns piece, head and content: the header's bytes, and the payload as far as the piece holds it.
_HEAD_BYTES = "octet_length(head)"
_PAYLOAD = "substring(piece, CAST(octet_length(head) + 5 AS INT), CAST(content AS INT))"
_FIELDS = {"type": "WARC-Type", "id": "WARC-Record-ID", "url": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "digest": "WARC-Payload-Digest"}


def _reachable(links: DataFrame) -> DataFrame:
    """Of links (file, off, succ): the offsets that a chain from the start of their file reaches.

    Round i has links over 2^i links: the reached set doubles by following them, then the links are joined with
    themselves. Both stay as large as the candidates; the rounds end when a round reaches nothing new."""
    marks = links.groupBy("file").agg(F.lit(0).cast("long").alias("off")).select("file", "off")
    jump, reached, size = links, marks, marks.count()
    while True:
        step = reached.join(jump, ["file", "off"]).select("file", F.col("succ").alias("off"))
        reached = staged(reached.unionByName(step.join(links.select("file", "off"), ["file", "off"], "left_semi")).distinct(), "warc-reached")
        now = reached.count()
        if now == size:
            return reached
        size = now
        far = jump.select("file", F.col("off").alias("succ"), F.col("succ").alias("far"))
        jump = staged(jump.join(far, ["file", "succ"]).select("file", "off", F.col("far").alias("succ")), "warc-jump")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of a verified record, with its offset, rec (the offset of that record) and size (its bytes); without payloads.

    What a task works on is one split, of a file of any size; the windows over a file hold a row for each split."""
    length = F.octet_length("piece").cast("long")
    content = F.expr("try_cast(content AS BIGINT)")
    p = _pieces(spark, path).withColumn("content", _header("Content-Length")).withColumn("content", F.when(F.col("content").rlike("^[0-9]{1,18}$"), content))
    whole = F.expr(f"octet_length(piece) >= {_HEAD_BYTES} + 4 + content + 4")
    found = [_header(v).alias(k) for k, v in _FIELDS.items()]
    small = p.select("file", "block", "seq", "mark", length.alias("len"), F.expr(_HEAD_BYTES).cast("long").alias("h"), "content", *found, F.when(whole, F.sha1(F.expr(_PAYLOAD))).alias("sha1"))
    small = staged(small, "warc-pieces")

    # A piece's place in its file: the bytes of the splits before its own, and of the pieces before it in its split.
    n = F.col("len") + len(MAGIC)
    splits = small.groupBy("file", "block").agg(F.sum(n).alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    run = F.sum(n).over(W.partitionBy("file", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    placed = small.withColumn("run", F.coalesce(run, F.lit(0))).join(splits, ["file", "block"])
    # What stands before the first magic of a file is no record; the magic before a piece is where its record starts.
    placed = staged(placed.withColumn("off", F.col("base") + F.col("run") - len(MAGIC)).where("off >= 0").drop("base", "run"), "warc-placed")
    succ = F.col("off") + len(MAGIC) + F.col("h") + 4 + F.col("content") + 4
    walked = staged(_walked(placed.withColumn("succ", succ)), "warc-walked")
    # Where chains can come into a split: at the start of a file, and where one goes out of another split.
    entries = walked.where("exit IS NOT NULL").select("file", F.col("exit").alias("off")).union(walked.where("off = 0").select("file", "off")).distinct()
    links = staged(walked.where("succ IS NOT NULL").join(entries, ["file", "off"]).select("file", "block", "off", "last", "last_succ", F.col("exit").alias("succ")), "warc-links")
    own = _reachable(links.select("file", "off", "succ")).join(links, ["file", "off"]).select("file", "block", F.col("off").alias("entry"), F.struct("last", "last_succ").alias("l"))
    # A row for each split: where the file's chain comes in, and the last record that began before it.
    before = F.last("l", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    info = splits.select("file", "block").join(own, ["file", "block"], "left").withColumn("c", before).select("file", "block", "entry", F.col("c.last").alias("c_rec"), F.col("c.last_succ").alias("c_succ"))
    return staged(_assigned(walked.join(info, ["file", "block"])), "warc-parts")


def _walked(placed: DataFrame) -> DataFrame:
    """Pieces with the chain that starts at each: its last piece in the split (last, last_succ), and exit, where it goes on behind the split.

    A piece without a successor of its own is no record: no chain goes through it, and it has none."""
    schema = T.StructType([*placed.schema.fields, T.StructField("last", T.LongType()), T.StructField("last_succ", T.LongType()), T.StructField("exit", T.LongType())])

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("off")
        off, succ = t.column("off").to_pylist(), t.column("succ").to_pylist()
        place = {o: i for i, o in enumerate(off)}
        last, end = [None] * len(off), [None] * len(off)
        for i in range(len(off) - 1, -1, -1):
            if succ[i] is not None:
                j = place.get(succ[i])
                on = j is not None and j > i and last[j] is not None
                last[i], end[i] = (last[j], end[j]) if on else (off[i], succ[i])
        final = off[-1] if off else 0
        leaves = [e if e is not None and e > final else None for e in end]
        for name, values in (("last", last), ("last_succ", end), ("exit", leaves)):
            t = t.append_column(name, pa.array(values, pa.int64()))
        return t

    return placed.groupBy("file", "block").applyInArrow(walk, schema)


def _assigned(walked: DataFrame) -> DataFrame:
    """Pieces with rec, the offset of the record that each belongs to, and size, that record's bytes; others go.

    entry is where the file's chain comes into the split; c_rec and c_succ are the last record before the split."""
    keep = [f for f in walked.schema if f.name not in ("succ", "last", "last_succ", "exit", "entry", "c_rec", "c_succ")]
    schema = T.StructType([*keep, T.StructField("rec", T.LongType()), T.StructField("size", T.LongType())])

    def assign(t: pa.Table) -> pa.Table:
        t = t.sort_by("off")
        off, succ = t.column("off").to_pylist(), t.column("succ").to_pylist()
        entry, rec, end = (t.column(c)[0].as_py() for c in ("entry", "c_rec", "c_succ"))
        out, size = [], []
        for o, e in zip(off, succ, strict=True):
            if o == entry and e is not None:
                rec, end, entry = o, e, e  # the next piece of the chain is where this one ends
            on = rec is not None and o < end
            out.append(rec if on else None)
            size.append(end - rec if on else None)
        t = t.select([f.name for f in keep]).append_column("rec", pa.array(out, pa.int64())).append_column("size", pa.array(size, pa.int64()))
        return t.filter(t.column("rec").is_valid())

    return walked.groupBy("file", "block").applyInArrow(assign, schema)


def _bytes_of(spark: SparkSession, path: str, marks: DataFrame) -> DataFrame:
    """(file, mark, piece) of the pieces with these files and hashes, each once, by a second scan."""
    found = _pieces(spark, path).join(marks.select("file", "mark").distinct(), ["file", "mark"], "left_semi")
    return found.groupBy("file", "mark").agg(F.first("piece").alias("piece"))


def _glued(spark: SparkSession, path: str, several: DataFrame) -> DataFrame:
    """(file, off, payload) of records from all their pieces, put together with the magics between them."""
    p = several.join(_bytes_of(spark, path, several), ["file", "mark"]).groupBy("file", "rec").agg(F.sort_array(F.collect_list(F.struct("off", "piece", "h", "content"))).alias("p"))
    magic = f"unhex('{MAGIC.encode().hex()}')"
    glue = f"aggregate(slice(p, 2, size(p)), p[0].piece, (a, x) -> concat(a, {magic}, x.piece))"
    p = p.select("file", F.col("rec").alias("off"), F.expr("p[0].h").alias("h"), F.expr("p[0].content").alias("content"), F.expr(glue).alias("piece"))
    return p.select("file", "off", F.expr("substring(piece, CAST(h + 5 AS INT), CAST(content AS INT))").alias("payload"))


def _several(parts: DataFrame, broadcast_rows: int) -> DataFrame:
    """The pieces of records that lie in several, as a broadcast where they are few."""
    several = staged(parts.where((F.col("off") != F.col("rec")) | (F.col("len") + len(MAGIC) < F.col("size"))).select("file", "mark", "off", "rec", "h", "content"), "warc-several")
    return F.broadcast(several) if several.limit(broadcast_rows + 1).count() <= broadcast_rows else several


def scan_warc(spark: SparkSession, path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(file, off, type, id, url, refers_to, digest, n, sha1) of each record whose boundary chain holds.

    digest is the header's; n and sha1 are of the payload bytes read. Payloads stay in the scan: only those of records
    that hold the magic are moved. An empty archive has no records; candidates that no chain reaches are no records."""
    parts = _placed(spark, path)
    glued = _glued(spark, path, _several(parts, broadcast_rows)).select("file", "off", F.sha1("payload").alias("glued"))
    records = parts.where("off = rec").join(glued, ["file", "off"], "left")
    return records.select("file", "off", *_FIELDS, F.col("content").alias("n"), F.coalesce("sha1", "glued").alias("sha1"))


def read_warc(spark: SparkSession, path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """What scan_warc returns, with the payloads (binary)."""
    parts = _placed(spark, path)
    several = _several(parts, broadcast_rows)
    records = parts.where("off = rec")
    whole = records.where(F.col("len") + len(MAGIC) >= F.col("size"))
    own = whole.join(_bytes_of(spark, path, whole), ["file", "mark"])
    own = own.withColumn("payload", F.expr("substring(piece, CAST(h + 5 AS INT), CAST(content AS INT))"))
    more = records.where(F.col("len") + len(MAGIC) < F.col("size")).join(_glued(spark, path, several), ["file", "off"])
    cols = ["file", "off", *_FIELDS, F.col("content").alias("n"), F.sha1("payload").alias("sha1"), "payload"]
    return own.select(*cols).unionByName(more.select(*cols))


def _page(urn: str, kind: T.DataType) -> Column:
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit("")).try_cast(kind)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages (page_id, url, html) to an archive and returns what a reader finds in it: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's digest and length are those of the stored payload that it refers to: the response of that id whose header
    has the revisit's digest, so that rows which repeat an id with other payloads are told apart. A null page_id comes back
    null, a null html is empty, repeated rows are repeated records, an empty table gives an empty result; other columns
    are left out. page_id may have any type that a string can be cast to; control characters in it come back encoded."""
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    r = scan_warc(pages.sparkSession, path).select(_page("id", kind).alias("page_id"), "id", F.col("type").alias("record_type"), "refers_to", "digest", "n", "sha1")
    r = staged(r, "warc-records")
    stored = r.where("record_type = 'response' AND id IS NOT NULL").groupBy(F.col("id").alias("refers_to"), "digest").agg(F.max(F.struct("n", "sha1")).alias("s"))
    response = r.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    revisit = r.where("record_type = 'revisit'").join(stored, ["refers_to", "digest"], "left")
    revisit = revisit.select("page_id", F.col("s.n").alias("payload_bytes"), F.col("s.sha1").alias("payload_digest"), "record_type", _page("refers_to", kind).alias("refers_to"))
    return response.unionByName(revisit)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), fresh_path(spark, "warc-archive"))


ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND p.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND p.page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND n >= 1000
"""
