"""Queries that stream or load: a table comes in files or batches, and a start or a batch may be repeated."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..folders import fresh
from ..sources import store
from ..streaming import incremental
from .registry import query

#: Files that the table comes in, and how many of them the first start finds.
SLICES, FIRST = 4, 2


@query(
    "streamed_items",
    """WITH e AS (SELECT *, epoch_ms(max(ts) OVER ()) - 3600000 AS passed FROM events),
w AS (SELECT user_id, event_id, ts, passed, row_number() OVER o AS n, last_value(CASE WHEN event_type = 'signup' THEN 'TOP ' || (event_id % 8 + 1) END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item
  FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'u' || user_id AS session_id, event_id AS id, n, item FROM w WHERE epoch_ms(ts) < passed""",
)
def streamed_items(spark, d):
    """Items carried through a stream that is stopped after half of the files and started again.

    One event in twenty comes with the next file, and one in thirty twice. What the watermark hasn't passed in the end waits."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    source, target, checkpoint = (fresh(spark, f"streamed-{x}") for x in ("source", "target", "checkpoint"))
    span = (last - first) / SLICES
    own = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (span.total_seconds() * 1e6)), F.lit(SLICES - 1)).cast("int")
    # Of those near a file's end, so that none is later than the watermark allows.
    near = F.unix_micros("ts") > F.unix_micros(F.lit(first)) + (own + 1) * (span.total_seconds() * 1e6) - 1.5e9
    rows = e.select(F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "signup", F.concat(F.lit("TOP "), F.col("event_id") % 8 + 1)).alias("opens"), own.alias("slice"), near.alias("near"))
    arrives = F.least(F.col("slice") + (F.col("near") & (F.col("id") % 20 == 0)).cast("int"), F.lit(SLICES - 1))
    rows = rows.withColumn("slice", F.explode(F.when(F.col("id") % 30 == 1, F.array(arrives, arrives)).otherwise(F.array(arrives)))).drop("near")
    for start in (range(FIRST), range(FIRST, SLICES)):
        for i in start:
            rows.where(F.col("slice") == i).drop("slice").write.mode("append").parquet(source)
        stream = spark.readStream.schema("session_id string, id long, ts timestamp, opens string").parquet(source)
        incremental.run_to_end(incremental.carried(stream), target, checkpoint)
    return spark.read.schema("session_id string, id long, n long, item string").parquet(target)


@query(
    "loaded_properties",
    """WITH c AS (SELECT 'n|' || client_id AS key, lpad(coalesce(seq, 0)::VARCHAR, 12, '0') || lpad(change_id::VARCHAR, 12, '0') AS ord, unnest(['city', 'op', 'segment']) AS prop, unnest([city, op, segment]) AS value FROM client_changes WHERE client_id IS NOT NULL)
SELECT key, prop, max({'o': ord, 'v': value}).v AS value FROM c WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def loaded_properties(spark, d):
    """The changes of clients come in three batches whose orders overlap, and the second comes again; the last value of each property holds."""
    path = fresh(spark, "store")
    c = spark.read.parquet(f"{d}/client_changes.parquet").where("client_id IS NOT NULL")
    ord = F.concat(F.lpad(F.coalesce("seq", F.lit(0)).cast("string"), 12, "0"), F.lpad(F.col("change_id").cast("string"), 12, "0"))
    props = F.map_entries(F.create_map(*[x for p in ("city", "op", "segment") for x in (F.lit(p), F.col(p))]))
    rows = c.select("change_id", F.concat(F.lit("n|"), "client_id").alias("key"), ord.alias("ord"), F.explode(props).alias("e")).select("change_id", "key", F.col("e.key").alias("prop"), F.col("e.value").alias("value"), "ord")
    for batch in (2, 0, 1, 0):
        store.upsert(rows.where(F.col("change_id") % 3 == batch), path, f"batch {batch}")
    store.vacuum(spark, path)
    return store.read(spark, path).select("key", "prop", "value")
