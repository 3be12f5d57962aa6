"""Incremental ingestion: each file is taken once, a broken one gives an error row, late events are dropped by watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..sources.record import parse_records

#: Groups that sessions of a stream are dealt to; a checkpoint holds for one number.
BUCKETS = 256


def ingest_records(spark: SparkSession, source: str, target: str, checkpoint: str, most: int | None = None) -> int:
    """Parses record files that are new since the last run into target/items; returns the number of rows that this run added.

    The stream's checkpoint is the ledger of files. A batch writes to a folder of its own number, so that a batch that
    is run again replaces what it wrote."""
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.xml")
    if most:
        reader = reader.option("maxFilesPerTrigger", most)
    files = reader.load(source).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.xml$", 1).alias("session_id"), F.col("value").alias("xml"))
    added = []

    def put(batch: DataFrame, number: int) -> None:
        path = f"{target}/items/batch={number}"
        parse_records(batch).write.mode("overwrite").parquet(path)
        added.append(batch.sparkSession.read.parquet(path).count())

    query = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(added)


def pending(keys: DataFrame, ledger: DataFrame, force: bool = False, most: int | None = None) -> DataFrame:
    """Keys (wp, nr) that the ledger doesn't have, newest first; all of them if forced."""
    out = keys if force else keys.join(ledger, ["wp", "nr"], "left_anti")
    out = out.orderBy(F.desc("nr"), F.desc("wp"))
    return out.limit(most) if most else out


def complete(ledgers: list[DataFrame]) -> DataFrame:
    """Keys that all ledgers have."""
    out = ledgers[0].select("wp", "nr")
    for x in ledgers[1:]:
        out = out.intersect(x.select("wp", "nr"))
    return out


def cached(keys: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache and what fetch finds for keys that it lacks; a key without a find is kept with null, so it isn't asked for again."""
    new = keys.join(cache, "key", "left_anti")
    return cache.unionByName(new.join(fetch(new), "key", "left").select(*cache.columns))


def reaction_windows(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes", streaming: bool = False) -> DataFrame:
    """Reactions (ts, session_id, polarity) by window; the same function for a stream and for a table."""
    e = events.withWatermark("ts", late) if streaming else events
    return e.groupBy(F.window("ts", every).alias("w"), "session_id", "polarity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "session_id", "polarity", "n")


def carried(utterances: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of utterances (session_id, id, ts, opens) as (session_id, id, n, item): its number in the session and the
    agenda item that is open then; opens names the item that an utterance opens, null if none.

    The state of a session is its open item, its count, and the utterances that came but that the watermark (so much
    behind the latest time) hasn't passed: these wait, so that what comes out of order by less than that is put in order of (ts, id)
    before it counts. What comes later than the watermark is left out, and so is an id that waits already. State
    outlives a restart on the same checkpoint; it grows with what waits, not with the session. Sessions are dealt to
    BUCKETS groups, whose sessions go through a step side by side."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions, items, counts, *held = state.get if state.exists else ([],) * 7
        passed = state.getCurrentWatermarkMs()
        parts = [pd.DataFrame(dict(zip(columns, held, strict=True)), columns=columns)]
        if not state.hasTimedOut:
            parts += [f.loc[f["micros"] // 1000 >= passed, columns] for f in frames]
        rows = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        codes, known = pd.factorize(pd.Series([*sessions, *rows["session_id"]], dtype=object), use_na_sentinel=False)
        item, n = list(items), list(counts)
        item += [None] * (len(known) - len(sessions))
        n += [0] * (len(known) - len(sessions))
        rows["code"] = codes[len(sessions) :]
        rows = rows.drop_duplicates(["code", "id"])  # what waits is first
        ready = rows["micros"] // 1000 < passed
        waiting, out = rows[~ready], rows[ready].sort_values(["code", "micros", "id"])
        if len(out):
            own = out["opens"].where(out["opens"].map(lambda x: isinstance(x, str) and x != "")).groupby(out["code"]).ffill()
            before = pd.Series(item, dtype=object)[out["code"]].set_axis(out.index)
            out["item"] = own.where(own.notna(), before).astype(object)
            out["n"] = out.groupby("code").cumcount() + 1 + np.array(n, np.int64)[out["code"]]
            for c, i, m in zip(*(out.drop_duplicates("code", keep="last")[x].tolist() for x in ("code", "item", "n")), strict=True):
                item[c], n[c] = (i if isinstance(i, str) else None), m
        plain = lambda x: [v if isinstance(v, str) else None for v in x]
        state.update((plain(known), item, n, plain(waiting["session_id"]), waiting["id"].tolist(), waiting["micros"].tolist(), plain(waiting["opens"])))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting["micros"].min()) // 1000, passed + 1))
        if len(out):
            yield out[["session_id", "id", "n", "item"]]

    columns = ["session_id", "id", "micros", "opens"]
    schema = "session_id string, id long, n long, item string"
    held = "sessions array<string>, items array<string>, counts array<long>, waiting array<string>, ids array<long>, times array<long>, opens array<string>"
    dealt = utterances.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts")).withColumn("bucket", F.pmod(F.hash("session_id"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, schema, held, "append", "EventTimeTimeout")


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes all that a stream's source has now into Parquet files; the next run on the same checkpoint goes on from there."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
