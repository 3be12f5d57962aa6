import datetime

from pyspark.sql import functions as F

from plenaria.streaming import incremental


def test_files_are_taken_once_and_broken_ones_give_error_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.xml").write_text("<dbtplenarprotokoll/>")
    (src / "b.xml").write_text("<kaputt>")
    args = (str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert incremental.ingest_records(spark, *args) == 2
    assert incremental.ingest_records(spark, *args) == 0
    (src / "c.xml").write_text("<dbtplenarprotokoll/>")
    assert incremental.ingest_records(spark, *args) == 1
    got = spark.read.parquet(str(tmp_path / "out" / "items"))
    assert sorted((r.session_id, r.kind) for r in got.collect()) == [("a", "session"), ("b", "error"), ("c", "session")]


def test_ledger(spark):
    keys = spark.createDataFrame([(21, 1), (21, 2), (21, 3)], "wp int, nr int")
    done = spark.createDataFrame([(21, 2)], "wp int, nr int")
    assert [r.nr for r in incremental.pending(keys, done).collect()] == [3, 1]
    assert [r.nr for r in incremental.pending(keys, done, force=True, most=2).collect()] == [3, 2]
    assert [r.nr for r in incremental.complete([keys, done]).collect()] == [2]


def test_negative_answers_are_cached(spark):
    cache = spark.createDataFrame([("a", "1")], "key string, value string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = incremental.cached(keys, cache, lambda df: df.where("key = 'b'").withColumn("value", F.lit("2")))
    assert sorted((r.key, r.value) for r in got.collect()) == [("a", "1"), ("b", "2"), ("c", None)]


def test_stream_and_table_agree(spark, tmp_path):
    t0 = datetime.datetime(2026, 1, 1)
    rows = [(t0 + datetime.timedelta(minutes=i), "s", "positiv" if i % 3 else "negativ") for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, session_id string, polarity string")
    path = str(tmp_path / "events")
    df.coalesce(1).write.parquet(path)
    stream = incremental.reaction_windows(spark.readStream.schema(df.schema).parquet(path), streaming=True)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("reaction_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("reaction_test").collect())) == sorted(map(tuple, incremental.reaction_windows(df).collect()))


def test_items_carry_over_restarts_and_late_rows_are_left_out(spark, tmp_path):
    from datetime import UTC, datetime, timedelta

    from plenaria.streaming import incremental

    day = datetime(2024, 1, 1, tzinfo=UTC)
    source, target, checkpoint = (str(tmp_path / x) for x in ("source", "target", "checkpoint"))
    schema = "session_id string, id long, ts timestamp, opens string"

    def come(*rows):
        made = [(s, i, day + timedelta(minutes=m), o) for s, i, m, o in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.run_to_end(incremental.carried(spark.readStream.schema(schema).parquet(source), "10 minutes"), target, checkpoint)
        return sorted(tuple(r) for r in spark.read.parquet(target).collect())

    come(("a", 1, 0, "TOP 1"), ("a", 3, 20, None), ("b", 9, 0, None), ("b", 9, 0, None))
    got = come(("a", 2, 15, "TOP 2"), ("a", 3, 20, None), ("a", 4, 40, None), ("b", 10, 41, "TOP 5"))
    assert got == [("a", 1, 1, "TOP 1"), ("a", 2, 2, "TOP 2"), ("a", 3, 3, "TOP 2"), ("b", 9, 1, None)]
    got = come(("a", 5, 5, "late"), ("a", 6, 90, None), ("b", 11, 95, None))
    assert got[3:] == [("a", 4, 4, "TOP 2"), ("b", 9, 1, None), ("b", 10, 2, "TOP 5")]


def test_many_sessions_go_through_one_state(spark, tmp_path):
    """Items and counts of 400 sessions, a null one included, over three starts against a plain run; few groups for all sessions."""
    import random
    from datetime import UTC, datetime, timedelta

    rng, day = random.Random(4), datetime(2024, 1, 1, tzinfo=UTC)
    source, target, checkpoint = (str(tmp_path / x) for x in ("source", "target", "checkpoint"))
    schema = "session_id string, id long, ts timestamp, opens string"
    rows = [(rng.choice([None, *(f"s{k}" for k in range(399))]), i, day + timedelta(seconds=rng.randrange(7200)), rng.choice([None, None, "", "TOP 1", "TOP 2"])) for i in range(1500)]
    rows.append(("last", 9999, day + timedelta(hours=5), None))
    for start in (rows[:700], rows[600:1400], rows[1400:]):
        spark.createDataFrame(start, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.run_to_end(incremental.carried(spark.readStream.schema(schema).parquet(source), "3 hours"), target, checkpoint)
    assert spark.read.format("statestore").load(checkpoint).count() <= 256
    want = []
    for s in {r[0] for r in rows}:
        item = None
        for n, (_, i, _, o) in enumerate(sorted((r for r in rows[:-1] if r[0] == s), key=lambda r: (r[2], r[1])), 1):
            item = o or item
            want.append((s, i, n, item))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in spark.read.parquet(target).collect())
