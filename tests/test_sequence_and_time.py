from pyspark.sql import functions as F

from plenaria.operators import sequence, timejoin


def test_carried_and_runs(spark):
    df = spark.createDataFrame([("a", 0, None, "x"), ("a", 1, 5, "x"), ("a", 2, None, None), ("a", 3, None, None), ("a", 4, 7, "x"), ("b", 0, None, "x")], "s string, i int, v int, l string")
    got = {(r.s, r.i): r.c for r in sequence.carried(df, F.col("v"), ["s"], ["i"], "c").collect()}
    assert got == {("a", 0): None, ("a", 1): 5, ("a", 2): 5, ("a", 3): 5, ("a", 4): 7, ("b", 0): None}
    runs = {(r.s, r.i): r.run for r in sequence.with_runs(df, F.col("l"), ["s"], ["i"]).collect()}
    assert runs == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 0): 0}


def test_repeats_buckets_and_numbers(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, " "), (3, "a"), (4, "b"), (5, "a")], "i int, t string").withColumn("s", F.lit(1))
    assert [r.i for r in sequence.without_repeats(df, "t", ["s"], ["i"]).orderBy("i").collect()] == [0, 4, 5]
    assert [r.bucket for r in sequence.buckets(df, 4, ["s"], ["i"]).orderBy("i").collect()] == [0, 0, 0, 0, 1, 1]
    assert [r.passage for r in sequence.passages(df, 3, ["s"], ["i"]).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2]
    assert [r.n for r in sequence.by_appearance(df, "t", ["s"], "i", "n").orderBy("i").collect()] == [1, 1, 2, 1, 3, 1]
    assert [r.i for r in sequence.evenly(df, 2, ["i"]).collect()] == [0, 3]


def test_best_overlap_ties_and_none(spark):
    items = spark.createDataFrame([("s", 1, 0.0, 10.0), ("s", 2, 100.0, 101.0), ("s", 3, 50.0, 130.0)], "session_id string, item_id int, start double, end double")
    turns = spark.createDataFrame([("s", 1, 0.0, 5.0, "A"), ("s", 2, 5.0, 10.0, "B"), ("s", 3, 60.0, 80.0, "C"), ("s", 4, 110.0, 150.0, "D")], "session_id string, turn_id int, start double, end double, speaker string")
    got = {r.item_id: r.speaker for r in timejoin.best_overlap(items, turns, width=7.0).collect()}
    assert got == {1: "A", 2: "SPEAKER_??", 3: "C"}


def test_point_in_span_or_nearest_start(spark):
    spans = spark.createDataFrame([("s", 0, 10.0, 20.0), ("s", 1, 20.0, 30.0), ("s", 2, 15.0, 40.0)], "session_id string, idx int, start double, end double")
    points = spark.createDataFrame([("s", 1, 20.0), ("s", 2, 0.0), ("s", 3, 100.0), ("s", 4, 16.0), ("t", 5, 1.0)], "session_id string, point_id int, t double")
    got = {r.point_id: r.idx for r in timejoin.at_or_nearest(points, spans, width=6.0).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: None}


def test_kth_pairs(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int").toDF("who", "o")
    right = spark.createDataFrame([("a", 5, "x")], "who string, o int, url string")
    got = {(r.who, r.k): r.url for r in timejoin.kth_pairs(left, right.select("who", "o", "url"), ["who"], "o").select("who", "k", "url").collect()}
    assert got == {("a", 1): "x", ("a", 2): None, ("b", 1): None}
