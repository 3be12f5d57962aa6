import pytest
from pyspark.sql import functions as F

from plenaria.sources import store

SCHEMA = "key string, prop string, value string, ord string"


def rows(spark, *r):
    return spark.createDataFrame(r, SCHEMA)


def state(spark, path):
    return {(r.key, r.prop): r.value for r in store.read(spark, path).collect()}


def test_batches_in_any_order_and_again(spark, tmp_path):
    a = rows(spark, ("x", "p", "old", "1"), ("x", "q", "q1", "1"), (None, "p", "v", "1"), ("y", "p", None, "1"), ("y", "p", "y1", "1"), ("y", "p", "y2", "1"))
    b = rows(spark, ("x", "p", "new", "2"), ("z", "p", "z", "2"))
    want = {("x", "p"): "new", ("x", "q"): "q1", ("y", "p"): "y2", ("z", "p"): "z"}
    for name, order in (("ab", [("a", a), ("b", b)]), ("ba", [("b", b), ("a", a)])):
        path = str(tmp_path / name)
        assert state(spark, path) == {}
        assert [store.upsert(r, path, n) for n, r in order] == [True, True]
        assert not store.upsert(a, path, "a") and store.upsert(a.limit(0), path, "empty") and store.upsert(b, path, "b again")
        assert state(spark, path) == want and store.applied(spark, path) == [*(n for n, _ in order), "empty", "b again"]
        store.vacuum(spark, path)
        assert state(spark, path) == want


def test_a_batch_that_dies_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "s")
    store.upsert(rows(spark, ("x", "p", "1", "1")), path, "first")
    batch = rows(spark, *[(f"k{i}", "p", "2", "2") for i in range(50)], ("x", "p", "2", "2"))

    @F.udf("string")
    def killed(v):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        store.upsert(batch.withColumn("value", F.when(F.col("key") == "k7", killed("value")).otherwise(F.col("value"))), path, "second")
    assert state(spark, path) == {("x", "p"): "1"} and store.applied(spark, path) == ["first"]
    assert store.upsert(batch, path, "second") and len(state(spark, path)) == 51 and state(spark, path)["x", "p"] == "2"


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "s")
    batch = rows(spark, ("x", "p", "1", "1"))
    store.upsert(batch, path, "first")
    numbers = store._manifests(spark, path)
    real, store._manifests = store._manifests, lambda *_: []
    try:
        with pytest.raises(RuntimeError, match="another batch"):
            store.upsert(rows(spark, ("x", "p", "2", "2")), path, "late")
    finally:
        store._manifests = real
    assert numbers == [0] and store.applied(spark, path) == ["first"] and state(spark, path) == {("x", "p"): "1"}


def test_graphs_are_published_and_read_back(spark, tmp_path):
    from plenaria.plans import jobs

    path = str(tmp_path / "g")
    kinds = "session_id string, id string, label string, type string, subtype string, schicht string, props map<string,string>"
    n = lambda label, **p: spark.createDataFrame([("s", "a", label, "Rede", "x", "c", {**p, "label": "no"}), ("s", "p", "P", "Person", "", "c", None)], kinds)
    e = spark.createDataFrame([("s", "p", "a", "R", {"w": "2", "source_id": "no"})], "session_id string, source_id string, target_id string, relationship_type string, props map<string,string>")
    assert jobs.publish({"nodes": n("new", k="2"), "edges": e}, path, "two", "2") and jobs.publish({"nodes": n("old", k="1", j="1"), "edges": e}, path, "one", "1")
    assert not jobs.publish({"nodes": n("old", k="1"), "edges": e}, path, "one", "1")
    nodes, edges = store.graph(spark, path)
    assert sorted((r.id, r.label, r.type, r.props) for r in nodes.collect()) == [("p", "P", "Person", {}), ("s:a", "new", "Rede", {"j": "1", "k": "2"})]
    assert [tuple(r) for r in edges.collect()] == [("p", "R", "s:a", {"w": "2"})]
