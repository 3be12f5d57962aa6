"""A store of properties by key that batches can be loaded into again and again.

Rows are (key, prop, value, ord): of a property of a key the value of the greatest ord holds, whatever the order in which batches
come. Rows lie in buckets by the hash of their key. A batch writes the buckets that it touches to a folder of its own
version, by Spark's committed writes, and counts from the moment when its manifest (which version each bucket has) gets its
name: a batch that dies, or whose tasks are run twice, leaves the store as it was, and one that comes again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a store; a manifest has a row for each.
BUCKETS = 64

SCHEMA = "key string, prop string, value string, ord string, bucket int"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _files(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _versions(spark: SparkSession, path: str, number: int | None) -> dict[int, str]:
    """Bucket -> the folder of the version that holds it; BUCKETS entries at most."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/{number}").collect() if r.bucket is not None} if number is not None else {}


def _rows(spark: SparkSession, path: str, versions: dict[int, str]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], SCHEMA)
    found = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(SCHEMA).option("basePath", f"{path}/data").parquet(*found).select("key", "prop", "value", "ord", "bucket")


def applied(spark: SparkSession, path: str) -> list[str]:
    """The batches that count."""
    numbers = _manifests(spark, path)
    return [r.batch for n in numbers for r in spark.read.parquet(f"{path}/manifest/{n}").select("batch").distinct().collect()]


def upsert(rows: DataFrame, path: str, batch: str) -> bool:
    """Loads rows (key, prop, value, ord) as a batch; False if the store has that batch already.

    Ords compare as texts. A null value says nothing, a null key has no place: both are left out. Of equal ords the greatest value
    holds. Of two writers at once one finds its version taken: an error, and it must come again."""
    spark = rows.sparkSession
    if batch in applied(spark, path):
        return False
    numbers = _manifests(spark, path)
    before = _versions(spark, path, numbers[-1] if numbers else None)
    version = (numbers[-1] if numbers else -1) + 1
    folder = f"{version}-{uuid.uuid4().hex[:12]}"  # no other writer's
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    new = rows.where("key IS NOT NULL AND prop IS NOT NULL AND value IS NOT NULL").select("key", "prop", "value", "ord", bucket.alias("bucket"))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    held = _rows(spark, path, {b: v for b, v in before.items() if b in touched})
    last = held.unionByName(new).groupBy("bucket", "key", "prop").agg(F.max(F.struct("ord", "value")).alias("o"))
    last = last.select("key", "prop", F.col("o.value").alias("value"), F.col("o.ord").alias("ord"), "bucket")
    last.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={folder}")
    now = before | {b: folder for b in touched}
    listed = spark.createDataFrame([(batch, b, v) for b, v in sorted(now.items())] or [(batch, None, None)], "batch string, bucket int, version string")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/_{folder}")
    fs, made = _files(spark, f"{path}/manifest/_{folder}")
    _, named = _files(spark, f"{path}/manifest/{version}")
    if fs.exists(named) or not fs.rename(made, named):
        raise RuntimeError(f"another batch has become version {version} of {path}")
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, prop, value, ord) of the store as the latest manifest has it."""
    numbers = _manifests(spark, path)
    return _rows(spark, path, _versions(spark, path, numbers[-1] if numbers else None)).drop("bucket")


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes the versions that the latest manifest doesn't name; queries that read an older state must have ended."""
    numbers = _manifests(spark, path)
    named = set(_versions(spark, path, numbers[-1]).values()) if numbers else set()
    fs, folder = _files(spark, f"{path}/data")
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        if s.getPath().getName().partition("=")[2] not in named:
            fs.delete(s.getPath(), True)


_NODE, _EDGE = ("id", "label", "type", "subtype", "schicht"), ("source_id", "relationship_type", "target_id")


def graph_rows(nodes: DataFrame, edges: DataFrame, ord: Column) -> DataFrame:
    """Nodes and edges of a namespaced graph as rows of a store; an edge's key names its ends and its type.

    Properties named like a column of their own are left out, as the column has that name."""

    def entries(df: DataFrame, key: Column, own: tuple[str, ...]) -> DataFrame:
        lead = F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))])
        rest = F.map_filter(F.coalesce("props", F.expr("map()").cast("map<string,string>")), lambda k, _: ~k.isin(*own))
        return df.select(key.alias("key"), ord.alias("ord"), F.explode(F.map_entries(F.map_concat(rest, lead))).alias("e")).select("key", F.col("e.key").alias("prop"), F.col("e.value").alias("value"), "ord")

    n = entries(nodes, F.concat(F.lit("n|"), "id"), _NODE)
    return n.unionByName(entries(edges, F.concat(F.lit("e|"), F.concat_ws("|", *_EDGE)), _EDGE))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a store that graph_rows were loaded into, with the other properties as a map."""
    whole = read(spark, path).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("prop", "value"))).alias("p"))
    of = lambda start, own: whole.where(F.startswith("key", F.lit(start))).select(*[F.col("p")[c].alias(c) for c in own], F.map_filter("p", lambda k, _: ~k.isin(*own)).alias("props"))
    return of("n|", _NODE), of("e|", _EDGE)
