"""Entity resolution of persons, by normal form of the name and by a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def clusters(persons: DataFrame) -> DataFrame:
    """Variants of one name: persons (id, label, deg) by key, of at least two words and two ids.

    The target has no office in its label and the largest degree; the label shown is the longest without offices."""
    p = persons.withColumn("key", X.person_key(F.col("label"))).where(F.size(F.split("key", " ")) >= 2).withColumn("shown", X.office_free(F.col("label")))
    order = F.struct(X.has_office(F.col("label")).alias("office"), (-F.col("deg")).alias("deg"), F.col("id"))
    g = p.groupBy("key").agg(F.min_by("id", order).alias("target"), F.sort_array(F.collect_set("id")).alias("ids"), F.max_by("shown", F.struct(F.length("shown"), F.col("shown"))).alias("label"))
    return g.where(F.size("ids") > 1).select("key", "target", F.array_remove("ids", F.col("target")).alias("others"), "label")


def id_map(found: DataFrame) -> DataFrame:
    """(old, new) of every id that a cluster merges."""
    return found.select(F.explode("others").alias("old"), F.col("target").alias("new"))


def registered(persons: DataFrame, registry: DataFrame, period: int = 21) -> DataFrame:
    """Persons (id, label, fraktion) with the registry id (dip_id) that is theirs for certain and its page (dip_url), else null.

    Candidates share the last name; those of the period come before others; first names must agree; several are told
    apart by the party."""
    words = lambda c: F.split(X.person_key(F.col(c)), " ")
    p = persons.select("id", "label", "fraktion", F.element_at(words("label"), 1).alias("first"), F.element_at(words("label"), -1).alias("last"))
    r = registry.select(F.col("id").alias("dip_id"), F.lower("vorname").alias("rf"), F.lower("nachname").alias("last"), F.array_contains("wp", period).alias("now"), "fraktionen")
    # Entries that a person can't tell apart are one row with their number; the id counts where that is one.
    r = r.groupBy("last", F.element_at(F.split("rf", " "), 1).alias("rf"), "now", "fraktionen").agg(F.count(F.lit(1)).alias("alike"), F.min("dip_id").alias("dip_id"))
    c = p.join(r, "last").where(X.names_agree(F.col("first"), F.col("rf")))
    w = W.partitionBy("id")
    c = c.withColumn("any_now", F.max("now").over(w)).where(F.col("now") | ~F.col("any_now"))
    c = c.withColumn("n", F.sum("alike").over(w)).withColumn("mine", F.coalesce(F.exists("fraktionen", lambda f: X.party(f) == F.col("fraktion")), F.lit(False)))
    c = c.withColumn("n_mine", F.sum(F.when(F.col("mine"), F.col("alike"))).over(w)).where((F.col("n") == 1) | (F.col("mine") & (F.col("n_mine") == 1)))
    return persons.join(c.select("id", "dip_id", X.registry_url(F.col("dip_id")).alias("dip_url")), "id", "left")


def registry_clusters(persons: DataFrame) -> DataFrame:
    """Persons (id, dip_id, deg) of one registry id: the one of largest degree is the target."""
    g = persons.where("dip_id IS NOT NULL").groupBy("dip_id").agg(F.min_by("id", F.struct((-F.col("deg")).alias("d"), F.col("id"))).alias("target"), F.sort_array(F.collect_set("id")).alias("ids"))
    return g.where(F.size("ids") > 1).select("dip_id", "target", F.array_remove("ids", F.col("target")).alias("others"))
