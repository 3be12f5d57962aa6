"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Every document gets an exponential key, -ln(u) / quality weight, with u from a hash of its id. A source first
gives as many complete epochs as its target holds; the rest of the target goes to the documents of smallest key,
up to the word budget. The prefix sums that find the end of the budget run over histograms of the keys (coarse
buckets, then fine buckets inside the one that holds the end), so that no task ever sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

#: Buckets of the exponential key: a unit of key has COARSE buckets, a coarse one has FINE; keys beyond LAST share a bucket.
COARSE, FINE, LAST = 32, 1024, 16

#: Tables of a row for each source go to every task up to so many sources; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000

WORDS = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of runs of bytes other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...], rate: tuple[int, int], cap: int) -> DataFrame:
    """(source, source_size, target): rate of all sizes shared by weight, no target above cap times its source.

    Weights repeat over the sources by code point, null last. The excess of a capped source is shared anew by weight
    until none is above; sorted by cap per weight the capped ones come first, which gives the end state directly.
    One row a source: the window without partition holds the list of sources, not documents."""
    num, den = rate
    dec = "decimal(38,0)"
    s = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    order = [F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()]
    upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    s = s.select(
        "*",
        F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
        F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("full"),
        F.sum("w").over(rest).alias("w_rest"),
        F.row_number().over(W.orderBy(*order)).alias("k"),
    )
    # What is left for the sources from this one on, times den; this one is not capped if its share fits under its cap.
    left = F.col("total").cast(dec) * num - F.col("full").cast(dec) * (cap * den)
    fits = left * F.col("w") <= F.col("source_size").cast(dec) * (cap * den) * F.col("w_rest")
    first = F.min_by(F.struct(left.cast("double").alias("left"), F.col("w_rest").cast("double").alias("w_rest"), "k"), F.when(fits, F.col("k")))
    s = s.withColumn("at", first.over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    share = F.col("w").cast("double") * F.col("at.left") / (F.col("at.w_rest") * F.lit(float(den)))
    target = F.when(F.col("k") >= F.col("at.k"), share).otherwise(F.col("source_size").cast("double") * float(cap))
    return s.select("source", "source_size", target.alias("target"))


def _end(sums: DataFrame, bucket: str) -> DataFrame:
    """Of the buckets of each source: the one in which the running sum passes the budget, and the sum before it."""
    run = W.partitionBy("source").orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    cum = F.col("before") + F.sum("n").over(run)
    hit = sums.withColumn("cum", cum).where(F.col("cum") > F.col("budget"))
    return hit.groupBy("source").agg(F.min_by(F.struct(F.col(bucket), (F.col("cum") - F.col("n")).alias("before")), bucket).alias("e")).select("source", F.col(f"e.{bucket}").alias(f"{bucket}_end"), F.col("e.before").alias("before"))


def mix(
    docs: DataFrame,
    quality: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    rate: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: str = "mix",
    quality_weights: tuple[float, float, float] = (2.0, 0.5, 1.0),
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of docs (doc_id, text, source, ...), one row for each row of docs.

    quality (doc_id, quality) weighs documents by quality_weights: of quality 1, of quality 0, without a label.
    taken counts words with repeats: size for each complete epoch of the source, and once more for the documents of
    smallest key whose middle word is still inside the rest of the budget; so a source misses its target by less than
    one document, and no document is taken more than cap times.
    Null and empty texts have size 0 and take nothing; null is a source of its own; a source of size 0 has target 0;
    an empty table gives an empty result. A null doc_id gets its key from its text. Repeated rows have equal keys and
    are told apart by nothing, so which of them is taken makes no difference to the result. Other columns of docs are left
    out, whatever their names."""
    label = quality.groupBy("doc_id").agg(F.max("quality").alias("q"))
    d = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text")), F.lit("")).alias("name"))
    d = d.join(label, "doc_id", "left")
    good, bad, unknown = quality_weights
    weight = F.when(F.col("q") >= 1, good).when(F.col("q") < 1, bad).otherwise(unknown)
    u = (F.conv(F.substring(F.md5(F.concat(F.col("name"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    key = -F.log(u) / weight
    fine = F.floor(F.least(key, F.lit(float(LAST))) * (COARSE * FINE))
    d = d.select("doc_id", "source", "size", key.alias("key"), F.floor(fine / FINE).alias("b1"), fine.alias("b2"))
    d = staged(d, "mix-sizes")

    plan = targets(d, "source", "size", weights, rate, cap)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size").cast("double"))
    plan = staged(plan, "mix-plan")

    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def on(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = b.withColumnRenamed("source", "__source__")
        b = F.broadcast(b) if few else b
        return a.join(b, F.col("source").eqNullSafe(F.col("__source__")), how).drop("__source__")

    coarse = on(d.groupBy("source", "b1").agg(F.sum("size").alias("n")), plan.select("source", "budget")).withColumn("before", F.lit(0).cast("long"))
    end1 = staged(_end(coarse, "b1"), "mix-coarse")
    inside = on(d, end1).where(F.col("b1") == F.col("b1_end"))
    fine = on(inside.groupBy("source", "b2").agg(F.sum("size").alias("n"), F.first("before").alias("before")), plan.select("source", "budget"))
    end2 = staged(_end(fine, "b2"), "mix-fine")

    ends = on(on(plan, end1.select("source", "b1_end"), "left"), end2, "left")
    d = on(d, ends, "left")
    last = F.col("b2") == F.col("b2_end")
    run = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    cols = ["doc_id", "size", "source_size", "target", "epochs", "budget"]
    at_end = d.where(last).withColumn("cum", F.col("before") + F.sum("size").over(run))
    once = F.col("cum") - F.col("size") + F.col("size") / 2.0 <= F.col("budget")
    at_end = at_end.select(*cols, "source", once.alias("once"))
    others = d.where(~F.coalesce(last, F.lit(False))).select(*cols, "source", F.coalesce(F.col("b2") < F.col("b2_end"), F.lit(False)).alias("once"))
    out = others.unionByName(at_end)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.when(F.col("once"), F.col("size")).otherwise(0)).alias("taken"))


def op4_mixing_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH q AS (SELECT doc_id, max(quality) q FROM labels GROUP BY doc_id),
s0 AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, md5(d.text), '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN q.q >= 1 THEN 2.0 WHEN q.q < 1 THEN 0.5 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s0 GROUP BY source),
s2 AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
    row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS k FROM s2),
s4 AS (SELECT min(k) AS k0 FROM s3 WHERE (total * 3 - filled * 4) * w <= source_size::HUGEINT * 4 * w_rest),
s5 AS (SELECT s3.source, s3.source_size,
    CASE WHEN s3.k >= k0 THEN s3.w::DOUBLE * (e.total * 3 - e.filled * 4)::DOUBLE / (e.w_rest::DOUBLE * 2.0) ELSE s3.source_size::DOUBLE * 2.0 END AS target
  FROM s3, s4, s3 e WHERE e.k = s4.k0),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS epochs FROM s5),
s7 AS (SELECT s0.doc_id, s0.size, s6.source_size, s6.target, s6.epochs,
    s6.target - s6.epochs * s6.source_size::DOUBLE AS budget,
    sum(s0.size) OVER (PARTITION BY s0.source ORDER BY s0.key, s0.doc_id NULLS LAST, s0.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM s0 JOIN s6 ON s0.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target,
  (size * epochs + CASE WHEN cum - size + size / 2.0 <= budget THEN size ELSE 0 END)::BIGINT AS taken FROM s7
"""
