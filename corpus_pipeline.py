"""The corpus pipeline: documents go through five operators, each over all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.llm import jaccard, mixing, secrets, toxicity, winnow
from plenaria.llm.common import forget, staged, table, tune, written


def _kept(docs: DataFrame, judged: Callable[[DataFrame], DataFrame], rule: str, added: list) -> DataFrame:
    """The rows of docs for which the rule holds on the columns that judged adds; columns of docs named like those stay as they are."""
    if {f.name for f in added} & {c.lower() for c in docs.columns}:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row__"), "text")
        return judged(rows).where(rule).select("__row__.*")
    return judged(docs).where(rule).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labelled documents that aren't held out.

    Null and empty texts have the score of a text without features; repeated rows, of equal scores, go or stay together;
    without labels of both classes the verdict of the one class holds for all. An empty table stays empty; all columns
    stay, also those named like the classifier's."""
    tune(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.toxic(d, model), "predicted = 0", toxicity.FIELDS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id: five-word shingles, a similarity of 0.8 or more.

    Null and empty texts are no copies and stay; of rows that repeat doc_id and text one stays, of equal doc_ids with
    near texts that of the smallest hash, a null doc_id only if its group has no other. An empty table stays empty; all
    columns stay."""
    tune(spark)
    return jaccard.deduplicate(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Null and empty texts hold none and stay, null and empty items are held by none; repeated rows go or stay together.
    An empty table on either side is allowed; all columns stay, also those named like the report's."""
    tune(spark)
    return _kept(docs, lambda d: winnow.decontaminate(d, table(spark, sf_dir, "benchmark")), "NOT contaminated", winnow.FIELDS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew; the path of a document is its source.

    Null and empty texts, and n_chars of null texts, stay as they are; every row stays, repeated ones alike. An empty table
    stays empty; all columns stay."""
    tune(spark)
    done = secrets.redact(docs, path="source")
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target and taken of every document that is left.

    Null and empty texts have size 0 and take nothing, null is a source of its own; repeated rows are documents of equal
    keys. An empty table gives an empty mix; other columns are left out."""
    return mixing.mix(docs, table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix_sources),
]

#: Learned models and tree joins have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has written goes once the next one's documents are saved."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(spark, before, (f"pipeline-{name}",))
    return STAGES[-1][1](spark, docs, sf_dir)
