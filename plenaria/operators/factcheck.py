"""Checks of statements against an evidence corpus; every verdict names a source."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .algorithms import saved
from .substrings import keys_in_texts

# The verdicts, as the records name them.
VERDICTS = ["bestätigt", "teilweise", "irreführend", "falsch", "unbelegt"]
LEAST = 0.6
#: Most bytes of evidence keys that go to every task; beyond, keys and texts are joined.
BROADCAST_BYTES = 32 << 20
#: Texts that a task has in Python at a time, at most.
BATCH = 500
_BEST = "struct<score:double,ord:bigint>"

_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, keys: list[str]) -> ahocorasick.Automaton:
    """The automaton over the keys, made once for each worker; key i is found as i, empty keys are left out."""
    if name not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for i, k in enumerate(keys):
            if k:
                made.add_word(k, i)
        if len(made):
            made.make_automaton()
        _automata[name] = made
    return _automata[name]


def _best_match(spark: SparkSession, rows: list[tuple[int, list[str]]]) -> Callable[[Column], Column]:
    """A function of lower-case texts to struct<score, ord>: the largest share of a row's keys that stand in the text, and
    the negative index of the first row with it. rows is (index, lower-case keys), sorted."""
    keys: dict[str, int] = {}
    owner, key = [], []
    for at, (_, own) in enumerate(rows):
        for k in own:
            if k is not None:  # a key that is missing is never matched
                owner.append(at)
                key.append(keys.setdefault(k, len(keys)))
    order = np.argsort(key, kind="stable")
    postings = np.array(owner, np.int64)[order] if len(order) else np.empty(0, np.int64)
    cut = np.searchsorted(np.array(key, np.int64)[order], np.arange(len(keys) + 1)) if len(order) else np.zeros(1, np.int64)
    size = np.array([max(1, len(own)) for _, own in rows], np.int64)
    sent = spark.sparkContext.broadcast((list(keys), postings, cut, size, np.array([i for i, _ in rows], np.int64)))
    name = uuid.uuid4().hex

    @F.pandas_udf("score double, ord long")
    def best(texts: pd.Series) -> pd.DataFrame:
        keys, postings, cut, size, index = sent.value
        found, always = _automaton(name, keys), [i for i, k in enumerate(keys) if not k]
        out = []
        for t in texts:
            hit = {i for _, i in found.iter(t)} if t and len(found) else set()
            hit.update(always if t is not None else ())
            rows = np.concatenate([postings[cut[i] : cut[i + 1]] for i in hit]) if hit else postings[:0]
            if len(rows):
                at, n = np.unique(rows, return_counts=True)
                share = n / size[at]
                top = int(share.argmax())
                out.append((float(share[top]), -int(index[at[top]])))
            else:
                out.append((0.0, -int(index[0])))
        return pd.DataFrame(out, columns=["score", "ord"])

    return best


def _best_joined(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """statements with best, as _best_match gives it, by joins: evidence (ev_idx, keys) of any size.

    Equal texts and equal lists of keys count once. Evidence meets the texts that hold any of its keys but the most
    frequent one; what that key gives alone is one row a key. So a key that much of the evidence has, and many texts
    hold, doesn't pair them all."""
    score = lambda hits: F.struct((hits / F.col("n")).alias("score"), (-F.col("ev")).alias("ord"))
    sets = evidence.groupBy(F.sort_array("keys").alias("keys")).agg(F.min("ev_idx").alias("ev"))
    sets = sets.select("ev", "keys", F.greatest(F.size("keys"), F.lit(1)).alias("n"), F.size(F.filter("keys", lambda k: k == "")).alias("empty"))
    # Empty keys stand in every text that isn't null; without any hit the first evidence has a share of 0.
    rest = sets.agg(F.max(score(F.col("empty"))).alias("text"), F.max(score(F.lit(0))).alias("null")).first()
    given = lambda r: F.struct(F.lit(r.score).alias("score"), F.lit(r.ord).cast("long").alias("ord"))
    own = sets.select("ev", "n", "empty", F.explode("keys").alias("key")).where("key <> ''").groupBy("ev", "n", "empty", "key").agg(F.count(F.lit(1)).alias("times"))
    own = saved(own)
    of = own.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    ranked = own.join(of, "key")
    hottest = ranked.groupBy("ev").agg(F.max_by(F.struct("key", "times"), F.struct("rows", "key")).alias("hot"))
    ranked = saved(own.join(hottest, "ev").select("ev", "n", "empty", "key", "times", F.col("hot.key").alias("hot"), F.col("hot.times").alias("hot_times")))
    alone = ranked.where("key = hot").groupBy("key").agg(F.max(score(F.col("times") + F.col("empty"))).alias("best"))

    low = statements.select(F.lower("text").alias("text")).where("text IS NOT NULL").select(F.md5("text").alias("tid"), "text").dropDuplicates(["tid"])
    hits = saved(keys_in_texts(low, of.select("key")))
    met = hits.join(ranked.where("key <> hot"), "key").groupBy("tid", "ev", "n", "empty", "hot", "hot_times").agg(F.sum("times").alias("times"))
    also = hits.select("tid", F.col("key").alias("hot"), F.lit(1).alias("hit"))
    met = met.join(also, ["tid", "hot"], "left").select("tid", score(F.col("times") + F.col("empty") + F.when(F.col("hit").isNotNull(), F.col("hot_times")).otherwise(0)).alias("best"))
    best = met.unionAll(hits.join(alone, "key").select("tid", "best")).groupBy("tid").agg(F.max("best").alias("met"))
    out = statements.withColumn("__tid__", F.md5(F.lower("text"))).join(best.withColumnRenamed("tid", "__tid__"), "__tid__", "left")
    least = F.when(F.col("text").isNull(), given(rest["null"])).otherwise(given(rest["text"]))
    return out.select(*statements.columns, F.greatest(F.col("met").cast(_BEST), least.cast(_BEST)).alias("best"))


def check_statements(statements: DataFrame, evidence: DataFrame, by: list[str], corpus_date: str = "", corpus_url: str = "https://dip.bundestag.de/", least: float = LEAST) -> DataFrame:
    """statements (by, text, ...) with verdikt, begruendung, quelle (titel, stand, url) and score.

    The evidence (ev_idx, keys, verdikt, begruendung, quelle) of the largest share of matched keys decides, the first
    of equals, from the least share on; else the verdict is unbelegt and the source is the corpus that was searched.
    by names the key of a statement. Keys match inside words: an automaton over all keys finds them in one pass of each text, and only evidence that holds
    a found key is scored. That automaton goes to the tasks if the keys have BROADCAST_BYTES at most, by counted bytes; more
    evidence is joined to the texts by anchors of its keys, with the same result. A null text matches nothing, a null key is never matched; without evidence all is unbelegt."""
    spark = statements.sparkSession
    keys = evidence.select(F.col("ev_idx").cast("long").alias("ev_idx"), F.transform(F.coalesce("keys", F.array().cast("array<string>")), F.lower).alias("keys"))
    size = keys.agg(F.sum(F.expr("64 + aggregate(keys, 0L, (a, k) -> a + 16 + coalesce(octet_length(k), 0))"))).first()[0]
    if not size:
        out = statements.withColumn("best", F.lit(None).cast(_BEST))
    elif size <= BROADCAST_BYTES:
        rows = keys.sort("ev_idx").collect()  # BROADCAST_BYTES at most
        held = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(held)) <= BATCH:
            spark.conf.set(held, str(BATCH))  # long texts must fit into Python workers beside the automaton
        out = statements.withColumn("best", _best_match(spark, [(r[0], r[1]) for r in rows])(F.lower("text")))
    else:
        out = _best_joined(statements, keys)
    ev = evidence.select((-F.col("ev_idx").cast("long")).alias("ord"), F.struct("verdikt", "begruendung", "quelle").alias("ev"))
    # Only rows at the threshold look their evidence up.
    out = out.withColumn("ord", F.when(F.col("best.score") >= least, F.col("best.ord"))).join(ev, "ord", "left")
    ok = F.col("ord").isNotNull()
    none = F.lit(f"Gegen den Evidenzkorpus (Stand {corpus_date}) geprüft; kein Beleg gefunden. 'Unbelegt' bedeutet nicht 'falsch'.")
    corpus = F.struct(F.lit("Evidenzkorpus durchsucht — kein Beleg gefunden").alias("titel"), F.lit(corpus_date).alias("stand"), F.lit(corpus_url).alias("url"))
    return out.select(
        *statements.columns,
        F.when(ok, F.col("ev.verdikt")).otherwise("unbelegt").alias("verdikt"),
        F.when(ok, F.col("ev.begruendung")).otherwise(none).alias("begruendung"),
        F.when(ok, F.col("ev.quelle")).otherwise(corpus).alias("quelle"),
        F.round(F.coalesce(F.col("best.score"), F.lit(0.0)), 2).alias("score"),
    )


def unsourced(checks: DataFrame) -> DataFrame:
    """Checks that break the rule that each has a source; there must be none."""
    return checks.where(F.col("quelle").isNull() | F.col("quelle.titel").isNull())


def verdict_counts(checks: DataFrame, by: list[str]) -> DataFrame:
    """One column for each verdict, and geprueft and fragwuerdig (falsch or irreführend)."""
    out = checks.groupBy(*by).pivot("verdikt", VERDICTS).count().na.fill(0, VERDICTS)
    return out.withColumn("geprueft", sum((F.col(v) for v in VERDICTS[1:]), F.col(VERDICTS[0]))).withColumn("fragwuerdig", F.col("falsch") + F.col("irreführend"))


def combined_evidence(sources: list[DataFrame], by: list[str], most: int = 5) -> DataFrame:
    """The rows of several retrieval sources, those of earlier sources first, at most so many for each key."""
    both = None
    for i, s in enumerate(sources):
        s = s.withColumn("__source__", F.lit(i))
        both = s if both is None else both.unionByName(s)
    w = W.partitionBy(*by).orderBy("__source__", "rank")
    return both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("__source__", "rank")


def verified(claims: DataFrame, evidence: DataFrame, by: list[str], verify: Callable[[DataFrame], DataFrame], claims_most: int = 12) -> DataFrame:
    """The policy around a model that verifies claims: the first claims of a session only, unbelegt without evidence,
    and unbelegt for an answer that is no verdict. verify maps (by, text, evidence) to (by, verdikt, begruendung)."""
    w = W.partitionBy("session_id").orderBy("i")
    some = claims.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= claims_most).drop("rn")
    gathered = evidence.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "titel", "url"))).alias("evidence"))
    asked = some.join(gathered, by, "left")
    answers = verify(asked.where(F.col("evidence").isNotNull()).select(*by, "text", "evidence")).select(*by, F.col("verdikt").alias("v"), "begruendung")
    known = F.col("v").isin(VERDICTS)
    return asked.join(answers, by, "left").withColumn("verdikt", F.when(known, F.col("v")).otherwise("unbelegt")).drop("v")
