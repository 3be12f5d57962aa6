"""Whole jobs: from sources to record lists, graphs and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract, factcheck, graph, quality, sequence, timejoin
from ..operators.dashboards import session_dashboard
from ..sources import inputs, record, store


def heard(lists: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """Sound events as reactions: of the utterance that holds their start, else the one of nearest start.

    The agenda item is that of the utterance's speech, else the session's first."""
    u = lists["utterances"].select("session_id", "idx", "start", "end")
    points = events.select("session_id", F.col("i").alias("point_id"), F.col("start_sec").alias("t"))
    at = timejoin.at_or_nearest(points, u).select("session_id", F.col("point_id").alias("i"), "idx")
    on = lists["speeches"].select("session_id", F.explode("src").alias("idx"), "top_nummer", F.col("idx").alias("ord")).groupBy("session_id", "idx").agg(F.max_by("top_nummer", "ord").alias("top_nummer"))
    first = lists["tops"].groupBy("session_id").agg(F.min_by("nummer", "ord").alias("first_top"))
    e = events.join(at, ["session_id", "i"], "left").join(on, ["session_id", "idx"], "left").join(first, "session_id", "left")
    said = F.concat(F.lit("("), "typ", F.lit(", "), "intensitaet", F.lit("; SED "), F.coalesce(F.col("score").cast("string"), F.lit("")), F.lit(")"))
    return e.select("session_id", "i", "typ", said.alias("text"), F.lit(None).cast("string").alias("urheber"), F.coalesce("top_nummer", "first_top", F.lit(0)).alias("top_nummer"), F.coalesce("idx", F.lit(-1)).alias("rede_index"), "start_sec", "intensitaet", F.lit("audio-SED").alias("herkunft"))


def default_meeting(lists: dict[str, DataFrame], gremium: str, datum: str, ort: str) -> DataFrame:
    """The meetings that were found, and a default for each session without an opening."""
    m = lists["meeting"]
    rest = lists["utterances"].select("session_id").distinct().join(m, "session_id", "left_anti")
    named = rest.select("session_id", F.lit(gremium).alias("gremium"), F.lit(datum).alias("datum"), F.lit(ort).alias("ort"), F.lit(None).cast("boolean").alias("beschlussfaehig"))
    return m.unionByName(named, allowMissingColumns=True)


def checked(lists: dict[str, DataFrame], evidence: DataFrame, allow_real_persons: bool = True) -> DataFrame:
    """Fact-checks of the statements; none if checks of real persons are not allowed."""
    head = evidence.select("stand", "korpus_url").first()
    s = lists["statements"] if allow_real_persons else lists["statements"].limit(0)
    stand, url = (head["stand"] or "", head["korpus_url"] or "https://dip.bundestag.de/") if head else ("", "https://dip.bundestag.de/")
    return factcheck.check_statements(s, evidence.select("ev_idx", "keys", "verdikt", "begruendung", "quelle"), ["session_id", "i"], stand, url)


def of_sessions(events: DataFrame, utterances: DataFrame) -> DataFrame:
    """Events with the session that they belong to: the only one there is, else the one that their file names; an error if there is none."""
    sessions = utterances.select("session_id").distinct()
    some = sessions.limit(2).collect()
    if len(some) == 1:
        return events.withColumn("session_id", F.lit(some[0].session_id))
    lost = events.join(sessions, "session_id", "left_anti").select("session_id").first()
    if lost:
        raise ValueError(f"events of {lost.session_id}, which none of several sessions is named")
    return events


def build_session(spark: SparkSession, transcript: str, evidence: str | None = None, events: str | None = None, meta: tuple[str, str, str] = ("Sitzung", "", "")) -> dict[str, DataFrame]:
    """Diarised transcripts to record lists, nodes, edges and dashboard tables; sound events go to the session that of_sessions says."""
    u = inputs.utterances(inputs.read_transcripts(spark, transcript))
    lists = extract.extract(u, dict(zip(("gremium", "datum", "ort"), meta, strict=True))) | {"utterances": u}
    lists["meeting"] = default_meeting(lists, *meta)
    if events:
        lists["reactions"] = heard(lists, of_sessions(inputs.read_sound_events(spark, events), u))
    return _finished(lists, inputs.read_evidence(spark, evidence) if evidence else None)


def ingest_records(spark: SparkSession, path: str, evidence: str | None = None, allow_real_persons: bool = False) -> dict[str, DataFrame]:
    """Official records to lists, nodes, edges and dashboard tables."""
    lists = record.tables(record.read_records(spark, path))
    return _finished(lists, inputs.read_evidence(spark, evidence) if evidence else None, allow_real_persons)


def ingest_captions(spark: SparkSession, path: str, meta: tuple[str, str, str], lines: int = 30) -> dict[str, DataFrame]:
    """Rolling captions to lists: segments of so many lines by one unknown speaker."""
    seg = inputs.rolling_segments(inputs.read_captions(spark, path), lines)
    u = seg.select("session_id", F.col("idx").cast("int").alias("idx"), "start", "end", F.lit("UNBEKANNT").alias("speaker_label"), F.lit("Unbekannt").alias("speaker_name"), F.lit("").alias("rolle"), F.lit(None).cast("string").alias("fraktion"), "text", F.lit("audio").alias("herkunft"))
    lists = extract.extract(u, dict(zip(("gremium", "datum", "ort"), meta, strict=True))) | {"utterances": u}
    lists["meeting"] = default_meeting(lists, *meta)
    return _finished(lists, None)


def ingest_clips(clips: DataFrame, meta: tuple[str, str, str]) -> dict[str, DataFrame]:
    """Media clips (session_id, speaker, role, fraktion, top, datum, uhr, fvid, url, text) to lists: one clip is one speech."""
    c = inputs.clip_record(clips)
    u = c.select("session_id", "idx", F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.col("speaker").alias("speaker_name"), F.col("role").alias("rolle"), "fraktion", "text", F.lit("audio").alias("herkunft"))
    speeches = c.select("session_id", "idx", F.col("speaker").alias("person"), "fraktion", "top_nummer", F.lit(0.0).alias("start"), F.lit("00:00").alias("timecode"), F.lit(False).alias("schriftlich"), F.array("idx").alias("src"), F.col("url").alias("video_url"), "text")
    tops = c.groupBy("session_id", F.col("top_nummer").alias("nummer")).agg(F.min_by("topic", "idx").alias("titel"), F.min("idx").alias("ord")).withColumn("src", F.expr("array()").cast("array<int>"))
    lists = {"utterances": u, "speeches": speeches.drop("text"), "tops": tops, "statements": extract.statements(speeches), "meeting": u.limit(0).select("session_id", F.lit("").alias("gremium"), F.lit("").alias("datum"), F.lit("").alias("ort"), F.lit(None).cast("boolean").alias("beschlussfaehig"))}
    lists["meeting"] = default_meeting(lists, *meta)
    return _finished(lists, None)


def _finished(lists: dict[str, DataFrame], evidence: DataFrame | None, allow_real_persons: bool = True) -> dict[str, DataFrame]:
    if evidence is not None:
        lists["checks"] = checked(lists, evidence, allow_real_persons)
    nodes, edges = graph.build_graph(lists)
    return lists | {"nodes": nodes, "edges": edges} | {f"dashboard_{k}": v for k, v in session_dashboard(lists, lists.get("checks")).items()}


def bucketed_claims(utterances: DataFrame, most: int = 14, letters: int = 6000) -> DataFrame:
    """Passages for a model that finds claims: consecutive utterances joined, with the first one's speaker."""
    p = sequence.passages(utterances, most, ["session_id"], ["idx"])
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    joined = F.array_join(F.transform(parts, lambda x: x["text"]), " ")
    return p.groupBy("session_id", "passage").agg(F.min("idx").alias("idx"), F.min_by("speaker_name", "idx").alias("person"), F.substring(joined, 1, letters).alias("text")).where(F.col("passage") < most)


def gap_report(spoken: DataFrame, transcript: DataFrame, official: DataFrame, detected: DataFrame) -> DataFrame:
    """One row a session: word errors, reactions found, speakers that the transcript lacks, missing passages, and a rating.

    spoken and transcript are (session_id, text, speakers); official and detected are (session_id, n) of reactions."""
    pairs = spoken.select("session_id", F.col("text").alias("ref"), F.col("speakers").alias("rs")).join(transcript.select("session_id", F.col("text").alias("hyp"), F.col("speakers").alias("hs")), "session_id")
    w = quality.word_errors(pairs)
    gaps = quality.missing_passages(spoken.select("session_id", "text"), transcript.select("session_id", "text"), ["session_id"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("luecken"))
    r = w.join(official.withColumnRenamed("n", "amtlich"), "session_id", "left").join(detected.withColumnRenamed("n", "erkannt"), "session_id", "left").join(gaps, "session_id", "left").na.fill(0, ["amtlich", "erkannt", "luecken"])
    r = r.withColumn("recall", quality.recall(F.col("erkannt"), F.col("amtlich"))).withColumn("fehlende_redner", quality.missing_speakers(F.col("rs"), F.col("hs")))
    return r.withColumn("bewertung", X.gap_rating(F.col("wer"), F.col("recall"), F.col("luecken"))).drop("ref", "hyp", "rs", "hs")


def corpus_errors(errors: DataFrame) -> DataFrame:
    """One row over sessions of block errors (session_id, edits, n_ref): mean, least and most, and all edits by all words."""
    s = errors.groupBy("session_id").agg(F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref")).withColumn("wer", F.col("edits") / F.greatest("n_ref", F.lit(1)))
    return s.agg(F.avg("wer").alias("wer_mittel"), F.min("wer").alias("wer_min"), F.max("wer").alias("wer_max"), (F.sum("edits") / F.sum("n_ref")).alias("wer_gesamt"), F.sum("n_ref").alias("woerter"))


def publish(lists: dict[str, DataFrame], path: str, batch: str, ord: str) -> bool:
    """Loads built lists of any number of sessions into a store in one call: ids get their session, what is shared merges, and of a
    property the value of the greatest ord holds. False if that batch is in already; a batch that died comes again."""
    nodes, edges = graph.namespaced(lists["nodes"], lists["edges"])
    return store.upsert(store.graph_rows(nodes, edges, F.lit(ord)), path, batch)


def load_sessions(sessions: list[dict[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of built lists with namespaced ids, shared nodes once. Lists hold any number of sessions, so there is
    one entry for each kind of source, not for each session."""
    nodes = edges = None
    for lists in sessions:
        n, e = graph.namespaced(lists["nodes"], lists["edges"])
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return graph.upserted(nodes, "session_id"), edges.dropDuplicates(["source_id", "target_id", "relationship_type"])


def coverage(found: DataFrame, first: int, last: int) -> DataFrame:
    """Numbers of a range that a table (nr) lacks."""
    return found.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("nr")).join(found.select("nr"), "nr", "left_anti")


def peaks(figures: DataFrame, values: list[str], key: str = "session_id") -> DataFrame:
    """(figure, key, value): where each figure is largest, the smallest key of equals."""
    long = figures.select(key, F.explode(F.array(*[F.struct(F.lit(v).alias("figure"), F.col(v).cast("long").alias("value")) for v in values])).alias("x")).select(key, "x.*")
    return long.groupBy("figure").agg(F.min_by(F.struct(key, "value"), F.struct((-F.col("value")).alias("v"), F.col(key))).alias("p")).select("figure", f"p.{key}", "p.value")
