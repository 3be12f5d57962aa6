"""Readers of transcripts, captions, sound events, evidence, media clips and dashboards."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.sequence import buckets, carried, merged_runs, without_repeats, with_runs

#: Rows of recordings that a task passes on at a time.
FRAMES = 10_000

TRANSCRIPT = (
    "audio_file string, language string, duration_sec double, asr_model string, diarization_model string, "
    "speaker_map map<string, struct<name: string, rolle: string, fraktion: string>>, "
    "segments array<struct<start: double, end: double, speaker: string, text: string>>"
)
EVENTS = "audio_file string, events array<struct<label: string, typ: string, start_sec: double, end_sec: double, score: double, db: double, intensitaet: string>>"
EVIDENCE = (
    "stand string, korpus_url string, evidenz array<struct<id: string, schluesselbegriffe: array<string>, verdikt: string, "
    "begruendung: string, quelle: struct<titel: string, stand: string, url: string>>>"
)
REVIEW = "sitzung string, geprueft_von string, stand string, korrekturen array<struct<faktencheck_id: string, status: string, verdikt_neu: string, notiz: string, stand: string, person: string>>"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("session_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Diarised transcripts, one row a file: session_id, language (de where none is given), audio_file, speaker_map, segments."""
    return _named(spark.read.schema(TRANSCRIPT).json(path, multiLine=True)).withColumn("language", F.coalesce("language", F.lit("de")))


def utterances(transcripts: DataFrame) -> DataFrame:
    """Segments with the names of their speakers; a label that the map doesn't have becomes 'Unbekannt (label)'."""
    s = transcripts.select("session_id", "speaker_map", F.posexplode("segments").alias("idx", "g"))
    who = F.col("speaker_map")[F.col("g.speaker")]
    return s.select(
        "session_id",
        "idx",
        F.col("g.start").alias("start"),
        F.col("g.end").alias("end"),
        F.col("g.speaker").alias("speaker_label"),
        F.coalesce(who["name"], F.concat(F.lit("Unbekannt ("), F.col("g.speaker"), F.lit(")"))).alias("speaker_name"),
        F.coalesce(who["rolle"], F.lit("")).alias("rolle"),
        who["fraktion"].alias("fraktion"),
        F.col("g.text").alias("text"),
        F.lit("audio").alias("herkunft"),
    )


def aligned_words(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Utterances from words and speaker turns: each word to the turn it overlaps most, then runs of one speaker."""
    from ..operators.timejoin import best_overlap

    return merged_runs(best_overlap(words, turns), "speaker", ["session_id"], "item_id", "start", "end", "text")


_STAMP = r"(\d+:\d{2}:\d{2}[.,]\d{1,3})"


def _cues(files: DataFrame) -> DataFrame:
    """(session_id, block, start, end, lines) of each caption block with two time stamps; files is (session_id, value)."""
    blocks = files.select("session_id", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("block", "b"))
    stamps = F.regexp_extract_all("b", F.lit(_STAMP), F.lit(1))
    body = F.regexp_extract("b", rf"(?s){_STAMP}[^\n]*{_STAMP}[^\n]*\n(.*)$", 3)
    return blocks.where(F.size(stamps) >= 2).select("session_id", "block", X.seconds(F.element_at(stamps, 1)).alias("start"), X.seconds(F.element_at(stamps, 2)).alias("end"), body.alias("body"))


def caption_segments(files: DataFrame) -> DataFrame:
    """Captions (WEBVTT or SRT): tags removed, a 'Name: ' in front is the speaker (else UNBEKANNT), runs of one speaker joined."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("body", "<[^>]*>", ""), r"\s+", " "))
    name = r"^([A-ZÄÖÜ][^:]{1,60}):\s+(.+)$"
    c = _cues(files).withColumn("t", plain).where("t != ''")
    c = c.select("session_id", "block", "start", "end", F.when(F.col("t").rlike(name), F.regexp_extract("t", name, 1)).otherwise("UNBEKANNT").alias("speaker"), F.when(F.col("t").rlike(name), F.regexp_extract("t", name, 2)).otherwise(F.col("t")).alias("text"))
    return merged_runs(c, "speaker", ["session_id"], "block", "start", "end", "text").withColumnRenamed("run", "idx")


def rolling_segments(files: DataFrame, lines: int = 12) -> DataFrame:
    """Rolling captions: repeated lines go, then so many lines make a segment, from the first line's start to the last's."""
    lines_of = files.select("session_id", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("line", "raw"))
    stamp = F.when(F.col("raw").rlike(_STAMP + ".*-->"), X.seconds(F.regexp_extract("raw", _STAMP, 1)))
    c = carried(lines_of.withColumn("stamp", stamp), F.col("stamp"), ["session_id"], ["line"], "start").where("stamp IS NULL AND start IS NOT NULL")
    c = c.withColumn("text", F.trim(F.regexp_replace("raw", "<[^>]*>", ""))).where(~F.col("text").rlike("^(WEBVTT|Kind:|Language:)"))
    kept = buckets(without_repeats(c, "text", ["session_id"], ["line"]), lines, ["session_id"], ["line"])
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return kept.groupBy("session_id", F.col("bucket").alias("idx")).agg(F.min("start").alias("start"), F.max("start").alias("end"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.text(path, wholetext=True).select("value", "_metadata")).select("session_id", "value")


def diarised(segments: DataFrame) -> DataFrame:
    """Caption segments in the shape of a transcript: one row a session, a speaker map of the names found."""
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "speaker", "text")))
    people = F.collect_set("speaker")
    made = segments.groupBy("session_id").agg(rows.alias("segments"), people.alias("who"), F.max("end").alias("duration_sec"))
    pairs = F.transform(F.sort_array("who"), lambda s: F.struct(s.alias("key"), F.struct(s.alias("name"), F.lit("").alias("rolle"), F.lit(None).cast("string").alias("fraktion")).alias("value")))
    return made.select("session_id", "duration_sec", F.map_from_entries(pairs).alias("speaker_map"), "segments")


def read_sound_events(spark: SparkSession, path: str) -> DataFrame:
    """Sound events; type and loudness are derived where the file has none."""
    e = _named(spark.read.schema(EVENTS).json(path, multiLine=True)).select("session_id", F.posexplode("events").alias("i", "e")).select("session_id", "i", "e.*")
    return e.withColumn("typ", F.coalesce("typ", X.sound_type(F.col("label")))).withColumn("intensitaet", F.coalesce("intensitaet", X.loudness(F.col("db"))))


def audio_frames(files: DataFrame, seconds: float = 0.1) -> DataFrame:
    """(session_id, frame, at, width, power, error) of WAV files (session_id, content): the mean square of the samples, full scale 1,
    of every stretch of so many seconds; the last one may be shorter.

    PCM of 8, 16, 24 or 32 bits, channels averaged. Samples are taken a stretch of frames at a time, so that no array of
    a whole recording is made. What is no such file gives one row with an error; a file without samples none."""
    kind = files.schema["session_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((x for f in frames for x in zip(f["session_id"], f["content"], strict=True)), seconds)

    return files.select("session_id", "content").mapInPandas(run, f"session_id {kind}, frame long, at double, width double, power double, error string")


def _frames(files: Iterable[tuple[object, bytes]], seconds: float) -> Iterator[pd.DataFrame]:
    """The rows of audio_frames, those of short files together, some FRAMES at a time."""
    held, size = [], 0

    def taken() -> pd.DataFrame:
        sessions, errors, *numbers = zip(*held, strict=True)
        of = np.repeat(np.arange(len(held)), [len(x) for x in numbers[0]])
        out = {c: np.concatenate(x) for c, x in zip(("frame", "at", "width", "power"), numbers, strict=True)}
        broken = np.array([e is not None for e in errors])[of]
        pick = lambda x: pd.Series([x[i] for i in of.tolist()], dtype=object)
        out = pd.DataFrame({"session_id": pick(sessions), **out, "error": pick(errors)})
        if broken.any():
            out["frame"] = out["frame"].astype("Int64").mask(broken)
            for c in ("at", "width", "power"):
                out[c] = out[c].astype("Float64").mask(broken)
        return out

    for session, content in files:
        try:
            with wave.open(io.BytesIO(content or b""), "rb") as w:
                rate, width, channels, number = w.getframerate(), w.getsampwidth(), w.getnchannels(), 0
                many = max(1, round(rate * seconds))
                while data := w.readframes(many * 1024):
                    x = _samples(data, width)
                    x = x.reshape(-1, channels).mean(axis=1) if channels > 1 else x
                    starts = np.arange(0, len(x), many)
                    widths = np.diff(np.append(starts, len(x)))
                    power = np.add.reduceat(x * x, starts) / widths / float(1 << (16 * width - 2))
                    frame = number + np.arange(len(starts))
                    held.append((session, None, frame, frame * many / rate, widths / rate, power))
                    number, size = number + len(starts), size + len(starts)
                    if size >= FRAMES:
                        yield taken()
                        held, size = [], 0
        except (wave.Error, EOFError, ValueError) as e:
            held.append((session, str(e) or "no WAV file", np.zeros(1, np.int64), *[np.zeros(1)] * 3))
            size += 1
            if size >= FRAMES:
                yield taken()
                held, size = [], 0
    if held:
        yield taken()


def _samples(data: bytes, size: int) -> np.ndarray:
    """Samples of PCM data around 0, as floating numbers of the file's own scale."""
    if size == 1:
        return np.frombuffer(data, np.uint8).astype(np.float64) - 128
    if size == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64)
    return np.frombuffer(data, {2: "<i2", 4: "<i4"}[size]).astype(np.float64)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, content) of the WAV files under a path; the session is the file name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("session_id"), "content")


def detected_events(frames: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Events from frames (session_id, label, frame, at, width, score, power): runs of frames at or above the threshold.

    An event ends where its last frame ends; its level is that of the mean power."""
    on = frames.withColumn("on", F.col("score") >= threshold)
    runs = with_runs(on, F.col("on"), ["session_id", "label"], ["frame"]).where("on")
    db = 20 * F.log10(F.sqrt(F.avg("power")) + 1e-9)
    e = runs.groupBy("session_id", "label", "run").agg(F.round(F.min("at"), 1).alias("start_sec"), F.round(F.max(F.col("at") + F.col("width")), 1).alias("end_sec"), F.round(F.max("score"), 2).alias("score"), F.round(db, 1).alias("db"))
    return e.drop("run").withColumn("typ", X.sound_type(F.col("label"))).withColumn("intensitaet", X.loudness(F.col("db")))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(ev_idx, id, keys, verdikt, begruendung, quelle, stand, korpus_url) of an evidence file."""
    return spark.read.schema(EVIDENCE).json(path, multiLine=True).select("stand", "korpus_url", F.posexplode("evidenz").alias("ev_idx", "e")).select("ev_idx", "e.id", F.col("e.schluesselbegriffe").alias("keys"), "e.verdikt", "e.begruendung", "e.quelle", "stand", "korpus_url")


def feed_clips(pages: DataFrame) -> DataFrame:
    """Clips of feed pages (value): items with title, link and enclosure; party, session and caption address derived."""
    item = pages.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("x"))
    get = lambda p: X.first_group(F.col("x"), p)
    c = item.select(get(r"(?s)<title>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</title>").alias("title"), get(r"(?s)<link>(.*?)</link>").alias("url"), get(r'<enclosure[^>]*url="([^"]+)"').alias("mp4"), get(r"(?s)<description>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</description>").alias("text"))
    c = c.where("title IS NOT NULL AND url IS NOT NULL AND mp4 IS NOT NULL")
    return c.withColumn("fvid", F.regexp_extract("url", r"(\d+)", 1)).withColumn("fraktion", X.known_party(F.col("title"))).withColumn("datum", F.regexp_extract("title", r"(\d{2}\.\d{2}\.\d{4})", 1)).withColumn("uhr", F.regexp_extract("title", r"(\d{2}:\d{2})", 1)).withColumn("nr", F.regexp_extract("title", r"(\d+)\. Sitzung", 1).try_cast("int")).withColumn("srt", F.regexp_replace("mp4", r"\.mp4.*$", ".srt"))


def session_clips(clips: DataFrame, nr: int) -> DataFrame:
    """Clips of a session, sorted as text by date, time and id."""
    return clips.where((F.col("nr") == nr) & (F.length(F.coalesce("text", F.lit(""))) > 0)).orderBy("datum", "uhr", "fvid")


def video_clips(items: DataFrame) -> DataFrame:
    """Video listings (video_id, title, text): session and agenda item from the title, newest last."""
    t = items.withColumn("nr", F.regexp_extract("title", r"(\d+)\.\s*Sitzung", 1).try_cast("int"))
    return t.withColumn("top", F.nullif(F.regexp_extract("title", r"\b((?:TOP|ZP)\s*\d+)", 1), F.lit(""))).where("nr IS NOT NULL")


def clip_record(clips: DataFrame) -> DataFrame:
    """Clips as utterances: one clip is one speech; agenda items are numbered as they first appear."""
    from ..operators.sequence import by_appearance

    w = W.partitionBy("session_id").orderBy("datum", "uhr", "fvid")
    c = clips.withColumn("idx", F.row_number().over(w) - 1)
    c = c.withColumn("topic", F.coalesce(F.nullif("top", F.lit("")), F.concat(F.lit("TOP "), (F.col("idx") + 1).cast("string"))))
    return by_appearance(c, "topic", ["session_id"], "idx", "top_nummer")


def read_dashboards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Dashboards of sessions; period and number come from the file name."""
    name = F.col("_metadata.file_name")
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("wahlperiode", F.regexp_extract(name, r"_(\d+)_(\d+)", 1).try_cast("int")).withColumn("nr", F.regexp_extract(name, r"_(\d+)_(\d+)", 2).try_cast("int"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Human corrections, one row each; sessions with an id of another form are left out."""
    r = spark.read.schema(REVIEW).json(path, multiLine=True).where(F.col("sitzung").rlike(r"^amt_\d+_\d+\z"))
    return r.select(F.col("sitzung").alias("session_id"), "geprueft_von", F.explode("korrekturen").alias("k")).select("session_id", "geprueft_von", "k.*")


GRAPH = "metadata struct<node_count:long,relationship_count:long>, nodes array<struct<id:string,label:string,type:string,subtype:string,schicht:string,props:map<string,string>>>, relationships array<struct<source_id:string,target_id:string,relationship_type:string,props:map<string,string>>>"


def read_graph_json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents (session_id, value), as sinks.graph_json writes them.

    Keys of nodes and relationships beside the leading ones count as properties too; a document that can't be parsed or
    that lacks a list gives no rows of it."""
    def rows(name: str, lead: list[str]) -> DataFrame:
        items = F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")
        each = files.select("session_id", F.explode(items).alias("item"))
        more = F.map_filter(F.from_json("item", "map<string,string>"), lambda k, _: ~k.isin([*lead, "props"]))
        props = F.coalesce(F.from_json(F.get_json_object("item", "$.props"), "map<string,string>"), F.expr("map()").cast("map<string,string>"))
        own = F.map_concat(F.map_filter(more, lambda k, _: ~F.map_contains_key(props, k)), props)
        return each.select("session_id", *[F.get_json_object("item", f"$.{c}").alias(c) for c in lead], own.alias("props"))

    return rows("nodes", ["id", "label", "type", "subtype", "schicht"]), rows("relationships", ["source_id", "target_id", "relationship_type"])
