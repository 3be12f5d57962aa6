"""Rule extraction from utterances (session_id, idx, start, end, speaker_name, rolle, fraktion, text, herkunft).

Each list of records is a DataFrame with session_id and src, the utterances that it comes from. The agenda item of
an utterance is carried forward from the last one that was called up, inside the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .algorithms import stored
from .sequence import carried

# The patterns by which records name agenda items, days, legal grounds and resolutions; the rules below look
# for fixed words of the same records.
_ITEM = r"(?U)Tagesordnungspunkt\s+(\d+)\s*(?:auf)?\s*[:,]?\s*(.*?)(?:\.|$)"
_DAY = r"\d{1,2}\.\s*\w+\s*\d{4}"
_LEGAL = r"(?U)(Paragraph\s+\d+\s+der\s+Gemeindeordnung)"
_RESOLUTION = r"(?U)Beschluss\s+(\d{4}-\d{3})\s*[:,]?\s*(.*?)$"


def _deadline(text: Column, order: str) -> Column:
    meeting = X.first_group(text, rf"(?U)bis zur\s+(Sitzung am\s+{_DAY})")
    day = X.first_group(text, rf"(?U)bis zum\s+({_DAY})")
    return F.coalesce(meeting, day) if order == "meeting first" else F.coalesce(day, meeting)


def with_agenda(utterances: DataFrame) -> DataFrame:
    """Utterances with low (lower-case text), called (the item that they call up) and top (the item that is open)."""
    called = F.when(F.col("text").rlike(_ITEM), F.regexp_extract("text", _ITEM, 1).cast("int"))
    u = utterances.withColumn("low", F.lower("text")).withColumn("called", called)
    return carried(u, F.col("called"), ["session_id"], ["idx"], "top")


def _first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__rn__", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__rn__ = 1").drop("__rn__")


def _src() -> Column:
    return F.array(F.col("idx")).alias("src")


def extract(utterances: DataFrame, defaults: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All record lists of the rules, by name; defaults has the fields of a meeting (gremium, datum, ort, rechtsgrundlage)
    that an opening doesn't name, empty where it has none.

    The open items are carried once, into files that all lists are read from."""
    given = {k: (defaults or {}).get(k, "") for k in ("gremium", "datum", "ort", "rechtsgrundlage")}
    u = stored(with_agenda(utterances).drop("low"), "agenda").withColumn("low", F.lower("text"))
    has = lambda *ws: F.expr("true") if not ws else _any(ws)
    opening = u.where(F.col("low").contains("eröffne") & F.col("low").contains("sitzung"))
    meeting = opening.groupBy("session_id").agg(
        F.max_by(
            F.struct(
                F.lit(given["gremium"]).alias("gremium"),
                F.coalesce(X.first_group(F.col("text"), rf"(?U)am\s+({_DAY})"), F.lit(given["datum"])).alias("datum"),
                F.lit(given["ort"]).alias("ort"),
                F.col("low").contains("beschlussfähig").alias("beschlussfaehig"),
                F.coalesce(X.first_group(F.col("text"), _LEGAL), F.lit(given["rechtsgrundlage"])).alias("rechtsgrundlage"),
                F.array("idx").alias("src"),
            ),
            "idx",
        ).alias("m")
    )
    title = F.regexp_replace(F.trim(F.regexp_extract("text", _ITEM, 2)), r"^auf[:.]?\s*", "")
    tops = _first(u.where(F.col("called").isNotNull()), ["session_id", "called"], ["idx"]).select("session_id", F.col("called").alias("nummer"), F.element_at(F.split(title, r"\."), 1).alias("titel"), _src(), F.col("idx").alias("ord"))
    open_ = u.where(F.col("top").isNotNull())
    member = open_.where(X.is_member(F.col("rolle")))
    who = [F.col("speaker_name").alias("person"), "fraktion", F.col("top").alias("top_nummer")]
    speeches = member.select("session_id", "idx", *who, "start", X.timecode(F.col("start"), F.col("herkunft")).alias("timecode"), F.lit(False).alias("schriftlich"), _src())
    ask = r"(?iuU)frage die Bundesregierung[:,]?\s*(.*?)$"
    questions = _numbered(member.where(F.col("text").rlike(ask)).select("session_id", "idx", F.col("speaker_name").alias("steller"), "fraktion", F.col("top").alias("top_nummer"), F.trim(F.regexp_extract("text", ask, 1)).alias("text"), _src()))
    mover = F.coalesce(F.nullif(F.col("fraktion"), F.lit("")), F.col("speaker_name"))
    motions = _numbered(open_.where(F.col("low").contains("beantrag")).select("session_id", "idx", F.col("top").alias("top_nummer"), mover.alias("steller"), F.trim("text").alias("text"), _src()))
    recusals = open_.where(has("erkläre mich", "für befangen")).select("session_id", "idx", F.col("speaker_name").alias("person"), F.col("top").alias("top_nummer"), F.coalesce(X.first_group(F.col("text"), _LEGAL), F.lit("§18 GemO")).alias("rechtsgrundlage"), _src())
    outcome = F.when(F.col("low").contains("angenommen"), "angenommen").when(F.col("low").contains("abgelehnt"), "abgelehnt").otherwise("offen")
    votes = open_.where(F.col("low").contains("jastimmen") | (F.col("low").contains("gegenstimme") & F.col("low").contains("enthaltung"))).select(
        "session_id",
        "idx",
        F.col("top").alias("top_nummer"),
        X.votes_before(F.col("text"), "Jastimmen?").alias("ja"),
        X.votes_before(F.col("text"), "(?:Gegenstimmen?|Neinstimmen?)").alias("nein"),
        X.votes_before(F.col("text"), "Enthaltung").alias("enthaltung"),
        outcome.alias("ergebnis"),
        _src(),
    )
    decided = u.where(F.col("text").rlike(_RESOLUTION)).withColumn("nummer", F.regexp_extract("text", _RESOLUTION, 1))
    decided = decided.withColumn("own", F.regexp_replace(F.trim(F.regexp_extract("text", _RESOLUTION, 2)), r"(?iu)^(?:ist\s+)?gefasst\s*[:.]?\s*", ""))
    resolutions = _first(decided, ["session_id", "nummer"], ["idx"]).select("session_id", "idx", "nummer", F.col("top").alias("top_nummer"), F.col("own").alias("text"), _src())
    low = F.lower("own")
    ordered = decided.where(low.contains("beauftragt") | low.contains("vorzulegen")).select(
        "session_id",
        "idx",
        F.lit(0).alias("rule"),
        F.col("nummer").alias("beschluss_nummer"),
        F.lit("Finanzierungskonzept / beauftragte Vorlage").alias("text"),
        F.coalesce(X.first_group(F.col("own"), r"(?U)Zuständig ist (?:das|die|der)\s+(\w+)"), F.lit("Verwaltung")).alias("zustaendig"),
        F.coalesce(_deadline(F.col("own"), "meeting first"), F.lit("nächste Sitzung")).alias("frist"),
        F.lit(None).cast("int").alias("top_nummer"),
        _src(),
    )
    pledged = u.where((F.col("low").contains("vorlegen") | F.col("low").contains("vorzulegen")) & ~F.col("text").rlike(r"(?U)Beschluss\s+\d{4}-\d{3}")).withColumn("due", _deadline(F.col("text"), "day first"))
    pledges = pledged.where(F.col("due").isNotNull()).select(
        "session_id",
        "idx",
        F.lit(1).alias("rule"),
        F.lit(None).cast("string").alias("beschluss_nummer"),
        F.lit("Zugesagte schriftliche Vorlage").alias("text"),
        F.when(F.col("low").contains("bundesregierung"), "Bundesregierung").otherwise(mover).alias("zustaendig"),
        F.col("due").alias("frist"),
        F.col("top").alias("top_nummer"),
        _src(),
    )
    tasks = _numbered(ordered.unionByName(pledges), ["idx", "rule"]).drop("rule")
    return {
        "meeting": meeting.select("session_id", "m.*"),
        "tops": tops,
        "speeches": speeches,
        "statements": statements(member.select("session_id", "idx", *who, "text")),
        "questions": questions,
        "motions": motions,
        "recusals": recusals,
        "votes": votes,
        "resolutions": resolutions,
        "tasks": tasks,
    }


def _any(parts: tuple[str, ...]) -> Column:
    out = F.col("low").contains(parts[0])
    for p in parts[1:]:
        out = out | F.col("low").contains(p)
    return out


def _numbered(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return df.withColumn("i", F.row_number().over(W.partitionBy("session_id").orderBy(*(order or ["idx"]))) - 1)


def statements(speeches: DataFrame) -> DataFrame:
    """The statements of speeches (session_id, idx, person, fraktion, top_nummer, text) that can be checked, numbered in order."""
    s = speeches.select("session_id", "idx", "person", "fraktion", "top_nummer", F.posexplode(X.sentences(F.col("text"))).alias("pos", "text")).where(X.is_statement(F.col("text")))
    return s.withColumn("i", F.row_number().over(W.partitionBy("session_id").orderBy("idx", "pos")) - 1).withColumn("src", F.array("idx")).drop("pos")
