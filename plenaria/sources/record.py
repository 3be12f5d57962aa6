"""Official plenary records (XML), read as parts in document order: every part belongs to one item (a block, a speech, a
comment, a chair, a line of the contents), and windows carry blocks over their items. A broken document gives an error row,
not a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.algorithms import stored
from ..operators.extract import statements
from .markup import attribute, parts

BLOCKS = {"sitzungsbeginn": "Sitzungseröffnung", "tagesordnungspunkt": "", "zusatzpunkt": "", "sitzungsende": "Sitzungsende"}
ANNEX = "Schriftliche Beiträge zu Protokoll (Anlagen)"
SCHEMA = (
    "session_id string, seq long, kind string, block_no int, block_tag string, block_key string, block_title string, "
    "wahlperiode string, sitzung_nr string, datum string, ort string, "
    "name string, rolle string, fraktion string, text string, herkunft string, error string"
)


#: Written contributions stand after all blocks, wherever the annex is in the file.
_AFTER = 1 << 30
#: Before paragraphs, and before those that name the speaker, while texts are put together; XML allows no such characters.
_MARK, _ASIDE = "\x01", "\x02"
#: White space that is stripped, and characters of XML that a partition of documents holds.
_WHITE, _HELD = r"\s\p{Z}\x1c-\x1f\x85", 8 << 20
#: Bytes of a generated method that the JVM compiles; a larger one is interpreted, row by row.
_COMPILED = 8000
#: Elements that have a meaning, by their numbers from 1 on.
NAMES = [
    *BLOCKS, "sitzungsverlauf", "anlagen", "rede", "kommentar", "name", "top-titel", "inhaltsverzeichnis", "ivz-block", "ivz-block-titel", "ivz-eintrag", "ivz-eintrag-inhalt",
    "redner", "p", "titel", "vorname", "nachname", "fraktion", "rolle", "rolle_lang",
]


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{_WHITE}]+|[{_WHITE}]+$", "")


def _is(number: Column, *names: str) -> Column:
    return number.isin(*[NAMES.index(n) + 1 for n in names])


def _depth(name: str) -> Column:
    """How deep the first element of a name around a part is; null if there is none."""
    return F.nullif(F.array_position("named", F.lit(NAMES.index(name) + 1)), F.lit(0)).cast("int") - 1


def _owned(documents: DataFrame) -> DataFrame:
    """Parts of the documents with their items: session_id, pos, owner (place of the item), kind (of the item, null where none is), block, annex, role, holder, tag, text."""
    session = W.partitionBy("session_id")
    at, named = lambda i: F.get("within", i), lambda i: F.get("named", i)
    first = lambda name: F.min(F.when((F.col("kind") == "open") & (F.size("within") == 2) & _is(named(F.lit(1)), name), F.col("pos"))).over(session)
    p = parts(documents, NAMES).where("kind != 'close'").withColumns({"course": first("sitzungsverlauf"), "annexed": first("anlagen")})
    p = p.withColumns({"opens": F.col("kind") == "open", "deep": F.size("within"), "annex": F.coalesce(at(F.lit(1)) == F.col("annexed"), F.lit(False))})
    # The depth of the block around a part: below the course, or of an agenda item where a record has no course.
    place = F.when(F.col("course").isNull(), _depth("tagesordnungspunkt")).when((at(F.lit(1)) == F.col("course")) & _is(named(F.lit(2)), *BLOCKS), 2)
    p = p.withColumns({"block_at": F.when(~F.col("annex"), place), "speech_at": _depth("rede"), "contents": _depth("inhaltsverzeichnis"), "named_at": _depth("name")})
    p = p.withColumns({"child": named(F.col("block_at") + 1), "below": named(F.col("speech_at") + 1), "entry": named(F.col("contents") + 2), "part": named(F.col("named_at") + 1)})
    spoken = F.col("speech_at").isNotNull() & (F.col("annex") | (F.col("speech_at") == F.col("block_at") + 1))
    kind = (
        F.when(F.col("kind") == "broken", "error")
        .when(spoken & _is(F.col("below"), "kommentar"), "comment")
        .when(spoken, "speech")
        .when(_is(F.col("child"), "kommentar"), "block comment")
        .when(_is(F.col("child"), "name"), "chair")
        .when(F.col("block_at").isNotNull() & (F.col("child").isNull() | _is(F.col("child"), "top-titel")), "block")
        .when(_is(named(F.col("contents") + 1), "ivz-block"), "contents")
        .when(F.col("opens") & (F.col("deep") == 1), "session")
    )
    p = p.withColumn("item", kind)
    owner_at = F.when(F.col("item") == "comment", F.col("speech_at") + 1).when(F.col("item") == "speech", F.col("speech_at")).when(F.col("item").isin("block comment", "chair"), F.col("block_at") + 1)
    owner_at = owner_at.when(F.col("item") == "block", F.col("block_at")).when(F.col("item") == "contents", F.col("contents") + 1).otherwise(0)
    p = p.withColumn("owner_at", owner_at)
    speech, contents, opens = F.col("item") == "speech", F.col("item") == "contents", F.col("opens")
    of_name = speech & (F.col("named_at") > 0) & _is(named(F.col("named_at") - 1), "redner")
    speaker = F.when(opens & (F.col("named_at") + 1 == F.col("deep")), "name")
    for n in ("titel", "vorname", "nachname", "fraktion"):
        speaker = speaker.when(~opens & _is(F.col("part"), n) & (F.col("named_at") + 2 == F.col("deep")), n)
    speaker = speaker.when(~opens & _is(F.col("part"), "rolle") & _is(named(F.col("named_at") + 2), "rolle_lang"), "rolle")
    said = F.when(opens & (F.col("deep") == F.col("speech_at") + 2), F.when(F.coalesce(attribute(F.col("tag"), "klasse"), F.lit("")) == "redner", "aside").otherwise("p"))
    listed = (
        F.when(_is(F.col("entry"), "ivz-block-titel"), "title")
        .when(_is(F.col("entry"), "ivz-eintrag") & opens & _is(named(F.col("deep") - 1), "redner"), "speaker")
        .when(_is(F.col("entry"), "ivz-eintrag") & _is(named(F.col("contents") + 3), "ivz-eintrag-inhalt"), "entry")
    )
    p = p.withColumns({"speaker": F.when(of_name, speaker), "said": F.when(speech & _is(F.col("below"), "p"), said.when(~opens, "said"))})
    role = F.when(speech, F.coalesce(F.when(F.col("said") != "said", F.col("said")), "speaker", "said")).when(contents, listed)
    role = role.otherwise(F.when(opens & (F.col("owner_at") + 1 == F.col("deep")), "self").otherwise("said"))
    p = p.withColumn("role", role)
    holder_at = F.when(F.col("role") == F.col("speaker"), F.col("named_at")).when(contents, F.col("contents") + 2)
    block = F.when(F.col("annex"), _AFTER).otherwise(at(F.col("block_at")))
    own = F.when(F.col("role") == "self", F.col("tag"))
    owner = F.when(F.col("item") == "error", 0).otherwise(at(F.col("owner_at")))
    return p.select("session_id", "pos", owner.alias("owner"), F.col("item").alias("kind"), block.alias("block"), "annex", "role", at(holder_at).alias("holder"), own.alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def parse_records(documents: DataFrame) -> DataFrame:
    """Items of records, in document order by seq: documents is (session_id, xml), one row a session.

    Blocks without a speech or a comment of their own are left out with all they hold; contributions of the annex are a block
    of their own behind the others. A document that isn't well formed (null and empty ones too) has one row of kind error."""
    spark = documents.sparkSession
    # Expressions of a part are many: beyond that size Spark makes methods of each instead of one of all.
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(limit, str(min(_COMPILED, int(spark.conf.get(limit)))))
    documents = stored(documents.select("session_id", "xml"), "records")
    size = documents.agg(F.sum(F.length("xml"))).first()[0] or 0
    # Documents are dealt once, by counted characters; all that is made of them stays where they are.
    own = _owned(documents.repartition(max(spark.sparkContext.defaultParallelism, -(-size // _HELD)), "session_id"))
    role, text = F.col("role"), F.col("text")
    listed = lambda roles, *cols: F.sort_array(F.collect_list(F.when(role.isin(*roles), F.struct("pos", *cols))))
    earliest = lambda name: F.min(F.when(role == name, F.struct("holder", "pos", "text"))).alias(name)
    # A paragraph's texts follow its opening tag, those of an aside (the line that names the speaker) go with it.
    piece = F.when(role == "p", F.lit(_MARK)).when(role == "aside", F.lit(_ASIDE)).otherwise(text).alias("piece")
    whole = own.groupBy("session_id", "owner", "kind").agg(
        F.count("kind").alias("parts"), F.max("block").alias("block"), F.max("annex").alias("annex"), F.max("tag").alias("tag"), F.min(F.when(role == "name", F.col("holder"))).alias("which"),
        listed(("p", "aside", "said"), piece).alias("said"), listed(("rolle",), "holder", "text").alias("rolle"), listed(("title", "speaker", "entry"), "role", "holder", "text").alias("listed"),
        *map(earliest, ("titel", "vorname", "nachname", "fraktion")),
    ).where("parts > 0")  # not by kind, which would be asked of each part before, by all that it is made of; fmt: skip
    kind_is = lambda *kinds: F.col("kind").isin(*kinds)
    spoken = kind_is("speech")
    joined = lambda xs, of="text": F.array_join(F.transform(xs, lambda x: x.getField(of)), "")
    first = lambda name: F.when(F.col(f"{name}.holder") == F.col("which"), F.col(f"{name}.text"))
    i = whole.select(
        "session_id", "owner", "kind", "block", "annex", "tag", "which", "listed", joined("said", "piece").alias("text"),
        *[F.coalesce(_stripped(first(n)), F.lit("")).alias(n) for n in ("titel", "vorname", "nachname", "fraktion")],
        F.when(F.size("rolle") > 0, _stripped(joined(F.filter("rolle", lambda x: x.getField("holder") == F.col("which"))))).alias("rolle"),
    )
    paragraphs = F.regexp_replace(F.regexp_replace("text", f"{_ASIDE}[^{_MARK}{_ASIDE}]*", ""), rf"(?<![{_WHITE}])[{_WHITE}]*+{_MARK}[{_WHITE}{_MARK}]*+", " ")
    # The first entry of the contents that has a text and names no speaker.
    of = lambda *roles: F.filter("listed", lambda x: x.getField("role").isin(*roles))
    speakers = F.transform(of("speaker"), lambda x: x.getField("holder"))
    entries = F.array_distinct(F.filter(F.transform(of("entry"), lambda x: x.getField("holder")), lambda h: ~F.array_contains(speakers, h)))
    texts = F.filter(F.transform(entries, lambda h: _stripped(joined(F.filter(of("entry"), lambda x: x.getField("holder") == h)))), lambda t: t != "")
    text = F.when(kind_is("contents"), F.get(texts, F.lit(0))).otherwise(_stripped(F.when(spoken, paragraphs).otherwise(F.col("text"))))
    i = i.withColumns({"text": text, "title": F.when(kind_is("contents"), _stripped(joined(of("title"))))})
    i = i.withColumns({c: X.composed(F.col(c)) for c in ("text", "title", "titel", "vorname", "nachname", "fraktion", "rolle")})
    full = F.array_join(F.filter(F.array("titel", "vorname", "nachname"), lambda x: x != ""), " ")
    tag_name = F.regexp_extract("tag", r"^<([^\s/>]+)", 1)
    i = i.select(
        "session_id", "owner", "kind", "block", "annex",
        F.when(kind_is("block"), tag_name).alias("block_tag"),
        F.when(kind_is("block"), F.coalesce(attribute(F.col("tag"), "top-id"), F.lit(""))).when(kind_is("contents"), F.col("title")).alias("block_key"),
        F.when(kind_is("block"), F.col("text")).alias("block_title"),
        *[F.when(kind_is("session"), F.coalesce(attribute(F.col("tag"), a), F.lit(other))).alias(c) for c, a, other in (("wahlperiode", "wahlperiode", ""), ("sitzung_nr", "sitzung-nr", ""), ("datum", "sitzung-datum", ""), ("ort", "sitzung-ort", "Berlin"))],
        F.when(spoken, F.coalesce(F.nullif(full, F.lit("")), F.lit("Unbekannt"))).when(kind_is("chair"), F.regexp_replace("text", ":+$", "")).alias("name"),
        F.when(spoken, F.coalesce(F.nullif("rolle", F.lit("")), F.when(F.col("which").isNotNull(), "Abgeordneter").otherwise("Redner"))).alias("rolle"),
        F.when(spoken, F.nullif("fraktion", F.lit(""))).alias("fraktion"),
        F.when(kind_is("speech", "contents", "comment", "block comment"), F.col("text")).alias("text"),
    )
    in_block = W.partitionBy("session_id", "block")
    counts = (kind_is("speech", "block comment") & ~F.col("annex")) | (kind_is("speech") & F.col("annex"))
    # Items of a block carry its tag, as their rows are read without it.
    tag_of = F.when(F.col("annex"), "anlagen").otherwise(F.max("block_tag").over(in_block))
    i = i.withColumns({"full": F.max(counts).over(in_block), "block_tag": tag_of, "nth": F.row_number().over(in_block.orderBy("owner", "kind"))}).where("(block IS NULL OR full) AND (kind != 'contents' OR text IS NOT NULL)")
    # The block of the annex, beside the first of its items.
    i = i.withColumn("added", F.explode(F.when(F.col("annex") & (F.col("nth") == 1), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    number = F.when(F.col("block").isNotNull(), F.dense_rank().over(W.partitionBy("session_id", F.col("block").isNull()).orderBy("block")))
    seq = F.when(F.col("added"), F.lit(_AFTER)).otherwise(F.col("owner") + F.when(F.col("annex"), F.lit(_AFTER + 1)).otherwise(0)).cast("long")
    origin = F.when(F.col("block") == _AFTER, "anlage").when(F.col("block").isNotNull(), "protokoll")
    values = {
        "seq": seq, "kind": F.when(F.col("added"), "block").otherwise(F.col("kind")), "block_no": number, "herkunft": origin, "error": F.when(kind_is("error"), "not well-formed XML"),
        "block_key": F.when(F.col("added"), "").otherwise(F.col("block_key")), "block_title": F.when(F.col("added"), ANNEX).otherwise(F.col("block_title")),
        **{c: F.when(~F.col("added"), F.col(c)) for c in ("name", "rolle", "fraktion", "text")},
    }
    return i.select(*[values.get(n, F.col(n)).cast(t).alias(n) for n, t in (c.split() for c in SCHEMA.split(", "))])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Items of the record files under a path; the session is the file name without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.xml)?$", 1).alias("session_id"), F.col("value").alias("xml"))
    return parse_records(files)


def tables(items: DataFrame) -> dict[str, DataFrame]:
    """The record lists of parsed items: meeting, tops, utterances, speeches, statements, reactions, errors."""
    order = W.partitionBy("session_id").orderBy("seq")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    person = X.office_free(F.col("name"))
    said = (F.col("kind") == "speech") | ((F.col("kind") == "chair") & (person != ""))
    i = items.withColumn("person", F.coalesce(F.nullif(person, F.lit("")), F.when(F.col("kind") == "speech", F.lit("Unbekannt")))).withColumn("said", said.cast("int"))
    i = i.withColumn("idx", F.when(F.col("said") == 1, F.sum("said").over(so_far).cast("int") - 1))
    in_block = W.partitionBy("session_id", "block_no").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    i = i.withColumn("last_speech", F.last(F.when(F.col("kind") == "speech", F.col("idx")), ignorenulls=True).over(in_block))
    talk = i.where("idx IS NOT NULL").select(
        "session_id",
        "idx",
        F.lit(0.0).alias("start"),
        F.lit(0.0).alias("end"),
        F.col("person").alias("speaker_name"),
        F.when(F.col("kind") == "chair", "Sitzungsleitung").otherwise(F.col("rolle")).alias("rolle"),
        F.when(F.col("kind") == "speech", X.party(F.col("fraktion"))).alias("fraktion"),
        F.coalesce("text", F.lit("")).alias("text"),
        "herkunft",
        "kind",
        F.col("block_no").alias("top_nummer"),
    )
    speeches = talk.where("kind = 'speech'").select("session_id", "idx", F.col("speaker_name").alias("person"), "fraktion", "top_nummer", F.lit(0.0).alias("start"), F.lit("Prot.").alias("timecode"), (F.col("herkunft") == "anlage").alias("schriftlich"), F.array("idx").alias("src"), "text")
    contents = i.where("kind = 'contents'").groupBy("session_id", X.label_key(F.col("block_key")).alias("key")).agg(F.max_by(X.shortened(F.col("text")), "seq").alias("described"))
    blocks = i.where("kind = 'block'").withColumn("key", X.label_key(F.col("block_key"))).join(contents.where("key != ''"), ["session_id", "key"], "left")
    name = F.coalesce(F.nullif("described", F.lit("")), F.nullif("block_title", F.lit("")), F.nullif("block_key", F.lit("")), X.literal_map(BLOCKS)[F.col("block_tag")], F.lit(""))
    tops = blocks.select("session_id", F.col("block_no").alias("nummer"), name.alias("titel"), F.expr("array()").cast("array<int>").alias("src"), F.col("seq").cast("int").alias("ord"))
    heard = i.where(F.col("kind").isin("comment", "block comment") & (F.coalesce("text", F.lit("")) != ""))
    reactions = heard.select("session_id", (F.row_number().over(order) - 1).alias("i"), X.reaction_type(F.col("text")).alias("typ"), "text", X.reaction_giver(F.col("text")).alias("urheber"), F.col("block_no").alias("top_nummer"), F.coalesce("last_speech", F.lit(-1)).alias("rede_index"))
    meeting = i.where("kind = 'session'").select("session_id", F.lit("Deutscher Bundestag").alias("gremium"), "datum", "ort", "wahlperiode", "sitzung_nr", F.lit(None).cast("boolean").alias("beschlussfaehig"))
    return {
        "meeting": meeting,
        "tops": tops,
        "utterances": talk.drop("kind"),
        "speeches": speeches.drop("text"),
        "statements": statements(speeches),
        "reactions": reactions,
        "errors": items.where("kind = 'error'").select("session_id", "error"),
    }
