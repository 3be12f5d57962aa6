"""Queries of small forms, readers and fetched sources over texts made from the driver tables, with DuckDB SQL.

The SQL forms know the numbers that the texts are made of and read no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dashboards, quality, resolve, retrieval, sequence
from ..sources import fetched, inputs, sinks
from ..streaming import incremental
from . import records
from .registry import query


def _table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(column: str, values: list) -> F.Column:
    """One of the values by a whole number modulo their count."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _picked(column: str, values: list) -> str:
    texts = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"list_extract([{texts}], ({column} % {len(values)} + 1)::INT)"


def _captions(spark, d) -> DataFrame:
    """A caption file for each conversation: two lines of one name, then two of the other."""
    c = _table(spark, d, "conversations")
    stamp = lambda at: F.format_string("00:%02d:%02d,000", F.floor(at / 60), at % 60)
    name = F.when(F.floor(F.col("turn") / 2) % 2 == 0, "Anna").otherwise("Bert")
    block = F.concat(F.col("turn").cast("string"), F.lit("\n"), stamp(F.col("turn")), F.lit(" --> "), stamp(F.col("turn") + 1), F.lit("\n<i>"), name, F.lit(": Zeile "), F.col("turn").cast("string"), F.lit("</i>\n"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"])
    return c.groupBy(F.col("conv_id").alias("session_id")).agg(F.array_join(blocks, "\n").alias("value"))


_RUNS = """c AS (SELECT conv_id AS session_id, turn, CASE WHEN (turn // 2) % 2 = 0 THEN 'Anna' ELSE 'Bert' END AS speaker FROM conversations),
r AS (SELECT *, sum(ch) OVER (PARTITION BY session_id ORDER BY turn) - 1 AS idx FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY session_id ORDER BY turn) IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS ch FROM c)),
g AS (SELECT session_id, idx::BIGINT AS idx, speaker, min(turn)::DOUBLE AS start, max(turn + 1)::DOUBLE AS "end", string_agg('Zeile ' || turn, ' ' ORDER BY turn) AS text FROM r GROUP BY 1, 2, 3)"""


@query("caption_segments", f"WITH {_RUNS} SELECT * FROM g")
def caption_segments(spark, d):
    """Captions to runs of one speaker."""
    return inputs.caption_segments(_captions(spark, d)).select("session_id", "idx", "speaker", "start", "end", "text")


@query("caption_transcripts", f"""WITH {_RUNS} SELECT session_id, max("end") AS duration_sec, count(*) AS segmente, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS namen FROM g GROUP BY 1""")
def caption_transcripts(spark, d):
    """Captions in the shape of a transcript."""
    t = inputs.diarised(inputs.caption_segments(_captions(spark, d)))
    return t.select("session_id", "duration_sec", F.size("segments").cast("long").alias("segmente"), F.array_join(F.sort_array(F.map_keys("speaker_map")), ",").alias("namen"))


@query("caption_texts", "SELECT conv_id AS session_id, string_agg('<i>' || CASE WHEN (turn // 2) % 2 = 0 THEN 'Anna' ELSE 'Bert' END || ': Zeile ' || turn || '</i>', ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def caption_texts(spark, d):
    """The text of a caption file."""
    return _captions(spark, d).select("session_id", fetched.caption_text(F.col("value")).alias("text"))


@query("transcript_utterances", "SELECT conv_id::VARCHAR AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx, CASE WHEN role = 'user' THEN 'Anna A' ELSE 'Unbekannt (' || role || ')' END AS speaker_name, CASE WHEN role = 'user' THEN 'Vorsitz' ELSE '' END AS rolle, CASE WHEN role = 'user' THEN 'SPD' END AS fraktion, text FROM conversations")
def transcript_utterances(spark, d):
    """Segments with the names of their speakers."""
    segment = F.struct("turn", F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), F.col("role").alias("speaker"), "text").alias("g"))
    known = F.create_map(F.lit("user"), F.struct(F.lit("Anna A").alias("name"), F.lit("Vorsitz").alias("rolle"), F.lit("SPD").alias("fraktion")))
    t = _table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["g"]).alias("segments")).withColumn("speaker_map", known)
    return inputs.utterances(t).select("session_id", "idx", "speaker_name", "rolle", "fraktion", "text")


_ROLES = ["SPD", "BÜNDNIS 90/DIE GRÜNEN", "Bundesregierung", "Fraktion der CDU/CSU"]
_ROLE_PARTY = ["SPD", "BÜNDNIS 90/DIE GRÜNEN", None, "CDU/CSU"]


@query(
    "feed_items",
    f"""SELECT o_orderkey::VARCHAR AS fvid, {_picked("o_orderkey", _ROLE_PARTY)} AS fraktion, printf('%02d.03.2026', (o_orderkey % 28 + 1)::INT) AS datum, printf('%02d:30', (o_orderkey % 24)::INT) AS uhr, (o_orderkey % 80 + 1)::INT AS nr,
'https://cdn.example/' || o_orderkey || '/film.srt' AS srt, 'Text ' || o_orderkey AS text FROM orders""",
)
def feed_items(spark, d):
    """Items of feed pages, some hundred a page."""
    k = F.col("o_orderkey").cast("string")
    title = F.concat(F.lit("Rede von X ("), _pick("o_orderkey", _ROLES), F.lit(") am "), F.format_string("%02d", F.col("o_orderkey") % 28 + 1), F.lit(".03.2026 um "), F.format_string("%02d", F.col("o_orderkey") % 24), F.lit(":30 Uhr ("), (F.col("o_orderkey") % 80 + 1).cast("string"), F.lit(". Sitzung)"))
    item = F.concat(F.lit("<item>\n<title><![CDATA["), title, F.lit("]]></title><link>https://tv.example/"), k, F.lit('</link><enclosure length="1" url="https://cdn.example/'), k, F.lit('/film.mp4" /><description>Text '), k, F.lit("</description></item>"))
    pages = _table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 200).alias("p"), item.alias("x")).groupBy("p").agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list("x"), "\n<item><title>halb</title></item>\n"), F.lit("</rss>")).alias("value"))
    return inputs.feed_clips(pages).select("fvid", "fraktion", "datum", "uhr", "nr", "srt", "text")


@query("loudness_levels", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 <= 18 THEN 'stark' WHEN o_orderkey % 50 <= 30 THEN 'mittel' ELSE 'vereinzelt' END AS intensitaet FROM orders")
def loudness_levels(spark, d):
    """Levels of loudness; a missing one is faint."""
    db = F.when(F.col("o_orderkey") % 50 != 49, -(F.col("o_orderkey") % 50).cast("double"))
    return _table(spark, d, "orders").select("o_orderkey", X.loudness(db).alias("intensitaet"))


_SOUNDS = ["Applause", "Booing", "Giggle", "Chatter", "Music", "Cheering"]


@query("sound_types", f"SELECT o_orderkey, {_picked('o_orderkey', ['Beifall', 'Missfallen', 'Lachen', 'Unruhe', 'Unruhe', 'Beifall'])} AS typ FROM orders")
def sound_types(spark, d):
    """Classes of sounds."""
    return _table(spark, d, "orders").select("o_orderkey", X.sound_type(_pick("o_orderkey", _SOUNDS)).alias("typ"))


@query(
    "gap_ratings",
    "SELECT o_orderkey, printf('WER %.1f%% (%s); ', (o_orderkey % 40)::DOUBLE, CASE WHEN o_orderkey % 40 < 10 THEN 'gut' WHEN o_orderkey % 40 < 20 THEN 'akzeptabel' ELSE 'kritisch' END) || CASE WHEN o_orderkey % 10 > 7 THEN 'Reaktionen ok; ' ELSE 'Reaktionen fehlen; ' END || (o_orderkey % 5) || ' Lücken' AS bewertung FROM orders",
)
def gap_ratings(spark, d):
    """A sentence on what a transcript lacks."""
    k = F.col("o_orderkey")
    return _table(spark, d, "orders").select("o_orderkey", X.gap_rating((k % 40) / 100, (k % 10) / 10, k % 5).alias("bewertung"))


_NAMES = ["Präsidentin Dr. Anna Beispiel", "Prof. Dr. h. c. Karl-Heinz  Müller", "Vizepräsident Otto Öl", "Schriftführerin Ute X.", "J. Meyer"]
_KEYS = ["anna beispiel", "karl-heinz müller", "otto öl", "ute x", "j meyer"]


@query("person_keys", f"SELECT c_custkey, {_picked('c_custkey', _KEYS)} || ' ' || chr((97 + c_custkey % 26)::INT) AS key, c_custkey % 5 IN (0, 2, 3) AS amt FROM customer")
def person_keys(spark, d):
    """Names without offices, titles and odd spaces."""
    name = F.concat(_pick("c_custkey", _NAMES), F.lit(" "), F.chr(65 + F.col("c_custkey") % 26))
    return _table(spark, d, "customer").select("c_custkey", X.person_key(name).alias("key"), X.has_office(name).alias("amt"))


@query("label_keys", "SELECT c_custkey, 'Tagesordnungspunkt ' || c_custkey AS label FROM customer")
def label_keys(spark, d):
    """Labels in a form that compares."""
    label = F.concat(F.lit(" Tagesordnungspunkt "), F.col("c_custkey").cast("string"), _pick("c_custkey", ["", ":", "::", ": "]))
    return _table(spark, d, "customer").select("c_custkey", X.label_key(label).alias("label"))


@query("clip_titles", f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Thema ' || c_custkey WHEN 1 THEN 'TOP ' || (c_custkey % 9) ELSE 'TOP ' || (c_custkey + 1) END AS titel FROM customer")
def clip_titles(spark, d):
    """The subject of a clip, else its agenda item, else its number."""
    k = F.col("c_custkey")
    topic = F.when(k % 3 == 0, F.concat(F.lit(" Thema "), k.cast("string"))).when(k % 2 == 0, F.lit(" "))
    top = F.when(k % 3 == 1, F.concat(F.lit("TOP "), (k % 9).cast("string")))
    return _table(spark, d, "customer").select("c_custkey", X.clip_title(topic, top, k).alias("titel"))


@query("verdict_words", f"SELECT c_custkey, {_picked('c_custkey', ['ist bestätigt', 'ist falsch', 'neu'])} AS worte, {_picked('c_custkey', ['Gelächter', 'Beifall'])} AS reaktion FROM customer")
def verdict_words(spark, d):
    """Verdicts and reactions in words."""
    return _table(spark, d, "customer").select("c_custkey", X.in_words(_pick("c_custkey", ["bestätigt", "falsch", "neu"]), X.VERDICT_PHRASES).alias("worte"), X.in_words(_pick("c_custkey", ["Lachen", "Beifall"]), X.REACTION_WORDS).alias("reaktion"))


@query("model_lists", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 3 + 1 END::INT AS n, CASE WHEN c_custkey % 4 <> 0 THEN 'a' || c_custkey END AS erste, CASE c_custkey % 3 WHEN 0 THEN 'x, y' WHEN 1 THEN 'w' ELSE '-' END AS text FROM customer")
def model_lists(spark, d):
    """Lists in a model's answer, and fields as text."""
    k = F.col("c_custkey")
    items = F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: F.concat(F.lit('{"a": "a'), (k + i).cast("string"), F.lit('"}')))
    said = F.when(k % 4 == 0, "Keine.").otherwise(F.concat(F.lit("```json\n["), F.array_join(items, ", "), F.lit("]\n```")))
    found = X.json_list_in(said, "struct<a:string>")
    field = _pick("c_custkey", ['["x", "", "y"]', '"w"', "null"])
    return _table(spark, d, "customer").select("c_custkey", F.size(found).alias("n"), F.get(found, F.lit(0))["a"].alias("erste"), X.as_text(field, "-").alias("text"))


@query("registered_persons", "SELECT c_custkey AS id, s_suppkey AS dip_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 50")
def registered_persons(spark, d):
    """Persons by last name, first name and period in a registry."""
    p = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Dr. A. Name"), F.translate((F.col("c_custkey") % 50).cast("string"), "0123456789", "abcdefghij")).alias("label"), F.lit("SPD").alias("fraktion"))
    s = F.col("s_suppkey")
    r = _table(spark, d, "supplier").select(s.alias("id"), F.lit("Anna Maria").alias("vorname"), F.concat(F.lit("Name"), F.translate((s % 50).cast("string"), "0123456789", "abcdefghij")).alias("nachname"), F.array(F.when(s < 50, 21).otherwise(20)).alias("wp"), F.array(F.lit("SPD")).alias("fraktionen"))
    return resolve.registered(p, r).select("id", "dip_id")


@query("registry_clusters", "SELECT dip_id, arg_min(id, row(-(id % 7), id)) AS target, count(*) - 1 AS n_others FROM (SELECT c_custkey AS id, c_custkey % 50 AS dip_id FROM customer WHERE c_custkey % 11 <> 0) GROUP BY 1 HAVING count(*) > 1")
def registry_clusters(spark, d):
    """Persons of one registry id."""
    k = F.col("c_custkey")
    p = _table(spark, d, "customer").select(k.alias("id"), F.when(k % 11 != 0, k % 50).alias("dip_id"), (k % 7).alias("deg"))
    return resolve.registry_clusters(p).select("dip_id", "target", F.size("others").cast("long").alias("n_others"))


@query("cached_keys", "SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'alt' WHEN c_custkey % 3 <> 0 THEN 'neu ' || c_custkey END AS value FROM customer")
def cached_keys(spark, d):
    """K3: a cache that grows by what it lacked."""
    keys = _table(spark, d, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), "c_custkey")
    have = keys.where("c_custkey % 2 = 0").select("key", F.lit("alt").alias("value"))
    number = F.substring("key", 2, 20).cast("long")
    return incremental.cached(keys.select("key"), have, lambda new: new.where(number % 3 != 0).select("key", F.concat(F.lit("neu "), number.cast("string")).alias("value")))


@query("stale_vectors", "SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND (doc_id % 3 = 0 OR doc_id % 3 = 1)")
def stale_vectors(spark, d):
    """Segments without a vector of the model in use."""
    k = F.col("doc_id")
    s = _table(spark, d, "documents").select("doc_id", "text", F.when(k % 3 != 0, F.array(F.lit(1.0))).alias("embedding"), F.when(k % 3 == 2, "neu").when(k % 3 == 1, "alt").alias("embedding_model"))
    return retrieval.stale(s, "neu").select("doc_id")


@query("divergent_speeches", "SELECT c_nationkey::VARCHAR AS session_id, c_custkey AS idx, rang::INT AS rang, rang <= 6 AND wer >= 0.02 AS gezeigt FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY wer DESC, c_custkey) AS rang FROM (SELECT *, (c_custkey % 13) / 400.0 AS wer FROM customer)) WHERE rang <= 8")
def divergent_speeches(spark, d):
    """The speeches whose captions differ most."""
    e = _table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("session_id"), F.col("c_custkey").alias("idx"), ((F.col("c_custkey") % 13) / 400).alias("wer"))
    return quality.divergences(e).select("session_id", "idx", "rang", "gezeigt")


@query("even_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS i, greatest(1, (count(*) OVER ()) // 40) AS step FROM orders) WHERE i % step = 0 AND i < 40 * step")
def even_sample(spark, d):
    """A sample at even distances, without chance."""
    o = _table(spark, d, "orders").select("o_orderkey", (-F.col("o_orderkey")).alias("o"))
    return sequence.evenly(o, 40, ["o"]).select("o_orderkey")


@query("paged_listings", "SELECT c_custkey::VARCHAR AS listing, p::INT AS page, c_custkey || '/' || p AS value FROM (SELECT c_custkey, unnest(range(0, least(c_custkey % 7, 4))) AS p FROM customer)")
def paged_listings(spark, d):
    """Listings page by page, four pages at most."""
    def fetch(listing, token):
        n = int(token or 0)
        return (f"{listing}/{n}", str(n + 1)) if n < int(listing) % 7 else ("", None)

    return fetched.pages(_table(spark, d, "customer").select(F.col("c_custkey").alias("listing")), fetch, most=4).select("listing", "page", "value")


@query("fetched_files", "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 5 <> 0 THEN 'v' || c_custkey END AS value, CASE WHEN c_custkey % 5 = 0 THEN 'OSError: 404' END AS error FROM customer")
def fetched_files(spark, d):
    """Files by key; what fails is a row with its error."""
    def fetch(key):
        if int(key) % 5 == 0:
            raise OSError("404")
        return f"v{key}"

    return fetched.by_key(_table(spark, d, "customer").select(F.col("c_custkey").alias("key")), fetch, tries=1)


@query("searched_claims", "SELECT c_custkey, r::INT AS rank, 'Treffer ' || r AS titel FROM (SELECT c_custkey, unnest(range(0, 2)) AS r FROM customer WHERE c_custkey % 4 <> 0)")
def searched_claims(spark, d):
    """Retrieval searches for the terms of claims."""
    claim = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("Die Steuer "), F.col("c_custkey").cast("string"), F.lit("a in Berlin stieg um 2024 Punkte"))).otherwise("")
    claims = _table(spark, d, "customer").select("c_custkey", claim.alias("text"))
    found = fetched.searched(claims, ["c_custkey"], lambda terms: [(f"Treffer {i}", "https://example.org", terms) for i in range(5)], ["die"], most=2)
    return found.select("c_custkey", "rank", "titel")


@query("model_answers", "SELECT c_custkey, 'FRAGE ' || (c_custkey % 20) AS answer FROM customer")
def model_answers(spark, d):
    """A model's answers, equal prompts asked once."""
    p = _table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Frage "), (F.col("c_custkey") % 20).cast("string")).alias("prompt"))
    return fetched.answered(p, lambda t: t.upper(), interval=0.0).select("c_custkey", "answer")


@query("noisy_transcripts", "SELECT conv_id::VARCHAR AS session_id, string_agg(CASE WHEN turn % 2 = 1 THEN 'Zeile 13 von ' || turn ELSE 'Zeile  Ende' END, ' ' ORDER BY turn) AS text, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN 'user' ELSE '' END AS namen FROM conversations GROUP BY 1")
def noisy_transcripts(spark, d):
    """A careless transcript of a record."""
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Zeile 15 von "), F.col("turn").cast("string"))).otherwise("Zeile weg damit. Ende")
    u = _table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker_name"), said.alias("text"))
    n = quality.noisy(u, {"Zeile 15": "Zeile 13"}, r"weg.*?damit\.", "weg", [r[0] for r in u.select("speaker_name").distinct().where("speaker_name != 'user'").collect()])
    return n.select("session_id", "text", F.array_join("speakers", ",").alias("namen"))


@query("record_counts", records._sql("SELECT s.session_id, coalesce(t.n, 0) AS tops, coalesce(p.n, 0) AS reden, coalesce(r.n, 0) AS reaktionen FROM (SELECT DISTINCT session_id FROM u) s LEFT JOIN (SELECT session_id, count(*) AS n FROM tops GROUP BY 1) t USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM speeches GROUP BY 1) p USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM reactions GROUP BY 1) r USING (session_id)"))
def record_counts(spark, d):
    """Counts of each session's lists."""
    return dashboards.session_counts(records.record(spark, d))


@query("record_names", records._sql("SELECT DISTINCT name AS person FROM speeches"))
def record_names(spark, d):
    """H8: the distinct names of speakers."""
    return dashboards.speaker_names(records.record(spark, d)["speeches"])


@query("record_summary", records._sql("SELECT w.session_id, 'Redebeiträge: ' || coalesce(p.n, 0) || '; Tagesordnungspunkte: ' || coalesce(t.n, 0) || '; Wörter: ' || w.w || '; Saalreaktionen: ' || coalesce(r.n, 0) AS zeile FROM (SELECT session_id, sum(woerter)::BIGINT AS w FROM u GROUP BY 1) w LEFT JOIN (SELECT session_id, count(*) AS n FROM tops GROUP BY 1) t USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM speeches GROUP BY 1) p USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM reactions GROUP BY 1) r USING (session_id)"))
def record_summary(spark, d):
    """The plain summary's figures."""
    return dashboards.plain_summary(records.record(spark, d)).select("session_id", F.regexp_extract("text", r"(Redebeiträge: [^\n]*)", 1).alias("zeile"))


@query("record_pages", records._sql("SELECT t.session_id, t.n AS tops, coalesce(p.n, 0) AS reden, coalesce(r.n, 0) AS reaktionen FROM (SELECT session_id, count(*) AS n FROM tops GROUP BY 1) t LEFT JOIN (SELECT session_id, count(*) AS n FROM speeches GROUP BY 1) p USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM reactions GROUP BY 1) r USING (session_id)"))
def record_pages(spark, d):
    """The printable record, by its marks."""
    h = sinks.record_html(records.record(spark, d))
    count = lambda mark: F.regexp_count("value", F.lit(mark)).cast("long")
    return h.select("session_id", count("<h2 ").alias("tops"), count("<h3>").alias("reden"), count("<em>").alias("reaktionen")).where("tops > 0")


@query("graph_verdicts", records._sql(f", {records._CHECKS} SELECT session_id, verdikt, count(*) AS n FROM checks GROUP BY 1, 2"))
def graph_verdicts(spark, d):
    """Verdicts of each session, from its graph."""
    return dashboards.graph_verdicts(records._graph(spark, d, True)[0])[0]
