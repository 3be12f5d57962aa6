"""Record queries: transcripts made from the orders, taken through the rules, the dashboards and the graph.

Every order is an utterance of a session whose sentence is of one of ten kinds, so each rule has rows of its own, and
DuckDB can say what must come out from the numbers alone, without the rules: the SQL forms never read a sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import algorithms, dashboards, extract, factcheck
from ..operators import graph as G
from ..operators.graph_queries import Graph, ask
from .registry import query

PARTIES = ["SPD", "CDU/CSU", "AfD", "Die Linke", ""]
_PARTY = f"list_extract([{', '.join(repr(p) for p in PARTIES)}], ((o_custkey // 60) % 5 + 1)::INT)"
#: The sentences by kind; n is the agenda item, p the project, d a day, v the votes against.
SAYINGS = [
    "Ich rufe Tagesordnungspunkt {n} auf: Haushalt {n}.",
    "Ich eröffne die Sitzung am {d}. Mai 2026. Wir sind beschlussfähig.",
    "Ich frage die Bundesregierung: Wann kommt Gesetz {p}?",
    "Die Fraktion beantragt Mittel für das Projekt {p}.",
    "Ich erkläre mich für befangen nach Paragraph 18 der Gemeindeordnung.",
    "Das Ergebnis: drei Jastimmen, {v} Gegenstimmen, eine Enthaltung. Der Antrag ist {o}.",
    "Beschluss 2026-{r}: Die Verwaltung wird beauftragt, das Konzept bis zum 3. Juni 2026 zu erstellen. Zuständig ist das Bauamt",
    "Wir werden die Zahlen bis zum 5. Juli 2026 vorlegen.",
    "Die Kosten stiegen um {p} Prozent. Das ist viel.",
    "Vielen Dank für die Debatte.",
]
#: The first sentence of each kind that a fact-check can be made of, by SQL over the same numbers.
_STATED = {
    0: "'Ich rufe Tagesordnungspunkt ' || n || ' auf: Haushalt ' || n || '.'",
    1: "'Ich eröffne die Sitzung am ' || d || '. Mai 2026.'",
    3: "'Die Fraktion beantragt Mittel für das Projekt ' || p || '.'",
    4: "'Ich erkläre mich für befangen nach Paragraph 18 der Gemeindeordnung.'",
    5: "'Das Ergebnis: drei Jastimmen, ' || v || ' Gegenstimmen, eine Enthaltung.'",
    6: "'Beschluss 2026-' || r || ': Die Verwaltung wird beauftragt, das Konzept bis zum 3. Juni 2026 zu erstellen.'",
    8: "'Die Kosten stiegen um ' || p || ' Prozent.'",
}
_FILL = {"n": "n", "d": "d", "p": "p", "v": "v", "o": "o", "r": "r"}
DEFAULTS = {"gremium": "Rat", "datum": "ohne Datum", "ort": "Saal", "rechtsgrundlage": "Satzung"}


def _numbers(k: str, div: str, char: str) -> dict[str, str]:
    """The numbers of an utterance by SQL of either dialect; div is its whole-number division."""
    tenth = div.format(k, 10)
    return {
        "kind": f"{k} % 10",
        "n": f"CAST({tenth} % 8 + 1 AS {char})",
        "d": f"CAST({k} % 28 + 1 AS {char})",
        "p": f"CAST({tenth} % 90 + 10 AS {char})",
        "v": f"CAST({tenth} % 4 + 1 AS {char})",
        "o": f"CASE WHEN {tenth} % 2 = 0 THEN 'angenommen' ELSE 'abgelehnt' END",
        "r": f"lpad(CAST({tenth} % 50 AS {char}), 3, '0')",
    }


_BASE = f"""u0 AS (SELECT 's' || (o_custkey % 60) AS session_id, o_orderkey AS idx, 'Person ' || (o_custkey % 23) AS name,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Vorsitz' ELSE 'Mitglied' END AS rolle, {_PARTY} AS fraktion, {", ".join(f"{v} AS {k}" for k, v in _numbers("o_orderkey", "({0} // {1})", "VARCHAR").items())} FROM orders),
u AS (SELECT *, last_value(CASE WHEN kind = 0 THEN n::INT END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top, rolle = 'Mitglied' AS member,
  CASE kind {" ".join(f"WHEN {i} THEN {len(s.split())}" for i, s in enumerate(SAYINGS))} END AS woerter, CASE kind {" ".join(f"WHEN {i} THEN {s}" for i, s in _STATED.items())} END AS stated FROM u0),
tops AS (SELECT session_id, n::INT AS nummer, min(idx) AS ord FROM u WHERE kind = 0 GROUP BY 1, 2),
speeches AS (SELECT * FROM u WHERE member AND top IS NOT NULL),
statements AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i FROM speeches WHERE stated IS NOT NULL),
questions AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i FROM speeches WHERE kind = 2),
motions AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i FROM u WHERE kind = 3 AND top IS NOT NULL),
recusals AS (SELECT * FROM u WHERE kind = 4 AND top IS NOT NULL),
votes AS (SELECT * FROM u WHERE kind = 5 AND top IS NOT NULL),
resolutions AS (SELECT session_id, '2026-' || r AS nummer, min(idx) AS idx, arg_min(struct_pack(top := top), idx).top AS top FROM u WHERE kind = 6 GROUP BY 1, 2),
tasks AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i FROM u WHERE kind IN (6, 7)),
people AS (SELECT session_id, name, min(idx) AS idx, arg_min(rolle, idx) AS rolle, arg_min(fraktion, idx) AS fraktion FROM u GROUP BY 1, 2),
meeting AS (SELECT session_id, max(idx) AS idx, arg_max(d, idx) || '. Mai 2026' AS datum FROM u WHERE kind = 1 GROUP BY 1),
reactions AS (SELECT u.session_id, event_id AS i, CASE event_type WHEN 'click' THEN 'Beifall' WHEN 'purchase' THEN 'Heiterkeit' WHEN 'error' THEN 'Zwischenruf' WHEN 'signup' THEN 'Widerspruch' ELSE 'Missfallen' END AS typ,
  CASE event_id % 3 WHEN 0 THEN 'SPD' WHEN 1 THEN 'AfD' END AS urheber, (event_id % 8 + 1)::INT AS top, u.idx AS rede_index FROM events JOIN u ON u.idx = event_id)"""


def _sql(body: str) -> str:
    return f"WITH {_BASE}{body if body.startswith(',') else ' ' + body}"


def utterances(spark, d) -> DataFrame:
    """The transcripts. They are saved before they are read, as transcripts are: the optimizer spends ten seconds on the
    conditions that it infers from the making of the sentences."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    for name, sql in _numbers("o_orderkey", "({0} div {1})", "STRING").items():
        o = o.withColumn(name, F.expr(sql))
    said = F.when(F.lit(False), F.lit(""))
    for i, s in enumerate(SAYINGS):
        parts = [F.col(x) if x in _FILL else F.lit(x) for x in _pieces(s)]
        said = said.when(F.col("kind") == i, F.concat(*parts))
    party = F.element_at(F.array(*[F.lit(p) for p in PARTIES]), F.expr("CAST((o_custkey div 60) % 5 + 1 AS INT)"))
    made = o.select(
        F.concat(F.lit("s"), F.expr("CAST(o_custkey % 60 AS STRING)")).alias("session_id"),
        F.col("o_orderkey").alias("idx"),
        F.col("o_orderkey").cast("double").alias("start"),
        (F.col("o_orderkey") + 1).cast("double").alias("end"),
        F.concat(F.lit("Person "), F.expr("CAST(o_custkey % 23 AS STRING)")).alias("speaker_name"),
        F.when(F.col("o_orderkey") % 9 == 0, "Vorsitz").otherwise("Mitglied").alias("rolle"),
        party.alias("fraktion"),
        said.alias("text"),
        F.lit("protokoll").alias("herkunft"),
    )
    return algorithms.stored(made, "utterances")


def _pieces(saying: str) -> list[str]:
    """A saying as texts and names of numbers in turn."""
    out, rest = [], saying
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [before, name] if before else [name]
    return [*out, rest] if rest else out


def record(spark, d) -> dict[str, DataFrame]:
    """The lists of all sessions, with reactions that the events give."""
    u = utterances(spark, d)
    lists = extract.extract(u, DEFAULTS) | {"utterances": u}
    e = spark.read.parquet(f"{d}/events.parquet")
    kinds = X.literal_map({"click": "Beifall", "purchase": "Heiterkeit", "error": "Zwischenruf", "signup": "Widerspruch"})
    giver = F.when(F.col("event_id") % 3 == 0, "SPD").when(F.col("event_id") % 3 == 1, "AfD")
    e = e.select(F.col("event_id").alias("idx"), F.coalesce(kinds[F.col("event_type")], F.lit("Missfallen")).alias("typ"), giver.alias("urheber"), (F.col("event_id") % 8 + 1).cast("int").alias("top_nummer"))
    lists["reactions"] = e.join(u.select("session_id", "idx"), "idx").select("session_id", F.col("idx").alias("i"), "typ", F.col("typ").alias("text"), "urheber", "top_nummer", F.col("idx").alias("rede_index"))
    return lists


def checks(lists: dict[str, DataFrame]) -> DataFrame:
    """Checks of the statements against three rows of evidence."""
    spark = lists["statements"].sparkSession
    source = "struct<titel:string,stand:string,url:string>"
    rows = [(1, ["Kosten", "Prozent"], "bestätigt", "belegt", ("Statistik", "2026", "https://example.org/a")), (2, ["Verwaltung", "Konzept", "nie gesagt"], "irreführend", "verkürzt", ("Ratsblatt", "2026", "https://example.org/b")), (3, ["Projekt 12"], "falsch", "widerlegt", ("Ratsblatt", "2026", "https://example.org/b"))]
    evidence = spark.createDataFrame(rows, f"ev_idx int, keys array<string>, verdikt string, begruendung string, quelle {source}")
    return factcheck.check_statements(lists["statements"], evidence, ["session_id", "i"])


_CHECKS = """checks AS (SELECT *, CASE WHEN kind = 8 THEN 'bestätigt' WHEN kind = 6 THEN 'irreführend' WHEN kind = 3 AND p = '12' THEN 'falsch' ELSE 'unbelegt' END AS verdikt,
  CASE WHEN kind = 8 THEN 'Statistik' WHEN kind = 6 OR kind = 3 AND p = '12' THEN 'Ratsblatt' ELSE 'Evidenzkorpus durchsucht — kein Beleg gefunden' END AS quelle,
  CASE WHEN kind = 6 THEN 0.67 WHEN kind = 8 OR kind = 3 AND p = '12' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM statements)"""


@query("record_meeting", _sql("SELECT session_id, 'Rat' AS gremium, datum, 'Saal' AS ort, true AS beschlussfaehig, 'Satzung' AS rechtsgrundlage, idx AS zeile FROM meeting"))
def record_meeting(spark, d):
    """The opening of each session, the last one of several."""
    m = record(spark, d)["meeting"]
    return m.select("session_id", "gremium", "datum", "ort", "beschlussfaehig", "rechtsgrundlage", F.col("src")[0].alias("zeile"))


@query("record_tops", _sql("SELECT session_id, nummer, 'Haushalt ' || nummer AS titel, ord FROM tops"))
def record_tops(spark, d):
    """Agenda items, the first call of each."""
    return record(spark, d)["tops"].select("session_id", "nummer", "titel", "ord")


@query("record_speeches", _sql("SELECT session_id, idx, name AS person, fraktion, top AS top_nummer, 'Prot.' AS timecode FROM speeches"))
def record_speeches(spark, d):
    """members' speeches with the agenda item that is open."""
    return record(spark, d)["speeches"].select("session_id", "idx", "person", "fraktion", "top_nummer", "timecode")


@query("record_statements", _sql("SELECT session_id, i::INT AS i, idx, stated AS text, name AS person, fraktion, top AS top_nummer FROM statements"))
def record_statements(spark, d):
    """The sentences that can be checked, numbered."""
    return record(spark, d)["statements"].select("session_id", "i", "idx", "text", "person", "fraktion", "top_nummer")


@query("record_questions", _sql("SELECT session_id, i::INT AS i, name AS steller, fraktion, top AS top_nummer, 'Wann kommt Gesetz ' || p || '?' AS text FROM questions"))
def record_questions(spark, d):
    """Questions to the government."""
    return record(spark, d)["questions"].select("session_id", "i", "steller", "fraktion", "top_nummer", "text")


@query("record_motions", _sql("SELECT session_id, i::INT AS i, coalesce(nullif(fraktion, ''), name) AS steller, top AS top_nummer, 'Die Fraktion beantragt Mittel für das Projekt ' || p || '.' AS text FROM motions"))
def record_motions(spark, d):
    """Motions."""
    return record(spark, d)["motions"].select("session_id", "i", "steller", "top_nummer", "text")


@query("record_recusals", _sql("SELECT session_id, idx, name AS person, top AS top_nummer, 'Paragraph 18 der Gemeindeordnung' AS rechtsgrundlage FROM recusals"))
def record_recusals(spark, d):
    """Recusals with their legal ground."""
    return record(spark, d)["recusals"].select("session_id", "idx", "person", "top_nummer", "rechtsgrundlage")


@query("record_votes", _sql("SELECT session_id, idx, top AS top_nummer, 3 AS ja, v::INT AS nein, 1 AS enthaltung, o AS ergebnis FROM votes"))
def record_votes(spark, d):
    """Votes from words and digits."""
    return record(spark, d)["votes"].select("session_id", "idx", "top_nummer", "ja", "nein", "enthaltung", "ergebnis")


@query("record_resolutions", _sql("SELECT session_id, idx, nummer, top AS top_nummer, 'Die Verwaltung wird beauftragt, das Konzept bis zum 3. Juni 2026 zu erstellen. Zuständig ist das Bauamt' AS text FROM resolutions"))
def record_resolutions(spark, d):
    """Resolutions, the first of each number."""
    return record(spark, d)["resolutions"].select("session_id", "idx", "nummer", "top_nummer", "text")


@query(
    "record_tasks",
    _sql("""SELECT session_id, i::INT AS i, CASE WHEN kind = 6 THEN '2026-' || r END AS beschluss_nummer, CASE WHEN kind = 6 THEN 'Finanzierungskonzept / beauftragte Vorlage' ELSE 'Zugesagte schriftliche Vorlage' END AS text,
CASE WHEN kind = 6 THEN 'Bauamt' ELSE coalesce(nullif(fraktion, ''), name) END AS zustaendig, CASE WHEN kind = 6 THEN '3. Juni 2026' ELSE '5. Juli 2026' END AS frist, CASE WHEN kind = 7 THEN top END AS top_nummer FROM tasks"""),
)
def record_tasks(spark, d):
    """Tasks of resolutions and pledges, with who is responsible and until when."""
    return record(spark, d)["tasks"].select("session_id", "i", "beschluss_nummer", "text", "zustaendig", "frist", "top_nummer")


@query("record_checks", _sql(f", {_CHECKS} SELECT session_id, i::INT AS i, verdikt, quelle, score FROM checks"))
def record_checks(spark, d):
    """The statements of a record against evidence."""
    return checks(record(spark, d)).select("session_id", "i", "verdikt", F.col("quelle.titel").alias("quelle"), "score")


def _dash(spark, d, name: str, with_checks: bool = False) -> DataFrame:
    """A table of the dashboards."""
    lists = record(spark, d)
    return dashboards.session_dashboard(lists, checks(lists) if with_checks else None, (name,))[name]


_SHARE = "SELECT session_id, fraktion, sum(woerter)::BIGINT AS woerter, min(idx) AS ord FROM u WHERE fraktion <> '' GROUP BY 1, 2"


@query("dash_word_share", _sql(f"SELECT session_id, fraktion, woerter, round(100 * woerter / sum(woerter) OVER (PARTITION BY session_id), 1)::DOUBLE AS prozent, row_number() OVER (PARTITION BY session_id ORDER BY woerter DESC, ord)::INT AS rang FROM ({_SHARE})"))
def dash_word_share(spark, d):
    """Share of words by party."""
    return _dash(spark, d, "sprachanteil_fraktion").select("session_id", "fraktion", "woerter", "prozent", "rang")


_ITEMS = """it AS (SELECT s.session_id, s.top, sum(woerter)::BIGINT AS woerter, min(idx) AS ord, 1 + count(*) FILTER (kind = 0) AS hits FROM speeches s GROUP BY 1, 2)"""


@query("dash_items", _sql(f", {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY woerter DESC, ord)::INT AS rang FROM it) SELECT session_id, top AS top_nummer, woerter, 'Haushalt ' || top AS titel, CASE WHEN hits >= 2 THEN 'Haushalt & Schulden' END AS thema, rang FROM r WHERE rang <= 30"))
def dash_items(spark, d):
    """Words by agenda item, with title and subject."""
    return _dash(spark, d, "top_themen").select("session_id", "top_nummer", "woerter", "titel", "thema", "rang")


@query("dash_subjects", _sql(f", {_ITEMS} SELECT session_id, CASE WHEN hits >= 2 THEN 'Haushalt & Schulden' ELSE 'Sonstige / Verfahren' END AS thema, sum(woerter)::BIGINT AS woerter FROM it GROUP BY 1, 2"))
def dash_subjects(spark, d):
    """Words by subject."""
    return _dash(spark, d, "sachthemen").select("session_id", "thema", "woerter")


@query(
    "dash_speakers",
    _sql("""SELECT session_id, name, woerter, reden, fraktion, rang FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY woerter DESC, ord)::INT AS rang FROM
(SELECT session_id, name, sum(woerter)::BIGINT AS woerter, count(*) AS reden, arg_max(fraktion, idx) AS fraktion, min(idx) AS ord FROM speeches GROUP BY 1, 2)) WHERE rang <= 15"""),
)
def dash_speakers(spark, d):
    """The speakers of most words, with the party of their last speech."""
    return _dash(spark, d, "redner").select("session_id", "name", "woerter", "reden", "fraktion", "rang")


_POLAR = "count(*) FILTER (typ IN ('Beifall', 'Heiterkeit')) AS positiv, count(*) FILTER (typ IN ('Zwischenruf', 'Widerspruch', 'Missfallen')) AS negativ"


@query("dash_feedback_items", _sql(f"SELECT session_id, top AS key, {_POLAR} FROM reactions GROUP BY 1, 2"))
def dash_feedback_items(spark, d):
    """Reactions of both polarities by agenda item."""
    return _dash(spark, d, "feedback_je_thema").select("session_id", "key", "positiv", "negativ")


@query("dash_feedback_given", _sql(f"SELECT session_id, urheber AS key, {_POLAR} FROM reactions WHERE urheber IS NOT NULL GROUP BY 1, 2"))
def dash_feedback_given(spark, d):
    """By who gives them."""
    return _dash(spark, d, "feedback_gegeben_fraktion").select("session_id", "key", "positiv", "negativ")


@query("dash_feedback_received", _sql(f"SELECT r.session_id, u.fraktion AS key, {_POLAR} FROM reactions r JOIN u ON u.session_id = r.session_id AND u.idx = r.rede_index WHERE u.fraktion <> '' GROUP BY 1, 2"))
def dash_feedback_received(spark, d):
    """By the party of who was interrupted."""
    return _dash(spark, d, "feedback_erhalten_fraktion").select("session_id", "key", "positiv", "negativ")



@query(
    "dash_figures",
    _sql(f""", {_CHECKS} SELECT w.session_id, w.woerter, coalesce(s.n, 0) AS reden, 0::BIGINT AS schriftliche_beitraege, coalesce(t.n, 0) AS tops, coalesce(r.n, 0) AS saalreaktionen, coalesce(c.n, 0) AS gepruefte_aussagen, round_even(w.woerter / 130.0, 0)::BIGINT AS gesamtzeit_min
FROM (SELECT session_id, sum(woerter)::BIGINT AS woerter FROM u GROUP BY 1) w LEFT JOIN (SELECT session_id, count(*) AS n FROM speeches GROUP BY 1) s USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM tops GROUP BY 1) t USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS n FROM reactions GROUP BY 1) r USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM checks GROUP BY 1) c USING (session_id)"""),
)
def dash_figures(spark, d):
    """The figures of each session."""
    return _dash(spark, d, "kennzahlen", True).select("session_id", "woerter", "reden", "schriftliche_beitraege", "tops", "saalreaktionen", "gepruefte_aussagen", "gesamtzeit_min")


@query("dash_verdicts", _sql(f", {_CHECKS} SELECT session_id, verdikt, count(*) AS n FROM checks GROUP BY 1, 2"))
def dash_verdicts(spark, d):
    """Verdicts of each session."""
    return _dash(spark, d, "faktencheck_bilanz", True).select("session_id", "verdikt", "n")


@query("corpus_speakers", _sql("SELECT name AS person, sum(woerter)::BIGINT AS woerter, count(DISTINCT session_id) AS sitzungen FROM speeches GROUP BY 1"))
def corpus_speakers(spark, d):
    """Speakers over all sessions, from uncut tables."""
    lists = record(spark, d)
    return dashboards.corpus_dashboard(dashboards.session_dashboard(lists), lists)["redner_genau"].select("person", "woerter", "sitzungen")


@query("corpus_figures", _sql("SELECT (SELECT sum(woerter)::BIGINT FROM u) AS woerter, (SELECT count(*) FROM speeches) AS reden, (SELECT count(*) FROM tops) AS tops, (SELECT count(*) FROM reactions) AS saalreaktionen"))
def corpus_figures(spark, d):
    """Sums of the figures over sessions."""
    return dashboards.corpus_dashboard(dashboards.session_dashboard(record(spark, d)))["kennzahlen"].select("woerter", "reden", "tops", "saalreaktionen")


def _graph(spark, d, with_checks: bool = False, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph of all sessions; statements, which several kinds of nodes and edges are made of, are stored where the whole graph is asked for."""
    lists = record(spark, d)
    if with_checks or whole:
        lists["statements"] = algorithms.stored(lists["statements"], "statements")
    return G.build_graph(lists | ({"checks": checks(lists)} if with_checks else {}))


@query(
    "graph_nodes",
    _sql(f""", {_CHECKS} SELECT 'Sitzung' AS type, count(*) AS n FROM meeting UNION ALL SELECT 'Norm', (SELECT count(*) FROM meeting) + (SELECT count(DISTINCT session_id) FROM recusals) UNION ALL SELECT 'Person', count(*) FROM people
UNION ALL SELECT 'Fraktion', count(DISTINCT (session_id, fraktion)) FROM people WHERE fraktion <> '' UNION ALL SELECT 'Tagesordnungspunkt', count(*) FROM tops UNION ALL SELECT 'Antrag', count(*) FROM motions
UNION ALL SELECT 'Abstimmung', count(DISTINCT (session_id, top)) FROM votes UNION ALL SELECT 'Beschluss', count(*) FROM resolutions UNION ALL SELECT 'Aufgabe', count(*) FROM tasks UNION ALL SELECT 'Redebeitrag', count(*) FROM speeches
UNION ALL SELECT 'Frage', count(*) FROM questions UNION ALL SELECT 'Aussage', count(*) FROM statements UNION ALL SELECT 'Faktencheck', count(*) FROM checks UNION ALL SELECT 'Quelle', count(DISTINCT (session_id, quelle)) FROM checks
UNION ALL SELECT 'AkustischesEreignis', count(*) FROM reactions UNION ALL SELECT 'Transkriptsegment', count(*) FROM u"""),
)
def graph_nodes(spark, d):
    """Nodes of the graph by type."""
    return Graph(*_graph(spark, d, True)).schema()[0].select("type", "n")


@query(
    "graph_edges",
    _sql(f""", {_CHECKS}, known AS (SELECT session_id, nummer AS top FROM tops) SELECT 'BESCHLUSSFAEHIG_NACH' AS relationship_type, count(*) AS n FROM meeting UNION ALL SELECT 'MITGLIED_VON', count(*) FROM people WHERE fraktion <> '' UNION ALL SELECT 'GELEITET_VON', count(*) FROM people WHERE rolle = 'Vorsitz'
UNION ALL SELECT 'HAT_TOP', count(*) FROM tops UNION ALL SELECT 'BEHANDELT_ANTRAG', count(*) FROM motions UNION ALL SELECT 'ENTSCHIEDEN_DURCH', count(*) FROM votes
UNION ALL SELECT 'FUEHRT_ZU', count(*) FROM resolutions r WHERE EXISTS (SELECT 1 FROM votes v WHERE v.session_id = r.session_id AND v.top = r.top) UNION ALL SELECT 'ERGEBNIS_BESCHLUSS', count(*) FROM resolutions WHERE top IS NOT NULL
UNION ALL SELECT 'ERZEUGT_AUFGABE', count(*) FROM tasks WHERE kind = 6 OR top IS NOT NULL UNION ALL SELECT 'BEFANGEN_BEI', count(*) FROM recusals UNION ALL SELECT 'BEFANGENHEIT_NACH', count(*) FROM recusals
UNION ALL SELECT 'HAT_REDEBEITRAG', count(*) FROM speeches UNION ALL SELECT 'ZU_TOP', (SELECT count(*) FROM speeches) + (SELECT count(*) FROM questions) + (SELECT count(*) FROM statements) UNION ALL SELECT 'STELLT_FRAGE', count(*) FROM questions
UNION ALL SELECT 'TAETIGT_AUSSAGE', count(*) FROM statements UNION ALL SELECT 'GEPRUEFT_ALS', count(*) FROM checks UNION ALL SELECT 'BELEGT_MIT', count(*) FROM checks UNION ALL SELECT 'HAT_REAKTION', count(*) FROM reactions JOIN known USING (session_id, top)
UNION ALL SELECT 'REAKTION_AUF', count(*) FROM reactions UNION ALL SELECT 'BELEGT_DURCH', (SELECT count(*) FROM reactions) + (SELECT count(*) FROM tops) + (SELECT count(*) FROM resolutions) + (SELECT count(*) FROM votes) + (SELECT count(*) FROM speeches) + (SELECT count(*) FROM statements)"""),
)
def graph_edges(spark, d):
    """Edges of the graph by type."""
    return _graph(spark, d, True)[1].groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))


@query("graph_json_round_trip", _sql("SELECT session_id, 'gemo_18' AS target_id, 'person_person_' || (substr(name, 8)) AS source_id, 'BEFANGENHEIT_NACH' AS relationship_type, NULL::VARCHAR AS grund FROM recusals UNION ALL SELECT session_id, 'top_' || top, 'person_person_' || (substr(name, 8)), 'BEFANGEN_BEI', 'Paragraph 18 der Gemeindeordnung' FROM recusals"))
def graph_json_round_trip(spark, d):
    """Graph documents written and read again, edge properties included."""
    from ..sources import inputs, sinks

    _, edges = inputs.read_graph_json(sinks.graph_json(*_graph(spark, d)))
    return edges.where("relationship_type LIKE 'BEFANGEN%'").select("session_id", "source_id", "target_id", "relationship_type", F.col("props")["rechtsgrundlage"].alias("grund"))


@query("graph_statements", _sql("SELECT 2 AS section, 'MATCH (a {id: $source}), (b {id: $target}) MERGE (a)-[r:BEFANGEN_BEI]->(b) SET r += $props' AS statement, 'Paragraph 18 der Gemeindeordnung' AS grund, count(*) AS n FROM recusals HAVING count(*) > 0"))
def graph_statements(spark, d):
    """Statements that write edges with their properties."""
    from ..sources import sinks

    s = sinks.statements(*_graph(spark, d)).where("statement LIKE '%BEFANGEN_BEI%'")
    return s.groupBy("section", "statement", F.col("params")["rechtsgrundlage"].alias("grund")).agg(F.count(F.lit(1)).alias("n"))


@query("graph_resolutions", _sql("""SELECT r.session_id, r.nummer AS beschluss, v.ja, v.nein, v.enthaltung, v.ergebnis, 'Prot. ' || u.name AS cited FROM resolutions r JOIN u ON u.session_id = r.session_id AND u.idx = r.idx
LEFT JOIN (SELECT session_id, top, '3' AS ja, arg_min(v, idx) AS nein, '1' AS enthaltung, arg_min(o, idx) AS ergebnis FROM votes GROUP BY 1, 2) v ON v.session_id = r.session_id AND v.top = r.top"""))
def graph_resolutions(spark, d):
    """Resolutions with vote and citation."""
    return Graph(*_graph(spark, d)).resolutions().select("session_id", "beschluss", "ja", "nein", "enthaltung", "ergebnis", "cited")


@query(
    "graph_tasks",
    _sql("""SELECT t.session_id, 'aufgabe_' || t.i AS task, CASE WHEN kind = 6 THEN 'Bauamt' ELSE coalesce(nullif(fraktion, ''), name) END AS zustaendig, CASE WHEN kind = 6 THEN '3. Juni 2026' ELSE '5. Juli 2026' END AS frist,
CASE WHEN kind = 6 THEN 'Beschluss 2026-' || r WHEN t.top IS NOT NULL THEN 'TOP ' || t.top || ': Haushalt ' || t.top END AS aus FROM tasks t"""),
)
def graph_tasks(spark, d):
    """Tasks and deadlines, asked in words."""
    return ask(Graph(*_graph(spark, d)), "Welche Aufgaben und Fristen gibt es?").select("session_id", "task", "zustaendig", "frist", "aus")


@query("graph_recusals", _sql("SELECT session_id, name AS person, 'TOP ' || top || ': Haushalt ' || top AS top FROM recusals"))
def graph_recusals(spark, d):
    """Recusals, asked in words."""
    return ask(Graph(*_graph(spark, d)), "Wer war befangen?").select("session_id", "person", "top")


@query("graph_quorum", _sql("SELECT session_id, true AS beschlussfaehig, 'GemO §37 Beschlussfähigkeit' AS norm FROM meeting"))
def graph_quorum(spark, d):
    """Quorum and its norm."""
    return ask(Graph(*_graph(spark, d)), "War der Rat beschlussfähig?").select("session_id", "beschlussfaehig", "norm")


@query("graph_vote_on", _sql("SELECT v.session_id, 'TOP 3: Haushalt 3' AS top_label, v.ergebnis, r.nummer AS beschluss FROM (SELECT session_id, top, arg_min(o, idx) AS ergebnis, count(*) AS n FROM votes WHERE top = 3 GROUP BY 1, 2) v JOIN votes w ON w.session_id = v.session_id AND w.top = v.top LEFT JOIN resolutions r ON r.session_id = v.session_id AND r.top = v.top"))
def graph_vote_on(spark, d):
    """I8: votes on an agenda item, with what they led to."""
    v = Graph(*_graph(spark, d)).vote_on("Haushalt 3")
    return v.select("session_id", "top_label", "ergebnis", F.replace("beschluss", F.lit("Beschluss "), F.lit("")).alias("beschluss"))


@query("graph_fact_checks", _sql(f", {_CHECKS} SELECT session_id, name AS person, stated AS aussage, verdikt, quelle FROM checks WHERE verdikt IN ('falsch', 'irreführend')"))
def graph_fact_checks(spark, d):
    """Doubtful statements with person, verdict and source."""
    return Graph(*_graph(spark, d, True)).fact_checks(["falsch", "irreführend"]).select("session_id", "person", "aussage", "verdikt", "quelle")


@query("graph_applause_received", _sql("SELECT p.fraktion, count(*) AS beifall FROM reactions r JOIN speeches s ON s.session_id = r.session_id AND s.idx = r.rede_index JOIN people p ON p.session_id = s.session_id AND p.name = s.name WHERE typ = 'Beifall' AND p.fraktion <> '' GROUP BY 1"))
def graph_applause_received(spark, d):
    """Applause by the party of the speech, over four hops."""
    return Graph(*_graph(spark, d)).applause_received().select("fraktion", "beifall")


@query("graph_reaction_counts", _sql("SELECT typ, count(*) AS n FROM reactions GROUP BY 1"))
def graph_reaction_counts(spark, d):
    """Reactions by kind."""
    return Graph(*_graph(spark, d)).reaction_counts().select("typ", "n")


@query("graph_applause_givers", _sql("SELECT urheber AS fraktion, count(*) AS n FROM reactions WHERE typ = 'Beifall' AND urheber IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"))
def graph_applause_givers(spark, d):
    """The report of who applauds most."""
    return Graph(*_graph(spark, d)).applause_givers().select("fraktion", "n")


@query("graph_session_counts", _sql("SELECT m.session_id, coalesce(t.n, 0) AS tops, coalesce(s.n, 0) AS reden, coalesce(r.n, 0) AS reaktionen FROM meeting m LEFT JOIN (SELECT session_id, count(*) AS n FROM tops GROUP BY 1) t USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM speeches GROUP BY 1) s USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM reactions GROUP BY 1) r USING (session_id)"))
def graph_session_counts(spark, d):
    """Distinct items, speeches and reactions of each session."""
    return Graph(*_graph(spark, d)).session_counts().select("session_id", "tops", "reden", "reaktionen")


@query("graph_speakers", _sql("SELECT name AS person, count(DISTINCT session_id) AS sitzungen, count(*) AS reden FROM speeches GROUP BY 1 HAVING count(DISTINCT session_id) >= 2 ORDER BY 3 DESC, 1 LIMIT 10"))
def graph_speakers(spark, d):
    """The report of the persons who speak most, in two sessions at least."""
    return Graph(*_graph(spark, d)).speakers(2, 10).select("person", "sitzungen", "reden")


@query("graph_co_speech", _sql("SELECT 'person_person_' || substr(a.name, 8) AS source, 'person_person_' || substr(b.name, 8) AS target, count(DISTINCT (a.session_id, a.top)) AS weight FROM (SELECT DISTINCT session_id, top, name FROM speeches) a JOIN (SELECT DISTINCT session_id, top, name FROM speeches) b ON a.session_id = b.session_id AND a.top = b.top AND 'person_person_' || substr(a.name, 8) < 'person_person_' || substr(b.name, 8) GROUP BY 1, 2"))
def graph_co_speech(spark, d):
    """Persons by the agenda items that both speak to."""
    return Graph(*_graph(spark, d)).co_speech()


@query("graph_unproven", _sql("SELECT session_id, 'redebeitrag_' || idx AS speech FROM speeches WHERE idx % 7 = 0"))
def graph_unproven(spark, d):
    """Speeches that no segment backs, where every seventh proof is taken away."""
    nodes, edges = _graph(spark, d)
    gone = F.coalesce((F.col("relationship_type") == "BELEGT_DURCH") & (F.regexp_extract("target_id", r"segment_(\d+)$", 1).try_cast("long") % 7 == 0), F.lit(False))
    return Graph(nodes, edges.where(~gone)).unproven_speeches().select("session_id", "speech")


@query("graph_reviewed", _sql(f", {_CHECKS} SELECT session_id, 'faktencheck_' || i AS id, i % 5 = 0 AS menschlich_geprueft, CASE WHEN i % 10 = 0 THEN 'bestätigt' END AS verdikt_mensch FROM checks"))
def graph_reviewed(spark, d):
    """Human reviews beside the machine's verdict."""
    nodes, _ = _graph(spark, d, True)
    i = F.regexp_extract("id", r"_(\d+)$", 1).try_cast("long")
    r = nodes.where("type = 'Faktencheck'").where(i % 5 == 0).select("session_id", F.col("id").alias("faktencheck_id"), F.lit("wer").alias("geprueft_von"), F.when(i % 10 == 0, "korrigiert").otherwise("bestaetigt").alias("status"), F.lit("bestätigt").alias("verdikt_neu"), F.lit("2026").alias("stand"), F.lit("").alias("notiz"))
    return G.reviewed(nodes, r).select("session_id", "id", "menschlich_geprueft", "verdikt_mensch")


@query("graph_person_degrees", _sql("SELECT 'Person' AS type, (SELECT count(DISTINCT name) FROM people) AS n, (SELECT count(*) FROM people WHERE fraktion <> '') + (SELECT count(*) FROM people WHERE rolle = 'Vorsitz') + 2 * (SELECT count(*) FROM recusals) + (SELECT count(*) FROM speeches) + (SELECT count(*) FROM questions) + (SELECT count(*) FROM statements) AS deg"))
def graph_person_degrees(spark, d):
    """Degrees of the persons, in any direction."""
    g = Graph(*_graph(spark, d, whole=True)).degrees("Person")
    return g.agg(F.lit("Person").alias("type"), F.count(F.lit(1)).alias("n"), F.sum("deg").alias("deg"))


@query("graph_merged_persons", _sql("SELECT session_id, 'Fraktion' AS type, count(DISTINCT fraktion) AS n FROM people WHERE fraktion <> '' GROUP BY 1"))
def graph_merged_persons(spark, d):
    """Nodes merged by a map keep their session and all other columns."""
    nodes, edges = G.namespaced(*_graph(spark, d, whole=True), shared=[])
    ids = nodes.where("type = 'Person'").select(F.col("id").alias("old"), F.regexp_replace("id", r"_\d$", "_9").alias("new"))
    merged, _ = G.remapped(nodes, edges, ids)
    return merged.where("type = 'Fraktion' AND schicht = 'fallbezug' AND subtype = 'Ratsfraktion'").groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n"))
