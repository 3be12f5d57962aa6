import json

import pytest
from pyspark.sql import functions as F

from plenaria.operators import graph
from plenaria.operators.dashboards import corpus_dashboard, plain_summary, session_dashboard
from plenaria.operators.graph_queries import Graph, ask, integrity
from plenaria.plans import jobs
from plenaria.sources import inputs, record, sinks

TRANSCRIPT = {
    "audio_file": "a.wav",
    "speaker_map": {
        "S0": {"name": "Frau Vorne", "rolle": "Vorsitz", "fraktion": None},
        "S1": {"name": "Herr Eins", "rolle": "Mitglied", "fraktion": "Liste A"},
        "S2": {"name": "Frau Zwei", "rolle": "Mitglied", "fraktion": "Liste B"},
    },
    "segments": [
        ["S0", "Ich eröffne die Sitzung am 3. Mai 2026. Wir sind beschlussfähig nach Paragraph 37 der Gemeindeordnung."],
        ["S0", "Tagesordnungspunkt 3: Neue Brücke. Bitte."],
        ["S1", "Wir beantragen den Bau. Von drei Wegen sind 50 Prozent kaputt. Ich frage: stimmt das?"],
        ["S2", "Ich erkläre mich für befangen."],
        ["S0", "Acht Jastimmen, zwei Gegenstimmen, eine Enthaltung. Damit angenommen."],
        ["S0", "Beschluss 2026-014: Die Verwaltung wird beauftragt, bis zum 1. Juli 2026 zu berichten. Zuständig ist das Bauamt"],
        ["S9", "Wer bin ich?"],
    ],
}
EVIDENCE = {"stand": "2026", "korpus_url": "https://k", "evidenz": [{"id": "e1", "schluesselbegriffe": ["wege", "prozent", "kaputt"], "verdikt": "falsch", "begruendung": "Nein.", "quelle": {"titel": "Straßenbericht", "stand": "2025", "url": "https://s"}}, {"id": "e2", "schluesselbegriffe": ["wege", "prozent", "kaputt"], "verdikt": "teilweise", "begruendung": "", "quelle": {"titel": "B", "stand": "", "url": ""}}]}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    t = TRANSCRIPT | {"segments": [{"start": 10.0 * i, "end": 10.0 * i + 9, "speaker": s, "text": x} for i, (s, x) in enumerate(TRANSCRIPT["segments"])]}
    (d / "rat.json").write_text(json.dumps(t, ensure_ascii=False))
    (d / "ev.json").write_text(json.dumps(EVIDENCE, ensure_ascii=False))
    events = [{"label": "Applause", "start_sec": 20.0, "end_sec": 22.0, "score": 0.9, "db": -18.0}, {"label": "Crowd", "start_sec": 500.0, "end_sec": 501.0, "score": 0.5}]
    (d / "sed.json").write_text(json.dumps({"audio_file": "a", "events": events}))
    lists = jobs.build_session(spark, str(d / "rat.json"), str(d / "ev.json"), str(d / "sed.json"))
    return {k: v.cache() for k, v in lists.items()}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rules(built):
    assert rows(built["meeting"], "datum", "beschlussfaehig", "rechtsgrundlage") == [("3. Mai 2026", True, "Paragraph 37 der Gemeindeordnung")]
    assert rows(built["tops"], "nummer", "titel") == [(3, "Neue Brücke")]
    assert rows(built["motions"], "steller", "top_nummer") == [("Liste A", 3)]
    assert rows(built["votes"], "ja", "nein", "enthaltung", "ergebnis") == [(8, 2, 1, "angenommen")]
    assert rows(built["resolutions"], "nummer", "top_nummer") == [("2026-014", 3)]
    assert rows(built["tasks"], "zustaendig", "frist") == [("Bauamt", "1. Juli 2026")]
    assert rows(built["recusals"], "person") == [("Frau Zwei",)]
    assert rows(built["statements"], "i", "text") == [(0, "Von drei Wegen sind 50 Prozent kaputt.")]
    assert rows(built["speeches"], "idx", "person") == [(2, "Herr Eins"), (3, "Frau Zwei"), (6, "Unbekannt (S9)")]
    assert rows(built["reactions"], "typ", "rede_index", "top_nummer", "intensitaet") == [("Beifall", 2, 3, "stark"), ("Unruhe", 6, 3, "vereinzelt")]


def test_every_check_has_a_source_and_first_evidence_wins(built):
    assert rows(built["checks"], "verdikt", "score", "quelle.titel") == [("falsch", 1.0, "Straßenbericht")]


def test_graph_counts_and_invariants(built):
    nodes, edges = built["nodes"], built["edges"]
    kinds = {r["type"]: r["count"] for r in nodes.groupBy("type").count().collect()}
    assert kinds == {"Sitzung": 1, "Norm": 2, "Person": 4, "Fraktion": 2, "Tagesordnungspunkt": 1, "Antrag": 1, "Abstimmung": 1, "Beschluss": 1, "Aufgabe": 1, "Redebeitrag": 3, "Aussage": 1, "Faktencheck": 1, "Quelle": 1, "AkustischesEreignis": 2, "Transkriptsegment": 7}
    g = Graph(nodes, edges)
    assert g.unproven_speeches().count() == 0
    assert graph.resolved_edges(nodes, edges).count() == edges.count()
    assert all(r.ok for r in integrity(g, 1).collect())
    n, e = graph.structural(nodes, edges)
    assert n.count() == nodes.count() - 7 and e.where("relationship_type = 'BELEGT_DURCH'").count() == 0


def test_namespacing_is_stable_for_shared_kinds(built):
    n, e = graph.namespaced(built["nodes"], built["edges"])
    ids = {r["id"] for r in n.collect()}
    assert "person_herr_eins" in ids and "rat:top_3" in ids and not any(i == "top_3" for i in ids)
    assert e.where("source_id = 'rat:top_3' AND target_id = 'rat:beschluss_2026-014'").count() == 1


def test_questions(built):
    g = Graph(built["nodes"], built["edges"])
    assert rows(ask(g, "Welche Beschlüsse gab es?"), "beschluss", "ja", "ergebnis") == [("2026-014", "8", "angenommen")]
    assert rows(ask(g, "Wer hat welche Aufgabe?"), "zustaendig", "frist") == [("Bauamt", "1. Juli 2026")]
    assert rows(ask(g, "Wer war befangen?"), "person") == [("Frau Zwei",)]
    assert rows(ask(g, "War der Rat beschlussfähig?"), "beschlussfaehig", "norm") == [(True, "GemO §37 Beschlussfähigkeit")]
    assert rows(ask(g, "Wie wurde zur Brücke abgestimmt?", "Brücke"), "ergebnis", "beschluss") == [("angenommen", "Beschluss 2026-014")]
    assert rows(ask(g, "Was ist falsch?"), "person", "verdikt", "quelle") == [("Herr Eins", "falsch", "Straßenbericht")]
    assert ask(g, "Welche Reaktionen gab es?").count() == 2
    assert rows(g.co_speech(), "source", "target", "weight") == [("person_frau_zwei", "person_herr_eins", 1), ("person_frau_zwei", "person_unbekannt_s9", 1), ("person_herr_eins", "person_unbekannt_s9", 1)]


def test_dashboard(built):
    d = session_dashboard(built, built["checks"])
    k = d["kennzahlen"].first()
    assert (k.reden, k.tops, k.saalreaktionen, k.gepruefte_aussagen, k.gesamtzeit_min) == (3, 1, 2, 1, 1)
    assert abs(sum(r.prozent for r in d["sprachanteil_fraktion"].collect()) - 100) < 0.2
    c = corpus_dashboard(d, built)
    assert c["kennzahlen"].first().reden == 3 and c["redner_genau"].count() == 3
    assert "TOP 3: Neue Brücke" in plain_summary(built).first().text


def test_sinks(spark, built, tmp_path):
    nodes, edges = built["nodes"], built["edges"]
    doc = json.loads(sinks.graph_json(nodes, edges).first().value)
    assert doc["metadata"]["node_count"] == nodes.count() == len(doc["nodes"])
    s = sinks.statements(nodes, edges)
    assert {r.section: r.n for r in sinks.load(s).collect()} == {0: 15, 1: nodes.count(), 2: edges.count()}
    sinks.write_csv(nodes, edges, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "nodes"), header=True).count() == nodes.count()
    sinks.write_script(nodes, edges, str(tmp_path / "script"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "script")).collect()]
    assert sum(x.startswith("MERGE (n:") for x in lines) == nodes.count()
    assert "<h2" in sinks.record_html(built).first().value


def test_graph_documents_keep_all_properties(spark, built):
    nodes, edges = built["nodes"], built["edges"]
    n, e = inputs.read_graph_json(sinks.graph_json(nodes, edges))
    flat = lambda df: sorted(str([dict(sorted(v.items())) if isinstance(v, dict) else v for v in r]) for r in df.select(sorted(df.columns)).collect())
    assert flat(n) == flat(nodes) and flat(e) == flat(edges)
    with_own = edges.where(F.size("props") > 0)
    assert with_own.count() > 0
    s = sinks.statements(nodes, edges).where("section = 2")
    assert s.where("statement LIKE '% SET r += $props'").count() == with_own.count()
    line = sinks.script(nodes, edges).where("value LIKE '%BEFANGEN_BEI%'").first().value
    assert "SET r += {rechtsgrundlage: " in line and "source:" not in line
    broken = spark.createDataFrame([("a", "{"), ("b", '{"nodes": [{"id": "1", "extra": "x"}]}')], "session_id string, value string")
    n, e = inputs.read_graph_json(broken)
    assert [(r.session_id, r.id, r.label, r.props) for r in n.collect()] == [("b", "1", None, {"extra": "x"})] and e.count() == 0


def test_merged_nodes_keep_their_columns(spark, built):
    from plenaria.operators import graph as G

    nodes, edges = G.namespaced(built["nodes"], built["edges"])
    two = [r.id for r in nodes.where("type = 'Person'").orderBy("id").limit(2).collect()]
    ids = spark.createDataFrame([(two[0], two[1]), (two[1], two[1])], "old string, new string")
    n, e = G.remapped(nodes, edges, ids)
    assert n.columns == nodes.columns and e.columns == edges.columns and n.count() == nodes.count() - 1
    kept, was = n.where(F.col("id") == two[1]).first(), nodes.where(F.col("id") == two[1]).first()
    assert (kept.session_id, kept.schicht, kept.props) == (was.session_id, was.schicht, was.props)
    assert e.where(F.col("source_id") == two[0]).count() == 0
    assert sinks.graph_json(n, e).count() == 1


def test_verdicts_and_counts(spark, built):
    from plenaria.operators import dashboards

    each, total = dashboards.graph_verdicts(built["nodes"])
    assert sum(r.n for r in each.collect()) == sum(r.n for r in total.collect()) == built["nodes"].where("type = 'Faktencheck'").count()
    c = dashboards.session_counts(built).first()
    assert (c.tops, c.reden) == (built["tops"].count(), built["speeches"].count())
    assert f"Redebeiträge: {c.reden}; Tagesordnungspunkte: {c.tops}; Wörter: " in plain_summary(built).first().text


XML = """<dbtplenarprotokoll wahlperiode="21" sitzung-nr="5" sitzung-datum="01.02.2026"><vorspann><inhaltsverzeichnis>
<ivz-block><ivz-block-titel>Tagesordnungspunkt 1:</ivz-block-titel><ivz-eintrag><redner/><ivz-eintrag-inhalt>R</ivz-eintrag-inhalt></ivz-eintrag><ivz-eintrag><ivz-eintrag-inhalt>Der  Haushalt</ivz-eintrag-inhalt></ivz-eintrag></ivz-block>
</inhaltsverzeichnis></vorspann><sitzungsverlauf><sitzungsbeginn><name>Präsidentin Anna Müller:</name><kommentar>(Beifall bei der SPD)</kommentar></sitzungsbeginn>
<tagesordnungspunkt top-id="Tagesordnungspunkt 1"><kommentar>(Unruhe)</kommentar>
<rede id="r1"><p klasse="redner"><redner id="1"><name><titel>Dr.</titel><vorname>Otto</vorname><nachname>X</nachname><fraktion>BÜNDNIS 90/DIE GRÜNEN</fraktion></name></redner>Dr. Otto X:</p><p>Es sind 50 <i>Prozent</i>.</p><kommentar>(Zuruf von der AfD)</kommentar><p>Schluss.</p></rede>
<name>Vizepräsident Karl Y:</name><kommentar>(Lachen)</kommentar></tagesordnungspunkt><zusatzpunkt top-id="ZP"/><sitzungsende/></sitzungsverlauf>
<anlagen><anlage><rede><p klasse="redner"><redner><name><vorname>Eva</vorname><nachname>Z</nachname><rolle><rolle_lang>Ministerin</rolle_lang></rolle></name></redner></p><p>Schriftlich.</p></rede></anlage></anlagen></dbtplenarprotokoll>"""


def test_record(spark):
    l = record.tables(record.parse_records(spark.createDataFrame([("s", XML)], "session_id string, xml string")))
    assert rows(l["tops"], "nummer", "titel") == [(1, "Sitzungseröffnung"), (2, "Der Haushalt"), (3, "Schriftliche Beiträge zu Protokoll (Anlagen)")]
    assert rows(l["utterances"], "idx", "speaker_name", "rolle", "fraktion", "text") == [(0, "Anna Müller", "Sitzungsleitung", None, ""), (1, "Dr. Otto X", "Abgeordneter", "BÜNDNIS 90/DIE GRÜNEN", "Es sind 50 Prozent. Schluss."), (2, "Karl Y", "Sitzungsleitung", None, ""), (3, "Eva Z", "Ministerin", None, "Schriftlich.")]
    assert [(r.typ, r.rede_index, r.urheber) for r in l["reactions"].orderBy("i").collect()] == [("Beifall", -1, "SPD"), ("Unruhe", -1, None), ("Zwischenruf", 1, "AfD"), ("Lachen", 1, None)]
    assert rows(l["speeches"], "idx", "schriftlich") == [(1, False), (3, True)]
    assert rows(l["statements"], "i", "person") == [(0, "Dr. Otto X")]


def test_broken_records_give_an_error_row(spark):
    bad = ["", "   ", "<a>", "<a><b></a>", "kein xml", "<a/><b/>", "<a>&nbsp;</a>"]
    items = record.parse_records(spark.createDataFrame([(f"x{i}", x) for i, x in enumerate(bad)] + [("y", XML)], "session_id string, xml string")).cache()
    l = record.tables(items)
    assert sorted(r.session_id for r in l["errors"].collect()) == [f"x{i}" for i in range(len(bad))]
    assert l["tops"].where("session_id = 'y'").count() == 3 and items.where("kind = 'session'").count() == 1


def test_empty_records(spark):
    empty = ["<dbtplenarprotokoll/>", "<dbtplenarprotokoll><sitzungsverlauf/></dbtplenarprotokoll>", "<x><sitzungsverlauf><tagesordnungspunkt/></sitzungsverlauf></x>", "<x><anlagen/></x>"]
    items = record.parse_records(spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(empty)], "session_id string, xml string"))
    assert [(r.session_id, r.kind) for r in items.orderBy("session_id").collect()] == [(f"s{i}", "session") for i in range(4)]


VTT = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nAnna M: Guten <b>Tag</b>\n\n00:00:02.000 --> 00:00:03.500\nAnna M: zusammen\nhier\n\n00:00:04.000 --> 00:00:05.000\nohne Namen\n\nkaputt\n"


def test_captions(spark):
    f = spark.createDataFrame([("v", VTT)], "session_id string, value string")
    assert rows(inputs.caption_segments(f), "idx", "start", "end", "speaker", "text") == [(0, 1.0, 3.5, "Anna M", "Guten Tag zusammen hier"), (1, 4.0, 5.0, "UNBEKANNT", "ohne Namen")]
    assert inputs.diarised(inputs.caption_segments(f)).first().speaker_map["Anna M"]["name"] == "Anna M"


def test_rolling_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n" + "\n\n".join(f"00:00:0{i}.000 --> 00:00:0{i + 1}.000\n{a}\n<c>{b}</c>" for i, (a, b) in enumerate([(" ", "eins"), ("eins", "zwei"), ("zwei", "drei")]))
    f = spark.createDataFrame([("v", vtt)], "session_id string, value string")
    assert rows(inputs.rolling_segments(f, 2), "idx", "start", "end", "text") == [(0, 0.0, 1.0, "eins zwei"), (1, 2.0, 2.0, "drei")]


def test_aligned_words_and_detected_events(spark):
    w = spark.createDataFrame([("s", 0, 0.0, 1.0, "a"), ("s", 1, 1.0, 2.0, "b"), ("s", 2, 5.0, 6.0, "c")], "session_id string, item_id int, start double, end double, text string")
    t = spark.createDataFrame([("s", 0, 0.0, 2.0, "X"), ("s", 1, 4.0, 6.0, "Y")], "session_id string, turn_id int, start double, end double, speaker string")
    assert rows(inputs.aligned_words(w, t), "speaker", "start", "end", "text") == [("X", 0.0, 2.0, "a b"), ("Y", 5.0, 6.0, "c")]
    frames = spark.createDataFrame([("s", "Applause", i, i * 0.5, 0.5, x, 0.01) for i, x in enumerate([0.1, 0.5, 0.9, 0.2, 0.4])], "session_id string, label string, frame int, at double, width double, score double, power double")
    assert rows(inputs.detected_events(frames), "start_sec", "end_sec", "score", "db", "typ", "intensitaet") == [(0.5, 1.5, 0.9, -20.0, "Beifall", "mittel"), (2.0, 2.5, 0.4, -20.0, "Beifall", "mittel")]


def test_feed_and_clips(spark):
    feed = '<rss><item><title>Otto X (SPD), 5. Sitzung, 01.02.2026 10:00</title><link>https://m/video?id=77</link><enclosure url="https://m/77.mp4"/><description>Text</description></item><item><title>ohne</title></item></rss>'
    c = inputs.feed_clips(spark.createDataFrame([(feed,)], "value string"))
    assert rows(inputs.session_clips(c, 5), "fvid", "fraktion", "nr", "datum", "uhr", "srt") == [("77", "SPD", 5, "01.02.2026", "10:00", "https://m/77.srt")]
    clips = spark.createDataFrame([("s", "A", "MdB", "SPD", "TOP 1", "1", "1", "1", "u1", "Es sind 3."), ("s", "B", "MdB", "CSU", "TOP 2", "1", "2", "2", "u2", "x"), ("s", "A", "MdB", "SPD", "TOP 1", "1", "3", "3", "u3", "y")], "session_id string, speaker string, role string, fraktion string, top string, datum string, uhr string, fvid string, url string, text string")
    l = jobs.ingest_clips(clips, ("G", "d", "o"))
    assert l["nodes"].where("type = 'Tagesordnungspunkt'").count() == 2 and l["nodes"].where("props['video_url'] = 'u2'").count() == 1


def test_reviews_never_overwrite_the_verdict(spark, built):
    r = spark.createDataFrame([("rat", "faktencheck_0", "P", "korrigiert", "bestätigt", "2026", "n")], "session_id string, faktencheck_id string, geprueft_von string, status string, verdikt_neu string, stand string, notiz string")
    got = graph.reviewed(built["nodes"], r).first()
    assert (got.subtype, got.verdikt_mensch, got.menschlich_geprueft) == ("falsch", "bestätigt", True)


def test_upsert_overlays_properties(spark):
    n = spark.createDataFrame([("a", "p", "L", "T", "", "x", {"k": "1", "j": "0"}, 1), ("b", "p", "M", "T", "", "x", {"k": "2"}, 2)], "session_id string, id string, label string, type string, subtype string, schicht string, props map<string,string>, ord int")
    got = graph.upserted(n, "ord").first()
    assert got.label == "M" and got.props == {"k": "2", "j": "0"}


def test_records_of_odd_shapes(spark):
    annex_first = '<x><anlagen><anlage><rede><p klasse="redner"/><p>A &#228; &lt;b&gt;</p><kommentar>(Beifall)</kommentar></rede></anlage></anlagen><sitzungsverlauf><tagesordnungspunkt top-id="T &quot;1&quot;"><kommentar>(Unruhe)</kommentar><rede><p>über <![CDATA[<rede>]]></p><p> </p></rede></tagesordnungspunkt><tagesordnungspunkt><name>Leer</name></tagesordnungspunkt></sitzungsverlauf></x>'
    no_course = "<x><y><tagesordnungspunkt top-id='7'><rede><p>eins</p></rede></tagesordnungspunkt></y></x>"
    l = record.tables(record.parse_records(spark.createDataFrame([("a", annex_first), ("n", no_course), ("o", None)], "session_id string, xml string")).cache())
    assert [tuple(r) for r in l["tops"].select("session_id", "nummer", "titel").orderBy("session_id", "nummer").collect()] == [("a", 1, 'T "1"'), ("a", 2, "Schriftliche Beiträge zu Protokoll (Anlagen)"), ("n", 1, "7")]
    assert [(r.session_id, r.idx, r.rolle, r.text) for r in l["utterances"].orderBy("session_id", "idx").collect()] == [("a", 0, "Redner", "über <rede>"), ("a", 1, "Redner", "A ä <b>"), ("n", 0, "Redner", "eins")]
    assert [(r.typ, r.rede_index) for r in l["reactions"].orderBy("session_id", "i").collect()] == [("Unruhe", -1), ("Beifall", 1)]
    assert [r.session_id for r in l["errors"].collect()] == ["o"]


def test_record_of_many_parts_needs_no_python(spark):
    long = "<x><sitzungsverlauf><tagesordnungspunkt>" + "".join(f"<rede><p>Wort {i}</p></rede>" for i in range(4000)) + "</tagesordnungspunkt></sitzungsverlauf></x>"
    items = record.parse_records(spark.createDataFrame([("s", long)], "session_id string, xml string"))
    assert items.where("kind = 'speech'").count() == 4000
    assert "Python" not in items._jdf.queryExecution().executedPlan().toString()


def test_records_are_parsed_once_where_their_documents_are(spark):
    texts = "<x><sitzungsverlauf><zusatzpunkt><rede><p klasse='redner'>Wer:</p><p> a <i> b</i>\t</p><p> </p><p>&#228;&amp;lt; e\u0301</p></rede></zusatzpunkt></sitzungsverlauf><anlagen><rede><p>c</p></rede></anlagen></x>"
    items = record.parse_records(spark.createDataFrame([("s", texts), ("t", "<x>")], "session_id string, xml string"))
    assert [(r.session_id, r.kind, r.block_no, r.text) for r in items.orderBy("session_id", "seq").collect()] == [("s", "session", None, None), ("s", "block", 1, None), ("s", "speech", 1, "a  b ä&lt; é"), ("s", "block", 2, None), ("s", "speech", 2, "c"), ("t", "error", None, None)]
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("posexplode(") == 1 and plan.count("Exchange ") == 1


def test_audio_frames_of_all_widths_and_broken_files(spark, tmp_path):
    import io
    import wave

    def wav(width, channels, values):
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(10)
            w.writeframes(b"".join((v + 128).to_bytes(1, "little") if width == 1 else v.to_bytes(width, "little", signed=True) for v in values))
        return held.getvalue()

    half = lambda width: 1 << (8 * width - 2)
    files = [(f"w{k}", wav(k, 1, [half(k)] * 10 + [0] * 10 + [-half(k)] * 5)) for k in (1, 2, 3, 4)]
    files += [("stereo", wav(2, 2, [half(2), -half(2)] * 10)), ("none", wav(2, 1, [])), ("broken", b"RIFF"), ("null", None)]
    f = inputs.audio_frames(spark.createDataFrame(files, "session_id string, content binary"), 1.0).collect()
    for k in (1, 2, 3, 4):
        assert [(r.frame, r.at, r.width, r.power) for r in f if r.session_id == f"w{k}"] == [(0, 0.0, 1.0, 0.25), (1, 1.0, 1.0, 0.0), (2, 2.0, 0.5, 0.25)]
    assert [r.power for r in f if r.session_id == "stereo"] == [0.0]
    assert sorted(r.session_id for r in f if r.error) == ["broken", "null"] and not any(r.session_id == "none" for r in f)
    (tmp_path / "a.wav").write_bytes(files[1][1])
    assert inputs.audio_frames(inputs.read_audio(spark, str(tmp_path)), 1.0).count() == 3


def test_events_find_their_session(spark):
    events = spark.createDataFrame([("a", 0), ("b", 1)], "session_id string, i int")
    u = lambda *s: spark.createDataFrame([(x,) for x in s], "session_id string")
    assert rows(jobs.of_sessions(events, u("rat", "rat")), "i", "session_id") == [(0, "rat"), (1, "rat")]
    assert rows(jobs.of_sessions(events, u("a", "b", "c")), "i", "session_id") == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError, match="events of b"):
        jobs.of_sessions(events, u("a", "c"))


def test_pairs_of_persons_are_counted_from_lists(spark, monkeypatch):
    """Blocks and parts of any size give each pair its items; no exchange is by pairs, of which there are many more than lines."""
    import itertools
    from collections import Counter

    from plenaria.operators import graph_queries

    monkeypatch.setattr(graph_queries, "BLOCK", 3)
    monkeypatch.setattr(graph_queries, "PART", 2)
    spoken = [(p, t) for p in range(12) for t in range(9) if (p * 7 + t * t) % 3]
    empty = F.expr("map()").cast("map<string,string>")
    made = spark.createDataFrame([(f"p{p:02}", f"r{p}-{t}", f"t{t}") for p, t in spoken], "p string, r string, t string")
    edge = lambda a, b, kind: made.select(F.lit("x").alias("session_id"), F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("relationship_type"), empty.alias("props"))
    found = graph_queries.Graph(None, edge("p", "r", "HAT_REDEBEITRAG").unionByName(edge("r", "t", "ZU_TOP"))).co_speech()
    want = Counter((f"p{a:02}", f"p{b:02}") for t in range(9) for a, b in itertools.combinations(sorted(p for p, x in spoken if x == t), 2))
    assert {(r.source, r.target): r.weight for r in found.collect()} == want
    assert "hashpartitioning(a, b," not in __import__("re").sub(r"#\d+L?", "", found._jdf.queryExecution().toString())


def test_large_graphs_have_several_documents(spark, monkeypatch):
    """No document holds a whole session whatever its size; all together hold every node and relationship, as they were."""
    monkeypatch.setattr(sinks, "PAGE", 10)
    props = F.create_map(F.lit("k"), F.col("id").cast("string"))
    at = lambda n: spark.range(n).select(F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("session_id"), "id", props.alias("props"))
    nodes = at(100).select("session_id", F.concat(F.lit("n"), "id").alias("id"), F.lit("l").alias("label"), F.lit("T").alias("type"), F.lit("").alias("subtype"), F.lit("s").alias("schicht"), "props")
    edges = at(300).select("session_id", F.lit("n0").alias("source_id"), F.concat(F.lit("n"), F.col("id") % 7).alias("target_id"), F.lit("R").alias("relationship_type"), "props")
    files = sinks.graph_json(nodes, edges)
    docs = [json.loads(r.value) for r in files.collect()]
    assert len(docs) > 10 and max(len(d.get("nodes", [])) + len(d.get("relationships", [])) for d in docs) < 50
    assert {(d["metadata"]["node_count"], d["metadata"]["relationship_count"]) for d in docs} == {(75, 225), (25, 75)}
    plain = lambda df: sorted(str({k: (dict(v) if isinstance(v, dict) else v) for k, v in sorted(r.asDict().items())}) for r in df.collect())
    for back, was in zip(inputs.read_graph_json(files), (nodes, edges)):
        assert plain(back) == plain(was.select(*back.columns))


def test_open_items_are_carried_once_for_all_lists(spark):
    from plenaria.operators import extract

    said = [(0, "Ich rufe Tagesordnungspunkt 3 auf: Haushalt."), (1, "Die Kosten stiegen um 12 Prozent."), (2, "Ich erkläre mich für befangen.")]
    u = spark.createDataFrame([("s", i, float(i), i + 1.0, "A", "Mitglied", "SPD", t, "protokoll") for i, t in said], "session_id string, idx long, start double, end double, speaker_name string, rolle string, fraktion string, text string, herkunft string")
    lists = extract.extract(u)
    for name in ("speeches", "recusals", "votes"):
        assert "Window" not in lists[name]._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.idx, r.top_nummer) for r in lists["recusals"].collect()] == [(2, 3)]


def test_frames_of_short_files_come_together():
    """A thousand short recordings and some broken ones in one table of rows, not one each; values as before."""
    import io
    import wave

    def made(samples):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(10)
            w.writeframes(bytes(samples))
        return out.getvalue()

    files = [(i, made([128 + 64] * (i % 20 + 1)) if i % 100 else b"x") for i in range(1000)]
    got = list(inputs._frames(iter(files), 1.0))
    assert len(got) == 1 and len(got[0]) == 10 + sum(1 + (i % 20 + 1 > 10) for i in range(1000) if i % 100)
    f = got[0]
    assert f[f["error"].notna()]["session_id"].tolist() == list(range(0, 1000, 100)) and f[f["error"].notna()]["frame"].isna().all()
    assert f[f["session_id"] == 19][["frame", "at", "width", "power"]].values.tolist() == [[0, 0.0, 1.0, 0.25], [1, 1.0, 1.0, 0.25]]


def test_projection_sends_pairs_as_packed_lists(spark, monkeypatch):
    """Groups of any size, larger than a batch and than a row, give each pair its groups once; pairs cross tasks packed, two bytes each or fewer."""
    import itertools
    from collections import Counter

    import numpy as np

    from plenaria.operators import projection

    spoken = [(t, (p * (t + 3)) % 101) for t in range(30) for p in range(3 + 7 * t)] + [(99, p) for p in range(400)]
    on = spark.createDataFrame(spoken * 2, "top long, a int").repartition(3, "top").sortWithinPartitions("top", "a")
    want = Counter(x for t in {t for t, _ in spoken} for x in itertools.combinations(sorted({a for u, a in spoken if u == t}), 2))
    monkeypatch.setattr(projection, "CHUNK", 500)
    monkeypatch.setattr(projection, "SHARE", 3000)
    for block in (3, 50, 1 << 16):
        items = projection.lists(on, block).cache()
        assert items.agg(F.max(F.length("sizes") + F.length("members"))).first()[0] <= 8 * max(block, 401)
        got = [tuple(r) for r in projection.counted(items, 1000).collect()]
        assert {r[:2]: r[2] for r in got} == want and len(got) == len(want)
    assert projection.counted(projection.lists(on.limit(0), 9), 9).count() == 0
    keys = np.unique(np.random.default_rng(1).integers(0, 1000, (400_000, 2)), axis=0).astype(np.uint64)
    keys = np.sort(keys[:, 0] << np.uint64(32) | keys[:, 1])
    packed = projection._packed(keys)
    assert (projection._unpacked(*packed) == keys).all() and len(__import__("zlib").compress(b"".join(packed), 1)) < 2 * len(keys)
    names = spark.createDataFrame([(f"p{i % 50:02}",) for i in range(200)] + [(None,)], "name string")
    assert rows(projection.numbered(names, "name"), "n", "name") == [(i, f"p{i:02}") for i in range(50)]


@pytest.mark.parametrize("measure", ["pagerank", "communities"])
def test_rounds_over_edges_move_nodes_only(spark, monkeypatch, measure):
    """Edges lie in buckets of the node that is summed for, so no round exchanges them or their sums; too many nodes to broadcast give the same."""
    from plenaria.operators import algorithms

    edges = spark.createDataFrame([(i, (i * i + 3) % 40, i % 3 + 1) for i in range(60)], "source long, target long, weight long")
    plans, was = [], algorithms.stored
    monkeypatch.setattr(algorithms, "stored", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), was(df, name))[1])
    found = sorted(map(tuple, getattr(algorithms, measure)(edges).collect()))
    own = [p for name, p in plans if name in ("ranks", "labels")]
    assert own and not any("Exchange hashpartitioning(a#" in p or "Exchange hashpartitioning(t#" in p or "Exchange hashpartitioning(b#" in p or "Exchange hashpartitioning(s#" in p for p in own)
    if measure == "communities":
        assert not any("Exchange hash" in p for p in own)
        plans.clear()
        whole = spark.createDataFrame([(i, j, 1) for i in range(6) for j in range(i)], "source long, target long, weight long")
        assert {r.community for r in algorithms.communities(whole).collect()} == {0}
        assert sum(name == "labels" for name, _ in plans) < 10  # it ends when no label changes
        assert algorithms.communities(edges, 0).where("id = community").count() == len(found)
    monkeypatch.setattr(algorithms, "NODES", 1)
    assert [(a, round(b, 9)) for a, b in sorted(map(tuple, getattr(algorithms, measure)(edges).collect()))] == [(a, round(b, 9)) for a, b in found]


def test_parts_of_records_run_compiled(spark):
    """Expressions of a part are too many for one method that the JVM compiles; a limit that is lower already stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    docs = spark.createDataFrame([("a", "<dbtplenarprotokoll/>"), ("b", "<a>")], "session_id string, xml string")
    was = spark.conf.get(limit)
    try:
        for before, after in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(limit, before)
            assert rows(record.parse_records(docs).select("session_id", "kind"), "session_id", "kind") == [("a", "session"), ("b", "error")]
            assert spark.conf.get(limit) == after
    finally:
        spark.conf.set(limit, was)


def test_graph_documents_move_their_entries_once(spark, monkeypatch):
    """Each list is dealt by session and part and never again; documents are what one to_json of the whole would write."""
    monkeypatch.setattr(sinks, "PAGE", 4)
    props = F.create_map(F.lit("z"), F.lit('quote " and \\'), F.lit("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")))
    at = lambda n, to: spark.range(n).select(F.when(F.col("id") < 2, "small").when(F.col("id") < to, "large").when(F.col("id") % 2 == 0, "only").alias("session_id"), "id", props.alias("props"))
    nodes = at(14, 14).select("session_id", F.concat(F.lit("n"), "id").alias("id"), F.lit(None).cast("string").alias("label"), F.lit("T").alias("type"), F.lit("").alias("subtype"), F.lit("s").alias("schicht"), "props")
    edges = at(80, 40).select("session_id", F.lit("n0").alias("source_id"), F.col("id").cast("string").alias("target_id"), F.lit("R").alias("relationship_type"), "props")
    found = sinks.graph_json(nodes, edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    docs = {(r.session_id, d["metadata"].get("part")): d for r in found.collect() for d in [json.loads(r.value)]}
    assert {k[0] for k in docs} == {"small", "large"}  # neither relationships without nodes nor rows without a session
    assert docs["small", None]["metadata"] == {"node_count": 2, "relationship_count": 2} and [n["id"] for n in docs["small", None]["nodes"]] == ["n0", "n1"]
    large = [d for k, d in docs.items() if k[0] == "large"]
    assert {tuple(sorted((k, v) for k, v in d["metadata"].items() if k != "part")) for d in large} == {(("node_count", 12), ("parts", 10), ("relationship_count", 38))}
    assert sum(len(d.get("nodes", [])) for d in large) == 12 and sum(len(d.get("relationships", [])) for d in large) == 38
    assert docs["small", None]["nodes"][1] == {"id": "n1", "type": "T", "subtype": "", "schicht": "s", "props": {"a": None, "z": 'quote " and \\'}}
