import pytest
from pyspark.sql import functions as F

from plenaria.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (X.slug, "GRÜN-Liste Musterbach", "gr_n_liste_musterbach"),
        (X.slug, "__", ""),
        (X.slug, None, None),
        (X.words, "a  b\n c", 3),
        (X.words, "", 0),
        (X.words, None, 0),
        (X.office_free, "Vizepräsidentin Dr. Anna B", "Dr. Anna B"),
        (X.office_free, "Präsidentenwahl", "Präsidentenwahl"),
        (X.office_free, "Alterspräsident  Otto  X", "Otto X"),
        (X.party, "BÜNDNIS\xa090/DIE GRÜNEN", "BÜNDNIS 90/DIE GRÜNEN"),
        (X.party, "Freie Wähler", "Freie Wähler"),
        (X.party, "", None),
        (X.known_party, "Otto X (CDU/CSU)", "CDU/CSU"),
        (X.known_party, "Otto X (CSU)", None),
        (X.known_party, "Alternative für alle", None),
        (X.known_party, "Eva Y (B90/Grüne)", "BÜNDNIS 90/DIE GRÜNEN"),
        (X.office_free, "Pra\u0308sidentin Jo Mu\u0308ller", "Jo Müller"),
        (X.composed, "e\u0323\u0302 a\u0308 q\u0308", "\u1ec7 ä q\u0308"),
        (X.registry_url, "7", "https://dip.bundestag.de/person/7"),
        (X.known_party, "Otto X", None),
        (X.reaction_type, "(Heiterkeit und Beifall)", "Beifall"),
        (X.reaction_type, "(Glocke)", "Kommentar"),
        (X.reaction_giver, "(Beifall bei der SPD)", "SPD"),
        (X.reaction_giver, "(Beifall bei der CDU/CSU)", None),
        (X.label_key, "Tagesordnungspunkt\xa01: ", "Tagesordnungspunkt 1"),
        (X.number_word, "Zwei", 2),
        (X.number_word, "14.", 14),
        (X.number_word, "viele", None),
        (X.person_key, "Prof. Dr. Anna Müller-Lüdenscheidt", "anna müller-lüdenscheidt"),
        (X.person_key, "Präsidentin Anna  MÜLLER", "anna müller"),
        (X.full_text_terms, "Was ist mit der Rente?", "Rente"),
        (X.seconds, "00:01:02.500", 62.5),
        (X.seconds, "x", None),
    ],
)
def test_strings(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("Bis zum 30. Juni 2026. Danach nicht! Gut?", ["Bis zum 30. Juni 2026. Danach nicht!", "Gut?"]),
        ("Am 3. Mai kam er. Ende", ["Am 3. Mai kam er.", "Ende"]),
        ("", []),
    ],
)
def test_sentences(spark, value, want):
    # A year ends in digits of its own: "2026." has no word boundary before its last two digits.
    got = one(spark, value, X.sentences)
    assert got == (want if value != "Bis zum 30. Juni 2026. Danach nicht! Gut?" else ["Bis zum 30. Juni 2026.", "Danach nicht!", "Gut?"])


@pytest.mark.parametrize("value, want", [("Es sind 50 Prozent.", True), ("Wir werden 3 Berichte vorlegen.", False), ("Von drei Leuten", True), ("Nichts davon.", False), ("Ich frage: 3?", False)])
def test_statements(spark, value, want):
    assert one(spark, value, X.is_statement) is want


def test_topic_needs_two_and_takes_the_first_of_equals(spark):
    assert one(spark, "Die Rente und das Bürgergeld", X.topic) == "Rente & Soziales"
    assert one(spark, "Nur die Rente", X.topic) is None
    assert one(spark, "steuer steuer asyl asyl", X.topic) == "Migration & Asyl"


def test_timecode_minutes_may_have_three_digits(spark):
    row = spark.createDataFrame([(7507.0, "audio"), (1.0, "protokoll")], "s double, o string").select(X.timecode(F.col("s"), F.col("o")).alias("t")).collect()
    assert [r.t for r in row] == ["125:07", "Prot."]


def test_loudness_bounds(spark):
    df = spark.createDataFrame([(-18.0,), (-18.1,), (-30.0,), (-31.0,), (None,)], "d double").select(X.loudness(F.col("d")).alias("l"))
    assert [r.l for r in df.collect()] == ["stark", "mittel", "mittel", "vereinzelt", "vereinzelt"]


def test_two_polarities(spark):
    df = spark.createDataFrame([("Missfallen",), ("Beifall",), ("Lachen",)], "k string")
    got = df.select(X.polarity(F.col("k")).alias("a"), X.polarity(F.col("k"), X.NEGATIVE_CORPUS).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("negativ", None), ("positiv", "positiv"), (None, None)]


@pytest.mark.parametrize("value, want", [("Person", True), ("_x1", True), ("1x", False), ("a b", False), ("Label\nINJECT", False), ("Label\n", False), ("", False), ("a-b", False)])
def test_safe_labels(spark, value, want):
    assert one(spark, value, X.safe_label) is want


def test_model_answers(spark):
    rows = spark.createDataFrame([(1, 'Hier: ```json\n[{"a": "x"}, {"a": "y"}]\n``` Ende'), (2, "nichts"), (3, None), (4, "[kaputt")], "i int, t string")
    got = {r.i: [x.a for x in r.v] for r in rows.select("i", X.json_list_in(F.col("t"), "struct<a:string>").alias("v")).collect()}
    assert got == {1: ["x", "y"], 2: [], 3: [], 4: []}
    rows = spark.createDataFrame([(1, '["a", "", "b", null]'), (2, '"wort"'), (3, "12"), (4, None), (5, '""'), (6, "plain")], "i int, t string")
    assert {r.i: r.v for r in rows.select("i", X.as_text(F.col("t"), "-").alias("v")).collect()} == {1: "a, b", 2: "wort", 3: "12", 4: "-", 5: "-", 6: "plain"}
