"""Column expressions for meeting records: normal forms, rules and classes of short texts.

All are built-in functions, so they stay inside code generation; null goes through as null unless a rule says
otherwise. Regular expressions carry (?U) where German letters must count as letters.
"""

from __future__ import annotations

import functools
import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles of the chair and the clerks, which are no members' speeches.
CHAIR_ROLES = "Vorsitz|räsident|Schriftführer|Sitzungsleitung"
# Number words of votes.
NUMBER_WORDS = {"null": 0, "keine": 0, "eine": 1, "ein": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10}
# Words of a comment by the reaction they name, in order of precedence.
REACTIONS = [("beifall", "Beifall"), ("heiterkeit", "Heiterkeit"), ("lachen", "Lachen"), ("widerspruch", "Widerspruch"), ("zuruf", "Zwischenruf"), ("gegenruf", "Zwischenruf"), ("buh", "Missfallen"), ("unruhe", "Unruhe")]
# Parts of party names by canonical party, in order of precedence.
PARTIES = [
    ("cdu", "CDU/CSU"),
    ("csu", "CDU/CSU"),
    ("bündnis 90", "BÜNDNIS 90/DIE GRÜNEN"),
    ("grüne", "BÜNDNIS 90/DIE GRÜNEN"),
    ("alternative für", "AfD"),
    ("afd", "AfD"),
    ("sozialdemokrat", "SPD"),
    ("spd", "SPD"),
    ("freie demokrat", "FDP"),
    ("fdp", "FDP"),
    ("die linke", "Die Linke"),
    ("linke", "Die Linke"),
    ("bsw", "BSW"),
    ("sahra wagenknecht", "BSW"),
    ("fraktionslos", "fraktionslos"),
]
# Parties as media feeds name them, in order of precedence.
FEED_PARTIES = [
    ("cdu/csu", "CDU/CSU"),
    ("b90/grüne", "BÜNDNIS 90/DIE GRÜNEN"),
    ("bündnis 90", "BÜNDNIS 90/DIE GRÜNEN"),
    ("grüne", "BÜNDNIS 90/DIE GRÜNEN"),
    ("afd", "AfD"),
    ("spd", "SPD"),
    ("fdp", "FDP"),
    ("die linke", "Die Linke"),
    ("linke", "Die Linke"),
    ("bsw", "BSW"),
    ("fraktionslos", "fraktionslos"),
]
# Classes of sounds by reaction.
SOUNDS = {
    "Applause": "Beifall",
    "Cheering": "Beifall",
    "Clapping": "Beifall",
    "Booing": "Missfallen",
    "Laughter": "Lachen",
    "Giggle": "Lachen",
    "Chuckle, chortle": "Lachen",
    "Crowd": "Unruhe",
    "Hubbub, speech noise, speech babble": "Unruhe",
    "Chatter": "Unruhe",
}
# Subjects by keyword, in order of precedence.
TOPICS = [
    ("Migration & Asyl", ["migration", "asyl", "flücht", "geflücht", "abschieb", "aufenthalt", "einwander"]),
    ("Krieg in der Ukraine", ["ukraine", "russland", "selenskyj", "putin", "waffenlief", "kriegs"]),
    ("Haushalt & Schulden", ["haushalt", "neuverschuld", "schuldenbremse", "etat", "staatsverschuld", "bundeshaushalt"]),
    ("Steuern & Finanzen", ["steuer", "mehrwertsteuer", "finanzpolit", "abgaben"]),
    ("Energie & Klima", ["energie", "klima", "windkraft", "windenerg", "kohle", "heizung", "erneuerbar", "co2"]),
    ("Verteidigung & Bundeswehr", ["bundeswehr", "verteidigung", "nato", "wehrpflicht", "rüstung", "aufrüst"]),
    ("Wirtschaft & Arbeit", ["wirtschaft", "arbeitsmarkt", "mindestlohn", "mittelstand", "industrie", "arbeitszeit"]),
    ("Rente & Soziales", ["rente", "bürgergeld", "grundsicher", "sozialstaat"]),
    ("Gesundheit & Pflege", ["gesundheit", "krankenhaus", "apothek", "pflege", "kranken"]),
    ("Wohnen & Bau", ["wohnen", "miete", "wohnungsbau", "städtebau", "bauland"]),
    ("Innere Sicherheit", ["polizei", "kriminal", "terror", "verfassungsschutz", "extremismus"]),
    ("Europa & EU", ["europäische union", "eu-haushalt", "binnenmarkt", "brüssel"]),
    ("Bildung & Forschung", ["bildung", "schule", "forschung", "wissenschaft", "ausbildung"]),
    ("Digitalisierung", ["digital", "künstliche intelligenz", "cyber", "internet"]),
    ("Verkehr & Mobilität", ["verkehr", "bahn", "autobahn", "mobilität", "luftverkehr"]),
    ("Landwirtschaft & Umwelt", ["landwirt", "umwelt", "tierschutz", "naturschutz"]),
]
NO_TOPIC = "Sonstige / Verfahren"
# Reactions by polarity.
POSITIVE = ["Beifall", "Heiterkeit"]
NEGATIVE_SESSION = ["Widerspruch", "Zwischenruf", "Missfallen", "Unruhe"]
#: Over several sessions Missfallen is no negative reaction.
NEGATIVE_CORPUS = ["Widerspruch", "Zwischenruf", "Unruhe"]
WORDS_PER_MINUTE = 130

_DAY = r"\d{1,2}\.\s*\w+\s*\d{4}"


def literal_map(values: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def slug(text: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def words(text: Column) -> Column:
    """Number of words between white space; 0 for null and empty texts."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def timecode(start: Column, origin: Column) -> Column:
    """mm:ss (minutes may have more than two digits) for audio, 'Prot.' for records."""
    s = F.floor(start).cast("long")
    return F.when(origin == "audio", F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))).otherwise(F.lit("Prot."))


def is_member(role: Column) -> Column:
    return ~F.coalesce(role, F.lit("")).rlike(CHAIR_ROLES)


def sentences(text: Column) -> Column:
    """Sentences, split after . ! ? at white space; ordinals of one or two digits ('30. Juni') don't end one."""
    marked = F.regexp_replace(text, r"(?U)([.!?])\s+", "$1\u0001")
    glued = F.regexp_replace(marked, "(?U)(\\b\\d{1,2}\\.)\u0001", "$1 ")
    return F.filter(F.transform(F.split(glued, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def is_checkable(sentence: Column) -> Column:
    """Holds a number, a percentage or a share, and announces no paper to come."""
    low = F.lower(sentence)
    return ~low.rlike("vorlegen|vorzulegen|wird .* vorle") & (low.rlike(r"\d") | low.contains("prozent") | low.rlike("von (drei|vier|fünf)"))


def is_statement(sentence: Column) -> Column:
    return is_checkable(sentence) & ~F.lower(sentence).contains("frage")


def number_word(token: Column) -> Column:
    """The integer that digits or a number word name, else null."""
    t = F.regexp_replace(F.lower(token), r"^[.,]+|[.,]+$", "")
    return F.coalesce(F.when(t.rlike(r"^\d+$"), t.try_cast("int")), literal_map(NUMBER_WORDS)[t])


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match, trimmed; null without a match."""
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def votes_before(text: Column, noun: str) -> Column:
    """The number named by the word before a noun, 0 if there is none."""
    return F.coalesce(number_word(F.regexp_extract(text, rf"(?iuU)(\w+)\s+{noun}", 1)), F.lit(0))


@functools.cache
def _compositions() -> tuple[str, str]:
    """Pairs of a letter and a combining mark, one behind another, and the letters that they make, by Unicode's rule, for
    Latin letters and the common marks."""
    bases = [chr(c) for c in (*range(0x41, 0x250), *range(0x1E00, 0x1F00)) if chr(c).isalpha()]
    both = [(b + chr(m), unicodedata.normalize("NFC", b + chr(m))) for b in bases for m in range(0x300, 0x32A)]
    return "".join(p for p, one in both if len(one) == 1), "".join(one for _, one in both if len(one) == 1)


def composed(text: Column) -> Column:
    """Latin letters with their combining marks as one code point (the NFC form); texts without marks aren't touched."""
    pairs, ones = map(F.lit, _compositions())
    for _ in range(2):  # a letter may have two marks
        parts = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}|."), F.lit(0))
        at = lambda x: F.instr(pairs, x)
        one = lambda x: F.when((F.length(x) == 2) & (at(x) > 0), F.substring(ones, F.shiftright(at(x) + 1, 1), F.lit(1))).otherwise(x)
        text = F.when(text.rlike(r"\p{M}"), F.array_join(F.transform(parts, one), "")).otherwise(text)
    return text


def office_free(name: Column) -> Column:
    """A name in composed letters without no-break spaces, leading offices and repeated spaces; academic titles stay."""
    plain = F.regexp_replace(composed(F.coalesce(name, F.lit(""))), " ", " ")
    office = r"(?iuU)^(\s*((alters|vize)?präsident(in)?|schriftführer(in)?)\b)+"
    return F.trim(F.regexp_replace(F.regexp_replace(plain, office, ""), r"(?U)\s+", " "))


def reaction_type(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for word, kind in REACTIONS:
        out = out.when(low.contains(word), F.lit(kind))
    return out.otherwise(F.lit("Kommentar"))


def reaction_giver(text: Column) -> Column:
    """Who reacts, as far as the comment names them; a name with a slash is not caught."""
    # Fixed value: the pattern of a giver.
    return first_group(text, r"(?U)(?:bei|von|der)\s+(?:der|dem)?\s*([A-ZÄÖÜ][\wäöüß .-]+?)(?:[:)]|$)")


def label_key(text: Column) -> Column:
    """Labels of agenda blocks in a form that compares."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), " ", " ")), ":+$", ""))


def party(text: Column) -> Column:
    """The canonical party, else the text with plain spaces; null for empty texts."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, " ", " "), r"(?U)\s+", " "))
    low = F.lower(plain)
    out = F.when(plain == "", F.lit(None).cast("string"))
    for part, canonical in PARTIES:
        out = out.when(low.contains(part), F.lit(canonical))
    return out.otherwise(plain)


def known_party(text: Column) -> Column:
    """The canonical party by the names that media feeds use, null if none is named."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for part, canonical in FEED_PARTIES:
        out = out.when(low.contains(part), F.lit(canonical))
    return out


def shortened(text: Column, limit: int = 200) -> Column:
    """Single spaces; longer texts are cut to limit - 1 characters and an ellipsis."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, " ", " "), r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def loudness(db: Column) -> Column:
    db = F.coalesce(db, F.lit(-40.0))
    return F.when(db >= -18, "stark").when(db >= -30, "mittel").otherwise("vereinzelt")


def sound_type(label: Column) -> Column:
    return F.coalesce(literal_map(SOUNDS)[label], F.lit("Unruhe"))


def polarity(kind: Column, negative: list[str] = NEGATIVE_SESSION) -> Column:
    return F.when(kind.isin(POSITIVE), "positiv").when(kind.isin(negative), "negativ")


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def topic(text: Column, topics: list[tuple[str, list[str]]] = TOPICS, least: int = 2) -> Column:
    """The subject whose keywords occur most often, the first of equals; null below the least count."""
    low = F.lower(text)
    scores = [sum((occurrences(low, w) for w in ws[1:]), occurrences(low, ws[0])) for _, ws in topics]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.when(best < least, F.lit(None).cast("string"))
    for (name, _), s in zip(topics, scores, strict=True):
        out = out.when(s == best, F.lit(name))
    return out


def query_terms(text: Column, stop: list[str], most: int = 8) -> Column:
    """A search query: capitalised words and words with digits, or all but stop words if those are fewer than three."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-zÄÖÜäöüß][\p{L}\p{N}_-]+"), F.lit(0))
    known = F.array(*[F.lit(w) for w in stop])
    plain = F.filter(found, lambda w: ~F.array_contains(known, F.lower(w)))
    strong = F.filter(found, lambda w: (w.rlike(r"^\p{Lu}") & ~F.array_contains(known, F.lower(w))) | w.rlike(r"\p{Nd}"))
    return F.array_join(F.slice(F.when(F.size(strong) < 3, plain).otherwise(strong), 1, most), " ")


def full_text_terms(question: Column) -> Column:
    """Words of more than three letters joined by OR, else the question."""
    found = F.filter(F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 3)
    return F.when(F.size(found) > 0, F.array_join(found, " OR ")).otherwise(question)


def person_key(name: Column) -> Column:
    """The key under which variants of a name meet: no offices, no academic titles, lower-case letters and spaces."""
    plain = F.lower(office_free(name))
    plain = F.regexp_replace(plain, r"(?U)\b(prof|dr|h\.?\s?c|med|jur|phil|ing|dipl|mag)\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\s-]+", " "), r"(?U)\s+", " "))


def has_office(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(r"(?iuU)^\s*((alters|vize)?präsident(in)?|schriftführer(in)?)\b")


def names_agree(first: Column, other: Column) -> Column:
    """One first name begins with the other (J. and Julia)."""
    a, b = F.regexp_replace(F.lower(first), r"\.$", ""), F.regexp_replace(F.lower(other), r"\.$", "")
    return F.startswith(a, b) | F.startswith(b, a)


def registry_url(registry_id: Column) -> Column:
    """The public page of a person of the registry."""
    return F.concat(F.lit("https://dip.bundestag.de/person/"), registry_id.cast("string"))


def safe_label(text: Column) -> Column:
    """Whether a label or type may stand in a graph statement."""
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z")


def thousands(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), ",", ".")


def gap_rating(wer: Column, recall: Column, gaps: Column) -> Column:
    """A sentence on the word error rate, the share of reactions found and the passages that are missing."""
    level = F.when(wer < 0.1, "gut").when(wer < 0.2, "akzeptabel").otherwise("kritisch")
    return F.concat(F.format_string("WER %.1f%% (%s); ", wer * 100, level), F.when(recall > 0.7, "Reaktionen ok; ").otherwise("Reaktionen fehlen; "), gaps.cast("string"), F.lit(" Lücken"))


def seconds(stamp: Column) -> Column:
    """Seconds of hh:mm:ss.mmm or hh:mm:ss,mmm."""
    p = r"(\d+):(\d{2}):(\d{2})[.,](\d{1,3})"
    part = [F.regexp_extract(stamp, p, i).cast("int") for i in (1, 2, 3)]
    ms = F.regexp_extract(stamp, p, 4).cast("int")
    return F.when(stamp.rlike(p), part[0] * 3600 + part[1] * 60 + part[2] + ms / 1000.0)


# How reactions and verdicts are put into words.
REACTION_WORDS = {"Beifall": "Beifall", "Heiterkeit": "Heiterkeit", "Lachen": "Gelächter", "Widerspruch": "Widerspruch", "Zwischenruf": "Zwischenruf", "Missfallen": "Missfallen", "Unruhe": "Unruhe"}
VERDICT_PHRASES = {"bestätigt": "ist bestätigt", "teilweise": "trifft teilweise zu", "irreführend": "ist irreführend", "falsch": "ist falsch", "unbelegt": "ist nicht belegt"}


def in_words(value: Column, words: dict[str, str]) -> Column:
    """The words for a value, or the value itself."""
    return F.coalesce(literal_map(words)[value], value)


def json_in(text: Column, schema: str) -> Column:
    """The first to the last brace of a text read as JSON; null where that fails."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def json_list_in(text: Column, schema: str) -> Column:
    """The first to the last bracket of a text read as a list of JSON objects; an empty list where that fails or there is none."""
    return F.coalesce(F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), f"array<{schema}>"), F.from_json(F.lit("[]"), f"array<{schema}>"))


def as_text(value: Column, default: str = "") -> Column:
    """A JSON value as text: the true parts of a list joined by commas, a text without quotes, else as it is written; the default for null and empty."""
    t = F.trim(value)
    parts = F.filter(F.from_json(t, "array<string>"), lambda x: x.isNotNull() & (x != "") & ~x.isin("0", "false"))
    plain = F.when(t.rlike(r"(?s)^\[.*\]$"), F.array_join(parts, ", ")).when(t.rlike(r'(?s)^".*"$'), F.get_json_object(F.concat(F.lit('{"x":'), t, F.lit("}")), "$.x")).otherwise(t)
    return F.when(value.isNull() | t.isin("", "null", '""'), F.lit(default)).otherwise(plain)


def session_ids(period: Column, number: Column) -> Column:
    """Names of a session: file (amt_21_005), prefix and label."""
    name = F.format_string("amt_%d_%03d", period, number)
    return F.struct(name.alias("file"), F.concat(name, F.lit(":")).alias("prefix"), F.format_string("Plenarprotokoll %d/%d", period, number).alias("label"))


def clip_title(topic: Column, top: Column, index: Column) -> Column:
    """The subject of a clip, else its agenda item, else its number."""
    return F.coalesce(F.nullif(F.trim(topic), F.lit("")), F.nullif(F.trim(top), F.lit("")), F.format_string("TOP %d", index + 1))
