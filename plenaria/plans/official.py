"""Queries over official XML records, written from the orders: a customer is a session, an order a speech.

Records have doubled agenda numbers, speeches without a speaker, empty paragraphs, references, reactions before the first speech,
an annex, and, for one customer of fifty, no well-formed XML. DuckDB says what must come out from the numbers alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.algorithms import saved
from ..sources import record
from .registry import query

#: What stands in place of a record in the sessions whose number leaves 49 by 50.
BROKEN = ["", "   ", "<a>", "<a><b></a>", "kein xml", "<a/><b/>"]

_SPEECH = """concat('<rede id="', k, '">', CASE WHEN annex AND k % 2 = 0 THEN '' ELSE concat('<p klasse="redner"><redner id="', k, '"><name>', CASE WHEN k % 3 = 0 THEN '<titel>Dr.</titel>' ELSE '' END,
  '<vorname>Jo</vorname><nachname>N', k % 23, '</nachname>', CASE k % 4 WHEN 0 THEN '<fraktion>SPD</fraktion>' WHEN 1 THEN '<fraktion>BÜNDNIS&#160;90/DIE GRÜNEN</fraktion>' WHEN 2 THEN '<fraktion>fraktionslos</fraktion>' ELSE '' END,
  CASE WHEN k % 5 = 0 THEN '<rolle><rolle_lang>Bundes<b>minister</b></rolle_lang></rolle>' ELSE '' END, '</name></redner>Jo N:</p>') END,
  CASE WHEN k % 11 = 0 THEN '<p/>' ELSE concat('<p klasse="J">Wert <i>', k % 1000, '</i> &amp; mehr.</p>') END,
  CASE WHEN k % 2 = 1 THEN '<kommentar>(Heiterkeit bei der AfD)</kommentar>' ELSE '' END, '<p><![CDATA[Ende <', k % 7, '>.]]></p></rede>')"""
_HEAD = """concat(CASE p WHEN 1 THEN '<sitzungsbeginn>' WHEN 5 THEN '<zusatzpunkt><top-titel>Zusatz &amp; Antrag</top-titel>' ELSE concat('<tagesordnungspunkt top-id="Tagesordnungspunkt&#160;', p % 2 + 1, '">') END,
  CASE WHEN p > 1 THEN concat('<name>Vizepräsidentin Dr. Eva P', c % 5, ':</name>') ELSE '' END, CASE WHEN p % 2 = 0 THEN '<kommentar>(Beifall bei der SPD)</kommentar>' ELSE '' END)"""
_CONTENTS = """<vorspann><inhaltsverzeichnis><ivz-block><ivz-block-titel>Tagesordnungspunkt&#160;1:</ivz-block-titel><ivz-eintrag><redner id="1"/><ivz-eintrag-inhalt>Jo N</ivz-eintrag-inhalt></ivz-eintrag>
<ivz-eintrag><ivz-eintrag-inhalt> Der  <i>Haushalt</i> {}</ivz-eintrag-inhalt></ivz-eintrag><ivz-eintrag><ivz-eintrag-inhalt>Zweites</ivz-eintrag-inhalt></ivz-eintrag></ivz-block></inhaltsverzeichnis></vorspann>"""


def documents(spark, d) -> DataFrame:
    """(session_id, xml), a record of each customer's orders."""
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS c", "o_orderkey AS k", "CAST(substring(o_orderpriority, 1, 1) AS INT) AS p", "o_orderkey % 7 = 0 AS annex")
    o = o.withColumn("speech", F.expr(_SPEECH))
    together = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "speech"))), lambda s: s.getField("speech")), x)
    blocks = o.groupBy("c", "p", "annex").agg(together("\n").alias("speeches"))
    ends = F.expr("CASE p WHEN 1 THEN '</sitzungsbeginn>' WHEN 5 THEN '</zusatzpunkt>' ELSE '</tagesordnungspunkt>' END")
    piece = F.when(F.col("annex"), F.concat(F.lit("<anlage>"), "speeches", F.lit("</anlage>"))).otherwise(F.concat(F.expr(_HEAD), "speeches", ends))
    part = lambda annex: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("annex") == annex, F.struct("p", piece.alias("piece"))))), lambda s: s.getField("piece")), "<!-- <rede> -->")
    whole = blocks.groupBy("c").agg(part(False).alias("course"), part(True).alias("annex"))
    before, after = (F.lit(x) for x in _CONTENTS.split("{}"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><!DOCTYPE r SYSTEM "r.dtd"><dbtplenarprotokoll wahlperiode="21" sitzung-nr="'), F.col("c"), F.lit('">'), before, F.col("c") % 4, after,
        F.lit("<sitzungsverlauf>"), "course", F.lit("<sitzungsende/></sitzungsverlauf><anlagen>"), "annex", F.lit("</anlagen></dbtplenarprotokoll>\n"),
    )
    broken = F.get(F.array(*[F.lit(x) for x in BROKEN]), (F.col("c") % len(BROKEN)).cast("int"))
    return whole.select(F.concat(F.lit("s"), F.col("c")).alias("session_id"), F.when(F.col("c") % 50 == 49, broken).otherwise(xml).alias("xml"))


_BASE = r"""o AS (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE substr(o_orderpriority, 1, 1)::INT END AS b, substr(o_orderpriority, 1, 1)::INT AS p FROM orders WHERE o_custkey % 50 <> 49),
blocks AS (SELECT c, b, row_number() OVER (PARTITION BY c ORDER BY b)::INT AS block_no FROM o GROUP BY c, b),
said AS (SELECT c, b, 4 AS ord, p, k,
  CASE WHEN b = 9 AND k % 2 = 0 THEN 'Unbekannt' ELSE CASE WHEN k % 3 = 0 THEN 'Dr. ' ELSE '' END || 'Jo N' || (k % 23) END AS name,
  CASE WHEN b = 9 AND k % 2 = 0 THEN 'Redner' WHEN k % 5 = 0 THEN 'Bundesminister' ELSE 'Abgeordneter' END AS rolle,
  CASE WHEN b = 9 AND k % 2 = 0 THEN NULL ELSE CASE k % 4 WHEN 0 THEN 'SPD' WHEN 1 THEN 'BÜNDNIS 90/DIE GRÜNEN' WHEN 2 THEN 'fraktionslos' END END AS fraktion,
  CASE WHEN k % 11 = 0 THEN '' ELSE 'Wert ' || (k % 1000) || ' & mehr. ' END || 'Ende <' || (k % 7) || '>.' AS text FROM o),
chairs AS (SELECT c, b, 2 AS ord, 0 AS p, 0 AS k, 'Dr. Eva P' || (c % 5) AS name, 'Sitzungsleitung' AS rolle, NULL::VARCHAR AS fraktion, '' AS text FROM blocks WHERE b BETWEEN 2 AND 5),
talk AS (SELECT *, (row_number() OVER (PARTITION BY c ORDER BY b, ord, p, k) - 1)::INT AS idx FROM (FROM said UNION ALL FROM chairs))"""


@query(
    "xml_items",
    f"""WITH {_BASE},
items AS (SELECT DISTINCT c, -2 AS b, 0 AS ord, 0 AS p, 0 AS k, 'session' AS kind, NULL::VARCHAR AS text, NULL::VARCHAR AS herkunft FROM o
UNION ALL SELECT DISTINCT c, -1, 0, 0, 0, 'contents', 'Der  Haushalt ' || (c % 4), NULL FROM o
UNION ALL SELECT c, b, 1, 0, 0, 'block', NULL, CASE WHEN b = 9 THEN 'anlage' ELSE 'protokoll' END FROM blocks
UNION ALL SELECT c, b, ord, p, k, 'chair', 'Vizepräsidentin ' || name, 'protokoll' FROM chairs
UNION ALL SELECT c, b, 3, 0, 0, 'block comment', '(Beifall bei der SPD)', 'protokoll' FROM blocks WHERE b IN (2, 4)
UNION ALL SELECT c, b, 4, p, k, 'speech', text, CASE WHEN b = 9 THEN 'anlage' ELSE 'protokoll' END FROM said
UNION ALL SELECT c, b, 4, p, k + 0.5, 'comment', '(Heiterkeit bei der AfD)', CASE WHEN b = 9 THEN 'anlage' ELSE 'protokoll' END FROM said WHERE k % 2 = 1)
SELECT 's' || i.c AS session_id, row_number() OVER (PARTITION BY i.c ORDER BY i.b, ord, p, k)::INT AS nth, kind, block_no, text, herkunft FROM items i LEFT JOIN blocks USING (c, b)
UNION ALL SELECT DISTINCT 's' || o_custkey, 1, 'error', NULL, NULL, NULL FROM orders WHERE o_custkey % 50 = 49""",
)
def xml_items(spark, d):
    items = record.parse_records(documents(spark, d))
    nth = F.row_number().over(W.partitionBy("session_id").orderBy("seq"))
    return items.select("session_id", nth.alias("nth"), "kind", "block_no", F.when(F.col("kind") == "chair", F.col("name")).otherwise(F.col("text")).alias("text"), "herkunft")


@query("xml_speeches", f"WITH {_BASE} SELECT 's' || c AS session_id, idx, name AS speaker_name, rolle, fraktion, text, CASE WHEN b = 9 THEN 'anlage' ELSE 'protokoll' END AS herkunft, block_no AS top_nummer FROM talk JOIN blocks USING (c, b)")
def xml_speeches(spark, d):
    found = record.tables(record.parse_records(documents(spark, d)))
    return found["utterances"].select("session_id", "idx", "speaker_name", "rolle", "fraktion", "text", "herkunft", "top_nummer")


@query(
    "xml_titles",
    f"""WITH {_BASE} SELECT 's' || c AS session_id, block_no AS nummer, CASE b WHEN 1 THEN 'Sitzungseröffnung' WHEN 3 THEN 'Tagesordnungspunkt' || chr(160) || '2' WHEN 5 THEN 'Zusatz & Antrag' WHEN 9 THEN 'Schriftliche Beiträge zu Protokoll (Anlagen)' ELSE 'Der Haushalt ' || (c % 4) END AS titel FROM blocks""",
)
def xml_titles(spark, d):
    return record.tables(saved(record.parse_records(documents(spark, d))))["tops"].select("session_id", "nummer", "titel")


@query(
    "xml_reactions",
    f"""WITH {_BASE}, first AS (SELECT c, b, p, k, idx, text FROM talk WHERE ord = 4),
heard AS (SELECT c, b, 3 AS ord, 0 AS p, 0 AS k, 'Beifall' AS typ, 'SPD' AS urheber, -1 AS rede_index FROM blocks WHERE b IN (2, 4)
UNION ALL SELECT c, b, 4, p, k, 'Heiterkeit', 'AfD', idx FROM first WHERE k % 2 = 1)
SELECT 's' || c AS session_id, (row_number() OVER (PARTITION BY c ORDER BY b, ord, p, k) - 1)::INT AS i, typ, urheber, block_no AS top_nummer, rede_index FROM heard JOIN blocks USING (c, b)""",
)
def xml_reactions(spark, d):
    return record.tables(record.parse_records(documents(spark, d)))["reactions"].select("session_id", "i", "typ", "urheber", "top_nummer", "rede_index")
