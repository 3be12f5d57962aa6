"""The engine's operators over the driver tables, each with DuckDB SQL for the same result.

Roles: conversations are session transcripts (conv_id, turn, role, text), documents are speeches (lang as party,
source as speaker), benchmark is the reference record, events are reactions in time, embeddings are segment vectors,
labels are human reviews, and the star schema is a graph of entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..folders import fresh
from ..functions import text as X
from ..operators import algorithms, components, dashboards, factcheck, index, quality, resolve, retrieval, sequence, timejoin, vectors
from ..operators import graph as G
from ..operators.graph_queries import Graph
from ..sources import inputs, sinks, store
from ..streaming import incremental
from . import jobs
from .registry import query

#: Subjects and evidence keys for invented prose: frequent tokens of the tables stand for keywords.
TOPICS = [("alpha", ["the ", "and "]), ("beta", ["que ", "les "]), ("gamma", ["der ", "und "]), ("delta", ["las ", "los "])]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_WORDS = "len(string_split_regex(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}]+', ' ', 'g')), ' '))"
_NWORDS = f"CASE WHEN trim(regexp_replace(coalesce(text, ''), '[\\s]+', ' ', 'g')) = '' THEN 0 ELSE {_WORDS} END"


def _lists(u: DataFrame) -> dict[str, DataFrame]:
    """Record lists of utterances (session_id, idx, speaker_name, fraktion, text, top_nummer), each of which is a speech."""
    u = u.withColumn("herkunft", F.lit("protokoll"))
    speeches = u.select("session_id", "idx", F.col("speaker_name").alias("person"), "fraktion", "top_nummer", F.lit(False).alias("schriftlich"), F.array("idx").alias("src"))
    tops = u.select("session_id", F.col("top_nummer").alias("nummer"), F.lit("").alias("titel")).distinct()
    return {"utterances": u, "speeches": speeches, "tops": tops}


def _speeches(spark, d):
    """Documents as the speeches of one session."""
    top = (F.col("doc_id") % 20).cast("int").alias("top_nummer")
    return _lists(t(spark, d, "documents").select(F.lit("x").alias("session_id"), F.col("doc_id").alias("idx"), F.col("source").alias("speaker_name"), F.col("lang").alias("fraktion"), "text", top))


def _talks(spark, d):
    """Turns of conversations as speeches, a session each."""
    return _lists(t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker_name"), F.col("role").alias("fraktion"), "text", F.lit(1).alias("top_nummer")))


@query("word_share", f"WITH w AS (SELECT lang AS fraktion, sum({_NWORDS})::BIGINT AS woerter FROM documents WHERE coalesce(lang, '') <> '' GROUP BY 1) SELECT fraktion, woerter, round(100 * woerter / sum(woerter) OVER (), 1)::DOUBLE AS prozent FROM w")
def word_share(spark, d):
    """Share of words by party."""
    return dashboards.session_dashboard(_speeches(spark, d), only=("sprachanteil_fraktion",))["sprachanteil_fraktion"].select("fraktion", "woerter", "prozent")


@query("speech_volume_topk", f"SELECT source, sum({_NWORDS})::BIGINT AS woerter, count(*) AS reden FROM documents GROUP BY 1 HAVING sum({_NWORDS}) > 0 ORDER BY 2 DESC, min(doc_id) LIMIT 15")
def speech_volume_topk(spark, d):
    """The report of the 15 speakers with most words."""
    return dashboards.session_dashboard(_speeches(spark, d), only=("redner",))["redner"].select(F.col("name").alias("source"), "woerter", "reden")


@query("speaker_stats", f"SELECT conv_id AS session_id, role AS name, count(*) AS reden, sum({_NWORDS})::BIGINT AS woerter, arg_max(role, turn) AS letzte FROM conversations GROUP BY 1, 2 HAVING sum({_NWORDS}) > 0")
def speaker_stats(spark, d):
    """Figures by speaker, with an attribute of the last speech."""
    return dashboards.session_dashboard(_talks(spark, d), only=("redner",))["redner"].select("session_id", "name", "reden", "woerter", F.col("fraktion").alias("letzte"))


def _topic_sql() -> str:
    low = "lower(text)"
    score = [" + ".join(f"(length({low}) - length(replace({low}, '{k}', ''))) // {len(k)}" for k in ks) for _, ks in TOPICS]
    cols = ", ".join(f"{s} AS s{i}" for i, s in enumerate(score))
    best = f"greatest({', '.join(f's{i}' for i in range(len(TOPICS)))})"
    cases = " ".join(f"WHEN s{i} = {best} THEN '{n}'" for i, (n, _) in enumerate(TOPICS))
    return f"SELECT coalesce(CASE WHEN {best} < 2 THEN NULL {cases} END, '{X.NO_TOPIC}') AS thema, count(*) AS n FROM (SELECT {cols} FROM documents) GROUP BY 1"


@query("topic_classify", _topic_sql())
def topic_classify(spark, d):
    """Subjects by keywords."""
    return t(spark, d, "documents").groupBy(F.coalesce(X.topic(F.col("text"), TOPICS), F.lit(X.NO_TOPIC)).alias("thema")).agg(F.count(F.lit(1)).alias("n"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '(\b\d{1,2}\.)' || chr(1), '\1 ', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_CHECKABLE = r"NOT regexp_matches(lower(s), 'vorlegen|vorzulegen|wird .* vorle') AND (regexp_matches(lower(s), '[0-9]') OR contains(lower(s), 'prozent') OR regexp_matches(lower(s), 'von (drei|vier|fünf)')) AND NOT contains(lower(s), 'frage')"


@query("sentence_statements", f"SELECT doc_id, count(*) AS saetze, sum(CASE WHEN {_CHECKABLE} THEN 1 ELSE 0 END)::BIGINT AS aussagen FROM (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents) GROUP BY 1")
def sentence_statements(spark, d):
    """Sentences, and those that can be checked."""
    s = t(spark, d, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("saetze"), F.count_if(X.is_statement(F.col("s"))).alias("aussagen"))


_EVIDENCE = r"SELECT item_id AS ev_idx, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}]{9,}'))) AS keys FROM benchmark"


def _evidence(spark, d):
    """Benchmark items as evidence: their long words are the keys."""
    keys = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{9,}"), F.lit(0))))
    source = F.struct(F.concat(F.lit("Quelle "), F.col("item_id").cast("string")).alias("titel"), F.lit("2026").alias("stand"), F.lit("https://example.org").alias("url"))
    verdict = F.element_at(F.array(*[F.lit(v) for v in factcheck.VERDICTS[:4]]), (F.col("item_id") % 4 + 1).cast("int"))
    return t(spark, d, "benchmark").select(F.col("item_id").alias("ev_idx"), keys.alias("keys"), verdict.alias("verdikt"), F.lit("").alias("begruendung"), source.alias("quelle"))


@query(
    "evidence_factcheck",
    f"""WITH e AS ({_EVIDENCE}),
s AS (SELECT doc_id, lower(text) AS low FROM documents),
p AS (SELECT doc_id, ev_idx, len(list_filter(keys, lambda k: contains(low, k)))::DOUBLE / greatest(len(keys), 1) AS score FROM s, e),
b AS (SELECT doc_id, max(score) AS score, arg_max(ev_idx, row(score, -ev_idx)) AS ev FROM p GROUP BY 1)
SELECT doc_id, round(score, 2) AS score, CASE WHEN score >= 0.6 THEN list_extract(['bestätigt','teilweise','irreführend','falsch'], (ev % 4 + 1)::INT) ELSE 'unbelegt' END AS verdikt,
CASE WHEN score >= 0.6 THEN 'Quelle ' || ev ELSE 'Evidenzkorpus durchsucht — kein Beleg gefunden' END AS quelle FROM b""",
)
def evidence_factcheck(spark, d):
    """The evidence of the largest share of matched keys decides; every verdict has a source."""
    s = t(spark, d, "documents").select("doc_id", "text")
    return factcheck.check_statements(s, _evidence(spark, d), ["doc_id"]).select("doc_id", "score", "verdikt", F.col("quelle.titel").alias("quelle"))


@query("verdict_counts", "WITH v AS (SELECT d.source, CASE WHEN l.toxic = 1 THEN 'falsch' WHEN l.quality = 1 THEN 'bestätigt' WHEN l.quality = 0 THEN 'teilweise' ELSE 'unbelegt' END AS v FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT source, count(*) FILTER (v = 'bestätigt') AS \"bestätigt\", count(*) FILTER (v = 'teilweise') AS teilweise, count(*) FILTER (v = 'irreführend') AS \"irreführend\", count(*) FILTER (v = 'falsch') AS falsch, count(*) FILTER (v = 'unbelegt') AS unbelegt, count(*) AS geprueft, count(*) FILTER (v IN ('falsch', 'irreführend')) AS fragwuerdig FROM v GROUP BY 1")
def verdict_counts(spark, d):
    """Verdicts by person as columns."""
    v = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    v = v.withColumn("verdikt", F.when(F.col("toxic") == 1, "falsch").when(F.col("quality") == 1, "bestätigt").when(F.col("quality") == 0, "teilweise").otherwise("unbelegt"))
    return factcheck.verdict_counts(v, ["source"])


@query("reaction_polarity", "SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS positiv, count(*) FILTER (event_type IN ('error', 'logout', 'click')) AS negativ FROM events GROUP BY 1")
def reaction_polarity(spark, d):
    """Reactions counted by polarity."""
    kinds = X.literal_map({"purchase": "Beifall", "signup": "Heiterkeit", "error": "Widerspruch", "logout": "Missfallen", "click": "Zwischenruf"})
    p = X.polarity(kinds[F.col("event_type")])
    return t(spark, d, "events").groupBy("user_id").agg(F.count_if(p == "positiv").alias("positiv"), F.count_if(p == "negativ").alias("negativ"))


@query("reaction_polarity_corpus", "SELECT user_id, count(*) FILTER (event_type IN ('error', 'click')) AS negativ FROM events GROUP BY 1")
def reaction_polarity_corpus(spark, d):
    """Over several sessions disapproval is no negative reaction."""
    kinds = X.literal_map({"purchase": "Beifall", "signup": "Heiterkeit", "error": "Widerspruch", "logout": "Missfallen", "click": "Zwischenruf"})
    p = X.polarity(kinds[F.col("event_type")], X.NEGATIVE_CORPUS)
    return t(spark, d, "events").groupBy("user_id").agg(F.count_if(p == "negativ").alias("negativ"))


@query("forward_fill_topic", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events")
def forward_fill_topic(spark, d):
    """The last item called up."""
    return sequence.carried(t(spark, d, "events"), F.when(F.col("event_type") == "signup", F.col("event_id")), ["user_id"], ["ts", "event_id"], "top").select("event_id", "top")


@query(
    "merge_runs",
    "WITH c AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM c) SELECT conv_id, run::BIGINT AS run, arg_min(role, turn) AS role, min(turn) AS start, max(turn) AS \"end\", string_agg(text, ' ' ORDER BY turn) AS text FROM r GROUP BY conv_id, run",
)
def merge_runs(spark, d):
    """runs of one speaker as one utterance."""
    c = t(spark, d, "conversations").withColumn("start", F.col("turn")).withColumn("end", F.col("turn"))
    return sequence.merged_runs(c, "role", ["conv_id"], "turn", "start", "end", "text").select("conv_id", "run", "role", "start", "end", "text")


@query("consecutive_dedup", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def consecutive_dedup(spark, d):
    """rows that differ from the one before."""
    return sequence.without_repeats(t(spark, d, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("caption_buckets", "SELECT conv_id, bucket::BIGINT AS bucket, min(turn) AS start, count(*) AS n, string_agg(role, ' ' ORDER BY turn) AS rollen FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS bucket FROM conversations) GROUP BY 1, 2")
def caption_buckets(spark, d):
    """Groups of consecutive lines."""
    b = sequence.buckets(t(spark, d, "conversations"), 3, ["conv_id"], ["turn"])
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ")
    return b.groupBy("conv_id", "bucket").agg(F.min("turn").alias("start"), F.count(F.lit(1)).alias("n"), roles.alias("rollen"))


@query("running_numbers", "SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY f)::INT AS nr FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations)")
def running_numbers(spark, d):
    """numbers by first appearance."""
    return sequence.by_appearance(t(spark, d, "conversations"), "role", ["conv_id"], "turn", "nr").select("conv_id", "turn", "nr")


_SPANS = "SELECT user_id AS session_id, event_id AS idx, epoch(ts) AS start, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS \"end\" FROM events WHERE event_type = 'click'"


def _spans(spark, d):
    """Intervals between one click and the next of a user."""
    e = t(spark, d, "events").where("event_type = 'click'")
    sec = F.col("ts").cast("timestamp").cast("double")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("idx"), sec.alias("start"), F.lead(sec).over(w).alias("end")).where(F.col("end").isNotNull())


def _points(spark, d):
    return t(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("point_id"), F.col("ts").cast("timestamp").cast("double").alias("t"))


@query(
    "point_in_interval",
    f"""WITH s AS (SELECT * FROM ({_SPANS}) WHERE "end" IS NOT NULL), p AS (SELECT user_id AS session_id, event_id AS point_id, epoch(ts) AS t FROM events WHERE event_type = 'purchase'),
i AS (SELECT p.session_id, point_id, min(idx) AS idx FROM p JOIN s ON p.session_id = s.session_id AND start <= t AND t < "end" GROUP BY 1, 2),
n AS (SELECT p.session_id, point_id, arg_min(idx, row(abs(start - t), idx)) AS idx FROM p JOIN s ON p.session_id = s.session_id GROUP BY 1, 2)
SELECT p.session_id, p.point_id, coalesce(i.idx, n.idx) AS idx FROM p LEFT JOIN i USING (session_id, point_id) LEFT JOIN n USING (session_id, point_id)""",
)
def point_in_interval(spark, d):
    """D3: the interval that holds a point, else the one of nearest start."""
    return timejoin.at_or_nearest(_points(spark, d), _spans(spark, d), width=86400.0).select("session_id", "point_id", "idx")


@query(
    "overlap_argmax",
    f"""WITH t AS (SELECT * FROM ({_SPANS}) WHERE "end" IS NOT NULL), i AS (SELECT user_id AS session_id, event_id AS item_id, epoch(ts) AS s, epoch(ts) + 20000 AS e FROM events WHERE event_type = 'signup'),
b AS (SELECT i.session_id, item_id, arg_max(idx, row(least(e, "end") - greatest(s, start), -idx)) AS x FROM i JOIN t ON i.session_id = t.session_id AND s < "end" AND start < e GROUP BY 1, 2)
SELECT i.session_id, i.item_id, coalesce('S' || x, 'SPEAKER_??') AS speaker FROM i LEFT JOIN b USING (session_id, item_id)""",
)
def overlap_argmax(spark, d):
    """The turn that an item overlaps most."""
    turns = _spans(spark, d).withColumnRenamed("idx", "turn_id").withColumn("speaker", F.concat(F.lit("S"), F.col("turn_id").cast("string")))
    sec = F.col("ts").cast("timestamp").cast("double")
    items = t(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("item_id"), sec.alias("start"), (sec + 20000).alias("end"))
    return timejoin.best_overlap(items, turns, width=86400.0).select("session_id", "item_id", "speaker")


@query("fifo_pairing", "WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id AS partner, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase') SELECT user_id, k::INT AS k, event_id, partner FROM c LEFT JOIN p USING (user_id, k)")
def fifo_pairing(spark, d):
    """The k-th speech with the k-th clip."""
    e = t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("partner"), "o")
    return timejoin.kth_pairs(e.where("event_type = 'click'").select("user_id", "event_id", "o"), right, ["user_id"], "o").select("user_id", "k", "event_id", "partner")


def _node(df, kind, nid, label=None, session=None):
    empty = F.expr("map()").cast("map<string,string>")
    return df.select((F.lit("x") if session is None else session).alias("session_id"), nid.alias("id"), (F.lit("") if label is None else label).alias("label"), F.lit(kind).alias("type"), F.lit("").alias("subtype"), F.lit("fallbezug").alias("schicht"), empty.alias("props"))


def _edge(df, kind, source, target, session=None):
    empty = F.expr("map()").cast("map<string,string>")
    return df.select((F.lit("x") if session is None else session).alias("session_id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("relationship_type"), empty.alias("props"))


@query("provenance_anti", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def provenance_anti(spark, d):
    """Speeches that nothing backs."""
    docs = t(spark, d, "documents")
    doc = F.col("doc_id").cast("string")
    g = Graph(_node(docs, "Redebeitrag", doc), _edge(t(spark, d, "labels"), "BELEGT_DURCH", doc, F.concat(F.lit("segment_"), doc)))
    return g.unproven_speeches().select(F.col("speech").cast("long").alias("doc_id")).join(docs.select("doc_id", "source"), "doc_id")


@query("review_overlay", "SELECT d.doc_id, l.doc_id IS NOT NULL AS geprueft, CASE WHEN l.quality = 0 THEN 'korrigiert' END AS verdikt_mensch FROM documents d LEFT JOIN labels l USING (doc_id)")
def review_overlay(spark, d):
    """Human reviews beside the machine's verdict."""
    nodes = _node(t(spark, d, "documents"), "Faktencheck", F.col("doc_id").cast("string"))
    status = F.when(F.col("quality") == 0, "korrigiert").otherwise("bestaetigt")
    r = t(spark, d, "labels").select(F.lit("x").alias("session_id"), F.col("doc_id").cast("string").alias("faktencheck_id"), F.lit("wer").alias("geprueft_von"), status.alias("status"), F.lit("korrigiert").alias("verdikt_neu"), F.lit("2026").alias("stand"), F.lit("").alias("notiz"))
    return G.reviewed(nodes, r).select(F.col("id").cast("long").alias("doc_id"), F.col("menschlich_geprueft").alias("geprueft"), "verdikt_mensch")


_CLICKERS, _BUYERS = "SELECT DISTINCT user_id FROM events WHERE event_type = 'click'", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'"


def _users(spark, d, kind):
    """A ledger of sessions: the users with an event of a kind."""
    return t(spark, d, "events").where(F.col("event_type") == kind).select(F.lit(21).alias("wp"), F.col("user_id").alias("nr")).distinct()


@query("set_difference", "WITH a AS (SELECT lang, list_sort(list_distinct(list(source))) AS s FROM documents GROUP BY 1), b AS (SELECT lang, list_distinct(list(source)) AS s FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) SELECT a.lang, array_to_string(list_filter(a.s, lambda x: b.s IS NULL OR NOT list_contains(b.s, x)), ',') AS fehlend FROM a LEFT JOIN b ON a.lang = b.lang")
def set_difference(spark, d):
    """H1: speakers of the record that the transcript lacks."""
    docs = t(spark, d, "documents")
    said = docs.join(t(spark, d, "labels").where("toxic = 1"), "doc_id").groupBy("lang").agg(F.collect_set("source").alias("t"))
    j = docs.groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("r")).join(said, "lang", "left")
    return j.select("lang", F.array_join(quality.missing_speakers(F.col("r"), F.coalesce("t", F.array().cast("array<string>"))), ",").alias("fehlend"))


@query("set_intersection", f"{_CLICKERS} INTERSECT {_BUYERS}")
def set_intersection(spark, d):
    """H2: keys of both ledgers."""
    return incremental.complete([_users(spark, d, "click"), _users(spark, d, "purchase")]).select(F.col("nr").alias("user_id"))


@query("pending_keys", f"{_CLICKERS} EXCEPT {_BUYERS}")
def pending_keys(spark, d):
    """K2: keys that the ledger lacks."""
    return incremental.pending(_users(spark, d, "click"), _users(spark, d, "purchase")).select(F.col("nr").alias("user_id"))


@query("ledger_union", f"SELECT coalesce(a.user_id, b.user_id) AS user_id, a.user_id IS NOT NULL AS geklickt, b.user_id IS NOT NULL AS gekauft FROM ({_CLICKERS}) a FULL JOIN ({_BUYERS}) b ON a.user_id = b.user_id")
def ledger_union(spark, d):
    """The index of sessions over all ledgers."""
    found = sinks.session_index({"geklickt": _users(spark, d, "click"), "gekauft": _users(spark, d, "purchase")})
    return found.select(F.col("nr").alias("user_id"), "geklickt", "gekauft")


def _graph(spark, d):
    """Customers, nations and regions as nodes, membership as edges; one session a region."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    props = F.expr("map('k', 'v')")
    session = F.col("r_name").alias("session_id")
    people = c.select(session, F.concat(F.lit("person_"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"), F.lit("Person").alias("type"), F.col("c_mktsegment").alias("subtype"), F.lit("fallbezug").alias("schicht"), props.alias("props"))
    nations = c.select(session, F.concat(F.lit("top_"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("Tagesordnungspunkt").alias("type"), F.lit("").alias("subtype"), F.lit("prozedural").alias("schicht"), props.alias("props"))
    nodes = G.first_nodes(people.unionByName(nations), ["label"])
    edges = c.select(session, F.concat(F.lit("person_"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat(F.lit("top_"), F.col("n_nationkey").cast("string")).alias("target_id"), F.lit("ZU_TOP").alias("relationship_type"), props.alias("props"))
    return nodes, edges


_GRAPH_BASE = "c AS (SELECT r_name AS session_id, c_custkey, c_name, c_mktsegment, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("build_graph_nodes", f"WITH {_GRAPH_BASE} SELECT session_id, 'person_' || c_custkey AS id, c_name AS label, 'Person' AS type FROM c UNION ALL SELECT DISTINCT session_id, 'top_' || n_nationkey, n_name, 'Tagesordnungspunkt' FROM c")
def build_graph_nodes(spark, d):
    """H4: nodes, the first of each id."""
    return _graph(spark, d)[0].select("session_id", "id", "label", "type")


@query("namespaced_edges", f"WITH {_GRAPH_BASE} SELECT session_id, 'person_' || c_custkey AS source_id, session_id || ':top_' || n_nationkey AS target_id, 'ZU_TOP' AS relationship_type FROM c")
def namespaced_edges(spark, d):
    """Ids of one session get its prefix, shared kinds keep theirs."""
    return G.namespaced(*_graph(spark, d))[1].select("session_id", "source_id", "target_id", "relationship_type")


@query("edge_dedup", "SELECT DISTINCT 's' || s_nationkey AS source_id, 'c' || c_nationkey AS target_id FROM (SELECT c_nationkey FROM customer) JOIN (SELECT s_nationkey FROM supplier) ON s_nationkey = c_nationkey")
def edge_dedup(spark, d):
    """H5: edges once each, no loops, after ids are mapped."""
    nodes = t(spark, d, "nation").select(F.lit("x").alias("session_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("Person").alias("type"))
    have = t(spark, d, "customer").select("c_nationkey").distinct().join(t(spark, d, "supplier").select("s_nationkey"), F.col("s_nationkey") == F.col("c_nationkey"))
    edges = have.select(F.lit("x").alias("session_id"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("source_id"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("target_id"), F.lit("R").alias("relationship_type"))
    ids = nodes.select(F.col("id").alias("old"), F.col("id").alias("new"))
    return G.remapped(nodes, edges, ids)[1].select("source_id", "target_id")


@query("graph_hop_agg", "SELECT r_name, n_name, count(DISTINCT o_orderkey) AS bestellungen FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def graph_hop_agg(spark, d):
    """A chain of hops and a count at its end."""
    text = lambda c: F.col(c).cast("string")
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    edges = _edge(t(spark, d, "orders"), "BESTELLT", text("o_custkey"), text("o_orderkey")).unionByName(_edge(t(spark, d, "customer"), "WOHNT_IN", text("c_custkey"), text("c_nationkey"))).unionByName(_edge(n, "LIEGT_IN", text("n_nationkey"), text("n_regionkey")))
    g = Graph(_node(n, "Nation", text("n_nationkey"), F.col("n_name")).unionByName(_node(r, "Region", text("r_regionkey"), F.col("r_name"))), edges)
    j = g.hop(g.hop(g.rel("BESTELLT", "c", "o"), "WOHNT_IN", "c", "n"), "LIEGT_IN", "n", "r")
    j = j.join(g.of("Nation", "n"), ["session_id", "n"]).join(g.of("Region", "r"), ["session_id", "r"])
    return j.groupBy(F.col("r_label").alias("r_name"), F.col("n_label").alias("n_name")).agg(F.countDistinct("o").alias("bestellungen"))


@query("cross_session_speakers", "SELECT user_id::VARCHAR AS person, count(DISTINCT date_trunc('week', ts)) AS sitzungen, count(*) AS reden FROM events GROUP BY 1 HAVING count(DISTINCT date_trunc('week', ts)) > 3 ORDER BY 3 DESC, 1 LIMIT 25")
def cross_session_speakers(spark, d):
    """The report of persons in more than three sessions."""
    e = t(spark, d, "events").select(F.date_trunc("week", "ts").cast("string").alias("session_id"), F.col("user_id").cast("string").alias("u"), "event_id")
    nodes = _node(e.select("session_id", "u").distinct(), "Person", F.col("u"), F.col("u"), F.col("session_id"))
    return Graph(nodes, _edge(e, "HAT_REDEBEITRAG", F.col("u"), F.col("event_id").cast("string"), F.col("session_id"))).speakers(4, 25).select("person", "sitzungen", "reden")


_COSPEECH = "WITH o AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS t FROM lineitem) SELECT a.p AS source, b.p AS target, count(DISTINCT a.t) AS weight FROM o a JOIN o b ON a.t = b.t AND a.p < b.p GROUP BY 1, 2"


def _co_speech(spark, d):
    """Suppliers as persons, lines as speeches, parts as agenda items."""
    i = t(spark, d, "lineitem")
    name = F.lpad(F.col("l_suppkey").cast("string"), 12, "0")  # ids of one length compare as their numbers do
    speech = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    edges = _edge(i, "HAT_REDEBEITRAG", name, speech).unionByName(_edge(i, "ZU_TOP", speech, F.col("l_partkey").cast("string")))
    g = Graph(_node(i.limit(0), "Person", name), edges)
    return g.co_speech().select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "weight")


@query("co_speech_projection", _COSPEECH)
def co_speech_projection(spark, d):
    """Pairs by shared items."""
    return _co_speech(spark, d)


@query("degree", f"WITH e AS ({_COSPEECH}) SELECT id, count(*) AS degree, sum(weight)::BIGINT AS weight FROM (SELECT source AS id, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY 1")
def degree(spark, d):
    """Degrees of the projection."""
    return algorithms.degree(_co_speech(spark, d))


@query(
    "pagerank",
    f"""WITH RECURSIVE e AS ({_COSPEECH}), o AS (SELECT source, sum(weight) AS s FROM e GROUP BY 1), p AS (SELECT e.source, e.target, weight / s AS p FROM e JOIN o ON e.source = o.source),
n AS (SELECT source AS id FROM e UNION SELECT target FROM e),
r AS (SELECT 0 AS i, id, 0.15::DOUBLE AS rank FROM n UNION ALL SELECT i + 1, n.id, 0.15 + 0.85 * coalesce(g.got, 0) FROM (SELECT DISTINCT i FROM r) x, n LEFT JOIN (SELECT p.target, sum(r.rank * p.p) AS got FROM r JOIN p ON p.source = r.id GROUP BY 1) g ON g.target = n.id WHERE i < 20)
SELECT id, round(rank, 6) AS rank FROM r WHERE i = 20""",
)
def pagerank(spark, d):
    """PageRank of the projection, 20 rounds."""
    return algorithms.pagerank(_co_speech(spark, d)).select("id", F.round("rank", 6).alias("rank"))


@query("communities")
def communities(spark, d):
    """Communities of the projection by label propagation."""
    return algorithms.communities(_co_speech(spark, d))


@query("louvain", "SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS community FROM nation")
def louvain(spark, d):
    """Communities by modularity of nations, which are joined to those of their region, and weakly to the next number."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    m = n.withColumnRenamed("k", "m")
    near = n.join(m, "n_regionkey").where("k < m").select(F.col("k").alias("source"), F.col("m").alias("target"), F.lit(5).alias("weight"))
    found = algorithms.louvain(near.unionAll(n.where("k > 0").select("k", F.col("k") - 1, F.lit(1))), levels=2, rounds=4)
    return found.select(F.col("id").alias("n_nationkey"), F.min("id").over(W.partitionBy("community")).alias("community"))


@query("entity_clusters", "SELECT 'anna lieferant ' || chr((97 + s_nationkey)::INT) AS key, min(s_suppkey) AS target, count(*) - 1 AS n_others FROM supplier GROUP BY 1 HAVING count(*) > 1")
def entity_clusters(spark, d):
    """Variants of a name, by its normal form."""
    s = t(spark, d, "supplier")
    letter = F.chr(97 + F.col("s_nationkey"))
    variants = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Dr. Anna Lieferant "), letter)).otherwise(F.concat(F.lit("Anna  LIEFERANT "), letter))
    found = resolve.clusters(s.select(F.col("s_suppkey").alias("id"), variants.alias("label"), F.lit(1).alias("deg")))
    return found.select("key", "target", F.size("others").cast("long").alias("n_others"))


@query("schema_introspection", f"WITH {_GRAPH_BASE} SELECT 'Person' AS type, count(*) AS n FROM c UNION ALL SELECT 'Tagesordnungspunkt', count(DISTINCT (session_id, n_nationkey)) FROM c")
def schema_introspection(spark, d):
    """Node types and their counts."""
    return Graph(*_graph(spark, d)).schema()[0].select("type", "n")


@query(
    "wer_near_pairs",
    r"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text,'')), '[\p{L}\p{N}_]+') AS r, text FROM conversations),
p AS (SELECT * FROM (SELECT conv_id, turn, r, lead(r) OVER w AS h, lead(text) OVER w AS x, len(r) AS nr FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE x IS NOT NULL),
rec AS (SELECT conv_id, turn, 0 AS i, nr, r, h, [{'c': j, 'g': 0, 'n': j} for j in range(0, len(h) + 1)] AS cells FROM p
UNION ALL SELECT conv_id, turn, i + 1, nr, r, h, list_reduce(range(1, len(h) + 1), lambda acc, j: list_append(acc, CASE
  WHEN cells[j].c + (h[j] <> r[i + 1])::INT <= least(cells[j + 1].c, acc[j].c) + 1 THEN {'c': cells[j].c + (h[j] <> r[i + 1])::INT, 'g': cells[j].g, 'n': cells[j].n}
  WHEN cells[j + 1].c <= acc[j].c THEN {'c': cells[j + 1].c + 1, 'g': cells[j + 1].g + 1, 'n': cells[j + 1].n}
  ELSE {'c': acc[j].c + 1, 'g': acc[j].g, 'n': acc[j].n + 1} END), [{'c': (i + 1)::BIGINT, 'g': (i + 1)::BIGINT, 'n': 0::BIGINT}]) FROM rec WHERE i < nr),
f AS (SELECT conv_id, turn, nr, cells[len(cells)] AS e FROM rec WHERE i = nr)
SELECT conv_id, turn, round_even(e.c / greatest(nr, 1), 3) AS wer, (e.c - e.g - e.n)::INT AS subs, e.n::INT AS ins, e.g::INT AS dels, nr::INT AS n_ref FROM f""",
)
def wer_near_pairs(spark, d):
    """Word error rates of consecutive turns of a conversation."""
    c = t(spark, d, "conversations")
    pairs = c.withColumn("hyp", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("hyp IS NOT NULL").select("conv_id", "turn", F.col("text").alias("ref"), "hyp")
    return quality.word_errors(pairs).select("conv_id", "turn", "wer", "subs", "ins", "dels", "n_ref")


@query(
    "content_gaps",
    r"""WITH v AS (SELECT DISTINCT s, tok FROM (SELECT doc_id % 40 AS s, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tok FROM documents)),
s AS (SELECT item_id AS s, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS satz, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) - 1 AS pos FROM benchmark),
k AS (SELECT s, pos, satz, unnest(regexp_extract_all(lower(satz), '[\p{L}\p{N}_]+')) AS tok FROM s WHERE len(regexp_extract_all(lower(satz), '[\p{L}\p{N}_]+')) >= 4),
g AS (SELECT k.s, pos, satz, avg(CASE WHEN v.tok IS NULL THEN 0 ELSE 1 END) AS x FROM k LEFT JOIN v ON k.tok = v.tok AND k.s = v.s GROUP BY 1, 2, 3)
SELECT s, pos::INT AS pos, substr(satz, 1, 140) AS satz, round(x, 2) AS deckung FROM g WHERE x < 0.6""",
)
def content_gaps(spark, d):
    """Sentences of a session's record that its transcripts lack."""
    ref = t(spark, d, "benchmark").select(F.col("item_id").alias("s"), "text")
    return quality.missing_passages(ref, t(spark, d, "documents").select((F.col("doc_id") % 40).alias("s"), "text"), ["s"])


@query(
    "bag_overlap_match",
    r"""WITH a AS (SELECT conv_id, turn AS a, tok, count(*) AS na FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tok FROM conversations) GROUP BY 1, 2, 3),
s AS (SELECT conv_id, a, sum(na) AS size FROM a GROUP BY 1, 2),
p AS (SELECT x.conv_id, x.a, y.a AS b, sum(least(x.na, y.na)) AS shared FROM a x JOIN a y ON x.conv_id = y.conv_id AND x.tok = y.tok AND x.a < y.a GROUP BY 1, 2, 3)
SELECT p.conv_id, p.a, p.b, round(2 * shared / (s1.size + s2.size), 6)::DOUBLE AS ratio FROM p JOIN s s1 ON p.conv_id = s1.conv_id AND p.a = s1.a JOIN s s2 ON p.conv_id = s2.conv_id AND p.b = s2.a""",
)
def bag_overlap_match(spark, d):
    """Similarity of bags of tokens inside a block."""
    c = t(spark, d, "conversations")
    both = quality.bag_overlap(c.select("conv_id", F.col("turn").alias("a"), "text"), c.select("conv_id", F.col("turn").alias("b"), "text"), ["conv_id"])
    return both.where("a < b").select("conv_id", "a", "b", F.round("ratio", 6).alias("ratio"))


TERMS = ["the", "und", "que", "los"]


@query(
    "bm25_topk",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), x AS (SELECT doc_id, len(w) AS dl, w FROM d WHERE len(w) > 0),
m AS (SELECT count(*) AS n, avg(dl) AS mean FROM x), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM x) WHERE term IN ('the', 'und', 'que', 'los') GROUP BY 1, 2, 3),
g AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM f JOIN g USING (term), m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
)
def bm25_topk(spark, d):
    """The best documents for a query."""
    return retrieval.bm25(t(spark, d, "documents"), TERMS, 25, key="doc_id")


@query(
    "index_topk",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), x AS (SELECT doc_id, len(w) AS dl, w FROM d WHERE len(w) > 0),
m AS (SELECT count(*) AS n, avg(dl) AS mean FROM x), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
f AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS term FROM x) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN f USING (term) JOIN g USING (term), m GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
)
def index_topk(spark, d):
    """The best documents for every benchmark text, from a stored index."""
    path = fresh(spark, "full-text")
    index.build(t(spark, d, "documents"), path, key="doc_id")
    found = index.search(spark, path, t(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"), 10)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def _vector_index(spark, d) -> tuple[str, DataFrame]:
    """A stored index of all embeddings, and the queries: every vector whose id is divisible by 50."""
    path, v = fresh(spark, "vectors"), t(spark, d, "embeddings")
    vectors.build(v, path, key="vec_id")
    return path, v.where("vec_id % 50 = 0")


@query(
    "vector_index_exact",
    """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
)
def vector_index_exact(spark, d):
    """The nearest vectors of many, all lists of the index searched."""
    path, queries = _vector_index(spark, d)
    return vectors.search(spark, path, queries, 10, True, key="vec_id").withColumnRenamed("key", "vec_id")


@query("vector_index_topk")
def vector_index_topk(spark, d):
    """The same with as many lists as the index has tuned itself to, and the share of the exact ones among them."""
    path, queries = _vector_index(spark, d)
    found = algorithms.saved(vectors.search(spark, path, queries, 10, key="vec_id"))
    by_query = vectors.recall(found, vectors.search(spark, path, queries, 10, True, key="vec_id"))
    return found.join(by_query, "query").select("query", "rank", F.col("key").alias("vec_id"), "score", "recall")


@query(
    "matched_captions",
    r"""WITH RECURSIVE c AS (SELECT conv_id // 10 AS s, turn % 2 AS k, conv_id % 2 AS side, conv_id * 100 + turn AS no, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM conversations),
n AS (SELECT s, k, side, no, t, count(*) AS n FROM (SELECT s, k, side, no, unnest(w) AS t FROM c) GROUP BY ALL),
shared AS (SELECT a.s, a.k, a.no AS idx, b.no AS clip, sum(least(a.n, b.n)) AS shared FROM n a JOIN n b ON a.s = b.s AND a.k = b.k AND a.t = b.t WHERE a.side = 0 AND b.side = 1 GROUP BY ALL),
e AS (SELECT a.s, a.k, a.no AS idx, b.no AS clip, 2 * coalesce(shared, 0) / (len(a.w) + len(b.w)) AS ratio FROM c a JOIN c b ON a.s = b.s AND a.k = b.k LEFT JOIN shared h ON h.s = a.s AND h.k = a.k AND h.idx = a.no AND h.clip = b.no
  WHERE a.side = 0 AND b.side = 1 AND len(a.w) >= 20 AND len(b.w) <= 3 * len(a.w) + 50),
l AS (SELECT s, k, idx, list({'clip': clip, 'ratio': ratio} ORDER BY ratio DESC, clip) AS wants, row_number() OVER (PARTITION BY s, k ORDER BY idx) AS nth FROM e GROUP BY s, k, idx),
r AS (SELECT s, k, 0::BIGINT AS nth, NULL::BIGINT AS idx, NULL::STRUCT(clip BIGINT, ratio DOUBLE) AS got, []::BIGINT[] AS used FROM (SELECT DISTINCT s, k FROM l)
UNION ALL SELECT s, k, nth, idx, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.clip) END FROM (
  SELECT r.s, r.k, l.nth, l.idx, r.used, list_filter(l.wants, lambda x: NOT list_contains(r.used, x.clip))[1] AS got FROM r JOIN l ON l.s = r.s AND l.k = r.k AND l.nth = r.nth + 1))
SELECT s AS session_id, k AS key, idx, got.clip AS clip, round(got.ratio, 6) AS ratio FROM r WHERE got IS NOT NULL""",
)
def matched_captions(spark, d):
    """One caption for each speech, no caption twice."""
    c = t(spark, d, "conversations").select(F.expr("conv_id div 10").alias("session_id"), (F.col("turn") % 2).alias("key"), (F.col("conv_id") % 2).alias("side"), (F.col("conv_id") * 100 + F.col("turn")).alias("no"), F.coalesce("text", F.lit("")).alias("text"))
    one = lambda side, name: c.where(F.col("side") == side).withColumnRenamed("no", name).drop("side")
    return quality.matched_captions(one(0, "idx"), one(1, "clip")).withColumn("ratio", F.round("ratio", 6))


@query(
    "linked_videos",
    """WITH RECURSIVE c AS (SELECT conv_id // 10 AS s, conv_id % 2 AS side, conv_id * 100 + turn AS no, 'l' || (conv_id // 2 % 2) AS last, 'n' || (turn % 3) AS own FROM conversations),
q AS (SELECT *, min(no) OVER (PARTITION BY s, last, own) AS queue FROM c WHERE side = 1),
l AS (SELECT s, last, idx, wants, row_number() OVER (PARTITION BY s, last ORDER BY idx) AS nth FROM (
  SELECT a.s, a.last, a.no AS idx, list(b.no ORDER BY a.own <> b.own, b.queue, b.no) AS wants FROM c a JOIN q b ON a.s = b.s AND a.last = b.last WHERE a.side = 0 GROUP BY 1, 2, 3)),
r AS (SELECT s, last, 0::BIGINT AS nth, NULL::BIGINT AS idx, NULL::BIGINT AS got, []::BIGINT[] AS used FROM (SELECT DISTINCT s, last FROM l)
UNION ALL SELECT s, last, nth, idx, got, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END FROM (
  SELECT r.s, r.last, l.nth, l.idx, r.used, list_filter(l.wants, lambda x: NOT list_contains(r.used, x))[1] AS got FROM r JOIN l ON l.s = r.s AND l.last = r.last AND l.nth = r.nth + 1))
SELECT s AS session_id, idx, 'u' || got AS url FROM r WHERE got IS NOT NULL""",
)
def linked_videos(spark, d):
    """Clips by name in order, and the next one of a namesake where a name has none left."""
    c = t(spark, d, "conversations").select(F.expr("conv_id div 10").alias("session_id"), (F.col("conv_id") % 2).alias("side"), (F.col("conv_id") * 100 + F.col("turn")).alias("no"), F.expr("concat('n', turn % 3, ' l', (conv_id div 2) % 2)").alias("person_key"))
    speeches, clips = (c.where(F.col("side") == s) for s in (0, 1))
    return quality.linked_videos(speeches.withColumnRenamed("no", "idx"), clips.withColumnRenamed("no", "ord").withColumn("url", F.concat(F.lit("u"), "ord")))


@query(
    "audio_events",
    """WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents), x AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) - 1 AS i FROM b),
s AS (SELECT doc_id, i // 80 AS frame, ('0x' || h)::INT - 128 AS v FROM x),
p AS (SELECT doc_id, frame, sum(v * v) / 80 / 16384 AS power FROM s GROUP BY 1, 2), f AS (SELECT *, least(1.0, 2 * sqrt(power)) AS score FROM p),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY doc_id ORDER BY frame) AS run FROM f WHERE score >= 0.68), e AS (SELECT doc_id, run, round(min(frame) * 0.1::DOUBLE, 1) AS start_sec, round((max(frame) + 1) * 0.1::DOUBLE, 1) AS end_sec, round(max(score), 2) AS score, round(20 * log10(sqrt(avg(power)) + 1e-9), 1) AS db FROM r GROUP BY 1, 2)
SELECT doc_id, start_sec, end_sec, score, db, 'Beifall' AS typ, CASE WHEN db >= -18 THEN 'stark' WHEN db >= -30 THEN 'mittel' ELSE 'vereinzelt' END AS intensitaet FROM e""",
)
def audio_events(spark, d):
    """Events from the bytes of recordings, a document's text as samples of eight bits, filled up with silence to whole frames."""
    b = t(spark, d, "documents").select(F.col("doc_id").alias("session_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    size = F.ceil(F.length("b") / 80).cast("int") * 80
    little = lambda n: F.concat(*[F.unhex(F.substring(F.lpad(F.hex(n), 8, "0"), 7 - 2 * i, 2)) for i in range(4)])
    head = F.concat(F.encode(F.lit("RIFF"), "UTF-8"), little(size + 36), F.encode(F.lit("WAVEfmt "), "UTF-8"), F.unhex(F.lit("10000000010001002003000020030000" + "01000800")), F.encode(F.lit("data"), "UTF-8"), little(size))
    silence = F.unhex(F.repeat(F.lit("80"), size - F.length("b")))
    frames = inputs.audio_frames(b.select("session_id", F.concat(head, "b", silence).alias("content")))
    scored = frames.where("error IS NULL").withColumn("label", F.lit("Applause")).withColumn("score", F.least(F.lit(1.0), 2 * F.sqrt("power")))
    return inputs.detected_events(scored, 0.68).select(F.col("session_id").alias("doc_id"), "start_sec", "end_sec", "score", "db", "typ", "intensitaet")


@query(
    "passage_texts",
    """WITH c AS (SELECT conv_id, conv_id * 100 + turn AS idx, role, coalesce(text, '') AS text, floor((row_number() OVER w - 1) / greatest(1, floor(count(*) OVER (PARTITION BY conv_id) / 3)))::BIGINT AS passage FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS session_id, passage, min(idx) AS idx, arg_min(role, idx) AS person, substring(string_agg(text, ' ' ORDER BY idx), 1, 500) AS text FROM c WHERE passage < 3 GROUP BY 1, 2""",
)
def passage_texts(spark, d):
    """Passages for a model that finds claims: texts in order, cut to so many letters, by the first one's speaker."""
    u = t(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("idx"), F.coalesce("role", F.lit("")).alias("speaker_name"), F.coalesce("text", F.lit("")).alias("text"))
    return jobs.bucketed_claims(u, 3, 500)


@query(
    "session_media",
    """SELECT client_id AS fvid, strftime(updated_at, '%d.%m.%Y') AS datum, strftime(updated_at, '%H:%M') AS uhr, name AS text, row_number() OVER (PARTITION BY strftime(updated_at, '%d.%m.%Y') ORDER BY strftime(updated_at, '%H:%M'), client_id::VARCHAR)::INT AS nth
FROM clients WHERE nation_id = 7 AND length(name) > 0 AND updated_at IS NOT NULL""",
)
def session_media(spark, d):
    """The clips of a session by date, time and id as texts, numbered within a day."""
    c = t(spark, d, "clients").where("updated_at IS NOT NULL").select(F.col("client_id").cast("string").alias("fvid"), F.date_format("updated_at", "dd.MM.yyyy").alias("datum"), F.date_format("updated_at", "HH:mm").alias("uhr"), F.col("nation_id").cast("int").alias("nr"), F.col("name").alias("text"))
    nth = F.row_number().over(W.partitionBy("datum").orderBy("uhr", "fvid"))
    return inputs.session_clips(c, 7).withColumn("nth", nth).select(F.col("fvid").cast("long").alias("fvid"), "datum", "uhr", "text", "nth")


@query(
    "joined_evidence",
    """WITH s AS (SELECT client_id AS k, 0 AS src, row_number() OVER (PARTITION BY client_id ORDER BY sale_id) AS rank, 'sale ' || sale_id AS titel FROM sales WHERE client_id IS NOT NULL AND status = 'open'
UNION ALL SELECT client_id, 1, row_number() OVER (PARTITION BY client_id ORDER BY change_id, seq, op), 'change ' || change_id FROM client_changes WHERE client_id IS NOT NULL)
SELECT k, titel, row_number() OVER (PARTITION BY k ORDER BY src, rank)::INT AS n FROM s QUALIFY n <= 5""",
)
def joined_evidence(spark, d):
    """H7: evidence of two sources, those of the first one first, five for each claim at most."""
    first = t(spark, d, "sales").where("client_id IS NOT NULL AND status = 'open'").select(F.col("client_id").alias("k"), F.row_number().over(W.partitionBy("client_id").orderBy("sale_id")).alias("rank"), F.concat(F.lit("sale "), "sale_id").alias("titel"))
    second = t(spark, d, "client_changes").where("client_id IS NOT NULL").select(F.col("client_id").alias("k"), F.row_number().over(W.partitionBy("client_id").orderBy("change_id", "seq", "op")).alias("rank"), F.concat(F.lit("change "), "change_id").alias("titel"))
    return factcheck.combined_evidence([first, second], ["k"]).select("k", "titel", "n")


@query(
    "transcript_report",
    r"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM conversations WHERE turn < 2),
p AS (SELECT a.conv_id, a.w AS r, b.w AS h, len(a.w) AS nr FROM t a JOIN t b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND b.turn = 1),
rec AS (SELECT conv_id, 0 AS i, nr, r, h, range(0, len(h) + 1) AS cells FROM p
UNION ALL SELECT conv_id, i + 1, nr, r, h, list_reduce(range(1, len(h) + 1), lambda acc, j: list_append(acc, least(cells[j] + (h[j] <> r[i + 1])::INT, cells[j + 1] + 1, acc[j] + 1)), [(i + 1)::BIGINT]) FROM rec WHERE i < nr),
f AS (SELECT conv_id % 20 AS session_id, sum(cells[len(cells)]) AS edits, sum(nr) AS n_ref FROM rec WHERE i = nr GROUP BY 1), s AS (SELECT *, edits / greatest(n_ref, 1) AS wer FROM f)
SELECT round(avg(wer), 6) AS wer_mittel, round(min(wer), 6) AS wer_min, round(max(wer), 6) AS wer_max, round(sum(edits) / sum(n_ref), 6) AS wer_gesamt, sum(n_ref)::BIGINT AS woerter FROM s""",
)
def transcript_report(spark, d):
    """Word errors of the corpus: mean, least and most of the sessions, and all edits by all words."""
    c = t(spark, d, "conversations").where("turn < 2")
    turn = lambda i, name: c.where(F.col("turn") == i).select("conv_id", F.coalesce("text", F.lit("")).alias(name))
    e = quality.word_errors(turn(0, "ref").join(turn(1, "hyp"), "conv_id"))
    errors = e.select((F.col("conv_id") % 20).alias("session_id"), (F.col("subs") + F.col("ins") + F.col("dels")).alias("edits"), "n_ref")
    r = jobs.corpus_errors(errors)
    return r.select(*[F.round(x, 6).alias(x) for x in ("wer_mittel", "wer_min", "wer_max", "wer_gesamt")], "woerter")


@query(
    "vector_hits_explained",
    """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q),
h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 6)
SELECT 's' || vec_id % 5 AS session_id, 'v' || vec_id AS seg, 'Text ' || vec_id AS text, CASE WHEN vec_id % 4 > 0 THEN 'P' || vec_id % 4 END AS sprecher, CASE WHEN vec_id % 3 > 0 AND vec_id // 5 % 2 = 0 THEN 'top' || vec_id // 5 % 7 END AS top, score FROM h""",
)
def vector_hits_explained(spark, d):
    """The best segments for each query with their text and speaker, and the agenda item of the speech that they back, if they back one."""
    path, queries = _vector_index(spark, d)
    found = vectors.search(spark, path, queries, 6, True, key="vec_id")
    v = t(spark, d, "embeddings").select(F.concat(F.lit("s"), F.col("vec_id") % 5).alias("session_id"), F.concat(F.lit("v"), "vec_id").alias("seg"), "vec_id", F.concat(F.lit("r"), F.expr("vec_id div 5"), F.lit("_"), F.col("vec_id")).alias("x"))
    props = F.map_filter(F.create_map(F.lit("text"), F.concat(F.lit("Text "), "vec_id"), F.lit("sprecher"), F.when(F.col("vec_id") % 4 > 0, F.concat(F.lit("P"), F.col("vec_id") % 4))), lambda _, x: x.isNotNull())
    nodes = _node(v, "Transkriptsegment", F.col("seg"), F.col("seg"), F.col("session_id")).drop("props").join(v.select("session_id", F.col("seg").alias("id"), props.alias("props")), ["session_id", "id"])
    backs = _edge(v.where("vec_id % 3 > 0"), "BELEGT_DURCH", F.col("x"), F.col("seg"), F.col("session_id"))
    to = _edge(v.where("vec_id div 5 % 2 = 0"), "ZU_TOP", F.col("x"), F.concat(F.lit("top"), F.expr("vec_id div 5 % 7")), F.col("session_id"))
    hits = found.select(F.concat(F.lit("s"), F.col("key") % 5).alias("session_id"), F.concat(F.lit("v"), "key").alias("seg"), "score")
    return Graph(nodes, backs.unionByName(to)).evidence_path(hits)


@query(
    "published_graph",
    f"""WITH {_GRAPH_BASE} SELECT 'person_' || c_custkey AS id, c_name AS label, 'Person' AS type, c_mktsegment AS subtype FROM c UNION ALL SELECT DISTINCT session_id || ':top_' || n_nationkey, n_name, 'Tagesordnungspunkt', '' FROM c
UNION ALL SELECT 'person_' || c_custkey || '>' || session_id || ':top_' || n_nationkey, NULL, 'ZU_TOP', NULL FROM c""",
)
def published_graph(spark, d):
    """Graphs of many sessions loaded in two batches, one of them twice, and read back."""
    path = fresh(spark, "published")
    nodes, edges = _graph(spark, d)
    for batch, ord in (("A", "1"), ("B", "2"), ("A", "1")):
        own = lambda df: df.where(F.substring("session_id", 1, 1).isin("A") if batch == "A" else ~F.substring("session_id", 1, 1).isin("A"))  # noqa: E731, B023
        jobs.publish({"nodes": own(nodes), "edges": own(edges)}, path, f"batch {batch}", ord)
    n, e = store.graph(spark, path)
    links = e.select(F.concat("source_id", F.lit(">"), "target_id").alias("id"), F.lit(None).cast("string").alias("label"), F.col("relationship_type").alias("type"), F.lit(None).cast("string").alias("subtype"))
    return n.select("id", "label", "type", "subtype").unionByName(links)


@query(
    "merged_components",
    """WITH RECURSIVE k AS (SELECT client_id AS a, min(client_id) OVER (PARTITION BY email) AS b FROM clients WHERE email IS NOT NULL
UNION SELECT client_id, min(client_id) OVER (PARTITION BY lower(name)) FROM clients WHERE name IS NOT NULL UNION SELECT client_id, master_id FROM clients WHERE master_id IS NOT NULL),
e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT client_id AS id, client_id AS seen FROM clients UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT id, min(seen) AS component FROM r GROUP BY 1""",
)
def merged_components(spark, d):
    """Clients that one email, one name or one master record makes the same person, however long the chain."""
    c = t(spark, d, "clients").select("client_id", "master_id", "email", F.lower("name").alias("name"))
    same = lambda by: c.where(F.col(by).isNotNull()).join(c.where(F.col(by).isNotNull()).groupBy(by).agg(F.min("client_id").alias("b")), by).select(F.col("client_id").alias("a"), "b")
    links = same("email").unionByName(same("name")).unionByName(c.select(F.col("client_id").alias("a"), F.col("master_id").alias("b")))
    found = components.components(links)
    return c.select(F.col("client_id").alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("vector_topk", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 25")
def vector_topk(spark, d):
    """The nearest vectors to one."""
    v = t(spark, d, "embeddings")
    return retrieval.nearest(v, [float(x) for x in v.where("vec_id = 0").first()["embedding"]], 25, key="vec_id")


@query("reaction_pairs", "SELECT event_type AS urheber, user_id AS person, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def reaction_pairs(spark, d):
    """Who reacts to whom most often."""
    e = t(spark, d, "events").select(F.lit("x").alias("session_id"), F.lit("r").alias("typ"), F.col("event_type").alias("urheber"), F.col("event_id").alias("rede_index"), "user_id")
    return dashboards.reaction_pairs(e, e.select("session_id", F.col("rede_index").alias("idx"), F.col("user_id").alias("person")), "r", 10)


@query("kpi_summary", f"SELECT conv_id AS session_id, count(*) AS reden, sum({_NWORDS})::BIGINT AS woerter, round_even(sum({_NWORDS}) / 130.0, 0)::BIGINT AS gesamtzeit_min FROM conversations GROUP BY 1")
def kpi_summary(spark, d):
    """Figures of each session."""
    return dashboards.session_dashboard(_talks(spark, d), only=("kennzahlen",))["kennzahlen"].select("session_id", "reden", "woerter", "gesamtzeit_min")


@query("slug_ids", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slug_ids(spark, d):
    """Ids from labels."""
    return t(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("html_structure", r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def html_structure(spark, d):
    """An extra of the engine: markup by pattern."""
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("session_shares", "SELECT lang, source, count(*) AS n, round(count(*) / max(count(*)) OVER (PARTITION BY lang), 6) AS von_max, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6)::DOUBLE AS anteil FROM documents GROUP BY 1, 2")
def session_shares(spark, d):
    """Values by the largest and by the sum of their group."""
    g = t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return dashboards.shares(g, "n", ["lang"]).select("lang", "source", "n", F.round("von_max", 6).alias("von_max"), F.round("anteil", 6).alias("anteil"))


@query("reaction_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS polarity, count(*) AS n FROM events GROUP BY 1, 2")
def reaction_windows(spark, d):
    """K: reactions by window, as the stream computes them."""
    e = t(spark, d, "events").select("ts", F.lit("x").alias("session_id"), F.col("event_type").alias("polarity"))
    return incremental.reaction_windows(e, "1 hour").select("start", "polarity", "n")


@query("revenue_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS menge FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def revenue_rollup(spark, d):
    """An extra of the engine: subtotals."""
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("menge"))


_SAID = "list_extract(['Fraktion der CDU', 'CSU', 'Bündnis 90', 'Die GRÜNEN', 'SPD-Fraktion', 'Freie Demokraten', 'Sahra Wagenknecht', 'Freie  Wähler'], (c_custkey % 8 + 1)::INT)"
_CANON = "list_extract(['CDU/CSU', 'CDU/CSU', 'BÜNDNIS 90/DIE GRÜNEN', 'BÜNDNIS 90/DIE GRÜNEN', 'SPD', 'FDP', 'BSW', 'Freie Wähler'], (c_custkey % 8 + 1)::INT)"


@query("party_canonical", f"SELECT c_custkey, {_CANON} AS fraktion FROM customer")
def party_canonical(spark, d):
    """Canonical parties."""
    said = F.element_at(F.array(*[F.lit(x) for x in ["Fraktion der CDU", "CSU", "Bündnis\u00a090", "Die GRÜNEN", "SPD-Fraktion", "Freie Demokraten", "Sahra Wagenknecht", "Freie  Wähler"]]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return t(spark, d, "customer").select("c_custkey", X.party(said).alias("fraktion"))


@query("reaction_classify", "SELECT event_id, list_extract(['Beifall', 'Zwischenruf', 'Heiterkeit', 'Kommentar'], (event_id % 4 + 1)::INT) AS typ, list_extract(['SPD', 'AfD', NULL, NULL], (event_id % 4 + 1)::INT) AS urheber FROM events")
def reaction_classify(spark, d):
    """C20: kinds of comments and who makes them."""
    said = F.element_at(F.array(*[F.lit(x) for x in ["(Beifall bei der SPD)", "(Zuruf von der AfD: Nein)", "(Heiterkeit)", "(Glocke)"]]), (F.col("event_id") % 4 + 1).cast("int"))
    return t(spark, d, "events").select("event_id", X.reaction_type(said).alias("typ"), X.reaction_giver(said).alias("urheber"))


@query("timecodes", "SELECT event_id, printf('%02d:%02d', (event_id // 60)::INT, (event_id % 60)::INT) AS timecode FROM events")
def timecodes(spark, d):
    """Minutes and seconds, minutes of any length."""
    return t(spark, d, "events").select("event_id", X.timecode(F.col("event_id").cast("double"), F.lit("audio")).alias("timecode"))


@query("vote_counts", "SELECT o_orderkey, (o_orderkey % 11)::INT AS ja, (o_orderkey % 3 + 1)::INT AS nein, 1 AS enthaltung FROM orders")
def vote_counts(spark, d):
    """Votes from number words and digits."""
    names = ["null", "eine", "Zwei", "drei", "vier", "fünf", "sechs", "sieben", "ACHT", "neun", "zehn"]
    yes = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 11 + 1).cast("int"))
    said = F.concat(F.lit("Ergebnis: "), yes, F.lit(" Jastimmen, "), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit(" Gegenstimmen, eine Enthaltung."))
    return t(spark, d, "orders").select("o_orderkey", X.votes_before(said, "Jastimmen?").alias("ja"), X.votes_before(said, "(?:Gegenstimmen?|Neinstimmen?)").alias("nein"), X.votes_before(said, "Enthaltung").alias("enthaltung"))


@query("shortened_text", r"WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 200 THEN rtrim(substr(s, 1, 199)) || '…' ELSE s END AS kurz FROM x")
def shortened_text(spark, d):
    """Titles of at most 200 characters."""
    return t(spark, d, "documents").select("doc_id", X.shortened(F.col("text")).alias("kurz"))


@query("query_terms", r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-zÄÖÜäöüß][\p{L}\p{N}_-]+') AS w FROM documents), s AS (SELECT doc_id, w, list_filter(w, lambda x: (regexp_matches(x, '^\p{Lu}') AND NOT list_contains(['the', 'der'], lower(x))) OR regexp_matches(x, '[0-9]')) AS s FROM w) SELECT doc_id, coalesce(array_to_string((CASE WHEN len(s) < 3 THEN list_filter(w, lambda x: NOT list_contains(['the', 'der'], lower(x))) ELSE s END)[1:8], ' '), '') AS terms FROM s")
def query_terms(spark, d):
    """Words of a search query."""
    return t(spark, d, "documents").select("doc_id", X.query_terms(F.col("text"), ["the", "der"]).alias("terms"))


@query("full_text_terms", r"SELECT item_id, CASE WHEN len(f) > 0 THEN array_to_string(f, ' OR ') ELSE text END AS terms FROM (SELECT item_id, text, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: length(x) > 3) AS f FROM benchmark)")
def full_text_terms(spark, d):
    """A question as terms joined by OR."""
    return t(spark, d, "benchmark").select("item_id", X.full_text_terms(F.col("text")).alias("terms"))


@query("safe_labels", "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') AS ok FROM part")
def safe_labels(spark, d):
    """Labels that may stand in a statement."""
    return t(spark, d, "part").select("p_partkey", X.safe_label(F.col("p_name")).alias("ok"))


@query("upsert_nodes", f"WITH {_GRAPH_BASE} SELECT 'n' || (c_custkey % 50) AS id, arg_max(c_name, c_custkey) AS label, count(DISTINCT 'k' || (c_custkey % 3)) AS keys, arg_max(c_custkey::VARCHAR, c_custkey) AS last FROM c GROUP BY 1")
def upsert_nodes(spark, d):
    """H6: merged nodes, later properties over earlier ones."""
    c = t(spark, d, "customer")
    props = F.create_map(F.concat(F.lit("k"), (F.col("c_custkey") % 3).cast("string")), F.col("c_custkey").cast("string"), F.lit("last"), F.col("c_custkey").cast("string"))
    n = c.select(F.concat(F.lit("n"), (F.col("c_custkey") % 50).cast("string")).alias("id"), F.col("c_name").alias("label"), F.lit("T").alias("type"), F.lit("").alias("subtype"), F.lit("x").alias("schicht"), props.alias("props"), F.col("c_custkey").alias("ord"))
    return G.upserted(n, "ord").select("id", "label", (F.size("props") - 1).cast("long").alias("keys"), F.col("props")["last"].alias("last"))


@query("structural_graph", f"WITH {_GRAPH_BASE} SELECT count(*) AS nodes FROM c")
def structural_graph(spark, d):
    """The graph without a kind of nodes."""
    n, e = G.structural(*_graph(spark, d), "Tagesordnungspunkt")
    return n.agg(F.count(F.lit(1)).alias("nodes"))


@query("resolved_edges", "SELECT 'person_' || c_custkey AS source_id, 'top_' || c_nationkey AS target_id FROM customer WHERE c_mktsegment = 'BUILDING'")
def resolved_edges(spark, d):
    """Edges whose ends both exist."""
    nodes, edges = _graph(spark, d)
    return G.resolved_edges(nodes.where("type != 'Person' OR subtype = 'BUILDING'"), edges).select("source_id", "target_id")


@query("clip_coverage", "SELECT d::INT AS nr FROM range(1, 367) r(d) WHERE d NOT IN (SELECT DISTINCT dayofyear(ts) FROM events)")
def clip_coverage(spark, d):
    """Numbers of a range that are missing."""
    from . import jobs

    return jobs.coverage(t(spark, d, "events").select(F.dayofyear("ts").alias("nr")), 1, 366)


@query("figure_peaks", "WITH f AS (SELECT user_id, count(*) AS n, max(event_id) AS m FROM events GROUP BY 1) SELECT 'n' AS figure, arg_min(user_id, row(-n, user_id)) AS user_id, max(n)::BIGINT AS value FROM f UNION ALL SELECT 'm', arg_min(user_id, row(-m, user_id)), max(m)::BIGINT FROM f")
def figure_peaks(spark, d):
    """Where each figure is largest."""
    from . import jobs

    f = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("m"))
    return jobs.peaks(f, ["n", "m"], "user_id")


@query("passage_buckets", "SELECT conv_id, turn, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / greatest(1, floor(count(*) OVER (PARTITION BY conv_id) / 3)))::BIGINT AS passage FROM conversations")
def passage_buckets(spark, d):
    """Passages of about equal length."""
    return sequence.passages(t(spark, d, "conversations"), 3, ["conv_id"], ["turn"]).select("conv_id", "turn", "passage")


@query("json_in_text", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_in_text(spark, d):
    """JSON out of a text around it."""
    said = F.concat(F.lit("Antwort: "), F.col("props"), F.lit(" Ende"))
    return t(spark, d, "events").select("event_id", X.json_in(said, "k string")["k"].alias("k"))


@query("session_ids", "SELECT n_nationkey, printf('amt_21_%03d', n_nationkey) AS file, printf('Plenarprotokoll 21/%d', n_nationkey) AS label FROM nation")
def session_ids(spark, d):
    """Names of sessions."""
    return t(spark, d, "nation").withColumn("i", X.session_ids(F.lit(21), F.col("n_nationkey"))).select("n_nationkey", "i.file", "i.label")


@query("thousands", "SELECT o_orderkey, replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', '.') AS preis FROM orders")
def thousands(spark, d):
    """Whole numbers with points between thousands."""
    return t(spark, d, "orders").select("o_orderkey", X.thousands(F.floor("o_totalprice").cast("long")).alias("preis"))


@query("ordered_numbers", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS nr FROM events WHERE event_type = 'signup'")
def ordered_numbers(spark, d):
    """numbers in order."""
    return sequence.numbered(t(spark, d, "events").where("event_type = 'signup'"), ["user_id"], ["ts", "event_id"], "nr", 1).select("user_id", "event_id", "nr")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by speaker: statements against the evidence, every one with a source."""
    s = t(spark, d, "documents").select("doc_id", "source", "text")
    return factcheck.verdict_counts(factcheck.check_statements(s, _evidence(spark, d), ["doc_id"]), ["source"])
