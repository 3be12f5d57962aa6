"""Property graphs of sessions: nodes (session_id, id, label, type, subtype, schicht, props) and edges (session_id,
source_id, target_id, relationship_type, props), built from record lists by one select for each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

SHARED = ["Person", "Fraktion", "Norm", "Quelle"]


def _props(**values) -> Column:
    """A map of the values as text; null stands for an empty text, as in files."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.coalesce((v if isinstance(v, Column) else F.lit(v)).cast("string"), F.lit("")))]
    return F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,string>")


def _cat(*parts) -> Column:
    return F.concat(*[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts])


def person_id(name: Column) -> Column:
    return _cat("person_", X.slug(name))


class _Parts:
    def __init__(self):
        self.nodes: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def node(self, df: DataFrame, nid, label, kind: str, layer: str, order: Column, subtype="", **props) -> None:
        kind_no = len(self.nodes)
        text = lambda c: F.coalesce((c if isinstance(c, Column) else F.lit(c)).cast("string"), F.lit(""))
        self.nodes.append(df.select("session_id", text(nid).alias("id"), text(label).alias("label"), F.lit(kind).alias("type"), text(subtype).alias("subtype"), F.lit(layer).alias("schicht"), _props(**props).alias("props"), F.lit(kind_no).alias("kind_no"), order.cast("long").alias("ord")))

    def edge(self, df: DataFrame, source, target, kind: str, **props) -> None:
        self.edges.append(df.select("session_id", source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("relationship_type"), _props(**props).alias("props")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_nodes(nodes: DataFrame, order: list[str], by: tuple[str, ...] = ("session_id", "id")) -> DataFrame:
    """One node for each session and id, the first of its order."""
    w = W.partitionBy(*by).orderBy(*order)
    return nodes.withColumn("__rn__", F.row_number().over(w)).where("__rn__ = 1").drop("__rn__")


def build_graph(lists: dict[str, DataFrame], audio_file: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the record lists; lists that are missing give nothing."""
    g = _Parts()
    zero = F.lit(0)
    u = lists["utterances"]
    m = lists["meeting"]
    for c in ("wahlperiode", "sitzung_nr"):
        if c not in m.columns:
            m = m.withColumn(c, F.lit(""))
    quorum = F.when(F.col("beschlussfaehig").isNull(), "").otherwise(F.initcap(F.col("beschlussfaehig").cast("string")))
    g.node(m, F.col("session_id"), _cat("Sitzung ", F.col("datum")), "Sitzung", "zeitlich", zero, F.col("gremium"), gremium=F.col("gremium"), datum=F.col("datum"), ort=F.col("ort"), wahlperiode=F.col("wahlperiode"), sitzung_nr=F.col("sitzung_nr"), beschlussfaehig=quorum, audio_file=audio_file)
    able = m.where(F.coalesce("beschlussfaehig", F.lit(False)))
    g.node(able, "gemo_37", "GemO §37 Beschlussfähigkeit", "Norm", "normativ", zero, "Gemeindeordnung")
    g.edge(able, F.col("session_id"), F.lit("gemo_37"), "BESCHLUSSFAEHIG_NACH")

    people = u.groupBy("session_id", F.col("speaker_name").alias("name")).agg(F.min("idx").alias("idx"), F.min_by("rolle", "idx").alias("rolle"), F.min_by(F.struct("fraktion"), "idx").alias("f")).withColumn("fraktion", F.nullif(F.col("f.fraktion"), F.lit("")))
    role = F.coalesce("rolle", F.lit(""))
    g.node(people, person_id(F.col("name")), F.col("name"), "Person", "fallbezug", F.col("idx"), F.col("rolle"))
    in_party = people.where("fraktion IS NOT NULL")
    faction = _cat("fraktion_", X.slug(F.col("fraktion")))
    g.node(in_party, faction, F.col("fraktion"), "Fraktion", "fallbezug", F.col("idx"), "Ratsfraktion")
    g.edge(in_party, person_id(F.col("name")), faction, "MITGLIED_VON")
    g.edge(people.where(role.contains("Vorsitz")), F.col("session_id"), person_id(F.col("name")), "GELEITET_VON")
    g.edge(people.where(role.contains("Schriftführer")), F.col("session_id"), person_id(F.col("name")), "PROTOKOLLIERT_VON")

    tops = lists["tops"]
    tid = _cat("top_", F.col("nummer"))
    g.node(tops, tid, _cat("TOP ", F.col("nummer"), ": ", F.col("titel")), "Tagesordnungspunkt", "prozedural", F.col("ord"), nummer=F.col("nummer"))
    g.edge(tops, F.col("session_id"), tid, "HAT_TOP")
    known = tops.select("session_id", F.col("nummer").alias("top_nummer")).distinct()
    on_top = lambda df: df.join(known, ["session_id", "top_nummer"], "left_semi")
    top = _cat("top_", F.col("top_nummer"))

    if "motions" in lists:
        a = lists["motions"]
        aid = _cat("antrag_t", F.col("top_nummer"), "_", F.col("i"))
        g.node(a, aid, _cat("Antrag (", F.col("steller"), ")"), "Antrag", "prozedural", F.col("i"), F.col("steller"), text=F.substring("text", 1, 240))
        g.edge(on_top(a), top, aid, "BEHANDELT_ANTRAG")
    if "votes" in lists:
        v = lists["votes"]
        vid = _cat("abstimmung_t", F.col("top_nummer"))
        g.node(v, vid, _cat("Abstimmung TOP ", F.col("top_nummer"), " (", F.col("ja"), ":", F.col("nein"), ":", F.col("enthaltung"), ")"), "Abstimmung", "prozedural", F.col("idx"), F.col("ergebnis"), ja=F.col("ja"), nein=F.col("nein"), enthaltung=F.col("enthaltung"), ergebnis=F.col("ergebnis"))
        g.edge(on_top(v), top, vid, "ENTSCHIEDEN_DURCH")
    if "resolutions" in lists:
        b = lists["resolutions"]
        bid = _cat("beschluss_", F.col("nummer"))
        g.node(b, bid, _cat("Beschluss ", F.col("nummer")), "Beschluss", "prozedural", F.col("idx"), nummer=F.col("nummer"), text=F.substring("text", 1, 300))
        voted = lists["votes"].select("session_id", "top_nummer").distinct()
        g.edge(b.join(voted, ["session_id", "top_nummer"], "left_semi"), _cat("abstimmung_t", F.col("top_nummer")), bid, "FUEHRT_ZU")
        g.edge(on_top(b), top, bid, "ERGEBNIS_BESCHLUSS")
    if "tasks" in lists:
        t = lists["tasks"]
        gid = _cat("aufgabe_", F.col("i"))
        g.node(t, gid, _cat("Aufgabe: ", F.col("text")), "Aufgabe", "prozedural", F.col("i"), F.col("zustaendig"), frist=F.col("frist"), zustaendig=F.col("zustaendig"))
        g.edge(t.where("beschluss_nummer IS NOT NULL"), _cat("beschluss_", F.col("beschluss_nummer")), gid, "ERZEUGT_AUFGABE")
        g.edge(on_top(t.where("beschluss_nummer IS NULL")), top, gid, "ERZEUGT_AUFGABE")
    if "recusals" in lists:
        r = lists["recusals"]
        g.node(r, "gemo_18", "GemO §18 Befangenheit", "Norm", "normativ", F.col("idx"), "Gemeindeordnung")
        g.edge(on_top(r), person_id(F.col("person")), top, "BEFANGEN_BEI", rechtsgrundlage=F.col("rechtsgrundlage"))
        g.edge(r, person_id(F.col("person")), F.lit("gemo_18"), "BEFANGENHEIT_NACH")

    texts = u.select("session_id", "idx", F.col("text").alias("said"))
    s = lists["speeches"].join(texts, ["session_id", "idx"], "left")
    rid = _cat("redebeitrag_", F.col("idx"))
    extra = {"video_url": F.col("video_url")} if "video_url" in s.columns else {}
    g.node(s, rid, _cat("Redebeitrag ", F.col("person"), " (TOP ", F.col("top_nummer"), ", ", F.col("timecode"), ")"), "Redebeitrag", "fallbezug", F.col("idx"), F.col("fraktion"), timecode=F.col("timecode"), start_sec=F.col("start"), text=F.substring("said", 1, 600), schriftlich=F.when(F.col("schriftlich"), "ja"), **extra)
    g.edge(s, person_id(F.col("person")), rid, "HAT_REDEBEITRAG")
    g.edge(on_top(s), rid, top, "ZU_TOP")
    if "questions" in lists:
        f = lists["questions"]
        fid = _cat("frage_", F.col("i"))
        g.node(f, fid, _cat("Frage an die Bundesregierung (", F.col("steller"), ")"), "Frage", "prozedural", F.col("i"), F.col("fraktion"), text=F.substring("text", 1, 240))
        g.edge(f, person_id(F.col("steller")), fid, "STELLT_FRAGE")
        g.edge(on_top(f), fid, top, "ZU_TOP")

    a = lists["statements"]
    aid = _cat("aussage_", F.col("i"))
    g.node(a, aid, _cat("Aussage: ", F.substring("text", 1, 60), "…"), "Aussage", "fallbezug", F.col("i"), F.col("fraktion"), text=F.substring("text", 1, 300), person=F.col("person"))
    g.edge(a, person_id(F.col("person")), aid, "TAETIGT_AUSSAGE")
    g.edge(on_top(a), aid, top, "ZU_TOP")
    if "checks" in lists:
        c = lists["checks"]
        cid = _cat("faktencheck_", F.col("i"))
        title = F.coalesce(F.nullif(F.col("quelle.titel"), F.lit("")), F.lit("Quelle"))
        qid = _cat("quelle_", F.coalesce(F.nullif(X.slug(title), F.lit("")), F.lit("quelle")))
        g.node(c, cid, _cat("Faktencheck: ", F.col("verdikt")), "Faktencheck", "faktencheck", F.col("i"), F.col("verdikt"), verdikt=F.col("verdikt"), begruendung=F.substring("begruendung", 1, 400))
        g.edge(c, _cat("aussage_", F.col("i")), cid, "GEPRUEFT_ALS", verdikt=F.col("verdikt"))
        g.node(c, qid, title, "Quelle", "faktencheck", F.col("i"), F.col("quelle.stand"), url=F.col("quelle.url"), stand=F.col("quelle.stand"))
        g.edge(c, cid, qid, "BELEGT_MIT")
    if "reactions" in lists:
        k = lists["reactions"]
        for col in ("intensitaet", "start_sec", "herkunft"):
            if col not in k.columns:
                k = k.withColumn(col, F.lit("protokoll" if col == "herkunft" else None).cast("string"))
        kid = _cat("ereignis_", F.col("i"))
        label = _cat(F.col("typ"), F.when(F.coalesce("intensitaet", F.lit("")) != "", _cat(" (", F.col("intensitaet"), ")")), F.when(F.coalesce("urheber", F.lit("")) != "", _cat(" — ", F.col("urheber"))))
        g.node(k, kid, label, "AkustischesEreignis", "reaktion", F.col("i"), F.col("typ"), text=F.substring("text", 1, 240), urheber=F.col("urheber"), intensitaet=F.col("intensitaet"), start_sec=F.col("start_sec"), herkunft=F.col("herkunft"))
        g.edge(on_top(k), top, kid, "HAT_REAKTION")
        of = k.where("rede_index >= 0")
        g.edge(of, kid, _cat("redebeitrag_", F.col("rede_index")), "REAKTION_AUF")
        g.edge(of, kid, _cat("segment_", F.col("rede_index")), "BELEGT_DURCH")

    code = X.timecode(F.col("start"), F.col("herkunft"))
    sid = _cat("segment_", F.col("idx"))
    g.node(u, sid, _cat("Segment ", code, " (", F.col("speaker_name"), ")"), "Transkriptsegment", "provenienz", F.col("idx"), F.col("speaker_name"), start_sec=F.col("start"), end_sec=F.col("end"), timecode=code, sprecher=F.col("speaker_name"), text=F.substring("text", 1, 500), audio_file=audio_file)
    backed = [("tops", tid), ("resolutions", _cat("beschluss_", F.col("nummer"))), ("votes", _cat("abstimmung_t", F.col("top_nummer"))), ("speeches", rid), ("statements", _cat("aussage_", F.col("i")))]
    for name, entity in backed:
        if name in lists:
            rows = lists[name].withColumn("__entity__", entity).select("session_id", "__entity__", F.explode("src").alias("s"))
            g.edge(rows, F.col("__entity__"), _cat("segment_", F.col("s")), "BELEGT_DURCH")
    # Ids of different types differ by their prefix; with the type as a key, a question for one type makes that type only.
    nodes = first_nodes(_union(g.nodes), ["kind_no", "ord"], ("session_id", "type", "id"))
    return nodes.drop("kind_no", "ord"), _union(g.edges)


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy("session_id").agg(F.count(F.lit(1)).alias("relationship_count"))
    return n.join(e, "session_id", "left").na.fill(0, ["relationship_count"])


def namespaced(nodes: DataFrame, edges: DataFrame, shared: list[str] = SHARED) -> tuple[DataFrame, DataFrame]:
    """Ids of nodes that belong to one session get its prefix; shared kinds keep theirs. Edges follow; ids that no node has stay."""
    new = F.when(F.col("type").isin(shared), F.col("id")).otherwise(_cat(F.col("session_id"), ":", F.col("id")))
    ids = nodes.select("session_id", F.col("id").alias("old"), new.alias("new"))
    e = edges
    for end in ("source_id", "target_id"):
        e = e.join(ids.select("session_id", F.col("old").alias(end), "new"), ["session_id", end], "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return nodes.withColumn("id", new), e.select(*edges.columns)


def upserted(nodes: DataFrame, order: str) -> DataFrame:
    """One node for each id over all sessions; later properties overlay earlier ones key by key."""
    entries = F.array_sort(F.map_entries("props")).alias("e")  # maps have no order, their entries do
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, entries))), lambda x: F.map_from_entries(x["e"]))
    merged = F.aggregate(parts, F.expr("map()").cast("map<string,string>"), lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))
    return nodes.groupBy("id").agg(F.max_by("label", order).alias("label"), F.max_by("type", order).alias("type"), F.max_by("subtype", order).alias("subtype"), F.max_by("schicht", order).alias("schicht"), merged.alias("props"))


def structural(nodes: DataFrame, edges: DataFrame, kind: str = "Transkriptsegment") -> tuple[DataFrame, DataFrame]:
    """The graph without nodes of a kind and the edges that touch them."""
    gone = nodes.where(F.col("type") == kind).select("session_id", F.col("id").alias("x"))
    e = edges
    for end in ("source_id", "target_id"):
        e = e.join(gone.withColumnRenamed("x", end), ["session_id", end], "left_anti")
    return nodes.where(F.col("type") != kind), e.select(*edges.columns)


def resolved_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    e = edges
    for end in ("source_id", "target_id"):
        e = e.join(nodes.select("session_id", F.col("id").alias(end)), ["session_id", end], "left_semi")
    return e.select(*edges.columns)


def remapped(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes merged by a map (old, new): the longest label stays, the other columns are those of the node that keeps its id, or of the first id;
    loops and doubled edges that arise go, the first properties of an edge stay. All columns are kept."""
    n = nodes.join(ids.withColumnRenamed("old", "id"), "id", "left").withColumn("__old__", F.col("id")).withColumn("id", F.coalesce("new", "id")).drop("new")
    rest = [c for c in nodes.columns if c not in ("id", "label", "props")]
    has = "props" in nodes.columns
    order = F.struct(F.col("__old__") != F.col("id"), F.col("__old__"), *[F.col(c) for c in rest])
    label = F.max_by("label", F.struct(F.length("label"), "label")).alias("label")
    kept = [F.min_by(F.struct(*rest, *(["props"] if has else [])), order).alias("own")] if rest or has else []
    n = n.groupBy("id").agg(label, *kept).select(*[F.col(c) if c in ("id", "label") else F.col(f"own.{c}").alias(c) for c in nodes.columns])
    e = edges
    for end in ("source_id", "target_id"):
        e = e.join(ids.select(F.col("old").alias(end), "new"), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    key = ["source_id", "target_id", "relationship_type"]
    rest = [c for c in edges.columns if c not in key]
    plain = [c for c in rest if c != "props"]
    if rest:
        order = F.struct(F.lit(0), *plain, *([F.array_sort(F.map_entries("props"))] if "props" in rest else []))
        e = e.where("source_id != target_id").groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("own")).select(*[F.col(c) if c in key else F.col(f"own.{c}").alias(c) for c in edges.columns])
        return n, e
    return n, e.where("source_id != target_id").dropDuplicates(key).select(*edges.columns)


def reviewed(nodes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Fact-check nodes with human reviews beside the machine's verdict, which stays; a new verdict only where one was corrected."""
    r = reviews.select("session_id", F.col("faktencheck_id").alias("id"), "geprueft_von", "status", F.when(F.col("status") == "korrigiert", F.col("verdikt_neu")).alias("verdikt_mensch"), F.col("stand").alias("geprueft_am"), F.col("notiz").alias("review_notiz"))
    return nodes.where("type = 'Faktencheck'").join(r, ["session_id", "id"], "left").withColumn("menschlich_geprueft", F.col("status").isNotNull())


def with_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Speech nodes with video_url from links (session_id, id, url); a new link replaces an old one."""
    j = nodes.join(links, ["session_id", "id"], "left")
    put = F.map_concat(F.map_filter("props", lambda k, _: k != "video_url"), F.create_map(F.lit("video_url"), F.col("url")))
    return j.withColumn("props", F.when(F.col("url").isNotNull(), put).otherwise(F.col("props"))).drop("url")
