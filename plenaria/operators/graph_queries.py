"""Named questions to a graph of nodes and edges, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .algorithms import stored
from .projection import counted, lists, numbered

#: Persons in a row of those on items, and meetings of two persons that are counted in one part, about.
BLOCK, PART = 1 << 16, 1 << 22

class Graph:
    """Edges joined by node type; every question is a chain of joins that the optimizer orders."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def of(self, kind: str, name: str) -> DataFrame:
        """Nodes of a type as (session_id, <name>, <name>_label, <name>_sub, <name>_props)."""
        return self.nodes.where(F.col("type") == kind).select("session_id", F.col("id").alias(name), F.col("label").alias(f"{name}_label"), F.col("subtype").alias(f"{name}_sub"), F.col("props").alias(f"{name}_props"))

    def rel(self, kind: str, source: str, target: str) -> DataFrame:
        return self.edges.where(F.col("relationship_type") == kind).select("session_id", F.col("source_id").alias(source), F.col("target_id").alias(target))

    def hop(self, df: DataFrame, kind: str, source: str, target: str, how: str = "inner") -> DataFrame:
        """Joins an edge kind to df, which has one of both ends."""
        r = self.rel(kind, source, target)
        return df.join(r, ["session_id", source if source in df.columns else target], how)

    def citations(self, entity: str) -> DataFrame:
        """(session_id, <entity>, cited): the segments that back an entity, by start."""
        seg = self.of("Transkriptsegment", "seg")
        b = self.rel("BELEGT_DURCH", entity, "seg").join(seg, ["session_id", "seg"])
        parts = F.array_sort(F.collect_list(F.struct(F.col("seg_props")["start_sec"].cast("double").alias("s"), "seg", F.concat_ws(" ", F.col("seg_props")["timecode"], F.col("seg_props")["sprecher"]).alias("c"))))
        return b.groupBy("session_id", entity).agg(F.array_join(F.transform(parts, lambda p: p["c"]), "; ").alias("cited"))

    def resolutions(self) -> DataFrame:
        """Resolutions with their vote (the last one, if several lead to them) and citation."""
        v = self.of("Abstimmung", "vote")
        led = self.rel("FUEHRT_ZU", "vote", "res").join(v, ["session_id", "vote"])
        led = led.groupBy("session_id", "res").agg(F.max_by(F.struct("vote_sub", "vote_props"), "vote").alias("v"))
        b = self.of("Beschluss", "res").join(led, ["session_id", "res"], "left").join(self.citations("res"), ["session_id", "res"], "left")
        p = F.col("v.vote_props")
        return b.select("session_id", F.col("res_props")["nummer"].alias("beschluss"), F.col("res_props")["text"].alias("text"), p["ja"].alias("ja"), p["nein"].alias("nein"), p["enthaltung"].alias("enthaltung"), F.col("v.vote_sub").alias("ergebnis"), "cited")

    def tasks(self) -> DataFrame:
        """Tasks with deadline, who is responsible, and the labels of what they come from."""
        t = self.of("Aufgabe", "task")
        from_ = self.rel("ERZEUGT_AUFGABE", "src", "task").join(self.nodes.select("session_id", F.col("id").alias("src"), F.col("label").alias("src_label")), ["session_id", "src"], "left")
        from_ = from_.groupBy("session_id", "task").agg(F.array_join(F.sort_array(F.collect_list("src_label")), ", ").alias("aus"))
        return t.join(from_, ["session_id", "task"], "left").select("session_id", "task", F.col("task_props")["zustaendig"].alias("zustaendig"), F.col("task_props")["frist"].alias("frist"), "aus")

    def resolution_tasks(self) -> DataFrame:
        r = self.hop(self.of("Beschluss", "res"), "ERZEUGT_AUFGABE", "res", "task").join(self.of("Aufgabe", "task"), ["session_id", "task"])
        return r.select("session_id", F.col("task_props")["zustaendig"].alias("zustaendig"), F.col("task_props")["frist"].alias("frist"), F.col("res_props")["nummer"].alias("aus_beschluss"))

    def recusals(self) -> DataFrame:
        r = self.rel("BEFANGEN_BEI", "person", "top").join(self.of("Person", "person"), ["session_id", "person"]).join(self.of("Tagesordnungspunkt", "top"), ["session_id", "top"])
        return r.select("session_id", F.col("person_label").alias("person"), F.col("top_label").alias("top"))

    def quorum(self) -> DataFrame:
        s = self.of("Sitzung", "s").join(self.rel("BESCHLUSSFAEHIG_NACH", "s", "norm"), ["session_id", "s"], "left").join(self.of("Norm", "norm"), ["session_id", "norm"], "left")
        return s.select("session_id", (F.col("s_props")["beschlussfaehig"] == "True").alias("beschlussfaehig"), F.col("norm_label").alias("norm"))

    def vote_on(self, word: str) -> DataFrame:
        """Votes on agenda items whose label holds a word, with the resolution and its citation."""
        t = self.of("Tagesordnungspunkt", "top").where(F.lower("top_label").contains(word.lower()))
        v = self.hop(t, "ENTSCHIEDEN_DURCH", "top", "vote").join(self.of("Abstimmung", "vote"), ["session_id", "vote"])
        v = self.hop(v, "FUEHRT_ZU", "vote", "res", "left").join(self.of("Beschluss", "res"), ["session_id", "res"], "left").join(self.citations("res"), ["session_id", "res"], "left")
        return v.select("session_id", "top_label", F.col("vote_label").alias("abstimmung"), F.col("vote_sub").alias("ergebnis"), F.col("res_label").alias("beschluss"), "cited")

    def fact_checks(self, verdicts: list[str] | None = None) -> DataFrame:
        """Person, statement, verdict, reasoning and source of each check; of several sources the first by id."""
        c = self.of("Faktencheck", "chk")
        if verdicts:
            c = c.where(F.col("chk_sub").isin(verdicts))
        q = self.rel("BELEGT_MIT", "chk", "src").join(self.of("Quelle", "src"), ["session_id", "src"])
        q = q.groupBy("session_id", "chk").agg(F.min(F.struct("src", "src_label", F.col("src_props")["url"].alias("url"))).alias("q"))
        a = self.hop(c, "GEPRUEFT_ALS", "st", "chk").join(self.of("Aussage", "st"), ["session_id", "st"])
        a = self.hop(a, "TAETIGT_AUSSAGE", "person", "st", "left").join(self.of("Person", "person"), ["session_id", "person"], "left")
        return a.join(q, ["session_id", "chk"], "left").select("session_id", F.col("person_label").alias("person"), F.col("st_props")["text"].alias("aussage"), F.col("chk_sub").alias("verdikt"), F.col("chk_props")["begruendung"].alias("begruendung"), F.col("q.src_label").alias("quelle"), F.col("q.url").alias("url"))

    def reactions(self) -> DataFrame:
        """Reactions by agenda item, with the speech that they answer, if any."""
        r = self.hop(self.of("Tagesordnungspunkt", "top"), "HAT_REAKTION", "top", "ev").join(self.of("AkustischesEreignis", "ev"), ["session_id", "ev"])
        r = self.hop(r, "REAKTION_AUF", "ev", "speech", "left").join(self.of("Redebeitrag", "speech"), ["session_id", "speech"], "left")
        return r.select("session_id", F.col("top_label").alias("top"), F.col("ev_sub").alias("typ"), F.col("ev_props")["urheber"].alias("urheber"), F.col("ev_props")["text"].alias("wortlaut"), F.col("speech_label").alias("auf_redebeitrag"))

    def reaction_counts(self) -> DataFrame:
        return self.of("AkustischesEreignis", "ev").groupBy(F.col("ev_sub").alias("typ")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "typ")

    def applause_givers(self, most: int = 8) -> DataFrame:
        e = self.of("AkustischesEreignis", "ev").where("ev_sub = 'Beifall'").withColumn("fraktion", F.col("ev_props")["urheber"]).where("fraktion != ''")
        return e.groupBy("fraktion").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fraktion").limit(most)

    def applause_received(self) -> DataFrame:
        e = self.hop(self.of("AkustischesEreignis", "ev").where("ev_sub = 'Beifall'"), "REAKTION_AUF", "ev", "speech")
        e = self.hop(self.hop(e, "HAT_REDEBEITRAG", "person", "speech"), "MITGLIED_VON", "person", "party").join(self.of("Fraktion", "party"), ["session_id", "party"])
        return e.groupBy(F.col("party_label").alias("fraktion")).agg(F.count(F.lit(1)).alias("beifall")).orderBy(F.desc("beifall"), "fraktion")

    def speakers(self, least_sessions: int = 1, most: int = 10) -> DataFrame:
        """Persons by speeches, who speak in at least so many sessions."""
        s = self.rel("HAT_REDEBEITRAG", "person", "speech").join(self.of("Person", "person"), ["session_id", "person"])
        g = s.groupBy(F.col("person_label").alias("person")).agg(F.countDistinct("session_id").alias("sitzungen"), F.count(F.lit(1)).alias("reden"))
        return g.where(F.col("sitzungen") >= least_sessions).orderBy(F.desc("reden"), "person").limit(most)

    def session_counts(self) -> DataFrame:
        """Distinct agenda items, speeches and reactions of each session; each side is counted before it is joined."""
        count = lambda kind, name: self.nodes.where(F.col("type") == kind).groupBy("session_id").agg(F.countDistinct("id").alias(name))
        out = self.of("Sitzung", "s").select("session_id")
        for kind, name in (("Tagesordnungspunkt", "tops"), ("Redebeitrag", "reden"), ("AkustischesEreignis", "reaktionen")):
            out = out.join(count(kind, name), "session_id", "left")
        return out.na.fill(0).orderBy("session_id")

    def unproven_speeches(self) -> DataFrame:
        """Speeches that no segment backs; there must be none."""
        return self.of("Redebeitrag", "speech").join(self.rel("BELEGT_DURCH", "speech", "seg"), ["session_id", "speech"], "left_anti").select("session_id", "speech")

    def degrees(self, kind: str = "Person") -> DataFrame:
        """Edges at each node of a type, in any direction; lone nodes have 0."""
        ends = self.edges.select("session_id", F.col("source_id").alias("id")).unionAll(self.edges.select("session_id", F.col("target_id").alias("id")))
        own = self.nodes.where(F.col("type") == kind).select("id", "label").dropDuplicates(["id"])
        d = ends.join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("deg"))  # ends of other types aren't counted
        return own.join(d, "id", "left").na.fill(0, ["deg"])

    def co_speech(self) -> DataFrame:
        """Pairs of persons (source < target) by the distinct agenda items that both speak to."""
        # Items are told apart by 64-bit hashes, persons by numbers in order of their names, as pairs take the most bytes.
        number = F.xxhash64
        spoken = self.rel("HAT_REDEBEITRAG", "person", "speech")
        who = stored(numbered(spoken.select("person"), "person"), "persons")
        talk = spoken.join(who, "person").select(number("session_id", "speech").alias("s"), F.col("n").alias("a"))
        to = self.rel("ZU_TOP", "speech", "top").select(number("session_id", "speech").alias("s"), number("session_id", "top").alias("top"))
        on = talk.join(to, "s").select("top", "a").repartition("top").sortWithinPartitions("top", "a")
        pairs = counted(stored(lists(on, BLOCK), "items"), PART)
        for end in ("a", "b"):
            pairs = pairs.join(who.select(F.col("n").alias(end), F.col("person").alias(f"person_{end}")), end)
        return pairs.select(F.col("person_a").alias("source"), F.col("person_b").alias("target"), "weight")

    def schema(self) -> tuple[DataFrame, DataFrame]:
        """Of each node type: count, property keys, layers; of each edge type: count and the pairs of types that it joins."""
        keys = self.nodes.select("type", F.explode_outer(F.map_keys("props")).alias("k")).groupBy("type").agg(F.sort_array(F.collect_set("k")).alias("keys"))
        n = self.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("schicht")).alias("layers")).join(keys, "type")
        t = self.nodes.select("session_id", "id", "type")
        e = self.edges.join(t.select("session_id", F.col("id").alias("source_id"), F.col("type").alias("a")), ["session_id", "source_id"]).join(t.select("session_id", F.col("id").alias("target_id"), F.col("type").alias("b")), ["session_id", "target_id"])
        return n, e.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.concat_ws("->", "a", "b"))).alias("pairs"))

    def evidence_path(self, hits: DataFrame) -> DataFrame:
        """Segments (session_id, seg, score) with what they back, its agenda item and session; several paths give several rows."""
        h = hits.join(self.rel("BELEGT_DURCH", "x", "seg"), ["session_id", "seg"], "left").join(self.rel("ZU_TOP", "x", "top"), ["session_id", "x"], "left")
        return h.join(self.of("Transkriptsegment", "seg"), ["session_id", "seg"], "left").select("session_id", "seg", F.col("seg_props")["text"].alias("text"), F.col("seg_props")["sprecher"].alias("sprecher"), "top", "score")


#: Words of a question by the named query that answers it, in order of precedence.
INTENTS: list[tuple[tuple[str, ...], str]] = [
    (("befangen",), "recusals"),
    (("beschlussfähig", "rechtsgrundlage"), "quorum"),
    (("faktencheck", "falsch", "irreführend", "beleg"), "fact_checks"),
    (("aufgabe", "frist", "zuständig"), "tasks"),
    (("beifall", "reaktion", "zwischenruf"), "reactions"),
    (("abgestimmt", "abstimmung zu", "wie wurde"), "vote_on"),
    (("beschluss", "beschlüsse", "beschlossen"), "resolutions"),
]


def ask(graph: Graph, question: str, about: str | None = None) -> DataFrame:
    """The DataFrame that answers a question; about is the word of an agenda item. Unknown questions get the resolutions."""
    low = question.lower()
    name = next((n for ws, n in INTENTS if any(w in low for w in ws)), "resolutions")
    if name == "vote_on":
        last = [w.strip("?.,!") for w in low.split() if len(w.strip("?.,!")) > 4]
        return graph.vote_on(about or (last[-1] if last else ""))
    return getattr(graph, name)()


def integrity(graph: Graph, sessions: int = 3) -> DataFrame:
    """One row for each check of a loaded graph: name and ok."""
    spark = graph.nodes.sparkSession
    c = graph.session_counts().agg(F.count(F.lit(1)).alias("n"), F.min("tops").alias("t"), F.min("reden").alias("r"), F.sum("reaktionen").alias("k")).first()
    checks = [
        ("sessions", c["n"] >= sessions),
        ("agenda items in each session", (c["t"] or 0) > 0),
        ("speeches in each session", (c["r"] or 0) > 0),
        ("reactions", (c["k"] or 0) > 0),
        ("every speech is backed", graph.unproven_speeches().limit(1).count() == 0),
        ("segments", graph.of("Transkriptsegment", "x").limit(1).count() > 0),
        ("persons of all sessions", graph.speakers(c["n"]).limit(1).count() > 0),
        ("every check has a source", graph.of("Faktencheck", "c").join(graph.rel("BELEGT_MIT", "c", "q"), ["session_id", "c"], "left_anti").limit(1).count() == 0),
    ]
    return spark.createDataFrame([(n, bool(ok)) for n, ok in checks], "name string, ok boolean")
