"""Writers of graphs, dashboards and records."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.algorithms import stored

#: Nodes and relationships that a document of a graph holds, about.
PAGE = 2048

_LEAD = {"node": ["id", "label", "type", "subtype", "schicht"], "edge": ["source_id", "target_id", "relationship_type"]}


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, value): each session's graph as a document {metadata, nodes, relationships}, with the properties of both.

    Sessions of more than PAGE nodes or relationships have several documents, each with some of both; metadata counts the
    whole graph, and says which part of how many a document is. read_graph_json of the inputs reads them back."""
    nodes, edges = (stored(df.where("session_id IS NOT NULL"), name) for df, name in ((nodes, "nodes"), (edges, "relationships")))  # they are counted, then dealt
    count = lambda df, name: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    size = count(nodes, "n").join(count(edges, "m"), "session_id", "full").na.fill(0, ["n", "m"]).withColumn("parts", F.ceil(F.greatest("n", "m") / PAGE))
    # Most sessions are one document, whose lists are counted where they are; only of the others numbers are joined.
    large = stored(size.where("parts > 1"), "large")

    def listed(df: DataFrame, lead: list[str], name: str) -> DataFrame:
        entries = F.array_sort(F.map_entries("props"))  # maps have no order, their entries do
        own = F.to_json(F.struct(*lead, F.map_from_entries(entries).alias("props"))).alias("own")  # takes fewer bytes than a map
        part = F.pmod(F.xxhash64(*lead, F.map_entries("props")), F.coalesce("parts", F.lit(1))).alias("part")
        df = df.join(large, "session_id", "left").select("session_id", part, "n", "m", "parts", own)
        return df.groupBy("session_id", "part").agg(*[F.max(c).alias(f"{c}_{name}") for c in ("n", "m", "parts")], F.sort_array(F.collect_list("own")).alias(name))

    both = listed(nodes, _LEAD["node"], "nodes").join(listed(edges, _LEAD["edge"], "relationships"), ["session_id", "part"], "full")
    both = both.select("session_id", "part", "nodes", "relationships", *[F.coalesce(f"{c}_nodes", f"{c}_relationships").alias(c) for c in ("n", "m", "parts")])
    both = both.where("coalesce(n, size(nodes)) > 0")  # relationships of a session without nodes are left out
    held = lambda c, name: F.coalesce(c, F.when(F.col(name).isNotNull(), F.size(name)), F.lit(0)).cast("long")
    meta = F.to_json(F.struct(held("n", "nodes").alias("node_count"), held("m", "relationships").alias("relationship_count"), F.when(F.col("parts") > 1, F.col("part")).alias("part"), "parts"))
    array = lambda c: F.concat(F.lit(f'"{c}":['), F.array_join(c, ","), F.lit("]"))
    value = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"metadata":'), meta), array("nodes"), array("relationships")), F.lit("}"))
    return both.select("session_id", value.alias("value"))


def flat(df: DataFrame, kind: str) -> DataFrame:
    """Nodes or edges with a column for each property key, in order of name, after the leading columns."""
    keys = sorted(r[0] for r in df.select(F.explode(F.map_keys("props"))).distinct().collect())  # the schema's keys, not data
    keys = [k for k in keys if k not in _LEAD[kind]]
    return df.select("session_id", *_LEAD[kind], *[F.coalesce(F.col("props")[k], F.lit("")).alias(k) for k in keys])


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    flat(nodes, "node").write.mode("overwrite").csv(f"{path}/nodes", header=True)
    flat(edges, "edge").write.mode("overwrite").csv(f"{path}/relationships", header=True)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, ord, statement, params): constraints by label, then nodes, then edges with their properties; unsafe labels and types are left out.

    $props are the params beside id, or beside source and target."""
    n, e = nodes.where(X.safe_label(F.col("type"))), edges.where(X.safe_label(F.col("relationship_type")))
    make = n.select("type").distinct().select(F.lit(0).alias("section"), F.col("type").alias("ord"), F.concat(F.lit("CREATE CONSTRAINT IF NOT EXISTS FOR (n:"), F.col("type"), F.lit(") REQUIRE n.id IS UNIQUE")).alias("statement"), F.expr("map()").cast("map<string,string>").alias("params"))
    own = F.map_concat(F.create_map(F.lit("id"), F.col("id"), F.lit("label"), F.col("label")), F.map_filter("props", lambda k, _: ~k.isin("id", "label")))
    put = n.select(F.lit(1).alias("section"), F.col("id").alias("ord"), F.concat(F.lit("MERGE (n:"), F.col("type"), F.lit(" {id: $id}) SET n += $props")).alias("statement"), own.alias("params"))
    ends = F.map_concat(F.create_map(F.lit("source"), F.col("source_id"), F.lit("target"), F.col("target_id")), F.map_filter("props", lambda k, _: ~k.isin("source", "target")))
    put_own = F.when(F.size(F.map_filter("props", lambda k, _: ~k.isin("source", "target"))) > 0, " SET r += $props").otherwise("")
    link = e.select(F.lit(2).alias("section"), F.concat_ws("|", "source_id", "relationship_type", "target_id").alias("ord"), F.concat(F.lit("MATCH (a {id: $source}), (b {id: $target}) MERGE (a)-[r:"), F.col("relationship_type"), F.lit("]->(b)"), put_own).alias("statement"), ends.alias("params"))
    return make.unionByName(put).unionByName(link)


def script(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, ord, value): the same as lines of a script, all values quoted."""
    s = statements(nodes, edges)
    own = F.map_filter("params", lambda k, _: (F.col("section") != 2) | ~k.isin("source", "target"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(own)), lambda x: F.concat(x["key"], F.lit(": "), _quoted(x["value"]))), ", ")
    text = F.replace(F.replace(F.replace(F.replace("statement", F.lit("$id"), _quoted(F.col("params")["id"])), F.lit("$props"), F.concat(F.lit("{"), pairs, F.lit("}"))), F.lit("$source"), _quoted(F.col("params")["source"])), F.lit("$target"), _quoted(F.col("params")["target"]))
    return s.select("section", "ord", F.concat(text, F.lit(";")).alias("value"))


def write_script(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    script(nodes, edges).repartitionByRange("section", "ord").sortWithinPartitions("section", "ord").select("value").write.mode("overwrite").text(path)


def load(statements: DataFrame, send: Callable[[list], None] | None = None, batch: int = 500) -> DataFrame:
    """Sends statements in batches, constraints first, each task its own; without send only counts them (a dry run)."""
    if send:

        def part(rows: Iterable) -> None:
            held = []
            for r in rows:
                held.append((r["statement"], dict(r["params"] or {})))
                if len(held) == batch:
                    send(held)
                    held = []
            if held:
                send(held)

        for section in (0, 1, 2):
            statements.where(F.col("section") == section).foreachPartition(part)
    return statements.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def record_html(lists: dict[str, DataFrame]) -> DataFrame:
    """(session_id, value): the printable record, with contents, speeches under their items, reactions and links into the video."""
    u = lists["utterances"].select("session_id", "idx", "text")
    s = lists["speeches"].join(u, ["session_id", "idx"], "left")
    link = F.lit("")
    if "video_url" in s.columns:
        link = F.when(F.col("video_url").isNotNull(), F.concat(F.lit(' <a href="'), escaped(F.col("video_url")), F.lit("&t="), F.col("start").cast("int").cast("string"), F.lit('">Video</a>'))).otherwise(F.lit(""))
    speech = s.select("session_id", F.col("top_nummer").alias("t"), F.lit(1).alias("k"), F.col("idx").cast("long").alias("o"), F.concat(F.lit("<h3>"), escaped(F.col("person")), F.lit("</h3>"), link, F.lit("<p>"), escaped(F.col("text")), F.lit("</p>")).alias("h"))
    head = lists["tops"].select("session_id", F.col("nummer").alias("t"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("o"), F.concat(F.lit('<h2 id="top'), F.col("nummer").cast("string"), F.lit('">'), escaped(F.col("titel")), F.lit("</h2>")).alias("h"))
    parts = head.unionByName(speech)
    if "reactions" in lists:
        parts = parts.unionByName(lists["reactions"].select("session_id", F.col("top_nummer").alias("t"), F.lit(1).alias("k"), F.greatest("rede_index", F.lit(0)).cast("long").alias("o"), F.concat(F.lit("<em>"), escaped(F.col("text")), F.lit("</em>")).alias("h")))
    toc = lists["tops"].groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nummer", "titel"))), lambda x: F.concat(F.lit('<li><a href="#top'), x["nummer"].cast("string"), F.lit('">'), escaped(x["titel"]), F.lit("</a></li>"))), "").alias("toc"))
    body = parts.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "k", "o", "h"))), lambda x: x["h"]), "\n").alias("body"))
    return body.join(toc, "session_id", "left").select("session_id", F.concat(F.lit("<!DOCTYPE html><html><body><ul>"), F.coalesce("toc", F.lit("")), F.lit("</ul>"), F.col("body"), F.lit("</body></html>")).alias("value"))


def session_index(ledgers: dict[str, DataFrame]) -> DataFrame:
    """Sessions of all ledgers (wp, nr, one flag a source), newest first."""
    out = None
    for name, df in ledgers.items():
        df = df.select("wp", "nr").distinct().withColumn(name, F.lit(True))
        out = df if out is None else out.join(df, ["wp", "nr"], "full")
    return out.na.fill(False).orderBy(F.desc("nr"), F.desc("wp"))
