"""Figures of a session and of a corpus, computed from the record lists; rankings have a tie key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def _spoken(speeches: DataFrame) -> DataFrame:
    return speeches.where(~F.coalesce("schriftlich", F.lit(False)))


def _ranked(df: DataFrame, order: list, most: int | None) -> DataFrame:
    out = df.withColumn("rang", F.row_number().over(W.partitionBy("session_id").orderBy(*order)))
    return out.where(F.col("rang") <= most) if most else out


def session_dashboard(lists: dict[str, DataFrame], checks: DataFrame | None = None, only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Every table of a session's dashboard, or only the named ones, for all sessions at once."""
    u = lists["utterances"].withColumn("woerter", X.words(F.col("text")))
    spoken = u.where("herkunft != 'anlage'")
    r = lists.get("reactions")

    def shares_of_words() -> DataFrame:
        by_party = spoken.where(F.coalesce("fraktion", F.lit("")) != "").groupBy("session_id", "fraktion").agg(F.sum("woerter").alias("woerter"), F.min("idx").alias("ord"))
        total = F.sum("woerter").over(W.partitionBy("session_id"))
        share = by_party.withColumn("prozent", F.round(100 * F.col("woerter") / F.when(total == 0, 1).otherwise(total), 1))
        return _ranked(share, [F.desc("woerter"), "ord"], None).drop("ord")

    def said(*columns: str) -> DataFrame:
        s = _spoken(lists["speeches"]).select("session_id", "person", "fraktion", "top_nummer", F.explode("src").alias("idx"))
        return s.join(u.select("session_id", "idx", *columns), ["session_id", "idx"], "left")

    def items() -> DataFrame:
        titles = lists["tops"].select("session_id", F.col("nummer").alias("top_nummer"), "titel")
        parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
        tops = said("text", "woerter").groupBy("session_id", "top_nummer").agg(F.sum("woerter").alias("woerter"), F.min("idx").alias("ord"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("alles"))
        return tops.join(titles, ["session_id", "top_nummer"], "left").withColumn("thema", X.topic(F.concat_ws(" ", "titel", "alles"))).drop("alles")

    def subjects() -> DataFrame:
        topics = items().groupBy("session_id", F.coalesce("thema", F.lit(X.NO_TOPIC)).alias("thema")).agg(F.sum("woerter").alias("woerter"), F.min("ord").alias("ord"))
        return _ranked(topics, [F.desc("woerter"), "ord"], None).drop("ord")

    def speakers() -> DataFrame:
        people = said("woerter").groupBy("session_id", F.col("person").alias("name")).agg(F.sum("woerter").alias("woerter"), F.count(F.lit(1)).alias("reden"), F.max_by("fraktion", "idx").alias("fraktion"), F.min("idx").alias("ord")).where("woerter > 0")
        return _ranked(people, [F.desc("woerter"), "ord"], 15).drop("ord")

    def feedback(key: str, received: bool = False) -> DataFrame:
        rows = r.withColumn("pol", X.polarity(F.col("typ"))).where("pol IS NOT NULL")
        if received:
            rows = rows.join(u.select("session_id", F.col("idx").alias("rede_index"), F.col("fraktion").alias("empf")), ["session_id", "rede_index"], "left")
        f = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy("session_id", F.col(key).alias("key")).agg(F.count_if(F.col("pol") == "positiv").alias("positiv"), F.count_if(F.col("pol") == "negativ").alias("negativ"), F.min("i").alias("ord"))
        return _ranked(f, [F.desc(F.col("positiv") + F.col("negativ")), "ord"], None).drop("ord")

    makers = {
        "sprachanteil_fraktion": shares_of_words,
        "top_themen": lambda: _ranked(items(), [F.desc("woerter"), "ord"], 30).drop("ord"),
        "sachthemen": subjects,
        "redner": speakers,
    }
    if r is not None:
        makers |= {"feedback_je_thema": lambda: feedback("top_nummer"), "feedback_gegeben_fraktion": lambda: feedback("urheber"), "feedback_erhalten_fraktion": lambda: feedback("empf", True)}
    if checks is not None:
        makers["faktencheck_bilanz"] = lambda: checks.groupBy("session_id", "verdikt").agg(F.count(F.lit(1)).alias("n"))
    makers["kennzahlen"] = lambda: _figures(lists, spoken, checks)
    return {name: make() for name, make in makers.items() if only is None or name in only}


def _figures(lists: dict[str, DataFrame], spoken: DataFrame, checks: DataFrame | None) -> DataFrame:
    n = F.count(F.lit(1))
    k = lists["speeches"].groupBy("session_id").agg(F.count_if(~F.coalesce("schriftlich", F.lit(False))).alias("reden"), F.count_if("schriftlich").alias("schriftliche_beitraege"))
    w = spoken.groupBy("session_id").agg(F.sum("woerter").alias("woerter"))
    out = w.join(k, "session_id", "left").join(lists["tops"].groupBy("session_id").agg(n.alias("tops")), "session_id", "left")
    if "reactions" in lists:
        out = out.join(lists["reactions"].groupBy("session_id").agg(n.alias("saalreaktionen")), "session_id", "left")
    if checks is not None:
        out = out.join(checks.groupBy("session_id").agg(n.alias("gepruefte_aussagen")), "session_id", "left")
    return out.withColumn("gesamtzeit_min", F.rint(F.col("woerter") / X.WORDS_PER_MINUTE).cast("long")).na.fill(0)


def corpus_dashboard(dash: dict[str, DataFrame], exact: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Sums over sessions of the (cut) session tables, as published; exact adds the same from uncut tables of persons."""
    topics = dash["sachthemen"].groupBy("thema").agg(F.sum("woerter").alias("woerter"), F.countDistinct("session_id").alias("sitzungen")).orderBy(F.desc("woerter"), "thema").limit(15)
    people = dash["redner"].groupBy("name").agg(F.sum("woerter").alias("woerter"), F.sum("reden").alias("reden"), F.max_by("fraktion", "session_id").alias("fraktion"), F.countDistinct("session_id").alias("sitzungen"))
    figures = dash["kennzahlen"].agg(*[F.sum(c).alias(c) for c in dash["kennzahlen"].columns if c != "session_id"])
    peaks = dash["kennzahlen"].agg(*[F.min_by("session_id", F.struct(-F.col(c), "session_id")).alias(f"max_{c}") for c in ("woerter", "reden")])
    out = {"sachthemen": topics, "redner": people.orderBy(F.desc("woerter"), "name").limit(25), "kennzahlen": figures, "spitzen": peaks}
    if "faktencheck_bilanz" in dash:
        out["verdikte"] = dash["faktencheck_bilanz"].groupBy("verdikt").agg(F.sum("n").alias("n"))
    if exact:
        u = exact["utterances"].withColumn("w", X.words(F.col("text")))
        s = _spoken(exact["speeches"]).select("session_id", "person", F.explode("src").alias("idx")).join(u.select("session_id", "idx", "w"), ["session_id", "idx"])
        out["redner_genau"] = s.groupBy("person").agg(F.sum("w").alias("woerter"), F.countDistinct("session_id").alias("sitzungen")).orderBy(F.desc("woerter"), "person")
    return out


def reaction_pairs(reactions: DataFrame, speeches: DataFrame, kind: str, most: int = 3) -> DataFrame:
    """Who reacts to whom with a kind of reaction, most often first."""
    to = reactions.where((F.col("typ") == kind) & F.col("urheber").isNotNull()).join(speeches.select("session_id", F.col("idx").alias("rede_index"), "person"), ["session_id", "rede_index"])
    return to.groupBy("urheber", "person").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "urheber", "person").limit(most)


def shares(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each value by the largest and by the sum of its group, for bars and stacks."""
    w = W.partitionBy(*by)
    return df.withColumn("von_max", F.col(value) / F.max(value).over(w)).withColumn("anteil", F.col(value) / F.sum(value).over(w))


def plain_summary(lists: dict[str, DataFrame]) -> DataFrame:
    """One text a session: its figures, agenda items, their speeches and reactions, line by line."""
    line = lambda df, section, order, text: df.select("session_id", F.lit(section).alias("sec"), order.cast("long").alias("ord"), text.alias("line"))
    rows = line(lists["meeting"], 0, F.lit(0), F.concat_ws(", ", "gremium", "datum", "ort"))
    count = lambda name, as_: lists[name].groupBy("session_id").agg(F.count(F.lit(1)).alias(as_))
    w = lists["utterances"].groupBy("session_id").agg(F.sum(X.words(F.col("text"))).alias("w"))
    w = w.join(count("speeches", "s"), "session_id", "left").join(count("tops", "t"), "session_id", "left")
    w = (w.join(count("reactions", "r"), "session_id", "left") if "reactions" in lists else w.withColumn("r", F.lit(0))).na.fill(0)
    rows = rows.unionByName(line(w, 0, F.lit(1), F.format_string("Redebeiträge: %d; Tagesordnungspunkte: %d; Wörter: %d; Saalreaktionen: %d", "s", "t", "w", "r")))
    rows = rows.unionByName(line(lists["tops"], 1, F.col("ord"), F.concat(F.lit("TOP "), F.col("nummer").cast("string"), F.lit(": "), F.col("titel"))))
    rows = rows.unionByName(line(lists["speeches"], 2, F.col("idx"), F.concat_ws(" ", F.col("timecode"), F.col("person"), F.concat(F.lit("("), F.col("fraktion"), F.lit(")")))))
    if "reactions" in lists:
        rows = rows.unionByName(line(lists["reactions"], 3, F.col("i"), F.concat(F.col("typ"), F.coalesce(F.concat(F.lit(" von "), F.col("urheber")), F.lit("")))))
    parts = F.array_sort(F.collect_list(F.struct("sec", "ord", "line")))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def session_counts(lists: dict[str, DataFrame]) -> DataFrame:
    """(session_id, tops, reden, reaktionen) of each session that has utterances."""
    out = lists["utterances"].select("session_id").distinct()
    for name, col in (("tops", "tops"), ("speeches", "reden"), ("reactions", "reaktionen")):
        n = lists[name].groupBy("session_id").agg(F.count(F.lit(1)).alias(col)) if name in lists else None
        out = out.join(n, "session_id", "left") if n is not None else out.withColumn(col, F.lit(0).cast("long"))
    return out.na.fill(0)


def speaker_names(speeches: DataFrame) -> DataFrame:
    """The distinct names of speakers, sorted; empty and null names are none."""
    return speeches.where(F.coalesce("person", F.lit("")) != "").select("person").distinct().orderBy("person")


def graph_verdicts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts of each session of a graph (session_id, verdikt, n), those of all); sessions without checks have no rows."""
    v = nodes.where("type = 'Faktencheck'").withColumn("verdikt", F.col("props")["verdikt"]).where(F.coalesce("verdikt", F.lit("")) != "")
    each = v.groupBy("session_id", "verdikt").agg(F.count(F.lit(1)).alias("n"))
    return each, each.groupBy("verdikt").agg(F.sum("n").alias("n"))
