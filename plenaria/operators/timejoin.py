"""Joins in time. Every join has an equality on the session; long sessions are cut into time slices, so that a join
of intervals is a hash join on (session, slice) with a residual condition, not a comparison of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 60.0


def _slices(start: Column, end: Column, width: float) -> Column:
    last = F.greatest(F.floor(start / width), F.floor(end / width))
    return F.explode(F.sequence(F.floor(start / width), last))


def best_overlap(items: DataFrame, turns: DataFrame, session: str = "session_id", width: float = SLICE) -> DataFrame:
    """Each item (item_id, start, end) with the speaker of the turn (turn_id, start, end, speaker) that it overlaps most.

    The earliest turn wins ties; items without an overlap get SPEAKER_??."""
    i = items.select(session, "item_id", F.col("start").alias("s"), F.col("end").alias("e"))
    t = turns.select(session, "turn_id", F.col("start").alias("ts"), F.col("end").alias("te"), "speaker")
    cut = i.withColumn("slice", _slices(F.col("s"), F.col("e"), width)).join(t.withColumn("slice", _slices(F.col("ts"), F.col("te"), width)), [session, "slice"])
    over = F.least("e", "te") - F.greatest("s", "ts")
    best = cut.where((F.col("s") < F.col("te")) & (F.col("ts") < F.col("e"))).groupBy(session, "item_id").agg(F.max_by("speaker", F.struct(over, -F.col("turn_id"))).alias("speaker"))
    return items.join(best, [session, "item_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("SPEAKER_??")))


def at_or_nearest(points: DataFrame, spans: DataFrame, session: str = "session_id", width: float = SLICE) -> DataFrame:
    """Each point (point_id, t) with the first span (idx, start, end) with start <= t < end, else the span of nearest start.

    Equal distances go to the smaller idx; a session without spans gives null."""
    p, s = points.select(session, "point_id", "t"), spans.select(session, "idx", "start", "end")
    inside = (
        p.withColumn("slice", F.floor(F.col("t") / width))
        .join(s.withColumn("slice", _slices(F.col("start"), F.col("end"), width)), [session, "slice"])
        .where((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end")))
        .groupBy(session, "point_id")
        .agg(F.min("idx").alias("idx"))
    )
    rest = p.join(inside, [session, "point_id"], "left_anti")
    near = _nearest(rest, s, session)
    return points.join(inside.unionByName(near), [session, "point_id"], "left")


def _nearest(points: DataFrame, spans: DataFrame, session: str) -> DataFrame:
    """The nearest start before and after each point, by one pass over both in order of time."""
    from pyspark.sql import Window as W

    starts = spans.groupBy(session, F.col("start").alias("t")).agg(F.min("idx").alias("idx"))
    both = starts.select(session, "t", "idx", F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id")).unionByName(
        points.select(session, "t", F.lit(None).cast(spans.schema["idx"].dataType).alias("idx"), "point_id")
    )
    w = W.partitionBy(session).orderBy("t")
    mark = F.when(F.col("idx").isNotNull(), F.struct(F.col("t").alias("at"), "idx"))
    before = F.last(mark, ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing))
    found = both.withColumn("b", before).withColumn("a", after).where(F.col("point_id").isNotNull())
    db, da = F.col("t") - F.col("b.at"), F.col("a.at") - F.col("t")
    pick = F.when(F.col("a").isNull(), F.col("b.idx")).when(F.col("b").isNull(), F.col("a.idx")).when(db < da, F.col("b.idx")).when(da < db, F.col("a.idx")).otherwise(F.least("b.idx", "a.idx"))
    return found.select(session, "point_id", pick.alias("idx"))


def kth_pairs(left: DataFrame, right: DataFrame, by: list[str], order: str) -> DataFrame:
    """The k-th row of a key on the left with the k-th row of that key on the right; left rows without one stay."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(order)
    return left.withColumn("k", F.row_number().over(w)).join(right.withColumn("k", F.row_number().over(w)), [*by, "k"], "left")
