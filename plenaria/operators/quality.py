"""Quality of transcripts: word error rates, missing passages, matching captions."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .algorithms import stored

WER = "wer double, subs int, ins int, dels int, n_ref int"


#: Width of the first band of an alignment; a band that is too narrow is made so many times wider.
BAND, WIDER = 64, 4
#: Words of a text that is aligned beside others, at most, and cells of a row of such alignments.
SHORT, CELLS = 512, 1 << 15


def _banded(a: np.ndarray, b: np.ndarray, w: int) -> tuple[int, int, int]:
    """(edits, insertions, deletions) of the best path that stays within w of the diagonal; ties go to the diagonal, then to a deletion.

    Place k of a row of the band is hyp's word i - w + k. One row at a time is kept, and each cell holds the deletions and
    insertions of its path, so memory grows with the band and time with ref times the band."""
    n, m, wide = len(a), len(b), 2 * w + 1
    far = np.int32(n + m + 1)
    at = np.arange(wide, dtype=np.int32)
    padded = np.full(m + n + 2 * wide, -1, np.int32)  # hyp with nothing on both sides; its word j stands at j + w
    padded[w + 1 : w + 1 + m] = b
    j = at - w
    cost, new = np.where((j >= 0) & (j <= m), j, far).astype(np.int32), np.where(j >= 0, j, 0).astype(np.int32)
    gone = np.zeros(wide, np.int32)
    for i, word in enumerate(a, 1):
        j = at + (i - w)
        diagonal = np.where(j >= 1, cost + (padded[i : i + wide] != word), far)
        down = np.append(cost[1:] + 1, far)
        row = np.where((j >= 0) & (j <= m), np.minimum(diagonal, down), far)
        row = np.minimum.accumulate(row - at) + at  # a run of insertions costs its length: a prefix minimum
        by_diagonal = row == diagonal
        by_deletion = ~by_diagonal & (row == down)
        # Where a path comes from the left, it is that of the nearest cell that doesn't, and the insertions since.
        left = np.maximum.accumulate(np.where(by_diagonal | by_deletion, at, 0))
        gone_here = np.where(by_diagonal, gone, np.append(gone[1:], 0) + 1)
        new_here = np.where(by_diagonal, new, np.append(new[1:], 0))
        cost, gone, new = np.minimum(np.where(j <= m, row, far), far), gone_here[left], new_here[left] + (at - left)
    k = m - n + w
    return int(cost[k]), int(new[k]), int(gone[k])


def _counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """(substitutions, insertions, deletions) of a shortest edit path; ties go to the diagonal, then to a deletion.

    A path of d edits never leaves the diagonal by more than d, so the best path of a band is the best of all as soon as it
    has no more edits than the band is wide: near texts of any length take time by their differences, not by their product."""
    code: dict[str, int] = {}
    a, b = (np.array([code.setdefault(w, len(code)) for w in ws], np.int32) for ws in (ref, hyp))
    w = max(BAND, abs(len(a) - len(b)))
    while True:
        w = min(w, max(len(a), len(b), 1))
        edits, new, gone = _banded(a, b, w)
        if edits <= w or w == max(len(a), len(b), 1):
            return edits - gone - new, new, gone
        w *= WIDER


def _side_by_side(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(edits, insertions, deletions) of each pair of short runs of codes, by whole tables that are filled row by row side by side; ties as in _banded."""
    n, m = (np.array([len(p[k]) for p in pairs], np.int32) for k in (0, 1))
    a, b = np.full((int(n.max()), len(pairs)), -2, np.int32), np.full((len(pairs), int(m.max()) + 1), -1, np.int32)
    for i, (x, y) in enumerate(pairs):
        a[: len(x), i], b[i, 1 : len(y) + 1] = x, y
    at = np.arange(b.shape[1], dtype=np.int32)
    begin = (np.arange(len(pairs)) * len(at))[:, None]
    cost, new, gone = np.tile(at, (len(pairs), 1)), np.tile(at, (len(pairs), 1)), np.zeros(b.shape, np.int32)
    out = np.stack([m, m, np.zeros_like(m)], axis=1)
    diagonal = np.full(b.shape, np.int32(1 << 30))
    for i, word in enumerate(a, 1):
        np.add(cost[:, :-1], b[:, 1:] != word[:, None], out=diagonal[:, 1:])
        down = cost + 1
        cost = np.minimum.accumulate(np.minimum(diagonal, down) - at, axis=1) + at
        by_diagonal = cost == diagonal
        left = np.maximum.accumulate(np.where(by_diagonal | (cost == down), at, 0), axis=1)
        gone_here, new_here = gone + 1, new.copy()
        np.copyto(gone_here[:, 1:], gone[:, :-1], where=by_diagonal[:, 1:])
        np.copyto(new_here[:, 1:], new[:, :-1], where=by_diagonal[:, 1:])
        from_ = left + begin
        gone, new = gone_here.reshape(-1)[from_], new_here.reshape(-1)[from_] + (at - left)
        if len(done := np.flatnonzero(n == i)):
            out[done] = np.stack([x[done, m[done]] for x in (cost, new, gone)], axis=1)
    return out


def _all_counts(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int]]:
    """_counts of many pairs; those of short texts are aligned side by side, in order of their lengths."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    short = []
    for i, (x, y) in enumerate(pairs):
        if max(len(x), len(y)) > SHORT:
            out[i] = _counts(x, y)
        else:
            short.append(i)
    short.sort(key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    code: dict[str, int] = {}
    at = 0
    while at < len(short):
        end, wide = at, 0
        while end < len(short) and (end == at or (wide := max(wide, len(pairs[short[end]][1]) + 1)) * (end + 1 - at) <= CELLS):
            wide = max(wide, len(pairs[short[end]][1]) + 1)
            end += 1
        code.clear()
        coded = [tuple(np.array([code.setdefault(w, len(code)) for w in ws], np.int32) for ws in pairs[i]) for i in short[at:end]]
        for i, (edits, new, gone) in zip(short[at:end], _side_by_side(coded).tolist(), strict=True):
            out[i] = (edits - gone - new, new, gone)
        at = end
    return out


def word_errors(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """pairs with wer (three decimals), subs, ins, dels and n_ref of lower-case word tokens."""

    @F.pandas_udf(WER)
    def errors(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        pairs = [(list(x if x is not None else []), list(y if y is not None else [])) for x, y in zip(r, h, strict=True)]
        out = [(round((s + n + d) / max(len(x), 1), 3), s, n, d, len(x)) for (x, _), (s, n, d) in zip(pairs, _all_counts(pairs), strict=True)]
        return pd.DataFrame(out, columns=["wer", "subs", "ins", "dels", "n_ref"])

    return pairs.withColumn("e", errors(X.tokens(F.col(ref)), X.tokens(F.col(hyp)))).select(*pairs.columns, "e.*")


def block_errors(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """The other rate: differing blocks of a matching of words, a replaced block counts its longer side."""

    @F.pandas_udf("edits int, n_ref int, wer double")
    def errors(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(r, h, strict=True):
            x, y = list(x if x is not None else []), list(y if y is not None else [])
            ops = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
            n = sum(max(b - a, d - c) for kind, a, b, c, d in ops if kind != "equal")
            out.append((n, len(x), n / max(len(x), 1)))
        return pd.DataFrame(out, columns=["edits", "n_ref", "wer"])

    return pairs.withColumn("e", errors(X.tokens(F.col(ref)), X.tokens(F.col(hyp)))).select(*pairs.columns, "e.*")


def differences(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", most: int = 90, context: int = 4) -> DataFrame:
    """pairs with diff: pieces [kind, words] of kind = (equal, long runs cut to their ends), p (changed), g (missing), r (added)."""
    kinds = {"equal": "=", "replace": "p", "delete": "g", "insert": "r"}

    @F.pandas_udf("array<array<string>>")
    def diff(r: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(r, h, strict=True):
            x, y = (x or "").split(), (y or "").split()
            pieces = []
            for kind, a, b, c, d in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                ws = x[a:b] if kind != "insert" else y[c:d]
                if kind == "equal" and len(ws) > 2 * context:
                    ws = [*ws[:context], "…", *ws[-context:]]
                pieces.append([kinds[kind], " ".join(ws), *([" ".join(y[c:d])] if kind == "replace" else [])])
            out.append(pieces[:most])
        return pd.Series(out)

    return pairs.withColumn("diff", diff(F.col(ref), F.col(hyp)))


def missing_passages(ref: DataFrame, hyp: DataFrame, by: list[str], least: float = 0.6, words: int = 4) -> DataFrame:
    """Sentences of ref (by, text) of at least so many tokens of which less than that share stands in hyp (by, text)."""
    vocab = hyp.select(*by, F.explode(X.tokens(F.col("text"))).alias("tok")).distinct().withColumn("there", F.lit(1))
    marked = F.regexp_replace("text", r"(?U)([.!?])\s+", "$1\u0001")
    s = ref.select(*by, F.posexplode(F.split(marked, "\u0001")).alias("pos", "satz")).withColumn("toks", X.tokens(F.col("satz"))).where(F.size("toks") >= words)
    t = s.select(*by, "pos", "satz", F.explode("toks").alias("tok")).join(vocab, [*by, "tok"], "left")
    g = t.groupBy(*by, "pos", "satz").agg(F.round(F.avg(F.coalesce("there", F.lit(0))), 2).alias("deckung"), F.avg(F.coalesce("there", F.lit(0))).alias("x"))
    return g.where(F.col("x") < least).select(*by, "pos", F.substring("satz", 1, 140).alias("satz"), "deckung")


def noisy(utterances: DataFrame, replaced: dict[str, str], dropped: str | None = None, where: str | None = None, unheard: list[str] | None = None) -> DataFrame:
    """(session_id, text, speakers) as a careless transcript has them: wrong numbers, passages left out where a text holds
    a word, all reactions and some speakers missed. Utterances without text are passed over."""
    t = F.col("text")
    for a, b in replaced.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    if dropped:
        t = F.when(F.contains(F.col("text"), F.lit(where or "")), F.regexp_replace(t, dropped, "")).otherwise(t)
    u = utterances.where(F.coalesce("text", F.lit("")) != "").withColumn("said", t)
    said = F.transform(F.array_sort(F.collect_list(F.struct("idx", "said"))), lambda x: x["said"])
    heard = F.collect_set(F.when(~F.col("speaker_name").isin(unheard or []), F.col("speaker_name")))
    return u.groupBy("session_id").agg(F.array_join(said, " ").alias("text"), F.sort_array(heard).alias("speakers"))


def divergences(errors: DataFrame, most: int = 8, shown: int = 6, least: float = 0.02) -> DataFrame:
    """The speeches (session_id, idx, wer, ...) of the largest rates of each session: rang up to most, and whether their
    differences are shown: the first few, as long as the rate reaches the least."""
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("wer"), "idx"))
    return errors.withColumn("rang", rank).where(F.col("rang") <= most).withColumn("gezeigt", (F.col("rang") <= shown) & (F.col("wer") >= least))


def recall(found, expected):
    """Share of reactions that were found, 1.0 where there are none, three decimals."""
    return F.when(expected == 0, 1.0).otherwise(F.round(found / expected, 3))


def missing_speakers(record, transcript):
    """Speakers of the record that the transcript lacks; all of them if it names none."""
    return F.when(F.size(transcript) == 0, record).otherwise(F.array_except(record, transcript))


def bag_overlap(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Similarity 2 * shared / all of bags of tokens for pairs with the same block (left: by, a, text; right: by, b, text)."""
    tok = lambda df, i: df.select(*by, i, F.explode(X.tokens(F.col("text"))).alias("t")).groupBy(*by, i, "t").agg(F.count(F.lit(1)).alias(f"n_{i}"))
    l, r = tok(left, "a"), tok(right, "b")
    size = lambda df, i: df.groupBy(*by, i).agg(F.sum(f"n_{i}").alias(f"size_{i}"))
    both = l.join(r, [*by, "t"]).groupBy(*by, "a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
    return both.join(size(l, "a"), [*by, "a"]).join(size(r, "b"), [*by, "b"]).withColumn("ratio", 2 * F.col("shared") / (F.col("size_a") + F.col("size_b")))


def in_turn(pairs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what each idx takes, the pairs that are still open) of pairs (by, idx, clip, want): in order of idx, the clip of the
    largest want that is left; wants of one idx differ.

    Every idx asks for the best clip that hasn't turned it down, and a clip that is asked turns down all that come after the
    least idx that asks, asked or not yet, as what it has in the end is never later; the rounds end with what one idx after
    another would take. Rounds are joins: no task holds a whole group."""
    pairs = stored(pairs, "pairs")
    while True:
        best = pairs.groupBy(*by, "idx").agg(F.max(F.struct("want", "clip")).alias("b")).select(*by, "idx", "b.clip", "b.want")
        asked = stored(best.withColumn("first", F.min("idx").over(W.partitionBy(*by, "clip"))), "asked")
        if asked.where("idx != first").isEmpty():
            return asked.drop("first"), pairs
        held = asked.where("idx = first").select(*by, "clip", "first")
        pairs = stored(pairs.join(held, [*by, "clip"], "left").where("first IS NULL OR idx <= first").select(*pairs.columns), "pairs")


def matched_captions(speeches: DataFrame, clips: DataFrame) -> DataFrame:
    """Speeches (session_id, key, idx, text) with one caption each (session_id, key, clip, text): in order of speech the
    unused clip of the same key of the largest bag similarity, the first of equals, no longer than 3 times the speech and
    50 words; speeches of fewer than 20 words have none.

    Pairs are those that share a word; only a speech that all these clips turn down meets the other clips of its key."""
    by = ["session_id", "key"]
    size = lambda df, i: df.select(*by, i, F.size(X.tokens(F.col("text"))).alias(f"size_{i}"))
    said, heard = size(speeches, "idx").where(F.col("size_idx") >= 20), size(clips, "clip")
    fits = F.col("size_clip") <= 3 * F.col("size_idx") + 50
    count = lambda df, i: df.select(*by, i, F.explode(X.tokens(F.col("text"))).alias("t")).groupBy(*by, i, "t").agg(F.count(F.lit(1)).alias(f"n_{i}"))
    shared = count(speeches, "idx").join(count(clips, "clip"), [*by, "t"]).groupBy(*by, "idx", "clip").agg(F.sum(F.least("n_idx", "n_clip")).alias("shared"))
    want = lambda ratio: F.struct(ratio.alias("ratio"), (-F.col("clip")).alias("first")).alias("want")
    ratio = 2 * F.col("shared") / (F.col("size_idx") + F.col("size_clip"))
    met = stored(shared.join(said, [*by, "idx"]).join(heard, [*by, "clip"]).where(fits).select(*by, "idx", "clip", want(ratio)), "met")
    asked, pairs = in_turn(met, by)
    widened = said.select(*by, "idx").limit(0)
    while True:  # who is left without a clip asks for those that it shares no word with, and may turn out others
        alone = stored(said.join(asked.select(*by, "idx"), [*by, "idx"], "left_anti").join(widened, [*by, "idx"], "left_anti"), "alone")
        more = alone.join(heard, by).where(fits).join(met.select(*by, "idx", "clip"), [*by, "idx", "clip"], "left_anti")
        more = stored(more.select(*by, "idx", "clip", want(F.lit(0.0))), "more")
        if more.isEmpty():
            return asked.select(*by, "idx", "clip", F.col("want.ratio").alias("ratio"))
        widened = stored(widened.unionByName(alone.select(*by, "idx")), "widened")
        asked, pairs = in_turn(pairs.unionByName(more), by)


def linked_videos(speeches: DataFrame, clips: DataFrame) -> DataFrame:
    """Speeches (session_id, idx, person_key) with the clip (session_id, ord, person_key, url) that belongs to them.

    A name's clips go to its speeches in order; a name without clips left takes the next one of the first name of the same last
    word that has one, which that name then lacks. So a speech wants its own name's clips, then the others' by the first clip of
    their name, each name's in order; who speaks earlier takes first. Null keys have no clip."""
    last = F.element_at(F.split("person_key", " "), -1).alias("last")
    said = speeches.where("person_key IS NOT NULL").select("session_id", last, "idx", F.col("person_key").alias("own"))
    queue = F.min("ord").over(W.partitionBy("session_id", "person_key"))
    held = clips.where("person_key IS NOT NULL").select("session_id", last, F.col("ord").alias("clip"), F.col("person_key").alias("other"), queue.alias("queue"))
    want = F.struct((F.col("own") == F.col("other")).alias("own"), (-F.col("queue")).alias("queue"), (-F.col("clip")).alias("clip")).alias("want")
    taken, _ = in_turn(said.join(held, ["session_id", "last"]).select("session_id", "last", "idx", "clip", want), ["session_id", "last"])
    return taken.join(clips.select("session_id", F.col("ord").alias("clip"), "url"), ["session_id", "clip"]).select("session_id", "idx", "url")
