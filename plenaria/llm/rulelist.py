"""Quality rules as a learned decision list; DataFrame functions only.

Statistics of each text are measured in its own row. Sequential covering learns from labelled statistics: a rule is a
conjunction of thresholds, grown on one part of the labelled documents by information gain, pruned on the other part by
what it gains there, and the documents that it covers go before the next one is grown. Growing needs only counts by
statistic and threshold, which Spark sums up; no labelled row reaches the driver. The list is one ordered conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import staged, table, without

WORDS = r"[^\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: What is counted of a text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper"]

#: The base rule: fewer words, or a larger share (of 100) of them in windows of three that occur twice.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Statistic -> (its value by the counts, the thresholds that a rule may use): ten per doubling, from the least to the most.
_SHARE = (0.002, 1.0)
STATISTICS: dict[str, tuple[Callable[[], Column], tuple[float, float]]] = {
    "words": (lambda: F.col("n_words").cast("double"), (50.0, 50_000.0)),
    "word_length": (lambda: _ratio("word_chars", "n_words"), (1.0, 64.0)),
    "symbols": (lambda: _ratio("n_symbols", "word_chars"), _SHARE),
    "dup_lines": (lambda: _ratio("n_dup_lines", "n_lines"), _SHARE),
    "repeated": (lambda: _ratio("n_repeat_words", "n_words"), _SHARE),
    "line_words": (lambda: _ratio("n_words", "n_lines"), (1.0, 2048.0)),
    "distinct": (lambda: _ratio("n_distinct", "n_words"), _SHARE),
    "upper": (lambda: _ratio("n_upper", "word_chars"), _SHARE),
}


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def thresholds(name: str) -> list[float]:
    lo, hi = STATISTICS[name][1]
    return [float(f"{lo * 2 ** (i / 10):.4g}") for i in range(int(10 * math.log2(hi / lo)) + 1)]


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A window's place takes the low PLACE bits of a number whose other bits are of its hash; of longer texts every window is a candidate.
PLACE = 20


def _neighbours(s: Column, same: Callable[[Column, Column], Column], place: Callable[[Column], Column]) -> Column:
    """Places of the elements of a sorted array that are the same as the one before or the one after."""
    meets = lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))
    return F.transform(F.filter(s, meets), place)


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Windows that may have an equal one are those whose hash bits meet in a sorted array of plain numbers (hash bits and
    place); of these few the whole hashes are compared. The places that stay, in order, cover three words each, less
    what the one before covers."""
    whole = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    short = F.sort_array(F.transform(starts, lambda i: F.shiftleft(whole(i), PLACE).bitwiseOR(i.cast("long"))))
    near = _with(short, lambda s: _neighbours(s, lambda a, b: F.shiftright(a, PLACE) == F.shiftright(b, PLACE), lambda x: x.bitwiseAND((1 << PLACE) - 1).cast("int")))
    candidates = F.when(F.size(words) <= 1 << PLACE, near).otherwise(starts)
    exact = F.sort_array(F.transform(candidates, lambda i: F.struct(whole(i).alias("h"), i.alias("p"))))
    covered = F.aggregate(
        F.sort_array(_with(exact, lambda s: _neighbours(s, lambda a, b: a.getField("h") == b.getField("h"), lambda x: x.getField("p")))),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc.getField("n") + F.least(F.lit(3), p - acc.getField("last"))).alias("n"), p.alias("last")),
        lambda acc: acc.getField("n"),
    )
    return F.when(F.size(words) >= 4, covered).otherwise(0)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text and with the COUNTS of it, long.

    Words are runs other than ASCII white space; lines, parts between \\n, count if they hold a word. Null and empty texts
    have 0 of everything. Every count is of the whole text, inside its row: repeated rows get equal counts, nothing is
    shuffled, an empty table stays empty. A very long text needs memory for its words and windows, some 100 bytes a
    word. Windows are told apart by 64-bit hashes. Columns of docs named like a count are replaced."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def counted(s: Column) -> Column:
        lines = F.filter(F.split(s, "\n", -1), lambda x: x.rlike(NOT_BLANK))
        words = F.regexp_extract_all(s, F.lit(WORDS), F.lit(0))
        of_words = _with(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), F.size(F.array_distinct(w)).alias("d"), _repeated(w).alias("r")))
        of_lines = _with(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
        return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(s, F.lit(SYMBOLS)).alias("sym"), F.regexp_count(s, F.lit(r"\p{Lu}")).alias("up"))

    keep = without(docs, [text, *COUNTS, "__s__"])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], _with(t, counted).alias("__s__"))
    found = dict(zip(COUNTS, ["w.n", "w.c", "sym", "l.d", "w.r", "l.n", "w.d", "up"], strict=True))
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__s__.{found[c]}").cast("long").alias(c) for c in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = STATISTICS[self.statistic][0]()
        return x >= self.threshold if self.above else x < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


@dataclass(frozen=True)
class RuleList:
    """Rules in order; a text that none covers is kept."""

    rules: tuple[Rule, ...] = ()

    def column(self) -> Column:
        """The number of the first rule that covers a row, from 0; null if none does."""
        out = F.lit(None).cast("int")
        for i, r in reversed(list(enumerate(self.rules))):
            out = F.when(r.column(), i).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([f"reject if {r}" for r in self.rules] + ["keep"])


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information gained on the p1 positives that stay when p0 and n0 become p1 and n1."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _grown(rows: DataFrame, most: int) -> Rule:
    """A rule for the rows of the growing part: the condition of the largest gain, again and again, until it covers no negative.

    Of thresholds of one statistic that gain the same the middle one is taken: it keeps away from both sides."""
    names, grids = list(STATISTICS), {s: thresholds(s) for s in STATISTICS}
    rule: tuple[Condition, ...] = ()
    own = rows.where("grow")
    while len(rule) < most:
        left = own
        for c in rule:
            left = left.where(_binned(c, names, grids))
        by: dict[tuple[int, int], Row] = {(r.s, r.b): r for r in left.select("bad", F.posexplode("bins").alias("s", "b")).groupBy("s", "b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()}
        p0 = sum(r.p for (s, _), r in by.items() if s == 0)
        n0 = sum(r.n for (s, _), r in by.items() if s == 0)
        if not p0 or not n0:
            break
        best: tuple[float, str, bool, list[int]] | None = None
        for s, name in enumerate(names):
            p = n = 0
            for b in range(len(grids[name])):  # bin b holds the values below threshold b that aren't below the one before
                p, n = p + (r.p if (r := by.get((s, b))) else 0), n + (r.n if r else 0)
                for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                    g = _gain(p0, n0, p1, n1)
                    if g > 1e-9 and (best is None or g > best[0] + 1e-9):
                        best = (g, name, above, [b])
                    elif best and g > best[0] - 1e-9 and best[1:3] == (name, above):
                        best[3].append(b)
        if not best:
            break
        _, name, above, ties = best
        rule += (Condition(name, above, grids[name][ties[len(ties) // 2]]),)
    return Rule(rule)


def _bin(name: str) -> Column:
    """How many thresholds of a statistic aren't above its value."""
    x = STATISTICS[name][0]()
    return F.size(F.filter(F.array(*map(F.lit, thresholds(name))), lambda t: t <= x)).cast("short")


def _binned(c: Condition, names: list[str], grids: dict[str, list[float]]) -> Column:
    b, at = F.get(F.col("bins"), F.lit(names.index(c.statistic))), grids[c.statistic].index(c.threshold)
    return b > at if c.above else b <= at


def _pruned(rows: DataFrame, rule: Rule, precision: float) -> Rule | None:
    """The beginning of the rule with the largest (p - n) / (p + n) on the pruning part, the shortest of several; None if
    fewer than precision of what it covers there are positive."""
    names, grids = list(STATISTICS), {s: thresholds(s) for s in STATISTICS}
    hit, sums = F.lit(True), []
    for i, c in enumerate(rule.conditions):
        hit = hit & _binned(c, names, grids)
        sums += [F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias(f"p{i}"), F.sum(F.when(hit, 1 - F.col("bad")).otherwise(0)).alias(f"n{i}")]
    if not sums:
        return None
    r = rows.where("NOT grow").agg(*sums).first()
    worth = [((p - n) / (p + n) if p + n else -1.0) for p, n in ((r[f"p{i}"] or 0, r[f"n{i}"] or 0) for i in range(len(rule.conditions)))]
    i = max(range(len(worth)), key=lambda i: (worth[i], -i))
    return Rule(rule.conditions[: i + 1]) if (worth[i] + 1) / 2 >= precision else None


def learned(counts: DataFrame, labels: DataFrame, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9) -> RuleList:
    """A list that rejects what labels (doc_id, quality) call 0, from counts (doc_id and COUNTS) of all labelled texts.

    Texts that fail the base rule teach nothing. Two of three labelled documents, by a hash of the id, grow rules, the
    others prune them. Learning ends when a rule is right in less than precision of the documents that it covers in the
    pruning part, or at most_rules. Of several labels of an id the greatest holds; null ids and labels are left out;
    repeated rows count as often as they occur; without labels of both classes the list is empty and keeps all. The
    list is the same for any layout of the rows: counts are exact, thresholds are fixed by rule. Each step sends one count for each
    statistic and threshold to the driver, whatever the table's size."""
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((1 - F.max("quality").cast("int")).alias("bad"))
    rows = counts.where(~base_failed()).join(y, "doc_id")
    bins = F.array(*[_bin(s) for s in STATISTICS])
    grow = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) > 0
    rows = staged(rows.select("bad", grow.alias("grow"), bins.alias("bins")), "rulelist-labelled")
    rules: list[Rule] = []
    left = rows
    names, grids = list(STATISTICS), {s: thresholds(s) for s in STATISTICS}
    while len(rules) < most_rules:
        rule = _pruned(left, _grown(left, most_conditions), precision)
        if rule is None:
            break
        rules.append(rule)
        hit = F.lit(True)
        for c in rule.conditions:
            hit = hit & _binned(c, names, grids)
        left = left.where(~hit)
    return RuleList(tuple(rules))


def judged(counts: DataFrame, rules: RuleList) -> DataFrame:
    """counts with base_failed, rule (the first that rejects the text, in words; null if none) and kept.

    kept is false where the base rule fails or a rule of the list covers the text. Columns named like these are replaced."""
    said = F.array(*[F.lit(str(r)) for r in rules.rules]) if rules.rules else F.array().cast("array<string>")
    keep = without(counts, ["base_failed", "rule", "kept"])
    at = rules.column()
    return counts.select(*[F.col(f"`{c}`") for c in keep], base_failed().alias("base_failed"), F.get(said, at).alias("rule"), (~base_failed() & at.isNull()).alias("kept"))


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    counts = staged(statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "rulelist-counts")
    rules = learned(counts, table(spark, sf_dir, "labels"))
    return judged(counts, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
