"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class, history). Both factors are log-linear in hashed features
of the history: the previous token, the one before it (a skip feature), and both together (an n-gram feature).
The most frequent tokens have classes of WIDTH tokens. All others fall into RARE classes by their first bytes and inside
these into groups of WIDTH, by their last bytes and then by a hash, as many levels deep as the vocabulary asks for: a
group at the end has some LEAF tokens. Each level is a softmax of its own; inside the last group a token has a smoothed
share of the counts of the whole training corpus.

Training is distributed: in every round each task takes the weights, makes gradient steps over its own documents
in minibatches and sends its weights back in blocks, which are averaged by the tokens seen. Each training document
is used once. Scoring works on sparse batches: token ids, three feature rows for each token, no dense matrix.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, steps, table, trimmed

#: The end of a text; no word holds white space.
END = b"\n"
#: Tokens with a softmax slot of their own: CLASSES classes of WIDTH; and the classes of all others.
CLASSES, WIDTH, RARE = 24, 24, 8
#: Tokens of the groups at the end, and the most levels (of hash digits) above them.
LEAF, DEEPEST = 1 << 16, 4
#: Rows of each hashed weight table.
ROW_BITS = 14
ROWS = 1 << ROW_BITS
#: The most frequent tokens, whose counts every task gets; the counts of others are joined by a shuffle.
KNOWN = 200_000
#: Tokens of a minibatch, and the share of documents of the first of two training rounds.
MINI, FIRST = 8192, 8
#: Distinct tokens that a task counts before it hands its counts on.
FLUSH = 300_000


def tokens(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then the end."""
    out = text.lower().split()
    out.append(END)
    return out


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def depth_of(distinct: int) -> int:
    """Levels of groups below the rare classes, so that a group at the end has about LEAF tokens; at least one."""
    levels = 1
    while levels < DEEPEST and distinct > RARE * WIDTH**levels * LEAF:
        levels += 1
    return levels


def leaf_of(token: bytes, depth: int) -> int:
    """The group of a token: its rare class, then a digit for each level."""
    leaf = (zlib.crc32(token[:3]) % RARE) * WIDTH + zlib.crc32(token[-2:]) % WIDTH
    if depth > 1:
        whole = zlib.crc32(token)
        for _ in range(depth - 1):
            leaf = leaf * WIDTH + whole % WIDTH
            whole //= WIDTH
    return leaf


def _leaf_column(depth: int):
    """leaf_of as a column of token."""
    last = F.expr("substring(token, greatest(1, octet_length(token) - 1), 2)")
    leaf = (F.crc32(F.substring("token", 1, 3)) % RARE) * WIDTH + F.crc32(last) % WIDTH
    for level in range(depth - 1):
        leaf = leaf * WIDTH + F.floor(F.crc32("token") / F.lit(WIDTH**level)) % WIDTH
    return leaf.cast("int")


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over all texts (one binary column): partial counts in the tasks, summed by a shuffle."""

    @trimmed
    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for at, n in steps(b.column(0)):
                for t in b.column(0).slice(at, n).to_pylist():
                    seen.update((t or b"").lower().split())
                seen[END] += n
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Index(dict):
    """Token -> its place by frequency; a token beyond the known ones -> len(known) + its group."""

    def __init__(self, known: list[bytes], depth: int):
        super().__init__(zip(known, range(len(known)), strict=True))
        self.size, self.depth, self.extra = len(known), depth, 0

    def __missing__(self, token: bytes) -> int:
        i = self.size + leaf_of(token, self.depth)
        if self.extra < 300_000:
            self.extra += 1
            self[token] = i
        return i


class Lexicon:
    """The frequent tokens with counts, and totals of the corpus; what every task needs to turn texts into numbers.

    groups has (counts, distinct tokens) of each group by its number."""

    def __init__(self, known: list[tuple[bytes, int]], total: int, distinct: int, groups: dict[int, tuple[int, int]]):
        self.known, self.counts = [t for t, _ in known], np.array([c for _, c in known], np.float64)
        self.total, self.distinct, self.depth = total, distinct, depth_of(distinct)
        slots = min(len(known), CLASSES * WIDTH)
        order = sorted(range(slots), key=lambda i: self.known[i])  # neighbours in spelling share a class
        each = max(1, -(-slots // CLASSES))
        below = WIDTH**self.depth  # groups of a rare class
        leaves = RARE * below
        self.leaf = np.array([leaf_of(t, self.depth) for t in self.known] + list(range(leaves)), np.int32)
        self.cls = (CLASSES + self.leaf // below).astype(np.int32)
        self.slot = np.full(len(self.leaf), -1, np.int32)
        for place, i in enumerate(order):
            self.cls[i], self.slot[i] = place // each, place % each
        n, v = np.zeros(leaves), np.zeros(leaves)
        for r, (c, d) in groups.items():
            n[r], v[r] = c, d
        for i in range(slots):
            n[self.leaf[i]] -= self.counts[i]
            v[self.leaf[i]] -= 1
        # A group shares its mass among its tokens and one more for all unseen ones.
        self.rare_mass = np.log10(n + 0.5 * (v + 1))
        self.log_count = np.concatenate((np.log10(self.counts + 0.5), np.zeros(leaves)))  # beyond the known ones it is joined later
        mass = np.zeros(CLASSES + RARE)
        self.word_bias = np.full((CLASSES, WIDTH), -1e9, np.float32)
        for i in range(slots):
            mass[self.cls[i]] += self.counts[i]
            self.word_bias[self.cls[i], self.slot[i]] = math.log(self.counts[i] + 0.5)
        mass[CLASSES:] = n.reshape(RARE, below).sum(axis=1)
        self.word_bias[self.word_bias.max(axis=1) < -1e8, 0] = 0.0
        self.class_bias = np.log(mass + 0.5).astype(np.float32)
        self.class_bias -= self.class_bias.max()
        self.word_bias -= self.word_bias.max(axis=1, keepdims=True)
        # Of each level: the logs of the masses of the groups, a row for each group above.
        self.group_bias = [np.log(n.reshape(RARE * WIDTH**level, WIDTH, -1).sum(axis=2) + 0.5).astype(np.float32) for level in range(self.depth)]
        for bias in self.group_bias:
            bias -= bias.max(axis=1, keepdims=True)
        self.index: Index | None = None

    def digits(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(group above, digit below it, number of the first group above) at each level, for tokens without a slot."""
        leaf, out, first = self.leaf[ids], [], 0
        for level in range(self.depth):
            part = leaf // WIDTH ** (self.depth - 1 - level)
            out.append((part // WIDTH, part % WIDTH, first))
            first += RARE * WIDTH**level
        return out

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def ids(self, words: list[bytes]) -> np.ndarray:
        if self.index is None:
            self.index = Index(self.known, self.depth)
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))


def contexts(lex: Lexicon, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of the three features of each token's history: (3, tokens)."""
    top = CLASSES * WIDTH
    c = np.where(lex.slot[ids] >= 0, ids, top + lex.cls[ids]).astype(np.uint32) + np.uint32(2)
    one = np.empty_like(c)
    one[1:] = c[:-1]
    one[starts] = 1
    two = np.empty_like(c)
    two[1:] = one[:-1]
    two[starts] = 1
    f = np.stack((one * np.uint32(0x9E3779B1), two * np.uint32(0x85EBCA77) + np.uint32(0x1B56C4E9), one * np.uint32(0xC2B2AE3D) + two * np.uint32(0x27D4EB2F)))
    return f ^ (f >> np.uint32(15))


def rows_of(f: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    h = (f + np.asarray(salt, np.uint32) * np.uint32(0x632BE59B)) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - ROW_BITS)).astype(np.uint16)


class Weights:
    """Three hashed tables: rows of class weights, of token weights inside a class, and of group weights inside a group."""

    def __init__(self, cls: np.ndarray | None = None, word: np.ndarray | None = None, group: np.ndarray | None = None):
        self.cls = np.zeros((ROWS, CLASSES + RARE), np.float32) if cls is None else cls
        self.word = np.zeros((ROWS, WIDTH), np.float32) if word is None else word
        self.group = np.zeros((ROWS, WIDTH), np.float32) if group is None else group


def _logits(w: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums of three rows of weights and a bias, whose largest is 0."""
    z = w[rows[0]]
    z += w[rows[1]]
    z += w[rows[2]]
    z += bias
    return z


def _normal(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp(z) in place of z, its sums by row); rows are moved by their largest only where a sum over- or underflows."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
        sums = e.sum(axis=1)
    odd = np.flatnonzero(~((sums > 1e-30) & (sums < 1e30)))
    if len(odd):
        e[odd] = np.exp(z[odd] - z[odd].max(axis=1, keepdims=True))
        sums[odd] = e[odd].sum(axis=1)
    return e, sums


def _gradient(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Probabilities less one at the right answer."""
    e, sums = _normal(z)
    e *= (1 / sums)[:, None]
    e[np.arange(len(y)), y] -= 1
    return e


def _log_prob(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    e, sums = _normal(z)
    own = e[np.arange(len(y)), y].astype(np.float64)
    low = own < 1e-30
    if low.any():  # too small to be told from 0 without its logarithm
        z = z[low].astype(np.float64)
        top = z.max(axis=1)
        exact = z[np.arange(len(z)), y[low]] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
        own[low] = 1.0
        out = np.log(own) - np.log(sums.astype(np.float64))
        out[low] = exact
        return out
    return np.log(own) - np.log(sums.astype(np.float64))


def _step(w: np.ndarray, seen: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """One gradient step of a table: each row moves by its summed gradient over the root of how often it was used."""
    for r in rows:
        order = np.argsort(r, kind="stable")
        s = r[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        used = s[first]
        seen[used] += np.diff(np.append(first, len(s)))
        w[used] -= (rate / np.sqrt(seen[used] + 1.0))[:, None] * np.add.reduceat(g[order], first, axis=0)


def learn(lex: Lexicon, w: Weights, seen: tuple[np.ndarray, ...], ids: np.ndarray, f: np.ndarray, rate: float = 0.25) -> None:
    """Minibatch steps over the tokens of some documents, changing w."""
    cls, slot = lex.cls[ids], lex.slot[ids]
    for lo in range(0, len(ids), MINI):
        part = slice(lo, lo + MINI)
        y = cls[part]
        rows = rows_of(f[:, part], 0)
        _step(w.cls, seen[0], rows, _gradient(_logits(w.cls, rows, lex.class_bias), y), rate)
        own = f[:, part]
        at = np.flatnonzero(slot[part] >= 0)
        if len(at):
            c = y[at]
            rows = rows_of(own[:, at], c + 1)
            _step(w.word, seen[1], rows, _gradient(_logits(w.word, rows, lex.word_bias[c]), slot[part][at]), rate)
        at = np.flatnonzero(slot[part] < 0)
        if len(at):
            own = own[:, at]
            for level, (above, digit, first) in enumerate(lex.digits(ids[part][at])):
                rows = rows_of(own, above + (first + 1))
                _step(w.group, seen[2], rows, _gradient(_logits(w.group, rows, lex.group_bias[level][above]), digit), rate)


def log10_probs(lex: Lexicon, w: Weights, ids: np.ndarray, f: np.ndarray) -> np.ndarray:
    """log10 P of each token; of a token beyond the known ones all but its own count's share, which is joined later."""
    cls, slot = lex.cls[ids], lex.slot[ids]
    out = np.empty(len(ids))
    for lo in range(0, len(ids), MINI):
        part = slice(lo, lo + MINI)
        y = cls[part]
        rows = rows_of(f[:, part], 0)
        p = _log_prob(_logits(w.cls, rows, lex.class_bias), y)
        own = f[:, part]
        at = np.flatnonzero(slot[part] >= 0)
        if len(at):
            c = y[at]
            rows = rows_of(own[:, at], c + 1)
            p[at] += _log_prob(_logits(w.word, rows, lex.word_bias[c]), slot[part][at])
        at = np.flatnonzero(slot[part] < 0)
        if len(at):
            own = own[:, at]
            for level, (above, digit, first) in enumerate(lex.digits(ids[part][at])):
                p[at] += _log_prob(_logits(w.group, rows_of(own, above + (first + 1)), lex.group_bias[level][above]), digit)
        out[part] = p * (1 / math.log(10))
    rare = np.flatnonzero(slot < 0)
    out[rare] += lex.log_count[ids[rare]] - lex.rare_mass[lex.leaf[ids[rare]]]
    return out


def _batches(lex: Lexicon, column: pa.Array):
    """(first row, token lists, ids, starts) of consecutive slices of a column of texts."""
    for at, n in steps(column):
        split = [tokens(t or b"") for t in column.slice(at, n).to_pylist()]
        ids = lex.ids([w for s in split for w in s])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in split])[:-1])).astype(np.int64)
        yield at, split, ids, starts


BLOCK = 1 << 9


def train_round(texts: DataFrame, lex: Lexicon, w: Weights) -> Weights:
    """One round of gradient updates over texts (one binary column): the average of the tasks' weights by tokens seen."""
    width = CLASSES + RARE + 2 * WIDTH

    @trimmed
    def run(batches):
        mine, seen, n = Weights(w.cls.copy(), w.word.copy(), w.group.copy()), tuple(np.zeros(ROWS) for _ in range(3)), 0
        for b in batches:
            for _, _, ids, starts in _batches(lex, b.column(0)):
                learn(lex, mine, seen, ids, contexts(lex, ids, starts))
                n += len(ids)
        if n:
            both = np.concatenate((mine.cls, mine.word, mine.group), axis=1) * np.float32(n)
            data = [both[i : i + BLOCK].tobytes() for i in range(0, ROWS, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary()), pa.array([float(n)] * len(data))], names=["block", "data", "n"])

    @trimmed
    def add(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for block, data, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = sums.setdefault(block, [np.zeros(BLOCK * width), 0.0])
                x[0] += np.frombuffer(data, np.float32)
                x[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / n).astype(np.float32).tobytes() for x, n in sums.values()], pa.binary())], names=["block", "data"])

    sent = texts.mapInArrow(run, "block int, data binary, n double")
    found = sent.repartition(ROWS // BLOCK, "block").mapInArrow(add, "block int, data binary").collect()  # the model: ROWS rows of weights
    if not found:
        return w
    both = np.concatenate([np.frombuffer(r[1], np.float32) for r in sorted(found)]).reshape(ROWS, width)
    cut = CLASSES + RARE
    return Weights(*(np.ascontiguousarray(x) for x in (both[:, :cut], both[:, cut : cut + WIDTH], both[:, cut + WIDTH :])))


def _most_frequent(counts: DataFrame, known: int) -> list[tuple[bytes, int]]:
    """At most so many of the most frequent tokens, most frequent first.

    A histogram of the logarithms of counts (some thousand rows for any corpus) gives the least count that fits, so
    that no task sends more than its share; tokens of equal logarithm come all or not at all."""
    step = F.floor(F.log2("c") * 64)
    least, room = None, known
    for bucket, n in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1))).collect(), reverse=True):
        if (room := room - n) < 0:
            break
        least = bucket
    if least is None:
        return []
    t = counts.where(step >= least).select("token", "c").toArrow()
    return sorted(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


_OUT = "rid long, key long, token binary, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    Trains on the rows whose crc32(doc_id as text) mod 5 is not 1 (a null doc_id trains). Null and empty texts are one
    end token. Repeated rows each train and each get equal scores; with no training rows all tokens are unknown; an
    empty table gives an empty result. Other columns are left out.
    Counts, and so base_score, cover the whole corpus and are the same for any layout. The weights are averages over the
    tasks, so score depends a little on how rows are split over them. Contexts tell the CLASSES * WIDTH most frequent
    tokens apart, and the groups of the others, inside which a token has its smoothed share of the counts."""
    d = docs.select("doc_id", F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    training = d.where(~F.col("held_out"))
    counts = staged(token_counts(training.select("text")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    depth = depth_of(distinct)
    groups = {r[0]: (r[1], r[2]) for r in counts.groupBy(_leaf_column(depth).alias("leaf")).agg(F.sum("c"), F.count(F.lit(1))).collect()}  # RARE * WIDTH^depth rows at most
    top = _most_frequent(counts, known)
    lex = Lexicon(top, total, distinct, groups)
    first = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0, F.lit(True))
    w = train_round(training.where(first).select("text"), lex, Weights())
    w = train_round(training.where(~first).select("text"), lex, w)
    norm = math.log10(total + 0.5 * (distinct + 1))

    @trimmed
    def run(batches):
        for b in batches:
            for at, split, ids, starts in _batches(lex, b.column(2)):
                size = len(lex.known)
                far = ids >= size
                p = log10_probs(lex, w, ids, contexts(lex, ids, starts))
                count = np.diff(np.append(starts, len(ids)))
                base = np.add.reduceat(lex.log_count[ids], starts) - count * norm
                near = np.add.reduceat((~far).astype(np.int64), starts)
                head = b.slice(at, len(split))
                rids = head.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [head.column(0), pa.array(rids), pa.nulls(len(split), pa.binary()), pa.nulls(len(split), pa.int64()), head.column(1), head.column(3), pa.array(count), pa.array(near), pa.array(base), pa.array(np.add.reduceat(p, starts))], names=names
                )
                # Tokens beyond the known ones, once for each document with their number.
                words, owner, number = [], [], []
                ends = np.append(starts, len(ids))
                at_far = np.flatnonzero(far)
                cut = np.searchsorted(at_far, ends)
                for i, s in enumerate(split):
                    if cut[i + 1] > cut[i]:
                        c = Counter([s[j] for j in (at_far[cut[i] : cut[i + 1]] - starts[i]).tolist()])
                        words += c.keys()
                        number += c.values()
                        owner += [i] * len(c)
                if words:
                    k = len(words)
                    rid = pa.array(rids[np.array(owner)])
                    yield pa.RecordBatch.from_arrays([rid, pa.nulls(k, pa.int64()), pa.array(words, pa.binary()), pa.array(number, pa.int64()), *(pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

    names = [x.split()[0] for x in _OUT.split(", ")]
    scored = d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "held_out").mapInArrow(run, _OUT)
    # Rows of documents must not meet in one partition for want of a token: each gets a key that no token has.
    token = F.coalesce(F.col("token"), F.concat(F.lit("\n").cast("binary"), F.col("key").cast("string").cast("binary")))
    found = scored.withColumn("token", token).join(counts, "token", "left")
    more = F.when(F.col("key").isNull(), F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).otherwise(0.0)
    also = F.when(F.col("key").isNull() & F.col("c").isNotNull(), F.col("n")).otherwise(0)
    out = found.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.coalesce(F.sum("n_known"), F.lit(0)) + F.sum(also)).cast("long").alias("n_known"),
        (F.max("base") + F.sum(more)).alias("base_score"),
        (F.max("score") + F.sum(more)).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
