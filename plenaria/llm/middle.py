"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, put in a new order between sentinels.

A table over (state, byte) follows UTF-8 continuation bytes and the sentinels at once. Each transition emits whether a
code point begins at its byte and which sentinel ends there. One scan of the bytes gives these transitions with their
counts by stretch of bytes; a second pass finds a cut, given as a number of code points, by the counts of the stretches
and then inside one of them. What the state holds is told by the last few bytes, so that stretches are scanned side by side,
each after a short run-up, as numpy columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, table, without

#: Prefix, suffix and middle sentinels.
SENTINELS = ("<P>", "<S>", "<M>")

#: Bytes of a stretch.
STRETCH = 256

FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


class Scanner:
    """The automaton of some sentinels, as a table of next states and one of what a transition emits.

    A state is (the longest end of what was read that begins a sentinel, continuation bytes that a code point still lacks).
    A byte that continues nothing is a unit of its own. The byte 0xFF, which UTF-8 doesn't have, stands between texts."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        words = [s.encode() for s in sentinels]
        ends = {w[-n:] for w in words for n in range(1, len(w))}
        if not all(words) or len(set(words)) < len(words) or any(w[:n] in ends for w in words for n in range(1, len(w))) or any(a in b for a in words for b in words if a != b):
            raise ValueError("sentinels must be distinct, not empty, and neither overlap nor hold one another")
        self.words = words
        self.run_up = max(4, *map(len, words))
        begun = sorted({w[:n] for w in words for n in range(len(w))})  # b"" first
        states = [(p, lacks) for p in begun for lacks in range(4)]
        place = {s: i for i, s in enumerate(states)}
        self.next = np.zeros(len(states) << 8, np.uint8)
        self.emits = np.zeros(len(states) << 8, np.uint8)
        for (p, lacks), i in place.items():
            for b in range(256):
                read = p + bytes([b])
                ended = next((k for k, w in enumerate(words, 1) if read.endswith(w)), 0)
                kept = b"" if ended else next(read[j:] for j in range(len(read) + 1) if read[j:] in begun)
                continues = lacks > 0 and 0x80 <= b < 0xC0
                wants = lacks - 1 if continues else 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0
                self.next[i << 8 | b] = place[kept, wants]
                self.emits[i << 8 | b] = ended << 1 | (not continues)

    def scan(self, data: bytes) -> np.ndarray:
        """What each byte's transition emits: 1 where a unit begins, and 2 times the number of the sentinel that ends."""
        n = len(data)
        lanes = -(-n // STRETCH)
        held = np.full(self.run_up + lanes * STRETCH, 0xFF, np.uint8)
        held[self.run_up : self.run_up + n] = np.frombuffer(data, np.uint8)
        steps = np.lib.stride_tricks.as_strided(held, (self.run_up + STRETCH, lanes), (1, STRETCH))
        out = np.empty((STRETCH, lanes), np.uint8)
        state = np.zeros(lanes, np.uint16)
        for j in range(self.run_up + STRETCH):
            at = (state << 8) | steps[j]
            if j >= self.run_up:
                out[j - self.run_up] = self.emits[at]
            state = self.next[at].astype(np.uint16)
        return out.T.reshape(-1)


class Scanned:
    """Several texts after one scan: units of each, sentinels in each, and the byte where a unit begins."""

    def __init__(self, texts: list[bytes], scanner: Scanner):
        emitted = scanner.scan(b"\xff".join(texts) + b"\xff")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.ends = self.starts + sizes
        self.units = (emitted & 1).astype(bool)
        self.counts = np.concatenate(([0], np.cumsum(self.units.reshape(-1, STRETCH).sum(axis=1))))
        self.before = self._units_before(self.starts)
        self.n = self._units_before(self.ends) - self.before
        self.found = np.flatnonzero(emitted > 1)
        self.kinds = emitted[self.found] >> 1
        self.of = np.searchsorted(self.starts, self.found, "right") - 1

    def _units_before(self, at: np.ndarray) -> np.ndarray:
        lane = at // STRETCH
        inside = self.units.reshape(-1, STRETCH)[lane] & (np.arange(STRETCH) < (at % STRETCH)[:, None])
        return self.counts[lane] + inside.sum(axis=1)

    def cut(self, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The byte inside its text at which a unit begins, or where the text ends."""
        rank = self.before[text] + unit
        lane = np.minimum(np.searchsorted(self.counts, rank, "right") - 1, len(self.counts) - 2)
        upto = np.cumsum(self.units.reshape(-1, STRETCH)[lane], axis=1)
        byte = lane * STRETCH + np.argmax(upto > (rank - self.counts[lane])[:, None], axis=1)
        return np.where(unit >= self.n[text], self.ends[text], byte) - self.starts[text]


def draws(doc_id: Column, epoch: int = 1) -> Column:
    """64 hex digits that decide on a document: its id's digest in this epoch."""
    return F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sentinels: tuple[str, str, str] = SENTINELS, rate: int = 90, spm: int = 20, epoch: int = 1) -> DataFrame:
    """docs with n (code points), form (plain, psm or spm), prefix_chars, middle_chars and output.

    rate of 100 texts are transformed, spm of 100 of those with the suffix first; both cuts are uniform over the
    n + 1 places between code points. All of it follows from the id and the epoch. A text that is empty or holds a
    sentinel stays plain: its output is the text, its prefix_chars and middle_chars are null. Null texts are empty; a
    null id draws as the empty one; repeated rows get equal results; an empty table an empty result; texts of any length are cut
    whole, in memory of some ten times their bytes. Columns of docs named like result columns are replaced."""
    prefix, suffix, middle = (s.encode() for s in sentinels)
    scanner = Scanner(sentinels)

    def work(texts: list[bytes], drawn: list[str]) -> list[pa.Array]:
        seen = Scanned(texts, scanner)
        h = np.array([[int(d[8 * i : 8 * i + 8], 16) for i in range(4)] for d in drawn], np.int64)
        plain = (seen.n == 0) | (h[:, 2] % 100 >= rate)
        plain[seen.of] = True
        a, b = h[:, 0] % (seen.n + 1), h[:, 1] % (seen.n + 1)
        first, last = np.minimum(a, b), np.maximum(a, b)
        rows = np.arange(len(texts))
        forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
        out = []
        for t, form, i, j in zip(texts, forms.tolist(), seen.cut(rows, first).tolist(), seen.cut(rows, last).tolist(), strict=True):
            if form == "plain":
                out.append(t)
            elif form == "psm":
                out.append(b"".join((prefix, t[:i], suffix, t[j:], middle, t[i:j])))
            else:
                out.append(b"".join((suffix, t[j:], prefix, t[:i], middle, t[i:j])))
        return [pa.array(seen.n), pa.array(forms.tolist(), pa.string()), pa.array(first, mask=plain), pa.array(last - first, mask=plain), pa.array(out, pa.binary())]

    fields = FIELDS[:-1] + [T.StructField("output", T.BinaryType())]
    keep = without(docs, [f.name for f in FIELDS] + ["__draw__"])
    made = map_text(docs.withColumn("__draw__", draws(F.col(f"`{doc_id}`"), epoch)), text, keep, fields, work, also="__draw__")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(made: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """made with restored: the exact text, from output and form alone; null where the output hasn't the sentinels of its form.

    A null output is an empty one, a null form is plain. Columns named like the result are replaced."""
    scanner = Scanner(sentinels)
    orders = {"psm": [1, 2, 3], "spm": [2, 1, 3]}

    def work(texts: list[bytes], forms: list[str]) -> list[pa.Array]:
        seen = Scanned(texts, scanner)
        out: list[bytes | None] = []
        for k, (t, f) in enumerate(zip(texts, forms, strict=True)):
            if f not in orders:
                out.append(t)
                continue
            lo, hi = np.searchsorted(seen.of, [k, k + 1])
            ends = (seen.found[lo:hi] - seen.starts[k] + 1).tolist()
            sizes = [len(scanner.words[i - 1]) for i in orders[f]]
            if seen.kinds[lo:hi].tolist() != orders[f] or ends[0] != sizes[0]:
                out.append(None)
                continue
            one, two, three = t[ends[0] : ends[1] - sizes[1]], t[ends[1] : ends[2] - sizes[2]], t[ends[2] :]
            out.append(one + three + two if f == "psm" else two + three + one)
        return [pa.array(out, pa.binary())]

    keep = without(made, ["restored"])
    return map_text(made, output, keep, [T.StructField("restored", T.BinaryType())], work, also=form).withColumn("restored", F.col("restored").cast("string"))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = restored(fill_in_middle(docs).drop("text"))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (
  SELECT *, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS c2,
    ('0x' || substr(s, 17, 8))::BIGINT % 100 AS c3, ('0x' || substr(s, 25, 8))::BIGINT % 100 AS c4
  FROM t),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
