"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are runs of token characters that hold a digit or begin like a known kind of token, values assigned to a
telling name, and private-key blocks as far as their lines of base64 go. The forest sees a candidate's length, its
characters, how likely its letters follow each other, how much of it words cover, the words before it, and the path
that it comes from. Words and letters' transitions are learned from all documents (learn()). The forest is trained on
labelled findings, which label_findings() draws by rule, with words of the documents: keys, tokens and passwords, and
what is often taken for them. Candidates and their surroundings are seen whole, however long.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, map_text, staged, table, tune, without, written

#: Least vote of the forest for a secret.
THRESHOLD = 0.5
#: A word of the dictionary stands in this share of the documents, and in this many.
SHARE, LEAST = 1e-4, 3
#: The dictionary's bit table has 2 to this many bits (2 MiB), two of them set for each word.
BITS = 24
#: So many of the most frequent words may stand in drawn findings.
DRAWN = 2000
NAMES = rb"(?:pass(?:word|wd|phrase)?|pwd|pw|secret|token|bearer|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|private[_-]?key|client[_-]?secret)"
_GAP = rb"(?:\s|\\[rn])*+"
_CANDIDATE = re.compile(
    # A key block: header lines, lines of base64 (a short one only before the end line), the end line if there is one.
    rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[ \t]*\r?\n[A-Za-z0-9-]+: [^\r\n]*)*(?:" + _GAP + rb"[A-Za-z0-9+/]{20,}+={0,2})+(?:" + _GAP + rb"[A-Za-z0-9+/]++={0,2}(?=" + _GAP + rb"-----END))?(?:" + _GAP + rb"-----END [A-Z0-9 ]*PRIVATE KEY-----)?"
    rb"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    rb"|(?<![A-Za-z0-9_+/-])(?:gh[pousr]_|glpat-|xox[abeprs]-|sk[-_]|npm_|pypi-|AIza)[A-Za-z0-9_-]{16,}+"
    rb"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{8})[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+={0,2}(?:\.[A-Za-z0-9_-]{16,}+){0,2}"
)
_ASSIGNED = re.compile(rb"(?i)(?<![a-z])" + NAMES + rb"[\"']?\s*+(?:=>|:=|=|:)\s*+[\"']?([^\s\"'<>,;]{6,})")
_BEFORE = re.compile(rb"[A-Za-z]+")

#: Words before a candidate that speak for a secret, and those that speak for something else.
FOR = frozenset(b"password passwd pwd pw pass passphrase secret token bearer key apikey auth authorization credential credentials private client access login".split())
AGAINST = frozenset(
    b"commit sha md5 checksum digest hash uuid guid revision build version isbn order invoice phone tel fax card iban id serial ticket page figure line image base integrity etag object blob tree parent http https www com org net html".split()
)
#: Words of placeholders and identifiers, longest first.
WORDS = tuple(
    sorted(
        b"example sample changeme placeholder password secret token your test dummy fake redacted xxxx user admin name data image file version build index node module script style color background border content header footer title value default config server client public private master branch release update number order invoice page chapter figure table section article session member report public minute hour date time year month week http https www com html json xml pdf png jpg".split(),
        key=len,
        reverse=True,
    )
)
_WORD = re.compile(b"|".join(WORDS))
_PATH = {"test": re.compile(r"(?i)test|spec|fixture|mock"), "sample": re.compile(r"(?i)example|sample|demo|docs?/"), "lock": re.compile(r"(?i)lock|\.min\.|vendor|node_modules|checksums?")}
_PREFIX = re.compile(rb"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|xox[abprs]-|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.|glpat-|-----BEGIN")
_UUID = re.compile(rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")

FEATURES = ["length", "digits", "upper", "lower", "symbols", "entropy", "hex", "transitions", "vowels", "run", "likely", "covered", "placeholder", "prefix", "uuid", "assigned", "quoted", "for", "against", "near_for", "in_path", "path_test", "path_sample", "path_lock"]


_HEX, _VOWELS = b"0123456789abcdefABCDEF", b"aeiouAEIOU"
#: Of each byte: 0 digit, 1 upper case, 2 lower case, 3 other.
_KINDS = bytes(0 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 for c in range(256))


#: Whole words of 4 to 16 letters: nothing that stands in a name, a path, a token or an assigned value.
_WHOLE = r"(?<![\p{L}\p{N}_+/=:@.\"'-])[a-z]{4,16}(?![\p{L}\p{N}_+/=@\"'-])"
_LETTERS = re.compile(rb"[a-z]{4,}")


def _bits(h: int) -> tuple[int, int]:
    return h & (1 << BITS) - 1, h >> BITS & (1 << BITS) - 1


class Lexicon:
    """A dictionary as a bit table, how much likelier than by chance a letter follows another (in bits), and frequent words.

    Of 100,000 words the table takes one in 7,000 others for a word, of a million one in 80."""

    def __init__(self, table: np.ndarray, pairs: dict[str, int], frequent: list[str]):
        self.table, self.frequent = table.copy(), frequent
        for w in WORDS:
            if 4 <= len(w) <= 16:
                for at in _bits(xxhash.xxh64_intdigest(w, 42)):
                    self.table[at >> 6] |= np.uint64(1 << (at & 63))
        count = np.ones((26, 26))
        for p, n in pairs.items():
            count[ord(p[0]) - 97, ord(p[1]) - 97] += n
        self.pairs = np.log2(count / count.sum(axis=1, keepdims=True)) + np.log2(26)

    @classmethod
    def plain(cls) -> Lexicon:
        """That of the words of the module, where there are no documents."""
        pairs: dict[str, int] = {}
        for w in WORDS:
            for i in range(len(w) - 1):
                two = w[i : i + 2].decode()
                pairs[two] = pairs.get(two, 0) + 1
        return cls(np.zeros(1 << BITS - 6, np.uint64), pairs, [w.decode() for w in WORDS])

    def holds(self, word: bytes) -> bool:
        return all(int(self.table[at >> 6]) >> (at & 63) & 1 for at in _bits(xxhash.xxh64_intdigest(word, 42)))

    def covered(self, own: bytes) -> float:
        """The share of the characters that words cover, from left to right the longest first."""
        n = 0
        for m in _LETTERS.finditer(own.lower()):
            run, at = m[0], 0
            while at + 4 <= len(run):
                k = next((k for k in range(min(16, len(run) - at), 3, -1) if self.holds(run[at : at + k])), 0)
                n += k
                at += k or 1
        return n / len(own)

    def likely(self, own: bytes) -> float:
        """The mean over neighbouring letters; 0 without any."""
        c = np.frombuffer(own.lower(), np.uint8).astype(np.int64) - 97
        ok = (c >= 0) & (c < 26)
        both = np.flatnonzero(ok[1:] & ok[:-1])
        return float(self.pairs[c[both], c[both + 1]].mean()) if len(both) else 0.0


def learn(docs: DataFrame, text: str = "text", share: float = SHARE, least: int = LEAST) -> Lexicon:
    """The lexicon of all whole texts: the words that at least this share of the documents hold, and least of them.

    What reaches the driver is bounded: a bit table, a count for each pair of letters, DRAWN words. Null and empty texts
    have no words; copies count as documents; without words there are those of the module."""
    spark, before = docs.sparkSession, written()
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(_WHOLE), F.lit(0)))
    words = docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    words = staged(words.where(F.col("docs") >= max(least, share * docs.count())), "words")
    h = F.xxhash64("word")
    place = F.explode(F.array(h.bitwiseAND((1 << BITS) - 1), F.shiftrightunsigned(h, BITS).bitwiseAND((1 << BITS) - 1))).alias("place")
    rows = words.select(place).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")).toPandas()
    found = np.zeros(1 << BITS - 6, np.uint64)
    found[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    two = F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("two")
    pairs = {r.two: r.n for r in words.select(two, "docs").groupBy("two").agg(F.sum("docs").alias("n")).collect()}
    frequent = [r.word for r in words.orderBy(F.desc("docs"), "word").limit(DRAWN).collect()]
    forget(spark, before)
    return Lexicon(found, pairs, frequent) if frequent else Lexicon.plain()


def candidates(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) in bytes of each candidate, in order, none inside another."""
    spans = {m.span() for m in _CANDIDATE.finditer(text)}
    spans |= {m.span(1) for m in _ASSIGNED.finditer(text)}
    end = -1
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= end:
            yield a, b
            end = b


def words_of(text: bytes) -> tuple[list[int], list[bytes]]:
    """(where they end, the words of letters in lower case) of a text."""
    found = [(m.end(), m[0].lower()) for m in _BEFORE.finditer(text)]
    return [e for e, _ in found], [w for _, w in found]


def features(text: bytes, a: int, b: int, path: str = "", words: tuple[list[int], list[bytes]] | None = None, lexicon: Lexicon | None = None) -> list[float]:
    """What the forest sees of the candidate text[a:b]; words are words_of(text), where several candidates need them."""
    lexicon = lexicon or _plain()
    own = text[a:b]
    n = len(own)
    ends, names = words or words_of(text)
    kinds = np.frombuffer(own.translate(_KINDS), np.uint8)
    bytes_ = np.frombuffer(own, np.uint8)
    count = np.bincount(kinds, minlength=4) / n
    chars = np.bincount(bytes_) / n
    chars = chars[chars > 0]
    other = np.flatnonzero(np.concatenate(([True], bytes_[1:] != bytes_[:-1], [True])))
    at = bisect_right(ends, a)
    near = names[max(0, at - 4) : at]
    last = near[-1] if near else b""
    begin = a
    while begin and text[begin - 1 : begin] in (b" ", b"\t", b'"', b"'"):
        begin -= 1
    tail = text[max(0, begin - 1) : begin]
    return [
        float(n),
        *count.tolist(),
        -float((chars * np.log2(chars)).sum()),
        float(not own.translate(None, _HEX)),
        float((kinds[1:] != kinds[:-1]).sum()) / max(1, n - 1),
        (n - len(own.translate(None, _VOWELS))) / n,
        float(np.diff(other).max()) / n,
        lexicon.likely(own),
        lexicon.covered(own),
        sum(len(m) for m in _WORD.findall(own.lower())) / n,
        float(bool(_PREFIX.match(own))),
        float(bool(_UUID.match(own))),
        float(tail in (b"=", b":")),
        float(a > 0 and text[a - 1 : a] in (b'"', b"'")),
        float(last in FOR),
        float(last in AGAINST),
        float(any(w in FOR for w in near)),
        float(tail in (b"/", b".", b"@", b"#") or own.count(b"/") >= 2),
        *(float(bool(r.search(path))) for r in _PATH.values()),
    ]


@cache
def _plain() -> Lexicon:
    return Lexicon.plain()


class Forest:
    """Trees over bootstrap samples; at each split a random few features, each with thresholds at quantiles, by Gini gain."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 9, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            at = self.rng.integers(0, len(y), len(y))
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[at], y[at], depth, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list) -> int:
        me, p = len(nodes), float(y.mean())
        nodes.append((-1, 0.0, me, me, p))
        if depth == 0 or len(y) < 6 or p in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        for f in self.rng.choice(x.shape[1], 6, replace=False):
            for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15))):
                left = x[:, f] <= t
                k = int(left.sum())
                if not 0 < k < len(y):
                    continue
                pl, pr = y[left].mean(), y[~left].mean()
                gain = p * (1 - p) - (k * pl * (1 - pl) + (len(y) - k) * pr * (1 - pr)) / len(y)
                if gain > best[0]:
                    best = (gain, int(f), float(t))
        _, f, t = best
        if f < 0:
            return me
        left = x[:, f] <= t
        a = self._grow(x[left], y[left], depth - 1, nodes)
        b = self._grow(x[~left], y[~left], depth - 1, nodes)
        nodes[me] = (f, t, a, b, p)
        return me

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, t, a, b, p in self.trees:
            at = np.zeros(len(x), np.int64)
            while (f[at] >= 0).any():
                inner = f[at] >= 0
                left = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
                at = np.where(inner, np.where(left, a[at], b[at]), at)
            out += p[at]
        return out / len(self.trees)


def label_findings(n: int = 2400, seed: int = 11, words: list[str] | None = None) -> list[tuple[bytes, int, int, str, int]]:
    """Labelled findings (text, start, end, path, 1 for a secret), half of them secrets, drawn by rule.

    Prose and names are of the given words, and in part of none, as names are."""
    words = words or _plain().frequent
    rng = random.Random(seed)
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def some(chars: str, k: int) -> str:
        return "".join(rng.choice(chars) for _ in range(k))

    def prose(k: int) -> str:
        return " ".join(rng.choice(words) if rng.random() < 0.7 else "".join(rng.choice("aeinrstlohd") for _ in range(rng.randint(2, 9))) for _ in range(k))

    def secret() -> tuple[str, str]:
        name = rng.choice(["password", "token", "secret", "api_key", "apikey", "access_key", "auth_token", "passwd", "pwd", "client_secret", "bearer"])
        equal = rng.choice(["=", " = ", ": ", ":", " "])
        quote = rng.choice(["", '"', "'"])
        kind = rng.random()
        if kind < 0.05:
            lines = "\n".join(some(b64, 64) for _ in range(rng.randint(1, 25))) + "\n" + some(b64, rng.randint(2, 60)) + "=="
            name = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
            return "", f"-----BEGIN {name}PRIVATE KEY-----\n{lines}" + rng.choice([f"\n-----END {name}PRIVATE KEY-----", ""])
        if kind < 0.25:
            return rng.choice(["", "key ", "aws_access_key_id = ", '"']), rng.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + string.digits, 16)
        if kind < 0.4:
            return rng.choice(["", f"{name}{equal}{quote}"]), rng.choice(["ghp_" + some(alnum, 36), "sk-" + some(alnum, 32), "sk_live_" + some(alnum, 24), "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24), "AIza" + some(alnum, 35), "glpat-" + some(alnum, 20), "eyJ" + some(alnum, 30) + "." + some(alnum, 40) + "." + some(alnum, 43)])
        if kind < 0.7:
            return f"{name}{equal}{quote}", some(hexa, rng.choice([16, 18, 20, 24, 32, 40, 48, 64]))
        return f"{name}{equal}{quote}", some(rng.choice([alnum, b64, alnum + "!$%_-"]), rng.randint(8, 44)) + rng.choice("0123456789")

    def other() -> tuple[str, str]:
        kind = rng.randint(0, 13)
        if kind == 0:
            return rng.choice(["commit ", "revision ", "sha1: ", "sha256:", "checksum = ", "md5 ", "etag: ", "integrity "]), some(hexa, rng.choice([32, 40, 64]))
        if kind == 1:
            return rng.choice(["uuid ", "id=", "", "guid: "]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))
        if kind == 2:
            return rng.choice(["", "card ", "order ", "tel: ", "isbn "]), some(string.digits, rng.randint(8, 19))
        if kind == 3:
            return rng.choice(["", "call ", "phone: "]), "-".join(some(string.digits, k) for k in (3, 3, 4))
        if kind == 4:
            return rng.choice(["", "see "]), f"{prose(1)}{some(string.digits, rng.randint(1, 4))}{rng.choice(['', '_', '-'])}{prose(1)}longword"
        if kind == 5:
            return "https://", f"{prose(1)}/{prose(1)}/{some(string.digits, 4)}/{prose(1)}-{prose(1)}page{some(string.digits, 2)}"
        if kind == 6:
            return rng.choice(["version ", "release ", "build "]), f"{some(string.digits, 2)}-{some(string.digits, 4)}-release{some(string.digits, 3)}"
        if kind == 7:
            return rng.choice(["", "date "]), f"20{some(string.digits, 2)}-{some('01', 2)}-{some('012', 2)}T{some('01', 2)}-{some('012345', 2)}"
        if kind == 8:
            return rng.choice(["password=", "token: ", 'secret = "', "api_key="]), rng.choice(["changeme", "your_token_here1", "xxxxxxxxxxxx1", "placeholder123", "example_password", "password123", "<redacted1>", "test1234", "dummy_secret_1", "none", "required", "undefined", "${PASSWORD1}"])
        if kind == 9:
            return "image ", f"IMG_{some(string.digits, 8)}_{some(string.digits, 6)}"
        if kind == 10:
            return "data:image/png;base64,", some(b64, rng.randint(60, 200)) + "1"
        if kind == 11:
            return rng.choice(["file ", "/usr/lib/"]), f"{prose(1)}_{prose(1)}{some(string.digits, 2)}/{prose(1)}{some(string.digits, 1)}"
        if kind == 12:
            return "", f"{prose(1).capitalize()}{some(string.digits, 1)}{prose(1)}wordlonger"
        return rng.choice(["", "hash ", "object "]), some(hexa, rng.choice([12, 20, 32, 40]))

    out = []
    for i in range(n):
        label = i % 2
        head, own = secret() if label else other()
        left = prose(rng.randint(0, 8)).encode() + rng.choice([b" ", b"\n", b" ", b"### "]) + head.encode()
        text = left + own.encode() + rng.choice([b" ", b'" ', b"\n", b"### ", b". "]) + prose(4).encode()
        # All kinds of paths hold both; tests, samples and lock files more often what is no secret.
        path = rng.choice(["", "", "src/app.py", "config/prod.env", "tests/fixture.json", "docs/example.md"] if label else ["", "", "src/app.py", "config/prod.env", "tests/fixture.json", "docs/example.md", "package-lock.json"])
        out.append((text, len(left), len(left) + len(own), path, label))
    return out


def train(lexicon: Lexicon | None = None, found: list[tuple[bytes, int, int, str, int]] | None = None) -> Forest:
    """A forest of the findings, or of drawn ones; it keeps the lexicon, by which it judges."""
    lexicon = lexicon or _plain()
    found = label_findings(words=lexicon.frequent) if found is None else found
    x = np.array([features(t, a, b, path, None, lexicon) for t, a, b, path, _ in found])
    forest = Forest(x, np.array([y for *_, y in found], np.float64))
    forest.lexicon = lexicon
    return forest


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
FIELDS = [T.StructField("n_candidates", T.LongType(), False), T.StructField("n_secrets", T.LongType(), False), T.StructField("secrets", T.ArrayType(_SPAN), False)]


def _found(forest: Forest, texts: list[bytes], paths: list[str], threshold: float) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """For each text the number of candidates and the secrets (start, end in bytes, score)."""
    spans = [list(candidates(t)) for t in texts]
    rows = []
    for t, own, p in zip(texts, spans, paths, strict=True):
        words = words_of(t) if own else None
        rows += [features(t, a, b, p, words, forest.lexicon) for a, b in own]
    scores = iter(forest.scores(np.array(rows)).tolist() if rows else [])
    return [(len(own), [(a, b, s) for a, b in own if (s := next(scores)) >= threshold]) for own in spans]


def _points(text: bytes, own: list[tuple[int, int, float]]) -> list[dict]:
    """The spans in code points, each byte decoded once."""
    out, at, n = [], 0, 0
    for a, b, s in own:
        start = n + len(text[at:a].decode("utf-8", "replace"))
        at, n = b, start + len(text[a:b].decode("utf-8", "replace"))
        out.append({"start": start, "end": n, "score": s})
    return out


def scan(docs: DataFrame, forest: Forest | None = None, text: str = "text", threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """docs with n_candidates, n_secrets and secrets: the spans (code points) and scores of what the forest takes for secrets.

    Without a forest one is trained, with the lexicon of these documents. It sees the column path, if one is named; a null path is an empty one. Null and empty texts have no secrets;
    texts are scanned whole; repeated rows get equal results; an empty table gives an empty result. Columns named like
    result columns are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or train(learn(docs, text)))

    def work(texts: list[bytes], paths: list[str] | None = None) -> list[pa.Array]:
        found = _found(sent.value, texts, paths or [""] * len(texts), threshold)
        spans = [_points(t, own) for t, (_, own) in zip(texts, found, strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return [pa.array([n for n, _ in found], pa.int64()), pa.array([len(own) for _, own in found], pa.int64()), pa.array(spans, kind)]

    return map_text(docs, text, without(docs, [f.name for f in FIELDS]), FIELDS, work, path)


def redact(docs: DataFrame, forest: Forest | None = None, text: str = "text", threshold: float = THRESHOLD, mark: str = "[SECRET]", path: str | None = None) -> DataFrame:
    """docs with each secret in the text replaced by the mark; null texts stay null, all other columns and rows as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or train(learn(docs, text)))

    def work(texts: list[bytes], paths: list[str] | None = None) -> list[pa.Array]:
        out = []
        for t, (_, own) in zip(texts, _found(sent.value, texts, paths or [""] * len(texts), threshold), strict=True):
            ends = [0, *(b for _, b, _ in own)]
            begins = [*(a for a, _, _ in own), len(t)]
            out.append(mark.encode().join(t[a:b] for a, b in zip(ends, begins, strict=True)).decode("utf-8", "replace"))
        return [pa.array(out, pa.string())]

    new = T.StructField("__new__", T.StringType(), False)
    done = map_text(docs, text, docs.columns, [new], work, path)
    return done.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.col("__new__")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    """The whole texts of documents; the path of a document is its source."""
    tune(spark)
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path="source").drop("text", "source")
