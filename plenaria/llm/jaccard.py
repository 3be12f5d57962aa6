"""N-gram Jaccard join with a prefix tree.

Documents with equal n-gram sets are one class. Classes are joined exactly:

1. Each set is put into one global order (frequent n-grams last, else by hash). Two sets at or above the threshold
   share an n-gram among their first few, so these prefixes are the only ones posted. Which n-grams are frequent is
   told by a bit table of fixed size; any order is a right one, a better order only makes the lists shorter.
2. Each posting of an n-gram that several sets have carries the path of the n-grams that follow it in the order. The
   paths under one n-gram are a prefix tree, dealt by n-gram. All sets walk the tree level by level: sets that share a
   beginning are compared with it once, an overlap goes down with the walk, and a subtree is left as soon as the
   n-grams that remain on either side can't add up to the overlap that the threshold asks for. In the tree of the first
   n-gram that two sets share the walk sees all that they have in common so far, so no pair is lost; sets whose n-gram
   before is the same one meet in that one's tree and are left to it.
3. An n-gram of many sets has a long list. Its sets are first paired with two hubs of the list, which joins most copies, and
   lists inside one component cost nothing more. In the others the sets outside the largest component walk the trees of
   the list's blocks, subtrees inside their own component are left, and pairs whose signatures tell them apart are dropped.
4. What the walks find is verified by a tree of the whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batch, forget, gram_hashes, mixed, parts_of, signed, staged, steps, table, trimmed, written
from .components import components

GRAM, PERCENT = 4, 85
#: An n-gram in the prefixes of more sets is frequent, and its list long.
FREQUENT = 32
TABLE_BITS = 24
#: Postings that a task keeps before it sends them, and the partners of a set in one tree.
HELD, BLOCK = 200_000, 256
SIG_BITS = 2048
#: N-grams of a path that go with a posting; what may follow them counts as shared until the sets are verified.
PATH = 32
#: Marks the end of a path.
END = np.uint32((1 << 32) - 1)
#: Sets of a block of a long list, sets of a tree, and pairs of sets and lists that walk it at a time.
CROSS, STEP_ROWS, STEP_PAIRS = 1024, 1 << 14, 1 << 20

POST = np.dtype([("tok", "<u8"), ("sid", "<u8"), ("n", "<u4")])
TALLY = np.dtype([("tok", "<u8"), ("c", "<u4")])
#: Marks the size of a set in the postings of a long list.
LONG = np.uint32(1 << 31)
MEMBER = np.dtype([("tok", "<u8"), ("sid", "<u8"), ("prev", "<u8"), ("n", "<u4"), ("beyond", "<u4"), ("size", "<u2")])


def prefix(n: int, percent: int) -> int:
    """How many first n-grams of a set of n any set at the threshold shares at least one with."""
    return n - -(-percent * n // 100) + 1


def gram_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The set of each text as sorted hashes: of its runs of k words, or of all its words if they are fewer."""
    batch = Batch(texts)
    h, at = batch.grams(k)
    cut = np.searchsorted(at, batch.starts)
    for i, n in enumerate(batch.counts.tolist()):
        if n >= k:
            s = np.sort(h[cut[i] : cut[i + 1]])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            yield gram_hashes(batch.hashes[batch.starts[i] : batch.starts[i + 1]], n) + np.uint64(n)
        else:
            yield h[:0]


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _sets(batches, column: int, k: int):
    """(batch slice, the sets of its texts)."""
    for b in batches:
        for at, n in steps(b.column(column)):
            part = b.slice(at, n)
            yield part, gram_sets([t or b"" for t in part.column(column).to_pylist()], k)


def signature(s: np.ndarray) -> bytes:
    """SIG_BITS parities of the n-grams: two sets differ in at least as many n-grams as their signatures in bits."""
    return np.packbits(np.bincount((s & np.uint64(SIG_BITS - 1)).astype(np.int64), minlength=SIG_BITS).astype(np.uint8) & 1).tobytes()


def _ends(first: np.ndarray, n: int) -> np.ndarray:
    """Where runs end that start at first, of n rows."""
    return np.append(first[1:], n) if len(first) else first


def _dealt(rows: np.ndarray, key: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each part that has any: the rows of the keys that fall to it, as bytes."""
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
    ends = _ends(first, len(part))
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["part", "rows"])


DEALT = "part int, rows binary"


def _gathered(batches, kind) -> np.ndarray:
    """All rows that a partition of dealt rows has."""
    found = [np.frombuffer(x, kind) for b in batches for x in b.column(1).to_pylist()]
    return np.concatenate(found) if found else np.empty(0, kind)


def _bits(df: DataFrame, column: str, bits: int = TABLE_BITS) -> np.ndarray:
    """A table with the bit of each value set; as large for any number of values."""
    bit = F.col(column).bitwiseAND((1 << bits) - 1)
    words = df.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")))
    out = np.zeros(1 << (bits - 6), np.int64)
    t = words.toArrow()  # 2^(bits - 6) rows at most
    out[t.column(0).to_numpy()] = t.column(1).to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    b = x & np.uint64((len(bits) << 6) - 1)
    return (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)


def classes_of(docs: DataFrame, key: str, text: str, k: int, percent: int, parts: int) -> tuple[DataFrame, np.ndarray]:
    """((key, mark, n, sid, sig) of each row, the bit table of frequent n-grams); mark is a hash of the text."""
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("t"))
    rest = [T.StructField("n", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("rows", T.BinaryType())]
    schema = T.StructType([source.schema[0], T.StructField("mark", T.LongType()), *rest])
    names = schema.names

    @trimmed
    def run(batches):
        held, size, key_type = ([], []), 0, None

        def flush():
            # Counts before anything is sent. A prefix may reach beyond its window where n-grams of it are frequent, so
            # those after the window are sent too if they come several times here: they may be frequent themselves.
            window, rest = (np.sort(np.concatenate(x)) for x in held)
            toks, counts = np.unique(np.concatenate((window, rest)), return_counts=True)
            some = (counts > 1) | (window[np.minimum(np.searchsorted(window, toks), len(window) - 1)] == toks)
            rows = np.empty(int(some.sum()), TALLY)
            rows["tok"], rows["c"] = toks[some], counts[some]
            d = _dealt(rows, rows["tok"], parts)
            n = d.num_rows
            return pa.RecordBatch.from_arrays([pa.nulls(n, key_type), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), d.column(0), d.column(1)], names=names)

        for part, sets in _sets(batches, 2, k):
            key_type = part.schema.field(0).type
            ns, sids, sigs, seen = [], [], [], set()
            for s in sets:
                ns.append(len(s))
                sigs.append(signature(s))
                sids.append(set_id(s))
                if len(s) and sids[-1] not in seen:
                    seen.add(sids[-1])
                    window = prefix(len(s), percent) * 3 // 2
                    held[0].append(s[:window])
                    held[1].append(s[window:])
                    size += len(s)
            n = len(ns)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ns, pa.int64()), pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            if size > 4 * HELD:
                yield flush()
                held, size = ([], []), 0
        if size:
            yield flush()

    out = staged(source.mapInArrow(run, schema), "join-sets")

    most = FREQUENT

    @trimmed
    def count(batches):
        rows = _gathered(batches, TALLY)
        rows = rows[np.argsort(rows["tok"])]
        first = np.flatnonzero(np.concatenate(([True], rows["tok"][1:] != rows["tok"][:-1]))) if len(rows) else np.empty(0, np.int64)
        often = rows["tok"][first][np.add.reduceat(rows["c"], first) > most] if len(first) else rows["tok"]
        yield pa.RecordBatch.from_arrays([signed(often)], names=["tok"])

    frequent = out.where("part IS NOT NULL").select("part", "rows").repartition(parts, "part").mapInArrow(count, "tok long")
    return out.where("part IS NULL").select("key", "mark", "n", "sid", "sig"), _bits(frequent, "tok")


def _new_runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _postings(docs: DataFrame, text: str, k: int, percent: int, parts: int, frequent: np.ndarray) -> DataFrame:
    """Dealt POST rows of the prefix n-grams that several sets have, all of one set in one part, LONG added to n if the list is long.

    Frequent n-grams are known to have long lists: their postings are salted by set and never meet."""
    most = FREQUENT
    source = docs.select(F.col(text).cast("binary").alias("t"))

    @trimmed
    def post(batches):
        held, size, sent = [], 0, set()

        def flush():
            rows = np.concatenate(held)
            often = _has(frequent, rows["tok"])
            return _dealt(rows, np.where(often, mixed(rows["tok"] ^ rows["sid"]), rows["tok"]), parts)

        for _, sets in _sets(batches, 0, k):
            for s in sets:
                if not len(s) or (sid := set_id(s)) in sent:
                    continue
                if len(sent) < 100_000:
                    sent.add(sid)
                last = _has(frequent, s)
                p = prefix(len(s), percent)
                rows = np.empty(p, POST)
                rows["tok"], rows["sid"], rows["n"] = np.concatenate((s[~last], s[last]))[:p], sid, len(s)
                held.append(rows)
                size += p
            if size > HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    @trimmed
    def several(batches):
        rows = _gathered(batches, POST)
        rows = rows[np.lexsort((rows["sid"], rows["tok"]))]
        rows = rows[_new_runs(rows["tok"], rows["sid"])]
        first = np.flatnonzero(_new_runs(rows["tok"]))
        count = _ends(first, len(rows)) - first
        often = _has(frequent, rows["tok"])
        rows["n"][often | np.repeat(count > most, count)] |= LONG
        rows = rows[often | np.repeat(count > 1, count)]
        yield _dealt(rows, mixed(rows["sid"]), parts)

    return source.mapInArrow(post, DEALT).repartition(parts, "part").mapInArrow(several, DEALT).repartition(parts, "part")


PATHS = "part int, rows binary, codes binary, tok long, sid long, prev long, n long, beyond long, size int, whole int, path binary"


def _paths(postings: DataFrame, percent: int, parts: int, frequent: np.ndarray) -> DataFrame:
    """For each posting the path of the set's next PATH n-grams in the global order, and the one before: rows of long lists one by one,
    the others dealt by n-gram. An n-gram that no other set has can't be shared and is left out of paths."""
    most = PATH

    @trimmed
    def run(batches):
        rows = _gathered(batches, POST).copy()
        often = _has(frequent, rows["tok"])
        order = np.lexsort((rows["tok"], often, rows["sid"]))
        rows, often = rows[order], often[order]
        long = (rows["n"] & LONG) > 0
        rows["n"] &= LONG - np.uint32(1)
        if not len(rows):
            return
        codes = np.minimum((rows["tok"] >> np.uint64(33)).astype(np.uint32) | (often.astype(np.uint32) << np.uint32(31)), END - 1)
        first = np.flatnonzero(_new_runs(rows["sid"]))
        end = np.repeat(_ends(first, len(rows)), _ends(first, len(rows)) - first)
        whole = end - np.repeat(first, _ends(first, len(rows)) - first)  # n-grams of the prefix that other sets have
        at = np.arange(len(rows))
        n = rows["n"].astype(np.int64)
        p = n + 1 - -(-percent * n // 100)
        size = np.minimum(end - at - 1, most)
        out = np.empty(len(rows), MEMBER)
        out["tok"], out["sid"], out["n"], out["size"] = rows["tok"], rows["sid"], rows["n"], size
        out["prev"][first], out["prev"][1:][~_new_runs(rows["sid"])[1:]] = 0, rows["tok"][:-1][~_new_runs(rows["sid"])[1:]]
        out["beyond"] = end - at - 1 - size + n - p
        for a in range(0, len(rows), 1 << 15):
            part = slice(a, a + (1 << 15))
            cold, hot = at[part][~long[part]], at[part][long[part]]
            d = _dealt_paths(out[cold], _windows(codes, cold, size[cold]), parts)
            paths = [codes[i + 1 : i + 1 + s].tobytes() for i, s in zip(hot.tolist(), size[hot].tolist(), strict=True)]
            m = d.num_rows
            yield pa.RecordBatch.from_arrays([*d.columns, *(pa.nulls(m, pa.int64()) for _ in range(5)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
            m, h = len(hot), out[hot]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), signed(h["tok"]), signed(h["sid"]), signed(h["prev"]), pa.array(h["n"].astype(np.int64)), pa.array(h["beyond"].astype(np.int64)), pa.array(h["size"].astype(np.int32)), pa.array((1000 * whole[hot] // p[hot]).astype(np.int32)), pa.array(paths, pa.binary())], names=names)

    names = [x.split()[0] for x in PATHS.split(", ")]
    return staged(postings.mapInArrow(run, PATHS), "join-paths")


def _windows(codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The codes that follow each place, so many of each, one after the other."""
    begin = np.repeat(at + 1 - (np.cumsum(size) - size), size)
    return codes[begin + np.arange(len(begin))]


def _dealt_paths(rows: np.ndarray, codes: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each part: its members, and their paths one after the other."""
    part = ((rows["tok"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.cumsum(rows["size"], dtype=np.int64) - rows["size"]
    rows, part = rows[order], part[order]
    codes = _windows(codes, cut[order] - 1, rows["size"].astype(np.int64))
    first = np.flatnonzero(_new_runs(part))
    ends, sums = _ends(first, len(rows)), np.concatenate(([0], np.cumsum(rows["size"], dtype=np.int64)))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([codes[sums[a] : sums[b]].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())],
        names=["part", "rows", "codes"],
    )


class Tree:
    """A prefix tree over the paths of sets that post the same n-gram, one root for each n-gram (or part of its list).

    The sets are sorted by root and path, so that a node of depth d is a run of sets that share their first d n-grams.
    root, n, beyond (n-grams that a set may share after its path), label, size and prev (the n-gram before, or 0) go with
    the rows of codes, whose unused places hold END."""

    def __init__(self, root, n, beyond, label, size, prev, codes):
        key = np.empty((len(root), 8 + 4 * PATH), np.uint8)
        key[:, :8] = np.ascontiguousarray(root.astype(">u8")).view(np.uint8).reshape(-1, 8)
        key[:, 8:] = np.ascontiguousarray(codes.astype(">u4")).view(np.uint8).reshape(len(root), -1)
        self.order = np.argsort(key.view(f"S{8 + 4 * PATH}").ravel(), kind="stable")
        self.root, self.n, self.beyond, self.label, self.size, self.prev = (x[self.order] for x in (root, n.astype(np.int64), beyond.astype(np.int64), label, size.astype(np.int64), prev))
        self.codes = np.concatenate((codes[self.order], np.full((len(root), 1), END, np.uint32)), axis=1)
        same = self.codes[1:] == self.codes[:-1]
        self.shared = np.concatenate(([-1], np.where(self.root[1:] == self.root[:-1], np.where(same.all(axis=1), PATH + 1, same.argmin(axis=1)), -1)))[: len(root)]

    def pairs(self, percent: int, probes: Tree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(probes, sets) whose n-grams can reach the threshold, by the place of both in their trees.

        All probes walk the tree at once, a level at a time. A probe carries its overlap with the path of a node, which
        all sets below share, and leaves a subtree if what remains of the probe, or of the sets below, can't add up to the
        overlap that the smallest set below needs, or if all of them are in the probe's component already. Without probes
        the sets are joined with those after them."""
        own = probes is None
        q = self if own else probes
        held = q.codes != END
        row, column = np.nonzero(held)
        known = (row.astype(np.uint64) << np.uint64(32)) | q.codes[row, column]  # sorted
        start = np.concatenate(([0], np.cumsum(held.sum(axis=1))))
        last = np.where(q.size > 0, q.codes[np.arange(len(q.n)), np.maximum(q.size - 1, 0)].astype(np.int64), -1)
        top = np.flatnonzero(self.shared < 0)
        roots = self.root[top]
        at = np.minimum(np.searchsorted(roots, q.root), len(roots) - 1)
        walkers = np.flatnonzero(roots[at] == q.root) if len(roots) else np.empty(0, np.int64)
        at = at[walkers]
        work = np.cumsum((_ends(top, len(self.n)) - top)[at])
        a = 0
        while a < len(walkers):
            to = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + STEP_PAIRS, "right")))
            yield self._walk(q, own, percent, walkers[a:to], at[a:to], known, start, last)
            a = to

    def _walk(self, q: Tree, own: bool, percent: int, p: np.ndarray, at: np.ndarray, known: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pairs() for the probes p, which stand at the roots at; known has their n-grams, last the last of each."""
        out_p, out_m, node = [], [], np.flatnonzero(self.shared < 0)
        have, passed = np.ones(len(p), np.int64), np.zeros(len(p), np.int64)
        for depth in range(PATH + 1):
            if not len(p):
                break
            begin, end = node, _ends(node, len(self.n))
            node = np.flatnonzero(self.shared <= depth)
            stop = _ends(node, len(self.n))
            low, high = np.searchsorted(node, begin[at]), np.searchsorted(node, end[at])
            count = high - low
            p, have, passed = np.repeat(p, count), np.repeat(have, count), np.repeat(passed, count)
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(p))
            rest = self.size + self.beyond - depth
            least, most = np.minimum.reduceat(self.n, node), np.maximum.reduceat(rest, node)
            first, other = np.minimum.reduceat(self.label, node), np.maximum.reduceat(self.label, node)
            ok = (first[at] != q.label[p]) | (other[at] != q.label[p])
            if own:
                ok &= stop[at] > p + 1
            p, at, have, passed = p[ok], at[ok], have[ok], passed[ok]
            code = self.codes[node[at], depth].astype(np.int64)
            done = (code == END) | (code > last[p])
            # Paths that end here, on either side: what is left of both is all that can be shared beyond.
            e = np.flatnonzero(done)
            left = np.where(code[e] == END, q.size[p[e]] - passed[e], 0) + q.beyond[p[e]]
            count = stop[at[e]] - node[at[e]]
            m = np.repeat(node[at[e]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            x, most_left, so_far = np.repeat(p[e], count), np.repeat(left, count), np.repeat(have[e], count)
            nx, ny = q.n[x], self.n[m]
            good = ((q.prev[x] == 0) | (q.prev[x] != self.prev[m])) & (so_far + np.minimum(most_left, rest[m]) >= needed(nx, ny, percent)) & (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent) & (q.label[x] != self.label[m])
            if own:
                good &= m > x
            out_p.append(x[good])
            out_m.append(m[good])
            p, at, have, passed, code = p[~done], at[~done], have[~done], passed[~done], code[~done]
            key = (p.astype(np.uint64) << np.uint64(32)) | code.astype(np.uint64)
            i = np.searchsorted(known, key, "right")
            have = have + (known[np.maximum(i - 1, 0)] == key) if len(known) else have
            passed = i - start[p]
            ok = have + np.minimum(q.size[p] - passed + q.beyond[p], most[at] - 1) >= needed(q.n[p], least[at], percent)
            p, at, have, passed = p[ok], at[ok], have[ok], passed[ok]
        return np.concatenate(out_p) if out_p else p, np.concatenate(out_m) if out_m else p


def needed(nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams that sets of these sizes share at the threshold."""
    return -(-percent * (nx + ny) // (100 + percent))


def _matrix(size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.full((len(size), PATH), END, np.uint32)
    out[np.arange(PATH) < size[:, None]] = codes
    return out


def _pair_batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Each pair of set ids once."""
    x, y = x.view(np.int64), y.view(np.int64)
    a, b = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = _new_runs(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def _cold_pairs(paths: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b): the pairs of sets that meet below an n-gram which isn't frequent and can be at the threshold."""

    @trimmed
    def run(batches):
        found = [(np.frombuffer(r, MEMBER), np.frombuffer(c, np.uint32)) for b in batches for r, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if not found:
            return
        rows, codes = (np.concatenate(x) for x in zip(*found, strict=True))
        cut = np.cumsum(rows["size"], dtype=np.int64) - rows["size"]
        order = np.argsort(rows["tok"], kind="stable")
        rows, cut = rows[order], cut[order]
        first = np.flatnonzero(_new_runs(rows["tok"]))
        ends = _ends(first, len(rows))
        at = 0
        while at < len(first):  # whole lists, some thousand sets at a time
            to = max(at + 1, int(np.searchsorted(ends, first[at] + STEP_ROWS)))
            own = slice(first[at], ends[min(to, len(first)) - 1])
            r = rows[own]
            tree = Tree(r["tok"], r["n"], r["beyond"], r["sid"], r["size"], r["prev"], _matrix(r["size"], _windows(codes, cut[own] - 1, r["size"].astype(np.int64))))
            for x, y in tree.pairs(percent):
                yield _pair_batch(tree.label[x], tree.label[y])
            at = to

    cold = paths.where("part IS NOT NULL").select("part", "rows", "codes").repartition(parts, "part")
    return cold.mapInArrow(run, "a long, b long")


def _hub_pairs(hot: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set of a long list with two others of the list, the one that has most of the list's n-grams in common
    with others and one by hash. A guess that joins most copies; what it misses is found later."""
    hubs = hot.groupBy("tok").agg(F.max(F.struct("whole", "sid", "n")).alias("u"), F.min(F.struct(F.xxhash64("sid").alias("h"), "sid", "n")).alias("v"))
    hubs = hubs.select("tok", F.explode(F.array(F.struct("u.sid", "u.n"), F.struct("v.sid", "v.n"))).alias("hub"))
    both = hot.select("tok", "sid", "n").join(hubs, "tok").where(f"sid != hub.sid AND least(n, hub.n) * 100 >= greatest(n, hub.n) * {percent}")
    return both.select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b")).distinct()


def _mixed_lists(hot: DataFrame, labels: DataFrame, sigs: DataFrame) -> DataFrame:
    """Sets of the long lists that hold several components, with component, signature, and the blocks of their list.

    A list of more than CROSS sets is cut into blocks; only sets outside the list's largest component go to each block as
    probes, so rows grow with the list and not with its square while it has a large component."""
    rows = hot.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    counts = rows.groupBy("tok", "label").agg(F.count(F.lit(1)).alias("c"))
    lists = counts.groupBy("tok").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    lists = lists.select("tok", "most", F.ceil(F.col("all") / CROSS).alias("blocks"))
    rows = rows.join(lists, "tok").join(sigs, "sid")
    return staged(rows.select("tok", "sid", "prev", "n", "beyond", "size", "path", "label", "sig", "most", "blocks"), "join-mixed")


def _hot_pairs(mixed_lists: DataFrame, percent: int, parts: int, best: bool) -> DataFrame:
    """(a, b): pairs of sets of one long list, of different components, that can be at the threshold by their paths and
    signatures; with best only the likeliest partner of each probe in a block."""
    members = mixed_lists.select("*", F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("block"), F.lit(False).alias("probe"))
    probes = mixed_lists.where("label != most").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("probe"))
    rows = members.unionByName(probes).select("tok", "block", "probe", "sid", "prev", "n", "beyond", "size", "path", "label", "sig").repartition(parts, "tok", "block").sortWithinPartitions("tok", "block")

    def joined(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        root = np.cumsum(_new_runs(t.column("tok").to_numpy(), t.column("block").to_numpy())).astype(np.uint64)
        size = t.column("size").to_numpy()
        codes = _matrix(size, np.frombuffer(b"".join(t.column("path").to_pylist()), np.uint32))
        n, beyond, label, sid, prev = (t.column(c).to_numpy() for c in ("n", "beyond", "label", "sid", "prev"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(sid), -1)
        probe = t.column("probe").to_numpy()
        probes, sets = np.flatnonzero(probe), np.flatnonzero(~probe)
        x, y = (Tree(root[of], n[of], beyond[of], label[of], size[of], prev[of], codes[of]) for of in (probes, sets))
        for i, j in y.pairs(percent, x):
            i, j = probes[x.order][i], sets[y.order][j]
            apart = np.empty(len(i), np.int64)
            for a in range(0, len(i), 1 << 14):
                part = slice(a, a + (1 << 14))
                apart[part] = np.bitwise_count(sig[i[part]] ^ sig[j[part]]).sum(axis=1, dtype=np.int64)
            ok = n[i] + n[j] - apart >= 2 * needed(n[i], n[j], percent)
            i, j, apart = i[ok], j[ok], apart[ok]
            if best:
                order = np.lexsort((sid[j], apart, sid[i]))
                i, j = i[order], j[order]
                new = _new_runs(sid[i], root[i])
                i, j = i[new], j[new]
            yield sid[i], sid[j]

    @trimmed
    def run(batches):
        for t in _groups(batches, ["tok", "block"], STEP_ROWS):
            for x, y in joined(t):
                yield _pair_batch(x, y)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _groups(batches, keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, of about so many rows or one group."""
    held: list[pa.RecordBatch] = []

    def last(b):
        return [b.column(b.schema.get_field_index(k))[b.num_rows - 1].as_py() for k in keys]

    for b in batches:
        if not b.num_rows:
            continue
        if held and sum(x.num_rows for x in held) >= rows:
            now = last(held[-1])
            same = np.logical_and.reduce([b.column(b.schema.get_field_index(k)).to_numpy() == v for k, v in zip(keys, now, strict=True)])
            cut = int(same.sum())  # sorted: they come first
            if cut < b.num_rows:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held = [b.slice(cut)]
                continue
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def traverse(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of sets have a Jaccard similarity of at least percent / 100 with probe (all sorted).

    The sets are the paths of a prefix tree; the walk visits shared beginnings once, carries the overlap so far, and
    leaves a subtree when what remains of the probe, or of the largest set below, can't reach the overlap needed."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    n = len(probe)
    need = [-(-percent * (n + len(s)) // (100 + percent)) for s in sets]
    found = []
    todo = [(0, len(order), 0, 0)]  # sets lo..hi of the order share their first depth n-grams, of which the probe has so many
    while todo:
        lo, hi, depth, have = todo.pop()
        one, last = sets[order[lo]], sets[order[hi - 1]]
        # The shared beginning of a sorted run is that of its first and last.
        m = min(len(one), len(last))
        differ = np.flatnonzero(one[depth:m] != last[depth:m])
        to = depth + int(differ[0]) if len(differ) else m
        if to > depth:
            at = np.searchsorted(probe, one[depth:to])
            have += int((probe[np.minimum(at, n - 1)] == one[depth:to]).sum())
            left = n - int(np.searchsorted(probe, one[to - 1], "right"))
        else:
            left = n - (int(np.searchsorted(probe, one[depth - 1], "right")) if depth else 0)
        below = order[lo:hi]
        if all(have + min(left, len(sets[i]) - to) < need[i] for i in below):
            continue
        while lo < hi and len(sets[order[lo]]) == to:  # paths that end here
            if have >= need[order[lo]]:
                found.append(order[lo])
            lo += 1
        while lo < hi:  # one subtree for each next n-gram
            x = sets[order[lo]][to]
            a, b = lo, hi
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if sets[order[mid]][to] == x else (a, mid)
            todo.append((lo, b, to, have))
            lo = b
    return sorted(found)


def _grams(docs: DataFrame, key: str, text: str, firsts: DataFrame, sids: DataFrame, k: int) -> DataFrame:
    """(sid, grams) of the sets with the given ids, made again from the first document of each class.

    A bit table of fixed size tells which documents those are; a document that shares its bit is made for nothing."""
    wanted = sids.toDF("sid").distinct().join(firsts, "sid")
    bits = _bits(wanted.select(F.col("sid").bitwiseXOR(F.crc32(F.coalesce(F.col("first").cast("string"), F.lit("")).cast("binary"))).alias("mark")), "mark")
    source = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("t"))

    @trimmed
    def make(batches):
        for part, sets in _sets(batches, 1, k):
            own = list(sets)
            sids = np.array([set_id(s) for s in own], np.uint64)
            marks = sids ^ np.array([zlib.crc32((x or "").encode()) for x in part.column(0).to_pylist()], np.uint64)
            at = np.flatnonzero(_has(bits, marks)) if len(own) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sids[at].view(np.int64)), pa.array([own[i].tobytes() for i in at], pa.binary())], names=["sid", "grams"])

    return staged(source.mapInArrow(make, "sid long, grams binary").dropDuplicates(["sid"]), "join-grams")


def _verified(made: DataFrame, pairs: DataFrame, percent: int, parts: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are at the threshold; a set with many partners gets a tree for each BLOCK of them."""
    pairs = staged(pairs, "join-pairs")
    if not pairs.limit(1).count():
        return pairs
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pairs = staged(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).alias("block")), "join-blocks")
    left = pairs.select("a", "block").distinct().join(made.withColumnRenamed("sid", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "grams")
    right = pairs.join(made.withColumnRenamed("sid", "b"), "b").select("a", "block", "b", "grams")

    @trimmed
    def walk(batches):
        group, probe, names, sets = None, None, [], []

        def done():
            hit = traverse(probe, sets, percent) if probe is not None and sets else []
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(hit), pa.int64()), pa.array([names[i] for i in hit], pa.int64())], names=["a", "b"])

        for b in batches:
            for a, block, other, grams in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (a, block) != group:
                    if group is not None:
                        yield done()
                    group, probe, names, sets = (a, block), None, [], []
                s = np.frombuffer(grams, np.uint64)
                if other is None:
                    probe = s
                else:
                    names.append(other)
                    sets.append(s)
        if group is not None:
            yield done()

    both = left.unionByName(right).repartition(parts, "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return staged(both.mapInArrow(walk, "a long, b long"), "join-verified")


def _labelled(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(key, mark, n, component, component_id) of each row of docs; component is null for texts without words."""
    spark, before = docs.sparkSession, written()
    parts = parts_of(docs, text)
    rows, frequent = classes_of(docs, key, text, k, percent, parts)
    firsts = staged(rows.where("n > 0").groupBy("sid").agg(F.min("key").alias("first")), "join-firsts")
    paths = _paths(_postings(docs, text, k, percent, parts, frequent), percent, parts, frequent)
    hot = paths.where("tok IS NOT NULL").drop("part", "rows", "codes")
    pairs = staged(_cold_pairs(paths, percent, parts).union(_hub_pairs(hot, percent)).distinct(), "join-pairs")
    grams = _grams(docs, key, text, firsts, pairs.select("a").union(pairs.select("b")), k)
    tested, links = pairs, _verified(grams, pairs, percent, parts)
    labels = components(links)
    sigs = rows.where("n > 0").select("sid", "sig").dropDuplicates(["sid"])
    for best in (True, False):  # the likeliest partners first: what they join needs no comparison any more
        lists = _mixed_lists(hot, labels, sigs)
        pairs = staged(_hot_pairs(lists, percent, parts, best).join(tested, ["a", "b"], "left_anti"), "join-pairs")
        if not pairs.limit(1).count():
            continue
        new = pairs.select("a").union(pairs.select("b")).distinct().join(grams.select(F.col("sid").alias("a")), "a", "left_anti")
        if new.limit(1).count():
            grams = grams.unionByName(_grams(docs, key, text, firsts, new, k))
        tested = tested.unionByName(pairs)
        links = links.unionByName(_verified(grams, pairs, percent, parts))
        labels = components(links)
    named = labels.join(firsts.withColumnRenamed("sid", "node"), "node")
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    least = named.join(least, "label").select(F.col("node").alias("sid"), "label", "least")
    of = firsts.join(least, "sid", "left").select("sid", F.coalesce("label", "sid").alias("component"), F.coalesce("least", "first").alias("component_id"))
    # A class of very many copies is one key of this join alone, which Spark can split.
    of = staged(of, "join-of")
    forget(spark, before, ("join-sets", "join-of"))  # all that the result reads
    some = rows.where("n > 0").join(of, "sid").select("key", "mark", "n", "component", "component_id")
    none = rows.where("n = 0").select("key", "mark", "n", F.lit(None).cast("long").alias("component"), F.col("key").alias("component_id"))
    return some.unionByName(none)


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of each row of docs: the size of its set, and the smallest key that links reach.

    Two rows link when 100 * shared >= percent * all of their sets of k-word shingles (A-Z in lower case); a text of
    fewer words has one shingle of all of them. Null and empty texts have no shingles and are their own component.
    Repeated rows and equal texts are one class; a null key is no component's smallest while there is another; an
    empty table gives an empty result. Other columns are left out. Sets are told apart by 64-bit hashes."""
    return _labelled(docs, key, text, k, percent).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies: that of the smallest key, and of its texts that with the smallest hash if a
    key is repeated; rows and columns as they are.

    Texts without words have no copies. Of rows that repeat both key and text one stays. A null key comes after all
    others, so a group keeps a row without a key only if none of its rows has one."""
    rows = _labelled(docs, key, text, k, percent)
    # Keys and hashes before the groups: a group of very many copies is one row of each task.
    best = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "mark")).alias("best")).select("best.key", "best.mark")
    best = staged(best.union(rows.where("component IS NULL").select("key", "mark")).distinct().toDF("__key__", "__mark__"), "join-kept")
    given = docs.withColumn("__same__", F.xxhash64(text))
    kept = given.join(best, F.col(key).eqNullSafe(F.col("__key__")) & (F.col("__same__") == F.col("__mark__")), "left_semi")
    return kept.dropDuplicates([key, "__same__"]).drop("__same__")


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.o)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.o GROUP BY 1) c ON c.r = d.r
"""
