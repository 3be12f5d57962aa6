"""Names within a few edits: a universal Levenshtein automaton with transpositions walks tries of names.

The automaton doesn't depend on any word: what it reads is which of the letters around a place of one name equal the next
letter of the other, and its states are sets of (shift, edits, inside an exchange). It is made once, as a table. The trie of
distinct names is dealt in shards: a name of length L is cut in k + 1 pieces and stands in the shards of its pieces, each
shard a trie. Of k edits each spoils one piece at most (an exchange across two pieces spoils none, it changes their ends),
so a name within k edits is in a shard of a piece that the other name holds, shifted or with ends exchanged. Each name of
the other table walks the tries of the pieces that it can have, all walks of a task side by side as numpy columns.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: Names of a shard that one task's trie holds, and names that walk it there; larger shards are cut into blocks.
BLOCK = 4096

#: Rows of a bucket of shards, both sides together, about.
BUCKET_ROWS = 1 << 15

#: Names that walk at once.
WALKERS = 2048

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.cache
def automaton(k: int) -> tuple[np.ndarray, np.ndarray]:
    """(next, ends): next[state << (2k+1) | letters] is a state, the last one dead; ends[state, d + k] the edits (k + 1: more
    than k) with d = the letters that the walking name still has after as many as the trie's name has.

    Bit b of letters: the walking name's letter k - b places before the place read equals the letter read."""
    width = 2 * k + 1
    start = frozenset({(0, 0, False)})
    place, todo, rows = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        row = []
        for letters in range(1 << width):
            equal = lambda d: bool(letters >> (d + k) & 1)  # noqa: E731, B023
            least: dict[tuple[int, bool], int] = {}

            def put(shift: int, edits: int, inside: bool) -> None:
                if edits <= k and abs(shift) <= k:
                    least[shift, inside] = min(edits, least.get((shift, inside), k + 1))  # noqa: B023

            for o, e, inside in state:
                if inside:  # the letter before the one read was that of the next place; now that of this one is due
                    if equal(o):
                        put(o + 1, e, False)
                    continue
                put(o - 1, e + 1, False)  # the letter read is one too many
                put(o, e + 1, False)  # it stands for another
                for skipped in range(k - e + 1):
                    if abs(o + skipped) <= k and equal(o + skipped):
                        put(o + skipped, e + skipped, False)
                if e < k and abs(o + 1) <= k and equal(o + 1):
                    put(o - 1, e + 1, True)
            after = frozenset((o, e, i) for (o, i), e in least.items())
            if after and after not in place:
                place[after] = len(place)
                todo.append(after)
            row.append(place[after] if after else -1)
        rows.append(row)
    n = len(place)
    step = np.array([*rows, [-1] * (1 << width)], np.int32)
    step[step < 0] = n
    ends = np.full((n + 1, width), k + 1, np.int8)
    for state, i in place.items():
        for o, e, inside in state:
            for d in range(-k, k + 1):
                if not inside and d - o >= 0:
                    ends[i, d + k] = min(ends[i, d + k], e + d - o)
    return step.reshape(-1), np.minimum(ends, k + 1)


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, plus one, of all names in a row, and their counts."""
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    return flat, np.fromiter(map(len, names), np.int64, len(names))


class Forest:
    """Tries of names by shard, one level after another; a level is made when a walk first reaches it."""

    def __init__(self, shards: np.ndarray, names: list[str]):
        """shards: numbers from 0, of names, in order; of a shard the names in order and distinct."""
        self.flat, self.sizes = _letters(names)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.rows = np.arange(len(names))
        self.node = shards
        self.wide = int(shards[-1]) + 1 if len(shards) else 0
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def level(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of depth d + 1: the first child of each node of depth d (and the end), the nodes' letters, the names that end there or -1."""
        while len(self.made) <= d:
            at = len(self.made)
            go = self.sizes[self.rows] > at
            rows, parent = self.rows[go], self.node[go]
            letter = self.flat[self.offsets[rows] + at]
            new = np.ones(len(rows), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            node = np.cumsum(new) - 1
            first = np.searchsorted(parent[new], np.arange(self.wide + 1))
            name = np.full(int(new.sum()), -1, np.int64)
            over = self.sizes[rows] == at + 1
            name[node[over]] = rows[over]
            self.made.append((first, letter[new], name))
            self.rows, self.node, self.wide = rows, node, len(name)
        return self.made[d]


def walked(forest: Forest, roots: np.ndarray, names: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(walking names, names of the forest, edits) of at most k edits; roots: the tries that the names walk."""
    step, ends = automaton(k)
    dead = len(ends) - 1
    flat, sizes = _letters(names)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    padded = np.zeros(len(flat) + len(names) + 1, np.int64)  # a 0 after each name
    padded[np.arange(len(flat)) + np.repeat(np.arange(len(names)), sizes)] = flat
    for lo in range(0, len(names), WALKERS):
        who = np.arange(lo, min(lo + WALKERS, len(names)))
        node, state, d = roots[who], np.zeros(len(who), np.int64), 0
        while len(who):
            first, letter, name = forest.level(d)
            many = first[node + 1] - first[node]
            child = np.repeat(first[node] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            who, state = np.repeat(who, many), np.repeat(state, many)
            read = letter[child]
            bits = np.zeros(len(who), np.int64)
            for b in range(2 * k + 1):
                at = d + b - k
                if at >= 0:
                    bits |= (padded[offsets[who] + np.minimum(at, sizes[who])] == read).astype(np.int64) << b
            state = step[state << (2 * k + 1) | bits].astype(np.int64)
            d += 1
            live = (state != dead) & (sizes[who] - d >= -k)
            who, node, state = who[live], child[live], state[live]
            left = sizes[who] - d
            over = np.flatnonzero((name[node] >= 0) & (left <= k))
            edits = ends[state[over], left[over] + k]
            yes = edits <= k
            if yes.any():
                yield who[over[yes]], name[node[over[yes]]], edits[yes]


def alignment(a: str, b: str, k: int) -> int:
    """Edits between two names by optimal string alignment, in a band of k beside the diagonal; k + 1 if there are more."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    far = k + 1
    before, last = [far] * (len(b) + 1), [min(j, far) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if i <= k:
            row[0] = i
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[j - 2] + 1)
            row[j] = min(best, far)
        before, last = last, row
    return last[-1]


def _hash(length: Column, piece: int, text: Column) -> Column:
    return F.xxhash64(length, F.lit(piece), text)


def _cut(length: Column, i: int, k: int) -> Column:
    return F.floor(length * i / (k + 1)).cast("int")


def own_shards(name: Column, k: int) -> Column:
    """The shards of a name: one for each of its k + 1 pieces."""
    n = F.length(name)
    return F.array_distinct(F.array(*[_hash(n, i, F.substring(name, _cut(n, i, k) + 1, _cut(n, i + 1, k) - _cut(n, i, k))) for i in range(k + 1)]))


def reached_shards(name: Column, k: int) -> Column:
    """The shards that can hold a name within k edits of this one.

    For each length, piece and shift of it: the letters there, and those with the first or last one exchanged with its
    neighbour beyond the piece, as far as shifts and exchanges stay within k edits."""
    size = F.length(name)
    found = []
    at = lambda start, n: F.substring(name, start + 1, n)
    for more in range(-k, k + 1):  # letters that this name has more
        length = size - more
        for i in range(k + 1):
            p, n = _cut(length, i, k), _cut(length, i + 1, k) - _cut(length, i, k)
            for shift in [0] if i == 0 else [more] if i == k else range(-k, k + 1):
                q, edits = p + shift, abs(shift) + abs(more - shift)
                inside = (length > 0) & (q >= 0) & (q + n <= size)
                if edits <= k:
                    found.append(F.when(inside, _hash(length, i, at(q, n))))
                if edits + 1 <= k and i > 0:
                    found.append(F.when(inside & (n >= 1) & (q >= 1), _hash(length, i, F.concat(at(q - 1, 1), at(q + 1, n - 1)))))
                if edits + 1 <= k and i < k:
                    found.append(F.when(inside & (n >= 1) & (q + n < size), _hash(length, i, F.concat(at(q, n - 1), at(q + n, 1)))))
                if edits + 2 <= k and 0 < i < k:
                    found.append(F.when(inside & (n >= 2) & (q >= 1) & (q + n < size), _hash(length, i, F.concat(at(q - 1, 1), at(q + 1, n - 2), at(q + n, 1)))))
    return F.array_distinct(F.array_compact(F.array(*found)))


def pairs(left: DataFrame, right: DataFrame, k: int = 2, block: int = BLOCK) -> DataFrame:
    """(l, r, distance) of all distinct names, left.name and right.name, that at most k edits turn into one another.

    Edits are insertions, deletions and substitutions of a code point and exchanges of two adjacent ones, no part edited
    twice. The walk finds the pairs, and each is verified by its own alignment. Null and empty names have none; repeated
    names give one pair; empty tables none; long names cost by their length only while a walk is alive. A shard that
    many names share is cut into blocks of `block` names on both sides, each block of one side against each of the other in
    tasks of their own, so that no task holds a whole hot shard; nothing is broadcast or collected but the number of rows."""
    here = left.select("name").where("length(name) > 0").distinct()
    there = right.select("name").where("length(name) > 0").distinct()
    a = here.select(F.col("name").alias("l"), F.explode(reached_shards(F.col("name"), k)).alias("shard"))
    b = there.select(F.col("name").alias("r"), F.explode(own_shards(F.col("name"), k)).alias("shard"))
    cells = a.groupBy("shard").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("shard").agg(F.count(F.lit(1)).alias("nb")).hint("merge"), "shard")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    cells = staged(cells.select("shard", blocks("na").alias("ca"), blocks("nb").alias("cb"), (F.col("na") * blocks("nb") + F.col("nb") * blocks("na")).alias("rows")), "names-shards")
    rows = cells.agg(F.sum("rows")).first()[0] or 0
    buckets = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))

    def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(name), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("with")
        side = side.join(cells.hint("merge"), "shard").select("shard", name, part.alias("part"), each)
        i, j = ("part", "with") if own == "ca" else ("with", "part")
        cell = F.xxhash64("shard", i, j)
        return side.select(F.pmod(cell, F.lit(buckets)).alias("bucket"), cell.alias("cell"), name)

    def meet(walkers: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if walkers.num_rows and held.num_rows:
            rows = sorted(zip(held.column("cell").to_pylist(), held.column("r").to_pylist(), strict=True))
            cells_of, roots = np.unique(np.array([c for c, _ in rows], np.int64), return_inverse=True)
            names = [n for _, n in rows]
            forest = Forest(roots, names)
            own = walkers.column("cell").to_numpy()
            to = np.minimum(np.searchsorted(cells_of, own), len(cells_of) - 1)
            ok = cells_of[to] == own
            walking = [n for n, x in zip(walkers.column("l").to_pylist(), ok.tolist(), strict=True) if x]
            seen = set()
            for i, j, _ in walked(forest, to[ok], walking, k):
                for pair in zip((walking[x] for x in i.tolist()), (names[x] for x in j.tolist()), strict=True):
                    if pair not in seen and (d := alignment(*pair, k)) <= k:
                        seen.add(pair)
                        for column, value in zip(out, (*pair, d), strict=True):
                            column.append(value)
        return pa.table({"l": pa.array(out[0], pa.string()), "r": pa.array(out[1], pa.string()), "distance": pa.array(out[2], pa.int32())})

    x = dealt(a, "l", "ca", "cb").groupBy("bucket").cogroup(dealt(b, "r", "cb", "ca").groupBy("bucket"))
    return x.applyInArrow(meet, "l string, r string, distance int").distinct()


def folded(name: Column) -> Column:
    return F.translate(name, UPPER, LOWER)


def misspelt(name: Column, vendor_id: Column) -> Column:
    """The name with two adjacent code points exchanged, as crc32 of the id says; as it is where that is odd or null."""
    h, size = F.crc32(vendor_id.cast("string").cast("binary")), F.length(name)
    at = (F.pmod(h, size - 1) + 1).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.lit(1)), F.substring(name, at, F.lit(1)), F.substring(name, at + 2, size))
    return F.when((size >= 2) & (F.pmod(h, F.lit(2)) == 0), swapped).otherwise(name)


def name_join(clients: DataFrame, vendors: DataFrame, k: int = 2, block: int = BLOCK) -> DataFrame:
    """vendor_id, distance, n_clients, first_client_id, clients_crc: vendors (vendor_id, name) by clients (client_id, name)
    of names within k edits, one row for each vendor and exact distance that has one.

    Names are compared as given. Null and empty ones take no part; every client row counts, also one that repeats; vendor rows
    that repeat count once, and of a vendor of several names each name's clients count; a null client_id counts but has
    neither place nor crc; a null vendor_id is a vendor of its own; empty tables give an empty result. Other columns
    are left out."""
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    people = staged(clients.where("length(name) > 0").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("client_id").alias("first"), F.sum(crc).alias("crc")), "names-clients")
    firms = vendors.select("vendor_id", "name").where("length(name) > 0").distinct()
    near = pairs(firms, people, k, block)
    sums = [F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.coalesce("crc", F.lit(0))).alias("crc")]
    by_name = near.join(people.withColumnRenamed("name", "r").hint("merge"), "r").groupBy("l", "distance").agg(*sums)
    found = firms.withColumnRenamed("name", "l").hint("merge").join(by_name.hint("merge"), "l")
    return found.groupBy("vendor_id", "distance").agg(*sums).select("vendor_id", "distance", F.col("n").alias("n_clients"), F.col("first").alias("first_client_id"), F.col("crc").alias("clients_crc"))


def op13_edit_distance_name_join(spark, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "clients").select("client_id", folded(F.col("name")).alias("name"))
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", folded(misspelt(F.col("name"), F.col("vendor_id"))).alias("name"))
    return name_join(clients, vendors)
