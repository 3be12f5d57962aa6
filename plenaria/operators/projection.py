"""Pairs of members by the groups that both are in, counted in few bytes a meeting of two.

Members have dense numbers in order of their names. A group is a list of sorted numbers; tasks make its pairs CHUNK at a time and
send them by the smaller member, sorted and as differences. Where they meet, pairs are counted as they come, so a
task holds the distinct pairs of a part, whatever the size of a group or the number of groups of a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .algorithms import stored

#: Pairs that a task makes at a time, and pairs for which a row of a large group is repeated, about.
CHUNK, SHARE = 1 << 22, 1 << 26


def numbered(names: DataFrame, name: str) -> DataFrame:
    """(name, n): distinct names with dense numbers from 0 on, in their order."""
    parts = names.where(F.col(name).isNotNull()).distinct().repartitionByRange(name).sortWithinPartitions(name)
    found = stored(parts.select(name, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "names")
    sizes = dict(found.groupBy("p").count().collect())  # a number for each partition
    if sum(sizes.values()) >= 1 << 31:
        raise ValueError("2^31 members or more")
    starts = F.array(*[F.lit(sum(n for q, n in sizes.items() if q < p)).cast("long") for p in range(max(sizes, default=0) + 1)])
    return found.select(name, (F.get(starts, F.col("p")) + F.col("i")).cast("int").alias("n"))


def _pairs(sizes: np.ndarray, members: np.ndarray, lo: int = 0, hi: int | None = None) -> Iterator[np.ndarray]:
    """Keys (smaller << 32 | larger) of the pairs in groups of sorted members, in runs of CHUNK about; lo and hi bound the place of the smaller."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(members))[lo:hi]
    later = ends[lo:hi] - at - 1  # members of the group behind each
    total = np.concatenate(([0], np.cumsum(later)))
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, "right")) - 1)
        n = later[a:b]
        # Of one member the larger ones stand in a row.
        others = np.arange(total[b] - total[a]) - np.repeat(total[a:b] - total[a], n) + np.repeat(at[a:b] + 1, n)
        yield np.repeat(members[at[a:b]].astype(np.uint64) << np.uint64(32), n) | members[others]
        a = b


def _planes(values: np.ndarray) -> bytes:
    """Numbers as one run for each of their bytes, which the shuffle's compression makes small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _packed(keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys as smaller members, how many pairs each has, and larger members, all but the counts as differences."""
    a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    gaps = np.diff(b, prepend=0)
    gaps[first] = b[first]
    return _planes(np.diff(a[first], prepend=0)), _planes(np.diff(np.append(first, len(a)))), _planes(gaps)


def _unpacked(members: bytes, counts: bytes, others: bytes) -> np.ndarray:
    a, n, gaps = (np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64) for x in (members, counts, others))
    run = np.cumsum(gaps)
    first = np.cumsum(n) - n
    b = run - np.repeat(run[first] - gaps[first], n)
    return np.repeat(np.cumsum(a), n).astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _part(a: np.ndarray, parts: int) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (mixed * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def lists(on: DataFrame, block: int) -> DataFrame:
    """(pairs, sizes, members, lo, hi): the members of groups, about block of them in a row; on is (group long, a int) with equal groups
    in one partition and side by side, a in order. A larger group is a row of its own.

    A group of more than SHARE pairs has several rows, which bound the place of the smaller member."""

    def run(batches):
        held, rest = [], (np.empty(0, np.int64), np.empty(0, np.uint32))

        def rows(group, a, last):
            """Rows of the groups that are whole, and what is left."""
            out = []
            if len(group):
                once = np.concatenate(([True], (group[1:] != group[:-1]) | (a[1:] != a[:-1])))
                group, a = group[once], a[once]
            new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
            stop = len(group) if last or not len(new) else int(new[-1])
            new = new[new < stop]
            sizes = np.diff(np.append(new, stop))
            at = 0
            while at < len(sizes):
                total = np.cumsum(sizes[at:])
                to = at + max(1, int(np.searchsorted(total, block, "right")))
                own = a[new[at] : new[at] + total[to - at - 1]]
                n = sizes[at:to].astype(np.int64)
                pairs = int((n * (n - 1) // 2).sum())
                if pairs:
                    step = max(1, -(-len(own) * SHARE // pairs)) if to == at + 1 and pairs > SHARE else len(own)
                    for lo in range(0, len(own), step):
                        out.append((pairs if step == len(own) else -(-pairs * step // len(own)), n.astype("<u4").tobytes(), own.astype("<u4").tobytes(), lo, min(lo + step, len(own))))
                at = to
            return out, (group[stop:], a[stop:])

        size = 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)))
            size += b.num_rows
            if size >= block:
                out, rest = rows(*(np.concatenate(x) for x in zip(rest, *held, strict=True)), False)
                # A group that goes on is put together again only when it has doubled.
                held, size = [], min(0, block - len(rest[0]))
                yield batch(out)
        out, _ = rows(*(np.concatenate(x) for x in zip(rest, *held, strict=True)), True)
        yield batch(out)

    def batch(out):
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["pairs", "sizes", "members", "lo", "hi"])

    return on.mapInArrow(run, "pairs long, sizes binary, members binary, lo long, hi long")


def counted(grouped: DataFrame, part: int) -> DataFrame:
    """(a, b, weight): pairs a < b of members by the groups that hold both, dealt to parts of part meetings about; grouped is of
    lists() and stored, as it is read twice."""
    total = grouped.agg(F.sum("pairs")).first()[0] or 0
    parts = max(grouped.sparkSession.sparkContext.defaultParallelism, -(-total // part))

    def made(batches):
        """Keys of about CHUNK pairs at a time, from as many rows as they take."""
        held, size = [], 0
        for b in batches:
            for sizes, members, lo, hi in zip(*(b.column(c).to_pylist() for c in ("sizes", "members", "lo", "hi")), strict=True):
                for keys in _pairs(np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(members, "<u4"), lo, hi):
                    held.append(keys)
                    size += len(keys)
                    if size >= CHUNK:
                        yield np.concatenate(held)
                        held, size = [], 0
        if size:
            yield np.concatenate(held)

    def dealt(batches):
        for keys in made(batches):
            keys = np.sort(keys)
            to = _part(keys >> np.uint64(32), parts)
            order = np.argsort(to, kind="stable")
            keys, to = keys[order], to[order]
            first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            cols = zip(*(_packed(keys[s:e]) for s, e in zip(first, np.append(first[1:], len(keys)), strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), *(pa.array(list(c), pa.binary()) for c in cols)], names=["part", "members", "counts", "others"])

    def met(batches):
        keys, counts, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("members", "counts", "others")), strict=True):
                held.append(_unpacked(*row))
                size += len(held[-1])
                if size >= max(CHUNK, len(keys)):
                    own = np.concatenate(held)
                    keys, counts = _summed(np.concatenate((keys, own)), np.concatenate((counts, np.ones(len(own), np.int64))))
                    held, size = [], 0
        if held:
            own = np.concatenate(held)
            keys, counts = _summed(np.concatenate((keys, own)), np.concatenate((counts, np.ones(len(own), np.int64))))
        for at in range(0, len(keys), 1 << 16):
            k = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(32)).astype(np.int32)), pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(counts[at : at + (1 << 16)])], names=["a", "b", "weight"])

    dealt_rows = grouped.mapInArrow(dealt, "part int, members binary, counts binary, others binary").repartition(parts, "part")
    return dealt_rows.mapInArrow(met, "a int, b int, weight long")
