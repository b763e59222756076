"""Covering locality-sensitive hashing over bit vectors: which rows lie within a reach of each other, as a forest.

A row has one or more 64-bit words. A table closes some bit positions of one word; rows that agree on them share a
bucket and are compared. ``masks`` gives the tables that no pair within a radius escapes: for radius r every position
gets a non-zero vector of r + 1 bits, position after position in turn; every non-zero vector v of r + 1 bits gives the
mask of the positions whose vector has an odd product with v. Whatever r positions two words differ in, some v is
orthogonal to their vectors, so its mask covers none of them. ``wide_masks`` first cuts the positions into two parts,
one of which holds at most half the differences.

Shuffled are packed arrays: a map task sorts the entries (table, words) of a chunk of rows by the slot of their bucket
and sends each slot one blob, 2 bytes a table and 8 bytes a word. A bucket leaves its task as a minimum spanning forest
of its pairs within the reach, never as all its pairs, and without the edges that an earlier table has: those rows met
there and are connected there. So what is emitted grows with the rows, however large a group is.

A bucket of more than ``LIMIT`` rows that holds over a ``SHARE``-th part of some chunk is found before the dealing, by
counting, so that no task gets a bucket that grows with such a share of the input. Its rows are dealt by tables that
close further positions of the same word instead, level by level, and the guarantee holds at each level. Where edges are
candidates that are confirmed later (``whole``), all its rows are linked to the bucket itself instead: no pair is lost.
There a bucket must also hold over ``CROWD`` times the rows of an even one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks

BITS = 64
ALL = (1 << BITS) - 1
#: Rows of a bucket from which it is split, and the part of a chunk that shows it.
LIMIT, SHARE, CROWD = 1 << 15, 8192, 8
#: Rows that are dealt at a time, rows that are counted at a time, and entries of a task that compares.
DEALT, COUNTED, TASK = 1 << 12, 1 << 16, 1 << 19
#: Edges that a task contracts.
EDGES = 1 << 20
#: Buckets up to this size are compared all at once, offset by offset.
SMALL = 8


def masks(open_: int, radius: int) -> list[int]:
    """The covering masks over the positions set in ``open_``."""
    places = [k for k in range(BITS) if open_ >> k & 1]
    size = 1 << (radius + 1)
    vector = {p: 1 + i % (size - 1) for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (vector[p] & v).bit_count() % 2) for v in range(1, size)]


def wide_masks(open_: int, radius: int) -> list[int]:
    """Masks over the positions set in ``open_``: some mask covers none of any ``radius`` positions."""
    places = [k for k in range(BITS) if open_ >> k & 1]
    sides = [sum(1 << p for p in places[k::2]) for k in (0, 1)]
    return sorted({m for side in sides if side for m in masks(side, radius // 2) if m})


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of 64-bit words."""
    x = x ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & ALL)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_id(words: Sequence[np.ndarray]) -> np.ndarray:
    """A row's id: its word if it has one, a hash of its words otherwise."""
    if len(words) == 1:
        return words[0].view(np.int64)
    out = np.zeros(len(words[0]), np.uint64)
    for k, w in enumerate(words):
        out = mixed(out ^ w, k)
    return out.view(np.int64)


class Tables:
    """Each table's word and closed positions; the tables that replace it for split buckets; the split buckets."""

    def __init__(self, words: int, make: Callable[[int, int], list[int]], radius: int, whole: bool = False) -> None:
        self.make, self.radius, self.whole = make, radius, whole
        self.word: list[int] = []
        self.closed: list[int] = []
        self.children: dict[int, list[int]] = {}
        self.hot = np.zeros(0, np.uint64)
        self.roots = [t for w in range(words) for t in self._add(w, 0)]

    def _add(self, word: int, closed: int) -> list[int]:
        new = [closed | m for m in self.make(ALL & ~closed, self.radius) if m]
        self.word += [word] * len(new)
        self.closed += new
        return list(range(len(self.closed) - len(new), len(self.closed)))

    def split(self, found: list[tuple[int, int]]) -> list[int]:
        """Split these buckets (table, hash); returns the tables that are new."""
        new: list[int] = []
        for t in sorted({t for t, _ in found}):
            if t not in self.children:
                self.children[t] = [] if self.whole else self._add(self.word[t], self.closed[t])
                new += self.children[t]
        self.hot = np.unique(np.r_[self.hot, np.array([h & ALL for t, h in found if self.children[t] or self.whole], np.uint64)])
        return new

    def key(self, t: int, words: Sequence[np.ndarray]) -> np.ndarray:
        return mixed(words[self.word[t]] & np.uint64(self.closed[t]), t)

    def is_hot(self, key: np.ndarray) -> np.ndarray:
        return self.hot[np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)] == key if len(self.hot) else np.zeros(len(key), bool)

    def spread(self, words: Sequence[np.ndarray]) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
        """(table, places of rows or None for all, bucket hashes) of every bucket that isn't split."""
        todo: list[tuple[int, np.ndarray | None]] = [(t, None) for t in self.roots]
        while todo:
            t, rows = todo.pop()
            key = self.key(t, words if rows is None else [w[rows] for w in words])
            if t in self.children and (warm := self.is_hot(key)).any():
                own = np.arange(len(key)) if rows is None else rows
                todo += [(c, own[warm]) for c in self.children[t]]
                rows, key = own[~warm], key[~warm]
            if len(key):
                yield t, rows, key


def _words(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """The columns, ``size`` rows at a time."""
    kept: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        own = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).view(np.uint64) for c in batch.columns]
        while len(own[0]):
            take = min(size - count, len(own[0]))
            kept.append([c[:take] for c in own])
            own, count = [c[take:] for c in own], count + take
            if count == size:
                yield [np.concatenate(x) for x in zip(*kept, strict=True)]
                kept, count = [], 0
    if count:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _count(tables: Tables, fresh: frozenset[int], share: int):  # noqa: ANN202
    """(table, bucket, rows) of the buckets that hold over a ``share``-th part of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches, COUNTED):
            least = max(2, len(words[0]) // share)
            for t, _, key in tables.spread(words):
                if t in fresh:
                    found, n = np.unique(key, return_counts=True)
                    some = n >= least
                    if some.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), t, np.int32)), pa.array(found[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["t", "h", "n"])

    return run


def _star(tables: Tables):  # noqa: ANN202
    """Edges from the rows of split buckets to their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches, DEALT):
            ids = row_id(words)
            for t in tables.children:
                key = tables.key(t, words)
                warm = tables.is_hot(key)
                bucket = key[warm].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[warm], bucket)), pa.array(np.maximum(ids[warm], bucket))], names=["a", "b"])

    return run


def _deal(tables: Tables, slots: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches, DEALT):
            everyone = np.arange(len(words[0]), dtype=np.int32)
            parts = [(t, everyone if rows is None else rows.astype(np.int32), (key % np.uint64(slots)).astype(np.int32)) for t, rows, key in tables.spread(words)]
            table = np.concatenate([np.full(len(r), t, np.uint32) for t, r, _ in parts])
            rows, slot = np.concatenate([r for _, r, _ in parts]), np.concatenate([s for _, _, s in parts])
            order = np.argsort(slot, kind="stable")
            table, rows = table[order], rows[order]
            count = np.bincount(slot, minlength=slots)
            full = np.flatnonzero(count)
            ends = np.r_[0, np.cumsum(count[full])]
            columns = [pa.array(full.astype(np.int32))]
            for column in (table, *(w[rows] for w in words)):
                offsets = (ends * column.itemsize).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(column))]))
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "tables", *(f"w{k}" for k in range(len(words)))])

    return run


def distances(words: Sequence[np.ndarray], a: np.ndarray | slice | int, b: np.ndarray | slice | int) -> np.ndarray:
    """Differing bits of rows a and b, over all words."""
    out = np.bitwise_count(words[0][a] ^ words[0][b]).astype(np.int16)
    for w in words[1:]:
        out += np.bitwise_count(w[a] ^ w[b])
    return out


def forest(words: Sequence[np.ndarray], reach: int) -> list[tuple[int, int]]:
    """A minimum spanning forest of the pairs within the reach, as positions."""
    n = len(words[0])
    some = np.zeros(n, bool)
    for first in range(0, n, 256):  # rows with a neighbour at all
        apart = np.zeros((min(256, n - first), n), np.int16)
        for w in words:
            apart += np.bitwise_count(w[first : first + 256, None] ^ w[None])
        some[first : first + 256] = (apart <= reach).sum(1) > 1
    left = np.flatnonzero(some)
    if not len(left):
        return []
    own = [w[left] for w in words]
    best, source, free = np.full(len(left), 1 << 14, np.int16), np.zeros(len(left), np.int64), np.ones(len(left), bool)
    out: list[tuple[int, int]] = []
    at = 0
    for _ in range(len(left)):
        free[at] = False
        step = distances(own, slice(None), at)
        nearer = step < best
        best[nearer], source[nearer] = step[nearer], at
        at = int(np.where(free, best, 1 << 14).argmin())
        if free[at] and best[at] <= reach:
            out.append((int(left[source[at]]), int(left[at])))
        elif not free[at]:
            break
    return out


def _edges(tables: Tables, reach: int):  # noqa: ANN202
    closed = np.array(tables.closed, np.uint64)
    word = np.array(tables.word)

    def earlier(words: Sequence[np.ndarray], table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether an earlier table of the first level has the pair in a bucket that isn't split."""
        out = np.zeros(len(a), bool)
        for t in tables.roots:
            own = words[tables.word[t]]
            some = np.flatnonzero(~out & (table > t) & ((own[a] ^ own[b]) & closed[t] == 0))
            if len(some):
                out[some] = ~tables.is_hot(tables.key(t, [w[a[some]] for w in words]))
        return out

    def compare(table: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key = np.zeros(len(table), np.uint64)
        for t in np.unique(table).tolist():
            own = table == t
            key[own] = tables.key(t, [w[own] for w in words])
        order = np.argsort(key, kind="stable")
        key, table, words = key[order], table[order], [w[order] for w in words]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        of = np.repeat(np.arange(len(start)), size)
        small = size <= SMALL
        hits: list[np.ndarray] = []
        at = np.flatnonzero(small[of] & (size[of] > 1))
        for step in range(1, SMALL):
            at = at[(at + step < len(key))]
            at = at[of[at + step] == of[at]]
            if not len(at):
                break
            d = distances(words, at, at + step)
            near = d <= reach
            hits.append(np.stack([at[near], at[near] + step, d[near]]))
        left, right = [], []
        if hits:
            found = np.concatenate(hits, axis=1)
            found = found[:, np.argsort(found[2], kind="stable")]
            parent = {int(x): int(x) for x in np.unique(found[:2])}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for a, b in zip(found[0].tolist(), found[1].tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    left.append(a)
                    right.append(b)
        for k in np.flatnonzero(~small).tolist():
            first = int(start[k])
            for a, b in forest([w[first : first + size[k]] for w in words], reach):
                left.append(first + a)
                right.append(first + b)
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        new = ~earlier(words, table[a], a, b) if len(a) else np.zeros(0, bool)
        a, b = a[new], b[new]
        return row_id([w[a] for w in words]), row_id([w[b] for w in words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[np.ndarray] = []
        words: list[list[np.ndarray]] = []
        for batch in batches:
            for row in range(len(batch)):
                table.append(np.frombuffer(batch.column(1)[row].as_buffer(), np.uint32).copy())
                words.append([np.frombuffer(c[row].as_buffer(), np.uint64).copy() for c in batch.columns[2:]])
        if table:
            a, b = compare(np.concatenate(table), [np.concatenate(x) for x in zip(*words, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def connect(rows: DataFrame, columns: Sequence[str], make: Callable[[int, int], list[int]], radius: int, reach: int, scratch: Scratch, *, limit: int = LIMIT, share: int = SHARE, whole: bool = False) -> DataFrame:
    """Edges (a < b) of ``row_id``s that connect the distinct rows as all pairs within the reach that meet do.

    ``whole``: edges are candidates, and all rows of an overfull bucket may be linked to it.
    """
    own = rows.select(*columns)
    total = own.count()
    tables = Tables(len(columns), make, radius, whole)
    dealt = own.repartition(blocks(total, DEALT * 2))
    fresh = list(tables.roots)
    if whole:
        limit = max(limit, CROWD * total >> min(closed.bit_count() for closed in tables.closed))
    while fresh and total > limit:  # with fewer rows no bucket can be too large
        counted = dealt.mapInArrow(_count(tables, frozenset(fresh), share), "t int, h long, n long").groupBy("t", "h").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        fresh = tables.split([(r.t, r.h) for r in counted.select("t", "h").collect()])  # at most tables * share of them
    entries = total * len(tables.roots)
    slots = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks(entries, TASK))
    packed = dealt.mapInArrow(_deal(tables, slots), ", ".join(["slot int, tables binary", *(f"w{k} binary" for k in range(len(columns)))]))
    edges = packed.repartitionById(slots, F.col("slot")).mapInArrow(_edges(tables, reach), "a long, b long")
    if whole and len(tables.hot):
        edges = edges.unionByName(dealt.mapInArrow(_star(tables), "a long, b long"))
    return scratch.put(edges)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: every node with the smallest node it reaches here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, r) for x in parent if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, *, share: int = EDGES) -> DataFrame:
    """(node, root) of every node of the edges (a, b), a table of ``scratch``; a root is its component's smallest node.

    Each share of at most about ``share`` edges is contracted to stars in one task. If there is one share that is all.
    Otherwise alternating large-star and small-star rounds follow: each joins a node's edges to its smallest neighbour,
    so no task gathers a component, and rounds are few however long its paths are.
    """
    shares = blocks(edges.count(), share)
    now = scratch.put(edges.select("a", "b").repartition(shares).mapInArrow(_contracted, "a long, b long"))
    before = None
    while shares > 1:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = scratch.put(small)
        scratch.drop(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
