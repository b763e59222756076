"""Operator 2: exact top-k inner products by a dual-tree search over cover trees.

Vectors and queries of a block are indexed by cover trees: a node has a centre, one of its points, and a covering
radius; its children cover its points with smaller radii. For a query node with centre a and radius r, and a vector
node with centre b and radius s, no inner product exceeds a.b + |a|s + |b|r + rs. A pair of nodes whose bound is
below the worst kth score of the query node's group is pruned; others are opened best bound first, and pairs of
leaves are computed.

Components count as floor(256 * x). Vectors that are null or hold null or non-finite components take no part; an id
that repeats counts once, with its smallest vector; vectors of another dimension than the query's are no candidates.
Ties go to the smaller vec_id. Further columns aren't read. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import search, sound

#: Points of a node that isn't split.
LEAF = 48
#: By how much the covering radius shrinks from a node to its children.
SHRINK = 1.3
#: Sums of products up to here are exact in doubles.
EXACT = 2.0**53


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    low: int
    high: int
    children: list[Node]


class CoverTree:
    """Points in the order of the leaves, and the tree over them."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.root = self._build(0, len(points))

    def _node(self, low: int, high: int, centre: np.ndarray, radius: float) -> Node:
        return Node(centre, float(np.sqrt(centre @ centre)), radius, low, high, [])

    def _build(self, low: int, high: int) -> Node:
        own = self.points[self.order[low:high]]
        middle = own[np.argmin(((own - own.mean(0)) ** 2).sum(1))]
        away = np.sqrt(np.maximum(0, ((own - middle) ** 2).sum(1)))
        node = self._node(low, high, middle, float(away.max()))
        if high - low <= LEAF or node.radius == 0:
            return node
        # centres are taken greedily until all points are within the next radius; each takes its own
        reach, label, left, found = node.radius / SHRINK, np.zeros(high - low, np.int64), np.arange(high - low), 0
        label[left[away <= reach]] = 0
        left, found = left[away > reach], 1
        while len(left):
            gap = np.sqrt(np.maximum(0, ((own[left] - own[left[0]]) ** 2).sum(1)))
            label[left[gap <= reach]] = found
            left, found = left[gap > reach], found + 1
        # what covers few points is bundled with its neighbours in the list, up to a leaf
        sizes = np.bincount(label, minlength=found)
        bundle, fill, name = np.zeros(found, np.int64), 0, 0
        for k in range(found):
            if fill and fill + sizes[k] > LEAF:
                name, fill = name + 1, 0
            bundle[k] = name
            fill += int(sizes[k])
        label = bundle[label]
        if label.max() == 0:
            return node
        self.order[low:high] = self.order[low:high][np.argsort(label, kind="stable")]
        at = low
        for n in np.bincount(label).tolist():
            if n == high - low:
                return node
            node.children.append(self._build(at, at + n))
            at += n
        return node


def top(query_ids: np.ndarray, queries: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best vectors with another id: query ids, vector ids, scores."""
    trees = CoverTree(queries), CoverTree(vectors)
    q, p = (t.points[t.order] for t in trees)
    query_ids, vec_ids = query_ids[trees[0].order], vec_ids[trees[1].order]
    most = float(np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(1, q.shape[1]))
    score, name = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    if most >= EXACT:
        q, p = q.astype(np.int64), p.astype(np.int64)
        score = np.full((len(q), k), -(1 << 62))

    def bound(a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius + 1e-6 * (1 + a.norm * b.norm)

    stack = [(bound(trees[0].root, trees[1].root), trees[0].root, trees[1].root)]
    while stack:
        limit, a, b = stack.pop()
        if limit < score[a.low : a.high, -1].min():
            continue
        if a.children or b.children:
            if b.children and (not a.children or b.radius >= a.radius):
                more = [(bound(a, c), a, c) for c in b.children]
            else:
                more = [(bound(c, b), c, b) for c in a.children]
            stack += sorted(more, key=lambda x: x[0])
            continue
        got = q[a.low : a.high] @ p[b.low : b.high].T
        ids = vec_ids[b.low : b.high]
        own = query_ids[a.low : a.high, None] == ids[None, :]
        for i in np.flatnonzero((got >= score[a.low : a.high, -1:]).any(1)).tolist():
            row = a.low + i
            take = np.flatnonzero((got[i] >= score[row, -1]) & ~own[i])
            if len(take):
                both, names = np.r_[score[row], got[i, take]], np.r_[name[row], ids[take]]
                best = np.lexsort((names, -both))[:k]
                score[row], name[row] = both[best], names[best]
    held = name != np.iinfo(np.int64).max
    return np.repeat(query_ids, held.sum(1)), name[held], score[held].astype(np.int64)


def exact_top(embeddings: DataFrame, queries: str, *, k: int, scale: int = 256) -> DataFrame:
    """The ``k`` best rows of each row for which the SQL condition ``queries`` holds: query_id, rank, vec_id, score."""
    own = embeddings.where(F.col("vec_id").isNotNull() & sound()).select("vec_id", "embedding")
    asks = own.where(F.expr(queries))

    def within(query_ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return top(query_ids, np.floor(scale * q), vec_ids, np.floor(scale * p), k)

    return search(own, asks, own.count(), asks.count(), within, k=k, score="long")
