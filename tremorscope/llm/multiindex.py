"""Operator 6: approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation is learned on a bounded sample so that the signs of rotated vectors lose little (alternating between
signs and the rotation that fits them best, from a random start after whitening by principal directions). Since
q.x and q.(x - mean) rank alike, only the indexed side is centred. A 64-bit code is split into 8 substrings; in every
block each substring has an index from each of its 256 values to the rows within that value's radius, as bitmaps.
Two codes within radius r agree in some substring within that substring's radius, as the substrings' radii plus one
sum to over r (pigeonhole), so joining 8 bitmaps finds every code within r. Those are confirmed on the whole code and
reranked by the inner product of the original vectors in doubles.

The radius is the one that holds ``RECALL`` of the true neighbours within the sample; in more rows neighbours are
nearer, so it is on the safe side. Queries that hold fewer than k rows of all blocks are searched again within
``WIDER`` more bits, up to the whole code, until they hold k or all there are. Every row is indexed. Vectors that are null, zero or hold null or non-finite
components take no part; an id that repeats counts once, with its smallest vector; vectors of another dimension than
the query's are no candidates, and rows of a dimension the sample lacks are searched whole. Ties go to the smaller
vec_id. Further columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import search, sound

#: Rows that the rotation and the radius are learned from at most.
SAMPLE = 20_000
#: Sample rows whose true neighbours set the radius.
PROBES = 400
#: Share of true neighbours that the radius holds in the sample.
RECALL = 0.97
BITS, PARTS = 64, 8
#: Bits by which the radius grows for queries that hold too few rows.
WIDER = 8
#: Queries that are reranked at a time.
STEP = 128
#: A candidate's own product costs about as much as so many entries of a matrix product.
SPARSE = 16

_NEAR = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])


@dataclass
class Codes:
    """The learned code: sign((x - mean) @ turn), and the search radius."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def code(self, rows: np.ndarray, *, centred: bool) -> np.ndarray:
        bits = ((rows - self.mean if centred else rows) @ self.turn) > 0
        return np.packbits(bits, axis=1)


def learn(sample: np.ndarray, k: int, rounds: int = 40) -> Codes:
    """Learn the code of vectors like the sample's rows."""
    mean = sample.mean(0)
    own = sample - mean
    dim, rng = sample.shape[1], np.random.default_rng(7)
    _, axes = np.linalg.eigh(own.T @ own)
    axes = axes[:, ::-1][:, : min(dim, BITS)]
    turns = []
    for _ in range(-(-BITS // axes.shape[1])):  # fewer dimensions than bits: several rotations
        flat = own @ axes
        r = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ r > 0, 1.0, -1.0).T @ flat)
            r = (u @ v).T
        turns.append(axes @ r)
    codes = Codes(mean, np.concatenate(turns, axis=1)[:, :BITS], BITS)
    if len(sample) > 2:
        probe = rng.permutation(len(sample))[:PROBES]
        scores = sample[probe] @ sample.T
        scores[np.arange(len(probe)), probe] = -np.inf
        near = np.argpartition(-scores, min(k, len(sample) - 2), axis=1)[:, :k]
        a, b = codes.code(sample[probe], centred=False), codes.code(sample, centred=True)
        gaps = np.bitwise_count(a[:, None, :] ^ b[near]).sum(-1)
        codes.radius = int(np.quantile(gaps, RECALL, method="higher"))
    return codes


def radii(radius: int) -> list[int]:
    """Radii of the substrings whose successors sum to radius + 1; -1: the substring is not probed."""
    return [(radius + 1) // PARTS + (j < (radius + 1) % PARTS) - 1 for j in range(PARTS)]


class Index:
    """Every substring's map from a value to the rows within the substring's radius of it."""

    def __init__(self, codes: np.ndarray, radius: int) -> None:
        self.codes, self.radius, self.rows = codes, radius, len(codes)
        self.reach = [np.packbits(_NEAR[:, codes[:, j]] <= r, axis=1) if r >= 0 else None for j, r in enumerate(radii(radius))]

    def within(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, row) whose codes differ in at most ``radius`` bits."""
        found = np.zeros((len(query), -(-self.rows // 8)), np.uint8)
        for j, reach in enumerate(self.reach):
            if reach is not None:
                found |= reach[query[:, j]]
        q, p = np.nonzero(np.unpackbits(found, axis=1, count=self.rows))
        whole = self.codes.view(np.uint64).ravel()
        keep = np.bitwise_count(query.view(np.uint64).ravel()[q] ^ whole[p]) <= self.radius
        return q[keep], p[keep]


def top(query_ids: np.ndarray, queries: np.ndarray, vec_ids: np.ndarray, vectors: np.ndarray, codes: Codes | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best among the rows within the radius: query ids, vector ids, inner products."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    index = Index(codes.code(vectors, centred=True), codes.radius) if codes else None
    for first in range(0, len(queries), STEP):
        own, names = queries[first : first + STEP], query_ids[first : first + STEP]
        if index is None:
            q, p = (x.ravel() for x in np.indices((len(own), len(vectors))))
        else:
            q, p = index.within(codes.code(own, centred=False))
        keep = names[q] != vec_ids[p]
        q, p = q[keep], p[keep]
        if not len(q):
            continue
        # few candidates are ranked as they are; of many a fast product first decides who may be among the best
        if len(q) * SPARSE > len(own) * len(vectors):
            rough = np.full((len(own), len(vectors)), -np.inf)
            rough[q, p] = (own @ vectors.T)[q, p]
            n = min(k, len(vectors))
            floor = np.partition(rough, len(vectors) - n, axis=1)[:, len(vectors) - n]
            floor = floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
            q, p = np.nonzero((rough >= floor[:, None]) & (rough > -np.inf))
        # the exact product, alike wherever a row stands, ranks
        score = (own[q] * vectors[p]).sum(1)
        order = np.lexsort((vec_ids[p], -score, q))
        q, p, score = q[order], p[order], score[order]
        start = np.flatnonzero(np.r_[True, np.diff(q) != 0])
        nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        best = nth < k
        out.append((names[q[best]], vec_ids[p[best]], score[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def nearest(embeddings: DataFrame, queries: str, *, k: int, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found of each row for which the SQL condition ``queries`` holds."""
    own = embeddings.where(F.col("vec_id").isNotNull() & sound(zero=False)).select("vec_id", "embedding")
    asks = own.where(F.expr(queries))
    total = own.count()
    share = int(1_000_000 * min(1.0, 0.95 * sample / max(1, total)))
    drawn = own.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < share).select("embedding").limit(sample).toArrow()  # bounded by ``sample``
    by: dict[int, list[np.ndarray]] = {}
    for row in drawn.column("embedding").to_numpy(zero_copy_only=False):
        by.setdefault(len(row), []).append(np.asarray(row, np.float64))
    codes = {d: learn(np.stack(rows), k) for d, rows in by.items() if len(rows) > 2 * k}

    def found(asked: DataFrame, codes: dict[int, Codes]) -> DataFrame:
        def within(query_ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return top(query_ids, q, vec_ids, p, codes.get(q.shape[1]), k)

        return cut(search(own, asked, total, asked.count(), within, k=k, score="double"))

    best = found(asks, codes)
    # rows of a dimension without a code were searched whole
    while narrow := [d for d, c in codes.items() if c.radius < BITS]:
        held = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
        short = cut(asks.where(F.size("embedding").isin(narrow)).join(held, "vec_id", "left_anti").select("vec_id", "embedding"))
        if not short.head(1):
            break
        codes = {d: replace(c, radius=min(BITS, c.radius + WIDER)) for d, c in codes.items()}
        again = short.select(F.col("vec_id").alias("query_id")).distinct()
        best = cut(best.join(again, "query_id", "left_anti").unionByName(found(short, codes)))
    return best
