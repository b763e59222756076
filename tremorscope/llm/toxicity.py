"""Operator 7: toxicity by maximum-scoring segments.

Tokens get log-odds of toxic against other text with an informative Dirichlet prior, from labelled rows alone.
A token is a word, or the beginning of words (``PREFIXES`` characters): a word outside the lexicon scores as its
longest beginning there. Learning counts a token once a document, so one text that repeats a word proves little.
A linear scan (all maximal scoring segments) finds every passage whose summed log-odds can't be raised by
lengthening, shortening or joining. A passage's significance follows the extreme-value law of such maxima: with
lambda solving sum(p * exp(lambda * score)) = 1 over clean tokens and K from clean documents, the expected number
of passages of score S in n tokens is K * n * exp(-lambda * S). A document's score joins its best passage's
significance and the sum over its significant passages by a logistic link fitted on the same labelled rows.

Learning reads labelled rows alone, those that ``train`` keeps, ``TRAIN_ROWS`` of them at most (a documented bound;
which ones is decided by a hash of the id). Scoring reads every whole text. Null and empty texts have no passage
and get the score of a text of no tokens. Repeated rows give one row each; a document labelled twice counts
twice. With no labelled row of either label every score is 0.5 or below: nothing is rejected. Further columns
aren't read; ``filter_toxic`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, cut, utf8
from .pieces import parts

#: Labelled rows that are learned from at most.
TRAIN_ROWS = 20_000
#: Tokens of the lexicon at most: those of the largest |z|.
LEXICON = 20_000
#: A token is in the lexicon from this |z| on.
LEAST_Z = 3.0
#: The weight of the prior, in tokens; a hundredth of the tokens learned from at most.
PRIOR = 500.0
#: What every count of the prior has besides its share of PRIOR.
LEAST_PRIOR = 0.5
#: Lengths of the beginnings of words that are tokens too.
PREFIXES = (4, 5, 6, 7)
#: Words whose score a Python worker keeps.
MEMO = 400_000
#: What a token outside the lexicon adds to a passage.
NEUTRAL = -0.25
#: A passage is significant at an expected number of at most this in a clean document.
EXPECTED = 0.05
#: Runs of ASCII letters and digits and of bytes of other scripts.
TOKEN = rb"[0-9A-Za-z\x80-\xff]+"
JAVA_TOKEN = r"[^0-9A-Za-z\x{80}-\x{10ffff}]+"


class Memo(dict):
    """Words' scores, None for a neutral word; a new word's comes from the lexicon."""

    def __init__(self, lexicon: dict[bytes, float]) -> None:
        self.lexicon = lexicon

    def __reduce__(self) -> tuple:
        return Memo, (self.lexicon,)

    def __missing__(self, word: bytes) -> float | None:
        value = self.lexicon.get(word)
        if value is None and len(word) > PREFIXES[0]:
            text = word.decode("utf-8")
            for k in reversed(PREFIXES):
                if len(text) > k and (value := self.lexicon.get(text[:k].encode() + b"*")) is not None:
                    break
        if len(self) < MEMO:
            self[word] = value
        return value


@dataclass
class Model:
    """What scoring needs: small, and sent with the tasks."""

    score: dict[bytes, float]
    lam: float = 1.0
    log_k: float = 0.0
    link: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def __post_init__(self) -> None:
        self.memo = Memo(self.score)

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.link[0] + self.link[1] * best + self.link[2] * total, -30, 30)))


def segments(at: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence, given its scored places; every other place scores ``gap`` < 0.

    Linear: each segment joins the last one that begins at a lower running sum if it ends at a higher one.
    """
    kept: list[list[float]] = []  # first place, last place, running sum before, running sum after
    total, seen = 0.0, 0
    for place, score in zip(at, scores, strict=True):
        total += gap * (place - seen)
        seen = place + 1
        if score <= 0:
            total += score
            continue
        own = [place, place, total, total + score]
        total += score
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= own[2]:
                j = int(kept[j][4]) if len(kept[j]) > 4 else j - 1
            if j < 0 or kept[j][3] >= own[3]:
                own.append(j)
                kept.append(own)
                break
            own = [kept[j][0], own[1], kept[j][2], own[3]]
            del kept[j:]
    return [(int(x[0]), int(x[1]) + 1, x[3] - x[2]) for x in kept]


def _scan(texts: list[bytes], score: Memo) -> tuple[list[int], list[list[tuple[int, int, float]]]]:
    """Each text's number of tokens and its maximal segments (token numbers)."""
    find, get = re.compile(TOKEN).findall, score.__getitem__
    counts, out = [], []
    for text in texts:
        tokens = find(text.lower())
        counts.append(len(tokens))
        values = list(map(get, tokens))
        hits = [k for k, v in enumerate(values) if v is not None] if any(values) else []
        out.append(segments(hits, [values[k] for k in hits], NEUTRAL) if hits else [])
    return counts, out


def _features(counts: list[int], found: list[list[tuple[int, int, float]]], lam: float, log_k: float) -> tuple[np.ndarray, np.ndarray]:
    """The best passage's -ln(expected number) and the sum of it over significant passages."""
    best, total = np.zeros(len(counts)), np.zeros(len(counts))
    for k, (n, segs) in enumerate(zip(counts, found, strict=True)):
        if segs:
            worth = [lam * s - log_k - np.log(n) for _, _, s in segs]
            best[k] = max(0.0, max(worth))
            total[k] = sum(w for w in worth if w >= -np.log(EXPECTED))
    return np.log1p(best), np.log1p(total)


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", train: str = "true", rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled rows for which the SQL condition ``train`` over doc_id holds."""
    marked = labels.where(F.expr(train)).select("doc_id", F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    n = marked.count()
    if n > rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    texts = cut(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")))
    tokens = texts.select("toxic", F.explode(F.array_distinct(F.split(F.expr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"), JAVA_TOKEN))).alias("token")).where("token <> ''")
    # two levels: a token's counts meet from each task, and rare tokens never reach the driver
    words = cut(tokens.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")))
    totals = words.agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).first()
    n1, n0 = float(totals["toxic"] or 0), float((totals["n"] or 0) - (totals["toxic"] or 0))
    if not n1 or not n0:
        return Model({})
    starts = F.array(F.col("token"), *(F.when(F.length("token") > k, F.concat(F.substring("token", 1, k), F.lit("*"))) for k in PREFIXES))
    counts = words.select(F.explode(starts).alias("token"), "toxic", "n").where("token is not null").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    prior = min(PRIOR, (n1 + n0) / 100)
    weight = F.lit(LEAST_PRIOR) + F.lit(prior) * F.col("n") / F.lit(n1 + n0)
    a, b = F.col("toxic") + weight, F.col("n") - F.col("toxic") + weight
    odds = F.log(a / (F.lit(n1 + prior) - a)) - F.log(b / (F.lit(n0 + prior) - b))
    lexicon = counts.select("token", "toxic", "n", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "token").limit(LEXICON).collect()
    score = {r["token"].encode(): float(r["odds"]) for r in lexicon}
    whole = [r for r in lexicon if not r["token"].endswith("*")]
    clean = np.array([r["n"] - r["toxic"] for r in whole], float)
    values = np.array([r["odds"] for r in whole], float)
    p = np.r_[clean, max(1.0, n0 - clean.sum())] / max(n0, clean.sum() + 1)
    s = np.r_[values, NEUTRAL]
    lam, memo = _root(p, s), Memo(score)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, own in parts(data, offsets):
                n_tokens, found = _scan(own, memo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(own)), pa.array(n_tokens, pa.int64()), pa.array([[x[2] for x in f] for f in found], pa.list_(pa.float64()))], names=["toxic", "n", "scores"])

    seen = texts.select("toxic", utf8("text").alias("text")).mapInArrow(scan, "toxic int, n long, scores array<double>").collect()
    y = np.array([r["toxic"] for r in seen], float)
    counts_, found = [r["n"] for r in seen], [[(0, 0, x) for x in r["scores"]] for r in seen]
    tops = np.array([lam * max(x[2] for x in f) - np.log(n) for n, f, t in zip(counts_, found, y, strict=True) if f and not t])
    log_k = float(tops.mean() - np.euler_gamma) if len(tops) >= 30 else 0.0
    best, total = _features(counts_, found, lam, log_k)
    return Model(score, lam, log_k, _logistic(np.stack([np.ones(len(y)), best, total], 1), y))


def _root(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * s)) = 1; 1 if there is none."""
    if (p * s).sum() >= 0 or s.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.clip(high * s, -500, 500))).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.clip(mid * s, -500, 500))).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, own: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score``, ``predicted`` and ``passages`` (start and end token, log-odds, expected number)."""
    passage = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("log_odds", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", passage)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, texts in parts(data, offsets):
                counts, found = _scan(texts, own.memo)
                p = own.probability(*_features(counts, found, own.lam, own.log_k))
                spans = [[{"start": a, "end": b, "log_odds": s, "expected": e} for a, b, s in segs if (e := n * float(np.exp(own.log_k - own.lam * s))) <= EXPECTED] if segs else [] for n, segs in zip(counts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_odds", pa.float64()), ("expected", pa.float64())])))], names=[f.name for f in schema])

    return docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, schema)


def filter_toxic(docs: DataFrame, own: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't toxic."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            keep: list[bool] = []
            for _, texts in parts(data, offsets):
                keep += (own.probability(*_features(*_scan(texts, own.memo), own.lam, own.log_k)) < 0.5).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
