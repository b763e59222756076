"""Operator 3: near duplicates by SimHash and covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it. For radius 3, 15 masks
guarantee that all pairs within the radius meet in some table, so none is missed (``covering``). Pairs are confirmed by
their true distance, equal fingerprints are one candidate, and a bucket emits the edges of a spanning forest.

Null and empty texts have no word: fingerprint zero, linked like any other. Components take the smallest doc_id of
their rows; null ids count for no component's id. Repeated rows come out as often as they came in. Further columns
aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buffers, cut, utf8
from .covering import LIMIT, SHARE, components, connect, masks
from .pieces import parts

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Hashes of a text that are counted at a time.
HASHES = 1 << 16

_SET = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text; A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)), strict=False)] if len(words) >= shingle else [b" ".join(words)]
    count = np.zeros(2048, np.int64)
    for k in range(0, len(grams), HASHES):
        own = grams[k : k + HASHES]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(SEED)), np.uint64, len(own))
        count += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048)
    bits = (count.reshape(8, 256) @ _SET).ravel() * 2 > len(grams)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``fp``, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, texts in parts(data, offsets):
                found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, fp long")


def links(prints: DataFrame, scratch: Scratch, *, radius: int = RADIUS, limit: int = LIMIT, share: int = SHARE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as all pairs within the radius do."""
    return connect(prints, ["fp"], masks, radius, radius, scratch, limit=limit, share=share)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (the smallest id reachable)."""
    rows = cut(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.put(rows.groupBy("fp").agg(F.min(id_col).alias("first")))
        groups = scratch.put(components(links(prints, scratch, radius=radius), scratch))
        joined = prints.join(groups.withColumnRenamed("node", "fp"), "fp")
        least = joined.groupBy("root").agg(F.min("first").alias("least"))
        moved = joined.select("fp", "root").join(least, "root").select("fp", "least")
        named = cut(prints.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return rows.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
