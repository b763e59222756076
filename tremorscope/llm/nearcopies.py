"""Near copies: SimHash candidates of a wide radius by covering masks, then exact similarity of five-word shingles.

Texts of equal words (A-Z as a-z) are one text. Each text of at least ``WORDS`` words gets two fingerprints of 64 bits,
by the halves of its two-word shingles' XXH3 hashes. Covering masks find every pair that differs by at most ``RADIUS``
bits in either, and most pairs some bits further apart; what meets is a candidate up to ``REACH`` bits of the 128 (a
block appended, cut or replaced changes as many two-word shingles as five-word ones: at a similarity of 0.8 about 19
bits, with a deviation of 4; unrelated texts are 64 bits apart, with a deviation of 6).

Candidate pairs aren't written out. Buckets give spanning forests (``covering``), whose components are the candidate
groups; most texts are in none. The shingle sets of a group are then held against each other in full, by the exact
Jaccard similarity, in blocks of at most ``BLOCK`` texts or ``BLOCK_BYTES`` of shingles:

1. A group of one block is settled in one task. Of a larger one each block settles itself.
2. In a larger group, all blocks are held against ``HUBS`` texts of its largest component so far. That joins a group of
   copies with data that grow as the group does.
3. What then lies outside the group's largest component is held, block by block, against the whole group.

So no pair within a group is left out, what a task holds is bounded, and what is emitted is one link a text and block.
The data sent in the third step grow with (texts outside the largest component) x (texts of the group) / ``BLOCK``:
that is linear where a large group holds together, not where it is many texts alike in their two-word shingles that
are no near copies.

Texts of fewer than ``WORDS`` words (null and empty ones too) have their whole sequence as their one shingle, so only
equal ones are linked. Rows without an id take no part. A row is judged by its id and its text, so two texts of one id
are two rows. Repeated rows come out as often as they came in; other columns aren't read, whatever their names. Very
long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, buffers, cut, release, utf8
from .covering import LIMIT, SHARE, components, connect, row_id, wide_masks
from .pieces import parts
from .simhash import _SET, HASHES

WORDS = 5
SIMILARITY = 0.8
SHINGLE = 2
#: Differing bits of one fingerprint up to which the masks find every pair, and of both up to which they are candidates.
RADIUS, REACH = 9, 30
#: Texts of a block, bytes of their shingles, and texts of a large group that all its blocks are held against.
BLOCK, BLOCK_BYTES, HUBS = 1024, 1 << 25, 16


def signature(words: list[bytes]) -> np.ndarray:
    """Two fingerprints of 64 bits."""
    grams = [b" ".join(x) for x in zip(*(words[k:] for k in range(SHINGLE)), strict=False)]
    count = np.zeros(4096, np.int64)
    for k in range(0, len(grams), HASHES):
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams[k : k + HASHES])), np.uint8).reshape(-1, 16)
        count += np.bincount((hashes + np.arange(0, 4096, 256)).ravel(), minlength=4096)
    bits = (count.reshape(16, 256) @ _SET).ravel() * 2 > len(grams)
    return np.packbits(bits, bitorder="little").view(np.int64)


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted distinct hashes of the five-word shingles."""
    grams = {b" ".join(x) for x in zip(*(words[k:] for k in range(WORDS)), strict=False)} or {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _signed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        data, offsets = buffers(batch.column(2))
        for first, texts in parts(data, offsets):
            words = [t.lower().split() for t in texts]
            full = np.array([len(w) >= WORDS for w in words], bool)
            prints = np.array([signature(w) if len(w) >= WORDS else (0, 0) for w in words], np.int64).reshape(-1, 2)
            whole = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())
            ids = row_id([np.ascontiguousarray(prints[:, k]).view(np.uint64) for k in (0, 1)])
            count = pa.array([len(w) for w in words], pa.int64())
            own = [pa.array(x, mask=~full) for x in (prints[:, 0], prints[:, 1], ids)]
            yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[:2]), whole, count, *own], names=["id", "mark", "whole", "words", "f0", "f1", "print"])
    release()


def _sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        data, offsets = buffers(batch.column(4))
        for first, texts in parts(data, offsets):
            grams = pa.array([shingles(t.lower().split()).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[:4]), grams], names=["node", "group", "block", "blocks", "grams"])
    release()


def joined(sets: list[np.ndarray], first: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """Labels, merged over all pairs of a row of ``first`` and any row whose similarity is ``least`` or more.

    Of a pair that an earlier pair has merged nothing is computed. A merged label is the smallest.
    """
    size = np.array([len(s) for s in sets])
    label = label.copy()
    ids, where = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(where, kind="stable")
    holders, bounds = of[order], np.r_[0, np.cumsum(np.bincount(where, minlength=len(ids)))]
    done = np.zeros(len(sets), bool)
    for i in first.tolist():
        done[i] = True
        other = (label != label[i]) & (size >= least * size[i]) & (size * least <= size[i]) & ~done & (size > 0)
        if not other.any():
            continue
        tokens = where[ends[i] - size[i] : ends[i]]
        if other.sum() < 8:
            found = [j for j in np.flatnonzero(other).tolist() if similarity(sets[i], sets[j]) >= least]
        else:
            shared = np.zeros(len(sets), np.int64)
            for k in range(0, len(tokens), 4096):
                some = tokens[k : k + 4096]
                count = bounds[some + 1] - bounds[some]
                total = int(count.sum())
                starts = np.repeat(bounds[some] - (np.cumsum(count) - count), count)
                shared += np.bincount(holders[starts + np.arange(total)], minlength=len(sets))
            found = np.flatnonzero(other & (shared >= least * (size + size[i] - shared))).tolist()
        for old in {int(label[j]) for j in found} - {int(label[i])}:
            low, high = sorted((int(label[i]), old))
            label[label == high] = low
    return label


def _settle(least: float):  # noqa: ANN202
    """Over rows sorted by their block: the labels (a, b) that the block's pairs merge, one row for each label but the smallest.

    Side 0 is held against all rows, side 1 against those of side 0 alone.
    """

    def settled(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        before = np.array([r[0] for r in rows], np.int64)
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        after = joined(sets, np.flatnonzero(np.array([r[1] for r in rows]) == 0), before, least)
        moved = np.unique(np.stack([before, after])[:, before != after], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(moved[0]), pa.array(moved[1])], names=["a", "b"]) if moved.shape[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, ...] | None = None
        kept: list[tuple[int, int, bytes]] = []
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            for key, row in zip(keys, zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True), strict=True):
                if key != at:
                    if len(kept) > 1 and (out := settled(kept)) is not None:
                        yield out
                    at, kept = key, []
                kept.append(row)
        if len(kept) > 1 and (out := settled(kept)) is not None:
            yield out
        kept = []
        release()

    return run


def _held(rows: DataFrame, least: float) -> DataFrame:
    """Merges (a, b) of labels, from rows (group, block, other, label, side, grams)."""
    keys = ["group", "block", "other"]
    return rows.select(*keys, "label", "side", "grams").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_settle(least), "a long, b long")


def settle(sets: DataFrame, scratch: Scratch, *, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, label) of the nodes of ``sets`` (node, group, block, blocks, grams); one label a component."""
    zero = F.lit(0).cast("long")
    within = scratch.put(_held(sets.select("group", "block", zero.alias("other"), F.col("node").alias("label"), F.lit(0).alias("side"), "grams"), least))
    label = sets.select("node", "group", "blocks").join(within.select(F.col("a").alias("node"), F.col("b").alias("to")), "node", "left").select("node", "group", "blocks", F.coalesce("to", "node").alias("label"))
    large = label.where("blocks > 1")
    if not large.head(1):
        return label.select("node", "label")
    # a group of several blocks: its hubs first, then what they leave apart
    own = scratch.put(large.select("node", "label").join(sets, "node"))
    top = own.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    hubs = own.join(top, ["group", "label"]).withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("node"), "node"))).where(F.col("place") <= HUBS)
    each = hubs.select("group", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), zero.alias("other"), "label", F.lit(0).alias("side"), "grams")
    rows = own.select("group", "block", zero.alias("other"), "label", F.lit(1).alias("side"), "grams")
    links = scratch.put(_held(each.unionByName(rows), least))
    now = _relabelled(own.select("node", "group", "label"), links, scratch)
    sizes = now.groupBy("group", "label").agg(F.count("*").alias("n"))
    core = sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("core"), F.sum("n").alias("all"), F.max("n").alias("most"))
    sided = now.join(core, "group").join(own.select("node", "block", "blocks", "grams"), "node").withColumn("rest", F.col("label") != F.col("core"))
    sided = scratch.put(sided.withColumn("others", F.ceil((F.col("all") - F.col("most")) / block).cast("long")).where("others > 0"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("others"))
    rest = sided.where("rest").select("group", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), part.alias("other"), "label", F.lit(0).alias("side"), "grams")
    every = sided.select("group", "block", F.explode(F.sequence(zero, F.col("others") - 1)).alias("other"), "label", F.lit(1).alias("side"), "grams")
    links = scratch.put(_held(rest.unionByName(every), least))
    now = _relabelled(now, links, scratch)
    return label.where("blocks = 1").select("node", "label").unionByName(now.select("node", "label"))


def _relabelled(rows: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    groups = components(links, scratch)
    return scratch.put(rows.join(groups.withColumnRenamed("node", "label"), "label", "left").select("node", "group", F.coalesce("root", "label").alias("label")))


def mark(text_col: str) -> Column:
    """What tells apart the texts of one id."""
    return F.xxhash64(F.col(text_col))


def near_copies(docs: DataFrame, *, least: float = SIMILARITY, radius: int = RADIUS, reach: int = REACH, block: int = BLOCK, limit: int = LIMIT, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row with an id: the id, ``mark`` of its text, its ``component`` (a text's node) and ``component_id``, the smallest id in that."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), mark(text_col).alias("mark"), utf8(text_col).alias("text"))
    signed = own.mapInArrow(_signed, f"id {kind}, mark long, whole binary, words long, f0 long, f1 long, print long")
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.put(signed)
        once = rows.groupBy("whole").agg(F.min(F.struct("id", "mark")).alias("first"), *(F.first(c).alias(c) for c in ("words", "f0", "f1", "print")))
        texts = scratch.put(once.withColumn("node", F.monotonically_increasing_id()))
        # the candidate groups
        full = texts.where("print IS NOT NULL")
        prints = scratch.put(full.groupBy("print").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1")).select("f0", "f1"))
        edges = connect(prints, ["f0", "f1"], wide_masks, radius, reach, scratch, limit=limit, share=share, whole=True)
        roots = components(edges, scratch).withColumnRenamed("node", "print")
        grouped = scratch.put(full.select("node", "first", "words", "print").join(roots, "print", "left").withColumn("group", F.coalesce("root", "print")).drop("print", "root"))
        sizes = grouped.groupBy("group").agg(F.count("*").alias("n"), F.sum("words").alias("words")).where("n > 1")
        sizes = sizes.select("group", F.ceil(F.greatest(F.col("n") / block, F.col("words") * 8 / BLOCK_BYTES)).cast("long").alias("blocks"))
        members = grouped.drop("words").join(sizes, "group").select("node", "group", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "blocks", "first.id", "first.mark")
        # their shingle sets
        named = members.join(own, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("node", "group", "block", "blocks", "text")
        sets = scratch.put(named.mapInArrow(_sets, "node long, group long, block long, blocks long, grams binary"))
        labels = settle(sets, scratch, least=least, block=block)
        known = scratch.put(texts.select("node", "whole", "first").join(labels, "node", "left").select("whole", "first", F.coalesce("label", "node").alias("component")))
        smallest = known.groupBy("component").agg(F.min("first.id").alias("component_id"))
        final = known.select("whole", "component").join(smallest, "component")
        return cut(rows.select("id", "mark", "whole").join(final, "whole").select(F.col("id").alias(id_col), "mark", "component", "component_id"))


def keep_first(docs: DataFrame, copies: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component of ``copies`` (by default those of ``near_copies``).

    That is the row of the smallest id, and of two texts of one id that of the smaller mark; of rows equal in id and
    text any one. Rows without an id are kept: nothing tells which of them is which.
    """
    copies = near_copies(docs, id_col=id_col, text_col=text_col) if copies is None else copies
    kept = copies.groupBy("component").agg(F.min(F.struct(F.col(id_col), F.col("mark"))).alias("one")).select(F.col(f"one.{id_col}").alias("_id"), F.col("one.mark").alias("_mark"))
    times = copies.groupBy(F.col(id_col).alias("_id"), F.col("mark").alias("_mark")).agg(F.count("*").alias("_times"))
    named = cut(kept.join(times, ["_id", "_mark"]))
    renamed = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # no column's name clashes
    at_id, at_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    found = renamed.where(F.col(at_id).isNotNull()).withColumn("_m", mark(at_text)).join(named, (F.col(at_id) == F.col("_id")) & (F.col("_m") == F.col("_mark")))
    out = found.where("_times = 1").select(renamed.columns)
    if named.where("_times > 1").head(1):
        out = out.unionByName(found.where("_times > 1").dropDuplicates(["_id", "_mark"]).select(renamed.columns))
    return out.unionByName(renamed.where(F.col(at_id).isNull())).toDF(*docs.columns)
