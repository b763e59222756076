"""Operator 4: best-fit packing by hierarchical residual packing.

Documents are tokenized, longer ones are cut into pieces of ``capacity`` ids, and the pieces are packed as
items: every partition packs its own by best fit, largest first, and emits the bins that are nearly full. The
underfull bins become items of the next round, in which ``FAN_IN`` partitions meet in one, down to one task as
long as it gets no more than ``ITEMS`` items. Before each further round, bins that no other open bin fits into
are finished: whatever is packed later is at least as large. Where more than ``ITEMS`` bins stay open, they keep
as many tasks as that takes and are dealt anew each round, until a round joins less than ``GAIN`` of them; so no
task's work grows with the input. A task packs at most ``ITEMS`` items at a time.

Null texts are empty. An empty text is one piece that holds the end id alone. Repeated rows are packed as
often as they come; equal ids are told apart by an own item number. Ties go to the fuller bin made first.
Further columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, cut, ragged, release, utf8
from .merges import MergeTable
from .pieces import parts

#: Ids a sequence holds at most.
CAPACITY = 4096
#: The id after each document's last.
END = 1
#: Partitions of one round that meet in one partition of the next.
FAN_IN = 8
#: Items that a task packs at a time.
ITEMS = 100_000
#: A bin with at most so many free ids is not opened again.
SLACK = 2
#: Over ``ITEMS`` open bins, rounds go on while each joins at least this share of them.
GAIN = 0.05
#: Words whose ids a worker keeps, and bytes of texts that it encodes at a time.
CACHE, CHUNK = 400_000, 4 << 20
#: Code points below this are lower-cased and split here, others by the library.
PLAIN = 0x250


class Numbers(dict):
    """Numbers keys from 0 on in the order in which they are first asked for."""

    def __missing__(self, key: object) -> int:
        n = self[key] = len(self)
        return n


class WordModel:
    """The tokenizer in ``path``, applied to whole texts by way of their distinct words.

    No id of this tokenizer spans white space, so a text's ids are those of its white-space separated chunks
    one after another. Chunks of plain letters are merged together by ``MergeTable``; every other chunk
    goes to the library itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self.own, self.known = Tokenizer.from_file(path), Numbers()
        body, vocab = stored["model"], stored["model"]["vocab"]
        self.suffix = body["end_of_word_suffix"] or ""
        kinds = [x["type"] for x in stored["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or body["type"] != "BPE" or body.get("ignore_merges") or body.get("dropout"):
            raise ValueError("not a lower-casing BPE vocabulary with word ends")
        self.word = regex.compile(stored["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letter[b] + self.suffix] for b in range(256)], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in body["merges"]]
        rows = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in reversed(list(enumerate(merges)))}
        self.table = MergeTable(*(np.array(x) for x in zip(*((a, b, k, m) for (a, b), (k, m) in rows.items()), strict=True)))
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def words(self, text: str) -> list[str] | None:
        """The chunk's words, or None where the library must be asked."""
        if "<|" in text:
            return None
        if not text.isascii() and (max(text) >= chr(PLAIN) or "İ" in text or any(c in text for c in "\x85\xa0")):
            return None
        return self.word.findall(text.lower())

    def fresh(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks one after another, and how many each has."""
        text = b"\n".join(chunks).decode("utf-8")  # no chunk holds a line break
        number, flat, count, odd = Numbers(), [], [], []
        for own, low in zip(text.split("\n"), text.lower().split("\n"), strict=True):
            if own.isascii():
                if low.isalpha():
                    flat.append(number[low])
                    count.append(1)
                    continue
                if low[:-1].isalpha():
                    flat += number[low[:-1]], number[low[-1]]
                    count.append(2)
                    continue
            words = self.words(own)
            if words is None:
                odd.append(own)
                flat.append(-len(odd))
                count.append(1)
            else:
                flat += map(number.__getitem__, words)
                count.append(len(words))
        raw = [w.encode("utf-8") for w in number]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        octets = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[octets]
        ends = np.cumsum(sizes)
        if len(raw):
            symbols[ends - 1] = self.last[octets[ends - 1]]
        ids, lengths, _ = self.table.run(symbols, sizes)
        asked = [x.ids for x in self.own.encode_batch(odd, add_special_tokens=False)] if odd else []
        pool = np.r_[ids, np.fromiter(chain.from_iterable(asked), np.int32, sum(map(len, asked)))]
        lengths = np.r_[lengths, np.array([len(x) for x in asked], np.int64)]
        starts = np.cumsum(lengths) - lengths
        at = np.array(flat, np.int64)
        at = np.where(at < 0, len(raw) - 1 - at, at)
        cuts = np.r_[0, np.cumsum(lengths[at])][np.r_[0, np.cumsum(np.array(count, np.int64))]]
        return pool[ragged(starts[at], lengths[at])], np.diff(cuts)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts one after another, and how many each has."""
        split = [t.split() for t in texts]
        known, start, length, pool = self.known, self.start, self.length, self.pool
        before = len(known)
        count = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, count.sum())
        if len(known) > before:
            new = list(islice(known, before, None))
            ids, sizes = self.fresh(new)
            ends = np.cumsum(sizes)
            start, length, pool = np.r_[start, len(pool) + ends - sizes], np.r_[length, sizes], np.r_[pool, ids]
            if len(known) <= CACHE:
                self.start, self.length, self.pool = start, length, pool
            else:  # what there is no room for is forgotten
                for w in new:
                    del known[w]
        sizes = length[flat]
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(count)]]
        return pool[ragged(start[flat], sizes)], np.diff(ends)


_models: dict[str, WordModel] = {}


def model(path: str) -> WordModel:
    if path not in _models:
        _models[path] = WordModel(path)
    return _models[path]


def tokenize(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if ``with_ids``, ``ids``."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, texts in parts(data, offsets, CHUNK):
                ids, sizes = own.encode(texts)
                ids = np.insert(ids.astype("<u4"), np.cumsum(sizes), end)
                sizes = sizes + 1
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(texts)), count)
                piece = ragged(np.zeros(len(texts), np.int64), count)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                whole = memoryview(ids.tobytes())
                crc = [zlib.crc32(whole[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(first, len(texts)).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[begin, len(ids)], pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        release()

    return docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: each item's bin and place in it, and the bins' fill."""
    bins, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms: list[int] = []  # that some bin has
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], place[k] = b, fill[b]
        fill[b] += n
        if room > n:
            if not open_[room - n]:
                insort(rooms, room - n)
            open_[room - n].append(b)
    return bins, place, np.array(fill, np.int64)


def _round(items: DataFrame, capacity: int, step: int, slack: int, most: int) -> DataFrame:
    """Pack each partition's items (``item``, ``size``): item, its bin, its place there, the bin's size."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()
        kept_id, kept_size = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def pack(ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            bins, place, fill = best_fit(sizes, capacity)
            number = (np.int64(step) << 54) + (np.int64(task) << 32) + made + bins
            made += len(fill)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(number), pa.array(place), pa.array(fill[bins])], names=["item", "bin", "place", "fill"])

        for batch in batches:
            kept_id = np.r_[kept_id, batch.column(0).to_numpy(zero_copy_only=False)]
            kept_size = np.r_[kept_size, batch.column(1).to_numpy(zero_copy_only=False)]
            if len(kept_id) >= most:
                yield pack(kept_id, kept_size)
                kept_id, kept_size = kept_id[:0], kept_size[:0]
        if len(kept_id):
            yield pack(kept_id, kept_size)

    return items.select("item", "size").mapInArrow(run, "item long, bin long, place long, fill long").withColumn("full", F.col("fill") >= capacity - slack)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, fan_in: int = FAN_IN, slack: int = SLACK, most: int = ITEMS, gain: float = GAIN) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: no two overlap, offsets are gapless from 0."""
    items = cut(pieces.withColumn("item", F.monotonically_increasing_id()))
    width = max(1, items.rdd.getNumPartitions())
    done = cut(_round(items.select("item", F.col("length").alias("size")), capacity, 1, slack, most))
    placed = done.select(F.col("item").alias("base"), F.col("bin").alias("first"), F.col("place").alias("within"))
    # where the first round's open bins are by now; the pieces themselves are joined once, at the end
    moved, before, step = None, None, 1
    while True:
        open_ = done.where(~F.col("full")).groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("size"))
        left, least = open_.agg(F.count("*"), F.min("size")).first()
        if left < 2 or (width == 1 and left <= most and step > 1):
            break  # the last task has seen all that is open
        if left > most and before is not None and left > (1 - gain) * before:
            break  # dealt anew they hardly pair any more
        before, width, step = left, max(-(-width // fan_in), -(-left // most)), step + 1
        done = cut(_round(open_.where(F.col("size") <= capacity - least).repartition(width), capacity, step, slack, most))
        if moved is None:
            moved = done.select(F.col("item").alias("first"), "bin", F.col("place").alias("at"))
        else:
            up = done.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("place").alias("more"))
            moved = moved.join(up, "bin", "left").select("first", F.coalesce("up", "bin").alias("bin"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
    if moved is not None:
        placed = placed.join(moved, "first", "left").select("base", F.coalesce("bin", "first").alias("first"), (F.col("within") + F.coalesce("at", F.lit(0))).alias("within"))
    return items.join(placed.select(F.col("base").alias("item"), F.col("first").alias("sequence_id"), F.col("within").alias("offset")), "item").drop("item")
