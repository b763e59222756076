"""Operator 8: SentencePiece encoding and decoding by vectorised merge rounds.

The text is cut where no piece of the vocabulary can cross (before a run of spaces, around line feeds), so
each unit merges by itself and equal units are merged once. Units unknown so far go through
``merges.MergeTable`` together; a bounded cache keeps the ids of the units that came first. Null texts count
as empty; an empty text has no ids and decodes to the empty text. Repeated rows and ties give one row per
input row. Only columns ``doc_id`` and ``text`` are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, ragged, utf8
from .merges import MergeTable

#: Units that a Python worker keeps at most.
CACHE = 400_000
#: Bytes of text that are encoded at a time.
CHUNK = 4 << 20
SPACE = "▁"


class PieceModel:
    """A SentencePiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        size = own.get_piece_size()
        self.pieces = [own.id_to_piece(i) for i in range(size)]
        special = np.array([own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i) for i in range(size)])
        self.byte_id = np.full(256, own.unk_id(), np.int32)
        for i in range(size):
            if own.is_byte(i):
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_id] = True
        self.controls = frozenset(i for i in range(size) if own.is_control(i))
        normal = [i for i in range(size) if not special[i]]
        inside = [self.pieces[i] for i in normal if len(self.pieces[i]) > 1]
        self.lines_cut = not any("\n" in x for x in inside)
        if any(SPACE in x.lstrip(SPACE) for x in inside):
            raise ValueError("a piece crosses a space: units can't be merged one by one")
        symbol = {self.pieces[i]: i for i in normal}
        for x in inside:
            for c in x:
                symbol.setdefault(c, len(self.pieces) + len(symbol))
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        scores = {i: own.get_score(i) for i in normal}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rows = [(symbol[x[:k]], symbol[x[k:]], order[scores[symbol[x]]], symbol[x]) for x in inside for k in range(1, len(x)) if x[:k] in symbol and x[k:] in symbol]
        self.table = MergeTable(*(np.array(c) for c in zip(*rows, strict=True)))
        self.size = size
        self.unit = re.compile(rb" *[^ \n]+| +|\n" if self.lines_cut else rb" *[^ ]+| +")
        self.digits = [str(i) for i in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.is_byte[i] else b"" if own.is_control(i) else " ⁇ ".encode() if own.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[str] = []
        self.start, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units one after another, and how many each has."""
        words = [u.decode("utf-8") for u in units]
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        symbols, lengths, origin = self.table.run(self.char[points], np.fromiter(map(len, words), np.int64, len(words)))
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not len(odd):
            return symbols, lengths
        parts = [self.byte_id[np.frombuffer(chr(p).encode("utf-8"), np.uint8)] for p in points[origin[odd]]]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = [len(x) for x in parts]
        ids = np.repeat(symbols, sizes)
        ids[ragged((np.cumsum(sizes) - sizes)[odd], sizes[odd])] = np.concatenate(parts)
        return ids, np.add.reduceat(sizes, np.cumsum(lengths) - lengths) if len(lengths) else lengths

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The ids of UTF-8 texts one after another, how many each has, and their decimal ids joined by commas."""
        space = SPACE.encode()
        split = [self.unit.findall(b" " + (t.replace(space, b" ") if space in t else t)) if t else [] for t in texts]
        fresh = list(set().union(*split).difference(self.known))
        lookup, start, length, pool, text = self.known, self.start, self.length, self.pool, self.text
        if fresh:
            ids, sizes = self.merge(fresh)
            ends = np.cumsum(sizes)
            digits = list(map(self.digits.__getitem__, ids.tolist()))
            joined = [",".join(digits[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            start, length, pool, text = np.r_[start, len(pool) + ends - sizes], np.r_[length, sizes], np.r_[pool, ids], text + joined
            numbered = zip(fresh, range(len(self.text), len(text)), strict=True)
            if len(text) <= CACHE:
                self.known.update(numbered)
                self.start, self.length, self.pool, self.text = start, length, pool, text
            else:
                lookup = {**self.known, **dict(numbered)}
        slots = [list(map(lookup.__getitem__, units)) for units in split]
        flat = np.fromiter(chain.from_iterable(slots), np.int64, sum(map(len, slots)))
        sizes = length[flat]
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum([len(x) for x in slots])].astype(np.int64)]
        return pool[ragged(start[flat], sizes)], np.diff(ends), [",".join(map(text.__getitem__, x)) for x in slots]

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of some ids: pieces joined, the leading space dropped, broken byte runs replaced."""
        if not self.controls.isdisjoint(ids):
            return self._repaired(ids)
        out = b"".join([self.bytes[i] for i in ids])
        if ids and not self.is_byte[ids[0]] and self.pieces[ids[0]].startswith(SPACE):
            out = out[1:]
        try:
            out.decode("utf-8")
        except UnicodeDecodeError:
            out = self._repaired(ids)
        return out

    def _repaired(self, ids: list[int]) -> bytes:
        out, run, first = [], b"", True
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run, first = run + self.bytes[i], False
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode("utf-8").encode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�".encode())
                    run = run[1:]
            if i is not None and i not in self.controls:
                out.append(self.bytes[i][1:] if first and self.pieces[i].startswith(SPACE) else self.bytes[i])
                first = False
        return b"".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model at ``path``, made once for a Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def parts(data: memoryview, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """The rows' bytes in groups of about ``most`` bytes: the first row's number and the rows."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield k, [bytes(data[offsets[i] : offsets[i + 1]]) for i in range(k, end)]
        k = end


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` (array of int, if ``with_ids``), digests of ids and of the decoded text."""
    from pyspark.sql import types as T

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, texts in parts(data, offsets):
                ids, sizes, digits = own.encode(texts)
                cuts = np.r_[0, np.cumsum(sizes)].tolist()
                listed = ids.tolist()
                decoded = [hashlib.sha256(own.decode(listed[a:b])).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = [batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in digits]), pa.array(decoded)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text``, the decoded ids; null ids count as none."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = [own.decode(x or []).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)
