"""SentencePiece encoding and decoding by suffix-array matching.

Texts fall into units between which no piece can reach (a run of word marks and
what follows it).  A task joins the units of a slice that it has not met before
into one byte string, sorts its suffixes, and finds the occurrence range of every
piece of the vocabulary by binary search.  The occurrences are edges; sorted by
where they end, they are relaxed from left to right: an edge extends the
encoding of the prefix before it exactly if the pair of the prefix's last piece
and the edge's piece stays as it is when its text is encoded alone.  For a
merge vocabulary one edge at most fits at each position, which gives the same ids
as applying the merges in order.  Characters without a piece become byte pieces.

Defined results: null text has null ids and decodes to null; empty text has no
ids; repeated rows each get their own result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from basketlens.llm.frames import map_arrow
from basketlens.llm.words import earliest, slices

MARK = "▁"
UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
REMEMBERED = 400_000
PAIRS = 2_000_000
BREAK = b"\xff"  # in no UTF-8 text


class Vocabulary:
    """The pieces of a model file, and the ids of units met so far."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {self.names[i]: -model.get_score(i) for i in plain}
        self.ids = {self.names[i]: i for i in plain}
        if any(len(n) > 1 and ("\n" in n or MARK in n.lstrip(MARK)) for n in self.rank):
            raise ValueError("pieces of this model reach over units")
        whole = sorted(n for n in self.rank if self.merged(n) == [n])
        self.pieces = [n.encode() for n in whole]
        self.whole = whole
        self.head, self.tail = _keys(b"".join(p[:16].ljust(16, b"\0") for p in self.pieces), np.arange(len(whole)) * 16)
        self.sizes = np.array([len(p) for p in self.pieces])
        decoded = [b""] * size
        for i in plain:
            decoded[i] = self.names[i].replace(MARK, " ").encode()
        for byte, i in self.byte_ids.items():
            decoded[i] = bytes([byte])
        self.decoded = decoded
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merges applied to a short text, best rank first, the leftmost of equal ones."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == math.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, a: int, b: int) -> bool:
        """Whether two neighbouring pieces (numbers in ``whole``) stay as they are."""
        found = self.pairs.get(a << 20 | b)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            x, y = self.whole[a], self.whole[b]
            found = self.pairs[a << 20 | b] = self.merged(x + y) == [x, y]
        return found

    def edges(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """End and piece of every occurrence of a piece, by end, longer pieces first."""
        n = len(data)
        head, tail = _keys(data + b"\0" * 16, np.arange(n))
        order = np.lexsort((tail, head))
        head, tail = head[order], tail[order]
        short = np.minimum(self.sizes, 8)
        open_ = np.where(short < 8, (np.uint64(1) << ((8 - short) * 8).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        low = np.searchsorted(head, self.head)
        high = np.searchsorted(head, self.head | open_, side="right")
        starts, which = [], []
        for i in np.flatnonzero(high > low):
            a, b, size = low[i], high[i], self.sizes[i]
            if size > 8:
                rest = np.uint64((1 << (8 * max(0, 16 - int(size)))) - 1)
                a, b = a + np.searchsorted(tail[a:b], self.tail[i]), a + np.searchsorted(tail[a:b], self.tail[i] | rest, side="right")
            own = order[a:b]
            if size > 16:
                own = np.array([s for s in own if data[s : s + size] == self.pieces[i]], dtype=np.int64)
            if len(own):
                starts.append(own)
                which.append(np.full(len(own), i))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, which = np.concatenate(starts), np.concatenate(which)
        ends = starts + self.sizes[which]
        by_end = np.lexsort((-self.sizes[which], ends))
        return ends[by_end], which[by_end]

    def learn(self, units: set[str]) -> None:
        """Encode units that are not known yet."""
        fresh = [u for u in units if u not in self.units]
        if len(self.units) + len(fresh) > REMEMBERED:
            self.units = earliest(self.units, REMEMBERED // 2)
            fresh = [u for u in units if u not in self.units]
        known = self.ids.keys()
        odd = {u: [] for u in fresh if not known >= set(u)}
        for unit in odd:  # merges never reach over a character without a piece
            for same, run in itertools.groupby(unit, known.__contains__):
                odd[unit].extend(["".join(run)] if same else run)
        plain = {u for u in fresh if u not in odd} | {x for parts in odd.values() for x in parts if x[0] in known}
        self._relax([u for u in plain if u not in self.units])
        for unit, parts in odd.items():
            self.units[unit] = b"".join(self.units[x] if x[0] in known else self._bytes(x) for x in parts)

    def _bytes(self, text: str) -> bytes:
        return np.array([self.byte_ids[b] for b in text.encode()], dtype="<i4").tobytes()

    def _relax(self, fresh: list[str]) -> None:
        raw = [u.encode() for u in fresh]
        ends, which = (x.tolist() for x in self.edges(BREAK.join(raw) + BREAK))
        ends.append(1 << 62)
        whole, sizes, ids, stays = self.whole, self.sizes.tolist(), self.ids, self.stays
        at = begin = 0
        for unit, data in zip(fresh, raw, strict=True):
            stop = begin + len(data)
            last = {begin: -1}  # the last piece of the encoding of each prefix
            while (end := ends[at]) <= stop:
                if end not in last:
                    piece = which[at]
                    before = last.get(end - sizes[piece])
                    if before is not None and (before < 0 or stays(before, piece)):
                        last[end] = piece
                at += 1
            found: list[int] = []
            while stop > begin:
                piece = last[stop]
                found.append(ids[whole[piece]])
                stop -= sizes[piece]
            self.units[unit] = np.array(found[::-1], dtype="<i4").tobytes()
            begin += len(data) + 1

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Little-endian 32-bit ids of each text."""
        split = [UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*split))
        return [None if t is None else b"".join(map(self.units.__getitem__, units)) for t, units in zip(texts, split, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.decoded.__getitem__, ids)).decode(errors="replace")[1:]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One for a worker, whose tasks follow each other."""
    return Vocabulary(path)


def _keys(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each position on, and the eight behind them, as numbers that sort like bytes."""
    x = np.frombuffer(data, np.uint8)
    head = np.zeros(len(at), np.uint64)
    tail = np.zeros(len(at), np.uint64)
    for j in range(8):
        head = head << np.uint64(8) | x[at + j]
        tail = tail << np.uint64(8) | x[at + 8 + j]
    return head, tail


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Every row of ``docs`` without its text, with ``ids array<int>``; ``model`` is the path of a public model file."""
    names = [c for c in docs.columns if c not in ("text", "ids")]
    fields = [f"`{c}` {kind}" for c, kind in docs.dtypes if c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in (part for batch in batches for part in slices(batch, "text")):
            blobs = known.encode(batch.column("text").to_pylist())
            flat = pa.array(np.frombuffer(b"".join(b or b"" for b in blobs), dtype="<i4"))
            offsets = np.cumsum([0, *(len(b or b"") // 4 for b in blobs)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([b is None for b in blobs]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), ids], names=[*names, "ids"])

    return map_arrow(docs.select(*names, "text"), run, ", ".join([*fields, "ids array<int>"]))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Every row of ``encoded`` with ``text`` in place of ``ids``."""
    names = [c for c in encoded.columns if c not in ("text", "ids")]
    fields = [f"`{c}` {kind}" for c, kind in encoded.dtypes if c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else known.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return map_arrow(encoded.select(*names, "ids"), run, ", ".join([*fields, "text string"]))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``n_ids``, ``ids_crc32`` and ``same``: whether decoding gives the text again (it does not where the text holds a word mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in (part for batch in batches for part in slices(batch, "text")):
            texts = batch.column("text").to_pylist()
            blobs = known.encode(texts)
            same = [t is None or known.decode(np.frombuffer(b, "<i4").tolist()) == t for t, b in zip(texts, blobs, strict=True)]
            n, crc = [len(b or b"") // 4 for b in blobs], [zlib.crc32(b or b"") for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "same"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_ids long, ids_crc32 long, same boolean")


def query(spark, folder):
    """``op2``: every document encoded and decoded again."""
    return round_trip(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
