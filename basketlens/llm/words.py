"""Vectorised words of Arrow text columns.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  All helpers work on one Arrow
batch inside a task, on the column's own buffers: no Python object is made for
a word unless its caller asks for the bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; bounds the memory of a task.
SLICE_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of text each; a longer text stands alone."""
    size = np.diff(_offsets(batch.column(column)))
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()[1]
    if len(column) == 0 or raw is None:
        return np.zeros(len(column) + 1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(raw, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)


class Words:
    """The words of a text column: byte spans, first word of each row, and hashes.

    A null text has no words.  ``first`` has one entry more than there are rows:
    row ``i`` has the words ``first[i]`` up to ``first[i + 1]``.
    """

    def __init__(self, column: pa.Array, fold: bool = False):
        offsets = _offsets(column)
        if column.null_count:  # whatever lies under a null is not text
            column = column.fill_null("")
            offsets = _offsets(column)
        raw = column.buffers()[2] if len(column) else None
        base = int(offsets[0])
        data = np.frombuffer(raw, dtype=np.uint8)[base : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - base
        if fold:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, self.offsets = data, offsets
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        fresh = ~space
        fresh[1:] &= space[:-1] | edge[1:n]
        self.start = np.flatnonzero(fresh)
        last = ~space
        last[:-1] &= space[1:] | edge[1:n]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
        own = (sums[self.end] - sums[self.start]) * _power(_INVERSE, n)[self.start]
        return mix(own + (self.end - self.start).astype(np.uint64))

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words of all ``size``-word windows that lie in one row, and the windows' hashes."""
        hashes = self.hashes() if hashes is None else hashes
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        own = grams(hashes, size)
        ends = np.repeat(self.first[1:], self.counts())[: n - size + 1]
        at = np.flatnonzero(np.arange(n - size + 1) + size <= ends)
        return at, own[at]

    def text(self, a: int, b: int) -> bytes:
        """Words ``a`` up to ``b`` of one row, joined by one space."""
        return b" ".join(self.data[self.start[a] : self.end[b - 1]].tobytes().split()) if b > a else b""


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hashes of all runs of ``size`` consecutive hashes."""
    n = len(hashes) - size + 1
    own = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(size):
        own *= np.uint64(0x2545F4914F6CDD1D)
        own += hashes[j : n + j]
    return mix(own)


def earliest(known: dict, n: int) -> dict:
    """The first ``n`` entries; frequent words are met first, so that these are the ones worth keeping."""
    return dict(itertools.islice(known.items(), n))


_held: dict[str, object] = {}


def held(key: str, make):
    """What a worker keeps from task to task; only the newest is kept."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what earlier tasks of other operators have left in this worker."""
    _held.clear()


class Remembered:
    """Values of distinct words, computed once for each word while a task goes over its texts.

    ``compute`` gets a list of new words (bytes) and returns an array with a row
    for each.  Beyond ``limit`` words the later half is forgotten, which costs time
    but changes no result.
    """

    def __init__(self, compute, limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.index: dict[bytes, int] = {}
        self.rows: np.ndarray | None = None

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words of the texts in order, and how many words each text has."""
        split = [x.encode().split() if x else [] for x in texts]
        words = set().union(*split)
        fresh = [w for w in words if w not in self.index]
        if len(self.index) + len(fresh) > self.limit and self.rows is not None:
            self.index = earliest(self.index, self.limit // 2)
            self.rows = self.rows[: len(self.index)]
            fresh = [w for w in words if w not in self.index]
        if fresh or self.rows is None:
            new = self.compute(fresh)
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            self.rows = new if self.rows is None else np.concatenate([self.rows, new])
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((i for words in split for i in map(self.index.__getitem__, words)), np.int64, int(counts.sum()))
        return self.rows[at], counts


def per_row(values: np.ndarray, counts: np.ndarray, of=np.add) -> np.ndarray:
    """Reduce consecutive values to one for each row; rows without values get 0."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=values.dtype if of is not np.add else np.result_type(values.dtype, np.int64))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = of.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out
