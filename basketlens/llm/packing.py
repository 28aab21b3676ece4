"""Best-fit packing of token pieces into sequences by bin completion.

Spark tokenises, counts and places; the driver only sees a histogram of piece
lengths, which has at most ``capacity`` entries however large the corpus is.
:func:`bin_completion` turns the histogram into fillings with multiplicities.
Each piece then finds its place from its rank among the pieces of its length:
no task and no driver ever holds the pieces of one length together.

Defined results: a null or empty text is one piece with the closing id alone;
equal rows are packed as often as they occur; an empty table packs to nothing;
other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.frames import kept, map_arrow, texts
from basketlens.llm.words import earliest, held, slices

CAPACITY = 2048
#: Distinct words whose ids a worker remembers; more only cost time.
REMEMBERED = 800_000
#: Nodes of the search for one filling before the best one so far is taken; more are spent only while the plan is above the lower bound.
NODES = (400, 1600, 6400)
#: Pieces of one length that one group ranks, on average at most.
RANK_ROWS = 5_000

#: A full stop or comma that ends a word is a token of its own: set apart, words recur more often.
STOP = re.compile(rb"(?<=[A-Za-z])[.,](?=[ \n])")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Little-endian 32-bit ids of white-space-free chunks, filled as chunks are met.

    The tokenizer turns white space into plain breaks, so that a text's ids are
    those of its chunks, one after the other.  A text that spells out a special
    token, which may reach over chunks, goes to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")

    def learn(self, words: set[bytes]) -> None:
        fresh = words.difference(self)
        if len(self) + len(fresh) > REMEMBERED:
            first = earliest(self, REMEMBERED // 2)
            self.clear()
            self.update(first)
            fresh = words.difference(self)
        fresh = list(fresh)
        for word, one in zip(fresh, self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False), strict=True):
            self[word] = np.array(one.ids, dtype="<u4").tobytes()

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Of each text; words are learnt for all of them together."""
        whole = {i for i, x in enumerate(texts) if x and self.special.search(x)}
        split = [STOP.sub(rb" \g<0>", x.encode()).split() if x and i not in whole else [] for i, x in enumerate(texts)]
        self.learn(set().union(*split))
        for i, words in enumerate(split):
            if i in whole:
                yield np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                yield b"".join(map(self.__getitem__, words))


def word_ids(path: str) -> WordIds:
    """One for a worker, whose tasks follow each other."""
    return held(f"word ids {path}", lambda: WordIds(path))


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document, closed by id 0.

    Returns ``doc_id, piece, start, length, ids_crc32`` and, with ``ids``, the
    piece's ids as ``ids array<int>``.  ``tokenizer`` is the path of a public
    word-level tokenizer file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        for batch in (part for batch in batches for part in slices(batch, "text")):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            blobs: list[bytes] = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), known.ids(batch.column("text").to_pylist()), strict=True):
                blob = own + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at : at + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if ids:
                        blobs.append(part)
            columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
            if ids:
                flat = pa.array(np.frombuffer(b"".join(blobs), dtype="<i4"))
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(b) // 4 for b in blobs)]), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, names=[*out, *["ids"] * ids])

    return map_arrow(texts(docs), run, PIECES + ", ids array<int>" * ids)


def complete(lengths: list[int], counts: dict[int, int], room: int, nodes: int) -> list[int]:
    """The fullest found filling of ``room`` from the lengths at hand, larger items first.

    Branch and bound over undominated fillings.  The greedy best fit is the first
    incumbent.  Items are tried from large to small; of the items behind which
    nothing more fits only the largest is tried, as it dominates the others.  A
    branch is left when all smaller items together could not fill its room better
    than the incumbent does.
    """
    best: list[int] = []
    left = room
    free = dict[int, int]()
    at = bisect.bisect_right(lengths, left)
    while at and left:  # best fit
        size = lengths[at - 1]
        if free.get(size, 0) < counts[size]:
            free[size] = free.get(size, 0) + 1
            best.append(size)
            left -= size
            at = bisect.bisect_right(lengths, min(left, size))
        else:
            at -= 1
    waste = left
    if not waste or not lengths:
        return best
    below = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) * np.array([counts[x] for x in lengths]))]).tolist()
    used: dict[int, int] = {}

    def branch(top: int, left: int, chosen: list[int]) -> None:
        nonlocal best, waste, nodes
        if left < waste:
            best, waste = list(chosen), left
        at = bisect.bisect_right(lengths, left, 0, top)
        while at and waste and nodes > 0 and left - below[at] < waste:
            size = lengths[at - 1]
            if counts[size] > used.get(size, 0):
                nodes -= 1
                used[size] = used.get(size, 0) + 1
                chosen.append(size)
                branch(at, left - size, chosen)
                chosen.pop()
                used[size] -= 1
                if left - size < lengths[0]:  # smaller ones are dominated
                    break
            at -= 1

    branch(len(lengths), room, [])
    return best


def _plan(histogram: dict[int, int], capacity: int, nodes: int, most: float) -> list[tuple[list[int], int]] | None:
    """Fillings with multiplicities, or None as soon as they need ``most`` sequences or more."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(counts)
    plan: list[tuple[list[int], int]] = []
    total = sum(k * n for k, n in counts.items())
    waste = 0
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        rest = complete(lengths, counts, capacity - top, nodes)
        counts[top] += 1
        filling = [top, *rest]
        need = {x: filling.count(x) for x in set(filling)}
        times = min(counts[x] // n for x, n in need.items())
        plan.append((filling, times))
        waste += times * (capacity - sum(filling))
        if -(-(total + waste) // capacity) >= most:  # what is wasted cannot be won back
            return None
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
                lengths.pop(bisect.bisect_left(lengths, x))
    return plan


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Fillings (lengths, larger first) with multiplicities that use up a histogram of lengths.

    The largest length left is completed again and again; a filling is repeated
    as often as the counts allow, so that every step uses up some length.  The plan
    of best fit alone is the first incumbent.  Searches with more and more nodes
    follow until the lower bound (all tokens, or the pieces of more than half a
    sequence) is reached; each is left as soon as its waste is as large as the
    incumbent's.
    """
    halves = sum(n for k, n in histogram.items() if 2 * k > capacity)
    bound = max(-(-sum(k * n for k, n in histogram.items()) // capacity), halves)
    best = _plan(histogram, capacity, 0, math.inf)
    for nodes in NODES:
        n = sum(times for _, times in best)
        if n <= bound:
            break
        best = _plan(histogram, capacity, nodes, n) or best
    return best


def places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequences and offsets of its runs of places."""
    out: dict[int, list[list[int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for filling, times in plan:
        offset = 0
        for size in filling:
            rank = ranks.get(size, 0)
            out.setdefault(size, []).append([rank, first, offset])
            ranks[size] = rank + times
            offset += size
        first += times
    return {k: tuple(np.array(v, dtype=np.int64).T) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of ``pieces`` (with ``length``) its ``sequence_id`` and ``offset``.

    Lengths must lie in 1..capacity.  Sequences are gapless from offset 0.
    """
    names = pieces.columns
    rows = kept(pieces)
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = places(bin_completion(histogram, capacity))
    buckets = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    order = [c for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    group = Window.partitionBy("length", "__bucket")
    ranked = dealt.withColumn("__rank", F.row_number().over(group.orderBy(*order)).cast("long") - 1)
    sizes = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("length").alias("__length"), F.col("__bucket").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    joined = ranked.join(starts, (F.col("length") == F.col("__length")) & (F.col("__bucket") == F.col("__of"))).withColumn("__rank", F.col("__rank") + F.col("__before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                ranks, first, offsets = found[int(size)]
                run_of = np.searchsorted(ranks, rank[own], side="right") - 1
                sequence[own] = first[run_of] + rank[own] - ranks[run_of]
                offset[own] = offsets[run_of]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return map_arrow(joined.select(*names, "__rank"), run, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Tokenise documents and pack their pieces into as few sequences as bin completion finds."""
    return pack(tokenize(docs, tokenizer, capacity, ids), capacity)


def query(spark, folder):
    """``op10``: every document of the table, packed."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)
