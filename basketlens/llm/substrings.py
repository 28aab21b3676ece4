"""Substring dedup with suffix automata over words.

A window is ``length`` consecutive words.  A word goes if a window that covers it
also starts in a document with a smaller id; windows are judged on the input.

*Against a bounded reference* (:func:`remove_reference`) the reference is cut into
shards, each shard's suffix automaton is broadcast, and documents are streamed
through all of them: where the matching statistic (the longest match that ends at
a word) reaches ``length``, the maximal spans are removed.

*Against the corpus itself* (:func:`dedup`) the reference grows with the input, so
that its automata are not broadcast but meet the documents where both can match:

1. The minimum of the hashed four-word runs of a window (its anchor) is the same
   wherever the window occurs.  Anchors that occur in one document only are
   dropped: no window of theirs repeats.
2. Runs of windows with one anchor are segments.  Equal segments of a task's
   documents count once, with the smallest id; the others' windows go at once.
3. Segments are dealt by anchor.  In each anchor's shard they are taken by document
   id: a segment is first streamed through the automaton of the segments of
   smaller ids, then added to it.  Windows of anchors that a fixed share of all
   documents has (a bounded list) are dealt by window instead, so that no anchor
   becomes a hot group.
4. The windows found are joined to their documents, whose covered words go.

Anchors are hashes and only choose candidates; all matches are of words.

Defined results: null text has no words and stays null; a null ``doc_id`` is larger
than any other; rows of one ``doc_id`` are not smaller than each other, so repeated
rows of one id all stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.frames import NO_ID, deal, kept, map_arrow, partitions
from basketlens.llm.words import Words, grams, mix, slices

ANCHOR_WORDS = 4
#: Anchors or segments that a task gathers before it hands them on.
GATHERED = 1_500_000
SEGMENTS = 250_000
#: An anchor is hot if it is in one of so many documents, and in more than the least number.
HOT_SHARE, HOT_LEAST = 1000, 2000
#: Words of a broadcast reference, and of one of its shards.
REFERENCE_WORDS, SHARD_WORDS = 5_000_000, 250_000


class WordAutomaton:
    """Suffix automaton of sequences of words; a match never reaches over two sequences."""

    def __init__(self):
        self.moves: list[dict[bytes, int]] = [{}]
        self.links, self.lengths = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        moves, links, lengths = self.moves, self.links, self.lengths
        last = 0
        for w in words:
            q = moves[last].get(w)
            if q is not None:
                if lengths[q] == lengths[last] + 1:
                    last = q
                    continue
                last = self._clone(last, w, q)
                continue
            new = len(moves)
            moves.append({})
            links.append(0)
            lengths.append(lengths[last] + 1)
            p = last
            while p >= 0 and w not in moves[p]:
                moves[p][w] = new
                p = links[p]
            if p >= 0:
                q = moves[p][w]
                links[new] = q if lengths[q] == lengths[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        moves, links, lengths = self.moves, self.links, self.lengths
        copy = len(moves)
        moves.append(dict(moves[q]))
        links.append(links[q])
        lengths.append(lengths[p] + 1)
        links[q] = copy
        while p >= 0 and moves[p].get(w) == q:
            moves[p][w] = copy
            p = links[p]
        return copy

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """For each word the length of the longest match that ends with it."""
        moves, links, lengths = self.moves, self.links, self.lengths
        state = n = 0
        for w in words:
            while (to := moves[state].get(w)) is None and state:
                state = links[state]
                n = lengths[state]
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield n


def _anchors(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, row and anchor of every window."""
    hashes = w.hashes()
    runs = min(ANCHOR_WORDS, length)
    n = len(hashes) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64)
    low, width, want = grams(hashes, runs), 1, length - runs + 1
    while width < want:  # minima of 1, 2, 4, ... neighbours, and of the rest
        step = min(width, want - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    ends = np.repeat(w.first[1:], w.counts())[:n]
    at = np.flatnonzero(np.arange(n) + length <= ends)
    return at, np.searchsorted(w.first, at, side="right") - 1, low[at]


_DOC = np.dtype([("id", "<i8"), ("hash", "<i8")])


class _Gathered:
    """Anchors of a task's documents, one entry for each and the documents that share it."""

    def __init__(self, buckets: int):
        self.buckets, self.n, self.parts = buckets, 0, []

    def add(self, anchors: np.ndarray, docs: np.ndarray) -> bool:
        self.parts.append((anchors, docs))
        self.n += len(anchors)
        return self.n >= GATHERED

    def flush(self) -> list[tuple[int, bool, bytes]]:
        """Bucket, whether it is of documents, and blob: entries by anchor, and by document the anchors that several of the task have."""
        if not self.n:
            return []
        anchors, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.n, self.parts = 0, []
        order = np.lexsort((docs["hash"], docs["id"], anchors))
        a, d = anchors[order], docs[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(a)))
        several = d != d[first][group]  # texts of one id too: a smaller id may be in another task
        shared = (np.bincount(group, several) > 0)[group]
        rows = [(bucket, True, blob) for bucket, blob in _by_doc(a[shared], d[shared], self.buckets)]
        for bucket, part in _by_bucket(a[first], self.buckets):
            i = first[part]
            rows.append((bucket, False, np.array([len(i)], np.int64).tobytes() + a[i].tobytes() + d[i].tobytes() + count[part].astype(np.int32).tobytes()))
        return rows


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(own):
            yield int(bucket[own[0]]), own


def _by_doc(anchors: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Anchors and their documents, packed by a bucket of documents."""
    keys = mix((docs["id"] ^ docs["hash"]).view(np.uint64)) if len(docs) else np.zeros(0, np.uint64)
    for bucket, own in _by_bucket(keys, buckets):
        table, index = np.unique(docs[own], return_inverse=True)
        yield bucket, np.array([len(own)], np.int64).tobytes() + anchors[own].tobytes() + index.astype(np.uint32).tobytes() + table.tobytes()


def _blobs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "by_doc": pa.bool_(), "blob": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, names, strict=True)], names=names)


def repeated_anchors(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """``bucket, blob``: packed anchors of documents that others have too, by a bucket of documents; bucket -1 lists hot anchors."""
    buckets = partitions(docs.sparkSession)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(buckets)
        for batch in (part for batch in batches for part in slices(batch, "text")):
            w = Words(batch.column("text"))
            _, row, anchor = _anchors(w, length)
            new = np.ones(len(row), bool)  # neighbours mostly share their anchor
            new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
            doc = np.zeros(w.rows, _DOC)
            doc["id"], doc["hash"] = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash"))
            if gathered.add(anchor[new], doc[row[new]]):
                yield _blobs(gathered.flush(), ["bucket", "by_doc", "blob"])
        yield _blobs(gathered.flush(), ["bucket", "by_doc", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, docs, counts = [np.zeros(0, np.uint64)], [np.zeros(0, _DOC)], [np.zeros(0, np.int32)]
        out = []
        for batch in batches:
            for bucket, by_doc, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "by_doc", "blob")), strict=True):
                if by_doc:
                    out.append((bucket, blob))
                    continue
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                anchors.append(np.frombuffer(blob, np.uint64, n, 8))
                docs.append(np.frombuffer(blob, _DOC, n, 8 + 8 * n))
                counts.append(np.frombuffer(blob, np.int32, n, 8 + 24 * n))
        a, d, c = np.concatenate(anchors), np.concatenate(docs), np.concatenate(counts)
        order = np.argsort(a, kind="stable")
        a, d, c = a[order], d[order], c[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        if len(a):
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            own = np.flatnonzero((np.diff(np.append(first, len(a))) > 1)[group])
            out.extend(_by_doc(a[own], d[own], buckets))
            often = a[first][np.add.reduceat(c.astype(np.int64), first) >= hot]
            if len(often):
                out.append((-1, often.tobytes()))
        yield _blobs(out, ["bucket", "blob"])

    posted = map_arrow(docs.select("id", "hash", "text"), post, "bucket int, by_doc boolean, blob binary")
    return map_arrow(deal(posted, "bucket"), meet, "bucket int, blob binary")


def anchor_lists(repeated: DataFrame) -> DataFrame:
    """``id, hash, anchors``: the repeated anchors of each document, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, docs = [np.zeros(0, np.uint64)], [np.zeros(0, _DOC)]
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                anchors.append(np.frombuffer(blob, np.uint64, n, 8))
                docs.append(np.frombuffer(blob, _DOC, -1, 8 + 12 * n)[np.frombuffer(blob, np.uint32, n, 8 + 8 * n)])
        a, d = np.concatenate(anchors), np.concatenate(docs)
        order = np.lexsort((a, d["hash"], d["id"]))
        a, d = a[order], d[order]
        cuts = np.flatnonzero(d[1:] != d[:-1]) + 1 if len(a) else np.zeros(0, np.int64)
        heads = d[np.append(0, cuts)] if len(a) else d
        lists = [np.unique(x).tobytes() for x in np.split(a, cuts)] if len(a) else []
        yield pa.RecordBatch.from_arrays([pa.array(heads["id"]), pa.array(heads["hash"]), pa.array(lists, pa.binary())], names=["id", "hash", "anchors"])

    return map_arrow(deal(repeated, "bucket"), run, "id long, hash long, anchors binary")


FOUND = "key long, id long, hash long, words binary, starts binary"
_FOUND = ["key", "id", "hash", "words", "starts"]
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _rows(rows: list[tuple], names: list[str] = _FOUND, types: tuple = _TYPES) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def segments(docs: DataFrame, length: int, hot: frozenset[int]) -> DataFrame:
    """``key, id, hash, words, starts``: segments of repeated anchors, or, with null words, windows that go at once.

    ``docs`` has ``id, hash, text`` and ``anchors``; ``hot`` is a bounded list.
    """
    often = np.array(sorted(hot), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        gone: list[tuple] = []

        def drop(key: int, doc: tuple[int, int], starts: list[int], count: int) -> None:
            found = (np.array(starts, np.int32)[:, None] + np.arange(count, dtype=np.int32)).ravel()
            gone.append((doc[0] ^ doc[1], *doc, None, found.tobytes()))

        def out() -> pa.RecordBatch:
            rows = [(key, *doc, words, np.array(starts, np.int32).tobytes()) for words, (key, held) in seen.items() for doc, starts in held.items()]
            rows += gone
            seen.clear()
            gone.clear()
            return _rows(rows)

        for batch in (part for batch in batches for part in slices(batch, "text")):
            w = Words(batch.column("text"))
            at, row, anchor = _anchors(w, length)
            hashes = None
            ids, hs, lists = (batch.column(c).to_pylist() for c in ("id", "hash", "anchors"))
            bounds = np.searchsorted(row, np.arange(w.rows + 1))
            for i in range(w.rows):
                a, b = bounds[i], bounds[i + 1]
                if a == b or not lists[i]:
                    continue
                wanted = np.frombuffer(lists[i], np.uint64)
                own = anchor[a:b]
                use = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
                if not use.any():
                    continue
                single = np.isin(own, often) if len(often) else np.zeros(b - a, bool)
                border = np.ones(b - a, bool)
                border[1:] = (own[1:] != own[:-1]) | single[1:]
                starts = np.flatnonzero(border)
                stops = np.append(starts[1:], b - a)
                pick = use[starts]
                doc = (ids[i], hs[i])
                base = int(w.first[i])
                words = w.data[w.start[base] : w.end[int(w.first[i + 1]) - 1]].tobytes().split()
                if single.any() and hashes is None:
                    hashes = w.hashes()
                for s, e in zip(starts[pick].tolist(), stops[pick].tolist(), strict=True):
                    first = int(at[a + s]) - base
                    text = b" ".join(words[first : first + e - s - 1 + length])
                    if single[s]:
                        key = int(grams(hashes[base + first : base + first + length], length)[0].astype(np.int64))
                    else:
                        key = int(own[s].astype(np.int64))
                    held = seen.get(text)
                    if held is None:
                        seen[text] = (key, {doc: [first]})
                        continue
                    holders = held[1]
                    least = next(iter(holders))[0]
                    if doc[0] > least:
                        drop(key, doc, [first], e - s)
                    elif doc[0] == least:
                        holders.setdefault(doc, []).append(first)
                    else:
                        for other, places in holders.items():
                            drop(key, other, places, e - s)
                        seen[text] = (key, {doc: [first]})
            if len(seen) >= SEGMENTS or len(gone) >= SEGMENTS:
                yield out()
        yield out()

    return map_arrow(docs, run, FOUND)  # all columns, so that the shuffle of texts is that of the last join


def matched(found: DataFrame, length: int) -> DataFrame:
    """``id, hash, starts``: windows (first words) of each document that start in a document of smaller id too."""

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        """The windows of one anchor's segments, sorted by document id."""
        least: dict[bytes, int] = {}
        for i, _, words, _ in rows:
            least.setdefault(words, i)
        automaton, added, flags = (WordAutomaton(), [], {}) if len(least) > 1 else (None, [], {})
        for i, h, words, starts in rows:
            places = np.frombuffer(starts, np.int32)
            n = words.count(b" ") + 2 - length
            if least[words] < i:
                hit = np.arange(n, dtype=np.int32)
            elif automaton is None:
                continue
            else:
                if added and added[0][0] < i:  # what has been held back is of smaller ids now
                    for _, split in added:
                        automaton.add(split)
                    added = []
                if words not in flags:
                    split = words.split(b" ")
                    flags[words] = np.array([k - length + 1 for k, m in enumerate(automaton.matches(split)) if m >= length], np.int32)
                    added.append((i, split))
                hit = flags[words]
            if len(hit):
                yield i, h, (places[:, None] + hit).ravel().astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for k, i, h, words, starts in zip(*(batch.column(c).to_pylist() for c in _FOUND), strict=True):
                if words is None:
                    out.append((i, h, starts))
                    continue
                if k != key:
                    out.extend(shard(rows))
                    key, rows = k, []
                rows.append((i, h, words, starts))
            if len(out) > 20_000:
                yield _rows(out, ["id", "hash", "starts"], (pa.int64(), pa.int64(), pa.binary()))
                out = []
        out.extend(shard(rows))
        yield _rows(out, ["id", "hash", "starts"], (pa.int64(), pa.int64(), pa.binary()))

    dealt = deal(found, "key").sortWithinPartitions("key", "id", "hash")
    return map_arrow(dealt, run, "id long, hash long, starts binary")


def _covered(w: Words, i: int, starts: np.ndarray, length: int) -> np.ndarray:
    n = int(w.first[i + 1] - w.first[i])
    edge = np.zeros(n + 1, np.int64)
    if len(starts):
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """A text without some words; a removed run takes the white space behind it along."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(raw[at : starts[a]])
        at = starts[b] if b < len(starts) else len(raw)
    return b"".join([*out, raw[at:]])


def _cut(docs: DataFrame, starts_of, length: int, texts: bool) -> DataFrame:
    """Remove covered words; ``starts_of`` gives the windows (first words) of each row of a batch."""
    drop = {"id", "hash", "windows", "n_words", "n_removed", "kept_sha256"}
    names = [c for c in docs.columns if c not in drop and (texts or c != "text")]
    fields = [f"`{c}` {kind}" for c, kind in docs.dtypes if c in names]
    more = [("n_words", pa.int64()), ("n_removed", pa.int64()), *([] if texts else [("kept_sha256", pa.string())])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = starts_of()
        for batch in (part for batch in batches for part in slices(batch, "text")):
            column = batch.column("text")
            w = Words(column)
            removed, digests, new = [], [], column.to_pylist() if texts else []
            for i, starts in enumerate(find(batch, w)):
                gone = _covered(w, i, starts, length)
                removed.append(int(gone.sum()))
                a, b = int(w.first[i]), int(w.first[i + 1])
                if texts and removed[-1]:
                    raw = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                    new[i] = _without(raw, w.start[a:b] - w.offsets[i], w.end[a:b] - w.offsets[i], gone).decode()
                elif not texts:
                    words = w.data[w.start[a] : w.end[b - 1]].tobytes().split() if b > a else []
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            columns = {c: batch.column(c) for c in names}
            if texts:
                columns["text"] = pa.array(new, pa.string())
            counts = [pa.array(w.counts(), pa.int64()), pa.array(removed, pa.int64()), *([] if texts else [pa.array(digests, pa.string())])]
            yield pa.RecordBatch.from_arrays([*columns.values(), *counts], names=[*names, *(c for c, _ in more)])

    return map_arrow(docs, run, ", ".join([*fields, *(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in more)]))


def dedup(docs: DataFrame, length: int = 50, texts: bool = True) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text`` and others) without the words that windows of smaller ids repeat.

    Adds ``n_words`` and ``n_removed``.  With ``texts`` the text is what is left, white
    space included; else it is replaced by ``kept_sha256``, the digest of the kept
    words joined by one space.
    """
    rows = docs.drop("id", "hash", "anchors", "windows").withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "hash": F.xxhash64("text")})
    hot = max(HOT_LEAST, rows.count() // HOT_SHARE)
    repeated = kept(repeated_anchors(rows, length, hot))
    often = frozenset(x for r in repeated.filter("bucket < 0").select("blob").collect() for x in np.frombuffer(r["blob"], np.uint64).tolist())
    lists = anchor_lists(repeated.filter("bucket >= 0"))
    picked = rows.join(lists.hint("shuffle_hash"), ["id", "hash"])
    found = matched(segments(picked, length, often), length)
    windows = found.groupBy("id", "hash").agg(F.collect_list("starts").alias("windows"))
    joined = rows.join(windows.hint("shuffle_hash"), ["id", "hash"], "left").select(*rows.columns, "windows")

    def starts_of():
        return lambda batch, w: (np.unique(np.frombuffer(b"".join(x or ()), np.int32)) for x in batch.column("windows").to_pylist())

    return _cut(joined, starts_of, length, texts)


def remove_reference(docs: DataFrame, reference: DataFrame, length: int = 50, texts: bool = True) -> DataFrame:
    """Every row of ``docs`` without the words of windows that also stand in ``reference`` (a ``text`` column).

    The reference must not have more than ``REFERENCE_WORDS`` words, which is checked;
    its shards' automata are broadcast.
    """
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    n = reference.filter("text is not null").agg(F.sum(words)).first()[0] or 0
    if n > REFERENCE_WORDS:
        raise ValueError(f"the reference has {n} words; automata of at most {REFERENCE_WORDS} are broadcast")
    shards, size = [WordAutomaton()], 0
    for r in reference.filter("text is not null").select("text").collect():
        own = r["text"].encode().split()
        if size + len(own) > SHARD_WORDS and size:
            shards.append(WordAutomaton())
            size = 0
        shards[-1].add(own)
        size += len(own)
    shared = docs.sparkSession.sparkContext.broadcast(shards)

    def starts_of():
        automata = shared.value

        def find(batch: pa.RecordBatch, w: Words) -> Iterator[np.ndarray]:
            for text in batch.column("text").to_pylist():
                own = (text or "").encode().split()
                yield np.unique(np.array([k - length + 1 for a in automata for k, m in enumerate(a.matches(own)) if m >= length], np.int64))

        return find

    return _cut(docs, starts_of, length, texts)


def query(spark, folder):
    """``op3``: every document without the words of 13-word windows that smaller ids have too."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return dedup(docs, 13, texts=False)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') END AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)
), m AS (SELECT g, min(doc_id) AS least FROM v GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM v JOIN m USING (g), (SELECT unnest(range(0, 13)) AS k) WHERE least < doc_id),
x AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM r GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(y.word, ' ' ORDER BY y.p) FROM (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p) y WHERE NOT list_contains(ps, y.p)), '') END) AS kept_sha256
FROM t LEFT JOIN x USING (doc_id)
"""
