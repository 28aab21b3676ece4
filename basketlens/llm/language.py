"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text is built.  A text is cut
greedily into the longest phrases that occur in the automaton's text; the
language that needs the fewest phrases, weighted by the bits that a phrase of its
reference takes, wins.  Case and what is between words do not count: a text is its
runs of letters, one blank apart, in units that end with a line or sentence, where
phrases end too; within a unit phrases run over words.  All units of a slice are
parsed together, one character of each at a time.

Models learn from a bounded, documented sample: whole labelled texts, one row for
each text, in the order of their hashes, at most ``LEARN_ROWS`` for each language and
as many as fit into ``LEARN_CHARS`` characters of all languages together.

Defined results: ``und`` with score 0 for a null text or one without a letter;
no labelled rows at all give ``und`` everywhere; of equally good languages the
first by name wins; repeated rows each get their own result.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.frames import held_out, map_arrow
from basketlens.llm.words import held, per_row, slices

LEARN_ROWS = 60
LEARN_CHARS = 320_000
#: The most frequent letters have a column of each transition table; transitions on all others are looked up in a sorted list.
COMMON = 62
#: Numerals that are no digits, such as fractions and superscripts, count as word characters but are no letters.
NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
AS_BLANK = str.maketrans(dict.fromkeys(NUMERALS, " "))
LETTERS = re.compile(r"[^\W\d_]+")
ENDS = re.compile(r"[.!?\n]+")
#: Of each character of a lower-case text: whether it is a letter or ends a unit.
LETTER, END = 1, 2
KINDS = np.zeros(0x110000, np.uint8)
KINDS[[ord(c) for c in map(chr, range(0x110000)) if c.isalpha()]] = LETTER
KINDS[[ord(c) for c in ".!?\n"]] = END
#: Texts are cut into units in blocks of this many characters, or of one longer unit.
BLOCK = 1 << 21
#: Longer units are parsed in runs of this many characters, so that a few long ones do not decide how many steps all take.
RUN = 256


def units(text: str) -> list[str]:
    """The letters of a text's sentences and lines, words one blank apart."""
    if not NUMERALS.isdisjoint(text):
        text = text.translate(AS_BLANK)
    return [f" {' '.join(own)} " for part in ENDS.split(text.lower()) if (own := LETTERS.findall(part))]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class SuffixAutomaton:
    """Substrings of a reference text, as transitions (state, character, next state)."""

    def __init__(self, text: str):
        moves, links, lengths, last = [{}], [-1], [0], 0
        for c in map(ord, text):
            new = len(moves)
            moves.append({})
            links.append(0)
            lengths.append(lengths[last] + 1)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = links[p]
            if p >= 0:
                q = moves[p][c]
                if lengths[q] == lengths[p] + 1:
                    links[new] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    links.append(links[q])
                    lengths.append(lengths[p] + 1)
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = links[p]
                    links[q] = links[new] = copy
            last = new
        self.moves = np.array([(s, c, t) for s, own in enumerate(moves) for c, t in own.items()], np.int32).reshape(-1, 3)
        self.states = len(moves)
        self.bits = math.log2(len(text) + 2)

    def table(self, alphabet: np.ndarray, root: int, out: np.ndarray) -> None:
        """Fill in the next state by state and number of a character in ``alphabet``, states counted from ``root``; 0 stays where there is none."""
        at, known = _places(alphabet, self.moves[:, 1])
        out[self.moves[known, 0], at[known] + 1] = self.moves[known, 2] + root

    def others(self, rest: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
        """Transitions on the characters of ``rest``: sorted keys (state times their number, plus that of the character) and next states."""
        at, known = _places(rest, self.moves[:, 1])
        keys = (self.moves[known, 0].astype(np.int64) + root) * len(rest) + at[known]
        order = np.argsort(keys)
        return keys[order], self.moves[known, 2][order] + root


def _places(alphabet: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters stand in a sorted alphabet, and which of them do."""
    if not len(alphabet):
        return np.zeros(len(chars), np.int64), np.zeros(len(chars), bool)
    at = np.minimum(np.searchsorted(alphabet, chars), len(alphabet) - 1)
    return at, alphabet[at] == chars


class Parser:
    """Cross-parses units against the automata of all languages."""

    def __init__(self, automata: list[SuffixAutomaton]):
        seen = np.concatenate([a.moves[:, 1] for a in automata] or [np.zeros(0, np.int32)])
        chars, n = np.unique(seen, return_counts=True)
        by_count = chars[np.argsort(-n, kind="stable")]
        alphabet, self.rest = np.sort(by_count[: COMMON + 1]), np.sort(by_count[COMMON + 1 :])
        self.unknown = len(alphabet) + 1
        # of a character: common ones, one number for all unknown ones, the rest
        self.number = np.full(0x110000, self.unknown, np.uint8 if not len(self.rest) else np.uint16 if len(chars) < 65_000 else np.int32)
        self.number[alphabet] = np.arange(1, len(alphabet) + 1)
        self.number[self.rest] = self.unknown + 1 + np.arange(len(self.rest))
        # states of all automata in one table, one after the other
        *self.roots, states = itertools.accumulate((a.states for a in automata), initial=0)
        self.width = len(alphabet) + 2
        table = np.zeros((states, self.width), np.int32)
        for a, root in zip(automata, self.roots, strict=True):
            a.table(alphabet, root, table[root : root + a.states])
        self.flat = table.ravel()
        others = [a.others(self.rest, root) for a, root in zip(automata, self.roots, strict=True)]
        self.others = [np.concatenate(x) for x in zip(*others, strict=True)]

    def _next(self, state: np.ndarray | int, c: np.ndarray, rare: bool) -> np.ndarray:
        """Next states, 0 where there is none; ``rare`` if some characters may be of the rest."""
        to = self.flat.take(np.multiply(state, self.width, dtype=np.int64) + (np.minimum(c, self.unknown) if rare else c))
        if rare and len(rows := np.flatnonzero(c > self.unknown)):
            keys, targets = self.others
            own = state if np.ndim(state) == 0 else state[rows]
            place, found = _places(keys, np.multiply(own, len(self.rest), dtype=np.int64) + c[rows] - (self.unknown + 1))
            to[rows[found]] = targets[place[found]]
        return to

    def _step(self, state: np.ndarray, root: np.ndarray | int, c: np.ndarray, rare: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next states where a phrase that cannot go on gives way to a new one; where that is, and how many phrases end there."""
        to = self._next(state, c, rare)
        cut = (to == 0).nonzero()[0]
        begin = root if np.ndim(root) == 0 else root[cut]
        again = self._next(begin, c[cut], rare)
        lost = again == 0
        to[cut] = np.where(lost, begin, again)
        return to, cut, (state[cut] != begin).astype(np.int32) + lost

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``units`` makes of texts, as numbers of characters one unit after the other: these, sizes of units, and units of each text."""
        lower = [(x if x.isascii() or NUMERALS.isdisjoint(x) else x.translate(AS_BLANK)).lower() if x else "" for x in texts]
        whole = "\n".join([*lower, ""])  # the end of a text is one of a unit
        parts, at = [(np.zeros(0, self.number.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        while at < len(whole):  # in blocks of whole units, for the sake of memory
            to = max(whole.rfind(c, at, at + BLOCK) for c in ".!?\n") + 1 or ENDS.search(whole, at).end()
            data, size, begins = self._units(_code_points(whole[at:to]))
            parts.append((data, size, begins + at))
            at = to
        data, size, begins = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum([len(x) + 1 for x in lower])
        return data, size, np.diff(np.searchsorted(begins, ends), prepend=0)

    def _units(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of lower-case characters: their own characters' numbers, sizes, and where each one's first letter is."""
        kind = KINDS[chars]
        letter, stops = kind == LETTER, np.flatnonzero(kind == END)
        edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        first, size = edges[::2], np.diff(edges)[::2]  # of words
        fresh = np.diff(np.searchsorted(stops, first), prepend=-1) > 0  # words that begin a unit
        # a blank before each word and one after each unit; the first word follows no unit
        place = np.cumsum(size + 1) - size + np.cumsum(fresh) - 1
        begins = np.flatnonzero(fresh)
        total = int(size.sum()) + len(size) + len(begins)
        turns = np.zeros(total + 1, np.int8)
        turns[place] = 1
        turns[place + size] = -1
        data = np.full(total, self.number[32], self.number.dtype)
        data[np.cumsum(turns[:-1], dtype=np.int8).view(bool)] = self.number[chars[letter]]
        return data, np.diff(place[begins] - 1, append=total), first[begins]

    def phrases(self, own: list[str]) -> np.ndarray:
        """Into how many longest matches each unit falls, by language; an unknown character is one of its own."""
        return self.parse(self.number[_code_points("".join(own))], np.array([len(x) for x in own], np.int64))

    def parse(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``phrases`` of units whose characters' numbers stand in ``data`` one unit after the other.

        The few units with uncommon characters are parsed by themselves, so that the others need no look-ups.
        """
        start = np.cumsum(size) - size
        if not len(self.rest):
            return self._parse(data, start, size, False)
        rare = np.bincount(np.repeat(np.arange(len(size)), size)[data > self.unknown], minlength=len(size)) > 0
        out = np.zeros((len(size), len(self.roots)), np.int32)
        for kind in (False, True):
            if len(rows := np.flatnonzero(rare == kind)):
                out[rows] = self._parse(data, start[rows], size[rows], kind)
        return out

    def _parse(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, rare: bool) -> np.ndarray:
        """Units are cut into runs, which are parsed side by side as if a phrase began with each, and then joined."""
        runs = -(-size // RUN)
        unit = np.repeat(np.arange(len(size)), runs)
        before = RUN * (np.arange(len(unit)) - np.repeat(np.cumsum(runs) - runs, runs))
        first, start, size = before == 0, start[unit] + before, np.minimum(size[unit] - before, RUN)
        order = np.argsort(-size, kind="stable")
        still = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")  # runs longer than each step
        steps = [data[start[order[:n]] + step] for step, n in enumerate(still.tolist())]
        if not rare:
            steps = [c.astype(np.uint8, copy=False) for c in steps]
        state, count = np.zeros((2, len(self.roots), len(unit)), np.int32)
        for j, root in enumerate(self.roots):
            to, ends = np.full(len(unit), root, np.int32), np.zeros(len(unit), np.int32)
            for c in steps:
                to[: len(c)], cut, ended = self._step(to[: len(c)], root, c, rare)
                ends[cut] += ended
            state[j, order], count[j, order] = to, ends
        self._join(data, start, size, first, state, count, rare)
        last = np.append(first, True)[1:]
        out = np.zeros((len(runs), len(self.roots)), np.int32)
        for j, root in enumerate(self.roots):
            out[:, j] = np.bincount(unit, count[j] + (last & (state[j] != root)), len(runs))
        return out

    def _join(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, state: np.ndarray, count: np.ndarray, rare: bool) -> None:
        """Correct counts and last states of runs, by language, for the state that the run before leaves.

        All runs are parsed side by side from their old and their new state until both are in one state, mostly after a few
        characters.  A run that ends in another state than it did (repeated words can do that) makes the next one of
        its unit wrong; these few are parsed again in their order, each once.
        """
        n = len(first)
        state, count = state.reshape(-1), count.reshape(-1)
        rows = later = (np.arange(len(self.roots))[:, None] * n + np.flatnonzero(~first)).ravel()
        roots = np.array(self.roots, np.int32)
        old, new = roots[rows // n], state[rows - 1]
        entered = new
        for step in range(RUN):
            going = (old != new) & (step < size[rows % n])
            rows, old, new = rows[going], old[going], new[going]
            if not len(rows):
                break
            c = data[start[rows % n] + step]
            both, cut, ended = self._step(np.concatenate([old, new]), np.tile(roots[rows // n], 2), np.tile(c, 2), rare)
            old, new = both[: len(rows)], both[len(rows) :]
            fresh = cut >= len(rows)
            count[rows[cut[~fresh]]] -= ended[~fresh]
            count[rows[cut[fresh] - len(rows)]] += ended[fresh]
            ending = step == size[rows % n] - 1
            state[rows[ending]] = new[ending]
        for k in np.flatnonzero(entered != state[later - 1]).tolist():
            while k < len(later) and entered[k] != state[later[k] - 1]:
                row, entered[k] = later[k], state[later[k] - 1]
                at = start[row % n]
                state[row], count[row] = self._again(int(entered[k]), int(roots[row // n]), data[at : at + size[row % n]].tolist())
                k += 1

    def _again(self, state: int, root: int, chars: list[int]) -> tuple[int, int]:
        """The last state of one run, and how many phrases end in it."""
        flat, width, ended = memoryview(self.flat), self.width, 0
        for c in chars:
            to = flat[state * width + c] if c <= self.unknown else self._other(state, c)
            if not to:
                ended += state != root
                to = flat[root * width + c] if c <= self.unknown else self._other(root, c)
                if not to:
                    ended, to = ended + 1, root
            state = to
        return state, ended

    def _other(self, state: int, c: int) -> int:
        keys, targets = self.others
        key = state * len(self.rest) + c - (self.unknown + 1)
        at = int(np.searchsorted(keys, key))
        return int(targets[at]) if at < len(keys) and keys[at] == key else 0


def learn(docs: DataFrame, rows: int = LEARN_ROWS, chars: int = LEARN_CHARS) -> dict[str, SuffixAutomaton]:
    """Automata by language from rows with ``text`` and ``lang``, of whole texts of a bounded sample."""
    docs = docs.select("text", "lang").filter("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("n")).collect()}
    if not counts:
        return {}
    most = {k: int(min(1.0, 3 * rows / n) * 2.0**64 - 2.0**63) if n > 3 * rows else 2**63 - 1 for k, n in counts.items()}
    limits = docs.sparkSession.createDataFrame(list(most.items()), "lang string, most long")
    chosen = docs.join(F.broadcast(limits), "lang").filter("h <= most").groupBy("lang", "h").agg(F.first("text").alias("text"), F.min(F.char_length("text")).alias("n"))
    by_hash = Window.partitionBy("lang").orderBy("h")  # about three times the asked rows
    chosen = chosen.withColumn("place", F.row_number().over(by_hash)).withColumn("chars", F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    sample = chosen.filter((F.col("place") == 1) | (F.col("place") <= rows) & (F.col("chars") <= chars // len(counts))).select("lang", "h", "text").collect()
    models = {}
    for lang in sorted(counts):
        own = sorted((r for r in sample if r["lang"] == lang), key=lambda r: r["h"])
        models[lang] = SuffixAutomaton("\n".join(x for r in own for x in units(r["text"])))
    return models


def identify(docs: DataFrame, models: dict[str, SuffixAutomaton]) -> DataFrame:
    """Every row of ``docs`` without its text, with ``lang_pred`` and ``score`` (0 to 1)."""
    names = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    fields = [f"`{c}` {kind}" for c, kind in docs.dtypes if c in names]
    langs = sorted(models)
    name = str(uuid.uuid4())
    shared = docs.sparkSession.sparkContext.broadcast([models[k] for k in langs])  # at most LEARN_CHARS and one text each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        bits = np.array([a.bits for a in automata])
        parser = held(name, lambda: Parser(automata))
        for batch in (part for batch in batches for part in slices(batch, "text")):
            data, size, counts = parser.numbers(batch.column("text").to_pylist())
            sums = per_row(np.concatenate([parser.parse(data, size), size[:, None]], axis=1), counts)
            preds, scores = [], []
            for own in sums:
                if not own[-1] or not langs:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                cost = own[:-1] * bits
                best = int(np.argmin(cost))
                each = np.exp2(-(cost - cost[best]) / max(1.0, math.sqrt(float(own[-1]))))
                preds.append(langs[best])
                scores.append(float(each[best] / each.sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return map_arrow(docs.select(*names, "text"), run, ", ".join([*fields, "lang_pred string, score double"]))


def query(spark, folder):
    """``op9``: the language of every document, learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    models = learn(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), models)
