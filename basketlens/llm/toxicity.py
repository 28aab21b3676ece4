"""Toxicity by a subsequence string kernel, a Nyström map and a linear support vector machine.

The kernel of two strings is the weighted count of common subsequences of three
characters, where every character that a subsequence spans costs a factor, divided
by the strings' own kernels.  Insults with gaps or inserted characters keep most
of their subsequences.  A string is as similar to a landmark as its most similar
stretch (of up to two characters more than the landmark); kernels up to ``FLOOR``
count as none.  These similarities with all landmarks are whitened by the
landmarks' own (Nyström), and a linear machine on this map gives a string's margin.

The strings of a sentence are its words, behind a mark for where a word begins, and
single characters set apart to hide one, put together.  A margin is computed once
for each distinct word of a task.  Training is by multiple instances: of a sentence
of a toxic text the string with the largest margin stands for it, against all
strings of sentences of clean texts.  Some strings tell by themselves, others, which
clean texts have by chance, only if a text has several: margins are sorted into
``STEPS`` steps, each with a weight, the log ratio of its rates among the strings of toxic and
of clean texts.  A text's evidence is the log ratio of how likely all its strings are,
or the sum of its strings of weight ``SURE`` and more if that is larger, however
long the text is; its score is a logistic curve over the evidence.

Landmarks are stretches of words that far more toxic texts have than clean ones,
chosen one after the other for the texts that those before do not explain, and the
clean strings that are most similar to them.

Models learn from a bounded, documented sample: at most ``LEARN_ROWS`` labelled
texts (smallest hashes, one row for each text), in one task.  Scores are calibrated
on the same rows.

Defined results: null and empty texts get the score of a text without any string;
with labels of one class only, every text gets that class's share; repeated rows
each get their own result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import pickle
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.frames import held_out, kept, map_arrow
from basketlens.llm.words import Remembered, held, per_row, slices

LEARN_ROWS = 4000
DECAY = 0.6
ORDER = 3
#: Longer strings are looked at in pieces of this many characters, which overlap by more than any stretch.
PIECE, OVERLAP = 40, 13
#: Toxic and clean landmarks, at most; lengths of toxic ones.
LANDMARKS = (64, 8)
STRETCH = range(4, 11)
#: Kernels up to this one count as none.
FLOOR = 0.5
#: How much more frequent in toxic texts a landmark must be, how many of them it must explain that others do not, and how unlikely that is by chance (a log likelihood).
LIFT, LEAST, EVIDENCE = 8, 4, 14.0
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\S)")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE = re.compile(r"[.!?\n]+")
APART = re.compile(r"[^\W\d_][\W_]+[^\W\d_][\W_]+[^\W\d_]")
INNER = re.compile(r"[\W_]+")
#: Stands for the beginning of a word.
START = "^"
#: Least margin of strings that tell something, and how many steps there are from there on.
TELLING, STEPS = -0.5, 24
#: Strings that a step has at least to be judged by itself.
FEW = 20
#: Weight from which a string tells by itself.
SURE = 6.5


def codes(strings: list[str]) -> np.ndarray:
    """Characters as numbers, one row for each string, 0 behind its end."""
    width = max(map(len, strings), default=1)
    return np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le"), np.int32).reshape(len(strings), width)


def _kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Weighted counts of common subsequences of each ``s`` (n, l) with its ``t`` (n or 1, k, m)."""
    n, m = len(s), t.shape[2]
    lam = np.float32(DECAY)
    steps = np.arange(m)
    spread = np.where(steps[None, :] >= steps[:, None], lam ** (steps[None, :] - steps[:, None]), 0).astype(np.float32)
    shape = (n, t.shape[1], m)
    before = [np.ones(shape, np.float32)] + [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]  # K'_q at i-1
    total = np.zeros(shape[:2], np.float32)
    for i in range(s.shape[1]):
        same = (t == s[:, i, None, None]) & (s[:, i, None, None] > 0)
        if not same.any():
            for q in range(1, ORDER):
                before[q] *= lam
            continue
        same = same.astype(np.float32) * (lam * lam)
        after = [before[0]]
        for q in range(ORDER):
            shifted = same.copy() if q == 0 else np.concatenate([np.zeros((*shape[:2], 1), np.float32), before[q][:, :, :-1]], axis=2) * same
            if q == ORDER - 1:
                total += shifted.sum(axis=2)
            else:
                after.append(lam * before[q + 1] + (shifted.reshape(-1, m) @ spread).reshape(shape))
        before = after
    return total


def string_kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels of all strings with all landmarks."""
    s, t = codes(strings), codes(landmarks)
    norm, out = np.outer(_own(s), _own(t)), np.zeros((len(strings), len(landmarks)), np.float32)
    for i in range(0, len(s), 500):
        out[i : i + 500] = _kernel(s[i : i + 500], t[None]) / np.sqrt(norm[i : i + 500] + 1e-12)
    return out


def _own(s: np.ndarray) -> np.ndarray:
    return np.concatenate([_kernel(x, x[:, None, :])[:, 0] for i in range(0, len(s), 2000) if len(x := s[i : i + 2000])] or [np.zeros(0, np.float32)])


def _bits(s: np.ndarray) -> np.ndarray:
    """A bit for each character; letters other than a to z may share one."""
    at = np.where((s >= 97) & (s <= 122), s - 97, 26 + s % 37).astype(np.uint64)
    return np.where(s > 0, np.uint64(1) << at, np.uint64(0))


class Landmark:
    """A landmark string and the largest kernel that a string with some of its letters can have with it.

    What a string has in common with the landmark are subsequences of common letters:
    by Cauchy and Schwarz the kernel is at most the share that these have in the
    landmark's norm.
    """

    def __init__(self, text: str):
        self.codes = codes([text])[0]
        bits = _bits(self.codes)
        self.letters = np.unique(bits)
        weight: dict[tuple, float] = defaultdict(float)
        for at in itertools.combinations(range(len(text)), ORDER):
            weight[tuple(self.codes[list(at)])] += DECAY ** (at[-1] - at[0] + 1)
        masks = np.array([sum(1 << int(np.searchsorted(self.letters, b)) for b in set(_bits(np.array(u)).tolist())) for u in weight], np.int64)
        square = np.array(list(weight.values())) ** 2
        some = np.arange(1 << len(self.letters))
        share = ((masks[None] & some[:, None]) == masks[None]) @ square / square.sum()
        self.bound = np.sqrt(share).astype(np.float32)

    def bounds(self, bits: np.ndarray) -> np.ndarray:
        index = np.zeros(bits.shape, np.int64)
        for j, letter in enumerate(self.letters):
            index |= ((bits & letter) > 0).astype(np.int64) << j
        return self.bound[index]


class Similarity:
    """Similarities of strings with landmarks: kernels of their most similar stretches, above the floor."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = [Landmark(t) for t in landmarks]
        self.codes = codes(landmarks) if landmarks else np.zeros((0, 1), np.int32)
        self.own = _own(self.codes)

    def of(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        parts = [(i, s[a : a + PIECE]) for i, s in enumerate(strings) for a in range(0, max(1, len(s) - OVERLAP), PIECE - OVERLAP)]
        for a in range(0, len(parts), 20_000):
            rows, pieces = zip(*parts[a : a + 20_000], strict=True)
            np.maximum.at(out, np.array(rows), self._of_pieces(list(pieces)))
        return out

    def _of_pieces(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.landmarks)), np.float32)
        s = codes(strings)
        bits, size = _bits(s), np.array([len(x) for x in strings])
        whole = np.bitwise_or.reduce(bits, axis=1)
        for j, landmark in enumerate(self.landmarks):
            near = np.flatnonzero((landmark.bounds(whole) > FLOOR) & (size >= ORDER))
            width = len(landmark.codes) + 2
            if not len(near):
                continue
            pad = ((0, 0), (0, max(width - s.shape[1], 0)))
            own = np.lib.stride_tricks.sliding_window_view(np.pad(s[near], pad), width, axis=1)
            has = np.bitwise_or.reduce(np.lib.stride_tricks.sliding_window_view(np.pad(bits[near], pad), width, axis=1), axis=2)
            inside = np.arange(own.shape[1])[None] <= np.maximum(size[near] - width, 0)[:, None]
            row, at = np.nonzero(inside & (landmark.bounds(has) > FLOOR))
            for i in range(0, len(row), 20_000):
                r = row[i : i + 20_000]
                stretch = np.ascontiguousarray(own[r, at[i : i + 20_000]])
                kernel = _kernel(stretch, landmark.codes[None, None])[:, 0] / np.sqrt(_own(stretch) * self.own[j] + 1e-12)
                np.maximum.at(out[:, j], near[r], kernel)
        return np.maximum(out - FLOOR, 0) / (1 - FLOOR)


def string_of(word: str) -> str:
    """A word behind its mark, without what surrounds it or sets single characters of it apart."""
    own = EDGES.sub("", word.lower())
    return START + (INNER.sub("", own) if APART.search(own) else own)


def spaced(text: str) -> list[str]:
    return [START + m[0].replace(" ", "").lower() for m in SPACED.finditer(text)]


def strings_of(text: str) -> list[str]:
    """The strings of a sentence: its words, and runs of spaced characters put together."""
    return [s for w in text.split() if len(s := string_of(w)) > ORDER] + spaced(text)


@dataclass
class Machine:
    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    steps: np.ndarray  # their borders
    rates: np.ndarray  # weight of each step, and by how much more of a toxic text's strings are in some step
    curve: np.ndarray

    def margins(self, strings: list[str], similarity: Similarity | None = None) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(strings), TELLING - 1)
        return ((similarity or Similarity(self.landmarks)).of(strings) @ self.whiten @ self.weights + self.bias).astype(np.float64)

    def weights_of(self, margins: np.ndarray) -> np.ndarray:
        """What a string tells: the log ratio of its step's rates in toxic and in clean texts."""
        return self.rates[np.searchsorted(self.steps, margins, side="right")]

    def of_texts(self, margins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [self.weights_of(m) for m in margins]
        return np.array([w.sum() for w in own]), np.array([w[w >= SURE].sum() for w in own]), np.array([len(m) for m in margins])

    def evidence(self, total: np.ndarray, sure: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of texts, from the summed weights of their strings and of those that tell by themselves, and how many strings they have."""
        return np.stack([np.clip(np.maximum(total - n * self.rates[-1], sure), -5, 10), np.ones(len(n))], axis=1)

    def probability(self, total: np.ndarray, sure: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(total, sure, n) @ self.curve, -50, 50)))


def _steps(margins: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of steps of margins (equal shares of the telling strings of toxic texts); weights of all, and the summed difference of their rates."""
    telling = np.concatenate([m[m >= TELLING] for m, y in zip(margins, toxic, strict=True) if y] or [np.zeros(0)])
    steps = np.unique(np.append(np.quantile(telling, np.linspace(0, 1, STEPS + 1)[1:-1]) if len(telling) else [], TELLING)) - 1e-6
    seen = np.array([np.bincount(np.searchsorted(steps, m, side="right"), minlength=len(steps) + 1) for m in margins])
    seen = np.array([seen[toxic == y].sum(axis=0) for y in (0, 1)])
    beyond = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1]  # a step of few strings is judged with those above it
    rate = (np.where(seen.sum(axis=0) < FEW, beyond, seen) + 0.5) / (seen.sum(axis=1, keepdims=True) + 1)
    weight = np.maximum.accumulate(np.log(rate[1] / rate[0]))  # never less for a larger margin
    weight[0] = 0
    each = seen[:, 1:].sum(axis=1) / (seen.sum(axis=1) + 1)
    return steps, np.append(weight, each[1] - each[0])


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0) -> np.ndarray:
    """A linear machine with squared hinge loss by Newton steps; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        active = y * (x @ w) < 1
        a, c = x[active], (cost * weight)[active]
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """A logistic curve by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _gapped(strings: list[str], rng: np.random.Generator) -> list[str]:
    """The strings with a character put in or put between."""
    out = []
    for s in strings:
        at = int(rng.integers(1, len(s)))
        out += [s[:at] + "*.-_x"[int(rng.integers(5))] + s[at:], "-".join(s)]
    return out


def _copies(texts: list[str], toxic: list[int]) -> list[int]:
    """The group of near copies of each text, as a number: texts of one label that share three of their ten least hashes of word pairs, and so on from text to text."""
    above = list(range(len(texts)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    first: dict[tuple, int] = {}
    for i, (text, y) in enumerate(zip(texts, toxic, strict=True)):
        words = text.split()
        sketch = sorted({zlib.crc32(f"{a} {b}".encode()) for a, b in itertools.pairwise(words)})[:10]
        for key in itertools.combinations(sketch, 3):
            above[top(i)] = top(first.setdefault((y, *key), i))
    return [top(i) for i in range(len(texts))]


def stretches(word: str) -> set[str]:
    return {word[a : a + n] for n in STRETCH for a in range(len(word) - n + 1)}


def telling(toxic: Counter, clean: Counter, share: float) -> list[str]:
    """Stretches that toxic texts have far more often; ``toxic`` and ``clean`` count the texts of each word."""
    within: dict[str, list[str]] = defaultdict(list)
    for word in toxic:
        for x in stretches(word):
            within[x].append(word)
    within = {x: own for x, own in within.items() if sum(toxic[w] for w in own) >= LEAST}
    of_clean: Counter[str] = Counter()
    for word, n in clean.items():
        for x in stretches(word):
            if x in within:
                of_clean[x] += n

    def tells(n: int, other: int) -> bool:
        chance = n * np.log(n / (n + other) / share) + (other * np.log(other / (n + other) / (1 - share)) if other else 0)
        return n * (1 - share) >= LIFT * share * (other + 1) and chance >= EVIDENCE

    within = {x: own for x, own in within.items() if tells(sum(toxic[w] for w in own), of_clean[x])}
    found: list[str] = []
    left = dict(toxic)
    gain = {x: sum(left[w] for w in own) for x, own in within.items()}
    while gain and len(found) < LANDMARKS[0]:
        most = max(gain.values())
        best = min((x for x, n in gain.items() if n == most), key=lambda x: (-len(x), x))
        best = min((x for x, n in gain.items() if best in x and n >= 0.8 * most), key=lambda x: (-len(x), x))  # the longest that says the same
        found.append(best)
        for w in within[best]:
            left[w] = 0
        gain = {x: n for x in gain if (n := sum(left[w] for w in within[x])) >= LEAST and tells(n, of_clean[x])}
    return found


def fit(texts: list[str | None], toxic: list[int]) -> Machine:
    """A machine from labelled texts, whose sentences take the texts' labels; the same one in whichever order they come."""
    texts, toxic = map(list, zip(*sorted((t or "", y) for t, y in zip(texts, toxic, strict=True)), strict=True)) if texts else ([], [])
    n_toxic = sum(toxic)
    share = (n_toxic + 0.5) / (len(toxic) + 1)
    empty = Machine([], np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), np.zeros(2), np.array([0, np.log(share / (1 - share))]))
    if not 0 < n_toxic < len(toxic):
        return empty
    rng = np.random.default_rng(7)
    of: tuple[Counter, Counter] = (Counter(), Counter())
    groups: dict[int, set[tuple[str, ...]]] = defaultdict(set)  # the strings of the sentences of near copies, each sentence once
    label = {}
    for text, y, g in zip(texts, toxic, _copies(texts, toxic), strict=True):
        groups[g].update(tuple(x) for part in SENTENCE.split(text) if (x := strings_of(part)))
        label[g] = y
    for g, own in groups.items():
        of[label[g]].update(set(itertools.chain.from_iterable(own)))
    bags = sorted(own for g, each in groups.items() if label[g] for own in each)
    insults = telling(of[1], of[0], share)
    if not insults:
        return empty
    clean = sorted(of[0])
    alike = Similarity(insults).of(clean).sum(axis=1)
    hard = [clean[i] for i in np.argsort(-alike, kind="stable") if alike[i] > 0 and len(clean[i]) <= STRETCH[-1] and not any(x in clean[i] for x in insults)][: LANDMARKS[1]]
    landmarks = insults + hard
    similarity = Similarity(landmarks)
    gram = string_kernel(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(landmarks)))
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.02))) @ vectors.T

    def features(strings: list[str]) -> np.ndarray:
        return np.concatenate([similarity.of(strings) @ whiten, np.ones((len(strings), 1))], axis=1)

    gapped = _gapped(insults, rng)
    bad, at = np.unique(features(clean), axis=0, return_inverse=True)  # most strings are similar to no landmark
    weight = np.bincount(at, [of[0][w] for w in clean])
    seen = sorted(set().union(*bags))
    of_seen = dict(zip(seen, features(seen), strict=True))
    witnesses = [w for own in bags for w in own if any(x in w for x in insults)]
    machine = Machine(landmarks, whiten, np.zeros(len(landmarks)), 0.0, empty.steps, empty.rates, empty.curve)
    for _ in range(4):
        count = Counter(witnesses)
        good = np.concatenate([np.array([of_seen[w] for w in count]), features(gapped)])
        often = np.r_[np.array(list(count.values()), float), np.full(len(gapped), len(witnesses) / 4 / len(gapped))]
        x, y = np.concatenate([good, bad]), np.r_[np.ones(len(good)), -np.ones(len(bad))]
        w = _squared_hinge(x, y, np.concatenate([often, weight]))
        machine.weights, machine.bias = w[:-1], float(w[-1])
        margin = {k: float(v @ w) for k, v in of_seen.items()}
        witnesses = [top for own in bags if margin[top := max(own, key=margin.__getitem__)] > 0] or witnesses
    strings = [strings_of(t) for t in texts]
    known = sorted(set().union(*strings))
    margin = dict(zip(known, machine.margins(known, similarity), strict=True))
    margins = [np.array([margin[x] for x in own]) for own in strings]
    machine.steps, machine.rates = _steps(margins, np.array(toxic))
    machine.curve = _logistic(machine.evidence(*machine.of_texts(margins)), np.array(toxic, float))
    return machine


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Machine:
    """A machine from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``, 0 or 1).

    At most ``rows`` texts with the smallest hashes are used, chosen before any text is
    shuffled.  One task fits the machine; the driver gets the chosen ids and the
    machine alone.
    """
    hashed = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    toxic = F.col("toxic").cast("int")
    keyed = kept(hashed.select("doc_id", "h").join(labels.select("doc_id", toxic.alias("toxic")).filter("toxic in (0, 1)"), "doc_id"))
    n = keyed.agg(F.approx_count_distinct("h", 0.01)).first()[0]
    few = keyed.filter(F.col("h") <= int(2 * rows / n * 2.0**64 - 2.0**63)) if n > 2 * rows else keyed
    chosen = few.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).orderBy("h").limit(rows).collect()
    keyed.unpersist()
    table = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "h long, doc_id long, toxic int")
    sample = hashed.join(F.broadcast(table), ["doc_id", "h"]).groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("h").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, toxic))], pa.binary())], names=["machine"])

    fitted = map_arrow(sample.select("text", "toxic").coalesce(1), run, "machine binary").collect()
    return pickle.loads(fitted[0]["machine"]) if fitted else fit([], [])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Every row of ``docs`` without its text, with ``score`` (0 to 1, higher: likelier toxic)."""
    names = [c for c in docs.columns if c not in ("text", "score")]
    fields = [f"`{c}` {kind}" for c, kind in docs.dtypes if c in names]
    name = str(uuid.uuid4())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similarity = Similarity(machine.landmarks)
        strings: dict[str, float] = {}  # margins, bounded below

        def compute(words: list[bytes]) -> np.ndarray:
            own = [string_of(w.decode()) for w in words]
            fresh = list({s for s in own if len(s) > ORDER and s not in strings})
            if len(strings) > 400_000:
                strings.clear()
                fresh = list({s for s in own if len(s) > ORDER})
            strings.update(zip(fresh, machine.margins(fresh, similarity), strict=True))
            margin = np.array([strings.get(s, -np.inf) for s in own], np.float64)
            weight = machine.weights_of(margin)
            return np.stack([weight, np.where(weight >= SURE, weight, 0), margin > -np.inf], axis=1)

        known = held(name, lambda: Remembered(compute))
        for batch in (part for batch in batches for part in slices(batch, "text")):
            texts = batch.column("text").to_pylist()
            values, counts = known.of(texts)
            sums = per_row(values, counts)
            for i, text in enumerate(texts):
                if text and (more := spaced(text)):
                    weights = machine.weights_of(machine.margins(more, similarity))
                    sums[i] += weights.sum(), weights[weights >= SURE].sum(), len(more)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(machine.probability(*sums.T))], names=[*names, "score"])

    return map_arrow(docs.select(*names, "text"), run, ", ".join([*fields, "score double"]))


def query(spark, folder):
    """``op1``: the toxicity of every document, learnt from labelled rows that are not held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    machine = learn(docs, labels)
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), machine).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
