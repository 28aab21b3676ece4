"""Quality rules with weak supervision.

Each rule votes that a text is bad (-1) or good (+1), or abstains (0).  A
two-class model in which each rule has an accuracy, and votes are independent
given the class, is fitted by expectation-maximisation; a text is kept if its posterior probability of being
good is at least one half.  The corpus reaches the driver only as counts of vote
patterns, at most two to the number of rules however large it is; all texts count.

Defined results: a null or empty text has zero counts, fails the base rules and
is not kept; repeated rows each get their own result; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.frames import kept, map_arrow
from basketlens.llm.words import Words, _power, _BASE, mix, slices

REPEAT_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bang", "n_ended")
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LETTER = UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0xC0)
ENDS = np.isin(np.arange(256), list(b".!?"))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have the row and key of another one, and which of an earlier one."""
    order = np.argsort(mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    same = np.zeros(len(order) + 1, bool)
    a, b = order[:-1], order[1:]
    same[1:-1] = (row[a] == row[b]) & (key[a] == key[b])
    both, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    both[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return both, later


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a column."""
    w = Words(column)
    data, offsets, n = w.data, w.offsets, len(w.data)
    out = {"n_words": w.counts()}
    space = (data == 32) | ((data >= 9) & (data <= 13))
    lead = (data & 0xC0) != 0x80
    out["word_chars"] = _sums(lead & ~space, offsets)
    for name, table in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_letters", LETTER)):
        out[name] = _sums(table[data], offsets)
    out["n_bang"] = _sums(data == ord("!"), offsets)
    # lines: from a text's start or behind a line feed up to the next of these
    borders = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
    borders = borders[borders < n]
    feed = np.append(np.flatnonzero(data == 10), n)
    row = np.searchsorted(offsets, borders, side="right") - 1
    ends = np.minimum(feed[np.searchsorted(feed, borders)], offsets[row + 1]) if len(borders) else borders
    words = np.zeros(n + 1, np.int64)
    np.cumsum(~space, out=words[1:])
    full = words[ends] > words[borders]
    borders, ends, row = borders[full], ends[full], row[full]
    sums = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
        from basketlens.llm.words import _INVERSE

        key = mix((sums[ends] - sums[borders]) * _power(_INVERSE, n)[borders] + (ends - borders).astype(np.uint64))
    else:
        key = np.zeros(0, np.uint64)
    rows = w.rows
    out["n_lines"] = np.bincount(row, minlength=rows)
    out["n_dup_lines"] = np.bincount(row[_again(row, key)[1]], minlength=rows)
    last = ends - 1
    for _ in range(2):  # a line may end in blanks
        last = np.where((last > borders) & space[last], last - 1, last) if n else last
    out["n_ended"] = np.bincount(row[ENDS[data[last]]], minlength=rows) if n else np.zeros(rows, np.int64)
    at, own = w.windows(REPEAT_WINDOW)
    twice = at[_again(np.searchsorted(w.first, at, side="right") - 1, own)[0]]
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, w.first)
    return out


def measured(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Every row of ``docs`` with its counts, and with its text if asked for."""
    names = [c for c in docs.columns if (texts or c != "text") and c not in COUNTS]
    fields = [f"`{c}` {kind}" for c, kind in docs.dtypes if c in names]
    docs = docs.select(*dict.fromkeys([*names, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, "text")):
            counts = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=[*names, *COUNTS])

    return map_arrow(docs, run, ", ".join([*fields, *(f"{c} long" for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The rules, as columns over the counts: all but the last say bad or nothing, the last says good or nothing."""
    c = F.col
    bad = {
        "length": c("n_words") < 20,
        "repeats": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "same_lines": (c("n_dup_lines") > 1) & (10 * c("n_dup_lines") > 3 * c("n_lines")),
        "shouting": 10 * c("n_upper") > 4 * c("n_letters"),
        "exclaiming": 10 * c("n_bang") > c("n_words"),
        "word_length": (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")),
        "line_ends": (10 * c("n_ended") < 3 * c("n_lines")) & (c("n_lines") > 1),
        "letters": 2 * c("n_letters") < c("word_chars"),
    }
    prose = (c("n_words") >= 20) & (10 * c("n_ended") >= 7 * c("n_lines")) & (20 * c("n_symbols") <= c("n_words")) & (5 * c("n_upper") <= c("n_letters"))
    return {k: F.when(v, -1).otherwise(0) for k, v in bad.items()} | {"prose": F.when(prose, 1).otherwise(0)}


#: Class balance: a text on which no rule votes is as likely good as bad.  It is given, because single votes cannot tell it from accuracies.
BALANCE = 0.5


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 80) -> np.ndarray:
    """Expectation-maximisation over counted vote patterns.

    A rule that does not abstain is right with its own accuracy, whichever the
    class.  Returns the accuracies.  It starts from nine right votes in ten; ten virtual votes of that accuracy for each rule, and the
    bounds of 0.55 and 0.999, keep rules with few votes from deciding alone.
    """
    seen = np.array(list(patterns), dtype=np.float64)
    n = np.array(list(patterns.values()), dtype=np.float64)
    accuracy = np.full(seen.shape[1], 0.9)
    for _ in range(rounds):
        good = posteriors(seen, accuracy)
        right = n @ ((seen > 0) * good[:, None] + (seen < 0) * (1 - good)[:, None])
        cast = n @ (seen != 0)
        accuracy = np.clip((right + 9) / (cast + 10), 0.55, 0.999)
    return accuracy


def posteriors(patterns: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """Probabilities that texts with these votes are good."""
    odds = np.log(BALANCE / (1 - BALANCE)) + patterns @ np.log(accuracy / (1 - accuracy))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Every row of ``docs`` with counts, ``base_failed``, ``quality`` (posterior) and ``kept``; with its text if asked for.

    ``kept`` is false for texts that fail the base rules, else the model's verdict.
    """
    pattern = F.concat_ws(",", *(v.cast("string") for v in votes().values()))
    rows = measured(docs, texts).withColumns({"base_failed": base_failed(), "__votes": pattern})
    if texts:  # rather measured twice than held
        counts = measured(docs.select("text")).withColumn("__votes", pattern)
    else:
        counts = rows = kept(rows)
    counted = {tuple(map(int, r[0].split(","))): r[1] for r in counts.groupBy("__votes").agg(F.count("*")).collect()}
    if not counted:
        return rows.drop("__votes").withColumns({"quality": F.lit(0.0), "kept": F.lit(False)})
    good = posteriors(np.array(list(counted), dtype=np.float64), fit(counted))
    table = rows.sparkSession.createDataFrame([(",".join(map(str, x)), float(q)) for x, q in zip(counted, good, strict=True)], "__of string, quality double")
    judged = rows.join(F.broadcast(table), F.col("__votes") == F.col("__of"))  # at most 2 to the number of rules
    return judged.drop("__votes", "__of").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    return judge(docs, texts=True).filter("kept").select(*docs.columns)


def query(spark, folder):
    """``op8``: counts and verdict of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS[:5], "base_failed", "kept", "quality")
