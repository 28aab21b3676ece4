"""Secret scans with a trigram inverted index.

For each rule a Boolean query over trigrams is derived from its regular
expression: a text that matches must hold the trigrams of at least one branch.
A task indexes its texts slice by slice (postings of the trigrams that occur in
any query), intersects and unites postings, and runs the regular expression over
the candidates alone.  A rule without a mandatory trigram scans all texts.

Defined results: null text counts as empty and has no spans; repeated rows each
get their own result; no text is shortened; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.frames import map_arrow
from basketlens.llm.words import _offsets, slices

#: Larger Boolean queries are weakened: a repeat or class with more strings is not spelt out.
SPELT = 48


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.regex.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: The first three are the base rules; the others are public token formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

#: A query is a set of branches, a branch the trigrams that a text of it must hold; the empty branch is always true.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset({frozenset()})


def _both(a: Query, b: Query) -> Query:
    both = {x | y for x in a for y in b}
    if len(both) > SPELT:
        return a if len(a) <= len(b) else b
    return frozenset(x for x in both if not any(y < x for y in both))


def _trigrams(texts: set[str]) -> Query:
    return frozenset(frozenset(x for i in range(len(t) - 2) if (x := t[i : i + 3]).isascii()) for t in texts)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression, over text with A-Z lower-cased.

    Walks the standard library's parse tree.  Runs of literals and small classes
    are spelt out as the strings they can be; where something open stands, what
    has been spelt so far gives its trigrams and spelling starts anew.
    """
    tree = re._parser.parse(pattern, re.ASCII)

    def strings(items) -> set[str] | None:
        """All strings that a sequence can be, or None if it is open."""
        found = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                own = {chr(arg).lower()}
            elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
                own = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
            elif name == "SUBPATTERN":
                own = strings(arg[-1])
            elif name == "BRANCH":
                parts = [strings(x) for x in arg[1]]
                own = None if None in parts else set().union(*parts)
            elif name == "MAX_REPEAT" and arg[1] <= 3 and (one := strings(arg[2])) is not None:
                own, grown = set(), {""}
                for n in range(arg[1] + 1):
                    own |= grown if n >= arg[0] else set()
                    grown = {x + y for x in grown for y in one}
                    if len(grown) > SPELT:
                        return None
            else:
                own = None
            if own is None or len(own) * len(found) > SPELT:
                return None
            found = {x + y for x in found for y in own}
        return found

    def query(items) -> Query:
        said, run = ALWAYS, {""}
        for item in items:
            own = strings([item])
            if own is not None and len(own) * len(run) <= SPELT:
                run = {x + y for x in run for y in own}
                continue
            said, run = _both(said, _trigrams(run)), {""}
            op, arg = str(item[0]), item[1]
            if own is not None:
                run = own
            elif op == "SUBPATTERN":
                said = _both(said, query(arg[-1]))
            elif op == "BRANCH":
                said = _both(said, frozenset().union(*(query(x) for x in arg[1])))
            elif op == "MAX_REPEAT" and arg[0] > 0:
                said = _both(said, query(arg[2]))
        return _both(said, _trigrams(run))

    return query(tree)


class TrigramIndex:
    """Postings of the wanted trigrams over the texts of one slice."""

    def __init__(self, wanted: list[str]):
        self.wanted = wanted
        self.number = np.zeros(1 << 24, dtype=np.uint16)
        for i, t in enumerate(wanted):
            a, b, c = t.encode("ascii")
            self.number[a << 16 | b << 8 | c] = i + 1

    def postings(self, column: pa.Array) -> dict[str, np.ndarray]:
        column = column.fill_null("")
        offsets = _offsets(column)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        if len(data) < 3:
            return {}
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
        number = self.number[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(number)
        rows = np.searchsorted(offsets - offsets[0], at, side="right") - 1  # one over a border is only a needless candidate
        pairs = np.unique(number[at].astype(np.int64) << 32 | rows)
        return {t: pairs[np.searchsorted(pairs, (i + 1) << 32) : np.searchsorted(pairs, (i + 2) << 32)] & 0xFFFFFFFF for i, t in enumerate(self.wanted)}


def candidates(query: Query, postings: dict[str, np.ndarray], rows: int) -> np.ndarray:
    """Rows that a Boolean trigram query leaves: united branches of intersected postings."""
    none = np.zeros(0, np.int64)
    out = none
    for branch in query:
        if not branch:
            return np.arange(rows)
        found = None
        for own in sorted((postings.get(t, none) for t in branch), key=len):
            found = own if found is None else np.intersect1d(found, own, assume_unique=True)
        out = np.union1d(out, found)
    return out


SPANS = "array<struct<kind: string, start: int, end: int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _found(texts: pa.Array, rules: tuple[Rule, ...], queries: list[Query], index: TrigramIndex) -> list[list[dict]]:
    postings = index.postings(texts)
    texts = texts.to_pylist()
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for i in candidates(query, postings, len(texts)):
            if texts[i]:
                spans[i].extend((a, order, b) for a, b in rule.spans(texts[i]))
    return [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(own)] for own in spans]


def _redacted(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:  # by start
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, redact: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``spans``: kind, start and end (code points, end exclusive), by start, then rule order.

    With ``redact`` the spans' text is replaced by the kind in brackets, united
    where spans overlap, and ``n_chars`` follows if there is such a column.
    """
    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes if c != "spans")
    names = [c for c in docs.columns if c != "spans"]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        index = TrigramIndex(sorted({t for q in queries for b in q for t in b}))
        for batch in (part for batch in batches for part in slices(batch, "text")):
            found = _found(batch.column("text"), rules, queries, index)
            columns = dict(zip(names, batch.columns, strict=True))
            if redact:
                texts = [_redacted(t, s) for t, s in zip(columns["text"].to_pylist(), found, strict=True)]
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found, pa.list_(_SPAN))], names=[*names, "spans"])

    return map_arrow(docs, run, f"{fields}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, folder):
    """``op6``: spans of every document, with digests of the base rules' spans."""
    found = scan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
