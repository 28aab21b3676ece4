"""Filter interaction audit: what five filters remove alone, together and in every order.

Every document gets a mask of the filters it fails.  Per part (language) the
masks shrink to counts of the documents that each of the 32 coalitions of filters
removes - the removal game.  Its Hart-Mas-Colell potentials follow by recursion
over coalitions; a filter's Shapley value is the potential of all filters minus the
potential without it, and differences of coalition values give every step of every order.

All work is DataFrame expressions.  Only ids, hashes and masks are shuffled, never
texts; copies are counted before they meet, so that a text with very many copies is
a few rows by then.

Defined results: a null text is an empty one; a null language is the part ``''``;
a null id has no labels, is no smaller than any other and none is smaller than it, so
that its row never fails ``E``; rows of equal id and text do not fail ``E`` through each
other; labels of several rows count if any row has them; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
GRAND = (1 << len(FILTERS)) - 1
MEASURES = ("n", "good", "toxic")
BLANKS = " \t\n\x0b\f\r"


def own_failures(text: Column, words: Column) -> Column:
    """Mask of the filters A to D, which look at one text only; ``words`` are its words."""
    n = F.size(words)
    failed = (
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by part and mask: ``part, mask, n, good, toxic``, some rows for each."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(F.col("text"), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    rows = rows.withColumn("words", words).select("doc_id", "part", F.sha2("text", 256).alias("same"), own_failures(F.col("text"), F.col("words")).alias("mask"))
    given = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("of")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    # rows without an id are dealt by their text, so that many of them do not meet in one task
    rows = rows.join(given, F.coalesce(F.col("doc_id").cast("string"), "same") == F.col("of"), "left").select("doc_id", "part", "same", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    # rows of one id and text, then ids of one text: each step adds up within tasks before it shuffles
    kind = ["same", "part", "mask", "good", "toxic"]
    ids = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    texts = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"))
    smallest = texts.groupBy(F.col("same").alias("key")).agg(F.min("first.doc_id").alias("least"))
    met = texts.join(smallest, F.col("same") == F.col("key"))
    spared = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = met.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(spared.alias("n"), F.lit(0).alias("e")), F.struct((F.col("n") - spared).alias("n"), F.lit(1 << 4).alias("e")))).alias("x"))
    return both.filter("x.n > 0").select("part", (F.col("mask") + F.col("x.e")).alias("mask"), F.col("x.n").alias("n"), (F.col("good") * F.col("x.n")).alias("good"), (F.col("toxic") * F.col("x.n")).alias("toxic"))


def coalitions(failed: DataFrame) -> DataFrame:
    """Per part the rows (``rows``) and, for each measure, what each coalition removes: arrays of 32, the empty one first."""
    hit = lambda s, c: F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0))
    return failed.groupBy("part").agg(F.sum("n").alias("rows"), *(F.array(F.lit(0).cast("long"), *(hit(s, c) for s in range(1, GRAND + 1))).alias(c) for c in MEASURES))


def potentials(games: DataFrame) -> DataFrame:
    """Adds ``shapley``: for each filter its Shapley value in the removal game times 120, a whole number.

    A potential P satisfies ``|S| P(S) = v(S) + sum of P(S without i)``; the
    columns hold ``|S|! P(S)``, so that all stay whole numbers.
    """
    found = games.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, len(FILTERS) + 1):
        of_size = [s for s in range(1, GRAND + 1) if s.bit_count() == size]
        found = found.withColumns({f"p{s}": factorial(size - 1) * F.col("n")[s] + sum((F.col(f"p{s & ~(1 << i)}") for i in range(len(FILTERS)) if s >> i & 1), F.lit(0)) for s in of_size})
    shapley = F.array(*(F.col(f"p{GRAND}") - len(FILTERS) * F.col(f"p{GRAND & ~(1 << i)}") for i in range(len(FILTERS))))
    return found.select("part", "rows", *MEASURES, shapley.alias("shapley"))


def steps(games: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = games.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(1, len(FILTERS) + 1)))))
    place = lambda k: F.ascii(F.substr("filter_order", F.lit(k), F.lit(1))) - ord("A")
    bits = F.array(*(F.pow(F.lit(2), place(k)).cast("int") for k in range(1, len(FILTERS) + 1)))
    upto = F.aggregate(F.slice(bits, 1, F.col("step")), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumns({"own": bits[F.col("step") - 1], "upto": upto}).withColumn("before", F.col("upto") - F.col("own"))
    lost = {c: F.col(c)[F.col("upto")] - F.col(c)[F.col("before")] for c in MEASURES}
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("rows") - F.col("n")[F.col("upto")]).alias("kept"),
        lost["n"].alias("removed"),
        (F.col("n")[F.col("own")] - lost["n"]).alias("redundant"),
        (F.col("n")[GRAND] - F.col("n")[GRAND - F.col("own")]).alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.col("shapley")[F.log2(F.col("own")).cast("int")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes in each order, per part."""
    return steps(potentials(coalitions(failures(docs, labels))))


def query(spark, folder):
    """``op13``: the audit of ``documents`` by language."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return audit(read("documents").select("doc_id", "text", "lang"), read("labels").select("doc_id", "quality", "toxic"))


#: Every order applied step by step to the counted masks.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
    || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
k AS (SELECT filter_order, step, filter_order[step:step] AS own, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
g AS (SELECT *, length(translate(fails, earlier, '')) = length(fails) AS reached, contains(fails, own) AS hit FROM m, k),
r AS (
  SELECT part, filter_order, step, any_value(own) AS own,
    sum(CASE WHEN reached AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN reached AND hit THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN NOT reached AND hit THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN reached AND hit THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN reached AND hit THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM g GROUP BY 1, 2, 3)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
