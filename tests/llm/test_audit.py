"""The filter audit against every order applied to the rows one by one."""

import re
from itertools import permutations

import pytest

from basketlens.llm import audit

LONG = " ".join(f"w{i}" for i in range(210))


def documents():
    rows = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (4, LONG, None), (5, "SHOUT " * 300, "en"), (6, "short # text", "de"), (7, None, "en"), (8, "", "en"), (9, " \t\x0b\n", "en"), (None, LONG, "en"), (None, None, None), (10, "Ab " * 250, "en"), (1, LONG, "en")]
    rows += [(20 + i, (LONG + " $") if i % 2 else "a b " * 150, ("en", "de", "fr")[i % 3]) for i in range(12)]
    return [*rows, (40, LONG + " \x85x y", "en"), (41, "x" * 200_000, "en"), (42, " ".join(f"x{i}" for i in range(60_000)), "en"), (-5, "short # text", "fr")]


def plain(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, docs = [], []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": earlier}
        docs.append((lang or "", {k for k, x in fails.items() if x}, i in good, i in toxic))
    for part in {d[0] for d in docs}:
        table = []
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                table.append([part, order, step, len(left), len(now), sum(f in d[1] for d in gone), sum(d[0] == part and d[1] == {f} for d in docs), sum(d[2] for d in now), sum(d[3] for d in now)])
                gone += now
        shapley = {f: sum(r[4] for r in table if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in table]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_every_order(spark):
    rows = documents()
    labels = [(1, 1, 0), (2, 1, 1), (5, 0, 1), (6, None, 1), (20, 1, None), (20, 0, 1), (None, 1, 1), (99, 1, 1), (21, 1, 0), (10, 1, 0)]
    docs = spark.createDataFrame([(*r, 7, "m", 1) for r in rows], "doc_id long, text string, lang string, n int, mask string, good int").repartition(3)
    given = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(docs, given)
    assert dict(got.dtypes)["step"] == "int" and all(k == "bigint" for c, k in got.dtypes if c not in COLUMNS[:3])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain(rows, labels)
    assert audit.audit(docs.limit(0), given).count() == 0
    assert {r["good_lost"] for r in audit.audit(docs, given.limit(0)).collect()} == {0}


@pytest.mark.parametrize("seed", [1, 2])
def test_potentials_are_shapley_values(spark, seed):
    """Any game, not only one of removals: values of random coalitions against means over all orders."""
    import random

    rng = random.Random(seed)
    v = [0, *(rng.randrange(1000) for _ in range(31))]
    games = spark.createDataFrame([("x", 5, v, v, v)], "part string, rows long, n array<long>, good array<long>, toxic array<long>")
    got = audit.potentials(games).first()["shapley"]
    want = [0] * 5
    for order in permutations(range(5)):
        s = 0
        for i in order:
            want[i] += v[s | 1 << i] - v[s]
            s |= 1 << i
    assert got == want
