"""The choice among conflicting promotions by expressions equals the plain search, on random groups and beyond its bound."""

import random

from pyspark.sql import functions as F

from basketlens.operators import pricing

SCHEMA = "basket_id long, store_id long, promotion_id long, canonical_id long, used decimal(12,3), saving decimal(10,2), allow_stacking boolean, items long"


def group(rng, basket, n, items, ids=40):
    """Promotions over one to three items each."""
    rows = []
    for p in rng.sample(range(1, ids), n):
        own = rng.sample(range(items), rng.randrange(1, 4))
        saving, stacks = rng.choice([1.5, 2.0, 2.0, 3.0, 4.5, 7.25]), rng.random() < 0.4
        rows += [(basket, 1, p, i, 1, saving, stacks, len(own)) for i in own]
    return rows


def plain(rows):
    """All promotions of a basket through the plain search."""
    out = set()
    for basket in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == basket]
        saving, stacks = {r[2]: r[5] for r in own}, {r[2]: r[6] for r in own}
        items = {p: {r[3] for r in own if r[2] == p} for p in saving}
        out |= {(basket, p) for p in pricing.best_subset(sorted(saving), saving, stacks, items)}
    return out


def applied(spark, rows):
    from decimal import Decimal

    found = spark.createDataFrame([(*r[:4], Decimal(r[4]), Decimal(str(r[5])), *r[6:]) for r in rows], SCHEMA).repartition(4, "basket_id", "store_id")
    got = pricing.resolve_conflicts(found)
    assert got.columns == found.columns
    return sorted((r["basket_id"], r["promotion_id"], r["canonical_id"], float(r["saving"]), r["allow_stacking"], r["items"]) for r in got.collect())


def test_random_groups(spark):
    rng = random.Random(11)
    rows = [r for k in range(150) for r in group(rng, k, rng.randrange(1, 9), rng.randrange(3, 9))]
    want = plain(rows)
    assert applied(spark, rows) == sorted((r[0], r[2], r[3], r[5], r[6], r[7]) for r in rows if (r[0], r[2]) in want)


def test_groups_beyond_the_bound(spark):
    rng = random.Random(12)
    rows = [r for k in range(6) for r in group(rng, k, pricing.EXACT + 1 + k, 6)]  # of many promotions on few items: greedy within components
    rows += [r for k in range(10, 13) for r in group(rng, k, pricing.EXACT, 5)]
    want = plain(rows)
    assert applied(spark, rows) == sorted((r[0], r[2], r[3], r[5], r[6], r[7]) for r in rows if (r[0], r[2]) in want)


def test_attribution_does_not_depend_on_order(spark):
    rows = [(1, 1, p, c, 1 + c, 10.01 + p, True, 3) for p in range(1, 8) for c in range(3)]
    from decimal import Decimal

    found = spark.createDataFrame([(*r[:4], Decimal(r[4]), Decimal(str(r[5])), *r[6:]) for r in rows], SCHEMA)
    lines = spark.createDataFrame([(1, 1, c, Decimal(f"{3 + c}.33")) for c in range(3)], "basket_id long, store_id long, canonical_id long, unit_price decimal(10,2)")
    made = [sorted((r["canonical_id"], r["saved"], r["promotion_id"]) for r in pricing.attribute(found.orderBy(F.rand(seed)), lines).collect()) for seed in range(3)]
    assert made[0] == made[1] == made[2]
    assert abs(float(sum(x[1] for x in made[0])) - sum(10.01 + p for p in range(1, 8))) < 1e-7
