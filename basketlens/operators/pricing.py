"""Promotions on compared baskets: what each is worth, which may be combined, and the new ranking.

Lines are ``basket_id, store_id, canonical_id, quantity, unit_price`` with one line
for each canonical item; promotions and ``promotion_items`` (``promotion_id,
canonical_id, is_gift``) have the columns of the feed.  Everything up to the choice
among conflicting promotions is DataFrame expressions, and so is that choice for up to ``EXACT``
promotions of a basket and branch that are bound to each other; what is left goes to a small
search in Python.  Rows are dealt once by basket and branch; everything else happens within these partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.cleaning import money
from basketlens.functions.promo_rules import CONVENIENCE_CHAINS, SINGLE_UNIT_FLOOR, active, is_conditional, open_to_all

#: Larger conflict groups are solved by savings, dearest first.
EXACT = 14
KEY = ["basket_id", "store_id", "promotion_id"]


def active_promotions(promotions: DataFrame, now: Column) -> DataFrame:
    """Promotions that everybody gets now."""
    c = F.col
    sound = ((c("reward_kind") != "PCT_OFF") | c("discount_rate").isNull() | (c("discount_rate") < 1)) & (
        ~c("reward_kind").isin("FIXED_PRICE", "BUNDLE_PRICE") | c("discounted_price").isNull() | (c("discounted_price") > 0)
    )
    return promotions.filter(active(c("starts_at"), c("ends_at"), now) & open_to_all(c("club_id")) & sound & ~is_conditional(c("description")))


def covered_lines(lines: DataFrame, promotions: DataFrame, items: DataFrame) -> DataFrame:
    """Every promotion of a branch with the basket lines it covers or gives, dealt by basket and branch.

    ``lines`` may have their ``basket_total``; otherwise it is summed here.
    """
    priced = lines
    if "basket_total" not in lines.columns:
        priced = lines.withColumn("basket_total", money(F.sum(F.col("unit_price") * F.col("quantity")).over(Window.partitionBy("basket_id", "store_id"))))
    offered = promotions.select("promotion_id", "store_id", "reward_kind", "discounted_price", "discount_rate", "discount_amount", "min_basket_amount", F.coalesce(F.nullif("min_qty", F.lit(0)), F.lit(1)).cast("decimal(10,3)").alias("min_qty"), F.when(F.col("max_qty") > 0, F.col("max_qty")).alias("max_qty"), "allow_stacking", "chain_id")
    rows = items.join(offered, "promotion_id").join(priced, ["store_id", "canonical_id"])
    enough = F.col("min_basket_amount").isNull() | (F.col("min_basket_amount") == 0) | (F.col("basket_total") >= F.col("min_basket_amount"))
    return rows.filter(enough).repartition("basket_id", "store_id")


def eligible_units(covered: DataFrame) -> DataFrame:
    """Adds ``take``: units that a promotion may price, dearest lines first, up to its ``max_qty``."""
    triggers = covered.filter(~F.col("is_gift"))
    before = F.coalesce(F.sum("quantity").over(Window.partitionBy(*KEY).orderBy(F.desc("unit_price"), F.desc("canonical_id")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.when(F.col("max_qty").isNull(), F.col("quantity")).otherwise(F.greatest(F.lit(0), F.least("quantity", F.col("max_qty") - before)))
    return triggers.withColumn("take", take.cast("decimal(12,3)")).filter("take > 0")


def evaluate(lines: DataFrame, promotions: DataFrame, items: DataFrame) -> DataFrame:
    """``basket_id, store_id, promotion_id, canonical_id, used, saving, allow_stacking, items``: what promotions take and save, and from how many items.

    Basket-level rewards have a null ``canonical_id``.  Promotions that save nothing
    are left out.  ``saving`` is the promotion's, on each of its rows.  All rewards are
    worked out side by side, over windows of one partitioning by promotion.
    """
    c = F.col
    own = items.filter(~c("is_gift")).select("promotion_id", "canonical_id")
    other = items.filter("is_gift").join(own, ["promotion_id", "canonical_id"], "left_anti").select("promotion_id", "canonical_id")
    covered = covered_lines(lines, promotions, items)
    gives_other = other.select("promotion_id", F.lit(True).alias("other")).distinct()
    units = eligible_units(covered).join(gives_other, "promotion_id", "left")

    promo = Window.partitionBy(*KEY)
    dearest, cheapest = promo.orderBy(F.desc("unit_price"), F.desc("canonical_id")), promo.orderBy("unit_price", "canonical_id")
    before = lambda w: F.coalesce(F.sum("take").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = lambda total, taken: F.greatest(F.lit(0), F.least(c("take"), c(total) - taken)).cast("decimal(12,3)")
    units = units.withColumns({"pool": F.sum("take").over(promo), "dearer": before(dearest), "cheaper": before(cheapest), "first": F.row_number().over(dearest) == 1})
    units = units.withColumn("n", F.floor(c("pool") / c("min_qty")).cast("decimal(12,0)")).withColumn("needed", (c("n") * c("min_qty")).cast("decimal(15,3)"))
    units = units.withColumns({"bundled": part("needed", c("dearer")), "given": F.when(c("other").isNull(), part("n", c("cheaper"))).otherwise(0).cast("decimal(12,3)")})

    kind, price, shelf, take = c("reward_kind"), c("discounted_price"), c("unit_price"), c("take")
    refused = F.coalesce(c("chain_id").isin(*CONVENIENCE_CHAINS) & (c("min_qty") <= 1) & (price < shelf * F.lit(SINGLE_UNIT_FLOOR).cast("decimal(3,2)")), F.lit(False))
    fixed = (kind == "FIXED_PRICE") & (price > 0) & (shelf > price) & ~refused
    rated = (kind == "PCT_OFF") & (c("discount_rate") > 0) & (c("discount_rate") < 1)
    bundle = (kind == "BUNDLE_PRICE") & (price > 0) & (c("min_qty") >= 1) & (c("n") >= 1)
    free = (kind == "NTH_FREE") & (c("min_qty") >= F.when(c("other"), 1).otherwise(2)) & (c("n") >= 1)
    amount = (kind == "AMOUNT_OFF") & (c("discount_amount") > 0) & c("first")
    gain = (
        F.when(fixed, (shelf - price) * take)
        .when(rated, shelf * take * c("discount_rate"))
        .when(bundle, shelf * c("bundled") - F.when(c("first"), c("n") * price).otherwise(0))
        .when(free, shelf * c("given"))
        .when(amount, F.least("discount_amount", "basket_total"))
    )
    used = F.when(fixed | rated, take).when(bundle, F.nullif("bundled", F.lit(0))).when(free, c("given") + take)
    rows = units.withColumns({"gain": gain.cast("decimal(18,5)"), "used": used.cast("decimal(12,3)")}).filter("gain is not null")
    sets = rows.filter(free & c("other")).select(*KEY, "n", "allow_stacking").distinct()
    rows = rows.filter(c("used").isNotNull() | (kind == "AMOUNT_OFF")).select(*KEY, F.when(kind != "AMOUNT_OFF", c("canonical_id")).alias("canonical_id"), "allow_stacking", "used", "gain")

    gifts = covered.filter("is_gift").join(other, ["promotion_id", "canonical_id"], "left_semi").select(*KEY, "canonical_id", "unit_price", c("quantity").alias("take")).join(sets, KEY)
    gifts = gifts.withColumn("used", part("n", before(cheapest))).filter("used > 0")
    gifts = gifts.select(*KEY, "canonical_id", "allow_stacking", "used", (c("unit_price") * c("used")).cast("decimal(18,5)").alias("gain"))
    parts = rows.unionByName(gifts).groupBy(*KEY, "canonical_id", "allow_stacking").agg(F.sum("used").cast("decimal(12,3)").alias("used"), F.sum("gain").alias("gain"))
    return parts.withColumns({"saving": money(F.sum("gain").over(promo)), "items": F.count("canonical_id").over(promo)}).filter("saving > 0").drop("gain")


def conflicts(found: DataFrame) -> DataFrame:
    """``basket_id, store_id, a, b``: promotions that take a common item and do not both stack; a report, nothing is decided by it."""
    rows = found.filter("canonical_id is not null").select("basket_id", "store_id", "promotion_id", "canonical_id", "allow_stacking")
    a = rows.withColumnsRenamed({"promotion_id": "a", "allow_stacking": "a_stacks"})
    b = rows.withColumnsRenamed({"promotion_id": "b", "allow_stacking": "b_stacks"})
    return a.join(b, ["basket_id", "store_id", "canonical_id"]).filter("a < b and not (a_stacks and b_stacks)").select("basket_id", "store_id", "a", "b").distinct()


def best_subset(ids: list[int], saving: dict, stacks: dict[int, bool], items: dict[int, set[int]]) -> list[int]:
    """The ids of greatest total saving of which no two conflict, for each component of promotions with common items.

    Of equally good choices the one whose ids, read as a binary number from the
    largest id down, are smallest.  Components of more than ``EXACT`` promotions are
    solved by savings, dearest first.
    """
    chosen: list[int] = []
    left = set(ids)

    def clash(i: int, j: int) -> bool:
        return not (stacks[i] and stacks[j]) and bool(items[i] & items[j])

    while left:
        part, stack = [], [min(left)]
        left.discard(stack[0])
        while stack:
            i = stack.pop()
            part.append(i)
            near = {j for j in left if items[i] & items[j]}
            stack.extend(near)
            left -= near
        part.sort()
        if len(part) > EXACT:
            own: list[int] = []
            for i in sorted(part, key=lambda i: (-saving[i], i)):
                if not any(clash(i, j) for j in own):
                    own.append(i)
            chosen += own
            continue
        best, kept = 0, []
        bad = [sum(1 << k for k, j in enumerate(part) if k != n and clash(i, j)) for n, i in enumerate(part)]
        for mask in range(1, 1 << len(part)):
            own = [n for n in range(len(part)) if mask >> n & 1]
            if not any(bad[n] & mask for n in own) and (value := sum(saving[part[n]] for n in own)) > best:
                best, kept = value, own
        chosen += [part[n] for n in kept]
    return chosen


def resolve_conflicts(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose promotions are applied.

    Where all promotions of an item take nothing else, either all that stack apply
    or the dearest of the others (beyond ``EXACT`` promotions, whichever is dearest
    decides).  Promotions that share an item with one over several items are looked
    at together for each basket and branch: up to ``EXACT`` of them by :func:`_best_of`, more by :func:`best_subset`.
    """
    c = F.col
    item = Window.partitionBy("basket_id", "store_id", "canonical_id")
    stacks = c("allow_stacking")
    rows = found.withColumns({
        "__several": F.max("items").over(item) > 1,
        "__n": F.count("*").over(item),
        "__stacked": F.coalesce(F.sum(F.when(stacks, c("saving"))).over(item), F.lit(0)),
        "__last": F.max(F.when(stacks, c("promotion_id"))).over(item),
        "__best": F.max(F.when(~stacks, F.struct("saving", (-c("promotion_id")).alias("id")))).over(item),
        "__top": F.max(F.struct("saving", (-c("promotion_id")).alias("id"), stacks.alias("stacks"))).over(item),
    })
    alone = c("__best.saving")
    exact = alone.isNull() | (c("__stacked") > alone) | ((c("__stacked") == alone) & (c("__last") < -c("__best.id")))
    together = F.when(c("__n") <= EXACT, exact).otherwise(c("__top.stacks"))
    mine = F.when(c("__n") <= EXACT, -c("__best.id")).otherwise(-c("__top.id"))
    applies = c("canonical_id").isNull() | F.when(together, stacks).otherwise(~stacks & (c("promotion_id") == mine))
    bound = c("canonical_id").isNotNull() & c("__several")
    simple = rows.filter(~bound & applies).select(*found.columns)

    line = F.struct("canonical_id", "used", "items")
    promos = rows.filter(bound).groupBy(*KEY).agg(F.first("saving").alias("saving"), F.first("allow_stacking").alias("allow_stacking"), F.collect_list(line).alias("lines"))
    promo = F.struct("promotion_id", "saving", "allow_stacking", "lines")
    groups = promos.groupBy("basket_id", "store_id").agg(F.array_sort(F.collect_list(promo)).alias("promos"))
    small = groups.filter(F.size("promos") <= EXACT).withColumn("promos", _best_of(c("promos")))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                own = {p["promotion_id"]: p for p in r.promos}
                chosen = best_subset(sorted(own), {i: p["saving"] for i, p in own.items()}, {i: p["allow_stacking"] for i, p in own.items()}, {i: {x["canonical_id"] for x in p["lines"]} for i, p in own.items()})
                out.append((r.basket_id, r.store_id, sorted(chosen)))
            yield pd.DataFrame(out, columns=["basket_id", "store_id", "ids"])

    large = groups.filter(F.size("promos") > EXACT).mapInPandas(choose, "basket_id long, store_id long, ids array<long>")
    large = groups.filter(F.size("promos") > EXACT).join(large, ["basket_id", "store_id"]).withColumn("promos", F.expr("filter(promos, p -> array_contains(ids, p.promotion_id))")).drop("ids")
    chosen = small.unionByName(large).select("basket_id", "store_id", F.explode("promos").alias("p")).select("basket_id", "store_id", "p.promotion_id", "p.saving", "p.allow_stacking", F.explode("p.lines").alias("x"))
    return simple.unionByName(chosen.select("basket_id", "store_id", "promotion_id", "saving", "allow_stacking", "x.*").select(*found.columns))


def _best_of(promos: Column) -> Column:
    """The promotions of an array (by id, at most ``EXACT``) that :func:`best_subset` would choose.

    A fold over the array keeps every set without conflicts as a mask with its saving in
    cents; the largest saving wins, of equal ones the smallest mask.
    """
    bit = lambda i: F.pow(F.lit(2), i).cast("int")
    code = lambda p: F.transform(p["lines"], lambda x: x["canonical_id"])

    def entry(p: Column, i: Column) -> Column:
        rivals = F.transform(promos, lambda q, j: F.when((j != i) & ~(p["allow_stacking"] & q["allow_stacking"]) & F.arrays_overlap(code(p), code(q)), bit(j)).otherwise(0))
        return F.struct(bit(i).alias("bit"), (p["saving"] * 100).cast("long").alias("cents"), F.aggregate(rivals, F.lit(0), lambda a, b: a + b).alias("bad"))

    def grow(sets: Column, p: Column) -> Column:
        free = F.filter(sets, lambda s: s["mask"].bitwiseAND(p["bad"]) == 0)
        return F.concat(sets, F.transform(free, lambda s: F.struct((s["mask"] + p["bit"]).alias("mask"), (s["cents"] + p["cents"]).alias("cents"))))

    none = F.array(F.struct(F.lit(0).alias("mask"), F.lit(0).cast("long").alias("cents")))
    sets = F.aggregate(F.transform(promos, entry), none, grow)
    best = -F.array_max(F.transform(sets, lambda s: F.struct(s["cents"].alias("cents"), (-s["mask"]).alias("mask"))))["mask"]
    return F.filter(promos, lambda p, i: best.bitwiseAND(bit(i)) != 0)


def attribute(applied: DataFrame, lines: DataFrame) -> DataFrame:
    """``basket_id, store_id, canonical_id, saved, promotion_id``: savings by line, by the value taken; the smallest promotion names it.

    A share is worked out in whole numbers and rounded to the ninth decimal place, so
    that sums are the same in whatever order they are added.
    """
    rows = applied.filter("canonical_id is not null").join(lines.select("basket_id", "store_id", "canonical_id", "unit_price"), ["basket_id", "store_id", "canonical_id"])
    rows = rows.withColumn("weight", (F.col("used") * F.col("unit_price") * 100_000).cast("decimal(20,0)"))
    rows = rows.withColumn("total", F.sum("weight").over(Window.partitionBy(*KEY)).cast("decimal(21,0)"))
    cents = "cast(saving * 100 as decimal(10,0))"
    share = F.expr(f"if(total = 0, cast({cents} * 10000000 as bigint), cast({cents} * weight * 20000000 + total as decimal(38,0)) div (total * 2))")
    saved = (F.sum("share").cast("decimal(18,0)") * F.lit("0.000000001").cast("decimal(9,9)")).cast("decimal(18,9)")
    return rows.withColumn("share", share).groupBy("basket_id", "store_id", "canonical_id").agg(saved.alias("saved"), F.min("promotion_id").alias("promotion_id"))


def savings(applied: DataFrame) -> DataFrame:
    """``basket_id, store_id, saving``: what all promotions of a branch save together."""
    return applied.groupBy(*KEY).agg(F.max("saving").alias("saving")).groupBy("basket_id", "store_id").agg(F.sum("saving").alias("saving"))


def reprice(totals: DataFrame, applied: DataFrame) -> DataFrame:
    """Totals with ``base_total``, ``total_savings``, the new ``total`` and ``promotions_applied``; without promotions they stay as they are."""
    sums = savings(applied).withColumnRenamed("saving", "__saving")
    rows = totals.join(sums, ["basket_id", "store_id"], "left").withColumn("base_total", F.col("total"))
    saved = F.least(F.coalesce("__saving", F.lit(0)), F.col("base_total")).cast("decimal(10,2)")
    return rows.withColumn("total_savings", saved).withColumn("total", (F.col("base_total") - F.col("total_savings")).cast("decimal(10,2)")).withColumn("promotions_applied", F.col("__saving").isNotNull()).drop("__saving")


def repriced_lines(lines: DataFrame, attributed: DataFrame) -> DataFrame:
    """Lines with ``original``, ``saved`` (at most the original), ``final`` and the promotion that names the saving."""
    own = attributed.select("basket_id", "store_id", "canonical_id", F.col("saved").alias("__saved"), "promotion_id")
    rows = lines.join(own, ["basket_id", "store_id", "canonical_id"], "left").withColumn("original", money(F.col("unit_price") * F.col("quantity")))
    rows = rows.withColumn("saved", F.least(F.round(F.coalesce("__saved", F.lit(0)), 2).cast("decimal(10,2)"), F.col("original")))
    return rows.withColumn("final", (F.col("original") - F.col("saved")).cast("decimal(10,2)")).drop("__saved")


def unchanged_lines(lines: DataFrame) -> DataFrame:
    """:func:`repriced_lines` of lines that no promotion touches."""
    original = money(F.col("unit_price") * F.col("quantity"))
    nothing = F.least(F.lit(0).cast("decimal(10,2)"), original)
    return lines.withColumns({"promotion_id": F.lit(None).cast("long"), "original": original, "saved": nothing, "final": (original - nothing).cast("decimal(10,2)")})


def applied_list(applied: DataFrame, promotions: DataFrame) -> DataFrame:
    """``basket_id, store_id, applied``: the promotions of each branch, dearest first, with description and saving."""
    each = applied.groupBy(*KEY).agg(F.max("saving").alias("saving")).join(promotions.select("promotion_id", "description", "reward_kind"), "promotion_id")
    entry = F.struct((-F.col("saving")).alias("order"), "promotion_id", "description", "reward_kind", "saving")
    drop = lambda x: F.struct(*(x[k].alias(k) for k in ("promotion_id", "description", "reward_kind", "saving")))
    return each.groupBy("basket_id", "store_id").agg(F.transform(F.array_sort(F.collect_list(entry)), drop).alias("applied"))


def unit_cost(kind: Column, price: Column, min_qty: Column) -> Column:
    """What one unit costs under a promotion, or null where that cannot be said."""
    price, units = price.cast("double"), min_qty.cast("double")
    return F.when(kind == "FIXED_PRICE", price).when((kind == "BUNDLE_PRICE") & (min_qty >= 1), price / units)


def worth_advertising(kind: Column, price: Column, rate: Column, min_qty: Column, shelf: Column, chain: Column, description: Column) -> Column:
    """Whether a promotion makes a line cheaper."""
    floor = chain.isin(*CONVENIENCE_CHAINS) & (min_qty <= 1) & (price < shelf * F.lit(SINGLE_UNIT_FLOOR).cast("decimal(3,2)"))
    good = (
        F.when(kind == "FIXED_PRICE", (price > 0) & (price < shelf) & ~F.coalesce(floor, F.lit(False)))
        .when(kind == "BUNDLE_PRICE", (price > 0) & (min_qty >= 1) & (price < shelf * min_qty))
        .when(kind == "PCT_OFF", (rate > 0) & (rate < 1))
        .when(kind == "NTH_FREE", min_qty >= 2)
    )
    return F.coalesce(good, F.lit(False)) & ~is_conditional(description)


def available_promotions(lines: DataFrame, attributed: DataFrame, promotions: DataFrame, items: DataFrame) -> DataFrame:
    """The promotion of fewest units that an undiscounted line could still get, and how many units are short."""
    open_ = lines.join(attributed.select("basket_id", "store_id", "canonical_id"), ["basket_id", "store_id", "canonical_id"], "left_anti")
    offers = items.filter(~F.col("is_gift")).join(promotions, "promotion_id")
    c = F.col
    rows = open_.join(offers, ["store_id", "canonical_id"]).filter(worth_advertising(c("reward_kind"), c("discounted_price"), c("discount_rate"), c("min_qty"), c("unit_price"), c("chain_id"), c("description")))
    best = F.row_number().over(Window.partitionBy("basket_id", "store_id", "canonical_id").orderBy("min_qty", "promotion_id"))
    short = F.when(c("min_qty") > c("quantity"), c("min_qty") - c("quantity"))
    return rows.withColumn("__best", best).filter("__best = 1").select("basket_id", "store_id", "canonical_id", "promotion_id", short.cast("double").alias("units_short"))


def alternative_promotions(lines: DataFrame, attributed: DataFrame, promotions: DataFrame, items: DataFrame) -> DataFrame:
    """The cheapest rival of another tier that is no cheaper than what a discounted line is charged."""
    applied = attributed.join(promotions.select("promotion_id", F.col("min_qty").alias("applied_min")), "promotion_id").withColumnRenamed("promotion_id", "applied_id")
    offers = items.filter(~F.col("is_gift")).join(promotions, "promotion_id")
    c = F.col
    charged = (c("unit_price").cast("double") * c("quantity").cast("double") - c("saved").cast("double")) / c("quantity").cast("double")
    cost = unit_cost(c("reward_kind"), c("discounted_price"), c("min_qty"))
    rows = lines.join(applied, ["basket_id", "store_id", "canonical_id"]).join(offers, ["store_id", "canonical_id"])
    rows = rows.withColumns({"cost": cost, "charged": charged}).filter((c("promotion_id") != c("applied_id")) & (c("min_qty") != c("applied_min")) & (c("cost") >= c("charged") - 1e-9))
    rows = rows.filter(worth_advertising(c("reward_kind"), c("discounted_price"), c("discount_rate"), c("min_qty"), c("unit_price"), c("chain_id"), c("description")))
    best = F.row_number().over(Window.partitionBy("basket_id", "store_id", "canonical_id").orderBy("cost", "promotion_id"))
    return rows.withColumn("__best", best).filter("__best = 1").select("basket_id", "store_id", "canonical_id", "promotion_id", "cost")
