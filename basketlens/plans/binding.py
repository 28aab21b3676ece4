"""The retail tables, derived from the star-schema tables of the test data.

Every view is written once here and once as SQL (:data:`CTES`), with the same
arithmetic, so that a query and its SQL start from equal rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.tokens import norm_name, size_signature
from basketlens.operators.upsert import last_per_key, refresh_availability

#: The clock of promotion queries.
NOW = "2026-06-15 12:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stores(spark: SparkSession, folder: str) -> DataFrame:
    s, n, r = (table(spark, folder, x) for x in ("supplier", "nation", "region"))
    twin = F.col("s_suppkey") % 11 == 0
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("s_suppkey").alias("store_id"),
        F.col("s_nationkey").cast("string").alias("chain_id"),
        F.col("n_name").alias("chain_name"),
        F.col("r_name").alias("city"),
        F.when(twin, "twin").otherwise(F.col("s_name")).alias("store_name"),
        F.when(twin & (F.col("s_suppkey") % 2 == 0), "").otherwise(F.concat(F.lit("street "), F.col("s_suppkey").cast("string"))).alias("address"),
        F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("store_code"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" g"))
    return p.select(
        F.col("p_partkey").alias("product_id"),
        name.alias("name"),
        norm_name(name).alias("name_norm"),
        size_signature(name).alias("size_signature"),
        F.col("p_brand").alias("manufacturer"),
        F.when(F.col("p_partkey") % 33 == 0, key).otherwise(F.lpad(key, 13, "0")).alias("barcode"),
        F.lit(None).cast("long").alias("availability"),
    )


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Products with what a listing shows: units, and in how many branches they are."""
    k = F.col("p_partkey")
    more = table(spark, folder, "part").select(
        k.alias("product_id"),
        F.when(k % 4 != 0, F.col("p_type")).alias("unit_qty"),
        F.concat(F.lit("per "), (k % 3).cast("string")).alias("unit_of_measure"),
        F.when(k % 5 != 0, F.col("p_size").cast("decimal(12,3)")).alias("quantity"),
        (k % 9 == 0).alias("is_weighted"),
    )
    branches = refresh_availability(prices(spark, folder), products(spark, folder))
    return products(spark, folder).drop("availability").join(more, "product_id").join(branches, "product_id", "left").fillna(0, ["availability"])


def price_log(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("decimal(18,0)")
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        (cents * F.lit(Decimal("0.01"))).cast("decimal(10,2)").alias("price"),
        F.col("l_shipdate").alias("seen"),
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("l"),
        F.col("l_extendedprice").alias("e"),
    )


ORDER = ["seen", "o", "l", "e"]


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return last_per_key(price_log(spark, folder), ["product_id", "store_id"], ORDER).select("product_id", "store_id", "price")


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    o, li, c, n, r = (table(spark, folder, x) for x in ("orders", "lineitem", "customer", "nation", "region"))
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("o_orderkey").alias("basket_id"), F.col("r_name").alias("city"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("decimal(10,3)").alias("quantity"))


def raw_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Everything a customer ever ordered as one basket, some of it with a quantity of 0."""
    o, li = (table(spark, folder, x) for x in ("orders", "lineitem"))
    quantity = F.when(F.col("o_orderkey") % 97 == 0, 0).otherwise(F.col("l_quantity")).cast("decimal(10,3)")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("basket_id"), F.col("l_partkey").alias("product_id"), quantity.alias("quantity"))


#: Ids of promotions over several items start here.
SEVERAL = 10**15


def promotion_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rules on priced items, one row for each item.

    Two kinds have one item: one of all five rewards, and one percentage that conflicts
    with it.  Two have several: a percentage, and a gift that goes with other items.
    """
    p, s, price = F.col("product_id"), F.col("store_id"), F.col("price")
    base = prices(spark, folder).join(stores(spark, folder).select("store_id", "chain_id"), "store_id")
    kind = F.element_at(F.array(*map(F.lit, ("FIXED_PRICE", "PCT_OFF", "BUNDLE_PRICE", "NTH_FREE", "AMOUNT_OFF"))), (F.pmod(p + s, F.lit(5)) + 1).cast("int"))
    null = F.lit(None)
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    made = lambda rows, k, number, family: rows.withColumns({"reward_kind": k, "promotion_id": number, "family": F.lit(family)})
    group = SEVERAL + (s * 100 + p % 10) * 2
    rows = made(base.filter((p * 7 + s) % 3 == 0), kind, (p * 1_000_000 + s) * 2, "a")
    rows = rows.unionByName(made(base.filter((p + s) % 4 == 0), F.lit("PCT_OFF"), (p * 1_000_000 + s) * 2 + 1, "b"))
    rows = rows.unionByName(made(base.filter(p % 10 < 5), F.lit("PCT_OFF"), group, "c"))
    rows = rows.unionByName(made(base.filter(p % 10 >= 5), F.lit("NTH_FREE"), group + 1, "d"))
    k, f = F.col("reward_kind"), F.col("family")
    own = f.isin("a", "b")
    deep = F.when(p % 23 == 0, F.lit(Decimal("0.3"))).otherwise(F.lit(Decimal("0.8")))
    discounted = F.when(k == "FIXED_PRICE", F.round(price * deep, 2)).when(k == "BUNDLE_PRICE", F.round(price * F.lit(Decimal("2.2")), 2))
    rate = F.when(f == "a", F.when(k == "PCT_OFF", F.lit(Decimal("0.10")) + (p % 5).cast("decimal(4,0)") * F.lit(Decimal("0.05")))).when(f == "b", F.lit(Decimal("0.20"))).when(f == "c", F.lit(Decimal("0.30")))
    text = F.when(own & (p % 19 == 0), "offer AR").when(k == "FIXED_PRICE", F.concat(F.lit("offer fixed "), (p % 7).cast("string"))).otherwise(F.concat(F.lit("offer "), k))
    return rows.select(
        "promotion_id", "store_id", "chain_id", "product_id", "reward_kind", "family",
        discounted.cast("decimal(10,2)").alias("discounted_price"),
        rate.cast("decimal(6,3)").alias("discount_rate"),
        F.when(k == "AMOUNT_OFF", (5 + p % 7)).cast("decimal(10,2)").alias("discount_amount"),
        F.when(k == "AMOUNT_OFF", 50).cast("decimal(10,2)").alias("min_basket_amount"),
        F.when(k == "BUNDLE_PRICE", 3).when((k == "NTH_FREE") & own, 2).otherwise(1).cast("decimal(10,3)").alias("min_qty"),
        F.when(own & (p % 4 == 0), 5).cast("decimal(10,3)").alias("max_qty"),
        F.when(f == "a", p % 2 == 0).when(f == "b", s % 2 == 0).when(f == "c", s % 3 == 0).otherwise(s % 2 == 0).alias("allow_stacking"),
        F.when(own & (p % 17 == 0), "2").otherwise(null).cast("string").alias("club_id"),
        day("2026-01-01 00:00:00").alias("starts_at"),
        F.when(own & (p % 13 == 0), day("2026-05-01 00:00:00")).otherwise(null).cast("timestamp_ntz").alias("ends_at"),
        text.alias("description"),
        ((f == "d") & (p % 20 >= 10)).alias("is_gift"),
    )


HEADER = ["promotion_id", "store_id", "chain_id", "reward_kind", "discounted_price", "discount_rate", "discount_amount", "min_basket_amount", "min_qty", "max_qty", "allow_stacking", "club_id", "starts_at", "ends_at", "description"]


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each rule."""
    return promotion_rows(spark, folder).select(*HEADER).distinct()


def promotion_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items of all rules."""
    return promotion_rows(spark, folder).select("promotion_id", F.col("product_id").alias("canonical_id"), "is_gift")


#: The same views in SQL.
CTES = r"""
WITH RECURSIVE stores AS (
  SELECT s_suppkey AS store_id, CAST(s_nationkey AS VARCHAR) AS chain_id, n_name AS chain_name, r_name AS city,
    CASE WHEN s_suppkey % 11 = 0 THEN 'twin' ELSE s_name END AS store_name,
    CASE WHEN s_suppkey % 11 = 0 AND s_suppkey % 2 = 0 THEN '' ELSE 'street ' || s_suppkey END AS address,
    lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS store_code
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), products AS (
  SELECT p_partkey AS product_id, p_name || ' ' || p_size || ' g' AS name, trim(regexp_replace(p_name || ' ' || p_size || ' g', '\s+', ' ', 'g')) AS name_norm,
    CASE WHEN p_size >= 10 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size_signature, p_brand AS manufacturer,
    CASE WHEN p_partkey % 33 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS barcode
  FROM part
), price_log AS (
  SELECT l_partkey AS product_id, l_suppkey AS store_id, CAST(CAST(floor(l_extendedprice * 100 / l_quantity) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)) AS price,
    l_shipdate AS seen, l_orderkey AS o, l_linenumber AS l, l_extendedprice AS e
  FROM lineitem
), prices AS (
  SELECT product_id, store_id, price FROM price_log QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY seen DESC, o DESC, l DESC, e DESC) = 1
), baskets AS (
  SELECT o_orderkey AS basket_id, r_name AS city, l_partkey AS product_id, CAST(l_quantity AS DECIMAL(10,3)) AS quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), lines AS (
  SELECT basket_id, city, product_id, CAST(sum(quantity) AS DECIMAL(12,3)) AS quantity FROM baskets WHERE product_id IN (SELECT product_id FROM products) GROUP BY ALL
), reps AS (SELECT DISTINCT product_id AS rep_id FROM lines),
tier1 AS (SELECT rep_id, rep_id AS product_id, 1 AS tier FROM reps),
tier2 AS (
  SELECT rep_id, b.product_id, 2 AS tier FROM reps JOIN products a ON a.product_id = rep_id JOIN products b ON a.name_norm = b.name_norm AND a.name_norm <> ''
  QUALIFY row_number() OVER (PARTITION BY rep_id ORDER BY b.product_id) <= 80
), features AS (
  SELECT DISTINCT name_norm, size_signature AS z, list_slice(list_filter(string_split_regex(lower(name_norm), '[\s\-/,]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+([.,][0-9]+)?%?$')), 1, 4) AS brand,
    list_filter(string_split_regex(lower(name_norm), '[\s\-/,]+'), lambda w: w <> '') AS words FROM products
), fuzzy AS ( -- every name here has its own words, so that names that only contain them are never taken
  SELECT q.name_norm AS query, c.name_norm AS candidate FROM features q JOIN features c ON substring(q.brand[1], 1, 2) = substring(c.brand[1], 1, 2)
  WHERE (q.z = '' OR q.z = c.z) AND (starts_with(c.brand[1], q.brand[1]) OR starts_with(q.brand[1], c.brand[1]))
    AND len(list_filter(q.brand, lambda t: len(list_filter(c.words, lambda w: starts_with(w, t))) = 0)) = 0 AND (q.z = '' OR list_contains(c.words, q.z))
), tier3 AS (
  SELECT rep_id, b.product_id, 3 AS tier FROM reps JOIN products a ON a.product_id = rep_id JOIN fuzzy ON query = a.name_norm JOIN products b ON b.name_norm = candidate
  QUALIFY row_number() OVER (PARTITION BY rep_id ORDER BY b.product_id) <= 80
), cand AS (SELECT rep_id, product_id, min(tier) AS tier FROM (SELECT * FROM tier1 UNION ALL SELECT * FROM tier2 UNION ALL SELECT * FROM tier3) GROUP BY ALL),
offers AS (
  SELECT rep_id, store_id, city, min(tier * 10000000000 + CAST(price * 100 AS BIGINT)) AS k
  FROM cand JOIN prices USING (product_id) JOIN stores USING (store_id) GROUP BY ALL
), best AS (SELECT rep_id, store_id, city, CAST(k // 10000000000 AS INTEGER) AS tier, CAST((k % 10000000000) * 0.01 AS DECIMAL(10,2)) AS price FROM offers),
offered AS (SELECT basket_id, l.city, l.product_id, quantity, store_id, tier, price FROM lines l JOIN best ON rep_id = l.product_id AND best.city = l.city),
wanted AS (SELECT basket_id, count(*) AS requested FROM lines GROUP BY 1),
totals AS (
  SELECT basket_id, store_id, CAST(round(sum(price * quantity), 2) AS DECIMAL(10,2)) AS total, count(*) AS found_count, any_value(requested) - count(*) AS missing_count
  FROM offered JOIN wanted USING (basket_id) GROUP BY 1, 2
), twinned AS (
  SELECT t.*, missing_count = 0 AS is_complete, chain_id, chain_name, city,
    count(DISTINCT nullif(address, '')) OVER w = count(*) OVER w AS apart,
    row_number() OVER (PARTITION BY basket_id, chain_id, city, store_name ORDER BY found_count DESC, (address = ''), total, store_id) AS place
  FROM totals t JOIN stores USING (store_id) WINDOW w AS (PARTITION BY basket_id, chain_id, city, store_name)
), single AS (SELECT * EXCLUDE (apart, place) FROM twinned WHERE apart OR place = 1),
posed AS (
  SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY is_complete DESC, CASE WHEN NOT is_complete THEN missing_count END NULLS FIRST, total, store_id) AS pos,
    CAST(min(CASE WHEN is_complete THEN total END) OVER (PARTITION BY basket_id) AS DOUBLE) AS cheapest
  FROM single
), ranked AS (
  SELECT * EXCLUDE (cheapest), CASE WHEN is_complete THEN pos END AS rank,
    CASE WHEN is_complete THEN round_even((CAST(total AS DOUBLE) - cheapest) / nullif(cheapest, 0) * 100, 1) END AS pct_above_cheapest
  FROM posed
), flagged AS (SELECT *, row_number() OVER (PARTITION BY basket_id, chain_name ORDER BY pos) = 1 AS first FROM ranked),
shown AS (SELECT * EXCLUDE (first) FROM flagged QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY first DESC, pos) <= 10)
"""

#: Promotions on top: what each is worth, which apply.
LISTED = r"""listed AS (
  SELECT p.*, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS unit_qty, 'per ' || (p_partkey % 3) AS unit_of_measure, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DECIMAL(12,3)) END AS quantity, p_partkey % 9 = 0 AS is_weighted, coalesce(n, 0) AS availability
  FROM products p JOIN part ON p_partkey = p.product_id LEFT JOIN (SELECT product_id, count(DISTINCT store_id) AS n FROM prices GROUP BY 1) USING (product_id)
)"""
PROMO_CTES = r""", promo_base AS (
  SELECT product_id AS p, store_id AS s, price, chain_id FROM prices JOIN stores USING (store_id)
), raw_baskets AS (
  SELECT o_custkey AS basket_id, l_partkey AS product_id, CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE l_quantity END AS DECIMAL(10,3)) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), promos0 AS (
  SELECT (p * 1000000 + s) * 2 AS promotion_id, p, s, price, chain_id, ['FIXED_PRICE', 'PCT_OFF', 'BUNDLE_PRICE', 'NTH_FREE', 'AMOUNT_OFF'][(p + s) % 5 + 1] AS reward_kind, 'a' AS f FROM promo_base WHERE (p * 7 + s) % 3 = 0
  UNION ALL
  SELECT (p * 1000000 + s) * 2 + 1, p, s, price, chain_id, 'PCT_OFF', 'b' FROM promo_base WHERE (p + s) % 4 = 0
  UNION ALL
  SELECT 1000000000000000 + (s * 100 + p % 10) * 2, p, s, price, chain_id, 'PCT_OFF', 'c' FROM promo_base WHERE p % 10 < 5
  UNION ALL
  SELECT 1000000000000000 + (s * 100 + p % 10) * 2 + 1, p, s, price, chain_id, 'NTH_FREE', 'd' FROM promo_base WHERE p % 10 >= 5
), promo_items AS (SELECT promotion_id, p AS canonical_id, f = 'd' AND p % 20 >= 10 AS is_gift FROM promos0),
promos AS (
  SELECT DISTINCT promotion_id, s AS store_id, chain_id, reward_kind, f,
    CAST(CASE reward_kind WHEN 'FIXED_PRICE' THEN round(price * CASE WHEN p % 23 = 0 THEN 0.3 ELSE 0.8 END, 2) WHEN 'BUNDLE_PRICE' THEN round(price * 2.2, 2) END AS DECIMAL(10,2)) AS discounted_price,
    CAST(CASE WHEN f = 'a' AND reward_kind = 'PCT_OFF' THEN 0.10 + (p % 5) * 0.05 WHEN f = 'b' THEN 0.20 WHEN f = 'c' THEN 0.30 END AS DECIMAL(6,3)) AS discount_rate,
    CASE WHEN reward_kind = 'AMOUNT_OFF' THEN CAST(5 + p % 7 AS DECIMAL(10,2)) END AS discount_amount,
    CASE WHEN reward_kind = 'AMOUNT_OFF' THEN CAST(50 AS DECIMAL(10,2)) END AS min_basket_amount,
    CAST(CASE WHEN reward_kind = 'BUNDLE_PRICE' THEN 3 WHEN reward_kind = 'NTH_FREE' AND f = 'a' THEN 2 ELSE 1 END AS DECIMAL(10,3)) AS min_qty,
    CASE WHEN f < 'c' AND p % 4 = 0 THEN CAST(5 AS DECIMAL(10,3)) END AS max_qty,
    CASE f WHEN 'a' THEN p % 2 = 0 WHEN 'c' THEN s % 3 = 0 ELSE s % 2 = 0 END AS allow_stacking,
    CASE WHEN f < 'c' AND p % 17 = 0 THEN '2' END AS club_id, CASE WHEN f < 'c' AND p % 13 = 0 THEN TIMESTAMP '2026-05-01' END AS ends_at,
    CASE WHEN f < 'c' AND p % 19 = 0 THEN 'offer AR' WHEN reward_kind = 'FIXED_PRICE' THEN 'offer fixed ' || (p % 7) ELSE 'offer ' || reward_kind END AS description
  FROM promos0
), live AS (SELECT * FROM promos WHERE club_id IS NULL AND (ends_at IS NULL OR ends_at >= TIMESTAMP '2026-06-15 12:00:00') AND description <> 'offer AR'),
plines AS (SELECT o.basket_id, o.store_id, o.product_id AS canonical_id, o.quantity, o.price AS unit_price FROM offered o JOIN single USING (basket_id, store_id)),
btotals AS (SELECT basket_id, store_id, CAST(round(sum(unit_price * quantity), 2) AS DECIMAL(10,2)) AS basket_total FROM plines GROUP BY 1, 2),
touched AS MATERIALIZED (
  SELECT l.*, b.basket_total, i.is_gift, v.* EXCLUDE (store_id, chain_id, club_id, ends_at, description)
  FROM plines l JOIN promo_items i USING (canonical_id) JOIN live v ON v.store_id = l.store_id AND v.promotion_id = i.promotion_id JOIN btotals b ON b.basket_id = l.basket_id AND b.store_id = l.store_id
  WHERE v.min_basket_amount IS NULL OR b.basket_total >= v.min_basket_amount
), covered AS (SELECT * EXCLUDE (is_gift), least(quantity, coalesce(max_qty, quantity)) AS take FROM touched WHERE NOT is_gift),
sets AS MATERIALIZED (SELECT basket_id, store_id, promotion_id, CAST(floor(sum(take)) AS DECIMAL(12,0)) AS n FROM covered WHERE f = 'd' AND promotion_id IN (SELECT promotion_id FROM promo_items WHERE is_gift) GROUP BY 1, 2, 3 HAVING floor(sum(take)) >= 1),
gifts AS (
  SELECT basket_id, store_id, promotion_id, canonical_id, allow_stacking, unit_price, greatest(0, least(quantity, n - coalesce(sum(quantity) OVER (PARTITION BY basket_id, store_id, promotion_id ORDER BY unit_price, canonical_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used
  FROM touched JOIN sets USING (basket_id, store_id, promotion_id) WHERE is_gift
), gains AS (
  SELECT basket_id, store_id, promotion_id, CASE WHEN reward_kind <> 'AMOUNT_OFF' THEN canonical_id END AS canonical_id, allow_stacking,
    CAST(CASE reward_kind
    WHEN 'FIXED_PRICE' THEN CASE WHEN unit_price > discounted_price THEN (unit_price - discounted_price) * take ELSE 0 END
    WHEN 'PCT_OFF' THEN unit_price * take * discount_rate
    WHEN 'BUNDLE_PRICE' THEN CAST(floor(take / 3) AS DECIMAL(10,0)) * (3 * unit_price - discounted_price)
    WHEN 'NTH_FREE' THEN CAST(floor(take / 2) AS DECIMAL(10,0)) * unit_price
    WHEN 'AMOUNT_OFF' THEN least(discount_amount, basket_total) END AS DECIMAL(18,5)) AS gain,
    CAST(CASE reward_kind WHEN 'AMOUNT_OFF' THEN NULL WHEN 'BUNDLE_PRICE' THEN floor(take / 3) * 3 WHEN 'NTH_FREE' THEN floor(take / 2) + take ELSE take END AS DECIMAL(12,3)) AS used
  FROM covered WHERE f <> 'd'
  UNION ALL SELECT basket_id, store_id, promotion_id, canonical_id, allow_stacking, 0, take FROM covered JOIN sets USING (basket_id, store_id, promotion_id)
  UNION ALL SELECT basket_id, store_id, promotion_id, canonical_id, allow_stacking, CAST(unit_price * used AS DECIMAL(18,5)), CAST(used AS DECIMAL(12,3)) FROM gifts WHERE used > 0
), found AS MATERIALIZED (
  SELECT * EXCLUDE (gain, total) FROM (SELECT *, CAST(round(total, 2) AS DECIMAL(10,2)) AS saving FROM (SELECT *, sum(gain) OVER w AS total, count(canonical_id) OVER w AS items FROM gains WHERE used > 0 OR canonical_id IS NULL WINDOW w AS (PARTITION BY basket_id, store_id, promotion_id))) WHERE saving > 0
), alone AS (
  SELECT *, max(items) OVER w > 1 AND canonical_id IS NOT NULL AS bound, coalesce(sum(saving) FILTER (allow_stacking) OVER w, 0) AS stacked, max(promotion_id) FILTER (allow_stacking) OVER w AS last_id, max(saving) FILTER (NOT allow_stacking) OVER w AS dearest
  FROM found WINDOW w AS (PARTITION BY basket_id, store_id, canonical_id)
), judged AS (
  SELECT *, min(promotion_id) FILTER (NOT allow_stacking AND saving = dearest) OVER (PARTITION BY basket_id, store_id, canonical_id) AS best_id FROM alone
), heads AS (
  SELECT basket_id, store_id, promotion_id, any_value(saving) AS saving, any_value(allow_stacking) AS stacks, list(canonical_id) AS own FROM judged WHERE bound GROUP BY 1, 2, 3
), clashing AS (
  SELECT a.basket_id, a.store_id, a.promotion_id, any_value(a.saving) AS saving, coalesce(list(b.promotion_id) FILTER (b.promotion_id <> a.promotion_id AND NOT (a.stacks AND b.stacks) AND list_has_any(a.own, b.own)), []) AS bad
  FROM heads a JOIN heads b USING (basket_id, store_id) GROUP BY 1, 2, 3
), subsets AS (
  SELECT basket_id, store_id, promotion_id AS last_id, [promotion_id] AS ids, CAST(saving AS DECIMAL(18,2)) AS value FROM clashing
  UNION ALL
  SELECT c.basket_id, c.store_id, c.promotion_id, list_prepend(c.promotion_id, ids), CAST(value + saving AS DECIMAL(18,2)) FROM subsets u JOIN clashing c ON c.basket_id = u.basket_id AND c.store_id = u.store_id AND c.promotion_id > u.last_id AND NOT list_has_any(ids, bad)
), picked AS (
  SELECT basket_id, store_id, unnest(ids) AS promotion_id FROM (SELECT * FROM subsets QUALIFY row_number() OVER (PARTITION BY basket_id, store_id ORDER BY value DESC, ids) = 1)
), applied AS (
  SELECT basket_id, store_id, promotion_id, canonical_id, allow_stacking, saving, used FROM judged
  WHERE NOT bound AND (canonical_id IS NULL OR CASE WHEN dearest IS NULL OR stacked > dearest OR (stacked = dearest AND last_id < best_id) THEN allow_stacking ELSE promotion_id = best_id END)
  UNION ALL SELECT basket_id, store_id, promotion_id, canonical_id, allow_stacking, saving, used FROM judged JOIN picked USING (basket_id, store_id, promotion_id) WHERE bound
), saved AS (SELECT basket_id, store_id, sum(saving) AS s FROM (SELECT DISTINCT basket_id, store_id, promotion_id, saving FROM applied) GROUP BY 1, 2),
repriced AS (
  SELECT t.* REPLACE (CAST(t.total - least(coalesce(s, 0), t.total) AS DECIMAL(10,2)) AS total), t.total AS base_total, CAST(least(coalesce(s, 0), t.total) AS DECIMAL(10,2)) AS total_savings, s IS NOT NULL AS promotions_applied
  FROM single t LEFT JOIN saved USING (basket_id, store_id)
), weighed AS (
  SELECT a.basket_id, a.store_id, a.promotion_id, a.canonical_id, CAST(saving * 100 AS HUGEINT) AS cents, CAST(used * unit_price * 100000 AS HUGEINT) AS weight
  FROM applied a JOIN plines l ON l.basket_id = a.basket_id AND l.store_id = a.store_id AND l.canonical_id = a.canonical_id
), shares AS (
  SELECT basket_id, store_id, promotion_id, canonical_id, CASE WHEN total = 0 THEN cents * 10000000 ELSE (cents * weight * 20000000 + total) // (total * 2) END AS share
  FROM (SELECT *, CAST(sum(weight) OVER (PARTITION BY basket_id, store_id, promotion_id) AS HUGEINT) AS total FROM weighed)
), attributed AS (SELECT basket_id, store_id, canonical_id, CAST(sum(share) AS DECIMAL(18,0)) * CAST(0.000000001 AS DECIMAL(10,9)) AS saved, min(promotion_id) AS promotion_id FROM shares GROUP BY 1, 2, 3)
"""
