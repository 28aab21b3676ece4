"""Predicates and classification of promotions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of offers with a condition that the feed does not state otherwise.
CONDITIONAL_MARKERS = ("קרוסייל", "קרוס סייל", "מותנה", "בקניה", "בקנייה", "קופון")
# Club ids that are open to everybody.
OPEN_CLUBS = ("", "0", "0 - כלל הלקוחות")
# Chains whose single-unit offers below a share of the shelf price are refused.
CONVENIENCE_CHAINS = ("7290644700005", "7290492000005")
SINGLE_UNIT_FLOOR = "0.40"
RATE_LIMIT = 1000


def is_conditional(description: Column) -> Column:
    text = F.coalesce(description, F.lit(""))
    marked = F.lit(False)
    for m in CONDITIONAL_MARKERS:
        marked = marked | F.contains(text, F.lit(m))
    return marked | text.rlike("(?<![A-Za-z])AR(?![A-Za-z])")


def open_to_all(club: Column) -> Column:
    return club.isNull() | F.trim(club).isin(*OPEN_CLUBS)


def active(starts_at: Column, ends_at: Column, now: Column) -> Column:
    """Bounds are inclusive, and open where they are null."""
    return (starts_at.isNull() | (starts_at <= now)) & (ends_at.isNull() | (ends_at >= now))


def fit_rate(c: Column) -> Column:
    return F.when(F.abs(c) < RATE_LIMIT, c)


def classify_reward(has_gift: Column, price: Column, rate: Column, min_qty: Column, basket_min: Column) -> Column:
    """The kind of reward, by which fields are filled, in this order."""
    least = F.when(min_qty.isNull() | (min_qty == 0), F.lit(1)).otherwise(min_qty)
    return (
        F.when(F.coalesce(has_gift, F.lit(False)), "NTH_FREE")
        .when((price > 0) & (least >= 2), "BUNDLE_PRICE")
        .when(price > 0, "FIXED_PRICE")
        .when((rate > 0) & (rate < 1), "PCT_OFF")
        .when(basket_min > 0, "AMOUNT_OFF")
        .otherwise("UNKNOWN")
    )
