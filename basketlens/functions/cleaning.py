"""Cleaning of feed values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What feeds write for "no data".
PLACEHOLDERS = ("", "לא ידוע", "unknown", "none", "null", "nan", "na", "n/a", "{}", "[]", "undefined")
ADDRESS_NULLS = ("0", "0.0", "00", "-", "--", "—", ".", ",", "?")
PROMO_NULLS = ("no_body", "none", "null", "")
TRUE_WORDS = ("1", "true", "yes", "y")
#: Item codes that are shorter are a chain's own numbers.
GTIN_LENGTH = 8


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_str(c: Column) -> Column:
    """Trimmed text without outer quotes; placeholders are null."""
    c = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^'+|'+$", ""), r'^"+|"+$', ""))
    return F.when(~F.lower(c).isin(*PLACEHOLDERS), c)


def clean_address(c: Column) -> Column:
    """A street address: no placeholder, no closing zeros, at least two characters and a letter."""
    c = clean_str(c)
    c = F.when(~F.lower(c).isin(*ADDRESS_NULLS), c)
    c = strip(F.regexp_replace(c, r"(?U)(?:[\s,]+0+)+[\s,]*$", ""))
    letter = c.rlike(r"[A-Za-z֐-׿؀-ۿ]")
    return F.when(~F.lower(c).isin(*ADDRESS_NULLS) & letter & (F.char_length(c) >= 2), c)


def norm_code(c: Column) -> Column:
    """Codes of digits lose leading zeros."""
    c = clean_str(c)
    return F.when(c.rlike(r"^\d+$"), F.regexp_replace(c, r"^0+(?=\d)", "")).otherwise(c)


def to_decimal(c: Column, precision: int = 10, scale: int = 2) -> Column:
    """Numbers with thousands commas; anything else is null."""
    return F.regexp_replace(clean_str(c), ",", "").try_cast(f"decimal({precision},{scale})")


def to_bool(c: Column) -> Column:
    c = clean_str(c)
    return F.when(c.isNotNull(), F.lower(c).isin(*TRUE_WORDS))


def parse_dt(c: Column) -> Column:
    """The first of four formats that fits, as a timestamp without zone."""
    c = F.replace(clean_str(c), F.lit("T"), F.lit(" "))
    formats = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats))


def first_alias(df: DataFrame, *names: str) -> Column:
    """The first of some columns, of those that exist, with a clean value."""
    found = [clean_str(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def product_key(code: Column, chain: Column) -> Column:
    """Item codes that are not global are put in their chain's name space."""
    code, chain = clean_str(code), clean_str(chain)
    return F.when(chain.isNull() | (F.char_length(code) >= GTIN_LENGTH), code).otherwise(F.concat(chain, F.lit("_"), code))


def promo_value(c: Column) -> Column:
    """Clean text of a promotion feed, which has null marks of its own."""
    c = clean_str(c)
    return F.when(~F.lower(c).isin(*PROMO_NULLS), c)


def promo_number(c: Column, precision: int = 18, scale: int = 3) -> Column:
    return to_decimal(promo_value(c), precision, scale)


def clamp(c: Column, n: int = 255) -> Column:
    return F.substring(clean_str(c), 1, n)


def money(c: Column) -> Column:
    """Rounded half up to cents; null where that is more than the type holds."""
    return F.round(c, 2).try_cast("decimal(10,2)")


def norm_locality(c: Column) -> Column:
    """Quotes and hyphens are blanks, and blanks are single."""
    return strip(F.regexp_replace(F.regexp_replace(c, "[\"'`׳״־–-]", " "), r"(?U)\s+", " "))


def clean_city(c: Column) -> Column:
    c = strip(F.regexp_replace(F.regexp_replace(strip(c), r"""^["']+|["']+$""", ""), r"^[-–]+|[-–]+$", ""))
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.when(~F.lower(c).isin(*PLACEHOLDERS), c)
