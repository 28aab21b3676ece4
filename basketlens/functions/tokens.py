"""Names of products: normal form, prominent words, sizes, and the predicates of fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.functions.cleaning import strip

# Units, packages and function words that say nothing about a product.
STOP_TOKENS = (
    "ליטר", "ל", "מל", "מיליליטר", "גרם", "גר", "ג", "קג", "קילו", "קילוגרם",
    "יחידה", "יח", "יחי", "מארז", "שישיה", "שישייה", "אריזה", "אריזת", "זוג",
    "חבילה", "בקבוק", "פחית", "קרטון", "ק", "מ", "כ",
    "על", "של", "עם", "או", "גם", "את", "אל",
)
# Hebrew final letters and their base forms.
FINAL_LETTERS, BASE_LETTERS = "ךםןףץ", "כמנפצ"
# What a number and a pack of several look like.
NUMERIC, PACK = r"^[0-9]+([.,][0-9]+)?%?$", r"(\d+)\s*[*x×X]\s*(\d+)"
# Fixed value: operators of search expressions.
OPERATORS = r"""[+\-><()~*"@]"""


def norm_name(c: Column) -> Column:
    """Trimmed, with single blanks."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Lower-cased words for search and prefix matching."""
    return F.filter(F.split(F.lower(norm_name(c)), r"[\s\-/,]+"), lambda w: w != "")


def prominent_tokens(c: Column, limit: int = 4) -> Column:
    """The first words of a name that are no numbers, sizes or units."""
    raw = F.split(norm_name(c), r"(?U)[\s\-/,]+")
    clean = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, OPERATORS, ""), r"""^['"]+|['"]+$""", ""))
    good = F.filter(clean, lambda w: (F.char_length(w) >= 2) & ~w.rlike(NUMERIC) & ~w.isin(*STOP_TOKENS))
    return F.slice(good, 1, limit)


def size_tokens(c: Column, limit: int = 2) -> Column:
    """Both numbers of packs such as ``4*55``, then numbers of two digits or more; distinct."""
    c = F.coalesce(c, F.lit(""))
    pack = PACK
    first, second = (F.regexp_extract_all(c, F.lit(pack), F.lit(i)) for i in (1, 2))
    packs = F.flatten(F.zip_with(first, second, lambda a, b: F.array(a, b)))
    alone = F.filter(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.char_length(n) >= 2)
    return F.slice(F.array_distinct(F.concat(packs, alone)), 1, limit)


def size_signature(c: Column) -> Column:
    return F.array_join(size_tokens(c), "|")


def definal(c: Column) -> Column:
    return F.translate(c, FINAL_LETTERS, BASE_LETTERS)


def head(c: Column) -> Column:
    """The first prominent word with base letters, or null."""
    return definal(F.try_element_at(prominent_tokens(c, 1), F.lit(1)))


def head_ok(candidate: Column, query_head: Column) -> Column:
    """One head is a prefix of the other; no head on either side passes."""
    both = F.startswith(candidate, query_head) | F.startswith(query_head, candidate)
    return candidate.isNull() | query_head.isNull() | both


def size_ok(candidate: Column, sizes: Column) -> Column:
    """Sizes of a query must be those of the candidate; a query without sizes passes."""
    return (F.size(sizes) == 0) | (F.array_sort(candidate) == F.array_sort(sizes))


def query_tokens(c: Column) -> Column:
    """Tokens of a search expression, lower-cased and without operators."""
    clean = F.regexp_replace(F.lower(norm_name(c)), OPERATORS, " ")
    return F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")
