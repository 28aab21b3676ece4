"""Localities from names of branches, cities from all sources, merges."""

import pytest

from basketlens.operators import cities

LOCALITIES = ["חיפה", "רמלה", "לוד", "עין חצבה", "חצבה", "אלונים", "קרית טבעון", "כרמל", "דאלית אל-כרמל", "קצרין", "גבע", "ירושלים", "פארן", "מיתר", "אורות", "Akko", "Acre Bay"]
REVIEWED = [("מתחם רונית", "חיפה"), ("מתחם עין", "עין חצבה"), ("מרכז מסחרי מיתר", "מיתר"), ("הדר", "חיפה")]
ALIASES = [("ירושלם", "ירושלים"), ("Acco", "Akko")]
BLOCKED = ["מחסן", "Depot"]


@pytest.mark.parametrize(
    ("name", "address", "want"),
    [
        ("קצרין", None, "קצרין"),
        ("שלי חיפה- חורב", None, "חיפה"),
        ("דיל קצרין- חרמון", "x", "קצרין"),
        ("שלי עין - חצבה", None, "עין חצבה"),  # the joined run wins over its part
        ("מתחם עין - חצבה", None, "עין חצבה"),  # a venue's name, but for its reviewed segment
        ("מתחם קרית - טבעון", None, None),
        ("רמלה - לוד", None, "רמלה"),  # names of unequal length: the first of the longest runs decides
        ("לוד - רמלה", None, "לוד"),
        ("גבע - כרמל - לוד", None, None),  # two localities of three letters
        ("BE אלונים- טבעון", "אלונים 1, קרית טבעון", None),  # a street
        ("יש מרים ירושלים- פארן", "פארן 7", None),
        ("קניון אורות", None, None),
        ("x - קניון אורות", None, None),  # a venue
        ("מתחם רונית", "קניון חיפה", "חיפה"),  # reviewed
        ("שלי - מרכז מסחרי מיתר", "מרכז מסחרי מיתר 3", "מיתר"),
        ("BE דלית אל כרמל", None, None),  # never a part of a name
        ("אקספרס דאלית אל כרמל", None, "דאלית אל-כרמל"),
        ("ירושלם", None, "ירושלים"),
        ("online - Akko", None, "Akko"),
        ("Be Acco", "Akko", "Akko"),
        ("Akko", "קצרין, x", None),  # the address names another
        ("Akko", "Akko (old), קצרין", "Akko"),
        ("מחסן", None, None),
        ("depot", None, None),
        ("Akko - depot", None, "Akko"),
        ("Be Depot - Akko", None, "Akko"),
        ("", None, None),
        (None, "Akko", None),
    ],
)
def test_strict_locality(spark, name, address, want):
    stores = spark.createDataFrame([(1, name, address)], "store_id long, store_name string, address string")
    pairs = lambda rows: spark.createDataFrame(rows, "alias string, city string")
    one = lambda rows: spark.createDataFrame([(x,) for x in rows], "name string")
    got = [r["named_city"] for r in cities.strict_locality(stores, one(LOCALITIES), pairs(ALIASES), pairs(REVIEWED), one(BLOCKED)).collect()]
    assert got == ([want] if want else [])


def test_dispatch(spark):
    cases = [
        ("'Tel-Aviv'", "x", "Tel Aviv"),  # an alias
        ("  Old   Town ", "x", "Old Town"),  # nothing known of it
        ("5000", None, "Tel Aviv"),  # a code
        ("0070", None, "Ashdod"),
        ("77", "Be Akko", "Gaz"),  # a code of the gazetteer only
        ("99999", "Be Akko", "Akko"),  # an unknown code: the name
        ("0", "queen st Tel Aviv", "Tel Aviv"),
        ("", "Ramot", "Jerusalem"),  # a neighbourhood
        (None, "Tel-Aviv", "Tel Aviv"),  # an alias as the name
        ("unknown", "Be Akko - north", "Akko"),
        ("Hand", "x", "Akko"),  # reviewed
        ("99999", "no place", None),
        (None, None, None),
    ]
    stores = spark.createDataFrame([(i, c, n, "a", "k") for i, (c, n, _) in enumerate(cases)], "store_id long, city string, store_name string, address string, code string")
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = cities.resolve_city(
        stores,
        frame([("5000", "Tel Aviv"), ("70", "Ashdod")], ["code", "city"]),
        frame([("Tel-Aviv", "Tel Aviv")], ["alias", "city"]),
        frame([("Tel Aviv",), ("Ashdod",), ("Jerusalem",)], ["city"]),
        frame([("77", "Gaz"), ("1", "Akko"), ("5000", "Tel Aviv - Yafo")], ["code", "name"]),
        frame([("Hand", "Akko")], ["alias", "city"]),
        frame([("depot",)], ["name"]),
        frame([("Ramot", "Jerusalem")], ["name", "city"]),
    )
    assert got.columns == stores.columns
    assert [r["city"] for r in got.orderBy("store_id").collect()] == [x for *_, x in cases]


def test_merges_by_address(spark):
    rows = [(1, "a", None), (2, "b", "the south road"), (3, "b", "north"), (4, "h", "sea, south"), (5, "h", None), (6, "z", None), (7, None, "south"), (8, "x", None)]
    stores = spark.createDataFrame(rows, "store_id long, city string, address string")
    got = cities.canonical_city(stores, [("a", "b"), ("b", "c"), ("h", "b"), ("x", "y"), ("y", "x")], [("b", "south", "s"), ("s", "never", "n")])
    assert {r["store_id"]: r["city"] for r in got.collect()} == {1: "c", 2: "s", 3: "c", 4: "s", 5: "c", 6: "z", 7: None, 8: cities.merge_closure([("x", "y"), ("y", "x")])["x"]}
