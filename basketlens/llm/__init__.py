"""Training-data operators over text, page and embedding tables.

Nothing else in the library imports this package.  Every operator is a plain
function from DataFrames to a DataFrame; the thin queries over the test tables
are in :mod:`basketlens.llm.queries`.
"""
