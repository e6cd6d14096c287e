"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

LONG = "word and another " * 3000

#: Null and empty texts, a null id, repeated rows, white space only, a very long text.
AWKWARD = [
    (1, None, "en"), (2, "", "en"), (None, "a text without an id", None), (3, "twice the same row", "fr"),
    (3, "twice the same row", "fr"), (4, " \t\n ", "xx"), (5, LONG, "en"), (6, "ünïcödé \U0001f600 wörds — and more", "de"),
]


def table(spark, rows, extra=True):
    """``doc_id, text, lang`` with extra columns whose names clash with what operators make."""
    df = spark.createDataFrame(list(rows), "doc_id long, text string, lang string")
    if not extra:
        return df
    return df.selectExpr("*", "'x' as spans", "1 as piece", "2 as rank", "'y' as blob", "3 as anchor", "'z' as row", "4 as label", "5 as print")


def empty(spark):
    return table(spark, [])
