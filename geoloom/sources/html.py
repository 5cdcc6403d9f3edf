"""HTML tables by regular expressions on columns; positions come from the text before a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import text


def elements(html: Column, tag: str) -> Column:
    """array<string>: the elements of a tag, without nesting."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[ >].*?</{tag}>"), F.lit(0))


def cells(row: Column) -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][ >].*?</t[dh]>"), F.lit(0)), text.html_text)


def events(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """(key, pos, piece): matches of ``pattern`` in document order with their offsets.

    The page is cut at every match; offsets are running sums of piece lengths.
    """
    gaps = F.regexp_extract_all(html, F.lit(rf"(?is)(.*?)({pattern}|\z)"), F.lit(1))
    hits = F.regexp_extract_all(html, F.lit(rf"(?is)(.*?)({pattern}|\z)"), F.lit(2))
    d = pages.select(key, gaps.alias("g"), hits.alias("m"))
    sums = F.expr("transform(sequence(0, size(m) - 1), i -> aggregate(slice(g, 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(m, 1, i), 0, (a, x) -> a + length(x)))")
    return d.select(key, F.explode(F.arrays_zip(sums.alias("pos"), F.col("m").alias("piece"))).alias("e")).select(key, "e.pos", "e.piece").where("piece <> ''")


def tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, rows array<array<string>>): every table with more than one cell in some row."""
    t = events(pages, key, html, r"<table[ >].*?</table>")
    rows = F.filter(F.transform(elements(F.col("piece"), "tr"), cells), lambda r: F.size(r) > 1)
    return t.select(key, "pos", rows.alias("rows"))


def labels(pages: DataFrame, pattern: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, label): texts of matching elements, such as headings or buttons."""
    e = events(pages, key, html, pattern)
    return e.select(key, "pos", text.html_text(F.col("piece")).alias("label"))


def labelled(t: DataFrame, l: DataFrame, reach: int, key: str = "page_id") -> DataFrame:  # noqa: E741
    """Tables with the nearest label before them, at most ``reach`` characters back (an as-of window)."""
    from geoloom.operators.rollups import preceding_label

    both = t.withColumn("label", F.lit(None).cast("string")).unionByName(l.withColumn("rows", F.lit(None).cast("array<array<string>>")))
    out = preceding_label(both, key, "pos", F.col("label"), reach, out="near")
    return out.where(F.col("rows").isNotNull()).select(key, "pos", "rows", F.col("near").alias("label"))
