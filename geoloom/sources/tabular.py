"""CSV and JSON files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def header(names: list[str]) -> list[str]:
    """Trimmed names; the second ``a`` becomes ``a_2``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = (n or "").replace("﻿", "").strip()
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """String columns by the first row's names: quoted newlines and doubled quotes are kept, short rows
    are filled with '', overflow cells go, lines of one blank cell are skipped."""
    options = {"multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    first = spark.read.csv(path, header=False, **options).first()
    if first is None:
        return spark.createDataFrame([], "empty string").drop("empty")
    raw = [v for v in first]
    while raw and raw[-1] is None:
        raw.pop()
    names = header(raw)
    schema = ", ".join(f"`{n or f'_{i}'}` string" for i, n in enumerate(names))
    d = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE", **options)
    d = d.na.fill("")
    blank = F.lit(True)
    for c in d.columns:
        blank = blank & (F.trim(F.col(f"`{c}`")) == "")
    return d.where(~blank)


def csv_cell(x: Column) -> Column:
    """A cell's text: quoted only if it holds a comma, a quote or a line break."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(d: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(value): one CSV line a row."""
    cols = columns or d.columns
    return d.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in cols]).alias("value"))


def csv_header(columns: list[str]) -> str:
    return ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\n\r') else c for c in columns)
