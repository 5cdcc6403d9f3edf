"""Quality rules with adaptive thresholds (DataFrame functions only).

Every document gets integer metrics.  Per language and source each metric is
summarised by a quantile sketch: a log-linear histogram whose buckets keep the
six highest bits of a value, so it has a few hundred buckets, no rank error at
its bucket bounds and values to within one part in 32 (exact below 64).  Two
sketches merge by adding counts, so Spark builds them with map-side partial
sums, and the sketch of a language (or of everything) is the merged sketch of
its sources.

A group's fence lies REACH times as far beyond its TAIL quantile as that lies
from the median, so the group's own spread decides; no cutoff is fixed.  A
document is judged by the bound that its own size allows: counts less Z times
their square root, word length give or take its standard error.  The fences are
joined back to the documents.

Defined results: a null or empty text has no words and fails the base rule; a
null language or source is a group of its own; repeated rows are judged one by
one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Groups with fewer documents borrow the merged sketch of their language.
MIN_GROUP = 50
#: Tail quantile in tenths (the lower one is its mirror), reach of a fence, deviations taken off a count.
TAIL, REACH, Z = 9, 6, 2
#: metric -> whether it has a lower fence too; counts in 1/10,000, word length in 1/100.
METRICS = {"sym": False, "dup": False, "rep": False, "wlen": True}


def base_metrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts per document; one narrow pass, no shuffle.

    Three-word windows are compared by 64-bit xxhash within one document.
    """
    d = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    d = d.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    d = d.select(
        "doc_id", "lang", "source", "w", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 3,
            F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"),
        ).alias("h"),
    )
    d = d.drop("w").withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.expr("sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))"),
        ),
    ).drop("h")
    d = d.withColumn(
        "p",
        F.expr("""transform(filter(s, (x, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = x.h)
                                  OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i)"""),
    ).drop("s")
    repeat = F.size(F.array_distinct(F.flatten(F.transform("p", lambda i: F.array(i, i + 1, i + 2)))))
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        F.when(F.col("p").isNull(), F.lit(0)).otherwise(repeat).cast("long").alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def _rate(num: Column, den: Column) -> Column:
    """Least likely rate of a count, in 1/10,000."""
    return F.floor(10000 * F.greatest(F.lit(0.0), num - Z * F.sqrt(num)) / F.greatest(den, F.lit(1))).cast("long")


def metric_columns() -> dict[str, Column]:
    """What the sketches hold."""
    c = F.col
    return {
        "sym": _rate(c("n_symbols"), c("word_chars")), "dup": _rate(c("n_dup_lines"), c("n_lines")), "rep": _rate(c("n_repeat_words"), c("n_words")),
        "wlen": F.floor(100 * c("word_chars") / F.greatest(c("n_words"), F.lit(1))).cast("long"),
    }


def _inside() -> Column:
    """Whether a document lies within the fences that hold for it."""
    value, n = metric_columns(), F.greatest(F.col("n_words"), F.lit(1))
    out = F.lit(True)
    for m, both in METRICS.items():
        low, high = (value[m] * (1 - 1 / F.sqrt(n)), value[m] * (1 + 1 / F.sqrt(n))) if both else (value[m], value[m])
        out = out & (low <= F.col(f"{m}_hi"))
        if both:
            out = out & (high >= F.col(f"{m}_lo"))
    return out


def bucket(v: Column) -> Column:
    """The lowest value of v's bucket: its six highest bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", v, _spare(v)), _spare(v))


def _spare(v: Column) -> Column:
    return F.greatest(F.length(F.bin(v)) - 6, F.lit(0))


def sketches(metrics: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): a few hundred rows a metric and group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metric_columns().items()]))
    return (
        metrics.where(~F.col("base_failed")).select("lang", "source", pairs.alias("m"))
        .groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))
    )


def merge_sketches(sketch: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches to coarser groups by adding their buckets."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """Fences from a sketch's quantiles, one row a group: n, <metric>_hi, <metric>_lo."""
    from pyspark.sql import Window

    part = Window.partitionBy(*keys, "metric")
    cum = part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    d = sketch.withColumn("cum", F.sum("n").over(cum)).withColumn("tot", F.sum("n").over(part))
    q = lambda k: F.min(F.when(10 * F.col("cum") >= k * F.col("tot"), F.col("bucket")))
    d = d.groupBy(*keys, "metric").agg(F.max("tot").alias("n"), q(10 - TAIL).alias("low"), q(5).alias("mid"), q(TAIL).alias("high"))
    out = [F.max("n").alias("n")]
    for m, both in METRICS.items():
        of = lambda x: F.max(F.when(F.col("metric") == m, x))  # noqa: B023, E731
        out.append(of(F.col("high") + REACH * (F.col("high") - F.col("mid"))).alias(f"{m}_hi"))
        if both:
            out.append(of(F.col("low") - REACH * (F.col("mid") - F.col("low"))).alias(f"{m}_lo"))
    return d.groupBy(*keys).agg(*out)


def thresholds(metrics: DataFrame) -> DataFrame:
    """One row per (lang, source) seen in ``metrics`` with the fences that hold for it."""
    sketch = sketches(metrics)
    by_lang = merge_sketches(sketch, "lang")
    overall = merge_sketches(by_lang)
    cols = [c for m, both in METRICS.items() for c in ([f"{m}_hi", f"{m}_lo"] if both else [f"{m}_hi"])]
    own = fences(sketch, "lang", "source").alias("o")
    lang = fences(by_lang, "lang").alias("l")
    top = fences(overall.withColumn("g", F.lit(1)), "g").alias("t")  # one row
    groups = metrics.groupBy("lang", "source").agg(F.count("*").alias("group_rows")).alias("g")
    j = (
        groups.join(own, F.col("g.lang").eqNullSafe(F.col("o.lang")) & F.col("g.source").eqNullSafe(F.col("o.source")), "left")
        .join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang")), "left")
        .join(F.broadcast(top), F.lit(1) == F.col("t.g"), "left")
    )
    pick = lambda c: (
        F.when(F.col("o.n") >= MIN_GROUP, F.col(f"o.{c}")).when(F.col("l.n") >= MIN_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"t.{c}"))
    )
    return j.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *[pick(c).alias(c) for c in cols])


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Metrics and verdict of every row of ``docs``."""
    m = materialize(base_metrics(docs, doc_id, text, lang, source))
    t = thresholds(m).alias("t")
    m = m.alias("m")
    j = m.join(t, F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "inner")
    return j.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(_inside(), F.lit(True))).alias("kept"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, lang, source, row_number() OVER () AS rn,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dupw AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rn, count(DISTINCT i + k) AS n_repeat_words FROM dupw, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rn),
m AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rn)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CAST(floor(10000 * greatest(0.0::DOUBLE, n_symbols - 2 * sqrt(n_symbols)) / greatest(word_chars, 1)) AS BIGINT) AS sym,
         CAST(floor(10000 * greatest(0.0::DOUBLE, n_dup_lines - 2 * sqrt(n_dup_lines)) / greatest(n_lines, 1)) AS BIGINT) AS dup,
         CAST(floor(10000 * greatest(0.0::DOUBLE, n_repeat_words - 2 * sqrt(n_repeat_words)) / greatest(n_words, 1)) AS BIGINT) AS rep,
         CAST(floor(100 * word_chars / greatest(n_words, 1)) AS BIGINT) AS wlen, sqrt(greatest(n_words, 1)) AS root
  FROM m),
g AS (SELECT * FROM b WHERE NOT base_failed),
q AS (
  SELECT GROUPING(lang) + GROUPING(source) AS lvl, lang, source, count(*) AS n,
    [quantile_disc(sym, 0.5), quantile_disc(sym, 0.9)] AS s, [quantile_disc(dup, 0.5), quantile_disc(dup, 0.9)] AS d,
    [quantile_disc(rep, 0.5), quantile_disc(rep, 0.9)] AS r, [quantile_disc(wlen, 0.1), quantile_disc(wlen, 0.5), quantile_disc(wlen, 0.9)] AS w
  FROM g GROUP BY GROUPING SETS ((lang, source), (lang), ())),
f AS (
  SELECT lvl, lang, source, n, ROUNDED(s) AS s, ROUNDED(d) AS d, ROUNDED(r) AS r, ROUNDED(w) AS w FROM q),
t AS (
  SELECT lvl, lang, source, n, s[2] + 6 * (s[2] - s[1]) AS sym_hi, d[2] + 6 * (d[2] - d[1]) AS dup_hi, r[2] + 6 * (r[2] - r[1]) AS rep_hi,
         w[3] + 6 * (w[3] - w[2]) AS wlen_hi, w[1] - 6 * (w[2] - w[1]) AS wlen_lo
  FROM f)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  NOT b.base_failed AND coalesce(CASE WHEN o.n >= 50 THEN INSIDE(o) WHEN l.n >= 50 THEN INSIDE(l) ELSE INSIDE(a) END, true) AS kept
FROM b
LEFT JOIN (SELECT * FROM t WHERE lvl = 0) o ON b.lang IS NOT DISTINCT FROM o.lang AND b.source IS NOT DISTINCT FROM o.source
LEFT JOIN (SELECT * FROM t WHERE lvl = 1) l ON b.lang IS NOT DISTINCT FROM l.lang
LEFT JOIN (SELECT * FROM t WHERE lvl = 2) a ON true
"""
for _k in "sdrw":
    ORACLE = ORACLE.replace(f"ROUNDED({_k})", f"list_transform({_k}, lambda v: (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0))")
for _k in "ola":
    ORACLE = ORACLE.replace(f"INSIDE({_k})", " AND ".join(f"b.{m} <= {_k}.{m}_hi" for m in ("sym", "dup", "rep")) + f" AND b.wlen * (1 - 1 / b.root) <= {_k}.wlen_hi AND b.wlen * (1 + 1 / b.root) >= {_k}.wlen_lo")
