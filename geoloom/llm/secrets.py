"""Secret scan by a trigram inverted index (DataFrame functions only).

Each rule's regex yields a Boolean trigram query.  One pass over the texts makes
the postings of the trigrams that any rule asks for, as bitmaps: one bit a
trigram, kept beside the row, so that intersecting postings is an AND of words
and neither texts nor postings are shuffled.  Only the candidates of a rule are
verified with its regex.  Rules without a mandatory trigram scan every text.

Defined results: a null text counts as empty and has no spans; each row, repeated
ones and ones without an id too, is scanned on its own; extra columns are
ignored but for those to be kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import trigrams


@dataclass(frozen=True)
class Rule:
    """``min_group``: matches count only if that regex group has ``min_chars`` characters or more."""

    kind: str
    regex: str
    min_group: int
    min_chars: int


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")

#: The base rules in the contract's order, then the method's own.
BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE_RULES + MORE_RULES


def _finder(regex: str) -> str:
    """Group 1: the gap before a match; group 2: the match, empty at the end of the text."""
    return rf"(?s)(.*?)(?:({regex})|\z)"


def _spans(text: Column, rule: Rule, kind_no: int) -> Column:
    """array<struct<s, k, e, t>> of the rule's matches in code points.

    Starts are prefix sums of gap and match lengths, summed in two levels of
    256 so that a text with many matches stays near linear.
    """
    pattern = F.lit(_finder(rule.regex))
    gaps = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.length)
    found = F.regexp_extract_all(text, pattern, F.lit(2))

    def with_lens(g: Column, m: Column) -> Column:
        lens = F.transform(m, lambda x, i: F.get(g, i) + F.length(x))
        zero = F.lit(0)
        add = lambda a, x: a + x

        def placed(lens: Column) -> Column:
            def with_blocks(blocks: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    b = F.floor(i / 256).cast("int")
                    before = F.aggregate(F.slice(blocks, F.lit(1), b), zero, add) + F.aggregate(F.slice(lens, b * 256 + 1, i - b * 256), zero, add)
                    start = before + F.get(g, i)
                    value = x if rule.min_group == 0 else F.regexp_extract(x, rule.regex, rule.min_group)
                    ok = (F.length(x) > 0) & (F.length(value) >= rule.min_chars)
                    return F.when(ok, F.struct(start.alias("s"), F.lit(kind_no).alias("k"), (start + F.length(x)).alias("e")))

                return F.array_compact(F.transform(m, one))

            blocks = F.transform(F.sequence(zero, F.floor(F.size(lens) / 256).cast("int")), lambda c: F.aggregate(F.slice(lens, c * 256 + 1, F.lit(256)), zero, add))
            return _let(blocks, with_blocks)

        return _let(lens, placed)

    return _let(gaps, lambda g: _let(found, lambda m: with_lens(g, m)))


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: a transform over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits of one word of postings.
WORD = 62


def queries(rules=RULES) -> tuple[list[str], dict[int, list[frozenset[str]]]]:
    """(the trigrams that any rule asks for, Boolean queries by rule)."""
    found = {r: q for r, rule in enumerate(rules) if (q := trigrams.query(rule.regex)) is not None}
    return sorted({t for q in found.values() for s in q for t in s}), found


def postings(low: Column, terms: list[str]) -> Column:
    """array<long>: bit i of the words tells whether the case-folded text holds trigram i."""
    bit = lambda t, k: F.when(F.contains(low, F.lit(t)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    words = [terms[x : x + WORD] for x in range(0, len(terms), WORD)]
    return F.array(*[reduce(lambda a, b: a.bitwiseOR(b), [bit(t, k) for k, t in enumerate(w)]) for w in words])


def candidate(held: Column, query: list[frozenset[str]], terms: list[str]) -> Column:
    """Whether the postings of all trigrams of some alternative meet in the row."""
    alternatives = F.lit(False)
    for wanted in query:
        masks = [0] * (-(-len(terms) // WORD))
        for t in wanted:
            w, k = divmod(terms.index(t), WORD)
            masks[w] |= 1 << k
        both = [held[w].bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for w, m in enumerate(masks) if m]
        alternatives = alternatives | reduce(lambda a, b: a & b, both)
    return alternatives


def scan(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, spans array<struct<s, k, e>> per row, sorted by start, then rule; and the columns ``keep``, but for ones named like these."""
    keep = tuple(k for k in keep if k not in ("doc_id", "text", "spans"))
    terms, asked = queries(rules)
    d = docs.select(F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("low", F.lower("text"))
    d = d.select("kept", "doc_id", "text", postings(F.col("low"), terms).alias("held"))
    found = []
    for r, rule in enumerate(rules):
        if r in asked:
            gate = candidate(F.col("held"), asked[r], terms) & F.col("text").rlike(rule.regex)
        else:
            # a plain run of min_chars decides first whether spans are worked out
            gate = F.col("text").rlike(rule.regex[:-1] + f"{{{rule.min_chars},}}" if rule.regex.endswith("+") else rule.regex)
        found.append(F.when(gate, _spans(F.col("text"), rule, r)).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>")))
    return d.select("doc_id", "text", *[F.col("kept")[k].alias(k) for k in keep], F.sort_array(F.concat(*found)).alias("spans"))


def digest(scanned: DataFrame, rules=RULES, n_base: int = len(BASE_RULES)) -> DataFrame:
    """The columns of the query contract from ``scan``'s rows."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    told = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{rules[k].kind}") for k in range(n_base)],
        F.sha2(told(F.filter("spans", lambda x: x["k"] < n_base)), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``scanned`` without spans; in its text every span, overlaps joined, is replaced by ``mark``."""
    gap = F.expr("""aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, x) -> CASE WHEN x.e <= a.at THEN a
                       WHEN x.s < a.at THEN named_struct('at', x.e, 'out', a.out)
                       ELSE named_struct('at', x.e, 'out', concat(a.out, array(substring(text, a.at + 1, x.s - a.at)))) END,
        a -> concat(a.out, array(substring(text, a.at + 1))))""")
    out = F.when(F.size("spans") > 0, F.array_join(gap, mark)).otherwise(F.col("text"))
    return scanned.withColumn("text", out).drop("spans")


def oracle_sql(rules=RULES, n_base: int = len(BASE_RULES)) -> str:
    """The same spans in DuckDB, scanning every text with every rule."""
    esc = lambda s: s.replace("'", "''")
    kinds = []
    for k, r in enumerate(rules):
        value = "m[i]" if r.min_group == 0 else f"regexp_extract(m[i], '{esc(r.regex)}', {r.min_group})"
        kinds.append(f"""
  SELECT rn, {k} AS k, '{r.kind}' AS kind, list_sum(lens[1:i]) - length(m[i]) AS s, list_sum(lens[1:i]) AS e
  FROM (SELECT rn, m, list_transform(range(1, len(m) + 1), lambda j: length(g[j]) + length(m[j])) AS lens, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT rn, regexp_extract_all(t, '{esc(_finder(r.regex))}', 1) AS g, regexp_extract_all(t, '{esc(_finder(r.regex))}', 2) AS m
              FROM d WHERE regexp_matches(t, '{esc(r.regex)}')))
  WHERE m[i] <> '' AND length({value}) >= {r.min_chars}""")
    counts = ", ".join(f"CAST(count(k) FILTER (WHERE k = {k}) AS BIGINT) AS n_{rules[k].kind}" for k in range(n_base))
    told = "kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, k, e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(kinds)})
SELECT doc_id, {counts},
  sha256(coalesce(string_agg({told}) FILTER (WHERE k < {n_base}), '')) AS base_sha256,
  coalesce(string_agg({told}), '') AS spans
FROM d LEFT JOIN s USING (rn) GROUP BY rn, doc_id
"""
