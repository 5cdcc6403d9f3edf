"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: compatibility forms, look-alike letters of other
scripts, and digits and signs that stand for letters ("1d10t").  Lexicon
entries are word beginnings, so inflected forms of one stem share an entry.
Entries and weights are smoothed log-odds of document counts in labelled
training rows.  A hit must start a word; the longest entry at a place counts.
Hits inside an exception phrase do not count; exception phrases are word pairs
around an entry that stand in clean training rows.  The score is a logistic
function of the hits' weight and of that weight by length.

Defined results: a null or empty text has no hits and the score of one without
hits; without both labels in the training rows every score is 0; rows with
equal ids are scored alike only if their texts are equal; a label row with a
null label is ignored and several labels of one id count as toxic if one is.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import crc32_mod5

#: The fit reads at most so many labelled documents of each label.
MAX_FIT_DOCS = 3000
MIN_PREFIX, MAX_PREFIX = 4, 10
MIN_DOCS, MIN_SHARE, MIN_LOG_ODDS, MAX_ENTRIES = 5, 0.01, 2.5, 20_000

#: Letters of other scripts that look like Latin ones, and digits
#: and signs used for letters.  Letters that share a stand-in fold together.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}


def _table() -> dict[int, str]:
    t = {ord(k): v for k, v in LOOK_ALIKES.items()}
    t |= {ord(k.upper()): v for k, v in LOOK_ALIKES.items()}
    t |= {c: chr(c).lower() for c in range(65, 91)}
    t |= {ord(k): v for k, v in STAND_INS.items()}
    t[ord("L")] = "i"
    return t


_FOLD = _table()
_ZERO_WIDTH = re.compile("[​-‏⁠﻿­]")
_OTHER = re.compile("[^\x00-\x7f¡-ɏ]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The text as it is matched; only texts with unusual characters pay for normalisation."""
    if _OTHER.search(text):
        text = unicodedata.normalize("NFKC", _ZERO_WIDTH.sub("", text))
    return text.lower().translate(_FOLD)


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    #: intercept, weight of the sum, weight of the sum by length.
    curve: tuple[float, float, float] | None = None


class Matcher:
    """The automaton of one model."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.auto = model, ahocorasick.Automaton()
        for w, v in model.entries.items():
            self.auto.add_word(w, (len(w), v))
        if model.entries:
            self.auto.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the longest entries that start a word."""
        if not self.model.entries:
            return []
        best: dict[int, tuple[int, float]] = {}
        for end, (n, v) in self.auto.iter(folded):
            start = end + 1 - n
            if start and folded[start - 1].isalnum():
                continue
            if start not in best or best[start][0] < n:
                best[start] = (n, v)
        return [(s, s + n, v) for s, (n, v) in sorted(best.items()) if not (self.model.exceptions and self._excepted(folded, s))]

    def _excepted(self, folded: str, start: int) -> bool:
        return any(p in self.model.exceptions for p in phrases(folded, start))

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        weight = sum(v for _, _, v in self.hits(folded))
        if not weight:
            return 0.0, 0.0
        return float(np.log1p(weight)), float(np.log1p(100 * weight / max(1, len(_WORD.findall(folded)))))

    def score(self, text: str) -> float:
        if self.model.curve is None:
            return 0.0
        a, b = self.features(text)
        c = self.model.curve
        return float(1 / (1 + np.exp(-np.clip(c[0] + c[1] * a + c[2] * b, -50, 50))))


def phrases(folded: str, start: int) -> list[str]:
    """The word at ``start`` with the word before it and with the one after it."""
    word = _WORD.match(folded, start)
    if word is None:
        return []
    out = []
    before = re.search(r"([^\W_]+)[^\w\n]{1,3}$", folded[max(0, start - 40) : start])
    after = re.match(r"[^\w\n]{1,3}([^\W_]+)", folded[word.end() : word.end() + 40])
    if before:
        out.append(f"{before[1]} {word[0]}")
    if after:
        out.append(f"{word[0]} {after[1]}")
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, text, y): at most ``max_docs`` training rows of each label, by a hash of the id.

    The chosen ids are at most 2 * max_docs rows, so they may be broadcast.
    """
    y = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    y = y.where(crc32_mod5(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y"))
    y = y.withColumn("h", F.xxhash64("id"))
    few = [y.where(F.col("y") == v).orderBy("h", "id").limit(max_docs) for v in (0, 1)]
    few = few[0].unionByName(few[1])
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    return d.join(F.broadcast(few), d.doc_id == few.id).select("doc_id", "text", "y")


def fit(rows: DataFrame) -> Model:
    """Learn entries, exceptions and curve from ``training_rows``."""

    def count(batches):
        for b in batches:
            terms, ys = [], []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = set()
                for w in set(_WORD.findall(fold(t))):
                    seen.update(w[:k] for k in range(MIN_PREFIX, min(len(w), MAX_PREFIX) + 1))
                terms += seen
                ys += [y] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ys, pa.int32())], names=["term", "y"])

    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model()
    c = rows.select("text", "y").mapInArrow(count, "term string, y int").groupBy("term").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1.0)) - F.log((F.col("c0") + 0.5) / (n0 + 1.0))
    got = c.where((F.col("c1") >= max(MIN_DOCS, MIN_SHARE * n1)) & (odds >= MIN_LOG_ODDS)).select("term", "c1", "c0", odds.alias("w")).orderBy(F.desc("w"), "term").limit(MAX_ENTRIES).collect()
    by_term = {r.term: r for r in got}
    # a longer entry stays only if it says more than its beginning does
    entries = {t: r.w for t, r in by_term.items() if not any(t[:k] in by_term and by_term[t[:k]].w >= r.w - 0.5 for k in range(MIN_PREFIX, len(t)))}
    plain = Matcher(Model(entries))

    def look(batches):
        for b in batches:
            y, around = b.column(1).to_pylist(), []
            for t in b.column(0).to_pylist():
                f = fold(t)
                around.append(sorted({p for s, _, _ in plain.hits(f) for p in phrases(f, s)}))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(around, pa.list_(pa.string()))], names=["y", "p"])

    near = rows.select("text", "y").mapInArrow(look, "y int, p array<string>").select("y", F.explode("p").alias("p"))
    near = near.groupBy("p").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")).where((F.col("c0") >= 3) & (F.col("c0") >= 9 * F.col("c1")))
    model = Model(entries, frozenset(r.p for r in near.orderBy(F.desc("c0"), "p").limit(MAX_ENTRIES).collect()))
    matcher = Matcher(model)

    def features(batches):
        for b in batches:
            f = [matcher.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[0] for x in f]), pa.array([x[1] for x in f])], names=["y", "a", "b"])

    pts = rows.select("text", "y").mapInArrow(features, "y int, a double, b double").toPandas()
    model.curve = logistic(pts[["a", "b"]].to_numpy(), pts["y"].to_numpy())
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Newton steps with a small ridge; both labels weigh the same in all."""
    a = np.hstack([np.ones((len(x), 1)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(3)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score added; Arrow batches, no shuffle."""
    d = docs.drop(out)
    schema = T.StructType([*d.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        matcher = Matcher(model)
        for b in batches:
            s = [matcher.score(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return d.mapInArrow(run, schema)
