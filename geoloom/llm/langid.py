"""Language identification by a byte convolutional network, in numpy.

Texts are cut into fixed windows of WINDOW bytes that cover the whole text.
Bytes are folded to 128 classes, embedded, run through filters of widths 2, 3
and 4, max-pooled over the window and classified by softmax; a document's
probabilities are the mean over its windows, weighted by their bytes.

Defined results: a null, empty or letterless text gives ``und`` with score 0;
without any labelled row every text gives ``und``; repeated rows are predicted
alike; input columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm import arrowbytes
from geoloom.llm.common import crc32_mod5, small_batches

WINDOW = 256
DIM, FILTERS, WIDTHS = 8, 8, (2, 3, 4)
#: The fit uses at most this many labelled documents, and of each at most
#: WINDOWS_EACH windows spread over the text.
MAX_FIT_DOCS, WINDOWS_EACH = 2000, 4
UNKNOWN = "und"


def _classes() -> np.ndarray:
    """256 bytes -> 128 classes: letters without case, digits as one, the other ASCII by kind, high bytes by their low bits."""
    t = np.zeros(256, np.uint8)
    for b in range(1, 256):
        if b >= 0x80:
            t[b] = 40 + (b & 0x3F) if b < 0xC0 else 104 + (b - 0xC0) % 24
        elif chr(b).isalpha():
            t[b] = 1 + ord(chr(b).lower()) - ord("a")
        elif chr(b).isdigit():
            t[b] = 27
        else:
            t[b] = 28 if b in (32, 9, 10, 11, 12, 13) else 29 + b % 8
    return t


CLASSES = _classes()


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes [n, WINDOW], row of each window, bytes in each window), over whole texts."""
    lens = np.diff(offsets)
    counts = -(-lens // WINDOW)
    rows = np.repeat(np.arange(len(lens)), counts)
    starts = arrowbytes.ragged(np.zeros(len(lens), np.int64), counts) * WINDOW
    size = np.minimum(lens[rows] - starts, WINDOW)
    out = np.zeros((len(rows), WINDOW), np.uint8)
    dest = np.cumsum(counts) - counts
    flat = out.reshape(-1)
    for i in np.flatnonzero(lens):
        a = dest[i] * WINDOW
        flat[a : a + lens[i]] = CLASSES[raw[offsets[i] : offsets[i + 1]]]
    return out, rows, size


class Model:
    """Parameters of the network; ``labels`` in sorted order."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.emb = r.normal(0, 0.5, (128, DIM)).astype(np.float32)
        self.conv = [r.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.conv, *self.bias, self.out, self.out_bias]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Per class pair the partial sums of every filter, and the last tap of width 3."""
        e, (c2, c3, c4) = self.emb, self.conv
        first, second = e @ np.hstack([c2[:DIM], c3[:DIM], c4[:DIM], c4[2 * DIM : 3 * DIM]]), e @ np.hstack([c2[DIM:], c3[DIM : 2 * DIM], c4[DIM : 2 * DIM], c4[3 * DIM :]])
        return (first[:, None, :] + second[None, :, :]).reshape(128 * 128, 4 * FILTERS).astype(np.float32), (e @ c3[2 * DIM :]).astype(np.float32)

    def pooled(self, x: np.ndarray, tables) -> np.ndarray:
        """Max-pooled features [n, 24] of windows [n, WINDOW]."""
        pair, last = tables
        f = FILTERS
        t = pair[(x[:, :-1].astype(np.int32) << 7) | x[:, 1:]]
        c2 = t[:, :, :f].max(1)
        c3 = (t[:, :-1, f : 2 * f] + last[x[:, 2:]]).max(1)
        c4 = (t[:, :-2, 2 * f : 3 * f] + t[:, 2:, 3 * f :]).max(1)
        return np.maximum(np.hstack([c2, c3, c4]) + np.hstack(self.bias), 0)

    def probabilities(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        tables = self.tables()
        h = [self.pooled(x[i : i + step], tables) for i in range(0, len(x), step)]
        z = (np.vstack(h) if h else np.zeros((0, len(WIDTHS) * FILTERS), np.float32)) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True, initial=0))
        return z / z.sum(1, keepdims=True)


def train(model: Model, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.01, seed: int = 11) -> Model:
    """Adam on cross-entropy with equal weight for each label; gradients pass the argmax positions only."""
    r = np.random.default_rng(seed)
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(model.labels)), 1) / len(model.labels)).astype(np.float32)
    ps = model.params()
    m, v, t = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for s in range(0, len(order), batch):
            k = order[s : s + batch]
            xb, yb = x[k].astype(np.int64), y[k]
            n = len(k)
            e = model.emb[xb]
            feats, args = [], []
            for w, c, b in zip(WIDTHS, model.conv, model.bias, strict=True):
                a = sum(e[:, j : WINDOW - w + 1 + j] @ c[j * DIM : (j + 1) * DIM] for j in range(w))
                args.append(a.argmax(1))
                feats.append(a.max(1) + b)
            pre = np.hstack(feats)
            h = np.maximum(pre, 0)
            z = h @ model.out + model.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p *= weight[yb][:, None] / n
            g_out, g_ob = h.T @ p, p.sum(0)
            g_h = (p @ model.out.T) * (pre > 0)
            g_emb, g_conv, g_bias = np.zeros_like(model.emb), [], []
            for i, (w, c) in enumerate(zip(WIDTHS, model.conv, strict=True)):
                gh = g_h[:, i * FILTERS : (i + 1) * FILTERS]
                taps = np.arange(w)
                cls = xb[np.arange(n)[:, None, None], args[i][:, :, None] + taps]  # n, filters, w
                seen = model.emb[cls].reshape(n, FILTERS, w * DIM)
                g_conv.append(np.einsum("nf,nfd->df", gh, seen))
                g_bias.append(gh.sum(0))
                back = (gh[:, :, None] * c.T[None]).reshape(n, FILTERS, w, DIM)
                np.add.at(g_emb, cls.reshape(-1), back.reshape(-1, DIM))
            t += 1
            for q, g, mq, vq in zip(ps, [g_emb, *g_conv, *g_bias, g_out, g_ob], m, v, strict=True):
                mq += 0.1 * (g - mq)
                vq += 0.001 * (g * g - vq)
                q -= rate * (mq / (1 - 0.9**t)) / (np.sqrt(vq / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_FIT_DOCS) -> Model | None:
    """Fit on at most ``max_docs`` rows with text and label whose id is not held out.

    Rows are chosen by a hash of the id, so the choice does not depend on the
    layout of the table.  Only window cuts travel to the driver.
    """
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull() & (crc32_mod5(F.col("i")) != 0))
    n = rows.select("i", "l").count()
    h = F.pmod(F.xxhash64("i"), F.lit(1 << 30))
    if n > max_docs:
        rows = rows.where(h < int((1 << 30) * min(1.0, 1.2 * max_docs / n)))
    last = WINDOWS_EACH - 1
    cut = F.expr(f"array_distinct(transform(sequence(0, {last}), k -> substring(t, 1 + cast(k * greatest(length(t) - {WINDOW}, 0) div {last} as int), {WINDOW})))")
    got = rows.select(h.alias("h"), "i", "l", cut.alias("w")).orderBy("h", "i", "l", "w").limit(max_docs).collect()
    if not got:
        return None
    labels = sorted({r.l for r in got})
    cuts = [(w.encode()[:WINDOW], labels.index(r.l)) for r in got for w in r.w if any(c.isalpha() for c in w)]
    if not cuts:
        return None
    x = np.zeros((len(cuts), WINDOW), np.uint8)
    for i, (w, _) in enumerate(cuts):
        x[i, : len(w)] = CLASSES[np.frombuffer(w, np.uint8)]
    return train(Model(labels), x, np.array([y for _, y in cuts]))


def _predict_batch(model: Model | None, col: pa.Array) -> tuple[list[str], np.ndarray]:
    raw, offsets = arrowbytes.flat(col)
    n = len(offsets) - 1
    names, score = np.full(n, UNKNOWN, object), np.zeros(n)
    if model is None:
        return names.tolist(), score
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    for a, b in arrowbytes.slices(offsets, 1 << 20):
        off = offsets[a : b + 1] - offsets[a]
        part = raw[offsets[a] : offsets[b]]
        x, rows, size = windows(part, off)
        if not len(rows):
            continue
        p = model.probabilities(x) * size[:, None]
        total = np.zeros((b - a, p.shape[1]))
        np.add.at(total, rows, p)
        has = np.zeros(b - a, bool)
        seen = letter[part]
        for i in range(b - a):
            u, w = off[i], off[i + 1]
            has[i] = w > u and (seen[u : min(u + 64, w)].any() or seen[u:w].any() or any(c.isalpha() for c in bytes(part[u:w]).decode("utf-8", "replace")))
        k = total.argmax(1)
        ok = np.flatnonzero(has)
        names[a + ok] = np.array(model.labels, object)[k[ok]]
        score[a + ok] = (total[ok, k[ok]] / total[ok].sum(1)).clip(0, 1)
    return names.tolist(), score


def identify(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with columns ``pred`` and ``score`` added; Arrow batches, no shuffle."""
    small_batches(docs.sparkSession)
    d = docs.drop(pred, score)
    schema = T.StructType([*d.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        for b in batches:
            names, p = _predict_batch(model, b.column(b.schema.get_field_index(text)))
            cols = [*b.columns, pa.array(names, pa.string()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, pred, score])

    return d.mapInArrow(run, schema)
