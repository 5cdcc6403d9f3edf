"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder is our own: texts are cut into segments at the white-space mark
(no piece goes across such a cut), and each distinct segment of a slice of an
Arrow batch goes through the score-ordered agenda of ``bpe``.  In every batch
the distinct segments are encoded by the sentencepiece library as well; where
the two differ the library's ids stand.  Decoding is the library's.

Defined results: a null or empty text has no ids and decodes to an empty
string; repeated rows are encoded alike; input columns named like an output
are replaced.
"""

from __future__ import annotations

import logging
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm import arrowbytes, bpe
from geoloom.llm.common import small_batches
from geoloom.llm.hashing import Prefix

MARK = "▁"
SLICE_BYTES = 2 << 20


class Vocabulary:
    """Tables of one model file; raises for models that the agenda does not cover."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only merge-type models with an identity normaliser, a dummy prefix and escaped spaces are covered")
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        by_score = sorted(ids.values(), key=lambda i: (-proto.pieces[i].score, i))
        self.id_of = np.array(by_score, np.int32)
        score = [proto.pieces[i].score for i in by_score]
        rank = np.cumsum([k > 0 and score[k] != score[k - 1] for k in range(len(score))])
        if any(rank[k] == rank[k - 1] and (set(proto.pieces[by_score[k]].piece) | set(proto.pieces[by_score[k - 1]].piece)) - {MARK} for k in range(1, len(rank)) if min(len(proto.pieces[by_score[j]].piece) for j in (k, k - 1)) > 1):
            raise ValueError("equal scores are covered for runs of the white-space mark only")
        own = {proto.pieces[i].piece: k for k, i in enumerate(by_score)}
        if any(MARK in p.lstrip(MARK) for p in ids) or any(c not in ids for p in ids for c in p):
            raise ValueError("a piece holds an inner white-space mark or a character that is no piece")
        made = [(own[p[:k]], own[p[k:]], i) for p, i in own.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
        self.pairs = bpe.Pairs(*(np.array(c, np.int64) for c in zip(*made, strict=True)), rank=rank)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20] = own[MARK]
        self.unknown = proto.trainer_spec.unk_id
        self.bytes = np.full(256, -1, np.int32)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:-1], 16)] = i
        if not proto.trainer_spec.byte_fallback or (self.bytes < 0).any():
            raise ValueError("only models with byte fallback are covered")

    def agenda(self, words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the distinct segments in one byte array."""
        points = np.frombuffer(words.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (words & 0xC0) != 0x80
        ends = np.cumsum(lens)
        n_chars = np.concatenate([[0], np.cumsum(lead)])
        n_sym = n_chars[ends] - n_chars[ends - lens]
        sym = self.char[points]
        sym = np.where(sym < 0, -2 - points.astype(np.int64), sym).astype(np.int32)
        second = np.minimum(ends - lens + 1, len(words) - 1)
        runs = (lens > 1) & (words[second] == 0x20)
        sym, counts = bpe.merge_words(sym, n_sym, self.pairs, runs)
        odd = np.flatnonzero(sym < 0)
        ids = np.where(sym >= 0, self.id_of[np.maximum(sym, 0)], sym)
        if not len(odd):
            return ids, counts
        size = np.ones(len(ids), np.int64)
        out_of = [np.frombuffer(chr(-2 - int(v)).encode(), np.uint8) for v in ids[odd]]
        size[odd] = [len(b) for b in out_of]
        dest = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        keep = np.flatnonzero(ids >= 0)
        out[dest[keep]] = ids[keep]
        for i, b in zip(odd, out_of, strict=True):
            out[dest[i] : dest[i] + len(b)] = self.bytes[b]
        e = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(size)])
        return out, total[e] - total[e - counts]

    def checked(self, words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``agenda`` compared with the library; where they differ, a warning says so and the library's ids are kept."""
        ids, counts = self.agenda(words, lens)
        text = words.tobytes()
        ends = np.cumsum(lens)
        plain = [text[e - n + 1 : e].decode("utf-8") for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
        theirs = self.lib.encode(plain, num_threads=1)
        n = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter((i for t in theirs for i in t), np.int32, int(n.sum()))
        lone = np.array([not p for p in plain])  # the mark alone: the library gives nothing for an empty text
        if len(flat) + int(counts[lone].sum()) == len(ids) and (n == np.where(lone, 0, counts)).all() and (flat == ids[np.repeat(~lone, counts)]).all():
            return ids, counts
        own = np.split(ids, np.cumsum(counts)[:-1])
        differ = sum(not alone and o.tolist() != t for o, t, alone in zip(own, theirs, lone, strict=True))
        logging.getLogger(__name__).warning("the agenda differs from the library on %d of %d segments; the library's ids are kept", differ, len(own))
        both = [o if alone else np.array(t, np.int32) for o, t, alone in zip(own, theirs, lone, strict=True)]
        return np.concatenate(both), np.array([len(b) for b in both], np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_slice(vocab: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of whole texts."""
    mark = MARK.encode()
    texts = [b" " + (t.replace(mark, b" ") if mark in t else t) if t else b"" for t in texts]
    lens = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    ends = np.cumsum(lens)
    space = raw == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[(ends - lens)[lens > 0]] = True
    starts = np.flatnonzero(cut)
    size = np.diff(np.append(starts, len(raw)))
    h = Prefix(raw).ranges(starts, starts + size)
    _, first, inv = np.unique(h, return_index=True, return_inverse=True)
    words = raw[arrowbytes.ragged(starts[first], size[first])]
    ids, counts = vocab.checked(words, size[first])
    u_start = np.cumsum(counts) - counts
    out = ids[arrowbytes.ragged(u_start[inv], counts[inv])]
    per = np.concatenate([[0], np.cumsum(counts[inv])])
    seg_of = np.searchsorted(starts, ends)  # segments before each text's end
    return out, np.diff(per[np.concatenate([[0], seg_of])])


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with array<int> ``ids`` and the library's decoding of them; Arrow batches, no shuffle."""
    small_batches(docs.sparkSession)
    d = docs.drop(ids, decoded)
    schema = T.StructType([*d.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches):
        vocab = vocabulary(model_path)
        for b in batches:
            raw, offsets = arrowbytes.flat(b.column(b.schema.get_field_index(text)))
            for x, y in arrowbytes.slices(offsets, SLICE_BYTES):
                off = offsets[x : y + 1]
                whole = raw[off[0] : off[-1]].tobytes()
                cut = (off - off[0]).tolist()
                flat, counts = encode_slice(vocab, [whole[cut[i] : cut[i + 1]] for i in range(y - x)])
                ends = np.cumsum(counts)
                lists = [flat[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                told = vocab.lib.decode(lists, num_threads=1)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))
                part = b.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([*part.columns, listed, pa.array(told, pa.string())], names=[*b.schema.names, ids, decoded])

    return d.mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """The columns of the query contract from ``encode``'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
