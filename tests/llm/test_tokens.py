"""Encoders against their libraries, the wavelet matrix against plain lists."""

import hashlib
import zlib

import numpy as np
import pytest

from geoloom.llm import sentencepieces, tokenfiles
from geoloom.llm.wavelet import WaveletMatrix, build

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "   x ", "\n\n a", "▁a", "a▁▁b", "日本語テキスト", "😀 x😀", "x" * 500 + " é" * 3, "the" * 100, "\x00a\x00", "tab\tx", "trail  ", "ab" * 3000, " ▁ ▁▁ ", "don't 'tis we'll  ok", "  x 　y", "<|endoftext|> x", "a\r\n b"]


def test_agenda_equals_library(odd_texts):
    v = sentencepieces.Vocabulary(PIECES)
    texts = ODD + [t for t in odd_texts if t]
    for use in (v.checked, v.agenda):  # with the check and alone
        v.checked = use
        flat, counts = sentencepieces.encode_slice(v, [t.encode() for t in texts])
        ends = np.cumsum(counts)
        assert [flat[e - n : e].tolist() for n, e in zip(counts, ends, strict=True)] == v.lib.encode(texts)


def test_sentencepiece_rows(docs, empty):
    v = sentencepieces.vocabulary(PIECES)
    rows = sentencepieces.encode(docs, PIECES).collect()
    assert len(rows) == docs.count() and sentencepieces.encode(empty, PIECES).count() == 0
    for r in rows:
        ids = v.lib.encode(r.text or "")
        assert r.ids == ids and r.decoded == v.lib.decode(ids) and r.score in (9.0, None)
    h = {r.doc_id: r for r in sentencepieces.digest(sentencepieces.encode(docs, PIECES)).collect()}
    assert h[0].n_tokens == 0 and h[0].ids_sha256 == hashlib.sha256(b"").hexdigest() == h[0].decoded_sha256


@pytest.mark.parametrize("memory", [1, 10**6])
def test_byte_encoder_equals_library(odd_texts, memory, monkeypatch):
    monkeypatch.setattr(tokenfiles, "MEMORY", memory)
    e = tokenfiles.Encoder(BYTES)
    texts = ODD + [t for t in odd_texts if t]
    for part in (texts[:7], texts[7:], texts):
        b = [t.encode() for t in part]
        off = np.concatenate([[0], np.cumsum([len(x) for x in b])])
        ids, counts = e.encode(np.frombuffer(b"".join(b), np.uint8), off)
        ends = np.cumsum(counts)
        assert [ids[z - n : z].tolist() for n, z in zip(counts, ends, strict=True)] == [x.ids for x in e.lib.encode_batch(part, add_special_tokens=False)]


def test_byte_encoder_on_random_texts():
    """Segments learned in any order and joined for the library give the ids of whole texts."""
    from tokenizers import Tokenizer

    lib, e, r = Tokenizer.from_file(BYTES), tokenfiles.Encoder(BYTES), np.random.default_rng(4)
    parts = ["a", "The", "'s", "'", "é", "×", "ß", " ", "  ", "\n", "\t", "\u00a0", "\u3000", ".", ",", "7", "日", "😀", "x9", "<|endoftext|>", "<|", "\x00", "ll"]
    texts = ["".join(parts[k] for k in r.integers(0, len(parts), r.integers(0, 40))) for _ in range(4000)]
    for x in range(0, 4000, 1000):
        b = [t.encode() for t in texts[x : x + 1000]]
        off = np.concatenate([[0], np.cumsum([len(y) for y in b])])
        ids, counts = e.encode(np.frombuffer(b"".join(b), np.uint8), off)
        ends = np.cumsum(counts)
        assert [ids[z - n : z].tolist() for n, z in zip(counts, ends, strict=True)] == [y.ids for y in lib.encode_batch(texts[x : x + 1000], add_special_tokens=False)]


@pytest.mark.parametrize("n, top", [(0, 10), (1, 2), (777, 300), (300_000, 50_257)])
def test_wavelet(n, top):
    r = np.random.default_rng(n)
    seq = np.minimum(r.zipf(1.3, n), top - 1).astype(np.uint32) if n else np.zeros(0, np.uint32)
    w = WaveletMatrix(build(seq, [3, None], np.array([n, 0]), max(1, (top - 1).bit_length())))
    assert (w.decode() == seq).all() and w.doc_ids == [3, None] and w.lengths.tolist() == [n, 0]
    for i in r.integers(0, n, 20) if n else []:
        t = int(seq[i])
        assert w.access(int(i)) == t and w.rank(t, int(i)) == int((seq[:i] == t).sum()) and w.count(t) == int((seq == t).sum())
        at = np.flatnonzero(seq == t)
        k = int(r.integers(len(at)))
        assert w.select(t, k) == at[k]
    if n == 777:
        t = int(seq[5])
        assert w.occurrences(t) == np.flatnonzero(seq == t).tolist()
    with pytest.raises(IndexError):
        w.select(0, n + 1)
    assert w.count(1 << 20) == 0


def test_files_round_trip(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    files = tokenfiles.write(docs, BYTES, tokenfiles.shared_dir(docs.sparkSession), range_bytes=20_000, file_tokens=500)
    got = {(r.start, r.doc_id): r for r in tokenfiles.read_back(files).collect()}
    assert files.count() > 3 and len(got) == docs.count()
    at = 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        g = got[at, r.doc_id]
        assert (g.n_tokens, g.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfiles.round_trip(empty, BYTES).count() == 0


def test_special_token_text_as_by_default(spark):
    """A text that holds a special token's literal is encoded as a fresh tokenizer does it."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    texts = ["a<|endoftext|> x", "<|endoftext|>", "a <|endoftext|> b <|endoftext|>", "x<|endof text|>", "<|endoftext|><|endoftext|>\n y"]
    got = {r.doc_id: r for r in tokenfiles.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES).collect()}
    for k, t in enumerate(texts):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        assert (got[k].n_tokens, got[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
