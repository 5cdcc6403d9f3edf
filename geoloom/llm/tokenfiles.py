"""Token ids of documents as wavelet-matrix files, and reading them back.

Rows are dealt by ranges of doc_id and sorted, so that the files in the order
of (range, part) hold the documents in ascending doc_id.  Each task encodes its
range and writes files of about FILE_TOKENS tokens to the shared folder under
names that do not depend on the attempt, by a temporary name and a rename, so a
task that runs again writes the same file again.

Defined results: a null or empty text has the end id alone; null ids come
first; rows with equal ids stand in the order of their texts; extra columns
are ignored; an empty table writes nothing.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm import arrowbytes
from geoloom.llm.common import materialize, shared_dir, small_batches
from geoloom.llm.hashing import Prefix, Table
from geoloom.llm.wavelet import WaveletMatrix, build

END_ID = 0
#: Bytes of text of one range: small ones up to RANGES of them, then larger ones up to LARGE_RANGE.
RANGE_BYTES, RANGES, LARGE_RANGE = 16 << 20, 4096, 1 << 30
#: Tokens after which a file ends, and tasks that read files at most.
FILE_TOKENS, READ_TASKS = 8 << 20, 20_000
#: Bytes of text worked on at once, and bytes of segments given to the library as one text.
SLICE_BYTES, JOINED = 1 << 20, 1 << 14
#: Distinct segments whose ids a worker remembers before it starts anew.
MEMORY = 400_000


def _classes() -> np.ndarray:
    """Bits of each byte: 1 starts a visible character, 2 an ASCII letter, 4 ASCII visible, 8 ASCII white space, 16 ASCII but no letter."""
    c = np.zeros(256, np.uint8)
    c[0x21:0x7F] |= 1 | 4
    c[0xC3:0xE0] |= 1
    c[[9, 10, 11, 12, 13, 32]] |= 8
    c[:128] |= 16
    for a in (65, 97):
        c[a : a + 26] = 1 | 2 | 4
    return c


class Encoder:
    """The tokenizers library, called once for each distinct segment.

    Texts are cut where the byte-level pre-tokenizer always starts a piece: before
    a space that a visible character follows, before white space that follows a
    visible ASCII character or a letter, and between a letter and an ASCII
    character that is none.  So the ids of a text are those of its segments, one
    after the other.  Literals of special tokens are not cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; the library's threads would contend for its cache
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.planes = max(1, (self.lib.get_vocab_size() - 1).bit_length())
        self.classes = _classes()
        self.lib.model._resize_cache(0)  # segments come once each
        added = {i: str(t.content).encode() for i, t in self.lib.get_added_tokens_decoder().items()}
        self.literals = list(added.values())
        #: bytes that each id spells; the byte-level alphabet has one character a byte
        self.width = np.zeros(self.lib.get_vocab_size(), np.int64)
        for token, i in self.lib.get_vocab().items():
            self.width[i] = len(added[i]) if i in added else len(token)
        self._forget()

    def _forget(self) -> None:
        self.table, self.segments, self.pooled = Table(), 0, 0
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16 if self.planes <= 16 else np.uint32)

    def _encoded(self, buffer: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of segments that stand one after the other: those between sure cuts go to the library as one text."""
        ends = np.cumsum(size)
        sure = np.zeros(len(buffer) + 1, bool)
        sure[self._cuts(buffer, np.zeros(2, np.int64))] = True
        apart = ends[:-1][~sure[ends[:-1]]]
        apart = np.union1d(apart, ends[np.searchsorted(ends, np.arange(JOINED, len(buffer), JOINED))]) if len(buffer) > JOINED else apart
        text, cuts = buffer.tobytes(), [0, *[x for x in apart.tolist() if x < len(buffer)], len(buffer)]
        found = [e.ids for e in self.lib.encode_batch_fast([text[x:y].decode("utf-8") for x, y in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), self.pool.dtype)
        at = np.cumsum(self.width[flat])
        last = np.searchsorted(at, ends)
        if not len(flat) or at[-1] != len(buffer) or (at[last] != ends).any():
            raise ValueError("the tokenizer's ids do not spell the segments")
        return flat, np.diff(last, prepend=-1).astype(np.int32)

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(raw[starts] != 0x20, kind="stable")
        hashes, starts, size = hashes[order], starts[order], size[order]
        flat, count = self._encoded(raw[arrowbytes.ragged(starts, size)], size)
        n, m = self.segments + len(count), self.pooled + len(flat)
        if n > len(self.count):
            more = np.zeros(max(n, 1 << 16), np.int64)
            self.start, self.count = np.concatenate([self.start, more]), np.concatenate([self.count, more.astype(np.int32)])
        if m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(m, 1 << 18), self.pool.dtype)])
        self.start[self.segments : n], self.count[self.segments : n] = np.cumsum(count) - count + self.pooled, count
        self.pool[self.pooled : m] = flat
        self.table.put(hashes, np.arange(self.segments, n, dtype=np.int32))
        self.segments, self.pooled = n, m

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        c = self.classes[raw]
        before, here = c[:-1], c[1:]
        letter = (before & 2) != 0
        # the letters of two bytes that start with 0xC3: all but the signs of multiplication and division
        letter[1:] |= (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)
        cut = np.zeros(len(raw), bool)
        cut[1:] = (letter & ((here & 16) != 0) & ((here & 2) == 0)) | (((before & 4) != 0) & ((here & 8) != 0))
        cut[:-1] |= (raw[:-1] == 0x20) & ((here & 1) != 0)
        text = raw.tobytes()
        for literal in self.literals:
            at = text.find(literal)
            while at >= 0:
                cut[at + 1 : at + len(literal)] = False
                at = text.find(literal, at + 1)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of whole texts in one buffer that starts at offset 0."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, self.pool.dtype), np.zeros(n, np.int64)
        starts = self._cuts(raw, offsets)
        size = np.diff(np.append(starts, len(raw)))
        h = Prefix(raw).ranges(starts, starts + size)
        if self.segments > MEMORY:
            self._forget()
        at = self.table.get(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            hashes, first = np.unique(h[new], return_index=True)
            self._learn(hashes, raw, starts[new[first]], size[new[first]])
            at[new] = self.table.get(h[new])
        count = self.count[at]
        per = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return self.pool[arrowbytes.ragged(self.start[at], count)], np.diff(per[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _store(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def write(docs: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES, file_tokens: int = FILE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns one row a file: range, part, path, n_docs, n_tokens."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(min(-(-total // range_bytes), RANGES), -(-total // LARGE_RANGE), 1)
    d = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    d = d.select(F.spark_partition_id().alias("range"), "doc_id", "text")

    def run(batches):
        coder, place = encoder(tokenizer_path), None
        ids, counts, owners, held, part, number = [], [], [], 0, 0, None

        def rows(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["range", "part", "path", "n_docs", "n_tokens"],
            )

        def finish():
            nonlocal ids, counts, owners, held, part, place
            place = place or _store(folder)
            name = f"{place[1]}/range-{number:08d}-{part:06d}.wvm"
            spare = f"{name}.{uuid.uuid4().hex}.tmp"
            with place[0].open_output_stream(spare) as out:
                out.write(build(np.concatenate(ids), owners, np.concatenate(counts), coder.planes))
            place[0].move(spare, name)
            row = (number, part, f"{folder.rstrip('/')}/range-{number:08d}-{part:06d}.wvm", len(owners), held)
            ids, counts, owners, held, part = [], [], [], 0, part + 1
            return row

        for b in batches:
            number = b.column(0)[0].as_py() if b.num_rows else number
            names = b.column(1).to_pylist()
            raw, offsets = arrowbytes.flat(b.column(2))
            for x, y in arrowbytes.slices(offsets, SLICE_BYTES):
                off = offsets[x : y + 1]
                got, k = coder.encode(raw[off[0] : off[-1]], off - off[0])
                out = np.full(len(got) + len(k), end_id, got.dtype)
                ends = np.cumsum(k + 1) - 1
                body = np.ones(len(out), bool)
                body[ends] = False
                out[body] = got
                ids.append(out)
                counts.append(k + 1)
                owners += names[x:y]
                held += len(out)
                if held >= file_tokens:
                    yield rows([finish()])
        if owners:
            yield rows([finish()])

    return materialize(d.mapInArrow(run, "range int, part int, path string, n_docs long, n_tokens long"))


def read_back(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    # one row a range (1 GB of text each when there are many), so the window over all of them stays small
    ranges = files.groupBy("range").agg(F.sum("n_tokens").alias("held")).select(F.col("range").alias("of"), F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    within = F.sum("n_tokens").over(Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    f = files.withColumn("within", within).join(ranges, F.col("range") == F.col("of"))
    f = f.select("range", "part", "path", (F.coalesce("earlier", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("base"))
    f = f.repartitionByRange(min(max(1, files.count()), READ_TASKS), "range", "part")

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path, base in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at) as f:
                    w = WaveletMatrix(f.read())
                tokens = w.decode()
                ends = np.cumsum(w.lengths)
                starts = ends - w.lengths
                crc = [zlib.crc32(tokens[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.doc_ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(w.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return f.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """``write`` to ``folder`` (a new one in the shared folder by default), then ``read_back``."""
    return read_back(write(docs, tokenizer_path, folder or shared_dir(docs.sparkSession)))
