"""Token ids in directly addressable codes.

A segment holds the ids of whole documents. Each id is cut into chunks of the widths in LEVEL_BITS, low bits first. Level
k stores the k-th chunk of every id that has one, in one array, and a continuation bitmap with a set bit for each id that
goes on at level k + 1; a rank directory counts the set bits before every block of BLOCK bits. Token i is read by a look
into level 0, then, while its bit is set, at place rank(bitmap, i) of the next level: no block of tokens is decoded.

Segments are rows of a Parquet file in a folder that executors and driver share, written by Spark's committer (a lost or
repeated task leaves no part behind) and read from any file system that Spark reads. Layout of a segment, little-endian:

    "DAC1", u32 documents, u64 ids, u8 levels
    per level: u8 bits, u64 chunks, the chunks, ceil(chunks / 8) bytes of bitmap (lowest bit first),
               ceil(chunks / BLOCK) u32 set bits before each block
    i64 doc_id per document (0 for null, see the flags), u32 ids per document, u8 flag per document (1: doc_id is null)
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import arrow, by_batch, new_folder, release
from vellum.llm.word_table import WordTable, byte_letters, filled, ragged, split_blanks, sums

LEVEL_BITS = (8, 8, 16)
BLOCK = 512
#: Ids of a segment at most, unless one document has more.
SEGMENT_IDS = 1 << 20
END_ID = 1
MAGIC = b"DAC1"
_TYPES = {8: np.dtype("u1"), 16: np.dtype("<u2")}


def _levels(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    for bits in LEVEL_BITS:
        chunks = (rest & ((1 << bits) - 1)).astype(_TYPES[bits])
        rest = rest >> np.uint32(bits) if bits < 32 else np.zeros_like(rest)
        more = rest > 0
        yield bits, chunks, more
        rest = rest[more]
        if not len(rest):
            return


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment."""
    levels = list(_levels(ids))
    out = [MAGIC, struct.pack("<IQB", len(doc_ids), len(ids), len(levels))]
    for bits, chunks, more in levels:
        blocks = -(-len(more) // BLOCK)
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, dtype=np.int64)
        before = np.cumsum(ones) - ones
        assert len(before) == blocks
        out += [struct.pack("<BQ", bits, len(chunks)), chunks.tobytes(), np.packbits(more, bitorder="little").tobytes(), before.astype("<u4").tobytes()]
    out.append(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes())
    out.append(np.asarray(lengths).astype("<u4").tobytes())
    out.append(np.array([d is None for d in doc_ids], dtype="u1").tobytes())
    return b"".join(out)


class Segment:
    """A packed segment; nothing is decoded before it is asked for."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<IQB", raw, 4)
        at, self.levels = 4 + struct.calcsize("<IQB"), []

        def take(kind: str | np.dtype, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        for _ in range(n_levels):
            bits, n = struct.unpack_from("<BQ", raw, at)
            at += struct.calcsize("<BQ")
            self.levels.append((bits, take(_TYPES[bits], n), take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK))))
        doc_ids, self.lengths, null = take("<i8", n_docs), take("<u4", n_docs).astype(np.int64), take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(doc_ids, null)]
        self.starts = np.cumsum(self.lengths) - self.lengths

    @staticmethod
    def _rank(bitmap: np.ndarray, before: np.ndarray, i: int) -> int:
        """Set bits before place i: the directory's count and the bytes from the block's start on."""
        block = min(i // BLOCK, len(before) - 1) if len(before) else 0
        ones = int(before[block]) if len(before) else 0
        ones += int(np.bitwise_count(bitmap[block * BLOCK // 8 : i >> 3]).sum())
        return ones + (int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def __getitem__(self, i: int) -> int:
        """Token i of the segment, by one look at each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = shift = 0
        for bits, chunks, bitmap, before in self.levels:
            out |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bitmap, before, i), shift + bits
        return out

    def slice(self, low: int, high: int) -> np.ndarray:
        """Tokens low to high - 1. Neighbours are neighbours at every level, so a rank at each end is all that is looked up."""
        parts = []
        for bits, chunks, bitmap, before in self.levels:
            if low >= high:
                break
            more = np.unpackbits(bitmap[low >> 3 : (high + 7) >> 3], bitorder="little")[low & 7 : (low & 7) + high - low].astype(bool)
            parts.append((bits, chunks[low:high].astype(np.uint32), more))
            low = self._rank(bitmap, before, low)
            high = low + int(more.sum())
        deeper = np.zeros(0, dtype=np.uint32)
        for bits, out, more in reversed(parts):
            out[more] |= deeper << np.uint32(bits)
            deeper = out
        return deeper

    def ids(self) -> np.ndarray:
        """All ids at once."""
        return self.slice(0, self.n_ids)

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k] + self.lengths[k]))


class Encoder:
    """Ids of a batch of texts by the tokenizers library; one to a Python worker and query.

    The vocabulary drops white space and has no piece with a blank in it, so a text's ids are those of its words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        shown, model = byte_letters(), library.model
        self.words = WordTable(
            lambda words: [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)],
            fold=lambda w: w.lower() if w.isascii() else w,
            encode_letters=lambda w: [t.id for t in model.tokenize(w if w.isascii() else "".join(shown[b] for b in w.lower().encode()))],
        )

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, END_ID behind each; how many each has."""
        offsets, words = split_blanks(pc.replace_substring(texts, "\n", " "))
        place, n, raw = self.words.lengths(words)
        flat, starts = np.frombuffer(raw, dtype="<u4"), np.cumsum(n) - n
        per = n[place]
        own = sums(per, offsets)
        out = np.empty(int(own.sum()) + len(texts), dtype=np.uint32)
        ends = np.cumsum(own + 1) - 1
        inner = np.ones(len(out), dtype=bool)
        inner[ends] = False
        out[ends] = END_ID
        out[inner] = flat[ragged(starts[place], per)]
        return out, own + 1


def write(docs: DataFrame, path: str, folder: str) -> None:
    """Encodes docs (doc_id, text) and writes segments to folder, in ascending order of (doc_id, text): rows of (part, seg,
    n_ids, first_doc, last_doc, packed), where (part, seg) ascends with doc_id. Null texts are empty; rows that repeat a doc_id follow each
    other in the order of their texts; a null doc_id comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        part, seg, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal seg, held, n_held
            own = [d for x in held for d in x[0]]
            packed = pack(own, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]))
            known = [d for d in own if d is not None]
            ends = [pa.array([known[k] if known else None], pa.int64()) for k in (0, -1)]
            row = pa.record_batch([pa.array([part]), pa.array([seg]), pa.array([n_held]), *ends, pa.array([packed], pa.large_binary())], ["part", "seg", "n_ids", "first_doc", "last_doc", "packed"])
            seg, held, n_held = seg + 1, [], 0
            return row

        for batch in batches:
            ids, n = encoder.encode(filled(batch.column(1)))
            doc_ids, ends = batch.column(0).to_pylist(), np.cumsum(n)
            low = 0
            while low < len(n):
                base = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, base + SEGMENT_IDS - n_held, side="right")))
                held.append((doc_ids[low:high], n[low:high], ids[base : ends[high - 1]]))
                n_held += int(ends[high - 1] - base)
                low = high
                if n_held >= SEGMENT_IDS or low < len(n):
                    yield out()
        if held:
            yield out()
        encoder = None
        release()

    arrow(docs.sparkSession)
    by_id = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    by_id.mapInArrow(run, "part long, seg long, n_ids long, first_doc long, last_doc long, packed binary").write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of folder."""
    files = spark.read.parquet(folder)
    # Segments are counted up within each part, and parts, as many as the writer had tasks, in one task.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("all"))
    sizes = sizes.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    base = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = files.select("part", "seg", "n_ids").withColumn("base", base).join(F.broadcast(sizes), "part").select("part", "seg", (F.col("base") + F.col("before")).alias("base"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], [], []]
        for part, seg, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
            s = Segment(raw)
            for k, (doc_id, start, n) in enumerate(zip(s.doc_ids, s.starts.tolist(), s.lengths.tolist())):
                for c, v in zip(cols, (part, seg, doc_id, start, n, zlib.crc32(s.document(k).astype("<u4")))):
                    c.append(v)
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["part", "seg", "doc_id", "within", "n_tokens", "ids_crc32"])

    found = by_batch(files.select("part", "seg", "packed"), run, "part long, seg long, doc_id long, within long, n_tokens long, ids_crc32 long", rows=8)
    return found.join(bases, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, folder: str, doc_id: int, places: list[int]) -> list[int | None]:
    """The ids at these places of a document, read from the files: of the rows whose span of doc_ids holds it (Parquet's
    statistics leave out the others), by a look into each level. None beyond its end; of rows that repeat the doc_id, the first."""
    rows = spark.read.parquet(folder).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("part", "seg").select("packed")
    for row in rows.toLocalIterator():
        s = Segment(bytes(row["packed"]))
        if doc_id in s.doc_ids:
            k = s.doc_ids.index(doc_id)
            return [s[int(s.starts[k]) + i] if 0 <= i < s.lengths[k] else None for i in places]
    return [None] * len(places)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """write, then read: every row of docs (doc_id, text; other columns are left out). Null texts are empty (the end id
    alone); rows that repeat a doc_id are a document each, in the order of their texts; a null doc_id comes first; an empty
    table gives an empty one."""
    folder = new_folder(docs.sparkSession, "tokens")
    write(docs, path, folder)
    return read(docs.sparkSession, folder)
