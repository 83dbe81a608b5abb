"""Operator 3: token ids as directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the low chunk of every id; an id with more to come has its bit set in
the level's bitmap and its next chunk at the place that the number of set bits before it names in the next level. A rank
directory gives that number in constant time, so any single id is read without decoding its neighbours.

A dataset is a folder of Parquet files whose rows are segments: complete images in the format below, in ascending order
of document id (``part``, ``seq``). Parquet is only the container, which gives the atomic commit and the access through
any file system that Spark reads; nothing in it is compressed, so an image's bytes are addressed as they lie. A segment's
row tells which positions and documents it has, so that a position or a document finds its segment by the columns'
statistics, and its ids in there by rank. Image, little-endian: magic ``DAC1``; u32 documents, u32 levels, u64 ids; i64 document
ids; u8 flags (1: the document id is null); u64 ends (ids up to and with each document); then for each level u64 chunks,
the chunks, and but for the last level the bitmap (least bit first) and u32 ranks (set bits before each 512).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.llm.common import cleaned, shuffle_parts
from honeyframe.llm.encoding import encode_all, vocabulary

SEGMENT_SCHEMA = "part int, seq int, start_in_part long, n_docs int, n_ids long, has_null boolean, least long, greatest long, image binary"
#: A segment is closed once it has so many ids; a document is never split, so one longer than this is a segment of its own.
SEGMENT_IDS = 1 << 18
BLOCK = 512


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The image of documents whose ids follow one another."""
    levels: list[bytes] = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8)
        if not more.any():
            levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes())
            break
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bitmap.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    known = np.array([x if x is not None else 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    head = b"DAC1" + struct.pack("<IIQ", len(doc_ids), len(levels), len(ids))
    return head + known.tobytes() + null.tobytes() + np.cumsum(lengths).astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """Reads an image: one id, one document, or all."""

    def __init__(self, image: bytes):
        if image[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        n_docs, n_levels, self.n_ids = struct.unpack_from("<IIQ", image, 4)
        at = 20
        known = np.frombuffer(image, "<i8", n_docs, at)
        null = np.frombuffer(image, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(known, null, strict=True)]
        self.ends = np.frombuffer(image, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 17 * n_docs
        self._levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        self._wide: dict[int, np.ndarray] = {}
        for level in range(n_levels):
            (n,) = struct.unpack_from("<Q", image, at)
            chunks = np.frombuffer(image, np.uint8, n, at + 8)
            at += 8 + n
            if level + 1 == n_levels:
                self._levels.append((chunks, None, None))
                break
            bitmap = np.frombuffer(image, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(image, "<u4", -(-n // BLOCK), at)
            at += 4 * len(ranks)
            self._levels.append((chunks, bitmap, ranks))

    def __getitem__(self, i: int) -> int:
        """The i-th id, by a rank look-up on each level and no decoding of others."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self._levels:
            value |= int(chunks[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            whole = bitmap[block * BLOCK // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(whole).sum()) + (int(bitmap[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
            shift += 8
        return value

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places, each by rank look-ups of its own: what lies between them is not decoded."""
        at, who = np.asarray(at, np.int64), np.arange(len(at))
        if len(at) and not 0 <= at.min() <= at.max() < self.n_ids:
            raise IndexError(at)
        out = np.zeros(len(at), "<u4")
        for level, (chunks, bitmap, ranks) in enumerate(self._levels):
            out[who] |= chunks[at].astype("<u4") << np.uint32(8 * level)
            if bitmap is None:
                break
            more = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            at, who = at[more], who[more]
            words = self._words(level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            place = ranks[at // BLOCK] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            first = at // BLOCK * (BLOCK // 64)
            for k in range(BLOCK // 64 - 1):  # the whole words of a block before the bit's own
                before = first + k < word
                if not before.any():
                    break
                place[before] += np.bitwise_count(words[first[before] + k])
            at = place
        return out

    def _words(self, level: int) -> np.ndarray:
        """A bitmap as 64-bit words, padded once."""
        if level not in self._wide:
            bitmap = self._levels[level][1]
            self._wide[level] = np.concatenate([bitmap, np.zeros(-len(bitmap) % 8, np.uint8)]).view("<u8")
        return self._wide[level]

    def ids(self) -> np.ndarray:
        """All ids as unsigned 32-bit integers, decoded in one go."""
        out: np.ndarray | None = None
        for chunks, bitmap, _ in reversed(self._levels):
            level = chunks.astype("<u4")
            if bitmap is not None:
                more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
                level[more] |= out << 8
            out = level
        return out if out is not None else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, each by direct access."""
        return self.take(np.arange(int(self.ends[k - 1]) if k else 0, int(self.ends[k])))


def _writer(tokenizer: str, end_id: int | None, segment_ids: int, engine: str):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, part = vocabulary(tokenizer), TaskContext.get().partitionId()
        seq, start, held_ids, held_docs, held_lengths, held = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            ids, lengths = np.concatenate(held_ids), np.concatenate(held_lengths)
            named = [x for x in held_docs if x is not None]
            row = (part, seq, start, len(held_docs), len(ids), len(named) < len(held_docs), min(named, default=None), max(named, default=None), build(ids, held_docs, lengths))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")])

        for batch in parts:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, ids, n in encode_all(path, texts, engine):
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                own, ends, first = docs[rows], np.cumsum(n), 0
                while first < len(own):  # as many documents as fill a segment
                    before = int(ends[first - 1]) if first else 0
                    last = min(int(np.searchsorted(ends, before + segment_ids - held)) + 1, len(own))
                    held_ids.append(ids[before : ends[last - 1]])
                    held_docs += own[first:last]
                    held_lengths.append(n[first:last])
                    held += int(ends[last - 1]) - before
                    first = last
                    if held >= segment_ids:
                        yield close()
                        seq, start, held_ids, held_docs, held_lengths, held = seq + 1, start + held, [], [], [], 0
        if held_docs:
            yield close()

    return write


def write_dataset(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS, engine: str = "table") -> None:
    """Encode whole texts and write the segments in ascending order of document id.

    Null texts are empty; a very long text is a segment of its own. A null id comes first; rows with the same id keep the
    order of their texts. Only the two named columns are read, so others can't clash. An empty table writes an empty dataset.
    """
    parts = shuffle_parts(docs.sparkSession)
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    segments = ordered.mapInArrow(_writer(tokenizer, end_id, segment_ids, engine), SEGMENT_SCHEMA)
    with cleaned(docs.sparkSession):  # row groups of a few images, so that a look-up reads few
        segments.write.option("compression", "none").option("parquet.block.size", 4 << 20).option("parquet.enable.dictionary", False).parquet(path)


def _reader(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for part, start, image in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            segment = Segment(image)
            starts = np.concatenate([[0], segment.ends[:-1]])
            raw = segment.take(np.arange(segment.n_ids)).tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), segment.ends.tolist(), strict=True)]
            columns = [pa.array([part] * len(crc), pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(starts + start), pa.array(segment.ends - starts), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])


def _bases(spark, path: str) -> list[tuple[int, int, int]]:
    """(part, ids before it, its ids) of each part that was written; image columns are not read."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    base, out = 0, []
    for part, n in sorted(segments.groupBy("part").agg(F.sum("n_ids")).collect()):
        out.append((part, base, n))
        base += n
    return out


def read_directory(spark, path: str) -> DataFrame:
    """Per document, its ids taken from the files by direct access: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    rows = segments.select("part", "start_in_part", "image").mapInArrow(_reader, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    bases = spark.createDataFrame([(part, base) for part, base, _ in _bases(spark, path)], "part int, base long")
    rows = rows.join(F.broadcast(bases), "part")  # as many rows as parts
    return rows.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark, path: str, position: int) -> int:
    """The id at a position of the whole dataset: one segment is read, and in it one byte of each level that the id has."""
    for part, base, n in _bases(spark, path):
        if base <= position < base + n:
            at = position - base
            here = (F.col("part") == part) & (F.col("start_in_part") <= at) & (F.col("start_in_part") + F.col("n_ids") > at)
            start, image = spark.read.schema(SEGMENT_SCHEMA).parquet(path).filter(here).select("start_in_part", "image").first()
            return Segment(image)[at - start]
    raise IndexError(position)


def _documents(doc_id: int | None):
    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part, seq, image in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                segment = Segment(image)
                own = [k for k, x in enumerate(segment.doc_ids) if x == doc_id]
                ids = [segment.document(k).astype(np.int64) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), pa.array([seq] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array(ids, pa.list_(pa.int64()))], ["part", "seq", "place", "ids"])

    return find


def documents(spark, path: str, doc_id: int | None) -> DataFrame:
    """The documents of one id: part, seq and place (their order) and ids. Only segments whose range of ids has it are read, and only its ids are decoded."""
    within = F.col("has_null") if doc_id is None else (F.col("least") <= doc_id) & (F.col("greatest") >= doc_id)
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path).filter(within)
    return segments.select("part", "seq", "image").mapInArrow(_documents(doc_id), "part int, seq int, place int, ids array<long>")
