"""Operator 9: best-fit packing with certified bounds.

Pieces are packed by best-fit decreasing inside partitions of bounded size. Dual-feasible functions bound from below the
bins that any packing of a partition's pieces needs: where the bound equals the bins used, the partition is certified
and final. A partition with a gap keeps its full bins; the documents in its other bins are exchanged with those of other
partitions with gaps, and best-fit decreasing runs again, over as many partitions as what is open fills, until no gap is
left, one partition holds all that is open, or an exchange saves no bin.

Pieces are dealt to partitions by a number of their own, given as they are cut, so ids that are null or repeated don't
meet in one partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.llm.common import materialise
from honeyframe.llm.encoding import encode_all, vocabulary

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A piece's own number, beside its other columns until it is packed.
NUMBER = "piece_number"
#: Pieces that one partition packs at once.
PARTITION_PIECES = 20_000


def _cutter(tokenizer: str, end_id: int, capacity: int, engine: str):
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, number = vocabulary(tokenizer), TaskContext.get().partitionId() << 40
        for batch in parts:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, ids, n in encode_all(path, texts, engine):
                raw = np.insert(ids, np.cumsum(n), end_id).astype("<u4").tobytes()
                out, at = [], 0
                for doc, length in zip(docs[rows], (n + 1).tolist(), strict=True):
                    first = length % capacity or capacity  # only the first piece is shorter
                    start, piece = 0, 0
                    while start < length:
                        size = first if not start else capacity
                        out.append((doc, piece, start, size, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + size)]), number))
                        start, piece, number = start + size, piece + 1, number + 1
                    at += length
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", NUMBER])

    return cut


def cut_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", engine: str = "table") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document with its end id, and their numbers; only longer documents are cut."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cutter(tokenizer, end_id, capacity, engine), f"{PIECE_SCHEMA}, {NUMBER} long")


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each size, and the number of bins; sizes are placed longest first, ties as they come.

    A bit for each amount of free space tells which is the least that fits, so a placement costs the same for any number of bins.
    """
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    with_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            at = with_space[space].pop()
            if not with_space[space]:
                mask ^= 1 << space
        else:
            space, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - space
        if space > size:
            with_space[space - size].append(at)
            mask |= 1 << (space - size)
    return bins, offsets, n


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[x]`` is the number of pieces of size x.

    The best of the dual-feasible functions: the identity; for each e up to half the capacity, the one that rounds sizes
    over capacity - e up to a bin and those under e down to none; and for each k up to 100 the one that rounds a size x down
    to floor((k+1) x / capacity) / k of a bin unless that is exact.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    weight = counts * x
    best = -(-int(weight.sum()) // capacity)
    tail = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    sums = np.concatenate([[0], np.cumsum(weight)])
    for e in range(1, capacity // 2 + 1):
        whole = int(tail[capacity - e + 1])
        best = max(best, whole + -(-int(sums[capacity - e + 1] - sums[e]) // capacity))
    for k in range(1, 101):
        scaled = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((counts * scaled).sum()) // (k * capacity)))
    return best


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", NUMBER], ascending=[False, True], kind="stable")
        sizes = group["length"].tolist()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=sizes, minlength=n)
        open_again = (n > bound) & (fill[bins] < capacity)
        return group.assign(bin=bins, offset=offsets, open=open_again, opens=np.asarray(offsets) == 0)

    return pack


def pack(pieces: DataFrame, capacity: int = 1024, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``pieces`` should be materialised, it is read once in each round.

    A piece of full length is a sequence of its own. Rows are kept as they are, repeated ones too; the number of a piece,
    if it has none of its own, is told by its place in the table.
    """
    columns = [c for c in pieces.columns if c != NUMBER]
    if NUMBER not in pieces.columns:
        pieces = materialise(pieces.withColumn(NUMBER, F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == capacity).select(*columns, (-1 - F.col(NUMBER)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, turn, open_bins = pieces.filter(F.col("length") < capacity), [full], 0, None
    left = rest.count()
    schema = ", ".join(f"{c} {t}" for c, t in rest.dtypes) + ", bucket long, bin long, offset long, open boolean, opens boolean"
    while True:
        parts = max(1, -(-left // partition_pieces))  # a partition holds about as many pieces, whatever is left
        dealt = rest.withColumn("bucket", F.pmod(F.xxhash64(F.lit(turn), F.col(NUMBER)), F.lit(parts)))
        packed = materialise(dealt.groupBy("bucket").applyInPandas(_packer(capacity), schema), f"packed{turn}")
        used, left, again = packed.agg(F.count_if("opens"), F.count_if("open"), F.count_if(F.col("open") & F.col("opens"))).first()
        last = parts == 1 or not left or open_bins is not None and used >= open_bins
        sequence = (F.lit(turn).cast("long") * (1 << 56) + F.col("bucket") * (1 << 24) + F.col("bin")).alias("sequence_id")
        done.append((packed if last else packed.filter(~F.col("open"))).select(*columns, sequence, "offset"))
        if last:
            break
        rest, open_bins = packed.filter("open").select(*columns, NUMBER), again
        turn += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", engine: str = "table") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. A very long text is cut as it is encoded. Null and repeated document ids keep
    all their rows; pieces of one length are placed in the order they were cut. An empty table gives an empty result. Only
    the two named columns are read, so other columns can't clash.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, engine), "pieces")
    return pack(pieces, capacity)
