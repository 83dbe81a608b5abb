"""Near duplicates by SimHash and MinHash, decided by the exact similarity of shingle sets.

Operator 5's index brings together sets whose fingerprints differ in at most ``TAU`` bits, by the generalised pigeonhole
principle. Pairs just above the bound differ in more, so MinHash bands bring together others; the texts of all decide.

Two sets of Jaccard similarity s agree in a band of ``ROWS`` minima with probability s^ROWS, so in one of ``BANDS`` bands or
more with 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8, more above. Whoever meets in a band and is not far apart in size or in 64
one-bit minima is a candidate; each candidate is verified on all shingles of both texts, so no pair under the bound is linked.

Only distinct sets are compared, so copies cost nothing. In a bucket of more than ``SMALL`` sets one pivot is compared
with all; what its links join is then left out, and more pivots follow until no pair of unlinked sets is left, so a large
group of near copies costs little more than its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from honeyframe.llm import simhash
from honeyframe.llm.common import give_back, materialise
from honeyframe.llm.components import components
from honeyframe.llm.simhash import U, _mixed, majority, shingle_hashes

BANDS, ROWS = 20, 5
#: Fingerprints that differ in so many bits or fewer bring their sets together.
TAU = 3
#: Up to so many sets in a bucket all pairs are candidates; beyond, pivots first: 1, then 8 times as many.
SMALL, PIVOTS, MORE = 32, 1, 8
#: Of 64 one-bit minima of a pair at 0.8 a tenth differ; more than 20 do in one pair of a million.
SKETCH_APART = 20
#: The bound as a fraction.
OVER, UNDER = 4, 5
_RANDOM = np.random.default_rng(20)
_XOR = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, U)[:, None]
_ODD = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, U)[:, None] | U(1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def minima(h: np.ndarray) -> np.ndarray:
    """The least of the hashes in each of BANDS * ROWS random orders."""
    out = np.full(BANDS * ROWS, U((1 << 64) - 1))
    for i in range(0, len(h), 1024):
        out = np.minimum(out, ((h[None, i : i + 1024] ^ _XOR) * _ODD).min(axis=1))
    return out


def _bytes(scalar) -> bytes:
    return scalar.as_buffer().to_pybytes() if scalar.is_valid else b""


def _signer(at: int, size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            own, number = np.arange(number, number + n), number + n
            node, count, least, fp = np.zeros(n, U), np.zeros(n, np.int64), np.zeros((n, BANDS * ROWS), U), np.zeros(n, U)
            for i, text in enumerate(batch.column(0).field(at)):
                h = shingle_set(_bytes(text), size)
                node[i], count[i], least[i], fp[i] = xxhash.xxh3_64_intdigest(h.tobytes()), len(h), minima(h), majority(h)
            sketch = np.packbits((least[:, :64] >> U(40) & U(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(n)
            bands = np.broadcast_to(np.arange(BANDS, dtype=U), (n, BANDS))
            for j in range(ROWS):
                bands = _mixed(bands ^ least[:, j::ROWS], j)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(node.view(np.int64)), pa.array(count), pa.array(sketch.view(np.int64)), pa.array(fp.view(np.int64)), lists], names)

    return run


class _Meeter:
    """Rows (key, node, sketch, size, label) in key order, in; candidates (false, a, b), out: all of a small bucket's, and of a larger one's those of its pivots from ``low`` to ``high``.

    In the first round the keys of larger buckets and their sizes are told too, for the rounds to come; labels are 0 then.
    """

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def near(self, rows: list[np.ndarray], a, b) -> np.ndarray:
        _, node, sketch, size, label = rows
        few, many = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        far = np.bitwise_count((sketch[a] ^ sketch[b]).view(U)) > SKETCH_APART
        return (few * UNDER >= many * OVER) & ~far & (node[a] != node[b]) & ((label[a] != label[b]) | (self.low == 0))

    def bucket_pairs(self, rows: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes = end - start
        if not self.low:
            small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
            at = np.concatenate([np.arange(s, e) for s, e in zip(start[small], end[small], strict=True)]) if len(small) else np.zeros(0, np.int64)
            last, step = np.repeat(end[small], sizes[small]), 1
            while len(at):
                keep = at + step < last
                at, last = at[keep], last[keep]
                good = self.near(rows, at, at + step)
                a.append(at[good])
                b.append(at[good] + step)
                step += 1
        for k in np.flatnonzero(sizes > max(SMALL, self.low)):
            own = np.arange(start[k], end[k])
            own = own[np.argsort(_mixed(rows[1][own].view(U) ^ rows[0][own].view(U), 6), kind="stable")]  # other pivots in each band
            for p in range(self.low, min(self.high, len(own))):
                met = own[p + 1 :][self.near(rows, own[p], own[p + 1 :])]
                a.append(np.full(len(met), own[p]))
                b.append(met)
        return np.concatenate(a), np.concatenate(b)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[list[np.ndarray]] = []
        size = 0

        def work(final: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            key, node = rows[0], rows[1]
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            if not final:
                edge = edge[:-1]  # the last bucket may go on
            a, b = self.bucket_pairs(rows, edge[:-1], edge[1:])
            pairs = np.unique(np.sort(np.stack([node[a], node[b]]), axis=0), axis=1)
            sizes = np.diff(edge)
            large = np.flatnonzero(sizes > SMALL) if not self.low else np.zeros(0, np.int64)
            told = np.repeat([False, True], [pairs.shape[1], len(large)])
            two = [np.concatenate([x, y]) for x, y in zip(pairs, (key[edge[large]], sizes[large]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(told), *map(pa.array, two)], ["large", "a", "b"]), [x[edge[-1] :] for x in rows]

        for batch in batches:
            held.append([x.to_numpy() for x in batch.columns])
            size += batch.num_rows
            if size >= 200_000:
                out, rest = work(False)
                yield out
                held, size = [rest], len(rest[0])
        if size:
            yield work(True)[0]


def _verifier(size: int):
    """Rows (a, b, text of a, text of b) in; those whose sets are similar enough, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: dict[int, np.ndarray] = {}

        def shingles(node: int, text) -> np.ndarray:
            h = held.pop(node, None)
            if h is None:
                h = shingle_set(_bytes(text), size)
                if len(held) >= 512:
                    held.pop(next(iter(held)))
            held[node] = h
            return h

        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                good[i] = similar(shingles(int(a[i]), x), shingles(int(b[i]), y))
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return run


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted and without repeats, have a similarity of OVER / UNDER or more."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return UNDER * common >= OVER * (len(x) + len(y) - common)


def _met(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_Meeter(low, high), "large boolean, a long, b long")


def _fingerprinted(signed: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b, that join all sets whose fingerprints links of at most ``TAU`` bits reach: one set stands for each fingerprint, others of the same one are compared with it."""
    sets = signed.select(F.col("nd_fp").alias("fp"), F.col("nd_node").alias("node")).distinct()
    heads = materialise(sets.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = sets.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    none = F.lit(0).cast("long")
    links = simhash.links(heads.select("fp", none.alias("w0"), none.alias("w1")), TAU)
    apart = links
    for end in ("a", "b"):
        apart = apart.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"head_{end}")), end)
    return same.union(apart.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")))


def near_duplicates(docs: DataFrame, shingle_words: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each row whole, as the struct ``row``, with nd_label and nd_least: the group of near duplicates and its smallest id, null if no row there has one.

    A group is what pairs of a Jaccard similarity of OVER / UNDER or more join. Texts without words, nulls among them, are
    alike. Whole texts are compared, very long ones too. Columns may have any names. An empty table gives no rows.
    """
    more = [("nd_row", T.LongType()), ("nd_node", T.LongType()), ("nd_size", T.LongType()), ("nd_sketch", T.LongType()), ("nd_fp", T.LongType()), ("nd_bands", T.ArrayType(T.LongType()))]
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in more)])
    signed = materialise(rows.mapInArrow(_signer(docs.columns.index(text_col), shingle_words, schema.names), schema), "signed")
    text, doc_id = F.col("row")[text_col], F.col("row")[id_col]
    sets = signed.select("nd_node", "nd_size", "nd_sketch", "nd_bands").dropDuplicates(["nd_node"])
    rows = sets.select(F.explode("nd_bands").alias("key"), F.col("nd_node").alias("node"), F.col("nd_sketch").alias("sketch"), F.col("nd_size").alias("size"), F.lit(0).cast("long").alias("label"))
    met = materialise(_met(rows, 0, PIVOTS), "met")
    keys = met.filter("large").select(F.col("a").alias("key"), F.col("b").alias("sets"))
    most = keys.agg(F.max("sets")).first()[0] or 0
    large = materialise(rows.drop("label").join(keys, "key", "left_semi"), "large") if most else rows.limit(0).drop("label")
    pairs = materialise(met.filter("not large").select("a", "b").union(_fingerprinted(signed)).distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("nd_node")).union(pairs.select("b")).union(large.select("node")).distinct()
    # One row of each set that is asked for, found by its own number: copies, however many, don't meet in a task.
    chosen = signed.groupBy("nd_node").agg(F.min("nd_row").alias("nd_row")).join(asked, "nd_node", "left_semi")
    texts = signed.select("nd_row", text.alias("text")).join(chosen, "nd_row").select("nd_node", "text")
    texts = materialise(texts, "texts")  # of all rounds: those to come compare sets of larger buckets only
    links, low, high = _verified(texts, pairs, shingle_words), PIVOTS, PIVOTS * MORE
    label = components(links)
    while low < most:
        labelled = large.join(label, "node", "left").select("key", "node", "sketch", "size", F.coalesce("label", "node").alias("label"))
        apart = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
        pairs = materialise(_met(labelled.join(apart, "key", "left_semi"), low, high).select("a", "b").distinct(), "met")
        if not pairs.isEmpty():
            links = links.unionByName(_verified(texts, pairs, shingle_words))
            label = components(links)
        low, high = high, high * MORE
    nodes = signed.groupBy("nd_node").agg(F.min(doc_id).alias("least")).join(label, F.col("nd_node") == F.col("node"), "left")
    classed = materialise(nodes.select("nd_node", F.coalesce("label", "nd_node").alias("nd_label"), "least"), "classed")
    least = classed.groupBy("nd_label").agg(F.min("least").alias("nd_least"))
    named = classed.join(least, "nd_label").select("nd_node", "nd_label", "nd_least")
    return signed.join(named, "nd_node").select("row", "nd_label", "nd_least")


def _verified(texts: DataFrame, pairs: DataFrame, shingle_words: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("nd_node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("nd_node").alias("b"), F.col("text").alias("y")), "b")
    return materialise(both.select("a", "b", "x", "y").mapInArrow(_verifier(shingle_words), "a long, b long"), "links")
