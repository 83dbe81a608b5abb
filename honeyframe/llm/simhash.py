"""Operator 5: near duplicates by SimHash and the generalised pigeonhole principle.

Two fingerprints of 64 bits that differ in at most tau of them differ, for any thresholds T_1..T_m of their m parts with
sum(T) = tau - m + 1, in at most T_i bits of some part i. Correlated bits are put into the same part (so that a skewed
bit spoils one part only); the thresholds, -1 for a part that need not be probed, are chosen by dynamic programming on the
number of candidates that the counts of the parts' values lead to expect. A fingerprint stands under its own value of each
part that is used and probes every value within T_i of it; what it meets is verified on all bits, each pair only in the
first part that brings it together.

Only distinct fingerprints are compared, so copies cost nothing. A value that many share is split into blocks, and each
pair of blocks is a bucket of its own, so that buckets stay bounded; within a bucket a breadth-first search compares a
fingerprint only with those that no link has reached yet, so a large group of near copies costs little more than its size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.llm.common import materialise, words
from honeyframe.llm.components import components

BITS = 64
#: Members and probes of a bucket, beyond which it is split.
BUCKET = 8192
#: What a probe costs, in candidates.
PROBE_COST = 8
FINGERPRINT_SCHEMA = "doc_id long, fp long, w0 long, w1 long"
U = np.uint64


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the shingles of ``size`` words, repeats included; fewer words are one shingle, none give none."""
    found = words(text)
    if not found:
        return np.zeros(0, U)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], U)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return np.array([digest(join(x), seed) for x in zip(*(found[i:] for i in range(size)), strict=False)], U)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hash bits from hashes."""
    h = (h ^ U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def _fingerprinter(size: int, wide: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = np.zeros((3, batch.num_rows), U)
            for i, text in enumerate(batch.column(1)):
                h = shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", size)
                out[0, i] = majority(h)
                if wide:
                    out[1, i], out[2, i] = majority(_mixed(h, 0)), majority(_mixed(h, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out)], ["doc_id", "fp", "w0", "w1"])

    return run


def fingerprints(docs: DataFrame, shingle_words: int = 3, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and, if ``wide``, 128 more bits (w0, w1) of every row; a null text is an empty one, whose bits are all 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprinter(shingle_words, wide), FINGERPRINT_SCHEMA)


@dataclass
class Plan:
    """How fingerprints are probed; all of it has a size that doesn't depend on the corpus."""

    tau: int
    parts: list[list[int]]  # the bits of each part
    blocks: list[list[tuple[list[int], np.ndarray]]]  # of each part: up to 16 of its bits, and for each distance how many fingerprints have a value at it
    n: int
    thresholds: list[int] = field(default_factory=list)

    def value(self, fp: np.ndarray, bits: list[int]) -> np.ndarray:
        out = np.zeros(len(fp), U)
        for k, bit in enumerate(bits):
            out |= (fp >> U(bit) & U(1)) << U(k)
        return out

    def most(self, part: int) -> int:
        return min(self.tau, len(self.parts[part]), 3)

    def expected(self, part: int, fp: np.ndarray) -> np.ndarray:
        """Fingerprints expected at distance 0, 1, ... in a part; its blocks count as independent."""
        total: np.ndarray | None = None
        for bits, at in self.blocks[part]:
            own = at[: self.most(part) + 1, self.value(fp, bits).astype(np.int64)].astype(float)
            if total is None:
                total = own
            else:
                total = np.array([sum(total[j] * own[d - j] for j in range(d + 1)) / max(self.n, 1) for d in range(len(own))])
        return total

    def allocate(self) -> None:
        """The cheapest thresholds whose sum is tau - m + 1, by dynamic programming over parts."""
        need, best = self.tau + 1, {0: (0.0, ())}  # in terms of T + 1
        for i, bits in enumerate(self.parts):
            totals = []
            for t in range(self.most(i) + 1):
                met = None  # of pairs of fingerprints those expected within t in this part, blocks counting as independent
                for _, at in self.blocks[i]:
                    own = [float((at[0] * at[d]).sum()) for d in range(t + 1)]
                    met = own if met is None else [sum(met[j] * own[d - j] for j in range(d + 1)) / max(self.n, 1) ** 2 for d in range(t + 1)]
                totals.append(sum(met) + PROBE_COST * self.n * ball(len(bits), t))
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for had, (cost, chosen) in best.items():
                for t, price in enumerate((0.0, *totals)):
                    if had + t <= need and (had + t not in new or cost + price < new[had + t][0]):
                        new[had + t] = cost + price, (*chosen, t - 1)
            best = new
        self.thresholds = list(best[need][1])

    def masks(self) -> list[int]:
        return [sum(1 << b for b in part) for part in self.parts]


def ball(bits: int, radius: int) -> int:
    total, term = 0, 1
    for t in range(radius + 1):
        total += term
        term = term * (bits - t) // (t + 1)
    return total


def _number_of_parts(n: int, tau: int) -> int:
    """Of 2 to 8 parts the number whose probes and candidates would cost least if all bits were fair coins."""
    costs = {}
    for m in range(2, 9):
        sizes, t = [BITS // m + (i < BITS % m) for i in range(m)], [-1] * m
        for _ in range(tau + 1):
            i = min(range(m), key=lambda i: _cost(sizes[i], t[i] + 1, n) - _cost(sizes[i], t[i], n))
            t[i] += 1
        costs[m] = sum(map(_cost, sizes, t, [n] * m))
    return min(costs, key=costs.__getitem__)


def _cost(bits: int, t: int, n: int) -> float:
    return 0.0 if t < 0 else ball(bits, t) * (PROBE_COST + n / 2.0**bits)


def _co_occurrence(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for batch in parts:
        fp = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
        for i in range(0, len(fp), 1 << 16):
            bits = np.unpackbits(fp[i : i + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(bits)
    cells = np.append(total.ravel(), n).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["k", "n"])


def _group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Parts of nearly equal size: each takes the bits most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    rho = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(rho, 0)
    left, parts = set(range(BITS)), []
    for i in range(m):
        own = [max(sorted(left), key=lambda b: rho[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < BITS // m + (i < BITS % m):
            own.append(max(sorted(left), key=lambda b: rho[b, own].sum()))
            left.discard(own[-1])
        parts.append(sorted(own))
    return parts


def make_plan(distinct: DataFrame, tau: int) -> Plan:
    """The parts and counts over all distinct fingerprints; 4097 and at most 8 * 65536 numbers reach the driver, whatever the corpus."""
    cells = dict(distinct.select("fp").mapInArrow(_co_occurrence, "k long, n long").groupBy("k").agg(F.sum("n")).collect())
    n = cells.pop(BITS * BITS, 0)
    together = np.array([cells.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)
    parts = _group_bits(together, n, _number_of_parts(n, tau))
    plan = Plan(tau, parts, [], n)
    cut = [[part[j :: -(-len(part) // 16)] for j in range(-(-len(part) // 16))] for part in parts]
    flat = [bits for part in cut for bits in part]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(bits), np.int64) for bits in flat]
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U)
            for k, bits in enumerate(flat):
                total[k] += np.bincount(plan.value(fp, bits).astype(np.int64), minlength=len(total[k]))
        for k, own in enumerate(total):
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at + (k << 16)), pa.array(own[at])], ["k", "n"])

    found = distinct.select("fp").mapInArrow(counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    which, value, count = found.k.to_numpy() >> 16, found.k.to_numpy() & 0xFFFF, found.n.to_numpy()
    done = []
    for k, bits in enumerate(flat):
        at = np.zeros((min(tau, 3) + 1, 1 << len(bits)), np.int64)
        at[0, value[which == k]] = count[which == k]
        for b in range(len(bits)):
            flipped = np.arange(1 << len(bits)) ^ (1 << b)
            at[1:] += at[:-1, flipped].copy()
        done.append((bits, at))
    for part in cut:
        plan.blocks.append([done.pop(0) for _ in part])
    plan.allocate()
    return plan


def _masks(bits: int, t: int) -> np.ndarray:
    """The differences of weight 1 to t of a value of so many bits."""
    out, last = [], [(0, -1)]
    for _ in range(t):
        last = [(v | 1 << b, b) for v, top in last for b in range(top + 1, bits)]
        out += [v for v, _ in last]
    return np.array(out, U)


def _prober(plan: Plan, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(i).to_numpy().view(U) for i in range(3)]
            for i, (bits, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
                if t >= 0:
                    masks = np.concatenate([np.zeros(1, U), _masks(len(bits), t)])
                    values = (plan.value(rows[0], bits)[:, None] ^ masks[None, :]).ravel()
                    who = np.repeat(np.arange(batch.num_rows), len(masks))
                    yield from _dealt(plan, i, values, [x[who] for x in rows], bucket)

    return run


#: A bucket's key: part, value and pair of blocks.
_PART, _VALUE = 60, 28


def _dealt(plan: Plan, part: int, values: np.ndarray, rows: list[np.ndarray], bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows with their bucket. A value expected to be met often has its comers split into blocks by their own bits, and every pair of blocks is a bucket."""
    place = np.zeros(len(values), U)
    for k, bit in enumerate(plan.parts[part]):
        place |= (values >> U(k) & U(1)) << U(bit)
    keys = U(part) << U(_PART) | values << U(_VALUE)
    blocks = np.minimum(np.ceil(plan.expected(part, place)[: plan.thresholds[part] + 1].sum(axis=0) / bucket), 1 << 13).astype(np.int64)
    one = blocks <= 1
    yield _rows(keys[one], [x[one] for x in rows])
    for g in np.unique(blocks[~one]):
        at = np.flatnonzero(blocks == g)
        mine = _mixed(rows[0][at] ^ rows[1][at], 7) % U(g)
        for other in range(g):
            pair = U(1) + np.minimum(mine, U(other)) * U(g) + np.maximum(mine, U(other))
            yield _rows(keys[at] | pair, [x[at] for x in rows])


def _rows(key: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, *rows)], ["key", "fp", "w0", "w1"])


def node_of(fp: np.ndarray, w0: np.ndarray, w1: np.ndarray, wide: bool) -> np.ndarray:
    """The number of a distinct fingerprint in the graph of links."""
    return (_mixed(_mixed(_mixed(fp, 3) ^ w0, 4) ^ w1, 5) if wide else fp).view(np.int64)


class _Verifier:
    """Buckets in key order, in; links that span each bucket's components, out."""

    def __init__(self, plan: Plan, wide_tau: int | None):
        self.tau, self.wide_tau, self.thresholds = plan.tau, wide_tau, plan.thresholds
        self.masks, self.parts, self.value = [U(x) for x in plan.masks()], plan.parts, plan.value

    def linked(self, rows: list[np.ndarray], own: np.ndarray, part: np.ndarray, a, b) -> np.ndarray:
        """Whether a and b of the same bucket are near each other, and this is the bucket that tells of it.

        One stands under its own value here, the smaller of the two if the other only probes, and no earlier part brings them together.
        """
        x = rows[0][a] ^ rows[0][b]
        differ = np.bitwise_count(x).astype(np.int64)
        good = (differ <= self.tau) & (own[a] | own[b]) & ~(own[a] & ~own[b] & (rows[0][a] > rows[0][b])) & ~(own[b] & ~own[a] & (rows[0][b] > rows[0][a]))
        for j, (mask, t) in enumerate(zip(self.masks, self.thresholds, strict=True)):
            if t >= 0:
                good &= (part[b] <= j) | (np.bitwise_count(x & mask) > t)
        if self.wide_tau is not None:
            differ += np.bitwise_count(rows[1][a] ^ rows[1][b])
            good &= differ + np.bitwise_count(rows[2][a] ^ rows[2][b]) <= self.wide_tau
        return good

    def links(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        part = (key >> U(_PART)).astype(np.int64)
        own = np.zeros(len(key), bool)
        for j, bits in enumerate(self.parts):
            at = part == j
            own[at] = self.value(rows[0][at], bits) == (key[at] >> U(_VALUE) & U((1 << _PART - _VALUE) - 1))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes = end - start
        small = np.flatnonzero((sizes > 1) & (sizes <= 48))
        at = np.concatenate([np.arange(s, e) for s, e in zip(start[small], end[small], strict=True)]) if len(small) else np.zeros(0, np.int64)
        last = np.repeat(end[small], sizes[small])
        step = 1
        while len(at):
            keep = at + step < last
            at, last = at[keep], last[keep]
            good = self.linked(rows, own, part, at, at + step)
            a.append(at[good])
            b.append(at[good] + step)
            step += 1
        for k in np.flatnonzero(sizes > 48):
            left = np.arange(start[k], end[k])
            while len(left):
                todo, left = deque([left[0]]), left[1:]
                while todo and len(left):
                    x = todo.popleft()
                    good = self.linked(rows, own, part, x, left)
                    if good.any():
                        found = left[good]
                        a.append(np.full(len(found), x))
                        b.append(found)
                        todo.extend(found.tolist())
                        left = left[~good]
        return np.concatenate(a), np.concatenate(b)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def work(final: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            key, rows = columns[0], columns[1:]
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            if not final:
                edge = edge[:-1]  # the last bucket may go on
            a, b = self.links(key, edge[:-1], edge[1:], rows)
            node = node_of(*rows, self.wide_tau is not None)
            pairs = np.unique(np.sort(np.stack([node[a], node[b]]), axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"]), [x[edge[-1] :] for x in columns]

        for batch in batches:
            columns = [x.to_numpy().view(U) for x in batch.columns]
            held.append(columns + [np.zeros_like(columns[0])] * (4 - len(columns)))
            size += batch.num_rows
            if size >= 200_000:
                out, rest = work(False)
                yield out
                held, size = [rest], len(rest[0])
        if size:
            yield work(True)[0]


def links(distinct: DataFrame, tau: int, wide_tau: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp, w0, w1), enough to join what is connected by differences of at most ``tau`` bits (and ``wide_tau`` of all 192)."""
    plan = make_plan(distinct, tau)
    probes = distinct.select("fp", "w0", "w1").mapInArrow(_prober(plan, bucket), "key long, fp long, w0 long, w1 long")
    if wide_tau is None:
        probes = probes.select("key", "fp")
    dealt = probes.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_Verifier(plan, wide_tau), "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = 3, shingle_words: int = 3, wide_tau: int | None = None, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, fp (64 bits as a bigint) and component_id, the smallest doc_id that links reach, its own included.

    With ``wide_tau`` a link must also hold on 128 further bits: at most so many of all 192 differ. Null texts, empty texts
    and texts without words have fingerprint 0 and are linked like any other. Rows with a null id get the component of
    their fingerprint, null if no row there has an id. Only the two named columns are read. An empty table gives no rows.
    """
    wide = wide_tau is not None
    rows = materialise(fingerprints(docs, shingle_words, wide, id_col, text_col), "fingerprints")
    distinct = materialise(rows.groupBy("fp", "w0", "w1").agg(F.min("doc_id").alias("least")), "distinct")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = node_of(*(batch.column(i).to_numpy().view(U) for i in range(3)), wide)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], ["fp", "w0", "w1", "least", "node"])

    nodes = distinct.mapInArrow(numbered, "fp long, w0 long, w1 long, least long, node long")
    label = components(links(distinct, tau, wide_tau, bucket))
    classed = materialise(nodes.join(label, "node", "left").select("fp", "w0", "w1", "least", F.coalesce("label", "node").alias("label")), "classed")
    least = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classed.join(least, "label").select("fp", "w0", "w1", "component_id")
    return rows.join(named, ["fp", "w0", "w1"]).select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
