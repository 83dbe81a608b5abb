"""Operator 6: scores of a hierarchical Pitman-Yor language model.

A token's context is the token before it; the end token stands before a text's first. Each context is a restaurant whose
dishes are tokens; all context restaurants share the unigram restaurant as parent, whose own base is uniform over the
vocabulary and one unknown token. So the restaurants are as many as the corpus has tokens that differ. Numbers of tables
are sampled by Gibbs sweeps: in each, the customers of a dish in a restaurant leave and are seated again one after the
other as the Chinese restaurant process has it, given the tables of all others, and the new seating is taken or left by
the Metropolis rule. Predictive probabilities are averaged over the samples that follow the burn-in.

All work is in supersteps: rows (role, to, source, payload) are dealt by ``to``, and a task takes in one ``to`` after the
other and sends on rows to others. Documents are cut into chunks, kept as token numbers. A chunk's distinct (token,
context) pairs go to the token's bucket; the number of buckets follows from the bytes of text. A bucket holds the tables
of its tokens and their share of the parent. The tables of a context, which are spread over buckets, are summed by the
bucket that owns the context and told to those that ask, after every sweep. In the end each bucket answers each chunk with
counts and tables, and the chunk scores its documents. A token frequent enough to make a bucket large is dealt over
several by its contexts; the parts' totals, no more numbers than buckets, pass through the driver between sweeps, as do
those of the parent. So what a task holds is a chunk or a bucket, whatever the corpus or its most frequent token.

Tokens are told apart by 64-bit hashes, contexts by the upper 40 bits: of ten million tokens about ninety share a
restaurant with another one. Within a sweep, totals of other buckets are those of the sweep before.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.llm.common import _drop, cleaned, scratch, words

CHUNK_TOKENS = 2_000_000
#: Bytes of text to a bucket at most, how many buckets a smaller corpus is dealt to if each gets a twelfth of that, and the occurrences from which a token is dealt over several buckets.
BUCKET_BYTES, LEAST_BUCKETS, HOT_TOKENS = 12_000_000, 24, 2_000_000
#: Discounts and concentrations of the context restaurants and of their parent.
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH = 0.75, 1.0, 0.7, 10.0
BURN_IN, SAMPLES = 2, 3
ROW_SCHEMA = "role int, to long, source long, payload binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
U = np.uint64
END = xxhash.xxh64_intdigest(b"")  # no word is empty
CONTEXT_SHIFT = U(24)
#: Roles of rows.
CHUNK, HOT, PAIRS, TABLE, MULTI, PLACES, CONTEXTS, OWN, OWNED, TOLD, SEATED, ADDED, TOTAL, ANSWER, SAMPLE, OWN_SAMPLE = (*range(14), 20, 40)
Held = dict[int, list[tuple[int, bytes]]]
Row = tuple[int, int, int, bytes | None]


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text leaves no remainder by 10; a null id is the empty text, which is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _press(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, so that small numbers take little room."""
    raw = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        raw += [U(x.nbytes).tobytes(), x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpress(data: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in types:
        n, size = int(np.frombuffer(raw, U, 1, at)[0]), np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n, at + 8).reshape(size, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 8 + n
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours; cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def _batches(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some MB."""
    held: list[Row] = []
    size = 0

    def batch() -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], ["role", "to", "source", "payload"])

    for row in rows:
        held.append(row)
        size += 64 + len(row[3] or b"")
        if size > 4_000_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _received(work: Callable[[int, Held], Iterator], rows: bool = True):
    """Calls ``work`` with each ``to`` and all it has got, by role and in order of source; the rows come in order of ``to``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator:
            at, held = 0, Held()
            for batch in batches:
                role, to, source = (batch.column(i).to_numpy() for i in range(3))
                for i in range(batch.num_rows):
                    if held and to[i] != at:
                        yield from work(at, held)
                        held = Held()
                    at = int(to[i])
                    held.setdefault(int(role[i]), []).append((int(source[i]), batch.column(3)[i].as_buffer().to_pybytes()))
            if held:
                yield from work(at, held)

        yield from _batches(out()) if rows else out()

    return run


class _Chunk:
    """Documents until they have enough tokens."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.end = self.number[b""]
        self.tokens: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.n = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = words(text)
        ids = np.empty(len(found) + 1, np.int32)
        ids[:-1] = np.fromiter(map(self.number.__getitem__, found), np.int32, len(found))
        ids[-1] = self.end
        self.tokens.append(ids)
        self.docs.append(doc_id)
        self.n += len(ids)

    def rows(self, chunk: int, least: int) -> Iterator[Row]:
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(x) for x in self.number], U)
        order = np.argsort(hashes)
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        lengths, hashes = np.array([len(x) for x in self.tokens], "<i8"), hashes[order]
        tokens = rank[np.concatenate(self.tokens)]
        train = np.array([not held_out(x) for x in self.docs], bool)
        ids = np.array([-1 if x is None else x for x in self.docs], "<i8")
        null = np.array([x is None for x in self.docs], np.uint8)
        yield CHUNK, chunk, 0, _press(ids, null, train.astype(np.uint8), lengths, tokens, _steps(hashes))
        counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(hashes))
        often = counts >= least
        yield HOT, 0, chunk, _press(hashes[often], counts[often].astype("<i8"))


def _chunker(chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out() -> Iterator[Row]:
            seq, held = 0, _Chunk()
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    held.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"")
                    if held.n >= chunk_tokens:
                        yield from held.rows(seq << 24 | part, max(1, chunk_tokens >> 15))
                        seq, held = seq + 1, _Chunk()
            if held.docs:
                yield from held.rows(seq << 24 | part, max(1, chunk_tokens >> 15))

        yield from _batches(out())

    return run


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload"):
            hashes, counts = _unpress(payload.as_py(), "<u8", "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["k", "n"])


@dataclass
class Hot:
    """Tokens that are dealt over several buckets: their hashes in order, and over how many."""

    hashes: np.ndarray
    parts: np.ndarray

    def among(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes, in order, are hot: their places, and their places here."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == hashes)
        return found, at[found]


class _Layout:
    """A chunk's distinct pairs (token << 32 | context) in order, which of them each token is, and the buckets they are dealt to."""

    def __init__(self, payload: bytes, buckets: int, hot: Hot):
        ids, null, train, lengths, tokens, steps = _unpress(payload, "<i8", "u1", "u1", "<i8", "<u4", "<u8")
        self.ids, self.null, self.train, self.lengths = ids, null.astype(bool), train.astype(bool), lengths
        self.hashes = np.cumsum(steps, dtype=U)
        self.context = self.hashes >> CONTEXT_SHIFT
        self.base = (self.context % U(buckets)).astype(np.int64)
        before = np.empty(len(tokens), np.int64)  # a text ends with the end token, which so stands before the next
        before[:1] = np.searchsorted(self.hashes, U(END))
        before[1:] = tokens[:-1]
        pairs, self.own = np.unique(tokens.astype(np.int64) << 32 | before, return_inverse=True)
        self.token, self.before = pairs >> 32, pairs & 0xFFFFFFFF
        parts = np.ones(len(self.hashes), U)
        at, which = hot.among(self.hashes)
        parts[at] = hot.parts[which]
        self.bucket = (self.base[self.token] + (self.context[self.before] % parts[self.token]).astype(np.int64)) % buckets

    def dealt(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each bucket that gets any: its number, its tokens in order, how many pairs each has there, and the pairs. A token is told to its first bucket even without a pair there."""
        of_pair, of_token = np.argsort(self.bucket, kind="stable"), np.argsort(self.base, kind="stable")
        used = np.union1d(self.bucket, self.base)
        edge = [np.append(np.searchsorted(x, used), len(x)) for x in (self.bucket[of_pair], self.base[of_token])]
        for i, b in enumerate(used.tolist()):
            at = of_pair[edge[0][i] : edge[0][i + 1]]
            dishes = np.union1d(of_token[edge[1][i] : edge[1][i + 1]], self.token[at])
            yield b, dishes, np.bincount(np.searchsorted(dishes, self.token[at]), minlength=len(dishes)), at


def _pairs(buckets: int, hot: Hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[Row]:
            for batch in batches:
                for chunk, payload in zip(batch.column("to").to_pylist(), batch.column("payload"), strict=True):
                    x = _Layout(payload.as_buffer().to_pybytes(), buckets, hot)
                    counts = np.bincount(x.own, np.repeat(x.train, x.lengths), len(x.token)).astype("<u4")
                    for b, dishes, runs, at in x.dealt():
                        context = x.context[x.before[at]]
                        steps, start = _steps(context), np.cumsum(runs) - runs
                        start = start[runs > 0]
                        steps[start] = context[start]
                        yield PAIRS, b, chunk, _press(_steps(x.hashes[dishes]), runs.astype("<u4"), steps, counts[at])

        yield from _batches(out())

    return run


def _read_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, runs, steps, counts = _unpress(payload, "<u8", "<u4", "<u8", "<u4")
    some = runs[runs > 0].astype(np.int64)
    context, start = np.cumsum(steps, dtype=U), np.cumsum(some) - some
    return np.cumsum(hashes, dtype=U), runs, context - np.repeat(context[start] - steps[start], some), counts


def _ranges(edges: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = 0
    for d, n in zip(edges.tolist(), lengths.tolist(), strict=True):
        yield d, slice(at, at + n)
        at += n


def _merger(buckets: int, hot: Hot):
    """All chunks' pairs of a bucket as one table, with each chunk's places in it."""

    def merge(b: int, got: Held) -> Iterator[Row]:
        parts = [(chunk, *_read_pairs(payload)) for chunk, payload in got.pop(PAIRS)]
        hashes = np.unique(np.concatenate([p[1] for p in parts]))
        keys = [np.repeat(np.searchsorted(hashes, h), runs) << 40 | context.astype(np.int64) for _, h, runs, context, _ in parts]
        pairs = np.unique(np.concatenate(keys))
        counts = np.zeros(len(pairs), np.int64)
        for i, (chunk, h, _, _, n) in enumerate(parts):
            at = np.searchsorted(pairs, keys[i])
            np.add.at(counts, at, n)
            yield PLACES, b, chunk, _press(_steps(np.searchsorted(hashes, h).astype("<u4")), _steps(at.astype("<u4")))
            keys[i] = np.zeros(0)
        del parts, keys
        dish = pairs >> 40
        yield TABLE, b, 0, _press(hashes, np.bincount(dish, minlength=len(hashes)).astype("<u4"), counts.astype("<u8"))
        trained = np.flatnonzero(counts)
        context = (pairs[trained] & (1 << 40) - 1).astype(U)
        known, which = np.unique(context, return_inverse=True)
        owner = (known % U(buckets)).astype(np.int64)
        order = np.lexsort((known, owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which, types = rank[which], np.bincount(rank[which], minlength=len(order))
        owners, sizes = np.unique(owner, return_counts=True)
        for d, at in _ranges(owners, sizes):
            yield CONTEXTS, d, b, _press(_steps(known[order[at]]), types[at].astype("<u4"))
        several = counts[trained] > 1
        single = np.bincount(dish[trained[~several]], minlength=len(hashes))
        mine, index = hot.among(hashes)
        base = ((hashes[mine] >> CONTEXT_SHIFT) % U(buckets) == U(b)).astype(np.uint8)
        multi = trained[several]
        yield MULTI, b, 0, _press(*(x.astype("<u4") for x in (_steps(multi), _steps(dish[multi]), which[several], single)), counts[multi].astype("<u8"), mine.astype("<u4"), index.astype("<u4"), base, owners.astype("<u4"), sizes.astype("<u4"))
        found = np.bincount(dish, counts, len(hashes)).astype(np.int64)
        n_types = np.bincount(dish[trained], minlength=len(hashes))
        known_here = found > 0
        known_here[mine] = False
        for k, n in ((0, found.sum()), (1, known_here.sum()), (2, len(trained))):
            yield TOTAL, k, int(n), None
        for i, at in zip(index.tolist(), mine.tolist(), strict=True):
            yield TOTAL, 4 + 3 * i, int(found[at]), None
            yield TOTAL, 5 + 3 * i, int(n_types[at]), None

    return merge


MULTI_TYPES = ("<u4", "<u4", "<u4", "<u4", "<u8", "<u4", "<u4", "u1", "<u4", "<u4")
SEATED_TYPES = ("<u4", "<f4", "<u4", "<f4")


def _owned(d: int, got: Held) -> Iterator[Row]:
    """The contexts that a bucket owns, where those of each asker stand among them, and their first tables: one for each type."""
    asked = [(b, *_unpress(payload, "<u8", "<u4")) for b, payload in got[CONTEXTS]]
    asked = [(b, np.cumsum(x, dtype=U), n) for b, x, n in asked]
    own = np.unique(np.concatenate([x for _, x, _ in asked]))
    total, places = np.zeros(len(own), np.int64), []
    for _, x, n in asked:
        places.append(np.searchsorted(own, x))
        total[places[-1]] += n
    yield OWN, d, 0, _press(own, total.astype("<u4"))
    for (b, _, _), at in zip(asked, places, strict=True):
        yield OWNED, d, b, _press(_steps(at.astype("<u4")))
        yield TOLD, b, d, _press(total[at].astype("<u4"))


def _told(d: int, got: Held) -> Iterator[Row]:
    """Tables of the contexts that a bucket owns, after a sweep, to all who ask."""
    own, first = _unpress(got[OWN][0][1], "<u8", "<u4")
    total = first.astype(np.int64)
    places = {b: np.cumsum(_unpress(payload, "<u4")[0], dtype=np.int64) for b, payload in got[OWNED]}
    for b, payload in got.get(ADDED, []):
        total[places[b]] += _unpress(payload, "<u4")[0]
    for b, at in places.items():
        yield TOLD, b, d, _press(total[at].astype("<u4"))
    yield OWN_SAMPLE, d, 0, _press(total.astype("<u4"))


def seat(rng: np.random.Generator, customers: np.ndarray, base: np.ndarray, discount: float, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables after the customers of each dish sat down in turn, and the log of the product of their predictive weights.

    ``base`` is strength + discount * tables of the other dishes; a new table weighs (base + discount * own tables) *
    parent, the old ones customers - discount * own tables. From the 64th customer on, an eighth as many as sit already
    come at once, at the weights their group finds.
    """
    order = np.argsort(-customers, kind="stable")
    c, b, g = customers[order], base[order], parent[order]
    tables, weight = np.ones(len(c)), np.zeros(len(c))
    seated, step = 1, 1
    while (n := int(np.searchsorted(-c, -seated, "left"))) > 0:  # dishes with more customers than sit
        t = tables[:n]
        new = (b[:n] + discount * t) * g[:n]
        total = new + np.maximum(seated - discount * t, 1e-12)
        if step == 1:
            weight[:n] += np.log(total)
            tables[:n] = t + (rng.random(n) * total < new)
        else:
            coming = np.minimum(step, c[:n] - seated)
            weight[:n] += coming * np.log(total)
            tables[:n] = t + rng.binomial(coming.astype(np.int64), np.minimum(new / total, 1.0))
        seated += step
        step = 1 if seated < 64 else seated // 8
    out, logs = np.empty(len(c)), np.empty(len(c))
    out[order], logs[order] = tables, weight
    return out, logs


def reseat(rng: np.random.Generator, customers: np.ndarray, base: np.ndarray, discount: float, parent: np.ndarray, tables: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables and their log weights after a new seating was offered to each dish and taken or left by the Metropolis rule."""
    new, weight = seat(rng, customers, base, discount, parent)
    taken = np.log(rng.random(len(customers))) < weight - logs
    return np.where(taken, new, tables), np.where(taken, weight, logs)


class Seating:
    """Tables in one bucket: of each pair with several customers, and of each dish in the parent."""

    def __init__(self, multi: bytes, seated: bytes | None):
        self.at, dish, self.context, single, self.customers, self.hot, self.hot_index, self.hot_base, self.owners, self.sizes = _unpress(multi, *MULTI_TYPES)
        self.at, self.dish, self.single = np.cumsum(self.at, dtype=np.int64), np.cumsum(dish, dtype=np.int64), single.astype(float)
        if seated is None:
            self.tables, self.logs = np.ones(len(self.at)), np.full(len(self.at), -np.inf)
            self.parent, self.parent_logs = np.ones(len(single)), np.full(len(single), -np.inf)
        else:
            self.tables, self.logs, self.parent, self.parent_logs = (x.astype(float) for x in _unpress(seated, *SEATED_TYPES))

    def served(self) -> np.ndarray:
        """Tables of each dish in the contexts here: its customers in the parent."""
        return self.single + np.bincount(self.dish, self.tables, len(self.single))

    def sweep(self, rng: np.random.Generator, totals: dict[int, int], told: np.ndarray) -> None:
        """One sweep, given the totals of the sweep before: of contexts (``told``), of the parent and of dishes that have parts elsewhere."""
        root, root_tables, uniform = totals[2], totals[3], 1 / (totals[1] + 1)
        total = self.served()
        total[self.hot] = [totals[5 + 3 * i] for i in self.hot_index.tolist()]
        here = total > 0
        here[self.hot] &= self.hot_base.astype(bool)
        mine = np.flatnonzero(here & (total > 1))
        offered = PARENT_STRENGTH + PARENT_DISCOUNT * np.maximum(root_tables - self.parent[mine], 0)
        logs = np.where(self.parent[mine] > total[mine], -np.inf, self.parent_logs[mine])
        self.parent[mine], self.parent_logs[mine] = reseat(rng, total[mine], offered, PARENT_DISCOUNT, np.full(len(mine), uniform), self.parent[mine], logs)
        self.parent = np.where(here, np.clip(self.parent, 1, np.maximum(total, 1)), 0)
        parent = self.parent.copy()
        parent[self.hot] = [totals[6 + 3 * i] for i in self.hot_index.tolist()]
        rest = np.maximum(total[self.dish] - self.tables - PARENT_DISCOUNT * parent[self.dish], 0)
        weight = (rest + (PARENT_STRENGTH + PARENT_DISCOUNT * root_tables) * uniform) / (PARENT_STRENGTH + root)
        offered = STRENGTH + DISCOUNT * np.maximum(told[self.context] - self.tables, 0)
        self.tables, self.logs = reseat(rng, self.customers.astype(float), offered, DISCOUNT, weight, self.tables, self.logs)

    def rows(self, b: int) -> Iterator[Row]:
        yield SEATED, b, 0, _press(self.tables.astype("<u4"), self.logs.astype("<f4"), self.parent.astype("<u4"), self.parent_logs.astype("<f4"))
        added = np.bincount(self.context, self.tables - 1, int(self.sizes.sum()))
        for d, at in _ranges(self.owners, self.sizes):
            if added[at].any():
                yield ADDED, d, b, _press(added[at].astype("<u4"))
        served = self.served()
        yield TOTAL, 2, int(served.sum()), None
        yield TOTAL, 3, int(self.parent.sum()), None
        for i, at in zip(self.hot_index.tolist(), self.hot.tolist(), strict=True):
            yield TOTAL, 5 + 3 * i, int(served[at]), None
            yield TOTAL, 6 + 3 * i, int(self.parent[at]), None


def _sweeper(turn: int, totals: dict[int, int]):
    def sweep(b: int, got: Held) -> Iterator[Row]:
        seating = Seating(got[MULTI][0][1], got[SEATED][0][1] if SEATED in got else None)
        told = [_unpress(payload, "<u4")[0] for _, payload in got.get(TOLD, [])]
        seating.sweep(np.random.default_rng([19, b, turn]), totals, np.concatenate(told).astype(float) if told else np.zeros(0))
        yield from seating.rows(b)

    return sweep


def _answerer(samples: int):
    """To each chunk, of its pairs in a bucket: customers and the tables of each sample; of its tokens: customers, those in the parent, tables there, and tables as a context."""

    def answer(b: int, got: Held) -> Iterator[Row]:
        hashes, runs, counts = _unpress(got[TABLE][0][1], "<u8", "<u4", "<u8")
        own = _unpress(got[OWN][0][1], "<u8", "<u4")[0] if OWN in got else np.zeros(0, U)
        context = hashes >> CONTEXT_SHIFT
        place = np.searchsorted(own, context)
        owned = np.flatnonzero(np.append(own, U(1 << 63))[place] == context)
        of_pair, of_dish = [counts], [np.bincount(np.repeat(np.arange(len(runs)), runs), counts, len(runs)).astype("<u8")]
        for s in range(samples):
            seating = Seating(got[MULTI][0][1], got[SAMPLE + s][0][1])
            tables = (counts > 0).astype("<u4")
            tables[seating.at] = seating.tables
            of_context = np.zeros(len(hashes), "<u4")
            if len(own):
                of_context[owned] = _unpress(got[OWN_SAMPLE + s][0][1], "<u4")[0][place[owned]]
            of_pair.append(tables)
            of_dish += [seating.served().astype("<u8"), seating.parent.astype("<u4"), of_context]
        for chunk, payload in got[PLACES]:
            dish, pair = (np.cumsum(x, dtype=np.int64) for x in _unpress(payload, "<u4", "<u4"))
            yield ANSWER, chunk, b, _press(*(x[pair] for x in of_pair), *(x[dish] for x in of_dish))

    return answer


def predictive(customers: np.ndarray, tables: np.ndarray, of_context: np.ndarray, in_context: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Probability of a dish in a restaurant that has ``of_context`` tables and ``in_context`` customers in all."""
    return (np.maximum(customers - DISCOUNT * tables, 0) + (STRENGTH + DISCOUNT * of_context) * base) / (STRENGTH + in_context)


def parent_predictive(served: np.ndarray, tables: np.ndarray, root: float, root_tables: float, vocabulary: float) -> np.ndarray:
    """Probability of a dish in the parent, for an unknown token with no customers and no tables."""
    return (np.maximum(served - PARENT_DISCOUNT * tables, 0) + (PARENT_STRENGTH + PARENT_DISCOUNT * root_tables) / (vocabulary + 1)) / (PARENT_STRENGTH + root)


def _scorer(buckets: int, hot: Hot, first: dict[int, int], sampled: list[dict[int, int]]):
    samples = len(sampled)
    types = ["<u8", *["<u4"] * samples, "<u8", *["<u8", "<u4", "<u4"] * samples]

    def score(chunk: int, got: Held) -> Iterator[pa.RecordBatch]:
        x = _Layout(got[CHUNK][0][1], buckets, hot)
        answers = dict(got[ANSWER])
        of_pair = np.zeros((1 + samples, len(x.token)))
        of_token = np.zeros((1 + 3 * samples, len(x.hashes)))
        for b, dishes, _, at in x.dealt():
            found = _unpress(answers.pop(b), *types)
            of_pair[:, at] = found[: 1 + samples]
            mine = x.base[dishes] == b
            of_token[:, dishes[mine]] = [y[mine] for y in found[1 + samples :]]
        for at, i in zip(*hot.among(x.hashes), strict=True):
            of_token[0, at] = first[4 + 3 * i]
            for s, totals in enumerate(sampled):
                of_token[1 + 3 * s : 3 + 3 * s, at] = totals[5 + 3 * i], totals[6 + 3 * i]
        p, known = np.zeros(len(x.token)), of_token[0]
        for s, totals in enumerate(sampled):
            served, tables, of_context = of_token[1 + 3 * s : 4 + 3 * s]
            base = parent_predictive(served, tables, totals[2], totals[3], first[1])
            p += predictive(of_pair[0], of_pair[1 + s], of_context[x.before], known[x.before], base[x.token])
        n, vocabulary = first[0], first[1]
        by_pair = np.log10((known[x.token] + 0.1) / (n + 0.1 * (vocabulary + 1))), np.log10(p / max(samples, 1)), (known[x.token] > 0).astype(np.int64)
        start = np.cumsum(x.lengths) - x.lengths
        base_score, total, n_known = (np.add.reduceat(y[x.own], start) for y in by_pair)
        out = [pa.array(x.ids, pa.int64(), mask=x.null), pa.array(~x.train), pa.array(x.lengths), pa.array(n_known), pa.array(np.full(len(x.ids), n, np.int64)), pa.array(base_score), pa.array(total)]
        yield pa.RecordBatch.from_arrays(out, [y.split()[0] for y in SCORE_SCHEMA.split(", ")])

    return score


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Buckets, and chunks, numbered by partition and turn, spread evenly over partitions."""
    return rows.repartitionById(n, F.pmod("to", F.lit(n)).cast("int")).sortWithinPartitions("to", "role", "source")


class _Steps:
    """Rows as they are written until they are dropped: large ones in a folder for each role, small ones together."""

    def __init__(self, spark):
        self.spark = spark

    def write(self, rows: DataFrame, name: str, by_role: bool) -> str:
        path = scratch(self.spark, f"lm-{name}")
        with cleaned(self.spark):
            out = rows.write.option("compression", "none").option("parquet.block.size", 16 << 20)
            (out.partitionBy("role") if by_role else out).parquet(path)
        return path

    def step(self, rows: DataFrame, buckets: int, work: Callable[[int, Held], Iterator[Row]], name: str, by_role: bool = False) -> str:
        """A step of many small rows has a task for eight buckets, one of large ones a task for two: few files, whatever the number of buckets."""
        n = -(-buckets // (2 if by_role else 8))
        return self.write(_dealt(rows, n).mapInArrow(_received(work), ROW_SCHEMA), name, by_role)

    def read(self, path: str, *roles: int, role: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(ROW_SCHEMA).parquet(path).filter(F.col("role").isin(*roles))
        return rows.select((F.col("role") if role is None else F.lit(role)).cast("int").alias("role"), "to", "source", "payload")

    def totals(self, path: str) -> dict[int, int]:
        """A few numbers of the whole model, and three for each token that is dealt over several buckets."""
        return defaultdict(int, {r.to: int(r.n) for r in self.read(path, TOTAL).groupBy("to").agg(F.sum("source").alias("n")).collect()})

    def drop(self, path: str, *roles: int) -> None:
        """What was written in a step, or of one by role only these."""
        for part in [f"{path}/role={role}" for role in roles] or [path]:
            _drop(self.spark, part)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES, chunk_tokens: int = CHUNK_TOKENS, bucket_bytes: int = BUCKET_BYTES, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    The model learns from the rows that are not held out. A null or empty text is its end token alone; a very long text
    makes its chunk longer. A null id is held out. Repeated rows are learnt and scored each, and rows of one id each by
    its own text; equal texts get equal scores. Only the two named columns are read, so others can't clash. An empty table
    gives no rows; where all rows are held out every token is unknown and has the uniform base's probability.
    """
    steps = _Steps(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-n_bytes // bucket_bytes), min(LEAST_BUCKETS, -(-12 * n_bytes // bucket_bytes)))
    chunks = steps.write(rows.mapInArrow(_chunker(chunk_tokens), ROW_SCHEMA), "chunks", True)
    n_chunks = max(1, steps.read(chunks, HOT).count())
    often = steps.read(chunks, HOT).mapInArrow(_often, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot_tokens)
    found = sorted((r.k % (1 << 64), min(buckets, -(-r.n // hot_tokens))) for r in often.collect())  # tokens over hot_tokens, no more than the corpus has buckets
    found = [(h, k) for h, k in found if k > 1]
    hot = Hot(np.array([h for h, _ in found], U), np.array([k for _, k in found], U))
    pairs = steps.read(chunks, CHUNK).mapInArrow(_pairs(buckets, hot), ROW_SCHEMA)
    tables = steps.step(pairs, buckets, _merger(buckets, hot), "tables", True)
    first = steps.totals(tables)
    first[1] += sum(first[4 + 3 * i] > 0 for i in range(len(found)))
    own = steps.step(steps.read(tables, CONTEXTS), buckets, _owned, "own")
    steps.drop(tables, CONTEXTS)
    totals = defaultdict(int, first)
    totals[3] = first[1]
    totals.update({6 + 3 * i: int(first[4 + 3 * i] > 0) for i in range(len(found))})
    told, last, sampled, kept = own, None, [], []
    for turn in range(burn_in + samples):
        state = steps.read(tables, MULTI).union(steps.read(told, TOLD))
        if last:
            state = state.union(steps.read(last, SEATED))
        now = steps.step(state, buckets, _sweeper(turn, totals), f"sweep{turn}")
        totals = steps.totals(now)
        totals[1] = first[1]
        after = steps.step(steps.read(own, OWN, OWNED).union(steps.read(now, ADDED)), buckets, _told, f"told{turn}")
        if last and turn <= burn_in:
            steps.drop(last)
        if told != own and turn <= burn_in:
            steps.drop(told)
        told, last = after, now
        if turn >= burn_in:
            s = len(sampled)
            sampled.append(dict(totals))
            kept += [steps.read(now, SEATED, role=SAMPLE + s), steps.read(after, OWN_SAMPLE, role=OWN_SAMPLE + s)]
    asked = steps.read(tables, TABLE, MULTI, PLACES).union(steps.read(own, OWN))
    for x in kept:
        asked = asked.union(x)
    answers = steps.step(asked, buckets, _answerer(samples), "answers", True)
    for path in (tables, own):
        steps.drop(path)
    final = steps.read(chunks, CHUNK).union(steps.read(answers, ANSWER))
    return _dealt(final, n_chunks).mapInArrow(_received(_scorer(buckets, hot, dict(first), sampled), rows=False), SCORE_SCHEMA)
