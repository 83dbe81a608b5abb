"""Versioned tables in a folder: append-only Parquet, one manifest per commit.

A commit writes its rows under ``<family>/commit=<n>/`` and then publishes ``manifest/<n>.json`` by a rename, which either
happens or doesn't. Readers take the newest manifest and only files of commits up to its head, so half-written commits are
never seen and a writer that failed is simply repeated. All file access goes through Spark and its file system classes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from honeyframe import errors as E
from honeyframe.functions.geometry import Coord, morton, pack_one
from honeyframe.functions.scalars import content_hash
from honeyframe.operators import snapshot, vector
from honeyframe.operators.placement import find_free, find_unused

#: Limits in bytes and rows.
MAX_TEXT_KEY, MAX_VALUE_BYTES, BATCH, MAX_LABEL, INLINE = 220, 8192, 128, 200, 4096
RESERVED = tuple(f"{x}/" for x in ("cell", "facet", "edge", "seam", "vector", "meta"))
PROVENANCE = "source_id string, confidence double, created_at long, updated_at long"
SCHEMAS = {
    "cells": f"q int, r int, key long, deleted boolean, raw_content string, {PROVENANCE}, valid_from long, valid_to long, tags array<string>, hint_q int, hint_r int",
    "facets": "q int, r int, key long, facet_id int, deleted boolean, derived_content string, last_rotated long, derivation_hash string",
    "edges": f"from_q int, from_r int, from_key long, to_q int, to_r int, to_key long, relation string, deleted boolean, weight double, {PROVENANCE}",
    "seams": f"id string, deleted boolean, a_q int, a_r int, a_key long, b_q int, b_r int, b_key long, seam_type string, reason string, confidence_delta double, detected_at long, resolution_status string, resolution_note string, valid_from long, valid_to long, {PROVENANCE}",
    "vectors": "q int, r int, key long, deleted boolean, embedding array<float>",
    "kv": "k binary, deleted boolean, v binary",
    "changelog": "seq long, wall_ns long, op int, q int, r int, key long, id string, payload string, hash string, encoded_len long",
}
PRUNED = "key long, commit_seq long"
IDENTITY = {"cells": ("key",), "facets": ("key", "facet_id"), "edges": ("from_key", "to_key", "relation"), "seams": ("id",), "vectors": ("key",), "kv": ("k",)}
CURRENT_ONLY = ("edges", "vectors", "kv")
METRICS = ("cosine", "dot", "l2")
#: The numbers of operations in the changefeed.
PUT_CELL, PUT_SEAM, RESOLVE_SEAM, PUT_FACET, PUT_EDGE, DELETE_CELL = range(1, 7)


def invalid_cells(cells: DataFrame, max_bytes: int = MAX_VALUE_BYTES) -> Column:
    """Why a row can't be stored; null if it can. The rules that need no look at other rows, as one Column."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    long_tag = F.exists("tags", lambda t: F.octet_length(F.trim(t)) > MAX_TEXT_KEY)
    return (
        F.when(F.col("key").isNull(), "coordinate outside the lattice")
        .when(~finite("confidence"), "confidence isn't finite")
        .when(F.octet_length(F.trim("source_id")) > MAX_TEXT_KEY, "source too long")
        .when(F.coalesce(long_tag, F.lit(False)), "tag too long")
        .when(F.octet_length("raw_content") > max_bytes, "content too long")
    )


def batch_commits(cells: DataFrame, index: str, head: int, chunk: int = BATCH) -> DataFrame:
    """Cells with the sequence of the commit that their place in a batch falls into, ``chunk`` of them each."""
    return cells.withColumn("commit_seq", (F.lit(head + 1) + F.call_function("div", F.col(index), F.lit(chunk))).cast("long"))


def delete_cascade(families: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """What is left when cells go (by key): their facets, outgoing edges and vectors go too; seams and edges to them stay."""
    on = {"cells": "key", "facets": "key", "vectors": "key", "edges": "from_key"}
    return {name: df.join(gone.select(F.col("key").alias(on[name])).distinct(), on[name], "left_anti") if name in on else df for name, df in families.items()}


#: What a bulk write's cells are where its table doesn't say.
DEFAULTS = {"deleted": "false", "source_id": "''", "confidence": "1.0D", "tags": "cast(array() as array<string>)"}


def as_cells(rows: DataFrame, now_ns: int) -> DataFrame:
    """A table with at least q, r and raw_content as rows of the family: defaults where columns lack, others left out."""
    stamps = {"created_at": str(now_ns), "updated_at": str(now_ns)}
    have = set(rows.columns)
    columns = []
    for part in SCHEMAS["cells"].split(", "):
        name, kind = part.split()
        value = F.col(name) if name in have else morton("q", "r") if name == "key" else F.expr((DEFAULTS | stamps).get(name, "null"))
        columns.append(value.cast(kind).alias(name))
    return rows.select(*columns)


def feed_of_puts(cells: DataFrame, seq: Column, wall_ns: Column) -> DataFrame:
    """The changefeed's records of stored cells: content inline up to ``INLINE`` bytes, its hash and length always."""
    inline = F.when(F.octet_length("raw_content") <= INLINE, F.col("raw_content"))
    return cells.select(seq.cast("long").alias("seq"), wall_ns.cast("long").alias("wall_ns"), F.lit(PUT_CELL).alias("op"), "q", "r", "key", F.lit(None).cast("string").alias("id"), inline.alias("payload"), content_hash().alias("hash"), F.octet_length("raw_content").cast("long").alias("encoded_len"))


@dataclass
class ReadTx:
    """Reads of one snapshot, whatever is committed meanwhile."""

    store: Store
    seq: int
    writable = False

    @property
    def read_sequence(self) -> int:
        return self.seq

    def snapshot(self, family: str = "cells") -> DataFrame:
        return self.store.snapshot(family, self.seq)

    def get_cell(self, q: int, r: int) -> dict | None:
        found = self.snapshot().filter(F.col("key") == pack_one(q, r)).first()
        return found.asDict() if found else None

    def get_seam(self, name: str) -> dict | None:
        found = self.snapshot("seams").filter(F.col("id") == name).first()
        return found.asDict() if found else None

    def get_embedding(self, q: int, r: int) -> list[float] | None:
        """The vector now stored; vectors have no history. None before the first vector."""
        return self.store.get_embedding(q, r)


@dataclass
class Tx:
    """Writes of one commit; they are seen by get_cell and get_seam here, and by others once committed."""

    store: Store
    seq: int
    rows: dict[str, list[dict]] = field(default_factory=dict)
    bulk: list[tuple[int, DataFrame]] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)
    records: int = 0
    deferred: bool = False

    @property
    def read_sequence(self) -> int:
        return self.seq - 1

    writable = True

    def _add(self, family: str, row: dict) -> None:
        self.rows.setdefault(family, []).append(row | {"_n": self.records})

    def _note(self, op: int, q: int | None, r: int | None, payload: str | None, name: str | None = None) -> None:
        self.log.append((self.records, op, q, r, None if q is None else pack_one(q, r), name, payload))
        self.records += 1

    def put_cell(self, q: int, r: int, raw_content: str, source_id: str = "", confidence: float = 1.0, tags: tuple[str, ...] = (), valid_from: int | None = None, valid_to: int | None = None, hint: Coord | None = None, now_ns: int | None = None) -> None:
        now = now_ns if now_ns is not None else time.time_ns()
        row = {"q": q, "r": r, "key": pack_one(q, r), "deleted": False, "raw_content": raw_content, "source_id": source_id, "confidence": float(confidence), "created_at": now, "updated_at": now, "valid_from": valid_from, "valid_to": valid_to, "tags": list(tags), "hint_q": hint and hint[0], "hint_r": hint and hint[1]}
        reason = self.store.refuses(row)
        if reason:
            raise E.RejectedCell(reason)
        self._add("cells", row)
        self._note(PUT_CELL, q, r, raw_content)
        if self.store.after_put_cell:
            self.store.after_put_cell(row)

    def put_cells(self, cells: DataFrame) -> None:
        """Many cells of one commit, from a table with at least q, r and raw_content, in the order of its rows.

        Each is held to the same rules as a single put, the store's validator included; the changefeed gets a record of
        each, and hooks are told of each in turn. Rows aren't gathered on the driver: a hook's are streamed past it.
        """
        staged, n = self.store.staged(cells)
        self.bulk.append((self.records, staged))
        self.records += n

    def get_cell(self, q: int, r: int) -> dict | None:
        for row in reversed(self.rows.get("cells", [])):
            if (row["q"], row["r"]) == (q, r):
                return None if row["deleted"] else row
        found = self.store.snapshot("cells").filter(F.col("key") == pack_one(q, r)).first()
        return found.asDict() if found else None

    def delete_cell(self, q: int, r: int) -> bool:
        """Whether there was a cell. Its facets, outgoing edges and vector go too; seams and edges to it stay."""
        if self.get_cell(q, r) is None:
            return False
        key = pack_one(q, r)
        self._add("cells", {"q": q, "r": r, "key": key, "deleted": True})
        for f in self.store.snapshot("facets").filter(F.col("key") == key).collect():
            self._add("facets", {"q": q, "r": r, "key": key, "facet_id": f.facet_id, "deleted": True})
        for e in self.store.current("edges").filter(F.col("from_key") == key).collect():
            self._add("edges", {**e.asDict(), "deleted": True})
        self._add("vectors", {"q": q, "r": r, "key": key, "deleted": True})
        self._note(DELETE_CELL, q, r, None)
        return True

    def put_facet(self, q: int, r: int, facet_id: int, derived_content: str, last_rotated: int = 0, derivation_hash: str = "0" * 64) -> None:
        if not 0 <= facet_id <= 5:
            raise E.InvalidArgument("a facet has a number from 0 to 5")
        self._add("facets", {"q": q, "r": r, "key": pack_one(q, r), "facet_id": facet_id, "deleted": False, "derived_content": derived_content, "last_rotated": last_rotated, "derivation_hash": derivation_hash})
        self._note(PUT_FACET, q, r, derived_content)

    def update_facet(self, q: int, r: int, facet_id: int, derived_content: str, derivation_hash: str, last_rotated: int = 0) -> None:
        import hashlib

        cell = self.get_cell(q, r)
        if cell is None:
            raise E.CellNotFound((q, r))
        if hashlib.sha256(cell["raw_content"].encode()).hexdigest() != derivation_hash:
            raise E.DerivationMismatch((q, r))
        self.put_facet(q, r, facet_id, derived_content, last_rotated, derivation_hash)

    def link_cells(self, start: Coord, end: Coord, relation: str, weight: float = 1.0, source_id: str = "", confidence: float = 1.0) -> None:
        """An edge between two coordinates, with cells or without."""
        if not relation:
            raise E.InvalidArgument("an edge has a relation")
        if weight != weight or abs(weight) == float("inf"):
            raise E.InvalidArgument("a weight is finite")
        now = time.time_ns()
        self._add("edges", {"from_q": start[0], "from_r": start[1], "from_key": pack_one(*start), "to_q": end[0], "to_r": end[1], "to_key": pack_one(*end), "relation": relation, "deleted": False, "weight": float(weight), "source_id": source_id, "confidence": confidence, "created_at": now, "updated_at": now})
        self._note(PUT_EDGE, *start, relation)

    put_edge = link_cells

    def get_seam(self, name: str) -> dict | None:
        for row in reversed(self.rows.get("seams", [])):
            if row["id"] == name:
                return row
        found = self.store.snapshot("seams").filter(F.col("id") == name).first()
        return found.asDict() if found else None

    def put_seam(self, name: str, a: Coord, b: Coord, seam_type: str, reason: str = "", op: int = PUT_SEAM, **more) -> None:
        old = self.get_seam(name)
        if old and {(old["a_q"], old["a_r"]), (old["b_q"], old["b_r"])} != {tuple(a), tuple(b)}:
            raise E.SeamConflict(name)
        now = time.time_ns()
        row = {"id": name, "deleted": False, "a_q": a[0], "a_r": a[1], "a_key": pack_one(*a), "b_q": b[0], "b_r": b[1], "b_key": pack_one(*b), "seam_type": seam_type, "reason": reason, "confidence_delta": 0.0, "detected_at": now, "resolution_status": "", "resolution_note": "", "source_id": "", "confidence": 1.0, "created_at": now, "updated_at": now} | more
        self._add("seams", row)
        self._note(op, None, None, None, name)
        if self.store.after_put_seam:
            self.store.after_put_seam(row)

    def mark_conflict(self, a: Coord, b: Coord, reason: str) -> str:
        low, high = sorted((a, b), key=lambda c: pack_one(*c))
        name = f"{time.time_ns():020d}{len(self.log):06d}"
        self.put_seam(name, low, high, "mark_conflict", reason)
        return name

    def mark_supersedes(self, new: Coord, old: Coord, reason: str) -> str:
        name = f"{time.time_ns():020d}{len(self.log):06d}"
        self.put_seam(name, old, new, "supersedes", reason)
        return name

    def resolve_seam(self, name: str, status: str, note: str = "") -> None:
        old = self.get_seam(name)
        if old is None:
            raise E.SeamNotFound(name)
        keep = {k: v for k, v in old.items() if k in ("confidence_delta", "detected_at", "valid_from", "valid_to", "source_id", "confidence", "created_at")}
        self.put_seam(name, (old["a_q"], old["a_r"]), (old["b_q"], old["b_r"]), old["seam_type"], old["reason"], RESOLVE_SEAM, **keep, resolution_status=status, resolution_note=note)

    def get_embedding(self, q: int, r: int) -> list[float] | None:
        """The vector as this commit leaves it so far."""
        for row in reversed(self.rows.get("vectors", [])):
            if (row["q"], row["r"]) == (q, r):
                return row.get("embedding")
        return self.store.get_embedding(q, r)

    def put_embedding(self, q: int, r: int, vector: list[float], deferred: bool = False) -> None:
        """The first vector sets how long all are. ``deferred`` leaves the index dirty until it is rebuilt."""
        self.deferred |= deferred
        dim = self.store.meta.get("dim") or next((len(x["embedding"]) for x in self.rows.get("vectors", []) if x.get("embedding")), 0)
        if not vector or any(x != x or abs(x) == float("inf") for x in vector):
            raise E.InvalidArgument("a vector has one or more finite numbers")
        if dim and dim != len(vector):
            raise E.DimensionMismatch(f"{len(vector)} numbers, not {dim}")
        self._add("vectors", {"q": q, "r": r, "key": pack_one(q, r), "deleted": False, "embedding": [float(x) for x in vector]})

    def delete_embedding(self, q: int, r: int) -> None:
        self._add("vectors", {"q": q, "r": r, "key": pack_one(q, r), "deleted": True})

    def put(self, key: bytes, value: bytes) -> None:
        if key.startswith(tuple(x.encode() for x in RESERVED)):
            raise E.InvalidArgument("the key belongs to a record family")
        self._add("kv", {"k": key, "deleted": False, "v": value})


class Store:
    """A folder of versioned tables; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True, max_value_bytes: int = MAX_VALUE_BYTES, validator: Callable[[dict], str | None] | None = None, after_put_cell: Callable | None = None, after_put_seam: Callable | None = None, metric: str = "cosine"):
        if metric not in METRICS:
            raise E.InvalidArgument(f"no such metric: {metric}")
        self.spark, self.path, self.max_value_bytes = spark, path.rstrip("/"), max_value_bytes
        self.validator, self.after_put_cell, self.after_put_seam = validator, after_put_cell, after_put_seam
        self._index = None
        if not self._versions():
            if not create:
                raise E.InvalidArgument(f"no store at {path}")
            self._publish({"head": 0, "floor": 0, "dim": 0, "metric": metric, "vectors": 0, "dirty": False, "records": 0, "families": {}, "pruned": [], "commits": [], "tags": {}, "consumers": {}, "version": 0})

    # Files ---------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifest")
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []

    @property
    def meta(self) -> dict:
        fs, at = self._fs(f"{self.path}/manifest/{self._versions()[-1]}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, meta: dict) -> None:
        fs, temp = self._fs(f"{self.path}/manifest/.{meta['version']}-{time.time_ns()}")
        out = fs.create(temp)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        final = self._fs(f"{self.path}/manifest/{meta['version']}.json")[1]
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise E.CursorConflict("another writer has committed")

    def _change(self, **changes) -> None:
        meta = self.meta
        self._publish(meta | changes | {"version": meta["version"] + 1})

    # Reading -------------------------------------------------------------------------------------------------------

    def versions(self, family: str, seq: int | None = None) -> DataFrame:
        """All retained rows of a family up to ``seq``, or the head, with commit_seq."""
        rows = self._stored(family, seq)
        pruned = self.meta.get("pruned") if family == "cells" else None
        if not pruned:
            return rows
        gone = self.spark.read.schema(PRUNED).parquet(*[self._folder("pruned", part) for part in pruned])
        return rows.join(gone, ["key", "commit_seq"], "left_anti").select(*rows.columns)

    def _folder(self, family: str, part: int | list) -> str:
        """A commit's files; those of a store that this one was forked from are named with its path."""
        path, number = part if isinstance(part, list) else (self.path, part)
        return f"{path}/{family}/commit={number}"

    def _stored(self, family: str, seq: int | None = None) -> DataFrame:
        """The rows in a family's files; cells that are pruned but not yet compacted are among them."""
        meta = self.meta
        last = meta["head"] if seq is None else snapshot.check_seq(seq, meta["head"], meta["floor"])
        schema = f"{SCHEMAS[family]}, commit_seq long"
        commits = [c for c in meta["families"].get(family, []) if (c[1] if isinstance(c, list) else c) <= last]
        if not commits:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[self._folder(family, c) for c in commits])
        return rows.filter(F.col("commit_seq") <= last)

    def snapshot(self, family: str, seq: int | None = None) -> DataFrame:
        if family in CURRENT_ONLY and seq is not None and seq != self.meta["head"]:
            raise E.HistoricalDataUnavailable(family)
        # What is pruned has a successor at or before the floor, so no snapshot shows it.
        return snapshot.snapshot(self._stored(family, seq), identity=IDENTITY[family])

    def current(self, family: str) -> DataFrame:
        return self.snapshot(family)

    def view(self, family: str = "cells") -> DataFrame:
        return self.snapshot(family)

    view_at = snapshot

    def view_at_time(self, wall_ns: int, family: str = "cells") -> DataFrame:
        commits = [(w, s) for s, w in self.meta["commits"] if w <= wall_ns]
        return self.snapshot(family, max(commits)[1] if commits else 0)

    def view_at_tag(self, label: str, family: str = "cells") -> DataFrame:
        tags = self.meta["tags"]
        if label not in tags:
            raise E.UnknownSnapshotTag(label)
        return self.snapshot(family, tags[label])

    def get(self, key: bytes) -> bytes | None:
        row = self.current("kv").filter(F.col("k") == F.lit(key)).first()
        return bytes(row.v) if row else None

    def range(self, low: bytes | None, high: bytes) -> DataFrame:
        """Raw pairs by key, both ends included; None is the start."""
        rows = self.current("kv").filter(F.col("k") <= F.lit(high))
        return (rows if low is None else rows.filter(F.col("k") >= F.lit(low))).orderBy("k")

    # Writing -------------------------------------------------------------------------------------------------------

    def refuses(self, row: dict) -> str | None:
        conf = row["confidence"]
        if conf != conf or abs(conf) == float("inf"):
            return "confidence isn't finite"
        if len(row["source_id"].strip().encode()) > MAX_TEXT_KEY or any(len(t.strip().encode()) > MAX_TEXT_KEY for t in row["tags"]):
            return "source or tag too long"
        if len(row["raw_content"].encode()) > self.max_value_bytes:
            return "content too long"
        return self.validator(row) if self.validator else None

    @contextmanager
    def update(self):
        """A commit: all that is written in the block is published at once when it ends, and nothing if it raises."""
        meta = self.meta
        tx = Tx(self, meta["head"] + 1)
        try:
            yield tx
            self._commit(meta, tx)
        finally:
            self._drop_staged(x for _, x in tx.bulk)

    @contextmanager
    def read(self):
        """Reads of the head as it is now."""
        yield ReadTx(self, self.meta["head"])

    def _drop_staged(self, frames: Iterable[DataFrame]) -> None:
        for frame in frames:
            for file in frame.inputFiles()[:1]:
                fs, at = self._fs(file.rsplit("/", 1)[0])
                fs.delete(at, True)

    def staged(self, cells: DataFrame, order: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
        """Cells as they are to be stored, written once, with ``nth``, their number from 0 in the order given or that of the rows; and how many there are.

        A row is numbered within its task as it is written, and the tasks' counts, one row each, say where each begins.
        """
        rows = cells.orderBy(*order) if order else cells
        schema = f"{SCHEMAS['cells']}, _at long"
        first = f"{self.path}/staged/{uuid.uuid4().hex}"
        as_cells(rows, time.time_ns()).withColumn("_at", F.monotonically_increasing_id()).write.parquet(first)
        written = self.spark.read.schema(schema).parquet(first)
        bad = written.select(invalid_cells(written, self.max_value_bytes).alias("why")).filter("why is not null").limit(1).collect()
        if not bad and self.validator:
            validator = self.validator

            def refused(frames):
                for f in frames:
                    why = [validator(row) for row in f.to_dict("records")]
                    yield f.assign(why=why)[["why"]]

            bad = written.drop("_at").mapInPandas(refused, "why string").filter("why is not null").limit(1).collect()
        if bad:
            self._drop_staged([written])
            raise E.RejectedCell(bad[0].why)
        sizes = written.groupBy(F.shiftright("_at", 33).alias("task")).count().orderBy("task").collect()
        starts, n = {}, 0
        for task, size in sizes:
            starts[task], n = n, n + size
        base = self.spark.createDataFrame([*starts.items()], "task long, base long")
        place = F.col("base") + F.col("_at").bitwiseAND((1 << 33) - 1)
        numbered = written.withColumn("task", F.shiftright("_at", 33)).join(F.broadcast(base), "task").withColumn("nth", place).drop("task", "base", "_at")
        second = f"{self.path}/staged/{uuid.uuid4().hex}"
        numbered.write.parquet(second)
        self._drop_staged([written])
        out = self.spark.read.schema(f"{SCHEMAS['cells']}, nth long").parquet(second)
        if self.after_put_cell:
            for row in out.drop("nth").toLocalIterator():
                self.after_put_cell(row.asDict())
        return out, n

    def import_cells(self, cells: DataFrame, order: tuple[str, ...] = (), chunk: int = BATCH) -> int:
        """Cells of a table in commits of ``chunk`` each, in order; how many. All commits are written at once and published together."""
        meta = self.meta
        staged, n = self.staged(cells, order)
        try:
            if n:
                head, wall = meta["head"], max(time.time_ns(), (meta["commits"][-1][1] + 1) if meta["commits"] else 0)
                numbered = batch_commits(staged, "nth", head, chunk)
                names = [x.split()[0] for x in SCHEMAS["cells"].split(", ")]
                last = numbered.groupBy("key", "commit_seq").agg(F.max_by(F.struct(*names), "nth").alias("row")).select("row.*", "commit_seq")
                last.write.mode("overwrite").parquet(f"{self.path}/cells/commit={head + 1}")
                feed = feed_of_puts(numbered, F.col("nth") + meta["records"] + 1, F.lit(wall - head - 1) + F.col("commit_seq"))
                feed = feed.withColumn("commit_seq", F.col("wall_ns") - (wall - head - 1))
                feed.write.mode("overwrite").parquet(f"{self.path}/changelog/commit={head + 1}")
                families = {k: list(v) for k, v in meta["families"].items()}
                for family in ("cells", "changelog"):
                    families.setdefault(family, []).append(head + 1)
                commits = [[head + 1 + i, wall + i] for i in range(-(-n // chunk))]
                self._publish(meta | {"head": commits[-1][0], "records": meta["records"] + n, "families": families, "commits": meta["commits"] + commits, "version": meta["version"] + 1})
        finally:
            self._drop_staged([staged])
        return n

    def _commit(self, meta: dict, tx: Tx) -> None:
        if not (tx.rows or tx.bulk):
            return
        wall = max(time.time_ns(), (meta["commits"][-1][1] + 1) if meta["commits"] else 0)
        for i, op, q, r, key, name, payload in tx.log:
            import hashlib

            raw = (payload or "").encode()
            has = op not in (DELETE_CELL,) and payload is not None
            tx._add("changelog", {"seq": meta["records"] + 1 + i, "wall_ns": wall, "op": op, "q": q, "r": r, "key": key, "id": name, "payload": payload if has and len(raw) <= INLINE else None, "hash": hashlib.sha256(raw).hexdigest() if has else None, "encoded_len": len(raw)})
        families, dim = {k: list(v) for k, v in meta["families"].items()}, meta["dim"]
        for family in {*tx.rows, *(("cells", "changelog") if tx.bulk else ())}:
            schema = SCHEMAS[family]
            names = [x.split()[0] for x in schema.split(", ")]
            own = tx.rows.get(family, [])
            last = list({tuple(row.get(c) for c in IDENTITY[family]): row for row in own}.values()) if family in IDENTITY else own
            out = self.spark.createDataFrame([(*(row.get(n) for n in names), row["_n"]) for row in last], f"{schema}, _n long")
            if family == "vectors":
                dim = dim or next((len(x["embedding"]) for x in own if x.get("embedding")), 0)
            for start, staged in tx.bulk:
                if family == "cells":
                    out = out.unionByName(staged.withColumn("_n", F.col("nth") + start).drop("nth"))
                elif family == "changelog":
                    out = out.unionByName(feed_of_puts(staged, F.col("nth") + start + meta["records"] + 1, F.lit(wall)).withColumn("_n", F.lit(0).cast("long")))
            if tx.bulk and family == "cells":  # of a cell that is put several times the last put counts
                out = out.groupBy("key").agg(F.max_by(F.struct(*names), "_n").alias("row")).select("row.*")
            else:
                out = out.drop("_n")
            if "deleted" in names:
                out = out.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
            out.withColumn("commit_seq", F.lit(tx.seq).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{family}/commit={tx.seq}")
            families.setdefault(family, []).append(tx.seq)
        vectors = meta["vectors"] + ("vectors" in tx.rows)
        self._publish(meta | {"head": tx.seq, "dim": dim, "vectors": vectors, "dirty": meta["dirty"] or tx.deferred, "records": meta["records"] + tx.records, "families": families, "commits": [*meta["commits"], [tx.seq, wall]], "version": meta["version"] + 1})

    def batch_put_cells(self, cells: list[dict], continue_on_error: bool = False) -> tuple[int, list[tuple[int, str]]]:
        """Cells in commits of 128; the number stored, and what was refused before it was written."""
        stored, refused = 0, []
        for start in range(0, len(cells), BATCH):
            with self.update() as tx:
                for i, cell in enumerate(cells[start : start + BATCH], start):
                    try:
                        tx.put_cell(**cell)
                        stored += 1
                    except (E.RejectedCell, E.InvalidArgument) as error:
                        if not continue_on_error:
                            raise
                        refused.append((i, str(error)))
        return stored, refused

    def find_free(self, anchor: Coord, radius: int) -> DataFrame:
        return find_free(self.view(), anchor, radius)

    def find_unused(self, anchor: Coord, radius: int) -> DataFrame:
        return find_unused(self.versions("cells"), anchor, radius)

    # Snapshots and maintenance -------------------------------------------------------------------------------------

    def tag_snapshot(self, label: str) -> None:
        if not label or len(label.encode()) > MAX_LABEL:
            raise E.InvalidArgument("a label has 1 to 200 bytes")
        meta = self.meta
        self._change(tags=meta["tags"] | {label: meta["head"]})

    def list_snapshot_tags(self) -> list[tuple[str, int]]:
        return sorted(self.meta["tags"].items())

    def delete_snapshot_tag(self, label: str) -> None:
        tags = self.meta["tags"]
        if label not in tags:
            raise E.UnknownSnapshotTag(label)
        self._change(tags={k: v for k, v in tags.items() if k != label})

    def oldest_snapshot_seq(self) -> int:
        return self.meta["floor"]

    def stats(self) -> DataFrame:
        return snapshot.stats(self.versions("cells"))

    def diff(self, low: int, high: int) -> DataFrame:
        return snapshot.diff(self.versions("cells"), self.versions("seams"), low, high, self.meta["head"])

    def prune(self, before: int, most: int | None) -> int:
        """Versions deleted, at most ``most`` or, for None, all there are; the floor moves up with the first of them.

        A pass reads keys and sequences and writes those of the deleted versions; their rows go at the next ``compact``.
        """
        meta = self.meta
        before = min(before, meta["head"])
        gone = snapshot.prunable(self.versions("cells").select("key", "commit_seq"), before)
        if most is not None:
            gone = gone.orderBy("key", "commit_seq").limit(most)
        number = -(meta["version"] + 1)
        at = self._folder("pruned", number)
        gone.write.mode("overwrite").parquet(at)
        n = self.spark.read.schema(PRUNED).parquet(at).count()
        if n:
            self._change(floor=max(meta["floor"], before), pruned=[*meta.get("pruned", []), number])
        return n

    def prune_by_profile(self, retain: int, profile: str = "balanced") -> int:
        """One pass that keeps ``retain`` commits of history, with the profile's most versions; nothing if ``retain`` says nothing."""
        plan = snapshot.prune_plan(self.meta["head"], retain, profile)
        return 0 if plan is None else self.prune(*plan)

    def compact(self, parts: int = 1) -> None:
        """Each family's files as one folder, all retained versions and deletions kept; rows of pruned versions go."""
        meta = self.meta
        families = {}
        for family in meta["families"]:
            number = -(meta["version"] + 1)
            self.versions(family).repartition(parts).sortWithinPartitions("commit_seq").write.mode("overwrite").parquet(f"{self.path}/{family}/commit={number}")
            families[family] = [number]
        self._change(families=families, pruned=[])

    def copy_to(self, path: str) -> Store:
        """A consistent copy of what is committed now."""
        meta = self.meta
        for family in meta["families"]:
            self.versions(family).write.parquet(f"{path}/{family}/commit=-1")
        other = Store(self.spark, path)
        other._publish(meta | {"families": {f: [-1] for f in meta["families"]}, "pruned": [], "version": 1})
        return other

    def fork(self, path: str) -> Store:
        """A store of its own that begins with what is committed now: it reads the files here, which stay as they are, and writes its own."""
        meta = self.meta

        def named(parts: list) -> list:
            return [x if isinstance(x, list) else [self.path, x] for x in parts]

        other = Store(self.spark, path)
        other._publish(meta | {"families": {f: named(v) for f, v in meta["families"].items()}, "pruned": named(meta.get("pruned", [])), "version": 1})
        return other

    # Changefeed ----------------------------------------------------------------------------------------------------

    def changelog(self) -> DataFrame:
        """All records; seq counts them from 1 over all commits, without gaps."""
        return self.versions("changelog")

    def advance_consumer(self, name: str, expected: int, then: int) -> None:
        """Compare and set; 0 to 0 registers, an equal advance changes nothing."""
        if not name or len(name) > 128 or not name.isascii():
            raise E.InvalidArgument("a consumer has a name of 1 to 128 ASCII characters")
        meta = self.meta
        now = meta["consumers"].get(name)
        head = meta["records"]
        if (now or 0) != expected or now is None and expected:
            raise E.CursorConflict(f"{name} is at {now}")
        if then < expected:
            raise E.CursorConflict(f"{name} would go back")
        if then > head:
            raise E.CursorConflict(f"{name} would pass the head")
        if now != then:
            self._change(consumers=meta["consumers"] | {name: then})

    def consumer(self, name: str) -> int | None:
        return self.meta["consumers"].get(name)

    def consumers(self) -> list[tuple[str, int]]:
        return sorted(self.meta["consumers"].items())

    def retention_floor(self) -> int | None:
        return min(self.meta["consumers"].values(), default=None)

    def delete_consumer(self, name: str, expected: int) -> None:
        if self.meta["consumers"].get(name) != expected:
            raise E.CursorConflict(name)
        self._change(consumers={k: v for k, v in self.meta["consumers"].items() if k != name})

    def reset_changelog(self) -> None:
        """Forget the feed and every consumer."""
        self._change(consumers={}, families={k: v for k, v in self.meta["families"].items() if k != "changelog"})

    def has_changefeed(self) -> bool:
        meta = self.meta
        return bool(meta["consumers"]) or bool(meta["families"].get("changelog"))

    # Vectors -------------------------------------------------------------------------------------------------------

    def dimension(self) -> int:
        return self.meta["dim"]

    def metric(self) -> str:
        return self.meta["metric"]

    def get_embedding(self, q: int, r: int) -> list[float] | None:
        """The vector now stored at a coordinate; None if there is none, or no vector at all."""
        if not self.dimension():
            return None
        row = self.current("vectors").filter(F.col("key") == pack_one(q, r)).select("embedding").first()
        return None if row is None else list(row.embedding)

    def index_state(self) -> dict:
        """Which revision of the vectors is stored and indexed, and whether deferred writes wait for a rebuild."""
        meta = self.meta
        return {"revision": meta["vectors"], "indexed": self._index and self._index.revision, "dirty": meta["dirty"]}

    def rebuild_embedding_index(self, most: int = vector.REBUILD_DEFAULT) -> vector.InvertedIndex:
        """An index over all vectors, at most ``most`` of them; published only if no vector has been written meanwhile."""
        revision, rows = self.meta["vectors"], self.current("vectors")
        vector.check_rebuild(rows.count(), most)
        built = vector.build_index(rows, revision, metric=self.metric())
        self._index = vector.publish_index(built, self.meta["vectors"])
        if self.meta["dirty"]:
            self._change(dirty=False)
        return self._index

    def search_by_embedding(self, query: list[float], k: int = 10, min_score: float = 0.0, effort: int = 0) -> tuple[DataFrame, dict]:
        """The most similar vectors, and by which path: the index if it is that of the vectors as they are, else all of them."""
        state = self.index_state()
        index = self._index if state["indexed"] == state["revision"] and not state["dirty"] else None
        return vector.search_with_stats(self.current("vectors"), query, k, min_score, self.metric(), index, effort)

    def storage(self) -> dict[str, int]:
        """Bytes of each family's files."""
        out = {}
        for family, commits in self.meta["families"].items():
            fs, _ = self._fs(self.path)
            out[family] = sum(fs.getContentSummary(self._fs(self._folder(family, c))[1]).getLength() for c in commits)
        return out
