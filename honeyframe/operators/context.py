"""Neighbourhoods: bounded packs of cells around one or more seeds, by rings or along edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from honeyframe.errors import CellNotFound, InvalidArgument, ScanLimit
from honeyframe.functions.geometry import Coord, check_radius, disk_size, distance, near, pack_one, spiral
from honeyframe.functions.scalars import valid_at
from honeyframe.operators import graph, seams as seam_ops

DEFAULT_RING, DEFAULT_CELLS, DEFAULT_HOPS = 5, 256, 5
MAX_RING, MAX_SEEDS, MAX_CELLS, MAX_HOPS, MAX_WORK = 128, 32, 10_000, 128, 200_000


@dataclass(frozen=True)
class AssembleOptions:
    """What is attached to a cell; an options value with nothing set means the default, facets only."""

    facets: bool = True
    edges: bool = False
    seams: bool = False
    seam_radius: int = 1


@dataclass(frozen=True)
class ContextConfig:
    """Zeros mean the defaults: 5 rings, 256 cells, 5 hops."""

    seeds: tuple[Coord, ...]
    max_ring: int = 0
    max_cells: int = 0
    max_hops: int = 0
    edge_filter: str | None = None
    as_of: int | None = None
    filter_superseded: bool = False
    include_seams: bool = False
    seam_radius: int = 0

    def normal(self) -> ContextConfig:
        ring, cells, hops = self.max_ring if self.max_ring > 0 else DEFAULT_RING, self.max_cells if self.max_cells > 0 else DEFAULT_CELLS, self.max_hops if self.max_hops > 0 else DEFAULT_HOPS
        if not self.seeds or len(self.seeds) > MAX_SEEDS or ring > MAX_RING or cells > MAX_CELLS or hops > MAX_HOPS or self.seam_radius < 0:
            raise InvalidArgument("a bound of the context is exceeded")
        if sum(disk_size(ring) for _ in self.seeds) > MAX_WORK and self.edge_filter is None:
            raise ScanLimit("the seeds' disks hold too many coordinates")
        for s in self.seeds:
            check_radius(s, ring if self.edge_filter is None else 0)
        return ContextConfig(self.seeds, ring, cells, hops, self.edge_filter, self.as_of, self.filter_superseded, self.include_seams, self.seam_radius)


@dataclass
class ContextPack:
    """cells in order; explanations and seams in theirs; stats in one row. Nothing runs before it is asked for."""

    cells: DataFrame
    explanations: DataFrame
    seams: DataFrame | None
    stats: DataFrame


def _candidates(snap: DataFrame, cfg: ContextConfig, chains: DataFrame | None) -> DataFrame:
    """Per seed: places of its disk that lead to a live, valid cell, as (seed_idx, place, ring, from_q, from_r, key)."""
    seeds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("sq"), F.lit(r).alias("sr")) for i, (q, r) in enumerate(cfg.seeds)]))
    any_near = F.lit(False)
    for s in cfg.seeds:
        any_near = any_near | near("q", "r", s, cfg.max_ring)
    live = snap if cfg.as_of is None else snap.filter(valid_at(cfg.as_of))
    if chains is None:
        starts = live.filter(any_near).select("q", "r", F.col("key").alias("target"), F.lit(False).alias("superseded"))
    else:
        own = chains.filter(any_near).select("q", "r", "key", F.col("target_key").alias("target"))
        starts = snap.filter(any_near).select("q", "r", F.col("key").alias("target")).join(own.select(F.col("key").alias("target")), "target", "left_anti").select("q", "r", "target", F.lit(False).alias("superseded"))
        starts = starts.unionByName(own.select("q", "r", "target", F.lit(True).alias("superseded")))
    rows = starts.withColumn("s", seeds).filter(distance("q", "r", F.col("s.sq"), F.col("s.sr")) <= cfg.max_ring)
    rows = rows.select(F.col("s.i").alias("seed_idx"), spiral("q", "r", (F.col("s.sq"), F.col("s.sr"))).alias("place"), distance("q", "r", F.col("s.sq"), F.col("s.sr")).alias("ring"), F.col("q").alias("from_q"), F.col("r").alias("from_r"), F.col("target").alias("key"), "superseded")
    if chains is not None:  # the end of a chain may lie anywhere, and must be valid itself
        found = rows.join(live.select("key", F.lit(True).alias("ok")), "key", "left")
        rows = found.withColumn("ok", F.coalesce("ok", F.lit(False)))
    else:
        rows = rows.withColumn("ok", F.lit(True))
    return rows


def load_context(snap: DataFrame, cfg: ContextConfig, seams: DataFrame | None = None, edges: DataFrame | None = None) -> ContextPack:
    """Cells around the seeds.

    Rings: each seed's disk in spiral order, at most max_cells of it; several seeds take turns, and a cell comes once. With
    an edge filter: a breadth-first walk from each seed in turn instead. ``filter_superseded`` puts the end of its chain
    in a superseded cell's place, or leaves it out. ``as_of`` asks for cells valid then.
    """
    cfg = cfg.normal()
    chains = seam_ops.resolve_supersession(snap, seams) if cfg.filter_superseded else None
    if cfg.edge_filter is not None:
        rows = _walked(snap, cfg, edges, chains)
    else:
        rows = _candidates(snap, cfg, chains)
    per_seed = F.min(F.struct("place", "ring", "from_q", "from_r", "superseded")).alias("m")
    firsts = rows.filter("ok").groupBy("seed_idx", "key").agg(per_seed).select("seed_idx", "key", "m.*")
    rank = F.row_number().over(Window.partitionBy("seed_idx").orderBy("place"))
    firsts = firsts.withColumn("rank", rank).filter(F.col("rank") <= cfg.max_cells)  # per seed at most its disk
    order = F.struct("seed_idx", "rank") if cfg.edge_filter is not None else F.struct("rank", "seed_idx")
    merged = firsts.groupBy("key").agg(F.min(F.struct(order.alias("o"), "ring", "from_q", "from_r", "superseded", "place", "seed_idx")).alias("m"))
    merged = merged.select("key", "m.*").orderBy("o").limit(cfg.max_cells)
    cells = merged.join(snap.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k")
    for c in ("q", "r"):
        cells = cells.withColumn(f"superseded_from_{c}", F.when(F.col("superseded"), F.col(f"from_{c}")))
    cells = cells.drop("from_q", "from_r", "superseded", "place").orderBy("o")
    stats = _stats(snap, cfg, rows, firsts, merged)
    gone = rows.filter("superseded").select("ring", F.col("from_q").alias("q"), F.col("from_r").alias("r"), F.lit("superseded").alias("reason"), F.when(F.col("ok"), F.col("key")).alias("superseded_by"), F.struct(F.lit(0).alias("first"), F.col("seed_idx").cast("long").alias("a"), F.col("place").cast("long").alias("b")).alias("o"))
    kept = cells.select("ring", "q", "r", F.lit("included").alias("reason"), F.lit(None).cast("long").alias("superseded_by"), F.struct(F.lit(1).alias("first"), F.col("o")[order_name(cfg, 0)].cast("long").alias("a"), F.col("o")[order_name(cfg, 1)].cast("long").alias("b")).alias("o"))
    explanations = gone.unionByName(kept).orderBy("o").drop("o")
    found = None
    if cfg.include_seams and seams is not None:
        radius = cfg.seam_radius or cfg.max_ring
        for i, s in enumerate(cfg.seeds):
            part = seam_ops.find_seams(seams, s, radius).withColumn("seed_idx", F.lit(i))
            found = part if found is None else found.unionByName(part)
        columns = found.columns
        found = found.groupBy("id").agg(F.min(F.struct("seed_idx", "place", *[c for c in columns if c not in ("id", "seed_idx", "place")])).alias("m")).select("id", "m.*").orderBy("seed_idx", "place", "id")
    return ContextPack(cells.drop("o"), explanations, found, stats)


def order_name(cfg: ContextConfig, i: int) -> str:
    names = ("seed_idx", "rank") if cfg.edge_filter is not None else ("rank", "seed_idx")
    return names[i]


def _stats(snap: DataFrame, cfg: ContextConfig, rows: DataFrame, firsts: DataFrame, merged: DataFrame) -> DataFrame:
    """candidates_scanned, result_limit_reached, max_ring_used; nulls and false if no cell was found.

    A seed scans its disk up to the cell that fills the pack, empty coordinates too.
    """
    per = firsts.groupBy("seed_idx").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.max("ring").alias("ring"))
    whole = disk_size(cfg.max_ring)
    if cfg.edge_filter is None:
        scanned = F.when(F.col("n") >= cfg.max_cells, F.col("last") + 1).otherwise(whole)
        per = per.select(scanned.cast("long").alias("scanned"), "ring")
        total = per.agg(F.sum("scanned").alias("candidates_scanned"), F.max("ring").alias("max_ring_used"))
    else:
        total = rows.agg(F.count("*").alias("candidates_scanned")).crossJoin(per.agg(F.max("ring").alias("max_ring_used")))
    return total.crossJoin(merged.agg((F.count("*") >= cfg.max_cells).alias("result_limit_reached")))


def _walked(snap: DataFrame, cfg: ContextConfig, edges: DataFrame, chains: DataFrame | None) -> DataFrame:
    parts = None
    for i, s in enumerate(cfg.seeds):
        reached = graph.walk(edges, s, cfg.edge_filter or "", cfg.max_hops, 0)
        if reached.limit(MAX_WORK + 1).count() > MAX_WORK:
            raise ScanLimit("a walk holds too many coordinates")
        place = F.row_number().over(Window.orderBy("level", "path"))  # a walk is bounded by hops and work
        part = reached.withColumn("place", place.cast("long")).select(F.lit(i).alias("seed_idx"), "place", F.col("q").alias("from_q"), F.col("r").alias("from_r"), "key")
        parts = part if parts is None else parts.unionByName(part)
    if parts.limit(MAX_WORK + 1).count() > MAX_WORK:
        raise ScanLimit("the walks hold too many coordinates")
    nearest = F.least(*[distance("from_q", "from_r", *s) for s in cfg.seeds], F.lit(1 << 30))
    parts = parts.withColumn("ring", nearest).withColumn("superseded", F.lit(False))
    if chains is not None:
        ends = chains.select("key", "target_key", F.lit(True).alias("has"))
        parts = parts.join(ends, "key", "left").withColumn("superseded", F.coalesce("has", F.lit(False))).withColumn("key", F.when(F.col("has"), F.col("target_key")).otherwise(F.col("key"))).drop("target_key", "has")
    live = (snap if cfg.as_of is None else snap.filter(valid_at(cfg.as_of))).select("key", F.lit(True).alias("ok"))
    return parts.join(live, "key", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def assemble_cells(snap: DataFrame, options: AssembleOptions = AssembleOptions(), as_of: int | None = None, facets: DataFrame | None = None, edges: DataFrame | None = None, seams: DataFrame | None = None) -> DataFrame:
    """Every cell of ``snap`` with its facets, edges and seams as arrays; validity is asked of cells only. For one cell filter first."""
    out = snap if as_of is None else snap.filter(valid_at(as_of))
    if options == AssembleOptions(False, False, False, 0):
        options = AssembleOptions()

    def attached(df: DataFrame, on: str, name: str, row: Column) -> DataFrame:
        return df.groupBy(F.col(on).alias("key")).agg(F.array_sort(F.collect_list(row)).alias(name))

    if options.facets and facets is not None:
        out = out.join(attached(facets, "key", "facets", F.struct("facet_id", "derived_content")), "key", "left")
    if options.edges and edges is not None:
        out = out.join(attached(edges, "from_key", "edges", F.struct("to_key", F.octet_length("relation").alias("n"), "relation", "weight")), "key", "left")
    if options.seams and seams is not None:
        ends = seams.select("id", "seam_type", F.explode(F.array_distinct(F.array("a_key", "b_key"))).alias("end"))
        out = out.join(attached(ends, "end", "seams", F.struct("id", "seam_type")), "key", "left")
    return out


def assemble_cell(snap: DataFrame, at: Coord, options: AssembleOptions = AssembleOptions(), **with_) -> DataFrame:
    out = assemble_cells(snap.filter(F.col("key") == pack_one(*at)), options, **with_)
    if out.isEmpty():
        raise CellNotFound(str(at))
    return out


def filter_views(views: DataFrame, predicate: Column | None = None) -> DataFrame:
    return views if predicate is None else views.filter(predicate)


def fit_prompt(cells: DataFrame, most_words: int, candidates: int = MAX_CELLS) -> list:
    """Greedy pack by confidence: a cell that would pass the budget of words is left out, smaller ones after it may go in."""
    rows = cells.withColumn("n_words", F.size(F.filter(F.split("raw_content", r"\s+"), lambda w: w != ""))).orderBy(F.col("confidence").desc(), "key").limit(candidates)
    out, used = [], 0
    for row in rows.toLocalIterator():
        if used + row.n_words <= most_words:
            out.append(row)
            used += row.n_words
    return out
