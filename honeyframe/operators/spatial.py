"""Reads around a coordinate; orders are those of the spiral, nearest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument
from honeyframe.functions.geometry import Coord, check_radius, distance, near, render_grid, ring, spiral
from honeyframe.functions.scalars import valid_at


def _around(snap: DataFrame, center: Coord, radius: int) -> DataFrame:
    return snap.filter(near("q", "r", center, radius)).withColumn("ring", distance("q", "r", *center)).withColumn("spiral", spiral("q", "r", center))


def walk_ring(snap: DataFrame, center: Coord, k: int) -> DataFrame:
    """Every coordinate of the ring in order, with its cell or nulls; ``found`` tells which."""
    check_radius(center, k)
    cells = snap.filter(near("q", "r", center, k)).withColumn("found", F.lit(True)).drop("q", "r")
    out = ring(snap.sparkSession, center, k).join(cells, "key", "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False))).orderBy("spiral")


def walk_ring_at(snap: DataFrame, center: Coord, k: int, as_of: int) -> DataFrame:
    """The ring's cells that are valid at a time."""
    check_radius(center, k)
    return _around(snap, center, k).filter((F.col("ring") == k) & valid_at(as_of)).orderBy("spiral")


def scan_context(snap: DataFrame, center: Coord, radius: int, most: int, as_of: int | None = None) -> DataFrame:
    """The first ``most`` cells of the disk, valid at ``as_of`` if it is given."""
    check_radius(center, radius)
    if most <= 0:
        raise InvalidArgument("the number of cells must be positive")
    rows = _around(snap, center, radius)
    return (rows if as_of is None else rows.filter(valid_at(as_of))).orderBy("spiral").limit(most)


def walk_ring_facets(snap: DataFrame, facets: DataFrame, center: Coord, k: int, mask: int, as_of: int | None = None) -> DataFrame:
    """The ring's cells with ``facets``, the facets whose bit of ``mask`` is set, in order of their id."""
    check_radius(center, k)
    if mask & ~0x3F or mask < 0:
        raise InvalidArgument("a mask has six bits")
    cells = _around(snap, center, k).filter(F.col("ring") == k)
    cells = cells if as_of is None else cells.filter(valid_at(as_of))
    wanted = facets.filter(F.col("facet_id").isin([i for i in range(6) if mask >> i & 1]) & near("q", "r", center, k))
    grouped = wanted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("facet_id", "derived_content", "last_rotated", "derivation_hash"))).alias("facets"))
    return cells.join(grouped, "key", "left").orderBy("spiral")


def ring_density(snap: DataFrame, center: Coord, radius: int) -> DataFrame:
    """ring, occupied and total of every ring, empty ones too."""
    check_radius(center, radius)
    taken = _around(snap, center, radius).groupBy("ring").agg(F.count("*").alias("occupied"))
    rings = snap.sparkSession.range(0, radius + 1, 1, 1).select(F.col("id").cast("int").alias("ring"))
    total = F.when(F.col("ring") == 0, 1).otherwise(6 * F.col("ring")).cast("long")
    return rings.join(taken, "ring", "left").select("ring", F.coalesce("occupied", F.lit(0)).cast("long").alias("occupied"), total.alias("total")).orderBy("ring")


def total_density(rings: DataFrame) -> DataFrame:
    return rings.agg(F.coalesce(F.sum("occupied"), F.lit(0)).alias("occupied"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def untagged_cells(snap: DataFrame, center: Coord, radius: int) -> DataFrame:
    check_radius(center, radius)
    return _around(snap, center, radius).filter(F.coalesce(F.size("tags"), F.lit(0)) <= 0).select("q", "r", "ring", "spiral").orderBy("spiral")


def render_occupied(snap: DataFrame, center: Coord, radius: int) -> str:
    """The disk as text, ``*`` where there is a cell; at most 331 coordinates reach the driver."""
    radius = min(radius, 10)
    taken = {(x.q, x.r) for x in snap.filter(near("q", "r", center, radius)).select("q", "r").collect()} if radius >= 0 else set()
    return render_grid(center, radius, lambda c: "*" if c in taken else ".")
