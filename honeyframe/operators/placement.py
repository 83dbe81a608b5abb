"""Free coordinates for new cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.errors import NoFreePlacement
from honeyframe.functions.geometry import MAX_COORD, Coord, check_radius, disk, disk_size, morton, near, spiral_inverse, spiral_offset
from honeyframe.plans.lineage import cut


def free_coords(taken: DataFrame, anchor: Coord, radius: int) -> DataFrame:
    """Coordinates of the disk that no row of ``taken`` has, in spiral order; ``probes`` says how many were skipped before it."""
    check_radius(anchor, radius)
    used = taken.filter(near("q", "r", anchor, radius)).select("key").distinct()
    return disk(taken.sparkSession, anchor, radius).join(used, "key", "left_anti").orderBy("spiral")


def find_free(snap: DataFrame, anchor: Coord, radius: int, must: bool = True) -> DataFrame:
    """The first coordinate without a visible cell, and as ``probes`` the taken ones before it; of a full disk an error or, unless one ``must`` be found, no row."""
    found = free_coords(snap, anchor, radius).limit(1)
    if must and found.isEmpty():
        raise NoFreePlacement(f"within {radius} of {anchor}")
    return found.select("q", "r", "key", F.col("spiral").alias("probes"))  # all places before the first free one are taken


def find_unused(versions: DataFrame, anchor: Coord, radius: int, must: bool = True) -> DataFrame:
    """The first coordinate that never had a cell: deleted ones count as taken."""
    return find_free(versions, anchor, radius, must)


def numbered(rows: DataFrame, order: str) -> tuple[DataFrame, int]:
    """Rows written once with ``nth``, their number from 0 in order (nulls last), and how many there are.

    A row is numbered within its task; the tasks' counts, one row each, say where each begins.
    """
    written = cut(rows.orderBy(F.col(order).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    starts, n = [], 0
    for task, size in written.groupBy(F.shiftright("_at", 33).alias("task")).count().orderBy("task").collect():
        starts.append((task, n))
        n += size
    base = written.sparkSession.createDataFrame(starts, "task long, base long")
    nth = F.col("base") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return written.join(F.broadcast(base), F.shiftright("_at", 33) == F.col("task")).withColumn("nth", nth).drop("task", "base", "_at"), n


def place_all(docs: DataFrame, taken: DataFrame, anchor: Coord, radius: int, order: str = "id", must: bool = True) -> DataFrame:
    """Documents of one anchor on its free coordinates, in order. More of them than there are free coordinates are an error or, unless all ``must`` be placed, those that come first are placed.

    The disk may be as wide as the lattice: coordinates and documents are numbered in parallel.
    """
    check_radius(anchor, radius, MAX_COORD)
    dq, dr = spiral_inverse(F.col("spiral"))
    places = taken.sparkSession.range(disk_size(radius)).select(F.col("id").alias("spiral")).select("spiral", (dq + anchor[0]).alias("q"), (dr + anchor[1]).alias("r"))
    used = taken.filter(near("q", "r", anchor, radius)).select("key").distinct()
    free, places_left = numbered(places.withColumn("key", morton("q", "r")).join(used, "key", "left_anti"), "spiral")
    own, wanted = numbered(docs, order)
    if must and wanted > places_left:
        raise NoFreePlacement(f"too many for {radius} rings around {anchor}")
    return own.join(free.select("nth", "q", "r", "key"), "nth").drop("nth")


def place_many(documents: list[tuple[object, Coord]], taken: set[Coord], radius: int) -> list[tuple[object, Coord]]:
    """Documents with anchors of their own, one after the other, as each takes the first place the earlier ones left."""
    used, out, start = set(taken), [], {}
    for name, anchor in documents:
        check_radius(anchor, radius)
        n = start.get(anchor, 0)
        while n < disk_size(radius):
            dq, dr = spiral_offset(n)
            at = anchor[0] + dq, anchor[1] + dr
            if at not in used:
                break
            n += 1
        else:
            raise NoFreePlacement(f"within {radius} of {anchor}")
        start[anchor] = n
        used.add(at)
        out.append((name, at))
    return out
