"""Seams: contradictions and supersessions between two cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from honeyframe.errors import ScanLimit
from honeyframe.functions.geometry import MAX_SEAM_RADIUS, Coord, check_radius, near, spiral
from honeyframe.functions.scalars import canonical_pair, valid_at
from honeyframe.plans.lineage import cut

SUPERSEDES, CONFLICT = "supersedes", "mark_conflict"
MAX_HOPS, MAX_SEAMS, MAX_SEAM_ROWS = 16, 10_000, 200_000


def find_seams(seams: DataFrame, center: Coord, radius: int, unresolved_only: bool = False, as_of: int | None = None, most: int = MAX_SEAMS, most_rows: int = MAX_SEAM_ROWS) -> DataFrame:
    """Seams with an end in the disk, each once, the nearest end first and then by id; resolved means any status but blank."""
    check_radius(center, radius, MAX_SEAM_RADIUS)
    rows = seams.filter(near("a_q", "a_r", center, radius) | near("b_q", "b_r", center, radius))
    if most_rows and rows.select("id").limit(most_rows + 1).count() > most_rows:
        raise ScanLimit(f"more than {most_rows} seams to look at")
    if unresolved_only:
        rows = rows.filter(F.trim("resolution_status") == "")
    if as_of is not None:
        rows = rows.filter(valid_at(as_of))
    first = F.least(spiral("a_q", "a_r", center), spiral("b_q", "b_r", center))
    rows = rows.withColumn("place", first).orderBy("place", "id")
    if not most:
        return rows
    found = cut(rows.limit(most + 1))  # read once, for its number and for the result
    if found.count() > most:
        raise ScanLimit(f"more than {most} seams")
    return found.orderBy("place", "id")


def seams_by_source(seams: DataFrame, source: str) -> DataFrame:
    return seams.filter(F.trim("source_id") == source).orderBy("id")


def seams_in_week(seams: DataFrame, bucket: int) -> DataFrame:
    from honeyframe.functions.scalars import week_bucket

    return seams.filter(week_bucket() == bucket).orderBy("id")


def _seam(df: DataFrame, kind: str, id_col: str, reason: str, now_ns: int) -> DataFrame:
    stamp = F.lit(now_ns).cast("long")
    return df.select(
        F.col(id_col).alias("id"), "a_q", "a_r", "a_key", "b_q", "b_r", "b_key", F.lit(kind).alias("seam_type"), F.lit(reason).alias("reason"), F.lit(0.0).alias("confidence_delta"), stamp.alias("detected_at"),
        F.lit("").alias("resolution_status"), F.lit("").alias("resolution_note"), F.lit(None).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.lit("").alias("source_id"), F.lit(1.0).alias("confidence"),
    )


def mark_conflict(pairs: DataFrame, id_col: str, reason: str, now_ns: int) -> DataFrame:
    """Conflict seams of pairs (a_*, b_*), the end with the smaller key first."""
    low, _ = canonical_pair("a_key", "b_key")
    swap = low != F.col("a_key")
    turned = pairs.select(id_col, *[F.when(swap, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}")).alias(f"{x}_{c}") for x, y in (("a", "b"), ("b", "a")) for c in ("q", "r", "key")])
    return _seam(turned, CONFLICT, id_col, reason, now_ns)


def mark_supersedes(pairs: DataFrame, id_col: str, reason: str, now_ns: int) -> DataFrame:
    """Supersession seams: a is the old cell, b the one in its place."""
    return _seam(pairs, SUPERSEDES, id_col, reason, now_ns)


def successors(seams: DataFrame) -> DataFrame:
    """The one cell that follows each superseded one: of several the first with a key not below its own, else the first."""
    links = seams.filter(F.col("seam_type") == SUPERSEDES).select("a_q", "a_r", "a_key", "b_q", "b_r", "b_key", "id")
    best = links.groupBy("a_key").agg(F.min(F.struct((F.col("b_key") < F.col("a_key")).alias("x"), "b_key", "id", "a_q", "a_r", "b_q", "b_r")).alias("m"))
    return best.select(F.col("a_key").alias("key"), "m.a_q", "m.a_r", F.col("m.b_key").alias("next_key"), F.col("m.b_q").alias("next_q"), F.col("m.b_r").alias("next_r"))


def resolve_supersession(snap: DataFrame, seams: DataFrame, most_hops: int = MAX_HOPS) -> DataFrame:
    """Of every superseded cell: key, q, r and the cell at the end of its chain (target_key, target_q, target_r).

    The target is null if the chain turns back on itself, is longer than ``most_hops``, or ends where no live cell is.
    Each round is one join of what is still under way, and stops when nothing is.
    """
    step = cut(successors(seams))
    going = step.select("key", F.col("a_q").alias("q"), F.col("a_r").alias("r"), F.col("next_key").alias("at"), F.col("next_q").alias("at_q"), F.col("next_r").alias("at_r"), F.array("key").alias("seen"))
    done = []
    links = step.select(F.col("key").alias("at"), "next_key", "next_q", "next_r")
    for hop in range(most_hops):
        last = hop + 1 == most_hops
        cycle = F.array_contains("seen", F.col("at"))
        moved = going.withColumn("cycle", cycle).join(links, "at", "left")
        ended = moved if last else moved.filter("cycle or next_key is null")
        target = (~F.col("cycle")) & F.col("next_key").isNull()
        done.append(ended.select("key", "q", "r", *[F.when(target, F.col(c)).alias(f"target{c[2:] or '_key'}") for c in ("at", "at_q", "at_r")]))
        if last:
            break
        going = cut(moved.filter("not cycle and next_key is not null").select("key", "q", "r", F.col("next_key").alias("at"), F.col("next_q").alias("at_q"), F.col("next_r").alias("at_r"), F.concat("seen", F.array("at")).alias("seen")))
        if going.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    live = snap.select(F.col("key").alias("target_key"), F.lit(True).alias("live"))
    out = out.join(live, "target_key", "left")
    return out.select("key", "q", "r", *[F.when(F.col("live"), F.col(c)).alias(c) for c in ("target_key", "target_q", "target_r")])


def orphans(seams: DataFrame, snap: DataFrame) -> DataFrame:
    """Seams with an end where no live cell is."""
    live = snap.select("key")
    ends = seams.select("id", F.explode(F.array("a_key", "b_key")).alias("key"))
    return ends.join(live, "key", "left_anti").select("id").distinct()


def versions_of(seams: DataFrame) -> DataFrame:
    """One row per id, its last version."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.col("commit_seq").desc()))
    return seams.withColumn("_n", last).filter("_n = 1").drop("_n").orderBy("id")
