"""Versions and snapshots over append-only tables.

A version is a row with its identity, commit_seq and deleted. What a snapshot shows is, per identity, the version with
the greatest commit_seq up to the snapshot's, unless it is a deletion. That is one partial and one final hash aggregate;
on a table bucketed by its identity there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from honeyframe.errors import FutureSequence, InvalidArgument, SnapshotExpired, UnknownSnapshotTag

#: The most versions that one pruning pass deletes, by profile.
PRUNE_PROFILES = {"balanced": 2048, "low-latency": 512, "long-history": 256}


def snapshot(versions: DataFrame, seq: int | Column | None = None, identity: tuple[str, ...] = ("key",), commit: str = "commit_seq") -> DataFrame:
    """Rows visible at ``seq``, or at the head for None."""
    rows = versions if seq is None else versions.filter(F.col(commit) <= seq)
    latest = rows.groupBy(*identity).agg(F.max_by(F.struct(*[c for c in versions.columns if c not in identity]), commit).alias("v"))
    out = latest.select(*identity, "v.*").select(*versions.columns)
    return out.filter(~F.col("deleted")) if "deleted" in versions.columns else out


def check_seq(seq: int, head: int, floor: int = 0) -> int:
    if seq > head:
        raise FutureSequence(f"{seq} is after the head {head}")
    if seq < floor:
        raise SnapshotExpired(f"{seq} is before the oldest snapshot {floor}")
    return seq


def seq_at_time(commits: DataFrame, wall_ns: int) -> int:
    """The last commit at or before a time, ties by sequence; 0 if there is none."""
    row = commits.filter(F.col("wall_ns") <= wall_ns).agg(F.max(F.struct("wall_ns", "commit_seq")).alias("m")).select("m.commit_seq").first()
    return row[0] or 0


def seq_of_tag(tags: DataFrame, label: str) -> int:
    row = tags.filter(F.col("label") == label).select("commit_seq").first()
    if row is None:
        raise UnknownSnapshotTag(label)
    return row[0]


def list_tags(tags: DataFrame) -> DataFrame:
    return tags.select("label", "commit_seq").orderBy("label")


def diff(cells: DataFrame, seams: DataFrame | None, low: int, high: int, head: int | None = None) -> DataFrame:
    """Retained versions with low < commit_seq <= high: kind, id, commit_seq, q, r, op. Not a net difference."""
    if low > high:
        raise InvalidArgument("from is after to")
    if head is not None:
        check_seq(high, head)
    within = (F.col("commit_seq") > low) & (F.col("commit_seq") <= high)
    op = F.when(F.col("deleted"), "delete").otherwise("put")
    out = cells.filter(within).select(F.lit("cell").alias("kind"), F.lit(None).cast("string").alias("id"), "commit_seq", "q", "r", op.alias("op"))
    if seams is not None:
        out = out.unionByName(seams.filter(within).select(F.lit("seam").alias("kind"), "id", "commit_seq", F.lit(None).cast("int").alias("q"), F.lit(None).cast("int").alias("r"), F.lit("put").alias("op")))
    return out.orderBy("kind", "commit_seq", "q", "r", "id")


def stats(versions: DataFrame) -> DataFrame:
    """head_seq, version_rows and coords, deleted ones too."""
    per = versions.groupBy("key").agg(F.count("*").alias("n"), F.max("commit_seq").alias("last"))
    return per.agg(F.coalesce(F.max("last"), F.lit(0)).alias("head_seq"), F.coalesce(F.sum("n"), F.lit(0)).alias("version_rows"), F.count("*").alias("coords"))


def prunable(versions: DataFrame, before: int) -> DataFrame:
    """Versions whose successor is at or before ``before``: the state at that sequence, deletions too, stays."""
    after = F.lead("commit_seq").over(Window.partitionBy("key").orderBy("commit_seq"))
    return versions.withColumn("_next", after).filter(F.col("_next") <= before).drop("_next")


def prune(versions: DataFrame, before: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted); at most ``most`` versions go, in the order of key and sequence."""
    gone = prunable(versions, before).orderBy("key", "commit_seq").limit(most)
    return versions.join(gone.select("key", "commit_seq"), ["key", "commit_seq"], "left_anti").select(*versions.columns), gone


def suggested_prune_seq(head: int, retain: int) -> int | None:
    """The sequence that keeps ``retain`` commits of history; None if nothing is said about it."""
    return None if retain <= 0 else max(head - retain, 0)


def prune_plan(head: int, retain: int, profile: str = "balanced") -> tuple[int, int] | None:
    if profile not in PRUNE_PROFILES:
        raise InvalidArgument(f"no such profile: {profile}")
    before = suggested_prune_seq(head, retain)
    return None if before is None else (before, PRUNE_PROFILES[profile])


@dataclass
class PruneScheduler:
    """Each tick is one pass; the caller decides when."""

    retain: int
    profile: str = "balanced"

    def tick(self, versions: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        head = versions.agg(F.max("commit_seq")).first()[0] or 0
        plan = prune_plan(head, self.retain, self.profile)
        return None if plan is None else prune(versions, *plan)
