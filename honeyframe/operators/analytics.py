"""Counts and checks over whole snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument
from honeyframe.functions.geometry import distance, superhex_center, superhex_parent
from honeyframe.functions.scalars import unique_sorted_tags
from honeyframe.operators import seams as seam_ops, snapshot


def tag_counts(snap: DataFrame) -> DataFrame:
    """Cells per tag, a tag counting once in a cell and only as it is trimmed; by count, then tag."""
    tags = F.explode(F.array_distinct(F.filter("tags", lambda t: (t == F.trim(t)) & (t != ""))))
    return snap.select(tags.alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag")


def tag_cooccurrences(snap: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of a cell's tags, the lesser first; the pairs are made inside the row, so there is no join."""
    tags = unique_sorted_tags()
    pairs = F.flatten(F.transform(tags, lambda a: F.transform(F.filter(tags, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    out = snap.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("tag_a"), F.col("p.b").alias("tag_b")).agg(F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "tag_a", "tag_b")


def health(snap: DataFrame, seams: DataFrame, versions: DataFrame, tag_index: DataFrame | None = None, source_index: DataFrame | None = None) -> DataFrame:
    """One row of counts. Resolved means exactly that status. Indexes (key, tag) and (key, source_id) are compared with the cells if given."""
    cells = snap.agg(F.count("*").alias("cells"))
    counts = seams.agg(F.count("*").alias("seams"), F.count_if(F.col("resolution_status") == "resolved").alias("resolved"), F.count_if(F.coalesce(F.col("resolution_status") != "resolved", F.lit(True))).alias("unresolved"))
    orphaned = seam_ops.orphans(seams, snap).agg(F.count("*").alias("orphaned_seams"))
    out = cells.crossJoin(counts).crossJoin(orphaned).crossJoin(snapshot.stats(versions))
    for name, index, wanted in (("tag", tag_index, snap.select("key", F.explode(unique_sorted_tags()).alias("tag"))), ("source_id", source_index, snap.select("key", F.trim("source_id").alias("source_id")).filter("source_id <> ''"))):
        if index is not None:
            wrong = wanted.exceptAll(index.select("key", name)).unionByName(index.select("key", name).exceptAll(wanted))
            out = out.crossJoin(wrong.agg(F.count("*").alias(f"{name}_index_errors")))
    return out


def warnings(row) -> list[str]:
    return [f"{n} {what}" for what, n in (("orphaned seams", row.orphaned_seams), ("unresolved seams", row.unresolved)) if n]


def superhex_summary(snap: DataFrame, level: int, seq: str | None = "commit_seq") -> DataFrame:
    """Occupied cells per super-hexagon of a level: parent_q, parent_r, center_q, center_r, occupied, capacity, last_seq."""
    if level < 1 or 7**level >= 1 << 63:
        raise InvalidArgument("the level is out of bounds")
    q, r = superhex_parent("q", "r", level)
    last = F.max(seq) if seq else F.lit(None).cast("long")
    out = snap.select(q.alias("parent_q"), r.alias("parent_r"), *([seq] if seq else [])).groupBy("parent_q", "parent_r").agg(F.count("*").alias("occupied"), last.alias("last_seq"))
    cq, cr = superhex_center("parent_q", "parent_r", level)
    return out.select("parent_q", "parent_r", cq.alias("center_q"), cr.alias("center_r"), "occupied", F.lit(7**level).cast("long").alias("capacity"), "last_seq").orderBy("parent_q", "parent_r")


def neighborhood_precision(docs: DataFrame, limit: int, radius: int) -> DataFrame:
    """Of the ``limit`` nearest placed documents of each (by distance, then id) the share of the same topic.

    ``docs`` has id, q, r and topic. A document meets others through the coordinates of its own disk, so the join is an
    equi-join whose size is rows * disk, not rows squared.
    """
    from honeyframe.functions.geometry import disk_size, spiral_inverse

    dq, dr = spiral_inverse("n")
    reach = docs.select(F.col("id").alias("center"), F.col("topic").alias("center_topic"), "q", "r", F.explode(F.sequence(F.lit(1), F.lit(disk_size(radius) - 1))).alias("n"))
    reach = reach.select("center", "center_topic", (F.col("q") + dq).alias("q"), (F.col("r") + dr).alias("r"), F.col("n").alias("place"))
    near = reach.join(docs, ["q", "r"])
    rank = F.row_number().over(Window.partitionBy("center").orderBy("place"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= limit)
    same = F.sum((F.col("topic") == F.col("center_topic")).cast("long"))
    return near.groupBy("center").agg(same.alias("same"), F.count("*").alias("n"))


def useful_fraction(near: DataFrame, size: str = "n_bytes") -> DataFrame:
    """Bytes of the same topic over all bytes of contexts; ``near`` has center_topic, topic and a size."""
    useful = F.sum(F.when(F.col("topic") == F.col("center_topic"), F.col(size)).otherwise(0))
    return near.agg((useful / F.sum(size)).alias("useful_fraction"))


def total_variation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the summed difference of two distributions over topic (topic, n); 1 where one is empty."""
    both = a.select("topic", F.col("n").alias("x")).join(b.select("topic", F.col("n").alias("y")), "topic", "full")
    sums = both.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("sx"), F.coalesce(F.sum("y"), F.lit(0)).alias("sy"))  # one row
    x, y = F.coalesce("x", F.lit(0)) / F.col("sx"), F.coalesce("y", F.lit(0)) / F.col("sy")
    gap = both.crossJoin(F.broadcast(sums.filter("sx * sy <> 0"))).agg((F.sum(F.abs(x - y)) / 2).alias("gap"))
    return gap.select(F.coalesce("gap", F.lit(1.0)).alias("divergence"))


def coordinate_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of ids that stand where they stood."""
    both = before.select("id", "q", "r").join(after.select("id", F.col("q").alias("q2"), F.col("r").alias("r2")), "id")
    return both.agg(F.avg(((F.col("q") == F.col("q2")) & (F.col("r") == F.col("r2"))).cast("double")).alias("stability"))


def lower_percentile(df: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """The value at rank (n - 1) * p div 100 of all values, not interpolated; a sort by range, of which only the asked rows go further."""
    n = df.count()
    ranks = [((n - 1) * p // 100, p) for p in percents] if n else []
    ordered = df.select(F.col(column).alias("value")).repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    from honeyframe.plans.lineage import cut

    ordered = cut(ordered)
    sizes = ordered.groupBy("part").count().collect()  # one row per partition
    picks, first = [], 0
    for part, size in sorted(sizes):
        picks += [(part, r - first + 1, p) for r, p in ranks if first <= r < first + size]
        first += size
    picks = df.sparkSession.createDataFrame(picks, "part int, nth int, percent int")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return ordered.withColumn("nth", nth).join(F.broadcast(picks), ["part", "nth"]).select("percent", "value").orderBy("percent")


def spread(snap: DataFrame, center=(0, 0)) -> DataFrame:
    """Cells per distance from a center."""
    return snap.groupBy(distance("q", "r", *center).alias("ring")).agg(F.count("*").alias("n")).orderBy("ring")
