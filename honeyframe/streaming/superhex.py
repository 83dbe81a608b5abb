"""Occupancy of super-hexagons kept up to date from the changefeed.

State is the last record of each coordinate, of which puts count as cells: a put that finds a cell only moves its
sequence, a deletion of an unknown one does nothing, and applying a batch twice changes nothing. Each batch writes its own
last records to the shared folder, no more than it has; when ``DELTAS`` batches have come they are merged with what was
before, so that the whole state is rewritten once in so many batches. A batch that fails is applied again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from honeyframe.errors import InvalidArgument
from honeyframe.functions.geometry import Coord, pack_one, superhex_center, superhex_parent
from honeyframe.plans.lineage import cut

PUT, DELETE = 1, 6
#: Batches after which the state is merged.
DELTAS = 32


class SuperhexSync:
    def __init__(self, spark: SparkSession, level: int):
        if level < 1 or 7**level >= 1 << 63:
            raise InvalidArgument("the level is out of bounds")
        self.level, self.last_seq = level, 0
        self.merged, self.deltas = spark.createDataFrame([], "key long, op int, q int, r int, seq long"), []

    def _last(self) -> DataFrame:
        rows = self.merged
        for x in self.deltas:
            rows = rows.unionByName(x)
        return rows.groupBy("key").agg(F.max_by(F.struct("op", "q", "r", "seq"), "seq").alias("m")).select("key", "m.*")

    @property
    def state(self) -> DataFrame:
        """key, q, r and seq of every coordinate that holds a cell."""
        return self._last().filter(F.col("op") == PUT).select("key", "q", "r", "seq")

    def apply(self, records: DataFrame, batch_id: int | None = None) -> None:
        """Records of the feed (seq, op, key, q, r), in any order; ready for foreachBatch."""
        new = records.filter((F.col("seq") > self.last_seq) & F.col("op").isin(PUT, DELETE))
        last = new.groupBy("key").agg(F.max_by(F.struct("op", "q", "r", "seq"), "seq").alias("m")).select("key", "m.*")
        high = records.agg(F.max("seq")).first()[0]
        self.deltas.append(cut(last.select("key", F.col("op").cast("int").alias("op"), "q", "r", "seq")))
        if len(self.deltas) >= DELTAS:
            self.merged, self.deltas = cut(self._last()), []
        self.last_seq = max(self.last_seq, high or 0)

    def sync(self, feed: DataFrame, limit: int = 256) -> int:
        """Apply at most ``limit`` next records; how many there were."""
        batch = cut(feed.filter(F.col("seq") > self.last_seq).orderBy("seq").limit(limit))
        n = batch.count()
        if n:
            self.apply(batch)
        return n

    def summaries(self) -> DataFrame:
        q, r = superhex_parent("q", "r", self.level)
        out = self.state.groupBy(q.alias("parent_q"), r.alias("parent_r")).agg(F.count("*").alias("occupied"), F.max("seq").alias("last_seq"))
        cq, cr = superhex_center("parent_q", "parent_r", self.level)
        return out.withColumn("center_q", cq).withColumn("center_r", cr).withColumn("capacity", F.lit(7**self.level).cast("long")).orderBy("parent_q", "parent_r")

    def summary(self, parent_q: int, parent_r: int) -> DataFrame:
        return self.summaries().filter((F.col("parent_q") == parent_q) & (F.col("parent_r") == parent_r))

    def summary_for(self, at: Coord) -> DataFrame:
        """The summary of the super-hexagon that a coordinate lies in; no row if that is empty."""
        spark = self.state.sparkSession
        pack_one(*at)  # a coordinate outside the lattice is an error
        q, r = superhex_parent(F.lit(at[0]), F.lit(at[1]), self.level)
        parent = spark.range(1).select(q.alias("parent_q"), r.alias("parent_r"))
        return self.summaries().join(F.broadcast(parent), ["parent_q", "parent_r"])

    def start(self, feed: DataFrame, checkpoint: str):
        """Follow a streaming feed until it has no more, batch by batch."""
        return feed.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
