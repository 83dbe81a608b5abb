"""The lattice's relations over the synthetic tables, so that every operator can be run and compared on them.

A document stands at the place of the spiral that its id names. All rules are whole-number arithmetic that other engines
share; nothing here is needed to use the operators on tables of your own.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from honeyframe.functions.geometry import morton, spiral_inverse
from honeyframe.plans.lineage import checkpoint_dir

BASE_NS = 1_700_000_000_000_000_000
HOUR_NS = 3600 * 1_000_000_000
#: The multipliers and modulus that choose blockers.
BLOCKERS = (73856093, 19349663, 17)


_stored: dict[tuple[str, str, str], str] = {}


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what was stored for a session, if the session is still there."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have gone before the interpreter ends
        pass


def stored(build):
    """A relation written once per session and folder of tables, as a store would hold it: with its coordinates as columns, so that filters on them reach the scan."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if at not in _stored:
            path = f"{checkpoint_dir(spark)}/honeyframe-{build.__name__}-{uuid.uuid4().hex}"
            rows = build(spark, sf_dir)
            if "key" in rows.columns:
                rows = rows.sortWithinPartitions("key")
            atexit.register(drop, spark, path)
            rows.write.parquet(path)
            _stored[at] = path
        return spark.read.parquet(_stored[at])

    get.__name__, get.__doc__ = build.__name__, build.__doc__
    return get


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_spiral(df: DataFrame, n: Column) -> DataFrame:
    """Adds q, r and key of a place of the spiral."""
    q, r = spiral_inverse(n)
    return df.withColumn("q", q).withColumn("r", r).withColumn("key", morton("q", "r"))


@stored
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    tags = F.array_compact(F.array(F.col("lang"), size, F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "quality")))
    start = F.lit(BASE_NS) + F.col("doc_id") * HOUR_NS
    valid_from = F.when(F.col("doc_id") % 5 != 0, start)
    out = at_spiral(docs, F.col("doc_id"))
    return out.select(
        "q", "r", "key", (F.col("doc_id") + 1).alias("commit_seq"), F.lit(False).alias("deleted"), F.col("text").alias("raw_content"), F.col("source").alias("source_id"),
        (F.col("doc_id") % 8 / 8.0).alias("confidence"), start.alias("created_at"), start.alias("updated_at"), valid_from.alias("valid_from"),
        F.when(F.col("doc_id") % 3 == 0, valid_from + 30 * 24 * HOUR_NS).alias("valid_to"), tags.alias("tags"), "doc_id",
    )


@stored
def cell_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a commit of its user's cell; an error deletes it."""
    events = at_spiral(read(spark, sf_dir, "events"), F.col("user_id"))
    wall = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return events.select("q", "r", "key", (F.col("event_id") + 1).alias("commit_seq"), (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("raw_content"), F.array("event_type").alias("tags"), wall.alias("wall_ns"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_versions(spark, sf_dir).select("commit_seq", "wall_ns")


@stored
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i to i + 1 (weight 1) and to i + 8 (weight 3), and to the next document of the same source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    step = F.explode(F.array(F.struct(F.lit(1).alias("by"), F.lit(1.0).alias("weight")), F.struct(F.lit(8).alias("by"), F.lit(3.0).alias("weight"))))
    ahead = docs.select(F.col("doc_id").alias("a"), step.alias("s")).select("a", (F.col("a") + F.col("s.by")).alias("b"), F.lit("evidence-route").alias("relation"), "s.weight")
    ahead = ahead.join(docs.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b", "relation", "weight")
    following = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    same = docs.select(F.col("doc_id").alias("a"), following.alias("b"), F.lit("same-source").alias("relation"), (1 + F.col("doc_id") % 4 / 4.0).alias("weight")).filter("b is not null")
    both = ahead.unionByName(same)
    both = at_spiral(both, F.col("a")).select("a", "b", "relation", "weight", F.col("q").alias("from_q"), F.col("r").alias("from_r"), F.col("key").alias("from_key"))
    return at_spiral(both, F.col("b")).select("from_q", "from_r", "from_key", F.col("q").alias("to_q"), F.col("r").alias("to_r"), F.col("key").alias("to_key"), "relation", "weight")


@stored
def seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of a text supersedes the copy before it; every second seam is resolved."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    before = F.lag("doc_id").over(Window.partitionBy("digest").orderBy("doc_id"))
    pairs = docs.select("doc_id", before.alias("older")).filter("older is not null")
    pairs = at_spiral(pairs, F.col("older")).select("doc_id", "older", F.col("q").alias("a_q"), F.col("r").alias("a_r"), F.col("key").alias("a_key"))
    pairs = at_spiral(pairs, F.col("doc_id"))
    start = F.lit(BASE_NS) + F.col("doc_id") * HOUR_NS
    return pairs.select(
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("id"), (F.col("doc_id") + 1).alias("commit_seq"), "a_q", "a_r", "a_key", F.col("q").alias("b_q"), F.col("r").alias("b_r"), F.col("key").alias("b_key"),
        F.lit("supersedes").alias("seam_type"), F.lit("copy").alias("reason"), F.lit(0.0).alias("confidence_delta"), start.alias("detected_at"), F.when(F.col("doc_id") % 2 == 0, "resolved").otherwise("").alias("resolution_status"),
        F.lit("").alias("resolution_note"), F.when(F.col("doc_id") % 5 != 0, start).alias("valid_from"), F.when(F.col("doc_id") % 3 == 0, start + 30 * 24 * HOUR_NS).alias("valid_to"), F.concat(F.lit("scan-"), (F.col("doc_id") % 4).cast("string")).alias("source_id"), F.lit(1.0).alias("confidence"),
    )


@stored
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = at_spiral(read(spark, sf_dir, "documents"), F.col("doc_id"))
    ids = F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(1))))
    derived = F.when(F.col("facet_id") == 1, F.col("text")).otherwise(F.col("lang"))
    return docs.withColumn("facet_id", ids).select("q", "r", "key", "facet_id", (F.col("doc_id") + 1).alias("commit_seq"), F.lit(False).alias("deleted"), derived.alias("derived_content"), F.lit(BASE_NS).alias("last_rotated"), F.sha2(F.col("text").cast("binary"), 256).alias("derivation_hash"))


@stored
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_spiral(read(spark, sf_dir, "embeddings"), F.col("vec_id")).select("q", "r", "key", "embedding", "vec_id", "label")


def blockers(coords: DataFrame) -> DataFrame:
    a, b, m = BLOCKERS
    return coords.filter(F.pmod(F.col("q").cast("long") * a + F.col("r").cast("long") * b, F.lit(m)) == 0).select("q", "r")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


@stored
def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changefeed of cell_versions: op 1 puts a cell, op 6 deletes it; a deletion carries no payload."""
    v = cell_versions(spark, sf_dir)
    op = F.when(F.col("deleted"), 6).otherwise(1)
    payload = F.when(~F.col("deleted"), F.col("raw_content"))
    return v.select(F.col("commit_seq").alias("seq"), "wall_ns", op.alias("op"), "q", "r", "key", payload.alias("payload"), F.when(~F.col("deleted"), F.sha2(F.col("raw_content").cast("binary"), 256)).alias("hash"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("encoded_len"))


def store(spark: SparkSession, sf_dir: str):
    """A store of the documents, made once per session: imported in order of their ids in commits of 128, every tenth put again in one bulk commit."""
    from honeyframe.sources.store import Store

    at = (spark.sparkContext.applicationId, sf_dir, "store")
    if at not in _stored:
        path = f"{checkpoint_dir(spark)}/honeyframe-store-{uuid.uuid4().hex}"
        atexit.register(drop, spark, path)
        made = Store(spark, path, max_value_bytes=1 << 31)
        made.import_cells(cells(spark, sf_dir), ("doc_id",))
        made.tag_snapshot("loaded")
        with made.update() as tx:
            again = cells(spark, sf_dir).filter("doc_id % 10 = 0").withColumn("raw_content", F.concat(F.lit("again "), "raw_content"))
            tx.put_cells(again.orderBy("doc_id"))
        made.tag_snapshot("again")
        _stored[at] = path
    return Store(spark, _stored[at], create=False)
