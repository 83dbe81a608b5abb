"""Operator 2: token counts through a digest cache.

The cache is a folder of Parquet files with one row per (tokenizer digest, content digest). A run joins the digests of
its documents to the cache, encodes one document of each digest that is missing, and appends those counts.

Nulls and empty texts count as the empty text; very long ones are encoded whole. Repeated rows and equal texts share one
digest and are encoded once; each input row still gets its own output row, also where ids are null or tie. Other columns
of the input are not read, so their names can't clash. An empty table gives an empty result and appends nothing.

A text that very many rows share is one key of the last join only; the counts it meets there are a written table, so that
Spark can split that key's partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from honeyframe.llm.common import cleaned, materialise
from honeyframe.llm.encoding import encode_all, vocabulary

#: Digests that a task remembers as encoded; past that it forgets, and a content met again is encoded again to the same count.
REMEMBERED = 200_000
CACHE_SCHEMA = "tokenizer binary, content binary, n_tokens long"


def tokenizer_digest(name: str) -> bytes:
    """SHA-256 of the vocabulary file: another version is another tokenizer."""
    with open(vocabulary(name), "rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, content digest and UTF-8 length. Content is normalised to what the tokenizers see: null becomes empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))


def _counter(name: str, engine: str):
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, seen = vocabulary(name), set()
        for part in parts:
            if len(seen) > REMEMBERED:
                seen.clear()
            # Rows that are alike in all columns meet in one task.
            new = [x not in seen and not seen.add(x) for x in part.column("content").to_pylist()]
            part = part.filter(pa.array(new, pa.bool_()))
            texts = part.column("text").to_pylist()
            for rows, _, n in encode_all(path, texts, engine):
                yield pa.RecordBatch.from_arrays([part.column("content").slice(rows.start, rows.stop - rows.start), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return count


def read_cache(docs: DataFrame, cache: str, digest: bytes) -> DataFrame:
    """content and n_tokens of one tokenizer; a pair appended twice by runs at the same time counts once."""
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content binary, n_tokens long")
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == F.lit(digest))
    return known.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def update_cache(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", engine: str = "table") -> None:
    """Encode the distinct contents that the cache lacks and append their counts."""
    digest = tokenizer_digest(tokenizer)
    keyed = with_digest(docs, id_col, text_col).withColumn("place", F.struct(F.xxhash64("text", "id").alias("h"), F.col("id")))
    missing = keyed.groupBy("content").agg(F.min("place").alias("place")).join(read_cache(docs, cache, digest), "content", "left_anti")
    # Only the chosen rows' keys are hashed in memory; the texts stream past them.
    chosen = missing.select(F.col("content").alias("c"), F.col("place.h").alias("h")).hint("shuffle_hash")
    texts = keyed.select("content", "text", F.col("place.h").alias("g"))
    texts = texts.join(chosen, (texts.content == chosen.c) & (texts.g == chosen.h), "left_semi")
    counted = texts.select("content", "text").mapInArrow(_counter(tokenizer, engine), "content binary, n_tokens long")
    counted = counted.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counted = counted.select(F.lit(digest).alias("tokenizer"), "content", "n_tokens")
    with cleaned(docs.sparkSession):
        counted.write.mode("append").option("compression", "zstd").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", max_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text", engine: str = "table") -> DataFrame:
    """Per input row: id, n_bytes, n_tokens and over_limit, after bringing the cache up to date."""
    update_cache(docs, cache, tokenizer, id_col, text_col, engine)
    known = materialise(read_cache(docs, cache, tokenizer_digest(tokenizer)), "counts")
    keyed = with_digest(docs, id_col, text_col).select("id", "content", "n_bytes")
    return keyed.join(known, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
