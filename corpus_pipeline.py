"""A corpus from raw documents to packed sequences: quality rules, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from honeyframe.llm import decontaminate, jaccard, packing, quality
from honeyframe.llm.common import materialise, table

#: Near duplicates share five-word shingles to a Jaccard similarity of 0.8 (``jaccard.OVER / jaccard.UNDER``) or more.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep. Null and empty texts have too few words; repeated rows, ties and null ids are judged each; without labels only the base rules judge."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id; rows without an id stay. Operator 5's SimHash index finds candidates, MinHash bands find those it can't, and each is checked on both whole texts. Rows are judged by their own whole text, whatever id they have; texts without words, nulls among them, are alike. Of rows with the same least id in one group the least row stays."""
    classes = jaccard.near_duplicates(docs, SHINGLE_WORDS)
    kept = classes.filter("row.doc_id is null or row.doc_id = nd_least")
    named = kept.filter("row.doc_id is not null")
    repeated = materialise(named.groupBy("nd_label").count().filter("count > 1").select("nd_label"), "repeated")
    if not repeated.isEmpty():  # the same id in several rows of a group: one of them stays
        one = named.join(repeated, "nd_label", "left_semi").groupBy("nd_label").agg(F.min("row").alias("row"))
        kept = kept.filter("row.doc_id is null").unionByName(named.join(repeated, "nd_label", "left_anti")).select("row").unionByName(one.select("row"))
    return kept.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts have none, repeated rows and null ids are judged each."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset; a null or empty text is its end id, repeated rows and null ids keep all their pieces."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicate removal", near_dedup), ("benchmark decontamination", decontamination), ("best-fit packing", packed)]

#: No stage but the third can be said in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, as the next one's input. Extra columns go along whatever their names; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
