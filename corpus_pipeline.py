"""Corpus pipeline: from ``documents`` to packed training sequences, one operator per stage.

Each stage reads what the one before kept; all but the last return the columns of ``documents``. Extra columns
pass through. Empty input gives empty output. A stage drops a row for its own reason only, so clean documents
stay; rows without a doc_id are judged on their text, and are no duplicate of anything.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcare.llm.chunk_dedup import without_repeats
from stationcare.llm.decontaminate import contamination
from stationcare.llm.jaccard_join import jaccard_classes
from stationcare.llm.packing import pack
from stationcare.llm.quality import judge
from stationcare.operators.ordered import with_index
from stationcare.session import shared_dir, staged


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``bad`` names by doc_id and hash of the text (null doc_ids match as well)."""
    own = F.struct(docs["doc_id"].cast("long").alias("i"), F.xxhash64(docs["text"]).alias("h"))
    named = bad.select(F.struct(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).alias("_bad")).distinct()
    return docs.join(named, own == named["_bad"], "left_anti")


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text the classifier, fitted on ``labels``, scores below its threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored, _ = judge(docs, labels)
    return _without(docs, scored.filter("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id, then hash of the text."""
    known = docs.filter(F.col("doc_id").isNotNull())
    # repeated rows are one document, other texts of a doc_id are others; looked for first, most tables have neither
    hashes = known.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"))
    shared = hashes.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    twice, several = shared.agg(F.bool_or(F.expr("n > 1")), F.bool_or(F.expr("low < high"))).first()
    if several:
        # every (doc_id, text) gets a number of its own, in that order
        numbered = staged(with_index(hashes.distinct(), ["i", "h"], index="_n"), "numbered")
        own = (F.col("i") == F.col("doc_id").cast("long")) & (F.col("h") == F.xxhash64("text"))
        one = known.select("doc_id", "text").join(numbered, own).select(F.col("_n").cast("long").alias("doc_id"), "text")
        classes = jaccard_classes(one.dropDuplicates(["doc_id"]))
        later = classes.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_n"))
        kept = _without(docs, numbered.join(later, "_n", "left_semi").select(F.col("i").alias("doc_id"),
                                                                            F.col("h").alias("text_hash")))
    else:
        classes = jaccard_classes(docs)
        later = classes.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_id")).distinct()
        kept = docs.join(later, docs["doc_id"].cast("long") == later["_id"], "left_anti")
    if not twice:
        return kept
    known = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return known.unionByName(kept.filter(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; a document that loses all of its text goes."""
    cut = without_repeats(docs)
    emptied = (F.col("_removed") > 0) & (F.trim("text") == "")
    return _sized(cut.filter(~emptied | F.col("text").isNull()).drop("_removed", "_gone"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contamination(docs, benchmark).filter("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids; one row per piece, with its ids."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packing),
]

#: Trained scores and byte-pair ids have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
