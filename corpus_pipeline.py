"""From raw documents to packed sequences: five stages, each over all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm import common, linededup, nearcopies, packing, quality, suffixdedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return _documents(quality.scored(docs, quality.fit(docs)).filter("keep"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that earlier documents have, in aligned blocks; no document goes."""
    return _documents(linededup.dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least doc_id; of rows that repeat its id and text, one."""
    kept = common.written(nearcopies.near_copies(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct(), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("__node"))
    return _documents(docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 200 bytes or more that occur twice, by whole characters; no document goes."""
    return _documents(suffixdedup.cut_out(docs, characters=True).withColumn("text", F.col("kept").cast("string")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't train the classifier, align texts or pack bins: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
