"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import _shared, decontaminate, lines, near, packing, quality
from lexforge.llm.queries import MIN_LINES, vocabulary_path

#: Words from which a repeated run of fewer than MIN_LINES lines is deleted too.
MIN_WORDS = 50
#: Words that packing remembers in Python workers, which other stages use as well.
CACHE_WORDS = 1 << 17


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go.

    Decided row by row: null and empty texts go, repeated ids and rows fare as their texts do, extra columns stay.
    """
    return quality.filter_documents(docs, quality.DEFAULT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs, by lines or by words, are deleted; documents with no line left go.

    Null and wordless texts have no lines and stay; a null id comes first; texts of any length are cut at their lines.
    """
    return lines.dedup_documents(docs, MIN_LINES, min_words=MIN_WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) one row stays, that with the smallest id.

    Rows are told apart by id and text, null ids too; repeated rows and all wordless texts are copies of one another.
    """
    return near.keep_survivors(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Decided by id and text, so null and repeated ids lose only rows that leak; an empty benchmark removes nothing.
    """
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; null and empty texts are the end id alone."""
    return packing.pack(docs, vocabulary_path(), capacity=2048, end_id=0, cache_words=CACHE_WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Tokenizing and packing are beyond SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _shared.materialize(stage(spark, docs, sf_dir), name)
        _shared.free_shuffles(spark)
    return docs
