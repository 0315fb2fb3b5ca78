"""The corpus operators' queries, thin over the operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import _shared, align, chat, decontaminate, exact, licenses, lines, ngram, oracles, packing, quality, simhash, substring, warc, whitening

#: The vocabulary file, found by the installed package of public tokenizers.
VOCABULARY = "word_bpe_49k.json"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES["op3_simhash"] = op3_simhash


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.verdict(quality.BASE)).alias("base_failed"), quality.verdict(quality.DEFAULT).alias("kept"),
    )


QUERIES["op4_quality"] = op4_quality
ORACLES["op4_quality"] = oracles.QUALITY


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{0}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{0}'".format(said))
    formatted = chat.format_conversations(rows.unionByName(extra), chat.text_part(F.col("text")))
    return chat.digests(chat.read_back(formatted))


QUERIES["op5_chat"] = op5_chat
ORACLES["op5_chat"] = oracles.CHAT


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared.new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.resolve(_shared.materialize(warc.read_archives(spark, path), "records"))


QUERIES["op8_warc"] = op8_warc
ORACLES["op8_warc"] = oracles.WARC


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path(), capacity=2048, end_id=0)


QUERIES["op2_packing"] = op2_packing


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(_table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op7_substring"] = op7_substring
ORACLES["op7_substring"] = oracles.SUBSTRING


#: Shortest run of lines that line dedup deletes.
MIN_LINES = 3


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(_table(spark, sf_dir, "documents"), min_lines=MIN_LINES)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op10_lines"] = op10_lines
ORACLES["op10_lines"] = oracles.LINES


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op1_decontaminate"] = op1_decontaminate


def op9_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram.scores(_table(spark, sf_dir, "documents"))
    mean = F.round(F.col("score") / F.nullif("n_tokens", F.lit(0)), 6)
    return found.select("doc_id", "n_tokens", F.round("score", 4).alias("log_score"), mean.alias("mean_log_score"))


QUERIES["op9_ngram"] = op9_ngram


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "paragraph", "family", F.round("probability", 4).alias("probability"), F.round("overlap", 4).alias("overlap"), "confirmed")


QUERIES["op6_licenses"] = op6_licenses


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_table(spark, sf_dir, "documents")).drop("row")


QUERIES["op12_exact"] = op12_exact
ORACLES["op12_exact"] = oracles.EXACT


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(_table(spark, sf_dir, "documents"), *paths)


QUERIES["op11_align"] = op11_align


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), most=8)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES["op13_whitening"] = op13_whitening
