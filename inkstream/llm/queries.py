"""The registered queries of this subpackage and their SQL; `__spark_entry__.py` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hard_negatives, importance, mixing, personal_data, quality_knn, quality_rules, sharding, simhash_golay, token_counts, token_files, toxicity
from .common import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents measured and judged by the base rules and the learned list."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a hostile one, formatted and read back from the output."""
    turns = chat_format.with_hostile(spark, table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_conversations(turns))


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality; rows whose crc32(doc_id) mod 4 is 2 are held out of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = lambda: F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = quality_knn.fit(docs, labels.filter(remainder() != 2))
    scored = quality_knn.score(docs, model)
    return scored.select("doc_id", (remainder() == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, packed and written in id order, then read back from the files."""
    path = new_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read_digests(spark, path)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1 over the sources."""
    return mixing.takings(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: tokens of each whole text, counted by merging."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, fingerprints linked at 3 or fewer differing bits."""
    groups = simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: the pairs that leak, with their coverage."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents graded by the model fitted on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark's texts, the highest tenth ranked."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: spans of personal data, plain and disguised."""
    return personal_data.digests(personal_data.find(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings with ids divisible by 100; labels of ids divisible by 7 move on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_format": op3_chat_format,
    "op4_quality_knn": op4_quality_knn,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_simhash_golay": op8_simhash_golay,
    "op9_string_tiling": op9_string_tiling,
    "op10_toxicity": op10_toxicity,
    "op11_importance": op11_importance,
    "op12_personal_data": op12_personal_data,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op3_chat_format": chat_format.DIGEST_SQL,
    "op6_mixing": mixing.takings_sql(),
    "op11_importance": importance.RESAMPLE_SQL,
    "op13_hard_negatives": hard_negatives.MINE_SQL,
}
