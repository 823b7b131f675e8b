"""A training corpus from raw documents: quality, near-duplicates, repeats, benchmarks, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlattice.llm.common import fresh_folder, read, whole
from govlattice.llm.decontamination import find_contamination
from govlattice.llm.packing import pack_documents
from govlattice.llm.quality import keep_good
from govlattice.llm.repeats import remove_repeats
from govlattice.llm.simhash import keep_one_of_each

TOKENIZER = "word_bpe_49k.json"
# Passages of over 50 words are at least this long: on the given tables those that repeat have 254 bytes and more.
PASSAGE_BYTES = 250


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of about 50 words and more that occur elsewhere too."""
    rows = docs.select("doc_id", "text", whole(docs).alias("row"))
    cut = remove_repeats(rows, least=PASSAGE_BYTES, carry=["row"], as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"))
    found = find_contamination(docs.select(key.alias("key"), "text"), items, id_column="key").filter("contaminated")
    bad = found.select(F.col("key.id").alias("bad_id"), F.col("key.k").alias("bad_k")).distinct()
    rows = docs.select(whole(docs).alias("row"), key.alias("key"))
    same = F.col("key.id").eqNullSafe(F.col("bad_id")) & (F.col("key.k") == F.col("bad_k"))
    return rows.join(bad, same, "left_anti").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 4096."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), end=1, capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_contamination", benchmark_contamination),
    ("best_fit_packing", best_fit_packing),
]

# Fingerprints, suffix arrays and token ids are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each one's result is written and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
