"""A training-data pipeline over `documents`: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the
columns of documents; each result is written as Parquet and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnspark.llm import jaccard, packing, quality, suffix_dedup
from knnspark.llm.common import Scratch, table
from knnspark.llm.queries import END_OF_TEXT, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.score(docs, quality.fit(docs)).filter(F.col(f"{quality.QUALITY}.kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 on five-word shingles, the row of the smallest id stays, and of equal rows one.

    A row is known by its id and two hashes of its text, so a text never goes because another one shares its id. Rows without an
    id or without words stay.
    """
    key = lambda: F.struct("doc_id", F.xxhash64("text").alias("__near_1"), F.xxhash64(F.lit(1), "text").alias("__near_2"))
    named = docs.filter("doc_id IS NOT NULL").select(key().alias("key"), "text")
    found = jaccard.near_duplicates(named, k=5, percent=80, id_col="key")
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("head"), F.max("n_shingles").alias("n"))
    odd = rows.filter("n > 0 AND (rows > 1 OR head <> doc_id)").select("doc_id.*", (F.col("head") != F.col("doc_id")).alias("__near_gone"))
    odd = Scratch(spark).keep(odd)  # most rows are neither copies nor repeated
    marked = docs.withColumns({"__near_1": F.xxhash64("text"), "__near_2": F.xxhash64(F.lit(1), "text")})
    by = ["doc_id", "__near_1", "__near_2"]
    suspect = jaccard.may_hold(odd, *by)(*by)
    checked = marked.filter(suspect).join(odd, by, "left")
    repeated = checked.filter("NOT __near_gone").dropDuplicates(by)
    plain = marked.filter(~suspect).select(*docs.columns)
    return plain.unionByName(checked.filter("__near_gone IS NULL").select(*docs.columns)).unionByName(repeated.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that also start elsewhere go, as in the operator; every document stays, with what is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix_dedup.dedup(docs, length=200, carry=others)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), END_OF_TEXT)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: No SQL for a classifier, iterated links or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents").select(*COLUMNS), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
