"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next.

1. toxicity: documents whose passages score 0.7 or more go.
2. jaccard: of documents joined by similarity 0.8 on word 5-grams, the one with the smallest id stays.
3. substrings: words covered by 13 consecutive words that also start in a document with a smaller id go; a document keeps its
   row even if no word is left, and one that loses nothing keeps its text as it is.
4. decontamination: documents that hold a window of 10 words of a benchmark item go.
5. packing: what is left becomes sequences of 1024 tokens along a Hilbert curve.

Defined cases: an empty table gives no rows; null and empty texts pass the first four stages and are packed as their end id; rows
with a null doc_id pass the second stage as they are; of rows that repeat an id and a text one passes the second stage; other
columns, whatever their names, pass the first four stages unchanged (n_chars, where there is one, follows the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import decontamination, jaccard, packing, substrings, toxicity
from arbora.llm._spark import folders, release, table, written
from arbora.llm.tokens import default_tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned, _ = substrings.remove_repeats(docs, target=13)
    if "n_chars" in docs.columns:  # a column of the documents table, which tells the length of the text
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.reject_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(docs, default_tokenizer()))


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("decontamination", reject_contaminated),
    ("packing", pack),
]

#: A learned score decides in the first stage, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    others = folders()
    for name, stage in STAGES[:-1]:
        before = folders()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        # The stage's rows are written, so what they came from goes: its own tables and the stage before.
        release(spark, keep=[*others, *[p for p in folders() if p not in before and f"/stage-{name}-" in p]])
    return STAGES[-1][1](spark, docs, sf_dir)
