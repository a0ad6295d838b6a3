"""The text pipeline: toxicity, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; all but the last return the columns of documents. Rows are
judged one by one, so null and repeated ids, and further columns of any name but
the documents' own, make no difference unless a stage says so. Null and empty
texts are neither toxic nor copies nor leaks. No rows in give no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import shared_path, write_parquet
from voxelith.llm.decontaminate import drop_leaks
from voxelith.llm.near_dup import JaccardJoin, drop_near_copies
from voxelith.llm.packing import pack
from voxelith.llm.secret_scan import redact_secrets
from voxelith.llm.toxicity import drop_toxic, fit_toxicity, fold


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text the classifier calls toxic. It learns from labelled rows of the training fold alone."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=fold(F.col("doc_id")) != 1)
    return drop_toxic(docs, model)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group that links of similarity 0.8 on five words reach.

    Rows with the same id are one document: they stay or go together, but of
    rows that also have the same text one stays. Rows without an id come after
    all others; of those with the same text one stays.
    """
    return drop_near_copies(docs, JaccardJoin(words=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a passage of a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, plain or encoded, and counts the characters anew. All rows stay; a null text stays null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of the rows left: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Rows with the same id, or none, are documents of their own; a null or empty text has the end id alone.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The classifier, the decoding worklist and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            write_parquet(docs, path)
            docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
