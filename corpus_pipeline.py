"""From raw documents to packed training sequences, a written table after each stage.

Toxic documents go; boilerplate lines go; one document of each group of near-duplicates stays; passages of test items
are cut, and documents that are mostly test items go; what remains is packed.

Every stage keeps all columns of its documents, extra ones too. Null and empty texts are clean, have no lines and no words: they
stay, but as near-duplicates of each other only the one of the least doc_id. Rows without a doc_id stay. Rows that repeat a doc_id are scored, cut
and packed each, and stay or go together as near-duplicates. A score of 0.5 is toxic; of equal documents the least doc_id stays. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import new_path, table
from glossweave.llm.decontaminate import remove_leaks
from glossweave.llm.line_dedup import WIDE, drop_boilerplate_lines
from glossweave.llm.near_texts import keep_one_of_each
from glossweave.llm.packing import pack_documents
from glossweave.llm.toxicity import fold, train, with_score


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    score = "_".join(("score", *docs.columns))  # a name that no column has
    return with_score(docs, train(docs, labels, label_col="toxic"), score_col=score).filter(F.col(f"`{score}`") < 0.5).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(drop_boilerplate_lines(docs, host=F.col("source"), once=True, wide=WIDE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(remove_leaks(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, drops_space=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Trained trees and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
