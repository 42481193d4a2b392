"""Training-corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but the last keep the columns of documents,
whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bestfit, bytecnn, simhash, subword
from tallgrass.llm.common import held_out, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below 0.5; it learns from the labels of rows that are not held out.

    Null and empty texts get the classifier's bias as score, whatever else their row holds. With no label at all every document scores 0.5 and stays. Repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return subword.keep_good(docs, labels)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: texts that are null or have no letter, and those of which no language has more than half of the network's softmax.

    The network learns from the languages of rows that are not held out. A document without a language gets the one that was told. Where nothing can be learned, as no row has a language and a text with a letter, every document stays.
    """
    return bytecnn.keep_identified(docs, docs.where(~held_out(F.col("doc_id"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles with a Jaccard similarity of 0.8 at least, and chains of such), the one with the smallest id (null last; ties by a hash of the text).

    Texts without words, null among them, are one group. Of rows equal in id and text one stays.
    """
    return simhash.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; every row is packed, those with null ids, null texts (an end mark alone) and null sources too."""
    return bestfit.pack_documents(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]

#: The stages learn models and fingerprint texts, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
