"""From raw documents to encoded training text: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of ``documents``. ``run`` writes each stage's result to the shared
folder and reads it again, so no stage repeats another's work when an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontaminate, neardup, pii, quality, treebpe
from emberline.llm.common import cut, table
from emberline.operators.common import cuts_made, drop_cuts
from emberline.llm.queries import tokenizer_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of every group of near duplicates (five words, similarity 0.8 or more) the document with the least id stays."""
    return neardup.keep_one(docs, percent=80, width=5)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data is replaced by its kind in brackets."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the number of ids, and the digests of ids and decoded text."""
    return treebpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", good), ("near_duplicates", one_of_each), ("decontamination", uncontaminated), ("personal_data", without_personal_data), ("bpe", encoded)]

#: A fitted classifier and a byte-pair encoding have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way goes once its result is written."""
    docs, mark = table(spark, sf_dir, "documents"), cuts_made()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        drop_cuts(spark, mark)
    return docs
