"""documents -> an accepted, deduplicated, redacted, mixed and tokenized corpus, in stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again
as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, mixing, pieces, quality, queries, secrets
from tidemark.llm.common import kept, stages_dropped, table


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike to 80 percent in their 5-word shingles (and what they lead to), one stays."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks that tell live-looking ones from examples; no document goes."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, are cut or go so that each source comes near its target."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, exact: ids by streaming Viterbi, decoded again to see that they're whole."""
    return pieces.encode_documents(docs, queries.MODEL).withColumnRenamed("id", "doc_id")


STAGES = [("accept", accept), ("deduplicate", deduplicate), ("redact", redact), ("mix", mix), ("encode", encode)]
#: Classifier, hashes and segmentation can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. What a stage writes on its way goes when it ends; of the
    stages' own results only the one that the last stage reads stays."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        if n == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with stages_dropped(spark):
            docs = kept(stage(spark, docs, sf_dir))
