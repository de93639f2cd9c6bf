"""Quality rules, near-duplicate join, secret scan, mixing and packing over the documents table.

Each stage takes all that its predecessor kept, written as Parquet and read again. The first four return the columns of documents: documents
that the rules reject go, one document of each group of near copies stays, secrets are masked, and documents are repeated or left out as
the mix takes them. The last returns packed pieces.

Defined results: null and empty texts are rejected by the first stage; rows without an id are never near copies of others; null sources are
a source; an empty table gives no rows; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard_join, mixing, packing, quality_rules, secrets
from tessera.llm.common import stored, table
from tessera.llm.token_counts import vocabulary

#: Near copies, as the stage takes them: five-word shingles and a similarity of 80 %.
SHINGLE, THRESHOLD = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, SHINGLE, THRESHOLD)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, vocabulary(path), public_tokenizers.PATTERN, special=packing.added_tokens(path))


STAGES = [("quality_rules", quality_stage), ("jaccard_join", near_copies_stage), ("secret_scan", secrets_stage), ("cube_mixing", mixing_stage), ("vector_packing", packing_stage)]

#: Mixing, and the forest of the secret scan, can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
