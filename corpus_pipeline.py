"""The corpus pipeline: documents without the toxic ones, one of each near-duplicate group, without words that an earlier
document has in 13-word windows, with surrogates for personal data, packed into sequences.

Every stage is written as Parquet in the shared folder and read again by the next; it works on all rows its predecessor
kept. All but the last return the columns of documents (n_chars follows the text). Part of the training-data operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, packing, pii, substring, toxicity
from tessera.llm.common import materialize, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring.remove_earlier(docs))


def put_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.rewrite(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substring", drop_repeated_spans),
    ("pii", put_surrogates),
    ("packing", pack),
]
#: The stages train a classifier, hash and tokenise: SQL can't express them. tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
