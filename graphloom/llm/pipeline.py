"""The corpus pipeline: toxicity, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. A stage's models and statistics come from its own input and the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import near_dedup, packing, pii, quality, toxicity
from graphloom.llm.common import scratch_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose score reaches their language's threshold go. Rows with null doc_id are scored like others."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return toxicity.filtered(docs, model, lambda score: ~toxicity.rejects(model, lang, score))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a score below the threshold go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.filtered(docs, model, lambda score: score >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each class of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every span found is replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the remaining documents in sequences of at most 4096 ids."""
    import public_tokenizers as public

    return packing.packed(docs, public.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: Classifiers and sampling have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
