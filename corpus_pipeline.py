"""A corpus pipeline: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontam, langid, neardup, packing, secrets
from tarn.llm.names import columns_of
from tarn.sources.scratch import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or is further from every language's codeword than labelled texts are.

    Labels of held-out documents are not learned from; without any label only
    the letters count.  Repeated rows and rows of null ids are judged like others,
    columns of any name and null in any of them stay; an empty table stays empty.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.identify(docs, model)
    lang = found.columns[-1]
    return found.where((F.col(f"{lang}.lang") != langid.UNKNOWN) & (F.col(f"{lang}.distance") <= model.limit)).select(*columns_of(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays, of the least doc_id (null last).

    Rows of null text are classes of their own and stay; of empty or wordless
    texts and of repeated rows one stays.  Columns of any name pass.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go.

    Null and empty texts stay as they are; without items all rows do.  Repeated
    rows stay, each cut alike; columns of any name pass.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; all rows stay, null texts as they are, columns of any name pass."""
    found = secrets.scan_secrets(docs)
    return found.withColumn("text", secrets.redact(found["text"], found[found.columns[-1]])).select(*columns_of(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens.

    Null and empty texts are a piece of the end mark alone, repeated rows and null
    ids are packed each; other columns are not read; an empty table gives no row.
    """
    return packing.packed(docs)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The stages train models, sample hashes and tokenise, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; the pieces of what is left, packed.  An empty table gives no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
