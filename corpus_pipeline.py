"""A training-data pipeline over `documents`: toxicity, near-duplicates, benchmark decontamination, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of `documents`; its result is written as
Parquet and read again as the next stage's docs, so a lost executor never costs more than the stage at work.

Defined results, of every stage and of run(): columns beyond doc_id, text, lang, source and n_chars come back as they were, whatever
their names; a null text, an empty one and one without words are not toxic, near nothing but an equal row, contaminated by nothing and
stay as they are; very long texts are read whole; a null doc_id counts as one value; rows alike in doc_id and text are one document
from near_duplicates on; ties go to the smallest doc_id; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tessera.llm import lsa, mixture, pii, simhash, toxicity
from tessera.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar finds toxic go; repeated rows are judged alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document of the smallest doc_id stays.

    Decisions meet the documents by a hash of doc_id and text (nulls included), the stage's one shuffle of texts. Rows alike in both
    are one document: where it stays, one of them does, the first by its other columns (as far as Spark can order them). The columns
    of docs travel inside one struct, so none of their names can clash with those made here.
    """
    judged = simhash.near_duplicates(docs)
    gone = judged.groupBy("row_key").agg(F.max("keep").alias("stays")).where("NOT stays").select(F.col("row_key").alias("key"))
    packed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = packed.join(gone, "key", "left_anti")
    order = [F.col("row").getField(f.name) for f in docs.schema if f.name not in ("doc_id", "text") and _sorts(f.dataType)]
    twins = Window.partitionBy("key").orderBy(*order, F.lit(0))
    return left.withColumn("n", F.row_number().over(twins)).where("n = 1").select("row.*")


def _sorts(kind: DataType) -> bool:
    """Whether values of the type have an order: maps and variants, and what holds them, have none."""
    if isinstance(kind, StructType):
        return all(_sorts(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _sorts(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go; null and wordless texts hold none."""
    return lsa.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets and n_chars renewed; every document stays, a null text stays null."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by the calibrated probabilities of their source, language and topic."""
    return mixture.sample(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("mixture", mix_sources),
]

#: The clause grammar, fingerprints and latent search are beyond SQL: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
