"""From raw documents to packed sequences: quality, exact copies, near copies, personal data, packing.

Each stage works on all that its predecessor kept, written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableworks.llm.exact_dedup import exact_duplicates
from tableworks.llm.near_dedup import near_duplicates
from tableworks.llm.packing import pack_documents
from tableworks.llm.pii import redacted
from tableworks.llm.quality_rules import good_documents
from tableworks.session import configure, scratch_path


def _kept(docs: DataFrame, verdicts: DataFrame, mark: str, marked) -> DataFrame:
    """The rows of ``docs`` whose identifier and text were kept, each once.

    The columns of ``docs`` travel as a struct, so they may have any names.
    """
    keep = verdicts.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col(mark).alias("mark"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), marked(text).alias("at"),
                       F.col("doc_id").alias("id"))
    found = rows.join(keep, (rows["at"] == keep["mark"]) & rows["id"].eqNullSafe(keep["kept_id"]), "left_semi")
    one = Window.partitionBy("at", "id").orderBy("at")
    return found.withColumn("n", F.row_number().over(one)).filter("n = 1").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null, empty and short texts fail, other columns stay as they are."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the largest identifier; null counts as empty, other columns stay."""
    return _kept(docs, exact_duplicates(docs), "text_sha256", lambda t: F.sha2(t, 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; texts without a word are a class each, other columns stay."""
    return _kept(docs, near_duplicates(docs), "text_md5", F.md5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars``, where there is one, follows the text.

    Null and empty texts stay, other columns too.
    """
    clean = redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; null and empty texts are one piece with the end token."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Models and tokenizers have no SQL; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
