"""Registered queries of this package, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableworks.llm.conversation_repair import damaged, repair_report
from tableworks.llm.exact_dedup import exact_duplicates
from tableworks.llm.hard_negatives import hard_negatives, quantised, shifted_labels
from tableworks.llm.html_text import main_text
from tableworks.llm.license_scan import license_scan
from tableworks.llm.merge_dropout import dropout_digest
from tableworks.llm.near_dedup import near_duplicates
from tableworks.llm.packing import pack_documents
from tableworks.llm.pii import personal_data
from tableworks.llm.quality_model import quality_scores
from tableworks.llm.quality_rules import quality_rules
from tableworks.llm.repair_sql import REPAIR
from tableworks.llm.sharding import shard_documents
from tableworks.llm.token_counts import token_counts
from tableworks.session import configure


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules on all documents, fitted on their labels."""
    return quality_rules(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(_read(spark, folder, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near copies among all documents."""
    return near_duplicates(_read(spark, folder, "documents"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences in all documents."""
    return license_scan(_read(spark, folder, "documents"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact_duplicates(_read(spark, folder, "documents"))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(_read(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_scores(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(_read(spark, folder, "documents"))


def op9_sentencepiece_dropout(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded with merge-dropout and decoded again."""
    return dropout_digest(_read(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all documents."""
    return token_counts(_read(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    return repair_report(damaged(_read(spark, folder, "conversations")))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all vectors."""
    return hard_negatives(shifted_labels(quantised(_read(spark, folder, "embeddings"))))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return shard_documents(_read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_html_extraction, op3_minhash_near_dedup, op4_license_scan, op5_exact_dedup,
    op6_best_fit_packing, op7_quality_classifier, op8_pii, op9_sentencepiece_dropout, op10_token_counts,
    op11_conversation_repair, op12_hard_negatives, op13_sharding)}

SQL = {
    "op5_exact_dedup": """
        select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, '')) as group_size,
               row_number() over (partition by coalesce(text, '') order by doc_id desc) = 1 as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents""",
    "op11_conversation_repair": REPAIR,
    "op12_hard_negatives": """
        with v as (
          select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)) as q
          from embeddings where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
          select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
          from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        p as (
          select anchor_id, vec_id as positive_id, score as positive_score from s where same
          qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select p.anchor_id, positive_id, (row_number() over (
            partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank,
          vec_id as negative_id, positive_score, score as negative_score
        from p join s on s.anchor_id = p.anchor_id and not same
          and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3""",
}
