"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tableworks.llm.exact_dedup import exact_duplicates
from tableworks.llm.html_text import main_text
from tableworks.llm.license_scan import license_scan
from tableworks.llm.merge_dropout import decoded, dropout_digest, encoded
from tableworks.llm.near_dedup import near_duplicates
from tableworks.llm.packing import pack_documents
from tableworks.llm.pii import personal_data, redacted
from tableworks.llm.quality_model import quality_scores
from tableworks.llm.quality_rules import good_documents, quality_rules
from tableworks.llm.token_counts import token_counts

LONG = " ".join(f"word{i % 9973} runs on" for i in range(12_000))
ROWS = [
    (1, "plain words of a short text"), (2, None), (3, ""), (4, " \n\t "), (None, "an orphan text"), (None, None),
    (5, "plain words of a short text"), (1, "plain words of a short text"), (6, LONG), (7, "x" * 60_000),
    (8, "1" * 20_000), (9, "日本語 😀 é a"),
]
#: Names that operators and stages use inside.
NAMES = """kept row class _spans key label lang source n_chars held_out _part _at _n _base _more _found_email _gaps_ip
_id _mark at id mark kept_id n sha bytes check run best size _above text_md5 text_sha256 same codes keys node open
piece start length offset sequence_id ids_crc32 probability score spans a b _row digest shard slot""".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(F.lit("z").alias(n) for n in NAMES)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 0, 1), (6, 1, 0), (7, 0, 0), (9, 1, 0), (None, 1, 1), (4, None, 0), (1, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality_rules": lambda d, l: quality_rules(d, l),
    "near_duplicates": lambda d, l: near_duplicates(d),
    "license_scan": lambda d, l: license_scan(d),
    "exact_duplicates": lambda d, l: exact_duplicates(d),
    "quality_scores": lambda d, l: quality_scores(d, l),
    "personal_data": lambda d, l: personal_data(d),
    "dropout_digest": lambda d, l: dropout_digest(d),
    "token_counts": lambda d, l: token_counts(d),
    "main_text": lambda d, l: main_text(d, "doc_id", "source", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(docs, labels, name):
    got = sorted((r[0] is None, r[0] or 0) for r in OPERATORS[name](docs, labels).collect())
    assert got == sorted((i is None, i or 0) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    empty = docs.limit(0)
    assert OPERATORS[name](empty, labels).count() == 0


def test_no_labels(docs, labels):
    none = labels.limit(0)
    assert {r.score for r in quality_scores(docs, none).collect()} == {1.0}
    rules = quality_rules(docs, none).collect()
    assert all(r.kept != r.base_failed and r.probability == 1.0 for r in rules)


def test_packing_cases(docs):
    rows = pack_documents(docs).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert [x.length for x in pieces[2]] == [1] and [x.length for x in pieces[3]] == [1]
    assert sum(x.piece == 0 for x in rows) == len(ROWS)
    assert pack_documents(docs.limit(0)).count() == 0


def test_near_cases(docs):
    got = near_duplicates(docs).collect()
    same = [r for r in got if r.class_id == 1]
    assert len(same) == 3 and sum(r.kept for r in same) == 1 and {r.class_size for r in same} == {3}
    assert all(r.kept and r.class_size == 1 for r in got if r.doc_id in (2, 3, 4))


def test_exact_cases(docs):
    got = exact_duplicates(docs).collect()
    empty = [r for r in got if r.text_sha256.startswith("e3b0c442")]
    assert {r.keep_id for r in empty} == {3} and [r.doc_id for r in empty if r.kept] == [3]
    plain = [r for r in got if r.keep_id == 5]
    assert len(plain) == 3 and [r.doc_id for r in plain if r.kept] == [5]


def test_columns_stay(docs, labels):
    assert good_documents(docs, labels).schema == docs.schema
    assert redacted(docs).columns == docs.columns
    for df in (redacted(docs), good_documents(docs, labels)):
        assert all(r[n] == "z" for r in df.collect() for n in NAMES)
    assert good_documents(docs.limit(0), labels).count() == 0 and redacted(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert texts[2] is None and texts[3] == "" and texts[6] == LONG


def test_round_trip_of_cases(docs):
    texts = decoded(encoded(docs)).collect()
    want = sorted((i is None, i or 0, t or "") for i, t in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in texts) == want


def test_pipeline_stages_take_the_cases(spark, docs, labels, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    table = docs.withColumn("n_chars", F.length("text").cast("long"))
    table.write.parquet(f"{folder}/documents.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, table, folder), stage(spark, table.limit(0), folder)
        assert none.count() == 0
        if name != "packing":
            assert some.columns == table.columns and some.dtypes == table.dtypes
            assert all(r[n] == "z" for r in some.collect() for n in NAMES if n != "n_chars")
            assert stage(spark, table.drop("n_chars"), folder).columns == table.drop("n_chars").columns
    once = corpus_pipeline.exact_stage(spark, table, folder)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in once.collect()) == [
        (False, 3), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (False, 9), (True, 0)]
    near = corpus_pipeline.near_stage(spark, table, folder)
    assert sorted(r.doc_id for r in near.collect() if r.doc_id) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_clashing_names_of_other_tables(spark, docs):
    """Extra columns of any name change nothing in the operators on conversations, vectors and shards."""
    from tableworks.llm.conversation_repair import damaged, repair_report
    from tableworks.llm.hard_negatives import hard_negatives, quantised, shifted_labels
    from tableworks.llm.sharding import shard_documents

    names = "copies said part kind fault first here c no_c t no_t turns audit row block cell batch a w score found rank bests scores parcel shard slot law".split()
    extra = lambda df: df.select("*", *(F.lit("z").alias(n) for n in names if n not in df.columns))
    talks = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b"), (2, None, None, None)],
                                  "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([(i, [0.5, 0.1 * ((i * 7 + 3) % 5)], i % 2) for i in range(60)], "vec_id long, embedding array<float>, label int")
    rows = lambda df: sorted(map(str, df.collect()))
    for operator, table in ((lambda d: repair_report(damaged(d)), talks), (lambda d: hard_negatives(shifted_labels(quantised(d))), vectors)):
        got = rows(operator(extra(table)))
        assert got == rows(operator(table)) and got
    shards = shard_documents(docs.withColumn("parcel", F.lit(1)).withColumn("copies", F.lit("z")))
    assert shards.count() == len(ROWS) and len({r.shard for r in shards.filter("doc_id = 2 or doc_id = 3").collect()}) == 1
