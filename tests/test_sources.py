"""Readers and writers on real files."""

import json

import pytest
from pyspark.errors import AnalysisException

from suite import sources as suite_sources
from tableworks.operators import cleaning, profiling
from tableworks.plans import questions, runs
from tableworks.sources import readers, sinks
from tableworks.streaming import run_logs


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_missing_table(spark, tmp_path):
    assert readers.load_if_present(spark, str(tmp_path), "table_0001") is None
    with pytest.raises(AnalysisException):
        readers.load(spark, str(tmp_path), "table_0001")
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path), "table_0001", "cooked")


def test_corpus_of_files(spark, tmp_path):
    put(tmp_path / "a" / "data.csv", 'Entity,Year,"Price, total",\n"Côte, d",2001,1.5,x\nB,NA,"2 ""q""",\n\nC,2003,3,z\n')
    put(tmp_path / "b" / "data.csv", "Name,v,v\nÉire,1,2\n", "latin-1")
    put(tmp_path / "b" / "zzz.csv", "other\n1\n")
    rows, headers = readers.read_corpus(spark, str(tmp_path))
    assert {r.table_id: r.columns for r in headers.collect()} == {
        "a": ["Entity", "Year", "Price, total", "Unnamed: 3"], "b": ["Name", "v", "v.1"]}
    got = [(r.table_id, r.cells) for r in rows.orderBy("table_id", "pos").collect()]
    assert got == [("a", ["Côte, d", "2001", "1.5", "x"]), ("a", ["B", None, '2 "q"', None]),
                   ("a", ["C", "2003", "3", "z"]), ("b", ["Éire", "1", "2"])]
    kinds = {(r.table_id, r.column_name): r.dtype for r in profiling.column_profile(rows, headers).collect()}
    assert kinds["a", "Year"] == "float64" and kinds["b", "v"] == "int64" and kinds["a", "Entity"] == "object"


def test_scan_and_structure(spark, tmp_path):
    wide = "a,b,c\n1,2,3\n"
    for name, manifest, csv in [
        ("good", '{"title": "Good"}', wide), ("narrow", '{"title": "N"}', "a,b\n1,2\n"),
        ("list", "[1]", wide), ("ragged", "{}", "a,b,c\n1,2,3,4\n"), ("nocsv", "{}", None), ("nomanifest", None, wide),
    ]:
        if manifest:
            put(tmp_path / name / "datapackage.json", manifest)
        if csv:
            put(tmp_path / name / "t.csv", csv)
    root = str(tmp_path)
    assert [r.dataset for r in readers.scan_datasets(spark, root).collect()] == ["good", "list", "narrow", "ragged"]
    assert readers.scan_datasets(spark, root, max_mb=1e-5).count() == 0
    assert {r.dataset: r.reason for r in readers.check_structure(spark, root).collect()} == {
        "good": None, "narrow": "too few columns", "list": "manifest is not an object",
        "ragged": "first rows do not fit the header"}
    assert {r.dataset: r.title for r in readers.manifests(spark, root).collect()}["good"] == "Good"


def test_csv_inference(spark, tmp_path):
    put(tmp_path / "t.csv", "k,n,x,m\na,1,1.5,\nNA,2,,n/a\nc,3,2,\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"k": "string", "n": "bigint", "x": "double", "m": "double", "_pos": "array<bigint>"}
    assert [r.k for r in df.orderBy("_pos").collect()] == ["a", None, "c"]


def question(i, **fields):
    record = {"question_id": f"question_{i:03d}", "question": "How many?", "table_refs": ["table_0001"],
              "answer": 5, "answer_type": "numerical", "domain": "health", "reasoning_type": "aggregation",
              "table_number": 1, "reasoning_steps": ["a", "b"], "answerable": True,
              "complexity_metrics": {"rows_involved": 10, "columns_involved": 2, "steps_count": 2,
                                     "complexity_score": 2.4}}
    return json.dumps({**record, **fields}, indent=1)


def test_questions(spark, tmp_path):
    put(tmp_path / "single_table" / "question_001.json", question(1))
    put(tmp_path / "multi_table" / "x" / "question_002.json", question(2, answer=["a", "b"], table_number=2))
    put(tmp_path / "multi_table" / "question_001.json", question(1, domain="general"))
    put(tmp_path / "distractor_bank" / "question_003.json", question(3, answer_type="guess", complexity_metrics={
        "rows_involved": 1, "columns_involved": 1, "steps_count": 2, "complexity_score": 9.0}))
    put(tmp_path / "single_table" / "question_004.json", "{ broken")
    df = readers.read_questions(spark, str(tmp_path))
    assert sorted((r.number, r.subset) for r in df.collect()) == [
        (1, "multi_table"), (1, "single_table"), (2, "multi_table"), (3, "distractor_bank")]
    broken = {(r.question_id, r.rule) for r in questions.violations(df).collect()}
    assert broken == {("question_002", "table_number"), ("question_003", "answer_type"),
                      ("question_003", "complexity_score")}
    specs = spark.createDataFrame([(0, "l", "9, 3-1"), (1, "l", "2,x,5-"), (2, "l", "1")], "o int, l string, s string")
    ids = questions.expand_ids(specs, "l", "s", "o")
    assert [r.id for r in ids.orderBy("rank").collect()] == [9, 1, 2, 3]
    picked = questions.pick_custom(ids, df).orderBy("rank").collect()
    assert [(r.id, r.subset) for r in picked] == [(1, "single_table"), (2, "multi_table"), (3, "distractor_bank")]
    assert questions.select_subset(df, "all").count() == 4
    with pytest.raises(ValueError):
        questions.select_subset(df, "none")


def record(i, *decisions):
    step = {"content": "plan", "status": "SUCCESS", "error": None, "guidance": None, "result": {"rows": 1}}
    return {"question_id": f"question_{i:03d}", "question": "q", "golden_answer": "1", "runs": [
        {"steps": [step, {**step, "status": "FAILED", "error": "EXEC_ERROR"}] * n, "llm_answer": "1" if d else None,
         "llm_valid": {"decision": d, "time_s": 0.5 * n, "retried": False, "error": None}}
        for n, d in enumerate(decisions)]}


def test_result_logs(spark, tmp_path):
    put(tmp_path / "m1" / "question_001.jsonl", json.dumps(record(1, True, True), indent=2))
    put(tmp_path / "m1" / "question_002.jsonl",
        json.dumps(record(2, True, False)) + "\n{bad\n" + json.dumps(record(2, None)) + "\n")
    put(tmp_path / "m2" / "question_003.jsonl", "{bad first\n" + json.dumps(record(3, None, None)))
    put(tmp_path / "m2" / "question_004.jsonl", "")
    put(tmp_path / "m2" / "notes.jsonl", "{}")
    logs = readers.read_result_logs(spark, str(tmp_path))
    flat = runs.flatten(logs)
    assert flat.count() == 7 and {r.source_dir for r in flat.collect()} == {"m1", "m2"}
    kinds = {r.question_id: r.kind for r in runs.consistency_by_question(flat).collect()}
    assert kinds == {"question_001": "all_success", "question_002": "mixed", "question_003": "all_null"}
    first = flat.filter("question_id = 'question_001'").orderBy("run_index").collect()
    assert first[0].status is None and first[1].status == "FAILED" and first[1].error_code == "EXEC_ERROR"
    steps = runs.explode_steps(flat)
    assert json.loads(steps.first().result) == {"rows": 1}


def test_question_logs_share_files(spark, tmp_path):
    """As many logs as questions, however few files."""
    path = str(tmp_path / "logs")
    source = spark.read.json(spark.sparkContext.parallelize(
        [json.dumps(record(i % 60, True, False)) for i in range(120)], 2), schema=readers.schemas.RECORD)
    sinks.write_question_logs(source.selectExpr("question_id", "question_id as record", "runs"), path)
    assert len(list((tmp_path / "logs").glob("*.parquet"))) <= 8
    files = readers.packed_logs(spark, path)
    schema = "record STRING, runs ARRAY<STRUCT<" + readers.schemas.RUN + ">>"
    for logs in (readers.result_logs(files, schema), readers.log_lines(files, schema)):
        flat = runs.flatten(logs)
        assert flat.count() == 240
        assert {(r.source_dir, r.record) for r in flat.collect()} == {
            (f"question_id=question_{i:03d}", f"question_{i:03d}") for i in range(60)}


def test_stream_reads_each_record_once(spark, tmp_path):
    log, out, progress = (str(tmp_path / n) for n in ("log", "out", "progress"))
    source = spark.read.json(spark.sparkContext.parallelize([json.dumps(record(1, True, False))]), schema=readers.schemas.RECORD)
    for _ in range(2):
        sinks.append_records(source, log)
        run_logs.follow(spark, log, out, progress).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_bundle_report_at_the_cap(spark, monkeypatch):
    """The report counts what the cap takes away; the smallest tables lie below the cap of the query."""
    monkeypatch.setattr(suite_sources, "CAPPED", cleaning.Policy(max_rows=100))
    got = {r.title: (r.row_count, r.final_rows, r.rows_removed)
           for r in suite_sources.bundle_documents(spark, "/root/testdata/sf0.001").collect()}
    want = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in got}
    assert got == {t: (n, min(n, 100), n - min(n, 100)) for t, n in want.items()} and max(want.values()) > 100


def test_bundle_and_ids(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    meta = df.selectExpr("'T' as title", "1L as row_count")
    sinks.write_bundle(base, "table_0007", df, raw=df.union(df), meta=meta)
    assert readers.load(spark, base, "table_0007", "raw").count() == 2
    assert [r.table_id for r in readers.existing_tables(spark, base).collect()] == ["table_0007"]
    found = readers.read_documents(spark, f"{base}/*/meta.json", readers.schemas.META).first()
    assert (found.table_id, found.title, found.row_count) == ("table_0007", "T", 1)
    names = spark.createDataFrame([("b",), ("a",)], "name string")
    assert {r.name: r.table_id for r in sinks.assign_ids(names, "name", 7).collect()} == {
        "a": "table_0008", "b": "table_0009"}


def test_a_stored_table_is_cut_by_its_bytes(spark, tmp_path):
    """Few rows of long texts next to many short rows are not one task and one file."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "512k")
    try:
        short = spark.range(20000).selectExpr("'a' as table_id", "id as pos", "array('x') as cells")
        long = spark.range(64).repartition(8).selectExpr("'b' as table_id", "id as pos", """array(array_join(transform(
            sequence(1, 1500), i -> sha2(concat(id, ':', i), 256)), '')) as cells""")
        sinks.write_corpus(f"{tmp_path}/corpus", short.union(long), spark.range(1))
    finally:
        spark.conf.unset(key)
    stored = spark.read.parquet(f"{tmp_path}/corpus/rows")
    assert {(r.table_id, r["count"]) for r in stored.groupBy("table_id").count().collect()} == {("a", 20000), ("b", 64)}
    files = stored.filter("table_id = 'b'").selectExpr("_metadata.file_path").distinct().count()
    assert 4 <= files <= 16
