"""The whole pipeline on the smallest tables against a plain version of its stages."""

import pytest

import brute
import corpus_pipeline
from tableworks.llm import order_minhash
from tableworks.llm.batches import map_texts, utf8
from tableworks.llm.pii import personal_data
from tableworks.llm.quality_rules import quality_rules
from tableworks.llm.words import encode, tokenizer_path, word_ids

FOLDER = "/root/testdata/sf0.001"


def _redact(text, spans):
    found = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -end)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def expected(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept.isdisjoint(d for d, t in texts.items() if brute.base_quality(t)[-1])
    last = {texts[d]: d for d in sorted(kept)}  # the largest identifier of each text
    ids = sorted(last.values())
    grams = [order_minhash.kmers(order_minhash.word_codes(texts[d])) for d in ids]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if order_minhash.aligned(grams[i], grams[j]) >= 0.8]
    label = brute.classes(ids, links)
    stay = [d for n, d in enumerate(ids) if label[n] == n]
    some = spark.createDataFrame([(d, texts[d]) for d in stay], "doc_id long, text string")
    return {r.doc_id: _redact(texts[r.doc_id], r.spans) for r in personal_data(some).collect()}


def test_pipeline(spark, expected):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    path = tokenizer_path()
    assert lengths == {d: len(encode(path, t.encode())) // 4 + 1 for d, t in expected.items()}


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_workers_forget_the_words_of_another_stage(spark):
    path = tokenizer_path()
    docs = spark.range(64, numPartitions=8).selectExpr("concat('word', id, ' and more') as text")

    def fill(batch):
        return {"n": [len(encode(path, t)) for t in utf8(batch, "text")]}

    def held(batch):
        return {"n": [word_ids.cache_info().currsize] * batch.num_rows}

    assert map_texts(docs, fill, "n long").agg({"n": "min"}).first()[0] > 0
    # the workers of the first stage are used again; their memos take memory beside the executor's heap
    assert map_texts(docs, held, "n long").agg({"n": "max"}).first()[0] == 0
