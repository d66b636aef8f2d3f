"""Named queries on the smallest tables, against SQL where there is some, and the pipeline."""

from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from dockledger.llm import decontaminate, lines, packing, quality
from dockledger.llm.queries import QUERIES, SQL
from tests.parity import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    ok, note = compare(spark, duck(FOLDER), SimpleNamespace(build=QUERIES[name], sql=SQL[name]), FOLDER)
    assert ok, note


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op4_quality_rules", "op7_personal_data", "op11_chat_formatting"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert docs.columns == columns
            tables.append({r["doc_id"]: r for r in docs.collect()})
            assert len(tables[-1]) == docs.count()
    good, fresh, single, clean = tables
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = quality.quality_scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    assert set(good) == {r["doc_id"] for r in scores.where("predicted = 1").collect()}

    owner, want = {}, {}
    for doc in sorted(good):
        for line in (good[doc]["text"] or "").split("\n"):
            owner.setdefault(lines.line_key(line), doc)
    for doc, row in good.items():
        stay = [
            x for x in (row["text"] or "").split("\n")
            if lines.line_key(x) is None or owner[lines.line_key(x)] == doc
        ]
        want[doc] = "\n".join(stay)
    assert {d: r["text"] or "" for d, r in fresh.items()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for d, r in fresh.items() if want[d] != (good[d]["text"] or ""))

    assert set(single) <= set(fresh)
    sets = {d: shingles(r["text"]) for d, r in fresh.items()}
    for a in sets:
        alike = {b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in sets if b != a}
        if max(alike.values()) < 0.6:
            assert a in single
        if any(j >= 0.85 and b < a for b, j in alike.items()):
            assert a not in single

    items = [decontaminate.word_hashes(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for doc, row in single.items():
        words = decontaminate.word_hashes(row["text"] or "")
        held = any(
            decontaminate.best_alignment(item, words)[0] <= decontaminate.allowed(len(item)) for item in items
        )
        assert held == (doc not in clean)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths, fill = {}, {}
    for r in docs.collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048
    assert lengths == {
        d: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for d, r in clean.items()
    }
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_stages_hand_small_batches_to_python(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["rows"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name in ("decontamination", "packing"):
                spark.conf.set(key, 10_000)
                stage(spark, docs, FOLDER)
                rows = spark.range(3_500, numPartitions=1).mapInArrow(sizes, "rows long").collect()
                assert sum(r["rows"] for r in rows) == 3_500
                assert max(r["rows"] for r in rows) <= 1_000
        spark.conf.set(key, 7)
        corpus_pipeline.clean_of_benchmarks(spark, docs, FOLDER)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_block_size_changes_no_packed_piece(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    whole = packing.pack_documents(docs, tokenizer).collect()
    small = packing.pack_documents(docs, tokenizer, cached_words=100, block_bytes=2_000).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, whole))
