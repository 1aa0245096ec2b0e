"""The pipeline and the registered queries of the subpackage."""

import os
import sys

import duckdb
import pytest
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check_oracles import normal  # noqa: E402

import __spark_entry__ as entry
import corpus_pipeline
from veriframe.llm import catalog, decontaminate, language_id, secret_scan, simhash_dedup
from veriframe.sources.tables import read_table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    # The checking SQL of op11 lists every string of 400 bytes: the smallest scale is enough here.
    folder = "/root/testdata/sf0.001" if name.startswith("op11_") else SF
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = entry.queries()[name](spark, folder)
    result = con.execute(entry.oracle_sql()[name])
    left = normal(frame.columns, [tuple(r) for r in frame.collect()])
    assert left == normal([d[0] for d in result.description], result.fetchall())


def test_all_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages_take_effect(spark):
    docs = read_table(spark, SF, "documents")
    clean = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clean, SF)
        assert out.columns == docs.columns, name
        path = corpus_pipeline.scratch_path(spark, "test")
        out.write.parquet(path)
        clean = spark.read.parquet(path)
    kept = {r.doc_id: r.text for r in clean.collect()}
    groups = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).collect()}
    assert len({groups[i] for i in kept}) == len(kept)
    assert decontaminate.passages(clean, read_table(spark, SF, "benchmark")).collect() == []
    assert secret_scan.find_secrets(clean).where("n_assign + n_access + n_hex > 0").collect() == []
    leaks = {r.doc_id for r in decontaminate.passages(docs, read_table(spark, SF, "benchmark")).collect()}
    und = {r.doc_id for r in language_id.identify(docs).where("lang_pred = 'und'").collect()}
    assert set(kept) == {i for i, c in groups.items() if i == c} - leaks - und
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == set(kept)
    assert sorted({p.sequence_id for p in pieces}) == list(range(1 + max(p.sequence_id for p in pieces)))


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, before long"
    odd = [(1, None, None, None, None, None, None), (1, "", "en", "s", 0, 1.0, 1), (2, "the cat and the dog", "en", "s", 19, 1.0, 1), (None, "the cat", None, None, 7, 1.0, 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            path = corpus_pipeline.scratch_path(spark, "test")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} == ({2} if rows else set())
