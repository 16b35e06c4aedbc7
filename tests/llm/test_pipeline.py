"""The stages on small tables, each held against what it must do with its own input."""

import re

import corpus_pipeline as p
from stopwise.llm import queries
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "suffix_dedup", "best_fit_packing"]


def test_each_stage_does_its_work_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in p.STAGES:
        docs = p.stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        if name == "toxicity":
            assert 0.85 * len(before) < len(rows) < len(before)
        elif name == "exact_dedup":
            keys = {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in before.values()}
            assert len(rows) == len(keys)
        elif name == "ngram_jaccard":
            found = components([(r.doc_id, r.text) for r in before.values()])
            assert {r.doc_id for r in rows} == {c for _, _, c in found}
        elif name == "suffix_dedup":
            found = repeats([(r.doc_id, r.text) for r in before.values()])
            assert {r.doc_id: r.text for r in rows} == {i: k.decode("utf-8", "ignore") for i, *_, k in found}
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            assert {r.doc_id for r in rows} == set(before)
            continue
        assert docs.columns == columns
        kept[name] = before = {r.doc_id: r for r in rows}


def test_odd_and_empty_documents_go_through(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for name, stage in p.STAGES:
            docs = p.stored(stage(spark, docs, SF), name)
            assert name == "best_fit_packing" or docs.columns == columns
        docs.collect()


def test_oracles_equal_queries(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        cursor = con.execute(sql)
        at = {d[0]: i for i, d in enumerate(cursor.description)}
        expected = [tuple(r[at[c]] for c in df.columns) for r in cursor.fetchall()]
        assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)
