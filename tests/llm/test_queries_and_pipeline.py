"""Registered queries against their SQL twins, and the pipeline against a plain version."""

import duckdb
import pytest
from brute import cut, leaks, measures, simhash_groups

import corpus_pipeline
from echoloom.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_rules", "simhash", "suffix_dedup", "decontamination", "bpe"]
    import __spark_entry__ as e
    assert {*queries.queries(), "pipeline"} <= set(e.queries()) and set(queries.oracles()) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(queries.oracles()[name])
    columns = [d[0] for d in rel.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_pipeline_equals_plain_version(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [d for d in docs if not measures(d[1])[5]]
    docs = [d for d, c in zip(docs, simhash_groups(docs)[1], strict=True) if d[0] == c]
    docs = [(k, b.decode("utf-8", "ignore")) for k, (b, _, _) in cut(docs).items()]
    leaked = {k for k, _ in leaks(docs, items)}
    docs = [d for d in docs if d[0] not in leaked]
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in docs}
