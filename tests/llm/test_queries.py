"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from seamark.llm.common import read
from seamark.llm.sql import SQL
from tests import oracle
from tests.conftest import SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert oracle.difference(entry.queries()[name](spark, SMALL), duck, SQL[name]) is None


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name,least", [("op1_pii", 200), ("op2_secrets", 200), ("op6_toxicity", 200), ("op7_url_filter", 50), ("op10_quality", 200), ("op11_language_id", 200)])
def test_query_without_sql(spark, name, least):
    assert entry.queries()[name](spark, SMALL).count() == least


def test_pipeline_stages(spark):
    docs = read(spark, SMALL, "documents").withColumn("_gone", F.lit(1)).withColumn("size", F.lit("s")).unionByName(
        spark.createDataFrame([(10_001, None, "en", None, None), (10_002, "", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumn(
            "_gone", F.lit(1)).withColumn("size", F.lit("s"))).cache()
    state = {"docs": docs}
    labels = {r.doc_id: r.quality for r in read(spark, SMALL, "labels").collect()}
    items = [tuple(r) for r in read(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = state["docs"].collect()
        after = stage(spark, state["docs"], SMALL)
        rows = after.collect()
        kept = {r.doc_id for r in rows}
        if name == "quality classifier":
            assert sum(labels.get(r.doc_id) == 1 and r.doc_id not in kept for r in before) <= 2
        elif name == "near-duplicate removal":
            sets = [brute.shingles(r.text, 5) for r in before]
            part = brute.components(sets, brute.similar)
            assert kept == {min(before[k].doc_id for k in range(len(before)) if part[k] == root) for root in set(part)}
        elif name == "benchmark decontamination":
            assert kept == {r.doc_id for r in before if not brute.contamination(r.text, items)[3]}
        elif name == "secret scan":
            assert kept == {r.doc_id for r in before} and not any(brute.secret_spans(r.text) for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows if r.text and r.n_chars is not None)
        else:
            assert kept == {r.doc_id for r in before} and set(after.columns) >= {"doc_id", "size", "source_size", "target", "taken"}
            break
        assert after.columns == docs.columns
        state["docs"] = spark.createDataFrame(rows, docs.schema)
