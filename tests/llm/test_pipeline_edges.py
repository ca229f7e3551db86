"""Every stage of the pipeline on empty tables, null and repeated rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: Names the operators use inside, or add.
CLASH = ("row", "size", "copies", "hash", "matches", "runs", "kept_text", "fingerprint", "Mix_Size")


def table(spark, extra=True):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(30)
    nulls = first.limit(3).withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns if c != "doc_id"})
    nameless = first.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    empty = first.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.lit("")})
    rows = first.unionByName(first.limit(4)).unionByName(nulls).unionByName(nameless).unionByName(empty)
    return rows.withColumns({c: F.lit(c) for c in CLASH}) if extra else rows


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_awkward_rows(spark, name):
    docs = table(spark).cache()
    out = STAGES[name](spark, docs, SF)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.columns == [*docs.columns, *(["mix_mix_size", "mix_mix_copies"] if last else [])]
    rows = out.collect()
    assert {r.row for r in rows} <= {"row"} and len(rows) <= docs.count()
    if last:
        assert len(rows) == docs.count()
    if name in ("line dedup", "benchmark decontamination"):
        assert any(r.text is None for r in rows) and any(r.text == "" for r in rows)


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_an_empty_table(spark, name):
    docs = table(spark, extra=False).limit(0)
    out = STAGES[name](spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and out.collect() == []
