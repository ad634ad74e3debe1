"""The pipeline's stages on small tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cairn.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, counts = Scratch(spark, "test"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.cut(stage(spark, docs, SF), name)
        assert after.dtypes == docs.dtypes
        assert after.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).select("doc_id").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_anti").isEmpty()
        docs = after
        counts.append(docs.count())
    assert counts[1] >= 0.99 * counts[0] and counts[2] < counts[1] and counts[3] < counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last if r.first_token == 0) == sorted(r.doc_id for r in docs.collect()) and all(r.crc_ok for r in last)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r.slot for r in rows}) == list(range(max(r.slot for r in rows) + 1))


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table_and_clashing_columns(spark, stage, tmp_path):
    function = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("x"), "fp": F.lit(1), "copies": F.lit(2)})
    for name, some in (("none", docs.limit(0)), ("few", docs.limit(20))):
        some.write.parquet(f"file://{tmp_path}/{name}")
        got = function(spark, spark.read.parquet(f"file://{tmp_path}/{name}"), SF)
        if stage != "token_output":
            assert got.columns == docs.columns and {r.score for r in got.collect()} <= {"x"}
        assert got.count() == 0 or name == "few"
