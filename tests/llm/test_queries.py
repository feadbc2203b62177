import importlib
import os

import pytest

from tests.oracle import SF_DIR, same
from tracewell.llm import queries

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@needs_data
def test_pipeline_keeps_what_each_stage_should(spark):
    """Each stage against its operator's own definition, on the small tables."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen, now = [], docs
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, SF_DIR).persist()
        seen.append((name, now))
    assert [n for n, _ in seen] == ["toxicity", "simhash_dedup", "suffix_dedup", "decontaminate", "mix"]
    assert all(d.columns == docs.columns for _, d in seen[:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for _, d in seen]
    assert ids[0] >= ids[1] == ids[2] >= ids[3] == ids[4]
    text = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in seen[:-1]}
    seen_strings: set = set()
    for i in sorted(text["simhash_dedup"]):
        raw = text["simhash_dedup"][i].encode()
        own = {raw[k : k + 50] for k in range(len(raw) - 49)}
        if not own & seen_strings:
            assert text["suffix_dedup"][i] == text["simhash_dedup"][i]
        else:
            assert len(text["suffix_dedup"][i]) < len(text["simhash_dedup"][i])
        seen_strings |= own


def test_pipeline_on_an_empty_table(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
