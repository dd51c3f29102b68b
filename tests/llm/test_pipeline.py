import re

import corpus_pipeline
from litspark.llm import quality
from litspark.llm.common import table
from tests.llm.test_dedup import _brute, _norm
from tests.llm.test_text_ops import _contaminated
from tests.conftest import SF_SMALL
from tests.llm.conftest import EDGE


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF_SMALL, "documents")
    columns, left = docs.columns, None
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        model = quality.fit(docs, table(spark, SF_SMALL, "labels")) if name == "quality" else None
        if name == "quality":
            want = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.5}
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[_norm(t)] = min(best.get(_norm(t), (1, 0)), (-len(t), i))
            want = {i for _, i in best.values()}
        elif name == "near_dedup":
            want = {i for i, _, c in _brute(before) if i == c}
        elif name == "decontaminate":
            want = {i for i, _, hit, _ in _contaminated(before, items) if not hit}
        else:
            want = {i for i, _ in before}
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left == want, name
    assert left


def test_stages_with_null_empty_and_clashing_input(spark, edge, none, benchmark, tmp_path):
    """Every stage on rows with nulls, empty, repeated and very long texts beside
    columns that the operators use themselves, and on a table without rows."""
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (8, 1, 0), (11, 0, 1), (None, 1, None), (12, None, 1), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, str(tmp_path))
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, _ in EDGE}
        else:
            assert out.dtypes == edge.dtypes
            rows = [(r.doc_id, r.text) for r in out.collect()]
            assert set(rows) <= set(EDGE) and rows


def test_run_gives_the_pieces_of_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert re.match("doc_id", out.columns[0]) and out.count() > 0


def test_entry_lists_the_operators():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(n) for n in range(1, 14)}
