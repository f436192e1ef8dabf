"""The pipeline on a small table against plain versions of its stages."""

import __spark_entry__
import corpus_pipeline
from sparkfeat.llm import decontaminate, language_id, near_join, packing
from sparkfeat.llm.common import tokenizer_path

from .test_near_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_run_keeps_what_plain_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    rejected = {r.doc_id for r in language_id.predict(docs, model).where("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    kept = {d for d, c, _, _ in brute(rows) if d == c}
    leaks = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == kept - leaks
    at = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * 1024 + p.offset == at and len(p.ids) == 4 * p.length
        at += p.length


def test_stages_handle_edge_cases(spark, edge, none):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs, SF).count() > 0, name
        assert stage(spark, docs.where("1 = 0"), SF).count() == 0, name


def test_packing_of_edge_cases_and_a_run_on_nothing(spark, edge, none, tmp_path):
    name, pack = corpus_pipeline.STAGES[-1]
    pieces = pack(spark, edge, SF).collect()
    assert sum(p.start == 0 for p in pieces) == edge.count() and {p.offset + p.length for p in pieces} <= set(range(1025))
    assert pack(spark, none, SF).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("1 = 0").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_send_small_batches(spark, docs):
    """A batch is held several times over, beside the tables of its worker."""
    for stage in (lambda: near_join.near_classes(docs.limit(20)), lambda: packing.pack(docs.limit(20), tokenizer_path())):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        stage()
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
