import sys
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from fieldgauge.llm import language_id, quality, queries

sys.path.insert(0, str(Path(__file__).parent))
import test_decontamination
import test_near_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append((name, docs.columns, {r["doc_id"]: r for r in docs.collect()}))
    return out


def test_stages_do_what_their_operators_say(spark, outputs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_report(table).where("kept").collect()}
    assert set(outputs[0][2]) == kept and len(kept) > 100
    good = table.where(F.col("doc_id").isin(list(kept)))
    judged = language_id.classify(good, language_id.train(good), {"doc_id": F.col("doc_id")})
    known = {r.doc_id for r in judged.where("lang_pred <> 'und' AND score >= 0.5").select("row.doc_id").collect()}
    assert set(outputs[1][2]) == known
    classes = test_near_dedup.brute([(i, r["text"]) for i, r in outputs[1][2].items()])
    assert set(outputs[2][2]) == {i for i, c in classes.items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = test_decontamination.brute([(i, r["text"]) for i, r in outputs[2][2].items()], items)
    assert set(outputs[3][2]) == {i for i, n, hit, _ in found if not (hit and 20 * hit >= n)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in outputs[4][2].items():
        assert list(r["token_ids"]) == library.encode(outputs[3][2][i]["text"]) and r["exact"]
    assert set(outputs[4][2]) == set(outputs[3][2])


def test_columns_stay_until_the_last_stage(spark, outputs):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(found == columns for _, found, _ in outputs[:-1])


def test_run_writes_every_stage_and_takes_awkward_tables(spark, tmp_path, documents, empty):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, rows in (("rows", documents), ("empty", empty), ("unlabelled", documents.withColumn("lang", F.lit(None).cast("string")))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "exact"]
        found = {r.doc_id for r in out.collect()}
        # Of these only the German text is prose that does not repeat itself; it has no id.
        assert found == (set() if name == "empty" else {None}), (name, found)


def test_the_native_queries_have_no_python(spark):
    for name in ("op1_decontamination", "op10_quality_rules"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert operator not in plan
