import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, text(rng.randrange(20, 80)), "en", "s" if i % 3 else "hot", 1) for i in range(120)]
    passage = text(15)
    copy = rows[3][1]
    rows += [(200, copy, "en", "t", 1), (201, copy + " end", "en", None, 1), (202, rows[5][1] + " " + passage, "en", "t", 1), (203, None, None, None, None), (204, "", "en", "s", 0), (204, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = corpus_pipeline.F.lit("kept")
    spark.createDataFrame(rows, schema).withColumns({c: extra for c in ("score", "hits", "copies", "component_id", "text_")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert all(r.score == r.hits == r.copies == r.component_id == r.text_ == "kept" for r in out)
    assert set(range(120)) - {3} <= {*ids} and not {200, 201} & {*ids}
    assert len([i for i in ids if i == 202]) == 1 and not any(passage in (r.text or "") for r in out)
    assert {r.shard for r in out} == set(range(24))
    # without labels nothing is known of quality or domains, and no document goes for them
    bare = tmp_path / "bare"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{bare}/labels.parquet")
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k in (0, 3):
        assert corpus_pipeline.STAGES[k][1](spark, whole, str(bare)).count() == whole.count()
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
