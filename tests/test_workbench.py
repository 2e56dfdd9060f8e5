import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import store
from lodestone.service import NotFound, Workbench
from lodestone.session import Settings
from lodestone.streaming.sync import follow

SCHEMA = "document_id string, sha256 string, filename string, page int, line_no int, text string, x0 double, top double, x1 double, bottom double"


def lines(spark, sha="s1", first="Stem respiration reached 2.4 µmol CO2 m-2 s-1 in the oak plots."):
    texts = ["Methods", "The species was oak and the sample size was nine trees in all of the plots we saw.", first, "Soil moisture stayed the same over the whole season at this place."]
    return spark.createDataFrame([("doc", sha, "paper-2020.pdf", 1, i + 1, t, 10.0, 40.0 * i, 90.0, 40.0 * i + 10) for i, t in enumerate(texts)], SCHEMA)


def test_round(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path / "w"))
    with pytest.raises(FileNotFoundError):
        bench.sync(lines(spark).limit(0))
    spec = bench.interpret("提取树干呼吸的数据，必须报告物种和样本量，关注站点。")
    assert bench.current_spec() == spec
    assert bench.sync(lines(spark)) == {"parsed": 1, "reused": 0, "failed": 0}
    assert bench.sync(lines(spark)) == {"parsed": 0, "reused": 1, "failed": 0}
    over = bench.overviews().first()
    assert over.screening_status == "usable" and over.block_count == 4 and over.publication_year == 2020
    run = bench.retrieve("doc", "stem_respiration_rate", 2)
    hits = run["hits"]
    assert len(hits) == 2 and hits[0]["text"].startswith("Stem") and hits[0]["is_gold"] is False and run["total_blocks"] == 4 and run["elapsed_ms"] > 0
    assert set(hits[0]["score_components"]) == {"bm25", "vector_similarity", "term_coverage", "section_prior"} and "树干呼吸" in run["query"]
    # a run is found again as it was returned
    kept = bench.run(run["run_id"])
    assert kept["result"] == json.loads(json.dumps(run)) and kept["k"] == 2 and kept["total_blocks"] == 4 and kept["backend"] == "hashing"
    assert json.loads(kept["parameters_json"])["weights"] == {"bm25": 0.45, "vector_similarity": 0.35, "term_coverage": 0.15, "section_prior": 0.05}
    first = hits[0]["block_id"]
    bench.add_gold("doc", "stem_respiration_rate", first)
    bench.add_gold("doc", "stem_respiration_rate", first, note="again")
    gold = bench.gold().collect()
    assert len(gold) == 1 and gold[0].note == "again" and bench.retrieve("doc", "stem_respiration_rate", 1)["hits"][0]["is_gold"] is True
    with pytest.raises(NotFound):
        bench.add_gold("doc", "species", "nowhere")
    for missing in (lambda: bench.blocks("nobody"), lambda: bench.run("none"), lambda: bench.block("none"), lambda: bench.document_by_hash("none")):
        with pytest.raises(NotFound):
            missing()
    assert bench.document_by_hash("s1").document_id == "doc" and bench.block(first).ordinal == hits[0]["ordinal"]
    runs = bench.table("runs").orderBy("created_at").collect()
    assert sorted((r.cache_hits, r.cache_misses, r.cache_writes) for r in runs) == [(0, 4, 4), (4, 0, 0)]
    result = bench.evaluate((1, 3))
    assert result["metrics_at_k"]["1"] == {"hit_rate": 1.0, "recall": 1.0, "precision": 1.0} and result["mean_reciprocal_rank"] == 1.0
    assert result["coverage"]["cache_hits"] == 4 and result["coverage"]["blocks_scored"] == 4 and bench.latest_evaluation() == json.loads(json.dumps(result))
    query = result["per_query"][0]
    assert query["gold_block_ids"] == [first] and query["top_block_ids"][0] == first and len(query["top_block_ids"]) == 3 and query["metrics"]["3"]["precision"] == pytest.approx(1 / 3)
    assert result["per_field"][0]["metrics"]["1"] == {"hit": 1.0, "recall": 1.0, "precision": 1.0} and set(result["timing"]) == {"retrieval_elapsed_ms", "evaluation_elapsed_ms", "mean_query_ms"}
    assert bench.evaluate(())["per_query"][0]["top_block_ids"] == []
    items = {x["strategy"]: x for x in bench.compare("doc", "stem_respiration_rate", 3)["items"]}
    assert list(items) == ["bm25-only", "hashing-hybrid", "e5-hybrid"]
    assert items["bm25-only"]["metrics"]["first_gold_rank"] == 1 and items["e5-hybrid"]["status"] == "unavailable" and "needs sentence-transformers==" in items["e5-hybrid"]["error"]
    assert bench.run(items["hashing-hybrid"]["retrieval"]["run_id"])["result"]["parameters"]["comparison_strategy"] == "hashing-hybrid"
    assert bench.compare("doc", "species", 3)["items"][0]["metrics"] == {"gold_count": 0, "first_gold_rank": None, "hit_at_k": None, "recall_at_k": None, "reciprocal_rank": None}
    # gold that is taken away and added again has a new id
    bench.delete_gold(gold[0].gold_id)
    bench.delete_gold("none")
    assert bench.gold().count() == 0
    bench.add_gold("doc", "stem_respiration_rate", first, "draft")
    again = bench.gold(status="draft").collect()
    assert len(again) == 1 and again[0].gold_id != gold[0].gold_id and again[0].note == ""
    # a new text under the same name is parsed again: its gold goes, and only the changed block misses the cache
    assert bench.sync(lines(spark, "s2", "Another line about stem respiration that has no values but is long enough."))["parsed"] == 1
    assert bench.gold().count() == 0 and bench.overviews().first().screening_status != "failed"
    assert bench.health()["cached_vectors"] == 4
    assert bench.blocks("doc", "SOIL").count() == 1


def test_folder(spark, tmp_path):
    bench = Workbench(spark, Settings(str(tmp_path / "w"), source_directory=str(tmp_path / "in")))
    (tmp_path / "in").mkdir()
    with pytest.raises(FileNotFoundError):
        bench.sync_folder(pattern="*.txt")
    text = "Methods\n\nThe   species was oak, in 9 plots that we saw over the whole of a season.\nStem respiration reached 2.4 µmol CO2 m-2 s-1 in the oak plots."
    (tmp_path / "in" / "a paper-2019.txt").write_text(text)
    (tmp_path / "in" / "short.txt").write_text("too short")
    assert bench.sync_folder(pattern="*.txt") == {"parsed": 1, "reused": 0, "failed": 1}
    assert bench.sync_folder(pattern="*.txt") == {"parsed": 0, "reused": 2, "failed": 0}
    (tmp_path / "in" / "new.txt").write_text(text + "\nOne more line.")
    assert bench.sync_folder(pattern="*.txt") == {"parsed": 1, "reused": 2, "failed": 0}
    rows = {r.filename: r for r in bench.documents().collect()}
    assert list(rows) == ["a paper-2019.txt", "new.txt", "short.txt"] and rows["a paper-2019.txt"].publication_year == 2019 and rows["short.txt"].parser_status == "failed"
    # title and time of creation come from the reader, if it knows them
    told = lines(spark, "s9").withColumns({"title": F.lit("A title that was given"), "created": F.lit("2012-03-04"), "filename": F.lit("x.pdf"), "document_id": F.lit("told")})
    bench.sync(told)
    assert (bench.document("told").title, bench.document("told").publication_year) == ("A title that was given", 2012)


def test_changes_are_published_whole(spark, tmp_path):
    catalog = store.Catalog(spark, str(tmp_path / "c"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    read = lambda name: sorted(r.x for r in spark.read.schema("x int").parquet(*catalog.folders(name)).collect())
    catalog.publish({"a": rows(1), "b": rows(2)})
    catalog.publish(append={"a": rows(3)})
    before = catalog.state()
    with pytest.raises(Exception, match="stop"):  # fails while the second table is written: nothing of the change is seen
        catalog.publish({"a": rows(7), "b": rows(8).select(F.raise_error(F.lit("stop")).cast("int").alias("x"))})
    assert catalog.state() == before and read("a") == [1, 3] and read("b") == [2]
    late = store.Catalog(spark, str(tmp_path / "c"))
    stale = late.state()
    catalog.publish({"b": rows(9)})
    late.state = lambda: stale
    with pytest.raises(store.Conflict):
        late.publish({"b": rows(10)})
    assert read("b") == [9]
    catalog.MOST_PARTS = 2
    for x in (4, 5):
        catalog.publish(append={"a": rows(x)})
    assert read("a") == [1, 3, 4, 5] and len(catalog.folders("a")) == 2


def test_old_runs_have_defaults(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path / "w"))
    old = spark.createDataFrame([("r1", "d", "f", 3, '{"hits": []}', "2024-01-01")], "run_id string, document_id string, field_name string, k int, result_json string, created_at string")
    bench.catalog.publish(append={"runs": old})
    run = bench.run("r1")
    assert (run["backend"], run["parameters_json"], run["query_count"], run["cache_enabled"], run["result"]) == ("unknown", "{}", 1, False, {"hits": []})


def test_settings(tmp_path):
    settings = Settings.from_env("r", {"LODESTONE_BATCH_SIZE": "8", "LODESTONE_VECTOR_CACHE": " No ", "LODESTONE_DEVICE": "cuda ", "LODESTONE_ROOT": "elsewhere"})
    assert (settings.root, settings.batch_size, settings.vector_cache, settings.device, settings.encoder) == ("r", 8, False, "cuda", "hashing")
    assert Settings.from_env(environment={"LODESTONE_ROOT": "x"}).root == "x"
    for bad in ({"LODESTONE_BATCH_SIZE": "0"}, {"LODESTONE_BATCH_SIZE": "many"}, {"LODESTONE_LOCAL_FILES_ONLY": "perhaps"}):
        with pytest.raises(ValueError, match="LODESTONE_"):
            Settings.from_env("r", bad)
    with pytest.raises(ValueError):
        Settings.from_env(environment={})
    with pytest.raises(ValueError):
        Settings("r", batch_size=0)


def test_another_cache_can_be_plugged_in(spark, tmp_path):
    class Memory:
        held = []

        def rows(self):
            from lodestone.service import SCHEMAS

            return spark.createDataFrame(self.held, SCHEMAS["vectors"])

        def add(self, records):
            self.held += records.select(*self.rows().columns).collect()

    cache = Memory()
    bench = Workbench(spark, str(tmp_path / "w"), cache)
    bench.interpret("提取树干呼吸的数据，必须报告物种和样本量，关注站点。")
    bench.sync(lines(spark))
    assert bench.retrieve("doc", "species", 1)["cache"] == {"enabled": True, "hits": 0, "misses": 4, "writes": 4} and len(cache.held) == 4
    assert bench.retrieve("doc", "species", 1)["cache"]["hits"] == 4 and bench.table("vectors").isEmpty()
    cache.held[0] = cache.held[0].asDict() | {"block_id": "other"}
    cache.held = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in cache.held]
    with pytest.raises(Exception, match="other parts"):
        bench.retrieve("doc", "species", 1)


def test_stream(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path / "w"))
    bench.interpret("提取树干呼吸的数据，必须报告物种和样本量，关注站点。")
    lines(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for _ in range(2):
        follow(source, bench, f"{tmp_path}/c").awaitTermination()
    assert bench.documents().count() == 1 and bench.table("blocks").count() == 4


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50
