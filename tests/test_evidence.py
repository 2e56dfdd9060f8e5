"""Golden rows and properties of the evidence operators."""

import hashlib
import json
import math
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions import text as T
from lodestone.functions.spec import Field, Spec, interpret, interpreted
from lodestone.operators import encoders, store
from lodestone.plans import evaluate, ingest, retrieve, screen

BRIEF = "希望提取树干呼吸的观测数据，必须给出物种和样本量；另外关注站点与测量方法。接受表格，不接受模型预测。"
BLOCK = "document_id string, block_id string, ordinal int, section string, kind string, text string"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


def blocks(spark, rows):
    return spark.createDataFrame([("d", f"b{i}", i, section, kind, text) for i, section, kind, text in rows], BLOCK)


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Étion CO₂-flux 1.5 m⁻²", ["tion", "co₂-flux", "1.5", "m⁻"]),
        ("树", ["树", "树"]),
        ("树干", ["树干", "树干"]),
        ("树干呼吸", ["树干", "干呼", "呼吸", "树干呼吸"]),
        ("树干呼吸速率测量", ["树干", "干呼", "呼吸", "吸速", "速率", "率测", "测量"]),
        (" \n", []),
        ("a 　B", ["a", "b"]),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokenize("x"), text) == tokens


@pytest.mark.parametrize(("text", "section"), [("2.1 Materials and Methods", "methods"), ("Results", "results"), ("1 Abstract", None), ("Abstract —", "abstract"), ("参考文献", "references"), ("methods " * 20, None), ("Resulting", None)])
def test_sections(spark, text, section):
    assert one(spark, T.section_of("x"), text) == section


@pytest.mark.parametrize(("text", "kind"), [("Figure 2. Rates", "figure_caption"), ("表 3 数据", "table_caption"), ("Table S1", "table_caption"), ("The table", "text"), ("Introduction", "heading")])
def test_kinds(spark, text, kind):
    assert one(spark, T.kind_of("x"), text) == kind


@pytest.mark.parametrize(("text", "number", "unit"), [("about 12 cm", True, True), ("m²5", False, False), ("v1.2", False, False), ("-3,5 mm", True, True), ("none", False, False), ("ΜMOL ΜMOL", False, True), ("20 °C", True, True)])
def test_number_and_unit(spark, text, number, unit):
    assert one(spark, T.has_number("x"), text) is number
    assert one(spark, T.has_unit("x"), text) is unit


def test_small_functions(spark):
    assert one(spark, T.stable_id("block", "x", F.lit(2)), "a") == "block-" + hashlib.sha256(b"a|2").hexdigest()[:14]
    assert [one(spark, T.language("x"), t) for t in ("树干 stem", "stem respiration 树", "123")] == ["zh", "en" if 1 <= 15 * 0.12 else "zh", "unknown"]
    assert one(spark, T.keyword_like("x", "ST_M"), "A STEM") and not one(spark, T.keyword_like("x", "é"), "É")
    assert [spark.range(1).select(T.percent(F.lit(v).cast("double")).alias("p")).first().p for v in (0.125, 0.5, None)] == ["13%", "50%", "0%"]


def test_brief(spark):
    spec = interpret(spark, BRIEF)
    assert [f.name for f in spec.targets] == ["stem_respiration_rate"]
    assert [f.name for f in spec.required] == ["species", "sample_size"]
    assert {"site_name", "measurement_method"} <= {f.name for f in spec.optional}
    assert spec.sources == ("table",) and spec.exclusions == ("model_prediction",) and spec.warnings == ()
    other = interpret(spark, "我要提取叶面积指数数据，不限制其他任何条件")
    assert other.targets[0].name == "custom_target" and other.targets[0].synonyms == ("叶面积指数",) and len(other.warnings) == 2
    with pytest.raises(ValueError):
        interpret(spark, "short")
    both = interpreted(spark.createDataFrame([(1, BRIEF), (2, "  ")], "i int, brief string")).orderBy("i").collect()
    assert both[0].required == ["species", "sample_size"] and both[1].custom_target == "目标变量"


def test_query_terms():
    spec = Spec(targets=(Field("a", "A", ("x", "A", "y")),))
    assert spec.terms_for("a") == ["A", "x", "y"] and spec.query_for("a") == "A x y"
    assert "n =" in spec.terms_for("sample_size") and spec.terms_for("leaf_area") == ["leaf area"]


def _plain_bm25(rows, query):
    n, lengths = len(rows), [len(r) for r in rows]
    average = sum(lengths) / n
    df = {t: sum(t in r for r in rows) for t in query}
    return [sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * r.count(t) * 2.5 / (r.count(t) + 1.5 * (0.25 + 0.75 * len(r) / average)) for t in query if r.count(t)) for r in rows]


def test_ranking(spark):
    texts = ["stem stem respiration", "respiration of soil", "", "nothing here at all", "stem"]
    spec = Spec(targets=(Field("rate", "stem respiration", ("stem",)),))
    rows = retrieve.ranked(retrieve.scored(blocks(spark, [(i + 1, "results" if i == 3 else "other", "table_caption" if i == 4 else "text", t) for i, t in enumerate(texts)]), spec, ["rate"], retrieve.LEXICAL)).orderBy("ordinal").collect()
    raw = _plain_bm25([t.split() for t in texts], ["stem", "respiration"])
    assert [r.bm25_raw for r in rows] == pytest.approx(raw)
    assert [r.bm25 for r in rows] == pytest.approx([x / max(raw) for x in raw])
    assert [r.term_coverage for r in rows] == [1, 0, 0, 0, 0.5]
    assert [r.section_prior for r in rows] == [0.15, 0.15, 0.15, 1.0, 0.65]
    assert rows[0].matched_terms == ["stem respiration", "stem"] and sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r.score, r.ordinal))] == [1, 2, 3, 4, 5]


def test_minmax_of_equal_values(spark):
    rows = retrieve.scored(blocks(spark, [(1, "x", "text", "same"), (2, "x", "text", "same")]), Spec(targets=(Field("f", "same"), Field("g", "absent"))), ["f", "g"], retrieve.BM25_ONLY).collect()
    assert {(r.field_name, r.bm25) for r in rows} == {("f", 1.0), ("g", 0.0)}


def test_weights():
    with pytest.raises(ValueError):
        retrieve.Weights(0.5, 0.5, 0.5, -0.5)
    with pytest.raises(ValueError):
        retrieve.Weights(0.5, 0.1, 0.1, 0.1)


def test_metrics(spark):
    ranked = spark.createDataFrame([("d", "f", f"b{i}", i) for i in range(1, 5)] + [("e", "f", "x", 1)], "document_id string, field_name string, block_id string, rank int")
    gold = spark.createDataFrame([("d", "f", "b2"), ("d", "f", "b4"), ("d", "f", "b2"), ("gone", "f", "z"), ("e", "f", "y")], "document_id string, field_name string, block_id string")
    rows = {r.document_id: r for r in evaluate.per_query(ranked, gold, [3, 50, 3, 0]).collect()}
    assert set(rows) == {"d", "e"} and rows["d"].gold_count == 2 and rows["d"].first_gold_rank == 2 and rows["e"].reciprocal_rank == 0
    assert [(x.k, x.hit, x.recall, x.precision) for x in rows["d"].at_k] == [(1, 0.0, 0.0, 0.0), (3, 1.0, 0.5, pytest.approx(1 / 3)), (30, 1.0, 1.0, 0.5)]
    assert evaluate.per_query(ranked, gold, []).first().at_k == []
    cover = evaluate.coverage(gold, evaluate.per_query(ranked, gold, [3])).first()
    assert (cover.annotated_queries, cover.evaluated_queries, cover.blocks_scored) == (3, 2, 5)
    macro = {(r.field_name, r.k): r.recall for r in evaluate.macro(evaluate.per_query(ranked, gold, [3])).collect()}
    assert macro == {("f", 3): 0.25, (None, 3): 0.25}
    ids = {r.document_id: (r.top_block_ids, r.gold_block_ids) for r in evaluate.per_query(ranked, gold, [2, 3], ids=True).collect()}
    assert ids == {"d": (["b1", "b2", "b3"], ["b2", "b4"]), "e": (["x"], ["y"])}
    assert evaluate.per_query(ranked, gold, [], ids=True).where("document_id = 'd'").first().top_block_ids == []
    pairs = {r.document_id: (r.gold_count, r.hit_at_k, r.reciprocal_rank) for r in evaluate.compared_with_gold(ranked, gold.where("document_id = 'd'"), 1).collect()}
    assert pairs == {"d": (2, 0.0, 0.5), "e": (0, None, None)}
    none = evaluate.coverage(gold.limit(0), evaluate.per_query(ranked, gold.limit(0), [3])).first()
    assert (none.annotated_queries, none.evaluated_queries, none.blocks_scored) == (0, 0, 0)


def test_screening(spark):
    spec = interpret(spark, "提取树干呼吸的数据，必须报告物种和样本量。")
    rate = "Stem respiration reached 2.4 µmol CO2 m-2 s-1"
    full = [(1, "methods", "text", "sample size n=9"), (2, "methods", "text", "Species: oak"), (3, "results", "text", rate)]
    state = lambda rows, s=spec, **k: screen.screened(blocks(spark, rows), s, **k).first()
    assert state(full).screening_status == "usable" and state(full).missing_required == []
    assert state(full[1:]).screening_status == "relative" and state(full[1:]).missing_required == ["sample_size"]
    assert state([(1, "x", "text", "stem respiration without values")]).screening_status == "nodata"
    # a gap in ordinals ends the neighbourhood
    assert state([(1, "x", "text", "stem respiration"), (3, "x", "text", "7 cm")]).numeric_blocks == 0
    failed = spark.createDataFrame([("z", "failed")], "document_id string, parser_status string")
    row = state(full, documents=failed)
    assert row.screening_status == "failed" and row.missing_required == ["species", "sample_size"]
    no_model = interpret(spark, "提取树干呼吸的数据，必须报告物种，不接受模型。")
    row = state([(1, "x", "text", "The model predicted stem respiration of 2 cm")], no_model)
    assert row.screening_status == "nodata" and row.excluded_blocks == 1 and len(row.screening_reasons) == 4


def _lines(spark, rows):
    return spark.createDataFrame([("d", p, n, t, x, top, x + 50.0, bottom) for p, n, t, x, top, bottom in rows], "document_id string, page int, line_no int, text string, x0 double, top double, x1 double, bottom double")


def test_line_merging(spark):
    rows = [(1, 1, "Methods", 10.0, 0.0, 10.0), (1, 2, "first", 10.0, 11.0, 21.0), (1, 3, "second", 10.0, 22.0, 32.0), (1, 4, "after a gap", 10.0, 60.0, 70.0), (1, 5, "other column", 300.0, 60.0, 70.0), (1, 6, "Figure 1. A", 300.0, 71.0, 81.0), (1, 7, "x" * 851, 300.0, 82.0, 92.0), (1, 8, "y", 300.0, 93.0, 103.0), (1, 9, "z", 300.0, 104.0, 114.0)]
    merged = ingest.merged_lines(_lines(spark, rows)).orderBy("line_no").collect()
    assert [r.block_no for r in merged] == [1, 2, 2, 3, 4, 5, 6, 7, 7]
    out = ingest.blocks_of(_lines(spark, rows)).orderBy("ordinal").collect()
    assert [(r.section, r.kind) for r in out][:3] == [("methods", "heading"), ("methods", "text"), ("methods", "text")]
    assert out[1].text == "first second" and out[1].bbox == [10.0, 11.0, 60.0, 32.0] and out[4].kind == "figure_caption"


def test_document_facts(spark):
    b = spark.createDataFrame([("d", 1, 1, "word " * 30), ("s", 1, 1, "short")], "document_id string, ordinal int, page int, text string")
    pages = spark.createDataFrame([("d", i) for i in range(1, 6)] + [("s", 1), ("none", 1)], "document_id string, page int")
    got = {r.document_id: (r.parser_status, r.page_count, r.low_text_pages) for r in ingest.document_facts(b, pages).collect()}
    assert got == {"d": ("warning", 5, 4), "s": ("failed", 1, 0), "none": ("failed", 1, 1)}
    rows = [("z", 2, 1, "stem " * 1000), ("z", 1, 1, "x" * 14_990), ("z", 3, 1, "树" * 9000), ("y", 1, 1, "树" * 200), ("y", 2, 1, "ab")]
    long = {r.document_id: (r.text_char_count, r.language) for r in ingest.document_facts(spark.createDataFrame(rows, "document_id string, ordinal int, page int, text string")).collect()}
    assert long == {"z": (14_990 + 5000 + 9000 + 2, "en"), "y": (203, "zh")}  # what lies beyond 20,000 characters doesn't count for the language


def test_hashing_encoder(spark):
    e = encoders.HashingEncoder()
    v = spark.createDataFrame([("Stem  Respiration",), ("",)], "t string").select(e.passages(F.col("t")).alias("v")).collect()
    assert v[0].v == e.query("stem respiration") and sum(x * x for x in v[0].v) == pytest.approx(1) and not any(v[1].v)
    grams = ["ab", "bc", "abc"]
    expected = [0.0] * 384
    for g in grams:
        digest = hashlib.blake2b(g.encode(), digest_size=8).digest()
        expected[int.from_bytes(digest, "big") % 384] += 1.0 if digest[0] % 2 else -1.0
    norm = math.sqrt(sum(x * x for x in expected))
    assert e.query("ABC") == pytest.approx([x / norm for x in expected])
    odd = ["ab", "", "ünïcode 树干 \U0001f642 x", "a", "ab ab " * 50, "\ud800b lone"]
    for digest in ("blake2b", "md5"):
        coder = encoders.HashingEncoder(16, digest=digest)
        for text, vector in zip(odd, coder._encoded(odd), strict=True):
            plain, low = [0.0] * 16, " ".join(text.lower().split())
            for w in (2, 3, 4):
                for i in range(len(low) - w + 1):
                    bucket, sign = encoders._place(low[i : i + w], 16, digest)
                    plain[bucket] += sign
            size = math.sqrt(sum(x * x for x in plain)) or 1
            assert vector.tolist() == pytest.approx([x / size for x in plain])
    assert encoders.HashingEncoder(digest="md5").metadata["model"] != e.metadata["model"]


def test_registry():
    assert encoders.encoder(" E5-small ").metadata["dimensions"] == 384
    with pytest.raises(ValueError):
        encoders.encoder("other")
    with pytest.raises(RuntimeError):
        encoders.DisabledEncoder().query("x")
    made = []
    asked = {}
    fake = encoders.E5Encoder(factory=lambda model, **k: asked.update(k, model=model) or type("M", (), {"encode": lambda self, texts, **k: made.extend(texts) or [[1.0] * 384 for _ in texts]})())
    assert not made and fake.query(" a \n b") == [1.0] * 384 and made == ["query: a b"]
    assert asked["revision"] == fake.metadata["model_version"] and len(asked["revision"]) == 40 and asked["trust_remote_code"] is False and asked["model"] == fake.metadata["model"]
    assert fake.runtime_status["ready"] and encoders.E5Encoder(batch_size=8).parameters != encoders.E5Encoder().parameters
    if not encoders.E5Encoder().runtime_status["ready"]:
        for use in (lambda: encoders.E5Encoder().query("x"), lambda: encoders.E5Encoder().passages(F.lit("x"))):
            with pytest.raises(encoders.EncoderUnavailable, match="5.5.1.*not-installed"):
                use()

    def broken(model, **options):
        raise OSError("no such model")

    with pytest.raises(encoders.EncoderUnavailable, match="at revision"):
        encoders.E5Encoder(factory=broken).query("x")
    with pytest.raises(ValueError):
        encoders.E5Encoder(batch_size=0)


def test_cosine_wants_equal_lengths(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(retrieve.cosine("a", "b").alias("c")).collect()] == [0.6, None]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [0.6, 0.8])], "a array<double>, b array<double>").select(retrieve.cosine("a", "b")).collect()


def test_hybrid_weights(spark):
    """The four branches at their default weights, with a cosine that is cut at zero."""
    texts = ["stem respiration of trees", "soil", "stem"]
    spec = Spec(targets=(Field("rate", "stem respiration", ("stem",)),))
    b = blocks(spark, [(i + 1, "results", "text", t) for i, t in enumerate(texts)])
    e = encoders.HashingEncoder()
    cosines = retrieve.semantic(b.select("block_id", e.passages(F.col("text")).alias("vector")), {"rate": e.query(spec.query_for("rate"))})
    rows = retrieve.scored(b, spec, ["rate"], vectors=cosines).orderBy("ordinal").collect()
    plain = [max(0.0, sum(x * y for x, y in zip(e.query(t), e.query("stem respiration stem"), strict=True))) for t in texts]
    assert [r.semantic for r in rows] == pytest.approx(plain) and min(plain) >= 0
    assert [r.score for r in rows] == [round(0.45 * r.bm25 + 0.35 * r.semantic + 0.15 * r.term_coverage + 0.05 * r.section_prior, 6) for r in rows]


def test_cache_key(spark):
    e = encoders.HashingEncoder()
    identity = {"cache_key_version": "embedding-cache-key-v1", "document_sha256": "s", "block_id": "b\"1/é", "normalized_text_sha256": hashlib.sha256(b"a b").hexdigest(), **{k: e.metadata[k] for k in ("backend", "backend_version", "model", "model_version", "dimensions")}}
    identity["parameters_sha256"] = hashlib.sha256(json.dumps(e.parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    expected = hashlib.sha256(json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, store.cache_key(F.lit("s"), F.lit('b"1/é'), F.col("x"), e.metadata, e.parameters), " A\n b ") == expected


def test_store(spark, tmp_path):
    schema = "document_id string, field_name string, block_id string, gold_id string, status string, note string, created_at string"
    gold = spark.createDataFrame([("d", "f", "b", "g1", "draft", "", "1"), ("e", "f", "c", "g2", "verified", "", "0")], schema)
    new = spark.createDataFrame([("d", "f", "b", "g9", "verified", "seen", "9"), ("d", "f", "x", "g3", "draft", "", "2")], schema)
    rows = {r.gold_id: (r.status, r.note, r.created_at) for r in store.upserted_gold(gold, new).collect()}
    assert rows == {"g1": ("verified", "seen", "1"), "g2": ("verified", "", "0"), "g3": ("draft", "", "2")}
    assert [r.gold_id for r in store.filtered_gold(gold).collect()] == ["g2", "g1"]
    assert store.cascaded_gold(gold, gold.where("document_id = 'd'")).count() == 1
    assert store.migrated(spark.createDataFrame([(1, None)], "i int, backend string"), {"backend": ("string", "unknown"), "cache_hits": ("int", 0)}).first() == (1, "unknown", 0)
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "cache_key string")
    cache = spark.createDataFrame([("k1", [1.0, 2.0])], "cache_key string, vector array<double>")
    stats = store.cache_stats(wanted, cache).first()
    assert (stats.hits, stats.misses, stats.writes) == (1, 2, 1)
    e = encoders.HashingEncoder(2)
    parts = store.cache_parts(F.lit("s"), F.col("b"), F.col("t"), e.metadata, e.parameters)
    rows = spark.createDataFrame([("b1", "x"), ("b2", "y")], "b string, t string").select(store.cache_key(F.lit("s"), F.col("b"), F.col("t"), e.metadata, e.parameters).alias("cache_key"), *[c.alias(k) for k, c in parts.items()])
    held = store.cache_new(rows.limit(0).withColumn("vector", F.array(F.lit(0.0))), rows.where("block_id = 'b1'").withColumn("vector", F.array(F.lit(3.0), F.lit(4.0))))
    assert [(r.block_id, r.vector) for r in store.cache_read(rows, held).orderBy("block_id").collect()] == [("b1", [3.0, 4.0]), ("b2", None)]
    assert [r.block_id for r in store.cache_new(held, rows.withColumn("vector", F.array(F.lit(5.0), F.lit(6.0)))).collect()] == ["b2"]
    for broken, message in ((held.withColumn("vector", F.array(F.lit(1.0))), "another length"), (held.withColumn("model", F.lit("other")), "other parts")):
        with pytest.raises(Exception, match=message):
            store.cache_read(rows, broken).collect()
    with pytest.raises(Exception, match="another length"):
        store.cache_new(held, rows.withColumn("vector", F.array(F.lit(5.0)))).collect()


def test_scratch_folder(spark):
    from types import SimpleNamespace as Stub

    from lodestone import scratch

    def session(master, **conf):
        return Stub(conf=Stub(get=lambda k, d="": conf.get(k, d), set=conf.__setitem__), sparkContext=Stub(master=master, getConf=lambda: Stub(get=lambda k, d="": d)))

    assert scratch.scratch_root(session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.scratch_root(session(master))
    assert scratch.scratch_root(session("local[4]")).startswith("file:///")
    rows = scratch.written(spark.range(5))
    assert rows.count() == 5
    scratch.dropped(rows)
    hot = spark.range(4000).select((F.col("id") % 3).alias("k")).unionByName(spark.range(100, 140).select(F.col("id").alias("k"))).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("k")))
    facts = hot.where("k IS NOT NULL AND k <> 139").groupBy("k").agg(F.count("*").alias("n"))
    plan = scratch.met(hot, facts, "k", "n", hot.count(), "left")
    assert sorted((str(r.k), r.n) for r in plan.collect()) == sorted((str(r.k), r.n) for r in hot.join(facts, "k", "left").collect())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=12), min_size=1, max_size=8))
def test_rank_properties(spark, texts):
    spec = Spec(targets=(Field("f", "a b", ("c",)),))
    rows = retrieve.ranked(retrieve.scored(blocks(spark, [(i + 1, "x", "text", t) for i, t in enumerate(texts)]), spec, ["f"])).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(texts) + 1))
    assert all(0 <= r[c] <= 1 for r in rows for c in ("bm25", "term_coverage", "section_prior", "score"))


def plain_buckets(rows):
    """key -> bucket -> value of the md5 encoder, one n-gram at a time; buckets of rows with one key add up."""
    out = {}
    for key, text in rows:
        low = " ".join((text or "").lower().split())
        for w in (2, 3, 4):
            for i in range(len(low) - w + 1):
                bucket, sign = encoders._place(low[i : i + w], 384, "md5")
                found = out.setdefault(key, {})
                found[bucket] = found.get(bucket, 0) + int(sign)
    return {k: {b: v for b, v in found.items() if v} for k, found in out.items() if any(found.values())}


ODD_TEXTS = [(1, "Stem  Respiration"), (2, ""), (3, None), (4, "a"), (5, "树干\U0001f642呼吸 x\U0001f642"), (6, "ab " * 9000), (7, "one text"), (7, "another text"), (None, "no key"), (None, "nor here")]


def test_md5_buckets(spark):
    rows = spark.createDataFrame(ODD_TEXTS, "k long, text string")
    found = {}
    for r in encoders.md5_buckets(rows, "k").collect():
        assert r.bucket not in found.setdefault(r.k, {})
        found[r.k][r.bucket] = r.value
    assert found == plain_buckets(ODD_TEXTS)
    # without repeated keys it is a map: nothing is dealt out character by character
    plan = encoders.md5_buckets(rows.where("k < 7"), "k")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1] and "Window" not in plan


def test_sums_in_parts(monkeypatch):
    """However small the parts and the table of known n-grams, the sums are those of plain code."""
    texts = ["", "ab", "\0\0\0", "\U0001f642x\U0001f642", "\ud800b", "the stem of the tree", "b", "树干呼吸" * 5]
    for chunk, bits in ((1, 1), (3, 2), (7, 20), (1 << 14, 20)):
        monkeypatch.setattr(encoders, "CHUNK", chunk)
        monkeypatch.setattr(encoders._Places, "BITS", bits)
        encoders._places.cache_clear()
        for widths in ((2, 3, 4), (1,), (2, 6)):
            coder = encoders.HashingEncoder(16, widths)
            for text, row in zip(texts, coder.sums(texts), strict=True):
                plain = [0] * 16
                for w in widths:
                    for i in range(len(text) - w + 1):
                        bucket, sign = encoders._place(text[i : i + w], 16)
                        plain[bucket] += int(sign)
                assert row.tolist() == plain
        assert [hi - lo for lo, hi in encoders._chunks(["x" * chunk, "", "yy", "z"])][0] >= 1
    encoders._places.cache_clear()


def test_title_candidate_ids_like_years(spark, tmp_path):
    """A document's number that looks like a year is none."""
    rows = [(1900, "A fine first line of text", "en"), (1901, "short", "en"), (2003, "short", "en"), (2007, "Another fine first line", "en"), (2004, "x", "fr"), (8, "x", "fr"), (-7, "x", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.document_id: (r.title, r.publication_year) for r in queries.title_candidate(spark, str(tmp_path)).collect()}
    assert found == {
        1900: ("A fine first line of text", 2000), 1901: ("paper-1901", None), 2003: ("paper-2003", None), 2007: ("Another fine first line", 2007),
        2004: ("paper-2014-2004", 2014), 8: ("paper-1998-8", 1998), -7: ("paper--7", None),
    }


def test_md5_norms(spark):
    expected = {k: math.sqrt(sum(v * v for v in found.values())) for k, found in plain_buckets(ODD_TEXTS).items()}
    out = encoders.md5_norms(spark.createDataFrame(ODD_TEXTS, "k long, text string"), "k")
    assert {r.k: r.norm for r in out.collect()} == pytest.approx(expected) and out.count() == len(expected)
    # the length is taken where the text is read: there is no row for each bucket
    assert "bucket" not in encoders.md5_norms(spark.createDataFrame(ODD_TEXTS[:6], "k long, text string"), "k")._jdf.queryExecution().toString()


def test_encoding_in_little_memory():
    texts = ["stem respiration " * 50_000] * 8
    coder = encoders.HashingEncoder(digest="md5")
    coder.query("stem")  # makes the tables, whose size is fixed
    tracemalloc.start()
    vectors = coder._encoded(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(vectors) == 8 and peak < 4 * sum(len(t) for t in texts)


def test_cosines_in_one_pass(spark, tmp_path, monkeypatch):
    e, asked = encoders.HashingEncoder(digest="md5"), ["stem respiration", "", "rate"]
    texts = ["Stem  respiration", "", None, "a", "rates of the stem"]
    out = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(e.cosines(F.col("t"), asked).alias("c")).collect()]
    for text, found in zip(texts, out, strict=True):
        assert found == pytest.approx([sum(x * y for x, y in zip(e.query(text or ""), e.query(q), strict=True)) for q in asked])
    rows = [(i, f"the {'stem ' * i}with that der und", "s", "en") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    passes, kept = [], retrieve.written
    monkeypatch.setattr(retrieve, "written", lambda df: passes.append(df) or kept(df))
    for name, python in (("hybrid_topk", 1), ("strategy_compare", 1), ("rank_delta", 1), ("run_records", 1)):
        passes.clear()
        plan = getattr(queries, name)(spark, str(tmp_path))._jdf.queryExecution().toString()
        # texts are read and encoded once, where they are tokenised, and not joined to their cosines
        assert len(passes) == python and "Python" not in plan and "documents.parquet" not in plan
