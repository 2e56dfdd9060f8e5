"""The workbench as one object: interpret a brief, sync documents, browse, retrieve, compare, keep gold, evaluate.

State is Parquet under one root; a change of several tables is published as one (see store.Catalog). Documents come as lines
(document_id, sha256, filename, page, line_no, text, x0, top, x1, bottom, and title and created where the reader knows them), from
whatever reader the caller has; PDF decoding itself needs a library that isn't assumed here.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as K
from .functions.spec import Field, Spec, interpret
from .functions.text import keyword_like
from .operators import encoders, store
from .plans import evaluate, ingest, retrieve, screen
from .scratch import dropped, written
from .session import Settings
from .sources import tables as sources


class NotFound(KeyError):
    """No such document, block, field or specification."""


def now() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat()


def new_id(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex[:12]}"


def spec_from_json(text: str) -> Spec:
    raw = json.loads(text)
    fields = {k: tuple(Field(f["name"], f["label"], tuple(f["synonyms"]), f["unit"]) for f in raw[k]) for k in ("targets", "required", "optional")}
    rest = {k: tuple(raw[k]) for k in ("sources", "exclusions", "warnings")}
    return Spec(**fields, **rest, brief=raw["brief"], version=raw["version"])


_VECTOR = "cache_key string, " + ", ".join(f"{c} {'int' if c == 'dimensions' else 'string'}" for c in K.CACHE_KEY_PARTS) + ", vector array<double>"
SCHEMAS = {
    "specs": "spec_id string, spec_json string, created_at string",
    "documents": "document_id string, sha256 string, filename string, parser_version string, page_count long, text_char_count int, language string, parser_status string, title string, publication_year int",
    "blocks": "document_id string, block_id string, ordinal int, page int, section string, kind string, text string, bbox array<double>",
    "gold": "document_id string, field_name string, block_id string, gold_id string, status string, note string, created_at string, kind string, at long",
    "screening": "document_id string, target_blocks long, numeric_blocks long, excluded_blocks long, missing_required array<string>, screening_status string, screening_reasons array<string>",
    "runs": "run_id string, document_id string, field_name string, k int, result_json string, created_at string, " + ", ".join(f"{n} {t}" for n, (t, _) in K.RUN_DEFAULTS.items()),
    "vectors": _VECTOR,
    "evaluations": "evaluation_id string, result_json string, created_at string",
}
GOLD_COLUMNS = ["gold_id", *store.GOLD_KEY, "status", "note", "created_at"]


def as_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


class TableCache:
    """Passage vectors as a table of a catalog."""

    def __init__(self, bench: Workbench):
        self.bench = bench

    def rows(self) -> DataFrame:
        return self.bench.table("vectors")

    def add(self, records: DataFrame) -> None:
        self.bench.publish(append={"vectors": store.cache_new(self.rows(), records)})


class Workbench:
    """`cache`: where passage vectors are kept, a store.VectorCache; by default a table beside the others."""

    def __init__(self, spark: SparkSession, settings: Settings | str, cache: store.VectorCache | None = None):
        self.spark, self.settings = spark, settings if isinstance(settings, Settings) else Settings(settings)
        self.catalog = store.Catalog(spark, self.settings.root)
        self.cache = cache or TableCache(self)

    # ------------------------------------------------------------ tables

    def table(self, name: str) -> DataFrame:
        """A table as it is now; columns that old rows lack have their defaults."""
        folders = self.catalog.folders(name)
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])
        return store.migrated(rows, K.RUN_DEFAULTS) if name == "runs" else rows

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        target = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target])

    def publish(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> int:
        shaped = [{name: self._shaped(name, rows) for name, rows in (x or {}).items()} for x in (replace, append)]
        return self.catalog.publish(*shaped)

    def _append(self, name: str, row: dict[str, Any]) -> None:
        self.publish(append={name: self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {_kind(SCHEMAS[name], k)}" for k in row))})

    # ------------------------------------------------------------ specification

    def interpret(self, brief: str) -> Spec:
        spec = interpret(self.spark, brief)
        self._append("specs", {"spec_id": new_id("spec"), "spec_json": as_json(asdict(spec)), "created_at": now()})
        self.rescreen()
        return spec

    def current_spec(self) -> Spec | None:
        rows = store.latest(self.table("specs"), "created_at", "spec_id").collect()
        return spec_from_json(rows[0].spec_json) if rows else None

    def _spec(self) -> Spec:
        spec = self.current_spec()
        if spec is None:
            raise ValueError("interpret a brief first")
        return spec

    # ------------------------------------------------------------ documents

    def sync(self, lines: DataFrame) -> dict[str, int]:
        """Parse documents whose hash isn't stored under this parser version; a saved document's blocks and gold are replaced."""
        known = [c for c in ("title", "created") if c in lines.columns]
        files = written(lines.groupBy("document_id", "sha256", "filename").agg(*[F.max(c).alias(c) for c in known], F.lit(1).alias("_one")).drop("_one"))
        if files.isEmpty():
            raise FileNotFoundError("no documents to sync")
        fresh = store.new_files(files, self.table("documents"), self.settings.parser_version)
        todo = lines.join(fresh.select("document_id"), "document_id", "left_semi")
        blocks = written(ingest.blocks_of(todo))
        facts = ingest.document_facts(blocks, todo.select("document_id", "page").distinct())
        meta = fresh.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in known else F.lit("") for c in ("title", "created")})
        titled = ingest.titles(blocks, meta).join(facts, "document_id").withColumn("parser_version", F.lit(self.settings.parser_version))
        titled = written(titled)
        states = files.join(titled.select("document_id", "parser_status"), "document_id", "left").withColumn("reused", F.col("parser_status").isNull())
        counts = ingest.sync_counts(states).first().asDict()
        if counts["parsed"] + counts["failed"]:
            self.publish(
                {
                    "gold": store.cascaded_gold(self.table("gold"), titled),
                    "blocks": store.replaced(self.table("blocks"), self._shaped("blocks", blocks), ["document_id"]),
                    "documents": store.replaced(self.table("documents"), self._shaped("documents", titled), ["document_id"]),
                }
            )
        for table in (files, blocks, titled):
            dropped(table)
        self.rescreen()
        return counts

    def sync_folder(self, folder: str = "", pattern: str = "*.pdf", reader: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
        """Sync the files of a folder (by default the settings' source directory). `reader` turns files (path, filename, sha256) into lines;
        without one, plain text is read. Only files that aren't stored yet are read."""
        files = sources.files(self.spark, folder or self.settings.source_directory, pattern).withColumn("document_id", F.concat(F.lit("doc-"), F.substring("sha256", 1, 14)))
        total = files.count()
        fresh = store.new_files(files, self.table("documents"), self.settings.parser_version)
        if fresh.isEmpty():
            self.rescreen()
            return {"parsed": 0, "reused": total, "failed": 0}
        counts = self.sync((reader or sources.text_lines)(fresh))
        return counts | {"reused": total - counts["parsed"] - counts["failed"]}

    def documents(self) -> DataFrame:
        return self.table("documents").orderBy("filename")

    def overviews(self) -> DataFrame:
        blocks, spec = self.table("blocks"), self.current_spec()
        covered = screen.covered_fields(blocks, spec or Spec())
        return ingest.overview(self.table("documents"), blocks, covered).join(self.table("screening"), "document_id", "left").orderBy("filename")

    def blocks(self, document_id: str, query: str = "", limit: int = 80) -> DataFrame:
        if not 1 <= limit <= 300:
            raise ValueError("limit lies in 1..300")
        self.document(document_id)
        rows = self.table("blocks").where(F.col("document_id") == document_id)
        return (rows.where(keyword_like("text", query)) if query else rows).orderBy("ordinal").limit(limit)

    def _one(self, table: str, key: str, value: str):
        found = self.table(table).where(F.col(key) == value).limit(1).collect()
        if not found:
            raise NotFound(value)
        return found[0]

    def document(self, document_id: str):
        return self._one("documents", "document_id", document_id)

    def document_by_hash(self, sha256: str):
        return self._one("documents", "sha256", sha256)

    def block(self, block_id: str):
        return self._one("blocks", "block_id", block_id)

    def run(self, run_id: str) -> dict[str, Any]:
        """A recorded run, its result as it was returned."""
        row = self._one("runs", "run_id", run_id).asDict()
        return row | {"result": json.loads(row.pop("result_json") or "{}")}

    def rescreen(self) -> None:
        spec = self.current_spec()
        if spec is not None:
            self.publish({"screening": screen.screened(self.table("blocks"), spec, self.table("documents"))})

    # ------------------------------------------------------------ retrieval

    def _encoder(self, name: str | None = None):
        name = name or self.settings.encoder
        neural = {"batch_size": self.settings.batch_size, "device": self.settings.device, "local_files_only": self.settings.local_files_only, "cache_folder": self.settings.model_cache_directory}
        return encoders.encoder(name, **(neural if "e5" in name.lower() else {}))

    def _vectors(self, blocks: DataFrame, spec: Spec, names: list[str], encoder) -> tuple[DataFrame, dict[str, Any]]:
        """Cosines of each block with each field's query; missing passage vectors are encoded once and kept."""
        hashes = self.table("documents").select("document_id", "sha256")
        parts = store.cache_parts(F.col("sha256"), F.col("block_id"), F.col("text"), encoder.metadata, encoder.parameters)
        wanted = blocks.join(hashes, "document_id").select("block_id", "text", *[c.alias(k) for k, c in parts.items() if k != "block_id"])
        wanted = wanted.withColumn("cache_key", store.cache_key(F.col("document_sha256"), F.col("block_id"), F.col("text"), encoder.metadata, encoder.parameters))
        queries = {n: encoder.query(spec.query_for(n)) for n in names}
        if not self.settings.vector_cache:
            stats = {"enabled": False, "hits": 0, "misses": 0, "writes": 0}
            return retrieve.semantic(wanted.select("block_id", encoder.passages(F.col("text")).alias("vector")), queries), stats
        stats = store.cache_stats(wanted, self.cache.rows()).first().asDict()
        if stats["misses"]:
            self.cache.add(store.cache_missing(wanted, self.cache.rows()).withColumn("vector", encoder.passages(F.col("text"))))
        have = store.cache_read(wanted, self.cache.rows()).select("block_id", "vector")
        return retrieve.semantic(have, queries), stats

    def rank(self, blocks: DataFrame, names: list[str], weights: retrieve.Weights | None = None, encoder=None) -> tuple[DataFrame, dict[str, Any]]:
        """Full ranking of every document in `blocks` for every field (written once), with the cache's counts and the time it took."""
        began = time.perf_counter()
        spec, weights = self._spec(), weights or retrieve.Weights()
        cosines, stats = None, {"enabled": False, "hits": 0, "misses": 0, "writes": 0}
        if weights.vector_similarity:
            cosines, stats = self._vectors(blocks, spec, names, encoder or self._encoder())
        ranked = written(retrieve.ranked(retrieve.scored(blocks, spec, names, weights, cosines)))
        return ranked, {"cache": stats, "elapsed_ms": round((time.perf_counter() - began) * 1000, 6)}

    def _recorded(self, document_id: str, field_name: str, k: int, weights: retrieve.Weights, encoder, strategy: str = "") -> tuple[dict[str, Any], DataFrame]:
        """(the run as returned and recorded, the full ranking)."""
        blocks = self.table("blocks").where(F.col("document_id") == document_id)
        ranked, work = self.rank(blocks, [field_name], weights, encoder)
        top = evaluate.flagged(retrieve.ranked(ranked.drop("rank"), k), self.gold())
        components = F.struct(F.col("bm25"), F.col("semantic").alias("vector_similarity"), "term_coverage", "section_prior")
        top = top.select("block_id", "rank", "score", components.alias("score_components"), "matched_terms", "is_gold").join(blocks.select("block_id", "ordinal", "page", "section", "kind", "text", "bbox"), "block_id").orderBy("rank")
        parameters = {"weights": asdict(weights), "encoder": encoder.parameters, "k1": K.K1, "b": K.B} | ({"comparison_strategy": strategy} if strategy else {})
        result = {
            "run_id": new_id("retrieval"), "document_id": document_id, "field_name": field_name, "query": self._spec().query_for(field_name), "retrieval_version": self.settings.retrieval_version,
            "backend": encoder.metadata, "parameters": parameters, "query_count": 1, "total_blocks": ranked.count(), "elapsed_ms": work["elapsed_ms"], "cache": work["cache"],
            "hits": [r.asDict(True) for r in top.collect()],
        }
        backend = {c: encoder.metadata[c] for c in ("backend", "backend_version", "model", "model_version")}
        counts = {f"cache_{c}": v for c, v in work["cache"].items()}
        row = {c: result[c] for c in ("run_id", "document_id", "field_name", "query_count", "total_blocks", "elapsed_ms")}
        self._append("runs", row | backend | counts | {"k": k, "parameters_json": as_json(parameters), "result_json": as_json(result), "created_at": now()})
        return result, ranked

    def retrieve(self, document_id: str, field_name: str, k: int = 8, weights: retrieve.Weights | None = None, encoder=None) -> dict[str, Any]:
        """Top k evidence with components; gold of any status is flagged, and the run is recorded."""
        if not 1 <= k <= 30:
            raise ValueError("k lies in 1..30")
        self._spec()
        self.document(document_id)
        result, ranked = self._recorded(document_id, field_name, k, weights or retrieve.Weights(), encoder or self._encoder())
        dropped(ranked)
        return result

    def compare(self, document_id: str, field_name: str, k: int = 8, e5=None) -> dict[str, Any]:
        """bm25-only, hashing-hybrid and e5-hybrid, each a recorded run with metrics against verified gold, or the reason why it can't run."""
        if not 1 <= k <= 30:
            raise ValueError("k lies in 1..30")
        query = self._spec().query_for(field_name)
        self.document(document_id)
        gold, items = self.gold(document_id, field_name, "verified"), []
        ways = {"bm25-only": (retrieve.BM25_ONLY, encoders.DisabledEncoder()), "hashing-hybrid": (retrieve.Weights(), encoders.HashingEncoder()), "e5-hybrid": (retrieve.Weights(), e5 or self._encoder("e5-small"))}
        for name, (weights, encoder) in ways.items():
            item = {"strategy": name, "label": K.STRATEGY_LABELS[name]}
            try:
                result, ranked = self._recorded(document_id, field_name, k, weights, encoder, name)
            except encoders.EncoderUnavailable as e:
                items.append(item | {"status": "unavailable", "error": str(e)})
                continue
            metrics = evaluate.compared_with_gold(ranked, gold, k).drop("document_id", "field_name").collect()
            dropped(ranked)
            none = {"gold_count": 0, "first_gold_rank": None, "hit_at_k": None, "recall_at_k": None, "reciprocal_rank": None}
            items.append(item | {"status": "available", "error": "", "retrieval": result, "metrics": metrics[0].asDict() if metrics else none})
        return {"comparison_id": new_id("comparison"), "document_id": document_id, "field_name": field_name, "query": query, "k": k, "gold_status": "verified", "items": items}

    # ------------------------------------------------------------ gold and evaluation

    def gold(self, document_id: str = "", field_name: str = "", status: str = "") -> DataFrame:
        return store.filtered_gold(store.gold_of(self.table("gold")).select(*GOLD_COLUMNS), document_id, field_name, status)

    def _log_gold(self, kind: str, document_id: str, field_name: str, block_id: str, gold_id: str, status: str = "", note: str = "") -> None:
        at = self.catalog.state()[0] + 1
        self._append("gold", {"document_id": document_id, "field_name": field_name, "block_id": block_id, "gold_id": gold_id, "status": status, "note": note, "created_at": now(), "kind": kind, "at": at})

    def add_gold(self, document_id: str, field_name: str, block_id: str, status: str = "verified", note: str = "") -> None:
        """Adds a gold row, or changes status and note of the one that is there; a row of a log is appended."""
        if status not in ("draft", "verified"):
            raise ValueError("status is draft or verified")
        wanted = self.spark.createDataFrame([(document_id, block_id)], "document_id string, block_id string")
        if not store.unknown_blocks(wanted, self.table("blocks")).isEmpty():
            raise NotFound(block_id)
        self._log_gold("put", document_id, field_name, block_id, new_id("gold"), status, note)

    def delete_gold(self, gold_id: str) -> None:
        """Takes a gold row away; none by that id is no error."""
        for r in self.gold().where(F.col("gold_id") == gold_id).collect():
            self._log_gold("drop", r.document_id, r.field_name, r.block_id, r.gold_id)

    def evaluate(self, k_values: tuple[int, ...] = (3, 5, 10), gold_status: str = "verified") -> dict[str, Any]:
        """Metrics of every annotated query, and their means; recorded."""
        began = time.perf_counter()
        gold = written(self.gold(status="" if gold_status == "all" else gold_status))
        names = [r[0] for r in gold.select("field_name").distinct().orderBy("field_name").collect()]
        if not names:
            raise ValueError("there is no gold evidence")
        weights, encoder = retrieve.Weights(), self._encoder()
        blocks = self.table("blocks").join(gold.select("document_id").distinct(), "document_id", "left_semi")
        ranked, work = self.rank(blocks, names, weights, encoder)
        queries = written(evaluate.per_query(ranked, gold, list(k_values), ids=True))
        n = queries.count()
        means = lambda r, hit="hit": {name: round(r[c], 4) for name, c in ((hit, "hit"), ("recall", "recall"), ("precision", "precision"))}
        by_k = evaluate.macro(queries).collect()
        per_field = [
            {"field_name": r.field_name, "query_count": r.query_count, "gold_count": r.gold_count, "mrr": round(r.mrr, 4), "metrics": {str(m.k): means(m) for m in by_k if m.field_name == r.field_name}}
            for r in evaluate.per_field(queries).orderBy("field_name").collect()
        ]
        per_query = [
            {"document_id": r.document_id, "field_name": r.field_name, "gold_count": r.gold_count, "gold_block_ids": r.gold_block_ids, "top_block_ids": r.top_block_ids, "first_relevant_rank": r.first_gold_rank,
             "reciprocal_rank": r.reciprocal_rank, "metrics": {str(m.k): {"hit": m.hit, "recall": m.recall, "precision": m.precision} for m in r.at_k}}
            for r in queries.orderBy("document_id", "field_name").collect()
        ]
        result = {
            "evaluation_id": new_id("eval"), "generated_at": now(), "retrieval_version": self.settings.retrieval_version, "backend": encoder.metadata, "gold_status": gold_status,
            "parameters": {"weights": asdict(weights), "encoder": encoder.parameters, "k1": K.K1, "b": K.B},
            "coverage": evaluate.coverage(gold, queries).first().asDict() | {f"cache_{k}": v for k, v in work["cache"].items() if k != "enabled"},
            "metrics_at_k": {str(r.k): means(r, "hit_rate") for r in by_k if r.field_name is None},
            "mean_reciprocal_rank": round(evaluate.mean_reciprocal_rank(queries).first().mrr, 4),
            "per_field": per_field, "per_query": per_query,
        }
        result["timing"] = {"retrieval_elapsed_ms": work["elapsed_ms"], "evaluation_elapsed_ms": round((time.perf_counter() - began) * 1000, 6), "mean_query_ms": round(work["elapsed_ms"] / n, 6) if n else 0.0}
        for table in (gold, ranked, queries):
            dropped(table)
        self._append("evaluations", {"evaluation_id": result["evaluation_id"], "result_json": as_json(result), "created_at": result["generated_at"]})
        return result

    def latest_evaluation(self) -> dict[str, Any] | None:
        rows = store.latest(self.table("evaluations"), "created_at", "evaluation_id").collect()
        return json.loads(rows[0].result_json) if rows else None

    # ------------------------------------------------------------ state

    def health(self) -> dict[str, Any]:
        encoder = self._encoder()
        return {"status": "ok", "retrieval_version": self.settings.retrieval_version, "parser_version": self.settings.parser_version, "encoder": encoder.metadata | {"runtime": encoder.runtime_status}, "cached_vectors": self.cache.rows().count()}

    def state(self) -> dict[str, Any]:
        return {"spec": self.current_spec(), "documents": self.overviews(), "gold": self.gold(), "evaluation": self.latest_evaluation()}


def _kind(ddl: str, name: str) -> str:
    return next(part.split(" ", 1)[1] for part in ddl.split(", ") if part.split(" ", 1)[0] == name)
