"""Keyed tables on immutable files: upsert, replace with cascade, latest row, additive migration, vector cache.

Every change is a new DataFrame. A `Catalog` publishes changes of several tables at once: their files are written first, then a
manifest that names the files of all tables appears under the next number by one rename. Readers take the last manifest,
so they see all of a change or nothing, and what was there stays until the change is complete.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import canonical_json, normalize


def latest(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """The newest row; equal times by the largest `tie`."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(1)


def latest_by(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_values(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """One row for each key: its last value, at its first position (`position` orders the rows and is the first one's in the result)."""
    others = [c for c in rows.columns if c not in (*key, position)]
    agg = rows.groupBy(*key).agg(F.min(position).alias(position), F.max_by(F.struct(*others), position).alias("_v"))
    return agg.select(*key, position, "_v.*")


GOLD_KEY = ["document_id", "field_name", "block_id"]


def upserted_gold(gold: DataFrame, new: DataFrame) -> DataFrame:
    """Insert, or on the same (document, field, block) change status and note only; gold_id and created_at stay."""
    old, add = gold.alias("o"), new.alias("n")
    joined = old.join(add, GOLD_KEY, "full_outer")
    pick = lambda c, first, second: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c)
    return joined.select(*GOLD_KEY, pick("gold_id", "o", "n"), pick("status", "n", "o"), pick("note", "n", "o"), pick("created_at", "o", "n"))


def filtered_gold(gold: DataFrame, document_id: str = "", field_name: str = "", status: str = "") -> DataFrame:
    """Gold rows by any of three optional filters, in order of creation and id."""
    for name, value in (("document_id", document_id), ("field_name", field_name), ("status", status)):
        if value:
            gold = gold.where(F.col(name) == value)
    return gold.orderBy("created_at", "gold_id")


#: A gold table as a log: rows of kind put or drop, in the order of `at`.
def gold_of(log: DataFrame) -> DataFrame:
    """The gold rows that a log of (gold columns, kind, at) leaves: each key's puts since its last drop, with the id and time of the
    first of them and the status and note of the last."""
    w = Window.partitionBy(*GOLD_KEY)
    dropped = F.coalesce(F.max(F.when(F.col("kind") == "drop", F.col("at"))).over(w), F.lit(-1))
    live = log.withColumn("_d", dropped).where((F.col("kind") == "put") & (F.col("at") > F.col("_d")))
    pick = {c: F.min_by(c, "at") for c in ("gold_id", "created_at")} | {c: F.max_by(c, "at") for c in ("status", "note")}
    return live.groupBy(*GOLD_KEY).agg(*[f.alias(c) for c, f in pick.items()])


def without(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows but those of a key; none by that key is no error."""
    return rows.where(~F.col(key).eqNullSafe(F.lit(value)))


def unknown_blocks(gold: DataFrame, blocks: DataFrame) -> DataFrame:
    """Gold rows whose block isn't one of their document's."""
    return gold.join(blocks.select("document_id", "block_id").distinct(), ["document_id", "block_id"], "left_anti")


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of keys in new replace those in old."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def cascaded_gold(gold: DataFrame, replaced_documents: DataFrame) -> DataFrame:
    """Gold that is left after documents were saved again: theirs goes, even if its blocks come back."""
    return gold.join(replaced_documents.select("document_id").distinct(), "document_id", "left_anti")


def new_files(files: DataFrame, documents: DataFrame, parser_version: str) -> DataFrame:
    """Files to parse: those whose hash isn't stored under this parser version."""
    known = documents.where(F.col("parser_version") == parser_version).select("sha256").distinct()
    return files.join(known, "sha256", "left_anti")


def migrated(rows: DataFrame, defaults: dict[str, tuple[str, Any]]) -> DataFrame:
    """Adds missing columns (name -> (type, default)) and fills nulls of old rows with the default."""
    for name, (kind, value) in defaults.items():
        lit = F.lit(value).cast(kind)
        rows = rows.withColumn(name, F.coalesce(F.col(name), lit) if name in rows.columns else lit)
    return rows


# ---------------------------------------------------------------- vector cache


def cache_parts(sha256: Column, block_id: Column, text: Column, metadata: dict[str, Any], parameters: dict[str, Any]) -> dict[str, Column]:
    """What a vector depends on, by name."""
    canonical = json.dumps(parameters, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    parts = {k: F.lit(metadata[k]) for k in ("backend", "backend_version", "model", "model_version")}
    parts |= {
        "dimensions": F.lit(int(metadata["dimensions"])), "cache_key_version": F.lit(K.CACHE_KEY_VERSION), "document_sha256": sha256, "block_id": block_id,
        "normalized_text_sha256": F.sha2(normalize(text), 256), "parameters_sha256": F.lit(hashlib.sha256(canonical.encode()).hexdigest()),
    }
    return {k: parts[k] for k in K.CACHE_KEY_PARTS}


def cache_key(sha256: Column, block_id: Column, text: Column, metadata: dict[str, Any], parameters: dict[str, Any]) -> Column:
    """Content address of a vector: hash of the canonical JSON of everything that decides it."""
    return F.sha2(canonical_json(cache_parts(sha256, block_id, text, metadata, parameters)), 256)


def identity_mismatch(prefix: str = "_c_") -> Column:
    """Whether a cached row's parts (under `prefix`) differ from those asked for."""
    return ~F.struct(*K.CACHE_KEY_PARTS).eqNullSafe(F.struct(*[F.col(prefix + c).alias(c) for c in K.CACHE_KEY_PARTS]))


def cache_joined(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (cache_key and its parts) with `vector`, null where none is cached, and `mismatch`: a row of that key has other parts."""
    there = cache.select("cache_key", "vector", *[F.col(c).alias(f"_c_{c}") for c in K.CACHE_KEY_PARTS])
    joined = wanted.join(there, "cache_key", "left")
    return joined.withColumn("mismatch", F.col("vector").isNotNull() & identity_mismatch()).drop(*[f"_c_{c}" for c in K.CACHE_KEY_PARTS])


def _bad(condition: Column, message: str) -> Column:
    return F.when(condition, F.raise_error(F.lit(message)).cast("array<double>"))


def cache_read(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted with the cached vector or null; a vector of other parts or of another length is an error."""
    joined = cache_joined(wanted, cache)
    checked = _bad(F.col("mismatch"), "cached vector belongs to other parts")
    wrong = F.col("vector").isNotNull() & (F.size("vector") != F.col("dimensions"))
    checked = checked.when(wrong, F.raise_error(F.lit("cached vector has another length")).cast("array<double>")).otherwise(F.col("vector"))
    return joined.withColumn("vector", checked).drop("mismatch")


def cache_missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def cache_new(cache: DataFrame, records: DataFrame) -> DataFrame:
    """The records to append: those whose key isn't cached, one for each key; a vector of another length is an error."""
    checked = _bad(F.size("vector") != F.col("dimensions"), "vector has another length than its encoder").otherwise(F.col("vector"))
    return cache_missing(records.dropDuplicates(["cache_key"]), cache).withColumn("vector", checked)


def cache_stats(wanted: DataFrame, cache: DataFrame, enabled: bool = True) -> DataFrame:
    """One row: enabled, hits, misses, writes (the distinct keys that were missing)."""
    if not enabled:
        return wanted.sparkSession.sql("SELECT false AS enabled, 0L AS hits, 0L AS misses, 0L AS writes")
    marked = wanted.join(cache.select("cache_key", F.lit(True).alias("_c")).distinct(), "cache_key", "left")
    return marked.agg(F.lit(True).alias("enabled"), F.count_if("_c").alias("hits"), F.count_if(F.col("_c").isNull()).alias("misses"), F.countDistinct(F.when(F.col("_c").isNull(), F.col("cache_key"))).alias("writes"))


class VectorCache(Protocol):
    """Where passage vectors are kept between rankings. Rows have cache_key, its ten parts and vector."""

    def rows(self) -> DataFrame: ...

    def add(self, records: DataFrame) -> None: ...


# ---------------------------------------------------------------- files


class Conflict(RuntimeError):
    """Another writer has published a change meanwhile."""


class Catalog:
    """Tables under one root, each a list of Parquet folders. Manifest n is the state after n changes."""

    #: Folders of a table that are read as they are; with more, an append rewrites the table as one.
    MOST_PARTS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def state(self) -> tuple[int, dict[str, list[str]]]:
        """(number of the last manifest, folders of each table)."""
        fs, folder = self._fs(f"{self.root}/_manifests")
        if not fs.exists(folder):
            return 0, {}
        names = sorted(n for n in (str(x.getPath().getName()) for x in fs.listStatus(folder)) if n.isdigit())
        if not names:
            return 0, {}
        rows = self.spark.read.text(f"{self.root}/_manifests/{names[-1]}").collect()
        return int(names[-1]), json.loads(rows[0][0])

    def folders(self, name: str) -> list[str]:
        return [f"{self.root}/{p}" for p in self.state()[1].get(name, [])]

    def publish(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> int:
        """Writes all tables, then makes the change visible. A crash before that leaves the old state; another writer's change in
        between raises Conflict."""
        number, tables = self.state()
        tables = dict(tables)
        for name, rows in (replace or {}).items():
            tables[name] = [self._write(name, rows)]
        for name, rows in (append or {}).items():
            parts = tables.get(name, [])
            if len(parts) >= self.MOST_PARTS:
                rows = self.spark.read.schema(rows.schema).parquet(*[f"{self.root}/{p}" for p in parts]).unionByName(rows)
                parts = []
            tables[name] = [*parts, self._write(name, rows)]
        fs, beside = self._fs(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(beside)
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        out.close()
        _, target = self._fs(f"{self.root}/_manifests/{number + 1:09d}")
        if fs.exists(target) or not fs.rename(beside, target):
            fs.delete(beside, False)
            raise Conflict(f"change {number + 1} was published by another writer")
        return number + 1

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{part}")
        return part
