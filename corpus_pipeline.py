"""A pipeline of five operators from raw documents to training shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's docs.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.decontamination import without_hits
from lodestone.llm.mixing import mixed
from lodestone.llm.ngram_join import keep_one
from lodestone.llm.quality import quality_scores
from lodestone.llm.sharding import interleaved

SHARDS = 24
#: Shares of words: how much of the other domains may stand beside the first.
TARGETS = {"good": 0.95, "low": 0.02, "toxic": 0.03}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _apart(docs: DataFrame, work) -> DataFrame:
    """work(docs) with the columns of docs; further columns pass through under names that no operator uses."""
    names = [c if c in ("doc_id", "text", "lang", "source", "n_chars") else f"_x{i}" for i, c in enumerate(docs.columns)]
    out = work(docs.toDF(*names))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without any label nothing is known, and all stay."""
    return _apart(docs, lambda d: quality_scores(d, _table(spark, sf_dir, "labels")).where("predicted = 1 OR NOT trained"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _apart(docs, keep_one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; n_chars follows."""
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _apart(docs, lambda d: without_hits(d, _table(spark, sf_dir, "benchmark")).withColumn("n_chars", size))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains over their target share are thinned out; none is repeated, for repeats would undo the second stage."""
    return _apart(docs, lambda d: mixed(d, _table(spark, sf_dir, "labels"), TARGETS, thin=True).where("copies > 0"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: all columns with shard and slot."""
    return interleaved(docs, SHARDS)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing to target weights", mixing), ("sharding", sharding)]

#: Learned models decide in two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
