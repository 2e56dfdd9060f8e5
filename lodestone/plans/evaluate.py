"""Evaluation of rankings against gold evidence: one plan from ranked rows to macro averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["document_id", "field_name"]


def flagged(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked rows with is_gold."""
    marks = gold.select(*KEY, "block_id").distinct().withColumn("_g", F.lit(True))
    return ranked.join(marks, [*KEY, "block_id"], "left").withColumn("is_gold", F.coalesce("_g", F.lit(False))).drop("_g")


def cutoffs(k_values: list[int]) -> list[int]:
    """Distinct, sorted, clamped to 1..30."""
    return sorted({min(30, max(1, k)) for k in k_values})


def cutoffs_of(k_values) -> Column:
    """The same for an array column."""
    return F.array_sort(F.array_distinct(F.transform(k_values, lambda k: F.least(F.lit(30), F.greatest(F.lit(1), k.cast("int"))))))


def per_query(ranked: DataFrame, gold: DataFrame, k_values: list[int], ids: bool = False) -> DataFrame:
    """For each annotated (document, field) that has ranked rows: gold_count, blocks (ranked ones), first_gold_rank, reciprocal_rank,
    and for each k hit, recall and precision (over the rows returned). Ranks are over the whole ranking. With `ids` also top_block_ids
    (as many as the largest k) and gold_block_ids (sorted).

    Ranked and gold rows meet by block in one aggregation, and fall together by query in a second one; nothing is joined.
    """
    ks = cutoffs(k_values)
    marks = gold.select(*KEY, "block_id", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("_g"))
    rows = ranked.select(*KEY, "block_id", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("_g")).unionByName(marks)
    one = rows.groupBy(*KEY, "block_id").agg(F.min("rank").alias("rank"), F.max("_g").alias("_g"))
    agg = [F.count("rank").alias("blocks"), F.count_if("_g").alias("gold_count"), F.min(F.when(F.col("_g"), F.col("rank"))).alias("first_gold_rank")]
    agg += [F.count_if(F.col("_g") & (F.col("rank") <= k)).alias(f"_f{k}") for k in ks]
    if ids:
        agg += [F.collect_list(F.when(F.col("rank") <= max(ks, default=0), F.struct("rank", "block_id"))).alias("_top"), F.array_sort(F.collect_list(F.when(F.col("_g"), F.col("block_id")))).alias("gold_block_ids")]
    got = one.groupBy(*KEY).agg(*agg).where("gold_count > 0 AND blocks > 0")
    got = got.withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_gold_rank"), F.lit(0.0)))
    each = [F.struct(F.lit(k).alias("k"), (F.col(f"_f{k}") > 0).cast("double").alias("hit"), (F.col(f"_f{k}") / F.col("gold_count")).alias("recall"), (F.col(f"_f{k}") / F.least(F.lit(k), F.col("blocks"))).alias("precision")) for k in ks]
    at = F.array(*each) if each else F.expr("CAST(array() AS array<struct<k:int,hit:double,recall:double,precision:double>>)")
    more = [F.transform(F.array_sort("_top"), lambda x: x["block_id"]).alias("top_block_ids"), "gold_block_ids"] if ids else []
    return got.select(*KEY, "gold_count", "blocks", "first_gold_rank", "reciprocal_rank", at.alias("at_k"), *more)


def macro(queries: DataFrame) -> DataFrame:
    """Means for each (field, k), and for each k over all fields (field_name null)."""
    flat = queries.select("field_name", "reciprocal_rank", "gold_count", F.inline("at_k"))
    sets = [[F.col("field_name"), F.col("k")], [F.col("k")]]
    return flat.groupingSets(sets, "field_name", "k").agg(F.count("*").alias("query_count"), *[F.avg(c).alias(c) for c in ("hit", "recall", "precision")], F.avg("reciprocal_rank").alias("mrr"))


def per_field(queries: DataFrame) -> DataFrame:
    return queries.groupBy("field_name").agg(F.count("*").alias("query_count"), F.sum("gold_count").alias("gold_count"), F.avg("reciprocal_rank").alias("mrr"))


def mean_reciprocal_rank(queries: DataFrame) -> DataFrame:
    return queries.agg(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"))


def coverage(gold: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: what was annotated, what was evaluated, and how many block scores that took."""
    said = gold.agg(F.countDistinct(*KEY).alias("annotated_queries"), F.count("*").alias("gold_blocks"), F.countDistinct("document_id").alias("documents"), F.countDistinct("field_name").alias("fields"))
    done = queries.agg(F.count("*").alias("evaluated_queries"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks_scored"))
    both = said.unionByName(done, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def compared_with_gold(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """For every ranked (document, field): gold_count, first_gold_rank, hit, recall and reciprocal_rank, null but the first where there is no gold."""
    found = per_query(ranked, gold, [k]).select(*KEY, "gold_count", "first_gold_rank", "reciprocal_rank", F.col("at_k")[0].alias("_m"))
    out = ranked.select(*KEY).distinct().join(found, KEY, "left")
    return out.select(*KEY, F.coalesce("gold_count", F.lit(0)).alias("gold_count"), "first_gold_rank", F.col("_m.hit").alias("hit_at_k"), F.col("_m.recall").alias("recall_at_k"), "reciprocal_rank")
