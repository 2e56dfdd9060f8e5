"""Four-state screening of documents: one pass over the blocks, windows by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.spec import Spec
from ..functions.text import contains_any, has_number, has_unit, is_prediction


def evidence(blocks: DataFrame, spec: Spec) -> DataFrame:
    """blocks with is_target, in_window (a target within one ordinal), numeric and excluded."""
    terms = [t for f in spec.targets for t in f.screening_terms]
    near = Window.partitionBy("document_id").orderBy(F.col("ordinal").cast("long")).rangeBetween(-1, 1)
    out = blocks.withColumn("is_target", contains_any("text", terms))
    out = out.withColumn("in_window", F.max("is_target").over(near))
    out = out.withColumn("numeric", F.col("in_window") & has_number("text") & (has_unit("text") | F.col("kind").isin(*K.CAPTION_KINDS)))
    drop = is_prediction("text") if "model_prediction" in spec.exclusions else F.lit(False)
    return out.withColumn("excluded", F.col("numeric") & drop)


def screened(blocks: DataFrame, spec: Spec, documents: DataFrame | None = None) -> DataFrame:
    """document_id, target_blocks, numeric_blocks, excluded_blocks, missing_required, screening_status, screening_reasons.

    documents (document_id, parser_status) adds documents without blocks and those that failed to parse.
    """
    found = {f.name: F.max(contains_any("text", f.screening_terms)) for f in spec.required}
    agg = evidence(blocks, spec).groupBy("document_id").agg(
        F.count_if("is_target").alias("target_blocks"), F.count_if(F.col("numeric") & ~F.col("excluded")).alias("numeric_blocks"),
        F.count_if("excluded").alias("excluded_blocks"), *[c.alias(f"_has{i}") for i, c in enumerate(found.values())],
    )
    if documents is not None:
        agg = documents.select("document_id", "parser_status").join(agg, "document_id", "left").fillna(0, ["target_blocks", "numeric_blocks", "excluded_blocks"])
    else:
        agg = agg.withColumn("parser_status", F.lit("ok"))
    failed = F.col("parser_status") == "failed"
    gone = [F.when(failed | ~F.coalesce(F.col(f"_has{i}"), F.lit(False)), F.lit(n)) for i, n in enumerate(found)]
    missing = F.filter(F.array(*gone), lambda x: x.isNotNull()) if gone else F.array().cast("array<string>")
    out = agg.withColumn("missing_required", missing)
    some, none_missing = F.col("numeric_blocks") > 0, F.size("missing_required") == 0
    status = F.when(failed, "failed").when(some & none_missing, "usable").when(some, "relative").otherwise("nodata")
    verdict = F.when(some & none_missing, F.lit(K.REASON_USABLE)).when(some, F.concat(F.lit(K.REASON_RELATIVE), F.array_join("missing_required", ", "))).otherwise(F.lit(K.REASON_NODATA))
    reasons = F.filter(
        F.array(
            F.concat(F.lit(K.REASON_TARGET), F.col("target_blocks").cast("string")), F.concat(F.lit(K.REASON_NUMERIC), F.col("numeric_blocks").cast("string")),
            F.when(F.col("excluded_blocks") > 0, F.concat(F.lit(K.REASON_EXCLUDED), F.col("excluded_blocks").cast("string"))), verdict,
        ),
        lambda x: x.isNotNull(),
    )
    out = out.withColumns({"screening_status": status, "screening_reasons": F.when(failed, F.array(F.lit(K.REASON_FAILED))).otherwise(reasons)})
    return out.select("document_id", "target_blocks", "numeric_blocks", "excluded_blocks", "missing_required", "screening_status", "screening_reasons")


def covered_fields(blocks: DataFrame, spec: Spec) -> DataFrame:
    """document_id and covered: labels of the fields (targets, required, optional) that some block mentions, in that order."""
    fields = (*spec.targets, *spec.required, *spec.optional)
    agg = blocks.groupBy("document_id").agg(*[F.max(contains_any("text", f.screening_terms)).alias(f"_c{i}") for i, f in enumerate(fields)])
    labels = F.filter(F.array(*[F.when(F.col(f"_c{i}"), F.lit(f.label)) for i, f in enumerate(fields)]), lambda x: x.isNotNull())
    return agg.select("document_id", F.array_distinct(labels).alias("covered"))
