"""Ranking of every (document, field) pair in one plan.

Blocks are scanned and tokenised once: term frequencies of all query terms, lengths and matches are written as narrow rows without
texts. Document frequency, length and extremes are sums and extremes by document with partial aggregation, joined back with
hot documents by broadcast, so a document with a third of all blocks is scored by many tasks. The rank is a window over (document,
field), and a top-k is cut in each task before the shuffle. Branches of weight zero are left out of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.spec import Spec, expected_sections
from ..functions.text import normalize, tokenize
from ..scratch import met, written


@dataclass(frozen=True)
class Weights:
    bm25: float = K.WEIGHTS["bm25"]
    vector_similarity: float = K.WEIGHTS["vector_similarity"]
    term_coverage: float = K.WEIGHTS["term_coverage"]
    section_prior: float = K.WEIGHTS["section_prior"]

    def __post_init__(self):
        values = [getattr(self, f.name) for f in fields(self)]
        if min(values) < 0:
            raise ValueError("weights must not be negative")
        if abs(sum(values) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


BM25_ONLY = Weights(1.0, 0.0, 0.0, 0.0)
LEXICAL = Weights(0.75, 0.0, 0.2, 0.05)


def query_tokens(spark, queries: dict[str, str]) -> dict[str, list[str]]:
    """Distinct tokens of each field's query, by the same expression as the blocks' tokens."""
    rows = spark.createDataFrame(list(queries.items()), "field string, query string").select("field", F.array_distinct(tokenize("query")).alias("t")).collect()
    return {r.field: r.t for r in rows}


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = F.when(average > 0, length / average).otherwise(0.0)
    return F.when(tf > 0, idf * tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * norm))).otherwise(0.0)


def _equals(term: str):
    return lambda x: x == term


def minmax(value: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; where all values are alike, 1 for positive ones and 0 for others."""
    alike = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(alike, F.when(value > 0, 1.0).otherwise(0.0)).otherwise((value - low) / F.when(alike, 1.0).otherwise(high - low))


def section_prior(field: str) -> Column:
    return F.when(F.col("section").isin(*expected_sections(field)), K.PRIOR_SECTION).when(F.col("kind").isin(*K.CAPTION_KINDS), K.PRIOR_CAPTION).otherwise(K.PRIOR_OTHER)


def matched_terms(terms: list[str], text: Column) -> Column:
    """Terms that the normalised text holds, as written and in the order of the specification."""
    hits = [F.when(F.contains(text, normalize(F.lit(t))), F.lit(t)) for t in terms]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def coverage(terms: list[str], text: Column) -> Column:
    """Share of the distinct non-blank normalised terms that the text holds."""
    total = F.size(F.array_distinct(F.array(*[normalize(F.lit(t)) for t in terms if t.strip()])))
    found = F.size(F.array_distinct(F.transform(matched_terms(terms, text), normalize)))
    return found / total if any(t.strip() for t in terms) else F.lit(0.0)


def scored(blocks: DataFrame, spec: Spec, names: list[str], weights: Weights | None = None, vectors: DataFrame | None = None, keep: tuple[str, ...] = (), cosines: Column | None = None) -> DataFrame:
    """One row for each block and field, unranked: components, matched terms and the weighted score.

    blocks: document_id, block_id, ordinal, section, kind, text. vectors: block_id, field_name, semantic (a cosine), joined only
    if the weights use it. cosines: instead of vectors, an array over blocks with a cosine for each of `names`, made in the pass over
    the texts and not joined. `keep`: further columns of blocks to carry.
    """
    weights = weights or Weights()
    spark = blocks.sparkSession
    tokens = query_tokens(spark, {f: spec.query_for(f) for f in names})
    terms = sorted({t for q in tokens.values() for t in q})
    own = [cosines.alias("_sem")] if weights.vector_similarity and cosines is not None else []
    base = blocks.select("document_id", "block_id", "ordinal", "section", "kind", *keep, normalize("text").alias("_low"), tokenize("text").alias("_tok"), *own)
    tf = {t: f"_tf{i}" for i, t in enumerate(terms)}
    base = base.withColumns({"_len": F.size("_tok").cast("double"), **{c: F.size(F.filter("_tok", _equals(t))).cast("double") for t, c in tf.items()}})
    parts = {}
    for i, f in enumerate(names):
        if weights.term_coverage:
            parts[f"_cov{i}"] = coverage(spec.terms_for(f), F.col("_low"))
        parts[f"_hit{i}"] = matched_terms(spec.terms_for(f), F.col("_low"))
    base = written(base.withColumns(parts).drop("_tok", "_low"))
    total = max(1, base.count())
    facts = base.groupBy("document_id").agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(c) > 0).cast("double")).alias(f"_df{c}") for c in tf.values()])
    stats = met(base, facts, "document_id", "_n", total)
    raw = {}
    for i, f in enumerate(names):
        sums = F.lit(0.0)
        for t in tokens[f]:
            sums = sums + bm25(F.col(tf[t]), F.col(f"_df{tf[t]}"), F.col("_n").cast("double"), F.col("_len"), F.col("_avg"))
        raw[f"_raw{i}"] = sums
    stats = stats.withColumns(raw).drop("_n")
    ends = [f(f"_raw{i}").alias(f"_{n}{i}") for i in range(len(names)) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    stats = met(stats, stats.groupBy("document_id").agg(F.count("*").alias("_n"), *ends), "document_id", "_n", total)
    per_field = [
        F.struct(
            F.lit(f).alias("field_name"), F.col(f"_raw{i}").alias("bm25_raw"), minmax(F.col(f"_raw{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")).alias("bm25"),
            (F.col(f"_cov{i}") if weights.term_coverage else F.lit(0.0)).alias("term_coverage"),
            section_prior(f).alias("section_prior"), F.col(f"_hit{i}").alias("matched_terms"),
            *([F.greatest(F.lit(0.0), F.coalesce(F.col("_sem")[i], F.lit(0.0))).alias("semantic")] if own else []),
        )
        for i, f in enumerate(names)
    ]
    out = stats.select("document_id", "block_id", "ordinal", *keep, F.array(*per_field).alias("_f")).select("document_id", "block_id", "ordinal", *keep, F.inline("_f"))
    if own:
        pass
    elif weights.vector_similarity and vectors is not None:
        out = out.join(vectors.select("block_id", "field_name", F.greatest(F.lit(0.0), "semantic").alias("semantic")), ["block_id", "field_name"], "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    else:
        out = out.withColumn("semantic", F.lit(0.0))
    return rescored(out, weights)


def rescored(rows: DataFrame, weights: Weights) -> DataFrame:
    """Rows of scored() with the score at these weights; components that weren't made there stay zero."""
    score = F.lit(0.0)
    for w, c in ((weights.bm25, "bm25"), (weights.vector_similarity, "semantic"), (weights.term_coverage, "term_coverage"), (weights.section_prior, "section_prior")):
        if w:
            score = score + w * F.col(c)
    return rows.withColumn("score", F.round(score, 6))


def semantic(vectors: DataFrame, queries: dict[str, list[float]]) -> DataFrame:
    """block_id, field_name and semantic (the cosine) for each row of vectors (block_id, vector) and each field's query vector. The query
    vectors are literals of the plan: as many as there are fields."""
    each = [F.struct(F.lit(f).alias("field_name"), cosine("vector", F.array(*[F.lit(float(x)) for x in q])).alias("semantic")) for f, q in queries.items()]
    return vectors.select("block_id", F.inline(F.array(*each)))


def ranked(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Rank within document and field by rounded score, then ordinal; with k, only the first k."""
    if k is not None and not 1 <= k <= 30:
        raise ValueError("k lies in 1..30")
    w = Window.partitionBy("document_id", "field_name").orderBy(F.desc("score"), F.asc("ordinal"))
    out = rows.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def cosine(a, b) -> Column:
    """Dot product in double precision of vectors that are unit already; different lengths are an error, null gives null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors have different lengths")).cast("double")).when(a.isNotNull() & b.isNotNull(), dot)


def compared(strategies: dict[str, DataFrame | None]) -> DataFrame:
    """Ranked rows of several strategies under a `strategy` column; an unavailable one (None) gives no rows."""
    out = None
    for name, rows in strategies.items():
        if rows is not None:
            tagged = rows.withColumn("strategy", F.lit(name))
            out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no strategy is available")
    return out


def rank_delta(hits: DataFrame, baseline: DataFrame) -> DataFrame:
    """hits with baseline rank, delta (positive: moved up; null outside the baseline's rows) and shown (delta as a text)."""
    b = baseline.select("document_id", "field_name", "block_id", F.col("rank").alias("baseline_rank"))
    out = hits.join(b, ["document_id", "field_name", "block_id"], "left").withColumn("delta", F.col("baseline_rank") - F.col("rank"))
    moved = F.concat(F.when(F.col("delta") > 0, K.DELTA_UP).otherwise(K.DELTA_DOWN), F.abs("delta").cast("string"))
    return out.withColumn("shown", F.when(F.col("delta").isNull(), K.DELTA_OUTSIDE).when(F.col("delta") == 0, K.DELTA_SAME).otherwise(moved))
