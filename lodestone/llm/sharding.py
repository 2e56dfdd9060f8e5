"""Sharding by proportional stratified interleaving.

Rows are put in a seeded order within their source; a row's fractional rank is (rank + 1/2) / (rows of its source). Sorted by
fractional rank, all sources run side by side in proportion, so cutting the sorted rows into equal runs gives shards that
all match the mixture. Shard sizes in rows differ by one at most (law `rows`).

Both ranks are counted in buckets of hash values or of fractional ranks, so the largest source is ranked by many tasks: a
row's rank is the rows of earlier buckets plus its place in its own. Bucket numbers are bounded (`most_buckets`).

Defined cases: a null source is a source of its own; null and empty texts are rows like others; repeated rows have places of
their own, and which of equal rows gets which is left open; ids may be null or repeat (order and bucket follow a hash of id and
all other columns). Extra columns are kept, whatever their names (they are renamed inside); input columns named like an
output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interleaved(docs: DataFrame, shards: int, source: str = "source", id_col: str = "doc_id", seed: int = 7, most_buckets: int = 1 << 14) -> DataFrame:
    """docs with shard (0 .. shards-1) and slot (0, 1, .. within the shard, by fractional rank)."""
    docs = docs.drop("shard", "slot")
    names = docs.columns
    keep = [f"_c{i}" for i in range(len(names))]
    id_at, source_at = keep[names.index(id_col)], keep[names.index(source)]
    rows = docs.count()
    if not rows:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    buckets = 1 << max(4, min(most_buckets, rows // 64).bit_length())
    docs = docs.toDF(*keep)
    others = [F.col(c) for c in keep if c not in (source_at, id_at)]
    low = lambda c: F.shiftrightunsigned(c, 1)  # noqa: E731  hashes as nonnegative numbers
    keyed = docs.withColumns(
        {
            "_sh_key": F.when(F.col(source_at).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_at).cast("string"))),
            "_sh_hash": low(F.xxhash64(F.col(id_at), *others, F.lit(seed))),
        }
    ).withColumn("_sh_bucket", F.shiftright("_sh_hash", 63 - (buckets.bit_length() - 1)))
    counts = keyed.groupBy("_sh_key", "_sh_bucket").agg(F.count("*").alias("_sh_n"))
    by_source = Window.partitionBy("_sh_key").orderBy("_sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_sh_key", "_sh_bucket", F.coalesce(F.sum("_sh_n").over(by_source), F.lit(0)).alias("_sh_before"), F.sum("_sh_n").over(Window.partitionBy("_sh_key")).alias("_sh_total"))
    place = F.row_number().over(Window.partitionBy("_sh_key", "_sh_bucket").orderBy("_sh_hash", id_at))
    ranked = keyed.withColumn("_sh_place", place).join(before, ["_sh_key", "_sh_bucket"])
    # (2 rank + 1) / (2 total) as a bucket of equal width, in whole numbers
    rank = F.col("_sh_before") + F.col("_sh_place") - 1
    ranked = ranked.withColumns({"_sh_rank": rank, "_sh_slice": F.expr(f"((2 * (_sh_before + _sh_place - 1) + 1) * {buckets}L) div (2 * _sh_total)")})
    slices = ranked.groupBy("_sh_slice").agg(F.count("*").alias("_sh_m"))
    # at most most_buckets rows
    offset = slices.select("_sh_slice", F.coalesce(F.sum("_sh_m").over(Window.orderBy("_sh_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sh_offset"))
    inside = F.row_number().over(Window.partitionBy("_sh_slice").orderBy(F.expr("(2 * _sh_rank + 1) / (2D * _sh_total)"), F.xxhash64("_sh_key", F.lit(seed)), "_sh_key", "_sh_rank"))
    placed = ranked.withColumn("_sh_inside", inside).join(F.broadcast(offset), "_sh_slice").withColumn("_sh_at", F.col("_sh_offset") + F.col("_sh_inside") - 1)
    # shard k holds places floor(k N / S) .. floor((k+1) N / S) - 1
    shard = F.expr(f"((_sh_at + 1) * {shards}L - 1) div {rows}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.col("_sh_at") - F.expr(f"(CAST(shard AS BIGINT) * {rows}L) div {shards}L")
    return placed.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], "shard", slot.alias("slot"))


def shard_digests(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source of every row; the text itself is not dealt out."""
    slim = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return interleaved(slim, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")

