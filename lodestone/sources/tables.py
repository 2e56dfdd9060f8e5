"""Sources: the driver's tables as evidence collections, and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_blocks(docs: DataFrame) -> DataFrame:
    """One block for each non-empty line of a document; ordinal is the line's position from 1, so blank lines leave gaps."""
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    text = F.trim("line")
    return lines.select("document_id", (F.col("p") + 1).alias("ordinal"), text.alias("text")).where(F.length("text") > 0)


def source_blocks(docs: DataFrame) -> DataFrame:
    """A source as a paper, its documents as blocks: section follows the language, lines with bars make a table caption."""
    section = F.when(F.col("lang") == "en", "methods").when(F.col("lang") == "fr", "results").when(F.col("lang") == "de", "discussion").otherwise("introduction")
    kind = F.when(F.contains("text", F.lit("|")), "table_caption").otherwise("text")
    return docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("block_id"), F.col("doc_id").alias("ordinal"), section.alias("section"), kind.alias("kind"), "text")


def source_gold(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of good quality as gold evidence for every field."""
    good = labels.where("quality = 1").select("doc_id")
    return docs.join(good, "doc_id").select(F.col("source").alias("document_id"), F.col("doc_id").alias("block_id"))


def page_lines(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """Lines with a page and a position on it, laid out from their place and length."""
    b = line_blocks(docs)
    n = F.length("text")
    top = (F.col("ordinal") * 12 + n % 5).cast("double")
    x0 = (10 + (n % 3) * 100).cast("double")
    return b.select(
        "document_id", (F.floor((F.col("ordinal") - 1) / per_page) + 1).cast("int").alias("page"), F.col("ordinal").alias("line_no"), "text",
        x0.alias("x0"), top.alias("top"), (x0 + n).alias("x1"), (top + 6 + n % 4).alias("bottom"),
    )


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder (not below it) with path, name, content and its SHA-256; none is an error. What isn't used isn't read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    out = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), "content")
    if out.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return out


def text_lines(found: DataFrame, per_page: int = 60) -> DataFrame:
    """Lines of plain text files (filename, sha256, document_id, content): white space collapsed, empty lines dropped, laid out in rows
    of equal height."""
    lines = found.select("document_id", "sha256", "filename", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("p", "line"))
    text = F.trim(F.regexp_replace("line", r"(?U)\s+", " "))
    on_page = (F.col("p") % per_page) * 14.0
    out = lines.select(
        "document_id", "sha256", "filename", (F.floor(F.col("p") / per_page) + 1).cast("int").alias("page"), (F.col("p") + 1).alias("line_no"), text.alias("text"),
        F.lit(40.0).alias("x0"), on_page.alias("top"), F.lit(555.0).alias("x1"), (on_page + 10.0).alias("bottom"),
    )
    return out.where(F.length("text") > 0)
