"""From lines to evidence blocks: merge lines, carry sections forward, number blocks, judge documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import is_caption, kind_of, language, section_of, stable_id

PAGE = ["document_id", "page"]


def line_breaks(lines: DataFrame) -> DataFrame:
    """lines with median_height (of the page, heights at least 1), alone (heading or caption), gap and column_jump against the
    line before on the page. lines: document_id, page, line_no, text, x0, top, x1, bottom."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    height = F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))
    medians = lines.groupBy(*PAGE).agg(F.median(height).alias("median_height"))
    out = lines.join(medians, PAGE)
    last = {c: F.lag(c).over(w) for c in ("x0", "bottom")}
    return out.withColumns(
        {
            "alone": section_of("text").isNotNull() | is_caption("text"),
            "gap": F.coalesce(F.col("top") - last["bottom"] > 1.5 * F.col("median_height"), F.lit(False)),
            "column_jump": F.coalesce((F.abs(F.col("x0") - last["x0"]) > 160) & (F.col("top") <= last["bottom"] + F.col("median_height")), F.lit(False)),
        }
    )


def merged_lines(lines: DataFrame, most: int = 850) -> DataFrame:
    """Each line with its block number on the page. A block ends before a heading, caption, gap or jump, after a heading or
    caption, and once it holds over `most` characters. The last rule restarts with each block, so a fold runs over the
    lines of a page; the others are flags computed before."""
    flagged = line_breaks(lines)
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    flagged = flagged.withColumn("cut", F.col("alone") | F.col("gap") | F.col("column_jump") | F.coalesce(F.lag("alone").over(w), F.lit(True)))
    item = F.struct("line_no", "text", "x0", "top", "x1", "bottom", "cut")
    pages = flagged.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("l"))
    start = F.named_struct(F.lit("chars"), F.lit(0), F.lit("block"), F.lit(0), F.lit("out"), F.array().cast("array<int>"))

    def step(acc: Column, x: Column) -> Column:
        new = x["cut"] | (acc["chars"] > most)
        block = F.when(new, acc["block"] + 1).otherwise(acc["block"])
        return F.named_struct(F.lit("chars"), F.when(new, F.length(x["text"])).otherwise(acc["chars"] + F.length(x["text"])), F.lit("block"), block, F.lit("out"), F.concat(acc["out"], F.array(block)))

    numbered = pages.withColumn("n", F.aggregate("l", start, step)["out"])
    both = numbered.select(*PAGE, F.inline(F.arrays_zip("l", "n")))
    return both.select(*PAGE, F.col("l.line_no").alias("line_no"), F.col("l.text").alias("text"), *[F.col(f"l.{c}").alias(c) for c in ("x0", "top", "x1", "bottom")], F.col("n").alias("block_no"))


def blocks_of(lines: DataFrame) -> DataFrame:
    """Evidence blocks with ordinal, section, kind, stable id and bbox."""
    grouped = merged_lines(lines).groupBy(*PAGE, "block_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "top"), (F.max, "x1"), (F.max, "bottom"))],
    )
    w = Window.partitionBy("document_id").orderBy("page", "block_no")
    out = grouped.withColumns({"text": F.trim("text"), "ordinal": F.row_number().over(w)})
    out = sectioned(out)
    return out.select(
        "document_id", stable_id("block", "document_id", "page", "ordinal", "text").alias("block_id"), "ordinal", "page", "section", "kind", "text",
        F.array(*[F.round(c, 2) for c in ("x0", "top", "x1", "bottom")]).alias("bbox"),
    )


def sectioned(blocks: DataFrame) -> DataFrame:
    """blocks with section, carried forward from the last heading of the document, and kind."""
    w = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last(section_of("text"), ignorenulls=True).over(w), F.lit(K.FRONT))
    return blocks.withColumns({"section": section, "kind": kind_of("text")})


def document_facts(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """document_id, text_char_count (blocks joined by line feeds), page_count, low_text_pages, language and parser_status.

    pages (document_id, page) lists all pages; without it, pages with blocks are all there are. Of the texts only what lies in the
    first LANGUAGE_CHARS characters is gathered; the rest is counted.
    """
    size = F.length("text")
    before = F.coalesce(F.sum(size + 1).over(Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("document_id", "page", size.alias("_size"), "ordinal", before.alias("_at"), F.substring("text", 1, K.LANGUAGE_CHARS).alias("_text"))
    head = F.when(F.col("_at") < K.LANGUAGE_CHARS, F.struct("ordinal", "_text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(head)), lambda x: x["_text"]), "\n")
    agg = placed.groupBy("document_id").agg(F.countDistinct("page").alias("_full"), F.count("*").alias("_n"), F.sum("_size").alias("_chars"), joined.alias("_head"))
    if pages is not None:
        agg = pages.groupBy("document_id").agg(F.countDistinct("page").alias("page_count")).join(agg, "document_id", "left").fillna({"_full": 0, "_n": 0, "_chars": 0, "_head": ""})
    else:
        agg = agg.withColumn("page_count", F.col("_full"))
    chars, low = (F.col("_chars") + F.greatest(F.col("_n") - 1, F.lit(0))).cast("int"), F.col("page_count") - F.col("_full")
    status = F.when((chars < 100) | (F.col("_n") == 0), "failed").when((F.col("page_count") > 0) & (low / F.greatest(F.col("page_count"), F.lit(1)) >= 0.2), "warning").otherwise("ok")
    return agg.select("document_id", chars.alias("text_char_count"), "page_count", low.alias("low_text_pages"), language("_head").alias("language"), status.alias("parser_status"))


def sync_counts(states: DataFrame) -> DataFrame:
    """One row of parsed, reused and failed from files with `reused` and `parser_status`."""
    fresh = ~F.col("reused")
    bad = F.coalesce(F.col("parser_status") == "failed", F.lit(False))
    return states.agg(F.count_if(fresh & ~bad).alias("parsed"), F.count_if("reused").alias("reused"), F.count_if(fresh & bad).alias("failed"))


def titles(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """documents (document_id, filename, title, created) with title and publication_year by the fallback rules."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    first = blocks.where((F.col("page") <= 2) & F.length("text").between(12, 300)).withColumn("_r", F.row_number().over(w)).where("_r <= 20")
    fits = ~F.col("text").rlike(f"^(?:{K.YEAR_PATTERN})$") & ~F.col("text").rlike("(?i)" + K.DOI_PATTERN) & ~F.lower("text").contains("journal")
    best = first.where(fits).groupBy("document_id").agg(F.min_by("text", "ordinal").alias("_line"))
    said = F.trim(F.coalesce("title", F.lit("")))
    generic = F.lower(said).isin(*K.GENERIC_TITLES) | (F.length(said) < 8)
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    year = lambda c: F.nullif(F.regexp_extract(c, f"({K.YEAR_PATTERN})", 1), F.lit(""))
    out = documents.join(best, "document_id", "left")
    return out.withColumns({"title": F.substring(F.when(generic, F.coalesce("_line", stem)).otherwise(said), 1, 500), "publication_year": F.coalesce(year("filename"), year("created")).cast("int")}).drop("_line")


def overview(documents: DataFrame, blocks: DataFrame, covered: DataFrame) -> DataFrame:
    """Compact row for each document: counts of blocks and captions, sections, covered fields, summary."""
    agg = blocks.groupBy("document_id").agg(
        F.count("*").alias("block_count"), F.count_if(F.col("kind") == "figure_caption").alias("figure_caption_count"), F.count_if(F.col("kind") == "table_caption").alias("table_caption_count"),
        F.array_sort(F.collect_set(F.when(F.col("section") != K.FRONT, F.col("section")))).alias("sections"),
    )
    out = documents.join(agg, "document_id", "left").join(covered, "document_id", "left").fillna(0, ["block_count", "figure_caption_count", "table_caption_count"])
    names = F.when(F.size("covered") > 0, F.array_join("covered", "、")).otherwise(K.SUMMARY_NO_FIELDS)
    failed = F.format_string(K.SUMMARY_FAILED, "page_count")
    good = F.format_string(K.SUMMARY_OK, "page_count", "block_count", names, "figure_caption_count", "table_caption_count")
    return out.withColumn("summary", F.when(F.col("parser_status") == "failed", failed).otherwise(good)).withColumnRenamed("covered", "covered_fields")
