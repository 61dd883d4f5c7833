"""From segments of text to chunks with source offsets; no operator here shuffles.

A segment is (text, page, col, base_offset); a chunk is (text, char_start,
char_end, page, page_char_start) with end exclusive, in characters of the full
text. For tables page is the data row and page_char_start the column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import let, spaced_words, word_count

SIZE, OVERLAP = 50, 10
STEPS_A_BLOCK = 64
CHUNK = "array<struct<k:int,text:string,char_start:bigint,char_end:bigint>>"


class Chunker(Protocol):
    def chunk(self, segments: DataFrame) -> DataFrame:
        """Segments (text, page, col, base_offset and further columns) to chunks."""


def word_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The overlapping windows of `size` words, as an array of (k, text, char_start, char_end).

    Windows advance by size - overlap words and stop once one reaches the last
    word. Text is cut verbatim. Offsets come from sums over whole steps, taken
    in blocks of `STEPS_A_BLOCK` and within a block.
    """
    size = max(1, size)
    step = size - min(max(0, overlap), size - 1)

    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    block = F.lit(STEPS_A_BLOCK)

    def windows(words: Column, count: Column, steps: Column, blocks: Column) -> Column:
        def window(k: Column) -> Column:
            raw = F.array_join(F.slice(words, k * step + 1, F.lit(size)), "")
            before = total(F.slice(blocks, F.lit(1), F.floor(k / block).cast("int"))) + total(F.slice(steps, F.floor(k / block).cast("int") * block + 1, k % block))
            return let(
                F.struct(raw.alias("raw"), F.regexp_replace(raw, r"(?U)^\s+", "").alias("text"), before.alias("before")),
                lambda w: F.struct(
                    k.cast("int").alias("k"),
                    w["text"].alias("text"),
                    (w["before"] + F.length(w["raw"]) - F.length(w["text"])).cast("bigint").alias("char_start"),
                    (w["before"] + F.length(w["raw"])).cast("bigint").alias("char_end"),
                ),
            )

        return F.transform(F.sequence(F.lit(0), count - 1), window)

    def all_of(words: Column) -> Column:
        n = F.size(words)
        count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.lit(step))).cast("int")
        steps = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.length(F.array_join(F.slice(words, k * step + 1, F.lit(step)), "")))
        blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")), lambda b: total(F.slice(s, b * block + 1, block)))
        return F.when(n > 0, let(steps, lambda s: let(blocks(s), lambda sums: windows(words, count, s, sums)))).otherwise(F.expr(f"cast(array() as {CHUNK})"))

    return let(spaced_words(text), all_of)


class WordWindowChunker:
    """Windows within each segment; segments without words give none."""

    def __init__(self, size: int = SIZE, overlap: int = OVERLAP):
        self.size, self.overlap = size, overlap

    def chunk(self, segments: DataFrame) -> DataFrame:
        rest = [c for c in segments.columns if c not in ("text", "page", "col", "base_offset")]
        cut = segments.select(*rest, "page", "base_offset", F.explode(word_windows(F.col("text"), self.size, self.overlap)).alias("c"))
        return cut.select(*rest, "c.k", "c.text", (F.col("c.char_start") + F.col("base_offset")).alias("char_start"), (F.col("c.char_end") + F.col("base_offset")).alias("char_end"), "page", F.col("c.char_start").alias("page_char_start"))


class CellChunker:
    """One chunk for each segment that isn't empty."""

    def chunk(self, segments: DataFrame) -> DataFrame:
        rest = [c for c in segments.columns if c not in ("text", "page", "col", "base_offset")]
        full = segments.where(F.col("text") != "")
        return full.select(*rest, F.lit(0).alias("k"), "text", F.col("base_offset").cast("bigint").alias("char_start"), (F.col("base_offset") + F.length("text")).cast("bigint").alias("char_end"), "page", F.col("col").cast("bigint").alias("page_char_start"))


def flat_segments(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """One segment a document."""
    return documents.withColumns({"text": F.col(text_col), "page": F.lit(None).cast("bigint"), "col": F.lit(None).cast("bigint"), "base_offset": F.lit(0).cast("bigint")})


def page_segments(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text") -> DataFrame:
    """Pages as segments of the full text in which line feeds join them."""
    before = Window.partitionBy(doc_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length(text_col) + 1).over(before), F.lit(0)).cast("bigint")
    return pages.select(F.col(doc_col), F.col(text_col).alias("text"), F.col(page_col).cast("bigint").alias("page"), F.lit(None).cast("bigint").alias("col"), offset.alias("base_offset"))


def header_label(headers: Column, col: Column) -> Column:
    """The header's text, or Column N where it is blank or missing."""
    name = F.get(headers, col)
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.concat(F.lit("Column "), (col + 1).cast("string"))).otherwise(name)


def cell_segments(grids: DataFrame, headers: str = "headers", rows: str = "rows") -> DataFrame:
    """Segments "header: value" of the cells that aren't empty, in reading order, joined by line feeds."""
    label = lambda c: header_label(F.col(headers), c)
    per_row = F.transform(F.col(rows), lambda row, r: F.transform(row, lambda v, c: F.struct(r.cast("bigint").alias("page"), c.cast("bigint").alias("col"), v.alias("value"), F.concat(label(c), F.lit(": "), v).alias("text"))))
    cells = F.filter(F.flatten(per_row), lambda x: x["value"] != "")
    rest = [c for c in grids.columns if c not in (headers, rows)]
    spread = grids.withColumn("_grid", F.monotonically_increasing_id()).select(*rest, "_grid", F.posexplode(cells).alias("_at", "_cell"))
    before = Window.partitionBy("_grid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("_cell.text") + 1).over(before), F.lit(0)).cast("bigint")
    return spread.select(*rest, "_cell.text", "_cell.page", "_cell.col", offset.alias("base_offset"))


def full_text(segments: DataFrame, doc_col: str) -> DataFrame:
    """Segments of each document joined by line feeds in order of offset."""
    ordered = F.array_sort(F.collect_list(F.struct("base_offset", "text")))
    return segments.groupBy(doc_col).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("full_text"))


def plain_word_chunks(text: Column, size: int = 128) -> Column:
    """Blocks of words joined by single spaces, without overlap."""
    def blocks(words: Column) -> Column:
        count = F.ceil(F.size(words) / F.lit(size)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice(words, k * size + 1, F.lit(size)), " "))
        return F.when(count > 0, cut).otherwise(F.expr("cast(array() as array<string>)"))

    return let(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), blocks)


def file_stats(text: Column) -> dict[str, Column]:
    return {"char_len": F.length(text).cast("bigint"), "word_count": word_count(text).cast("bigint"), "byte_len": F.octet_length(text).cast("bigint")}


def register(spark: SparkSession) -> None:
    """The table function word_window_chunks(text, size, overlap) for SQL."""

    @F.udtf(returnType="k int, text string, char_start bigint, char_end bigint")
    class WordWindowChunks:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, int]]:
            import re

            spans = [m.span() for m in re.finditer(r"\S+", text or "")]
            step = max(1, size) - min(max(0, overlap), max(1, size) - 1)
            for k, lo in enumerate(range(0, len(spans), step)):
                hi = min(lo + max(1, size), len(spans))
                yield k, text[spans[lo][0] : spans[hi - 1][1]], spans[lo][0], spans[hi - 1][1]
                if hi == len(spans):
                    return

    spark.udtf.register("word_window_chunks", WordWindowChunks)
