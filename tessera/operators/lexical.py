"""Keyword search over trigrams: substring candidates, BM25 ranking, word-prefix recheck."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import literal_tokens, matches_literal

K1, B = 1.2, 0.75
CANDIDATES = 4096


def trigrams(tokens: list[str]) -> list[str]:
    """The distinct trigrams of tokens of at least three characters, in order."""
    return list(dict.fromkeys(t[k : k + 3] for t in map(str.lower, tokens) for k in range(len(t) - 2)))


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def term_frequency(text: Column, gram: str) -> Column:
    """Occurrences, overlapping ones included, in lower-case text."""
    return F.regexp_count(text, F.lit(f"(?={_quoted(gram)})"))


def bm25(rows: DataFrame, tokens: list[str], text_col: str = "text") -> DataFrame:
    """`rows` that have all trigrams of all tokens, with their BM25 score.

    The statistics over all rows (number, mean length, document frequencies of
    the query's trigrams) are one aggregate of one row; scoring is a projection.
    """
    grams = trigrams([t for t in tokens if len(t) >= 3])
    if not grams:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0.0))
    low = F.lower(F.col(text_col))
    size = F.greatest(F.length(low) - 2, F.lit(0)).cast("double")
    stats = rows.agg(F.count("*").alias("n"), F.avg(size).alias("mean"), *(F.count_if(low.contains(g)).alias(f"df_{k}") for k, g in enumerate(grams)))
    has_all = F.lit(True)
    for g in grams:
        has_all = has_all & low.contains(g)
    counted = rows.where(has_all).withColumns({f"_tf_{k}": term_frequency(low, g) for k, g in enumerate(grams)}).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for k in range(len(grams)):
        idf = F.log(1 + (F.col("n") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5))
        tf = F.col(f"_tf_{k}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("mean")))
    return counted.withColumn("score", F.round(score, 9)).select(*rows.columns, "score")


def substring_search(rows: DataFrame, tokens: list[str], k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The k best rows that contain all tokens of at least three characters; none if no token is left."""
    return bm25(rows, tokens, text_col).orderBy(F.col("score").desc(), id_col).limit(k)


def literal_candidates(rows: DataFrame, literal: str, limit: int | None = CANDIDATES, id_col: str = "id", text_col: str = "text") -> DataFrame | None:
    """Rows in which every token of the literal begins a word, scored; None for a literal without tokens."""
    tokens = literal_tokens(literal)
    if not tokens:
        return None
    found = bm25(rows, tokens, text_col)
    if limit is not None:
        found = found.orderBy(F.col("score").desc(), id_col).limit(limit)
    return found.where(matches_literal(F.col(text_col), literal))
