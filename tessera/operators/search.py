"""Hybrid search: weighted semantic terms, quoted keyword filters, relevance feedback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.embedder import QUERY_PREFIX, Embedder
from tessera.functions.query import WeightedTerm, normalize_weights, parse_query
from tessera.functions.text import literal_tokens, matches_all
from tessera.operators import ann, lexical, vectors

MODES = ("exact", "ann")
FILTERS = ("exact_filter", "over_fetch")
PAGE = 30


@dataclass(frozen=True)
class Preference:
    """A marked hit: its text joins the query with this weight."""

    text: str
    weight: float


def over_fetch(limit: int, filtered: bool) -> int:
    return max(20 * limit, 200) if filtered else limit


def _dense(rows: DataFrame, query: list[float], k: int, mode: str, index: ann.IvfIndex | None, id_col: str) -> DataFrame:
    if mode == "ann" and index is not None:
        near = ann.probed(rows.sparkSession, index, query).drop("cell")
        return vectors.top_k(near.join(rows.select(id_col), id_col, "left_semi"), query, k, id_col)  # rows may be a scope or filtered
    return vectors.top_k(rows, query, k, id_col)


def hybrid_search(
    rows: DataFrame,
    raw: str,
    embedder: Embedder,
    preferences: list[Preference] | None = None,
    limit: int = 20,
    mode: str = "exact",
    keyword_filter: str = "exact_filter",
    members: DataFrame | None = None,
    scope_key: str = "sha512",
    index: ann.IvfIndex | None = None,
    id_col: str = "id",
    prefix: str = QUERY_PREFIX,
) -> DataFrame:
    """The best rows for a query, with distance, score and score_kind.

    With terms, rows rank by cosine distance. Literals that have tokens
    filter before ranking; in "over_fetch" only the nearest max(20 * limit,
    200) rows, and of a literal's rows the best 4096, are looked at, so fewer
    than limit may come back though more match. With literals alone rows rank
    by the first one's keyword score. A literal that nothing matches, an empty
    scope or an empty query give no rows.
    """
    if mode not in MODES or keyword_filter not in FILTERS:
        raise ValueError(f"unknown mode: {mode}, {keyword_filter}")
    scoped = vectors.in_scope(rows, members, scope_key)
    parsed = parse_query(raw)
    wanted = [WeightedTerm(p.text, p.weight) for p in preferences or [] if p.weight != 0]
    query = vectors.centroid(normalize_weights(parsed.semantic + wanted), embedder, prefix)
    literals = [x for x in parsed.literals if literal_tokens(x)]
    capped = lexical.CANDIDATES if keyword_filter == "over_fetch" else None
    if query is None:
        if not literals:
            return vectors.top_k(scoped.where(F.lit(False)), [0.0] * embedder.dim, 0, id_col).withColumn("score_kind", F.lit("cosine"))
        found = lexical.literal_candidates(scoped, literals[0], capped, id_col).where(matches_all(F.col("text"), literals[1:]))
        ranked = found.orderBy(F.col("score").desc(), id_col).limit(limit)
        return ranked.withColumn("distance", F.lit(0.0)).withColumn("score_kind", F.lit("bm25"))
    if literals and keyword_filter == "exact_filter":
        scoped, literals = scoped.where(matches_all(F.col("text"), literals)), []
    near = _dense(scoped, query, over_fetch(limit, bool(literals)), mode, index, id_col)
    if literals:
        # the filter is a predicate on the rows fetched: the candidates' ids need no join
        near = near.where(matches_all(F.col("text"), literals))
        near = near.orderBy("distance", id_col).limit(limit)
    return near.withColumn("score_kind", F.lit("cosine"))


def enrich(hits: DataFrame, files: DataFrame, key: str = "sha512") -> DataFrame:
    """Hits with file name and type; a file that isn't known shows its key and counts as text."""
    about = files.select(F.col(key), F.col("basename").alias("_name"), F.col("filetype").alias("_type"))
    return hits.join(about, key, "left").withColumn("basename", F.coalesce("_name", key)).withColumn("filetype", F.coalesce("_type", F.lit("text"))).drop("_name", "_type")


def group_by_file(hits: DataFrame, key: str = "sha512", id_col: str = "id") -> DataFrame:
    """Files by mean score, each with its hits from best to worst."""
    entry = F.struct((-F.col("score")).alias("order"), F.col(id_col).alias("id"), F.col("score"))
    best = F.transform(F.sort_array(F.collect_list(entry)), lambda h: h["id"])
    return hits.groupBy(key).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n_hits"), best.alias("hit_ids")).orderBy(F.col("mean_score").desc(), key)


def excerpt_view(hits: DataFrame, current: str | None = None, key: str = "sha512", id_col: str = "id") -> DataFrame:
    """All hits from best to worst, of one file if that is asked for."""
    shown = hits if current is None else hits.where(F.col(key) == current)
    return shown.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), id_col)))


def filter_by_name(rows: DataFrame, part: str, name_col: str = "basename") -> DataFrame:
    """Rows whose file name contains the part, in any case; an empty part keeps all."""
    return rows.where(F.lower(F.col(name_col)).contains(part.lower()))


def page(search, pages: int) -> tuple[DataFrame, DataFrame]:
    """(hits of the first pages, whether there may be more): search(limit) is run again with a longer limit."""
    limit = pages * PAGE
    hits = search(limit)
    return hits, hits.agg((F.count("*") >= limit).alias("has_more"))
