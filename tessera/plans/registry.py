"""Queries of the engine's own operators, by name, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.functions import text as tx
from tessera.functions.embedder import HashEmbedder
from tessera.functions.query import WeightedTerm, normalize_weights, parse_query_column
from tessera.operators import ann, chunking, explain, highlight, keyword_index, lexical, search, vectors, views
from tessera.operators import catalog as cat
from tessera.plans import data, sql
from tessera.sources import files as src
from tessera.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL

HYBRID = 'the of and -pour "erth" "and"'
LITERALS = ["and thea", "erth"]
NOW = 1_700_000_000_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over the chunks of all documents, with file names."""
    return hybrid_overfetch(spark, sf_dir)


# chunking and sources


@query
def chunk_word_windows(spark, sf_dir):
    docs = chunking.flat_segments(data.documents(spark, sf_dir).select("doc_id", "text"))
    return chunking.WordWindowChunker().chunk(docs).select("doc_id", "k", "text", "char_start", "char_end")


@query
def chunk_stats(spark, sf_dir):
    return data.table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in chunking.file_stats(F.col("text")).items()))


@query
def chunk_plain_words(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.plain_word_chunks(F.col("text"))).alias("k", "text"))
    return docs.select("doc_id", F.col("k").cast("int").alias("k"), "text")


def _grids(spark, sf_dir):
    tables = {"region": ["r_regionkey"], "nation": ["n_nationkey"]}
    grids = None
    for name, order in tables.items():
        one = src.grid_of_table(data.table(spark, sf_dir, name), order, name)
        grids = one if grids is None else grids.unionByName(one)
    return grids.unionByName(src.grid_of_table(data.table(spark, sf_dir, "supplier"), ["s_suppkey"], "supplier"))


@query
def csv_cell_chunks(spark, sf_dir):
    return chunking.CellChunker().chunk(chunking.cell_segments(_grids(spark, sf_dir))).select("sha512", "text", "char_start", "char_end", F.col("page").alias("row"), F.col("page_char_start").alias("col"))


@query
def page_segments_offsets(spark, sf_dir):
    pages = chunking.page_segments(data.table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return pages.select("conv_id", "page", "base_offset", F.length("text").alias("n_chars"))


@query
def document_full_text(spark, sf_dir):
    pages = chunking.page_segments(data.table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return chunking.full_text(pages, "conv_id").select("conv_id", F.md5("full_text").alias("digest"), F.length("full_text").alias("n_chars"))


@query
def file_identity(spark, sf_dir):
    page = data.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"), F.col("html").cast("binary").alias("content"))
    return page.select("page_id", tx.basename(F.col("path")).alias("basename"), src.file_type(F.col("path"), F.col("content")).alias("filetype"), F.octet_length("content").alias("byte_len"), tx.project_name(F.col("path")).alias("project_name"))


@query
def decoded_text(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents").select("doc_id", src.decode_text(F.col("text").cast("binary")).alias("text"))
    return docs.select("doc_id", F.md5("text").alias("digest"))


# vectors


@query
def exact_knn(spark, sf_dir):
    near = vectors.top_k(data.vectors(spark, sf_dir), data.vector_of(spark, sf_dir, 0), 10)
    return near.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query
def knn_scoped(spark, sf_dir):
    members = spark.createDataFrame([("1",), ("3",), ("5",)], "sha512 string")
    near = vectors.top_k(vectors.in_scope(data.vectors(spark, sf_dir), members, "sha512"), data.vector_of(spark, sf_dir, 0), 10)
    return near.select("id", "sha512", F.round("distance", 6).alias("distance"))


@query
def knn_all_pairs(spark, sf_dir):
    return vectors.nearest_of_all(data.vectors(spark, sf_dir), 3).select("id", "rank", "other", F.round("distance", 6).alias("distance"))


def _means(spark, sf_dir):
    spread = data.vectors(spark, sf_dir).select(F.col("sha512").alias("label"), F.posexplode("vector").alias("pos", "x"))
    return spread.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))


@query
def mean_pool(spark, sf_dir):
    return _means(spark, sf_dir).select("label", "pos", F.round("x", 6).alias("x"))


@query
def similarity_matrix(spark, sf_dir):
    one = _means(spark, sf_dir).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
    return vectors.similarity_matrix(one, "label")


def _centroid(spark, sf_dir, weights: dict[int, float]) -> list[float]:
    terms = normalize_weights([WeightedTerm(str(k), w) for k, w in weights.items()])
    chosen = data.vectors(spark, sf_dir).where(F.col("id").isin(list(weights)))
    weight = F.coalesce(*(F.when(F.col("id") == int(t.text), F.lit(t.weight)) for t in terms))
    return vectors.unit(vectors.weighted_sum(chosen.withColumn("weight", weight)))


@query
def weighted_centroid_search(spark, sf_dir):
    near = vectors.top_k(data.vectors(spark, sf_dir), _centroid(spark, sf_dir, {0: 1.0, 1: 2.0, 2: -1.0}), 10)
    return near.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query
def relevance_feedback_search(spark, sf_dir):
    near = vectors.top_k(data.vectors(spark, sf_dir), _centroid(spark, sf_dir, {0: 1.0, 7: 0.5, 9: -2.0}), search.PAGE)
    return near.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query
def ann_ivf_search(spark, sf_dir):
    """Of every 50th row the ten nearest others, from an index of all rows."""
    rows = data.vectors(spark, sf_dir)
    near = ann.search_many(ann.build(rows), rows.where("id % 50 = 0"), 10)
    return near.select("query", "rank", "id", F.round("distance", 6).alias("distance"))


def _hits(spark, sf_dir, limit=60):
    return vectors.top_k(data.vectors(spark, sf_dir), data.vector_of(spark, sf_dir, 0), limit)


@query
def group_hits_by_file(spark, sf_dir):
    return search.group_by_file(_hits(spark, sf_dir).withColumn("score", F.round("score", 6))).select("sha512", "mean_score", "n_hits", F.concat_ws(",", F.transform("hit_ids", lambda x: x.cast("string"))).alias("hit_ids"))


@query
def excerpt_view(spark, sf_dir):
    return search.excerpt_view(_hits(spark, sf_dir).withColumn("score", F.round("score", 6)), "1").select("place", "id", "score", tx.score_percent(F.col("score")).alias("percent"))


@query
def load_more(spark, sf_dir):
    hits, more = search.page(lambda n: _hits(spark, sf_dir, n), 2)
    return hits.crossJoin(F.broadcast(more)).select("id", F.round("distance", 6).alias("distance"), "has_more")


# keywords and hybrid search


@query
def keyword_prefix_filter(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents")
    return docs.where(tx.matches_literal(F.col("text"), LITERALS[0])).select("doc_id", "source")


@query
def multi_literal_and(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents")
    return docs.where(tx.matches_all(F.col("text"), LITERALS)).select("doc_id", "source")


@query
def keyword_substring(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.bm25(docs, ["erth", "of"]).select("id", F.round("score", 6).alias("score"))


@query
def bm25_trigram_rank(spark, sf_dir):
    """From the stored postings, without the texts."""
    return keyword_index.substring_search(spark, data.keywords(spark, sf_dir), ["hent", "orst"], 50).select("id", F.round("score", 6).alias("score"))


@query
def keyword_prefix_rank(spark, sf_dir):
    """Postings choose the documents, their texts decide whether words begin with the tokens."""
    docs = data.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return keyword_index.literal_candidates(data.keywords(spark, sf_dir), docs, LITERALS[1]).select("id", F.round("score", 6).alias("score"))


@query
def literals_only_rank(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("sha512"), "text")
    found = search.hybrid_search(docs, '"erth" "and"', HashEmbedder(8), limit=30, keyword_filter="exact_filter")
    return found.select("id", "distance", F.round("score", 6).alias("score"), "score_kind")


def _hybrid(spark, sf_dir, keyword_filter):
    rows = data.stored_chunks(spark, sf_dir)
    hits = search.hybrid_search(rows, HYBRID, data.EMBEDDER, limit=20, keyword_filter=keyword_filter)
    names = data.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sha512"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("basename"), F.lit("text").alias("filetype"))
    shown = search.enrich(hits, names)
    return shown.select("id", "sha512", "basename", "filetype", "char_start", "char_end", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query
def hybrid_overfetch(spark, sf_dir):
    return _hybrid(spark, sf_dir, "over_fetch")


@query
def hybrid_exact_filter(spark, sf_dir):
    return _hybrid(spark, sf_dir, "exact_filter")


@query
def filename_filter(spark, sf_dir):
    return search.filter_by_name(data.files(spark, sf_dir, committed=False), "SRC1-").select("sha512", "basename")


@query
def parse_query_terms(spark, sf_dir):
    parsed = data.table(spark, sf_dir, "benchmark").select("item_id", parse_query_column("text").alias("p"))
    return parsed.select("item_id", F.size("p.semantic").alias("terms"), F.size("p.literals").alias("literals"))


@query
def normalized_quotes(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("“"), "text", F.lit("‟ ‘‛")).alias("t"))
    return docs.select("doc_id", F.md5(tx.normalize_quotes(F.col("t"))).alias("digest"))


# explanation and highlighting


@query
def explain_tokens(spark, sf_dir):
    hits = explain.explain(data.chunks(spark, sf_dir).select("id", "text"), "the of", data.EMBEDDER)
    return hits.select("id", F.posexplode("explanation.tokens").alias("place", "t")).select("id", "place", "t.start", "t.end", F.round("t.score", 6).alias("score"))


@query
def explain_totals(spark, sf_dir):
    hits = explain.explain(data.chunks(spark, sf_dir).select("id", "text"), "the of", data.EMBEDDER)
    return hits.select("id", F.size("explanation.tokens").alias("tokens"), "explanation.bias", F.round("explanation.total", 6).alias("total"))


@query
def highlight_segments(spark, sf_dir):
    shown = highlight.explained_highlight(data.chunks(spark, sf_dir).select("id", "text"), "the of", data.EMBEDDER, ["erth"])
    return shown.select("id", F.posexplode("segments").alias("place", "s")).select("id", "place", "s.text", F.round("s.weight", 6).alias("weight"), "s.keyword", highlight.colour(F.col("s.weight")).alias("colour"))


@query
def highlight_windows(spark, sf_dir):
    shown = highlight.explained_highlight(data.chunks(spark, sf_dir).select("id", "text"), "the of", data.EMBEDDER, [], windows=True)
    return shown.select("id", F.posexplode("segments").alias("place", "s")).select("id", "place", "s.text", F.round("s.weight", 6).alias("weight"))


@query
def sentence_offsets(spark, sf_dir):
    docs = data.documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(tx.sentence_starts(F.col("text"))).alias("place", "start"))


@query
def word_islands(spark, sf_dir):
    """Trigram pieces of the conversations' words, rolled up to the words again."""
    rows = data.table(spark, sf_dir, "benchmark").select("item_id", "text")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 3)), lambda k: F.struct((k * 3).cast("int").alias("start"), F.least(k * 3 + 3, F.length("text")).cast("int").alias("end"), F.lit(1.0).alias("score")))
    spread = rows.select("item_id", "text", F.explode(pieces).alias("p")).select("item_id", "text", "p.start", "p.end", "p.score")
    return highlight.word_scores(spread, "item_id", "text").select("item_id", "word", "start", "end", "score", "tokens")


@query
def line_boxes(spark, sf_dir):
    """Rectangles of the characters 3 to 42 of each benchmark text, set 20 characters a line, in points and pixels."""
    rows = data.table(spark, sf_dir, "benchmark")
    box = lambda k: F.struct(((k % 20) * 6.0).alias("left"), (700.0 - F.floor(k / 20) * 12).alias("bottom"), ((k % 20) * 6.0 + 5).alias("right"), (709.0 - F.floor(k / 20) * 12).alias("top"))
    boxes = rows.select("item_id", F.transform(F.sequence(F.lit(0), F.length("text") - 1), box).alias("boxes"))
    rects = boxes.select("item_id", highlight.highlight_rects(F.col("boxes"), F.lit(3), F.lit(40)).alias("r"))
    pixels = highlight.to_pixels(F.col("r"), F.lit(600.0), F.lit(800.0), F.lit(1200.0), F.lit(1600.0))
    both = rects.select("item_id", F.posexplode(F.arrays_zip("r", pixels.alias("p"))).alias("line", "z"))
    return both.select("item_id", "line", "z.r.left", "z.r.bottom", "z.r.right", "z.r.top", "z.p.x", "z.p.y", "z.p.w", "z.p.h")


# the catalogue


@query
def dedup_by_content(spark, sf_dir):
    return cat.dedup_by_content(data.memberships(spark, sf_dir)).select("sha512", "project_id", "source_path")


@query
def ref_count(spark, sf_dir):
    return cat.ref_count(data.memberships(spark, sf_dir))


@query
def orphan_files(spark, sf_dir):
    left = data.memberships(spark, sf_dir).where("project_id not in ('src1', 'src2', 'src3')")
    return cat.orphans(data.files(spark, sf_dir), left).select("sha512", "basename")


@query
def delete_project(spark, sf_dir):
    left = cat.delete_project(data.projects(spark, sf_dir), data.files(spark, sf_dir), data.memberships(spark, sf_dir), data.jobs(spark, sf_dir), "src1")
    counted = None
    for name in sorted(left):
        one = left[name].agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        counted = one if counted is None else counted.unionByName(one)
    return counted


@query
def remove_file_ref(spark, sf_dir):
    first = data.memberships(spark, sf_dir).orderBy("added_at").first()
    left = cat.remove_file_ref(data.files(spark, sf_dir), data.memberships(spark, sf_dir), first.project_id, first.sha512)
    return left["project_files"].select("project_id", "sha512")


@query
def add_file_refs(spark, sf_dir):
    refs = data.memberships(spark, sf_dir)
    return cat.add_file_ref(refs.where(F.lit(False)), refs)


@query
def list_project_files(spark, sf_dir):
    return cat.list_project_files(cat.add_file_ref(data.memberships(spark, sf_dir).limit(0), data.memberships(spark, sf_dir)), data.files(spark, sf_dir)).select("project_id", "sha512", "added_at", "basename", "char_len")


@query
def list_documents(spark, sf_dir):
    return cat.list_documents(data.memberships(spark, sf_dir), data.files(spark, sf_dir), "src1").select("sha512", "basename", "filetype", "char_len", "word_count")


@query
def known_and_new(spark, sf_dir):
    known, new = cat.known_and_new(data.memberships(spark, sf_dir), data.files(spark, sf_dir))
    return known.withColumn("state", F.lit("known")).unionByName(new.withColumn("state", F.lit("new"))).groupBy("project_id", "state").agg(F.count("*").alias("n"))


@query
def project_listing(spark, sf_dir):
    return cat.project_listing(data.projects(spark, sf_dir), data.memberships(spark, sf_dir), data.jobs(spark, sf_dir))


@query
def project_labels(spark, sf_dir):
    listed = cat.project_listing(cat.rename_project(data.projects(spark, sf_dir), "src2", "renamed"), data.memberships(spark, sf_dir), data.jobs(spark, sf_dir))
    return listed.select("project_id", "name", views.project_label(F.col("doc_count"), F.col("pending"), F.col("error")).alias("label"))


@query
def job_counts(spark, sf_dir):
    return cat.job_counts(data.jobs(spark, sf_dir))


@query
def next_pending_job(spark, sf_dir):
    return cat.next_pending_job(data.jobs(spark, sf_dir)).select("project_id", "sha512", "added_at")


@query
def project_status(spark, sf_dir):
    jobs = data.jobs(spark, sf_dir)
    return cat.project_status(jobs, "src0", cat.next_pending_job(jobs.where("project_id = 'src0'"))).select("sha512", "status", "error", "active")


@query
def retry_failed_jobs(spark, sf_dir):
    return cat.retry_failed(data.jobs(spark, sf_dir), "src0").select("project_id", "sha512", "status", "error")


@query
def manage_rows(spark, sf_dir):
    jobs = data.jobs(spark, sf_dir)
    rows = views.manage_rows(data.files(spark, sf_dir), jobs, cat.next_pending_job(jobs))
    return rows.select("sha512", "basename", "state", views.row_label(F.col("state"), F.col("error")).alias("label"), views.row_stats(F.col("byte_len"), F.col("page_count"), F.col("word_count")).alias("stats"))


@query
def indexing_state(spark, sf_dir):
    return views.indexing_state(data.jobs(spark, sf_dir))


@query
def requeue_all(spark, sf_dir):
    refs = cat.add_file_ref(data.memberships(spark, sf_dir).where(F.lit(False)), data.memberships(spark, sf_dir))
    jobs, _, _ = cat.requeue_all(data.jobs(spark, sf_dir), data.files(spark, sf_dir), refs, NOW)
    return jobs.select("project_id", "sha512", "status", "added_at")


@query
def upsert_meta(spark, sf_dir):
    regions = data.table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return cat.set_meta(cat.set_meta(regions, "ASIA", "changed"), "active_pipeline", tx.pipeline_version("hash", chunking.SIZE, chunking.OVERLAP))


@query
def contiguous_ids(spark, sf_dir):
    return cat.with_ids(data.table(spark, sf_dir, "documents").select("source", "doc_id"), 100, ["source", "doc_id"]).select("id", "source", "doc_id")


@query
def delete_file(spark, sf_dir):
    return cat.delete_where(data.chunks(spark, sf_dir), F.col("sha512") == "11").groupBy("sha512").agg(F.count("*").alias("chunks"))


@query
def chunk_counts(spark, sf_dir):
    chunks = data.chunks(spark, sf_dir)
    members = data.table(spark, sf_dir, "documents").where("source = 'src3'").select(F.col("doc_id").cast("string").alias("sha512"))
    return cat.count_for(chunks, members).crossJoin(cat.max_id(chunks))


@query
def sizes_and_labels(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("double")  # its square is no int from 46,341 bytes on
    return docs.select("doc_id", tx.format_bytes(size * size).alias("size"), tx.counted(F.col("doc_id") % 3, "file").alias("files"), tx.progress_fraction(F.col("doc_id") % 100, F.lit(100)).alias("progress"), tx.clamp_multiple(F.col("doc_id") / 100).alias("strength"))


@query
def embed_batch_stats(spark, sf_dir):
    events = data.table(spark, sf_dir, "events")
    return views.batch_stats(events.select((F.col("value") * 100).cast("bigint").alias("ms"), F.lit(32).alias("rows")), "ms", "rows")


@query
def padded_grid(spark, sf_dir):
    ragged = data.table(spark, sf_dir, "nation").select("n_nationkey", F.split("n_name", " ").alias("row"))
    return ragged.select("n_nationkey", F.concat_ws("|", views.padded_grid(F.array("row"), F.lit(3))[0]).alias("cells"))


@query
def stream_ingest(spark, sf_dir):
    """All documents as files, indexed by a stream until none is left: the committed files, by size, and their chunks."""
    base = scratch.new_path(spark, "ingest")
    docs = data.table(spark, sf_dir, "documents")

    def write(parts):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(f"{base}/in")
        made = set()
        for part in parts:
            for k, text in zip(part.doc_id, part.text):
                folder = f"{root}/{k // 1000}"  # folders are listed side by side
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{folder}/{k}.txt") as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(part)]})

    docs.select("doc_id", "text").mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    catalog = cat.Catalog(spark, f"{base}/catalog")
    indexer = ingest.Indexer(catalog, HashEmbedder(16), "all")
    indexer.open()
    ingest.stream(spark, f"{base}/in", f"{base}/checkpoint", indexer, max_files=100_000).awaitTermination()
    chunks = catalog.table("chunks").groupBy("sha512").agg(F.count("*").alias("chunks"), F.max("char_end").alias("last_end"))
    return catalog.table("files").join(chunks, "sha512", "left").select("byte_len", "char_len", "word_count", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("last_end", F.lit(0)).alias("last_end"))
