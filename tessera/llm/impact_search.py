"""Exact top-k search over a stored impact-ordered index, score at a time.

Scores are BM25 over distinct query words. Every row of the query table is a
query, every row of the document table a document.

`build` writes an index of all words of all documents once:

1. a first scan takes the number of documents and their mean length;
2. a second one cuts each task's documents into shards. In a shard, a word's
   postings lie in segments of equal impact, its share of the score without
   the word's weight, rounded down to one of `LEVELS` levels, greatest first.
   Rows are stored by shard and range of word hashes, sorted and in small row
   groups, so that a search reads the ranges of its words only.

`search` answers any number of queries from the index, without the texts:

3. document frequencies of the query words are added up over all shards;
4. the segments of the query words go to one task a shard. A query's segments
   are taken by falling weighted impact and added up. What is still missing to
   a document is bounded by the words' next impacts and by the rounding.
   Processing stops once that proves that all but `SLACK` times k documents
   can't reach the k-th best sum so far; without proof it goes on to the last
   segment. The possible members, however many, are scored exactly.
5. The exact best k of the shards are merged by score and id.

A word is a run of ASCII letters, digits and non-ASCII characters, in lower
case (A-Z, À-Þ). Documents rank by score rounded to 6 places, then least id.

Defined results: documents with null id or without words are no part of the
collection; queries without words or with none that occurs find nothing; null
query ids stay null; repeated rows are documents, and queries, of their own;
fewer than k matches give fewer rows; empty tables give an empty table;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera import scratch
from tessera.llm.textarrays import WORDLIKE, Words, fold_case, slices, text_bytes

K = 10
K1, B = 1.2, 0.75
LEVELS = 256
SLACK = 8
#: Postings and documents of a shard of the index; a task builds as many shards as it needs.
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 60_000
#: Ranges of word hashes, and bytes of a row group of the index: what is read at least for one word of a shard.
BUCKETS, ROW_GROUP = 256, 1 << 20
#: Queries that are answered by one pair of jobs; their words are sent to the executors.
QUERIES_AT_ONCE = 2_000
_EPS = 2e-6  # scores are compared in 6 places


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of the words, row of each word less the first) of slices of a column."""
    data, offsets = text_bytes(column)
    for begin, end in slices(offsets):
        for lo in range(begin, end, SHARD_DOCS):
            hi = min(end, lo + SHARD_DOCS)
            words = Words(fold_case(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo], WORDLIKE)
            yield lo, hi, words.hashes(), words.doc


@dataclass(frozen=True)
class Index:
    """Where an index is stored, and what all of its searches need to know."""

    path: str
    documents: int
    mean_length: float


def _statistics(docs: DataFrame) -> tuple[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in slices(offsets):
                found = Words(fold_case(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo], WORDLIKE)
                n, words = n + int((np.diff(found.first) > 0).sum()), words + len(found)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], ["n", "words"])

    row = docs.select("text").mapInArrow(run, "n bigint, words bigint").agg(F.sum("n"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def part_of_score(tf: np.ndarray, length: np.ndarray, mean_length: float) -> np.ndarray:
    """A word's share of the score of documents of these lengths that have it tf times, without its weight."""
    tf = tf.astype(float)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Write the index of `docs` under `path`, by default in the shared folder."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id is not null and text is not null")
    path = path or scratch.new_path(spark, "impacts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    n, words = _statistics(docs)
    mean = words / n if n else 1.0
    names = ["shard", "bucket", "terms", "postings", "segments", "levels", "sizes", "docs", "counts", "ids"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7, pa.list_(id_type)]

    def shard(number: int, ids: list[pa.Array], lengths: list[np.ndarray], hashes: list[np.ndarray], own: list[np.ndarray], tfs: list[np.ndarray]) -> Iterator[tuple]:
        all_ids, length = pa.concat_arrays(ids), np.concatenate(lengths)
        order = np.asarray(pc.sort_indices(all_ids))  # documents in order of id, so that ties within the shard are in order
        rank = np.argsort(order)
        length = length[order]
        yield number, -1, b"", b"", b"", b"", b"", length.astype(np.uint32).tobytes(), b"", all_ids.take(pa.array(order)).to_pylist()
        terms, term = np.unique(np.concatenate(hashes), return_inverse=True)
        doc, tf = rank[np.concatenate(own)], np.concatenate(tfs)
        level = np.minimum((part_of_score(tf, length[doc], mean) * (LEVELS / (K1 + 1))).astype(np.int64), LEVELS - 1)
        key = (term.astype(np.int64) << 24) | ((LEVELS - 1 - level) << 16) | doc
        by = np.argsort(key)
        key, tf = key[by], tf[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] >> 16 != key[:-1] >> 16]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        seg_term, seg_level = key[start] >> 24, LEVELS - 1 - (key[start] >> 16 & 255)
        per_term = np.bincount(seg_term, minlength=len(terms))
        n_postings = np.bincount(term, minlength=len(terms))
        t_at = np.searchsorted(terms >> np.uint64(56), np.arange(BUCKETS + 1, dtype=np.uint64))
        s_at = np.concatenate([[0], np.cumsum(per_term)])[t_at]
        p_at = np.concatenate([[0], np.cumsum(n_postings)])[t_at]
        docs16 = (key & 0xFFFF).astype(np.uint16)
        for k in np.flatnonzero(np.diff(t_at)):
            t, g, p = slice(t_at[k], t_at[k + 1]), slice(s_at[k], s_at[k + 1]), slice(p_at[k], p_at[k + 1])
            yield number, int(k), terms[t].tobytes(), n_postings[t].astype(np.uint32).tobytes(), per_term[t].astype(np.uint16).tobytes(), seg_level[g].astype(np.uint8).tobytes(), size[g].astype(np.uint16).tobytes(), docs16[p].tobytes(), tf[p].astype(np.uint32).tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, count, total = TaskContext.get().partitionId(), 0, 0, 0
        held: tuple[list, ...] = ([], [], [], [], [])

        def out() -> Iterator[pa.RecordBatch]:
            for row in shard((task << 24) + number, *held):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            for lo, hi, hashes, row in word_hashes(batch.column(1)):
                if not len(hashes):
                    continue
                terms, term = np.unique(hashes, return_inverse=True)
                key, tf = np.unique(row * len(terms) + term, return_counts=True)
                length = np.bincount(row, minlength=hi - lo)
                real = np.flatnonzero(length)
                if count and (count + len(real) > SHARD_DOCS or total + len(key) > SHARD_POSTINGS):
                    yield from out()
                    held, count, total, number = ([], [], [], [], []), 0, 0, number + 1
                place = np.cumsum(length > 0) - 1
                for into, x in zip(held, (batch.column(0).take(pa.array(real + lo)), length[real], terms[key % len(terms)], place[key // len(terms)] + count, tf)):
                    into.append(x)
                count, total = count + len(real), total + len(key)
        if count:
            yield from out()

    rows = docs.mapInArrow(run, f"shard bigint, bucket int, terms binary, postings binary, segments binary, levels binary, sizes binary, docs binary, counts binary, ids array<{kind}>")
    rows.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{path}/shards")
    spark.createDataFrame([(n, float(mean))], "documents bigint, mean_length double").coalesce(1).write.parquet(f"{path}/about")
    return Index(path, n, mean)


def load(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    about = spark.read.parquet(f"{path}/about").first()
    return Index(path, about.documents, about.mean_length)


class Shard:
    """Segments of the query words in one shard: their word, level and size, and documents and counts one after the other."""

    def __init__(self, length: np.ndarray, term: np.ndarray, level: np.ndarray, size: np.ndarray, docs: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean_length: float):
        order = np.argsort(term * LEVELS + (LEVELS - 1 - level), kind="stable")
        end = np.cumsum(size)
        self.start, self.end = (end - size)[order], end[order]
        self.term, self.level, self.docs, self.n, self.idf = term[order], level[order], docs, len(length), idf
        key = (np.repeat(term, size) << 16) | docs
        by = np.argsort(key)
        self.key = key[by]
        self.score = (idf[np.repeat(term, size)] * part_of_score(counts, length[docs], mean_length))[by]
        self.unit = (K1 + 1) / LEVELS

    def search(self, terms: np.ndarray, k: int) -> tuple[list[tuple[float, int]], int, int]:
        """(best (score, document) pairs, segments processed, documents scored exactly)."""
        lo, hi = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, side="right")
        here = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]) if len(terms) else np.zeros(0, np.int64)
        if not len(here):
            return [], 0, 0
        own = np.repeat(np.arange(len(terms)), hi - lo)
        weight = self.idf[terms] * self.unit
        impact = self.level[here] * weight[own]
        # what each segment's word can still add once it is done: its next level, rounded up
        level = self.level[here]
        after = np.zeros(len(here))
        same = own[1:] == own[:-1]
        after[:-1][same] = (level[1:][same] + 1) * weight[own[:-1][same]]
        some = hi > lo
        missing = np.zeros(len(terms))
        missing[some] = (self.level[lo[some]] + 1) * weight[some]
        order = np.argsort(-(impact + weight[own]), kind="stable")
        here, own, impact, after = here[order], own[order], impact[order], after[order]
        slack = float(weight[some].sum())  # rounding down loses less than one level a word
        total = np.zeros(self.n)
        done, processed, look_at = 0, 0, 1
        possible = None
        while True:
            seg = here[done]
            total[self.docs[self.start[seg] : self.end[seg]]] += impact[done]
            missing[own[done]] = after[done]
            done += 1
            if done < len(here) and done < look_at:
                continue
            look_at = done + max(1, len(here) // 24)
            rest = float(missing.sum())
            kth = float(np.partition(total, self.n - k)[self.n - k]) if self.n > k else 0.0
            if done < len(here) and rest + slack + _EPS >= kth:
                continue  # a document not seen yet could still enter
            members = np.flatnonzero(total + (rest + slack + _EPS) >= kth)
            if done == len(here) or len(members) <= SLACK * k:
                possible, processed = members, done
                break
        wanted = (terms[:, None] << 16) | possible[None, :]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        exact = np.where(self.key[at] == wanted, self.score[at], 0.0).sum(axis=0)
        found = [(round(float(s), 6), int(d)) for s, d in zip(exact, possible) if s > 0]
        found.sort(key=lambda x: (-x[0], x[1]))
        return found[:k], processed, len(possible)


def _read(spark: SparkSession, index: Index, known: np.ndarray) -> DataFrame:
    """The rows of the ranges in which the words may be, and the rows of kind -1."""
    buckets = [int(b) for b in np.unique(known >> np.uint64(56))]
    return spark.read.parquet(f"{index.path}/shards").where(F.col("bucket").isin([-1, *buckets]))


def _frequencies(rows: DataFrame, known: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for terms, n in zip(batch.column(0), batch.column(1)):
                terms, n = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.uint32)
                place = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                hit = known[place] == terms
                total[place[hit]] += n[hit]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    out = np.zeros(len(known), dtype=np.int64)
    for row in rows.where("bucket >= 0").select("terms", "postings").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def _segments(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """Of each stored row the segments of the query words; what a shard needs comes together in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, bucket, *blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(k) for k in range(2, 9))):
                if bucket < 0:
                    out.append((shard, 0, None, None, None, blobs[5].as_py(), None))
                    continue
                terms, postings, segments, levels, sizes, docs, counts = (np.frombuffer(x.as_buffer(), t) for x, t in zip(blobs, (np.uint64, np.uint32, np.uint16, np.uint8, np.uint16, np.uint16, np.uint32)))
                place = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                hit = known[place] == terms
                if hit.any():
                    seg, post = np.repeat(hit, segments), np.repeat(hit, postings)
                    out.append((shard, 1, np.repeat(place[hit], segments[hit]).astype(np.int32).tobytes(), levels[seg].tobytes(), sizes[seg].tobytes(), docs[post].tobytes(), counts[post].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.binary()] * 5))], ["shard", "kind", "terms", "levels", "sizes", "docs", "counts"])

    stored = rows.select("shard", "bucket", "terms", "postings", "segments", "levels", "sizes", "docs", "counts")
    found = stored.mapInArrow(run, "shard bigint, kind int, terms binary, levels binary, sizes binary, docs binary, counts binary")
    return found.repartition("shard").sortWithinPartitions("shard", "kind")


def _best(segments: DataFrame, queries: list[np.ndarray], idf: np.ndarray, mean_length: float, k: int) -> DataFrame:
    """q, shard, doc (its number in the shard) and score of the best k of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(length: np.ndarray, parts: list[list[np.ndarray]]) -> pa.RecordBatch | None:
            if not parts:
                return None
            term, level, size, docs, counts = (np.concatenate(x) for x in zip(*parts))
            shard = Shard(length, term.astype(np.int64), level.astype(np.int64), size.astype(np.int64), docs.astype(np.int64), counts, idf, mean_length)
            rows = [(q, number, d, s) for q, terms in enumerate(queries) for s, d in shard.search(terms, k)[0]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.float64()))], ["q", "shard", "doc", "score"]) if rows else None

        number, length, parts = None, np.zeros(0), []
        for batch in batches:
            for shard, kind, *blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(j) for j in range(2, 7))):
                if shard != number:
                    if (out := finish(length, parts)) is not None:
                        yield out
                    number, parts = shard, []
                if kind == 0:
                    length = np.frombuffer(blobs[3].as_buffer(), np.uint32).astype(float)
                else:
                    parts.append([np.frombuffer(x.as_buffer(), t) for x, t in zip(blobs, (np.int32, np.uint8, np.uint16, np.uint16, np.uint32))])
        if (out := finish(length, parts)) is not None:
            yield out

    return segments.mapInArrow(run, "q int, shard bigint, doc int, score double")


def search(index: Index, queries: DataFrame, k: int = K, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the best k documents of each query."""
    spark = queries.sparkSession
    asked = queries.select(queries[query_id].alias("item_id"), queries[query_text].cast("string").alias("text"))
    id_kind = spark.read.parquet(f"{index.path}/shards").schema["ids"].dataType.elementType.simpleString()
    answers = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id {id_kind}, score double")
    rows, block = asked.toLocalIterator(), []
    more = index.documents > 0
    while more:
        row = next(rows, None)
        more = row is not None
        if more:
            block.append(row)
        if block and (not more or len(block) == QUERIES_AT_ONCE):
            found = _answer(spark, index, block, k, asked)
            answers = answers if found is None else answers.unionByName(found)
            block = []
    return answers


def _answer(spark: SparkSession, index: Index, block: list, k: int, asked: DataFrame) -> DataFrame | None:
    hashes: list[np.ndarray] = [np.zeros(0, np.uint64) for _ in block]
    for lo, _, found, row in word_hashes(pa.array([r.text for r in block], pa.string())):
        for q in range(lo, lo + int(row[-1]) + 1 if len(row) else lo):
            hashes[q] = np.unique(found[row == q - lo])
    known = np.unique(np.concatenate(hashes))
    if not len(known):
        return None
    rows = _read(spark, index, known)
    df = _frequencies(rows, known)
    idf = np.log(1 + (index.documents - df + 0.5) / (df + 0.5))
    best = _best(_segments(rows, known), [np.searchsorted(known, h) for h in hashes], idf, index.mean_length, k)
    names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(block)], f"q int, item_id {asked.schema['item_id'].dataType.simpleString()}")
    # before ids are known, those that tie with a shard's k-th have to stay; they do, as a shard numbers its documents by id
    ids = spark.read.parquet(f"{index.path}/shards").where("bucket = -1").select("shard", F.posexplode("ids").alias("doc", "doc_id"))
    ranked = best.join(ids, ["shard", "doc"]).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "doc_id"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Build an index of `docs` and search it."""
    return search(build(docs, None, id_col, text_col), queries, k, query_id, query_text)
