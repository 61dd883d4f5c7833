"""N-gram Jaccard join by a token-group matrix.

Finds all links between documents whose sets of word n-grams have a Jaccard
similarity of at least `threshold`, exactly, and gives one row per document:
its class (the documents that links connect), how many documents have the very
same set, and how many further sets it is linked to. Every document is a query.

1. One scan turns texts into sets of gram hashes. The hashes of a task's
   documents go, as blocks of bytes, to reducers by hash range, which count in
   how many sets each occurs and send back those that occur in several: no
   other can be common to two sets. A set with too few of them for any partner
   (less than `threshold` of its size) is done.
2. Each set that is left is ordered by how rare its tokens are. Two sets need
   threshold / (1 + threshold) * (|Q| + |S|) common tokens, so the rarest
   common one stands early in both; how early depends on both sizes.
   Boilerplate shared by many sets stands last and leads nowhere.
3. Similar sets (neighbours by a min-hash, then by size) form groups of at most
   `GROUP_SETS`. The token-group matrix is kept as postings, one entry for a
   token and a group in whose members it stands early enough, with the least
   size of those members and the largest partner that its position allows. Two
   groups meet only where an entry of each allows the other.
4. Where groups meet, |Q ∩ union of the group's tokens| bounds what each query
   can share with any member; only queries that reach the bound open the group
   and are compared with its sets, by a product of their token matrices.

No recall is lost, and a false link needs collisions of 48-bit hashes (for two
sets of 500 grams one of 10**9 pairs has one token too many). Work follows the
tokens, and the groups that pass the bound: c sets that are all linked with
each other are (c / GROUP_SETS)**2 / 2 products of matrices, so one cluster of
different texts that grows with the corpus costs its square, though only a row
per set and group leaves a product. Equal sets cost nothing beyond the scan.

A word is a run of ASCII letters, digits and non-ASCII characters, in lower
case (A-Z, À-Þ). A text of 1 to n - 1 words has one gram, all its words.

Defined results: rows without id give no row; null and wordless texts are
classes of their own; equal rows count once; an id with several texts has a
row for each different set of grams, and both may be linked; further columns,
whatever their names, are ignored by `join` and passed through by
`keep_one_per_group`; an empty table gives an empty table; there are no ties,
as every link counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from tessera import scratch
from tessera.llm.components import connected_components
from tessera.llm.textarrays import WORDLIKE, Rolling, Words, fold_case, give_back, lean, mix, own, run_starts, slices, text_bytes

N = 3
THRESHOLD = 0.5
#: Tokens and rows of a chunk, the part of a task's documents that is handled at a time; a longer text is a chunk alone.
CHUNK_TOKENS, CHUNK_ROWS = 4_000_000, 60_000
GROUP_SETS, GROUP_TOKENS = 128, 1 << 17
#: Sets of a group differ in size by this factor at most.
GROUP_SPAN = 1.25
#: Groups that meet one group in one task; a group that meets more of them goes to several tasks.
MEET_AT_ONCE = 64
#: Pairs of groups that are looked at at once.
PAIRS_AT_ONCE = 2_000_000
#: A side of a join is broadcast up to this size, and shuffled beyond it.
BROADCAST_BYTES = 32_000_000
_REST_BITS = 40


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a set, first token of each, tokens): each row's distinct gram hashes in ascending order."""
    words = Words(fold_case(data), offsets, WORDLIKE)
    rolling = Rolling(words.hashes())
    start = run_starts(words.doc, n)
    end = start + n
    count = words.first[1:] - words.first[:-1]
    short = np.flatnonzero((count > 0) & (count < n))
    start, end = np.concatenate([start, words.first[short]]), np.concatenate([end, words.first[short + 1]])
    tokens, row = rolling.of(start, end), words.doc[start]
    order = np.argsort(tokens)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    tokens, row = tokens[order], row[order]
    if len(tokens):
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])])
        tokens, row = tokens[new], row[new]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return row[first], first, tokens


def set_ids(tokens: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(tokens), first) ^ size.astype(np.uint64)).view(np.int64)


def _column_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        for at in range(lo, hi, CHUNK_ROWS):  # rows of a slice are numbered in 16 bits
            to = min(hi, at + CHUNK_ROWS)
            yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]


def _binary(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of 8-byte items; ends: where each entry ends."""
    offsets = (np.concatenate([[0], ends]) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(parts))])


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _pack(ids: np.ndarray) -> bytes:
    """The low 40 bits of each id."""
    return ids.astype(np.uint32).tobytes() + (ids >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpack(blob: memoryview, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | (np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _buckets(docs: DataFrame) -> int:
    """Ranges of hashes: a power of two, several for each partition of a shuffle."""
    wanted = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(8, (wanted - 1).bit_length())


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal values in the first `keys` columns, as one iterator of rows each."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            fixed = [c.to_pylist() if not pa.types.is_binary(c.type) and not pa.types.is_list(c.type) else c for c in columns]
            for i in range(batch.num_rows):
                yield tuple(c[i] for c in fixed)

    for key, some in groupby(rows(), key=lambda r: r[:keys]):
        yield key, some


CHUNK_ROW = "bucket int, kind int, chunk bigint, a binary, b binary, ids array<{kind}>"


def _scan(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows of kind 0 (a bucket's tokens in a chunk, counted), 1 (the sets in which they stand) and 2 (what the chunk's documents are)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    shift = np.uint64(64 - _REST_BITS - (buckets.bit_length() - 1))

    def chunk_rows(chunk: int, ids: list[pa.Array], sets: list[np.ndarray], sizes: list[np.ndarray], tokens: list[np.ndarray]) -> Iterator[tuple]:
        set_of, size, token = np.concatenate(sets), np.concatenate(sizes), np.concatenate(tokens) >> shift
        some = size > 0
        known, first, of = np.unique(set_of[some], return_index=True, return_inverse=True)
        order = np.argsort(first)  # sets in the order in which they stand
        known, first, of = known[order], first[order], np.argsort(order)[of]
        size_of = size[some][first]
        begin = (np.cumsum(size[some]) - size[some])[first]
        place = np.full(len(size), -1, dtype=np.int32)
        place[some] = of
        all_ids = pa.concat_arrays(ids)
        yield chunk % buckets, 2, chunk, place.tobytes(), known.tobytes() + size_of.astype(np.int32).tobytes(), all_ids
        own = np.concatenate([token[b : b + s] for b, s in zip(begin, size_of)]) if len(known) else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(known), dtype=np.uint16), size_of)
        by = np.argsort(own)
        run = _starts(own[by])
        count = np.diff(np.concatenate([run, [len(by)]]))
        alone = np.zeros(len(own), dtype=bool)
        alone[by[run[count == 1]]] = True
        singles, single_doc = own[alone], doc[alone]
        by_bucket = np.argsort((singles >> np.uint64(_REST_BITS)).astype(np.uint32 if buckets > 65536 else np.uint16), kind="stable")
        singles, single_doc = singles[by_bucket], single_doc[by_bucket]
        multi, times = own[by[run[count > 1]]], count[count > 1].astype(np.uint16)
        multi_doc = doc[by][np.repeat(count > 1, count)]
        edges = np.arange(buckets + 1, dtype=np.uint64)
        s_at = np.searchsorted(singles >> np.uint64(_REST_BITS), edges)
        m_at = np.searchsorted(multi >> np.uint64(_REST_BITS), edges)
        d_at = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])[m_at]
        for k in np.flatnonzero((np.diff(s_at) > 0) | (np.diff(m_at) > 0)):
            s, m, d = slice(s_at[k], s_at[k + 1]), slice(m_at[k], m_at[k + 1]), slice(d_at[k], d_at[k + 1])
            yield int(k), 0, chunk, _pack(singles[s]) + _pack(multi[m]), np.uint32(s.stop - s.start).tobytes() + times[m].tobytes(), None
            yield int(k), 1, chunk, np.diff(single_doc[s], prepend=np.uint16(0)).tobytes() + multi_doc[d].tobytes(), None, None

    def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[3])
            if size > 8_000_000:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        bucket, knd, chunk, a, b, ids = zip(*rows)
        lists = [x for x in ids if x is not None]
        ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(lists) if lists else pa.array([], id_type))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(knd, pa.int32()), pa.array(chunk, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), listed], ["bucket", "kind", "chunk", "a", "b", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: tuple[list, ...] = ([], [], [], [])
        rows = tokens_held = 0
        for batch in batches:
            for at, data, offsets in _column_slices(batch.column(1)):
                row, first, tokens = token_sets(data, offsets, n)
                here = len(offsets) - 1
                if rows and (rows + here > CHUNK_ROWS or tokens_held + len(tokens) > CHUNK_TOKENS):
                    yield from out(chunk_rows((task << 24) + number, *held))
                    held, rows, tokens_held, number = ([], [], [], []), 0, 0, number + 1
                sets, size = np.zeros(here, dtype=np.int64), np.zeros(here, dtype=np.int64)
                if len(row):
                    size[row] = np.diff(np.concatenate([first, [len(tokens)]]))
                    sets[row] = set_ids(tokens, first, size[row])
                for into, x in zip(held, (own(batch.column(0).slice(at, here)), sets, size, tokens)):
                    into.append(x)
                rows, tokens_held = rows + here, tokens_held + len(tokens)
        if rows:
            yield from out(chunk_rows((task << 24) + number, *held))

    return docs.mapInArrow(lean(run), CHUNK_ROW.format(kind=kind))


def _shared_tokens(scanned: DataFrame) -> DataFrame:
    """For each chunk and bucket the tokens that occur in several sets, with set and class of frequency; rows of kind 2 as they are."""
    kind = scanned.schema["ids"].dataType.elementType.simpleString()
    id_type = to_arrow_type(scanned.schema["ids"].dataType.elementType)

    def reply(bucket: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        tokens, weights, parts, begin = [], [], {}, 0
        frequency = None
        for _, what, chunk, a, b, ids in rows:
            if what == 2:
                yield chunk, 2, bucket, a.as_py(), b.as_py(), ids.values
            elif what == 0:
                blob, about = a.as_buffer(), b.as_buffer()
                singles = int(np.frombuffer(about, np.uint32, 1)[0])
                times = np.frombuffer(about, np.uint16, offset=4)
                own = np.concatenate([_unpack(blob[: 5 * singles], singles), _unpack(blob[5 * singles :], len(times))])
                parts[chunk] = (begin, singles, times)
                tokens.append(own)
                weights.append(np.concatenate([np.ones(singles, np.int64), times]))
                begin += len(own)
            else:
                if frequency is None:
                    tokens, weight = np.concatenate(tokens), np.concatenate(weights)
                    by = np.argsort(tokens)
                    run = _starts(tokens[by])
                    total = np.add.reduceat(weight[by], run)
                    frequency = np.empty(len(tokens), dtype=np.int64)
                    frequency[by] = np.repeat(total, np.diff(np.concatenate([run, [len(tokens)]])))
                lo, singles, times = parts[chunk]
                doc = np.frombuffer(a.as_buffer(), np.uint16)
                doc = np.concatenate([np.cumsum(doc[:singles], dtype=np.uint16), doc[singles:]])
                entry = lo + np.concatenate([np.arange(singles), np.repeat(singles + np.arange(len(times)), times)])
                shared = frequency[entry] > 1
                entry, doc = entry[shared], doc[shared]
                if len(entry):
                    grade = np.minimum(255, np.round(8 * np.log2(frequency[entry]))).astype(np.uint8)
                    yield chunk, 1, bucket, doc.tobytes() + grade.tobytes(), _pack(tokens[entry]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _grouped(batches, 1):
            for chunk, what, of, a, b, ids in reply(bucket, rows):
                listed = pa.ListArray.from_arrays(pa.array([0, 0 if ids is None else len(ids)], pa.int32()), ids if ids is not None else pa.array([], id_type))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([what], pa.int32()), pa.array([of], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary()), listed], ["chunk", "kind", "bucket", "a", "b", "ids"])
        give_back()

    ordered = scanned.repartition("bucket").sortWithinPartitions("bucket", "kind", "chunk")
    return ordered.mapInArrow(run, f"chunk bigint, kind int, bucket int, a binary, b binary, ids array<{kind}>")


def _assemble(replies: DataFrame, threshold: float) -> DataFrame:
    """A row per document: doc_id, set_id, m and, for one of each chunk's sets that may have a partner, key and tokens, rarest first."""
    kind = replies.schema["ids"].dataType.elementType.simpleString()

    def finish(rows: Iterator[tuple]) -> pa.RecordBatch | None:
        doc, grade, token = [], [], []
        ids = place = known = size = None
        for _, what, bucket, a, b, listed in rows:
            if what == 2:
                ids, place = listed.values, np.frombuffer(a.as_buffer(), np.int32)
                raw = b.as_buffer()
                known = np.frombuffer(raw, np.int64, raw.size // 12)
                size = np.frombuffer(raw, np.int32, len(known), 8 * len(known))
            else:
                n = len(a.as_buffer()) // 3
                doc.append(np.frombuffer(a.as_buffer(), np.uint16, n))
                grade.append(np.frombuffer(a.as_buffer(), np.uint8, n, 2 * n))
                token.append(_unpack(b.as_buffer(), n) | (np.uint64(bucket) << np.uint64(_REST_BITS)))
        if ids is None or not len(ids):
            return None
        doc, grade, token = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((doc, np.uint16), (grade, np.uint8), (token, np.uint64)))
        count = np.bincount(doc, minlength=len(known))
        able = count >= np.ceil(threshold * size - 1e-9)
        kept = able[doc] if len(doc) else np.zeros(0, dtype=bool)
        doc, grade, token = doc[kept], grade[kept], token[kept]
        order = np.lexsort((token, grade, doc))
        token = token[order]
        count = np.where(able, count, 0)
        first = np.cumsum(count) - count
        key = np.zeros(len(known), dtype=np.uint64)
        if len(token):
            key[count > 0] = np.minimum.reduceat(mix(token), first[count > 0])
        lead = np.zeros(len(place), dtype=bool)  # of equal sets of the chunk the first row has the tokens
        _, at = np.unique(place, return_index=True)
        lead[at] = True
        lead &= place >= 0
        lead[lead] = count[place[lead]] > 0
        of = place[lead]
        ends = np.cumsum(count[of])
        parts = np.concatenate([token[first[s] : first[s] + count[s]] for s in of]) if len(of) else np.zeros(0, np.uint64)
        spread = np.full(len(place), -1, dtype=np.int64)
        spread[lead] = np.arange(len(of))
        take = pa.array(np.where(lead, spread, 0), mask=~lead)
        has = place >= 0
        safe = np.maximum(place, 0)
        sets = pa.array(known[safe] if len(known) else np.zeros(len(place), np.int64), mask=~has)
        sizes = pa.array(size[safe] if len(known) else np.zeros(len(place), np.int32), mask=~has)
        return pa.RecordBatch.from_arrays([ids, sets, sizes, pa.array(key[of].view(np.int64)).take(take), _binary(parts, ends).take(take)], ["doc_id", "set_id", "m", "key", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            out = finish(rows)
            if out is not None:
                yield out
            del out, rows
            give_back()

    return replies.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, f"doc_id {kind}, set_id bigint, m int, key bigint, tokens binary")


GROUP = "gid bigint, n int, low int, sets binary, sizes binary, counts binary, tokens binary"


def _groups(sets: DataFrame) -> DataFrame:
    """Groups of neighbouring sets; gid is one of their set_ids. Equal sets of several chunks become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        done: list[tuple] = []
        size = total = 0

        def close() -> None:
            ids, m, _, blobs = zip(*held)
            counts = np.array([len(x) // 8 for x in blobs], dtype=np.int32)
            done.append((ids[0], len(ids), min(m), np.array(ids, np.int64).tobytes(), np.array(m, np.int32).tobytes(), counts.tobytes(), b"".join(blobs)))
            held.clear()

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], ["gid", "n", "low", "sets", "sizes", "counts", "tokens"])

        for batch in batches:
            for key, m, sid, blob in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and held[-1][0] == sid:
                    continue
                if held and (held[0][2] != key or len(held) >= GROUP_SETS or m > GROUP_SPAN * held[0][1] or size + len(blob) > 8 * GROUP_TOKENS):
                    close()
                    size = 0
                held.append((sid, m, key, blob))
                size, total = size + len(blob), total + len(blob)
                if total > 8_000_000 and done:
                    yield out()
                    done.clear()
                    total = size
        if held:
            close()
        if done:
            yield out()

    placed = sets.where("tokens is not null").select("key", "m", "set_id", "tokens")
    return placed.repartitionByRange("key", "m", "set_id").sortWithinPartitions("key", "m", "set_id").mapInArrow(run, GROUP)


def _largest_partner(m: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """Of a token that is the place-th (from 1) of a set of size m: the largest set with which it can be the rarest common one."""
    return np.floor((m - place + 1) * ((1 + threshold) / threshold) - m + 1e-6).astype(np.int32)


def _meetings(groups: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """Pairs g < h of groups with a token that may be the rarest common one of a linked pair."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def out() -> pa.RecordBatch:
            token, gid, low, most = (np.concatenate(x) for x in zip(*held))
            bucket = (token >> np.uint64(_REST_BITS)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            token, gid, low, most, bucket = token[order], gid[order], low[order], most[order], bucket[order]
            start = _starts(bucket)
            ends = np.concatenate([start[1:], [len(bucket)]])
            blobs = [[x[a:b].tobytes() for a, b in zip(start, ends)] for x in (token, gid, low, most)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], ["bucket", "token", "gid", "low", "most"])

        for batch in batches:
            for gid, sizes, counts, tokens in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                m, count = np.frombuffer(sizes.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int32)
                token = np.frombuffer(tokens.as_buffer(), np.uint64)
                size = np.repeat(m, count)
                place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(m - count, count) + 1
                most = _largest_partner(size, place, threshold)
                early = most >= np.ceil(threshold * size - 1e-9)
                token, size, most = token[early], size[early], most[early]
                if len(m) > 1:
                    order = np.argsort(token, kind="stable")
                    run = _starts(token[order])
                    token, size, most = token[order][run], np.minimum.reduceat(size[order], run), np.maximum.reduceat(most[order], run)
                held.append((token, np.full(len(token), gid, np.int64), size, most))
                total += len(token)
                if total > 1_000_000:
                    yield out()
                    held, total = [], 0
        if total:
            yield out()

    def meet(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
        token, gid, low, most = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((low, token))
        token, gid, low, most = token[order], gid[order], low[order], most[order]
        start = _starts(token)
        rank = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [len(token)]]))).astype(np.int64) << 32
        last = np.searchsorted(rank | low, rank | np.maximum(most, 0), side="right")
        count = np.maximum(last - np.arange(len(token)) - 1, 0)
        names, code = np.unique(gid, return_inverse=True)
        found = np.zeros(0, np.int64)
        cuts = np.cumsum(count)
        lo = 0
        while lo < len(count):
            before = cuts[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cuts, before + PAIRS_AT_ONCE, side="right")))
            n = count[lo:hi]
            one = np.repeat(np.arange(lo, hi), n)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            both = low[one] <= most[two]
            one, two = code[one[both]], code[two[both]]
            found = np.unique(np.concatenate([found, np.minimum(one, two) * len(names) + np.maximum(one, two)]))
            lo = hi
        return names[found // len(names)], names[found % len(names)]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            parts = [tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(r[1:], (np.uint64, np.int64, np.int32, np.int32))) for r in rows]
            g, h = meet(parts)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(h)], ["g", "h"])

    posted = groups.select("gid", "sizes", "counts", "tokens").mapInArrow(post, "bucket int, token binary, gid binary, low binary, most binary")
    return posted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pair, "g bigint, h bigint").distinct()


class Group:
    """A group's sets and the matrix of its tokens."""

    def __init__(self, sets: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray):
        self.sets, self.sizes, self.counts, self.tokens = sets, sizes.astype(np.int64), counts, tokens
        self.low = int(sizes.min())
        self.row = np.repeat(np.arange(len(sets)), counts)

    def open(self) -> None:
        self.union, column = np.unique(self.tokens, return_inverse=True)
        self.matrix = np.zeros((len(self.sets), len(self.union)), dtype=np.float32)
        self.matrix[self.row, column] = 1

    def inner_links(self, threshold: float) -> np.ndarray:
        return _linked(self.matrix @ self.matrix.T, self.sizes, self.sizes, threshold) & ~np.eye(len(self.sets), dtype=bool)

    def links(self, queries: Group, threshold: float) -> np.ndarray | None:
        """Which of the queries (rows) are linked with which of this group's sets; None if no query opens the group."""
        column = np.minimum(np.searchsorted(self.union, queries.tokens), len(self.union) - 1)
        known = self.union[column] == queries.tokens
        bound = np.bincount(queries.row[known], minlength=len(queries.sets))
        opened = bound >= threshold / (1 + threshold) * (queries.sizes + self.low) - 1e-9
        if not opened.any():
            return None
        at = np.cumsum(opened) - 1
        used = known & opened[queries.row]
        matrix = np.zeros((int(opened.sum()), len(self.union)), dtype=np.float32)
        matrix[at[queries.row[used]], column[used]] = 1
        out = np.zeros((len(queries.sets), len(self.sets)), dtype=bool)
        out[opened] = _linked(matrix @ self.matrix.T, queries.sizes[opened], self.sizes, threshold)
        return out


def _linked(common: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    return common >= threshold * (one[:, None] + two[None, :] - common) - 1e-6


def roots_of(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least name that links connect each row and column with."""
    most = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(links, columns[None, :], most).min(axis=1))
        new_columns = np.minimum(columns, np.where(links, new_rows[:, None], most).min(axis=0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _compare(groups: DataFrame, meetings: DataFrame, threshold: float) -> DataFrame:
    """(set_id, root, links), written: by cell, the sets that are linked, with whom they are connected and their number of links."""
    parts = meetings.groupBy("g").agg((1 + F.floor(F.count("*") / MEET_AT_ONCE)).alias("parts"))
    cells = scratch.materialise(meetings.join(parts, "g").select("g", "h", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part")), "cells")
    owners = cells.select("g", "part").unionByName(groups.where("n > 1").select(F.col("gid").alias("g"), F.lit(0).alias("part"))).distinct()
    roles = owners.select(F.col("g").alias("gid"), F.col("g").alias("owner"), "part", F.lit(0).alias("role")).unionByName(cells.select(F.col("h").alias("gid"), F.col("g").alias("owner"), "part", F.lit(1).alias("role")))
    roles = scratch.materialise(roles, "roles")
    small = roles.count() * 24 <= BROADCAST_BYTES
    rows = groups.join(F.broadcast(roles) if small else roles, "gid").select("owner", "part", "role", "gid", "sets", "sizes", "counts", "tokens")
    rows = rows.repartition("owner", "part").sortWithinPartitions("owner", "part", "role", "gid")

    def of(row: tuple) -> Group:
        return Group(*(np.frombuffer(x.as_buffer(), t) for x, t in zip(row[4:], (np.int64, np.int32, np.int32, np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []

        def add(names: np.ndarray, roots: np.ndarray, links: np.ndarray) -> None:
            some = links > 0
            out.append((names[some], roots[some], links[some].astype(np.int64)))

        for (_, part), some in _grouped(batches, 2):
            owner = None
            for row in some:
                if row[2] == 0:
                    owner = of(row)
                    owner.open()
                    if part == 0 and len(owner.sets) > 1:
                        links = owner.inner_links(threshold)
                        add(owner.sets, roots_of(links, owner.sets, owner.sets)[0], links.sum(axis=1))
                    continue
                queries = of(row)
                links = owner.links(queries, threshold)
                if links is not None and links.any():
                    one, two = roots_of(links, queries.sets, owner.sets)
                    add(queries.sets, one, links.sum(axis=1))
                    add(owner.sets, two, links.sum(axis=0))
            if sum(len(x[0]) for x in out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["set_id", "root", "links"])
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["set_id", "root", "links"])

    found = scratch.materialise(rows.mapInArrow(run, "set_id bigint, root bigint, links bigint"), "links")
    scratch.release(cells, roles)
    return found


def _classified(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, set_id) of all documents, (set_id, lead, class_id, class_set, copies, links) of all sets); lead is the set's least id."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null")
    buckets = _buckets(docs)
    sets = scratch.materialise(_assemble(_shared_tokens(_scan(docs, n, buckets)), threshold), "sets")
    groups = scratch.materialise(_groups(sets), "groups")
    meetings = scratch.materialise(_meetings(groups, threshold, buckets), "meetings")
    met = _compare(groups, meetings, threshold)
    scratch.release(groups, meetings)
    roots = connected_components(met, "set_id", "root")
    linked = met.groupBy("set_id").agg(F.sum("links").alias("links")).join(roots.select(F.col("node").alias("set_id"), "root"), "set_id")
    members = sets.select("doc_id", "set_id").distinct()
    each = members.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("lead"), (F.count("*") - 1).alias("copies"))
    each = each.join(linked, "set_id", "left").select("set_id", "lead", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set_id").alias("root"))
    each = scratch.materialise(each, "each")
    scratch.release(met)
    best = each.groupBy("root").agg(F.min(F.struct("lead", "set_id")).alias("best"))
    each = each.join(best, "root").select("set_id", "lead", F.col("best.lead").alias("class_id"), F.col("best.set_id").alias("class_set"), "copies", "links")
    return members, each


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copies, links) of every document.

    class_id is the least id of all documents that links connect with it, its
    own if there is none; copies counts the other documents with the same set
    of n-grams, links the other sets with a Jaccard similarity of at least the
    threshold.
    """
    members, each = _classified(docs, threshold, n, id_col, text_col)
    none = F.lit(0).cast("bigint")
    return members.join(each, "set_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", none).alias("copies"), F.coalesce("links", none).alias("links"))


def _with_set(docs: DataFrame, name: str, n: int, text_col: str) -> DataFrame:
    """`docs` with the id of each text's set of n-grams, null without words."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, has = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=bool)
            for lo, data, offsets in _column_slices(batch.column(at)):
                row, first, tokens = token_sets(data, offsets, n)
                if len(row):
                    sets[row + lo] = set_ids(tokens, first, np.diff(np.concatenate([first, [len(tokens)]])))
                    has[row + lo] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, mask=~has)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keep_one_per_group(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without those whose class has a document of a lesser id.

    Of rows that repeat id and set of n-grams one stays, the one of least text;
    rows of one id with texts that aren't linked all stay. Rows without id or
    words stay.
    """
    members, each = _classified(docs, threshold, n, id_col, text_col)
    fresh = lambda name: name if name not in docs.columns else fresh("_" + name)
    lost_id, lost_set, own_set, place = map(fresh, ("lost_id", "lost_set", "own_set", "place"))
    of: Column = (F.col("doc_id") != F.col("class_id")) | (F.col("set_id") != F.col("class_set"))
    lost = scratch.materialise(members.join(each, "set_id").where(of).select(F.col("doc_id").alias(lost_id), F.col("set_id").alias(lost_set)), "lost")
    weight = lost.select(F.sum(F.octet_length(F.col(lost_id).cast("string")) + 24)).first()[0] or 0
    side = F.broadcast(lost) if weight <= BROADCAST_BYTES else lost
    if docs.where(docs[id_col].isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return docs.join(side, docs[id_col] == F.col(lost_id), "left_anti")
    marked = _with_set(docs, own_set, n, text_col)
    kept = marked.join(side, (marked[id_col] == F.col(lost_id)) & (marked[own_set] == F.col(lost_set)), "left_anti")
    again = Window.partitionBy(id_col, own_set).orderBy(kept[text_col].asc_nulls_last())
    return kept.withColumn(place, F.row_number().over(again)).where((F.col(place) == 1) | F.col(own_set).isNull() | F.col(id_col).isNull()).drop(place, own_set)
