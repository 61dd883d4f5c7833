"""Word-aligned binary coding of token ids (Simple-8b).

Ids are cut into blocks of `BLOCK`. A block is a sequence of 64-bit words,
little-endian. The top 4 bits of a word are its selector, which tells how many
ids of how many bits fill the other 60:

    selector   0    1   2   3   4   5   6   7  8  9 10 11 12 13 14    15
    ids      240  120  60  30  20  15  12  10  8  7  6  5  4  3  2     1
    bits       0    0   1   2   3   4   5   6  7  8 10 12 15 20 30   esc

Each word takes the selector of most ids that fits the next ids; a word may be
filled up with zeros at the end of its block only, so a block's number of ids,
known from the length, ends it. Selector 15 is an escape: the low 60 bits hold
one id of 31 to 60 bits, or, if their top bit is set, nothing, and the whole
next word is the id (61 to 64 bits, and negative ids).

`offsets` holds the first word of each block, so any block can be decoded
alone, and all blocks in step with each other: packing and unpacking are numpy
operations over the words of many documents at once.

`shards` frames this as a file: rows are written as one record each into part
files by `write_shards`, and `read_shards` gives them back.

Defined results: null ids lists give null bytes and offsets with n_tokens 0;
an empty list gives empty bytes; a null id inside a list is an error, as it
has no code; lists of any length, repeated rows and equal or null keys are
coded row by row; an empty table gives an empty table; further columns pass
through, those called n_tokens, packed or offsets give way. Shards keep keys
of any type that survives a cast to string and back, null keys as null.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bpe

BLOCK = 1024
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 15
_WIDE = np.uint64(1) << np.uint64(59)
_LOW60 = (np.uint64(1) << np.uint64(60)) - np.uint64(1)
#: Ids packed at a time, so that temporaries stay small.
AT_ONCE = 1_000_000
#: Texts tokenized and packed at a time.
ROWS_AT_ONCE = 1_000


def blocks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first id of each block and the end of the last, blocks of each list) for lists laid end to end."""
    n_blocks = -(-counts // BLOCK)
    first_block = np.cumsum(n_blocks) - n_blocks
    within = np.arange(n_blocks.sum()) - np.repeat(first_block, n_blocks)
    start = np.repeat(np.cumsum(counts) - counts, n_blocks) + within * BLOCK
    return np.concatenate([start, [counts.sum()]]), n_blocks


def pack(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of the blocks that begin at starts, which ends with len(ids)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    value = ids.astype(np.int64).view(np.uint64)
    stop = np.repeat(starts[1:], np.diff(starts))
    ends = np.zeros(n + 1, dtype=bool)
    ends[starts] = True
    # bits of each value; beyond 30 only that there are more matters, so rounding to a float does no harm
    bits = np.frexp(value.astype(np.float64))[1].astype(np.uint8)
    # the selector of most ids that fit, for every position
    choice = np.full(n, ESCAPE, dtype=np.int8)
    for s in range(len(COUNTS) - 2, -1, -1):
        room_for = int(COUNTS[s])
        # stretches of values that are narrow enough, cut where blocks end
        narrow = bits <= BITS[s]
        edge = np.concatenate([[True], narrow[1:] != narrow[:-1], [True]]) | ends
        edge[:-1] &= narrow | np.concatenate([[False], narrow[:-1]])
        edge[-1] &= narrow[-1]
        border = np.flatnonzero(edge)
        inside = np.concatenate([narrow, [False]])[border]
        first, stop_at = border[inside], border[1:][inside[:-1]]
        # a word may be filled up with zeros where its block ends
        size = np.where(ends[stop_at], stop_at - first, stop_at - first - room_for + 1)
        some = size > 0
        first, size = first[some], size[some]
        if len(first):
            change = np.zeros(n + 1, dtype=np.int8)
            change[first] += 1
            change[first + size] -= 1
            np.copyto(choice, np.int8(s), where=np.cumsum(change[:n], dtype=np.int8).view(bool))
    selectors, at, block = [], [], []
    live, pos = np.arange(len(starts) - 1), starts[:-1].copy()
    some = pos < starts[1:]
    live, pos = live[some], pos[some]
    while len(live):
        s = choice[pos]
        selectors.append(s)
        at.append(pos)
        block.append(live)
        pos = pos + COUNTS[s]
        more = pos < starts[live + 1]
        live, pos = live[more], pos[more]
    selector, at, block = np.concatenate(selectors), np.concatenate(at), np.concatenate(block)
    order = np.argsort(block, kind="stable")
    selector, at, block = selector[order], at[order], block[order]
    escaped = np.flatnonzero(selector == ESCAPE)
    wide = escaped[value[at[escaped]] >= _WIDE]
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([value, np.zeros(COUNTS[0], np.uint64)])
    for s in range(2, ESCAPE):
        which = np.flatnonzero(selector == s)
        if len(which):
            begin, word = at[which], np.zeros(len(which), dtype=np.uint64)
            for k in range(int(COUNTS[s])):
                word |= padded[begin + k] << np.uint64(k * BITS[s])
            beyond = COUNTS[s] - np.minimum(stop[begin] - begin, COUNTS[s])  # zeros there
            word &= _LOW60 >> (beyond * BITS[s] + (60 - COUNTS[s] * BITS[s])).astype(np.uint64)
            words[which] |= word
    narrow = escaped[value[at[escaped]] < _WIDE]
    words[narrow] |= value[at[narrow]]
    words[wide] |= _WIDE
    size = np.bincount(block, minlength=len(starts) - 1)
    if len(wide):
        words = np.insert(words, wide + 1, value[at[wide]])
        size += np.bincount(block[wide], minlength=len(starts) - 1)
    return words, size


def unpack(words: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of blocks: begin has the first word of each and the end of the last, counts the number of ids."""
    if not len(words):
        return np.zeros(0, np.int64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    marks = (selector == ESCAPE) & (words & _WIDE != 0)
    raw = np.zeros(len(words), dtype=bool)
    if marks.any():
        # a raw word may look like a mark itself: within a run of marks every second word is raw
        head = np.flatnonzero(marks & ~np.concatenate([[False], marks[:-1]]))
        run = np.cumsum(np.isin(np.arange(len(words)), head))
        place = np.arange(len(words)) - head[np.maximum(run - 1, 0)]
        odd = marks & (run > 0) & (place % 2 == 1)
        real = marks & ~odd
        raw[np.flatnonzero(real) + 1] = True
    took = COUNTS[selector]
    took[raw] = 0
    block = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    ends = np.cumsum(took)
    before = ends - took
    first = np.zeros(len(begin) - 1, dtype=np.int64)
    some = np.diff(begin) > 0
    first[some] = before[begin[:-1][some]]
    target = np.cumsum(counts) - counts
    place = target[block] + before - first[block]
    limit = (target + counts)[block]
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in range(2, ESCAPE):
        which = np.flatnonzero((selector == s) & ~raw)
        if len(which):
            value = (words[which][:, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s]))) & ((np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1))
            where = place[which][:, None] + np.arange(COUNTS[s])
            inside = where < limit[which][:, None]
            out[where[inside]] = value[inside]
    single = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[place[single]] = words[single] & (_WIDE - np.uint64(1))
    wide = single[words[single] & _WIDE != 0]
    out[place[wide]] = words[wide + 1]
    return out.view(np.int64)


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(flat values, counts, null marks) of a list column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = column.is_null()
    counts = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    values = column.flatten()
    if values.null_count:
        raise ValueError("a null token id has no code")
    return np.asarray(values, dtype=np.int64), counts, null


def encode_column(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(n_tokens, packed, offsets) of a column of id lists."""
    values, counts, null = _lists(column)
    edges = np.cumsum(counts)
    blobs: list[bytes | None] = []
    offsets: list[np.ndarray] = []
    lo = 0
    while lo < len(counts):
        base = edges[lo] - counts[lo]
        hi = max(lo + 1, int(np.searchsorted(edges, base + AT_ONCE, side="right")))
        starts, n_blocks = blocks_of(counts[lo:hi])
        words, size = pack(values[base : edges[hi - 1]], starts)
        begin = np.concatenate([[0], np.cumsum(size)])
        block_edge = np.concatenate([[0], np.cumsum(n_blocks)])
        raw = words.tobytes()
        for k in range(hi - lo):
            a, b = block_edge[k], block_edge[k + 1]
            blobs.append(raw[8 * begin[a] : 8 * begin[b]])
            offsets.append(begin[a:b] - begin[a])
        lo = hi
    blobs = [None if gone else b for gone, b in zip(null.to_pylist(), blobs)]
    edge = np.concatenate([[0], np.cumsum([len(o) for o in offsets])]).astype(np.int32)
    flat = np.concatenate(offsets).astype(np.int32) if offsets else np.zeros(0, np.int32)
    return pa.array(counts.astype(np.int32)), pa.array(blobs, pa.binary()), pa.ListArray.from_arrays(pa.array(edge), pa.array(flat), mask=null if null.true_count else None)


def decode_column(n_tokens: pa.Array, packed: pa.Array, offsets: pa.Array) -> pa.Array:
    """The id lists (bigint) again."""
    null = packed.is_null()
    counts = np.asarray(n_tokens.fill_null(0), dtype=np.int64)
    blobs = [b or b"" for b in packed.to_pylist()]
    size = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
    words = np.frombuffer(b"".join(blobs), dtype="<u8")
    n_blocks = np.asarray(offsets.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(offsets.flatten(), dtype=np.int64)
    begin = np.concatenate([flat + np.repeat(np.cumsum(size) - size, n_blocks), [len(words)]])
    starts, _ = blocks_of(counts)
    values = unpack(words, begin, np.diff(starts))
    edge = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(values), mask=null if null.true_count else None)


def _plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _same_lists(one: pa.Array, two: pa.Array) -> pa.Array:
    """Which lists are equal."""
    a, b = np.asarray(one.value_lengths().fill_null(-1)), np.asarray(two.value_lengths().fill_null(-1))
    if not np.array_equal(a, b):
        return pa.array([x == y for x, y in zip(one.to_pylist(), two.to_pylist())])
    size = np.maximum(a, 0).astype(np.int64)
    wrong = np.flatnonzero(np.asarray(one.flatten(), dtype=np.int64) != np.asarray(two.flatten()))
    return pa.array(np.bincount(np.searchsorted(np.cumsum(size), wrong, side="right"), minlength=len(size)) == 0)


def encode(table: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """`table` with n_tokens, packed and offsets in place of the ids."""
    made = ("n_tokens", "packed", "offsets")
    rest = [f for f in table.schema if f.name != tokens_col and f.name not in made]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.IntegerType()), T.StructField("packed", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(rest))), *encode_column(_plain(batch.column(len(rest))))], schema.fieldNames())

    return table.select(*(table[f.name].alias(f"_{k}") for k, f in enumerate(rest)), table[tokens_col].cast("array<bigint>").alias("_tokens")).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str = bpe.VOCABULARY, text_col: str = "text", check: bool = False) -> DataFrame:
    """`docs` with n_tokens, packed and offsets of the BPE ids in place of the text, tokenized and packed by one worker.

    With `check` also round_trip, whether unpacking gives the ids again.
    """
    made = ("n_tokens", "packed", "offsets", "round_trip")[: 3 + check]
    rest = [f for f in docs.schema if f.name != text_col and f.name not in made]
    kinds = (T.IntegerType(), T.BinaryType(), T.ArrayType(T.IntegerType()), T.BooleanType())
    schema = T.StructType([*rest, *(T.StructField(name, kind) for name, kind in zip(made, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                _, tokens, _ = bpe.encode_column(_plain(part.column(len(rest))), path)
                coded = encode_column(tokens)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), *coded, *([_same_lists(tokens, decode_column(*coded))] if check else [])], schema.fieldNames())

    return docs.select(*(docs[f.name].alias(f"_{k}") for k, f in enumerate(rest)), docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def decode(table: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """`table` with the ids (array<bigint>) in place of n_tokens, packed and offsets."""
    made = ("n_tokens", "packed", "offsets")
    rest = [f for f in table.schema if f.name != tokens_col and f.name not in made]
    schema = T.StructType([*rest, T.StructField(tokens_col, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(rest)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), decode_column(*(_plain(batch.column(n + k)) for k in range(3)))], schema.fieldNames())

    return table.select(*(table[f.name].alias(f"_{k}") for k, f in enumerate(rest)), *(table[c] for c in made)).mapInArrow(run, schema)


_MAGIC = b"S8B2"
_RECORD = "<iiqi"


def shard_bytes(keys: list[str | None], counts: list[int], blobs: list[bytes | None], offsets: list[list[int] | None]) -> bytes:
    """One shard: magic, number of records, a table of (bytes of the key or -1, n_tokens, words or -1, blocks), then key, offsets and words of each."""
    head, body = [], []
    for key, n, blob, starts in zip(keys, counts, blobs, offsets):
        raw = None if key is None else key.encode()
        head.append(struct.pack(_RECORD, -1 if raw is None else len(raw), n, -1 if blob is None else len(blob) // 8, len(starts or ())))
        body += [raw or b"", np.array(starts or (), dtype="<i4").tobytes(), blob or b""]
    return _MAGIC + struct.pack("<q", len(head)) + b"".join(head) + b"".join(body)


def parse_shard(data: bytes) -> Iterator[tuple[str | None, int, bytes | None, list[int] | None]]:
    """The records of one shard."""
    if data[:4] != _MAGIC:
        raise ValueError("this is no shard of packed token ids")
    (n,) = struct.unpack_from("<q", data, 4)
    size = struct.calcsize(_RECORD)
    at = 12 + n * size
    for k in range(n):
        key_size, count, words, blocks = struct.unpack_from(_RECORD, data, 12 + k * size)
        key = None if key_size < 0 else data[at : at + key_size].decode()
        at += max(key_size, 0)
        starts = np.frombuffer(data, dtype="<i4", count=blocks, offset=at).tolist()
        at += 4 * blocks
        blob = None if words < 0 else data[at : at + 8 * words]
        at += 8 * max(words, 0)
        yield key, count, blob, None if words < 0 else starts


def shards(table: DataFrame, key_col: str = "doc_id", tokens_col: str = "tokens", records: int = 10_000) -> DataFrame:
    """Shards of at most `records` rows: their bytes and number of records and ids. Keys are kept as strings."""
    packed = encode(table.select(table[key_col].cast("string").alias("key"), table[tokens_col].alias("tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, records):
                part = batch.slice(lo, records)
                cols = [c.to_pylist() for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([shard_bytes(*cols)], pa.binary()), pa.array([part.num_rows], pa.int32()), pa.array([sum(cols[1])], pa.int64())], ["shard", "records", "ids"])

    return packed.mapInArrow(run, "shard binary, records int, ids long")


def write_shards(table: DataFrame, path: str, **options) -> None:
    shards(table, **options).write.mode("error").parquet(path)


def read_shards(spark, path: str, tokens_col: str = "tokens", key_type: str = "bigint") -> DataFrame:
    """key (in the type it had) and tokens of all records of the shards under `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = list(parse_shard(data))
                keys, counts, blobs, starts = ([r[k] for r in found] for k in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int32()), pa.array(blobs, pa.binary()), pa.array(starts, pa.list_(pa.int32()))], ["key", "n_tokens", "packed", "offsets"])

    table = spark.read.parquet(path).select("shard").mapInArrow(run, "key string, n_tokens int, packed binary, offsets array<int>")
    return decode(table, tokens_col).select(F.col("key").cast(key_type), F.col(tokens_col))
