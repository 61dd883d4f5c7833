"""Numpy kernels over Arrow string columns: slices, words and rolling hashes.

All kernels work on the UTF-8 bytes of whole texts, many documents at once.
A word is a maximal run of bytes that a table of 256 flags marks; runs never
cross documents. Hashes are 64-bit polynomial hashes modulo 2**64 over random
byte codes, taken from prefix sums, so that any span's hash is one subtraction
and one multiplication, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time, so that temporaries stay within tens of MB; a longer text is handled alone, whole.
SLICE_BYTES = 500_000
#: Rows of a batch that `lean` hands on at a time.
ROWS_AT_ONCE = 2_000

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xC2B2AE3D27D4EB4F | 1}
_KEPT_POWERS = 4_000_000
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}

#: Whitespace of ASCII; everything else belongs to words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters and digits of ASCII, and every byte of a longer UTF-8 sequence.
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True


def powers(base: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (_BASES[base], pow(_BASES[base], -1, 2**64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        kept = (both[0], both[1])
        if size <= _KEPT_POWERS:
            _powers[base] = kept
    return kept[0][:n], kept[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system; allocators of a worker that is used again would keep it for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # no glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for mapInArrow, over parts of the batches, so that its own batches are small too; freed memory is given back after each batch."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield batch.slice(lo, ROWS_AT_ONCE)
            del batch
            give_back()

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts(batches))
        give_back()

    return lean_run


def own(column: pa.Array) -> pa.Array:
    """A copy of the column; the columns of a batch that was received share its memory, so that keeping one keeps all."""
    return column.take(pa.array(np.arange(len(column))))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Spans of the words of many texts, in order: start, end (bytes), doc (row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE):
        flag = table[data]
        before = np.zeros(len(flag), dtype=bool)
        after = np.zeros(len(flag), dtype=bool)
        before[1:], after[:-1] = flag[:-1], flag[1:]
        if len(flag):
            before[offsets[:-1][offsets[:-1] < len(flag)]] = False
            ends = offsets[1:] - 1
            after[ends[ends >= 0]] = False
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(flag & ~before)
        self.end = np.flatnonzero(flag & ~after) + 1
        self.doc = np.searchsorted(offsets[1:], self.start, side="right")
        #: Of each row, its first word; one entry more than rows.
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)), side="left")

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal bytes have equal hashes wherever they stand."""
    up, down = powers("byte", len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


class Rolling:
    """Hashes of runs of consecutive words."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = powers("word", len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def run_starts(doc: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n consecutive words of one document begin."""
    if len(doc) < n:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the entries whose key stands more than once, and of those whose key also stands further to the left."""
    out = np.zeros(len(keys), dtype=bool)
    later = out
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        if same.any():
            out[order[1:][same]] = True
            out[order[:-1][same]] = True
            later = out.copy()
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            later[np.minimum.reduceat(order, head)] = False
    return out, later


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for the letters of ASCII and of Latin-1 (À to Þ, but not ×)."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = np.zeros(len(data), dtype=bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[latin] += 32
    return out


def char_counts(data: np.ndarray) -> np.ndarray:
    """Prefix sums of code points: entry i counts those that begin before byte i."""
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total
