"""Byte-level BPE encoding and decoding, by speculation and verification.

Texts are split into pieces by the public pattern for byte-level vocabularies
(contractions, letters, numbers, other signs, white space; a single space goes
with what follows), on code points and for a whole batch of texts at once.
Each distinct piece is encoded once:

1. Speculate: from its first byte on, always the longest token that fits,
   found for all positions of all pieces together by steps through a trie.
2. Verify: a token sequence is the BPE encoding exactly if each adjacent pair
   is one that merging would leave apart. That is tested by undoing the merges
   of both tokens along their common border, for all pairs in lock-step.
3. Pieces with a pair that fails are merged exactly, lowest rank first.

Encoded pieces are remembered by a hash. The bytes of all ids of a batch are
compared with its texts, so pieces that share a hash are noticed; that batch is
then encoded piece by piece.

Vocabularies are rank files (base64 token, rank); the path is a parameter and
must be readable on every executor. Ids equal ranks, the 256 bytes come first.

Defined results: a null text has null tokens and n_tokens 0; an empty text has
no tokens; texts of any length are encoded whole; repeated rows and equal or
null ids are encoded row by row; an empty table gives an empty table. `encode`
returns the other columns as they were; columns that were called n_tokens or
tokens give way. `decode` turns null tokens into a null text, and ids outside
the vocabulary, null ones included, and bytes that are no UTF-8 into U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.textarrays import lean, slices, span_hashes, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pieces that a worker remembers before it starts afresh.
REMEMBERED = 300_000

_LETTER, _NUMBER, _SPACE = 1, 2, 3
_NO_LIMIT = 1 << 40


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter, number, space or other (0) of each code point."""
    kind = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8)
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        which = np.flatnonzero((lead >= low) & (lead < high))
        if len(which):
            value = (lead[which] & mask).astype(np.int32)
            for k in range(1, more + 1):
                value = (value << 6) | (data[at[which] + k] & 0x3F)
            cp[which] = value
    return at, cp


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in bytes of the pieces of all texts, in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, cp = code_points(data)
    kind = _classes()[cp]
    n = len(cp)
    new_doc = np.zeros(n + 1, dtype=bool)
    begins = np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])
    new_doc[begins] = True
    new_doc[n] = True
    run = np.ones(n + 1, dtype=bool)
    run[1:n] = kind[1:] != kind[:-1]
    run |= new_doc
    cut = run.copy()
    starts = np.flatnonzero(run)
    space = starts[:-1][kind[starts[:-1]] == _SPACE]
    if len(space):
        ends = starts[np.searchsorted(starts, space) + 1]
        inner = ~new_doc[ends]  # a run at the end of a text is one piece
        ends = ends[inner]
        cut[ends - 1] = True
        cut[ends[cp[ends - 1] == 32]] = False
    quote = np.flatnonzero(cut[:n] & (cp == 39) & run[:n] & run[1:])
    quote = quote[~new_doc[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        two = np.where((quote + 2 < n) & ~new_doc[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for which, size in ((short, 2), (long & ~short, 3)):
            cut[quote[which] + 1] = False
            cut[quote[which] + size] = True
    where = np.concatenate([at, [len(data)]])[np.flatnonzero(cut)]
    return where[:-1], where[1:]


class Vocabulary:
    """Ranks, splits and the trie of one rank file, and the pieces encoded so far."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._split()
        self._grow_trie()
        self.length = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self._forget()

    def _split(self) -> None:
        """The two tokens whose merge makes each token; itself twice for a byte."""
        self.left = np.arange(self.size, dtype=np.int64)
        self.right = np.arange(self.size, dtype=np.int64)
        keys, made = [], []
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self.merge(token, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
                    keys.append(parts[0] * self.size + parts[1])
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_key, self.pair_rank = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]

    def _grow_trie(self) -> None:
        child: dict[int, int] = {}
        ids = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for b in token:
                key = node * 256 + b
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(ids)
                    ids.append(-1)
            ids[node] = rank
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.trie_key, self.trie_node = keys[order], np.fromiter(child.values(), np.int64, len(child))[order]
        self.node_token = np.array(ids, dtype=np.int32)
        # the first two steps, which every byte of a text takes, by tables
        self.first_node = np.array([child[b] for b in range(256)], dtype=np.int64)
        self.second_node = np.full(1 << 16, -1, dtype=np.int64)
        for b, node in enumerate(self.first_node.tolist()):
            for c in range(256):
                self.second_node[b << 8 | c] = child.get(node * 256 + c, -1)

    def _forget(self, room: int = 0) -> None:
        # a hash table, at most half full: the hashes of pieces and their slots, -1 where there is none
        size = 1 << (2 * max(REMEMBERED, room)).bit_length()
        self.piece, self.slot = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where in the table each key stands, or would."""
        mask = len(self.slot) - 1
        place = (keys & np.uint64(mask)).astype(np.int64)
        live = np.arange(len(keys))
        while len(live):
            here = place[live]
            live = live[(self.slot[here] >= 0) & (self.piece[here] != keys[live])]
            place[live] = (place[live] + 1) & mask
        return place

    def _remember(self, keys: np.ndarray, slots: np.ndarray) -> None:
        while len(keys):  # of new keys that meet at a place one gets it
            place = self._places(keys)
            self.slot[place], self.piece[place] = slots, keys
            lost = self.slot[place] != slots
            self.piece[place[~lost]] = keys[~lost]
            keys, slots = keys[lost], slots[lost]

    def merge(self, piece: bytes, below: int = _NO_LIMIT) -> list[int]:
        """The BPE encoding of one piece, by merges of ranks under `below`, lowest rank and leftmost first."""
        ranks = self.ranks
        if len(piece) < 100:
            parts = [piece[k : k + 1] for k in range(len(piece))]
            while len(parts) > 1:
                best, where = below, -1
                for k in range(len(parts) - 1):
                    rank = ranks.get(parts[k] + parts[k + 1], _NO_LIMIT)
                    if rank < best:
                        best, where = rank, k
                if where < 0:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            return [ranks[p] for p in parts]
        end = list(range(1, len(piece) + 1))  # of the part that begins here; 0 once it is merged away
        before = list(range(-1, len(piece) - 1))
        heap = [(r, k, k + 2) for k in range(len(piece) - 1) if (r := ranks.get(piece[k : k + 2], _NO_LIMIT)) < below]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            middle = end[k]
            if not middle or middle >= len(piece) or end[middle] != stop:
                continue
            end[k], end[middle] = stop, 0
            if stop < len(piece):
                before[stop] = k
                if (r := ranks.get(piece[k : end[stop]], _NO_LIMIT)) < below:
                    heapq.heappush(heap, (r, k, end[stop]))
            if before[k] >= 0 and (r := ranks.get(piece[before[k] : stop], _NO_LIMIT)) < below:
                heapq.heappush(heap, (r, before[k], stop))
        found, k = [], 0
        while k < len(piece):
            found.append(ranks[piece[k : end[k]]])
            k = end[k]
        return found

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or a number beyond all ids."""
        key = a * self.size + b
        pos = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[pos] == key, self.pair_rank[pos], _NO_LIMIT)

    def merge_all(self, data: np.ndarray, start: np.ndarray, width: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, counts): exact merging of pieces of at most `width` bytes, each step for all of them at once."""
        n = len(start)
        column = np.arange(width)
        inside = column < length[:, None]
        ids = np.where(inside, self.byte_id[data[np.minimum(start[:, None] + column, len(data) - 1)]], -1).astype(np.int64)
        rank = np.full((n, width), _NO_LIMIT)
        both = inside[:, 1:]
        rank[:, :-1][both] = self.merged(ids[:, :-1][both], ids[:, 1:][both])
        after = np.tile(column + 1, (n, 1))
        before = np.tile(column - 1, (n, 1))
        live = np.arange(n)
        while len(live):
            at = rank[live].argmin(axis=1)
            best = rank[live, at]
            more = best < _NO_LIMIT
            live, at, best = live[more], at[more], best[more]
            if not len(live):
                break
            gone = after[live, at]
            next_ = after[live, gone]
            ids[live, at], ids[live, gone] = best, -1
            rank[live, gone] = rank[live, at] = _NO_LIMIT
            after[live, at] = next_
            right = np.flatnonzero(next_ < length[live])
            before[live[right], next_[right]] = at[right]
            rank[live[right], at[right]] = self.merged(best[right], ids[live[right], next_[right]])
            left = np.flatnonzero(at > 0)
            where = before[live[left], at[left]]
            rank[live[left], where] = self.merged(ids[live[left], where], best[left])
        kept = ids >= 0
        return ids[kept].astype(np.int32), kept.sum(axis=1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of tokens apart."""
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NO_LIMIT)
        while len(live):
            bad = self.merged(a, b) < limit
            good[live[bad]] = False
            inner_a, inner_b = self.right[a], self.left[b]
            undo_a = ((a > b) & (inner_a != a)) | ((a <= b) & (inner_b == b))
            done = bad | ((inner_a == a) & (inner_b == b))
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, inner_a, a), np.where(undo_a, b, inner_b)
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return good

    def longest(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, length) of the longest token at each byte that ends by stop."""
        n = len(data)
        best, size = self.byte_id[data], np.ones(n, dtype=np.int64)
        live = np.arange(n)
        node = self.first_node[data]
        depth = 1
        while len(live):
            fits = live + depth < stop[live]
            live, node = live[fits], node[fits]
            if not len(live):
                break
            if depth == 1:
                node = self.second_node[data[live].astype(np.int64) << 8 | data[live + 1]]
                hit = node >= 0
                live, node = live[hit], node[hit]
            else:
                key = node * 256 + data[live + depth]
                pos = np.minimum(np.searchsorted(self.trie_key, key), len(self.trie_key) - 1)
                hit = self.trie_key[pos] == key
                live, node = live[hit], self.trie_node[pos[hit]]
            depth += 1
            token = self.node_token[node]
            real = token >= 0
            best[live[real]], size[live[real]] = token[real], depth
        return best, size

    def speculate(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, id) of the greedy proposal for each piece, in order."""
        length = end - start
        first = np.concatenate([[0], np.cumsum(length)])
        own = data[np.repeat(start - first[:-1], length) + np.arange(first[-1])]
        best, size = self.longest(own, np.repeat(first[1:], length))
        live, pos, which, ids = np.arange(len(start)), first[:-1].copy(), [], []
        while len(live):
            which.append(live)
            ids.append(best[pos])
            pos = pos + size[pos]
            more = pos < first[live + 1]
            live, pos = live[more], pos[more]
        which, ids = np.concatenate(which), np.concatenate(ids)
        order = np.argsort(which, kind="stable")
        return which[order], ids[order]

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, position, count) of the encoding of each piece."""
        which, ids = self.speculate(data, start, end)
        inside = np.flatnonzero(which[1:] == which[:-1])
        failed = np.zeros(len(start), dtype=bool)
        failed[which[inside[~self.compatible(ids[inside], ids[inside + 1])]]] = True
        count = np.bincount(which, minlength=len(start))
        at = np.concatenate([[0], np.cumsum(count)[:-1]])
        flat, total, done, length = [ids], len(ids), 0, end - start
        for width in (8, 16, 32, 64):
            these = np.flatnonzero(failed & (length > done) & (length <= width))
            if len(these):
                exact, size = self.merge_all(data, start[these], width, length[these])
                at[these], count[these] = total + np.cumsum(size) - size, size
                flat.append(exact)
                total += len(exact)
            done = width
        for k in np.flatnonzero(failed & (length > done)):
            exact = np.array(self.merge(data[start[k] : end[k]].tobytes()), dtype=np.int32)
            at[k], count[k] = total, len(exact)
            flat.append(exact)
            total += len(exact)
        return np.concatenate(flat), at, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids)."""
        start, end = pieces(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        hashes = span_hashes(data, start, end)
        order = np.argsort(hashes)  # any piece stands for its hash, so this needn't be stable as in np.unique
        new = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])
        first = order[new]
        inverse = np.empty(len(order), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        keys = hashes[first]
        slot = self.slot[self._places(keys)].astype(np.int64)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            if len(self.at) + len(fresh) > REMEMBERED:
                self._forget(len(keys))
                fresh = np.arange(len(keys))
            flat, at, count = self.encode_pieces(data, start[first[fresh]], end[first[fresh]])
            slot[fresh] = np.arange(len(self.at), len(self.at) + len(fresh))
            self._remember(keys[fresh], slot[fresh])
            self.at = np.concatenate([self.at, at + len(self.flat)])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, flat])
        mine = slot[inverse]
        size = self.count[mine]
        begin = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.at[mine] - begin[:-1], size) + np.arange(begin[-1])]
        if not np.array_equal(self.decode(ids)[0], data):  # pieces of equal hashes: encode each by itself
            flat, at, size = self.encode_pieces(data, start, end)
            begin = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.repeat(at - begin[:-1], size) + np.arange(begin[-1])]
        return ids, np.diff(begin[np.searchsorted(start, offsets)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, number of each id's bytes)."""
        size = self.length[ids]
        begin = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.begin[ids] - begin[:-1], size) + np.arange(begin[-1])], size


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_column(column: pa.Array, path: str, check: bool = False) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(n_tokens, tokens, whether decoding gives the text again) of a string column."""
    known = vocabulary(path)
    data, offsets = text_bytes(column)
    all_ids, counts, same = [], [], []
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        ids, count = known.encode(part, at)
        all_ids.append(ids)
        counts.append(count)
        if check:
            back, size = known.decode(ids)
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
            good = np.ones(hi - lo, dtype=bool)
            if not (np.array_equal(ends, at) and np.array_equal(back, part)):
                good = np.array([np.array_equal(back[ends[k] : ends[k + 1]], part[at[k] : at[k + 1]]) for k in range(hi - lo)])
            same.append(good)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    values = pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), pa.int32())
    null = column.is_null() if column.null_count else None
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values, mask=null)
    return pa.array(count.astype(np.int32)), lists, pa.array(np.concatenate(same) if same else np.zeros(0, bool))


def _one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def encode(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text", check: bool = False) -> DataFrame:
    """`docs` with n_tokens and tokens in place of the text; with `check` also round_trip."""
    made = ["n_tokens", "tokens"] + ["round_trip"] * check
    rest = [f for f in docs.schema if f.name != text_col and f.name not in made]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    if check:
        schema = schema.add("round_trip", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tokens, same = encode_column(_one_array(batch.column(len(rest))), path, check)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(rest))), n, tokens, *([same] * check)], schema.fieldNames())

    return docs.select(*(docs[f.name].alias(f"_{k}") for k, f in enumerate(rest)), docs[text_col].cast("string").alias("_text")).mapInArrow(lean(run), schema)


def decode(table: DataFrame, path: str = VOCABULARY, tokens_col: str = "tokens", text_col: str = "text") -> DataFrame:
    """`table` with the text in place of the tokens."""
    rest = [f for f in table.schema if f.name not in (tokens_col, text_col)]
    schema = T.StructType([*rest, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            lists = _one_array(batch.column(len(rest)))
            texts: list[str | None] = []
            for one in lists:
                if not one.is_valid:
                    texts.append(None)
                    continue
                ids = np.asarray(one.values.fill_null(-1) if one.values.null_count else one.values, dtype=np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= known.size):
                    texts.append(b"".join(known.tokens[i] if 0 <= i < known.size else "�".encode() for i in ids).decode("utf-8", "replace"))
                else:
                    texts.append(known.decode(ids)[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(rest))), pa.array(texts, pa.string())], schema.fieldNames())

    return table.select(*(table[f.name].alias(f"_{k}") for k, f in enumerate(rest)), table[tokens_col].alias("_tokens")).mapInArrow(run, schema)
