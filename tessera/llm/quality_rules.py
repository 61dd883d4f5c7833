"""Repetition coverage: how much of a text lies inside repeated n-grams and lines.

Words are split at ASCII whitespace, lines at line feeds; a line is known by
its sequence of words and blank lines don't count. Of a text's characters
(code points that aren't ASCII whitespace):

* ``dup_line``: share inside lines that also stand further up in the text;
* ``dup_n``: share inside words that some n-gram covers which also stands
  earlier in the text, counting a character once however many n-grams cover it.

The first copy counts as original, so a passage that is said twice counts once.

A document is kept if no share exceeds its limit.

Defined results: a null, empty or blank text has no characters, shares 0 and
is kept; a text of fewer than n + 1 words has dup_n 0; repeated rows and equal
ids are judged row by row; an empty table gives an empty table; further
columns, whatever their names, are left out of `measure` and passed through
untouched by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.textarrays import NOT_SPACE, Rolling, Words, char_counts, lean, mix, repeated, run_starts, slices, text_bytes

#: Limits published for filtering web text (MassiveText), on shares of characters.
LINE_LIMIT = 0.30
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

_DOC = np.uint64(0xD6E8FEB86659FD93)


def shares(column: pa.Array, ns: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Characters, share in repeated lines, and by n the share in repeated n-grams, of each text."""
    data, offsets = text_bytes(column)
    n_docs = len(offsets) - 1
    chars, line = np.zeros(n_docs, np.int64), np.zeros(n_docs)
    grams = {n: np.zeros(n_docs) for n in ns}
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        words = Words(part, at, NOT_SPACE)
        counts = char_counts(part)
        size = counts[words.end] - counts[words.start]
        total = np.bincount(words.doc, weights=size, minlength=hi - lo)
        chars[lo:hi] = total
        safe = np.maximum(total, 1)
        rolling = Rolling(words.hashes())
        salt = mix(words.doc.astype(np.uint64) * _DOC)

        feeds = np.concatenate([[0], np.cumsum(part == 10)])
        line_id = feeds[words.start] + words.doc  # differs across lines and across documents
        if len(words):
            first = np.flatnonzero(np.concatenate([[True], line_id[1:] != line_id[:-1]]))
            last = np.concatenate([first[1:], [len(words)]])
            _, hit = repeated(rolling.of(first, last) ^ salt[first])
            line[lo:hi] = np.bincount(words.doc, weights=size * np.repeat(hit, last - first), minlength=hi - lo) / safe

        found: np.ndarray | None = None
        previous = 0
        for n in sorted(ns):
            where = run_starts(words.doc, n)
            if found is not None and previous:
                # an n-gram that stands twice consists of shorter ones that do
                steps = n - previous
                where = where[np.logical_and.reduce([found[where + k] for k in range(steps + 1)])] if len(where) else where
            twice, later = repeated(rolling.of(where, where + n) ^ salt[where])
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            cover[where[later]] += 1
            cover[where[later] + n] -= 1
            grams[n][lo:hi] = np.bincount(words.doc, weights=size * (np.cumsum(cover)[:-1] > 0), minlength=hi - lo) / safe
            found, previous = np.zeros(len(words) + 1, dtype=bool), n
            found[where[twice]] = True
    return chars, line, grams


def _judged(line: np.ndarray, grams: dict[int, np.ndarray], line_limit: float, limits: dict[int, float]) -> np.ndarray:
    ok = line <= line_limit
    for n, most in limits.items():
        ok &= grams[n] <= most
    return ok


def measure(docs: DataFrame, line_limit: float = LINE_LIMIT, limits: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, chars, dup_line, dup_n of each n (rounded to 6 places) and keep."""
    limits = dict(limits or NGRAM_LIMITS)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, line, grams = shares(batch.column(1), tuple(limits))
            keep = _judged(line, grams, line_limit, limits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chars), pa.array(np.round(line, 6)), *(pa.array(np.round(grams[n], 6)) for n in limits), pa.array(keep)],
                ["doc_id", "chars", "dup_line", *(f"dup_{n}" for n in limits), "keep"],
            )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, chars bigint, dup_line double, {', '.join(f'dup_{n} double' for n in limits)}, keep boolean")


def keep(docs: DataFrame, line_limit: float = LINE_LIMIT, limits: dict[int, float] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with all their columns as they were."""
    limits = dict(limits or NGRAM_LIMITS)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, line, grams = shares(batch.column(at), tuple(limits))
            yield batch.filter(pa.array(_judged(line, grams, line_limit, limits)))

    return docs.mapInArrow(lean(run), docs.schema)
