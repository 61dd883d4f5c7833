"""Column functions over text: words, word prefixes, quotes, names, labels."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.batches import by_slices

SPACE = r"(?U)\s+"
#: Typographic double, then single quotes, and what they become.
_CURLY = "“”„‟‘’‚‛"
_PLAIN = '""""' + "''''"
_SENTENCE_SPACE, _SENTENCE_END = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SENTENCE_SPACE[[9, 10, 13, 32]] = True
_SENTENCE_END[[33, 46, 63]] = True
UNITS = ("B", "KB", "MB", "GB", "TB")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body uses it in inner functions."""
    return F.transform(F.array(value), body)[0]


def spaced_words(text: Column) -> Column:
    """Words with the white space in front of them, so that lengths of prefixes are offsets."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\s*\S+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1)))


def normalize_quotes(text: Column) -> Column:
    return F.translate(text, _CURLY, _PLAIN)


def literal_tokens(literal: str) -> list[str]:
    """Lower-case words of at least three characters; shorter ones are too common to filter by."""
    return [t for t in literal.lower().split() if len(t) >= 3]


def has_word_prefix(text: Column, token: str) -> Column:
    """Whether some word of the text begins with the token, in any case."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", token.lower())
    return F.lower(text).rlike(r"(?U)(?<![\p{L}\p{N}_])" + quoted)


def matches_literal(text: Column, literal: str) -> Column:
    """Whether every token of the literal begins some word; true of a literal without tokens."""
    found = F.lit(True)
    for token in literal_tokens(literal):
        found = found & F.lower(text).contains(token) & has_word_prefix(text, token)
    return found


def matches_all(text: Column, literals: list[str]) -> Column:
    found = F.lit(True)
    for literal in literals:
        found = found & matches_literal(text, literal)
    return found


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension without dot; empty where there is none. A leading dot makes no extension."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*\.([^.]*)$|^[^.]\.([^.]*)$", 1))


def project_name(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]+$", "")
    return F.when(stem == "", F.lit("New project")).otherwise(F.coalesce(stem, F.lit("New project")))


def score_percent(score: Column) -> Column:
    return F.concat(F.floor(score * 100 + F.lit(0.5)).cast("string"), F.lit("%"))


def format_bytes(size: Column) -> Column:
    """1023 -> 1023 B, 1536 -> 1.5 KB, 20480 -> 20 KB: one decimal under 10, none in bytes."""
    value = size.cast("double")
    power = F.least(F.lit(len(UNITS) - 1), F.floor(F.log2(F.greatest(value, F.lit(1.0))) / 10)).cast("int")
    scaled = value / F.pow(F.lit(1024.0), power)
    shown = F.when((power == 0) | (scaled >= 10), F.floor(scaled + 0.5).cast("string")).otherwise(F.format_string("%.1f", F.floor(scaled * 10 + 0.5) / 10))
    return F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), power + 1))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """"1 file", "2 files"."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_multiple(x: Column) -> Column:
    """Strength of a preference: not a number is 1, otherwise within 0.1 and 2."""
    return clamp(F.nanvl(F.coalesce(x, F.lit(1.0)), F.lit(1.0)), 0.1, 2.0)


def progress_fraction(done: Column, total: Column) -> Column:
    """Share done, at least 4 % so that a bar can be seen; 0 of 0 counts as nothing done."""
    return F.greatest(F.lit(0.04), F.when(total > 0, done / total).otherwise(F.lit(0.0)))


def staleness_key(query: Column, preferences: Column, n_documents: Column) -> Column:
    """Changes whenever a search would have to be run again."""
    return F.xxhash64(query, preferences, n_documents)


def sentence_byte_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which sentences of many texts begin, but for the first of each text.

    A sentence begins after a run of .!? and a run of spaces, tabs, line feeds
    or carriage returns, unless the text ends there.
    """
    space = _SENTENCE_SPACE[data]
    at = np.arange(len(data))
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = space[:-1] & ~space[1:]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = False
    begins = np.flatnonzero(begins)
    before = np.maximum.accumulate(np.where(space, -1, at))[begins - 1] if len(begins) else begins
    same = before >= offsets[np.searchsorted(offsets, begins, side="right") - 1]
    return begins[same & _SENTENCE_END[data[np.maximum(before, 0)]]]


def sentence_offsets(texts: pa.Array) -> pa.Array:
    """Of each text of a batch the characters at which sentences begin, a slice at a time."""

    def part(texts: pa.Array) -> pa.Array:
        whole = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64, count=len(whole) + 1, offset=8 * whole.offset)
        raw = np.frombuffer(whole.buffers()[2], dtype=np.uint8) if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
        data, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        found = sentence_byte_starts(data, offsets)
        row = np.searchsorted(offsets, found, side="right") - 1
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        count = 1 + np.bincount(row, minlength=len(texts))
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(ends[-1], dtype=np.int32)
        rest = np.ones(ends[-1], dtype=bool)
        rest[ends[:-1]] = False
        out[rest] = chars[found] - chars[offsets[row]]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=texts.is_null())

    return by_slices(texts, lambda lo, hi: part(texts.slice(lo, hi - lo)))


def sentence_starts(text: Column) -> Column:
    """0-based character offsets at which sentences begin; 0 for an empty text, null for a null one."""

    @F.arrow_udf("array<int>")
    def starts(texts: pa.Array) -> pa.Array:
        return sentence_offsets(texts)

    return starts(text)


def epoch_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def content_key(content: Column) -> Column:
    """Identity of a file: lower-case hex SHA-512 of its bytes."""
    return F.sha2(content, 512)


def pipeline_version(model: str, size: int, overlap: int) -> str:
    return f"v1:{model}:wordwindow:{size}-{overlap}"
