"""From token shares to highlighted text, and from character boxes to rectangles.

Whole batches of texts are handled at once, as arrays over their characters,
spans and pieces. Spans are UTF-8 byte offsets in explanations and characters
of the batch in here; the pieces of a text join to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import by_slices
from tessera.functions.embedder import Embedder, _utf8_size, classify, code_points
from tessera.functions.text import sentence_byte_starts
from tessera.operators.explain import Shares, query_vector, shares_of

SEGMENTS = "array<struct<text:string,weight:double,score:double,keyword:boolean>>"
BIAS_LIMIT = 1e-3
RUN_BASE, RUN_MISS = 0.7, -0.5
QUIET = 0.3
#: Points of a matrix of texts by spans that are searched for runs at once.
POINTS_AT_ONCE = 1_000_000


@dataclass(frozen=True)
class Options:
    granularity: str = "word"
    scale: str = "relative"
    absolute_scale: float = 0.05
    max_highlights: int = 2
    min_run: int = 5
    short_penalty: float = 0.4
    max_run: int = 15
    long_penalty: float = 0.2
    window_words: int = 10


@dataclass
class Spans:
    """Spans of a batch in order: text, first and end character (of all texts laid end to end), share, number of tokens."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray
    count: np.ndarray


class Batch:
    """Texts laid end to end, by characters and bytes."""

    def __init__(self, texts: list[str]):
        self.texts, self.whole = texts, "".join(texts)
        self.chars = code_points(self.whole)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.bytes = np.concatenate([[0], np.cumsum(_utf8_size(self.chars))])

    def char_of(self, doc: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The character at a byte offset of a text."""
        return np.searchsorted(self.bytes, self.bytes[self.at[doc]] + offset)

    def islands(self) -> np.ndarray:
        """Of each character, how many runs without white space have begun in the batch; texts are apart."""
        space = classify(self.chars, str.isspace)
        fresh = ~space & np.concatenate([[True], space[:-1]])
        begins = self.at[:-1][self.at[:-1] < len(self.chars)]
        fresh[begins] = ~space[begins]
        return np.cumsum(fresh)


def sentence_starts(data: bytes) -> list[int]:
    """Byte offsets at which sentences begin."""
    found = sentence_byte_starts(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    return [0, *found.tolist()] if data else []


def aggregate_spans(batch: Batch, shares: Shares, granularity: str = "word") -> Spans:
    """Token shares summed up by token, word or sentence. Words without white space between them are one."""
    real = ~shares.special & (shares.end > shares.start)
    doc = shares.doc[real]
    start, end, score = batch.char_of(doc, shares.start[real]), batch.char_of(doc, shares.end[real]), shares.score[real]
    order = np.lexsort((start, doc))
    doc, start, end, score = doc[order], start[order], end[order], score[order]
    if not len(doc):
        return Spans(doc, start, end, score, doc)
    if granularity == "token":
        return Spans(doc, start, end, score, np.ones(len(doc), dtype=np.int64))
    if granularity == "sentence":
        data = np.frombuffer(batch.whole.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        key = np.searchsorted(np.searchsorted(batch.bytes, sentence_byte_starts(data, batch.bytes[batch.at])), start, side="right")
    else:
        key = batch.islands()[start]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    size = np.diff(np.concatenate([first, [len(doc)]]))
    return Spans(doc[first], start[first], np.maximum.reduceat(end, first), np.add.reduceat(score, first), size)


def severities(spans: Spans, bias: np.ndarray, options: Options) -> np.ndarray:
    """How strongly each span stands out in its text, from 0 to 1."""
    n = len(bias)
    tokens, total = np.bincount(spans.doc, spans.count, minlength=n), np.bincount(spans.doc, spans.score, minlength=n)
    baseline = np.where((tokens > 0) & (np.abs(bias) < BIAS_LIMIT), total / np.maximum(tokens, 1), 0.0)
    colour = spans.score - spans.count * baseline[spans.doc]
    colour = np.where(colour > 1e-12, colour, 0.0)  # less is rounding
    norm = np.full(n, options.absolute_scale)
    if options.scale != "absolute":
        norm = np.zeros(n)
        np.maximum.at(norm, spans.doc, colour)
    norm = norm[spans.doc]
    return np.where(norm > 0, np.minimum(colour / np.where(norm > 0, norm, 1.0), 1.0), 0.0)


def best_runs(points: np.ndarray, size: np.ndarray, cap: int, min_len: int, short_penalty: float, max_len: int, long_penalty: float) -> np.ndarray:
    """Of each row of points (the first `size` of it) up to `cap` disjoint runs of greatest adjusted sum: [pass, row, (first, last)], -1 for none.

    Rows are scanned side by side. A scan's running sum restarts where it is
    no more positive or meets a run that is taken. A run of n points loses
    short_penalty for each point under min_len, and long_penalty times
    1 + 2 + ... for those beyond max_len.
    """
    rows, width = points.shape
    place = np.arange(width)
    free = place[None, :] < size[:, None]
    found = np.full((cap, rows, 2), -1, dtype=np.int64)
    for each in range(cap):
        total, begin, best = np.zeros(rows), np.zeros(rows, dtype=np.int64), np.zeros(rows)
        for k in range(width):
            here, value = free[:, k], points[:, k]
            fresh = total <= 0
            begin = np.where(here, np.where(fresh, k, begin), k + 1)
            total = np.where(here, np.where(fresh, value, total + value), 0.0)
            n = k - begin + 1
            over = np.maximum(n - max_len, 0)
            adjusted = total - short_penalty * np.maximum(min_len - n, 0) - long_penalty * over * (over + 1) / 2
            better = here & (adjusted > best)
            best = np.where(better, adjusted, best)
            found[each, better, 0], found[each, better, 1] = begin[better], k
        hit = found[each, :, 0] >= 0
        if not hit.any():
            break
        free &= ~(hit[:, None] & (place >= found[each, :, :1]) & (place <= found[each, :, 1:]))
    return found


def best_windows(points: np.ndarray, size: np.ndarray, width: int, cap: int) -> np.ndarray:
    """The same for windows of `width` points (or of a whole shorter row) of greatest positive sum; of equal ones the first."""
    rows, most = points.shape
    found = np.full((cap, rows, 2), -1, dtype=np.int64)
    if width < 1 or not most:
        return found
    own = np.minimum(width, size)
    sums = np.concatenate([np.zeros((rows, 1)), np.cumsum(points, axis=1)], axis=1)
    place = np.arange(most)
    last = np.minimum(place[None, :] + own[:, None], most)
    gain = np.round(np.take_along_axis(sums, last, axis=1) - sums[:, :most], 12)
    gain[(place[None, :] + own[:, None] > size[:, None]) | (own[:, None] == 0)] = 0.0
    for each in range(cap):
        k = gain.argmax(axis=1)
        hit = gain[np.arange(rows), k] > 0
        if not hit.any():
            break
        found[each, hit, 0], found[each, hit, 1] = k[hit], (k + own - 1)[hit]
        near = (place[None, :] > (k - own)[:, None]) & (place[None, :] < (k + own)[:, None])
        gain[hit[:, None] & near] = 0.0
    return found


def top_runs(points: list[float], cap: int, min_len: int, short_penalty: float, max_len: int, long_penalty: float) -> list[tuple[int, int]]:
    """best_runs of one row, in order."""
    if not points:
        return []
    found = best_runs(np.array([points], dtype=float), np.array([len(points)]), cap, min_len, short_penalty, max_len, long_penalty)[:, 0]
    return sorted((int(a), int(b)) for a, b in found if a >= 0)


def select_windows(weights: list[float], width: int, cap: int) -> list[tuple[int, int]]:
    """best_windows of one row, in order."""
    if not weights:
        return []
    found = best_windows(np.array([weights], dtype=float), np.array([len(weights)]), width, cap)[:, 0]
    return sorted((int(a), int(b)) for a, b in found if a >= 0)


def _runs(spans: Spans, severity: np.ndarray, n: int, options: Options, windows: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last span (of the batch) of each run."""
    size = np.bincount(spans.doc, minlength=n)
    first = np.cumsum(size) - size
    points = severity if windows else np.where(severity > 0, RUN_BASE + severity, RUN_MISS)
    out: list[np.ndarray] = []
    by_size = np.argsort(size, kind="stable")  # rows of a matrix are of similar length
    by_size = by_size[size[by_size] > 0]
    lo = 0
    while lo < len(by_size):
        hi = lo + 1
        while hi < len(by_size) and size[by_size[hi]] * (hi + 1 - lo) <= POINTS_AT_ONCE and size[by_size[hi]] <= 2 * size[by_size[lo]] + 16:
            hi += 1
        some = by_size[lo:hi]
        matrix = np.zeros((len(some), int(size[some[-1]])))
        row = np.repeat(np.arange(len(some)), size[some])
        place = np.arange(len(row)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        matrix[row, place] = points[np.repeat(first[some], size[some]) + place]
        found = best_windows(matrix, size[some], options.window_words, options.max_highlights) if windows else best_runs(matrix, size[some], options.max_highlights, options.min_run, options.short_penalty, options.max_run, options.long_penalty)
        out.append((found + np.where(found >= 0, first[some][None, :, None], 0)).reshape(-1, 2))
        lo = hi
    runs = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
    runs = runs[runs[:, 0] >= 0]
    runs = runs[np.argsort(runs[:, 0])]
    return runs[:, 0], runs[:, 1]


def keyword_pattern(literals: list[str]) -> re.Pattern | None:
    tokens = [t for x in literals for t in x.split() if len(t) >= 3]
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, tokens)) + r")\w*", re.IGNORECASE) if tokens else None


@dataclass
class Pieces:
    """The texts of a batch in pieces: ends in characters, weight, share (nan for none), whether a keyword; and each text's number of pieces."""

    start: np.ndarray
    end: np.ndarray
    weight: np.ndarray
    score: np.ndarray
    keyword: np.ndarray
    count: np.ndarray


def pieces_of(batch: Batch, shares: Shares, options: Options, literals: list[str], windows: bool = False) -> Pieces:
    """The best runs of words marked strongly, other words by how much they stand out, and words that begin with a literal's token as keywords.

    The outer characters of a marked block that are neither letters nor digits
    are plain. A keyword is one piece, whatever blocks it touches; it has the
    marks of its first character.
    """
    n = len(batch.texts)
    spans = aggregate_spans(batch, shares, options.granularity)
    severity = severities(spans, shares.bias, options)
    first, last = _runs(spans, severity, n, options, windows)
    # blocks: runs, and single spans outside of them
    inside = np.zeros(len(spans.doc) + 1, dtype=np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    single = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    positive = np.concatenate([[0.0], np.cumsum(severity)])
    how_many = np.concatenate([[0], np.cumsum(severity > 0)])
    sums = np.concatenate([[0.0], np.cumsum(spans.score)])
    a, b = np.concatenate([first, single]), np.concatenate([last, single])
    strong = np.arange(len(a)) < len(first)
    some = how_many[b + 1] - how_many[a]
    weight = np.where(strong, (positive[b + 1] - positive[a]) / np.maximum(some, 1), severity[a] * QUIET) if len(a) else np.zeros(0)
    weight = np.where(strong & (some == 0), 0.0, np.minimum(weight, 1.0))
    share = sums[b + 1] - sums[a] if len(a) else np.zeros(0)
    start, end = (spans.start[a], spans.end[b]) if len(a) else (a, b)
    # characters that are letters or digits: the first and last of each block
    solid = np.flatnonzero(classify(batch.chars, str.isalnum))
    lo = np.searchsorted(solid, start)
    hi = np.searchsorted(solid, end) - 1
    marked = lo <= hi
    inner, outer = (solid[lo[marked]], solid[hi[marked]] + 1) if len(solid) else (start[:0], end[:0])
    cuts = np.concatenate([batch.at, start, end, inner, outer])
    flag = np.zeros(len(batch.chars) + 1, dtype=bool)
    flag[cuts] = True
    pattern = keyword_pattern(literals)
    matches = np.zeros((0, 2), dtype=np.int64)
    if pattern is not None:
        apart = "\n".join(batch.texts)  # no keyword goes on into the next text
        found = np.array([m.span() for m in pattern.finditer(apart)], dtype=np.int64).reshape(-1, 2)
        text = np.searchsorted(batch.at[1:] + np.arange(1, n + 1), found[:, 0], side="right")
        matches = found - text[:, None]
        covered = np.zeros(len(flag) + 1, dtype=np.int64)
        np.add.at(covered, matches[:, 0] + 1, 1)
        np.add.at(covered, matches[:, 1], -1)
        flag[np.cumsum(covered[:-1]) > 0] = False
        flag[matches.ravel()] = True
    flag[batch.at] = True
    cut = np.flatnonzero(flag)
    begin, stop = cut[:-1], cut[1:]
    out_weight, out_share = np.zeros(len(begin)), np.full(len(begin), np.nan)
    if len(inner):
        order = np.argsort(inner)
        at = np.searchsorted(inner[order], begin, side="right") - 1
        within = (at >= 0) & (begin < outer[order][np.maximum(at, 0)])
        which = np.flatnonzero(marked)[order][np.maximum(at, 0)]
        out_weight, out_share = np.where(within, weight[which], 0.0), np.where(within, share[which], np.nan)
    keyword = np.isin(begin, matches[:, 0])
    return Pieces(begin, stop, out_weight, out_share, keyword, np.diff(np.searchsorted(begin, batch.at)))


def as_arrow(batch: Batch, pieces: Pieces) -> pa.ListArray:
    data = batch.whole.encode("utf-8", "surrogatepass")
    offsets = np.concatenate([batch.bytes[pieces.start], batch.bytes[-1:]]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(pieces.start), pa.py_buffer(offsets), pa.py_buffer(data))
    fields = [text, pa.array(pieces.weight), pa.array(pieces.score, mask=np.isnan(pieces.score)), pa.array(pieces.keyword)]
    edges = np.concatenate([[0], np.cumsum(pieces.count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, ["text", "weight", "score", "keyword"]))


def segments_of(text: str, explanation: dict, options: Options = Options(), literals: list[str] | None = None, windows: bool = False) -> list[dict]:
    """The pieces of one text, from its explanation."""
    tokens = explanation["tokens"]
    column = lambda name, kind: np.array([t[name] if t[name] is not None else -1 for t in tokens], dtype=kind)
    shares = Shares(np.zeros(len(tokens), np.int64), column("start", np.int64), column("end", np.int64), column("word_id", np.int64), column("score", float), column("special", bool), np.array([explanation["bias"]]))
    batch = Batch([text])
    return as_arrow(batch, pieces_of(batch, shares, options, literals or [], windows)).to_pylist()[0]


def highlight(hits: DataFrame, literals: list[str], options: Options = Options(), text_col: str = "text", windows: bool = False) -> DataFrame:
    """Hits with an `explanation`, and their highlighted segments."""

    @F.arrow_udf(SEGMENTS)
    def run(texts: pa.Array, explanations: pa.Array) -> pa.Array:
        return by_slices(texts, lambda lo, hi: part(texts.slice(lo, hi - lo), explanations.slice(lo, hi - lo)))

    def part(texts: pa.Array, explanations: pa.Array) -> pa.Array:
        tokens = explanations.field("tokens")
        size = np.asarray(tokens.value_lengths().fill_null(0), dtype=np.int64)
        flat = tokens.flatten()
        field = lambda name, fill: np.asarray(flat.field(name).fill_null(fill))
        shares = Shares(np.repeat(np.arange(len(size)), size), field("start", 0).astype(np.int64), field("end", 0).astype(np.int64), field("word_id", -1).astype(np.int64), field("score", 0.0), field("special", False), np.asarray(explanations.field("bias").fill_null(0.0)))
        batch = Batch([t or "" for t in texts.to_pylist()])
        return as_arrow(batch, pieces_of(batch, shares, options, literals, windows))

    return hits.withColumn("segments", run(F.col(text_col), F.col("explanation")))


def explained_segments(texts: pa.Array, query: np.ndarray, embedder: Embedder, literals: list[str], options: Options = Options(), windows: bool = False) -> pa.Array:
    """The segments of a batch of texts, a slice at a time."""

    def part(lo: int, hi: int) -> pa.Array:
        batch = Batch([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
        return as_arrow(batch, pieces_of(batch, shares_of(batch.texts, query, embedder), options, literals, windows))

    return by_slices(texts, part)


def explained_highlight(hits: DataFrame, raw: str, embedder: Embedder, literals: list[str], options: Options = Options(), text_col: str = "text", windows: bool = False) -> DataFrame:
    """Hits with the segments that explain() and highlight() give, without the explanation leaving the worker in between."""
    query = query_vector(raw, embedder)

    @F.arrow_udf(SEGMENTS)
    def run(texts: pa.Array) -> pa.Array:
        return explained_segments(texts, query, embedder, literals, options, windows)

    return hits.withColumn("segments", run(F.col(text_col)))


def word_scores(tokens: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """Token rows (doc, text, start, end, score in characters) rolled up to words: islands without white space between."""
    order = Window.partitionBy(doc_col).orderBy("start", "end")
    gap = F.substring(F.col(text_col), F.lag("end").over(order) + 1, F.col("start") - F.lag("end").over(order))
    fresh = F.when(F.lag("end").over(order).isNull() | gap.rlike(r"(?U)\s"), 1).otherwise(0)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tokens.withColumn("fresh", fresh).withColumn("word", island).groupBy(doc_col, "word").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("tokens"))


BOX = "struct<left:double,bottom:double,right:double,top:double>"


def merge_boxes(boxes: Column) -> Column:
    """Character boxes as one rectangle a line: a box that shares no height with the running one begins the next."""
    real = F.filter(boxes, lambda b: (b["right"] > b["left"]) & (b["top"] > b["bottom"]))

    def add(lines: Column, b: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        joins = (F.size(lines) > 0) & (b["bottom"] < last["top"]) & (b["top"] > last["bottom"])
        wider = F.struct(F.least(last["left"], b["left"]).alias("left"), F.least(last["bottom"], b["bottom"]).alias("bottom"), F.greatest(last["right"], b["right"]).alias("right"), F.greatest(last["top"], b["top"]).alias("top"))
        fresh = F.struct(*(b[c].alias(c) for c in ("left", "bottom", "right", "top")))
        return F.when(joins, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(wider))).otherwise(F.concat(lines, F.array(fresh)))

    return F.aggregate(real, F.expr(f"cast(array() as array<{BOX}>)"), add)


def highlight_rects(boxes: Column, start: Column, length: Column) -> Column:
    """Rectangles of a range of characters, cut to those the page has."""
    n = F.size(boxes)
    first = F.least(F.greatest(start, F.lit(0)), n)
    count = F.greatest(F.least(start + length, n) - first, F.lit(0))
    return merge_boxes(F.slice(boxes, first + 1, count))


def to_pixels(rects: Column, page_width: Column, page_height: Column, width: Column, height: Column) -> Column:
    """Rectangles in points from the bottom left as x, y, w, h in pixels from the top left."""
    return F.transform(
        rects,
        lambda r: F.struct(
            (r["left"] / page_width * width).alias("x"),
            ((page_height - r["top"]) / page_height * height).alias("y"),
            ((r["right"] - r["left"]) / page_width * width).alias("w"),
            ((r["top"] - r["bottom"]) / page_height * height).alias("h"),
        ),
    )


def colour(weight: Column) -> Column:
    """Tint of a weight; none for none."""
    return F.when(weight > 0, F.concat(F.lit("rgba(250, 204, 21, "), F.round(weight, 3).cast("string"), F.lit(")"))).otherwise(F.lit("transparent"))
