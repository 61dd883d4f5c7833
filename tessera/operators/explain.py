"""Why a hit scores as it does: the exact share of each token.

Texts are explained by batches, with arrays over all their tokens. A model of
the mean of its tokens' vectors, then perhaps a linear map and an offset (its
`dense`), has the score query . (dense(mean) + offset) / norm. That is a sum
over the tokens and the offset's part, which is the bias.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import by_slices
from tessera.functions.embedder import QUERY_PREFIX, Embedder
from tessera.functions.query import normalize_weights, parse_query
from tessera.operators.vectors import centroid

EXPLANATION = "struct<tokens:array<struct<start:int,end:int,word_id:int,score:double,special:boolean>>,bias:double,total:double>"


@dataclass
class Shares:
    """Tokens of a batch of texts in order: text, span in UTF-8 bytes, word, share and whether it is a mark of the model's own; bias of each text."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    score: np.ndarray
    special: np.ndarray
    bias: np.ndarray

    def totals(self) -> np.ndarray:
        return self.bias + np.bincount(self.doc, self.score, minlength=len(self.bias))


def shares_of(texts: list[str], query: np.ndarray, embedder: Embedder) -> Shares:
    """Token shares; bias + the sum of a text's shares is its cosine score."""
    tokens = embedder.tokens(texts)
    n = np.bincount(tokens.doc, minlength=len(texts))
    mean = embedder.pooled(tokens, len(texts))
    norm = np.linalg.norm(mean, axis=1)
    safe = np.where(norm > 0, norm, 1.0)
    own = embedder.scores(tokens, query) / (n * safe)[tokens.doc]
    bias = np.where(n > 0, embedder.offset_score(query) / safe, 0.0)
    return Shares(tokens.doc, tokens.start, tokens.end, tokens.word, np.where(norm[tokens.doc] > 0, own, 0.0), tokens.special, np.where(norm > 0, bias, 0.0))


def explain_text(text: str, query: np.ndarray, embedder: Embedder) -> dict:
    """The explanation of one text."""
    s = shares_of([text], query, embedder)
    tokens = [{"start": int(a), "end": int(b), "word_id": int(w) if w >= 0 else None, "score": float(x), "special": bool(m)} for a, b, w, x, m in zip(s.start, s.end, s.word, s.score, s.special)]
    return {"tokens": tokens, "bias": float(s.bias[0]), "total": float(s.totals()[0])}


def query_vector(raw: str, embedder: Embedder, prefix: str = QUERY_PREFIX, signed: bool = True) -> np.ndarray:
    """The vector that scores are explained against; zero where the terms cancel out."""
    terms = parse_query(raw).semantic
    if signed and terms:
        query = centroid(normalize_weights(terms), embedder, prefix)
    else:
        query = embedder.embed([prefix + (" ".join(t.text for t in terms) or raw)])[0].tolist()
    return np.zeros(embedder.dim) if query is None else np.array(query, dtype=float)


def as_arrow(s: Shares) -> pa.StructArray:
    """Explanations as Arrow structs."""
    edges = np.searchsorted(s.doc, np.arange(len(s.bias) + 1)).astype(np.int32)
    fields = [pa.array(s.start.astype(np.int32)), pa.array(s.end.astype(np.int32)), pa.array(s.word.astype(np.int32), mask=s.word < 0), pa.array(s.score), pa.array(s.special)]
    tokens = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, ["start", "end", "word_id", "score", "special"]))
    return pa.StructArray.from_arrays([tokens, pa.array(s.bias), pa.array(s.totals())], ["tokens", "bias", "total"])


def explained(texts: pa.Array, query: np.ndarray, embedder: Embedder) -> pa.Array:
    """The explanations of a batch of texts, a slice at a time."""
    return by_slices(texts, lambda lo, hi: as_arrow(shares_of([t or "" for t in texts.slice(lo, hi - lo).to_pylist()], query, embedder)))


def explain(hits: DataFrame, raw: str, embedder: Embedder, text_col: str = "text", prefix: str = QUERY_PREFIX, signed: bool = True) -> DataFrame:
    """`hits` with their explanation. Unsigned explains all terms as if they were wanted, joined by spaces."""
    vector = query_vector(raw, embedder, prefix, signed)

    @F.arrow_udf(EXPLANATION)
    def run(texts: pa.Array) -> pa.Array:
        return explained(texts, vector, embedder)

    return hits.withColumn("explanation", run(F.col(text_col)))
