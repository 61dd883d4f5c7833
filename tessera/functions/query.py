"""The search query language: weighted terms and quoted literals.

    happy +2 playful -0.5 sad "puppy"

Terms are what lies between signs; a number right after a sign is a weight.
Quoted parts are literals that filter. Weights are scaled so that positive
terms share one golden-ratio part and negative terms the other.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIVE_SHARE = 0.618034
NEGATIVE_SHARE = 0.381966
_QUOTES = str.maketrans("“”„‟‘’‚‛", '""""' + "''''")
_NUMBER = re.compile(r"\d+\.?\d*|\.\d+")
_SIGNED = re.compile(r"\s*([+-]?)([0-9.]*)\s*([^+-]*)")


@dataclass(frozen=True)
class WeightedTerm:
    text: str
    weight: float


@dataclass(frozen=True)
class ParsedQuery:
    semantic: list[WeightedTerm] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)


def normalize_quotes(text: str) -> str:
    return text.translate(_QUOTES)


def extract_literals(text: str) -> tuple[str, list[str]]:
    """The text without its quoted parts, and those, trimmed; a quote left open reaches to the end."""
    parts = text.split('"')
    return "".join(parts[::2]), [p.strip() for p in parts[1::2] if p.strip()]


def _weight(sign: str, digits: str) -> float:
    value = float(digits) if _NUMBER.fullmatch(digits) else 1.0
    if not math.isfinite(value):
        raise ValueError("a weight must be a finite number")
    return -abs(value) if sign == "-" else value


def parse_terms(text: str) -> list[WeightedTerm]:
    found, at = [], 0
    while at < len(text):
        part = _SIGNED.match(text, at)
        if part.end() == at:
            break
        sign, digits, words = part.groups()
        words = words.strip()
        if words:
            found.append(WeightedTerm(words, _weight(sign, digits)))
        at = part.end()
    return found


def parse_query(raw: str) -> ParsedQuery:
    rest, literals = extract_literals(normalize_quotes(raw))
    return ParsedQuery(parse_terms(rest), literals)


def normalize_weights(terms: list[WeightedTerm]) -> list[WeightedTerm]:
    """Each positive weight times the positive share over their number; likewise the negative ones."""
    pos, neg = sum(t.weight > 0 for t in terms), sum(t.weight < 0 for t in terms)
    scale = lambda w: w * POSITIVE_SHARE / pos if w > 0 else w * NEGATIVE_SHARE / neg if w < 0 else w
    return [WeightedTerm(t.text, scale(t.weight)) for t in terms]


SCHEMA = T.StructType(
    [
        T.StructField("semantic", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("weight", T.DoubleType())]))),
        T.StructField("literals", T.ArrayType(T.StringType())),
    ]
)


@F.udf(SCHEMA, useArrow=True)
def parse_query_column(raw):
    """parse_query for a column of queries; null and a weight that isn't finite give null."""
    try:
        parsed = parse_query(raw) if raw is not None else None
    except ValueError:
        parsed = None
    if parsed is None:
        return None
    return ([(t.text, t.weight) for t in parsed.semantic], parsed.literals)
