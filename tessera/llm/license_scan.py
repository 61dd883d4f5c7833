"""License scans by ordered signature rules.

The rules (`license_rules.RULES`) are expressions written by hand, each gated
by keywords. One pass of a keyword automaton over a text in lower case tells
which expressions can match at all; only those run, over the whole text. Most
texts meet no gate and cost that one pass.

Detections are put in order by priority of the rule's kind, then length, then
place in the rule table. In that order each is taken unless its interval lies
within that of one already taken, or the other way round. Detections that
overlap without one containing the other stand side by side. Of two with the
same interval the first in the order stays.

Defined results: null and empty texts have no detections; repeated rows and
equal or null ids are scanned row by row; an empty table gives an empty table;
texts of any length are scanned whole; further columns are ignored. Intervals
count code points, from 0, with exclusive end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.license_rules import PRIORITIES, RULES


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    kind: str
    gates: tuple[frozenset[str], ...]
    expression: re.Pattern

    @property
    def priority(self) -> int:
        return PRIORITIES[self.kind]


def parse_rules(text: str) -> list[Rule]:
    found = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            name, kind, keywords, expression = (part.strip() for part in line.split(" ~ ", 3))
            gates = tuple(frozenset(k.lower().split("+")) for k in keywords.split(","))
            # a blank in front of a quantifier keeps it: "x ?y" is optional white space
            source = re.sub(r" (?=[?*+])", r"(?:\\s+)", expression)
            source = re.sub(r" ", r"\\s+", source)
            found.append(Rule(len(found), name, kind, gates, re.compile(source, re.IGNORECASE)))
    return found


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    return tuple(parse_rules(RULES))


@lru_cache(maxsize=1)
def _automaton():
    made = ahocorasick.Automaton()
    for rule in rules():
        for gate in rule.gates:
            for word in gate:
                made.add_word(word, word)
    made.make_automaton()
    return made


def _folded(text: str) -> str:
    """The text in lower case, with the further letters that expressions take for i and s when they ignore case."""
    low = text.lower()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that stand, by place."""
    taken: list[tuple[int, int, Rule]] = []  # none contains another, so starts and ends both rise
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[2].number, d[0])):
        at = bisect_left(taken, start, key=lambda d: d[0])
        same = at < len(taken) and taken[at][0] == start
        within = at > 0 and taken[at - 1][1] >= end
        around = at < len(taken) and taken[at][1] <= end
        if not (same or within or around):
            taken.insert(at, (start, end, rule))
    return taken


def scan_text(text: str) -> list[tuple[int, int, Rule]]:
    present = {word for _, word in _automaton().iter(_folded(text))}
    if not present:
        return []
    found = []
    for rule in rules():
        if any(gate <= present for gate in rule.gates):
            found += [(m.start(), m.end(), rule) for m in rule.expression.finditer(text) if m.end() > m.start()]
    return resolve(found) if found else []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, kind, rule (its number), start, end and matched of each detection that stands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    for start, end, rule in scan_text(text):
                        where.append(k)
                        rows.append((rule.license, rule.kind, rule.number, start, end, text[start:end]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), *(pa.array(c) for c in zip(*rows))], ["doc_id", "license", "kind", "rule", "start", "end", "matched"])

    out = f"doc_id {kind}, license string, kind string, rule bigint, start bigint, end bigint, matched string"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, out)
