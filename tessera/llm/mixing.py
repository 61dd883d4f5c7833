"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often it should stand in the mix. Among all
rates that meet the token constraints, those nearest to 1 in relative entropy
(over token mass) are taken:

* of the mix's tokens, each source has its target share;
* each language keeps its share of the corpus, up to a small ridge;
* so does the mean of log length per token, so that no source is met by its
  long documents alone. Where the targets of sources contradict these two,
  coefficients of at most `LANGUAGE_LIMIT` and `LENGTH_LIMIT` do what they can;
* the mix has `budget` tokens, by default as many as the corpus.

The solution is an exponential tilt, rate = exp(a[source] + b[lang] + c * z)
with z the standardised log length, at most 20 either way. Its coefficients minimise a convex dual by
Newton steps. For given b and c the source coefficients have a closed form,
a[s] = log(budget * target[s] / tilted tokens of s), so the dual is one of
languages and length alone, sum of target[s] * log(tilted tokens of s) less
the targets of b and c. A step takes one pass over the documents' sizes: sums
by (source, lang) for the current c, then value, gradient and Hessian added up
over sources by the executors. The driver sees only numbers of languages
(squared), never sources: there may be as many as documents.

Rates become whole copies by floor(rate) and one more with the chance of the
fraction, drawn from a hash of the id (of the text where the id is null), so
that the result doesn't depend on the layout of the data.

A token is a run of characters other than white space (Unicode), or one of the
BPE vocabulary (`bpe_path`), so that a mix that is encoded next meets its
targets in the tokens that count.

Defined results: null sources and languages are a source and a language of
their own; null, empty and blank texts have no tokens, no part in the
constraints, rate 1 and one copy; repeated rows have equal rates and copies;
given targets are taken in proportion to their sum over the sources present, sources without a target
get rate 0 and no copy; where no source has tokens,
all rates are 1; an empty table gives an empty table. Further columns pass
through `mix` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm import bpe
from tessera.llm.textarrays import give_back

#: Without given targets a source's share is its tokens to this power, in proportion.
POWER = 0.5
RIDGE = 1e-4
LANGUAGE_LIMIT, LENGTH_LIMIT, Z_LIMIT = 10.0, 5.0, 20.0
STEPS = 50
TOLERANCE = 1e-9
SEED = 20240817
#: The table of sources is broadcast up to this many bytes, and shuffled beyond them.
BROADCAST_BYTES = 32_000_000
#: Numbers that a task holds at once of its sources' shares by language.
BLOCK = 4_000_000


def tokens_of(text: Column) -> Column:
    words = F.size(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "))
    return F.when(text.isNull() | ~text.rlike(r"(?U)\S"), F.lit(0)).otherwise(words).cast("long")


def bpe_tokens_of(text: Column, path: str) -> Column:
    """The number of tokens of the vocabulary under `path`."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        found = bpe.encode_column(texts, path)[0].cast(pa.int64())
        give_back()
        return found

    return F.when(text.isNull() | ~text.rlike(r"(?U)\S"), F.lit(0).cast("bigint")).otherwise(count(text))


def _local(spark: SparkSession, schema: str, *columns: pa.Array) -> DataFrame:
    """A small table of the driver's; from rows instead of Arrow columns it would take Python workers of another kind, which stay."""
    return spark.createDataFrame(pa.table(list(columns), [c.split()[0] for c in schema.split(", ")]), schema)


@dataclass
class Tilt:
    """The dual's solution: rate = source's factor * exp(language's coefficient + slope * z)."""

    sources: DataFrame  # s, factor
    languages: dict[str | None, float]
    slope: float
    mean: float
    spread: float
    residual: float
    steps: int


def _z(mean: float, spread: float) -> Column:
    z = (F.log(F.col("tokens").cast("double")) - F.lit(mean)) / F.lit(spread)
    return F.greatest(F.lit(-Z_LIMIT), F.least(F.lit(Z_LIMIT), z))


def _moments(weighted: DataFrame, languages: DataFrame, b: np.ndarray, slope: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and Hessian, by languages and then length, of the sum over sources of target * log(tilted tokens)."""
    n = len(b)
    shift = float(b.max())
    factor = np.exp(b - shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, gradient, hessian = 0.0, np.zeros(n + 1), np.zeros((n + 1, n + 1))
        for batch in batches:
            lists = batch.column(1)
            flat, size = lists.flatten(), np.asarray(lists.value_lengths(), dtype=np.int64)
            if not len(flat):
                continue
            lang, m0, m1, m2 = (np.asarray(flat.field(k)) for k in range(4))
            source = np.repeat(np.arange(len(size)), size)
            whole = np.bincount(source, factor[lang] * m0)
            p, r1, r2 = (factor[lang] * m / whole[source] for m in (m0, m1, m2))
            w = np.asarray(batch.column(0))
            value += float(w @ (np.log(whole) + shift))
            mean = np.bincount(source, r1)
            gradient[:n] += np.bincount(lang, w[source] * p, minlength=n)
            gradient[n] += float(w @ mean)
            cross = np.bincount(lang, w[source] * (r1 - p * mean[source]), minlength=n)
            hessian[n, :n] += cross
            hessian[:n, n] += cross
            hessian[n, n] += float(w @ (np.bincount(source, r2) - mean**2))
            hessian[np.arange(n), np.arange(n)] += np.bincount(lang, w[source] * p, minlength=n)
            step = max(1, BLOCK // n)
            for lo in range(0, len(size), step):
                here = (source >= lo) & (source < lo + step)
                share = np.zeros((min(step, len(size) - lo), n))
                share[source[here] - lo, lang[here]] = p[here]
                hessian[:n, :n] -= (share * w[lo : lo + step, None]).T @ share
        every = np.concatenate([[value], gradient, hessian.ravel()])
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some])], ["pos", "x"])

    out = np.zeros(1 + (n + 1) + (n + 1) ** 2)
    for row in weighted.mapInArrow(run, "pos bigint, x double").groupBy("pos").agg(F.sum("x").alias("x")).collect():
        out[row.pos] = row.x
    return float(out[0]), out[1 : n + 2], out[n + 2 :].reshape(n + 1, n + 1)


def solve(sizes: DataFrame, targets: Mapping[str, float] | DataFrame | None = None, budget: float | None = None, power: float = POWER) -> Tilt | None:
    """The tilt for a table of source, lang, tokens; None if there are no tokens.

    targets: by source, as a mapping or as a table (source, target).
    """
    spark = sizes.sparkSession
    sizes = sizes.where("tokens > 0").select("source", "lang", "tokens")
    first = sizes.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.log("tokens")), F.sum(F.col("tokens") * F.log("tokens") ** 2)).first()
    if not first[0]:
        return None
    total = float(first[0])
    mean = first[1] / total
    spread = max(first[2] / total - mean**2, 0.0) ** 0.5
    spread = spread if spread > 1e-6 else 1.0
    wanted = sizes.groupBy("source").agg((F.sum("tokens").cast("double") ** power).alias("w"))
    if targets is not None:
        given = targets if isinstance(targets, DataFrame) else spark.createDataFrame([(s, float(t)) for s, t in targets.items()], "source string, target double")
        given = given.where("target > 0").select(F.col("source").alias("s"), F.col("target").cast("double").alias("w"))
        wanted = wanted.drop("w").join(given, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    share = wanted.agg(F.sum("w")).first()[0]
    if not share:
        return None
    wanted = scratch.materialise(wanted.select(F.col("source").alias("s"), (F.col("w") / F.lit(share)).alias("w")), "targets")
    chosen = sizes.join(wanted, F.col("source").eqNullSafe(F.col("s")), "left_semi")
    by_lang = {r.lang: float(r.t) for r in sizes.groupBy("lang").agg(F.sum("tokens").alias("t")).collect()}
    names = sorted((r.lang for r in chosen.select("lang").distinct().collect()), key=lambda s: (s is None, s or ""))
    n = len(names)
    languages = _local(spark, "l string, k int", pa.array(names, pa.string()), pa.array(range(n), pa.int32()))
    target = np.array([by_lang[x] / total for x in names] + [0.0])  # z has the mean 0 in the corpus

    def cells(slope: float) -> DataFrame:
        z = _z(mean, spread)
        mass = F.col("tokens") * F.exp(F.lit(slope) * z)
        found = sizes.groupBy("source", "lang").agg(F.sum(mass).alias("m0"), F.sum(mass * z).alias("m1"), F.sum(mass * z * z).alias("m2"))
        return found.join(F.broadcast(languages), F.col("lang").eqNullSafe(F.col("l"))).join(wanted, F.col("source").eqNullSafe(F.col("s")))

    def dual(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        weighted = cells(float(theta[-1])).groupBy("source").agg(F.first("w").alias("w"), F.collect_list(F.struct("k", "m0", "m1", "m2")).alias("cells")).select("w", "cells")
        value, gradient, hessian = _moments(weighted, languages, theta[:-1], float(theta[-1]))
        return value - float(theta @ target) + 0.5 * RIDGE * float(theta @ theta), gradient - target + RIDGE * theta, hessian + (RIDGE + 1e-12) * np.eye(n + 1)

    limit = np.array([LANGUAGE_LIMIT] * n + [LENGTH_LIMIT])
    theta, steps = np.zeros(n + 1), 0
    value, gradient, hessian = dual(theta)
    while steps < STEPS:
        free = (np.abs(theta) < limit) | (theta * gradient > 0)  # not held at a limit
        if not free.any() or np.abs(gradient[free]).max() <= TOLERANCE:
            break
        step = np.zeros(n + 1)
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        size = 1.0
        while True:
            new = np.clip(theta - size * step, -limit, limit)
            trial = dual(new)
            if trial[0] <= value + 1e-12 or size < 1e-6:
                break
            size /= 2
        theta, steps = new, steps + 1
        value, gradient, hessian = trial
    free = (np.abs(theta) < limit) | (theta * gradient > 0)
    b = _local(spark, "k int, b double", pa.array(range(n), pa.int32()), pa.array(theta[:-1]))
    tilted = cells(float(theta[-1])).join(F.broadcast(b), "k").groupBy("source").agg(F.first("w").alias("w"), F.sum(F.exp("b") * F.col("m0")).alias("m"))
    factors = scratch.materialise(tilted.select(F.col("source").alias("s"), (F.lit(total if budget is None else float(budget)) * F.col("w") / F.col("m")).alias("factor")), "factors")
    return Tilt(factors, {x: float(theta[k]) for k, x in enumerate(names)}, float(theta[-1]), mean, spread, float(np.abs(gradient[free]).max(initial=0.0)), steps)


def _with_copies(table: DataFrame, tilt: Tilt | None, key: Column) -> DataFrame:
    """`table` (source, lang, tokens) with rate and copies."""
    if tilt is None:
        return table.withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1).cast("long"))
    spark = table.sparkSession
    weight = tilt.sources.select(F.sum(F.coalesce(F.octet_length("s"), F.lit(0)) + 32)).first()[0]
    factors = F.broadcast(tilt.sources) if weight <= BROADCAST_BYTES else tilt.sources
    languages = _local(spark, "l string, b double", pa.array(list(tilt.languages), pa.string()), pa.array(list(tilt.languages.values()), pa.float64()))  # as many rows as languages
    joined = table.join(factors, F.col("s").eqNullSafe(F.col("source")), "left").join(F.broadcast(languages), F.col("l").eqNullSafe(F.col("lang")), "left")
    z = _z(tilt.mean, tilt.spread)
    rate = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.coalesce(F.col("factor") * F.exp(F.col("b") + F.lit(tilt.slope) * z), F.lit(0.0)))
    draw = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return joined.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")).drop("s", "l", "factor", "b")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, bpe_path: str | None) -> list[Column]:
    """source, lang, tokens and key of each document."""
    key = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("text:"), F.coalesce(docs[text_col], F.lit(""))))
    tokens = tokens_of(docs[text_col]) if bpe_path is None else bpe_tokens_of(docs[text_col], bpe_path)
    return [docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"), tokens.alias("tokens"), F.xxhash64(key).alias("key")]


def rates(docs: DataFrame, targets: Mapping[str, float] | DataFrame | None = None, budget: float | None = None, power: float = POWER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", bpe_path: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokens, rate (6 places) and copies of each document."""
    sized = docs.select(docs[id_col].alias("doc_id"), *_sized(docs, id_col, text_col, source_col, lang_col, bpe_path))
    sized = scratch.materialise(sized, "sizes")
    out = _with_copies(sized, solve(sized, targets, budget, power), F.col("key"))
    return out.select("doc_id", "source", "lang", "tokens", F.round("rate", 6).alias("rate"), "copies")


def mix(docs: DataFrame, targets: Mapping[str, float] | DataFrame | None = None, budget: float | None = None, power: float = POWER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", bpe_path: str | None = None) -> DataFrame:
    """The rows of `docs`, each as often as it has copies, with all their columns as they were."""
    # written once with its size, so that tokens are counted once; solving reads three columns of it
    table = docs.select(F.struct("*").alias("row"), *_sized(docs, id_col, text_col, source_col, lang_col, bpe_path))
    table = scratch.materialise(table, "sized")
    copied = _with_copies(table, solve(table, targets, budget, power), F.col("key")).where("copies > 0")
    # in two steps, so that no array is as long as the copies of a row are many
    block = F.lit(1000).cast("long")
    blocks = copied.select("row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))).alias("at"))
    return blocks.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(block, F.col("copies") - F.col("at") * block)))).select("row.*")
