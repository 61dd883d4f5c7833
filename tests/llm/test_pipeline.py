"""The pipeline's stages against brute force, and on awkward documents."""

import base64
import io
from collections import Counter

import pyarrow as pa
import tiktoken
from conftest import SMALL

import awkward
import corpus_pipeline
from tessera.llm import bpe, mixing, quality_classifier, quality_rules, textarrays
from test_operators import PATTERN, grams_of, slow_shares

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_by_rules(text):
    lines = [" ".join(x.split()) for x in (text or "").split("\n")]
    size = sum(len(x.replace(" ", "")) for x in lines)
    again = sum(len(x.replace(" ", "")) for k, x in enumerate(lines) if x and x in lines[:k])
    return again <= quality_rules.LINE_LIMIT * max(size, 1) and all(slow_shares(text, n) <= most for n, most in quality_rules.NGRAM_LIMITS.items())


def least_of_groups(texts):
    sets = {k: grams_of(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(k for k in texts if sets[k])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(k) for k in texts}


def test_stages_equal_brute_force(spark, tmp_path):
    raw = docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    classified, ruled, single, mixed, encoded = seen
    assert all(d.columns == COLUMNS for d in seen[:-1])
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    model = quality_classifier.learn(raw, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(texts(classified)) == {r.doc_id for r in quality_classifier.score(raw, model).where("keep").collect()}
    assert set(texts(ruled)) == {k for k, t in texts(classified).items() if kept_by_rules(t)}
    assert set(texts(single)) == least_of_groups(texts(ruled))
    copies = {r.doc_id: r.copies for r in mixing.rates(single, bpe_path=bpe.VOCABULARY).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})
    with open(bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    known = texts(mixed)
    assert all(r.tokens == exact.encode_ordinary(known[r.doc_id]) for r in encoded.collect())
    count = lambda d: Counter((r.doc_id, tuple(r.tokens)) for r in d.collect())
    assert count(corpus_pipeline.run(spark, SMALL)) == count(encoded)


def test_stages_take_awkward_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, None), (8, 1, 0), (7, 1, 0), (9, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for given in (awkward.docs(spark, extra=False), awkward.docs(spark), awkward.docs(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == given.columns and out.count() <= 3 * given.count()
        assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() == given.count()


def test_workers_hold_parts_and_give_memory_back(spark, monkeypatch):
    gave = []
    monkeypatch.setattr(textarrays, "give_back", lambda: gave.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000)), pa.array(["a text"] * 5_000)], ["id", "text"])
    parts = list(textarrays.lean(lambda batches: batches)(iter([batch, batch.slice(0, 0), batch])))
    assert [p.num_rows for p in parts] == [2_000, 2_000, 1_000] * 2 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch, batch])) and len(gave) == 4
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x" * 10_000_000])], ["id", "text"]))
    before = pa.total_allocated_bytes()
    received = next(iter(pa.ipc.open_stream(io.BytesIO(sink.getvalue().to_pybytes()))))
    ids = textarrays.own(received.column(0))
    del received
    assert ids.to_pylist() == [1] and pa.total_allocated_bytes() - before < 1_000_000
    # tables of the mix's own come without Python workers of another kind, which would stay
    plan = mixing._local(spark, "l string, b double", pa.array(["en", None]), pa.array([0.5, 1.0]))
    assert plan.collect() == [("en", 0.5), (None, 1.0)] and "ExistingRDD" not in plan._jdf.queryExecution().toString()
