"""Fixtures of the query language, chunkers, files, catalogue, explanation and highlighting."""

import shutil
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import batches, embedder
from tessera.functions import text as tx
from tessera.functions.embedder import HashEmbedder, PieceEmbedder
from tessera.functions.query import WeightedTerm, normalize_weights, parse_query
from tessera.operators import ann, chunking, explain, highlight, keyword_index, lexical, search, vectors
from tessera.operators import catalog as cat
from tessera.plans import registry
from tessera.sources import files as src
from tessera.streaming import ingest


@pytest.mark.parametrize(
    "raw, terms, literals",
    [
        ("dog", [("dog", 1)], []),
        ('"dog"', [], ["dog"]),
        ("good “dog”", [("good", 1)], ["dog"]),
        ('"dog" "cat"', [], ["dog", "cat"]),
        ("dog - cat", [("dog", 1), ("cat", -1)], []),
        ("dog is cool - cat", [("dog is cool", 1), ("cat", -1)], []),
        ("dog +1.2 cat", [("dog", 1), ("cat", 1.2)], []),
        ("+3 dogs are nice -2 cats are mean", [("dogs are nice", 3), ("cats are mean", -2)], []),
        ('happy +2 playful "puppy"', [("happy", 1), ("playful", 2)], ["puppy"]),
        ("   ", [], []),
        ("state-of-the-art", [("state", 1), ("of", -1), ("the", -1), ("art", -1)], []),
        ("1.2.3 foo", [("foo", 1)], []),
        ("3", [], []),
        ("+ 2 cats", [("2 cats", 1)], []),
        ("--x", [("x", -1)], []),
        ('a"x"b', [("ab", 1)], ["x"]),
        ('open "quote', [("open", 1)], ["quote"]),
    ],
)
def test_query_language(raw, terms, literals):
    parsed = parse_query(raw)
    assert [(t.text, t.weight) for t in parsed.semantic] == terms and parsed.literals == literals


def test_weights():
    assert [t.weight for t in normalize_weights([WeightedTerm("a", 1), WeightedTerm("b", 1)])] == [0.618034 / 2] * 2
    assert [t.weight for t in normalize_weights([WeightedTerm("a", 1), WeightedTerm("b", -1), WeightedTerm("c", 0)])] == [0.618034, -0.381966, 0]
    with pytest.raises(ValueError):
        parse_query("+" + "9" * 400 + " x")


def test_word_prefixes(spark):
    cases = [("the greenhouse effect", "green", True), ("an evergreen forest", "green", False), ("a house of cards", "use", False), ("we use it", "use", True), ("The GREENHOUSE", "green", True), ("greenery", "GREEN", True), ("new yorker magazine", "new york", True), ("new jersey", "new york", False), ("anything at all", "go", True), ("google it", "goo", True), ("a house", "goo", False), ("c++ x_use", "use", False), ("été froid", "été", True)]
    for text, literal, wanted in cases:
        assert spark.range(1).select(tx.matches_literal(F.lit(text), literal).alias("m")).first().m is wanted, (text, literal)


def _windows(spark, text, size, overlap):
    return [tuple(r) for r in spark.range(1).select(F.inline(chunking.word_windows(F.lit(text), size, overlap))).orderBy("k").collect()]


def test_word_windows(spark):
    assert [w[1] for w in _windows(spark, "one two three four five", 2, 0)] == ["one two", "three four", "five"]
    assert _windows(spark, "a b c d e", 3, 1) == [(0, "a b c", 0, 5), (1, "c d e", 4, 9)]
    text = "café\tnaïve\n\n  Σigma"
    found = _windows(spark, text, 2, 0)
    assert [w[1] for w in found] == ["café\tnaïve", "Σigma"] and all(text[a:b] == t for _, t, a, b in found)
    assert _windows(spark, "   \n\t ", 50, 10) == [] and _windows(spark, "", 50, 10) == []
    assert len(_windows(spark, "a b c d e f g", 3, 9)) == 5
    chunking.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM word_window_chunks('a b c d e', 3, 1) ORDER BY k").collect()] == _windows(spark, "a b c d e", 3, 1)


def test_csv_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'city,note\nParis,"a, b\nc"\nTokyo,\nOslo,x,extra\n')
    (tmp_path / "n.txt").write_bytes(b"it\x92s")
    (tmp_path / "empty.csv").write_bytes(b"\n")
    (tmp_path / "p.bin").write_bytes(b"%PDF-1.4 rest")
    files = src.read_files(spark, str(tmp_path)).cache()
    assert {r.basename: r.filetype for r in files.collect()} == {"t.csv": "csv", "n.txt": "text", "empty.csv": "csv", "p.bin": "pdf"}
    got = [(r.text, r.page, r.col, r.base_offset) for r in src.segments(files.where("filetype != 'pdf'"), with_pdf=False).orderBy("filetype", "base_offset").collect()]
    assert got == [("city: Paris", 0, 0, 0), ("note: a, b\nc", 0, 1, 12), ("city: Tokyo", 1, 0, 25), ("city: Oslo", 2, 0, 37), ("note: x", 2, 1, 48), ("Column 3: extra", 2, 2, 56), ("it’s", None, None, 0)]
    assert [r.text for r in src.pdf_pages(files, lambda content: ["one", ""]).orderBy("page").collect()] == ["one", ""]
    with pytest.raises(RuntimeError):
        src.pdf_pages(files)
    sha = files.where("basename = 't.csv'").first().sha512
    assert src.document_text(files, sha).first().text.startswith("city: Paris\nnote: a, b\nc\ncity: Tokyo")
    assert src.document_text(files, "none").isEmpty()
    copies = "file://" + str(tmp_path / "copies")
    assert src.copy_by_content(files, copies).count() == 4 and src.remove_copies(spark, copies, [sha]) == 1


def test_search_modes(spark):
    rows = spark.createDataFrame([(k, f"f{k % 2}", t) for k, t in enumerate(["the greenhouse effect", "an evergreen forest", "green green house", "new yorker magazine", "a house of cards"])], "id bigint, sha512 string, text string")
    embed = HashEmbedder(64)
    data = spark.createDataFrame([(r.id, r.sha512, r.text, embed.embed([r.text])[0].tolist()) for r in rows.collect()], "id bigint, sha512 string, text string, vector array<double>")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(search.hybrid_search(data, "greenhouse effect", embed, limit=1, prefix="")) == [0]
    assert sorted(ids(search.hybrid_search(data, 'house "green"', embed, prefix=""))) == [0, 2]
    assert ids(search.hybrid_search(data, '"green"', embed)) == [2, 0]
    assert ids(search.hybrid_search(data, '"zzz" house', embed)) == [] and ids(search.hybrid_search(data, "", embed)) == []
    assert len(ids(search.hybrid_search(data, '"go" house', embed))) == 5
    members = spark.createDataFrame([("f1",)], "sha512 string")
    assert sorted(ids(search.hybrid_search(data, "house", embed, members=members))) == [1, 3]
    assert ids(search.hybrid_search(data, "house", embed, members=members.limit(0))) == []
    assert ids(search.hybrid_search(data, "", embed, [search.Preference("new yorker magazine", 1.0)], limit=1, prefix="")) == [3]
    with pytest.raises(ValueError):
        search.hybrid_search(data, "x", embed, mode="fuzzy")
    assert ids(lexical.substring_search(data, ["gr"], 5)) == [] and ids(lexical.substring_search(data, ["new", "york"], 5)) == [3]


def test_ann_finds_the_needle_and_most_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 2000)] + 0.3 * rng.normal(size=(2000, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id bigint, vector array<double>")
    index = ann.build(rows)
    assert not ann.needs_build(255, None) and ann.needs_build(256, None) and not ann.needs_build(300, 256) and ann.needs_build(320, 256)
    hits = total = 0
    for k in (0, 500, 999):
        exact = {r.id for r in vectors.top_k(rows, points[k].tolist(), 10).collect()}
        found = [r.id for r in ann.search(index, points[k].tolist(), 10, spark).collect()]
        assert found[0] == k
        hits, total = hits + len(exact & set(found)), total + 10
    assert hits / total >= 0.9


def test_ann_recall_on_the_real_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    index = ann.build(rows)
    held = spark.read.parquet(index.path).orderBy("id").toPandas()
    unit = np.array(held["vector"].tolist(), dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cell, ids, hits = held["cell"].to_numpy(), held["id"].to_numpy(), 0
    for k in range(0, 2000, 5):
        order = np.argsort(-(unit @ unit[k]), kind="stable")[1:11]
        near = np.argsort(-(index.centres @ unit[k]), kind="stable")[: index.probes]
        hits += np.isin(cell[order], near).sum()
    print("probes", index.probes, "of", len(index.centres), "recall", hits / 4000)
    assert hits >= 0.9 * 4000
    exact = [r.id for r in vectors.top_k(rows, unit[7].tolist(), 10).collect()]
    assert len(set(exact) & {r.id for r in ann.search(index, unit[7].tolist(), 10, spark).collect()}) >= 8 and exact[0] == ids[7]


def test_ann_of_many_queries_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    index = ann.build(rows)
    asked = rows.where("id % 50 = 0")
    exact = {(r.id, r.other) for r in vectors.nearest_of_all(rows, 10).where("id % 50 = 0").collect()}
    found = ann.search_many(index, asked, 10).collect()
    assert len(exact) == 400 and len({(r.query, r.id) for r in found} & exact) >= 0.9 * 400 and len(found) == 400
    one = found[0].query
    vector = [float(x) for x in rows.where(F.col("id") == one).first().vector]
    mine = [r.id for r in ann.search(index, vector, 11, spark).collect()]
    assert mine[0] == one and mine[1:] == [r.id for r in sorted(found, key=lambda r: r.rank) if r.query == one]
    gone = spark.createDataFrame([(mine[1],)], "id bigint")
    assert mine[1] not in {r.id for r in ann.search(index, vector, 11, spark, deleted=gone).collect()}
    whole = ann.search_many(index, asked, 10, probes=len(index.centres)).collect()
    assert {(r.query, r.id) for r in whole} == exact


def test_all_pairs_shuffle_in_proportion(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vecs = np.round(rng.normal(size=(60, 4)))
    vecs[::7] = vecs[0]  # ties
    for kind, name in (("bigint", int), ("string", str)):
        rows = spark.createDataFrame([(name(k), v.tolist()) for k, v in enumerate(vecs)], f"id {kind}, vector array<float>").repartition(3)
        found = vectors.nearest_of_all(rows, 3)
        unit = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
        d = np.maximum(np.round(1 - unit @ unit.T, 9), 0)
        want = {(name(a), r + 1, b) for a in range(60) for r, (_, b) in enumerate(sorted((d[a, b], name(b)) for b in range(60) if b != a)[:3])}
        assert {(r.id, r["rank"], r.other) for r in found.collect()} == want
        assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString() and "Generate" not in found._jdf.queryExecution().toString()
    asked = vectors._Asked(pa.array(range(60)), unit, 3)  # block by block, with few pairs waiting
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 13)
    monkeypatch.setattr(vectors, "WAITING", 20)
    for lo in range(0, 60, 13):
        asked.meet(pa.array(range(lo, min(lo + 13, 60))), unit[lo : lo + 13])
    got = asked.result(pa.int64()).to_pydict()
    assert set(zip(got["a"], got["rank"], got["b"])) == {(a, r + 1, b) for a in range(60) for r, (_, b) in enumerate(sorted((d[a, b], b) for b in range(60) if b != a)[:3])}


def test_keyword_index_gives_what_a_scan_gives(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(["Green TEA and greenery", "tea", "te", "", None, "éàü green tea", "aaaa aaaa", "grüne Tee 漢字漢字", "ea te", "a🎉🎉🎉b green"])] + [(None, "green tea")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    known = df.where("id is not null and text is not null")
    index = keyword_index.build(df.repartition(3), "file://" + str(tmp_path / "index"))
    for tokens in (["green"], ["green", "tea"], ["aaa"], ["漢字漢"], ["🎉🎉🎉"], ["nothing"], ["xy"]):
        want = [(r.id, r.score) for r in lexical.substring_search(known, tokens, 5).collect()]
        assert [(r.id, r.score) for r in keyword_index.substring_search(spark, index, tokens, 5).collect()] == want, tokens
    for literal in ("gree tea", "ree", "te"):
        one, two = keyword_index.literal_candidates(index, known, literal), lexical.literal_candidates(known, literal, None)
        assert (one is None) == (two is None) and (one is None or {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()})
    plan = keyword_index._postings(spark, index, ["gre"])[0]._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert keyword_index.substring_search(spark, keyword_index.build(df.limit(0), "file://" + str(tmp_path / "none")), ["green"], 5).count() == 0


def test_grams_are_counted_by_slices(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abé漢🎉 "), n)) for n in (0, 1, 2, 3, 7, 40, 41, 500)]
    monkeypatch.setattr(keyword_index, "SLICE_BYTES", 20)
    code = lambda g: int(keyword_index.gram_codes(embedder.code_points(g))[0])
    want = [Counter(code(t[k : k + 3]) for k in range(len(t) - 2)) for t in texts]
    for some, limit in ((texts, 1 << 63), (texts, 0), (texts[:2], 0), *(([t], 0) for t in texts)):
        monkeypatch.setattr(keyword_index, "KEY_LIMIT", limit)
        gram, row, tf, size = keyword_index.counted_grams(some)
        assert size.tolist() == [len(t) for t in some] and (np.diff(row) >= 0).all()
        got = [dict(zip(gram[row == k].tolist(), tf[row == k].tolist())) for k in range(len(some))]
        assert got == [want[texts.index(t)] for t in some] and len(gram) == sum(map(len, got))


def test_kernels_take_slices_of_a_batch(monkeypatch):
    texts = pa.array([f"Tea {k}. Green tea! {'x ' * (k % 50)}" for k in range(300)] + [None, "", "long. " * 2000])
    seen = []
    embed = HashEmbedder(16)
    tokens = embed.tokens
    embed.tokens = lambda some: (seen.append(sum(map(len, some))), tokens(some))[1]
    query = explain.query_vector("green tea", embed)
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else round(x, 9) + 0.0 if isinstance(x, float) else x
    run = lambda: plain([explain.explained(texts, query, embed).to_pylist(), highlight.explained_segments(texts, query, embed, ["tea"]).to_pylist(), tx.sentence_offsets(texts).to_pylist()])
    whole = run()
    monkeypatch.setattr(batches.slices, "__defaults__", (1000,))
    seen.clear()
    assert run() == whole and sorted(seen)[-2:] == [12_000] * 2 and max(n for n in seen if n < 12_000) <= 1000 and len(seen) > 30


def test_catalogue(spark, tmp_path):
    c = cat.Catalog(spark, "file://" + str(tmp_path / "cat"))
    c.commit(db_meta=cat.set_meta(c.table("db_meta"), "a", "1"))
    c.commit(db_meta=cat.set_meta(cat.set_meta(c.table("db_meta"), "a", "2"), "b", "3"))
    assert {tuple(r) for r in c.table("db_meta").collect()} == {("a", "2"), ("b", "3")}
    c.compact("db_meta", 1)
    assert c.table("db_meta").count() == 2 and len(list((tmp_path / "cat" / "db_meta").iterdir())) == 1
    p = cat.ensure_project(cat.ensure_project(c.table("projects"), "p", "P", 1), "p", "Q", 2)
    assert [tuple(r) for r in p.collect()] == [("p", "P", 1)]
    job = spark.createDataFrame([("p", "s", "/a", "/b", "a", "txt", 5)], "project_id string, sha512 string, source_path string, copied_path string, basename string, ext string, added_at bigint")
    jobs = cat.enqueue(c.table("index_jobs"), job)
    failed = cat.set_job_status(jobs, "p", "s", cat.ERROR, "bad")
    assert cat.enqueue(failed, job).first().status == "error" and cat.next_pending_job(failed).isEmpty()
    assert cat.retry_failed(failed).first().status == "pending" and cat.delete_job(jobs, "p", "s").isEmpty()
    assert cat.max_id(c.table("chunks")).first().max_id == -1


def test_ingest_is_incremental_and_survives_bad_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one two three " * 40)
    (folder / "b.txt").write_text("one two three " * 40)
    (folder / "c.csv").write_text("h,k\n1,2\n")
    (folder / "d.pdf").write_bytes(b"%PDF-1.4")
    (folder / "e.txt").write_text(" \n")
    c = cat.Catalog(spark, "file://" + str(tmp_path / "cat"))
    indexer = ingest.Indexer(c, HashEmbedder(8), "p")
    indexer.open()
    run = lambda: ingest.stream(spark, "file://" + str(folder), "file://" + str(tmp_path / "cp"), indexer).awaitTermination()
    run()
    assert c.table("files").count() == 3 and c.table("project_files").count() == 3
    assert [(r.status, r.basename) for r in c.table("index_jobs").collect()] == [("error", "d.pdf")]
    before = {r.id for r in c.table("chunks").collect()}
    assert before == set(range(5))
    (folder / "f.txt").write_text("something new")
    run()
    assert {r.id for r in c.table("chunks").collect()} == before | {5}
    indexer.maintain()
    assert c.table("chunks").count() == 6
    other = ingest.Indexer(c, HashEmbedder(8), "p", model="next")
    texts = lambda: sorted((r.sha512, r.text, r.char_start) for r in c.table("chunks").collect())
    whole = texts()
    assert other.open() == 4 and c.table("chunks").isEmpty() and c.table("files").isEmpty()
    run_other = lambda: ingest.stream(spark, "file://" + str(folder), "file://" + str(tmp_path / "cp"), other).awaitTermination()
    run_other()  # the queue brings back what the stream has seen already
    assert texts() == whole and c.table("files").count() == 4 and {r.pipeline_version for r in c.table("files").collect()} == {other.version}
    assert [r.status for r in c.table("index_jobs").collect()] == ["error"] and min(r.id for r in c.table("chunks").collect()) == 6
    third = ingest.Indexer(c, HashEmbedder(8), "p", model="third")
    assert third.open() == 4
    (folder / "f.txt").unlink()
    (folder / "c.csv").write_text("changed\n")
    assert third.drain(2) == 4
    assert sorted((r.basename, r.status, r.error) for r in c.table("index_jobs").collect()) == [("c.csv", "error", "the file is gone or has changed"), ("d.pdf", "error", "no reader for PDF files"), ("f.txt", "error", "the file is gone or has changed")]
    assert c.table("files").count() == 2


def test_ingest_compacts_in_proportion(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.txt").write_text(f"one text {k}")
    monkeypatch.setattr(ingest, "MAINTAIN_ROWS", 1)
    c, rewritten = cat.Catalog(spark, "file://" + str(tmp_path / "cat")), []
    compact = c.compact
    c.compact = lambda name, files: (rewritten.append(c.table(name).count()), compact(name, files))
    costs = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(k) for k in costs]
    indexer = ingest.Indexer(c, HashEmbedder(8), "p")
    indexer.open()
    ingest.stream(spark, "file://" + str(folder), "file://" + str(tmp_path / "cp"), indexer, max_files=1).awaitTermination()
    assert rewritten == [1, 2, 4] and c.table("files").count() == 4
    assert sorted(r.id for r in c.table("chunks").where("size(vector) = 8").collect()) == [0, 1, 2, 3]
    for _ in range(50):
        if [spark.conf.get(k) for k in costs] == before:
            break
        time.sleep(0.1)
    assert [spark.conf.get(k) for k in costs] == before


def test_ingest_with_a_reader_copies_and_deletes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, raw in (("a.txt", b"one two three"), ("b.pdf", b"%PDF-bad"), ("c.pdf", b"%PDF-good")):
        (folder / name).write_bytes(raw)

    def reader(content):
        if content.endswith(b"bad"):
            raise ValueError("broken")
        return ["page one", "page two"]

    c = cat.Catalog(spark, "file://" + str(tmp_path / "cat"))
    indexer = ingest.Indexer(c, HashEmbedder(8), "p", reader=reader, copies="file://" + str(tmp_path / "copies"))
    indexer.open()
    ingest.stream(spark, "file://" + str(folder), "file://" + str(tmp_path / "cp"), indexer).awaitTermination()
    assert sorted(r.text for r in c.table("chunks").collect()) == ["one two three", "page one", "page two"]
    assert [(r.basename, r.error) for r in c.table("index_jobs").collect()] == [("b.pdf", "ValueError: broken")]
    files = {r.basename: r for r in c.table("files").collect()}
    assert sorted(files) == ["a.txt", "c.pdf"] and files["c.pdf"].page_count == 2 and (tmp_path / "copies" / (files["a.txt"].sha512 + ".txt")).read_bytes() == b"one two three"
    shutil.rmtree(folder)  # the copies are enough
    again = ingest.Indexer(c, HashEmbedder(8), "p", model="next", reader=reader, copies=indexer.copies)
    assert again.open() == 2 and again.drain() == 2 and c.table("chunks").count() == 3 and c.table("project_files").count() == 2
    again.delete_file("p", files["a.txt"].sha512)
    assert c.table("chunks").count() == 2 and c.table("files").count() == 1 and not (tmp_path / "copies" / (files["a.txt"].sha512 + ".txt")).exists()
    read = src.read_files(spark, str(tmp_path / "copies"))
    assert bytes(src.pdf_bytes(read, files["c.pdf"].sha512).first().content) == b"%PDF-good" and src.csv_data(read, files["c.pdf"].sha512).count() == 0
    again.delete_project("p")
    assert all(c.table(t).isEmpty() for t in ("projects", "files", "project_files", "index_jobs", "chunks")) and not any(p.suffix == ".pdf" for p in (tmp_path / "copies").iterdir())


def test_texts_of_other_encodings():
    for text, names in (("これは日本語の文章です。かなと漢字。", ("shift_jis", "euc_jp")), ("这是一个中文句子,用来测试编码。", ("gb18030",)), ("이것은 한국어 문장입니다", ("euc_kr",)), ("Это предложение на русском языке.", ("cp1251", "koi8_r")), ("Crème brûlée, naïve façade – “déjà vu”", ("cp1252",)), ("Grüße aus Köln, schöne Straße", ("latin-1",)), ("日本", ("utf-16",))):
        for name in names:
            assert src.guess_text(text.encode(name)) == text, (text, name)


def test_explanation_adds_up(spark):
    embed = HashEmbedder(128)
    texts = ["the naïve café has green tea", "", "tea tea tea"]
    rows = explain.explain(spark.createDataFrame([(t,) for t in texts], "text string"), "green tea", embed).collect()
    query = np.array(vectors.centroid(normalize_weights(parse_query("green tea").semantic), embed))
    for r in rows:
        shares = sum(t.score for t in r.explanation.tokens)
        assert abs(r.explanation.bias + shares - r.explanation.total) < 1e-9
        assert abs(r.explanation.total - float(embed.embed([r.text])[0] @ query)) < 1e-9
        assert all(r.text.encode()[t.start : t.end].decode().strip() for t in r.explanation.tokens)


def test_highlighting_in_one_step_equals_two(spark):
    embed = HashEmbedder(64)
    rows = spark.createDataFrame([(1, "the naïve café has green tea and more of it"), (2, ""), (3, None), (4, "tea")], "id bigint, text string")
    two = highlight.highlight(explain.explain(rows, "green tea", embed), ["caf"])
    one = highlight.explained_highlight(rows, "green tea", embed, ["caf"])
    shown = lambda df: {r.id: [(s.text, round(s.weight, 9), s.keyword) for s in r.segments] for r in df.select("id", "segments").collect()}
    assert shown(one) == shown(two) and shown(one)[3] == []


def _best_run(points, min_len, short, max_len, long):
    best, where = 0.0, None
    for a in range(len(points)):
        total = 0.0
        for b in range(a, len(points)):
            total += points[b]
            n = b - a + 1
            over = max(0, n - max_len)
            value = total - short * max(0, min_len - n) - long * over * (over + 1) / 2
            if value > best + 1e-12:
                best, where = value, (a, b)
    return where


def test_runs_and_windows():
    assert highlight.top_runs([-1, 2, 2, -5, 1], 2, 1, 0, 9, 0) == [(1, 2), (4, 4)]
    assert highlight.top_runs([1, 1, 1], 1, 1, 0, 9, 0) == [_best_run([1, 1, 1], 1, 0, 9, 0)]
    assert highlight.top_runs([-1, -1], 2, 1, 0, 9, 0) == [] and highlight.top_runs([], 2, 1, 0, 9, 0) == []
    assert highlight.select_windows([0, 3, 3, 0, 2, 2], 2, 2) == [(1, 2), (4, 5)]
    assert highlight.select_windows([1, 1, 1], 1, 1) == [(0, 0)] and highlight.select_windows([], 3, 2) == []


def test_segments_join_to_the_text():
    embed = HashEmbedder(64)
    text = "Über-naïve «café»: the green tea, and more green tea! Ünd so weiter… fin"
    query = np.array(embed.embed(["green tea"])[0])
    why = explain.explain_text(text, query, embed)
    found = highlight.segments_of(text, why)
    assert "".join(p["text"] for p in found) == text and any(p["weight"] > 0 for p in found)
    marked = highlight.segments_of(text, why, literals=["gree", "so"])
    assert "".join(p["text"] for p in marked) == text and [p["text"] for p in marked if p["keyword"]] == ["green", "green"]
    halves = {"tokens": [{"start": 0, "end": 2, "word_id": 0, "score": 1.0, "special": False}, {"start": 2, "end": 8, "word_id": 0, "score": 0.0, "special": False}], "bias": 0.5}
    assert [(p["text"], p["keyword"]) for p in highlight.segments_of("greenery", halves, highlight.Options(granularity="token"), ["green"])] == [("greenery", True)]
    assert highlight.segments_of("", {"tokens": [], "bias": 0.0}) == [] and [p["text"] for p in highlight.segments_of(" \n", {"tokens": [], "bias": 0.0})] == [" \n"]


def test_batches_are_highlighted_as_single_texts():
    rng = np.random.default_rng(4)
    words = ["tea", "green", "(green)", "kyoto,", "…", "“x”", "naïve", "漢字", "greenery"]
    texts = ["", " ", "green"] + [" ".join(rng.choice(words, rng.integers(0, 70))) + rng.choice(["", "\n", "! "]) for _ in range(60)]
    for embed in (HashEmbedder(16), PieceEmbedder(16)):
        query = np.array(embed.embed(["green tea kyoto"])[0])
        for windows in (False, True):
            for options in (highlight.Options(), highlight.Options(granularity="sentence", scale="absolute"), highlight.Options(granularity="token", max_highlights=3)):
                batch = highlight.Batch(texts)
                whole = highlight.as_arrow(batch, highlight.pieces_of(batch, explain.shares_of(texts, query, embed), options, ["gree"], windows)).to_pylist()
                for text, got in zip(texts, whole):
                    assert "".join(p["text"] for p in got) == text
                    want = highlight.segments_of(text, explain.explain_text(text, query, embed), options, ["gree"], windows)
                    assert [(p["text"], p["keyword"], round(p["weight"], 9)) for p in got] == [(p["text"], p["keyword"], round(p["weight"], 9)) for p in want]


def test_explanations_of_pieces_marks_and_bias_reproduce_the_cosine(spark):
    embed = PieceEmbedder(32)
    query = explain.query_vector("green tea", embed)
    texts = ["green tea in Kyoto", "", "naïve café", "x"]
    shares = explain.shares_of(texts, query, embed)
    vectors_ = embed.embed(texts)
    assert np.abs(shares.totals() - vectors_ @ query).max() < 1e-12 and np.abs(shares.bias[[0, 2, 3]]).min() > 1e-4 and shares.bias[1] == 0
    why = explain.explain_text(texts[0], query, embed)
    assert why["tokens"][0]["special"] and why["tokens"][0]["word_id"] is None and len(why["tokens"]) == 2 + 2 + 1 + 1 + 2
    rolled = highlight.aggregate_spans(highlight.Batch(texts[:1]), explain.shares_of(texts[:1], query, embed))
    assert rolled.count.tolist() == [2, 1, 1, 2] and [texts[0][a:b] for a, b in zip(rolled.start, rolled.end)] == texts[0].split()
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    rows = explain.explain(df, "green tea", embed).collect()
    assert {r.text: round(r.explanation.total, 9) for r in rows}["naïve café"] == round(float(vectors_[2] @ query), 9)
    shown = highlight.highlight(explain.explain(df, "green tea", embed), ["tea"]).collect()
    direct = highlight.explained_highlight(df, "green tea", embed, ["tea"]).collect()
    assert {r.text: [s.text for s in r.segments] for r in shown} == {r.text: [s.text for s in r.segments] for r in direct}


def test_sentences_agree(spark):
    for text in ["One. Two! Three", "a.b. c", "", "End. ", "What?! Yes... no", "é. ñ"]:
        here = spark.range(1).select(tx.sentence_starts(F.lit(text)).alias("s")).first().s
        assert [len(text[:k].encode()) for k in here] == (highlight.sentence_starts(text.encode()) or [0]), text
    rows = [(1, "One. Two!\r\nThree"), (2, None), (3, ""), (4, "x" * 1_000_000), (5, ". " * 3), (6, "a? b.\u00a0c"), (7, "a.b. " * 100_000)]
    found = {r.k: r.s for r in spark.createDataFrame(rows, "k int, t string").coalesce(1).select("k", tx.sentence_starts(F.col("t")).alias("s")).collect()}
    assert found[7] == list(range(0, 500_000, 5)) and {k: found[k] for k in range(1, 7)} == {1: [0, 5, 11], 2: None, 3: [0], 4: [0], 5: [0, 2, 4], 6: [0, 3]}


def test_boxes(spark):
    box = lambda left, bottom: Row(left=float(left), bottom=float(bottom), right=left + 5.0, top=bottom + 9.0)
    boxes = [box(0, 100), box(6, 101), Row(left=0.0, bottom=0.0, right=0.0, top=0.0), box(0, 80)]
    df = spark.createDataFrame([(boxes,)], f"b array<{highlight.BOX}>")
    got = [tuple(r) for r in df.select(F.inline(highlight.merge_boxes(F.col("b")))).collect()]
    assert got == [(0.0, 100.0, 11.0, 110.0), (0.0, 80.0, 5.0, 89.0)]
    assert df.select(F.size(highlight.highlight_rects(F.col("b"), F.lit(3), F.lit(99))).alias("n")).first().n == 1
    assert df.select(F.size(highlight.highlight_rects(F.col("b"), F.lit(9), F.lit(1))).alias("n")).first().n == 0


def test_labels(spark):
    shown = lambda n: spark.range(1).select(tx.format_bytes(F.lit(n)).alias("s")).first().s
    assert [shown(n) for n in (0, 1023, 1536, 20480, 5 * 1024**4)] == ["0 B", "1023 B", "1.5 KB", "20 KB", "5.0 TB"]
    name = lambda p: spark.range(1).select(tx.project_name(F.lit(p)).alias("s")).first().s
    assert [name(p) for p in ("/a/report.final.pdf", "/a/", "x")] == ["report.final", "New project", "x"]
    ext = lambda p: spark.range(1).select(tx.extension(F.lit(p)).alias("s")).first().s
    assert [ext(p) for p in ("/a/B.TXT", "/a/none", "/a/.hidden", "a.tar.gz")] == ["txt", "", "", "gz"]
    assert spark.range(1).select(tx.score_percent(F.lit(0.875)).alias("s")).first().s == "88%"


def test_sizes_of_long_texts(spark, tmp_path):
    rows = [(k, "é" * (n // 2) + "x" * (n % 2)) for k, n in enumerate((0, 5, 46_340, 46_341, 133_719, 2_000_001))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.ORACLE_SQL["sizes_and_labels"]).fetchall()
    found = registry.QUERIES["sizes_and_labels"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted(want) and {r.size for r in found} >= {"0 B", "2.0 GB", "17 GB", "3.6 TB"}


def test_centroids_that_cancel_out():
    embed = HashEmbedder(32)
    assert vectors.centroid([WeightedTerm("a", 1), WeightedTerm("a", -1)], embed) is None and vectors.centroid([], embed) is None
