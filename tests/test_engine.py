"""Operators on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veclattice import schema
from veclattice.errors import DimensionMismatch, EmptyEmbeddingSet, EmptyInput, EngineError, IndexNotFound, InvalidDocumentId, InvalidPredicate, ModelMismatch, PoolingError
from veclattice.functions import text as X
from veclattice.functions import vectors as V
from veclattice.operators import chunk, codec, encode, evaluate, metadata, mutate, pooling, predicate, score, search
from veclattice.operators import packed
from veclattice.operators.index import VectorIndex
from veclattice.operators.segments import SegmentIndex
from veclattice.plans import params
from veclattice.schema import IndexConfig, SearchParameters
from veclattice.sources import ingest
from veclattice.streaming import ingest as streaming


def one_hot(spark, axes, dim=16, tokens=4):
    rows = [(i, t, [1.0 if k == a else 0.0 for k in range(dim)]) for i, a in enumerate(axes) for t in range(tokens)]
    return spark.createDataFrame(rows, "doc_id long, token_pos int, v array<float>")


def ask(spark, axis, dim=16):
    return spark.createDataFrame([(0, 0, [1.0 if k == axis else 0.0 for k in range(dim)])], "query_id long, qtok int, v array<double>")


EVERYTHING = SearchParameters(n_full_scores=4096, n_ivf_probe=1024, top_k=3, centroid_score_threshold=None)


def best(index, axis):
    return index.search(ask(index.spark, axis), EVERYTHING).where("rank = 1").first()["doc_id"]


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, document_name string, chunk_text string, chunk_index int, embedding_count int, file_path string")


def test_index_life(spark, tmp_path):
    path = str(tmp_path / "index")
    meta = chunk_rows(spark, [(i, "AABBB"[i], f"text {i}", i, 4, None) for i in range(5)])
    index = VectorIndex.create(spark, path, one_hot(spark, range(5)), IndexConfig(nbits=4, centroids="deterministic"), meta)
    assert (index.num_documents, index.num_embeddings, index.dim) == (5, 20, 16)
    assert best(index, 1) == 1
    index, ids = index.append(one_hot(spark, [5, 6]), chunk_rows(spark, [(0, "C", "five", 0, 4, "/c"), (1, "C", "six", 1, 4, None)]))
    assert ids == [5, 6] and best(index, 6) == 6
    index, gone = index.delete([2, 2, 99, -1])
    assert [r[0] for r in gone.collect()] == [2]
    assert [best(index, a) for a in (1, 3, 4, 6)] == [1, 2, 3, 5]
    index, _ = index.delete([5])
    assert [best(index, a) for a in (3, 5)] == [2, 4]
    assert [r["chunk_text"] for r in index.chunks().orderBy("doc_id").collect()] == ["text 0", "text 1", "text 3", "text 4", "five"]
    got = np.array([r["v"] for r in index.reconstruct([0]).collect()])
    assert got.shape == (4, 16) and abs((got**2).sum(1) - 1).max() < 1e-6
    with pytest.raises(InvalidDocumentId):
        index.reconstruct([99])
    same, none = index.delete([77])
    assert same is index and none.count() == 0
    assert index.query("document_name = ?", ["A"]).count() == 2
    index, _ = index.delete_named("A")
    assert index.num_documents == 3
    assert [tuple(r)[:3] for r in index.documents().collect()] == [("B", 2, 8), ("C", 1, 4)]
    with pytest.raises(ModelMismatch):
        VectorIndex.open(spark, path, "other")
    index, gone = index.delete([0, 1, 2])
    assert index is None and gone.count() == 3
    with pytest.raises(IndexNotFound):
        VectorIndex.open(spark, path)


def test_incremental_append(spark, tmp_path):
    index = VectorIndex.create(spark, str(tmp_path / "i"), one_hot(spark, range(6)), IndexConfig(nbits=2, centroids="deterministic", rebuild_up_to=0))
    assert not index._exists("raw")
    index, ids = index.append(one_hot(spark, [6, 7]))
    assert ids == [6, 7] and index.num_documents == 8 and best(index, 3) == 3


def test_empty_and_ragged_index(spark, tmp_path):
    with pytest.raises(EmptyEmbeddingSet):
        VectorIndex.create(spark, str(tmp_path / "a"), one_hot(spark, []))
    ragged = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [1.0])], "doc_id long, token_pos int, v array<float>")
    with pytest.raises(DimensionMismatch):
        VectorIndex.create(spark, str(tmp_path / "b"), ragged)


def test_graded_corpus(spark):
    docs, queries = evaluate.graded_corpus()
    d = spark.createDataFrame(docs, "doc_id long, token_pos int, v array<double>").cache()
    q = spark.createDataFrame(queries, "query_id long, qtok int, v array<double>")
    exact = score.search_exact(d, q, 5).cache()
    assert {r["query_id"]: r["doc_id"] for r in exact.where("rank = 1").collect()} == {i: 5 * i for i in range(6)}
    c = codec.kmeans_centroids(d, 64)
    a = codec.assign(d, c).cache()
    rest = codec.residuals(a, c).cache()
    edges, weights = codec.cutoffs(rest, 4)
    rebuilt = codec.reconstruct(codec.codes(rest, edges), c, weights)
    got = search.staged(rebuilt, a, codec.inverted_lists(a), c, q, SearchParameters(n_full_scores=4096, n_ivf_probe=64, centroid_score_threshold=None)).cache()
    assert evaluate.top_1_agreement(exact, got).where("not agrees").count() == 0
    assert evaluate.overlap_at_k(exact, got, 5).agg(F.avg("overlap")).first()[0] >= 0.8
    # everything probed, nothing cut, nothing compressed: the exact result
    same = search.staged(d.select("doc_id", "v"), a, codec.inverted_lists(a), c, q, SearchParameters(n_full_scores=4096, n_ivf_probe=64, centroid_score_threshold=None))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, exact.collect()))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 60), st.integers(1, 200), st.integers(0, 200))
def test_windows_cover_all(n, size, overlap):
    size, step = X.window_sizes(size, overlap)
    starts = list(range(0, n, step))
    assert {i for s in starts for i in range(s, min(s + size, n))} == set(range(n))


def windows(spark, n, size, overlap):
    ids = spark.createDataFrame([([str(i) for i in range(1, n + 1)],)], "t array<string>")
    return ids.select(X.token_windows(F.col("t"), size, overlap).alias("w")).first()[0]


def test_windows(spark):
    assert [int(w[0]) - 1 for w in windows(spark, 60, 16, 4)] == [0, 12, 24, 36, 48]
    w = windows(spark, 15, 5, 20)
    assert len(w) == 15 and w[-1] == ["15"]
    assert max(map(len, windows(spark, 200, 300, 0))) == 180
    assert windows(spark, 0, 5, 2) == [] and len(windows(spark, 1000, 180, 64)) == 9


def of_text(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression(F.col("text"))).first()[0]


def greedy(counts, size, overlap):
    """Chunks of greedy packing, item by item."""
    out, held = [], []
    for i, n in enumerate(counts):
        if n > size:
            out += [held] * bool(held) + [[i]]
            held = []
            continue
        if held and sum(counts[j] for j in held) + n > size:
            out.append(held)
            kept = []
            for j in reversed(held):
                if sum(counts[k] for k in kept) + counts[j] > overlap:
                    break
                kept.insert(0, j)
            held = kept
        held = [*held, i]
    return out + [held] * bool(held)


def test_packed_ranges(spark):
    r = np.random.default_rng(1)
    for size, overlap in ((1, 0), (5, 0), (9, 4), (20, 19)):
        rows = [[int(x) for x in r.integers(1, size + 4, r.integers(0, 40))] for _ in range(30)] + [[1] * 3000, []]
        got = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "i int, counts array<int>").select("i", X.packed_ranges(F.col("counts"), size, overlap).alias("r")).collect()
        for i, ranges in got:
            assert [list(range(x["first"], x["end"])) for x in ranges or []] == greedy(rows[i], size, overlap)


def test_sentences(spark):
    packed = lambda text, size, overlap: of_text(spark, text, lambda t: chunk.sentence_chunks(t, size, overlap))
    split = lambda text: of_text(spark, text, X.sentences)
    assert packed("", 10, 2) == [] and packed(None, 10, 2) == [] and packed(" \n ", 10, 2) == []
    parts = split("Dr. Smith met Mr. Jones at 9 a.m. on Monday. They spoke at length. Nothing came of it.")
    assert parts[0] == "Dr. Smith met Mr. Jones at 9 a.m. on Monday." and len(parts) == 3
    assert split("He left at 9 p.m. Nobody saw J. Doe. \"Prof. Dr. Who?\" she said.") == ["He left at 9 p.m.", "Nobody saw J. Doe.", "\"Prof. Dr. Who?\"", "she said."]
    chunks = packed("One two three. Four five six. Seven eight nine. Ten eleven twelve.", 7, 3)
    assert chunks[0] == "One two three. Four five six." and chunks[1].startswith("Four five six.")
    long = packed("this is a long sentence, with a clause in it; and another clause after that one, and more words to come here.", 8, 2)
    assert len(long) > 1 and all(c[-1] in ",;." for c in long)
    assert len(packed("No end " * 50, 10, 0)) == 10
    assert split("Really?! Yes! No... Maybe?") == ["Really?!", "Yes!", "No...", "Maybe?"]
    assert split("a\u0001b\u0002 c. d") == ["ab c.", "d"]


def test_masks(spark):
    row = spark.createDataFrame([([5, 6, 7, 8],)], "ids array<bigint>")
    seq = X.model_tokens(F.col("ids"), 5, 2, 0)
    assert row.select(seq).first()[0] == [1, 2, 5, 6, 7]
    assert row.select(X.model_tokens(F.col("ids"), 8, 2, 0)).first()[0] == [1, 2, 5, 6, 7, 8, 0, 0]
    mask = X.attention_mask(X.model_tokens(F.col("ids"), 8, 2, 0), 0, F.array(F.lit(6).cast("long")), 8)
    assert row.select(mask).first()[0] == [1, 1, 1, 0, 1, 1, 0, 0]
    both = row.select(X.model_tokens(F.col("ids"), 8, 2, 0).alias("s"), mask.alias("m"))
    assert both.select(X.document_rows(F.col("s"), F.col("m"))).first()[0] == [1, 2, 5, 7]
    assert both.select(X.document_rows(F.col("s"), F.col("m"), False)).first()[0] == [1, 2, 5, 7, 8]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in rows.select(V.normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in rows.select(V.normalize(F.col("v"), zero_policy="zero")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in rows.select(V.cosine(F.col("v"), F.col("v"))).collect()] == [1.0, 0.0]
    m = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert (V.unpack(*V.pack(m)) == m).all() and len(V.unpack(b"", 2, 3)) == 0
    assert rows.select(V.format_vector(F.col("v"))).first()[0] == "[3.000000000, 4.000000000]"


@settings(max_examples=20, deadline=None)
@given(st.sampled_from([1, 2, 4, 8]), st.lists(st.integers(0, 255), min_size=1, max_size=40))
def test_codes_round_trip(nbits, values):
    v = np.array(values) % (1 << nbits)
    assert (packed.unpack(packed.pack(v[None], nbits), nbits, len(v))[0] == v).all()


def test_pooling():
    eye = np.eye(5)
    out = pooling.pool(eye, 2)
    assert out.shape == (3, 5) and (out[-1] == eye[0]).all()
    assert (pooling.pool(eye, 1) == eye).all() and (pooling.pool(eye[:1], 4) == eye[:1]).all()
    with pytest.raises(PoolingError):
        pooling.pool(np.zeros((0, 3)), 2)


def test_predicates(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, "b", None), (2, "c", 3)], "doc_id long, name string, n int")
    ids = lambda s, p=(): [r[0] for r in predicate.where(rows, s, p).orderBy("doc_id").collect()]
    assert ids("name = ?", ["b"]) == [1] and ids("n IS NULL OR n >= ?", [3]) == [1, 2]
    assert ids("NOT (name IN ('a', ?))", ["c"]) == [1] and ids("n BETWEEN 1 AND 2") == [0]
    for bad, p in (("name", ()), ("other = 1", ()), ("name = 'a'; drop", ()), ("name = ?", ()), ("name = 'a'", (1,)), ("upper(name) = 'A'", ()), ("name = (select 1)", ())):
        with pytest.raises(InvalidPredicate):
            predicate.where(rows, bad, p)


def test_metadata(spark):
    c = metadata.register(chunk_rows(spark, [(0, "Zeta", "z0", 0, 7, "/tmp/zeta"), (1, "Alpha", "a0", 0, 3, ""), (2, "Alpha", "a1", 1, 5, "/x")]))
    assert [r["chunk_text"] for r in metadata.get(c, [2, 9, 0, 1]).collect()] == ["a1", "z0", "a0"]
    assert [tuple(r)[:4] for r in metadata.documents(c).collect()] == [("Alpha", 2, 8, "/x"), ("Zeta", 1, 7, "/tmp/zeta")]
    hits = spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 9, 0.4)], schema.RESULTS)
    assert [r["chunk_text"] for r in metadata.enrich(hits, c).collect()] == ["a1"]
    back = metadata.from_payload(spark.createDataFrame([('{"_subset_": "4", "chunkText": "t"}',), ('{"chunkText": "no id"}',)], "payload string")).collect()
    assert len(back) == 1 and back[0]["doc_id"] == 4 and back[0]["document_name"] == ""


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 40), st.sets(st.integers(0, 39)))
def test_remap(n, gone):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    ids = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("old"))
    d = spark.createDataFrame([(g,) for g in sorted(gone)], "doc_id long")
    got = {r["old"]: r["doc_id"] for r in mutate.remap(ids, mutate.sanitize(d, n)).collect()}
    assert got == {o: i for i, o in enumerate(x for x in range(n) if x not in gone)}


def test_parameters():
    assert params.adaptive(100, 5).n_full_scores == 100 and params.adaptive(100, 5).n_ivf_probe == 16
    assert params.adaptive(1679, 3).n_full_scores == 250
    p = SearchParameters(top_k=3)
    assert "log_timing" not in p.to_json() and SearchParameters.from_json(p.to_json()) == p
    assert schema.resolve_model("MXBAI-edge")[0] == "mxbai" and schema.resolve_model("lfm2")[1].document_length == 512
    with pytest.raises(EngineError):
        schema.resolve_model("other")


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("bravo")
    (tmp_path / "a.MD").write_text("alpha")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "x.bin").write_text("no")
    (tmp_path / ".hidden.txt").write_text("no")
    assert [r["document_name"] for r in ingest.directory(spark, str(tmp_path)).collect()] == ["a.MD", "b.txt"]
    (tmp_path / "ids").write_text(" 3\nx\n7 \n1.5\n")
    assert [r[0] for r in ingest.ids_file(spark, str(tmp_path / "ids")).collect()] == [3, 7]
    with pytest.raises(EmptyInput):
        ingest.samples(spark, str(tmp_path / "none*"))


def test_encoder():
    m = encode.encode_query("one two", encode.HashEncoder(), 4)
    assert m.shape == (4, 32) and (m[2:] == 0).all() and abs((m[:2] ** 2).sum(1) - 1).max() < 1e-12
    with pytest.raises(EmptyInput):
        encode.encode_query(" ", encode.HashEncoder())


def test_stream(spark, tmp_path):
    from veclattice.streaming import ingest as streaming

    for i, (name, text) in enumerate([("a", "red green blue"), ("b", "one two three"), ("c", "stone water fire")]):
        spark.createDataFrame([(name, text)], "document_name string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.stream_files(spark, str(tmp_path / "in"), "document_name string, text string", files_per_batch=2)
    streaming.ingest(stream, str(tmp_path / "index"), encode.HashEncoder(), str(tmp_path / "state"), IndexConfig(nbits=8, centroids="deterministic")).awaitTermination()
    index = SegmentIndex.open(spark, str(tmp_path / "index"))
    assert index.num_documents == 3 and index.num_embeddings == 9
    q = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(encode.encode_query("two three", encode.HashEncoder(), 2))], "query_id long, qtok int, v array<double>")
    hit = metadata.enrich(index.search(q, EVERYTHING).where("rank = 1"), index.chunks()).first()
    assert hit["document_name"] == "b" and abs(hit["score"] - 2) < 0.2


def test_service(spark, tmp_path):
    from veclattice.operators.service import SearchService

    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("red stone on a hill")
    (folder / "b.txt").write_text("blue water under " + " ".join(f"w{i}" for i in range(200)))
    s = SearchService(spark, str(tmp_path / "index"), encode.HashEncoder(), schema.ModelConfig(32), IndexConfig(nbits=8, centroids="deterministic"))
    index = s.index_directory(str(folder))
    assert index.num_documents == 3
    top = s.search("red stone").first()
    assert top["name"] == "a.txt" and top["score"] > 0.9 and top["band"] == "green"
    assert [r["document_name"] for r in s.documents().collect()] == ["a.txt", "b.txt"]
    assert spark.read.json(f"{s.path}/state").first()["totalDocuments"] == 3
    assert s.delete_document("a.txt") == 1 and s.delete_document("none") == 0
    assert s.search("blue water").first()["name"] == "b.txt"
    assert s.delete_document("b.txt") == 2
    with pytest.raises(IndexNotFound):
        s.search("blue")
    s.delete_index()
    s.index_documents(spark.createDataFrame([("c", "one , two . three")], "document_name string, text string"))
    # punctuation is not encoded; the same model keeps the index, another one removes it
    assert s.cache.open(spark, s.path).num_embeddings == 3
    assert not s.switch_model("hash", encode.HashEncoder(), schema.ModelConfig(32)) and s.documents().count() == 1
    assert s.switch_model("other", encode.HashEncoder(), schema.ModelConfig(32, document_length=4))
    with pytest.raises(IndexNotFound):
        s.documents()
    s.index_documents(spark.createDataFrame([("c", "one two three")], "document_name string, text string"))
    assert s.cache.open(spark, s.path).num_embeddings == 2 and s.cache.open(spark, s.path).meta["model_id"] == "other"


def test_generator_and_progress():
    from veclattice.functions.vectors import Lcg

    g = Lcg(1)
    assert g.next() == 6364136223846793006 and Lcg(0).next() == Lcg(0).next()
    seen = []
    from types import SimpleNamespace

    from veclattice.streaming.progress import Progress

    p = Progress(lambda b, n: seen.append((b, n)))
    for b in range(2):
        p.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(batchId=b, numInputRows=3)))
    assert seen == [(0, 3), (1, 6)]


def test_long_pieces_keep_the_text(spark):
    pieces = lambda text, size: of_text(spark, text, lambda t: chunk.long_pieces(t, size))
    got = pieces("it costs 3,000 at noon, and more words follow here, then the end of it all", 6)
    assert "".join(got).replace(" ", "") == "itcosts3,000atnoon,andmorewordsfollowhere,thentheendofitall"
    assert any("3,000" in p for p in got)
    assert pieces("one two three four five", 2) == ["one two", "three four", "five"]
    # a delimiter at the end parts nothing
    assert pieces("one two three,", 2) == ["one two", "three,"]


@pytest.mark.parametrize("flat", [64, 4])
def test_kmeans(spark, monkeypatch, flat):
    """Reruns agree, ids are dense, and centroids fit better than they did at first; hot cells are dealt over several groups."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((5, 6))
    x = np.vstack([centres[r.integers(0, 5, 150)] + 0.2 * r.standard_normal((150, 6)), np.tile(centres[0], (150, 1))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tokens = spark.createDataFrame([(i // 3, i % 3, v.tolist()) for i, v in enumerate(x)], "doc_id long, token_pos int, v array<double>")
    monkeypatch.setattr(codec, "FLAT", flat)
    monkeypatch.setattr(codec, "CELL", 40)
    fit = lambda n: np.array([r["v"] for r in codec.kmeans_centroids(tokens.repartition(n), 20, iterations=3).orderBy("centroid_id").collect()])
    a, b = fit(1), fit(3)
    assert a.shape[0] <= 20 and a.shape == b.shape and np.allclose(a, b, atol=1e-8)
    assert (x @ a.T).max(1).mean() > 0.95 and np.allclose(np.linalg.norm(a, axis=1), 1)


def test_subwords(spark, tmp_path):
    from veclattice.functions.subword import MARK, SubwordTokenizer

    (tmp_path / "v.json").write_text('{"%sab": 3, "%s": 5, "a": 1, "abc": 2,\n "cd": 7}' % (MARK, MARK))
    t = SubwordTokenizer.load(spark, str(tmp_path / "v.json"))
    assert t.tokenize("abcd  xabc\n") == [MARK + "ab", "cd", MARK, "x", "abc"] and t.ids("abcd  xabc\n") == [3, 7, 5, 0, 2]
    assert t.detokenize(t.tokenize(" abcd \t xabc")) == "abcd xabc"
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "abcd ab"), (4, "é" * 5000)], "i int, text string").select("i", t.column(F.col("text")).alias("ids"))
    got = dict(map(tuple, rows.collect()))
    assert got[1] == got[2] == [] and got[3] == [3, 7, 3] and got[4] == [5] + [0] * 5000
    (tmp_path / "v.txt").write_text("a\nb\n")
    assert SubwordTokenizer.load(spark, str(tmp_path / "v.txt")).vocabulary == {"a": 1, "b": 2}
    with pytest.raises(EngineError):
        SubwordTokenizer({"": 1})


def test_replayed_batch(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two three"), ("b", "four five")], "document_name string, text string")
    run = streaming.index_batch(f"{tmp_path}/index", encode.HashEncoder())
    counted = lambda: SegmentIndex.open(spark, f"{tmp_path}/index").num_documents
    # also out of turn
    for batch, want in ((0, 2), (0, 2), (1, 4), (0, 4), (1, 4)):
        run(docs, batch)
        assert counted() == want


def test_vectors_are_written_with_ties_to_even(spark, tmp_path):
    """2 ** -10 has ten decimals, the last a 5; the next double above 0.1234567885 is no tie."""
    import duckdb

    from veclattice.plans import catalogue

    values = [2**-10, 3 * 2**-10, -(2**-10), 1.5, 0.1234567885, float(np.nextafter(0.1234567885, 1)), 7 * 2**-10, 0.0, 153 * 2**-10, -5 * 2**-10, 1e-12]
    spark.createDataFrame([(0, values), (1, values[::-1]), (2, None)], "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalogue.format_vector(spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == sorted(db.sql(catalogue.SQL["format_vector"]).fetchall())
    assert got[0][1].startswith("[0.000976562, 0.002929688, -0.000976562, 1.500000000, ")


def test_products_with_centroids_stay_in_blocks():
    """Memory of an assignment does not grow with tokens times centroids."""
    import tracemalloc

    from veclattice.operators import packed

    r = np.random.default_rng(0)
    v, matrix = r.standard_normal((4096, 4)), r.standard_normal((5000, 4))
    want = np.concatenate([np.round(x @ matrix.T, 9).argmax(1) for x in np.split(v, 16)])
    tracemalloc.start()
    got, _ = packed.nearest(v, matrix), packed.Encoder(matrix, [0.0], [-0.1, 0.1], 1).encode(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 40e6


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(1)
    at = [i / 512 for i in range(1, 512)]
    for held in ([0.5], [3.0, 1.0], [0.0] * 700 + np.round(r.standard_normal(3000), 3).tolist(), [1e300, -1e300, *r.random(50).tolist()], [float("inf"), float("-inf"), 2.0, 1.0, None]):
        rows = spark.createDataFrame([(x,) for x in held], "x double").repartition(5)
        want = rows.agg(F.percentile("x", F.array(*map(F.lit, at)))).first()[0]
        assert repr(codec.quantiles(rows, at)) == repr(want)
    assert codec.quantiles(spark.createDataFrame([(None,)], "x double"), at) == []
    rows = spark.range(200_000).select(F.rand(3).alias("x")).persist()
    assert codec.quantiles(rows, [0.25, 0.3]) == rows.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.3)))).first()[0]


def test_cutoffs_of_an_index_of_over_a_million_numbers_are_exact(spark, tmp_path):
    rows = spark.range(2100).select(F.expr("id div 8").alias("doc_id"), (F.col("id") % 8).cast("int").alias("token_pos"), F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.xxhash64("id", i) / 2.0**63).alias("v"))
    index = VectorIndex.create(spark, str(tmp_path / "i"), rows, IndexConfig(nbits=2, centroids="deterministic", every=500))
    c = index.table("centroids")
    rest = codec.residuals(codec.assign(index.table("raw"), c), c).select(F.explode("r").alias("x"))
    want = rest.agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias("c"), F.percentile("x", F.array(*[F.lit(p) for p in (0.125, 0.375, 0.625, 0.875)])).alias("w")).first()
    assert (index.meta["cutoffs"], index.meta["weights"]) == tuple(want)
    assert not (tmp_path / "i" / "v0" / "residuals").exists()


def test_probing_all_lists_ranks_nothing(spark):
    r = np.random.default_rng(2)
    unit = [(i // 4, i % 4, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(r.standard_normal((80, 8)))]
    d = spark.createDataFrame(unit, "doc_id long, token_pos int, v array<double>")
    q = d.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), F.col("token_pos").alias("qtok"), F.when(F.col("doc_id") == 1, F.transform("v", lambda x: F.lit(0.0))).otherwise(F.col("v")).alias("v"))
    c = codec.every_nth(d, 8)
    lists = codec.inverted_lists(codec.assign(d, c))
    scorer, ids = search.scorer_of(c, q)
    found = search.probe(c, scorer, lists, len(ids))
    assert sorted(map(tuple, search.pairs(found, scorer).collect())) == [(i, j) for i in (0, 2) for j in range(20)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_many_query_tokens_are_no_columns_of_a_plan(spark, monkeypatch):
    """Same scores as by columns, ties by rounding and a query of zeros included; the plan does not grow with the query tokens."""
    rng = np.random.default_rng(5)
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    rows = [(d, p, unit(rng.normal(size=4))) for d in range(60) for p in range(1 + d % 5)]
    rows += [(60 + i, p, [x + i * 1e-9 for x in v]) for i in range(9) for _, p, v in rows[-5:]]
    documents = spark.createDataFrame(rows, "doc_id long, token_pos int, v array<double>").repartition(3)
    asked = [(q, t, unit(rng.normal(size=4))) for q in (3, 7, 9) for t in range(1 + q % 4)] + [(5, 0, [0.0] * 4)] + [(11, p, v) for _, p, v in rows[-5:]]
    queries = spark.createDataFrame(asked, "query_id long, qtok int, v array<double>")
    seen = spark.createDataFrame([(3, 4), (3, 64), (7, 8)], "query_id long, doc_id long")
    calls = [lambda: score.maxsim(documents, queries), lambda: score.search_exact(documents, queries, 5), lambda: score.search_exact(documents, queries, 2, seen)]
    by_columns = [sorted(map(tuple, f().collect())) for f in calls]
    assert len(by_columns[0]) == 5 * 69 and len(by_columns[1]) == 25
    monkeypatch.setattr(score, "COLUMNS", 3)
    assert [sorted(map(tuple, f().collect())) for f in calls] == by_columns
    with pytest.raises(Exception, match="dimension|Dimension"):
        score.maxsim(spark.createDataFrame([(0, 0, [1.0, 2.0])], "doc_id long, token_pos int, v array<double>"), queries).collect()
    many = spark.createDataFrame([(i // 8, i % 8, unit(rng.normal(size=4))) for i in range(2400)], "query_id long, qtok int, v array<double>")
    monkeypatch.undo()
    wide = score.search_exact(documents, many, 5)
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("max(") == 0
    assert wide.count() == 300 * 5
