"""The segmented index: packed codes, pruning, certified search, segments, bitmaps and the ledger."""

from __future__ import annotations

import glob
import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclattice.errors import ConcurrentWrite, DimensionMismatch, EngineError
from veclattice.operators import packed, score
from veclattice.operators.segments import SegmentIndex, select_and_set
from veclattice.schema import IndexConfig, SearchParameters

CONFIG = IndexConfig(nbits=2, centroids="deterministic", every=8, rebuild_up_to=0, block=8, bucket=2)
ALL = SearchParameters(n_full_scores=10_000, n_ivf_probe=10_000, top_k=5, centroid_score_threshold=None)
KIND = "doc_id long, token_pos int, v array<double>"


def made(n: int, seed: int = 0, dim: int = 12) -> list[tuple]:
    """Token rows of n documents around a few centres."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim))
    return [(d, t, (centres[d % 6] + 0.3 * r.standard_normal(dim)).tolist()) for d in range(n) for t in range(int(r.integers(1, 6)))]


@pytest.fixture(scope="module")
def rows():
    return made(60)


@pytest.fixture(scope="module")
def queries(spark, rows):
    return spark.createDataFrame([(q, t, v) for q, (d, t, v) in enumerate(rows[:4])] + [(9, 0, rows[30][2]), (9, 1, rows[50][2]), (9, 2, [0.0] * 12), (10, 0, [0.0] * 12)], "query_id long, qtok int, v array<double>").cache()


def frame(spark, rows, shift=0):
    return spark.createDataFrame([(d - shift, t, v) for d, t, v in rows], KIND)


def hits(df):
    return sorted(map(tuple, df.collect()))


def exact(spark, rows, queries, k=5):
    return hits(score.search_exact(score.unit_tokens(frame(spark, rows)), score.unit_tokens(queries.select(F.col("query_id").alias("doc_id"), F.col("qtok").alias("token_pos"), "v")).select(F.col("doc_id").alias("query_id"), F.col("token_pos").alias("qtok"), "v").where("query_id <> 10"), k))


@pytest.mark.parametrize("nbits", [1, 2, 4, 8])
@pytest.mark.parametrize("dim", [1, 5, 64])
def test_packing_and_tables(nbits, dim):
    r = np.random.default_rng(nbits * dim)
    codes = r.integers(0, 2**nbits, (33, dim)).astype(np.uint8)
    data = packed.pack(codes, nbits)
    assert data.shape == (33, -(-dim * nbits // 8)) and (packed.unpack(data, nbits, dim) == codes).all()
    weights, queries, centroids = r.standard_normal(2**nbits), r.standard_normal((7, dim)), r.standard_normal((5, dim))
    encoder = packed.Encoder(centroids, [], weights, nbits)
    scorer = packed.Scorer.of([0, 1], np.array([0, 0, 0, 1, 1, 1, 1]), queries, encoder)
    best, lengths = r.integers(0, 5, 33), r.random(33) + 0.5
    rebuilt = encoder.decode(best, data, lengths)
    assert np.allclose(scorer.products(best, data, lengths), rebuilt @ queries.T)
    counts = np.array([1, 30, 2])
    sums = scorer.sums(scorer.products(best, data, lengths), counts)
    brute = [[sum((rebuilt[a:b] @ q).max() for q in queries[s:e]) for s, e in ((0, 3), (3, 7))] for a, b in ((0, 1), (1, 31), (31, 33))]
    assert np.allclose(sums, brute)


def test_bitmaps():
    r = random.Random(1)
    gone, words, left = set(), None, 100
    for _ in range(6):
        alive = [d for d in range(100) if d not in gone]
        ranks = r.sample(range(len(alive)), 9)
        gone |= {alive[k] for k in ranks}
        words, left = select_and_set(128, 100, words, ranks)
    assert left == 100 - len(gone) and {64 * w + b for w, x in enumerate(words) for b in range(64) if x % 2**64 >> b & 1} == gone


def test_certified_is_exact(spark, tmp_path, rows, queries):
    index = SegmentIndex.create(spark, f"{tmp_path}/i", frame(spark, rows), replace(CONFIG, nbits=4))
    want = exact(spark, rows, queries)
    got, report = index.certified(queries, 5, probes=3)
    assert hits(got) == want
    assert all(5 <= r["scored"] <= r["candidates"] <= r["documents"] == 60 for r in report) and min(r["scored"] for r in report) < 30
    # more than there are, a subset, and a query that sees all
    assert len(hits(index.certified(queries, 100)[0])) == 60 * 5
    subset = spark.createDataFrame([(0, 7), (0, 40), (0, 999)], "query_id long, doc_id long")
    few = hits(index.certified(queries, 5, subset=subset)[0])
    assert {h[2] for h in few if h[0] == 0} == {7, 40} and [h for h in few if h[0]] == [h for h in want if h[0]]
    assert [h[:3] for h in hits(index.search(queries, ALL, subset)) if h[0] == 0] == [h[:3] for h in few if h[0] == 0]


def test_equal_scores_and_repeated_documents(spark, tmp_path):
    same = [(d, 0, [1.0, 0.0]) for d in range(20)] + [(20, 0, [0.0, 1.0])]
    index = SegmentIndex.create(spark, f"{tmp_path}/i", frame(spark, same), CONFIG)
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id long, qtok int, v array<double>")
    assert [h[2] for h in hits(index.certified(q, 5)[0])] == [0, 1, 2, 3, 4] == [h[2] for h in hits(index.search(q, ALL))]


def test_packed_store_is_small(spark, tmp_path):
    r = np.random.default_rng(0)
    wide = [(d, t, r.standard_normal(128).tolist()) for d in range(200) for t in range(8)]
    index = SegmentIndex.create(spark, f"{tmp_path}/i", frame(spark, wide), replace(CONFIG, every=100, block=4096))
    codes = sum(len(x["codes"]) + 4 * x["n_tokens"] for x in spark.read.parquet(f"{tmp_path}/i/docs").select("codes", "n_tokens").collect())
    assert codes * 4 < 4 * 128 * len(wide) and index.stored_bytes("docs") * 4 < index.stored_bytes("vectors")


def test_searches_read_few_files(spark, tmp_path, rows, queries):
    index = SegmentIndex.create(spark, f"{tmp_path}/i", frame(spark, rows), CONFIG)
    lists = glob.glob(f"{tmp_path}/i/lists/*/bucket=*/*.parquet")
    scorer, _ = next(index._scorers(queries.where("query_id = 0")))
    candidates = index.candidates({0: [0]}, scorer)
    read = {r[0] for r in index._read("lists", "bucket int, centroid_id int, block int, docs array<int>, reach array<double>").where("bucket = 0").select(F.input_file_name()).distinct().collect()}
    plan = candidates._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(seg" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] + plan
    assert 0 < len(read) < len(lists) / 4
    docs = index._at("docs", "block int, doc int, n_tokens int", candidates.limit(1))
    scan = next(x for x in docs._jdf.queryExecution().executedPlan().toString().split("\n") if "docs/" in x or "FileScan" in x and "n_tokens" in x)
    assert "block" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_appends_write_what_they_bring(spark, tmp_path, rows, queries):
    path, config = f"{tmp_path}/i", replace(CONFIG, fan=3)
    index = SegmentIndex.create(spark, path, frame(spark, [x for x in rows if x[0] < 12]), config)
    once = SegmentIndex.create(spark, f"{tmp_path}/once", frame(spark, [x for x in rows if x[0] < 12]), config)
    once, ids = once.append(frame(spark, [x for x in rows if x[0] >= 12], 12))
    assert ids == list(range(12, 60))
    codebook = os.path.getmtime(glob.glob(f"{path}/codebook-*")[0])
    for a in range(12, 60, 6):
        before = set(glob.glob(f"{path}/docs/seg=*"))
        index, ids = index.append(frame(spark, [x for x in rows if a <= x[0] < a + 6], a))
        assert ids == list(range(a, a + 6)) and before <= set(glob.glob(f"{path}/docs/seg=*"))
    assert codebook == os.path.getmtime(glob.glob(f"{path}/codebook-*")[0])
    assert index.num_documents == 60 and len(index.segments) < 6 and not index.due()
    assert hits(index.search(queries, ALL)) == hits(once.search(queries, ALL))
    assert hits(index.certified(queries)[0]) == exact(spark, rows, queries)
    # 9 segments were written and 4 merged ones: each document is rewritten at most once for each size
    assert len(glob.glob(f"{path}/docs/seg=*")) <= 9 + 4
    gone = index.vacuum()
    assert gone and len(glob.glob(f"{path}/docs/seg=*")) == len(index.segments)
    assert hits(SegmentIndex.open(spark, path).search(queries, ALL)) == hits(once.search(queries, ALL))


def test_deletes_leave_codes_alone(spark, tmp_path, rows, queries):
    path = f"{tmp_path}/i"
    chunks = spark.createDataFrame([(d, f"n{d % 5}", f"text {d}") for d in range(60)], "doc_id long, document_name string, chunk_text string")
    index = SegmentIndex.create(spark, path, frame(spark, [x for x in rows if x[0] < 40]), CONFIG, chunks.where("doc_id < 40"))
    index, _ = index.append(frame(spark, [x for x in rows if x[0] >= 40], 40), chunks.where("doc_id >= 40").withColumn("doc_id", F.col("doc_id") - 40))
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/docs/**/*.parquet", recursive=True)}
    left = list(range(60))
    r = random.Random(4)
    for _ in range(3):
        gone = sorted(r.sample(range(len(left)), 9))
        index, told = index.delete([*gone, -1, 1000, gone[0]])
        assert [x[0] for x in told.collect()] == gone
        left = [d for k, d in enumerate(left) if k not in gone]
    assert files == {f: os.path.getmtime(f) for f in glob.glob(f"{path}/docs/**/*.parquet", recursive=True)}
    place = {d: k for k, d in enumerate(left)}
    kept = [(place[d], t, v) for d, t, v in rows if d in place]
    want = exact(spark, kept, queries)
    assert hits(index.certified(queries)[0]) == want
    assert sorted((x["doc_id"], x["chunk_text"]) for x in index.chunks().collect()) == [(k, f"text {d}") for k, d in enumerate(left)]
    assert index.num_documents == len(left) and index.num_embeddings == len(kept) == index.tokens().count()
    assert sorted(map(tuple, index.table("doclens").collect())) == [(k, sum(1 for x in kept if x[0] == k)) for k in range(len(left))]
    merged = index.compact(last=2)
    assert len(merged.segments) == 1 and merged.segments[0]["docs"] == len(left)
    assert hits(merged.certified(queries)[0]) == want and merged.chunks().count() == len(left)
    assert merged.delete([])[0] is merged
    index, told = merged.delete(spark.range(len(left)).select(F.col("id").alias("doc_id")))
    assert index is None and told.count() == len(left) and not os.path.exists(path)


def test_ledger(spark, tmp_path, rows):
    index = SegmentIndex.create(spark, f"{tmp_path}/i", frame(spark, [x for x in rows if x[0] < 10]), replace(CONFIG, fan=2), batch="a:0")
    for name in ("a:1", "b:0", "a:2"):
        index, ids = index.append(frame(spark, [x for x in rows if x[0] < 5]), batch=name)
        assert len(ids) == 5
    # out of turn, after merges, after deletes
    index, _ = index.delete([0, 3])
    for name in ("a:1", "b:0", "a:0", "a:2"):
        same, ids = SegmentIndex.open(spark, f"{tmp_path}/i").append(frame(spark, [x for x in rows if x[0] < 5]), batch=name)
        assert ids == [] and same.version == index.version
    assert index.batches == {"a:0", "a:1", "b:0", "a:2"}


def test_refusals(spark, tmp_path, rows):
    index = SegmentIndex.create(spark, f"{tmp_path}/i", frame(spark, rows[:20]), replace(CONFIG, keep_vectors=False))
    with pytest.raises(DimensionMismatch):
        index.append(frame(spark, [(0, 0, [1.0, 2.0])]))
    with pytest.raises(EngineError):
        index.certified(spark.createDataFrame([(0, 0, rows[0][2])], "query_id long, qtok int, v array<double>"))
    stale = SegmentIndex.open(spark, f"{tmp_path}/i")
    index.append(frame(spark, rows[:3]))
    with pytest.raises(ConcurrentWrite):
        stale.append(frame(spark, rows[:3]))
    # what a writer left that failed before it published is in nobody's way
    SegmentIndex.open(spark, f"{tmp_path}/i")._write_segment(score.unit_tokens(frame(spark, rows[:3])), index.encoder(), 3, None, ["lost"])
    assert SegmentIndex.open(spark, f"{tmp_path}/i").batches == set()
    assert SegmentIndex.open(spark, f"{tmp_path}/i").num_documents == stale.num_documents + 1 + max(x[0] for x in rows[:3])


def test_small_indexes_are_built_anew(spark, tmp_path, rows, queries):
    config = replace(CONFIG, rebuild_up_to=999)
    index = SegmentIndex.create(spark, f"{tmp_path}/i", frame(spark, [x for x in rows if x[0] < 20]), config, batch="x:0")
    index, _ = index.delete([1])
    index, ids = index.append(frame(spark, [x for x in rows if x[0] >= 20], 20), batch="x:1")
    kept = [(d - (d > 1), t, v) for d, t, v in rows if d != 1]
    whole = SegmentIndex.create(spark, f"{tmp_path}/w", frame(spark, kept), config)
    assert ids == list(range(19, 59)) and len(index.segments) == 1 and index.batches == {"x:0", "x:1"}
    assert hits(index.search(queries, ALL)) == hits(whole.search(queries, ALL))


def test_scorers_hold_no_products():
    """What travels with a function grows with centroids plus query tokens, and tiles of queries give the same sums."""
    import pickle

    r = np.random.default_rng(0)
    centroids, matrix = r.standard_normal((3000, 16)), r.standard_normal((900, 16))
    encoder = packed.Encoder(centroids, [], r.standard_normal(256), 8)
    scorer = packed.Scorer.of(list(range(300)), np.repeat(np.arange(300), 3), matrix, encoder)
    best, data, lengths, counts = r.integers(0, 3000, 40), r.integers(0, 256, (40, 16)).astype(np.uint8), r.random(40) + 0.5, np.array([7, 3, 30])
    want = scorer.sums(encoder.decode(best, data, lengths) @ matrix.T, counts)
    tiles = list(scorer.tiles())
    assert len(tiles) > 2 and [i for i, _ in tiles] == np.cumsum([0, *(len(t.ids) for _, t in tiles[:-1])]).tolist()
    assert np.allclose(np.hstack([t.sums(t.products(best, data, lengths), counts) for _, t in tiles]), want)
    assert len(pickle.dumps(scorer)) < 2 * (centroids.nbytes + matrix.nbytes)


def test_counts_of_texts_are_those_of_their_rows(spark):
    """embedding_count comes without the encoder; words are hashed once."""
    from veclattice.operators import encode
    from veclattice.schema import ModelConfig

    class Counting(encode.HashEncoder):
        hashed: list = []

        def _hashed(self, tokens):
            Counting.hashed += tokens
            return encode.HashEncoder._hashed(tokens)

    texts = ["a b\n c\td", "", None, "  ", "a , b . c", ", .", "a a a a a a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, chunk_text string").coalesce(1)
    for model in (None, ModelConfig(32, document_length=5)):
        rows = encode.encode_documents(df, encode.HashEncoder(), model).groupBy("doc_id").count()
        assert hits(rows) == hits(df.select("doc_id", encode.counted(F.col("chunk_text"), model)))
    one = Counting()
    twice = np.vstack([one.encode(["x", "y", "x"]), one.encode(["y", "x"])])
    assert Counting.hashed == ["x", "y"] and (twice == encode.HashEncoder._hashed(["x", "y", "x", "y", "x"])).all()


def test_many_query_tokens_are_multiplied():
    """Thousands of query tokens are few tiles, whose look-up tables are never made."""
    r = np.random.default_rng(1)
    matrix = r.standard_normal((2400, 64))
    encoder = packed.Encoder(r.standard_normal((50, 64)), [], r.standard_normal(256), 8)
    scorer = packed.Scorer.of(list(range(300)), np.repeat(np.arange(300), 8), matrix, encoder)
    tiles = [t for _, t in scorer.tiles()]
    assert len(tiles) == 6 and sum(len(t.ids) for t in tiles) == 300
    best, data, lengths = r.integers(0, 50, 9), r.integers(0, 256, (9, 64)).astype(np.uint8), r.random(9) + 0.5
    got = np.hstack([t.products(best, data, lengths) for t in tiles])
    assert np.allclose(got, scorer.lookup.shape[2] and np.hstack([packed.tables(m, encoder.weights, 8)[np.arange(64)[:, None], data.T].sum(0) + encoder.centroids[best] @ m.T for m in np.array_split(matrix, 6)]) / lengths[:, None])
    assert not any("lookup" in t.__dict__ for t in tiles)


def test_nearest_as_rounded_products():
    """Equal and nearly equal products, in one block of centroids or two: the first of the greatest after rounding."""
    r = np.random.default_rng(2)
    matrix = np.round(r.standard_normal((packed.SIDE * 2 + 7, 3)), 1)
    matrix[packed.SIDE + 5] = matrix[3] = [9.0, 9.0, 9.0]
    matrix[packed.SIDE * 2 + 1] = [9.0 + 1e-10, 9.0, 9.0]
    v = np.vstack([np.ones((1, 3)), np.zeros((1, 3)), np.round(r.standard_normal((500, 3)), 1)])
    assert (packed.nearest(v, matrix) == np.round(v @ matrix.T, 9).argmax(1)).all() and packed.nearest(v, matrix)[0] == 3


def test_hopeless_probes_score_nothing(spark, tmp_path, monkeypatch):
    """Where what was not probed could have any score at all, no list is read and no document scored before all are; results stay."""
    r = np.random.default_rng(3)
    rows = [(d, t, r.standard_normal(32).tolist()) for d in range(60) for t in range(4)]
    index = SegmentIndex.create(spark, f"{tmp_path}/i", frame(spark, rows), replace(CONFIG, nbits=8))
    queries = spark.createDataFrame([(q, t, rows[4 * q + t][2]) for q in range(3) for t in range(4)], "query_id long, qtok int, v array<double>")
    probed, real = [], SegmentIndex.candidates
    monkeypatch.setattr(SegmentIndex, "candidates", lambda *a: probed.append(a) or real(*a))
    got, report = index.certified(queries, 5, probes=2)
    assert hits(got) == exact(spark, rows, queries) and not probed
    assert {r["probes"] for r in report} == {30} and {r["candidates"] for r in report} == {60}


def test_norm_once(spark):
    """A vector's norm is one sum, not one for each component."""
    from veclattice.functions import vectors as V

    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>").select(V.normalize(F.col("v")).alias("v"))
    assert [r[0] for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_units_and_rests_to_the_bit(spark):
    """Unit vectors and residuals made in blocks are those of the SQL functions, with odd rows too; none is made by a function of each component."""
    from veclattice.functions import vectors as V
    from veclattice.operators import codec

    r = np.random.default_rng(4)
    v = [*r.standard_normal((300, 32)).astype(np.float32).tolist(), [0.0] * 32]
    regular = spark.createDataFrame([(i, 0, x) for i, x in enumerate(v)], KIND)
    odd = regular.unionByName(spark.createDataFrame([(900, 0, None), (901, 1, []), (902, 0, [3.0, 4.0]), (903, 0, [1.0, None])], KIND))
    for rows in (regular, odd):
        want = rows.select("doc_id", "token_pos", V.normalize(F.col("v")).alias("v"))
        got = codec.units(rows)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    ids, matrix = np.arange(7), r.standard_normal((7, 32))
    unit = codec.units(regular)
    want = codec.residuals(codec.assign(unit, (ids, matrix)), spark.createDataFrame(codec.centroid_table(matrix), "centroid_id long, v array<double>"))
    assert sorted(map(repr, (x[0] for x in codec.rests(unit, (ids, matrix)).collect()))) == sorted(map(repr, (x[0] for x in want.select("r").collect())))
    x = np.array([[0.1234567895, -0.1234567895, 0.0000000005, -1e-12, 0.5000000015]])
    assert repr(codec._rounded(x)[0].tolist()) == repr(list(spark.createDataFrame(x.tolist(), "a double, b double, c double, d double, e double").select(*[F.round(c, 9) for c in "abcde"]).first()))
