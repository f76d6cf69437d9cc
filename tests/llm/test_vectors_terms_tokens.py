"""Whitening, ranked search and token counts against brute force, and on odd inputs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veclattice.llm import lexical, tokencount, whitening
from veclattice.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# -- 11


def whitened_by_numpy(vectors, k=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)) + 1_000_000
    centred = x - x.mean(0)
    e, p = np.linalg.eigh(centred.T @ centred / len(x))
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    return x.astype(np.int64), centred @ p / np.sqrt(e), e


def test_whitening(spark):
    rows = table(spark, SF, "embeddings")
    got = whitening.whiten(rows).toPandas()
    plain = rows.orderBy("vec_id").toPandas()
    x, w, e = whitened_by_numpy(plain["embedding"].tolist())
    mine = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert mine.shape == w.shape == (len(plain), 32)
    mine = mine * np.sign((mine * w).sum(0))
    assert np.abs(mine - w).max() < 1e-6
    share = got.groupby("component")["explained"].first().to_numpy()
    total = np.trace(np.cov(x.T, bias=True))
    assert np.abs(share / (e / total) - 1).max() < 1e-9 and (np.diff(share) <= 0).all()
    n, sums = len(x), [sum(int(c) for c in column) for column in x.T]
    exact = {int(i): sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for i, row in zip(plain["vec_id"], x, strict=True)}
    assert {int(i): int(d) for i, d in zip(got["vec_id"], got["deviation"], strict=True)} == exact
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9 and set(got["n"]) == {n}
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(32)).max() < 1e-4
    assert got.dtypes.astype(str).to_dict() == {"vec_id": "int64", "component": "int32", "n": "int64", "deviation": "int64", "whitened": "float64", "explained": "float64", "identity_error": "float64"}


@pytest.mark.parametrize("seed", range(4))
def test_spectrum(seed):
    r = np.random.default_rng(seed)
    d = int(r.integers(2, 40))
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    # repeated, near and vanishing eigenvalues
    values = np.concatenate([[9, 9, 9 - 1e-9], r.random(d) * 5, np.zeros(d)])[:d]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, p = whitening.leading(a, 32)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert np.abs(e - want[: len(e)]).max() < 1e-12 * 9 * d and (want[len(e) : 32] < 1e-9).all()
    assert np.abs(p.T @ p - np.eye(len(e))).max() < 1e-12 and np.abs(a @ p - p * e).max() < 1e-12 * 9 * d
    for shift in r.random(5) * 9:
        assert whitening.positive_pivots(a - shift * np.eye(d)) == (want > shift).sum()


def test_pivots_of_whole_numbers():
    r = np.random.default_rng(0)
    for _ in range(300):
        a = r.integers(-2, 3, (n := int(r.integers(1, 7)), n)).astype(float)
        a = a + a.T
        assert whitening.positive_pivots(a) == (np.linalg.eigvalsh(a) > 1e-9).sum()


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    kind = "vec_id long, embedding array<float>, label int, n long, component int, d int, v int, id string, i int, pos int"
    more = (None,) * 7
    make = lambda rows: spark.createDataFrame([(i, v, None, *more) for i, v in rows], kind)
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, 0.0, 3.0]), (2, [0.25, 0.0, 3.0]), (None, [1.5, -1.0, 0.125]), (4, [9.0, 2.0, 1.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 0.0, 0.0]), (9, [1.0, inf, 0.0]), (10, [1.0, 2.0])]
    got = whitening.whiten(make(good + bad)).toPandas()
    assert len(got) == 15 and set(got["n"]) == {5} and set(got["vec_id"].dropna()) == {1, 2, 4}
    _, w, _ = whitened_by_numpy([v for _, v in good])
    assert np.allclose(np.sort(np.abs(got["whitened"])), np.sort(np.abs(w.ravel())))
    same = whitening.whiten(make([(1, [0.5, 1.0]), (2, [0.5, 1.0])]))
    assert same.count() == 0 and same.columns == got.columns.tolist()
    assert whitening.whiten(make([(1, [0.5, 1.0])])).count() == 0 and whitening.whiten(make([])).count() == 0 and whitening.whiten(make(bad[:5])).count() == 0
    # a dimension that never changes, and numbers beyond 64 bits
    flat = whitening.whiten(make([(i, [float(i), 3.0]) for i in range(6)])).toPandas()
    assert set(flat["component"]) == {1} and flat["identity_error"].max() < 1e-9
    huge = whitening.whiten(make([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 7.0])])).toPandas()
    assert np.isfinite(huge["whitened"]).all() and huge["deviation"].isna().any()


# -- 12


def ranked(docs, items, k=10):
    """By the definition, document by document."""
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    counts = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    big, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, Counter()).update(TERM.findall(fold(text)))
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, query in asked.items():
        scores = []
        for i, c in counts:
            if c:
                m = 100 - 75 + (75 * sum(c.values()) * big) // length
                s = sum(times * math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in query.items() if c[t])
                if s > 0:
                    scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_ranked_search(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows_of(lexical.search(docs, items)) == want
    # many blocks of items and of documents, and sums without arrays
    monkeypatch.setattr(lexical, "ITEM_BYTES", 2000)
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(lexical, "WIDE", 3)
    assert rows_of(lexical.search(docs, items)) == want


def test_ranked_search_odd(spark):
    r = random.Random(5)
    make = lambda n: " ".join(r.choice(["ab", "AB", "é1", "x", "y", "zz9", "İ", "q"]) for _ in range(n))
    docs = [(1, None), (2, ""), (3, " .,-\x7f"), (None, make(9)), (None, "x y"), (4, make(20_000)), (5, "x" * 300_000), *[(10 + i, "x y zz9 q") for i in range(30)], *[(9, "x y zz9 q")] * 3, *[(50 + i, make(r.randint(1, 30))) for i in range(60)]]
    items = [(1, "x y"), (1, "x y"), (1, "Q q q"), (2, None), (3, ""), (None, "é1 İ"), (4, "nowhere"), (5, make(200))]
    frame = spark.createDataFrame([(i, t, None, 1) for i, t in docs], "doc_id long, text string, score long, terms int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert rows_of(lexical.search(frame, asked)) == ranked(docs, items)
    assert rows_of(lexical.search(frame, asked, k=3)) == ranked(docs, items, 3)
    assert lexical.search(frame.where("false"), asked).count() == 0 and lexical.search(frame, asked.where("false")).count() == 0


def test_tree_leaves_out_subtrees():
    """Bounds are never below a score, and most of the tree is not opened."""
    r = random.Random(1)
    rows = [(i, r.randint(25, 200), *zip(*sorted((t, r.randint(1, 4)) for t in r.sample(range(40), r.randint(1, 12))), strict=True)) for i in range(3000)]
    held = Counter(t for row in rows for t in row[2])
    place = [sorted(range(40), key=lambda t: held[t]).index(t) for t in range(40)]
    root = lexical.tree(rows, place, 5)
    nodes, ahead = 0, [root]
    while ahead:
        node = ahead.pop()
        nodes += 1
        ahead += [c for c in node.children if isinstance(c, lexical.Node)]
    opened = 0
    for _ in range(20):
        query = [(t, r.randint(1, 9000)) for t in r.sample(range(40), 5)]
        best = lexical.Best(5)
        opened += lexical.walk(root, query, best)
        scores = sorted(((sum(w * lexical.gain(tf, m) for t, w in query for u, tf in zip(found, times, strict=True) if u == t), -i) for i, m, found, times in rows), reverse=True)
        assert sorted(best.rows(), key=lambda x: (-x[0], x[1])) == [(s, -i) for s, i in scores[:5]]
    assert opened < 20 * nodes / 2


# -- 13

HARD = ["", " ", "x" * 300_000, "ab12" * 60_000, "word " * 60_000, "<|endoftext|>" * 5, "a<|endoftext|> b <|endof text|>  <|endoftext|>\n", "don't 's  'S we'LL  x\x1c y \x85 z\n\n q\t\tr  ", "   a   b", "İß ǅ ﬁ é é ́x ́   \U0001f600 漢字 かな", "\n \n", "1a1 a1a'd1"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    texts = [(1, None), *enumerate(HARD, 2), (2, "again"), (2, "again"), (None, "no id")]
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    docs = docs.withColumn("n_tokens", F.lit("mine")).withColumn("size", F.lit(1))
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        plain = Tokenizer.from_file(path)
        count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    got = tokencount.token_counts(docs, name).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == docs.count()
    for r in got:
        t = r["text"] or ""
        n = count(t)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024), t[:50]
    assert tokencount.token_counts(docs.where("false"), name).count() == 0


def test_pieces_join_to_the_text():
    for t in HARD:
        assert "".join(tokencount.pieces(t)) == t
    assert max(len(p) for p in tokencount.pieces("ab12" * 60_000)) <= 4


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 8)
    monkeypatch.setattr(tokencount, "BATCH", 64)
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        counter = tokencount.Counter(f.read(), ".json")
    r = random.Random(2)
    for _ in range(50):
        texts = [" ".join(r.choice(["alpha", "Beta", "g4mma", "délta", "x" * 60, ""]) + str(r.randint(0, 9)) for _ in range(r.randint(0, 9))) for _ in range(4)]
        assert counter.counts(texts) == counter.lengths(texts) and len(counter.late) <= 8


def test_unknown_tokenizers_are_not_cut():
    step = {"type": "ByteLevel", "add_prefix_space": True}
    assert not tokencount.cuttable({"pre_tokenizer": step}) and not tokencount.cuttable({"pre_tokenizer": None})
    assert not tokencount.cuttable({"pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": [{"content": "<a b>", "lstrip": False, "rstrip": False, "single_word": False}]})
