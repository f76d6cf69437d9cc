"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary
text.  Each window of words is compressed with the ordinary dictionary alone
and with both; the bytes that the toxic one saves are the window's distance.
A logistic calibration turns a document's distances (greatest, mean, share
above thresholds) into a probability.

Training text is chosen so that the dictionaries differ in what matters: the
toxic one is trained on words with stems that recur over toxic documents and
are rare in ordinary ones, the ordinary one on words
that recur in ordinary text.  Windows are compressed behind a fixed lead that
both dictionaries hold, because zstandard stores very short inputs raw.

The model is fitted on a bounded sample of the learnable labelled rows: at
most `toxic_rows` and `ordinary_rows` of them and `words_each` words of each;
each half is calibrated with dictionaries trained on the other.  Scoring
covers whole texts.

Defined results: null and empty texts are scored as having no toxic window;
where no toxic or no ordinary row can be learned from, every score is the
share of toxic rows among those that can; of several labels of one doc_id the
greatest holds; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable
from .textcodes import plain, tidied

TOXIC_ROWS, ORDINARY_ROWS, WORDS_EACH = 2000, 4000, 4000
WINDOW = 6
TOXIC_DICT, ORDINARY_DICT = 4096, 16384
#: Bytes of a word's stem, with the blank before it.
STEMS = range(5, 12)
LEAST_RATIO, LEAST_SIGMAS = 4, 6
_EDGES = b".,;:!?\"'()*#$%&|<>[]{}"
_LEAD = bytes(np.random.default_rng(5).integers(33, 127, 64).astype(np.uint8))


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    base: float


def _words(text: str) -> list[bytes]:
    return [w.strip(_EDGES) for w in text.lower().encode().split()]


def _dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    try:
        return zstd.train_dictionary(size, samples, k=k, d=6, split_point=1.0).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself
        return b"".join(dict.fromkeys(samples))[-size:]


def _distinct(texts: list[str]) -> list[list[bytes]]:
    """The words of each text outside word triples that a text before it has: copied passages count once."""
    seen: set[tuple[bytes, ...]] = set()
    out = []
    for text in texts:
        ws = _words(text)
        triples = list(zip(ws, ws[1:], ws[2:], strict=False))
        old = {k + i for k, t in enumerate(triples) if t in seen for i in range(3)}
        seen.update(triples)
        if len(old) < len(ws):
            out.append([b" " + w + b" " for k, w in enumerate(ws) if k not in old])
    return out


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Trained on texts without their copies and near copies, whose words would pass for recurring ones."""
    tox, plain_ = _distinct(toxic), _distinct(ordinary)

    def stems(ws: list[bytes]) -> set[bytes]:
        return {w[:n] for w in set(ws) for n in STEMS if len(w) >= n}

    in_toxic, in_plain = Counter(g for t in tox for g in stems(t)), Counter(g for t in plain_ for g in stems(t))
    marks = set()
    for stem, k in in_toxic.items():
        expected = (in_plain[stem] + 1) * len(tox) / (len(plain_) + 1)
        if k >= 3 and k >= LEAST_RATIO * expected and k - expected >= LEAST_SIGMAS * (expected + 0.5) ** 0.5:
            marks.add(stem)
    rng = np.random.default_rng(11)
    bad = [w for t in tox for w in t if any(w[:n] in marks for n in STEMS)]
    common = Counter(w for t in plain_ for w in set(t) if len(w) > 4)
    good = [w for w, n in sorted(common.items()) if n > 1 for _ in range(min(n, 5))]  # in an order that is the same in every process
    bad, good = [bad[i] for i in rng.permutation(len(bad))], [good[i] for i in rng.permutation(len(good))]
    return _dictionary(bad, TOXIC_DICT, 24), _dictionary(good, ORDINARY_DICT, 32)


class Distance:
    """Bytes that the toxic dictionary saves on each window of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstd.ZstdCompressionParameters(window_log=16, chain_log=16, hash_log=15, search_log=5, min_match=4, target_length=32, strategy=zstd.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0)
        self._pack = []
        for body in (ordinary + _LEAD, toxic + ordinary + _LEAD):
            d = zstd.ZstdCompressionDict(body, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self._pack.append(zstd.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def windows(self, text: str | None) -> np.ndarray:
        ws = _words(text or "")
        one, both = self._pack
        out = []
        for k in range(0, len(ws), WINDOW):
            x = _LEAD + b" " + b" ".join(ws[k : k + WINDOW]) + b" "
            out.append(len(one(x)) - len(both(x)))
        return np.array(out or [0], dtype=np.float64)

    def features(self, text: str | None) -> list[float]:
        d = self.windows(text)
        top = np.sort(d)[::-1][:3]
        return [top[0], top.mean(), d.mean(), *(np.log1p((d >= k).sum()) for k in (1, 2, 3, 4)), (d >= 2).mean()]


def train(toxic: list[str], ordinary: list[str], base: float) -> Model:
    """base: share of toxic rows, which the sample need not have."""
    if not toxic or not ordinary:
        return Model(b"", b"", np.zeros(8), np.ones(8), np.zeros(9), base)
    x, y = [], []
    for half in (0, 1):  # each half is calibrated with the dictionaries of the other
        distance = Distance(*dictionaries(toxic[half::2] or toxic, ordinary[half::2] or ordinary))
        for label, texts in ((1, toxic), (0, ordinary)):
            rest = texts[1 - half :: 2]
            x += [distance.features(t) for t in rest]
            y += [label] * len(rest)
    bad, good = dictionaries(toxic, ordinary)
    x, y = np.array(x), np.array(y)
    w = np.where(y == 1, base / len(toxic), (1 - base) / len(ordinary)) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    ridge = np.append(np.full(z.shape[1] - 1, 0.3), 1e-3)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - p)) - ridge * beta)
        beta += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Model(bad, good, mean, scale, beta, base)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, words_each: int = WORDS_EACH) -> Model:
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r[0]): r[1] for r in known.groupBy("toxic").count().where("toxic in (0, 1)").collect()}
    total = sum(counts.values())
    u = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # a few more than wanted, cut to the bound below
    share = F.when(F.col("toxic") == 1, min(1.0, 1.2 * toxic_rows / max(1, counts.get(1, 0)))).otherwise(min(1.0, 1.2 * ordinary_rows / max(1, counts.get(0, 0))))
    ids = sorted((r[2], r[0], r[1]) for r in known.where("toxic in (0, 1)").select("doc_id", "toxic", u.alias("u")).where(F.col("u") < share).collect())
    picked = [(i, t) for want, n in ((1, toxic_rows), (0, ordinary_rows)) for _, i, t in [x for x in ids if x[2] == want][:n]]
    spark = docs.sparkSession
    kind = labels.schema["doc_id"].dataType.simpleString()
    rows = spark.createDataFrame(picked, f"doc_id {kind}, toxic int")
    # at most toxic_rows + ordinary_rows ids are broadcast
    text = F.array_join(F.slice(F.split("text", r"[\x20\x09-\x0D]+"), 1, words_each), " ")
    texts = sorted(map(tuple, docs.where("text is not null").select("doc_id", text.alias("text")).join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text")).collect()))  # a text for each id
    return train([t for _, k, t in texts if k == 1], [t for _, k, t in texts if k == 0], counts.get(1, 0) / max(1, total))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        distance = Distance(m.toxic, m.ordinary) if m.ordinary or m.toxic else None
        for batch in batches:
            scores = np.full(batch.num_rows, m.base)
            if distance is not None and batch.num_rows:
                texts = plain(batch.column(1))
                x = np.array([distance.features(t.as_py()) for t in texts])
                z = np.clip((x - m.mean) / m.scale @ m.weights[:-1] + m.weights[-1], -30, 30)
                scores = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def predict(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Learns from the learnable labelled rows and scores all: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
