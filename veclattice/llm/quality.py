"""Quality rules by weak supervision.

Each rule votes good, votes bad or abstains.  The counts of vote patterns (at
most 3 ** rules rows) are all that the driver sees; expectation-maximisation
on them estimates how often each rule votes each way on good and on bad
documents, and the posterior probability of good replaces an all-must-pass
filter.  A base filter fails short and self-repeating texts outright.

Defined results: null and empty texts have zero counts and fail the base
filter; repeated rows each get their row; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textcodes import _BYTE_CODE, BASES, chunks, plain, spans, tidied, windows, words

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_ended", "n_distinct", "n_bare")


def _per_doc(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _counts(texts: pa.Array, i: int, j: int) -> list[np.ndarray]:
    w = words(texts, i, j)
    n = np.diff(w.first)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + i : texts.offset + j + 1]
    edges = offsets - offsets[0]
    if not len(w.data):
        return [np.zeros(j - i, dtype=np.int64) for _ in _COUNTS]
    data, doc = w.data, w.doc()
    lead = (data & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    chars = np.bincount(doc, weights=(sums[w.end] - sums[w.begin]), minlength=j - i).astype(np.int64)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    # lines: between a document's edges and its newlines
    brk = np.flatnonzero(data == 10)
    b = np.sort(np.concatenate([edges[:-1], brk + 1]))
    e = np.sort(np.concatenate([edges[1:], brk]))
    # a line begins in the document of its first byte; empty documents have an empty line
    at = np.searchsorted(w.begin, b)
    full = (at < len(w.begin)) & (w.begin[np.minimum(at, max(len(w.begin) - 1, 0))] < e) if len(w.begin) else np.zeros(len(b), dtype=bool)
    b, e, at = b[full], e[full], at[full]
    line_doc = doc[at]
    code = spans(_BYTE_CODE[data], b, e, BASES[1])
    pair = np.unique(np.stack([line_doc.astype(np.uint64), code]), axis=1)
    n_lines = np.bincount(line_doc, minlength=j - i)
    n_dup = n_lines - np.bincount(pair[0].astype(np.int64), minlength=j - i)
    last = w.end[np.searchsorted(w.begin, e) - 1] - 1
    ended = np.isin(data[last], np.frombuffer(b".!?:;\"')", dtype=np.uint8))
    n_ended = np.bincount(line_doc, weights=ended, minlength=j - i).astype(np.int64)
    # words in 3-word windows met twice in their document
    start, tri = windows(w, 3)
    tri_doc = doc[start]
    order = np.lexsort((tri, tri_doc))
    same = np.zeros(len(order), dtype=bool)
    if len(order):
        eq = (tri[order][1:] == tri[order][:-1]) & (tri_doc[order][1:] == tri_doc[order][:-1])
        same[1:] |= eq
        same[:-1] |= eq
    twice = np.zeros(len(w.code) + 3, dtype=bool)
    s = start[order[same]]
    for k in range(3):
        twice[s + k] = True
    n_repeat = _per_doc(twice[: len(w.code)], w.first)
    order = np.lexsort((w.code, doc))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (w.code[order][1:] != w.code[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    n_distinct = np.bincount(doc[order[fresh]], minlength=j - i)
    upper = (data >= 0x41) & (data <= 0x5A)
    letter = upper | ((data >= 0x61) & (data <= 0x7A)) | (lead & (data >= 0xC3))
    sums = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    n_bare = np.bincount(doc, weights=sums[w.end] == sums[w.begin], minlength=j - i).astype(np.int64)
    return [n, chars, _per_doc(symbol[data], edges), n_dup, n_repeat, n_lines, _per_doc(upper, edges), _per_doc(letter, edges), _per_doc(data == 0x21, edges), n_ended, n_distinct, n_bare]


@tidied
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = plain(batch.column(1))
        parts = [_counts(texts, i, j) for i, j in chunks(texts)]
        columns = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for k in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))


#: name: (bad if, good if); neither: the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols > 0.3 * n_words", "n_symbols < 0.05 * n_words"),
    "dup_lines": ("n_dup_lines > 0.3 * n_lines", "n_lines > 2 and n_dup_lines = 0"),
    "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.1 * n_words"),
    "upper": ("n_upper > 0.5 * n_letters", "n_upper < 0.15 * n_letters"),
    "shouts": ("n_shouts > 0.2 * n_words", "n_shouts < 0.03 * n_words"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    "letters": ("n_letters < 0.6 * word_chars", "n_letters > 0.85 * word_chars"),
    "bare_words": ("n_bare > 0.2 * n_words", "n_bare < 0.05 * n_words"),
    "line_ends": ("n_ended < 0.2 * n_lines", "n_ended > 0.7 * n_lines"),
    "variety": ("n_distinct < 0.1 * n_words", "n_distinct > 0.3 * n_words"),
}


def _pattern(rules: dict[str, tuple[str, str]]) -> Column:
    """Votes as base-3 digits: 0 abstains, 1 good, 2 bad."""
    votes = [F.when(F.expr(bad), 2).when(F.expr(good), 1).otherwise(0).cast("long") * 3**k for k, (bad, good) in enumerate(rules.values())]
    return sum(votes[1:], votes[0])


#: How a rule is presumed to abstain, vote good and vote bad: on bad documents, on good ones.
PRESUMED = np.array([[0.35, 0.35, 0.3], [0.2, 0.79, 0.01]])
#: Weight of that presumption in either class, as a share of the documents.
PRIOR_SHARE = 0.02


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 100) -> np.ndarray:
    """Posterior probability of good for each vote pattern, by expectation-maximisation."""
    votes = patterns[:, None] // 3 ** np.arange(n_rules) % 3
    bad, good = (votes == 2).sum(1), (votes == 1).sum(1)
    post = np.where(bad > 0, 0.1, np.where(good > 0, 0.9, 0.5))
    strength = 1 + PRIOR_SHARE * counts.sum()
    for _ in range(rounds):
        # smoothed: a rule is presumed to vote rightly more often than wrongly
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        log = np.tile(np.log(prior)[:, None], (1, len(patterns)))
        for k in range(n_rules):
            seen = np.stack([[(weight[c] * (votes[:, k] == v)).sum() for v in range(3)] for c in range(2)])
            seen += strength * PRESUMED
            log += np.log(seen / seen.sum(1, keepdims=True))[:, votes[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    return post


def judge(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, least: float = 0.5) -> DataFrame:
    """Counts, base_failed, quality (posterior of good) and kept of every row."""
    rows = cut(measure(docs).withColumn("pattern", _pattern(rules)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    table = rows.where(~failed).groupBy("pattern").count().toPandas()  # at most 3 ** rules rows
    post = fit(table["pattern"].to_numpy(dtype=np.int64), table["count"].to_numpy(dtype=float), len(rules))
    posts = docs.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(table["pattern"], post, strict=True)], "pattern long, quality double")
    # as bounded as the table of patterns
    out = rows.join(F.broadcast(posts), "pattern", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))
