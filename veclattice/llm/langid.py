"""Language identification by a linear-chain conditional random field.

Each word is labelled with a language; emissions sum learned weights of
affixes, character n-grams and the word itself (the lexicon), transitions
between the languages of neighbouring words are learned too, so text that
switches language is labelled word by word.  Training strings random passages
of different languages together, with the gradient from forward-backward.
Labelling runs forward-backward over the whole text; a document's language is
the one with the greatest sum of word posteriors.

Words of more than LONGEST characters (text without blanks, such as Chinese or
Thai, or a url) are labelled in pieces of that length, each a link of the
chain, so every character counts.

The model is fitted on a bounded sample: at most `per_language` documents of
each language, `words_each` words of each (parameters below), from which
SEQUENCES strings of SEQUENCE_WORDS words are drawn.  Forward-backward
is exact for any length: pieces of a text are reduced to transfer matrices,
which are multiplied along the text.

Defined results: null text and text without a letter give "und" and score 0,
as does a table with nothing to learn from; repeated rows each get their row;
columns other than doc_id, text and (to learn) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, learnable
from .textcodes import Words, byte_codes, chunks, plain, release, tidied, words

PER_LANGUAGE, WORDS_EACH = 500, 300
LONGEST = 24
HASH_BITS, WIDTH = 17, LONGEST + 2
PIECE = 32
SEQUENCE_WORDS, SEQUENCES, _EPOCHS = 64, 3000, 6


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # 2**HASH_BITS x languages
    moves: np.ndarray  # languages x languages


def _slots(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def _lower(word: str) -> str:
    """In lower case, of the same length."""
    return word.replace("\u0130", "i").lower()


def _pieces(w: Words) -> Words:
    """Words with those of more than LONGEST characters cut into pieces."""
    long_ = np.flatnonzero(w.end - w.begin > LONGEST)
    cuts: dict[int, np.ndarray] = {}
    for k in long_.tolist():
        starts = np.flatnonzero((w.data[w.begin[k] : w.end[k]] & 0xC0) != 0x80)  # first bytes of characters
        if len(starts) > LONGEST:
            cuts[k] = w.begin[k] + starts[::LONGEST]
    if not cuts:
        return w
    count = np.ones(len(w.begin), dtype=np.int64)
    count[list(cuts)] = [len(x) for x in cuts.values()]
    upto = np.concatenate([[0], np.cumsum(count)])
    begin, end = np.repeat(w.begin, count), np.repeat(w.end, count)
    for k, x in cuts.items():
        begin[upto[k] : upto[k + 1]] = x
        end[upto[k] : upto[k + 1] - 1] = x[1:]
    return Words(w.data, begin, end, upto[w.first], byte_codes(w.data, begin, end))


def features(vocabulary: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, slot) pairs, one feature kind and place at a time; words without a letter have none."""
    short = [f"^{v}$" for v in vocabulary]
    c = np.array(short, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(short), WIDTH).astype(np.uint64)
    n = (c > 0).sum(1)
    row = np.flatnonzero([any(map(str.isalpha, v)) for v in vocabulary])
    c, n = c[row], n[row]
    size = np.uint64(0x110000)
    whole = np.zeros(len(row), dtype=np.uint64)
    for p in range(WIDTH):
        whole = whole * np.uint64(0x100000001B3) + c[:, p]
    yield row, _slots(whole, 1)  # lexicon
    pairs = c[:, :-1] * size + c[:, 1:]
    for p in range(WIDTH - 1):
        on = n > p + 1
        if on.any():
            yield row[on], _slots(pairs[on, p], 2)
        on = n > p + 2
        if on.any():
            yield row[on], _slots(pairs[on, p] * size + c[on, p + 2], 3)
    for k in (3, 4):  # affixes of k letters
        on = np.flatnonzero(n > k + 1)
        if len(on):
            head = tail = np.zeros(len(on), dtype=np.uint64)
            for p in range(k + 1):
                head = head * size + c[on, p]
                tail = tail * size + c[on, n[on] - 1 - p]
            yield row[on], _slots(head, 3 + k)
            yield row[on], _slots(tail, 9 + k)


def emissions(vocabulary: list[str], model: Model) -> np.ndarray:
    out = np.zeros((len(vocabulary), len(model.languages)), dtype=np.float32)
    if vocabulary:
        for row, slot in features(vocabulary):
            out[row] += model.weights[slot]
    return out


def train(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """From (text, language) pairs."""
    languages = sorted({lang for _, lang in samples})
    k = len(languages)
    if not k:
        return Model([], np.zeros((1 << HASH_BITS, 0), dtype=np.float32), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    texts: list[list[np.ndarray]] = [[] for _ in languages]
    for text, lang in samples:
        pieces = [x[i : i + LONGEST] for x in map(bytes.decode, text.encode().split()) for i in range(0, len(x), LONGEST)]
        ids = [vocabulary.setdefault(_lower(x), len(vocabulary)) for x in pieces]
        if ids:
            texts[languages.index(lang)].append(np.array(ids))
    able = [i for i in range(k) if texts[i]]
    weights, moves = np.zeros((1 << HASH_BITS, k)), np.zeros((k, k))
    if not able:
        return Model(languages, weights.astype(np.float32), moves)
    x = np.zeros((SEQUENCES, SEQUENCE_WORDS), dtype=np.int64)
    y = np.zeros((SEQUENCES, SEQUENCE_WORDS), dtype=np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < SEQUENCE_WORDS:
            lang = able[rng.integers(len(able))]
            text = texts[lang][rng.integers(len(texts[lang]))]
            n = min(int(rng.integers(4, 48)), len(text), SEQUENCE_WORDS - at)
            i = rng.integers(len(text) - n + 1)
            x[s, at : at + n], y[s, at : at + n] = text[i : i + n], lang
            at += n
    # only words that were drawn are trained on
    drawn, x = np.unique(x, return_inverse=True)
    x = x.reshape(y.shape)
    names = list(vocabulary)
    names = [names[v] for v in drawn.tolist()]
    del vocabulary, texts
    parts = [(a.astype(np.int32), b) for a, b in features(names)]
    word = np.concatenate([a for a, _ in parts])
    slot = np.concatenate([b for _, b in parts])
    del parts
    order = np.argsort(word, kind="stable").astype(np.int32)
    word, slot = word[order], slot[order]
    first = np.searchsorted(word, np.arange(len(names) + 1))
    del word, order
    square_w, square_m = np.full((1 << HASH_BITS, k), 1e-6), np.full((k, k), 1e-6)
    for epoch in range(_EPOCHS):
        for batch in np.array_split(rng.permutation(SEQUENCES), SEQUENCES // 100):
            bx, by = x[batch], y[batch]
            used, back = np.unique(bx, return_inverse=True)
            back = back.reshape(bx.shape)
            counts = first[used + 1] - first[used]
            f_word = np.repeat(np.arange(len(used)), counts)
            f_slot = slot[np.concatenate([np.arange(a, b) for a, b in zip(first[used], first[used + 1], strict=True)])] if counts.sum() else np.zeros(0, dtype=np.int64)
            scores = np.stack([np.bincount(f_word, weights=weights[f_slot, c], minlength=len(used)) for c in range(k)], axis=1)
            e = scores[back]
            e = np.exp(e - e.max(2, keepdims=True))
            t = np.exp(moves)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            for i in range(SEQUENCE_WORDS):
                a = e[:, i] if i == 0 else (alpha[:, i - 1] @ t) * e[:, i]
                alpha[:, i] = a / a.sum(1, keepdims=True)
            for i in range(SEQUENCE_WORDS - 2, -1, -1):
                b = (beta[:, i + 1] * e[:, i + 1]) @ t.T
                beta[:, i] = b / b.sum(1, keepdims=True)
            post = alpha * beta
            post /= post.sum(2, keepdims=True)
            gold = np.eye(k)[by]
            g = gold - post
            flat = back.ravel()
            g_word = np.stack([np.bincount(flat, weights=g[:, :, c].ravel(), minlength=len(used)) for c in range(k)], axis=1)
            hit, inverse = np.unique(f_slot, return_inverse=True)
            g_slot = np.stack([np.bincount(inverse, weights=g_word[f_word, c], minlength=len(hit)) for c in range(k)], axis=1) / len(batch)
            g_slot -= 1e-6 * weights[hit]
            square_w[hit] += g_slot**2
            weights[hit] += 0.1 * g_slot / np.sqrt(square_w[hit])
            pair = alpha[:, :-1, :, None] * t * (beta[:, 1:] * e[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            real = np.zeros((k, k))
            np.add.at(real, (by[:, :-1].ravel(), by[:, 1:].ravel()), 1)
            g_move = (real - pair.sum((0, 1))) / len(batch) - 1e-3 * moves
            square_m += g_move**2
            moves += 0.1 * g_move / np.sqrt(square_m)
    return Model(languages, weights.astype(np.float32), moves)


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posteriors of every word of every document; document d has the words first[d]..first[d+1]."""
    n, k = scores.shape
    if not n:
        return scores
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64) + 1e-30
    t = np.exp(moves)
    count = np.diff(first)
    pieces = -(-count // PIECE)
    base = np.concatenate([[0], np.cumsum(pieces)])
    m = int(base[-1])
    owner = np.repeat(np.arange(len(count)), pieces)
    index = np.arange(m) - base[owner]
    start = first[owner] + index * PIECE
    length = np.minimum(PIECE, first[owner + 1] - start)
    # transfer matrix of each piece: rows come in, columns go out
    product = np.tile(np.eye(k), (m, 1, 1))
    for i in range(PIECE):
        on = np.flatnonzero(length > i)
        step = (product[on].reshape(-1, k) @ t).reshape(-1, k, k) * e[start[on] + i][:, None, :]
        product[on] = step / step.sum((1, 2), keepdims=True)
    inward, outward = np.full((m, k), 1.0 / k), np.ones((m, k))
    for j in range(1, int(pieces.max())):
        at = base[:-1][pieces > j] + j
        v = np.einsum("mi,mij->mj", inward[at - 1], product[at - 1])
        inward[at] = v / v.sum(1, keepdims=True)
    for j in range(int(pieces.max()) - 2, -1, -1):
        at = base[:-1][pieces > j + 1] + j
        v = np.einsum("mij,mj->mi", product[at + 1], outward[at + 1])
        outward[at] = v / v.sum(1, keepdims=True)
    post = np.empty((n, k))
    now = inward
    for i in range(PIECE):
        on = np.flatnonzero(length > i)
        v = (now[on] @ t) * e[start[on] + i]
        v /= v.sum(1, keepdims=True)
        now[on] = v
        post[start[on] + i] = v
    now = outward
    for i in range(PIECE - 1, -1, -1):
        on = np.flatnonzero(length > i)
        post[start[on] + i] *= now[on]
        v = (now[on] * e[start[on] + i]) @ t.T
        now[on] = v / v.sum(1, keepdims=True)
    return post / post.sum(1, keepdims=True)


def classify(texts: pa.Array, i: int, j: int, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of rows i..j of a `plain` array."""
    w = _pieces(words(texts, i, j))
    langs, score = ["und"] * (j - i), np.zeros(j - i)
    if not model.languages or not len(w.code):
        return langs, score
    _, at, back = np.unique(w.code, return_index=True, return_inverse=True)
    raw = w.data.tobytes()
    vocabulary = [_lower(raw[a:b].decode()) for a, b in zip(w.begin[at].tolist(), w.end[at].tolist(), strict=True)]
    lettered = np.array([any(map(str.isalpha, v)) for v in vocabulary])[back]
    post = marginals(emissions(vocabulary, model)[back], w.first, model.moves) * lettered[:, None]
    doc = w.doc()
    sums = np.stack([np.bincount(doc, weights=post[:, c], minlength=j - i) for c in range(len(model.languages))], axis=1)
    n = np.bincount(doc, weights=lettered, minlength=j - i)
    best = sums.argmax(1)
    some = n > 0
    score[some] = np.clip(sums[np.arange(j - i), best][some] / n[some], 0, 1)
    for d in np.flatnonzero(some):
        langs[d] = model.languages[best[d]]
    return langs, score


def sample(docs: DataFrame, label: str, per_label: int, words_each: int) -> list[tuple[str, str]]:
    """At most per_label texts of each label, spread over all rows by a hash, as (text, label)."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}  # a row for each label
    if not counts:
        return []
    u = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for v, n in counts.items() for x in (F.lit(v), F.lit(min(1.0, 1.3 * per_label / n + 20 / n)))])
    taken = known.where(u < share[F.col(label)]).select(u.alias("u"), F.array_join(F.slice(F.split("text", r"[\x20\x09-\x0D]+"), 1, words_each), " ").alias("words"), label).distinct()  # repeated rows count once
    rows = sorted(map(tuple, taken.collect()))  # bounded: per_label and words_each
    out, had = [], dict.fromkeys(counts, 0)
    for _, text, value in rows:
        if had[value] < per_label:
            had[value] += 1
            out.append((text, value))
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, words_each: int = WORDS_EACH) -> Model:
    model = train(sample(docs, "lang", per_language, words_each))
    release()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; all columns of docs stay, theirs of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    at = names.index("text")

    @tidied
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(at))
            langs: list[str] = []
            scores: list[float] = []
            for i, j in chunks(texts):
                one, two = classify(texts, i, j, shared.value)
                langs += one
                scores += two.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(label, schema)


def predict(docs: DataFrame) -> DataFrame:
    """Learns from the learnable rows of docs and labels all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.select("doc_id", "text", "lang").where(learnable(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
