"""Substring dedup with a count-min prefilter.

A window is `size` consecutive words of one document.  Every word covered by
a window whose word sequence also starts anywhere else is removed.

1. Each window is represented by the seed (a shorter run of words) of least
   code inside it, so equal windows have equal representatives at equal
   offsets.  A count-min sketch counts the places of representatives: each
   block of rows makes a sparse sketch, the sketches are merged by ranges of
   cells, and one bit a cell says "two or more".  A window that occurs twice
   has a representative at two places, so the sketch never estimates it below
   two: the prefilter loses none.
2. A second pass takes only windows estimated repeated and groups them
   exactly by a 96-bit code.  A block of rows sends one row for each
   distinct window, whatever its count, so a window in a third of all
   documents costs one row a block and not one a document.
3. Documents take the starts of their repeated windows and drop what they cover.

Defined results: null and empty texts have no words, nothing removed and the
hash of the empty string; texts shorter than a window keep all words;
repeated rows (also of one doc_id) are documents of their own; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textcodes import BASES, chunks, mix, plain, spans, tidied, U64, windows, words

WINDOW = 35
#: Words of a seed; each window of 35 words holds 18 seeds.
SEED = 18
ROWS = 2
#: Cells of a row of the sketch for each seed place expected, and their bounds as powers of 2.
SPARSE, LEAST_BITS, MOST_BITS = 8, 20, 29
#: A larger input takes so many sketches, each of its share of the seeds; beyond, cells fill up and more windows go to the second pass.
MOST_SLICES = 8
BLOCK_BITS = 18
#: Text that one block of rows may hold at a time.
BLOCK_BYTES = 24_000_000


def _row_key(docs: DataFrame) -> Column:
    """A name for each row: doc_id where it is one, else a hash of the row (equal rows may share theirs)."""
    if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
            return F.col("doc_id").cast("long")
    return F.xxhash64("doc_id", "text")


def _seeds(w, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts; the place of each window's seed; all seed places and codes."""
    at, code = windows(w, seed)
    start, _ = _starts(w, size)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=U64)
    dense = np.full(len(w.code), np.iinfo(np.uint64).max, dtype=U64)
    dense[at] = code
    least, where = dense[start].copy(), np.zeros(len(start), dtype=np.int64)
    for k in range(1, size - seed + 1):
        here = dense[start + k]
        less = here < least
        least[less] = here[less]
        where[less] = k
    return start, start + where, at, dense


def _starts(w, size: int) -> tuple[np.ndarray, None]:
    last = np.repeat(w.first[1:], np.diff(w.first))
    return np.flatnonzero(np.arange(len(w.code)) + size <= last), None


def _cells(code: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(code + U64(0x1000003 * (k + 1))) >> U64(64 - bits) for k in range(ROWS)]


def _slice(code: np.ndarray, slices: int) -> np.ndarray:
    return mix(code ^ U64(0x5851F42D4C957F2D)) % U64(slices)


@tidied
def _sketch(batches: Iterator[pa.RecordBatch], size: int, seed: int, bits: int, slices: int, one: int) -> Iterator[pa.RecordBatch]:
    """Rows of (block of cells, cells with a count, cells with two or more), compressed."""
    pack = zstandard.ZstdCompressor(level=1)
    held: list[np.ndarray] = []
    held_n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, held_n
        if held:
            code = np.concatenate(held)
            if not len(code):
                held = []
                return
            for row, cell in enumerate(_cells(code, bits)):
                cell, n = np.unique(cell, return_counts=True)
                block = (cell >> U64(min(BLOCK_BITS, bits))).astype(np.int64)
                edge = np.flatnonzero(np.diff(block, prepend=-1))
                names, bodies = [], []
                for a, b in zip(edge, [*edge[1:], len(cell)], strict=True):
                    inside = (cell[a:b] & U64((1 << min(BLOCK_BITS, bits)) - 1)).astype(np.int64)
                    marks = np.zeros((2, 1 << min(BLOCK_BITS, bits)), dtype=bool)
                    marks[0, inside] = True
                    marks[1, inside[n[a:b] > 1]] = True
                    names.append((row << 32) + int(block[a]))
                    bodies.append(pack.compress(np.packbits(marks).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], ["block", "body"])
        held, held_n = [], 0

    for batch in batches:
        texts = plain(batch.column(0))
        for i, j in chunks(texts):
            w = words(texts, i, j)
            _, rep, _, dense = _seeds(w, size, seed)
            codes = dense[np.unique(rep)]
            if slices > 1:
                codes = codes[_slice(codes, slices) == one]
            held.append(codes)
            held_n += len(codes)
            if held_n > 2_000_000:
                yield from flush()
    yield from flush()


@tidied
def _merge(batches: Iterator[pa.RecordBatch], bits: int, last: bool) -> Iterator[pa.RecordBatch]:
    """One row a block: its sketches merged; if last, only the cells with two or more."""
    pack, opened = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    width = 1 << min(BLOCK_BITS, bits)
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            new = np.frombuffer(opened.decompress(body.as_py(), max_output_size=width), dtype=np.uint8).reshape(2, -1)
            if name in sums:
                old = sums[name]
                old[1] |= new[1] | (old[0] & new[0])
                old[0] |= new[0]
            else:
                sums[name] = new.copy()
    names = list(sums)
    bodies = [sums[k][1].tobytes() if last else pack.compress(sums[k].tobytes()) for k in names]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary())], ["block", "body"])


def _sizes(docs: DataFrame, size: int, seed: int) -> tuple[int, int]:
    """Bits of a cell's number and number of slices; they follow the input up to their bounds."""
    (total,) = docs.agg(F.sum(F.octet_length("text"))).first()
    cells = SPARSE * (total or 0) / 6 * 2 / (size - seed + 2) + 1
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(cells)))))
    return bits, int(min(MOST_SLICES, np.ceil(cells / 2.0**bits)))


def _flags(docs: DataFrame, size: int, seed: int, bits: int, slices: int, one: int) -> list[np.ndarray]:
    """The merged sketch of one slice of the seeds, as packed bits."""
    sketch = docs.select("text").mapInArrow(lambda b: _sketch(b, size, seed, bits, slices, one), "block long, body binary")
    # many small sketches of one block meet in two steps, so no task reads one from each task of a large input
    step = sketch.withColumn("part", F.spark_partition_id() % 64)
    step = step.repartition("block", "part").select("block", "body").mapInArrow(lambda b: _merge(b, bits, False), "block long, body binary")
    merged = step.repartition("block").mapInArrow(lambda b: _merge(b, bits, True), "block long, body binary")
    flags = [np.zeros((1 << bits) >> 3, dtype=np.uint8) for _ in range(ROWS)]
    width = (1 << min(BLOCK_BITS, bits)) >> 3
    for name, body in merged.collect():  # bounded: ROWS * 2**MOST_BITS bits
        at = (name & 0xFFFFFFFF) * width
        flags[name >> 32][at : at + width] = np.frombuffer(body, dtype=np.uint8)
    return flags


def _estimated(code: np.ndarray, bits: int, flags: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(code), dtype=bool)
    for cell, row in zip(_cells(code, bits), flags, strict=True):
        out &= (row[(cell >> U64(3)).astype(np.int64)] >> (7 - (cell & U64(7)).astype(np.uint8))) & 1 > 0
    return out


_WINDOW_ROWS = "h long, rest long, doc long"


@tidied
def _flagged(batches: Iterator[pa.RecordBatch], size: int, seed: int, bits: int, slices: int, one: int, sketch) -> Iterator[pa.RecordBatch]:
    """Windows estimated repeated.

    h and the upper half of rest are the window's code, the lower half its
    start.  Of a window met twice in one block, one row without doc goes out
    as a witness, and the runs of its places as rows without h, with their
    length in the upper half of rest: these need no partner.
    """
    flags = sketch.value
    held: list[tuple[np.ndarray, ...]] = []
    held_bytes = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, held_bytes
        if held:
            h, h2, pos, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h))
            h, h2, pos, doc = h[order], h2[order], pos[order], doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(h)))
            many = np.repeat(n > 1, n)
            one = begin[n == 1]
            witness = begin[n > 1]
            places = np.flatnonzero(many)
            hi = h2.astype(np.int64) << 32
            places = places[np.lexsort((pos[places], doc[places]))]
            gap = np.ones(len(places), dtype=bool)
            gap[1:] = (doc[places[1:]] != doc[places[:-1]]) | (pos[places[1:]] != pos[places[:-1]] + 1)
            run = np.flatnonzero(gap)
            length = np.diff(np.append(run, len(places)))
            run = places[run]
            hs = np.concatenate([h[one], h[witness], np.zeros(len(run), dtype=U64)]).view(np.int64)
            rest = np.concatenate([hi[one] | pos[one], hi[witness], (length << 32) | pos[run]])
            docs = np.concatenate([doc[one], np.zeros(len(witness), dtype=np.int64), doc[run]])
            a, b = len(one), len(one) + len(witness)
            no_h, no_doc = np.zeros(len(hs), dtype=bool), np.zeros(len(hs), dtype=bool)
            no_h[b:], no_doc[a:b] = True, True
            for i in range(0, len(hs), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(hs[s], mask=no_h[s]), pa.array(rest[s]), pa.array(docs[s], mask=no_doc[s])], ["h", "rest", "doc"])
        held, held_bytes = [], 0

    for batch in batches:
        texts = plain(batch.column(1))
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in chunks(texts):
            w = words(texts, i, j)
            start, rep, _, dense = _seeds(w, size, seed)
            if len(start):
                place, back = np.unique(rep, return_inverse=True)
                code = dense[place]
                often = _estimated(code, bits, flags)
                if slices > 1:
                    often &= _slice(code, slices) == one
                start = start[often[back]]
                doc = w.doc()
                d = doc[start]
                h = spans(w.code, start, start + size, BASES[0])
                h2 = (spans(w.code, start, start + size, BASES[1]) >> U64(33)).astype(np.int64)
                held.append((h, h2, start - w.first[d], keys[i + d]))
            held_bytes += len(w.data)
            if held_bytes > BLOCK_BYTES:
                yield from flush()
    yield from flush()


@tidied
def _remove(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = plain(batch.column(1))
        starts = batch.column(2)
        offsets = starts.offsets.to_numpy()
        values = starts.values.to_numpy(zero_copy_only=False)
        n_words, n_removed, kept = [], [], []
        for i, j in chunks(texts):
            w = words(texts, i, j)
            covers = np.zeros(len(w.code) + 1, dtype=np.int64)
            for d in range(i, j):
                if starts[d].is_valid:
                    runs = np.unique(values[offsets[d] : offsets[d + 1]])
                    s = (runs & 0xFFFFFFFF) + w.first[d - i]
                    np.add.at(covers, s, 1)
                    np.add.at(covers, s + (runs >> 32) - 1 + size, -1)
            stays = np.cumsum(covers[:-1]) == 0
            raw = w.data.tobytes()
            for d in range(j - i):
                a, b = w.first[d], w.first[d + 1]
                at = a + np.flatnonzero(stays[a:b])
                n_words.append(int(b - a))
                n_removed.append(int(b - a) - len(at))
                kept.append(b" ".join([raw[x:y] for x, y in zip(w.begin[at].tolist(), w.end[at].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame, size: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of docs."""
    if not 1 <= seed <= size:
        raise ValueError("a seed is at least a word and at most a window")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    bits, slices = _sizes(docs, size, seed)
    key = _row_key(docs)
    found = None
    for one in range(slices):
        sketch = spark.sparkContext.broadcast(_flags(docs, size, seed, bits, slices, one))
        part = docs.select(key.alias("key"), "text").mapInArrow(lambda b, one=one, sketch=sketch: _flagged(b, size, seed, bits, slices, one, sketch), _WINDOW_ROWS)
        found = part if found is None else found.unionByName(part)
    # a place without code is in no group; it goes where its hash sends it
    group = Window.partitionBy("h", F.shiftright("rest", 32), F.when(F.col("h").isNull(), F.xxhash64("doc", "rest")))
    repeated = found.withColumn("met", F.count(F.lit(1)).over(group)).where("doc is not null and (h is null or met > 1)")
    runs = F.when(F.col("h").isNull(), F.col("rest")).otherwise(F.col("rest").bitwiseAND(0xFFFFFFFF).bitwiseOR(1 << 32))
    starts = repeated.select("doc", runs.alias("start")).groupBy("doc").agg(F.collect_list("start").alias("starts"))
    whole = docs.withColumn("doc", key).join(starts, "doc", "left")
    return whole.select("doc_id", "text", "starts").mapInArrow(lambda b: _remove(b, size), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
