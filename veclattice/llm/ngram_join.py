"""N-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each distinct shingle set (documents with
equal sets are one row, told apart by 128 bits and named by 64 of them) and a
column for each shingle code.  The product of the matrix with itself holds the
overlap of every two sets; only blocks of it are made that can still reach the
threshold:

* Columns are ordered by estimated frequency, rarest first (a count sketch of
  bounded size; any order is exact, a good one is cheap).  Two sets that link
  share one of their first n - ceil(t n) + 1 columns, so this block of columns
  is multiplied first.
* Of two rows one of which has no first column of more than COMMON rows, all
  shared first columns are rare; these are multiplied cell by cell.  The overlap
  over the block is accumulated for each pair, and pairs are discarded whose
  overlap can't reach the bound that follows from their sizes even if the rest
  of the smaller row were shared.
* Two rows with common first columns both are compared by blocks of columns:
  a hash deals all columns over parts, more parts than two sets of these sizes
  may differ in columns, so that sets that link have some part in common to the
  last column.  A part of few columns is left out, as there are enough others
  (rows of too many such parts are dealt anew, at last by their first columns).
  The parts that two rows have in common are counted and pairs below the count
  that their sizes ask for discarded.  Rows that share a passage meet in a part
  only where the rest of both puts nothing into it: rarely at 90 percent, but
  now and then at 80, where parts have a column or two.
* Parts that more than COMMON rows have in common make families.  A family's rows are
  dealt over blocks of bounded size by their set size and a hash, and each two
  blocks whose sizes can link are multiplied as matrices, COLUMNS columns at a
  time; rows leave as soon as no pair of theirs can reach its bound.  A block
  gives the number of links of each row and a tree of what it connects, never
  its pairs, and no task holds more than two blocks however large a family is.
* All pairs that are left are held against the threshold exactly.

A family of m sets takes about m * m * size / BLOCK_CELLS cells through the
shuffle.  A row of n columns has about n / 7 parts of three columns or more at
90 percent and n / 4 of one or more at 80; where sets are too small or the
threshold too low (below about 75) for parts, rows go by their first columns.
Columns that most documents have are in no block, being the last of each row.

Defined results: null and empty texts have an empty set, link with nothing
and are their own component; rows without a doc_id take part, their component
is the least doc_id reachable or null; repeated rows each get their row;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut
from .graph import components
from .textcodes import BASES, chunks, mix, plain, spans, tidied, U64, windows, words

#: Cells of the count sketch: one for so many shingles, within these powers of two.
LOAD, LEAST_BITS, MOST_BITS = 64, 16, 26
SKETCH_BLOCK_BITS = 16
#: Bits of the filter that picks the texts to be verified; a full filter only lets more through.
FILTER_BITS = 26
#: Columns of more rows than this are common, parts of more rows make families; cells and rows of a block of a family, and columns that two blocks multiply at a time.
COMMON, BLOCK_CELLS, BLOCK_ROWS, COLUMNS = 16, 150_000, 400, 4096
#: A part has so many columns or more, if sets are large enough for it; so many times a row is dealt anew.
PART_COLUMNS, DEALS = 4, 3


def shingle_sets(texts: pa.Array, i: int, j: int, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle codes of rows i..j."""
    w = words(texts, i, j, lower=True)
    start, code = windows(w, n)
    edge = np.searchsorted(start, w.first)
    out = []
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = spans(w.code, w.first[short], w.first[short + 1], BASES[0])
    short_code = dict(zip(short.tolist(), whole, strict=True))
    for d in range(j - i):
        out.append(np.array([short_code[d]], dtype=U64) if d in short_code else np.unique(code[edge[d] : edge[d + 1]]))
    return out


@tidied
def _sketch(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(1 << bits, dtype=np.uint32)
    for batch in batches:
        texts = plain(batch.column(0))
        for i, j in chunks(texts):
            _, code = windows(words(texts, i, j, lower=True), n)
            cell, count = np.unique(code >> U64(64 - bits), return_counts=True)
            sums[cell.astype(np.int64)] += count.astype(np.uint32)
    if sums.any():
        pack = zstandard.ZstdCompressor(level=1)
        parts = sums.reshape(-1, 1 << min(bits, SKETCH_BLOCK_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int64()), pa.array([pack.compress(p.tobytes()) for p in parts], pa.binary())], ["block", "body"])


@tidied
def _sketch_sum(batches: Iterator[pa.RecordBatch], bits: int, last: bool) -> Iterator[pa.RecordBatch]:
    pack, opened = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            new = np.frombuffer(opened.decompress(body.as_py(), max_output_size=4 << SKETCH_BLOCK_BITS), dtype=np.uint32)
            old = sums.get(name)
            sums[name] = new.copy() if old is None else np.minimum(old.astype(np.uint64) + new, 2**32 - 1).astype(np.uint32)
    bodies = [np.log2(v + 1.0).astype(np.uint8).tobytes() if last else pack.compress(v.tobytes()) for v in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bodies, pa.binary())], ["block", "body"])


def _frequency(docs: DataFrame, n: int) -> np.ndarray:
    """Floor of log2 of the estimated count of each cell of shingles; its size is bounded."""
    (total,) = docs.agg(F.sum(F.octet_length("text"))).first()
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2((total or 0) / 6 / LOAD + 1)))))
    parts = docs.select("text").mapInArrow(lambda b: _sketch(b, n, bits), "block long, body binary").withColumn("part", F.spark_partition_id() % 64)
    parts = parts.repartition("block", "part").select("block", "body").mapInArrow(lambda b: _sketch_sum(b, bits, False), "block long, body binary")
    merged = parts.repartition("block").mapInArrow(lambda b: _sketch_sum(b, bits, True), "block long, body binary")
    out = np.zeros(1 << bits, dtype=np.uint8)
    width = 1 << min(bits, SKETCH_BLOCK_BITS)
    for name, body in merged.collect():  # bounded: 2**MOST_BITS bytes
        out[name * width : (name + 1) * width] = np.frombuffer(body, dtype=np.uint8)
    return out


def _signature(s: np.ndarray) -> tuple[np.int64, np.int64]:
    return np.sum(mix(s ^ U64(0xA5A5)), dtype=U64).astype(np.int64), np.bitwise_xor.reduce(mix(s + U64(0x5A5A5A5A))).astype(np.int64)


@tidied
def _rows(batches: Iterator[pa.RecordBatch], n: int, percent: int, frequency) -> Iterator[pa.RecordBatch]:
    cells = frequency.value
    shift = U64(64 - (len(cells).bit_length() - 1))
    for batch in batches:
        texts = plain(batch.column(1))
        sizes, s1s, s2s, prefixes = [], [], [], []
        for i, j in chunks(texts):
            for s in shingle_sets(texts, i, j, n):
                if not len(s):
                    sizes.append(0), s1s.append(None), s2s.append(None), prefixes.append(None)
                    continue
                keep = len(s) - -(-percent * len(s) // 100) + 1
                rank = (cells[(s >> shift).astype(np.int64)].astype(U64) << U64(58)) | (s >> U64(6))
                s1, s2 = _signature(s)
                sizes.append(len(s)), s1s.append(s1), s2s.append(s2)
                prefixes.append(s[np.argsort(rank, kind="stable")[:keep]].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(s1s, pa.int64()), pa.array(s2s, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "name", "n", "s1", "s2", "prefix"])


@tidied
def _texts(batches: Iterator[pa.RecordBatch], n: int, wanted) -> Iterator[pa.RecordBatch]:
    """Signature and compressed text of the sets that the filter lets through, once a batch."""
    bits = wanted.value
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = plain(batch.column(0))
        found: dict[tuple[int, int], bytes] = {}
        for i, j in chunks(texts):
            for d, s in enumerate(shingle_sets(texts, i, j, n), i):
                if len(s):
                    key = tuple(map(int, _signature(s)))
                    at = (key[0] ^ key[1]) & ((1 << FILTER_BITS) - 1)
                    if key not in found and bits[at >> 3] >> (at & 7) & 1:
                        found[key] = pack.compress(texts[d].as_py().encode())
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.binary())], ["s1", "s2", "body"])


@tidied
def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    opened = zstandard.ZstdDecompressor()
    last_id, last = None, None

    def sets(bodies: list[bytes]) -> list[np.ndarray]:
        texts = plain(pa.array([opened.decompress(x).decode() for x in bodies], pa.large_string()))
        return [s for i, j in chunks(texts) for s in shingle_sets(texts, i, j, n)]

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            a, x, y = part.column(0).to_pylist(), part.column(2).to_pylist(), sets(part.column(3).to_pylist())
            on = []
            for ai, xi, yi in zip(a, x, y, strict=True):
                if ai != last_id:
                    last_id, last = ai, sets([xi])[0]
                both = len(np.intersect1d(last, yi, assume_unique=True))
                on.append(100 * both >= percent * (len(last) + len(yi) - both))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in (0, 1, 4, 5)], ["a", "b", "m", "n"]).filter(pa.array(on, pa.bool_()))


def _bodies(docs: DataFrame, classes: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, n, size and body, a compressed text, of the sets that nodes name."""
    keys = cut(classes.select("node", "s1", "s2", "n", "size").join(nodes.distinct(), "node"))
    at = F.col("s1").bitwiseXOR(F.col("s2")).bitwiseAND((1 << FILTER_BITS) - 1)
    marks = keys.select(F.shiftright(at, 5).alias("w"), F.expr("shiftleft(1L, cast((s1 ^ s2) & 31 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()  # bounded: a row for 32 bits
    bits = np.zeros(1 << (FILTER_BITS - 5), dtype="<u4")
    bits[marks["w"].to_numpy(dtype=np.int64)] = marks["m"].to_numpy(dtype=np.int64).astype(np.uint32)
    wanted = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))
    texts = docs.select("text").mapInArrow(lambda b: _texts(b, n, wanted), "s1 long, s2 long, body binary")
    return cut(texts.join(keys, ["s1", "s2"]).groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("size").alias("size"), F.any_value("body").alias("body")))


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with the name of each (a hash of the text), their distinct sets with the node, documents and first columns of each, and a row with the set of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("name"))
    frequency = spark.sparkContext.broadcast(_frequency(docs, n))
    schema = "doc_id long, name long, n long, s1 long, s2 long, prefix array<long>"
    # two passes over the texts: columns are kept once, for each set, and not for each row too
    full = docs.mapInArrow(lambda b: _rows(b, n, percent, frequency), schema)
    classes = full.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.any_value("prefix").alias("prefix"))
    classes = cut(classes.withColumn("node", F.col("s1")))
    rows = cut(docs.mapInArrow(lambda b: _rows(b, n, 100, frequency), schema).drop("prefix"))
    return docs, classes, rows


def _cells(classes: DataFrame) -> DataFrame:
    """h, met, head, node and n: the cells of the first columns that more than one row has; met: the column's rows, head: the least of them."""
    cells = classes.select("node", "n", F.explode("prefix").alias("h"))
    met = cells.groupBy("h").agg(F.count(F.lit(1)).alias("met"), F.min("node").alias("head")).where("met > 1")
    return cut(cells.join(met, "h").select("h", "met", "head", "node", "n"))


def _pairs(cells: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) of rows that their first columns don't rule out; of hot rows, which have common columns, one at most is in a pair."""
    rare = cells.where(F.col("met") <= COMMON).join(hot.withColumn("hot", F.lit(True)), "node", "left")
    sizes = f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)"
    meet = F.expr(f"l.h = r.h and l.node < r.node and {sizes} and (l.hot is null or r.hot is null)")
    # a row that is not hot shares rare columns only: the count is the whole overlap of their first columns
    made = rare.alias("l").join(rare.alias("r"), meet).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.n").alias("m"), F.col("r.n").alias("n"))
    pairs = made.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"), F.any_value("m").alias("m"), F.any_value("n").alias("n"))
    # of the row whose first columns end first, no column behind them has been counted
    rest = F.expr(f"greatest(ceil({percent} * m / 100), ceil({percent} * n / 100)) - 1")
    return cut(pairs.where((100 + percent) * (F.col("overlap") + rest) >= percent * (F.col("m") + F.col("n"))).select("a", "b"))


def _width(percent: int) -> float:
    """Sets that link have sizes in the same step of this width, by logarithm, or in neighbouring ones."""
    return max(float(np.log(100 / percent)), 1e-6) * 1.0001


@lru_cache(maxsize=4096)
def dealing(step: int, percent: int) -> tuple[int, int, int]:
    """For pairs whose larger set is in a step: the number of parts, the least columns of a part, and how many smaller parts are allowed; no parts, if there are too few columns."""
    low, high = np.exp((step - 1) * _width(percent)), int(np.exp((step + 1) * _width(percent))) + 1
    apart = (100 - percent) * 2 * high // (100 + percent)
    if apart == 0:
        return 1, 1, 0
    for least in range(PART_COLUMNS, 0, -1):
        for parts in range(apart + 1, 2 * apart + 16, max(1, apart // 64)):
            mean = max(low, 1.0) / parts
            few = parts * np.exp(-mean) * sum(mean**i / factorial(i) for i in range(least))
            if parts - apart - 1 >= few + 1.5 * np.sqrt(few):
                return parts, least, parts - apart - 1
    return 0, 0, 0


def parts(s: np.ndarray, step: int, deal: int, count: int, least: int) -> tuple[np.ndarray, int]:
    """Codes of the parts of a set, one for all columns of a part, and the number of parts of fewer than least columns, which have none."""
    x = mix(s ^ U64(0x9E3779B97F4A7C15 * (deal + 1) % 2**64))
    part = ((x >> U64(32)) * U64(count)) >> U64(32)
    order = np.argsort(part, kind="stable")
    name, first, size = np.unique(part[order], return_index=True, return_counts=True)
    code = mix(np.add.reduceat(mix(x + U64(deal))[order], first) ^ mix(name + U64((step * DEALS + deal) << 32)))
    return code[size >= least].view(np.int64), count - int((size >= least).sum())


@tidied
def _dealt(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The parts of each row, for pairs whose larger set is in its own step and for those where it is in the next."""
    opened = zstandard.ZstdDecompressor()
    names = ["node", "n", "step", "larger", "deal", "parts", "few", "codes"]
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = plain(pa.array([opened.decompress(x).decode() for x in part.column(1).to_pylist()], pa.large_string()))
            sets = [s for i, j in chunks(texts) for s in shingle_sets(texts, i, j, n)]
            rows = []
            for node, s in zip(part.column(0).to_pylist(), sets, strict=True):
                step = int(np.log(len(s)) / _width(percent))
                for larger in (step, step + 1):
                    count, least, allowed = dealing(larger, percent)
                    few = allowed + 1
                    for deal in range(DEALS if count else 0):
                        codes, few = parts(s, larger, deal, count, least)
                        rows.append((node, len(s), step, larger, deal, count, few, codes))
                        if few <= allowed:
                            break
                    if few > allowed:  # by its first columns
                        rows.append((node, len(s), step, larger, DEALS, count, None, None))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if name == "codes" else pa.int64()) for c, name in zip(columns, names, strict=True)], names)


def _families(bodies: DataFrame, hot: DataFrame, cells: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The families (node, family) of hot rows, and the pairs(a, b) of hot rows outside of one that their parts don't rule out."""
    dealt = cut(bodies.join(hot, "node").select("node", "body").mapInArrow(lambda b: _dealt(b, n, percent), "node long, n long, step long, larger long, deal long, parts long, few long, codes array<long>"))
    way = (F.col("larger") * (DEALS + 1) + F.col("deal")).alias("way")
    first = dealt.where("codes is null").select("node", way, "larger").join(cells.select("node", "h"), "node").select(F.xxhash64("h", "larger").alias("h"), "node", "way")
    keys = dealt.select(F.explode("codes").alias("h"), "node", way).unionByName(first)
    met = keys.groupBy("h").agg(F.count(F.lit(1)).alias("met"), F.min("node").alias("head")).where("met > 1")
    shared = cut(keys.join(met, "h").select("h", "met", "head", "node", "way"))
    common = shared.where((F.col("met") > COMMON) & (F.col("node") != F.col("head")))
    families = cut(components(common.select(F.col("node").alias("a"), F.col("head").alias("b"))).select("node", F.col("label").alias("family")))
    facts = dealt.select("node", way, "n", "step", "larger", "parts", "few").join(families, "node", "left")
    rare = shared.where(F.col("met") <= COMMON).join(facts, ["node", "way"])
    sizes = f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)"
    meet = F.expr(f"l.h = r.h and l.way = r.way and l.node < r.node and l.larger = greatest(l.step, r.step) and {sizes} and not coalesce(l.family = r.family, false)")
    made = rare.alias("l").join(rare.alias("r"), meet)
    # rows of different families share no common part: the count is that of all parts they have in common
    apart = f"floor((100 - {percent}) * (l.n + r.n) / (100 + {percent}))"
    made = made.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), "l.way", F.expr(f"l.parts - {apart} - least(l.few, r.few)").alias("least"))
    pairs = made.groupBy("a", "b", "way").agg(F.count(F.lit(1)).alias("alike"), F.any_value("least").alias("least"))
    return families, cut(pairs.where("least is null or alike >= least").select("a", "b").distinct())


def _blocks(bodies: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """The rows of families once for each two blocks that they take part in: family, the blocks (qa, ka) and (qb, kb), node, n, size, body, q and k."""
    rows = families.join(bodies, "node").withColumn("q", F.floor(F.log("n") / _width(percent)))
    steps = rows.groupBy("family", "q").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_CELLS, F.count(F.lit(1)) / BLOCK_ROWS)).alias("blocks"))
    near = steps.select("family", "blocks", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("d"), "q").withColumn("q", F.col("q") + F.col("d"))
    near = near.groupBy("family", "q").agg(*[F.coalesce(F.max(F.when(F.col("d") == d, F.col("blocks"))), F.lit(0)).alias(name) for d, name in ((1, "below"), (0, "own"), (-1, "above"))])
    rows = rows.join(near, ["family", "q"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("own")))
    some = "if({0} > 0, transform(sequence(0L, {0} - 1), x -> named_struct('qa', {1}, 'ka', {2}, 'qb', {3}, 'kb', {4})), array())".format
    met = F.expr(f"concat({some('own', 'q', 'least(x, k)', 'q', 'greatest(x, k)')}, {some('above', 'q', 'k', 'q + 1', 'x')}, {some('below', 'q - 1', 'x', 'q', 'k')})")
    return rows.select("family", "node", "n", "size", "body", "q", "k", F.explode(met).alias("t")).select("family", "t.*", "node", "size", "body", "q", "k")


def product(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a and b reach the threshold: their overlaps, accumulated over blocks of columns."""
    na, nb = np.array([len(s) for s in a], dtype=np.int64), np.array([len(s) for s in b], dtype=np.int64)
    out = np.zeros((len(a), len(b)), dtype=bool)
    need = percent * (na[:, None] + nb[None, :])
    column = np.unique(np.concatenate([*a, *b, np.zeros(0, dtype=U64)]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
    mine = row < len(a)
    width = int(column.max(initial=-1)) + 1
    # columns that one side alone has add nothing
    both = (np.bincount(column[mine], minlength=width) > 0) & (np.bincount(column[~mine], minlength=width) > 0)
    on = both[column]
    column, row = (np.cumsum(both) - 1)[column[on]], row[on]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    left = np.bincount(row, minlength=len(a) + len(b))
    overlap = np.zeros((len(a), len(b)), dtype=np.int64)
    i, j = np.arange(len(a)), np.arange(len(b))  # rows that still have a pair within its bound
    width = int(both.sum())
    for at in range(0, width, COLUMNS):
        alive = (100 + percent) * (overlap[np.ix_(i, j)] + np.minimum(left[i][:, None], left[len(a) + j][None, :])) >= need[np.ix_(i, j)]
        i, j = i[alive.any(1)], j[alive.any(0)]
        if not len(i) or not len(j):
            return out
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        left -= np.bincount(row[lo:hi], minlength=len(left))
        cells = np.zeros((len(left), min(COLUMNS, width - at)), dtype=np.float32)
        cells[row[lo:hi], column[lo:hi] - at] = 1
        overlap[np.ix_(i, j)] += (cells[i] @ cells[len(a) + j].T).astype(np.int64)
    out[np.ix_(i, j)] = ((100 + percent) * overlap >= need)[np.ix_(i, j)] & (overlap[np.ix_(i, j)] > 0)
    return out


def _connected(links: np.ndarray) -> np.ndarray:
    """Of each row and then each column of links the least index among those it is connected with."""
    n = len(links)
    rows, columns = np.arange(n), np.arange(n, n + links.shape[1])
    none = n + links.shape[1]
    while True:
        new = np.minimum(rows, np.where(links, columns[None, :], none).min(1, initial=none))
        after = np.minimum(columns, np.where(links, new[:, None], none).min(0, initial=none))
        if (new == rows).all() and (after == columns).all():
            return np.concatenate([rows, columns])
        rows, columns = new, after


def _multiplied(table: pa.Table, n: int, percent: int, every: bool) -> pa.Table:
    """node, linked and least of the rows of two blocks that link: documents it links with, and a row it is connected with; every: or all links (a, b) as rows."""
    opened = zstandard.ZstdDecompressor()
    texts = plain(pa.array([opened.decompress(x).decode() for x in table["body"].to_pylist()], pa.large_string()))
    sets = [s for i, j in chunks(texts) for s in shingle_sets(texts, i, j, n)]
    node, size = table["node"].to_numpy(), table["size"].to_numpy()
    q, k, qa, ka, qb, kb = (table[c].to_numpy() for c in ("q", "k", "qa", "ka", "qb", "kb"))
    a, b = np.flatnonzero((q == qa) & (k == ka)), np.flatnonzero((q == qb) & (k == kb))
    links = product([sets[x] for x in a], [sets[x] for x in b], percent)
    same = len(table) > 0 and (qa[0], ka[0]) == (qb[0], kb[0])
    if same:
        links &= ~np.eye(len(a), dtype=bool)
    if every:
        x, y = np.nonzero(np.triu(links) if same else links)
        return pa.table([pa.array(v) for v in (node[a[x]], node[b[y]])], ["a", "b"])
    counts = np.concatenate([links @ size[b], (size[a] @ links) * (not same)])
    names, on = np.concatenate([node[a], node[b]]), np.concatenate([links.any(1), links.any(0)])
    return pa.table([pa.array(v[on]) for v in (names, counts, names[_connected(links)])], ["node", "linked", "least"])


def _joined(docs: DataFrame, classes: DataFrame, n: int, percent: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links of pairs as (a, b, m, n) with the documents of each, and of families as (node, linked, least), or, if every, as (a, b)."""
    cells = _cells(classes)
    hot = cut(cells.where(F.col("met") > COMMON).select("node").distinct())
    pairs = _pairs(cells, hot, percent)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(hot)
    bodies = _bodies(docs, classes, nodes, n)
    families, further = _families(bodies, hot, cells, n, percent)
    pairs = pairs.unionByName(further)
    x = bodies.select(F.col("node").alias("a"), F.col("body").alias("x"), F.col("size").alias("m"))
    y = bodies.select(F.col("node").alias("b"), F.col("body").alias("y"), F.col("size").alias("n"))
    schema = "a long, b long, m long, n long"
    single = cut(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y", "m", "n").mapInArrow(lambda b: _verify(b, n, percent), schema))
    dealt = _blocks(bodies, families, percent).groupBy("family", "qa", "ka", "qb", "kb")
    return single, cut(dealt.applyInArrow(lambda t: _multiplied(t, n, percent, every), "a long, b long" if every else "node long, linked long, least long"))


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, name, n, component, group (a name of its component), equal and linked of every row."""
    docs, classes, rows = _classes(docs, n, percent)
    single, many = _joined(docs, classes, n, percent)
    tree = single.select("a", "b").unionByName(many.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = single.select(F.col("a").alias("node"), F.col("n").alias("linked")).unionByName(single.select(F.col("b").alias("node"), F.col("m").alias("linked"))).unionByName(many.select("node", "linked"))
    counts = counts.groupBy("node").agg(F.sum("linked").alias("linked"))
    labels = components(tree)
    low = labels.join(classes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("low"))
    labels = cut(labels.join(low, "label").join(counts, "node"))
    named = classes.select("s1", "s2", "node", "least", "size").join(labels, "node", "left")
    component = F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("low"))
    named = named.select("s1", "s2", component.alias("component"), F.coalesce("label", "node").alias("group"), "size", "linked")
    out = rows.join(named, ["s1", "s2"], "left")
    none = F.col("n") == 0
    return out.select("doc_id", "name", "n", F.when(none, F.col("doc_id")).otherwise(F.col("component")).alias("component"), "group", F.when(none, 0).otherwise(F.col("size") - 1).alias("equal"), F.coalesce("linked", F.lit(0)).alias("linked"))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_equal and n_links of every row; sets link at a Jaccard similarity of percent / 100.

    n_equal counts the other rows of the same set, n_links the rows of other
    sets that it links with.
    """
    return _components(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("equal").alias("n_equal"), F.col("linked").alias("n_links"))


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, n_shingles and class_id, and all links(a, b) of classes.

    A class is the documents of one set, its id 64 bits of the set's signature.
    Null and empty texts have no class.  A family of near copies has as many
    rows here as it has links; `jaccard_join` counts them without making them.
    """
    docs, classes, rows = _classes(docs, n, percent)
    single, many = _joined(docs, classes, n, percent, every=True)
    members = rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("s1").alias("class_id"))
    links = single.select("a", "b").unionByName(many)
    return members, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one of the least doc_id.

    Of rows of that doc_id the one of least text hash stays, once if it is
    repeated; a component without any doc_id keeps its row of least text hash.
    Documents without a word are alone in their component and stay.
    """
    rows = cut(_components(docs, n, percent).select("doc_id", "name", "n", "group"))
    first = rows.where("n > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("first"))
    kept = first.select("first.doc_id", "first.name").unionByName(rows.where("n = 0").select("doc_id", "name").distinct())
    kept = kept.select(F.col("doc_id").alias("k_id"), F.col("name").alias("k_name"))
    # the other columns travel together, so that none of them clashes
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), "text", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("name"))
    here = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("name") == F.col("k_name"))
    out = whole.join(kept, here, "left_semi")
    if not rows.where("n > 0").groupBy("doc_id", "name").count().where("count > 1").isEmpty():
        lettered = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
        out = out.where(lettered).dropDuplicates(["id", "text"]).unionByName(out.where(~lettered))
    return out.select(*["text" if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
