"""Ranked lexical search over a document FP-tree.

A document keeps of its terms only those that some item asks for: its
restricted vector.  Each task orders the terms of its documents' vectors by
how many documents hold them and puts blocks of BLOCK documents in a prefix
tree; documents share the path of the terms they begin with alike, equal
documents share a leaf.  Every node knows, for each child, the greatest count
of each term below it and the least m (the length norm), so the score of what
lies below has an upper bound for any item.  Each item then walks the tree
depth-first, best child first, and leaves out subtrees whose bound does not
reach its k-th score so far.  A leaf's bound is its documents' score.  The k
best of each task meet in a ranking by item; nothing is dropped otherwise.

Items are collected in blocks of at most ITEM_BYTES of text and travel with
the function; larger sets of items take several passes.  Restricted vectors
are written once to the shared folder and read for the counts (N, L, df) and
for the search.

Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
lower-cased.  w is floor(1000 ln((2N+2)/(2df+1))) of a term held by df of N
documents with terms, m is 25 + (75 n N) div L of a document with n of all L
terms, and a term that occurs tf times scores w ((10^9 tf) div (1000 tf + 8 m)).

Defined results: null and empty texts and items have no terms; rows of one
item_id are one item with the terms of all its different texts; equal scores
go by doc_id, a null one last; each repeated row of a document is ranked;
items without hits have no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of one tree, bytes of items that are searched at a time, and children of a node whose bounds are summed as arrays.
BLOCK, ITEM_BYTES, WIDE = 4096, 8_000_000, 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text, in order."""
    return text.translate(_FOLD).split(b" ") if text else []


def counted(text: bytes) -> Counter[bytes]:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


# -- restricted vectors


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), and the terms of the vocabulary in it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, times = [], [], []
            for text in batch.column(1):
                count = counted(text.as_py() or b"")
                n.append(count.total())
                own = [(i, count[t]) for t in count if (i := vocabulary.get(t)) is not None]
                found.append([i for i, _ in own])
                times.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gain(tf: int, m: int) -> int:
    """What a term with tf occurrences in a document of norm m scores, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


# -- the tree


class Leaf:
    """Documents of one vector and norm; only the k of least doc_id can be among the k best."""

    __slots__ = ("ids", "least", "m", "most")

    def __init__(self, vector: dict[int, int], m: int, ids: list):
        self.most, self.m, self.ids = vector, m, ids
        self.least = ids[0]


class Node:
    """A shared path's end: its children, and for each term the children that hold it with their gains at best."""

    __slots__ = ("children", "least", "leasts", "m", "most", "places")

    def __init__(self, children: list):
        self.children = children
        self.m = min(c.m for c in children)
        self.leasts = [c.least for c in children]
        self.least = min(self.leasts)
        self.most: dict[int, int] = {}
        self.places: dict[int, list] = {}
        for k, child in enumerate(children):
            for term, tf in child.most.items():
                self.places.setdefault(term, []).append((k, gain(tf, child.m)))
                if tf > self.most.get(term, 0):
                    self.most[term] = tf
        if len(children) >= WIDE:
            self.places = {term: np.ascontiguousarray(np.array(at, dtype=np.int64).T) for term, at in self.places.items()}

    def bounds(self, query: list[tuple[int, int]], floor: int) -> list[tuple[int, int]]:
        """(bound, child) of the children that can reach a score of `floor`."""
        places = self.places
        if len(self.children) >= WIDE:
            out = np.zeros(len(self.children), dtype=np.int64)
            for term, w in query:
                if term in places:
                    at, gains = places[term]
                    out[at] += w * gains
            return [(int(out[k]), int(k)) for k in np.flatnonzero(out >= floor)]
        sums = [0] * len(self.children)
        for term, w in query:
            for k, g in places.get(term, ()):
                sums[k] += w * g
        return [(s, k) for k, s in enumerate(sums) if s >= floor]


def _key(doc_id: int | None) -> tuple[bool, int]:
    """The order of documents of equal score."""
    return doc_id is None, doc_id or 0


def tree(rows: list[tuple], place: list[int], k: int) -> Node | None:
    """The prefix tree of rows (doc_id, m, terms, times), whose paths take terms by their place in the order."""
    same: dict[tuple, list] = {}
    for doc_id, m, found, times in rows:
        if found:
            path, tfs = zip(*sorted(zip(map(place.__getitem__, found), times, strict=True)), strict=True)
            same.setdefault((path, tfs, m), []).append(doc_id)
    leaves = sorted(same.items(), key=lambda x: x[0])
    if not leaves:
        return None
    order = sorted(range(len(place)), key=place.__getitem__)
    open_: list[tuple[int, list]] = [(0, [])]  # depth and children of the nodes on the way to the last leaf
    before, child = (), None
    for (path, tfs, m), ids in leaves:
        leaf = Leaf(dict(zip(map(order.__getitem__, path), tfs, strict=True)), m, heapq.nsmallest(k, ids, key=_key))
        leaf.least = _key(leaf.ids[0])
        if child is not None:
            depth = next((i for i, (a, b) in enumerate(zip(before, path, strict=False)) if a != b), min(len(before), len(path)))
            while open_[-1][0] > depth:
                children = open_.pop()[1]
                child = Node([*children, child])
            if open_[-1][0] < depth:
                open_.append((depth, []))
            open_[-1][1].append(child)
        before, child = path, leaf
    while open_:
        child = Node([*open_.pop()[1], child])
    return child


class Best:
    """The k best (score, document) of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.heap: list[tuple] = []

    @property
    def floor(self) -> int:
        """The least score that can be among the best."""
        return max(1, self.heap[0][0]) if len(self.heap) == self.k else 1

    def reaches(self, bound: int, least: tuple) -> bool:
        """Whether documents of at most this score and at least this id can be among the best."""
        if bound <= 0:
            return False
        if len(self.heap) < self.k:
            return True
        score, null, minus = self.heap[0][:3]
        return bound > score or bound == score and least < (not null, -minus)

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> Iterator[tuple[int, int | None]]:
        return ((score, -minus if known else None) for score, known, minus in self.heap)


def walk(root: Node, query: list[tuple[int, int]], best: Best) -> int:
    """Depth-first branch-and-bound of one item over a tree; returns how many nodes were opened."""
    opened, ahead = 0, [(None, root)]
    while ahead:
        bound, node = ahead.pop()
        if bound is not None and not best.reaches(bound, node.least):
            continue
        opened += 1
        inner = []
        # falling, so that the first leaves raise what the others must reach
        for bound, k in sorted(node.bounds(query, best.floor), reverse=True):
            if best.reaches(bound, node.leasts[k]):
                child = node.children[k]
                if type(child) is Leaf:
                    for doc_id in child.ids:
                        best.offer(bound, doc_id)
                else:
                    inner.append((bound, child))
        ahead += reversed(inner)  # the best one is taken next
    return opened


# -- the search


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // ITEM_BYTES + 1
    out = None
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        part = _search_block(docs, own, items.schema["item_id"].dataType.simpleString(), k)
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(docs: DataFrame, rows: list, kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked: dict = {}
    for r in rows:
        asked.setdefault(r["item_id"], Counter()).update(counted(r["text"].encode()))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))}
    vectors = written(restricted(docs, vocabulary))
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    held = [df.get(i, 0) for i in range(len(vocabulary))]
    # the rarest term first: a subtree holds none of the terms before its path's
    place = [0] * len(held)
    for p, i in enumerate(sorted(range(len(held)), key=lambda i: (held[i], i))):
        place[i] = p
    weights = [weight(n_docs, x) for x in held]
    queries = [[(vocabulary[t], weights[vocabulary[t]] * times) for t, times in count.items() if held[vocabulary[t]]] for count in asked.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = [Best(k) for _ in queries], []

        def searched() -> None:
            root = tree(block, place, k)
            if root is not None:
                for query, b in zip(queries, best, strict=True):
                    walk(root, query, b)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append(row)
                if len(block) >= BLOCK:
                    searched()
        searched()
        found = [(i, score, doc_id) for i, b in enumerate(best) for score, doc_id in b.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "score", "doc_id"])

    m = F.expr(f"cast(25 + (cast(75 as decimal(20,0)) * n * {n_docs}) div {max(n_terms, 1)} as bigint)")
    found = vectors.where("size(terms) > 0").select("doc_id", m.alias("m"), "terms", "times").mapInArrow(run, "item int, score long, doc_id long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, item_id in enumerate(asked)], f"item int, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The search in DuckDB's SQL, without a tree: every document that shares a term is scored.
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w))::BIGINT AS nl FROM d),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
x AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nl))))::BIGINT AS score FROM i JOIN p USING (t) JOIN f USING (t), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10"""
