"""Residual codes as packed bytes, scored as they are.

A code of nbits is stored in as many bits, so a byte holds 8 / nbits components
of a token.  A query token's product with a de-quantised token is its product
with the centroid plus one looked-up sum for each byte, divided by the length
of the de-quantised vector; nothing is rebuilt.  Where query tokens are more
than one block of look-up tables holds, a block of tokens is rebuilt and
multiplied instead: a sum for each byte and pair would cost far more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Numbers of one block of products or of one set of look-up tables, whatever the number of centroids and queries.
PRODUCTS = 1_000_000
#: Query tokens of a tile whose products are made with rebuilt tokens.
TILE = 400
#: Tokens among which equal vectors are sought.
PART = 32_768
#: Rows of the other side that a block of products takes at a time, and the distance within which rounding may make products equal or turn them.
SIDE, NEARLY = 2048, 2e-9
#: Pairs of a document and a query that a task holds at a time.
PAIRS = 400_000


def nearest(v: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The row of greatest product, rounded; the first of equal ones.

    Products are held in blocks of PRODUCTS numbers, and equal rows of a part (a word's vectors) are taken once.
    """
    parts = []
    for i in range(0, len(v), PART):
        x = np.ascontiguousarray(v[i : i + PART])
        _, first, where = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        x, out = x[first], np.zeros(len(first), dtype=np.int64)
        room = max(1, PRODUCTS // max(1, min(len(matrix), SIDE)))
        for j in range(0, len(x), room):
            out[j : j + room] = _greatest(x[j : j + room], matrix)
        parts.append(out[where])
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _greatest(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The row of greatest rounded product of each of x: rounding decides only among products that are nearly equal."""
    best, top, close = np.zeros(len(x), dtype=np.int64), np.full(len(x), -np.inf), np.zeros(len(x), dtype=bool)
    for c in range(0, len(matrix), SIDE):
        products = x @ matrix[c : c + SIDE].T
        at = products.argmax(1)
        here = products[np.arange(len(x)), at]
        # or not a number
        close |= ((products >= (here - NEARLY)[:, None]).sum(1) != 1) | (np.abs(here - top) <= NEARLY)
        more = here > top
        best[more], top[more] = at[more] + c, here[more]
    again, room = np.flatnonzero(close), max(1, PRODUCTS // max(1, len(matrix)))
    for k in range(0, len(again), room):
        products = x[again[k : k + room]] @ matrix.T
        best[again[k : k + room]] = np.round(products, 9, out=products).argmax(1)
    return best


def pack(codes: np.ndarray, nbits: int) -> np.ndarray:
    """Rows of codes as rows of bytes, first component in the highest bits; the last byte is filled with zeros."""
    per = 8 // nbits
    rows, dim = codes.shape
    wide = np.zeros((rows, -(-dim // per) * per), dtype=np.uint8)
    wide[:, :dim] = codes
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * np.uint8(nbits)
    return (wide.reshape(rows, -1, per) << shifts).sum(2).astype(np.uint8)


def unpack(data: np.ndarray, nbits: int, dim: int) -> np.ndarray:
    shifts = np.arange(8 // nbits - 1, -1, -1, dtype=np.uint8) * np.uint8(nbits)
    return ((data[:, :, None] >> shifts) & np.uint8(2**nbits - 1)).reshape(len(data), -1)[:, :dim]


def tables(queries: np.ndarray, weights: list[float], nbits: int) -> np.ndarray:
    """For each byte of a code and each of its 256 values, what it adds to the product with every query token."""
    per = 8 // nbits
    rows, dim = queries.shape
    wide = np.zeros((rows, -(-dim // per) * per))
    wide[:, :dim] = queries
    values = np.asarray(weights, dtype=np.float64)[unpack(np.arange(256, dtype=np.uint8)[:, None], nbits, per)]
    return np.einsum("vc,qpc->pvq", values, wide.reshape(rows, -1, per))


@dataclass(frozen=True)
class Encoder:
    """Centroids, edges and weights of a codec; small enough to travel with a function (checked where it is read)."""

    centroids: np.ndarray
    cutoffs: list[float]
    weights: list[float]
    nbits: int

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit rows: centroid, packed codes, length of the de-quantised row, distance to it when it has unit length, and to the centroid."""
        parts, nearest_to = [], nearest(v, self.centroids)
        for i in range(0, len(v), 4096):
            x, best = v[i : i + 4096], nearest_to[i : i + 4096]
            c = self.centroids[best]
            codes = np.searchsorted(self.cutoffs, np.round(x - c, 9), "right").astype(np.uint8)
            raw = c + np.asarray(self.weights)[codes]
            length = np.linalg.norm(raw, axis=1)
            length[length <= 1e-12] = 1.0
            parts.append((best.astype(np.int32), pack(codes, self.nbits), length, np.linalg.norm(x - raw / length[:, None], axis=1), np.linalg.norm(x - c, axis=1)))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def decode(self, best: np.ndarray, packed: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.centroids[best] + np.asarray(self.weights)[unpack(packed, self.nbits, self.centroids.shape[1])]) / length[:, None]


@dataclass(frozen=True)
class Scorer:
    """Query tokens against packed tokens: queries in order and their tokens' rows.

    What grows with queries times centroids or values of a byte is made where it is used, for a tile of queries at a time.
    """

    ids: tuple[int, ...]
    starts: tuple[int, ...]  # of each query among the tokens; queries without real tokens are left out
    lengths: np.ndarray  # of the query tokens
    matrix: np.ndarray
    encoder: Encoder

    @classmethod
    def of(cls, ids: list[int], query: np.ndarray, matrix: np.ndarray, encoder: Encoder) -> Scorer:
        starts = tuple(int(np.searchsorted(query, i)) for i in ids)
        return cls(tuple(ids), starts, np.linalg.norm(matrix, axis=1), matrix, encoder)

    @cached_property
    def lookup(self) -> np.ndarray:
        return tables(self.matrix, self.encoder.weights, self.encoder.nbits)

    @property
    def tabled(self) -> int:
        """Query tokens whose look-up tables fit in one block."""
        width = self.matrix.shape[1] if self.matrix.ndim == 2 else 1
        return max(1, PRODUCTS // (256 * -(-width * self.encoder.nbits // 8)))

    def spans(self) -> list[tuple[int, int]]:
        """The rows of each query."""
        return list(zip(self.starts, [*self.starts[1:], len(self.lengths)], strict=True))

    def tiles(self) -> Iterator[tuple[int, Scorer]]:
        """Scorers of consecutive queries, with the place of their first; a longer query is alone.

        All queries are one tile if their look-up tables fit in one block; else a tile has TILE tokens.
        """
        room = self.tabled if len(self.lengths) <= self.tabled else max(self.tabled, TILE)
        first, spans = 0, self.spans()
        for k in range(1, len(spans) + 1):
            if k == len(spans) or spans[k][1] - spans[first][0] > room:
                a, b = spans[first][0], spans[k - 1][1]
                yield first, Scorer(self.ids[first:k], tuple(x - a for x in self.starts[first:k]), self.lengths[a:b], self.matrix[a:b], self.encoder)
                first = k

    def blocks(self, counts: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of documents whose tokens' products fit in one block; a longer document is alone."""
        room, out, first, held = max(1, PRODUCTS // max(1, len(self.lengths))), [], 0, 0
        for k, n in enumerate(counts):
            if held and held + n > room:
                out.append((first, k))
                first, held = k, 0
            held += int(n)
        return [*out, (first, len(counts))] if len(counts) else out

    def pairs(self, whole: pa.RecordBatch, qs: int, n: int, sums: Callable[[pa.RecordBatch, np.ndarray, Scorer], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of a batch of documents with the row, query and score of each wanted pair.

        qs and n: the columns of wanted queries (by their place) and of numbers of tokens.  sums: document x query of a
        part for the queries of a tile.
        """
        ends, at = whole.column(qs).offsets.to_numpy(), 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS, "right")) - 1)
            batch, at = whole.slice(at, to - at), to
            counts = batch.column(n).to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(batch.column(qs).offsets.to_numpy()))
            q = batch.column(qs).flatten().to_numpy()
            total = np.zeros(len(q))
            for first, tile in self.tiles():
                own = np.flatnonzero((q >= first) & (q < first + len(tile.ids)))
                for i, j in tile.blocks(counts) if len(own) else []:
                    a, b = np.searchsorted(row[own], (i, j))
                    if b > a:
                        here = own[a:b]
                        total[here] = sums(batch.slice(i, j - i), counts[i:j], tile)[row[here] - i, q[here] - first]
            yield batch, row, q, total

    def near(self, centroids: np.ndarray, threshold: float | None) -> np.ndarray:
        """Centroid x query token, rounded; where no token of a query reaches the threshold all of its are -inf."""
        out = self.encoder.centroids[centroids] @ self.matrix.T
        np.round(out, 9, out=out)
        if threshold is not None:
            for a, b in self.spans():
                out[out[:, a:b].max(1) < threshold, a:b] = -np.inf
        return out

    def products(self, best: np.ndarray, packed: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Token x query token."""
        if len(self.lengths) > self.tabled:
            return self.encoder.decode(best, packed, length) @ self.matrix.T
        out = self.encoder.centroids[best] @ self.matrix.T
        for p in range(packed.shape[1]):
            out += self.lookup[p][packed[:, p]]
        out /= length[:, None]
        return out

    def sums(self, products: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Document x query: the sum of each query token's best product; every document has tokens."""
        best = np.maximum.reduceat(products, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        return np.add.reduceat(np.where(np.isneginf(best), 0.0, best), self.starts, axis=1)
