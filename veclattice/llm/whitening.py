"""Embedding whitening by spectrum slicing.

Vectors become whole numbers, so the moments are sums of whole numbers that do
not depend on how rows are dealt (exactly, up to 2^53).  The data are read four
times: for the counts and sums of each dimension, for the covariance (d x d
numbers a task, centred on the rounded mean before multiplying, summed by
cell), for the covariance of the whitened values, and for the result.  No row
meets another one, so no key can be hot; the driver holds d x d numbers, d the
dimension of the vectors.

The leading eigenvalues of the covariance V come from its spectrum cut in
slices.  For a shift s the factors L D L' of V - s I have as many positive
pivots as V has eigenvalues above s (Sylvester), so counts at a few shifts
put each eigenvalue in a slice of its own.  There Rayleigh quotient iteration
converges cubically; what leaves its slice is cut again.  At the end counts
just above and just below each eigenvalue certify its number.  Eigenvalues
that no shift can part (a slice of rounding's width) get vectors by inverse
iteration, each orthogonal to those before it.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries go, and so do vectors of another length than most have (of equally
many, the longer stays); repeated rows count each; other columns than vec_id
and the vector are not read.  64 * c is held within +-2^61.  Components whose
variance is 0, or not above RANK times the first one's, cannot be whitened and
have no rows: one vector alone, equal vectors and empty tables give no row.
A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: Components that are given, and the share of the first eigenvalue that one must exceed.
COMPONENTS, RANK = 32, 1e-11
#: Rows that one product takes, and steps of iteration in one slice.
ROWS, STEPS = 4096, 12
_MOST = 2.0**61
_EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Moments:
    """Vectors, their sums (whole numbers, exact) and their covariance."""

    n: int
    sums: tuple[int, ...]
    least: tuple[int, ...]
    most: tuple[int, ...]
    covariance: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The mean of each dimension, rounded to a whole number."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def offset(self) -> np.ndarray:
        """What the mean exceeds the rounded one by."""
        return np.array([(s - int(c) * self.n) / self.n for s, c in zip(self.sums, self.centre, strict=True)])


# -- the vectors as whole numbers


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -_MOST, _MOST).astype(np.int64) + OFFSET


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers."""
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _sums(rows: DataFrame) -> tuple[int, tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """n, sums, least and greatest entries of the vectors of the most frequent length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            column = part.column(0)
            lengths = np.diff(column.offsets.to_numpy())
            for d in np.unique(lengths):
                x = _matrix(column.filter(pa.array(lengths == d)))
                exact = x.sum(0) if np.abs(x).max() < 2.0**62 / len(x) else x.astype(object).sum(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(d)] * d, pa.int32()), pa.array(np.arange(d, dtype=np.int32)), pa.array([len(x)] * d, pa.int64()), pa.array([int(s) for s in exact], pa.decimal128(38, 0)), pa.array(x.min(0)), pa.array(x.max(0))], ["d", "pos", "n", "s", "least", "most"]
                )

    found = rows.mapInArrow(run, "d int, pos int, n long, s decimal(38,0), least long, most long").groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
    # one row for each length and position: the length that most vectors have
    lead = found.where("pos = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lead:
        return 0, (), (), ()
    own = found.where(F.col("d") == lead[0]["d"]).orderBy("pos").collect()
    return lead[0]["n"], tuple(int(r["s"]) for r in own), tuple(r["least"] for r in own), tuple(r["most"] for r in own)


def _gram(cells: DataFrame, d: int) -> np.ndarray:
    """The sum of d x d matrices given as rows of (i, a row of the matrix)."""
    out = np.zeros((d, d))
    for r in cells.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return out


def _rows_of(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix), dtype=np.int32)), pa.array(list(matrix), pa.list_(pa.float64()))], ["i", "v"])


def moments(rows: DataFrame) -> Moments | None:
    """Counts, sums and covariance of rows(v); None without rows."""
    n, sums, least, most = _sums(rows)
    if not n:
        return None
    d = len(sums)
    bare = Moments(n, sums, least, most, np.zeros((d, d)))
    centre = bare.centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for part in _parts(batches):
            y = (_matrix(part.column(0)) - centre).astype(np.float64)
            total += y.T @ y
        yield _rows_of(total)

    total = _gram(rows.where(F.size("v") == d).mapInArrow(run, "i int, v array<double>"), d)
    covariance = total / n - np.outer(bare.offset, bare.offset)
    return Moments(n, sums, least, most, (covariance + covariance.T) / 2)


# -- the spectrum


def positive_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive, from its factors L D L'.

    Symmetric pivoting with pivots of one or two rows (Bunch and Kaufman): a pair's block is indefinite and counts one.
    A column of zeros counts nothing.
    """
    a, d, count, j = matrix.copy(), len(matrix), 0, 0
    bound = (1 + np.sqrt(17)) / 8
    while j < d:
        below = np.abs(a[j + 1 :, j])
        most, own, pair = below.max(initial=0.0), abs(a[j, j]), False
        if not most and not own:
            j += 1
            continue
        if own < bound * most:
            r = j + 1 + int(below.argmax())
            row = np.abs(a[r, j:])
            row[r - j] = 0
            if own * row.max() < bound * most**2:
                pair = abs(a[r, r]) < bound * row.max()
                to = j + pair
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        n = 2 if pair else 1
        block, side = a[j : j + n, j : j + n], a[j + n :, j : j + n]
        count += 1 if pair else int(block[0, 0] > 0)
        a[j + n :, j + n :] -= side @ (np.linalg.solve(block, side.T) if pair else side.T / block[0, 0])
        j += n
    return count


class Spectrum:
    """Counts of eigenvalues above shifts, each factored once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.d = len(matrix)
        radius = np.abs(matrix).sum(1) - np.abs(matrix.diagonal())
        spread = float(np.abs(matrix).sum(1).max())
        #: No eigenvalue is known better than this.
        self.width = 4 * self.d * _EPS * spread
        self.counts = {float((matrix.diagonal() - radius).min()) - self.width - 1e-300: self.d, float((matrix.diagonal() + radius).max()) + self.width + 1e-300: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positive_pivots(self.matrix - shift * np.eye(self.d))
        return self.counts[shift]

    def slice(self, k: int) -> tuple[float, float]:
        """The narrowest known slice that holds the k-th greatest eigenvalue."""
        low = max(s for s, c in self.counts.items() if c >= k)
        return low, min(s for s, c in self.counts.items() if c < k and s > low)

    def isolate(self, k: int) -> tuple[float, float]:
        """A slice with the k-th eigenvalue alone, or of rounding's width."""
        low, high = self.slice(k)
        while self.above(low) - self.above(high) > 1 and high - low > self.width:
            self.above((low + high) / 2)
            low, high = self.slice(k)
        return low, high

    def halve(self, k: int) -> tuple[float, float]:
        low, high = self.slice(k)
        self.above((low + high) / 2)
        return self.slice(k)


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    try:
        out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        out = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), right)
    return out / np.linalg.norm(out)


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """v without what the vectors found so far explain."""
    for _ in range(2):
        for f in found:
            v = v - (f @ v) * f
    return v / np.linalg.norm(v)


def leading(matrix: np.ndarray, most: int = COMPONENTS, rank: float = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit vectors as columns; at most `most`, all above `rank` of the first.

    Each number is certified: k - 1 eigenvalues lie above the k-th one plus rounding's width, and k or more above it
    less that width.  Of a vector the entry of greatest size is positive.
    """
    if not len(matrix) or not np.abs(matrix).max():
        return np.zeros(0), np.zeros((len(matrix), 0))
    spectrum = Spectrum(matrix)
    start = np.random.default_rng(7).standard_normal(len(matrix))
    values: list[float] = []
    found: list[np.ndarray] = []
    for k in range(1, min(most, len(matrix)) + 1):
        low, high = spectrum.isolate(k)
        v, value, rest = _apart(start, found), 0.0, np.inf
        while not (low - spectrum.width <= value <= high + spectrum.width and rest <= spectrum.width):
            v, shift = _apart(start, found), (low + high) / 2
            for step in range(STEPS):
                v = _apart(_solve(matrix, shift, v, spectrum.width), found)
                value = float(v @ matrix @ v)
                rest = float(np.linalg.norm(matrix @ v - value * v))
                if rest <= spectrum.width / 4:
                    break
                # two steps of inverse iteration turn the vector to its slice, then its own quotient is the shift
                if step and low < value < high:
                    shift = value
            if high - low <= spectrum.width:
                break
            low, high = spectrum.halve(k)
        values.append(value)
        found.append(v)
    order = np.argsort(-np.array(values), kind="stable")
    e, p = np.array(values)[order], np.array(found).T[:, order]
    keep = int((e > max(rank * e[0], 0)).sum())
    for k in range(keep):
        # the counts certify the numbers, up to what rounding cannot part
        if spectrum.above(e[k] + spectrum.width) > k or spectrum.above(e[k] - spectrum.width) < k + 1:
            raise ArithmeticError(f"eigenvalue {k + 1} is not certified")
    p = p[:, :keep]
    return e[:keep], p * np.where(p[np.abs(p).argmax(0), np.arange(keep)] < 0, -1.0, 1.0)


# -- the result


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error of each usable row and component."""
    rows = usable(rows, vector).select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    m = moments(rows.select("v"))
    e, p = leading(m.covariance, components) if m else (np.zeros(0), np.zeros((0, 0)))
    if not len(e):
        return rows.sparkSession.createDataFrame([], out)
    d, k, n = len(p), len(e), m.n
    centre, offset, turn = m.centre, m.offset, p / np.sqrt(e)
    share = e / np.trace(m.covariance)
    rows = rows.where(F.size("v") == d)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre).astype(np.float64) - offset) @ turn

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))  # the last row has the sums
        for part in _parts(batches):
            w = project(_matrix(part.column(0)))
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        yield _rows_of(total)

    both = _gram(rows.select("v").mapInArrow(spread, "i int, v array<double>"), k + 1) / n
    error = float(np.abs(both[:k, :k] - np.outer(both[k, :k], both[k, :k]) - np.eye(k)).max())
    sums = m.sums
    farthest = max(max(abs(n * b - s), abs(n * a - s)) for a, b, s in zip(m.least, m.most, sums, strict=True))
    fits = max(farthest, *(n * max(abs(a), abs(b)) for a, b in zip(m.least, m.most, strict=True))) < 2**62 and d * farthest**2 < 2**63

    def deviations(x: np.ndarray) -> pa.Array:
        if fits:
            return pa.array(((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(1))
        exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = _matrix(part.column(1))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), deviations(x).take(each), pa.array(project(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * k, error))],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, out)
