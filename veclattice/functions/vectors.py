"""Vector expressions: map-side, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column, eps: float = 1e-12, zero_policy: str = "keep") -> Column:
    """v / |v|; at a norm of at most eps v as it is ("keep"), or, for a norm of 0, zeros ("zero")."""

    def by(n: Column) -> Column:
        if zero_policy == "zero":
            return F.when(n == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / n))
        return F.when(n <= eps, v).otherwise(F.transform(v, lambda x: x / n))

    # the norm is computed once: inside of the function of a component it would be for each
    return F.transform(F.array(norm(v)), by)[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def is_padding(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


@F.arrow_udf(T.ArrayType(T.StringType()))
def nine_decimals(v: pa.Array) -> pa.Array:
    """The numbers with nine decimals, rounded as they are in binary and ties to even; Java rounds ties of its own shortest form up."""
    return pa.array([None if x is None else [None if y is None else f"{y:.9f}" for y in x] for x in v.to_pylist()], pa.list_(pa.string()))


def format_vector(v: Column, head: int = 5, tail: int = 5) -> Column:
    """Nine decimals; the middle of vectors longer than head + tail is left out."""

    def text(part: Column) -> Column:
        return F.array_join(nine_decimals(part), ", ")

    long = F.concat(F.lit("["), text(F.slice(v, 1, head)), F.lit(", ..., "), text(F.slice(v, -tail, tail)), F.lit("]"))
    return F.when(F.size(v) == 0, F.lit("(empty)")).when(F.size(v) > head + tail, long).otherwise(F.concat(F.lit("["), text(v), F.lit("]")))


def pack(matrix: np.ndarray) -> tuple[bytes, int, int]:
    """Little-endian row-major float32, rows and columns."""
    m = np.ascontiguousarray(matrix, dtype="<f4")
    rows, cols = (m.shape[0], m.shape[1]) if m.ndim == 2 else (0, 0)
    return m.tobytes(), rows, cols


def unpack(data: bytes, rows: int, cols: int) -> np.ndarray:
    """An empty matrix where the data are too short."""
    if len(data) < 4 * rows * cols:
        return np.zeros((0, cols), dtype=np.float32)
    return np.frombuffer(data, dtype="<f4", count=rows * cols).reshape(rows, cols)


class Lcg:
    """A seeded 64-bit generator: state * 6364136223846793005 + 1, wrapping (fixed values); a zero seed is replaced."""

    def __init__(self, seed: int):
        self.state = seed % (1 << 64) or 0x9E3779B97F4A7C15

    def next(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1) % (1 << 64)
        return self.state
