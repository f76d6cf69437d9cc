"""Token pooling: agglomerative merging of a document's vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import PoolingError


def pool(rows: np.ndarray, factor: int) -> np.ndarray:
    """All rows but the first are merged into n div factor clusters by least cosine distance; the first comes last.

    Ties go to the first pair; a merged cluster goes to the end of the list; a
    zero vector has cosine 0 with any; means are not normalised again.
    """
    rows = np.asarray(rows, dtype=np.float64)
    if rows.ndim != 2 or not rows.size:
        raise PoolingError("a document must have rows of one length")
    if factor <= 1 or len(rows) <= 1:
        return rows
    first, tail = rows[:1], rows[1:]
    want = max(1, len(tail) // factor)
    if want >= len(tail):
        return rows
    # clusters lie in slots in the order of the list; a merged one takes the next slot, the two it is made of are closed
    n, dim = tail.shape
    last = 2 * n - want
    sums, sizes, unit = np.zeros((last, dim)), np.ones(last), np.zeros((last, dim))
    distance = np.full((last, last), np.inf)
    sums[:n] = tail
    unit[:n] = _unit(tail)
    distance[:n, :n] = 1 - unit[:n] @ unit[:n].T
    distance[np.tril_indices(last)] = np.inf
    live = np.arange(last) < n
    # the first of each slot's nearest later slots; only rows that lose theirs look again
    near = distance.argmin(1)
    least = distance[np.arange(last), near]
    for new in range(n, last):
        i = int(least.argmin())
        j = int(near[i])
        live[[i, j]] = False
        distance[[i, j]] = distance[:, [i, j]] = np.inf
        least[[i, j]] = np.inf
        for k in np.flatnonzero(live & ((near == i) | (near == j))):
            near[k] = distance[k].argmin()
            least[k] = distance[k, near[k]]
        sums[new], sizes[new] = sums[i] + sums[j], sizes[i] + sizes[j]
        unit[new] = _unit(sums[new : new + 1] / sizes[new])[0]
        others = np.flatnonzero(live)
        distance[others, new] = 1 - unit[others] @ unit[new]
        closer = others[distance[others, new] < least[others]]
        near[closer], least[closer] = new, distance[closer, new]
        live[new] = True
    return np.vstack([sums[live] / sizes[live][:, None], first])


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.sqrt((rows * rows).sum(1))
    return rows / np.where(n == 0, 1, n)[:, None]


def pool_tokens(tokens: DataFrame, factor: int) -> DataFrame:
    """doc_id, token_pos and v of pooled documents; a document's tokens are one group, as long as one text."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("token_pos")
        rows = np.array(table["v"].to_pylist(), dtype=np.float64)
        out = pool(rows, factor)
        return pa.table([pa.array([table["doc_id"][0].as_py()] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], ["doc_id", "token_pos", "v"])

    return tokens.select("doc_id", "token_pos", "v").groupBy("doc_id").applyInArrow(run, "doc_id long, token_pos int, v array<double>")
