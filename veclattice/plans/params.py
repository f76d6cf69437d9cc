"""Search parameters by corpus size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SearchParameters


def adaptive(chunks: int, top_k: int) -> SearchParameters:
    """The steps of full scores and probes by the number of chunks."""
    n, k = max(chunks, 0), top_k
    if n <= 100:
        full, probe = n, min(16, n)
    elif n <= 500:
        full, probe = max(40 * k, min(200, n)), max(8, min(24, n // 4))
    elif n <= 2000:
        full, probe = max(60 * k, 250), min(32, max(24, n // 80))
    else:
        full, probe = max(80 * k, 300), min(48, max(32, n // 100))
    return SearchParameters(n_full_scores=full, n_ivf_probe=probe, top_k=k)


def adaptive_columns(n: Column, k: Column) -> tuple[Column, Column]:
    """The same as column expressions: full scores and probes."""
    div = lambda d: F.floor(n / d)
    full = F.when(n <= 100, n).when(n <= 500, F.greatest(40 * k, F.least(F.lit(200), n))).when(n <= 2000, F.greatest(60 * k, F.lit(250))).otherwise(F.greatest(80 * k, F.lit(300)))
    probe = F.when(n <= 100, F.least(F.lit(16), n)).when(n <= 500, F.greatest(F.lit(8), F.least(F.lit(24), div(4)))).when(n <= 2000, F.least(F.lit(32), F.greatest(F.lit(24), div(80)))).otherwise(F.least(F.lit(48), F.greatest(F.lit(32), div(100))))
    return full.cast("long"), probe.cast("long")


def for_new_index(documents: int, top_k: int, nbits: int) -> SearchParameters:
    return SearchParameters(n_full_scores=documents, top_k=min(top_k, documents), n_ivf_probe=min(8, 2**nbits))


def for_existing_index(documents: int | None, top_k: int, partitions: int | None) -> SearchParameters:
    """Without figures in the index 10 documents and 32 partitions are presumed."""
    n = 10 if documents is None else documents
    return SearchParameters(n_full_scores=n, top_k=min(top_k, n), n_ivf_probe=min(8, 32 if partitions is None else partitions))
