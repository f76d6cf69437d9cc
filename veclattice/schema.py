"""Table schemas, parameters and the model registry."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from .errors import EngineError

TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("token_pos", T.IntegerType()), T.StructField("v", T.ArrayType(T.FloatType()))])
MATRIX = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("flat", T.ArrayType(T.FloatType()))])
CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("document_name", T.StringType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("embedding_count", T.IntegerType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("index_name", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("metadata_json", T.StringType()),
    ]
)
RESULTS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class ModelConfig:
    """do_query_expansion and attend_to_expansion_tokens are accepted and have no effect."""

    embedding_dimension: int
    batch_size: int = 32
    query_length: int = 32
    document_length: int = 180
    do_query_expansion: bool = True
    attend_to_expansion_tokens: bool = False


@dataclass(frozen=True)
class SearchParameters:
    batch_size: int = 2000
    n_full_scores: int = 4096
    top_k: int = 5
    n_ivf_probe: int = 32
    centroid_batch_size: int = 100_000
    centroid_score_threshold: float | None = 0.4
    log_timing: bool = False

    def to_json(self) -> str:
        """log_timing is written only where it is set."""
        d = asdict(self)
        if not self.log_timing:
            del d["log_timing"]
        return json.dumps(d, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> SearchParameters:
        return cls(**json.loads(text))


@dataclass(frozen=True)
class IndexConfig:
    nbits: int = 4
    seed: int | None = 42
    kmeans_iterations: int = 4
    max_points_per_centroid: int = 256
    batch_size: int = 64
    rebuild_up_to: int = 999
    centroids: str = "kmeans"  # or "deterministic"
    every: int | None = None  # deterministic centroids: each token of so many; else as many as k-means would have
    # of segmented indexes: documents of a block, centroids of a file of lists, whether vectors are kept, segments of a size that are merged
    block: int = 4096
    bucket: int = 64
    keep_vectors: bool = True
    fan: int = 4

    def __post_init__(self):
        if self.nbits not in (1, 2, 4, 8):
            raise EngineError("nbits must be 1, 2, 4 or 8")
        if self.centroids not in ("kmeans", "deterministic"):
            raise EngineError("centroids are kmeans or deterministic")


#: Dimension, query length and document length of the known models.
MODELS = {"lfm2": ModelConfig(128, query_length=32, document_length=512), "mxbai": ModelConfig(64, query_length=256, document_length=256)}


def resolve_model(name: str) -> tuple[str, ModelConfig]:
    """A model by its name or a longer form of it, without case and hyphens."""
    plain = name.replace("-", "").replace(".", "").lower()
    for key, config in MODELS.items():
        if plain.startswith(key):
            return key, config
    raise EngineError(f"unknown model {name}")
