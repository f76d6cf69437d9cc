"""Errors raised by the engine."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class EmptyEmbeddingSet(EngineError):
    """An index can't be made of no documents."""


class EmptyInput(EngineError):
    """A text or a matrix is empty where content is needed."""


class DimensionMismatch(EngineError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected vectors of {expected} dimensions, got {actual}")
        self.expected, self.actual = expected, actual


class MaskMismatch(EngineError):
    """A mask and its rows differ in length."""


class PoolingError(EngineError):
    """Token pooling got an empty or ragged document."""


class InvalidDocumentId(EngineError):
    def __init__(self, doc_id: int):
        super().__init__(f"no document has the id {doc_id}")


class InvalidPredicate(EngineError):
    """A metadata predicate is not in the accepted grammar."""


class IndexNotFound(EngineError):
    """There is no index at a path."""


class ModelMismatch(EngineError):
    """An index was made with another model."""


class ConcurrentWrite(EngineError):
    """Another writer has published a snapshot meanwhile."""
