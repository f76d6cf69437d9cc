"""Progress of an ingestion: a callback for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls back with the batch number and the rows so far."""

    def __init__(self, callback: Callable[[int, int], None]):
        self._callback, self._rows = callback, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self._rows += event.progress.numInputRows
        self._callback(event.progress.batchId, self._rows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
