"""What goes wrong, by kind."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException, PySparkException


class EngineError(Exception):
    """An error with its kind: sql (can't be parsed), plan (can't be resolved), execution, configuration."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


def engine_error(e: Exception) -> EngineError:
    """e as an EngineError, with the first line of its message."""
    if isinstance(e, EngineError):
        return e
    kind = "sql" if isinstance(e, ParseException) else "plan" if isinstance(e, AnalysisException) else "execution" if isinstance(e, PySparkException) else "other"
    text = str(e).strip().splitlines()
    return EngineError(kind, text[0] if text else type(e).__name__)
