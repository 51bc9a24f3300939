"""Errors that the library raises."""

from __future__ import annotations


class TidewaterError(Exception):
    """Base of all errors of the library."""


class UnknownStepError(TidewaterError, KeyError):
    """A pipeline names a step that isn't registered."""

    def __init__(self, name: str, known: list[str] | None = None):
        self.name, self.known = name, sorted(known or [])
        super().__init__(f"unknown step {name!r}" + (f"; known steps: {', '.join(self.known)}" if known else ""))

    def __str__(self) -> str:
        return str(self.args[0])


class CsvReadError(TidewaterError, ValueError):
    """A CSV source can't be read as asked."""


class JsonlReadError(TidewaterError, ValueError):
    """A JSON Lines source can't be read."""


class RemoteReadError(TidewaterError, OSError):
    """A remote source can't be fetched."""


class TypeCastError(TidewaterError, ValueError):
    """A value doesn't fit the type it should be cast to."""


class PipelineStepError(TidewaterError):
    """A step of a pipeline failed."""

    def __init__(self, step: str, cause: BaseException):
        self.step, self.cause = step, cause
        super().__init__(f"step {step!r} failed: {cause}")


class SchemaValidationError(TidewaterError, ValueError):
    """Data breaks a contract; ``result`` says how."""

    def __init__(self, message: str, result=None):
        super().__init__(message)
        self.result = result


class PipelineSerializationError(TidewaterError, ValueError):
    """A pipeline can't be saved or loaded."""
