"""Errors with a type each: a result that cannot be honest is an error and never a default."""

from __future__ import annotations


class StancelakeError(Exception):
    """The base of all errors of the library."""


class InvalidInput(StancelakeError, ValueError):
    """An argument outside its domain: an unknown bank, sort key, layout or size."""


class EntityNotFound(StancelakeError, LookupError):
    """Something was asked of a speaker, speech or point that is not there."""

    def __init__(self, entity: str, identifier: object):
        super().__init__(f"{entity} not found: {identifier!r}")
        self.entity, self.identifier = entity, identifier


class ImmutableRecord(StancelakeError):
    """A change of a table that rows are only added to."""


class ScorerFailed(StancelakeError):
    """A scorer gave nothing usable: other numbers of vectors or verdicts than were asked for."""


class BenchmarkUnavailable(StancelakeError, FileNotFoundError):
    """A rate series or labelled set that is read from a file is not there."""


class InsufficientData(StancelakeError):
    """Less history than a result needs to mean anything."""
