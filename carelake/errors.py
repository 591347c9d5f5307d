"""Errors that callers can tell apart."""


class EngineError(Exception):
    status = 500


class SearchError(EngineError):
    """The query is at fault: an unknown parameter, a bad value, a refused modifier."""

    status = 400


class NotFound(EngineError):
    status = 404


class Deleted(EngineError):
    status = 410


class Conflict(EngineError):
    """The expected version is not the current one."""

    status = 409


class Duplicate(EngineError):
    """The id to be created was used before."""

    status = 409


class MultipleMatches(EngineError):
    """A conditional interaction met more than one resource."""

    status = 412


class DocumentError(EngineError):
    """A document can't be read as a resource."""

    status = 400


class NotModified(EngineError):
    """The caller has the current version already."""

    status = 304


class Invalid(EngineError):
    """A document breaks the rules of its type."""

    status = 422


class PathError(EngineError):
    """A path expression can't be parsed or evaluated."""

    status = 422
