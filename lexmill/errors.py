"""Typed errors of the engine, each with the status a web front would answer with."""


class EngineError(Exception):
    status = 500


class InvalidFormat(EngineError):
    """Malformed JSON, schema or query, or an unknown field."""

    status = 400


class NotFound(EngineError):
    status = 404


class Conflict(EngineError):
    """The name or id is taken."""

    status = 409


class NotAuthorized(EngineError):
    """A feature that the collection was not created with."""


class Internal(EngineError):
    """Storage failed."""
