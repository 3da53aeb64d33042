"""Errors that callers may want to tell apart."""


class ConfigError(ValueError):
    """The configuration names something unknown or asks for something impossible."""


class SchemaError(ValueError):
    """The XSD can't be compiled."""


class ConflictError(RuntimeError):
    """Another load was committed first."""


class InvalidDocument(ValueError):
    """A document is malformed or breaks its schema."""
