"""What can go wrong with a query, by class."""


class CypherError(Exception):
    """Base of all query errors."""


class ParseError(CypherError):
    def __init__(self, message: str, position: int = -1) -> None:
        super().__init__(message if position < 0 else f"{message} (at offset {position})")
        self.position = position


class BindError(CypherError):
    """Names, scopes, arities and aggregation rules."""


class CypherTypeError(CypherError):
    """An operation on values it isn't defined for."""


class Unsupported(CypherError):
    """Cypher that this engine refuses instead of guessing."""


class ResourceExceeded(CypherError):
    """A limit of the session was reached."""


class WriteError(CypherError):
    """A write that would break identity, constraints or references."""
