"""Errors of the engine, by the layer that raises them."""


class GraphloomError(Exception):
    """Base of all errors here."""


class StoreError(GraphloomError):
    """A source can't be read or a write is refused. ``kind``: connection, query, not_found, invalid_data or transaction."""

    def __init__(self, message: str, kind: str = "query"):
        super().__init__(message)
        self.kind = kind


class MappingError(GraphloomError):
    """A value has no counterpart. ``kind``: missing_property, invalid_type, unknown_label, unknown_relation or conversion."""

    def __init__(self, message: str, kind: str = "conversion"):
        super().__init__(message)
        self.kind = kind


class RuleError(GraphloomError):
    """A rule text that can't be parsed, or that isn't safe."""


class ExpressionError(GraphloomError):
    """A class expression that can't be parsed."""


class ShapeError(GraphloomError):
    """A shape with a target, path or constraint that can't be used, such as an invalid regular expression."""


class FixpointError(GraphloomError):
    """An iteration that can't go on."""
