"""Errors of the query language, the tensor functions and datasets."""


class QueryError(ValueError):
    """Base of errors found while a query is parsed or lowered."""


class QuerySyntaxError(QueryError):
    pass


class SourceNotFound(QueryError):
    pass


class FunctionNotFound(QueryError):
    pass


class ColumnNotFound(QueryError):
    def __init__(self, name: str):
        super().__init__(f"there is no column {name!r}; a string value stands in single quotes")


class AmbiguousName(QueryError):
    pass


class TypeMismatch(QueryError):
    pass


class ShapeMismatch(QueryError):
    pass


class InvalidGroupFunction(QueryError):
    pass


class IndexDimensionError(QueryError):
    pass


class MergeError(QueryError):
    """Sides of a set operation that do not have the same columns."""


class DatasetError(Exception):
    pass
