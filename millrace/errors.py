"""What can go wrong, one class for each kind."""


class MillraceError(Exception):
    """Any error of this engine."""


class QuerySyntaxError(MillraceError):
    """The text is no statement of the dialect."""


class ColumnNotFound(MillraceError):
    """No table in the query has a column of that name."""


class AmbiguousColumn(MillraceError):
    """Several tables in the query have a column of that name."""


class TypeMismatch(MillraceError):
    """Operands of types that do not go together."""


class InvalidQuery(MillraceError):
    """The statement parses but has no meaning."""


class TableNotFound(MillraceError):
    """No such table in the catalog."""


class TableExists(MillraceError):
    """A table of that name is there already."""


class SortColumnsMismatch(MillraceError):
    """A sort key is no column of the table."""


class UnsupportedFileType(MillraceError):
    """A kind of table that is declared but not supported."""


class LoadError(MillraceError):
    """A file to load is missing."""


class CatalogError(MillraceError):
    """The catalog's text cannot be read."""


class EstimateError(MillraceError):
    """The estimator cannot make sense of its input."""
