"""What can be wrong with a query."""


class QueryError(ValueError):
    """The query is wrong: its text, its types or, at run time, its data."""


class ParseError(QueryError):
    """The text is no query; `at` is the offset of the offending part."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.at = at


class UnsupportedError(QueryError):
    """The query is right, but there is no plan for it."""
