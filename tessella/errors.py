"""Errors by the moment they are found in."""


class DeclarationError(ValueError):
    """A model or a report is declared wrongly. Carries every problem found, not only the first."""

    def __init__(self, problems: list[str] | str):
        self.problems = [problems] if isinstance(problems, str) else list(problems)
        super().__init__("; ".join(self.problems))


class QueryError(ValueError):
    """A call asks for what its declared read cannot give."""


class Refused(NotImplementedError):
    """An operation whose meaning Spark cannot keep. It is named and refused, never approximated."""


class ChildLimitError(QueryError):
    """A relation plan met more children than its limit; it never truncates."""


class WriteError(ValueError):
    """A write that must not happen."""


class NothingAssigned(WriteError):
    """An insert or update that assigns no column."""


class UnfilteredWrite(WriteError):
    """A set-based write without a predicate."""


class PagedWrite(WriteError):
    """A set-based write with a limit or an offset."""


class StaleWrite(WriteError):
    """A row's version is not the one that was read."""


class Conflict(WriteError):
    """A row with the same unique key exists."""


class ConstraintViolation(WriteError):
    """Rows that break a declared constraint; `kind` is unique, foreign_key, check, exclusion or not_null."""

    def __init__(self, kind: str, name: str, rows: int):
        self.kind, self.name, self.rows = kind, name, rows
        super().__init__(f"{kind} constraint {name} is broken by {rows} rows or groups")
