"""Sort terms with explicit places for nulls: ascending puts them last and descending first unless a term says otherwise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from ..errors import QueryError


@dataclass(frozen=True)
class Term:
    """A sort term over a column or output name."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def nulls_are_first(self) -> bool:
        return self.descending if self.nulls_first is None else self.nulls_first

    def column(self, at: Column) -> Column:
        if self.descending:
            return at.desc_nulls_first() if self.nulls_are_first else at.desc_nulls_last()
        return at.asc_nulls_first() if self.nulls_are_first else at.asc_nulls_last()

    def flipped(self) -> Term:
        return Term(self.name, not self.descending, not self.nulls_are_first)


def asc(name: str) -> Term:
    return Term(name)


def desc(name: str) -> Term:
    return Term(name, True)


def asc_nulls_first(name: str) -> Term:
    return Term(name, False, True)


def desc_nulls_last(name: str) -> Term:
    return Term(name, True, False)


def terms(given) -> tuple[Term, ...]:
    for t in given:
        if not isinstance(t, Term):
            raise QueryError(f"not a sort term: {t!r}")
    return tuple(given)
