"""Window specifications with checked frames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import DeclarationError
from .ordering import Term, asc, asc_nulls_first, desc, desc_nulls_last

UNBOUNDED_PRECEDING, CURRENT, UNBOUNDED_FOLLOWING = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def preceding(n: int) -> int:
    if n < 1:
        raise DeclarationError("n preceding needs an n of 1 or more")
    return -n


def following(n: int) -> int:
    if n < 1:
        raise DeclarationError("n following needs an n of 1 or more")
    return n


@dataclass(frozen=True)
class Over:
    """A window: `over().by("Region").asc("Day").rows(preceding(6), CURRENT)`. Names are outputs of the report."""

    partition: tuple[str, ...] = ()
    order: tuple[Term, ...] = ()
    frame: tuple[str, int, int] | None = None

    def by(self, *names: str) -> Over:
        return replace(self, partition=self.partition + names)

    def asc(self, *names: str) -> Over:
        return replace(self, order=self.order + tuple(map(asc, names)))

    def desc(self, *names: str) -> Over:
        return replace(self, order=self.order + tuple(map(desc, names)))

    def asc_nulls_first(self, *names: str) -> Over:
        return replace(self, order=self.order + tuple(map(asc_nulls_first, names)))

    def desc_nulls_last(self, *names: str) -> Over:
        return replace(self, order=self.order + tuple(map(desc_nulls_last, names)))

    def rows(self, start: int, end: int) -> Over:
        return self._framed("rows", start, end)

    def range(self, start: int, end: int) -> Over:
        if any(x not in (UNBOUNDED_PRECEDING, CURRENT, UNBOUNDED_FOLLOWING) for x in (start, end)):
            raise DeclarationError("a RANGE frame has unbounded or current edges only")
        return self._framed("range", start, end)

    def _framed(self, kind: str, start: int, end: int) -> Over:
        if start > end or start == UNBOUNDED_FOLLOWING or end == UNBOUNDED_PRECEDING:
            raise DeclarationError("a frame starts before it ends")
        return replace(self, frame=(kind, start, end))

    def problems(self, name: str, ranking: bool) -> list[str]:
        out = []
        if ranking and not self.order:
            out.append(f"{name}: a ranking needs an order")
        if ranking and self.frame:
            out.append(f"{name}: a ranking takes no frame")
        if self.frame and not self.order and self.frame[1:] != (UNBOUNDED_PRECEDING, UNBOUNDED_FOLLOWING):
            out.append(f"{name}: a frame needs an order unless it is the whole partition")
        return out

    def spec(self):
        # an empty partition still needs a clause of its own: all rows
        w = Window.partitionBy(*map(F.col, self.partition))
        if self.order:
            w = w.orderBy(*[t.column(F.col(t.name)) for t in self.order])
        if self.frame:
            kind, start, end = self.frame
            w = w.rowsBetween(start, end) if kind == "rows" else w.rangeBetween(start, end)
        return w


def over() -> Over:
    return Over()
