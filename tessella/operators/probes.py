"""Semi- and anti-joins: rows with, or without, related rows that match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import predicates as P
from ..errors import DeclarationError
from ..model import Catalog, Relation
from .query import Query


def _child(catalog: Catalog, table: str, preds: tuple, columns: tuple[str, ...]) -> DataFrame:
    """The matching related rows' key columns under names that clash with none."""
    return Query(catalog, table).where(*preds).matching().select(*[F.col(c).alias(f"probe__{c}") for c in columns])


def _narrow(q: Query, target: str, pairs: list[tuple[str, str]], preds: tuple, how: str) -> Query:
    def run(df: DataFrame) -> DataFrame:
        child = _child(q.catalog, target, preds, tuple(b for _, b in pairs))
        return df.join(child, [df[a] == child[f"probe__{b}"] for a, b in pairs], how)

    return q.through(run)


def _sides(q: Query, relation: str) -> tuple[Relation, list[tuple[str, str]]]:
    r = q.table.relation(relation)
    if r.link:
        raise DeclarationError(f"{relation} goes through {r.link}; probe that relation")
    return r, list(zip(r.columns, r.target_columns))


def having(q: Query, relation: str, *preds: P.Pred) -> Query:
    """Rows with a related row that matches. Works along relations to one and to many; more probes may follow."""
    r, pairs = _sides(q, relation)
    return _narrow(q, r.target, pairs, preds, "left_semi")


def not_having(q: Query, relation: str, *preds: P.Pred) -> Query:
    """Rows without a related row that matches: also those without any, and those whose reference is null."""
    r, pairs = _sides(q, relation)
    return _narrow(q, r.target, pairs, preds, "left_anti")


def having_on(q: Query, target: str, pairs: list[tuple[str, str]], *preds: P.Pred) -> Query:
    """A probe on declared column pairs, without a relation."""
    return _narrow(q, target, pairs, preds, "left_semi")


def not_having_on(q: Query, target: str, pairs: list[tuple[str, str]], *preds: P.Pred) -> Query:
    return _narrow(q, target, pairs, preds, "left_anti")


class Exists(P.Pred):
    """Whether a related row exists, as a predicate that may stand inside an OR or a NOT."""

    def __init__(self, catalog: Catalog, table: str, relation: str, *preds: P.Pred):
        self.q, self.preds = Query(catalog, table), P.checked(preds)
        self.relation, self.pairs = _sides(self.q, relation)

    def to_column(self, at: P.Resolve) -> Column:
        child = _child(self.q.catalog, self.relation.target, self.preds, tuple(b for _, b in self.pairs))
        for a, b in self.pairs:
            child = child.where(F.col(f"probe__{b}") == at(a).outer())
        return child.exists()


def variant_is(q: Query, arc: str, variant: str) -> P.Pred:
    """Whether an exclusive reference points to this variant."""
    for a in q.table.arcs:
        if a.name == arc and variant in a.variants:
            return q[a.variants[variant][0]].is_not_null()
    raise DeclarationError(f"{q.name} has no variant {arc}.{variant}")
