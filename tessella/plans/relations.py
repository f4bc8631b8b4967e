"""Relation plans: parents with their related rows, as nested structs and arrays, in one Spark plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import predicates as P
from ..errors import ChildLimitError, DeclarationError, QueryError
from ..model import Arc
from ..operators.ordering import Term
from ..operators.query import Query

CHILD_LIMIT = 1 << 20


@dataclass
class _Edge:
    relation: str
    plan: Plan
    top: int | None
    order: tuple[Term, ...]
    payload: bool


@dataclass
class Plan:
    """A parent query and the relations to load with it; `into` nests.

    `child_limit` bounds the related rows of all parents together: more is an error, never a shorter answer. A collected plan has one
    always; a DataFrame, whose rows stay distributed, only where `limited` sets it. `top` takes so many per parent and needs an order.
    """

    query: Query
    edges: list[_Edge] = field(default_factory=list)
    arcs: list[tuple[Arc, dict[str, tuple[str, ...]]]] = field(default_factory=list)
    child_limit: int | None = None

    def load(self, relation: str, *preds: P.Pred, order: tuple[Term, ...] = (), top: int | None = None, payload: bool = False, into=None) -> Plan:
        r = self.query.table.relation(relation)
        if top is not None and not order:
            raise QueryError("so many per parent needs an order")
        if payload and not r.link:
            raise DeclarationError(f"{relation} has no linking table to take columns from")
        child = Plan(Query(self.query.catalog, r.target).where(*preds), child_limit=self.child_limit)
        if into is not None:
            into(child)
        self.edges.append(_Edge(relation, child, top, tuple(order), payload))
        return self

    def load_arc(self, name: str) -> Plan:
        """All variants of an exclusive reference: the one that is set, with `kind`."""
        for a in self.query.table.arcs:
            if a.name == name:
                self.arcs.append((a, {}))
                return self
        raise DeclarationError(f"{self.query.name} has no arc {name}")

    def limited(self, n: int) -> Plan:
        self.child_limit = n
        return self

    # building
    def _rows(self, parents: DataFrame) -> DataFrame:
        columns = parents.columns
        for e in self.edges:
            parents = self._attach(parents, e)
            columns = [*columns, e.relation]
            parents = parents.select(*columns)
        for arc, _ in self.arcs:
            parents = self._attach_arc(parents, arc)
        return parents

    def _children(self, e: _Edge) -> tuple[DataFrame, list[str]]:
        """Related rows as `item__` with their parent's keys and, where there is an order, their number `rn__` in it."""
        r = self.query.table.relation(e.relation)
        catalog = self.query.catalog
        children = e.plan._rows(e.plan.query.matching().select(*[c.name for c in catalog.table(r.target).columns]))
        row = F.struct(*[F.col(c) for c in children.columns])
        keys = [f"key__{i}" for i in range(len(r.columns))]
        if r.kind == "one":
            return children.select(*[F.col(c).alias(k) for c, k in zip(r.target_columns, keys)], row.alias("item__")), keys
        if r.link:
            # the link gives each far row its parent; a pair that is linked twice counts once
            here, there = r.link_columns
            link = catalog.live(r.link)
            far = children.select(row.alias("far__row"), *[F.col(c).alias(f"far__{i}") for i, c in enumerate(r.target_columns)])
            held = link.select(*[F.col(c).alias(k) for c, k in zip(here, keys)], *[F.col(c).alias(f"there__{i}") for i, c in enumerate(there)], F.struct(*link.columns).alias("link__row"))
            if not e.payload:
                held = held.drop("link__row").distinct()
            joined = held.join(far, [held[f"there__{i}"] == far[f"far__{i}"] for i in range(len(there))])
            item = F.struct("link__row.*", "far__row.*") if e.payload else F.col("far__row")
            children = joined.select(*keys, item.alias("item__"), "far__row")
            at = lambda name: F.col("far__row")[name]
        else:
            children = children.select(*[F.col(c).alias(k) for c, k in zip(r.target_columns, keys)], row.alias("item__"))
            at = lambda name: F.col("item__")[name]
        children = children.dropna(subset=keys)
        target = catalog.table(r.target)
        plain = [c.name for c in target.columns if not c.type.array and c.type.spark != "variant"]
        order = e.order or tuple(Term(c) for c in target.primary_key or plain)
        sort = [t.column(catalog.order_value(r.target, t.name, at(t.name))) for t in order]
        # numbered rows sort inside their array; a bare collected list has no order
        children = children.withColumn("rn__", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort)) if sort else F.lit(1))
        return (children if e.top is None else children.where(F.col("rn__") <= e.top)), keys

    def _attach(self, parents: DataFrame, e: _Edge) -> DataFrame:
        r = self.query.table.relation(e.relation)
        children, keys = self._children(e)
        if r.kind == "one":
            near = children.withColumnRenamed("item__", e.relation)
            return parents.join(near, [parents[a] == near[k] for a, k in zip(r.columns, keys)], "left")
        lists = children.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rn__", "item__"))).alias("items__"))
        lists = lists.withColumnsRenamed({k: f"of__{k}" for k in keys})
        joined = parents.join(lists, [parents[a] == lists[f"of__{k}"] for a, k in zip(r.columns, keys)], "left")
        empty = F.array().cast(lists.schema["items__"].dataType)
        return joined.withColumn(e.relation, F.transform(F.coalesce("items__", empty), lambda x: x["item__"]))

    def flat(self, relation: str) -> DataFrame:
        """A row for each parent and related row, its struct in a column of the relation's name (null where there is none).

        Nothing is gathered by parent but by `top` or an order of its own, so a parent with very many related rows is no task's burden.
        """
        (e,) = [e for e in self.edges if e.relation == relation] or [None]
        if e is None:
            raise QueryError(f"the plan loads no {relation}")
        if e.order and e.top is None:
            raise QueryError("flat rows have no order inside a parent; order the result, or take so many per parent")
        r = self.query.table.relation(relation)
        parents = self.query.df()
        children, keys = self._children(e)
        children = children.select(*keys, F.col("item__").alias(relation))
        on = [parents[a] == children[k] for a, k in zip(r.columns, keys)]
        return parents.join(children, on, "left").select(*[parents[c] for c in parents.columns], relation)

    def _attach_arc(self, parents: DataFrame, arc: Arc) -> DataFrame:
        kind = F.lit(None).cast("string")
        for name, (column, table) in arc.variants.items():
            target = self.query.catalog.table(table)
            (key,) = target.primary_key
            rows = self.query.catalog.live(table)
            near = rows.select(F.col(key).alias("arc__key"), F.struct(*rows.columns).alias(f"{arc.name}_{name}"))
            parents = parents.join(near, parents[column] == near["arc__key"], "left").drop("arc__key")
            kind = F.when(F.col(column).isNotNull(), F.lit(name)).otherwise(kind)
        return parents.withColumn(f"{arc.name}_kind", kind)

    def _built(self) -> DataFrame:
        out = self._rows(self.query.df())
        order = self.query.sort_columns()
        return out.orderBy(*order) if order else out

    def _checked(self, df: DataFrame, limit: int) -> None:
        sizes = [F.sum(F.size(e.relation)).alias(e.relation) for e in self.edges if self.query.table.relation(e.relation).kind == "many"]
        if sizes:
            for name, n in df.agg(*sizes).first().asDict().items():
                if (n or 0) > limit:
                    raise ChildLimitError(f"{name} has {n} rows; the limit is {limit}")

    def df(self) -> DataFrame:
        """Parents with one column per relation: a struct (or null) to one, an array of structs to many."""
        df = self._built()
        if self.child_limit is not None:
            self._checked(df, self.child_limit)
        return df

    def all(self) -> list:
        """Collects, after checking each relation to many against the limit."""
        df = self._built()
        self._checked(df, CHILD_LIMIT if self.child_limit is None else self.child_limit)
        return df.collect()


def plan(query: Query) -> Plan:
    return Plan(query)
