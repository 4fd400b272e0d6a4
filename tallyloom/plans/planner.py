"""From a query and a catalog to one DataFrame with one row, columns ``s0 .. sK``.

The plan is declared as pruned and filtered scans, inner equi-joins and one
global aggregate; Catalyst and adaptive execution choose the physical joins.
A join graph that isn't connected is an error, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import u64
from ..sources.catalog import Catalog
from .estimates import JoinCost
from .graph import check_connected, class_edges, equivalence_classes, join_order
from .query import Query, Ref, parse_query


class UnknownColumn(ValueError):
    """A query names a relation or column that the catalog doesn't have."""


def name(ref: Ref) -> str:
    return f"b{ref.binding}_c{ref.column}"


def validate(query: Query, catalog: Catalog) -> None:
    for rel in query.relations:
        if rel >= len(catalog):
            raise UnknownColumn(f"relation {rel} is not in the catalog of {len(catalog)}: {query}")
    for ref in query.refs():
        if ref.column >= catalog.width(query.relations[ref.binding]):
            raise UnknownColumn(f"relation {query.relations[ref.binding]} has no column {ref.column}: {query}")
    check_connected(query)


def scan(query: Query, catalog: Catalog, binding: int) -> DataFrame:
    """One binding: its filters and the equalities inside a row, implied ones included, then only the columns that the query needs."""
    df = catalog[query.relations[binding]]
    for f in query.filters:
        if f.ref.binding == binding:
            df = df.where(u64.compare(df[f"c{f.ref.column}"], f.op, f.value, catalog.domain))
    for refs in equivalence_classes(query):
        own = [df[f"c{r.column}"] for r in refs if r.binding == binding]
        for c in own[1:]:
            df = df.where(own[0] == c)
    needed = sorted({r for r in query.refs() if r.binding == binding})
    return df.select(*(df[f"c{r.column}"].alias(name(r)) for r in needed))


def joined(query: Query, catalog: Catalog, reorder: bool = False) -> DataFrame:
    """All bindings joined; columns ``b<binding>_c<column>``."""
    validate(query, catalog)
    cost = JoinCost(query, catalog.bound_stats(query)) if reorder and len(query.relations) > 2 else None
    order, classes = join_order(query, cost), equivalence_classes(query)
    out, bound = scan(query, catalog, order[0]), {order[0]}
    for b in order[1:]:
        right = scan(query, catalog, b)
        on = []
        for refs in classes:  # a class is met once: its bound columns are equal already
            here, there = (next((r for r in refs if r.binding in s), None) for s in ({b}, bound))
            if here and there:
                on.append(out[name(there)] == right[name(here)])
        out, bound = out.join(right, u64.all_of(on), "inner"), bound | {b}
    return out


def join_tree(query: Query) -> list[tuple[int, Ref, Ref]] | None:
    """(binding, its key, its parent's key), leaves first, if one edge ties each binding to a tree under binding 0; else None."""
    edges = class_edges(query)
    if len(edges) != len(query.relations) - 1:
        return None
    order, bound = [], {0}
    while len(bound) < len(query.relations):
        near = next((j for j in edges if (j.left.binding in bound) != (j.right.binding in bound)), None)
        if near is None:
            return None
        up, own = (near.left, near.right) if near.left.binding in bound else (near.right, near.left)
        order.append((own.binding, own, up))
        bound.add(own.binding)
    return order[::-1]


def preaggregated(query: Query, catalog: Catalog) -> DataFrame | None:
    """The sums of a tree-shaped query without its fan-out; None if the joins are no tree or values are bit patterns.

    From the leaves up, a binding is reduced to a row a key of its parent: the
    number of combinations below it and the sums over them. A parent's rows
    multiply what its children give. A join then meets a key once on that side,
    whatever the multiplicity, and only partial sums are shuffled. Products and
    sums are decimals of 38 digits.
    """
    tree = join_tree(query)
    if tree is None or catalog.domain != "bigint":
        return None
    validate(query, catalog)
    wide = "decimal(38,0)"
    frames = {b: scan(query, catalog, b).withColumn("n", F.lit(1).cast("decimal(20,0)")) for b in range(len(query.relations))}
    held: dict[int, dict[str, Column]] = {b: {} for b in frames}  # sums that a binding's frame carries: by name, the value of a row
    for i, ref in enumerate(query.sums):
        held[ref.binding][f"s{i}"] = F.col(name(ref)).cast("decimal(20,0)")
    total = lambda b: [F.sum(v.cast(wide) * F.col("n").cast(wide) if k in own[b] else v).cast(wide).alias(k) for k, v in held[b].items()]
    own = {b: set(h) for b, h in held.items()}
    for b, key, up in tree:
        reduced = frames[b].groupBy(F.col(name(key)).alias("k")).agg(F.sum("n").cast(wide).alias("m"), *total(b))
        parent = up.binding
        joined = frames[parent].join(reduced, F.col(name(up)) == F.col("k")).drop("k")
        # What the parent holds from other children is per combination of them, so this child's number multiplies it, and the other way round.
        others = [c for c in held[parent] if c not in own[parent]]
        joined = joined.select(*(c for c in frames[parent].columns if c != "n" and c not in others), *((F.col(c) * F.col("m")).cast(wide).alias(c) for c in others), *((F.col(c) * F.col("n")).cast(wide).alias(c) for c in held[b]), (F.col("n") * F.col("m")).cast(wide).alias("n"))
        frames[parent] = joined
        held[parent] |= {c: F.col(c) for c in held[b]}
    sums = dict(zip(held[0], total(0), strict=True))
    return frames[0].agg(*(sums[f"s{i}"] for i in range(len(query.sums))))


def fans_out(query: Query, catalog: Catalog) -> bool:
    """Whether statistics that have been taken tell of a join whose keys repeat on both sides."""
    if not catalog.knows(query.relations):
        return False
    stats = catalog.bound_stats(query)
    repeats = lambda r: stats[r].rows > stats[r].distinct
    return any(repeats(j.left) and repeats(j.right) for j in class_edges(query))


def plan_query(query: Query | str, catalog: Catalog, reorder: bool = False, zero_as_null: bool = True, preaggregate: bool | None = None) -> DataFrame:
    """The sums of a query, in SELECT order. A sum of 0 is NULL, as on no row, unless ``zero_as_null`` is off.

    ``preaggregate`` sums below the joins where the query allows it, which pays
    where keys repeat on both sides; by default it is done where statistics that
    the catalog has taken say so.
    """
    if isinstance(query, str):
        query = parse_query(query, allow_no_predicates=True)
    if preaggregate is None:
        validate(query, catalog)
        preaggregate = fans_out(query, catalog)
    if preaggregate and (out := preaggregated(query, catalog)) is not None:
        sums = [F.col(c).cast("bigint") for c in out.columns]
        return out.select(*((u64.zero_as_null(s) if zero_as_null else s).alias(f"s{i}") for i, s in enumerate(sums)))
    rows = joined(query, catalog, reorder)
    sums = [u64.wrapped_sum(rows[name(r)], catalog.domain) for r in query.sums]
    if zero_as_null:
        sums = [u64.zero_as_null(s) for s in sums]
    return rows.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums)))
