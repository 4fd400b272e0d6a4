"""SQL text of a query."""

from __future__ import annotations

from .query import Query


def render_sql(query: Query, quote: str = '"') -> str:
    """``SELECT SUM("0".c2) FROM r3 "0", r1 "1" WHERE ...;`` with filters after joins, in source order.

    Spark needs ``quote="`"`` or ``spark.sql.ansi.doubleQuotedIdentifiers``.
    """

    def col(ref) -> str:
        return f"{quote}{ref.binding}{quote}.c{ref.column}"

    # The words and marks of the SQL form, set by its format.
    sums = ", ".join(f"SUM({col(r)})" for r in query.sums)
    tables = ", ".join(f"r{rel} {quote}{i}{quote}" for i, rel in enumerate(query.relations))
    where = [f"{col(j.left)}={col(j.right)}" for j in query.joins] + [f"{col(f.ref)}{f.op}{f.value}" for f in query.filters]
    return f"SELECT {sums} FROM {tables}" + (f" WHERE {' and '.join(where)}" if where else "") + ";"
