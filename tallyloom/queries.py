"""One query per operator over the TPC-H-like tables, with SQL for the same rows.

The SQL is written by hand, not rendered, so that both sides share no fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import relational, stats
from .plans.estimates import ColumnStat, JoinCost, estimate_equality, estimate_join
from .plans.graph import join_order
from .plans.planner import joined, plan_query
from .plans.query import Ref, parse_query
from .plans.render import render_sql
from .sources import binary, files
from .sources.catalog import Catalog
from .storage import shared_path
from .streaming.batches import read_batches, read_filenames

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "pages", "benchmark", "conversations")

#: Query text by operator. Relation ids are positions in TABLES, columns the integral ones in schema order.
TEXTS = {
    "scan_parquet": "6|0.3>0|0.0 0.1 0.2 0.3",
    "filter_gt": "5|0.1>700|0.0",
    "filter_lt": "5|0.1<700|0.0",
    "filter_eq": "5|0.1=7|0.0 0.1",
    "filter_and": "6|0.0>100&0.1<900&0.3=2|0.0 0.1",
    "filter_multi": "6 5|0.0=1.0&0.3<4&1.1>20|0.1 1.1",
    "join_as_filter": "6 5 2|0.0=1.0&1.1=2.0&2.0=1.1&1.1=2.0|0.1 2.1",
    "intra_row_eq": "6|0.2=0.3|0.0 0.2",
    "project": "6 5|0.0=1.0|1.1 0.2 1.1",
    "join_equi": "6 5|0.0=1.0|0.1 1.1",
    "join_initial": "5 2|0.1=1.0&0.0>50&1.1<20|0.0 1.1",
    "join_extend": "6 5 2 1|0.0=1.0&1.1=2.0&2.1=3.0&3.1=2|0.0 2.0 3.0",
    "join_bushy": "6 5 3 1|0.0=1.0&2.1=3.0&0.2=2.0|1.1 3.1 0.1",
    "self_join": "5 5|0.1=1.1|0.0 1.0",
    "join_multi_key": "6 5|0.0=1.0&0.1=1.1|0.0 1.1",
    "join_redundant": "6 5|0.0=1.0&1.0=0.0&0.0=1.0|0.1",
    "join_star": "6 5 4 3|0.0=1.0&0.1=2.0&0.2=3.0&2.1<10|1.1 2.1 3.1",
    "join_chain": "6 5 2 1 0|0.0=1.0&1.1=2.0&2.1=3.0&3.1=4.0&4.0>1|0.0 4.0",
    "sum_global": "5|0.0>0|0.0",
    "sum_multi": "6 5|0.0=1.0&1.1<50|0.1 0.2 0.1",
    "sum_of_join_key": "6 5|0.0=1.0|0.0 1.0",
    "sum_empty": "6 5|0.0=1.0&0.3=99|0.0 1.1",
    "sum_zero_null": "1 0|0.1=1.0&1.0=0|1.0 0.0",
    "flagship": "6 5 2|0.0=1.0&1.1=2.0&2.1<5|0.2 1.0 2.1",
}


def _sum(select: str, rest: str) -> str:
    return "SELECT " + ", ".join(f"NULLIF(CAST(SUM({c}) AS BIGINT), 0) AS s{i}" for i, c in enumerate(select.split())) + f" FROM {rest}"


_LO = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
_LOC = f"{_LO} JOIN customer c ON o.o_custkey = c.c_custkey"
SQL = {
    "scan_parquet": _sum("l_orderkey l_partkey l_suppkey l_linenumber", "lineitem WHERE l_linenumber > 0"),
    "filter_gt": _sum("o_orderkey", "orders WHERE o_custkey > 700"),
    "filter_lt": _sum("o_orderkey", "orders WHERE o_custkey < 700"),
    "filter_eq": _sum("o_orderkey o_custkey", "orders WHERE o_custkey = 7"),
    "filter_and": _sum("l_orderkey l_partkey", "lineitem WHERE l_orderkey > 100 AND l_partkey < 900 AND l_linenumber = 2"),
    "filter_multi": _sum("l_partkey o_custkey", f"{_LO} WHERE l_linenumber < 4 AND o_custkey > 20"),
    "join_as_filter": _sum("l_partkey c_nationkey", _LOC),
    "intra_row_eq": _sum("l_orderkey l_suppkey", "lineitem WHERE l_suppkey = l_linenumber"),
    "project": _sum("o_custkey l_suppkey o_custkey", _LO),
    "join_equi": _sum("l_partkey o_custkey", _LO),
    "join_initial": _sum("o_orderkey c_nationkey", "orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 50 AND c_nationkey < 20"),
    "join_extend": _sum("l_orderkey c_custkey n_nationkey", f"{_LOC} JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"),
    "join_bushy": _sum("o_custkey n_regionkey l_partkey", f"{_LO} JOIN (supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey"),
    "self_join": _sum("a.o_orderkey b.o_orderkey", "orders a JOIN orders b ON a.o_custkey = b.o_custkey"),
    "join_multi_key": _sum("l_orderkey o_custkey", f"{_LO} AND l.l_partkey = o.o_custkey"),
    "join_redundant": _sum("l_partkey", _LO),
    "join_star": _sum("o_custkey p_size s_nationkey", f"{_LO} JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 10"),
    "join_chain": _sum("l_orderkey r_regionkey", f"{_LOC} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 1"),
    "sum_global": _sum("o_orderkey", "orders WHERE o_orderkey > 0"),
    "sum_multi": _sum("l_partkey l_suppkey l_partkey", f"{_LO} WHERE o_custkey < 50"),
    "sum_of_join_key": _sum("l_orderkey o_orderkey", _LO),
    "sum_empty": _sum("l_orderkey o_custkey", f"{_LO} WHERE l_linenumber = 99"),
    "sum_zero_null": _sum("r_regionkey n_nationkey", "nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 0"),
    "flagship": _sum("l_suppkey o_orderkey c_nationkey", f"{_LOC} WHERE c_nationkey < 5"),
}


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.from_tables(spark, sf_dir, TABLES)


def _sums(text: str, preaggregate: bool = False):
    """Only the relations that the text names are opened."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = parse_query(text)
        opened = {TABLES[r] for r in query.relations}
        catalog = Catalog([])
        catalog.relations = [Catalog.from_tables(spark, sf_dir, [t])[0] if t in opened else None for t in TABLES]
        return plan_query(query, catalog, preaggregate=preaggregate)

    return run


def _scan_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lineitem.tbl")
    files.write_tbl(_catalog(spark, sf_dir)[6], path)
    return plan_query("0|0.0>10|0.0 0.1 0.2 0.3", Catalog([files.read_tbl(spark, path, 4)]))


def _scan_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem through the binary format, with a column of values beyond 2^63 in a filter, a join and sums that wrap."""
    rows = _catalog(spark, sf_dir)[6].withColumn("c4", F.bitwise_not("c0"))  # the pattern of 2^64-1-c0
    path = shared_path(spark, "lineitem")
    binary.write_folder(rows, path)
    catalog = Catalog.from_files(spark, [path])
    return plan_query("0 0|0.4=1.4&0.3=1.3&0.1=1.1&0.2=1.2&0.4>9223372036854775808|0.0 0.1 1.4", catalog).select(*(F.col(f"s{i}").cast("string").alias(f"s{i}") for i in range(3)))


def _catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog.from_files(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES])
    rows = [catalog[i].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).cast("bigint").alias("relation"), F.lit(catalog.width(i)).cast("bigint").alias("n_columns"), "n_rows") for i in range(len(catalog))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _full_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _catalog(spark, sf_dir)[5]
    return relational.filtered_scan(orders, [orders.c1 > 10, orders.c0 > 20], ["c1", "c0"]).select(F.col("c1").alias("k"), F.col("c0").alias("rid"))


def _sort_key_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _catalog(spark, sf_dir)[5].select(F.col("c1").alias("k"), F.col("c0").alias("rid"))
    return relational.sort_by_key(orders, "k", "rid")


def _answers(texts: list[str]):
    """The answer lines of a batch as rows, still one distributed plan a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for i, text in enumerate(texts):
            df = _sums(text)(spark, sf_dir)
            line = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns))
            row = df.select(F.lit(i).cast("bigint").alias("query"), line.alias("line"))
            out = row if out is None else out.unionByName(row)
        return out

    return run


def _col_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(_catalog(spark, sf_dir)[6])


def _catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.catalog_stats(_catalog(spark, sf_dir))


def _estimates(spark: SparkSession, stats: dict[Ref, ColumnStat]) -> DataFrame:
    rows = [(r.binding, r.column, float(s.low), float(s.high), round(float(s.rows), 3), round(float(s.distinct), 3)) for r, s in sorted(stats.items())]
    return spark.createDataFrame(rows, "binding bigint, column bigint, low double, high double, est_rows double, est_distinct double")


def _opened(spark: SparkSession, sf_dir: str, relations: list[int]) -> dict[Ref, ColumnStat]:
    catalog = Catalog.from_tables(spark, sf_dir, [TABLES[r] for r in relations])
    return {Ref(b, c): s for b in range(len(relations)) for c, s in enumerate(catalog.stats(b))}


def _est_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, estimate_equality(_opened(spark, sf_dir, [5]), Ref(0, 1), 7))


def _est_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, estimate_join(_opened(spark, sf_dir, [6, 5]), Ref(0, 0), Ref(1, 0)))


def _est_same_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, estimate_join(_opened(spark, sf_dir, [6]), Ref(0, 2), Ref(0, 3)))


def _est_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated rows after each step of the chain lineitem, orders, customer."""
    query = parse_query("0 1 2|0.0=1.0&1.1=2.0|0.1")
    catalog = Catalog.from_tables(spark, sf_dir, ["lineitem", "orders", "customer"])
    cost = JoinCost(query, catalog.bound_stats(query))
    rows = [(step, round(float(cost(frozenset(range(step)), step)), 3)) for step in (1, 2)]
    return spark.createDataFrame(rows, "step bigint, cost double")


def _stats_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A self-join's bindings each have their relation's statistics."""
    catalog = Catalog.from_tables(spark, sf_dir, ["orders"])
    return _estimates(spark, catalog.bound_stats(parse_query("0 0|0.1=1.1|0.0")))


def _join_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a bushy query's bindings are joined."""
    order = join_order(parse_query(TEXTS["join_bushy"]))
    return spark.createDataFrame(list(enumerate(order)), "step bigint, binding bigint")


def _ir_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a join, by the columns that a further step reads."""
    return joined(parse_query("0 1|0.1=1.0|0.0 1.1"), Catalog.from_tables(spark, sf_dir, ["orders", "customer"]))


def _relation_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of orders as a text dump writes them."""
    files.write_dump(_catalog(spark, sf_dir)[5], path := shared_path(spark, "dump"))
    return spark.read.text(path).select(F.col("value").alias("line"))


def _catalog_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dumps of region and nation, one after another."""
    lines = Catalog.from_tables(spark, sf_dir, TABLES[:2]).dump()
    return spark.createDataFrame(list(enumerate(lines)), "position bigint, line string")


def _joinable_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and row of every nation."""
    lines = files.dump_pairs(_catalog(spark, sf_dir)[1], "c1", "c0")
    return spark.createDataFrame([(x,) for x in lines], "line string")


def _file_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, files.exists(spark, f"{sf_dir}/{t}.parquet")) for t in (*TABLES, "no_such_table")], "name string, present boolean")


def _read_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = iter(["region", "", " nation ", "DONE", TEXTS["join_equi"]])
    return spark.createDataFrame(list(enumerate(read_filenames(script))), "position bigint, name string")


def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(" 6  5 | 0.0 = 1.0 & 1.1 < 50 | 0.1  0.2 ")(spark, sf_dir)


def _render(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "6 5 2|0.0=1.0&1.1=2.0&2.1<5|0.2 1.0 2.1"
    _catalog(spark, sf_dir).register(spark)
    sql = render_sql(parse_query(text), quote="`").rstrip(";")
    return spark.sql(sql).toDF("s0", "s1", "s2")


def _read_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = [TEXTS["join_equi"], TEXTS["sum_empty"], "F", TEXTS["sum_zero_null"]]
    return _answers([t for batch in read_batches(iter(script)) for t in batch])(spark, sf_dir)


def queries() -> dict:
    out = {k: _sums(t) for k, t in TEXTS.items()}
    return out | {
        "scan_tbl": _scan_tbl, "catalog_load": _catalog_load, "full_scan_filter": _full_scan_filter, "sort_key_rowid": _sort_key_rowid,
        "col_stats": _col_stats, "catalog_stats": _catalog_stats, "est_filter_eq": _est_filter_eq, "est_join": _est_join, "est_same_relation": _est_same_relation, "scan_binary": _scan_binary,
        "sum_pushdown": _sums(TEXTS["join_star"], preaggregate=True),
        "self_join": _sums(TEXTS["self_join"], preaggregate=True),  # no pairs of a hot customer's orders
        "est_cost": _est_cost, "stats_bind": _stats_bind, "join_executor": _join_executor, "ir_scan": _ir_scan, "relation_dump": _relation_dump, "catalog_dump": _catalog_dump,
        "joinable_dump": _joinable_dump, "file_exists": _file_exists, "read_filenames": _read_filenames,
        "parse_query": _parse, "render_sql": _render, "read_batch": _read_batch,
        "result_lines": _answers([TEXTS["flagship"], TEXTS["sum_multi"], TEXTS["sum_empty"], TEXTS["sum_zero_null"]]),
    }


_COLUMNS = {
    "region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey", "supplier": "s_suppkey s_nationkey", "part": "p_partkey p_size",
    "orders": "o_orderkey o_custkey", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber", "events": "event_id user_id", "documents": "doc_id n_chars",
    "embeddings": "vec_id label", "labels": "doc_id quality toxic", "pages": "page_id", "benchmark": "item_id", "conversations": "conv_id turn",
}


# The estimates' formulas, written from the survey of what is to be computed: l, u, f, d are a column's least and largest value, rows and distinct values.
_F = "SELECT MIN({c}) AS l, MAX({c}) AS u, CAST(COUNT(*) AS DOUBLE) AS f, CAST(COUNT(DISTINCT {c}) AS DOUBLE) AS d FROM {t}"
_EST_ROW = "SELECT CAST({b} AS BIGINT) AS binding, CAST({i} AS BIGINT) AS \"column\", CAST({l} AS DOUBLE) AS low, CAST({u} AS DOUBLE) AS high, ROUND({f}, 3) AS est_rows, ROUND({d}, 3) AS est_distinct"
_EST_FILTER = (
    _EST_ROW.format(b=0, i=0, l="l", u="u", f="f", d="d * (1 - POW(1 - 1 / f, f / d))") + f" FROM ({_F.format(c='o_orderkey', t='orders')}) x UNION ALL "
    + _EST_ROW.format(b=0, i=1, l=7, u=7, f="CAST(1 AS DOUBLE)", d="CAST(0 AS DOUBLE)")
)


def _est_join_sql() -> str:
    """lineitem and orders on the order key: the common column's n values, rows and distinct values; the other columns keep the share d'/d of the join column."""
    head = f"WITH a AS ({_F.format(c='l_orderkey', t='lineitem')}), b AS ({_F.format(c='o_orderkey', t='orders')}), n AS (SELECT GREATEST(a.l, b.l) AS l, LEAST(a.u, b.u) AS u, a.d AS da, b.d AS db, a.f AS fa, b.f AS fb FROM a, b), j AS (SELECT l, u, fa * fb / (u - l + 1) AS f, da * db / (u - l + 1) AS d, da, db FROM n) "
    parts = []
    for binding, (table, columns, own) in enumerate((("lineitem", "l_orderkey l_partkey l_suppkey l_linenumber", "da"), ("orders", "o_orderkey o_custkey", "db"))):
        parts.append(_EST_ROW.format(b=binding, i=0, l="l", u="u", f="f", d="d") + " FROM j")
        for i, c in list(enumerate(columns.split()))[1:]:
            parts.append(_EST_ROW.format(b=binding, i=i, l="x.l", u="x.u", f="j.f", d=f"x.d * (1 - POW(1 - LEAST(1, j.d / j.{own}), x.f / x.d))") + f" FROM j, ({_F.format(c=c, t=table)}) x")
    return head + " UNION ALL ".join(parts)


def _est_same_sql() -> str:
    """Two columns of lineitem made equal: f/n rows; distinct values and the other columns shrink by the share f'/f."""
    head = f"WITH a AS ({_F.format(c='l_suppkey', t='lineitem')}), b AS ({_F.format(c='l_linenumber', t='lineitem')}), j AS (SELECT GREATEST(a.l, b.l) AS l, LEAST(a.u, b.u) AS u, a.f / (LEAST(a.u, b.u) - GREATEST(a.l, b.l) + 1) AS f, a.f AS fa, a.d AS da FROM a, b) "
    joined = "da * (1 - POW(1 - f / fa, fa / da))"
    parts = [_EST_ROW.format(b=0, i=i, l="l", u="u", f="f", d=joined) + " FROM j" for i in (2, 3)]
    parts += [_EST_ROW.format(b=0, i=i, l="x.l", u="x.u", f="j.f", d="x.d * (1 - POW(1 - j.f / j.fa, x.f / x.d))") + f" FROM j, ({_F.format(c=c, t='lineitem')}) x" for i, c in enumerate(("l_orderkey", "l_partkey"))]
    return head + " UNION ALL ".join(parts)


# After the first step the join column of orders' customers has as many rows as the join.
_EST_COST = (
    f"WITH a AS ({_F.format(c='l_orderkey', t='lineitem')}), b AS ({_F.format(c='o_orderkey', t='orders')}), c AS ({_F.format(c='o_custkey', t='orders')}), d AS ({_F.format(c='c_custkey', t='customer')}), "
    "j AS (SELECT a.f * b.f / (LEAST(a.u, b.u) - GREATEST(a.l, b.l) + 1) AS f FROM a, b), k AS (SELECT j.f * d.f / (LEAST(c.u, d.u) - GREATEST(c.l, d.l) + 1) AS f FROM j, c, d) "
    "SELECT CAST(1 AS BIGINT) AS step, ROUND(f, 3) AS cost FROM j UNION ALL SELECT 2, ROUND(f, 3) FROM k"
)
_EST_JOIN, _EST_SAME = _est_join_sql(), _est_same_sql()
_WRAP = "CAST(NULLIF(SUM(CAST({v} AS HUGEINT)) % 18446744073709551616, 0) AS VARCHAR)"
_SCAN_BINARY = (
    f"SELECT {_WRAP.format(v='a.l_orderkey')} AS s0, {_WRAP.format(v='a.l_partkey')} AS s1, {_WRAP.format(v='18446744073709551615 - b.l_orderkey')} AS s2 "
    "FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey"
)


def _stats_sql(table: str, relation: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {relation}CAST({i} AS BIGINT) AS \"column\", CAST(MIN({c}) AS BIGINT) AS low, CAST(MAX({c}) AS BIGINT) AS high, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS n_distinct FROM {table}" for i, c in enumerate(_COLUMNS[table].split())
    )


def _lines_sql(names: list[str]) -> str:
    def one(i: int, name: str) -> str:
        n = len(parse_query(TEXTS[name]).sums)
        return f"SELECT CAST({i} AS BIGINT) AS query, CONCAT_WS(' ', {', '.join(f"COALESCE(CAST(s{k} AS VARCHAR), 'NULL')" for k in range(n))}) AS line FROM ({SQL[name]}) q{i}"

    return " UNION ALL ".join(one(i, n) for i, n in enumerate(names))


def oracle_sql() -> dict[str, str]:
    return SQL | {
        "scan_tbl": _sum("l_orderkey l_partkey l_suppkey l_linenumber", "lineitem WHERE l_orderkey > 10"),
        "catalog_load": " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS relation, CAST({len(_COLUMNS[t].split())} AS BIGINT) AS n_columns, CAST(COUNT(*) AS BIGINT) AS n_rows FROM {t}" for i, t in enumerate(TABLES)),
        "full_scan_filter": "SELECT o_custkey AS k, o_orderkey AS rid FROM orders WHERE o_custkey > 10 AND o_orderkey > 20",
        "sort_key_rowid": "SELECT o_custkey AS k, o_orderkey AS rid FROM orders ORDER BY k, rid",
        "col_stats": _stats_sql("lineitem"),
        "catalog_stats": " UNION ALL ".join(_stats_sql(t, f"CAST({i} AS BIGINT) AS relation, ") for i, t in enumerate(TABLES)),
        "est_filter_eq": _EST_FILTER,
        "est_join": _EST_JOIN,
        "est_same_relation": _EST_SAME,
        "scan_binary": _SCAN_BINARY,
        "est_cost": _EST_COST,
        "stats_bind": " UNION ALL ".join(_EST_ROW.format(b=b, i=i, l="l", u="u", f="f", d="d") + f" FROM ({_F.format(c=c, t='orders')}) x" for b in (0, 1) for i, c in enumerate(("o_orderkey", "o_custkey"))),
        "join_executor": "SELECT CAST(i AS BIGINT) AS step, CAST(i AS BIGINT) AS binding FROM RANGE(4) t(i)",
        "ir_scan": "SELECT o_orderkey AS b0_c0, o_custkey AS b0_c1, c_custkey AS b1_c0, CAST(c_nationkey AS BIGINT) AS b1_c1 FROM orders JOIN customer ON o_custkey = c_custkey",
        "relation_dump": "SELECT CONCAT_WS(' ', o_orderkey, o_custkey) AS line FROM orders",
        "catalog_dump": "SELECT CAST(ROW_NUMBER() OVER (ORDER BY t, k) - 1 AS BIGINT) AS position, line FROM (SELECT 0 AS t, -1 AS k, '1 ' || COUNT(*) AS line FROM region UNION ALL SELECT 0, r_regionkey, CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 1, -1, '2 ' || COUNT(*) FROM nation UNION ALL SELECT 1, n_nationkey, n_nationkey || ' ' || n_regionkey FROM nation) x",
        "joinable_dump": "SELECT n_regionkey || ' ' || n_nationkey AS line FROM nation",
        "file_exists": " UNION ALL ".join(f"SELECT '{t}' AS name, {str(t in TABLES).upper()} AS present" for t in (*TABLES, "no_such_table")),
        "read_filenames": "SELECT CAST(0 AS BIGINT) AS position, 'region' AS name UNION ALL SELECT 1, 'nation'",
        "parse_query": _sum("l_partkey l_suppkey", f"{_LO} WHERE o_custkey < 50"),
        "sum_pushdown": SQL["join_star"],
        "render_sql": SQL["flagship"],
        "read_batch": _lines_sql(["join_equi", "sum_empty", "sum_zero_null"]),
        "result_lines": _lines_sql(["flagship", "sum_multi", "sum_empty", "sum_zero_null"]),
    }
