"""An ordered list of relations; a relation's id is its position, its columns are c0, c1, ..."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import u64
from ..plans.estimates import ColumnStat
from ..plans.query import Query, Ref
from . import binary, files


class Catalog:
    def __init__(self, relations: Iterable[DataFrame], domain: str = "bigint"):
        """``domain``: "bigint" for values and sums below 2^63, "u64" for bit patterns of unsigned values."""
        if domain not in ("bigint", "u64"):
            raise ValueError(f"unknown domain {domain!r}")
        self.relations, self.domain, self._stats = list(relations), domain, {}

    def __len__(self) -> int:
        return len(self.relations)

    def __getitem__(self, relation: int) -> DataFrame:
        return self.relations[relation]

    def width(self, relation: int) -> int:
        return len(self.relations[relation].columns)

    @classmethod
    def from_files(cls, spark: SparkSession, paths: Sequence[str], widths: Sequence[int] | None = None, domain: str | None = None) -> Catalog:
        """Files in order: ``.tbl`` text, ``.parquet``, else binary. A missing file is an error.

        Binary files hold unsigned values, so with any of them the domain is "u64" unless ``domain`` says otherwise.
        """
        out, unsigned = [], False
        for i, path in enumerate(paths):
            if not files.exists(spark, path):
                raise FileNotFoundError(path)
            if path.endswith(".tbl"):
                out.append(files.read_tbl(spark, path, widths[i] if widths else None))
            elif path.rstrip("/").endswith(".parquet"):
                out.append(integral(spark.read.parquet(path)))
            else:
                out.append(binary.read(spark, path))
                unsigned = True
        return cls(out, domain or ("u64" if unsigned else "bigint"))

    @classmethod
    def from_tables(cls, spark: SparkSession, directory: str, tables: Sequence[str]) -> Catalog:
        """The integral columns of ``<directory>/<table>.parquet``, in schema order."""
        return cls([integral(spark.read.parquet(f"{directory}/{t}.parquet")) for t in tables])

    def register(self, spark: SparkSession) -> None:
        """Temporary views r0, r1, ... for SQL text."""
        for i, df in enumerate(self.relations):
            df.createOrReplaceTempView(f"r{i}")

    def stats(self, relation: int) -> list[ColumnStat]:
        """Exact statistics of each column, from one scan; kept."""
        if relation not in self._stats:
            from ..operators.stats import column_stats

            df = self.relations[relation]
            if self.domain == "u64":
                df = df.select(*(u64.unsigned(df[c]).alias(c) for c in df.columns))
            found = {r["column"]: r for r in column_stats(df).collect()}  # a row a column
            none = {"low": 0, "high": 0, "n_rows": 0, "n_distinct": 0}
            rows = [found.get(i) or none for i in range(len(df.columns))]
            self._stats[relation] = [ColumnStat(float(r["low"] or 0), float(r["high"] or 0), r["n_rows"], r["n_distinct"]) for r in rows]
        return self._stats[relation]

    def knows(self, relations: Iterable[int]) -> bool:
        """Whether the statistics of these relations have been taken."""
        return all(r in self._stats for r in relations)

    def bound_stats(self, query: Query) -> dict[Ref, ColumnStat]:
        """The statistics of a query's columns, by binding."""
        return {Ref(b, c): s for b, rel in enumerate(query.relations) for c, s in enumerate(self.stats(rel))}

    def dump(self, first: int = 0, last: int | None = None, delimiter: str = " ") -> Iterator[str]:
        """Text dumps of the relations ``first`` to ``last`` (included), one after another; for debugging."""
        for df in self.relations[first : None if last is None else last + 1]:
            yield from files.dump_lines(df, delimiter)


def integral(df: DataFrame) -> DataFrame:
    """Integral columns as BIGINT, named c0, c1, ... in schema order."""
    kept = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    return df.select(*(F.col(f"`{c}`").cast("bigint").alias(f"c{i}") for i, c in enumerate(kept)))
