"""Delimited text relations, and file checks through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, for any scheme that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return bool(fs.exists(p))


def read_tbl(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """``|``-separated BIGINT columns; the ``|`` at the end of a line makes no column. Without ``width`` the first line tells it.

    An empty field is NULL; a field that is no number and a line with more or fewer fields are errors.
    """
    if width is None:
        head = spark.read.text(path).limit(1).collect()
        if not head:
            raise ValueError(f"{path} is empty: its width must be given")
        width = len(head[0][0].rstrip().rstrip("|").split("|"))
    schema = ", ".join(f"c{i} bigint" for i in range(width))
    # Every field is parsed, needed or not, so that a malformed, short or long line is an error wherever it stands.
    lines = spark.read.option("columnPruning", "false").csv(path, sep="|", schema=f"{schema}, rest string", mode="FAILFAST")
    closed = F.when(F.coalesce("rest", F.lit("")) == "", True).otherwise(F.raise_error(F.concat(F.lit("a line goes on after its last field: "), "rest")).cast("boolean"))
    least = F.lit(-(2**63)).cast("bigint")
    read = F.greatest(least, *(F.col(f"c{i}") for i in range(width))) >= least  # always true, but only fields that are used are parsed
    return lines.where(closed & read).select(*(f"c{i}" for i in range(width)))


def write_tbl(df: DataFrame, path: str) -> None:
    """The inverse of ``read_tbl``: one folder of text files, each line closed by ``|``."""
    df.select(F.concat(F.concat_ws("|", *(F.col(c).cast("string") for c in df.columns)), F.lit("|")).alias("value")).write.mode("overwrite").text(path)


def dump_lines(df: DataFrame, delimiter: str = " ") -> list[str]:
    """Text dump of a small relation: ``<columns> <rows>``, then the rows without a delimiter at the end.

    For debugging: it brings the relation to the driver, through an iterator that holds a partition at a time.
    """
    lines = [delimiter.join(map(str, row)) for row in df.toLocalIterator()]
    return [f"{len(df.columns)} {len(lines)}", *lines]


def write_dump(df: DataFrame, path: str, delimiter: str = " ") -> None:
    """The rows of ``dump_lines`` as a distributed write."""
    df.write.mode("overwrite").csv(path, sep=delimiter)


def dump_pairs(df: DataFrame, key: str, row: str) -> list[str]:
    """``<key> <row>`` of a small scan, a line a row, in the rows' order; for debugging."""
    return [f"{k} {r}" for k, r in df.select(key, row).toLocalIterator()]
