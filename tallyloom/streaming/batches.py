"""Scripts: file names up to ``Done``, then batches of queries, each closed by ``F``.

The queries of a batch run at once on driver threads over one session (with
``spark.scheduler.mode=FAIR`` they share the executors evenly); answers come in
the order of the queries, and a batch ends before the next begins.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from ..plans.planner import plan_query
from ..plans.query import parse_query
from ..sources.catalog import Catalog

log = logging.getLogger(__name__)
IN_FLIGHT = 4


def read_filenames(lines: Iterator[str]) -> list[str]:
    """Lines up to ``Done`` in any case; blank lines are skipped."""
    out = []
    for line in lines:
        line = line.strip()
        if line.lower() == "done":
            return out
        if line:
            out.append(line)
    return out


def read_batches(lines: Iterator[str]) -> Iterator[list[str]]:
    """Lists of query lines. A last batch that no ``F`` closes counts too."""
    batch: list[str] = []
    for line in lines:
        line = line.strip()
        if line == "F":
            yield batch
            batch = []
        elif line:
            batch.append(line)
    if batch:
        yield batch


def format_line(sums: Iterable[int | None]) -> str:
    """Sums separated by a space; NULL for none and for 0."""
    return " ".join(str(int(s)) if s else "NULL" for s in sums)


def run_batch(catalog: Catalog, batch: list[str], in_flight: int = IN_FLIGHT) -> list[str]:
    """The answer lines of one batch, in its order."""

    def answer(text: str) -> str:
        began = time.monotonic()
        line = format_line(plan_query(parse_query(text), catalog).first())
        log.info("%.0f ms %s", 1000 * (time.monotonic() - began), text)
        return line

    with ThreadPoolExecutor(max_workers=in_flight) as pool:
        return list(pool.map(answer, batch))


def run_script(spark: SparkSession, lines: Iterable[str], load: Callable[[SparkSession, list[str]], Catalog] = Catalog.from_files) -> Iterator[str]:
    """Answers to a whole script, a line at a time. The time of all batches, without loading, goes to the log."""
    it = iter(lines)
    catalog = load(spark, read_filenames(it))
    spent = 0.0
    for batch in read_batches(it):
        began = time.monotonic()
        answers = run_batch(catalog, batch)
        spent += time.monotonic() - began
        yield from answers
    log.info("%.0f ms Main execution", 1000 * spent)
