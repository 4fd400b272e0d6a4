"""Exact top-k by inner product with Fagin's threshold algorithm over sorted lists of every dimension.

Vectors are turned into integers floor(scale * x), so scores are exact. Rows
are dealt to blocks. A block keeps, for every dimension, its rows in order of
their value. A query walks the lists from the top where its own component is
positive and from the bottom where it is negative, scores every row that it
meets, and stops as soon as the sum of its components times the values at the
depths reached, which no unseen row can exceed, is below its k-th score. (At
equality it goes on: a row with a smaller id could tie.) Lists are walked to
depths of their own: where a further row lowers the sum most, first.

The first block's k-th score is carried to the others as a bound, so that they
need no k rows of their own before they can stop, and give only rows that can
still count. The best k of all blocks are merged.

Queries against all rows, in blocks of both, is the stated job; a block pair is
a task of bounded size, so a large group of equal vectors is dealt evenly.
Vectors that are null or empty, or hold null or non-finite components, take no
part, nor do vectors with a null id. Vectors of another length than a query's
are no candidates of it. Rows with equal ids are candidates of their own; a
query doesn't meet rows with its own id. Queries of one id with different
vectors are queries of their own; a row that repeats id and vector is one query.
With fewer candidates than k, all are given. An empty table gives an empty one;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
SCALE = 64
QUERY_MODULUS = 20
CANDIDATES, QUERIES = 8192, 4096
#: Queries whose products with a block are taken at once.
TOGETHER = 64


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): valid vectors as floor(scale * x), x as double."""
    values = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = values.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite & (F.size("e") > 0))
    return valid.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _hull(gains: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Falling gains a row: adjoining steps are averaged until none is worth more than the one before it."""
    parts: list[list[float]] = []  # gain, rows, steps
    for g, n in zip(gains.tolist(), rows.tolist(), strict=True):
        parts.append([g, n, 1])
        while len(parts) > 1 and parts[-1][0] * parts[-2][1] >= parts[-2][0] * parts[-1][1]:
            g, n, k = parts.pop()
            parts[-1] = [parts[-1][0] + g, parts[-1][1] + n, parts[-1][2] + k]
    return np.repeat([g / n for g, n, _ in parts], [k for *_, k in parts])


class Lists:
    """A block's vectors and, for every dimension, its rows by falling value, with the values at a grid of depths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, exact: type):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order].astype(exact))
        wide = self.vectors.astype(np.float64 if exact is np.float32 else exact)
        n = len(ids)
        self.falling = np.ascontiguousarray(np.argsort(-wide, axis=0, kind="stable").T.astype(np.int32))  # a row a dimension
        values = np.take_along_axis(wide.T, self.falling, axis=1)
        grid, depth = [], 1.0
        while depth < n:
            grid.append(int(depth))
            depth = max(depth + 1, depth * 1.2)
        self.grid = np.array([*grid, n])
        #: By direction: the next value at each depth, which bounds the rows not shown yet; from the bottom with the sign turned.
        self.at = (values[:, np.minimum(self.grid, n - 1)], -values[:, np.maximum(n - 1 - self.grid, 0)])
        self.gains = [a[:, :-1] - a[:, 1:] for a in self.at]
        #: What a further row of a list lowers its value by, on the convex hull below its values, so that depths come in order.
        self.worth = [np.stack([_hull(g, np.diff(self.grid)) for g in gains]) if gains.shape[1] else gains for gains in self.gains]

    def walk(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The steps of a walk down all lists, the most worth a row first: the list of each, the rows walked and the bound on unseen rows before each step and after the last."""
        up, size, steps = (q > 0)[:, None], np.abs(q)[:, None], len(self.grid) - 1
        walked = np.flatnonzero(q != 0)
        order = np.argsort(-(size * np.where(up, *self.worth))[walked].ravel(), kind="stable")  # within a list, depths of equal worth stay in order
        gains, rows = (size * np.where(up, *self.gains))[walked].ravel()[order], np.tile(np.diff(self.grid), len(walked))[order]
        total = (size[:, 0] * np.where(up[:, 0], self.at[0][:, 0], self.at[1][:, 0])).sum()
        return walked[order // steps] if steps else order, np.concatenate([[0], np.cumsum(rows)]) + len(walked), np.concatenate([[total], total - np.cumsum(gains)])

    def show(self, seen: np.ndarray, q: np.ndarray, before: np.ndarray | None, places: np.ndarray) -> None:
        """Marks the rows that the lists show from grid positions ``before`` (None: from their heads) down to ``places``."""
        n = len(self.ids)
        for j in np.flatnonzero(q != 0).tolist():
            a, b = 0 if before is None else self.grid[before[j]], self.grid[places[j]]
            if a < b:
                seen[self.falling[j, a:b] if q[j] > 0 else self.falling[j, n - b : n - a]] = True


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; ties to smaller rows, which are in order of id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((rows[keep], -scores[keep]))[:k]]


def threshold_search(lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, rows, scores, rows scored) for every query against one block; rows below a query's floor aren't given."""
    queries = queries.astype(lists.vectors.dtype)
    n, spent = len(lists.ids), 0.0
    products: np.ndarray | None = None
    for i, q in enumerate(queries):
        if i % TOGETHER == 0:
            # Where the queries before had to score most rows, one product for all is faster than gathering rows.
            products = queries[i : i + TOGETHER] @ lists.vectors.T if spent > 0.25 * n * i else None
        hidden = slice(*np.searchsorted(lists.ids, [query_ids[i], query_ids[i] + 1]))
        others = n - (hidden.stop - hidden.start)
        if not q.any():
            # A zero vector scores 0 everywhere: no list is walked, the smallest ids win.
            rows = np.concatenate([np.arange(hidden.start)[:k], np.arange(hidden.stop, n)[:k]])[:k]
            yield i, rows, np.zeros(len(rows), q.dtype), len(rows)
            continue
        kth = -np.inf if floors is None or np.isnan(floors[i]) else floors[i]
        rows, scores, done, limit, places = np.zeros(0, np.int64), np.zeros(0, q.dtype), 0, 4 * k, None
        scored = np.zeros(n, bool)
        scored[hidden] = True
        steps, walked, bounds = lists.walk(q)
        while True:
            # Several times as many rows a round, but no deeper than the k-th score so far asks for.
            at = min(int(np.searchsorted(walked, limit)), int(np.searchsorted(-bounds, -kth, "right")), len(steps))
            seen = scored.copy()
            before, places = places, np.bincount(steps[:at], minlength=len(q))
            lists.show(seen, q, before, places)
            new = np.flatnonzero(seen > scored)
            scored = seen
            done += len(new)
            found = products[i % TOGETHER][new] if products is not None else lists.vectors[new] @ q
            good = found >= kth
            rows, scores = np.concatenate([rows, new[good]]), np.concatenate([scores, found[good]])
            keep = _best(scores, rows, k)
            rows, scores = rows[keep], scores[keep]
            if len(scores) == k:
                kth = max(kth, float(scores[-1]))
            if bounds[at] < kth or done == others:
                break
            limit = 6 * max(limit, int(walked[at]))
        spent += done
        yield i, rows, scores, done


_PARTIAL = "qid bigint, query_id bigint, vec_id bigint, score bigint, scored bigint"


def _search(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(x, pa.int64()) for x in ("qid", "query_id", "vec_id", "score", "scored")])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        width = len(left.column("v")[0])
        q, x = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        # Doubles are exact for integers below 2^53, and their products are much faster.
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width
        lists = Lists(right.column("vec_id").to_numpy(), x, np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64)
        ids, qids = left.column("vec_id").to_numpy(), left.column("qid").to_numpy()
        floors = left.column("floor").to_numpy() if "floor" in left.column_names else None
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, rows, scores, done in threshold_search(lists, ids, q, k, floors):
            for column, values in zip(out, (np.full(len(rows), qids[i]), np.full(len(rows), ids[i]), lists.ids[rows], scores.astype(np.int64), np.full(len(rows), done)), strict=True):
                column.append(values)
        return pa.table([np.concatenate(c) for c in out], schema=schema)

    return run


def partials(queries: DataFrame, candidates: DataFrame, k: int = K, candidate_rows: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """The rows of every block that can be among a query's k best, with the number of rows that the block scored for it."""
    distinct = queries.select("vec_id", "v").distinct().withColumn("qid", F.monotonically_increasing_id())
    both = materialize(distinct.unionByName(candidates.select("vec_id", "v", F.lit(None).cast("bigint").alias("qid"))), "vectors")
    n, nq = both.agg(F.count_if(F.col("qid").isNull()), F.count("qid")).first()
    n_c, n_q = max(1, -(-n // candidate_rows)), max(1, -(-nq // query_rows))
    block = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    span = lambda first, last: F.explode(F.sequence(F.lit(first), F.lit(last)))
    left = both.where("qid is not null").select("qid", "vec_id", "v", F.size("v").alias("width"), block(n_q).alias("qb"))
    own = [F.col(c).alias(c) for c in ("vec_id", "v")]  # columns of their own, as both sides are cogrouped
    right = both.where("qid is null").select(*own, F.size("v").alias("width"), span(0, n_q - 1).alias("qb"), block(n_c).alias("cb"))
    keys = ("width", "qb", "cb")
    met = lambda a, b: a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_search(k), _PARTIAL)
    first = met(left.withColumn("cb", F.lit(0)), right.where("cb = 0"))
    if n_c == 1:
        return first
    first = materialize(first, "first_block")
    floors = first.groupBy(F.col("qid").alias("q")).agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    bounded = left.join(floors, F.col("qid") == F.col("q"), "left").drop("q").withColumn("cb", span(1, n_c - 1))
    return first.unionByName(met(bounded, right.where("cb > 0").select("width", "qb", "cb", "vec_id", "v")))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, candidate_rows: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query, both given as (vec_id, v)."""
    found = partials(queries, candidates, k, candidate_rows, query_rows)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, k: int = K, modulus: int = QUERY_MODULUS) -> DataFrame:
    """The k best rows of every row whose vec_id is divisible by ``modulus``."""
    rows = integers(embeddings)
    return top_k(rows.where(F.col("vec_id") % modulus == 0), rows, k)
