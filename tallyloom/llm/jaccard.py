"""Near duplicates by Jaccard similarity of word shingles, with Bayesian pruning of MinHash candidates.

1. Texts of equal words form a class of copies; its least doc_id stands for it.
2. Each text gets ``HASHES`` MinHash values. Bands of them put representatives
   into buckets. In a bucket, signatures are compared a few values at a time
   and a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold (uniform prior, Beta posterior) falls below
   ``TOLERANCE``. Surviving links are kept as the bucket's components only: one
   edge a member, never the pairs. Their components over all buckets are the
   clusters; every pair that can be similar lies within one.
3. Within a cluster every pair passes the same pruning and is then verified on
   the exact shingle sets. The task counts links and joins components; it emits
   a row a document, never the pairs. Buckets and clusters beyond a bound are
   dealt to pairs of blocks, so that no task holds an unbounded group.

A text of fewer words than a shingle has one shingle of all its words. Null and
empty texts and texts without words are alike to nothing. Rows with a null
doc_id take no part: class null, no links. Rows of one doc_id are one document
with several texts. Very long texts are compared whole. A similarity of exactly
the threshold is a link; a class is named after its least doc_id. An empty table
gives an empty one. Extra columns stay, those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, binary_matrix, map_texts, materialize, mix, raw, shingle_hashes, whole_groups
from .components import connected

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 3
HASHES = BANDS * ROWS
STEP = 12
TOLERANCE = 1e-6
#: Members of a bucket, and shingles of a cluster, in a block.
BUCKET_ROWS = 20_000
CLUSTER_SHINGLES = 2_000_000

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_matches(threshold: float, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """(n, k): after n values a pair with fewer than k matches is dropped.

    With m matches of n the posterior is Beta(m+1, n-m+1), whose mass above t is P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(step, hashes + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survives(a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of ``b`` stay possible partners of ``a`` (one row, or one for each)."""
    rows, matches, at = np.arange(len(b)), np.zeros(len(b), np.int32), 0
    for n, k in rule:
        x = a[at:n] if a.ndim == 1 else a[rows, at:n]
        matches = matches + (b[rows, at:n] == x).sum(axis=1)
        keep = matches >= k
        rows, matches, at = rows[keep], matches[keep], n
        if not len(rows):
            break
    return rows


def _signatures(width: int):
    def run(batch: pa.RecordBatch) -> dict:
        words = Words(batch.column("text"))
        shingles, offsets = shingle_hashes(words, width)
        n, size = batch.num_rows, np.diff(offsets)
        some = size > 0
        out = np.zeros((n, HASHES), np.uint16)
        if some.any():
            starts = offsets[:-1][some]
            with np.errstate(over="ignore"):
                for k, seed in enumerate(_SEEDS):
                    out[some, k] = np.minimum.reduceat((shingles * seed) >> np.uint64(24), starts).astype(np.uint16)
        data, fps = words.data, []
        for i in range(n):
            a, b = words.offsets[i], words.offsets[i + 1]
            own = data[a:b]
            inside = own != 0
            keep = inside.copy()
            keep[1:] |= inside[:-1]  # one zero after each word
            fps.append(hashlib.blake2b(own[keep].tobytes().rstrip(b"\0"), digest_size=16).digest())
        return {"fp": pa.array(fps, pa.binary()), "n_shingles": size, "sig": pa.array([r.tobytes() for r in out], pa.binary())}

    return run


_SIGNATURE = [T.StructField("fp", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType())]


def in_blocks(df: DataFrame, group: str, blocks: str, member: str) -> DataFrame:
    """Rows of ``group`` dealt to pairs of its ``blocks`` blocks: columns bi <= bj, own (the row's block). Every pair of rows meets once, pairs within a block where bi = bj."""
    own = df.withColumn("own", F.pmod(F.xxhash64(member), F.col(blocks)).cast("int"))
    out = own.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return out.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", blocks)


def _bucket_edges(rule: list[tuple[int, int]]):
    """Edges (u, v) of the components of surviving pairs in each group of (bucket, bi, bj)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["bucket", "bi", "bj"]):
            node = table.column("node").to_numpy()
            sig = binary_matrix(table.column("sig"), "<u2", HASHES)
            size = np.diff(cuts)
            first = cuts[:-1][size == 2]
            ok = survives(sig[first], sig[first + 1], rule) if len(first) else first
            us, vs = [node[first[ok]]], [node[first[ok] + 1]]
            for g in np.flatnonzero(size > 2):
                rows = np.arange(cuts[g], cuts[g + 1])
                left = rows
                while len(left):
                    pivot, left, queue = left[0], left[1:], [left[0]]
                    while queue and len(left):
                        at = queue.pop()
                        near = survives(sig[at], sig[left], rule)
                        if len(near):
                            got = left[near]
                            queue += got.tolist()
                            us.append(node[got])
                            vs.append(np.full(len(got), node[pivot]))
                            left = np.delete(left, near)
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _sets(width: int):
    def run(batch: pa.RecordBatch) -> dict:
        shingles, offsets = shingle_hashes(Words(batch.column("text")), width)
        return {"shingles": pa.array([np.unique(shingles[a:b]).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())}

    return run


def _verify(threshold: float, rule: list[tuple[int, int]]):
    """(node, links, root): the number of similar documents and the least node joined, in each group of (cluster, bi, bj)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["cluster", "bi", "bj"]):
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            bi, bj, own = (table.column(c).to_numpy() for c in ("bi", "bj", "own"))
            sig = binary_matrix(table.column("sig"), "<u2", HASHES)
            bytes_, at = raw(table.column("shingles"))
            values, at = bytes_.view("<u8"), at // 8
            links, root = np.zeros(len(node), np.int64), node.copy()
            for a, b in zip(cuts, cuts[1:], strict=False):
                distinct, ids = np.unique(values[at[a] : at[b]], return_inverse=True)
                offs, size, parent = at[a : b + 1] - at[a], np.diff(at[a : b + 1]), list(range(b - a))
                mark = np.zeros(len(distinct), bool)

                def find(i: int, parent=parent) -> int:
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for i in range(b - a - 1):
                    rest = np.arange(i + 1, b - a)
                    if bi[a] != bj[a]:  # only pairs across the two blocks
                        rest = rest[own[a + rest] != own[a + i]]
                    small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
                    rest = rest[small >= threshold * large]
                    rest = rest[survives(sig[a + i], sig[a + rest], rule)] if len(rest) else rest
                    if not len(rest):
                        continue
                    mine = ids[offs[i] : offs[i + 1]]
                    mark[mine] = True
                    total = np.concatenate([[0], np.cumsum(size[rest])])
                    theirs = ids[np.repeat(offs[rest] - total[:-1], size[rest]) + np.arange(total[-1])]
                    common = np.add.reduceat(mark[theirs].astype(np.int64), total[:-1])
                    mark[mine] = False
                    good = rest[common >= threshold * (size[rest] + size[i] - common) - 1e-9]
                    if len(good):
                        links[a + i] += copies[a + good].sum()
                        links[a + good] += copies[a + i]
                        for j in good.tolist():
                            x, y = find(i), find(j)
                            if x != y:
                                parent[max(x, y)] = min(x, y)  # rows are sorted by node
                root[a:b] = node[a + np.array([find(i) for i in range(b - a)])]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], ["node", "links", "root"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, bucket_rows: int = BUCKET_ROWS, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """doc_id, class_id (least doc_id of its component) and n_links (documents with similarity >= threshold), a row for each row of ``docs``."""
    rule = least_matches(threshold)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = materialize(map_texts(texts, "text", _SIGNATURE, lambda: _signatures(width)).drop("text"), "signatures")
    known = made.where("n_shingles > 0 and doc_id is not null")
    # Copies: the least doc_id stands for its class.
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    reps = known.join(classes.withColumnRenamed("fp", "f"), (F.col("fp") == F.col("f")) & (F.col("doc_id") == F.col("node"))).dropDuplicates(["fp"]).select("node", "copies", "n_shingles", "sig")
    reps = materialize(reps, "representatives")
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)))
    banded = reps.select("node", F.explode(bands).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("bucket").alias("b"), F.ceil(F.col("k") / bucket_rows).cast("int").alias("blocks"))
    members = banded.join(shared, F.col("bucket") == F.col("b")).drop("b").join(reps.select("node", "sig"), "node")
    dealt = in_blocks(members, "bucket", "blocks", "node").select("bucket", "bi", "bj", "node", "sig")
    dealt = dealt.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "node")
    clusters = connected(dealt.mapInArrow(_bucket_edges(rule), "u bigint, v bigint"))
    # A root belongs to its own cluster.
    of = materialize(clusters.select("node", F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct()), "clusters")
    placed = of.join(reps, "node")
    weight = placed.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / cluster_shingles).cast("int").alias("blocks"))
    placed = placed.join(weight, "cluster")
    whole = placed.join(texts.withColumnRenamed("doc_id", "node"), "node")
    sets = map_texts(whole, "text", [T.StructField("shingles", T.BinaryType())], lambda: _sets(width)).drop("text", "n_shingles")
    spread = in_blocks(sets, "cluster", "blocks", "node").repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "node")
    checked = materialize(spread.mapInArrow(_verify(threshold, rule), "node bigint, links bigint, root bigint"), "verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected(checked.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    facts = classes.join(links, "node", "left").join(joined, "node", "left").select(F.col("fp").alias("f"), F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return made.join(facts, (F.col("fp") == F.col("f")) & ~alone, "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class: the one that the class is named after."""
    kept = near_duplicates(docs).where("class_id = doc_id or doc_id is null").select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
