"""Quality scores of documents by histogram gradient-boosted trees over text statistics.

Statistics are taken over the whole text. Trees are grown on the driver from a
bounded sample of labelled rows (``SAMPLE_ROWS``, those whose doc_id hashes
lowest), with values binned to histograms. The trees are flattened into arrays
of features, thresholds and children, and all rows of a batch walk them at once.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out and never learnt from.
Null and empty texts are scored like any other, very long ones whole. Without
usable labels every score is 1: nothing is known against a document. A doc_id
labelled more than once counts once, as its lowest label; a null label doesn't
count. Equal scores are no tie to break: each row is judged alone, and repeated
rows get the same score. An empty table gives an empty one. Extra columns stay,
those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, map_texts, packed, raw

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
HELD_OUT = 2

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper_share", "digit_share", "space_share", "beyond_ascii", "full_stops", "commas",
    "exclamations", "questions", "pipes", "symbols", "brackets", "other_marks", "log_lines", "mean_line", "short_lines", "distinct_words", "top_word", "repeated_pairs", "marks_a_word", "capital_words",
)

_CLASS = np.zeros(256, np.int64)  # 0: letters and the rest
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n", ".", ",;:", "!", "?", "|", "#$%&*@^~<>=+\\_`", "()[]{}\"'/-"), 1):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[0x80:] = 11
_KINDS = 12


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    bytes_, offsets = raw(texts)
    n, words = len(texts), Words(texts)
    size = np.diff(offsets)
    doc_of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc_of_byte * _KINDS + _CLASS[bytes_], minlength=n * _KINDS).reshape(n, _KINDS)
    lead = (bytes_ & 0xC0) != 0x80
    chars = np.maximum(1, np.bincount(doc_of_byte[lead], minlength=n))
    count = words.counts()
    some = np.maximum(1, count)
    doc = np.repeat(np.arange(n), count)
    length = words.end - words.start
    per_doc = lambda mask: np.bincount(doc[mask], minlength=n)
    capital = (bytes_[words.start] >= 0x41) & (bytes_[words.start] <= 0x5A) if len(words.start) else np.zeros(0, bool)
    breaks = np.flatnonzero(bytes_ == 10)
    cuts = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_doc = np.concatenate([doc_of_byte[breaks], np.arange(n)])[np.argsort(np.concatenate([breaks, offsets[1:]]), kind="stable")]
    line_size = np.diff(np.concatenate([[0], cuts]))
    lines = np.bincount(line_doc, minlength=n)
    h = words.hashes() >> np.uint64(24)
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | h)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    owner = (key >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner[new], minlength=n)
    run = np.diff(np.append(np.flatnonzero(new), len(key)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[new], run)
    same = np.zeros(len(doc), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    share = lambda k: kinds[:, k] / chars
    marks = kinds[:, 4] + kinds[:, 5] + kinds[:, 6] + kinds[:, 7] + kinds[:, 8] + kinds[:, 9] + kinds[:, 10]
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.bincount(doc, length, minlength=n) / some, per_doc(length > 12) / some, per_doc(length < 4) / some, share(1), share(2), share(3), share(11), share(4), share(5),
        share(6), share(7), share(8), share(9), share(10), marks / chars, np.log1p(lines), size / np.maximum(1, lines), np.bincount(line_doc[line_size < 40], minlength=n) / np.maximum(1, lines), distinct / some, top / some, per_doc(same) / some, marks / some, per_doc(capital) / some,
    ])


@dataclass
class Forest:
    """Flattened trees: node arrays shared by all trees, and the index of each root. A leaf's feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        for a in range(0, len(self.roots), 32):  # a block of trees at a time bounds memory
            at = np.broadcast_to(self.roots[a : a + 32], (len(x), len(self.roots[a : a + 32]))).copy()
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            total += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 15, ridge: float = 1.0) -> Forest:
    """Logistic boosting on binned features; without both classes, no tree and a score near the only one's label."""
    n, d = x.shape
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        offset = binned + np.arange(d) * bins
        total = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0, -1, -1, 0])
            open_ = [(roots[-1], np.arange(n))]
            for level in range(depth + 1):
                below = []
                for node, rows in open_:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    best = None
                    if level < depth and len(rows) >= 2 * least:
                        flat = offset[rows].ravel()
                        hist = lambda w: np.bincount(flat, np.repeat(w, d) if w is not None else None, minlength=d * bins).reshape(d, bins).cumsum(axis=1)[:, :-1]  # noqa: B023, E731
                        gl, hl, nl = hist(grad[rows]), hist(hess[rows]), hist(None)
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        gain[(nl < least) | (len(rows) - nl < least)] = -1
                        k = int(gain.argmax())
                        if gain.flat[k] > 1e-6:
                            best = divmod(k, bins - 1)
                    if best is None:
                        nodes[node][4] = rate * g / (h + ridge)
                        total[rows] += nodes[node][4]
                        continue
                    j, b = best
                    go = binned[rows, j] <= b
                    left, right = len(nodes), len(nodes) + 1
                    nodes += [[-1, 0, -1, -1, 0], [-1, 0, -1, -1, 0]]
                    nodes[node][:4] = [j, edges[j][b], left, right]
                    below += [(left, rows[go]), (right, rows[~go])]
                open_ = below
    cols = np.array(nodes or np.zeros((0, 5)), float).T
    ints = lambda i: cols[i].astype(np.int64)
    return Forest(ints(0), cols[1], ints(2), ints(3), cols[4], np.array(roots, np.int64), base, depth)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == HELD_OUT


_VECTOR = [T.StructField("__statistics", T.ArrayType(T.DoubleType()))]


def _vectors(batch: pa.RecordBatch) -> dict:
    x = statistics(batch.column("text"))
    return {"__statistics": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """A model from at most ``sample_rows`` labelled documents that aren't held out; None without any."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select(F.col("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most sample_rows rows
    rows = map_texts(chosen, "text", _VECTOR, lambda: _vectors).select("doc_id", "quality", "__statistics").orderBy("doc_id").limit(2 * sample_rows).collect()
    if not rows:
        return None
    return train(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float))


OUTPUT = [T.StructField("score", T.DoubleType())]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold)."""
    forest = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # trees x 2^(depth+1) nodes at most

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            model = sent.value
            return {"score": np.ones(batch.num_rows) if model is None else model.scores(statistics(batch.column("text")))}

        return run

    return map_texts(without_prediction(docs), "text", OUTPUT, make).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_prediction(docs: DataFrame) -> DataFrame:
    return docs.drop(*(c for c in docs.columns if c.lower() == "predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` predicted to be of quality, with columns of any name as they were."""
    rows, columns = packed(docs, "doc_id")
    return classify(rows, labels).where("predicted = 1").select(*columns)
