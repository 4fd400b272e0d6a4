"""Benchmark decontamination by multi-pattern search with block shift tables (Wu and Manber, 1994).

An item's windows of 10 consecutive words are the patterns. Texts and patterns
are written as words with one space before and after each, so that a match
begins and ends at words. A table of shifts, indexed by a hash of the block of
bytes that ends at the search position, tells how far no pattern can end; where
it tells 0, the patterns whose leading part ends in that block, kept in suffix
hash buckets, are compared with the text directly. Many positions of a batch
move at once, each through its own part of the text.

Null and empty texts have no words. A repeated row is a row of its own; items
of the same id count as one item, as do all without an id: their windows are hits
and they count as an item, though no id names them. Very long texts are searched
whole. Extra columns stay; those named like an output are replaced. An empty
benchmark contaminates nothing; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, map_texts, materialize, packed

WINDOW = 10
#: Bytes of item text in one pass; a larger benchmark is searched in several.
PASS_BYTES = 2 << 20
LANES = 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def item_windows(items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[bytes, set[int]]:
    """Patterns, each with the ids of the items that hold it."""
    out: dict[bytes, set[int]] = {}
    words = Words(pa.array([t or "" for _, t in items], pa.string()))
    data = words.data.tobytes()
    for k, (item, _) in enumerate(items):
        own = [data[a:b] for a, b in zip(words.start[words.first[k] : words.first[k + 1]], words.end[words.first[k] : words.first[k + 1]], strict=True)]
        for i in range(max(1, len(own) - window + 1) if own else 0):
            out.setdefault(b" " + b" ".join(own[i : i + window]) + b" ", set()).add(item)
    return out


class ShiftTables:
    """Patterns of similar length: shifts by block, buckets by the hash of the block that ends the common length."""

    def __init__(self, patterns: list[tuple[int, bytes]], block: int):
        self.block, self.patterns = block, patterns
        self.m = m = min(len(p) for _, p in patterns)
        head = np.frombuffer(b"".join(p[:m] for _, p in patterns), np.uint8).reshape(-1, m)
        self.bits = int(min(22, max(10, np.ceil(np.log2(len(patterns) * m * 8)))))
        self.shift = np.full(1 << self.bits, m - block + 1, np.int32)
        for end in range(block, m + 1):
            value = np.zeros(len(patterns), np.uint64)
            for i in range(block):
                value |= head[:, end - block + i].astype(np.uint64) << np.uint64(8 * i)
            key = self.hash(value)
            np.minimum.at(self.shift, key, m - end)
        order = np.argsort(key, kind="stable")  # of the last block, which ends at m
        self.order, self.keys = order, key[order]
        padded = np.zeros((len(patterns), 8), np.uint8)
        padded[:, : min(8, m)] = head[:, :8]
        self.prefix, self.mask = padded.view("<u8").ravel(), np.uint64((1 << (8 * min(8, m))) - 1)

    def hash(self, value: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((value * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(position, pattern) of all occurrences in ``text[:n]``, which has 8 bytes more."""
        view = np.ndarray((len(text) - 7,), "<u8", text.data, 0, (1,))
        mask = np.uint64((1 << (8 * self.block)) - 1)
        first = self.m - 1
        if n <= first:
            return []
        lane = np.linspace(first, n, LANES + 1).astype(np.int64)
        at, stop = lane[:-1].copy(), lane[1:]
        live = at < stop
        at, stop, found = at[live], stop[live], []
        while len(at):
            step = self.shift[self.hash(view[at - (self.block - 1)] & mask)]
            if not step.all():
                found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return []
        end = np.concatenate(found)
        key = self.hash(view[end - (self.block - 1)] & mask)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        size = high - low
        start = np.repeat(end - first, size)
        which = self.order[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        same = (view[start] & self.mask) == self.prefix[which]
        whole, out = text.tobytes(), []
        for s, w in zip(start[same].tolist(), which[same].tolist(), strict=True):
            k, p = self.patterns[w]
            if whole.startswith(p, s):
                out.append((s, k))
        return out


class Searcher:
    """All windows of some items, in groups by length, so that short items don't shorten the shifts of the others."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        windows = item_windows(items, window)
        self.patterns, self.items = list(windows), list(windows.values())
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for k, p in enumerate(self.patterns):
            groups.setdefault(6 if len(p) >= 24 else 4 if len(p) >= 8 else 3, []).append((k, p))
        self.tables = [ShiftTables(ps, block) for block, ps in sorted(groups.items())]
        self.n_words = [p.count(b" ") - 1 for p in self.patterns]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
        """Words, merged ranges of hit words [start, end) and item ids of each text."""
        words = Words(texts)
        counts, docs = words.counts(), len(texts)
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
        ids: list[set[int]] = [set() for _ in range(docs)]
        if not self.tables or not len(words.start):
            return counts, ranges, ids
        length = words.end - words.start
        doc = np.repeat(np.arange(docs), counts)
        rank = np.concatenate([[0], np.cumsum(length)])
        place = rank[:-1] + np.arange(len(length)) + 2 * doc + 1  # a space before each word, two bytes more after each text
        n = int(place[-1] + length[-1] + 2)
        text = np.full(n + 8, 0x20, np.uint8)
        text[np.repeat(place - rank[:-1], length) + np.arange(rank[-1])] = words.data[words.data != 0]
        last = words.first[1:][counts > 0] - 1
        text[place[last] + length[last] + 1] = 0
        for table in self.tables:
            hits = table.search(text, n)
            if not hits:
                continue
            word = np.searchsorted(place, np.array([s + 1 for s, _ in hits]))
            for (_, k), w, d in zip(hits, word.tolist(), doc[word].tolist(), strict=True):
                w -= int(words.first[d])
                ranges[d].append((w, w + self.n_words[k]))
                ids[d] |= self.items[k]
        return counts, [merged(r) for r in ranges], ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RANGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
HITS = [T.StructField("hit_ranges", _RANGE), T.StructField("item_ids", T.ArrayType(T.LongType()))]
OUTPUT = [T.StructField("n_words", T.LongType()), *HITS]


def _passes(benchmark: DataFrame, pass_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in lists of at most ``pass_bytes`` of text (or one item), fetched a list at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull())
    batch, size = [], 0
    for item, text in items.toLocalIterator():
        if batch and size + len(text) > pass_bytes:
            yield batch
            batch, size = [], 0
        batch.append((item, text))
        size += len(text)
    yield batch


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_ranges (merged ranges of hit words) and item_ids (items with an occurring window).

    A pass broadcasts at most ``pass_bytes`` of item text. A benchmark of one
    pass is searched in one map over the rows. Of more, each writes only what it
    hits, by a 128-bit key of the text, and the rows are joined with it once.
    """
    passes = _passes(benchmark, pass_bytes)
    first, second = next(passes), next(passes, None)
    context = docs.sparkSession.sparkContext
    if second is None:
        sent = context.broadcast(first)
        return map_texts(docs, "text", OUTPUT, lambda: _all(Searcher(sent.value, window)))
    texts = docs.select(_key("text").alias("key"), "text")
    found = None
    for items in chain((first, second), passes):
        sent = context.broadcast(items)
        hits = map_texts(texts, "text", [T.StructField("n_words", T.LongType()), *HITS], lambda sent=sent: _all(Searcher(sent.value, window))).where(F.size("item_ids") > 0)
        hits = materialize(hits.select("key", "hit_ranges", "item_ids").dropDuplicates(["key"]), "benchmark_hits")
        found = hits if found is None else found.unionByName(hits)
    # A text's hits are bounded by its words and the passes.
    found = found.groupBy("key").agg(F.flatten(F.collect_list("hit_ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("ids")).withColumnRenamed("key", "k")
    columns = [c for c in docs.columns if c.lower() not in {f.name for f in OUTPUT}]
    others = [F.col(f"`{c}`") for c in columns if c != "text"]  # in a struct, where no name can clash
    rows = docs.select(F.struct(F.lit(0).alias("none"), *others).alias("row"), "text", _key("text").alias("key"))
    joined = rows.join(found, F.col("key") == F.col("k"), "left").select("row", "text", "ranges", "ids")
    out = map_texts(joined, "text", OUTPUT, lambda: _united)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns), *(f.name for f in OUTPUT))


def _key(column: str) -> Column:
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


def _dicts(ranges: list[list[tuple[int, int]]]) -> list[list[dict]]:
    return [[{"start": a, "end": b} for a, b in r] for r in ranges]


def _sorted(ids: Iterable[int | None]) -> list[int | None]:
    return sorted(ids, key=lambda x: (x is None, x))


def _all(searcher: Searcher):
    def run(batch: pa.RecordBatch) -> dict:
        n, ranges, ids = searcher(batch.column("text"))
        return {"n_words": n, "hit_ranges": _dicts(ranges), "item_ids": [_sorted(i) for i in ids]}

    return run


def _united(batch: pa.RecordBatch) -> dict:
    ranges = [merged([(x["start"], x["end"]) for x in r or ()]) for r in batch.column("ranges").to_pylist()]
    return {"n_words": Words(batch.column("text")).counts(), "hit_ranges": _dicts(ranges), "item_ids": [_sorted(i or ()) for i in batch.column("ids").to_pylist()]}


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item, with columns of any name as they were."""
    rows, columns = packed(docs)
    return scan(rows, benchmark).where(F.size("item_ids") == 0).select(*columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids there are), contaminated."""
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    hit = F.aggregate("hit_ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"])
    found = scan(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)
