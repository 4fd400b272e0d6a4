"""What the operators share: bounded Arrow batches, words of texts, runs of sorted rows.

Arrow batches that Spark sends are bounded in bytes by its own default (64 MB);
``slices`` cuts them further. No setting of the session is changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize, scratch, shared_path

__all__ = ["Words", "binary_matrix", "map_texts", "materialize", "mix", "packed", "plain_names", "raw", "scratch", "shared_path", "shingle_hashes", "slices", "whole_groups", "without"]

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without columns whose name, in any case, an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in taken))


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with other names for columns that have a dot in theirs, which Spark's Arrow functions can't resolve; ``toDF`` gives them back."""
    return df.toDF(*(f"__dotted_{i}" if "." in c else c for i, c in enumerate(df.columns)))


def packed(df: DataFrame, *apart: str) -> tuple[DataFrame, list[Column]]:
    """(rows, columns): ``row``, a struct of all columns but text, where no name can clash, then text and the columns ``apart``; and what makes the columns of ``df`` of it again."""
    others = [F.col(f"`{c}`") for c in df.columns if c != "text"]
    rows = df.select(F.struct(F.lit(0).alias("none"), *others).alias("row"), "text", *apart)
    return rows, [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in df.columns]


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``budget`` bytes of ``column`` each, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + budget, "right")))
        yield batch.slice(at, end - at)
        at = end


def map_texts(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], dict]], keep: bool = True) -> DataFrame:
    """``df`` with columns added by a function from a batch to arrays by name.

    ``make`` runs once a task and returns that function, so a model or automaton
    is built there. With ``keep`` off, only the new columns stay.
    """
    names = [f.name for f in fields]
    df = without(df, names)
    kept, df = df.columns if keep else [], plain_names(df)
    schema = T.StructType((list(df.schema.fields) if keep else []) + fields)
    arrow = [(f.name, _arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, column):
                made = f(part)
                arrays = (list(part.columns) if keep else []) + [x if isinstance(x := made[n], pa.Array) else pa.array(x, t) for n, t in arrow]
                yield pa.RecordBatch.from_arrays(arrays, (part.schema.names if keep else []) + names)

    return df.mapInArrow(run, schema).toDF(*kept, *names)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n+1 offsets; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return bytes_, offs - offs[0]


_LUT = np.zeros(256, np.uint8)
_LUT[0x80:] = np.arange(0x80, 256)
_LUT[0x30:0x3A] = np.arange(0x30, 0x3A)
_LUT[0x61:0x7B] = np.arange(0x61, 0x7B)
_LUT[0x41:0x5B] = np.arange(0x61, 0x7B)


class Words:
    """Words of a batch of texts: maximal runs of digits, a-z (A-Z lower-cased) and everything beyond ASCII.

    ``data``: the bytes, 0 where no word is. ``start``, ``end``: of each word in
    ``data``. ``first``: n+1 indices of each text's first word.
    """

    def __init__(self, array: pa.Array):
        bytes_, offsets = raw(array)
        self.data = _LUT[bytes_]
        inside = self.data != 0
        edge = np.zeros(len(inside) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(inside), bool)
        before[1:] = ~inside[:-1]
        before[:1] = True
        self.start = np.flatnonzero(inside & (before | edge[:-1]))
        after = np.empty(len(inside), bool)
        after[:-1] = ~inside[1:]
        after[-1:] = True
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.offsets = offsets

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, mixed."""
        n = len(self.data)
        powers = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[0][:n], out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * powers[1][self.start])


_BASE = 0x9E3779B97F4A7C15
_kept_powers: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse; kept between batches."""
    if not _kept_powers or len(_kept_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            a = np.ones(n, np.uint64)
            a[1:] = np.uint64(base)
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(a))
        _kept_powers[:] = out
    return _kept_powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's runs of ``width`` words and their n+1 offsets; a text of fewer words, but not none, has one shingle of all of them."""
    h, counts = words.hashes(), words.counts()
    n = np.maximum(counts - width + 1, 0)
    short = (counts > 0) & (n == 0)
    total = n + short
    offsets = np.concatenate([[0], np.cumsum(total)])
    at = np.repeat(words.first[:-1] - offsets[:-1], total) + np.arange(offsets[-1])
    length = np.repeat(np.where(short, counts, width), total)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(width):
            out = np.where(j < length, mix(out * np.uint64(_BASE) + padded[at + j] + np.uint64(1)), out)
    return out, offsets


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal ``keys`` from a partition sorted by them, with the n+1 cuts between groups.

    A group may span batches; only the last group of a batch waits for the next.
    """
    kept: list[pa.RecordBatch] = []
    last = None

    def done(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        changed = np.ones(table.num_rows, bool)
        changed[1:] = False
        for k in keys:
            c = table.column(k).to_numpy()
            changed[1:] |= c[1:] != c[:-1]
        return table, np.append(np.flatnonzero(changed), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        first, final = tuple(c[0] for c in cols), tuple(c[-1] for c in cols)
        if kept and first != last:
            yield done(kept)
            kept = []
        if first == final:
            kept.append(batch)
        else:
            same = np.ones(batch.num_rows, bool)
            for c in cols:
                same &= c == c[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1
            yield done([*kept, batch.slice(0, cut)])
            kept = [batch.slice(cut)]
        last = final
    if kept:
        yield done(kept)


def binary_matrix(column: pa.ChunkedArray | pa.Array, dtype: str, width: int) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    bytes_, _ = raw(column)
    return bytes_.view(dtype).reshape(-1, width)
