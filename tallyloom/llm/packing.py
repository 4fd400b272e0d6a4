"""Best-fit packing of token pieces by exact complements.

A piece is a document's tokens or, of a longer document, one of its parts of
``capacity`` tokens, the first of which may be shorter. Only the number of
pieces of each length matters to the packing, so it is planned on a histogram
of at most ``capacity`` counts, whatever the number of documents. The sums of
one, two and three lengths are indexed. The longest length left opens sequences;
its gap is filled exactly by a single length, else a pair, else a triple, looked
up by sum and used as often as the counts allow; what has no exact filler takes
the longest length that fits (best fit), and its new gap is looked up again. The
plan is a list of runs: so many sequences with these lengths. A piece's rank
within its length, counted over salted groups, finds its run, sequence and
offset by a join.

Null texts are empty: one piece with the end token alone. Very long texts are
tokenized whole. Rows that repeat a doc_id are pieces of their own. An empty
table gives an empty one. Extra columns stay, those named like an output are
replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, plain_names, slices, without

CAPACITY = 1024
END_TOKEN = 2
#: Rows of one length that one task ranks: small, but with fewer groups where there are many rows.
SALT_ROWS = (1_000, 500_000)


class PieceTokenizer:
    """Token ids as little-endian u32 bytes.

    The vocabulary is the JSON file's; byte-level BPE is run by ``tiktoken``
    over its merges, which gives the same ids as ``tokenizers`` several times
    faster (a test compares them). The pattern's look-ahead is slow and only
    tells on runs of white space, so texts without one go by a pattern without it.
    The file's added tokens in a text get their own ids, as ``tokenizers`` gives them.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, own = file["model"], file.get("added_tokens") or []
        if any(t.get(k) for t in own for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that are whole words or take white space in are not supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in own}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if own else None
        back = {c: b for b, c in _byte_characters().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token) and token not in self.added}
        self.whole = tiktoken.Encoding("whole", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain = tiktoken.Encoding("plain", pat_str=_PATTERN.replace(_LOOK_AHEAD, ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.split and any(t in text for t in self.added):
            return b"".join(self.added[x] if k % 2 else self._text(x) for k, x in enumerate(self.split(text)))
        return self._text(text)

    def _text(self, text: str) -> bytes:
        spaced = text.replace("\n", " ")  # all other white space isn't printable
        encode = self.plain if spaced.isprintable() and "  " not in spaced else self.whole
        return array("I", encode(text)).tobytes()


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One a process and file; a worker keeps it for its next tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: The pre-tokenizer's pattern, fixed by the vocabulary file's format.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOOK_AHEAD = r"|\s+(?!\S)"

PIECES = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    head = n % capacity or capacity
    return [(0, min(n, head)), *((s, capacity) for s in range(head, n, capacity))]


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """One row a piece: the columns of ``docs`` but text, then piece, start, length, ids_crc32 and, if asked for, ids."""
    made = [*PIECES, T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])
    names = [f.name for f in made]
    docs = without(docs, names)
    back, docs = [c for c in docs.columns if c != "text"], plain_names(docs)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_TOKEN], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                encode = tokenizer(path)
                row, piece, start, length, crc, values = [], [], [], [], [], []
                for r, text in enumerate(part.column("text").to_pylist()):
                    data = encode(text or "") + end
                    for k, (s, n) in enumerate(pieces_of(len(data) // 4, capacity)):
                        own = data[4 * s : 4 * (s + n)]
                        row.append(r), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(own))
                        if ids:
                            values.append(np.frombuffer(own, "<i4"))
                take = pa.array(row, pa.int64())
                arrays = [part.column(f.name).take(take) for f in kept] + [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    arrays.append(pa.array(values, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + names)

    return docs.mapInArrow(run, T.StructType(kept + made)).toDF(*back, *names)


class SumIndex:
    """The sums of one, two and three available lengths, each with its combinations, longest part first.

    ``pairs[s]`` lists the pairs of sum s. A triple is its longest part and a pair
    of the rest, so ``triples[s]`` lists longest parts whose rest has pairs.
    ``left`` counts only fall, so a combination that runs out is dropped from the
    end of its list for good; ``held`` are those that an open sequence has.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.held = [0] * (capacity + 1), [0] * (capacity + 1)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
            self.left[length] += n
        self.lengths = [n for n in range(1, capacity + 1) if self.left[n]]
        self.pairs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        for a in self.lengths:  # rising, so that the pair with the longest part stands last
            for b in self.lengths:
                if b > a or a + b > capacity:
                    break
                self.pairs[a + b].append((a, b))
        self.triples: dict[int, list[int]] = {}

    def free(self, length: int) -> int:
        return self.left[length] - self.held[length]

    def usable(self, parts: tuple[int, ...]) -> int:
        """How many sequences of these lengths the free counts allow."""
        return min(self.free(p) // parts.count(p) for p in parts)

    def hold(self, parts: tuple[int, ...], n: int = 1) -> None:
        for p in parts:
            self.held[p] += n

    def take(self, parts: tuple[int, ...], n: int) -> None:
        for p in parts:
            self.left[p] -= n

    def pair(self, total: int, longest: int) -> tuple[int, int] | None:
        """The pair of this sum with the longest part, at most ``longest``."""
        found = self.pairs[total]
        while found and not (self.left[found[-1][0]] and self.left[found[-1][1]]):
            found.pop()
        return next((parts for parts in reversed(found) if parts[0] <= longest and self.usable(parts)), None)

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """The triple of this sum with the longest part, then with the longest second one."""
        if total not in self.triples:
            self.triples[total] = [a for a in self.lengths if 3 * a >= total and a < total - 1 and self.pairs[total - a]]
        found = self.triples[total]
        while found and not self.left[found[-1]]:
            found.pop()
        for a in reversed(found):
            if self.free(a):
                self.hold((a,))
                rest = self.pair(total - a, a)
                self.hold((a,), -1)
                if rest:
                    return (a, *rest)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Free lengths that fill the gap exactly: none, one, two or three."""
        if gap == 0:
            return ()
        if self.free(gap):
            return (gap,)
        return self.pair(gap, gap) or self.triple(gap)

    def longest(self, gap: int) -> int:
        """The longest free length that fits, or 0."""
        return next((n for n in range(gap, 0, -1) if self.free(n)), 0)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths, number of sequences), given how many pieces each length has."""
    index = SumIndex(counts, capacity)
    runs: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while index.left[longest]:
            parts, gap = (longest,), capacity - longest
            index.hold(parts)
            while gap:  # an exact filler or, as long as there is none, the best fit
                new = index.exact(gap) or ((n,) if (n := index.longest(gap)) else ())
                if not new:
                    break
                index.hold(new)
                parts += new
                gap -= sum(new)
            index.hold(parts, -1)
            n = index.usable(parts)
            index.take(parts, n)
            runs.append((parts, n))
    return runs


def run_slots(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of every slot of every run; ranks count the pieces of a length from 0."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for parts, n in runs:
        offset = 0
        for p in parts:
            out.append((p, used.get(p, 0), n, sequence, offset))
            used[p] = used.get(p, 0) + n
            offset += p
        sequence += n
    return out


def salts_of(n: int) -> int:
    return max(1, min(-(-n // SALT_ROWS[0]), 64 + n // SALT_ROWS[1]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Ranks: pieces of a length are dealt to groups by a hash of their order
    columns (many groups for a frequent length), counted per (length, group),
    the groups' first ranks summed, and rows numbered within a group. Rows that
    tie in the order are numbered in any way, so ``pieces`` must be a written
    table whose rows stay as they are.
    """
    spark = pieces.sparkSession
    pieces = without(pieces, ["sequence_id", "offset", "__salts", "__salt", "__rank", "__base", "__slot"])
    # The histogram has at most ``capacity`` rows.
    histogram = dict(map(tuple, pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()))
    dealt = spark.createDataFrame([(length, salts_of(n)) for length, n in histogram.items()], "length bigint, __salts int")
    salted = pieces.join(F.broadcast(dealt), "length").withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__salts")).cast("int")).drop("__salts")
    # At most ``capacity`` x 64 rows and one for each SALT_ROWS[1] pieces.
    counted = sorted(map(tuple, salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")).collect()))
    firsts: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, sequence, offset in run_slots(plan_packing(histogram, capacity)):
        firsts.setdefault(length, []).append((first, sequence, offset))
    rows, base = [], 0
    for i, (length, salt, n) in enumerate(counted):
        if i == 0 or counted[i - 1][0] != length:
            base, own = 0, firsts[length]
            starts = [f for f, _, _ in own]
        # Each (length, group) gets the slots that its ranks meet.
        rows.append((length, salt, base, own[bisect_right(starts, base) - 1 : bisect_left(starts, base + n)]))
        base += n
    table = spark.createDataFrame(rows, "length bigint, __salt int, __base bigint, __slot array<struct<first:bigint,sequence:bigint,offset:bigint>>")
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)).cast("bigint") - 1)
    joined = ranked.join(F.broadcast(table), ["length", "__salt"])
    rank = F.col("__base") + F.col("__rank")
    # The last slot that begins at or before the rank.
    found = joined.withColumn("__slot", F.element_at(F.filter("__slot", lambda s: s["first"] <= rank), -1))
    return found.select(*(f"`{c}`" for c in pieces.columns), (F.col("__slot.sequence") + rank - F.col("__slot.first")).alias("sequence_id"), F.col("__slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Tokenizes, cuts and packs: a row a piece with its place, its columns of ``docs`` but text and, if asked for, its ids."""
    return pack(materialize(tokenize_pieces(docs, path, capacity, ids), "pieces"), capacity)
