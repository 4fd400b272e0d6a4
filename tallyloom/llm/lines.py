"""Line deduplication by pairwise alignment of overlapping documents.

A document is a distinct (doc_id, text); documents are in order of doc_id, then
of a hash of the text. A block is a run of adjoining lines of at least
``BLOCK_WORDS`` words that an earlier document has as a run of adjoining lines,
too. Every line of a block is deleted from the later document, whatever the
order of the blocks; nothing else is. In steps:

1. Lines are hashed and counted. A line of one document takes part no further.
   A *rare* line is one that 2 to ``RARE`` documents have.
2. In each document, stretches of adjoining shared lines that are too short for
   a block are dropped. The rare lines of the rest are keys; a block without any
   lies in a stretch of frequent lines alone, whose windows (shortest runs of
   ``BLOCK_WORDS`` words from each line on and up to each line) are keys instead.
3. A key of at most ``RARE`` documents pairs all of them. A key of more pairs
   each document with one before it, in chains dealt over salted groups, so that
   pairs grow with the documents and never with the square of a group. Any
   earlier holder of a window will do, as it holds the window whole.
4. Each pair's whole line-hash sequences are aligned as patience diff does: lines
   that occur once in both, in the longest order common to both, are anchors;
   equal lines next to anchors and, between anchors, the same again. Blocks are
   measured in the alignment of this pair alone. Lines left over are aligned
   again, so that blocks in another order go too; at last the windows that are
   left are looked up in the earlier document, so that no repeated line hides one.
5. The ranges found with all partners are united and cut out.

Lines are compared without white space at their ends, by 64-bit hashes; blank
lines neither match nor break a block. Null and empty texts stay as they are.
Rows with a null doc_id stay and are compared to nothing. Rows that repeat a
doc_id and its text are one document and lose the same lines; rows of one doc_id
with different texts are documents of their own. Very long texts are compared
whole. An empty table gives an empty one. Extra columns stay, those named like
an output are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize, packed, slices, whole_groups

BLOCK_WORDS = 25
#: Documents that may have a rare line.
RARE = 4
#: Documents in one chain of a frequent key.
CHAIN_ROWS = 500

Line = tuple[int, int]  # position, hash
Range = tuple[int, int]  # [start, end)


def lines_of(text: str) -> list[str]:
    return list(filter(None, map(str.strip, text.split("\n"))))


def windows(words: list[int], least_words: int) -> list[Range]:
    """The shortest ranges with ``least_words`` words from each line on and up to each line."""
    sums = [0, *accumulate(words)]
    if sums[-1] < least_words:
        return []
    out = {(i, bisect_left(sums, sums[i] + least_words)) for i in range(len(words))}
    out |= {(bisect_right(sums, sums[i] - least_words) - 1, i) for i in range(1, len(sums))}
    return sorted((a, b) for a, b in out if 0 <= a < b < len(sums))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            own = [lines_of(t) for t in part.column("text").to_pylist()]
            hashes = pa.array([[xxhash.xxh3_64_intdigest(x) - 2**63 for x in ls] for ls in own], pa.list_(pa.int64()))
            words = pa.array([[len(x.split()) for x in ls] for ls in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("fp"), hashes, words], ["id", "fp", "hashes", "words"])


def _runs(places: list[int]) -> list[Range]:
    """Ranges of adjoining places, which are sorted."""
    cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1] + 1), len(places)]
    return [(places[a], places[b - 1] + 1) for a, b in zip(cuts, cuts[1:], strict=False)] if places else []


def keys_of(places: list[int], hashes: list[int], words: list[int], rare: list[bool], least_words: int) -> set[int]:
    """The keys of a document, from its shared lines in order."""
    at = {p: i for i, p in enumerate(places)}
    out: set[int] = set()
    for a, b in _runs(places):
        own = range(at[a], at[a] + b - a)
        if sum(words[i] for i in own) < least_words:
            continue
        out.update(hashes[i] for i in own if rare[i])
        for c, d in _runs([i for i in own if not rare[i]]):
            for x, y in windows(words[c:d], least_words):
                out.add(xxhash.xxh3_64_intdigest(np.array(hashes[c + x : c + y], "<i8").tobytes()) - 2**63)
    return out


def _keys(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["id", "fp"]):
            ids, fps = table.column("id").to_numpy(), table.column("fp").to_numpy()
            columns = [table.column(c).to_pylist() for c in ("pos", "h", "n_words", "rare")]
            keys, of = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                found = keys_of(*(c[a:b] for c in columns), least_words)
                keys += found
                of += [a] * len(found)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids[of]), pa.array(fps[of])], ["key", "id", "fp"])

    return run


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain rising in both parts of pairs sorted by the first."""
    tops, ends, back = [], [], [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            ends.append(i)
        else:
            tops[k], ends[k] = y, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(later: list[Line], earlier: list[Line]) -> list[tuple[int, int]]:
    """Pairs of positions that patience diff aligns, given lines of both in order."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(later), 0, len(earlier))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and later[a][1] == earlier[c][1]:
            out.append((later[a][0], earlier[c][0]))
            a, c = a + 1, c + 1
        while a < b and c < d and later[b - 1][1] == earlier[d - 1][1]:
            b, d = b - 1, d - 1
            out.append((later[b][0], earlier[d][0]))
        if a >= b or c >= d:
            continue
        once: dict[int, list[int]] = {}
        for i in range(a, b):
            once.setdefault(later[i][1], []).append(i)
        other: dict[int, list[int]] = {}
        for j in range(c, d):
            other.setdefault(earlier[j][1], []).append(j)
        pairs = [(i[0], other[h][0]) for h, i in once.items() if len(i) == 1 and len(other.get(h, ())) == 1]
        anchors = _longest_increasing(sorted(pairs))
        if not anchors:
            continue
        i0, j0 = a, c
        for i, j in [*anchors, (b, d)]:
            # Equal lines on both sides of an anchor go with it, before the parts between are searched for anchors.
            stack.append((i0, i, j0, j))
            if i < b:
                out.append((later[i][0], earlier[j][0]))
            i0, j0 = i + 1, j + 1
    return out


def blocks(aligned: list[tuple[int, int]], words: list[int], least_words: int) -> list[Range]:
    """Ranges of the later document whose lines are aligned with adjoining lines of the earlier one, long enough."""
    out, start = [], 0
    aligned = sorted(aligned)
    for k in range(1, len(aligned) + 1):
        if k == len(aligned) or aligned[k] != (aligned[k - 1][0] + 1, aligned[k - 1][1] + 1):
            a, b = aligned[start][0], aligned[k - 1][0] + 1
            if sum(words[a:b]) >= least_words:
                out.append((a, b))
            start = k
    return out


def common_blocks(later: list[int], words: list[int], earlier: list[int], least_words: int = BLOCK_WORDS) -> list[Range]:
    """Ranges of ``later`` (line hashes, and the lines' words) to delete for one earlier document."""
    gone: set[int] = set()
    there = list(enumerate(earlier))
    left, held = list(enumerate(later)), set(earlier)
    while left:
        found = blocks(align(left, there), words, least_words)
        if not found:
            break
        gone.update(i for a, b in found for i in range(a, b))
        left = [x for x in left if x[0] not in gone and x[1] in held]  # blocks in another order
    if any(h in held for i, h in enumerate(later) if i not in gone):
        at: dict[int, list[int]] = {}
        for j, h in there:
            at.setdefault(h, []).append(j)
        known: dict[tuple[int, ...], bool] = {}  # equal windows of a text that repeats itself are looked up once
        for a, b in windows(words, least_words):
            if all(i in gone for i in range(a, b)):
                continue
            own = tuple(later[a:b])
            if own not in known:
                h = min(own, key=lambda x: len(at.get(x, ())))
                k = own.index(h)
                known[own] = any(j >= k and tuple(earlier[j - k : j - k + b - a]) == own for j in at.get(h, ()))
            if known[own]:
                gone.update(range(a, b))
    return _runs(sorted(gone))


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _blocks(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = [common_blocks(*x, least_words) for x in zip(*(part.column(c).to_pylist() for c in ("hashes", "words", "there")), strict=True)]
                some = pa.array([i for i, r in enumerate(found) if r], pa.int64())
                ranges = pa.array([[{"start": a, "end": b} for a, b in r] for r in found if r], _RANGES)
                yield pa.RecordBatch.from_arrays([part.column("id").take(some), part.column("fp").take(some), ranges], ["id", "fp", "ranges"])

    return run


_KEYS = "key bigint, id bigint, fp bigint"


def overlapping(seqs: DataFrame, least_words: int = BLOCK_WORDS, rare: int = RARE, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """(id, fp, other_id, other_fp): pairs of a document and an earlier one to align, each once.

    Whatever block a document has in common with any earlier one lies in the
    union of those that it has in common with its partners.
    """
    # Both sides of the joins below are written tables: plain shuffles, in which adaptive execution splits a hot line or key.
    counts = seqs.select(F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts.select(F.col("h").alias("g"), (F.col("n") <= rare).alias("rare")), "shared_lines")
    lines = seqs.select("id", "fp", F.posexplode(F.arrays_zip("hashes", "words")).alias("pos", "line")).select("id", "fp", "pos", F.col("line.hashes").alias("h"), F.col("line.words").alias("n_words"))
    shared = lines.join(counts, F.col("h") == F.col("g")).drop("g")
    dealt = shared.repartition("id", "fp").sortWithinPartitions("id", "fp", "pos")
    keys = materialize(dealt.mapInArrow(_keys(least_words), _KEYS), "line_keys")
    doc = F.struct("id", "fp")
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(doc).alias("first")).where("n > 1").withColumnRenamed("key", "k")
    members = materialize(keys.join(materialize(held, "shared_keys"), F.col("key") == F.col("k")).drop("k"), "key_members")
    few = members.where(F.col("n") <= rare).groupBy("key").agg(F.collect_list(doc).alias("docs"))  # ``rare`` at most
    all_pairs = few.select(F.explode("docs").alias("d"), "docs").select("d", F.explode("docs").alias("e")).where("e < d")
    many = members.where(F.col("n") > rare).withColumn("chain", F.pmod(F.xxhash64("id", "fp"), F.ceil(F.col("n") / chain_rows)))
    before = F.lag(doc).over(Window.partitionBy("key", "chain").orderBy("id", "fp"))
    chained = many.select(doc.alias("d"), F.coalesce(before, "first").alias("e")).where("e < d")
    pairs = all_pairs.unionByName(chained).distinct()
    return pairs.select(F.col("d.id").alias("id"), F.col("d.fp").alias("fp"), F.col("e.id").alias("other_id"), F.col("e.fp").alias("other_fp"))


def sequences(docs: DataFrame) -> DataFrame:
    """(id, fp, hashes, words): the lines of each distinct document."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("fp"), "text").where("id is not null and text <> ''")
    return materialize(texts.mapInArrow(_sequences, "id bigint, fp bigint, hashes array<bigint>, words array<int>").dropDuplicates(["id", "fp"]), "line_sequences")


def shared_blocks(docs: DataFrame, least_words: int = BLOCK_WORDS, rare: int = RARE, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """(id, fp, removed): ranges of non-blank lines that an earlier document has, for documents with any."""
    seqs = sequences(docs)
    pairs = materialize(overlapping(seqs, least_words, rare, chain_rows), "document_pairs")
    other = seqs.select(F.col("id").alias("e_id"), F.col("fp").alias("e_fp"), F.col("hashes").alias("there"))
    met = pairs.join(other, (F.col("other_id") == F.col("e_id")) & (F.col("other_fp") == F.col("e_fp"))).select("id", "fp", "there")
    own = seqs.select(F.col("id").alias("d_id"), F.col("fp").alias("d_fp"), "hashes", "words")
    both = met.join(own, (F.col("id") == F.col("d_id")) & (F.col("fp") == F.col("d_fp"))).select("id", "fp", "hashes", "words", "there")
    found = both.mapInArrow(_blocks(least_words), "id bigint, fp bigint, ranges array<struct<start:int,end:int>>")
    # A document's ranges lie within it: those that partners share are kept once.
    once = found.select("id", "fp", F.explode("ranges").alias("r")).distinct()
    return once.groupBy("id", "fp").agg(F.collect_list("r").alias("removed"))


def _cut(batch: pa.RecordBatch) -> dict:
    texts, counts = [], []
    for text, removed in zip(batch.column("body").to_pylist(), batch.column("removed").to_pylist(), strict=True):
        if not removed:
            texts.append(text)
            counts.append(0)
            continue
        gone = {i for r in removed for i in range(r["start"], r["end"])}
        kept, at = [], 0
        for line in text.split("\n"):
            if line.strip():
                if at not in gone:
                    kept.append(line)
                at += 1
            else:
                kept.append(line)
        texts.append("\n".join(kept) if any(map(str.strip, kept)) else "")
        counts.append(len(gone))
    return {"text": pa.array(texts, pa.string()), "n_removed": pa.array(counts, pa.int64())}


def dedup_lines(docs: DataFrame, least_words: int = BLOCK_WORDS, rare: int = RARE, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """``docs`` with text without the blocks that an earlier document has, and n_removed, the number of lines deleted."""
    found = shared_blocks(docs, least_words, rare, chain_rows)
    columns = [c for c in docs.columns if c.lower() != "n_removed"]
    others = [F.col(f"`{c}`") for c in columns if c != "text"]  # in a struct, where no name can clash
    rows = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("bigint").alias("own_id"), F.xxhash64("text").alias("own_fp"), F.col("text").alias("body"))
    joined = rows.join(found, (F.col("own_id") == F.col("id")) & (F.col("own_fp") == F.col("fp")), "left").select("row", "body", "removed")
    out = map_texts(joined, "body", [T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())], lambda: _cut)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns), "n_removed")


def distinct_text(docs: DataFrame) -> DataFrame:
    """``docs`` with deduplicated texts (n_chars follows), other columns of any name as they were; documents of which nothing is left are dropped."""
    rows, columns = packed(docs, "doc_id")
    out = dedup_lines(rows).where((F.col("n_removed") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        columns[docs.columns.index("n_chars")] = counted.alias("n_chars")
    return out.select(*columns)
