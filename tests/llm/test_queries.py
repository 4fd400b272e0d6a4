"""The registered queries and the pipeline on the small tables."""

import math
import os
import re
import zlib
from collections import defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import packing, quality
from tallyloom.llm import queries as llm
from tallyloom.llm.common import scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    df = llm.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    sql = llm.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in names) for r in rows), key=key) == sorted(want.fetchall(), key=key)


NASTY = [(1, "one two three", "en", "a", 3), (1, "one two three", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "x y z", "en", "a", 1), (4, "word " * 30_000, "en", "a", 5), (4, "another text of this id", "en", "a", 5)]
#: Names that operators give to columns of their own.
CLASHES = ("__doc", "score", "predicted", "n_removed", "removed", "ranges", "id", "fp", "hashes", "words", "key", "row", "body", "class_id", "n_links", "node", "cluster", "sig", "f", "n_words", "item_ids", "hit_ranges", "k", "piece", "length", "offset", "sequence_id", "__salt", "a.b", "__statistics")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nasty = spark.createDataFrame(NASTY, docs.schema).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    out = stage(spark, nasty, SF)
    rows = out.collect()
    assert rows
    if (name, stage) != corpus_pipeline.STAGES[-1]:
        assert out.columns == nasty.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert stage(spark, docs.limit(0), SF).count() == 0


def plainly(spark):
    """The documents that reach the last stage, by plain means: trees walked a row at a time, runs of lines in a set, all pairs of shingle sets, windows of lists."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())

    def accepted(text):
        (x,), total = quality.statistics(pa.array([text])), forest.base
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + math.exp(-total)) >= quality.THRESHOLD

    rows = [r for r in rows if accepted(r[1])]
    seen, kept = set(), []
    for doc, text in rows:
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        sums = [0, *accumulate(len(x.split()) for x in lines)]
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sums[b] - sums[a] >= 25]
        gone = {i for a, b in runs if tuple(lines[a:b]) in seen for i in range(a, b)}
        seen.update(tuple(lines[a:b]) for a, b in runs)
        out, at = [], 0
        for line in text.split("\n"):
            if not line.strip() or at not in gone:
                out.append(line)
            at += bool(line.strip())
        text = "\n".join(out) if gone else text
        if not gone or text.strip():
            kept.append((doc, text))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for d, t in kept}
    root = {d: d for d in shingles}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a in shingles:
        for b in shingles:
            if a < b and shingles[a] and 0.8 * len(shingles[a]) <= len(shingles[b]) <= 1.25 * len(shingles[a]) and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [(d, t) for d, t in kept if find(d) == d]
    items = [w for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() if (w := words(t or ""))]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    return {d: t for d, t in kept if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))}


def test_pipeline_brute(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    want = plainly(spark)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.5 * n < len(want) < n
    own, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        own[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert own.keys() == want.keys()
    for doc, text in want.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(own[doc], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in pieces] == packing.pieces_of(len(ids), 1024)
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces]
    for slots in places.values():
        slots.sort()
        assert [o for o, _ in slots] == [0, *accumulate(n for _, n in slots)][:-1] and sum(n for _, n in slots) <= 1024


def test_nothing_is_left_behind(spark, tmp_path):
    """Tables that an operator writes on the way are gone once its result is written and the scope left."""
    shared = spark.conf.get("spark.checkpoint.dir")[len("file://") :]
    before = set(os.listdir(shared))
    with scratch():
        for name in ("op4_best_fit_packing", "op5_line_dedup", "op8_warc", "op9_sharding"):
            llm.queries()[name](spark, SF).write.parquet(str(tmp_path / name))
        assert set(os.listdir(shared)) > before
    assert set(os.listdir(shared)) == before
    assert spark.read.parquet(str(tmp_path / "op9_sharding")).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    kept = corpus_pipeline.run(spark, SF)
    assert len(set(os.listdir(shared)) - before) == 1 and kept.count() > 0  # the last stage's rows


def test_session_settings_stay(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    llm.queries()["op9_sharding"](spark, SF).count()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.files.maxPartitionBytes"))
