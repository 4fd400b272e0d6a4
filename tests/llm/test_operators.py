"""Edge cases of every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns; and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, extract, jaccard, licenses, lines, packing, quality, shards, topk, warc
from tallyloom.llm.components import connected

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n, vocabulary=5000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def paragraphs(seed, n, size=30):
    return "\n".join(prose(seed * 1000 + i, size) for i in range(n))


LONG = paragraphs(9, 900)
NASTY = [
    (1, paragraphs(1, 4), "en", "a", 10),
    (2, paragraphs(1, 4), "en", "a", 10),  # a copy
    (3, paragraphs(1, 3) + "\n" + prose(77, 6), None, "a", None),  # a near copy
    (4, None, "en", None, None),
    (5, "", "en", "a", 0),
    (6, " \n\t\n ", None, "a", 5),
    (7, LONG, "en", "b", len(LONG)),
    (8, "One.", "en", "b", 4),
    (8, "One.", "en", "b", 4),  # a repeated row
    (9, "one", "en", "b", 3),
    (None, paragraphs(1, 4), "en", "b", 1),
    (10, "Ünï ©ode 漢字 \U0001f600 \x00 end", "de", "b", 20),
]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(NASTY, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    """``df`` with extra columns of an output's name and of helpers' names, and one of a type of its own."""
    for n in (*names, "__doc", "__removed", "__kept", "__dir", "extra", "with.dot"):
        df = df.withColumn(n, F.array(F.lit(None).cast("string")))
    return df


# Decontamination


def hits(text, items, window=10):
    own, found, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            p = w[k : k + window]
            for i in range(len(own) - len(p) + 1):
                if own[i : i + len(p)] == p:
                    found |= set(range(i, i + len(p)))
                    ids.add(item)
    return len(own), len(found), ids


def test_decontaminate_brute(spark, nasty):
    items = [(1, prose(1000, 14)), (2, "ONE!"), (3, None), (4, ""), (5, "..."), (10, " ".join(words(LONG)[5000:5030])), (11, " ".join(words(LONG)[5000:5030])), (None, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    known = [(i, t) for i, t in items if t]
    for size in (1 << 20, 100, 1):  # one pass, several, and one an item
        got = decontaminate.scan(clashing(nasty, "n_words", "hit_ranges", "item_ids"), bench, pass_bytes=size).collect()
        assert len(got) == len(NASTY)
        for r in got:
            n, hit, ids = hits(r.text, known)
            assert (r.n_words, sum(x.end - x.start for x in r.hit_ranges), r.item_ids) == (n, hit, sorted(ids, key=lambda x: (x is None, x)))
    report = {r.doc_id: r for r in decontaminate.report(nasty, bench).collect()}
    assert report[7].n_items == 2 and report[7].items_sha256 == hashlib.sha256(b"10,11").hexdigest()
    assert report[4].items_sha256 == hashlib.sha256(b"").hexdigest() and not report[4].contaminated
    assert report[9].contaminated and report[8].contaminated
    assert report[9].n_items == 2 and report[9].items_sha256 == hashlib.sha256(b"2").hexdigest()  # an item without an id counts
    some = clashing(nasty, "n_words", "key", "row", "k", "ranges", "ids")
    assert decontaminate.scan(some, bench, pass_bytes=1).columns == [c for c in some.columns if c != "n_words"] + ["n_words", "hit_ranges", "item_ids"]


def test_decontaminate_empty(spark, nasty, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(nasty, none).where("contaminated").count() == 0
    assert decontaminate.report(empty, none).count() == 0
    kept = decontaminate.decontaminate(clashing(nasty), none)
    assert kept.count() == len(NASTY) and kept.columns == clashing(nasty).columns


def test_shift_tables_random():
    rng = random.Random(3)
    for _ in range(30):
        letters = "ab" if rng.random() < 0.5 else "abcdef"
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))  # noqa: B023, E731
        items = [(i, " ".join(word() for _ in range(rng.randint(1, 13)))) for i in range(6)]
        texts = [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(20)]
        texts[3] += " " + items[0][1]
        n, ranges, ids = decontaminate.Searcher(items, 3)(pa.array(texts))
        for t, k, r, i in zip(texts, n, ranges, ids, strict=True):
            assert (k, sum(b - a for a, b in r), i) == hits(t, items, 3)


# Near duplicates


def brute_classes(rows, threshold=0.8):
    own = {}
    for i, t, *_ in rows:
        w = words(t)
        own[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and i is not None else set()
    parent, links = {i: i for i in own}, Counter()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in own if i is not None)
    for a in ids:
        for b in ids:
            if a < b and own[a] and own[b] and len(own[a] & own[b]) >= threshold * len(own[a] | own[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def near_copies():
    """A chain of texts that differ by ever more words, a family of near copies and unrelated texts."""
    rows, base = [], prose(5, 120).split()
    for k in range(12):
        own = base[:]
        for j in range(k):
            own[j * 9] = f"x{j}"
        rows.append((100 + k, " ".join(own)))
    rows += [(200 + k, prose(6, 150) + f" tail{k}") for k in range(12)]
    rows += [(300 + k, prose(300 + k, 80)) for k in range(12)]
    rows += [(400, "a b c"), (401, "A, b. C!"), (402, "a b"), (403, prose(6, 150) + " tail3")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 2, "cluster_shingles": 300}])
def test_near_duplicates_brute(spark, sizes):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(df, **sizes).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_exact(spark):
    """All the given documents against an exact join: shared shingles counted through an index of all of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders, links, root = defaultdict(list), Counter(), {d: d for d in sets}

    def find(d):
        return d if root[d] == d else find(root[d])

    for d in sorted(sets):
        for e, n in Counter(e for s in sets[d] for e in holders[s]).items():
            if n >= 0.8 * (len(sets[d]) + len(sets[e]) - n) - 1e-9:
                links.update((d, e))
                x, y = sorted((find(d), find(e)))
                root[y] = x
        for s in sets[d]:
            holders[s].append(d)
    assert sum(links.values()) > 100
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()} == {d: (find(d), links[d]) for d in sets}


def test_near_duplicates_edges(spark, nasty, empty):
    got = jaccard.near_duplicates(clashing(nasty, "fp", "sig", "n_shingles")).collect()
    assert len(got) == len(NASTY)
    by = {r.doc_id: (r.class_id, r.n_links) for r in got}
    assert by[1][0] == by[2][0] == 1 and by[4] == (4, 0) and by[5] == (5, 0) and by[6] == (6, 0) and by[None] == (None, 0)
    assert by[9][0] == 8
    kept = jaccard.deduplicated(clashing(nasty))
    assert kept.columns == clashing(nasty).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {1, 4, 5, 6, 7, 8, None} <= set(ids) and 2 not in ids and 9 not in ids
    assert jaccard.near_duplicates(empty).count() == 0


def test_pruning_rule():
    rule = jaccard.least_matches(0.8)
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(300):  # pairs of similarity 0.8: values agree with that probability
        a = rng.integers(0, 60000, jaccard.HASHES).astype(np.uint16)
        b = np.where(rng.random(jaccard.HASHES) < 0.8, a, a + 1).astype(np.uint16)
        lost += len(jaccard.survives(a, b[None], rule)) == 0
    assert lost == 0
    assert len(jaccard.survives(a, (a + 1)[None], rule)) == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# Lines


def test_line_dedup(spark, nasty, empty):
    passage = prose(50, 55)
    rows = [(20, prose(1, 20) + "\n" + passage + "\n" + prose(2, 20)), (21, prose(3, 20) + "\n\n  " + passage + "\n" + prose(4, 20)), (22, passage), (23, "Thanks.\n" + prose(5, 40)), (24, "Thanks.\n" + prose(6, 40))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got[20] == (rows[0][1], 0)
    assert got[21] == (prose(3, 20) + "\n\n" + prose(4, 20), 1)
    assert got[22] == ("", 1)
    assert got[23][1] == got[24][1] == 0  # a short line of two documents stays
    out = lines.dedup_lines(clashing(nasty, "n_removed")).collect()
    assert len(out) == len(NASTY)
    by = {r.doc_id: r for r in out}
    assert by[2].text == "" and by[2].n_removed == 4 and by[3].text == prose(77, 6) and by[3].n_removed == 3
    assert by[4].text is None and by[5].text == "" and by[6].text == " \n\t\n " and by[7].text == LONG and by[8].n_removed == 0 and by[None].text == by[1].text
    kept = lines.distinct_text(clashing(nasty))
    assert kept.columns == clashing(nasty).columns
    rest = {r.doc_id: r.n_chars for r in kept.collect()}
    assert 2 not in rest and rest[3] == len(prose(77, 6)) and rest[7] == len(LONG)
    assert lines.dedup_lines(empty).count() == 0


def test_alignment():
    a = [(i, h) for i, h in enumerate("abcXdefg")]
    b = [(i, h) for i, h in enumerate("ZabcdeYfg")]
    assert sorted(lines.align(a, b)) == [(0, 1), (1, 2), (2, 3), (4, 4), (5, 5), (6, 7), (7, 8)]
    assert sorted(lines.align(list(enumerate("xxxx")), list(enumerate("xx")))) == [(0, 0), (1, 1)]
    rng = random.Random(1)
    for _ in range(200):  # aligned pairs are equal lines and rise in both
        a, b = ([(i, rng.choice("abcdefgh")) for i in range(rng.randint(0, 12))] for _ in range(2))
        got = sorted(lines.align(a, b))
        assert all(a[i][1] == b[j][1] for i, j in got)
        assert all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:], strict=False))


def test_line_dedup_other_order(spark):
    p, q, r = ("\n".join(prose(60 + 10 * k + i, 10) for i in range(4)) for k in range(3))  # passages of four lines of ten words
    own = [prose(90 + i, 20) for i in range(8)]
    t, u = "\n".join(prose(400 + i, 10) for i in range(5)), "\n".join(prose(410 + i, 10) for i in range(4))
    s = "\n".join([*u.split("\n")[:2], prose(420, 10), *u.split("\n")[2:]])
    gap = "\n".join([*q.split("\n")[:2], own[4], *q.split("\n")[2:]])
    rows = [
        (1, f"{p}\n{q}"), (2, f"{own[0]}\n{q}"), (3, f"{own[1]}\n{q}\n{p}\n{own[2]}"),  # both orders, and one alone between
        (4, f"{r}\n{own[3]}\n{gap}"), (5, f"{gap}\n{own[5]}\n{r}"),  # halves of a passage, too short; then the same text in the other order
        (6, "\n".join([*p.split("\n")[2:], own[6], *p.split("\n")[:2]])),  # pieces of a passage, too short
        (7, f"{own[7]}\n" + "\n".join(p.split("\n")[::-1])),  # its lines the other way round
        (8, f"{s}\n{t}"), (9, f"{t}\n{u}"),  # a moved block, and one that no earlier document has without a line inside
    ]
    got = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == own[0] and got[3] == f"{own[1]}\n{own[2]}"
    assert got[4] == rows[3][1] and got[5] == own[5]
    assert got[8] == rows[7][1] and got[9] == u
    assert got[6] == rows[5][1] and got[7] == rows[6][1]


def test_line_dedup_blocks_of_one_document(spark):
    x, y, z = (prose(700 + i, 12) for i in range(3))
    block = [prose(710 + i, 10) for i in range(6)]
    scattered = "\n".join(w for i, line in enumerate(block) for w in (line, prose(730 + i, 15)))
    rows = [
        (1, f"{x}\n{prose(720, 30)}"), (2, f"{y}\n{prose(721, 30)}"), (3, f"{z}\n{prose(722, 30)}"), (9, f"{x}\n{y}\n{z}"),  # three lines of three documents
        (11, scattered), (12, "\n".join([prose(740, 20), *block])), (13, "\n".join([*block, prose(741, 20)])),  # the block whole only in the second
        (20, f"{prose(750, 30)}\nown line one"), (20, f"{prose(751, 30)}\nown line two"), (19, prose(751, 30)),  # texts of one id
        (30, prose(760, 40)), (30, prose(760, 40)), (31, prose(760, 40)),  # a repeated row
    ]
    got = Counter((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    want = Counter((i, t, 0) for i, t in rows if i not in (13, 31) and not t.endswith("two"))
    want.update([(13, prose(741, 20), 6), (20, "own line two", 1), (31, "", 1)])
    assert got == want


def removed_by_all_pairs(docs, least=lines.BLOCK_WORDS):
    """Lines that stay of each document, given (order, lines): every run of lines of every earlier document is compared."""
    out = {}
    for key, own in docs.items():
        gone = set()
        for other, there in docs.items():
            if other >= key:
                continue
            runs = {tuple(there[a:b]) for a in range(len(there)) for b in range(a + 1, len(there) + 1) if sum(len(x.split()) for x in there[a:b]) >= least}
            gone |= {i for a in range(len(own)) for b in range(a + 1, len(own) + 1) if tuple(own[a:b]) in runs for i in range(a, b)}
        out[key] = [x for i, x in enumerate(own) if i not in gone]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_brute(spark, seed):
    rng = random.Random(seed)
    pool = [prose(3000 + 100 * seed + i, rng.choice((1, 2, 4, 9, 14, 27))) for i in range(12 if seed % 2 else 60)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 8))] for _ in range(9)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages) for _ in range(rng.randint(0, 3))] + [[rng.choice(pool)] for _ in range(rng.randint(0, 5))] + [[prose(9000 + 100 * seed + d, 12)]]
        rng.shuffle(parts)
        rows.append((rng.randrange(50), "\n".join(x for part in parts for x in part)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = {(r.doc_id, r.text): (r.doc_id, r.fp) for r in df.withColumn("fp", F.xxhash64("text")).collect()}
    want = removed_by_all_pairs({keys[d, t]: t.split("\n") for d, t in rows})
    want = Counter((d, "\n".join(want[keys[d, t]])) for d, t in rows)
    for sizes in ({}, {"rare": 1, "chain_rows": 2}):
        assert Counter((r.doc_id, r.text) for r in lines.dedup_lines(df, **sizes).collect()) == want


def test_windows_cover_runs():
    rng = random.Random(2)
    for _ in range(200):
        counts = [rng.randint(1, 30) for _ in range(rng.randint(0, 14))]
        found = lines.windows(counts, 25)
        assert all(sum(counts[a:b]) >= 25 for a, b in found)
        for a in range(len(counts)):
            for b in range(a + 1, len(counts) + 1):
                if sum(counts[a:b]) >= 25:
                    assert {x for c, d in found if a <= c and d <= b for x in range(c, d)} == set(range(a, b))


def test_common_blocks_of_pairs():
    """Any two sequences, with repeated lines: the runs that both have, and no other line."""
    rng = random.Random(4)
    for _ in range(400):
        words = {h: rng.choice((1, 2, 3, 6)) for h in range(8)}
        own, there = ([rng.randrange(8 if rng.random() < 0.8 else 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        runs = {tuple(there[a:b]) for a in range(len(there)) for b in range(a + 1, len(there) + 1) if sum(words[h] for h in there[a:b]) >= 6}
        want = {i for a in range(len(own)) for b in range(a + 1, len(own) + 1) if tuple(own[a:b]) in runs for i in range(a, b)}
        assert {i for a, b in lines.common_blocks(own, [words[h] for h in own], there, 6) for i in range(a, b)} == want


# Packing


def test_tokens_match_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.PieceTokenizer(packing.tokenizer_path())
    texts = [t for _, t, *_ in NASTY if t] + [" ", "a  b", "x \n y", "a\n b", "it's we'll <|endoftext|> x", "\t\ta b c　d ", "é́ ² Ⅷ 12½", "a \x1c b\x1cc", " lead", "trail ", "a\n\nb c\n", "\xa0 a\xa0b c", "a b\x85c d"]
    for t in texts:
        assert encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]


def test_added_tokens_match_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.tokenizer(packing.tokenizer_path())
    mark = "<|endoftext|>"
    texts = [t for _, t, *_ in NASTY if t] + [f"a {mark} b", mark, mark * 3, f" {mark}  {mark}\n", f"x \n {mark}y", f"<|{mark}|>", "<|endoftext| >", "<|ENDOFTEXT|>", f"it's{mark}'s  c"]
    assert encode(f"a {mark} b") == np.array([64, 220, 50256, 275], "<u4").tobytes()
    for t in texts:
        assert encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]
    rows = packing.pack_documents(spark.createDataFrame([(1, f"a {mark} b")], "doc_id bigint, text string")).collect()
    assert [(r.length, r.ids) for r in rows] == [(5, [64, 220, 50256, 275, 2])]


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, nasty, empty):
    rows = packing.pack_documents(clashing(nasty, "piece", "offset", "sequence_id", "ids_crc32", "__salt", "__rank")).collect()
    check_packing(rows, 1024)
    encode = packing.PieceTokenizer(packing.tokenizer_path())
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    for doc, text in ((7, LONG), (1, NASTY[0][1]), (4, ""), (5, "")):
        ids = encode(text) + np.array([2], "<u4").tobytes()
        got = sorted(own[doc], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in got] == packing.pieces_of(len(ids) // 4, 1024)
        assert b"".join(np.array(r.ids, "<u4").tobytes() for r in got) == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert len(own[8]) == 2 and len(own[4]) == 1
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = 50
    counts = {n: rng.randrange(40) for n in range(1, 51) if rng.random() < 0.6}
    runs = packing.plan_packing(counts, capacity)
    used = Counter()
    for parts, n in runs:
        assert sum(parts) <= capacity and n > 0
        for p in parts:
            used[p] += n
    assert used == Counter({k: v for k, v in counts.items() if v})
    # Not more than best fit decreasing, piece by piece, but for a sequence in fifty.
    gaps = []
    for p in sorted(Counter(counts).elements(), reverse=True):
        fits = [g for g in gaps if g >= p]
        gaps.append(capacity) if not fits else None
        gap = min(fits) if fits else capacity
        gaps.remove(gap)
        gaps.append(gap - p)
    assert sum(n for _, n in runs) <= 1.02 * len(gaps) + 1


def test_sum_index():
    """Every lookup against a search over all combinations, while counts fall."""
    from itertools import combinations_with_replacement

    rng = random.Random(5)
    for _ in range(60):
        counts = {n: rng.randint(1, 3) for n in range(1, 21) if rng.random() < 0.4}
        index = packing.SumIndex(counts, 20)
        for _ in range(12):
            held = [n for n in range(1, 21) if index.left[n]]
            ways = lambda total, k: [c[::-1] for c in combinations_with_replacement(held, k) if sum(c) == total and all(c.count(p) <= index.left[p] for p in c)]  # noqa: B023, E731
            total = rng.randint(1, 20)
            assert index.pair(total, total) == max(ways(total, 2), default=None)
            assert index.triple(total) == max(ways(total, 3), default=None)
            found = index.exact(total)
            assert (found is None) == (not any(ways(total, k) for k in (1, 2, 3)))
            assert index.longest(total) == max((n for n in held if n <= total), default=0)
            if found:
                index.take(found, 1)


def test_plan_exact():
    assert sum(n for _, n in packing.plan_packing({7: 3, 2: 3, 1: 3}, 10)) == 3  # a pair fills each
    assert sum(n for _, n in packing.plan_packing({6: 1, 2: 1, 1: 2}, 10)) == 1  # a triple
    assert packing.plan_packing({10: 5}, 10) == [((10,), 5)]
    with pytest.raises(ValueError):
        packing.plan_packing({11: 1}, 10)


# Quality


def test_quality(spark, nasty, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = {r.doc_id for r in docs.where(quality.held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert held == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    found = {r.doc_id: r for r in quality.classify(clashing(docs, "score", "predicted"), labels).collect()}
    own = [(r.doc_id, r.quality) for r in labels.collect()]
    assert np.mean([found[i].predicted == q for i, q in own if i in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    # Held-out labels never matter.
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert {i: r.score for i, r in found.items()} == {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}
    messy = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (10**12, 1, 0)], labels.schema)).unionByName(labels)
    assert quality.classify(nasty, messy).count() == len(NASTY)
    none = labels.limit(0)
    assert {r.score for r in quality.classify(nasty, none).collect()} == {1.0}
    assert quality.classify(empty, labels).count() == 0
    assert quality.accepted(clashing(nasty), none).columns == clashing(nasty).columns


def test_forest_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.train(x, y, trees=40, depth=3)
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95

    def walk(row):  # one row, one tree at a time
        total = forest.base
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.scores(x[:50]), [walk(r) for r in x[:50]])
    assert 0.9 < quality.train(x, np.ones(800)).scores(x[:1])[0] <= 1


def test_splits_brute():
    """A tree's splits against a search over every feature and cut of the binned values."""
    rng = np.random.default_rng(3)
    for _ in range(10):
        x = rng.integers(0, 6, (120, 3)).astype(float)
        y = (rng.random(120) < np.where(x[:, rng.integers(3)] > 2, 0.9, 0.2)).astype(float)
        forest = quality.train(x, y, trees=1, depth=2, least=10)
        p = 1 / (1 + np.exp(-forest.base))
        grad, hess = y - p, np.full(120, p * (1 - p))

        def best(rows, x=x, grad=grad, hess=hess):
            gain = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
            cuts = [(gain(rows & (x[:, j] <= c)) + gain(rows & (x[:, j] > c)) - gain(rows), j, c) for j in range(3) for c in np.unique(x[rows, j])[:-1] if min((rows & (x[:, j] <= c)).sum(), (rows & (x[:, j] > c)).sum()) >= 10]
            return max(cuts, default=(0.0, None, None), key=lambda e: e[0]) if rows.sum() >= 20 else (0.0, None, None)

        open_ = [(int(forest.roots[0]), np.ones(120, bool), 0)]
        while open_:
            node, rows, level = open_.pop()
            found, j, c = best(rows)
            if forest.feature[node] < 0:
                assert level == 2 or found <= 1e-6
                assert forest.value[node] == pytest.approx(0.15 * grad[rows].sum() / (hess[rows].sum() + 1))
                continue
            left = rows & (x[:, forest.feature[node]] <= forest.threshold[node])
            gain = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
            assert gain(left) + gain(rows & ~left) - gain(rows) == pytest.approx(found)
            open_ += [(int(forest.left[node]), left, level + 1), (int(forest.right[node]), rows & ~left, level + 1)]


# HTML

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home</a></nav><div id="wrap"><div class="article-body"><h1>Head &amp; tail</h1>
<p>One <b>two</b>&nbsp;three &lt;b&gt; and some more text, long enough to count.</p><p>Short.<p>Unclosed <i>one with more words than before</i><ul><li>item a<li>item b</ul><script>var x="<p>no</p>"</script></div>
<div class="comments"><p>A comment that is longer than anything else on this page, by far, and goes on and on.</p></div></div><aside>Side</aside><form>F<input></form><div class="cookie-notice">C</div><footer>Foot</footer></body></html>"""


def test_extract(spark):
    assert extract.text_of(PAGE) == "Head & tail\nOne two three <b> and some more text, long enough to count.\nShort.\nUnclosed one with more words than before\nitem a\nitem b"
    assert extract.text_of("plain text") == "plain text" and extract.text_of("") == extract.text_of(None) == "" and extract.text_of("<") == "<"
    assert extract.text_of("<article><p>a<br>b</p></article>") == "a b"
    assert extract.text_of("<!-- open") == "" and extract.text_of("<script>open") == ""
    layout = '<body class="has-sidebar"><div class="page with-sidebar"><article class="post category-legal"><p>Kept text.</p></article><section class="comments"><article class="comment"><p>Dropped text, and longer than the other.</p></article></section></div></body>'
    assert extract.text_of(layout) == "Kept text."
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert extract.text_of(deep) == "x"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "long " * 200_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = extract.extract(clashing(df, "text", "n_chars")).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter([(1, len(extract.text_of(PAGE)))] * 2 + [(2, 0), (3, 0), (None, 999_999)])
    assert extract.extract(df.limit(0)).count() == 0


def test_extract_layouts():
    long = "Words of a paragraph that goes on for long enough to be dense, and then some more of them. " * 3
    said = long.strip()
    page = lambda inner: extract.text_of(f"<html><body>{inner}</body></html>").split("\n")
    # A title beside the text's box, furniture around it.
    assert page(f'<div id="page-header">Site</div><h1>Title</h1><div><p>{long}</p><p>End.</p></div><div class="related-posts"><p>{long}</p></div>') == ["Title", said, "End."]
    # A long quotation is not the whole text, nor is the longest of several sections.
    assert page(f"<div><p>First.</p><blockquote><p>{long}</p><p>{long}</p></blockquote><p>Last.</p></div>") == ["First.", said, said, "Last."]
    assert page(f"<div><section><h2>A</h2><p>{long}</p></section><section><h2>B</h2><p>Short.</p></section></div>") == ["A", said, "B", "Short."]
    # Dense text of no telling name beside an article isn't part of it; a second article is.
    assert page(f'<div class="xyz"><p>{long}</p></div><article><p>{long}</p><p>{long}</p></article>') == [said, said]
    assert page(f"<article><p>{long}</p></article><article><p>{long}</p></article>") == [said, said]
    # Cells of a layout table.
    assert page(f"<table><tr><td><a href=a>menu</a><td><h2>A</h2><p>{long}<p>{long}</table>") == ["A", said, said]


def article_of(page):
    """The text of a given page's article, by regular expressions."""
    import html

    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
    return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in parts)))


def given_pages():
    import duckdb

    return [h for (h,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]


def test_extract_article_of_pages():
    for page in given_pages():
        assert extract.text_of(page) == article_of(page)
        assert extract.text_of(page.replace("<article>", "<div>").replace("</article>", "</div>")) == article_of(page)


def test_extract_by_density_alone(monkeypatch):
    """Pages without any telling element, class or id: the densities find the text, and nothing else does."""
    pages = [(re.sub("(</?)(?:nav|article|footer)>", r"\1div>", p.replace(' class="ad"', "")), article_of(p)) for p in given_pages()]
    found = [extract.text_of(p) for p, _ in pages]
    assert all(want in text for text, (_, want) in zip(found, pages, strict=True))  # the rest is a short box as dense as the text
    assert np.mean([text == want for text, (_, want) in zip(found, pages, strict=True)]) > 0.75
    measure = extract.measure

    def shuffled(nodes, body):
        measure(nodes, body)
        rng = random.Random(len(nodes))
        for n in nodes:
            n.density, n.total = 300 * rng.random(), 1000 * rng.random()

    monkeypatch.setattr(extract, "measure", shuffled)
    assert np.mean([extract.text_of(p) == want for p, want in pages]) < 0.1


def test_extract_keeps_what_only_sounds_like_furniture():
    long = "Words of a paragraph that goes on for long enough to be dense, and then some more of them. " * 3
    said = long.strip()
    for extra, text in (
        ('<p class="warning">Mind the gap.</p>', "Mind the gap."), ('<div class="legal-analysis">Of the law.</div>', "Of the law."), ('<table class="search-results"><tr><td>A cell.</td></tr></table>', "A cell."),
        ('<p id="form-factor">Its form.</p>', "Its form."), ("<p><math><mi>x</mi></math></p>", "x"), ("<header><h1>A title</h1></header>", "A title"), ('<section id="related-work"><p>Of others.</p></section>', "Of others."),
        ('<h2 id="discussion">Discussion</h2>', "Discussion"), ('<div class="headerless shared-memory">Kept.</div>', "Kept."),
    ):
        for box in ("article", "div"):
            if (box, text) != ("div", "A title"):
                assert extract.text_of(f"<body><{box}><p>{long}</p>{extra}<p>{long}</p></{box}></body>") == f"{said}\n{text}\n{said}", extra
    for extra in ('<div class="ad">Buy.</div>', '<div class="cookie-notice">Cookies.</div>', '<section id="comments-area"><p>Reader says.</p></section>', '<div class="page-header">Site</div>', '<footer>End</footer>', '<div class="ad_300x250">Buy.</div>', '<ul class="site-nav"><li>Home</li></ul>', '<div class="related-posts">More</div>', '<form><p>Name</p></form>', "<article class='comment'><p>Reader.</p></article>", '<div role="navigation">N</div>', "<p hidden>H</p>"):
        assert extract.text_of(f"<body><article><p>{long}</p>{extra}<p>{long}</p></article></body>") == f"{said}\n{said}", extra


def test_extract_bare_text():
    long = "Words of a paragraph that goes on for long enough to be dense, and then some more of them. " * 3
    page = f"<body><div>Bare <b>and bold</b> text,<br><br>parted by breaks. {long}<div><p>{long}</p><p>{long}</p></div>And a last word.</div><div><a href=x>one</a> <a href=y>two</a></div></body>"
    said = long.strip()
    assert extract.text_of(page) == f"Bare and bold text, parted by breaks. {said}\n{said}\n{said}\nAnd a last word."


def test_densities_brute():
    """Counts, densities and sums of small random trees, by the definitions and recursion."""
    import math

    rng = random.Random(3)

    def grow(depth):
        tag = rng.choice(["div", "p", "a", "ul", "section", "b"]) if depth else "body"
        parts = ["x" * rng.randint(0, 30) if rng.random() < 0.5 else grow(depth + 1) for _ in range(rng.randint(0, 4 if depth < 4 else 0))]
        return tag, parts

    def build(tree, parent=None):
        node = extract.Node(tree[0], parent)
        node.parts = [p if isinstance(p, str) else build(p, node) for p in tree[1]]
        return node

    def counts(tree, linked=False):
        linked |= tree[0] == "a"
        own = sum(len(p) for p in tree[1] if isinstance(p, str))
        c, t, lc, lt = own, 1, own * linked, int(linked)
        for p in tree[1]:
            if not isinstance(p, str):
                c, t, lc, lt = (x + y for x, y in zip((c, t, lc, lt), counts(p, linked), strict=True))
        return c, t, lc, lt

    def value(c, t, lc, lt, share):
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1) + math.e - 1) / math.log(c / max(c - lc, 1) * lc + share * c + math.e) if c else 0.0

    def check(tree, node, share, linked=False):
        linked |= tree[0] == "a"
        own = sum(len(p) for p in tree[1] if isinstance(p, str))
        assert node.density == pytest.approx(value(*counts(tree, linked), share))
        kids = [p for p in tree[1] if not isinstance(p, str)]
        assert node.total == pytest.approx(value(own, 1, own * linked, int(linked), share) + sum(value(*counts(k, linked), share) for k in kids))
        for k, n in zip(kids, [p for p in node.parts if not isinstance(p, str)], strict=True):
            check(k, n, share, linked)

    for _ in range(200):
        tree = grow(0)
        body = build(tree)
        extract.measure(extract._order(body), body)
        c, _, lc, _ = counts(tree)
        check(tree, body, lc / c if c else 0.0)


# WARC


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://x/ä b", big), (2, None, big), (3, "http://y", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u\r\nWARC-Type: x", "<p>\r\n\r\nWARC/1.1\r\n</p>" * 100), (None, "u", big), (3, "http://y", big), (9, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    root = (tmp_path / "warc").as_uri()
    got = warc.archive_pages(spark, clashing(df, "archive", "payload_digest"), root).collect()
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        again = i in (1, 2)
        want[(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.url for r in got if r.page_id == 1} == {"http://x/%C3%A4%20b"}
    files = sorted((tmp_path / "warc" / "records").glob("*.gz"))
    for f in files:  # each record is a gzip member of its own, at its offset
        data = f.read_bytes()
        for line in (f.parent / f"{f.name}.idx").read_text().splitlines():
            at, size, _ = line.split("\t")
            assert zlib.decompress(data[int(at) : int(at) + int(size)], 31).startswith(b"WARC/1.1")
    assert warc.archive_pages(spark, df.limit(0), (tmp_path / "none").as_uri()).count() == 0


def test_inflate(tmp_path):
    import gzip

    data = bytes(random.Random(0).randrange(4) for _ in range(300_000)) + b"\0" * 30_000_000
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(data) + gzip.compress(b"tail"))
    assert b"".join(warc.inflate(path.as_uri())) == data + b"tail"
    path.write_bytes(gzip.compress(data)[:-20])
    with pytest.raises(EOFError):
        list(warc.inflate(path.as_uri()))


# Shards


def test_shards(spark, tmp_path, nasty, empty):
    rows = clashing(nasty)
    store = shards.ShardStore(spark, (tmp_path / "a store").as_uri(), rows.schema)
    for i in range(5):
        assert store.append(rows, F.lit(i % 2)) == i + 1
    before = store.manifest().count()
    version = store.compact()
    assert before == 5 and version == 6 and store.manifest().count() == 1
    key = lambda r: str(r)
    assert sorted(map(key, store.read().collect())) == sorted(map(key, rows.collect() * 5))
    assert store.read(1).count() == len(NASTY) and store.compact() == version
    assert sum(r.n_rows for r in store.manifest().collect()) == 5 * len(NASTY)
    with pytest.raises(shards.VersionConflict):
        store.commit(store.manifest(), version)
    assert store.vacuum() == 5 and store.vacuum() == 0 and store.read().count() == 5 * len(NASTY)
    bare = shards.ShardStore(spark, (tmp_path / "e").as_uri(), empty.schema)
    assert bare.read().count() == 0 and bare.compact() == 0
    bare.append(empty)
    assert bare.read().count() == 0


def test_shard(spark, nasty, empty):
    rows = clashing(nasty, "__arrival", "arrival", "run", "a.b")
    key = lambda r: str(r)
    store = shards.shard(rows, F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    assert sorted(map(key, store.read().collect())) == sorted(map(key, rows.collect())) and store.read().columns == rows.columns
    assert store.vacuum() == 0  # nothing of the merges is left
    assert shards.shard(empty, F.lit(1)).read().count() == 0


def test_shards_tiers(spark, tmp_path):
    """Runs of unlike sizes are never merged together, and settled ones stay."""
    store = shards.ShardStore(spark, (tmp_path / "t").as_uri(), spark.range(1).schema, target_bytes=100_000, fanout=3)
    tiers = lambda: sorted(r.tier for r in store.manifest().collect())
    store.append(spark.range(200_000).coalesce(1))  # one file, larger than the target
    store.append(spark.range(10).coalesce(1))
    store.append(spark.range(10).coalesce(1))
    assert tiers() == [-1, 0, 0] and store.compact() == 3
    settled = store.manifest().where("tier = -1").first().run
    store.append(spark.range(10).coalesce(1))
    assert store.compact() == 5
    assert store.manifest().where("tier = -1").first().run == settled and store.manifest().count() == 2
    assert store.read().count() == 200_030
    conf = "spark.sql.files.maxPartitionBytes"
    assert spark.conf.get(conf) == "134217728b"


# Top-k


def test_topk_brute(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 3) for i in range(300)]
    rows += [(300 + i, [0.5] * 6, 0) for i in range(60)]  # equal vectors: ties to the smaller id
    rows += [(600 + i, [float(x) for x in rng.normal(size=4)], 0) for i in range(50)]  # of another length: searched among themselves
    rows += [(400, None, 0), (420, [float("nan")] * 6, 0), (440, [None] + [1.0] * 5, 0), (460, [float("inf")] * 6, 0), (480, [], 0), (500, [1.0], 0), (None, [1.0] * 6, 0), (0, rows[0][1], 0), (520, [0.0] * 6, 1)]
    rows += [(20, [3.0, -2.0, 0.0, 0.0, 0.0, 1.0], 0)]  # another vector of a query's id
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    valid = [(i, tuple(np.floor(64 * np.array(v, np.float32).astype(float)).astype(int).tolist())) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for i, q in set(valid):
        if i % 20 == 0:
            best = sorted((-int(np.dot(q, v)), j) for j, v in valid if j != i and len(v) == len(q))[:20]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    base = topk.integers(df)
    queries = base.where("vec_id % 20 = 0")
    for sizes in ({}, {"candidate_rows": 50, "query_rows": 4}, {"candidate_rows": 9}):
        got = Counter(map(tuple, topk.top_k(queries, base, **sizes).collect()))
        assert got == want
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(clashing(df, "v", "rank", "qid", "floor", "width")).count() == want.total()


def test_threshold_search_brute():
    rng = np.random.default_rng(7)
    for trial in range(40):
        n, width, k = int(rng.integers(1, 300)), int(rng.integers(1, 9)), int(rng.integers(1, 25))
        x = rng.integers(-6, 7, (n, width)) if trial % 2 else np.floor(rng.normal(size=(n, width)) ** 3 * 20).astype(int)
        ids = rng.permutation(n)
        queries = rng.integers(-3, 4, (5, width))
        lists = topk.Lists(ids, x, np.float32)
        for floors in (None, np.array([np.nan, -50.0, 0.0, 10.0, 60.0])):
            for i, rows, scores, done in topk.threshold_search(lists, np.array([0, 1, 2, -1, -1]), queries, k, floors):
                own = [0, 1, 2, -1, -1][i]
                all_ = sorted((-int(queries[i] @ v), int(j)) for j, v in zip(ids, x, strict=True) if j != own)
                floor = -np.inf if floors is None or np.isnan(floors[i]) or not queries[i].any() else floors[i]
                assert [(-int(s), int(lists.ids[r])) for r, s in zip(rows, scores, strict=True)] == [e for e in all_ if -e[0] >= floor][:k]
                assert done <= n


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (4000, 8))
    x[:30] = 60
    lists = topk.Lists(np.arange(4000), x, np.float64)
    (_, rows, scores, done) = next(topk.threshold_search(lists, np.array([-1]), np.ones((1, 8)), 20))
    assert rows.tolist() == list(range(20)) and set(scores) == {480} and done < 400
    (_, rows, _, done) = next(topk.threshold_search(lists, np.array([-1]), np.ones((1, 8)), 20, np.array([481.0])))
    assert not len(rows) and done < 40  # nothing can reach the bound that another block gave


def test_threshold_scores_fewer_rows():
    """On vectors with a few large dimensions; near-isotropic ones, as the given, let no list end early (README has the share)."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(5000, 64)) * 64 * np.exp(-np.arange(64) / 4)).astype(int)
    lists = topk.Lists(np.arange(5000), x, np.float64)
    assert np.mean([done for *_, done in topk.threshold_search(lists, np.arange(0, 5000, 100), x[::100], 20)]) < 2500


# Licences


def test_licenses(spark, empty):
    rows = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/x.py", "code"), ("a/b/y.py", "# Released under the MIT License.\ncode"), ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("z.py", None), ("d/e.py", ""), (None, "Licensed under CC BY-NC 4.0."), ("a/x.py", "public licence matters are dull"), ("a/x.py", "public licence matters are dull"), ("d/long.py", LONG + "\nLicensed under CC BY-NC 4.0."),
        ("t/LICENSE", "Released under the MIT License."), ("t/LICENSE.b", "Licensed under the Apache License, Version 2.0."), ("t/q", "x"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = [(r.path, r.license, r.origin, r.license_path) for r in licenses.scan_licenses(clashing(df, "license", "cosine", "origin")).collect()]
    assert Counter(got) == Counter([
        ("a/LICENSE", "Apache-2.0", "own", "a/LICENSE"), ("a/b/c/x.py", "GPL-3.0", "inherited", "a/b/COPYING.txt"), ("a/b/y.py", "MIT", "own", "a/b/y.py"), ("a/b/COPYING.txt", "GPL-3.0", "own", "a/b/COPYING.txt"),
        ("z.py", None, "none", None), ("d/e.py", None, "none", None), (None, "CC-BY-NC-4.0", "own", None), ("a/x.py", "Apache-2.0", "inherited", "a/LICENSE"), ("a/x.py", "Apache-2.0", "inherited", "a/LICENSE"), ("d/long.py", "CC-BY-NC-4.0", "own", "d/long.py"),
        ("t/LICENSE", "MIT", "own", "t/LICENSE"), ("t/LICENSE.b", "Apache-2.0", "own", "t/LICENSE.b"), ("t/q", "MIT", "inherited", "t/LICENSE"),
    ])
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_triggers_lose_nothing(spark):
    matcher = licenses.Matcher()
    for (text,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        want = (None, 0.0, None)
        for i, line in enumerate((text or "").split("\n")):
            name, cosine = matcher.best(line)
            if name and cosine > want[1]:
                want = (name, cosine, i)
        assert matcher.scan(text)[:2] == want[:2]


def test_license_wrapped_statements():
    import textwrap

    matcher = licenses.Matcher()
    header = "# Copyright (c) 2019 The Example Authors. All rights reserved.\n"
    name, cosine, line = matcher.scan(header + "# This work is licensed\n# under a Creative Commons\n# Attribution-NonCommercial\n# 4.0 International License.\ncode")
    assert (name, cosine, line) == ("CC-BY-NC-4.0", 1.0, 1)
    for name, own in licenses.TEMPLATES.items():
        for text in own:
            if sum(text in texts for texts in licenses.TEMPLATES.values()) > 1:
                continue
            for width in (14, 30, 70):  # over many lines, some without a word of weight
                wrapped = header + "//\n" + "\n".join("// " + x for x in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False)) + "\nint main() {}\n"
                assert matcher.scan(wrapped)[:2] == (name, 1.0), (name, width)
    # Copies as they are met, with a title and a holder's name.
    title = "BSD License\n\nCopyright (c) 2020, A. Holder\n\n"
    texts = {n: max(licenses.TEMPLATES[n], key=len) for n in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC")}
    assert all(len(t) > 500 for t in texts.values())
    for name, text in texts.items():
        assert matcher.scan(title + "\n".join(textwrap.wrap(text.replace("copyright holder ", "A. Holder "), 72)))[0] == name


def test_license_runs_brute():
    rng = random.Random(6)
    templates = {n: licenses.TEMPLATES[n] for n in ("CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0", "Unlicense")}
    matcher = licenses.Matcher(templates)
    pool = [w for own in templates.values() for t in own for w in t.split()] + ["plain", "prose", "this"] * 6
    for _ in range(60):
        text = "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for _ in range(12))
        if rng.random() < 0.5:
            text += "\n" + "\n".join(rng.choice(templates[rng.choice([*templates])]).split(" ", 4)) + "\nplain prose"
        rows = text.split("\n")
        runs = [matcher.best(" ".join(rows[a:b])) for a in range(len(rows)) for b in range(a + 1, len(rows) + 1)]
        assert matcher.scan(text)[1] == max((c for n, c in runs if n), default=0.0)


# Openings and passages of licence texts that name other licences or versions, as published.
OPENINGS = {
    "GPL-1.0": "\n                    GNU GENERAL PUBLIC LICENSE\n                     Version 1, February 1989\n\n Copyright (C) 1989 Free Software Foundation, Inc.\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n",
    "LGPL-2.0": "                  GNU LIBRARY GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n[This is the first released version of the Lesser GPL.  It also counts\n as the successor of the GNU Library Public License, version 2, hence\n the version number 2.1.]\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.\n",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n",
    "GFDL-1.2": "                GNU Free Documentation License\n                  Version 1.2, November 2002\n",
    "GFDL-1.3": "                GNU Free Documentation License\n                 Version 1.3, 3 November 2008\n",
    "MPL-1.1": "                          MOZILLA PUBLIC LICENSE\n                                Version 1.1\n\n                              ---------------\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n",
    "Apache-2.0": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n",
    "EPL-1.0": "Eclipse Public License - v 1.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE\n",
    "EPL-2.0": "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE\n",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software\n",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE\n",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International\nPublic License\n",
}
PASSAGES = [
    "  13. Use with the GNU Affero General Public License.\n\n  Notwithstanding any other provision of this License, you have\npermission to link or combine any covered work with a work licensed\nunder version 3 of the GNU Affero General Public License into a single\ncombined work, and to convey the resulting work.",
    "1.12. \"Secondary License\"\n    means either the GNU General Public License, Version 2.0, the GNU\n    Lesser General Public License, Version 2.1, the GNU Affero General\n    Public License, Version 3.0, or any later versions of those\n    licenses.",
    "This General Public License does not permit incorporating your program into\nproprietary programs.  If your program is a subroutine library, you may\nconsider it more useful to permit linking proprietary applications with the\nlibrary.  If this is what you want to do, use the GNU Lesser General\nPublic License instead of this License.",
]


def test_license_texts():
    import glob
    import os

    matcher = licenses.Matcher()
    for name, opening in OPENINGS.items():
        assert matcher.scan(opening + "\n".join(PASSAGES))[0] == name
        assert matcher.scan("\n".join(PASSAGES) + "\n\n" + opening)[0] == name
    # Notices differ in the version and in a word of the name.
    for number in ("1", "2", "2.1", "3", "4"):
        for title in ("General", "Lesser General", "Library General", "Affero General"):
            notice = licenses._GNU.format(f"{title} Public License", number)
            name = {"General": "GPL", "Lesser General": "LGPL", "Library General": "LGPL", "Affero General": "AGPL"}[title] + f"-{number if '.' in number else number + '.0'}"
            known = name in licenses.TEMPLATES and (title, number) not in (("Lesser General", "2"), ("Library General", "3"), ("Library General", "2.1"))
            assert matcher.scan(notice)[0] == (name if known else None), notice
    assert matcher.scan("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.")[0] == "CC-BY-NC-ND-4.0"
    assert matcher.scan("Licensed under CC BY 3.0.")[0] is None and matcher.scan("Licensed under the Apache License v2")[0] == "Apache-2.0"
    named = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    for path in glob.glob("/usr/share/common-licenses/*"):  # where the system has them, the whole texts
        if (name := os.path.basename(path)) in named:
            with open(path, encoding="utf-8", errors="replace") as f:
                assert matcher.scan(f.read())[0] == named[name]


def cosines(templates, lines, limit):
    """The best (cosine, name) over all runs of lines of at most ``limit`` weighted words, by the definition of TF-IDF."""
    import math

    bags = [(n, Counter(licenses.tokens(t))) for n in sorted(templates) for t in templates[n]]
    weight = lambda w: math.log((1 + len(bags)) / (1 + sum(w in b for _, b in bags))) + 1
    own, best = [licenses.tokens(x) for x in lines], (0.0, None)
    vocabulary = {w for _, b in bags for w in b}
    known = {w: weight(w) for w in vocabulary}
    unseen = math.log(1 + len(bags)) + 1
    for a in range(len(own)):
        for b in range(a + 1, len(own) + 1):
            run = Counter(w for ws in own[a:b] for w in ws)
            if sum(run.values()) > limit and b > a + 1 or not vocabulary & run.keys():
                continue
            norm = math.sqrt(sum((c * known.get(w, unseen)) ** 2 for w, c in run.items()))
            for name, bag in bags:
                need, telling = licenses.required(name, bag)
                if not need <= run.keys() or telling is not None and telling != licenses.TELLING & run.keys():
                    continue
                dot = sum(run[w] * c * known[w] ** 2 for w, c in bag.items())
                cosine = round(dot / norm / math.sqrt(sum((c * known[w]) ** 2 for w, c in bag.items())), 12)
                if cosine >= licenses.THRESHOLD and cosine > best[0]:
                    best = (cosine, name)
    return best


def test_license_scan_brute():
    import duckdb

    matcher, rng = licenses.Matcher(), random.Random(11)
    texts = [t or "" for (t,) in duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    texts = [t for t in texts if t.count("\n") < 12]
    stated = [t for t in texts if matcher.scan(t)[0]]
    assert stated
    pool = [t for own in licenses.TEMPLATES.values() for t in own if len(t) < 250]
    made = ["\n".join([prose(i, 5), *rng.choice(pool).split(" ", rng.randint(0, 5)), prose(i + 1, 3)]) for i in range(25)]
    for text in stated[:15] + texts[:25] + made:
        cosine, name = cosines(licenses.TEMPLATES, text.split("\n"), matcher.most_words)
        got = matcher.scan(text)
        assert got[1] == pytest.approx(cosine, abs=1e-9) and (got[0] is None) == (name is None)


def test_license_inheritance_brute(spark):
    """Every file against a walk up its own path."""
    import os.path

    rng = random.Random(12)
    statements = [None, "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "plain words", "# Licensed under the Apache License, Version 2.0.\ncode"]
    rows = []
    for _ in range(250):
        folder = "/".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
        rows.append((f"{folder}/{rng.choice(['LICENSE', 'COPYING', 'x.py', 'y.c', 'z'])}".lstrip("/"), rng.choice(statements)))
    rows = list(dict(rows).items())
    matcher = licenses.Matcher()
    own = {p: matcher.scan(t) for p, t in rows}

    def walk(path):
        if own[path][0]:
            return own[path][0], "own", path
        folder = os.path.dirname(path)
        while True:
            said = [(-own[p][1], p) for p in own if os.path.dirname(p) == folder and os.path.basename(p) in ("LICENSE", "COPYING") and own[p][0]]
            if said:
                return own[min(said)[1]][0], "inherited", min(said)[1]
            if not folder:
                return None, "none", None
            folder = os.path.dirname(folder)

    got = {r.path: (r.license, r.origin, r.license_path) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {p: walk(p) for p, _ in rows}
