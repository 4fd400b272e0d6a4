"""One query per operator over its whole table, and SQL where SQL can tell the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, jaccard, licenses, lines, packing, quality, shards, topk, warc

ARRIVALS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/hundred/id.txt; short ones (at most 60 words) with a statement count as their directory's licence file."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select("doc_id", "text", path.alias("path"), (F.size(F.split("text", r"\s+")) <= 60).alias("short"))
    found = licenses.scan_licenses(files, is_license_file=F.col("short"), keep_text=False)
    return found.select("doc_id", "path", "license", "cosine", "line", "origin", "license_path")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_removed")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_pages(spark, _table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the last version of a store holds them."""
    docs = _table(spark, sf_dir, "documents")
    store = shards.shard(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_html_extraction, op3_quality_classifier, op4_best_fit_packing, op5_line_dedup, op6_benchmark_decontamination, op7_ngram_jaccard_join, op8_warc, op9_sharding, op10_exact_topk)}


_OP8 = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
     d AS (SELECT page_id, CAST(STRLEN(payload) AS BIGINT) AS payload_bytes, SHA1(payload) AS payload_digest FROM p),
     k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN MAX(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM k
"""
_OP10 = """
WITH v AS (SELECT vec_id, LIST_TRANSFORM(embedding, lambda x: CAST(FLOOR(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
     r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


_OP6 = r"""
WITH d AS (SELECT doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     items AS (SELECT DISTINCT item_id, LEAST(LEN(w), 10) AS k, ARRAY_TO_STRING(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, UNNEST(RANGE(1, GREATEST(LEN(w) - 9, 1) + 1)) AS i FROM b WHERE LEN(w) > 0)),
     sizes AS (SELECT DISTINCT k FROM items),
     grams AS (SELECT doc_id, k, i, ARRAY_TO_STRING(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, UNNEST(RANGE(1, LEN(w) - k + 2)) AS i FROM d, sizes WHERE LEN(w) >= k)),
     hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN items USING (k, g)),
     words AS (SELECT doc_id, COUNT(DISTINCT x) AS n FROM (SELECT doc_id, UNNEST(RANGE(i, i + k)) AS x FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
     ids AS (SELECT doc_id, COUNT(*) AS n, STRING_AGG(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(COALESCE(words.n, 0) AS BIGINT) AS n_hit, CAST(COALESCE(ids.n, 0) AS BIGINT) AS n_items, SHA256(COALESCE(ids.s, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""


# Every shortest run of lines of 25 words, from each line on and up to each line, that a document with a lesser doc_id has.
_OP5 = r"""
WITH d AS (SELECT doc_id, STRING_SPLIT(text, CHR(10)) AS ls FROM documents WHERE text IS NOT NULL),
     l AS (SELECT doc_id, p, line, REGEXP_REPLACE(line, '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, UNNEST(ls) AS line, GENERATE_SUBSCRIPTS(ls, 1) AS p FROM d)),
     n AS (SELECT doc_id, p, s, LEN(REGEXP_EXTRACT_ALL(s, '\S+')) AS w, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE s <> ''),
     c AS (SELECT doc_id, i, w, SUM(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n),
     whole AS (SELECT doc_id, LIST(s ORDER BY i) AS ss FROM n GROUP BY doc_id),
     spans AS (SELECT a.doc_id, a.i AS x, b.i AS y FROM c a JOIN c b ON a.doc_id = b.doc_id WHERE b.upto >= a.upto - a.w + 25 AND b.upto - b.w < a.upto - a.w + 25
               UNION SELECT a.doc_id, a.i, b.i FROM c a JOIN c b ON a.doc_id = b.doc_id WHERE a.upto - a.w <= b.upto - 25 AND a.upto > b.upto - 25),
     keyed AS (SELECT doc_id, x, y, MD5(ARRAY_TO_STRING(ss[x:y], CHR(10))) AS k FROM spans JOIN whole USING (doc_id)),
     held AS (SELECT doc_id, x, y, MIN(doc_id) OVER (PARTITION BY k) AS holder FROM keyed),
     gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, UNNEST(RANGE(x, y + 1)) AS i FROM held WHERE holder < doc_id)),
     cut AS (SELECT doc_id, COUNT(*) AS g FROM gone GROUP BY doc_id),
     kept AS (SELECT l.doc_id, STRING_AGG(l.line, CHR(10) ORDER BY l.p) AS t, BOOL_OR(l.s <> '') AS more FROM l LEFT JOIN n ON l.doc_id = n.doc_id AND l.p = n.p LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.i = gone.i WHERE gone.i IS NULL GROUP BY l.doc_id)
SELECT x.doc_id, CASE WHEN g IS NULL THEN x.text WHEN more THEN t ELSE '' END AS text, CAST(COALESCE(g, 0) AS BIGINT) AS n_removed
FROM documents x LEFT JOIN cut ON x.doc_id = cut.doc_id LEFT JOIN kept ON x.doc_id = kept.doc_id
"""
_OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, MD5(ARRAY_TO_STRING(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, GREATEST(LEN(w) - 4, 1) + 1)) AS i FROM d WHERE LEN(w) > 0)),
     size AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
     common AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
     e AS (SELECT u, v FROM common JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 10 * k >= 8 * (x.n + y.n - k)),
     r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON r.doc_id = e.u)
SELECT r.doc_id, MIN(root) AS class_id, CAST((SELECT COUNT(*) FROM e WHERE e.u = r.doc_id) AS BIGINT) AS n_links FROM r GROUP BY r.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": _OP5,
        "op7_ngram_jaccard_join": _OP7,
        "op6_benchmark_decontamination": _OP6,
        "op8_warc": _OP8,
        "op9_sharding": "SELECT doc_id, lang, source, n_chars, MD5(text) AS text_md5 FROM documents",
        "op10_exact_topk": _OP10,
    }
