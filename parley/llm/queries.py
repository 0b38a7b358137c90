"""The registered queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, minhash, mixing, neighbours, pii, quality, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == held, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", _fold(5, 0), "score", "predicted")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.linked(_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", _fold(5, 0), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(_table(spark, sf_dir, "documents"), pii.key_of(spark)).drop("spans")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.quality(docs, model).select("doc_id", _fold(4, 2), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontam.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Plan(width=4, percent=80))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", "part", "shards")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.licenses(docs, licenses.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_toxicity, op2_embedding_near_dedup, op3_language_id, op4_warc, op5_pii, op6_quality, op7_decontamination, op8_minhash_near_dedup, op9_mixing, op10_licenses)
    }


_COMPONENTS = """
reach(node, root) AS (
  SELECT {id}, {id} FROM nodes
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
"""

OP2 = f"""
WITH RECURSIVE nodes AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
),
edges AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM nodes p JOIN nodes q ON p.label = q.label AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.v, q.v) >= 0.98
),
{_COMPONENTS.format(id="vec_id")},
deg AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp c ON c.node = e.vec_id LEFT JOIN deg d ON d.a = e.vec_id
"""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS h FROM p),
m AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN m.top IS NULL OR m.top = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.top <> d.page_id THEN m.top END AS refers_to
FROM d LEFT JOIN m ON d.n >= 1000 AND m.h = d.h
"""

OP7 = r"""
WITH plain AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, list_aggregate(w[i : i + least(len(w), 13) - 1], 'string_agg', ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bench WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM wins),
grams AS (
  SELECT doc_id, k, i, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM plain CROSS JOIN sizes WHERE len(w) >= k)
),
found AS (SELECT g.doc_id, g.i, g.k, w.item_id FROM grams g JOIN wins w ON w.k = g.k AND w.s = g.s),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT p.doc_id, len(p.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(p.w) AS contaminated
FROM plain p LEFT JOIN hit h ON h.doc_id = p.doc_id LEFT JOIN items t ON t.doc_id = p.doc_id
"""

OP8 = rf"""
WITH RECURSIVE plain AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
nodes AS (SELECT doc_id FROM plain),
sh AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + 3], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM plain WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id),
edges AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
{_COMPONENTS.format(id="doc_id")}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM plain d JOIN comp c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express; the others are tested against brute force, round trips or held-out labels."""
    return {"op2_embedding_near_dedup": OP2, "op4_warc": OP4, "op7_decontamination": OP7, "op8_minhash_near_dedup": OP8}
