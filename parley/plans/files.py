"""Sources and sinks as queries: what was written is read back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import UTTERANCES, files, table, utterances
from .registry import register


def _folder(spark: SparkSession) -> str:
    return f"{files.shared_folder(spark)}/files-{uuid.uuid4().hex}"


@register("csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, text, lang, source FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through CSV, all columns text."""
    at = _folder(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")
    return files.csv_table(spark, files.write_csv(d, at))


@register(
    "selected_lines",
    f"WITH {UTTERANCES} SELECT id, conv_id::BIGINT AS conv_id, role, text, length(text)::BIGINT AS n FROM utt WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')",
)
def selected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of the selected conversations, as a semi-join after the parse."""
    at = files.write_lines(utterances(spark, sf_dir).select("id", "conv_id", "role", "text"), _folder(spark))
    lines = files.json_lines(spark, at, "id string, conv_id long, role string, text string")
    chosen = table(spark, sf_dir, "conversations").where("role = 'system'").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return lines.join(chosen, "conv_id", "left_semi").select("id", "conv_id", "role", "text", F.length("text").cast("long").alias("n"))


@register(
    "nested_cases",
    """WITH o AS (SELECT conv_id, turn, role, text, dense_rank() OVER (ORDER BY conv_id) - 1 AS case_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row_index, row_number() OVER (ORDER BY conv_id, turn) - 1 AS source_order FROM conversations)
SELECT case_index::BIGINT AS case_index, row_index::BIGINT AS row_index, source_order::BIGINT AS source_order, role, text FROM o""",
)
def nested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of cases with an array of rows each, unnested from exact byte spans."""
    c = table(spark, sf_dir, "conversations")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    case = c.groupBy("conv_id").agg(F.to_json(F.struct(rows.alias("rows")), {"ignoreNullFields": "false"}).alias("j"))
    whole = case.agg(F.concat(F.lit("[ "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "j"))), lambda x: x["j"]), " ,\n"), F.lit("]")).alias("content"))
    one = whole.select(F.lit("cases.json").alias("path"), F.col("content").cast("binary").alias("content"))  # one document, as a source file is
    return files.nested_rows(one, "rows", "role string, text string").select("case_index", F.col("row_index").cast("long").alias("row_index"), "source_order", "role", "text")


@register("blob_round_trip", "SELECT page_id, sha256(coalesce(html, '')) AS digest, coalesce(html, '') AS html FROM pages")
def blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents stored once by their hash and joined back to the rows."""
    at = _folder(spark)
    rows = files.put_blobs(table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")), "html", at)
    return rows.join(files.get_blobs(spark, at), "digest").select("page_id", "digest", F.col("content").cast("string").alias("html"))


@register(
    "revision_cache",
    "WITH a AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type <> 'error' THEN props END AS content FROM events) SELECT user_id, arg_max(event_id, struct_pack(a := content IS NOT NULL, b := ts, c := event_id)) AS event_id, count(content) > 0 AS has_content FROM a GROUP BY 1",
)
def revision_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value cache in which a record with content beats one without, and a later one an earlier one."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("content"))
    prefer = F.struct(F.col("content").isNotNull().alias("has"), "ts", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0")  # the two sources of the cache, together all rows
    return files.upsert(old, new, "user_id", prefer).select("user_id", "event_id", F.col("content").isNotNull().alias("has_content"))


@register(
    "revision_lookups",
    "WITH w AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, count(*) FILTER (e.ts >= lo AND e.ts <= hi)::BIGINT AS n_window, arg_max(e.event_id, struct_pack(a := e.ts, b := e.event_id)) FILTER (e.ts <= lo) AS baseline FROM events e JOIN w ON w.user_id = e.user_id GROUP BY 1",
)
def revision_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's history within a window, and the one revision at or before its start, by joins instead of requests."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    w = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    last = F.max(F.when(F.col("ts") <= F.col("lo"), F.struct("ts", "event_id")))["event_id"]
    return e.join(w, "user_id").groupBy("user_id").agg(F.count_if((F.col("ts") >= F.col("lo")) & (F.col("ts") <= F.col("hi"))).alias("n_window"), last.alias("baseline"))


@register(
    "resumed_shards",
    "SELECT doc_id, length(text)::BIGINT AS n FROM documents",
)
def resumed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that was stopped after some shards, and the run that finishes it; no row is made twice."""
    at = _folder(spark)
    todo = files.stage(spark, at, "todo", {"table": "documents", "version": 1}, lambda: table(spark, sf_dir, "documents").select("doc_id", "text"))
    make = lambda d: d.select("doc_id", F.length("text").cast("long").alias("n"))
    first = todo.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) < 3)  # what the stopped run got through
    files.resume_shards(first, "doc_id", 8, f"{at}/shards", make)
    return files.resume_shards(todo, "doc_id", 8, f"{at}/shards", make).drop("shard")


@register("view_catalog", "SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'labels', count(*)::BIGINT FROM labels UNION ALL SELECT 'labels_again', count(*)::BIGINT FROM labels")
def view_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over views of Parquet, one of them a second name, one an ordered copy."""
    at = files.write_table(table(spark, sf_dir, "labels"), _folder(spark), ["doc_id"])
    names = files.views(spark, {"parley_documents": f"{sf_dir}/documents.parquet", "parley_labels": at, "parley_labels_again": at})
    return spark.sql(" UNION ALL ".join(f"SELECT '{n.removeprefix('parley_')}' AS name, count(*) AS n FROM {n}" for n in names))


@register(
    "several_outputs",
    "SELECT 'long' AS output, count(*)::BIGINT AS n FROM documents WHERE n_chars > 500 UNION ALL SELECT 'foreign', count(*)::BIGINT FROM documents WHERE lang <> 'en' UNION ALL SELECT 'all', count(*)::BIGINT FROM documents",
)
def several_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the rows into several tables."""
    at = _folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    files.write_several(d, {"long": F.col("n_chars") > 500, "foreign": F.col("lang") != "en", "all": F.lit(True)}, at)
    return spark.read.parquet(at).groupBy("output").agg(F.count("*").alias("n"))


@register("table_schemas", "SELECT table_name AS \"table\", (ordinal_position - 1)::INT AS place, column_name AS \"column\", n AS n_rows FROM information_schema.columns JOIN (SELECT 'labels' AS t, count(*)::BIGINT AS n FROM labels UNION ALL SELECT 'nation', count(*)::BIGINT FROM nation) ON t = table_name")
def table_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, place and rows; types are left out here, as the engines name them differently."""
    found = files.schema_inventory(spark, {t: table(spark, sf_dir, t) for t in ("labels", "nation")})
    return found.select("table", "place", "column", "n_rows")
