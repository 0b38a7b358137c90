"""Conversation structure: export, replies, order, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rel
from ..sources import UTTERANCES, table, utterances
from .registry import register


@register(
    "annotation_export",
    f"""WITH {UTTERANCES}, o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS local_order,
         sum(CASE WHEN length(text) >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS so,
         dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS author_no FROM utt)
SELECT o.id, o.conv_id, o.role, o.local_order::BIGINT AS local_order, CASE WHEN length(o.text) >= 40 THEN o.so END::BIGINT AS substantive_order,
       o.author_no::BIGINT AS author_no, o.reply_to, t.local_order::BIGINT AS reply_order, coalesce(nullif(trim(o.text), ''), '(empty)') AS text
FROM o LEFT JOIN o t ON t.conv_id = o.conv_id AND t.id = o.reply_to""",
)
def annotation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order within the case, substantive order, speaker number and the reply target's order; both shuffles are by case, for the windows and for the targets."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    big = F.length("text") >= 40
    o = utterances(spark, sf_dir).withColumn("local_order", F.row_number().over(w).cast("long"))
    o = o.withColumn("so", F.sum(big.cast("long")).over(w)).withColumn("author_no", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("role")).cast("long"))
    t = o.select("conv_id", F.col("id").alias("reply_to"), F.col("local_order").alias("reply_order"))
    x = o.join(t, ["conv_id", "reply_to"], "left")
    text = F.coalesce(F.when(F.trim("text") != "", F.trim("text")), F.lit("(empty)"))
    return x.select("id", "conv_id", "role", "local_order", F.when(big, F.col("so")).alias("substantive_order"), "author_no", "reply_to", "reply_order", text.alias("text"))


_FORWARD = f"WITH {UTTERANCES}, f AS (SELECT *, conv_id::VARCHAR || '.' || (turn + 1)::VARCHAR AS target, CASE WHEN role = 'user' THEN conv_id::VARCHAR || '.' || (turn + 1)::VARCHAR END AS original_id FROM utt)"


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances that refer to the next turn, which the last of a case does not have; a user's also has that as its original id."""
    after = F.concat_ws(".", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"))
    return utterances(spark, sf_dir).withColumn("target", after).withColumn("original_id", F.when(F.col("role") == "user", after))


@register("dangling_replies", f"{_FORWARD} SELECT k.id, k.target FROM f k LEFT JOIN f p ON p.conv_id = k.conv_id AND p.id = k.target WHERE p.id IS NULL")
def dangling_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose target is not in the case, as an anti-join."""
    k = _forward(spark, sf_dir)
    return k.join(k.select("conv_id", F.col("id").alias("target")), ["conv_id", "target"], "left_anti").select("id", "target")


@register(
    "unresolved_alias",
    f"""{_FORWARD}, al AS (SELECT DISTINCT conv_id, unnest([id, original_id]) AS alias FROM f)
SELECT k.role, count(*)::BIGINT AS n_children, count(a.alias)::BIGINT AS n_resolved FROM f k LEFT JOIN al a ON a.conv_id = k.conv_id AND a.alias = k.target GROUP BY k.role""",
)
def unresolved_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children matched through any alias of a row."""
    k = _forward(spark, sf_dir)
    al = k.select("conv_id", F.explode(F.array("id", "original_id")).alias("alias")).where("alias IS NOT NULL").distinct()
    x = k.join(al.select("conv_id", F.col("alias").alias("target"), "alias"), ["conv_id", "target"], "left")
    return x.groupBy("role").agg(F.count("*").alias("n_children"), F.count("alias").alias("n_resolved"))


@register(
    "or_join_parent",
    f"""WITH {UTTERANCES}, p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'old:' || id ELSE id END AS id, conv_id::VARCHAR || '.' || (turn + 1)::VARCHAR AS original_id FROM utt),
j AS (SELECT c.id, p.id AS parent, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN p.id = c.reply_to THEN 0 ELSE 1 END, p.turn) AS rn
  FROM utt c JOIN p ON p.conv_id = c.conv_id AND (p.id = c.reply_to OR p.original_id = c.reply_to))
SELECT id, parent FROM j WHERE rn = 1""",
)
def or_join_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on either of two keys, the exact one first, as a union of equi-joins and one row a child."""
    u = utterances(spark, sf_dir)
    own = F.when(F.col("role") == "user", F.concat(F.lit("old:"), F.col("id"))).otherwise(F.col("id")).alias("parent")
    older = F.concat_ws(".", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")).alias("reply_to")
    p = u.select("conv_id", own, older, F.col("turn").alias("pt"))
    a = p.select("conv_id", F.col("parent").alias("reply_to"), "parent", F.lit(0).alias("rank"), "pt")
    x = u.select("conv_id", "id", "reply_to").join(a.unionByName(p.withColumn("rank", F.lit(1))), ["conv_id", "reply_to"])
    return rel.top1(x.select("id", "parent", "rank", "pt"), ["id"], [F.col("rank"), F.col("pt")]).select("id", "parent")


@register(
    "reply_depth_root",
    f"""WITH RECURSIVE {UTTERANCES}, r AS (SELECT id, id AS root, 0::BIGINT AS depth FROM utt WHERE reply_to IS NULL
  UNION ALL SELECT u.id, r.root, r.depth + 1 FROM utt u JOIN r ON u.reply_to = r.id) SELECT u.id, r.root, r.depth, r.id IS NULL AS reply_cycle FROM utt u LEFT JOIN r ON r.id = u.id""",
)
def reply_depth_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and root of each reply by pointer doubling; rows of a cycle have neither and a flag."""
    u = utterances(spark, sf_dir)
    return rel.roots(u.select(F.col("id").alias("node"), F.col("reply_to").alias("parent"))).select(F.col("node").alias("id"), "root", "depth", F.col("cycle").alias("reply_cycle"))


@register(
    "first_reply",
    f"WITH {UTTERANCES} SELECT reply_to AS id, min(turn)::BIGINT AS first_reply_turn, arg_min(role, turn) AS first_reply_role, count(*)::BIGINT AS n_replies FROM utt WHERE reply_to IS NOT NULL GROUP BY reply_to",
)
def first_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest reply of each utterance."""
    u = utterances(spark, sf_dir).where("reply_to IS NOT NULL")
    return u.groupBy(F.col("reply_to").alias("id")).agg(F.min("turn").alias("first_reply_turn"), F.min_by("role", "turn").alias("first_reply_role"), F.count("*").alias("n_replies"))


@register(
    "utterance_order",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id)::BIGINT AS utterance_order FROM events",
)
def utterance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronology with a unique tie-break."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_last(), "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("utterance_order"))


@register(
    "display_order",
    f"""WITH {UTTERANCES} SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, turn, id)::BIGINT AS display_order FROM utt""",
)
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untimed context first, then turns."""
    w = Window.partitionBy("conv_id").orderBy(F.when(F.col("role") == "system", 0).otherwise(1), "turn", "id")
    return utterances(spark, sf_dir).select("id", F.row_number().over(w).cast("long").alias("display_order"))


@register(
    "simultaneity_groups",
    "SELECT user_id, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
)
def simultaneity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at one time."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("user_id", "hour").agg(F.count("*").alias("n")).where("n > 1")


@register(
    "unique_alias_resolution",
    "SELECT source AS alias, count(DISTINCT lang)::BIGINT AS n_candidates, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS resolved FROM documents GROUP BY source",
)
def unique_alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias resolves only if it has one candidate."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("alias"), "lang")
    return rel.unique_resolution(d, ["alias"], "lang")


@register(
    "identity_full_outer",
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS presence FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id",
)
def identity_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence on either side."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("a"))
    x = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("b")), "doc_id", "full")
    return x.select("doc_id", F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both").alias("presence"))


@register(
    "append_only_registry",
    "SELECT doc_id AS k, 'quality:' || quality::VARCHAR AS v FROM labels UNION ALL SELECT doc_id, 'source:' || source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def append_only_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first issue wins; labels were issued before documents."""
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.concat(F.lit("quality:"), F.col("quality").cast("string")).alias("v"))
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.concat(F.lit("source:"), F.col("source")).alias("v"))
    return rel.append_only(old, new, "k")


@register("upsert_last_wins", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return rel.extreme(e, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_type", "ts")


@register("keep_first_dedupe", "SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256, count(*)::BIGINT AS n FROM documents GROUP BY sha256(text)")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each content; texts never shuffle, only their hashes."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@register("identity_conflicts", "SELECT sha256(text) AS text_sha256, count(DISTINCT source)::BIGINT AS n_sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One content under several identities."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256"))
    return d.agg(F.count_distinct("source").alias("n_sources")).where("n_sources > 1")
