"""Lifecycle, coverage and identifier queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import UTTERANCES, table, utterances
from .registry import register


@register(
    "edge_lags",
    """SELECT event_id, p AS parent_id, (epoch_us(ts) - epoch_us(pt))::BIGINT AS lag_us, ts < pt AS child_before_parent, ts = pt AS equal_time
FROM (SELECT event_id, ts, lag(event_id) OVER w AS p, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE p IS NOT NULL""",
)
def edge_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of each event to the one before it, and whether time runs back."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select("event_id", "ts", F.lag("event_id").over(w).alias("parent_id"), F.lag("ts").over(w).alias("pt")).where("parent_id IS NOT NULL")
    lag = (F.unix_micros("ts") - F.unix_micros("pt")).alias("lag_us")
    return e.select("event_id", "parent_id", lag, (F.col("ts") < F.col("pt")).alias("child_before_parent"), (F.col("ts") == F.col("pt")).alias("equal_time"))


@register(
    "deletion_states",
    """SELECT event_id, event_type, CASE WHEN event_type = 'error' AND was = 'error' THEN 'repeated_deletion' WHEN event_type = 'signup' AND was IS DISTINCT FROM 'error' THEN 'restoration_without_deletion' ELSE 'consistent' END AS state
FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events)
WHERE event_type IN ('error', 'signup')""",
)
def deletion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deleted flag over ordered actions; error deletes, signup restores.  Other rows never reach the shuffle."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = F.col("event_type")
    e = e.withColumn("was", was)
    state = F.when((t == "error") & (F.col("was") == "error"), "repeated_deletion").when((t == "signup") & ~F.col("was").eqNullSafe("error"), "restoration_without_deletion").otherwise("consistent")
    return e.select("event_id", "event_type", state.alias("state"))


@register("years_per_customer", "SELECT o_custkey, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years FROM orders GROUP BY 1")
def years_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted set of years of each customer."""
    y = F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("years")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(y)


@register(
    "lifecycle_counts",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n_modification, count(*) FILTER (WHERE event_type = 'error') AS n_deletion, count(*) FILTER (WHERE event_type = 'signup') AS n_restoration,
count(*) FILTER (WHERE event_type IN ('purchase', 'error', 'signup')) > 0 AS was_modified FROM events GROUP BY 1""",
)
def lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by kind of each entity."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    any_ = F.count_if(F.col("event_type").isin("purchase", "error", "signup")) > 0
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n("purchase").alias("n_modification"), n("error").alias("n_deletion"), n("signup").alias("n_restoration"), any_.alias("was_modified"))


@register("case_flags", f"WITH {UTTERANCES} SELECT id, length(text) > 300 AS long_row, bool_or(length(text) > 300) OVER (PARTITION BY conv_id) AS long_case FROM utt")
def case_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag of any row, given back to all rows of its case."""
    u = utterances(spark, sf_dir).select("conv_id", "id", (F.length("text") > 300).alias("long_row"))
    return u.select("id", "long_row", F.bool_or("long_row").over(Window.partitionBy("conv_id")).alias("long_case"))


@register("languages_per_source", """SELECT source, '[' || string_agg(DISTINCT '"' || lang || '"', ',' ORDER BY '"' || lang || '"') || ']' AS langs FROM documents WHERE lang IS NOT NULL GROUP BY 1""")
def languages_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted set as JSON."""
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return d.groupBy("source").agg(F.to_json(F.array_sort(F.collect_set("lang"))).alias("langs"))


@register("status_pairs", "SELECT a, b, count(*)::BIGINT AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1, 2")
def status_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one state follows another; null after the last."""
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("a"), nxt.alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@register(
    "label_coverage",
    """SELECT count(*)::BIGINT AS n_all, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_unlabelled, count(*) FILTER (WHERE d.doc_id IS NULL) AS n_dangling, count(*) FILTER (WHERE l.quality = 1 AND l.toxic = 1) AS n_both
FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id""",
)
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two sides cover each other."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"))
    x = d.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l"), F.col("d") == F.col("l"), "full")
    n = lambda c: F.count_if(c)
    return x.agg(F.count("*").alias("n_all"), n(F.col("l").isNull()).alias("n_unlabelled"), n(F.col("d").isNull()).alias("n_dangling"), n((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("n_both"))


@register(
    "method_comparison",
    """SELECT count(*) FILTER (WHERE a AND NOT b) AS lost, count(*) FILTER (WHERE b AND NOT a) AS gained, count(*) FILTER (WHERE a AND b) AS kept, round(100.0 * count(*) FILTER (WHERE b) / nullif(count(*), 0), 6)::DOUBLE AS pct
FROM (SELECT o_totalprice > 100000 AS a, o_orderstatus = 'F' AS b FROM orders)""",
)
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second selection loses, gains and keeps."""
    a, b = F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F"
    pct = F.round(F.lit(100.0) * F.count_if(b) / F.nullif(F.count("*"), F.lit(0)), 6)
    return table(spark, sf_dir, "orders").agg(F.count_if(a & ~b).alias("lost"), F.count_if(b & ~a).alias("gained"), F.count_if(a & b).alias("kept"), pct.alias("pct"))


@register(
    "priority_merge",
    """SELECT doc_id, quality AS value, 'primary' AS origin FROM labels UNION ALL
SELECT doc_id, n_chars::INT, 'secondary' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
)
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary rows only where the primary has none."""
    first = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("value"), F.lit("primary").alias("origin"))
    rest = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("int").alias("value"), F.lit("secondary").alias("origin"))
    return first.unionByName(rest.join(first.select("doc_id"), "doc_id", "left_anti"))


@register(
    "ancestors",
    f"""WITH {UTTERANCES} SELECT id, reply_to AS ancestor, 1 AS depth FROM utt WHERE reply_to IS NOT NULL UNION ALL
SELECT a.id, b.reply_to, 2 FROM utt a JOIN utt b ON b.id = a.reply_to WHERE b.reply_to IS NOT NULL UNION ALL
SELECT a.id, c.reply_to, 3 FROM utt a JOIN utt b ON b.id = a.reply_to JOIN utt c ON c.id = b.reply_to WHERE c.reply_to IS NOT NULL""",
)
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors up to depth 3, one row for each depth."""
    up = utterances(spark, sf_dir).where("reply_to IS NOT NULL").select("id", F.col("reply_to").alias("ancestor"))
    out = at = up.withColumn("depth", F.lit(1))
    for depth in (2, 3):
        step = up.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
        at = at.join(step, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"))
        out = out.unionByName(at)
    return out


@register(
    "dotted_ids",
    f"""WITH {UTTERANCES} SELECT id, coalesce(try_cast(split_part(id, '.', 1) AS BIGINT), 9223372036854775807) AS p1, coalesce(try_cast(nullif(split_part(id, '.', 2), '') AS BIGINT), 9223372036854775807) AS p2,
coalesce(try_cast(nullif(split_part(id, '.', 3), '') AS BIGINT), 9223372036854775807) AS p3, 'D' || lpad(conv_id::VARCHAR, 5, '0') AS label FROM utt""",
)
def dotted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three integers of an id, the greatest one where a part is missing, and a padded label."""
    part = lambda k: F.coalesce(F.split_part("id", F.lit("."), F.lit(k)).try_cast("long"), F.lit(2**63 - 1)).alias(f"p{k}")
    return utterances(spark, sf_dir).select("id", part(1), part(2), part(3), F.concat(F.lit("D"), F.lpad(F.col("conv_id").cast("string"), 5, "0")).alias("label"))


@register(
    "lost_words",
    f"""WITH {UTTERANCES}, w AS (SELECT id, reply_to, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM utt), n AS (SELECT id, reply_to, word, count(*) AS n FROM w GROUP BY ALL)
SELECT c.id, p.word, (p.n - coalesce(m.n, 0))::BIGINT AS n_lost FROM utt c JOIN n p ON p.id = c.reply_to LEFT JOIN n m ON m.id = c.id AND m.word = p.word WHERE p.n > coalesce(m.n, 0)""",
)
def lost_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the target of a reply has more often than the reply."""
    u = utterances(spark, sf_dir).select("id", "reply_to", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    child = utterances(spark, sf_dir).where("reply_to IS NOT NULL").select("id", "reply_to")
    there = u.select(F.col("id").alias("reply_to"), "word").join(child, "reply_to").select("id", "word", F.lit(1).alias("n"))
    both = there.unionByName(u.where("reply_to IS NOT NULL").select("id", "word", F.lit(-1).alias("n")))
    return both.groupBy("id", "word").agg(F.sum("n").alias("n_lost")).where("n_lost > 0")


@register(
    "allocation",
    """WITH s AS (SELECT lang, count(*) AS cap FROM documents GROUP BY 1), f AS (SELECT lang, cap, least(cap, least(20, 120 // count(*) OVER ())) AS base FROM s),
g AS (SELECT lang, cap, base, sum(base) OVER () AS used, sum(cap - base) OVER () AS room FROM f),
q AS (SELECT *, greatest(120 - used, 0) * (cap - base) // greatest(room, 1) AS whole, greatest(120 - used, 0) * (cap - base) % greatest(room, 1) AS part FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY part DESC, lang) AS k, greatest(120 - used, 0) - sum(whole) OVER () AS over FROM q)
SELECT lang, cap::BIGINT AS cap, least(cap, base + whole + CASE WHEN k <= over THEN 1 ELSE 0 END)::BIGINT AS n FROM r""",
)
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 places over strata: a floor of 20, or less where strata are many, the rest in proportion to what is left, by largest remainder.

    The windows run over one row per stratum.
    """
    s = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("cap"))
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("base", F.least("cap", F.least(F.lit(20).cast("long"), F.expr("120 div count(*) over (partition by 1)"))))
    s = s.withColumn("left_", F.greatest(120 - F.sum("base").over(every), F.lit(0).cast("long"))).withColumn("room", F.greatest(F.sum(F.col("cap") - F.col("base")).over(every), F.lit(1).cast("long")))
    s = s.withColumn("whole", F.expr("left_ * (cap - base) div room")).withColumn("part", F.expr("left_ * (cap - base) % room"))
    s = s.withColumn("k", F.row_number().over(every.orderBy(F.desc("part"), F.asc_nulls_last("lang")))).withColumn("over_", F.col("left_") - F.sum("whole").over(every))
    return s.select("lang", "cap", F.least("cap", F.col("base") + F.col("whole") + (F.col("k") <= F.col("over_")).cast("long")).alias("n"))
