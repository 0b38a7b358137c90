"""Counts, samples, estimates, selection policies and data-quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rel
from ..sources import table
from .registry import register


@register("counts_by_type", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@register("distinct_counts", "SELECT lang, count(DISTINCT source)::BIGINT AS n_sources, count(DISTINCT sha256(text))::BIGINT AS n_texts FROM documents GROUP BY lang")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents by hash, so texts do not shuffle."""
    d = table(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("h"))
    return d.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("h").alias("n_texts"))


@register("conditional_counts", "SELECT user_id, count(*) FILTER (event_type = 'error')::BIGINT AS n_error, count(*) FILTER (value > 50)::BIGINT AS n_large, round(avg(value) FILTER (event_type = 'purchase'), 6) AS mean_purchase FROM events GROUP BY user_id")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D06."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_error"), F.count_if(F.col("value") > 50).alias("n_large"), F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("mean_purchase"))


@register("cross_label", "SELECT sha256(d.text) AS h, count(DISTINCT l.quality)::BIGINT AS n_labels, min(l.quality) AS lo, max(l.quality) AS hi FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1 HAVING count(DISTINCT l.quality) > 1")
def cross_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal content with contradicting labels."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(table(spark, sf_dir, "labels"), "doc_id")
    return x.groupBy("h").agg(F.count_distinct("quality").alias("n_labels"), F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("n_labels > 1")


@register("empty_text_classes", "SELECT role, CASE WHEN text IS NULL THEN 'null' WHEN trim(text) = '' THEN 'blank' ELSE 'text' END AS text_class, count(*)::BIGINT AS n FROM conversations GROUP BY ALL")
def empty_text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11."""
    c = F.when(F.col("text").isNull(), "null").when(F.trim("text") == "", "blank").otherwise("text")
    return table(spark, sf_dir, "conversations").groupBy("role", c.alias("text_class")).agg(F.count("*").alias("n"))


@register("common_support", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') >= '1994-' AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1997-'")
def common_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose time, as text, lies in a range of years; compared as text, so the lower bound needs no month."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created"))
    return o.where((F.col("created") >= "1994-") & (F.col("created") < "1997-"))


@register("left_semi_selected", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def left_semi_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@register("left_anti_missing", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def left_anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@register("null_safe_diff", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS DISTINCT FROM CASE WHEN d.n_chars > 500 THEN 1 END")
def null_safe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B09."""
    x = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return x.where(~F.col("quality").eqNullSafe(F.when(F.col("n_chars") > 500, 1))).select("doc_id")


@register(
    "stratified_sample",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('17:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of each stratum with the smallest seeded hash.  The rank filter bounds each stratum before the final sort (group limit)."""
    h = F.sha2(F.concat(F.lit("17:"), F.col("doc_id").cast("string")), 256)
    d = table(spark, sf_dir, "documents").select("source", "doc_id", h.alias("h"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id"))).where("r <= 5").select("source", "doc_id")


@register(
    "ht_estimate",
    """WITH x AS (SELECT d.source, count(*) AS big, count(l.doc_id) AS small, avg(l.toxic) AS mean, var_samp(l.toxic) AS s2 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source),
y AS (SELECT sum(big * mean) AS t, sqrt(sum(CASE WHEN small > 1 THEN big * big * (1 - small / big) * s2 / small ELSE 0 END)) AS e, sum(big)::BIGINT AS population FROM x WHERE small > 0)
SELECT round(greatest(least(t, population), 0), 6) AS total, round(e, 6) AS se, round(greatest(least(t - 1.96 * e, population), 0), 6) AS ci95_low, round(greatest(least(t + 1.96 * e, population), 0), 6) AS ci95_high, population FROM y""",
)
def ht_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified total, its standard error with finite-population correction and its 95 % interval, within the population."""
    x = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    x = x.groupBy("source").agg(F.count("*").alias("big"), F.count("toxic").alias("small"), F.avg("toxic").alias("mean"), F.var_samp("toxic").alias("s2")).where("small > 0")
    var = F.when(F.col("small") > 1, F.expr("big * big * (1 - small / big) * s2 / small")).otherwise(0.0)
    y = x.agg(F.sum(F.col("big") * F.col("mean")).alias("t"), F.sqrt(F.sum(var)).alias("e"), F.sum("big").alias("population"))
    inside = lambda c: F.round(F.greatest(F.least(c, F.col("population")), F.lit(0.0)), 6)
    t, e = F.col("t"), F.col("e")
    return y.select(inside(t).alias("total"), F.round(e, 6).alias("se"), inside(t - 1.96 * e).alias("ci95_low"), inside(t + 1.96 * e).alias("ci95_high"), "population")


@register(
    "quantiles",
    "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(median(value), 6) AS p50, round(quantile_disc(value, 0.9), 6) AS p90, max(value) AS top FROM events GROUP BY event_type",
)
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles, p05 and p50 interpolated, p90 by nearest rank; no group is held as a whole."""
    n = F.col("n")
    at = lambda q: (n - 1) * F.lit(q)
    low, up = lambda q: F.floor(at(q)), lambda q: F.ceil(at(q))
    ranks = {"a5": low(0.05), "b5": up(0.05), "a50": low(0.5), "b50": up(0.5), "p90": F.ceil(0.9 * n) - 1}
    x = rel.ranked_values(table(spark, sf_dir, "events").where("value IS NOT NULL"), "event_type", "value", ranks)
    between = lambda a, b, q: F.round(F.col(a) + (F.col(b) - F.col(a)) * (at(q) - F.floor(at(q))), 6)
    return x.select("event_type", between("a5", "b5", 0.05).alias("p05"), between("a50", "b50", 0.5).alias("p50"), F.round("p90", 6).alias("p90"), F.col("hi").alias("top"))


@register(
    "agreement_metrics",
    "SELECT count(*)::BIGINT AS n, sum(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END)::BIGINT AS n_agree, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 9) AS share, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS both_one FROM labels",
)
def agreement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D26."""
    agree = F.col("quality") == 1 - F.col("toxic")
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(agree).alias("n_agree"), F.round(F.avg(F.when(agree, 1.0).otherwise(0.0)), 9).alias("share"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("both_one"))


@register(
    "recovery_funnel",
    "SELECT count(*)::BIGINT AS n_all, count(l.doc_id)::BIGINT AS n_labelled, count(*) FILTER (l.quality = 1)::BIGINT AS n_good, count(*) FILTER (l.quality = 1 AND l.toxic = 0)::BIGINT AS n_final, round(count(*) FILTER (l.quality = 1 AND l.toxic = 0) / count(*), 9) AS coverage FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def recovery_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D28."""
    x = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    final = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return x.agg(F.count("*").alias("n_all"), F.count("has").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(final).alias("n_final"), F.round(F.count_if(final) / F.count("*"), 9).alias("coverage"))


_GATES = {
    "DUP003_unique_ids": ("documents", "count(*) - count(DISTINCT doc_id)"),
    "LAB001_known_documents": ("labels l LEFT JOIN (SELECT doc_id AS known FROM documents) k ON k.known = l.doc_id", "sum(CASE WHEN known IS NULL THEN 1 ELSE 0 END)"),
    "LAB002_binary_labels": ("labels", "sum(CASE WHEN quality IN (0, 1) AND toxic IN (0, 1) THEN 0 ELSE 1 END)"),
    "TXT001_text_present": ("documents", "sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END)"),
    "STR005_turns_from_zero": ("(SELECT conv_id, min(turn) AS t, max(turn) AS u, count(*) AS n FROM conversations GROUP BY conv_id) c", "sum(CASE WHEN t = 0 AND u = n - 1 THEN 0 ELSE 1 END)"),
}


@register("gate_report", " UNION ALL ".join(f"SELECT '{g}' AS gate, CAST({e} AS BIGINT) AS failures, CASE WHEN {e} = 0 THEN 'pass' ELSE 'fail' END AS status FROM {t}" for g, (t, e) in _GATES.items()))
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate's failures, as lazy aggregates."""
    docs, labels, conv = (table(spark, sf_dir, t) for t in ("documents", "labels", "conversations"))
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    cases = conv.groupBy("conv_id").agg(F.min("turn").alias("t"), F.max("turn").alias("u"), F.count("*").alias("n"))
    found = {
        "DUP003_unique_ids": docs.agg((F.count("*") - F.count_distinct("doc_id")).alias("failures")),
        "LAB001_known_documents": labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("failures")),
        "LAB002_binary_labels": labels.agg(bad(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)).alias("failures")),
        "TXT001_text_present": docs.agg(bad(F.col("text").isNotNull()).alias("failures")),
        "STR005_turns_from_zero": cases.agg(bad((F.col("t") == 0) & (F.col("u") == F.col("n") - 1)).alias("failures")),
    }
    out = None
    for gate, df in found.items():
        one = df.select(F.lit(gate).alias("gate"), "failures", F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


@register("provenance_check", "SELECT b.item_id, count(d.doc_id)::BIGINT AS n_matches, CASE count(d.doc_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'exact' ELSE 'duplicate' END AS status FROM benchmark b LEFT JOIN documents d ON sha256(d.text) = sha256(b.text) GROUP BY b.item_id")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content found exactly once, several times or never, by hash."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return b.join(d, "h", "left").select("item_id", n.alias("n_matches"), F.when(n == 0, "missing").when(n == 1, "exact").otherwise("duplicate").alias("status"))


@register(
    "shipped_revenue",
    "SELECT n.n_name, r.r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n_lines FROM lineitem JOIN supplier s ON s.s_suppkey = l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ALL",
)
def shipped_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of equi-joins, small sides first."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_lines"))
