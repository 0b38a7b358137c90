"""As-of joins, horizons, reverts and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rel
from ..sources import table
from .registry import register


@register(
    "asof_representation",
    """SELECT p.event_id, p.user_id, (SELECT v.event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS asof_view_id
FROM events p WHERE p.event_type = 'purchase'""",
)
def asof_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest view at or before each purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return rel.asof(left, right, "user_id", "ts", "ts", "view_id", ["view_id"]).select("event_id", "user_id", "asof_view_id")


@register(
    "horizon_outcomes",
    """WITH n AS (SELECT a.event_id, min(b.ts) AS nxt FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts > a.ts WHERE a.event_type = 'error' GROUP BY a.event_id),
lim AS (SELECT max(ts) AS last_ts FROM events)
SELECT a.event_id, h.h::BIGINT AS horizon_days, CASE WHEN n.nxt <= a.ts + to_days(h.h) THEN 'observed' WHEN a.ts + to_days(h.h) <= last_ts THEN 'absent' ELSE 'not_observable' END AS status
FROM events a JOIN n ON n.event_id = a.event_id CROSS JOIN lim CROSS JOIN (SELECT unnest([1, 3, 7]) AS h) h""",
)
def horizon_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase within h days after an error; unseen time is not absence."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    nxt = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p")).distinct()
    both = e.where("event_type = 'error'").select("user_id", "ts", "event_id").unionByName(nxt.select("user_id", F.col("p").alias("ts"), F.lit(None).cast("long").alias("event_id")))
    both = both.withColumn("p", F.when(F.col("event_id").isNull(), F.col("ts")))
    # at one time, purchases sort before errors, so rows that follow an error are strictly later
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_id").asc_nulls_first()).rowsBetween(1, Window.unboundedFollowing)
    x = both.withColumn("nxt", F.first("p", ignorenulls=True).over(w)).where("event_id IS NOT NULL")
    last = e.agg(F.max("ts").alias("last_ts"))
    x = x.join(F.broadcast(last)).withColumn("horizon_days", F.explode(F.array(*[F.lit(h).cast("long") for h in (1, 3, 7)])))  # one row
    end = F.expr("ts + make_dt_interval(CAST(horizon_days AS INT))")
    status = F.when(F.col("nxt") <= end, "observed").when(end <= F.col("last_ts"), "absent").otherwise("not_observable")
    return x.select("event_id", "horizon_days", status.alias("status"))


@register(
    "cutoff_membership",
    """WITH c AS (SELECT user_id, min(ts) AS cutoff FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.event_id, e.ts <= c.cutoff AS in_window, e.ts = c.cutoff AS at_cutoff FROM events e JOIN c ON c.user_id = e.user_id""",
)
def cutoff_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: rows up to a per-key cutoff."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id")
    x = e.withColumn("cutoff", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)).where("cutoff IS NOT NULL")
    return x.select("event_id", (F.col("ts") <= F.col("cutoff")).alias("in_window"), (F.col("ts") == F.col("cutoff")).alias("at_cutoff"))


@register(
    "leakage_class",
    """WITH c AS (SELECT user_id, min(ts) AS cutoff FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT CASE WHEN cutoff IS NULL THEN 'unknown' WHEN e.ts < cutoff THEN 'pre' WHEN e.ts = cutoff THEN 'concurrent' ELSE 'post' END AS leakage, count(*)::BIGINT AS n FROM events e LEFT JOIN c ON c.user_id = e.user_id GROUP BY 1""",
)
def leakage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's side of the cutoff."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    cutoff = F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id"))
    x = e.withColumn("cutoff", cutoff)
    kind = F.when(F.col("cutoff").isNull(), "unknown").when(F.col("ts") < F.col("cutoff"), "pre").when(F.col("ts") == F.col("cutoff"), "concurrent").otherwise("post")
    return x.groupBy(kind.alias("leakage")).agg(F.count("*").alias("n"))


@register(
    "window_coalesce",
    """WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM s)
SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*)::BIGINT AS n FROM g GROUP BY user_id, grp""",
)
def window_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation windows merged where gaps are at most six hours."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.expr("ts > prev + INTERVAL 6 HOUR")
    x = e.withColumn("prev", F.lag("ts").over(w)).withColumn("brk", F.when(F.col("prev").isNull() | gap, 1).otherwise(0))
    x = x.withColumn("grp", F.sum("brk").over(w))
    return x.groupBy("user_id", "grp").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("grp")


@register(
    "identity_reverts",
    """WITH s AS (SELECT user_id, event_id, event_type AS sha1, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IS NOT NULL),
l AS (SELECT *, lag(i) OVER (PARTITION BY user_id, sha1 ORDER BY i) AS prev FROM s)
SELECT event_id, user_id, (i - prev - 1)::BIGINT AS n_between FROM l WHERE i - prev > 1""",
)
def identity_reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision that restores an earlier state with other states between, null ones left out; rows between have other states by construction of the lag."""
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL")
    x = e.select("user_id", "event_id", F.col("event_type").alias("sha1"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"))
    x = x.withColumn("prev", F.lag("i").over(Window.partitionBy("user_id", "sha1").orderBy("i")))
    return x.where("i - prev > 1").select("event_id", "user_id", (F.col("i") - F.col("prev") - 1).cast("long").alias("n_between"))


@register(
    "consecutive_merge_runs",
    """WITH s AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*)::BIGINT AS n, min(event_id) AS first_id FROM g GROUP BY user_id, run""",
)
def consecutive_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive rows of one kind become one."""
    x = rel.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return x.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@register("case_end", "SELECT user_id, max(ts) AS end_ts, max(ts) FILTER (event_type <> 'error') AS last_clean_ts FROM events GROUP BY user_id")
def case_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest time of a case."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("end_ts"), F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_clean_ts"))


@register(
    "full_event_timeline",
    """SELECT 'event:' || event_id AS uid, 'event' AS kind, event_type AS type, ts AS at FROM events
UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderstatus, o_orderdate FROM orders ORDER BY "at" NULLS LAST, kind, uid""",
)
def full_event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and orders on one timeline, untimed ones last."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    a = e.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("uid"), F.lit("event").alias("kind"), F.col("event_type").alias("type"), F.col("ts").alias("at"))
    b = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("uid"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("type"), F.col("o_orderdate").alias("at"))
    return a.unionByName(b).orderBy(F.col("at").asc_nulls_last(), "kind", "uid")


@register(
    "adjacent_inversions",
    "WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) SELECT user_id, count(*)::BIGINT AS n_inversions FROM l WHERE ts < prev GROUP BY user_id",
)
def adjacent_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in id order that run back in time."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").withColumn("prev", F.lag("ts").over(w)).where("ts < prev").groupBy("user_id").agg(F.count("*").alias("n_inversions"))


@register("tied_groups", "SELECT date_trunc('minute', ts) AS minute, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY 1 HAVING count(*) > 1")
def tied_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a time."""
    e = table(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return e.groupBy("minute").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users")).where("n > 1")


@register(
    "session_windows",
    """WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 1 DAY THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM s)
SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 1 DAY AS end_ts, count(*)::BIGINT AS n FROM g GROUP BY user_id, grp""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming extension, batch form: sessions with a gap of one day."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"), "n")


@register("tumbling_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming extension, batch form: daily totals."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
