"""Composite tables: outcomes, merges, histories, exports, audits of a source, and small evidence operators."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as kernels
from ..operators import rel
from ..sources import UTTERANCES, table, utterances
from .cases import pick, pick_sql
from .registry import register

# Outcome definitions and their horizons in days (null: none).
HORIZONS = (None, 7, 30, 90)
VENUES = ("mediation", "arbitration", "request_for_comment", "third_opinion", "noticeboard", "deletion_review", "move_review", "administrators")
_CLOSED = ["failed", "resolved", "withdrawn", "general", "stale", None]

_OUTCOMES = f"""e AS (SELECT * FROM events), c AS (SELECT user_id, user_id % 2 = 0 AS escalated, min(ts) FILTER (event_type = 'purchase') AS idx, min(ts) FILTER (event_type = 'signup') AS filed, min(ts) FILTER (event_type = 'error') AS removed, {pick_sql('user_id', _CLOSED)} AS closed FROM e GROUP BY user_id),
lim AS (SELECT max(ts) AS seen FROM e), h AS (SELECT unnest([NULL, 7, 30, 90]) AS h)"""


@register(
    "outcome_rows",
    f"""WITH {_OUTCOMES}, filing AS (SELECT user_id, 'formal_filing' AS definition, h AS horizon, CASE WHEN NOT escalated THEN 'not_observable' WHEN filed IS NULL OR idx IS NULL THEN 'unknown' WHEN filed > idx THEN 'observed' ELSE 'observed_prevalent_or_concurrent' END AS observation,
CASE WHEN escalated AND filed > idx THEN CASE WHEN h IS NULL OR filed <= idx + to_days(h) THEN 'true' ELSE 'false' END END AS value FROM c, h),
venues AS (SELECT user_id, v AS definition, h AS horizon, 'not_observable' AS observation, NULL::VARCHAR AS value FROM c, h, (SELECT unnest([{', '.join(f"'{v}'" for v in VENUES)}]) AS v)),
tags AS (SELECT user_id, 'tag_clearance' AS definition, h AS horizon, CASE WHEN escalated THEN 'not_observable' ELSE 'unknown' END AS observation, CASE WHEN NOT escalated AND removed IS NOT NULL THEN CASE WHEN removed > idx THEN 'future' ELSE 'prevalent' END END AS value FROM c, h WHERE h IS NOT NULL),
reverts AS (SELECT c.user_id, 'revert_stability' AS definition, h AS horizon, CASE WHEN idx + to_days(h) <= seen THEN 'observed' ELSE 'not_observable' END AS observation, CASE WHEN idx + to_days(h) <= seen THEN (SELECT count(*) FROM e WHERE e.user_id = c.user_id AND e.event_type = 'view' AND e.ts > idx AND e.ts <= idx + to_days(h))::VARCHAR END AS value FROM c, h, lim WHERE h IS NOT NULL),
closure AS (SELECT user_id, 'closure' AS definition, NULL AS horizon, CASE WHEN escalated THEN 'observed_category_time_unknown' ELSE 'not_observable' END AS observation, CASE WHEN escalated THEN CASE closed WHEN 'failed' THEN 'failure' WHEN 'resolved' THEN 'success' WHEN 'withdrawn' THEN 'withdrawn' WHEN 'general' THEN 'general' WHEN 'stale' THEN 'other' ELSE 'unknown' END END AS value FROM c)
SELECT user_id, definition, horizon::INT AS horizon, observation, value, observation IN ('unknown', 'not_observable') AS censored FROM (SELECT * FROM filing UNION ALL SELECT * FROM venues UNION ALL SELECT * FROM tags UNION ALL SELECT * FROM reverts UNION ALL SELECT * FROM closure)""",
)
def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """43 rows a case, a row for each definition and horizon; what was not seen is censored, not negative.

    Reverts within all horizons are counted in one pass; only case rows are multiplied.
    """
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    c = e.groupBy("user_id").agg(first("purchase").alias("idx"), first("signup").alias("filed"), first("error").alias("removed"))
    after = e.where("event_type = 'view'").join(c.select("user_id", "idx"), "user_id")
    within = lambda d: F.count_if((F.col("ts") > F.col("idx")) & (F.col("ts") <= F.col("idx") + F.expr(f"INTERVAL {d} DAY"))).alias(f"n{d}")
    counts = after.groupBy("user_id").agg(*[within(d) for d in HORIZONS if d])
    c = c.join(counts, "user_id", "left").withColumns({"escalated": F.col("user_id") % 2 == 0, "closed": pick("user_id", _CLOSED)})
    c = c.join(F.broadcast(e.agg(F.max("ts").alias("seen"))))  # one row
    esc, idx, filed = F.col("escalated"), F.col("idx"), F.col("filed")
    end = lambda d: idx + F.expr(f"INTERVAL {d} DAY")

    def row(definition: str, horizon: int | None, observation, value):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(definition).alias("definition"), F.lit(horizon).cast("int").alias("horizon"), observation.alias("observation"), (none if value is None else value.cast("string")).alias("value"))

    seen = F.when(~esc, "not_observable").when(filed.isNull() | idx.isNull(), "unknown").when(filed > idx, "observed").otherwise("observed_prevalent_or_concurrent")
    future = esc & (filed > idx)
    rows = [row("formal_filing", h, seen, F.when(future, F.lit("true") if h is None else F.when(filed <= end(h), "true").otherwise("false"))) for h in HORIZONS]
    rows += [row(v, h, F.lit("not_observable"), None) for v in VENUES for h in HORIZONS]
    cleared = F.when(~esc & F.col("removed").isNotNull(), F.when(F.col("removed") > idx, "future").otherwise("prevalent"))
    for h in HORIZONS[1:]:
        covered = end(h) <= F.col("seen")
        rows.append(row("tag_clearance", h, F.when(esc, "not_observable").otherwise("unknown"), cleared))
        rows.append(row("revert_stability", h, F.when(covered, "observed").otherwise("not_observable"), F.when(covered, F.coalesce(F.col(f"n{h}"), F.lit(0)))))
    rows.append(row("closure", None, F.when(esc, "observed_category_time_unknown").otherwise("not_observable"), F.when(esc, C.closure(F.col("closed")))))
    x = c.select("user_id", F.explode(F.array(*rows)).alias("r")).select("user_id", "r.*")
    return x.withColumn("censored", F.col("observation").isin("unknown", "not_observable"))


@register(
    "annual_merge",
    """WITH x AS (SELECT doc_id % 97 AS id, sha256(text) AS h, 2000 + doc_id % 7 AS year, doc_id AS line FROM documents), k AS (SELECT id, h, min(struct_pack(a := year, b := line)) AS f FROM x GROUP BY ALL), y AS (SELECT id, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS years FROM x GROUP BY id)
SELECT k.id, k.h, k.f.a::BIGINT AS year, k.f.b::BIGINT AS line, y.years, count(*) OVER (PARTITION BY k.id) > 1 AS conflict FROM k JOIN y ON y.id = k.id""",
)
def annual_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files merged: equal records once, from the first year and line; different ones of an id are kept as a conflict."""
    i = F.col("doc_id")
    x = table(spark, sf_dir, "documents").select((i % 97).alias("id"), F.sha2("text", 256).alias("h"), (2000 + i % 7).alias("year"), i.alias("line"))
    k = x.groupBy("id", "h").agg(F.min(F.struct("year", "line")).alias("f"))
    y = x.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ",").alias("years"))
    return k.join(y, "id").select("id", "h", "f.year", "f.line", "years", (F.count("*").over(Window.partitionBy("id")) > 1).alias("conflict"))


@register(
    "article_histories",
    """WITH w AS (SELECT user_id, min(ts) AS lo, max(ts) + INTERVAL 1 DAY AS hi FROM events WHERE event_type = 'error' GROUP BY 1), r AS (SELECT e.user_id, e.event_id, e.event_type, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) - 1 AS i FROM events e JOIN w ON w.user_id = e.user_id AND e.ts >= lo AND e.ts <= hi)
SELECT user_id, event_id, i::BIGINT AS place, i = 0 AS is_first, event_type = 'purchase' AS has_evidence FROM r""",
)
def article_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page the window that its cases ask for, its revisions in it, and their places."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    w = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("lo"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("hi"))
    r = e.join(w, "user_id").where("ts >= lo AND ts <= hi").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    return r.select("user_id", "event_id", "place", (F.col("place") == 0).alias("is_first"), (F.col("event_type") == "purchase").alias("has_evidence"))


@register(
    "hydrated_revisions",
    """WITH want AS (SELECT DISTINCT doc_id FROM labels UNION SELECT -1 - doc_id FROM labels WHERE quality = 0), old AS (SELECT doc_id, source AS v FROM documents), new AS (SELECT doc_id, lang AS v FROM documents WHERE lang IS NOT NULL)
SELECT w.doc_id, coalesce(n.v, o.v) AS value, CASE WHEN n.doc_id IS NOT NULL THEN 'fetched' WHEN o.doc_id IS NOT NULL THEN 'cached' ELSE 'missing' END AS state FROM want w LEFT JOIN old o ON o.doc_id = w.doc_id LEFT JOIN new n ON n.doc_id = w.doc_id""",
)
def hydrated_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisions that are asked for, from a newer observation, else the cache, else said to be missing."""
    labels = table(spark, sf_dir, "labels")
    want = labels.select("doc_id").unionByName(labels.where("quality = 0").select((-1 - F.col("doc_id")).alias("doc_id"))).distinct()
    d = table(spark, sf_dir, "documents")
    old, new = d.select("doc_id", F.col("source").alias("o"), F.lit(True).alias("has_o")), d.where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("n"), F.lit(True).alias("has_n"))
    x = want.join(old, "doc_id", "left").join(new, "doc_id", "left")
    return x.select("doc_id", F.coalesce("n", "o").alias("value"), F.when(F.col("has_n"), "fetched").when(F.col("has_o"), "cached").otherwise("missing").alias("state"))


@register(
    "source_audit",
    f"""WITH {UTTERANCES}, t AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) > 1), x AS (SELECT d.source, count(DISTINCT l.toxic) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
SELECT 'rows:' || coalesce(role, '') AS metric, count(*)::BIGINT AS n FROM utt GROUP BY role UNION ALL SELECT 'cases', count(DISTINCT conv_id)::BIGINT FROM utt UNION ALL SELECT 'replies', count(reply_to)::BIGINT FROM utt UNION ALL SELECT 'tied_entities', count(DISTINCT user_id)::BIGINT FROM t
UNION ALL SELECT 'cross_label_sources', count(*)::BIGINT FROM x WHERE n > 1 UNION ALL SELECT 'duplicate_groups', count(*)::BIGINT FROM (SELECT 1 FROM documents GROUP BY sha256(text) HAVING count(*) > 1)""",
)
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audits of a source as one long report."""
    u, e, d = utterances(spark, sf_dir), table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    one = lambda name, df, n: df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("metric"), "n")
    ties = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("c")).where("c > 1")
    mixed = d.select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count_distinct("toxic").alias("c")).where("c > 1")
    repeated = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c")).where("c > 1")
    parts = [
        u.groupBy("role").agg(F.count("*").alias("n")).select(F.concat(F.lit("rows:"), F.coalesce("role", F.lit(""))).alias("metric"), "n"),
        one("cases", u, F.count_distinct("conv_id")), one("replies", u, F.count("reply_to")), one("tied_entities", ties, F.count_distinct("user_id")),
        one("cross_label_sources", mixed, F.count("*")), one("duplicate_groups", repeated, F.count("*")),
    ]
    return reduce(DataFrame.unionByName, parts)


@register(
    "eligible_views",
    """WITH x AS (SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'predictor' AS view, doc_id FROM x WHERE quality = 1 UNION ALL SELECT 'both', doc_id FROM x WHERE quality = 1 AND toxic = 0 UNION ALL SELECT 'side:en', doc_id FROM x WHERE lang = 'en' UNION ALL SELECT 'substantive', doc_id FROM x WHERE source IS NOT NULL AND doc_id IS NOT NULL""",
)
def eligible_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered views of an export, a row for each view that a row is in, in one pass."""
    x = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = {"predictor": F.col("quality") == 1, "both": (F.col("quality") == 1) & (F.col("toxic") == 0), "side:en": F.col("lang") == "en", "substantive": F.col("source").isNotNull() & F.col("doc_id").isNotNull()}
    return x.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("view"), "doc_id")


@register("pilot_rows", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25)")
def pilot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded pilot, which is what the operator is for: the first 25 rows by id."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(25)


_SPEAKERS = ['"Ann"', '{"id": "Bob", "x": 1}', "null", '{"name": "Cy"}', "7", '{"id": null}', None]
_TIMES = ['{"7": {"status": "found", "timestamp": "2012-01-02T03:04:05Z"}, "8": {"status": "missing"}}', '{"9": {"status": "found", "timestamp": "soon"}}', "{}", None, '{"10": {"status": "found", "timestamp": "2013-05-06T00:00:00Z"}}']


@register(
    "speaker_fields",
    f"""WITH d AS (SELECT doc_id, {pick_sql('doc_id', _SPEAKERS)} AS s FROM documents) SELECT doc_id, CASE WHEN s LIKE '"%' THEN s->>'$' WHEN s LIKE '{{%' THEN s->>'$.id' END AS speaker FROM d""",
)
def speaker_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speaker that is a text, or the id of an object; anything else is null."""
    s = F.col("s")
    text = F.when(s.startswith('"'), F.element_at(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), 1))
    return table(spark, sf_dir, "documents").select("doc_id", pick("doc_id", _SPEAKERS).alias("s")).select("doc_id", F.coalesce(text, F.when(s.startswith("{"), F.get_json_object("s", "$.id"))).alias("speaker"))


@register(
    "timestamp_evidence",
    f"""WITH d AS (SELECT doc_id, {pick_sql('doc_id', _TIMES)} AS t FROM documents), k AS (SELECT doc_id, t, unnest(json_keys(t)) AS k FROM d WHERE t IS NOT NULL), f AS (SELECT doc_id, k::BIGINT AS revision, try_strptime(t->k->>'$.timestamp', '%Y-%m-%dT%H:%M:%SZ') AS t0, t->k->>'$.status' AS status FROM k)
SELECT doc_id, revision, epoch(t0)::BIGINT AS seconds FROM f WHERE status = 'found' AND t0 IS NOT NULL""",
)
def timestamp_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON map of revisions, of which those that were found and have a time count."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.from_json(pick("doc_id", _TIMES), "map<string,struct<status:string,timestamp:string>>").alias("m"))
    x = d.select("doc_id", F.explode("m").alias("k", "v")).where("v.status = 'found'")
    return x.select("doc_id", F.col("k").cast("long").alias("revision"), F.unix_timestamp(C.instant(F.col("v.timestamp"))).alias("seconds")).where("seconds IS NOT NULL")


_OPS = "o AS (SELECT l_orderkey AS k, list(struct_pack(kind := CASE l_linenumber % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'equal' ELSE 'delete' END, a := (l_linenumber * 3)::INT, b := (l_linenumber * 3 + l_suppkey % 5)::INT) ORDER BY l_linenumber) AS ops FROM lineitem GROUP BY 1)"


@register(
    "operation_histograms",
    f"WITH {_OPS} SELECT k, len(list_filter(ops, lambda x: x.kind = 'insert'))::BIGINT AS n_insert, len(list_filter(ops, lambda x: x.kind = 'equal'))::BIGINT AS n_equal, len(list_filter(ops, lambda x: x.kind = 'delete'))::BIGINT AS n_delete, len(list_filter(ops, lambda x: NOT (x.a >= 3 AND x.b <= 18))) = 0 AS contained, len(list_filter(ops, lambda x: x.b <= x.a)) = 0 AS positive FROM o",
)
def operation_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a row's operations, whether a candidate holds all their spans, and whether all are positive."""
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "insert").when(n % 3 == 1, "equal").otherwise("delete")
    op = F.struct(kind.alias("kind"), (n * 3).cast("int").alias("a"), (n * 3 + F.col("l_suppkey") % 5).cast("int").alias("b"))
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(op).alias("ops"))
    count = lambda name: F.size(F.filter("ops", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    inside = F.forall("ops", lambda x: (x["a"] >= 3) & (x["b"] <= 18))
    return o.select("k", count("insert"), count("equal"), count("delete"), inside.alias("contained"), F.forall("ops", lambda x: x["b"] > x["a"]).alias("positive"))


@register(
    "competing_candidates",
    f"WITH {UTTERANCES}, c AS (SELECT id, unnest([conv_id::VARCHAR || '.' || (turn - 2)::VARCHAR, conv_id::VARCHAR || '.' || (turn + 2)::VARCHAR]) AS other FROM utt) SELECT c.id, string_agg(u.id || ':' || u.role, ',' ORDER BY u.id) AS others FROM c JOIN utt u ON u.id = c.other GROUP BY c.id",
)
def competing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a list looked up, and what was found gathered in order."""
    u = utterances(spark, sf_dir).select("id", "conv_id", "turn", "role")
    other = lambda d: F.concat_ws(".", F.col("conv_id").cast("string"), (F.col("turn") + d).cast("string"))
    c = u.select(F.col("id").alias("of"), F.explode(F.array(other(-2), other(2))).alias("id"))
    found = c.join(u.select("id", "role"), "id").groupBy("of").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "role"))), ",").alias("others"))
    return found.withColumnRenamed("of", "id")


@register(
    "annotation_rewrite",
    f"""WITH {UTTERANCES}, a AS (SELECT id, text, role, CASE WHEN turn % 4 = 0 THEN 'recovered:raw' ELSE 'source' END AS origin, turn % 3 = 0 AS by_b, turn % 6 <> 0 AS accepted FROM utt)
SELECT id, role, CASE WHEN by_b AND accepted THEN 'B ' || id WHEN origin LIKE 'recovered%' THEN NULL ELSE text END AS text, CASE WHEN by_b AND accepted THEN 'method_b' WHEN origin LIKE 'recovered%' THEN 'fallback' ELSE origin END AS origin FROM a""",
)
def annotation_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new export whose texts change only where Method B was selected and accepted, and which falls back where the old one was itself recovered."""
    turn = F.col("turn")
    a = utterances(spark, sf_dir).select("id", "text", "role", F.when(turn % 4 == 0, "recovered:raw").otherwise("source").alias("origin"), ((turn % 3 == 0) & (turn % 6 != 0)).alias("take"))
    was = F.col("origin").startswith("recovered")
    return a.select("id", "role", F.when(F.col("take"), F.concat(F.lit("B "), "id")).when(~was, F.col("text")).alias("text"), F.when(F.col("take"), "method_b").when(was, "fallback").otherwise(F.col("origin")).alias("origin"))


_QUOTAS = {"en": 18, "fr": 18, "de": 14}


@register(
    "calibration_controls",
    "WITH x AS (SELECT doc_id, lang, sha256('cal:' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS k FROM x), q AS (SELECT doc_id, h, k <= CASE lang WHEN 'en' THEN 18 WHEN 'fr' THEN 18 WHEN 'de' THEN 14 ELSE 0 END AS quota FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY quota ORDER BY h, doc_id) AS j, count(*) FILTER (quota) OVER () AS n FROM q) SELECT doc_id, CASE WHEN quota THEN 'quota' ELSE 'fill' END AS why FROM f WHERE quota OR j <= 60 - n",
)
def calibration_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 controls: quotas of three classes by hash, and the rest filled by hash, whatever the class."""
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.concat(F.lit("cal:"), F.col("doc_id").cast("string")), 256).alias("h"))
    r = x.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    most = reduce(lambda c, q: c.when(F.col("lang") == q[0], q[1]), list(_QUOTAS.items())[1:], F.when(F.col("lang") == "en", _QUOTAS["en"])).otherwise(0)
    chosen = r.where(F.col("k") <= most).select("doc_id", "h")
    fill = x.join(chosen.select("doc_id"), "doc_id", "left_anti").orderBy("h", "doc_id").limit(60).select("doc_id", "h")
    both = chosen.select("doc_id", "h", F.lit("quota").alias("why")).unionByName(fill.select("doc_id", "h", F.lit("fill").alias("why")))
    w = Window.orderBy(F.desc("why"), "h", "doc_id")  # at most 110 rows
    return both.withColumn("j", F.row_number().over(w)).where("j <= 60").select("doc_id", "why")


_LABELS = {"recoverability": ["deterministic_rule_possible", "needs_model", "not_recoverable", "maybe", None], "confidence": ["high", "medium", "low", "sure"], "error": ["none", "wrong", "overwide", "", None, "underwide"]}


@register(
    "label_validation",
    "WITH d AS (SELECT doc_id, " + ", ".join(f"{pick_sql('doc_id', v)} AS {k}" for k, v in _LABELS.items()) + """ FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN recoverability IS NULL THEN 'recoverability_missing' WHEN recoverability = 'maybe' THEN 'recoverability_unknown' END, CASE WHEN confidence = 'sure' THEN 'confidence_unknown' END, CASE WHEN recoverability = 'deterministic_rule_possible' AND error IN ('wrong', 'overwide', 'underwide') THEN 'rule_contradicts_error' END], lambda x: x IS NOT NULL), ',') AS problems FROM d""",
)
def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reviewer's label keeps to its lists and to itself, with every problem."""
    d = table(spark, sf_dir, "documents").select("doc_id", *[pick("doc_id", v).alias(k) for k, v in _LABELS.items()])
    r = F.col("recoverability")
    rules = [(r.isNull(), "recoverability_missing"), (r == "maybe", "recoverability_unknown"), (F.col("confidence") == "sure", "confidence_unknown"), ((r == "deterministic_rule_possible") & F.col("error").isin("wrong", "overwide", "underwide"), "rule_contradicts_error")]
    return d.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])), ",").alias("problems"))


_CORE = f"""{UTTERANCES}, o AS (SELECT conv_id, id, role, turn, reply_to, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM utt)"""


@register(
    "core_tables",
    f"""WITH {_CORE} SELECT 'conversation' AS entity, conv_id::VARCHAR AS key, count(*)::BIGINT AS n, NULL::VARCHAR AS of FROM o GROUP BY conv_id UNION ALL SELECT 'utterance', id, place::BIGINT, conv_id::VARCHAR FROM o UNION ALL SELECT 'reply_edge', id, 1, reply_to FROM o WHERE reply_to IS NOT NULL
UNION ALL SELECT 'author', conv_id::VARCHAR || '/' || role, count(*)::BIGINT, conv_id::VARCHAR FROM o GROUP BY conv_id, role UNION ALL SELECT 'representation', id, length(text)::BIGINT, sha256(text) FROM o WHERE text IS NOT NULL UNION ALL SELECT 'alias', id, 1, conv_id::VARCHAR FROM o""",
)
def core_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M01, M04, M09 in part, C08, E05: the tables of a corpus from its utterances: conversations, utterances in order, edges, authors, texts, aliases; one long table."""
    u = utterances(spark, sf_dir).withColumn("c", F.col("conv_id").cast("string"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    row = lambda df, entity, key, n, of: df.select(F.lit(entity).alias("entity"), key.alias("key"), n.alias("n"), of.cast("string").alias("of"))
    one, c = F.lit(1).cast("long"), F.col("c")
    parts = [
        row(u.groupBy("c").agg(F.count("*").alias("k")), "conversation", c, F.col("k"), F.lit(None)),
        row(u, "utterance", F.col("id"), place, c),
        row(u.where("reply_to IS NOT NULL"), "reply_edge", F.col("id"), one, F.col("reply_to")),
        row(u.groupBy("c", "role").agg(F.count("*").alias("k")), "author", F.concat_ws("/", "c", "role"), F.col("k"), c),
        row(u.where("text IS NOT NULL"), "representation", F.col("id"), F.length("text").cast("long"), F.sha2("text", 256)),
        row(u, "alias", F.col("id"), one, c),
    ]
    return reduce(DataFrame.unionByName, parts)


@register("folded_texts")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: compatibility form without case, by Arrow batches; tested against Python's own functions."""

    @F.pandas_udf("string")
    def folded(t: pd.Series) -> pd.Series:
        return t.map(kernels.folded, na_action="ignore")

    return table(spark, sf_dir, "documents").select("doc_id", folded("text").alias("text"))


@register(
    "history_hashes",
    "WITH RECURSIVE g AS (SELECT doc_id AS node, CASE WHEN doc_id % 5 <> 0 THEN doc_id - 1 END AS parent, sha256(coalesce(lang, '')) AS h, text IS NOT NULL AS available FROM documents), r AS (SELECT node, parent, 0 AS d FROM g UNION ALL SELECT r.node, g.parent, d + 1 FROM r JOIN g ON g.node = r.parent WHERE d < 4) "
    "SELECT r.node, count(DISTINCT g.h)::BIGINT AS n_hashes, bool_and(g.available) AS complete FROM r JOIN g ON g.node = r.parent GROUP BY r.node",
)
def history_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different bodies among a revision's ancestors, and whether all of them are there; a join for each depth up to 5."""
    i = F.col("doc_id")
    g = table(spark, sf_dir, "documents").select(i.alias("node"), F.when(i % 5 != 0, i - 1).alias("parent"), F.sha2(F.coalesce("lang", F.lit("")), 256).alias("h"), F.col("text").isNotNull().alias("available"))
    up = rel.settle(g.select(F.col("node").alias("at"), F.col("parent").alias("next"), "h", "available"))
    cur, out = g.select("node", F.col("parent").alias("at")).where("at IS NOT NULL"), None
    for _ in range(5):
        step = cur.join(up, "at")
        found = step.select("node", "h", "available")
        out = found if out is None else out.unionByName(found)
        cur = step.where("next IS NOT NULL").select("node", F.col("next").alias("at"))
    return out.groupBy("node").agg(F.count_distinct("h").alias("n_hashes"), F.bool_and("available").alias("complete"))
