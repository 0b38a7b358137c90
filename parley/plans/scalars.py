"""Scalar rules over whole tables: coercions, classes, times, canonical JSON, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import UTTERANCES, table, utterances
from .cases import pick, pick_sql
from .registry import register


def _docs(spark: SparkSession, sf_dir: str, **values: list) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[pick("doc_id", v).alias(k) for k, v in values.items()])


def _docs_sql(**values: list) -> str:
    return "d AS (SELECT doc_id, " + ", ".join(f"{pick_sql('doc_id', v)} AS {k}" for k, v in values.items()) + " FROM documents)"


_TAGS = ["{{TotallyDisputed|date=May}}", "{{subst:POV}} npov", " {{Neutrality}}", "MSG:Disputed", "{{Disputeabout|x}}", "Factual accuracy", "accuracy|npov", "{{cleanup}}", "", None, "neutral point-of_view"]


@register(
    "template_family",
    f"""WITH {_docs_sql(tag=_TAGS)}, c AS (SELECT *, regexp_replace(lower(regexp_replace(split_part(regexp_replace(regexp_replace(trim(tag), '^\\{{\\{{', ''), '\\}}\\}}$', ''), '|', 1), '^(subst:|msg:)', '', 'i')), '[^a-z0-9]+', '', 'g') AS k FROM d)
SELECT doc_id, CASE WHEN coalesce(tag, '') = '' THEN NULL WHEN contains(k, 'totallydisputed') THEN 'totally_disputed' WHEN contains(k, 'npov') OR contains(k, 'neutrality') OR contains(k, 'neutralpointofview') THEN 'neutral_point_of_view'
WHEN contains(k, 'dispute') THEN 'disputed' WHEN contains(k, 'accuracy') OR contains(k, 'factual') THEN 'factual_accuracy' ELSE 'other_dispute_template' END AS family FROM c""",
)
def template_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first family that fits, in a fixed order."""
    return _docs(spark, sf_dir, tag=_TAGS).select("doc_id", C.tag_family(F.col("tag")).alias("family"))


_CLOSED = ["Failed to agree", "successfully RESOLVED", "resolved", "Withdrawn", "general close", "stale", "", None, "failed but resolved"]


@register(
    "closure_category",
    f"WITH {_docs_sql(v=_CLOSED)} SELECT doc_id, CASE WHEN v IS NULL THEN 'unknown' WHEN contains(lower(v), 'fail') THEN 'failure' WHEN contains(lower(v), 'success') OR contains(lower(v), 'resolved') THEN 'success' WHEN contains(lower(v), 'withdraw') THEN 'withdrawn' WHEN contains(lower(v), 'general') THEN 'general' ELSE 'other' END AS category FROM d",
)
def closure_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I20."""
    return _docs(spark, sf_dir, v=_CLOSED).select("doc_id", C.closure(F.col("v")).alias("category"))


_TARGETS = ["User talk:Ann", "user_talk:Bob", "User:X", "Special:Contributions/9", "Special:Diff/1", "index.php?oldid=3", "#top", "fr:Page", "w:Page", "category:Y", "File:z.png", "Plain page", "Abcdefghijkl:x", "a1:x"]


@register(
    "link_kinds",
    f"""WITH {_docs_sql(t=_TARGETS)}, l AS (SELECT *, lower(replace(t, '_', ' ')) AS low FROM d)
SELECT doc_id, CASE WHEN low LIKE 'user talk:%' THEN 'user_talk' WHEN low LIKE 'user:%' THEN 'user' WHEN low LIKE 'special:contributions%' THEN 'special_contributions' WHEN contains(low, 'special:diff') OR contains(low, 'oldid=') OR contains(low, 'diff=') THEN 'diff_revision'
WHEN t LIKE '#%' THEN 'section_anchor' WHEN length(split_part(t, ':', 1)) BETWEEN 2 AND 11 AND contains(t, ':') AND regexp_full_match(split_part(t, ':', 1), '[A-Za-z]+') AND split_part(low, ':', 1) NOT IN ('category', 'file', 'template') THEN 'interwiki' ELSE 'article' END AS kind FROM l""",
)
def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I21."""
    return _docs(spark, sf_dir, t=_TARGETS).select("doc_id", C.link_kind(F.col("t")).alias("kind"))


_ACTORS = ["Ann", "10.0.0.255", "10.0.0.256", "2001:db8::1", "~2024-1", "", None, "1.2.3", "::", "Bob 1"]
_NUMBERS, _HIDDEN = [1, None, 3], [False, False, False, False, True, None, False]


@register(
    "actor_identity",
    f"""WITH {_docs_sql(a=_ACTORS, n=_NUMBERS, h=_HIDDEN)}
SELECT doc_id, CASE WHEN coalesce(h, false) THEN 'revision_actor_hidden_or_deleted' WHEN coalesce(a, '') = '' THEN 'revision_actor_not_observed'
WHEN regexp_full_match(a, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') OR (length(a) - length(replace(a, ':', '')) >= 2 AND regexp_full_match(a, '[0-9A-Fa-f:]+')) THEN 'revision_actor_ip_observed'
WHEN a LIKE '~%' THEN 'revision_actor_temporary_observed' WHEN n IS NULL THEN 'revision_actor_name_observed_numeric_id_unavailable' ELSE 'revision_actor_observed_rename_status_unchecked' END AS status FROM d""",
)
def actor_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I22."""
    d = _docs(spark, sf_dir, a=_ACTORS, n=_NUMBERS, h=_HIDDEN)
    return d.select("doc_id", C.actor_status(F.col("a"), F.col("n"), F.col("h")).alias("status"))


_USERS, _OBSERVED = ["Ann_B", "Bob", None, "Ann  b"], ["ann b", "Bob", "", "Cy", None]


@register(
    "signature_actor_match",
    f"""WITH {_docs_sql(u=_USERS, a=_OBSERVED, h=_HIDDEN)}, k AS (SELECT *, lower(trim(regexp_replace(replace(u, '_', ' '), ' +', ' ', 'g'))) AS x, lower(trim(regexp_replace(replace(a, '_', ' '), ' +', ' ', 'g'))) AS y FROM d)
SELECT doc_id, CASE WHEN coalesce(h, false) THEN 'revision_actor_hidden_or_deleted' WHEN coalesce(a, '') = '' THEN 'revision_actor_not_observed' WHEN x IS NULL THEN 'signature_identity_target_not_observed' WHEN x = y THEN 'exact_normalized_target_match' ELSE 'observed_mismatch_or_rename' END AS status FROM k""",
)
def signature_actor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I17, I23."""
    d = _docs(spark, sf_dir, u=_USERS, a=_OBSERVED, h=_HIDDEN)
    return d.select("doc_id", C.signature_match(F.array("u", F.lit(None).cast("string")), F.col("a"), F.col("h")).alias("status"))


_PAGES = ['{"pageid": 1}', '{"missing": true}', '{"pageid": 2, "title": "t"}', '{"missing": ""}']
_REVISIONS = ['{"revid": 1, "content": "x"}', None, '{"revid": 2, "texthidden": true}', '{"revid": 3}', '{"revid": 4, "slots": {"main": {"content": "y"}}}', '{"revid": 5, "userhidden": "", "sha1hidden": "", "content": ""}']
_STATE = """CASE WHEN list_contains(json_keys(p), 'missing') THEN 'missing_page' WHEN r IS NULL THEN 'revision_not_returned' WHEN list_contains(json_keys(r), 'texthidden') THEN 'suppressed_or_revision_deleted_text'
WHEN NOT list_contains(json_keys(r), 'slots') AND NOT list_contains(json_keys(r), 'content') THEN 'metadata_only' ELSE 'content_available' END"""


@register(
    "revision_availability",
    f"""WITH {_docs_sql(p=_PAGES, r=_REVISIONS)}, s AS (SELECT *, {_STATE} AS availability FROM d)
SELECT doc_id, availability, coalesce(list_contains(json_keys(r), 'userhidden'), false) AS userhidden, CASE WHEN r IS NULL THEN NULL ELSE coalesce(r->>'$.slots.main.content', r->>'$.content') END AS content,
CASE availability WHEN 'content_available' THEN 'available' WHEN 'metadata_only' THEN 'retryable' WHEN 'revision_not_returned' THEN 'retryable' ELSE 'true_unavailable' END AS acquisition FROM s""",
)
def revision_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a revision, where its text stands, and whether asking again can help."""
    d = _docs(spark, sf_dir, p=_PAGES, r=_REVISIONS).withColumn("availability", C.availability(F.col("p"), F.col("r")))
    content = F.coalesce(F.get_json_object("r", "$.slots.main.content"), F.get_json_object("r", "$.content"))
    acquired = F.when(F.col("availability") == "content_available", "available").when(F.col("availability").isin("metadata_only", "revision_not_returned"), "retryable").otherwise("true_unavailable")
    hidden = F.coalesce(F.array_contains(F.json_object_keys("r"), "userhidden"), F.lit(False))
    return d.select("doc_id", "availability", hidden.alias("userhidden"), content.alias("content"), acquired.alias("acquisition"))


_SAME = [True, False, None]


@register(
    "cross_label_policy",
    f"""WITH {_docs_sql(s=_SAME, v=[True, False])} SELECT doc_id, CASE WHEN s AND v THEN 'positive_formal_event_with_contradictory_source_provenance' WHEN NOT s THEN 'distinct_non_overlapping_episodes' ELSE 'quarantined_episode_identity_unresolved' END AS status, CASE WHEN s AND v THEN true END AS outcome FROM d""",
)
def cross_label_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I27, R24, M13."""
    d = _docs(spark, sf_dir, s=_SAME, v=[True, False]).withColumn("status", C.cross_label(F.col("s"), F.col("v")))
    return d.select("doc_id", "status", F.when(F.col("status").startswith("positive"), True).alias("outcome"))


_TIMES = ["2012-03-04T05:06:07Z", "2012-03-04T05:06:07", "2012-03-04 05:06:07+02:00", "04/03/12 05:06 ", "2012-03-04", "soon", "", None, "2012-13-04T00:00:00Z"]
_SIGNED = ["12:34, 1 January 2020 (UTC)", "00:00, 29 February 2019 (UTC)", "7:08, 30 June 2011 (UTC)", "12:34, 1 Foo 2020 (UTC)", None]


@register(
    "parsed_times",
    f"""WITH {_docs_sql(t=_TIMES, s=_SIGNED)}, u AS (SELECT *, trim(t) AS x FROM d)
SELECT doc_id, epoch(coalesce(try_strptime(x, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(x, '%Y-%m-%dT%H:%M:%S'), CASE WHEN x LIKE '%+02:00' THEN try_strptime(replace(x, '+02:00', ''), '%Y-%m-%d %H:%M:%S') - INTERVAL 2 HOUR END, try_strptime(x, '%d/%m/%y %H:%M'), try_strptime(x, '%Y-%m-%d')))::BIGINT AS at,
epoch(try_strptime(s, '%-H:%M, %-d %B %Y (UTC)'))::BIGINT AS signed_at, strftime(make_timestamp(doc_id * 86400000000 + 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS of_unix FROM u""",
)
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I06, I07, I08, I10."""
    d = _docs(spark, sf_dir, t=_TIMES, s=_SIGNED)
    return d.select("doc_id", F.unix_timestamp(C.instant(F.col("t"))).alias("at"), F.unix_timestamp(C.signature_time(F.col("s"))).alias("signed_at"), C.iso_of_unix(F.col("doc_id") * 86400 + 1).alias("of_unix"))


@register(
    "eastern_repair",
    """WITH e AS (SELECT event_id, to_timestamp(1299000000 + 1800 * event_id) AS s FROM events),
c AS (SELECT *, CASE WHEN date_diff('hour', timezone('America/New_York', s - INTERVAL 4 HOUR), timezone('UTC', s - INTERVAL 4 HOUR)) = 4 THEN s - INTERVAL 4 HOUR END AS a,
CASE WHEN date_diff('hour', timezone('America/New_York', s - INTERVAL 5 HOUR), timezone('UTC', s - INTERVAL 5 HOUR)) = 5 THEN s - INTERVAL 5 HOUR END AS b FROM e)
SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN NULL ELSE epoch(coalesce(a, b))::BIGINT END AS repaired, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'dst_inverse_ambiguous' WHEN a IS NULL AND b IS NULL THEN 'timezone_repair_failed' ELSE 'corrected_eastern_artifact' END AS status FROM c""",
)
def eastern_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every half hour from March 2011 on, over changes of the clock."""
    e = table(spark, sf_dir, "events").select("event_id", F.timestamp_seconds(1299000000 + 1800 * F.col("event_id")).alias("s"))
    repaired, status = C.eastern_repair(F.col("s"))
    return e.select("event_id", F.unix_timestamp(repaired).alias("repaired"), status.alias("status"))


@register(
    "canonical_uids",
    """SELECT doc_id, 'doc:v1:' || sha256('[' || coalesce(to_json(source)::VARCHAR, 'null') || ',' || doc_id::VARCHAR || ',' || coalesce(to_json(lang)::VARCHAR, 'null') || ']') AS uid,
sha256('[' || doc_id::VARCHAR || ',' || coalesce(n_chars::VARCHAR, 'null') || ',' || coalesce(to_json(sha256(text))::VARCHAR, 'null') || ']') AS projection FROM documents""",
)
def canonical_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable names and ordered projections."""
    d = table(spark, sf_dir, "documents")
    name = C.uid("doc", [(F.col("source"), "string"), (F.col("doc_id"), "number"), (F.col("lang"), "string")])
    fields = [(F.col("doc_id"), "number"), (F.col("n_chars"), "number"), (F.sha2("text", 256), "string")]
    return d.select("doc_id", name.alias("uid"), F.sha2(C.canonical_array(fields), 256).alias("projection"))


_LOOSE = ["1", " Yes", "TRUE", "no", "0", "x", "", None, "12", "-3", "4.5", " 7 "]


@register(
    "lenient_values",
    f"""WITH {_docs_sql(v=_LOOSE)}, t AS (SELECT doc_id, lower(trim(v)) AS t FROM d)
SELECT doc_id, coalesce(t IN ('1', 'true', 'yes'), false) AS truth, CASE WHEN t IN ('1', 'true', 'yes') THEN true WHEN t IN ('0', 'false', 'no') THEN false END AS three, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN t::BIGINT END AS n, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN t::BIGINT ELSE -1 END AS m, try_cast(t AS DOUBLE) AS x FROM t""",
)
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B01, B15, B16."""
    v = F.col("v")
    return _docs(spark, sf_dir, v=_LOOSE).select("doc_id", C.truth(v).alias("truth"), C.three_state(v).alias("three"), C.whole(v).alias("n"), C.whole(v, -1).alias("m"), C.fraction(v).alias("x"))


_LISTS = ['["b", "a", "a", ""]', "z|y| |z", "", None, "[]", "[broken", "one"]


@register(
    "reason_lists",
    f"""WITH {_docs_sql(v=_LISTS, k=["Creation", "insert", " RESTORE", "remove", "edit", "", None], s=["Clean", "", "1", "detected", "no", "?", None])},
p AS (SELECT *, CASE WHEN v LIKE '[%' THEN CASE WHEN json_valid(v) THEN from_json(v, '["VARCHAR"]') ELSE [v] END ELSE string_split(v, '|') END AS parts FROM d)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(parts, lambda x: trim(x)), lambda x: x <> ''))), ','), '') AS reasons,
CASE WHEN lower(trim(k)) IN ('creation', 'original', 'add', 'addition', 'insert', 'new') THEN 'addition' WHEN lower(trim(k)) IN ('restore', 'restoration', 'revert_restore') THEN 'restoration' WHEN lower(trim(k)) IN ('delete', 'deletion', 'remove') THEN 'deletion' WHEN coalesce(k, '') <> '' THEN 'modification' ELSE 'unclassified' END AS class,
CASE WHEN lower(s) IN ('clean', '', '0', 'false', 'no') THEN 'clean' WHEN lower(s) IN ('detected', '1', 'true', 'yes') THEN 'detected' ELSE 'unknown' END AS contamination FROM p""",
)
def reason_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I28, I29, S11, S14."""
    d = _docs(spark, sf_dir, v=_LISTS, k=["Creation", "insert", " RESTORE", "remove", "edit", "", None], s=["Clean", "", "1", "detected", "no", "?", None])
    return d.select("doc_id", F.array_join(C.reasons(F.col("v")), ",").alias("reasons"), C.action_class(F.col("k")).alias("class"), C.contamination(F.col("s")).alias("contamination"))


@register(
    "text_cascade",
    f"""WITH {UTTERANCES}, x AS (SELECT id, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN '  ' END AS final, CASE WHEN turn % 2 = 0 THEN text END AS source, role FROM utt)
SELECT id, coalesce(CASE WHEN trim(final) <> '' THEN final END, CASE WHEN trim(source) <> '' THEN source END, role) AS text, CASE WHEN trim(final) <> '' THEN 'final' WHEN trim(source) <> '' THEN 'source' WHEN trim(role) <> '' THEN 'role' END AS origin,
coalesce(final, '') <> coalesce(source, '') AS differs, 'utterance' AS row_kind, NULL::VARCHAR AS episode FROM x""",
)
def text_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text that is not blank, and where it came from."""
    u = utterances(spark, sf_dir)
    m = F.col("turn") % 3
    x = u.select("id", F.when(m == 0, F.col("text")).when(m == 1, "  ").alias("final"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("source"), "role")
    three = {c: F.col(c) for c in ("final", "source", "role")}
    differs = F.coalesce("final", F.lit("")) != F.coalesce("source", F.lit(""))
    return x.select("id", C.first_text(*three.values()).alias("text"), C.first_source(**three).alias("origin"), differs.alias("differs"), F.lit("utterance").alias("row_kind"), F.lit(None).cast("string").alias("episode"))


@register(
    "excerpts",
    r"""WITH s AS (SELECT doc_id, text, (doc_id % 50)::INT AS a, (doc_id % 50 + 20)::INT AS b, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS even FROM documents)
SELECT doc_id, substr(text, greatest(a - 10, 0) + 1, 40) AS excerpt, CASE WHEN length(even) <= 30 THEN even ELSE rtrim(substr(even, 1, 27)) || '...' END AS preview, (length(text) - length(replace(text, 'the ', ''))) // 4 AS n_the FROM s""",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I33, S10."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 50).cast("int").alias("a"))
    return d.select("doc_id", C.excerpt(F.col("text"), F.col("a"), F.col("a") + 20, 40).alias("excerpt"), C.preview(F.col("text"), 30).alias("preview"), C.occurrences(F.col("text"), F.lit("the ")).alias("n_the"))


@register(
    "merged_spans",
    """WITH s AS (SELECT DISTINCT o_custkey, (o_orderkey % 97)::INT AS a, (o_orderkey % 97 + 1 + o_orderkey % 5)::INT AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), g AS (SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m),
r AS (SELECT o_custkey, k, min(a) AS a, max(b) AS b FROM g GROUP BY ALL) SELECT o_custkey, count(*)::BIGINT AS n, sum(b - a)::BIGINT AS covered, max(CASE WHEN a < 10 AND 5 < b THEN 1 ELSE 0 END) = 1 AS meets FROM r GROUP BY 1""",
)
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a customer joined where they touch, and whether one overlaps the places 5 to 10."""
    k = F.col("o_orderkey") % 97
    s = F.struct(k.cast("int").alias("start"), (k + 1 + F.col("o_orderkey") % 5).cast("int").alias("end"))
    x = table(spark, sf_dir, "orders").select("o_custkey", s.alias("s")).groupBy("o_custkey").agg(F.collect_set("s").alias("s"))
    x = x.select("o_custkey", C.merged(F.col("s")).alias("m"))
    covered = F.aggregate("m", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return x.select("o_custkey", F.size("m").cast("long").alias("n"), covered.alias("covered"), F.exists("m", lambda r: C.overlaps(r["start"], r["end"], F.lit(5), F.lit(10))).alias("meets"))


_NEEDLES = ("error", "timeout")


@register(
    "needle_search",
    "SELECT user_id, count(*) FILTER (contains(lower(concat_ws(' ', event_type, props, value::INT::VARCHAR)), 'error') OR contains(lower(concat_ws(' ', event_type, props, value::INT::VARCHAR)), 'timeout'))::BIGINT AS n FROM events GROUP BY 1",
)
def needle_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of some words in several columns at once."""
    e = table(spark, sf_dir, "events")
    text = F.lower(F.concat_ws(" ", "event_type", "props", F.round("value").cast("int").cast("string")))
    hit = F.lit(False)
    for needle in _NEEDLES:
        hit = hit | text.contains(needle)
    return e.groupBy("user_id").agg(F.count_if(hit).alias("n"))


_WHY = ["content suppressed", "fetch timeout", "target_unavailable", "predecessor_unavailable", "", "boundary", "oversight http"]


@register(
    "unavailable_taxonomy",
    f"""WITH {_docs_sql(w=_WHY, t=["yes", "0", None], p=["true", "no", None, "1"], r=["12", None], a=["creation", "modification"], q=["3", None, "4"])}
SELECT doc_id, CASE WHEN regexp_matches(w, 'suppressed|deleted|revisiondeleted|oversight') THEN 'suppressed/deleted' WHEN regexp_matches(w, 'fetch|cache|http|network|timeout|api_error') THEN 'fetch/cache failure'
WHEN coalesce(lower(t) IN ('0', 'false', 'no'), false) OR contains(w, 'target_unavailable') OR contains(w, 'target_revision_unavailable') THEN 'target revision unavailable'
WHEN coalesce(lower(p) IN ('0', 'false', 'no'), false) OR contains(w, 'predecessor_unavailable') OR contains(w, 'predecessor_revision_unavailable') THEN 'predecessor unavailable only'
WHEN r IS NULL THEN 'missing metadata' WHEN q IS NULL AND a <> 'creation' THEN 'missing metadata' ELSE 'other' END AS taxonomy FROM d""",
)
def unavailable_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a text cannot be had, the most specific evidence first."""
    d = _docs(spark, sf_dir, w=_WHY, t=["yes", "0", None], p=["true", "no", None, "1"], r=["12", None], a=["creation", "modification"], q=["3", None, "4"])
    said = lambda *words: F.regexp_like("w", F.lit("|".join(words)))
    false = lambda *names: F.coalesce(~C.three_state(C.first_present(d.columns, *names)), F.lit(False))
    c = F.when(said("suppressed", "deleted", "revisiondeleted", "oversight"), "suppressed/deleted").when(said("fetch", "cache", "http", "network", "timeout", "api_error"), "fetch/cache failure")
    c = c.when(false("target_available", "t") | said("target_unavailable", "target_revision_unavailable"), "target revision unavailable")
    c = c.when(false("predecessor_available", "p") | said("predecessor_unavailable", "predecessor_revision_unavailable"), "predecessor unavailable only")
    c = c.when(F.col("r").isNull() | (F.col("q").isNull() & (F.col("a") != "creation")), "missing metadata")
    return d.select("doc_id", c.otherwise("other").alias("taxonomy"))
