"""Joins, aggregates, windows and graphs beyond the basic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import rel
from ..sources import UTTERANCES, table, utterances
from .registry import register


@register(
    "top_one_of_each",
    "SELECT o.o_orderkey, l.l_linenumber, l.l_extendedprice FROM orders o LEFT JOIN LATERAL (SELECT l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_linenumber LIMIT 1) l ON true",
)
def top_one_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order its dearest returned line, if it has any; the condition is applied before the join."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")
    best = rel.top1(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")])
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@register(
    "reconciliation",
    """WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS lines, count(*)::BIGINT AS n FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, c.c_custkey, n.n_name, coalesce(l.n, 0)::BIGINT AS n, l.lines IS DISTINCT FROM round(o.o_totalprice, 2) AS differs FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN l ON l.l_orderkey = o.o_orderkey""",
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sides reconciled on their keys, the many-row side aggregated before it is joined."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("lines"), F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    x = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    x = x.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return x.select("o_orderkey", "c_custkey", "n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (~F.col("lines").eqNullSafe(F.round("o_totalprice", 2))).alias("differs"))


@register(
    "events_after_index",
    "WITH i AS (SELECT user_id, min(ts) AS cut FROM events WHERE event_type = 'error' GROUP BY 1) SELECT e.event_id, e.user_id, floor(epoch(e.ts - i.cut))::BIGINT AS seconds FROM events e JOIN i ON i.user_id = e.user_id AND e.ts > i.cut WHERE e.event_type = 'purchase'",
)
def events_after_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an entity after its index time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    index = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("at"))
    x = e.where("event_type = 'purchase'").join(index, "user_id").where("ts > at")
    return x.select("event_id", "user_id", F.floor((F.unix_micros("ts") - F.unix_micros("at")) / 1000000).alias("seconds"))


_SPANS = "a AS (SELECT l_orderkey AS k, l_linenumber AS i, (l_linenumber * 5)::INT AS a0, (l_linenumber * 5 + l_suppkey % 4)::INT AS a1 FROM lineitem), b AS (SELECT l_orderkey AS k, l_linenumber AS j, (l_linenumber * 6)::INT AS b0, (l_linenumber * 6 + 2 + l_partkey % 9)::INT AS b1 FROM lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_suppkey", "l_partkey")
    a = x.select("k", F.col("n").alias("i"), (F.col("n") * 5).cast("int").alias("a0"), (F.col("n") * 5 + F.col("l_suppkey") % 4).cast("int").alias("a1"))
    b = x.select("k", F.col("n").alias("j"), (F.col("n") * 6).cast("int").alias("b0"), (F.col("n") * 6 + 2 + F.col("l_partkey") % 9).cast("int").alias("b1"))
    return a, b


@register("span_overlaps", f"WITH {_SPANS} SELECT a.k, i, j, a0 >= b0 AND a1 <= b1 AS inside, least(a1, b1) - greatest(a0, b0) AS shared FROM a JOIN b ON a.k = b.k AND a0 < b1 AND b0 < a1 WHERE a0 < a1")
def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed spans with the candidates they overlap, as an equi-join on stretches."""
    x = rel.overlap_join(*_spans(spark, sf_dir), ["k"], 8)
    inside = (F.col("a0") >= F.col("b0")) & (F.col("a1") <= F.col("b1"))
    return x.select("k", "i", "j", inside.alias("inside"), (F.least("a1", "b1") - F.greatest("a0", "b0")).alias("shared"))


@register(
    "nearest_spans",
    f"""WITH {_SPANS}, o AS (SELECT a.k, i, j, 0 AS gap, row_number() OVER (PARTITION BY a.k, i ORDER BY b0, j) AS r FROM a JOIN b ON a.k = b.k AND a0 < b1 AND b0 < a1 WHERE a0 < a1),
n AS (SELECT a.k, i, j, greatest(b0 - a1, a0 - b1, 0) AS gap, row_number() OVER (PARTITION BY a.k, i ORDER BY greatest(b0 - a1, a0 - b1, 0), b0, j) AS r FROM a JOIN b ON a.k = b.k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = a.k AND o.i = a.i))
SELECT k, i, j, gap FROM o WHERE r <= 3 UNION ALL SELECT k, i, j, gap FROM n WHERE r = 1""",
)
def nearest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each span the first three candidates it overlaps, else the nearest one."""
    a, b = _spans(spark, sf_dir)
    gap = F.greatest(F.col("b0") - F.col("a1"), F.col("a0") - F.col("b1"), F.lit(0))
    x = a.join(b, "k").withColumn("gap", gap).withColumn("over", (F.col("a0") < F.col("a1")) & (F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    w = Window.partitionBy("k", "i")
    x = x.withColumn("some", F.max("over").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("over"), "gap", "b0", "j")))
    keep = F.when(F.col("some"), F.col("over") & (F.col("r") <= 3)).otherwise(F.col("r") == 1)
    return x.where(keep).select("k", "i", "j", F.when(F.col("some"), 0).otherwise(F.col("gap")).alias("gap"))


@register(
    "best_edges",
    f"""WITH {UTTERANCES}, w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM utt),
e AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, len(list_intersect(a.w, b.w)) AS n FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant' WHERE len(list_intersect(a.w, b.w)) > 0)
SELECT conv_id, a, b, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY n DESC, abs(a - b), b) AS r FROM e) WHERE r = 1""",
)
def best_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions and candidates of a case with evidence between them (shared words), the best candidate of each."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    u = utterances(spark, sf_dir).select("conv_id", "turn", "role", F.explode(w).alias("word"))
    a = u.where("role = 'user'").select("conv_id", F.col("turn").alias("a"), "word")
    b = u.where("role = 'assistant'").select("conv_id", F.col("turn").alias("b"), "word")
    e = a.join(b, ["conv_id", "word"]).groupBy("conv_id", "a", "b").agg(F.count("*").alias("n"))
    return rel.extreme(e, ["conv_id", "a"], F.struct("n", -F.abs(F.col("a") - F.col("b")), -F.col("b"))).select("conv_id", "a", "b", "n")


_EVEN = r"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@register(
    "unique_text_match",
    f"""WITH d AS (SELECT doc_id, sha256({_EVEN.format(c='text')}) AS h, count(*) OVER (PARTITION BY sha256({_EVEN.format(c='text')})) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT h, min(doc_id) AS a, max(doc_id) AS b, count(*)::BIGINT AS n FROM d GROUP BY h HAVING count(*) > 1)
SELECT a, b, CASE WHEN n = 2 THEN 'unique_pair' ELSE 'ambiguous' END AS status, n FROM p""",
)
def unique_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts equal after normalising; a match counts only if it is the only one."""
    even = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    g = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2(even, 256).alias("h"))
    g = g.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return g.select("a", "b", F.when(F.col("n") == 2, "unique_pair").otherwise("ambiguous").alias("status"), "n")


@register(
    "contract_report",
    """WITH c AS (SELECT doc_id, count(*) AS n, min(n_chars) AS v FROM documents GROUP BY 1), s AS (SELECT doc_id, count(*) AS n, min(quality) AS v FROM labels GROUP BY 1)
SELECT CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'unclaimed' WHEN c.n > 1 OR s.n > 1 THEN 'duplicate' WHEN c.v % 2 IS DISTINCT FROM s.v THEN 'mismatch' ELSE 'exact' END AS status, count(*)::BIGINT AS n FROM c FULL JOIN s ON s.doc_id = c.doc_id GROUP BY 1""",
)
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-to-one contract between two sides: what is missing, unclaimed, repeated or has another value."""
    side = lambda t, v: table(spark, sf_dir, t).groupBy("doc_id").agg(F.count("*").alias("n_" + t), F.min(v).alias("v_" + t))
    x = side("documents", "n_chars").join(side("labels", "quality"), "doc_id", "full")
    c, s = F.col("n_documents"), F.col("n_labels")
    status = F.when(c.isNull(), "missing").when(s.isNull(), "unclaimed").when((c > 1) | (s > 1), "duplicate").when(~(F.col("v_documents") % 2).eqNullSafe(F.col("v_labels")), "mismatch").otherwise("exact")
    return x.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_SEGMENTS = ("BUILDING", "MACHINERY", "NOWHERE")


@register(
    "cascade_match",
    f"""WITH g AS (SELECT s_suppkey, s_nationkey, [{', '.join(f"'{s}'" for s in _SEGMENTS)}][(s_suppkey % 3 + 1)::INT] AS seg, s_acctbal > 0 AS pos FROM supplier),
p AS (SELECT g.s_suppkey, c.c_custkey, c.c_mktsegment = g.seg AS f1, (c.c_acctbal > 0) = g.pos AS f2 FROM g JOIN customer c ON c.c_nationkey = g.s_nationkey),
a AS (SELECT *, CASE WHEN bool_or(f1) OVER (PARTITION BY s_suppkey) THEN f1 ELSE true END AS k1 FROM p), b AS (SELECT * FROM a WHERE k1), d AS (SELECT *, CASE WHEN bool_or(f2) OVER (PARTITION BY s_suppkey) THEN f2 ELSE true END AS k2 FROM b)
SELECT s_suppkey, count(*)::BIGINT AS n, min(c_custkey) AS first FROM d WHERE k2 GROUP BY 1""",
)
def cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates narrowed by one property after the other, none of which may empty the pool; candidates are counted by their properties before they are joined."""
    seg = F.element_at(F.array(*[F.lit(s) for s in _SEGMENTS]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    g = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", seg.alias("seg"), (F.col("s_acctbal") > 0).alias("pos"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("cpos")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    x = g.join(c, F.col("c_nationkey") == F.col("s_nationkey"))
    x = rel.narrowed(x, ["s_suppkey"], [F.col("c_mktsegment") == F.col("seg"), F.col("cpos") == F.col("pos")])
    return x.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


@register(
    "fallback_keys",
    f"""WITH {UTTERANCES}, r AS (SELECT conv_id, turn, id, CASE WHEN turn % 3 = 0 THEN id WHEN turn % 3 = 1 THEN id || 'x' END AS uid FROM utt), a AS (SELECT conv_id, turn AS t, CASE WHEN turn % 2 = 0 THEN id END AS uid, [id || 'x', id || 'y'] AS uids FROM utt),
j AS (SELECT r.id, a.t, coalesce(a.uid = r.uid, false) AS e, coalesce(list_contains(a.uids, r.uid), false) AS c FROM r JOIN a ON a.conv_id = r.conv_id),
n AS (SELECT id, count(*) FILTER (e) AS ne, count(*) FILTER (c) AS nc, count(*) AS n, min(t) FILTER (e) AS ae, min(t) FILTER (c) AS ac, min(t) AS a FROM j GROUP BY id)
SELECT id, CASE WHEN ne = 1 THEN ae WHEN nc = 1 THEN ac WHEN n = 1 THEN a END::BIGINT AS place, CASE WHEN ne = 1 THEN 'exact' WHEN nc = 1 THEN 'contained' WHEN n = 1 THEN 'sole' ELSE 'none' END AS how FROM n""",
)
def fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's action by its exact key, else by the only list that holds it, else the only one there is; three equi-joins."""
    u = utterances(spark, sf_dir)
    own = F.when(F.col("turn") % 3 == 0, F.col("id")).when(F.col("turn") % 3 == 1, F.concat("id", F.lit("x")))
    r = u.select("conv_id", "id", own.alias("uid"))
    a = u.select("conv_id", F.col("turn").alias("at"), F.when(F.col("turn") % 2 == 0, F.col("id")).alias("uid"), F.array(F.concat("id", F.lit("x")), F.concat("id", F.lit("y"))).alias("uids"))
    one = lambda x, name: x.agg(F.count("*").alias("n" + name), F.min("at").alias("a" + name))
    exact = one(a.where("uid IS NOT NULL").groupBy("conv_id", "uid"), "e")
    held = one(a.select("conv_id", "at", F.explode(F.array_distinct("uids")).alias("uid")).groupBy("conv_id", "uid"), "c")
    sole = one(a.groupBy("conv_id"), "s")
    x = r.join(exact, ["conv_id", "uid"], "left").join(held, ["conv_id", "uid"], "left").join(sole, "conv_id")
    rules = [("e", "exact"), ("c", "contained"), ("s", "sole")]
    at = F.coalesce(*[F.when(F.col("n" + k) == 1, F.col("a" + k)) for k, _ in rules])
    how = F.coalesce(*[F.when(F.col("n" + k) == 1, name) for k, name in rules], F.lit("none"))
    return x.select("id", at.cast("long").alias("place"), how.alias("how"))


_MOVES = "m AS (SELECT p_partkey AS node, CASE WHEN p_partkey IN (1, 3) THEN 4 - p_partkey WHEN p_partkey % 2 = 0 THEN p_partkey // 2 END AS parent FROM part)"


@register(
    "renames",
    f"""WITH RECURSIVE {_MOVES}, r AS (SELECT node, node AS last, 0::BIGINT AS n FROM m WHERE parent IS NULL OR parent NOT IN (SELECT node FROM m) UNION ALL SELECT m.node, r.last, r.n + 1 FROM m JOIN r ON m.parent = r.node)
SELECT m.node, r.last, r.n, r.node IS NULL AS cycle FROM m LEFT JOIN r ON r.node = m.node""",
)
def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chain of renames ends, safe from cycles; every requested name keeps a row."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(k.alias("node"), F.when(k.isin(1, 3), 4 - k).when(k % 2 == 0, F.floor(k / 2)).alias("parent"))
    return rel.roots(m).select("node", F.col("root").alias("last"), F.col("depth").alias("n"), "cycle")


@register(
    "participant_overlap",
    """WITH o AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS a, list_distinct(list(o_orderstatus)) AS s, min(o_orderdate) AS t FROM orders GROUP BY 1), x AS (SELECT *, len(list_intersect(a, ['1-URGENT', '2-HIGH'])) AS n FROM o)
SELECT o_custkey, n::BIGINT AS n_shared, CASE WHEN n > 0 THEN 'observed_overlap' ELSE 'observed_none' END AS status, epoch(TIMESTAMP '1995-01-01' - t)::BIGINT AS distance FROM x""",
)
def participant_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of two sides compared, and the distance in time."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.min(F.col("o_orderdate").cast("timestamp")).alias("t"))
    n = F.size(F.array_intersect("a", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).cast("long")
    return g.select("o_custkey", n.alias("n_shared"), F.when(n > 0, "observed_overlap").otherwise("observed_none").alias("status"), (F.unix_timestamp(F.lit("1995-01-01").cast("timestamp")) - F.unix_timestamp("t")).alias("distance"))


@register(
    "audit_bundle",
    """SELECT d.doc_id, d.source AS doc__source, d.n_chars AS doc__n_chars, l.quality AS label__quality, l.toxic AS label__toxic, coalesce(s.n, 0)::BIGINT AS source__n,
CASE WHEN l.doc_id IS NULL THEN 'missing_recovery' WHEN l.quality = 0 THEN 'residual' ELSE 'selected' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) s ON s.source IS NOT DISTINCT FROM d.source""",
)
def audit_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence of a row side by side, columns prefixed with their side; what has no recovery is said to."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    sides = {"doc": d, "label": table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")}
    sides = {p: x.select("doc_id", *[F.col(c).alias(f"{p}__{c}") for c in x.columns if c != "doc_id"]) for p, x in sides.items()}
    x = sides["doc"].join(sides["label"].withColumn("has", F.lit(True)), "doc_id", "left")
    n = d.groupBy(F.col("source").alias("s_")).agg(F.count("*").alias("source__n"))
    x = x.join(n, F.col("doc__source").eqNullSafe(F.col("s_")), "left").withColumn("source__n", F.coalesce("source__n", F.lit(0).cast("long")))
    state = F.when(F.col("has").isNull(), "missing_recovery").when(F.col("label__quality") == 0, "residual").otherwise("selected")
    return x.withColumn("state", state).drop("s_", "has")


@register("duplicate_pair_guard", "SELECT count(*)::BIGINT AS pairs, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def duplicate_pair_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of keys that occur more than once."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_rows"))


@register("research_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def research_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D08."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@register("tied_entities", "SELECT count(DISTINCT user_id)::BIGINT AS n FROM (SELECT user_id, date_trunc('hour', ts) AS h FROM events GROUP BY 1, 2 HAVING count(*) > 1)")
def tied_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that have a tie, in two levels."""
    g = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("c")).where("c > 1")
    return g.agg(F.count_distinct("user_id").alias("n"))


@register(
    "anchor_rows",
    "SELECT source, coalesce(arg_min(doc_id, doc_id) FILTER (lang = 'en'), min(doc_id)) AS anchor, count(*) FILTER (lang = 'en') > 0 AS preferred FROM documents GROUP BY source",
)
def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each entity among the preferred ones, else among all."""
    en = F.coalesce(F.col("lang") == "en", F.lit(False))
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(F.struct((~en).alias("other"), "doc_id")).alias("a"))
    return g.select("source", F.col("a.doc_id").alias("anchor"), (~F.col("a.other")).alias("preferred"))


@register(
    "status_maps",
    """SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def status_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each state occurs, as one sorted map of an entity."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@register(
    "duplicate_candidates",
    "SELECT sha256(text) AS h, count(*)::BIGINT AS n, array_to_string(list_sort(list(doc_id))[1:20], ',') AS sample FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
)
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts with the 20 least of their ids, which are ranked by key before they are gathered."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))).where("r <= 20")
    few = r.groupBy("h").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("sample"))
    return d.groupBy("h").agg(F.count("*").alias("n")).where("n >= 2").join(few, "h").select("h", "n", "sample")


@register(
    "target_differences",
    """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t, page_id % 2 = 0 AS after FROM pages), g AS (SELECT t, bool_or(after) AS a, bool_or(NOT after) AS b FROM t GROUP BY t)
SELECT count(*) FILTER (a AND NOT b)::BIGINT AS gained, count(*) FILTER (b AND NOT a)::BIGINT AS lost, count(*) FILTER (a AND b)::BIGINT AS kept FROM g""",
)
def target_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets that one side has and the other has not."""
    t = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("t"), (F.col("page_id") % 2 == 0).alias("after"))
    g = t.groupBy("t").agg(F.bool_or("after").alias("a"), F.bool_or(~F.col("after")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.agg(F.count_if(a & ~b).alias("gained"), F.count_if(b & ~a).alias("lost"), F.count_if(a & b).alias("kept"))


_MARKS = {"digit": "[0-9]", "question": r"\?", "code": "`"}


@register(
    "markup_changes",
    f"WITH {UTTERANCES}, p AS (SELECT text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM utt), x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS mark, len(regexp_extract_all(a, '{e}')) - len(regexp_extract_all(b, '{e}')) AS d FROM p WHERE b IS NOT NULL" for n, e in _MARKS.items()) + ") SELECT mark, count(*) FILTER (d > 0)::BIGINT AS n_gain, count(*) FILTER (d < 0)::BIGINT AS n_loss, sum(greatest(d, 0))::BIGINT AS added, sum(greatest(-d, 0))::BIGINT AS removed FROM x GROUP BY 1",
)
def markup_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks gained and lost from one text to the next, in one pass over all patterns."""
    u = utterances(spark, sf_dir).withColumn("b", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    d = F.explode(F.array(*[F.struct(F.lit(n).alias("mark"), (F.regexp_count("text", F.lit(e)) - F.regexp_count("b", F.lit(e))).alias("d")) for n, e in _MARKS.items()])).alias("x")
    x = u.select(d).select("x.*")
    up, down = F.greatest("d", F.lit(0)), F.greatest(-F.col("d"), F.lit(0))
    return x.groupBy("mark").agg(F.count_if(F.col("d") > 0).alias("n_gain"), F.count_if(F.col("d") < 0).alias("n_loss"), F.sum(up).alias("added"), F.sum(down).alias("removed"))


@register(
    "agreement_rates",
    "SELECT d.source, count(l.quality)::BIGINT AS comparable, count(*) FILTER (l.quality = 1 - l.toxic)::BIGINT AS agreeing, round(count(*) FILTER (l.quality = 1 - l.toxic) / nullif(count(l.quality), 0), 9) AS rate FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1",
)
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over the rows that can be compared; no rate where there is none."""
    x = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    same = F.count_if(F.col("quality") == 1 - F.col("toxic"))
    return x.groupBy("source").agg(F.count("quality").alias("comparable"), same.alias("agreeing"), F.round(F.try_divide(same, F.count("quality")), 9).alias("rate"))


@register(
    "reason_frequencies",
    "WITH r AS (SELECT unnest(list_filter([CASE WHEN n_chars > 500 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END], lambda x: x IS NOT NULL)) AS reason FROM documents) SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY 1 ORDER BY n DESC, reason",
)
def reason_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of a row's several reasons occurs, the commonest first."""
    why = F.array(F.when(F.col("n_chars") > 500, "long"), F.when(F.col("lang") != "en", "foreign"), F.when(F.col("text").contains("\n"), "lines"))
    r = table(spark, sf_dir, "documents").select(F.explode(F.array_compact(why)).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


_FLAGS = f"""{UTTERANCES}, f0 AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 7 = 5 THEN conv_id::VARCHAR || '.0' ELSE id END AS cur, CASE WHEN turn % 9 = 8 THEN id || '!' ELSE reply_to END AS target, CASE WHEN turn % 4 = 0 THEN conv_id::VARCHAR || '.' || (turn + 5)::VARCHAR || '!' END AS orig FROM utt),
f1 AS (SELECT f.*, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) > 60 AS long_row, count(*) OVER (PARTITION BY conv_id, cur) > 1 AS dup,
target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f0 g WHERE g.conv_id = f.conv_id AND g.cur = f.target) AS dangling,
target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f0 g WHERE g.conv_id = f.conv_id AND (g.cur = f.target OR g.orig = f.target)) AS dangling_alias FROM f0 f),
f2 AS (SELECT *, bool_or(long_row) OVER c AS long_case, bool_or(dup OR dangling) OVER c AS broken_case FROM f1 WINDOW c AS (PARTITION BY conv_id))"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with some repeated ids, broken targets and original ids, and what is wrong with row and case."""
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    u = utterances(spark, sf_dir).select(
        "conv_id", "turn", "role", "text",
        F.when(turn % 7 == 5, F.concat(conv, F.lit(".0"))).otherwise(F.col("id")).alias("cur"),
        F.when(turn % 9 == 8, F.concat("id", F.lit("!"))).otherwise(F.col("reply_to")).alias("target"),
        F.when(turn % 4 == 0, F.concat(conv, F.lit("."), (turn + 5).cast("string"), F.lit("!"))).alias("orig"),
    )
    names = u.select("conv_id", F.explode(F.array(F.struct(F.col("cur").alias("target"), F.lit(True).alias("own")), F.struct(F.col("orig").alias("target"), F.lit(False).alias("own")))).alias("n"))
    names = names.select("conv_id", "n.*").where("target IS NOT NULL").groupBy("conv_id", "target").agg(F.bool_or("own").alias("own"))
    u = u.withColumn("long_row", F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+")) > 60).withColumn("dup", F.count("*").over(Window.partitionBy("conv_id", "cur")) > 1)
    u = u.join(names, ["conv_id", "target"], "left")
    has = F.col("target").isNotNull()
    u = u.withColumn("dangling", has & ~F.coalesce("own", F.lit(False))).withColumn("dangling_alias", has & F.col("own").isNull())
    c = Window.partitionBy("conv_id")
    return u.withColumn("long_case", F.bool_or("long_row").over(c)).withColumn("broken_case", F.bool_or(F.col("dup") | F.col("dangling")).over(c))


@register("replication_flags", f"WITH {_FLAGS} SELECT conv_id, turn, long_row, dup, dangling, dangling_alias, NOT long_case AS after_length, NOT long_case AND NOT dup AND NOT dangling AS after_duplicates, NOT long_case AND NOT broken_case AS complete FROM f2")
def replication_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a row and with its case, and what each filter leaves."""
    f = _flags(spark, sf_dir)
    ok = ~F.col("long_case")
    return f.select("conv_id", "turn", "long_row", "dup", "dangling", "dangling_alias", ok.alias("after_length"), (ok & ~F.col("dup") & ~F.col("dangling")).alias("after_duplicates"), (ok & ~F.col("broken_case")).alias("complete"))


@register(
    "replication_attrition",
    f"WITH {_FLAGS} SELECT role, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS n_cases, count(*) FILTER (NOT long_case)::BIGINT AS after_length, count(DISTINCT CASE WHEN NOT long_case THEN conv_id END)::BIGINT AS cases_after_length, count(*) FILTER (NOT long_case AND NOT dup AND NOT dangling)::BIGINT AS after_duplicates, count(*) FILTER (NOT long_case AND NOT broken_case)::BIGINT AS complete FROM f2 GROUP BY 1",
)
def replication_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cases that each filter leaves, by side."""
    ok = ~F.col("long_case")
    n = F.count_if
    return _flags(spark, sf_dir).groupBy("role").agg(
        F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_cases"), n(ok).alias("after_length"), F.count_distinct(F.when(ok, F.col("conv_id"))).alias("cases_after_length"),
        n(ok & ~F.col("dup") & ~F.col("dangling")).alias("after_duplicates"), n(ok & ~F.col("broken_case")).alias("complete"),
    )


@register(
    "merged_runs",
    f"""WITH {_FLAGS}, r AS (SELECT *, CASE WHEN role = lag(role) OVER w AND coalesce(target, '') = coalesce(lag(target) OVER w, '') THEN 0 ELSE 1 END AS c FROM f2 WHERE NOT long_case AND NOT broken_case WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM r) SELECT conv_id, k::BIGINT AS run, min(role) AS role, count(*)::BIGINT AS n, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, k""",
)
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive rows of one author and addressee in complete cases, their texts joined in order."""
    f = _flags(spark, sf_dir).where(~F.col("long_case") & ~F.col("broken_case")).withColumn("key", F.struct("role", F.coalesce("target", F.lit("")).alias("to")))
    g = rel.islands(f, ["conv_id"], "turn", "key").groupBy("conv_id", "run")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return g.agg(F.min("role").alias("role"), F.count("*").alias("n"), text.alias("text"))


@register("episode_numbers", "SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS LAST)::BIGINT AS number, 'D' || lpad(dense_rank() OVER (ORDER BY source NULLS LAST)::VARCHAR, 5, '0') AS label FROM documents")
def episode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global dense rank, over distinct keys instead of all rows."""
    x = rel.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "number")
    return x.select("doc_id", "number", F.concat(F.lit("D"), F.lpad(F.col("number").cast("string"), 5, "0")).alias("label"))


@register(
    "ordered_rows",
    "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, lang NULLS LAST, n_chars NULLS LAST, doc_id)::BIGINT AS place FROM documents",
)
def ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place by several keys, nulls last in each."""
    w = Window.partitionBy("source").orderBy(F.when(F.col("lang") == "en", 0).otherwise(1), F.col("lang").asc_nulls_last(), F.col("n_chars").asc_nulls_last(), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("place"))


@register(
    "timed_inversions",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN ts END AS t FROM events), a AS (SELECT user_id, count(*) FILTER (t < p) AS n FROM (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e) GROUP BY 1),
b AS (SELECT user_id, count(*) FILTER (t < p) AS n FROM (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e WHERE t IS NOT NULL) GROUP BY 1) SELECT a.user_id, a.n::BIGINT AS n_adjacent, coalesce(b.n, 0)::BIGINT AS n_skipping FROM a LEFT JOIN b ON b.user_id = a.user_id""",
)
def timed_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that run back, between neighbours, and between neighbours that have a time; both in one sort."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("ts")).alias("t"))
    e = e.withColumn("p", F.lag("t").over(w)).withColumn("q", F.last("t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return e.groupBy("user_id").agg(F.count_if(F.col("t") < F.col("p")).alias("n_adjacent"), F.count_if(F.col("t") < F.col("q")).alias("n_skipping"))


@register(
    "simultaneity_names",
    """SELECT event_id, 'simultaneity:v1:' || sha256('["' || user_id || '","' || coalesce(strftime(CASE WHEN event_type <> 'error' THEN date_trunc('hour', ts) END, '%Y-%m-%dT%H:%M:%S'), 'unresolved:' || event_id) || '"]') AS uid FROM events""",
)
def simultaneity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a case with one time share a name; one without a time has its own."""
    e = table(spark, sf_dir, "events")
    at = F.date_format(F.when(F.col("event_type") != "error", F.date_trunc("hour", "ts")), "yyyy-MM-dd'T'HH:mm:ss")
    at = F.coalesce(at, F.concat(F.lit("unresolved:"), F.col("event_id").cast("string")))
    return e.select("event_id", C.uid("simultaneity", [(F.col("user_id").cast("string"), "string"), (at, "string")]).alias("uid"))


@register(
    "display_interleave",
    f"""WITH {UTTERANCES}, k AS (SELECT id, conv_id, role = 'system' AS context, CASE WHEN turn % 5 <> 3 THEN turn // 2 END AS t, turn FROM utt)
SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN context AND (turn = 0 OR t IS NULL) THEN 0 WHEN t IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN context AND turn = 0 THEN -1 ELSE coalesce(t, 0) END, CASE WHEN context AND turn = 0 THEN 0 WHEN context AND t IS NULL THEN 1 WHEN context THEN 0 ELSE 1 END, turn, id)::BIGINT AS place FROM k""",
)
def display_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's own context, untimed context, then by time with context first on ties, untimed rows last."""
    u = utterances(spark, sf_dir).select("id", "conv_id", (F.col("role") == "system").alias("context"), F.when(F.col("turn") % 5 != 3, F.floor(F.col("turn") / 2)).alias("t"), "turn")
    page, untimed, context = F.col("context") & (F.col("turn") == 0), F.col("t").isNull(), F.col("context")
    level = F.when(context & ((F.col("turn") == 0) | untimed), 0).when(~untimed, 1).otherwise(2)
    w = Window.partitionBy("conv_id").orderBy(level, F.when(page, -1).otherwise(F.coalesce("t", F.lit(0))), F.when(page, 0).when(context & untimed, 1).when(context, 0).otherwise(1), "turn", "id")
    return u.select("id", F.row_number().over(w).cast("long").alias("place"))


@register(
    "deduplicated_reverts",
    """WITH d AS (SELECT user_id, event_type, date_trunc('day', ts) AS t, min(event_id) AS id, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS i FROM d),
l AS (SELECT *, lag(i) OVER (PARTITION BY user_id, event_type ORDER BY i) AS p FROM s) SELECT id, user_id, n::BIGINT AS n_seen, (i - p - 1)::BIGINT AS n_reverted FROM l WHERE i - p > 1""",
)
def deduplicated_reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated sights of a revision become one before reverts are looked for; no grouped input is needed."""
    d = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_trunc("day", "ts").alias("t")).agg(F.min("event_id").alias("id"), F.count("*").alias("n_seen"))
    s = d.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "id")))
    l_ = s.withColumn("p", F.lag("i").over(Window.partitionBy("user_id", "event_type").orderBy("i")))
    return l_.where("i - p > 1").select("id", "user_id", "n_seen", (F.col("i") - F.col("p") - 1).cast("long").alias("n_reverted"))


_SIM = "0.9 + (l_partkey * 37 % 101) / 1000.0"


@register(
    "anchor_winners",
    f"""WITH c AS (SELECT l_orderkey AS k, l_suppkey AS anchor, l_linenumber AS v, {_SIM} AS s FROM lineitem), a AS (SELECT k, anchor, max(s) AS s FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, anchor) AS n FROM a),
t AS (SELECT k, max(CASE WHEN n = 1 THEN s END) AS best, coalesce(max(CASE WHEN n = 2 THEN s END), 0) AS second, max(CASE WHEN n = 1 THEN anchor END) AS anchor FROM r WHERE n <= 2 GROUP BY k)
SELECT k, anchor, round(best, 6) AS best, round(best - second, 6) AS margin, CASE WHEN round(best, 6) >= 0.985 AND (round(best - second, 6) >= 0.03 OR round(best, 6) >= 0.999) THEN 'high_confidence' WHEN round(best, 6) >= 0.94 AND round(best - second, 6) >= 0.02 THEN 'review' ELSE 'unresolved' END AS status FROM t""",
)
def anchor_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best variant of each anchor, then the two best anchors of a row, their margin and the decision."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("anchor"), F.expr(_SIM.replace("1000.0", "1000.0D").replace("0.9 ", "0.9D ")).alias("s"))
    a = c.groupBy("k", "anchor").agg(F.max("s").alias("s"))
    r = a.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "anchor"))).where("n <= 2")
    first = F.col("n") == 1
    t = r.groupBy("k").agg(F.max(F.when(first, F.col("s"))).alias("best"), F.coalesce(F.max(F.when(~first, F.col("s"))), F.lit(0.0)).alias("second"), F.max(F.when(first, F.col("anchor"))).alias("anchor"))
    t = t.select("k", "anchor", F.round("best", 6).alias("best"), F.round(F.col("best") - F.col("second"), 6).alias("margin"))
    b, m = F.col("best"), F.col("margin")
    return t.withColumn("status", F.when((b >= 0.985) & ((m >= 0.03) | (b >= 0.999)), "high_confidence").when((b >= 0.94) & (m >= 0.02), "review").otherwise("unresolved"))


@register(
    "top_and_forced",
    "WITH s AS (SELECT page_id, 3 * len(regexp_extract_all(html, '<a ')) + len(regexp_extract_all(html, '<img')) AS score FROM pages), t AS (SELECT page_id, score FROM s ORDER BY score DESC, page_id LIMIT 40), f AS (SELECT page_id, score FROM s WHERE page_id IN (SELECT max(page_id) FROM s)) SELECT page_id, score::BIGINT AS score FROM t UNION SELECT page_id, score::BIGINT FROM f",
)
def top_and_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the 40 best rows and those that must be there."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    s = table(spark, sf_dir, "pages").select("page_id", (3 * n("<a ") + n("<img")).cast("long").alias("score"))
    forced = s.groupBy().agg(F.max_by("score", "page_id").alias("score"), F.max("page_id").alias("page_id")).select("page_id", "score")
    return s.orderBy(F.desc("score"), "page_id").limit(40).unionByName(forced).distinct()


@register("title_order", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name, p_partkey")
def title_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by title without case, then exactly."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy(F.lower("p_name"), "p_name", "p_partkey")


@register("widened_union", "SELECT doc_id::BIGINT AS id, n_chars::DOUBLE AS value, NULL::VARCHAR AS kind FROM documents UNION ALL SELECT event_id, value, event_type FROM events")
def widened_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of both sides, missing ones null, numbers in the wider type."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("value"))
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value", F.col("event_type").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


_GRAPH = "g AS (SELECT doc_id AS node, CASE doc_id % 11 WHEN 0 THEN doc_id WHEN 1 THEN -doc_id - 1 WHEN 2 THEN doc_id + 1 WHEN 3 THEN doc_id - 1 WHEN 4 THEN NULL WHEN 5 THEN doc_id - 1 WHEN 6 THEN doc_id - 2 ELSE doc_id - 1 END AS parent FROM documents)"


@register(
    "lifecycle_checks",
    f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT node FROM g WHERE parent IS NULL OR parent NOT IN (SELECT node FROM g) UNION ALL SELECT g.node FROM g JOIN r ON g.parent = r.node),
c AS (SELECT parent, count(DISTINCT node) AS n FROM g WHERE parent IS NOT NULL GROUP BY 1)
SELECT g.node, coalesce(g.node = g.parent, false) AS self_reference, g.parent IS NOT NULL AND g.parent NOT IN (SELECT node FROM g) AS missing_parent, coalesce(c.n > 1, false) AS concurrent_branch, r.node IS NULL AS cycle FROM g LEFT JOIN c ON c.parent = g.node LEFT JOIN r ON r.node = g.node""",
)
def lifecycle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that refer to themselves, to nothing or in a circle, and parents with several children."""
    k, m = F.col("doc_id"), F.col("doc_id") % 11
    parent = F.when(m == 0, k).when(m == 1, -k - 1).when(m == 2, k + 1).when(m == 4, F.lit(None)).when(m == 6, k - 2).otherwise(k - 1)
    g = table(spark, sf_dir, "documents").select(k.alias("node"), parent.alias("parent"))
    children = g.where("parent IS NOT NULL").groupBy("parent").agg(F.count_distinct("node").alias("n")).withColumnRenamed("parent", "node")
    known = g.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    x = g.join(known, "parent", "left").join(children, "node", "left").join(rel.roots(g).select("node", "cycle"), "node")
    missing = F.col("parent").isNotNull() & F.col("known").isNull()
    return x.select("node", F.coalesce(F.col("node") == F.col("parent"), F.lit(False)).alias("self_reference"), missing.alias("missing_parent"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("concurrent_branch"), "cycle")


@register(
    "asof_with_uncertainty",
    """WITH c AS (SELECT user_id, max(ts) AS cut FROM events GROUP BY 1), a AS (SELECT e.*, c.cut, e.ts = c.cut AND e.event_type <> 'signup' AS unsure FROM events e JOIN c ON c.user_id = e.user_id WHERE e.ts <= c.cut)
SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) FILTER (NOT unsure) AS event_id, bool_or(unsure) AS uncertain FROM a GROUP BY 1""",
)
def asof_with_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest action at or before a cutoff; what happens at the cutoff itself and creates nothing is left out and makes the state uncertain."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    a = e.withColumn("cut", F.max("ts").over(Window.partitionBy("user_id"))).where("ts <= cut").withColumn("unsure", (F.col("ts") == F.col("cut")) & (F.col("event_type") != "signup"))
    last = F.max(F.when(~F.col("unsure"), F.struct("ts", "event_id")))["event_id"]
    return a.groupBy("user_id").agg(last.alias("event_id"), F.bool_or("unsure").alias("uncertain"))
