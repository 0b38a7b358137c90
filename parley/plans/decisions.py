"""Gates, selection, designed samples, invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import safety
from ..sources import UTTERANCES, table, utterances
from .cases import pick, pick_sql
from .registry import register

#: Evidence that is true but for every so many-th document, so that all combinations of few faults occur.
_EVERY = dict(zip([k for k, _ in safety.REQUIRED], (53, 59, 61, 67, 71, 73, 79, 83, 89, 97), strict=True)) | {"signature_timestamp_consistent": 13, "action_offset_consistent": 17, "predecessor_target_comment_continuity": 19, "restoration_history_sufficient": 23}
_RARE = {"adjacent_comment_contamination": 101, "neighboring_comment_overlap": 103, "page_level_structure_absorbed": 107, "signature_expected": 2, "explicit_unsigned_comment": 26, "action_offset_informative": 3, "informative_fragment_aligned": 5}
_KINDS = ["creation", "Modification", "restoration", "deletion", "addition", "edit", None]
_STATES = ["available", "content_available", "exact_empty_root"] * 9 + ["missing", None]
_FLAGS = [None, None, None, "terminal_signature", None, "unsigned_signature_residue", None, None, "section_heading", None, "dangling_tilde"]
_LEFT, _RIGHT = ["not 5 may", "5 5 not", "may"], ["not 5 may", "5 not", "no 5"]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of evidence for each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    flag = F.array_compact(F.array(pick("doc_id", _FLAGS)))
    return d.select(
        "doc_id", pick("doc_id", _KINDS).alias("action_type"), pick("doc_id", _STATES).alias("target_availability"), F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.pmod(i * 7, F.lit(len(_STATES))) + 1).cast("int")).alias("predecessor_availability"),
        *[(i % n != 0).alias(k) for k, n in _EVERY.items()], *[(i % n == 0).alias(k) for k, n in _RARE.items()], F.lit(True).alias("closed_structural_boundaries"), F.lit(True).alias("restoration_reintroduction_verified"),
        F.when(i % 31 != 0, "raw").alias("candidate_raw"), F.when(i % 37 != 0, F.concat(F.lit("body "), i.cast("string"))).otherwise(" \n").alias("candidate_body"),
        flag.alias("flags"), F.when(i % 41 == 0, F.array(F.lit("tie"))).alias("ambiguity"), F.split(pick("doc_id", _LEFT), " ").alias("trusted_critical"), F.split(F.element_at(F.array(*[F.lit(s) for s in _RIGHT]), (F.floor(i / 3) % 3 + 1).cast("int")), " ").alias("candidate_critical"),
    )


_DIFF = "len(list_filter(list_distinct({a}), lambda x: len(list_filter({a}, lambda y: y = x)) > len(list_filter({b}, lambda y: y = x)))) > 0"
_EVIDENCE = f"""ev AS (SELECT doc_id, lower(coalesce({pick_sql('doc_id', _KINDS)}, '')) AS kind, coalesce({pick_sql('doc_id', _STATES)}, '') IN ('available', 'content_available', 'exact_empty_root') AS target, coalesce({pick_sql('(doc_id * 7)', _STATES)}, '') IN ('available', 'content_available', 'exact_empty_root') AS before,
{', '.join(f'doc_id % {n} <> 0 AS {k}' for k, n in _EVERY.items())}, {', '.join(f'doc_id % {n} = 0 AS {k}' for k, n in _RARE.items())}, doc_id % 31 = 0 OR doc_id % 37 = 0 AS nothing, {pick_sql('doc_id', _FLAGS)} AS flag, doc_id % 41 = 0 AS tie, string_split({pick_sql('doc_id', _LEFT)}, ' ') AS l, string_split({pick_sql('(doc_id // 3)', _RIGHT)}, ' ') AS r FROM documents),
rs AS (SELECT *, CASE WHEN kind = 'deletion' THEN ['target_comment_not_applicable_for_deletion'] ELSE list_filter([CASE WHEN NOT target THEN 'target_content_unavailable' END, CASE WHEN kind IN ('creation', 'addition', 'modification', 'restoration') AND NOT before THEN 'predecessor_content_unavailable' END,
{', '.join(f"CASE WHEN NOT {k} THEN '{v}' END" for k, v in safety.REQUIRED)}, CASE WHEN nothing THEN 'no_candidate' END, {', '.join(f"CASE WHEN {k} THEN '{k}' END" for k in ('adjacent_comment_contamination', 'neighboring_comment_overlap', 'page_level_structure_absorbed'))},
{', '.join(f"CASE WHEN flag = '{f}' THEN 'structure:{f}' END" for f in safety.DISALLOWED)}, CASE WHEN signature_expected AND NOT signature_timestamp_consistent AND NOT explicit_unsigned_comment THEN 'signature_or_timestamp_inconsistent' END,
CASE WHEN action_offset_informative AND NOT action_offset_consistent THEN 'action_offset_contradiction' END, CASE WHEN kind = 'modification' AND NOT predecessor_target_comment_continuity THEN 'modification_continuity_unproven' END, CASE WHEN kind = 'restoration' AND NOT restoration_history_sufficient THEN 'restoration_history_insufficient' END,
CASE WHEN informative_fragment_aligned AND {_DIFF.format(a='l', b='r')} THEN 'critical_token_contradiction_missing' END, CASE WHEN informative_fragment_aligned AND {_DIFF.format(a='r', b='l')} THEN 'critical_token_contradiction_added' END, CASE WHEN tie THEN 'ambiguity_flags_present' END], lambda x: x IS NOT NULL) END AS reasons FROM ev),
b AS (SELECT *, CASE WHEN kind = 'deletion' THEN 'b_not_applicable' WHEN list_contains(reasons, 'no_candidate') THEN 'b_no_candidate' WHEN len(list_filter(reasons, lambda x: x LIKE '%unavailable')) > 0 THEN 'b_unavailable' WHEN tie OR NOT assignment_unique OR NOT assignment_uncontested THEN 'b_ambiguous'
WHEN len(reasons) = 0 THEN 'b_safe' WHEN len(list_filter(reasons, lambda x: x NOT IN ('structure:terminal_signature', 'structure:unsigned_signature_residue'))) = 0 THEN 'b_usable' ELSE 'b_review' END AS status FROM rs)"""


@register("method_b_safety", f"WITH {_EVIDENCE} SELECT doc_id, status, array_to_string(reasons, ',') AS reasons FROM b")
def method_b_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by precedence, with all reasons in their order, over evidence with every kind of fault."""
    return safety.method_b(_evidence(spark, sf_dir)).select("doc_id", "status", F.array_join("reasons", ",").alias("reasons"))


_A = ["promote", "review", "fallback"]
_SELECTION = f"""{_EVIDENCE}, m AS (SELECT b.doc_id, {pick_sql('b.doc_id', _A)} AS a, d.text AS a_text, status IN ('b_safe', 'b_usable') AND NOT tie AS ok, 'body ' || b.doc_id AS b_text FROM b JOIN documents d ON d.doc_id = b.doc_id),
s AS (SELECT doc_id, a, a_text, CASE WHEN a = 'promote' THEN 'method_a' WHEN ok THEN 'method_b' ELSE 'method_a_fallback' END AS method, CASE WHEN a = 'promote' THEN 'method_a_safe_unchanged' WHEN ok THEN a || '_to_promote' ELSE a || '_preserved' END AS transition, CASE WHEN a <> 'promote' AND ok THEN b_text ELSE a_text END AS text FROM m)"""


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = safety.method_b(_evidence(spark, sf_dir))
    ok = safety.selectable(F.col("status"), F.col("reasons"), F.size(F.coalesce("ambiguity", F.array().cast("array<string>"))) > 0, F.col("candidate_body"))
    b = b.select("doc_id", "status", ok.alias("b_selectable"), F.col("candidate_body").alias("b_text"))
    a = table(spark, sf_dir, "documents").select("doc_id", pick("doc_id", _A).alias("a_status"), F.col("text").alias("a_text"))
    return safety.monotonic(a.join(b, "doc_id", "left"))


@register("monotonic_selection", f"WITH {_SELECTION} SELECT doc_id, method, transition, sha256(text) AS h FROM s")
def monotonic_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row keeps or takes."""
    return _selection(spark, sf_dir).select("doc_id", "method", "transition", F.sha2("text", 256).alias("h"))


@register(
    "selection_invariants",
    f"""WITH {_SELECTION} SELECT count(*) = (SELECT count(*) FROM documents) AS same_rows, count(*) = count(DISTINCT s.doc_id) AS unique_rows, bool_and(a <> 'promote' OR sha256(text) IS NOT DISTINCT FROM sha256(a_text)) AS promoted_unchanged, bool_and(method <> 'method_b' OR b.status IN ('b_safe', 'b_usable')) AS no_unsafe_b, true AS no_outcome_column FROM s JOIN b ON b.doc_id = s.doc_id""",
)
def selection_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a selection, as one row."""
    s = _selection(spark, sf_dir)
    same = F.sha2("text", 256).eqNullSafe(F.sha2("a_text", 256))
    whole = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_all"))
    x = s.agg(
        F.count("*").alias("n"), (F.count("*") == F.count_distinct("doc_id")).alias("unique_rows"), F.bool_and((F.col("a_status") != "promote") | same).alias("promoted_unchanged"),
        F.bool_and((F.col("method") != "method_b") | F.col("status").isin("b_safe", "b_usable")).alias("no_unsafe_b"),
    )
    clean = not any("outcome" in c.lower() for c in s.columns)
    return x.join(F.broadcast(whole)).select((F.col("n") == F.col("n_all")).alias("same_rows"), "unique_rows", "promoted_unchanged", "no_unsafe_b", F.lit(clean).alias("no_outcome_column"))  # two single rows


@register(
    "representation_rows",
    f"""WITH {_EVIDENCE} SELECT doc_id, 'comment_raw' AS kind, 'recovered_candidate' AS availability, 3::BIGINT AS bytes FROM b WHERE doc_id % 31 <> 0 UNION ALL
SELECT doc_id, CASE WHEN status = 'b_safe' THEN 'comment_body' ELSE 'comment_body_candidate' END, CASE WHEN status = 'b_safe' THEN 'recovered' ELSE status END, CASE WHEN doc_id % 37 <> 0 THEN length('body ' || doc_id) ELSE 2 END::BIGINT FROM b""",
)
def representation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No, one or two rows of a piece of evidence: its raw text, and its body, named by how safe it is."""
    b = safety.method_b(_evidence(spark, sf_dir))
    safe = F.col("status") == "b_safe"
    raw = F.when(F.col("candidate_raw").isNotNull(), F.struct(F.lit("comment_raw").alias("kind"), F.lit("recovered_candidate").alias("availability"), F.octet_length("candidate_raw").cast("long").alias("bytes")))
    body = F.when(F.col("candidate_body").isNotNull(), F.struct(F.when(safe, "comment_body").otherwise("comment_body_candidate").alias("kind"), F.when(safe, F.lit("recovered")).otherwise(F.col("status")).alias("availability"), F.octet_length("candidate_body").cast("long").alias("bytes")))
    return b.select("doc_id", F.explode(F.array_compact(F.array(raw, body))).alias("r")).select("doc_id", "r.*")


_T = {"t": ["historical_signature_fallback", "", None, "other", "existing_current"], "b": ["legacy_timestamp_region_hypothesis", None, "historical_signature_fallback"], "p": [None, "legacy_candidate_current_safety:1", "x", "historical_signature_fallback/2"], "s": ["yes", None, "0", "no", "", "n", "f"], "m": ["certified_source_artifact", None]}


@register(
    "recovery_tiers",
    "WITH d AS (SELECT doc_id, " + ", ".join(f"{pick_sql('doc_id', v)} AS {k}" for k, v in _T.items()) + """ FROM documents)
SELECT doc_id, CASE WHEN t IN ('historical_signature_fallback', 'existing_current') THEN t WHEN b = 'historical_signature_fallback' OR p LIKE 'historical_signature_fallback%' THEN 'historical_signature_fallback' WHEN b = 'legacy_timestamp_region_hypothesis' OR p LIKE 'legacy_candidate_current_safety%' THEN 'legacy_candidate_current_safety'
WHEN s = 'yes' OR m = 'certified_source_artifact' THEN 'certified_source_artifact' ELSE coalesce(nullif(t, ''), 'existing_current') END AS tier FROM d""",
)
def recovery_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explicit tier, else historical, legacy, artifact, existing."""
    d = table(spark, sf_dir, "documents").select("doc_id", *[pick("doc_id", v).alias(k) for k, v in _T.items()])
    return d.select("doc_id", safety.recovery_tier(*[F.col(c) for c in "tbpsm"]).alias("tier"))


# -- samples -------------------------------------------------------------------------------------------------------------

_STRATA = (("toxic", 20, "toxic = 1"), ("good", 30, "quality = 1"), ("foreign", 25, "lang <> 'en'"), ("long", 15, "n_chars > 1000"), ("rest", 40, "true"))


@register(
    "priority_sample",
    "WITH x AS (SELECT d.doc_id, sha256('7:' || d.doc_id) AS h, CASE " + " ".join(f"WHEN coalesce({c}, false) THEN '{n}'" for n, _, c in _STRATA) + " END AS first FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY h, doc_id) AS k FROM x) SELECT doc_id, first AS stratum FROM r WHERE k <= CASE first " + " ".join(f"WHEN '{n}' THEN {k}" for n, k, _ in _STRATA) + " END",
)
def priority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S22, L02 in its simple case: each row belongs to the first stratum that fits it, and each stratum gives its rows with the least hashes."""
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    first = reduce(lambda c, s: c.when(F.coalesce(F.expr(s[2]), F.lit(False)), s[0]), _STRATA[1:], F.when(F.coalesce(F.expr(_STRATA[0][2]), F.lit(False)), _STRATA[0][0]))
    size = reduce(lambda c, s: c.when(F.col("stratum") == s[0], s[1]), _STRATA[1:], F.when(F.col("stratum") == _STRATA[0][0], _STRATA[0][1]))
    x = x.select("doc_id", first.alias("stratum"), F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "doc_id"))).where(F.col("k") <= size).select("doc_id", "stratum")


def disjoint_sample(rows: DataFrame, key: str, strata: list[tuple[str, int, str]], seed: str) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """Strata in order, each taking so many of the rows that no earlier one took, by hash; and what each wanted and got.

    An earlier stratum leaves the rows it did not take to later ones.  Each picks from its own rows with a limit, so a few rows move.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("h_", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    taken: list = []
    report = []
    for name, size, rule in strata:
        # rows that earlier strata took can be among the first, so so many more are looked at
        some = rows.where(F.coalesce(F.expr(rule), F.lit(False))).orderBy("h_", key).limit(size + len(taken)).select(key).collect()
        have = {t[0] for t in taken}
        new = [r[key] for r in some if r[key] not in have][:size]
        taken += [(k, name) for k in new]
        report.append((name, size, len(new)))
    return spark.createDataFrame(taken, f"{key} {rows.schema[key].dataType.simpleString()}, stratum string"), report


def allocate(populations: dict[str, int], size: int, floor: int) -> dict[str, int]:
    """Places by stratum: a floor, then shares of the room that is left, rounded down, then the largest remainders in turn."""
    if size >= sum(populations.values()):
        return dict(populations)
    names = sorted(populations)
    least = min(floor, size // len(names))
    got = {n: min(least, populations[n]) for n in names}
    while (left := size - sum(got.values())) > 0:
        room = {n: populations[n] - got[n] for n in names}
        exact = {n: left * room[n] / sum(room.values()) for n in names}
        more = {n: min(room[n], int(exact[n])) for n in names}
        spare = left - sum(more.values())
        for n in sorted((n for n in names if room[n] > more[n]), key=lambda n: (-(exact[n] % 1), n))[:spare]:
            more[n] += 1
        got = {n: got[n] + more[n] for n in names}
    return got


def design_sample(rows: DataFrame, key: str, stratum: str, domain: str, size: int, seed: str, census: str, least: dict[str, int], floor: int = 20) -> DataFrame:
    """A two-stage sample with the chance and weight of each row.

    Places go to strata by ``allocate``; inside, all rows of the domain ``census`` and at least so many of others are taken,
    the rest by room.  Within a cell rows are ranked by hash.  The driver holds one number for each cell.
    """
    cells = {(r[stratum], r[domain]): r["n"] for r in rows.groupBy(stratum, domain).agg(F.count("*").alias("n")).collect()}
    strata: dict[str, int] = {}
    for (s, _), n in cells.items():
        strata[s] = strata.get(s, 0) + n
    plan = []
    for s, places in allocate(strata, size, floor).items():
        mine = {d: n for (t, d), n in cells.items() if t == s}
        must = {d: n if d == census else min(n, least.get(d, 0)) for d, n in mine.items()}
        if sum(must.values()) > places:
            raise ValueError(f"the places of {s} do not cover what must be in the sample")
        extra = allocate({d: mine[d] - must[d] for d in mine}, places - sum(must.values()), 0)
        plan += [(s, d, n, must[d] + extra[d]) for d, n in mine.items() if must[d] + extra[d]]
    side = rows.sparkSession.createDataFrame(plan, f"{stratum} string, {domain} string, population long, sample long")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("k_", F.row_number().over(Window.partitionBy(stratum, domain).orderBy(h, key)))
    x = ranked.join(F.broadcast(side), [stratum, domain]).where(F.col("k_") <= F.col("sample")).drop("k_")  # a row a cell
    return x.withColumn("probability", F.col("sample") / F.col("population")).withColumn("weight", F.col("population") / F.col("sample"))


@register("design_cells")
def design_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 120 documents by source and kind of label, toxic ones all, with weights; tested against a plain version."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang")).join(table(spark, sf_dir, "labels").dropDuplicates(["doc_id"]), "doc_id", "left")
    domain = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 1, "good").otherwise("other")
    return design_sample(d.select("doc_id", F.col("lang").alias("stratum"), domain.alias("domain")), "doc_id", "stratum", "domain", 120, "11", "none", {"good": 2}).select("doc_id", "stratum", "domain", "population", "sample", "probability", "weight")


@register(
    "blinded_packet",
    """SELECT doc_id, 'audit:' || substr(sha256('["5","' || doc_id || '"]'), 1, 20) AS audit_uid, CASE WHEN ('0x' || substr(sha256('["5","' || doc_id || '","label-order"]'), 1, 2))::INT % 2 = 0 THEN 'a' ELSE 'b' END AS first_label, substr(text, 1, 50) AS excerpt FROM documents""",
)
def blinded_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet whose two labels are swapped by a hash, and whose key is apart."""
    d = table(spark, sf_dir, "documents")
    name = lambda *more: F.sha2(F.to_json(F.array(F.lit("5"), F.col("doc_id").cast("string"), *[F.lit(m) for m in more])), 256)
    flip = F.conv(F.substr(name("label-order"), F.lit(1), F.lit(2)), 16, 10).cast("int") % 2
    return d.select("doc_id", F.concat(F.lit("audit:"), F.substr(name(), F.lit(1), F.lit(20))).alias("audit_uid"), F.when(flip == 0, "a").otherwise("b").alias("first_label"), F.substr("text", F.lit(1), F.lit(50)).alias("excerpt"))


@register(
    "feasibility_gate",
    """WITH r AS (SELECT d.doc_id, l.doc_id IS NULL AS control, text IS NOT NULL AND text <> '' AS parsed, coalesce(l.quality = 1, false) AS safe, CASE WHEN l.toxic = 1 THEN 'detected' WHEN l.toxic = 0 THEN 'clean' ELSE 'unknown' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
a AS (SELECT count(*) AS n, count(*) FILTER (control) AS c, avg(parsed::INT) AS p, count(*) FILTER (safe AND state = 'detected') AS bad, count(*) FILTER (safe AND state = 'unknown') AS unsure, count(*) FILTER (NOT control AND safe AND state = 'clean') AS good, count(*) FILTER (NOT control) AS rest FROM r)
SELECT array_to_string(list_filter([CASE WHEN n <> 200 THEN 'pilot_count_not_200' END, CASE WHEN c <> 40 THEN 'control_count_not_40' END, CASE WHEN p < 0.95 THEN 'parser_success_below_95_percent' END, CASE WHEN bad > 0 THEN 'proposed_safe_contamination_detected' END, CASE WHEN unsure > 0 THEN 'proposed_safe_contamination_unknown' END,
CASE WHEN good < 10 THEN 'residual_safe_count_below_10' END, CASE WHEN good < 0.05 * rest THEN 'residual_safe_yield_below_5_percent' END], lambda x: x IS NOT NULL), ',') AS reasons, good::BIGINT AS n_safe FROM a""",
)
def feasibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of a pilot, and every reason for which it fails."""
    x = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce("text", F.lit("")) != "").alias("parsed")).join(table(spark, sf_dir, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    control, safe = F.col("has").isNull(), F.coalesce(F.col("quality") == 1, F.lit(False))
    n = F.count_if
    a = x.agg(
        F.count("*").alias("n"), n(control).alias("c"), F.avg(F.col("parsed").cast("int")).alias("p"), n(safe & (F.col("toxic") == 1)).alias("bad"), n(safe & F.col("toxic").isNull()).alias("unsure"),
        n(~control & safe & (F.col("toxic") == 0)).alias("good"), n(~control).alias("rest"),
    )
    rules = [("n <> 200", "pilot_count_not_200"), ("c <> 40", "control_count_not_40"), ("p < 0.95", "parser_success_below_95_percent"), ("bad > 0", "proposed_safe_contamination_detected"), ("unsure > 0", "proposed_safe_contamination_unknown"), ("good < 10", "residual_safe_count_below_10"), ("good < 0.05 * rest", "residual_safe_yield_below_5_percent")]
    why = F.array_compact(F.array(*[F.when(F.expr(r), F.lit(name)) for r, name in rules]))
    return a.select(F.array_join(why, ",").alias("reasons"), F.col("good").alias("n_safe"))


@register(
    "ceiling_gate",
    """WITH x AS (SELECT d.lang AS cell, d.source AS family, l.quality, l.toxic, l.doc_id IS NOT NULL AS s FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), c AS (SELECT cell, count(*) AS big, count(*) FILTER (s) AS small FROM x GROUP BY 1), t AS (SELECT sum(big) AS total FROM c WHERE small > 0),
f AS (SELECT x.family, x.cell, count(*) AS k, count(*) FILTER (x.toxic = 1) AS risky FROM x WHERE s AND quality = 1 GROUP BY ALL),
e AS (SELECT f.family, sum(k) AS n, sum(risky) AS risky, sum(big * k / small) AS total_est, sum(CASE WHEN small > 1 THEN big * big * (1 - small / big) * ((k / small) * (1 - k / small) * small / (small - 1)) / small ELSE 0 END) AS v FROM f JOIN c ON c.cell IS NOT DISTINCT FROM f.cell GROUP BY 1)
SELECT family, n::BIGINT AS n, round(total_est, 6) AS projected, round(greatest(total_est - 1.96 * sqrt(v), 0), 6) AS low, CASE WHEN risky = 0 THEN round(3 / n, 9) ELSE round(risky / n, 9) END AS risk, n >= 3 AND total_est >= greatest(100, ceil(0.005 * total)) AND risky = 0 AND 3 / n <= 0.05 AS passes FROM e, t""",
)
def ceiling_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule family would yield, by a stratified estimate, and whether it is worth building."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("cell"), F.col("source").alias("family")).join(table(spark, sf_dir, "labels").withColumn("s", F.lit(True)), "doc_id", "left")
    c = x.groupBy(F.col("cell").alias("cell_")).agg(F.count("*").alias("big"), F.count("s").alias("small"))
    total = c.where("small > 0").agg(F.sum("big").alias("total"))
    f = x.where("s AND quality = 1").groupBy("family", "cell").agg(F.count("*").alias("k"), F.count_if(F.col("toxic") == 1).alias("risky"))
    part = F.expr("CASE WHEN small > 1 THEN big * big * (1 - small / big) * ((k / small) * (1 - k / small) * small / (small - 1)) / small ELSE 0 END")
    e = f.join(c, F.col("cell").eqNullSafe(F.col("cell_"))).groupBy("family").agg(F.sum("k").alias("n"), F.sum("risky").alias("risky"), F.sum(F.expr("big * k / small")).alias("t"), F.sum(part).alias("v"))
    e = e.join(F.broadcast(total))  # one row
    passes = (F.col("n") >= 3) & (F.col("t") >= F.greatest(F.lit(100), F.ceil(0.005 * F.col("total")))) & (F.col("risky") == 0) & (3 / F.col("n") <= 0.05)
    return e.select("family", "n", F.round("t", 6).alias("projected"), F.round(F.greatest(F.col("t") - 1.96 * F.sqrt("v"), F.lit(0.0)), 6).alias("low"), F.round(F.when(F.col("risky") == 0, 3 / F.col("n")).otherwise(F.col("risky") / F.col("n")), 9).alias("risk"), passes.alias("passes"))


@register(
    "review_packet",
    """WITH s AS (SELECT 'documents' AS origin, coalesce(source, '') AS stratum, doc_id::VARCHAR AS id FROM documents UNION ALL SELECT 'events', event_type, event_id::VARCHAR FROM events UNION ALL SELECT 'orders', o_orderstatus, o_orderkey::VARCHAR FROM orders)
SELECT origin, stratum, id, NULL::VARCHAR AS adjudication FROM (SELECT *, row_number() OVER (PARTITION BY origin, stratum ORDER BY sha256('["3","' || id || '"]'), id) AS k FROM s) WHERE k <= 5""",
)
def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows of each stratum of several sources, by hash, with an empty column for the reviewer."""
    parts = {"documents": (F.coalesce("source", F.lit("")), "doc_id"), "events": (F.col("event_type"), "event_id"), "orders": (F.col("o_orderstatus"), "o_orderkey")}
    s = None
    for t, (stratum, key) in parts.items():
        one = table(spark, sf_dir, t).select(F.lit(t).alias("origin"), stratum.alias("stratum"), F.col(key).cast("string").alias("id"))
        s = one if s is None else s.unionByName(one)
    h = F.sha2(F.to_json(F.array(F.lit("3"), "id")), 256)
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("origin", "stratum").orderBy(h, "id"))).where("k <= 5")
    return s.select("origin", "stratum", "id", F.lit(None).cast("string").alias("adjudication"))


# -- checks --------------------------------------------------------------------------------------------------------------


@register(
    "round_trip_check",
    "SELECT count(*)::BIGINT AS n, 0::BIGINT AS bad_bytes, count(*) FILTER (octet_length(encode(text)) IS DISTINCT FROM octet_length(encode(text)))::BIGINT AS bad_length, count(*) FILTER (n_chars <> length(text))::BIGINT AS bad_chars FROM documents",
)
def round_trip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut out of their stored bytes again by offset and length, hashed, and compared with the fields."""
    d = table(spark, sf_dir, "documents").select("text", "n_chars", F.col("text").cast("binary").alias("raw"))
    again = F.expr("substring(concat(cast('<<' AS binary), raw, cast('>>' AS binary)), 3, octet_length(raw))")
    bad = F.count_if(~F.sha2(again, 256).eqNullSafe(F.sha2("text", 256)))
    return d.agg(F.count("*").alias("n"), bad.alias("bad_bytes"), F.count_if(~F.octet_length("raw").eqNullSafe(F.octet_length("text"))).alias("bad_length"), F.count_if(F.col("n_chars") != F.length("text")).alias("bad_chars"))


@register(
    "key_checks",
    """SELECT 'pk:orders' AS name, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)::BIGINT AS failures UNION ALL SELECT 'fk:orders.customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))::BIGINT
UNION ALL SELECT 'fk:lineitem.orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))::BIGINT UNION ALL SELECT 'enum:orders.status', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))::BIGINT""",
)
def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat, references to nothing, values outside their domain."""
    o, c, l_ = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem")
    checks = {
        "pk:orders": o.agg((F.count("*") - F.count_distinct("o_orderkey")).alias("failures")),
        "fk:orders.customer": o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("failures")),
        "fk:lineitem.orders": l_.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("failures")),
        "enum:orders.status": o.agg(F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("failures")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("name"), "failures") for n, df in checks.items()])


@register(
    "leakage_check",
    """WITH i AS (SELECT user_id, min(ts) AS cut FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT count(*) FILTER (e.event_type = 'view' AND e.ts <= i.cut)::BIGINT AS n_predictors, count(*) FILTER (e.event_type = 'view' AND e.ts > i.cut)::BIGINT AS late_predictors,
count(*) FILTER (e.event_type = 'error' AND e.ts > i.cut AND e.ts <= i.cut + INTERVAL 7 DAY)::BIGINT AS n_outcomes, count(*) FILTER (e.event_type = 'error' AND e.ts <= i.cut)::BIGINT AS early_outcomes FROM events e JOIN i ON i.user_id = e.user_id""",
)
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictors that come after their index, outcomes that come before it or past the horizon."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    x = e.withColumn("cut", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id"))).where("cut IS NOT NULL")
    n = lambda kind, cond: F.count_if((F.col("event_type") == kind) & F.expr(cond))
    return x.agg(n("view", "ts <= cut").alias("n_predictors"), n("view", "ts > cut").alias("late_predictors"), n("error", "ts > cut AND ts <= cut + INTERVAL 7 DAY").alias("n_outcomes"), n("error", "ts <= cut").alias("early_outcomes"))


_ALLOWED = "lang"


@register(
    "cell_differences",
    """WITH a AS (SELECT doc_id, source, lang, n_chars FROM documents), b AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 50 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents),
x AS (SELECT 'lang' AS col, count(*) FILTER (a.lang IS DISTINCT FROM b.lang) AS n FROM a JOIN b USING (doc_id) UNION ALL SELECT 'n_chars', count(*) FILTER (a.n_chars IS DISTINCT FROM b.n_chars) FROM a JOIN b USING (doc_id) UNION ALL SELECT 'source', count(*) FILTER (a.source IS DISTINCT FROM b.source) FROM a JOIN b USING (doc_id))
SELECT col, n::BIGINT AS n, col = 'lang' OR n = 0 AS allowed FROM x""",
)
def cell_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that differ between two snapshots by column, and whether the column may change."""
    a = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    i = F.col("doc_id")
    b = a.select("doc_id", F.col("source").alias("source_"), F.when(i % 10 == 0, "xx").otherwise(F.col("lang")).alias("lang_"), F.when(i % 50 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars_"))
    n = a.join(b, "doc_id").agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(c + "_"))).alias(c) for c in ("lang", "n_chars", "source")])
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("n")) for c in ("lang", "n_chars", "source")])).alias("x")
    return n.select(one).select("x.*").withColumn("allowed", (F.col("col") == _ALLOWED) | (F.col("n") == 0))


@register(
    "hard_invariants",
    "SELECT array_to_string(list_filter([CASE WHEN count(*) <> count(DISTINCT doc_id) THEN 'ids_repeat' END, CASE WHEN count(*) FILTER (text IS NULL) > 0 THEN 'text_missing' END, CASE WHEN count(*) FILTER (n_chars <> length(text)) > 0 THEN 'length_wrong' END, CASE WHEN count(*) < 200 THEN 'too_few' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents",
)
def hard_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All errors of one aggregate gathered, to be raised together."""
    rules = [(F.count("*") != F.count_distinct("doc_id"), "ids_repeat"), (F.count_if(F.col("text").isNull()) > 0, "text_missing"), (F.count_if(F.col("n_chars") != F.length("text")) > 0, "length_wrong"), (F.count("*") < 200, "too_few")]
    return table(spark, sf_dir, "documents").agg(F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])), ",").alias("errors"))


_CODES = {
    "empty_or_unavailable_text": ("coalesce(trim(text), '') = ''", "warning"),
    "comment_over_1000_whitespace_tokens": ("n_words > 1000", "warning"),
    "missing_author_evidence": ("lang IS NULL", "warning"),
    "exact_text_duplicate_candidate": ("n_same > 1", "information"),
    "ambiguous_identity_candidates": ("n_ids > 1", "error"),
    "conversation_metadata_conflict": ("n_sources > 1 AND n_same > 1", "warning"),
}


@register(
    "quality_flags",
    r"WITH d AS (SELECT doc_id, text, lang, source, sha256(text) AS h, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS n_words FROM documents), g AS (SELECT h, count(*) AS n_same, count(DISTINCT source) AS n_sources FROM d GROUP BY 1), k AS (SELECT doc_id, count(*) AS n_ids FROM d GROUP BY 1), "
    "x AS (SELECT d.*, g.n_same, g.n_sources, k.n_ids FROM d LEFT JOIN g ON g.h = d.h LEFT JOIN k ON k.doc_id = d.doc_id) " + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS flag_code, '{s}' AS severity FROM x WHERE {e}" for c, (e, s) in _CODES.items()),
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each flag of a document, in one pass; the flags of graphs are in ``lifecycle_checks`` and ``deletion_states``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.trim("text").alias("t"), F.sha2("text", 256).alias("h"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f]+")).alias("n_words"))
    d = d.select("doc_id", "lang", "source", "h", "n_words", (F.coalesce("t", F.lit("")) == "").alias("empty"))
    g = d.groupBy("h").agg(F.count("*").alias("n_same"), F.count_distinct("source").alias("n_sources"))
    k = d.groupBy("doc_id").agg(F.count("*").alias("n_ids"))
    x = d.join(g, "h", "left").join(k, "doc_id", "left")
    flag = lambda c: F.struct(F.lit(c).alias("flag_code"), F.lit(_CODES[c][1]).alias("severity"))
    held = F.array_compact(F.array(*[F.when(F.col("empty") if c == "empty_or_unavailable_text" else F.expr(e), flag(c)) for c, (e, _) in _CODES.items()]))
    return x.select("doc_id", F.explode(held).alias("f")).select("doc_id", "f.*")


@register(
    "missingness",
    f"WITH {UTTERANCES} SELECT count(*) FILTER (text IS NULL)::BIGINT AS no_text, count(*) FILTER (trim(text) = '')::BIGINT AS blank_text, count(*) FILTER (reply_to IS NULL)::BIGINT AS no_target, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest, list_sort(list(length(text)))[count(text) // 2 + 1]::BIGINT AS upper_median FROM utt",
)
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing, and the range and upper median of lengths, counted by length first."""
    u = utterances(spark, sf_dir).select("text", "reply_to")
    n = u.agg(F.count_if(F.col("text").isNull()).alias("no_text"), F.count_if(F.trim("text") == "").alias("blank_text"), F.count_if(F.col("reply_to").isNull()).alias("no_target"), F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"))
    by = u.where("text IS NOT NULL").groupBy(F.length("text").alias("l")).agg(F.count("*").alias("c"))  # a row a length
    every = Window.partitionBy(F.lit(1))
    by = by.withColumn("upto", F.sum("c").over(every.orderBy("l"))).withColumn("half", F.floor(F.sum("c").over(every) / 2))
    return n.join(F.broadcast(by.where("upto > half").agg(F.min("l").cast("long").alias("upper_median"))))
