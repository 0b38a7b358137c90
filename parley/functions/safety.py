"""Method-B gate, selection and tiers as column expressions: evidence columns in, statuses with ordered reasons out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import truth

# What must be true, and what is said where it is not, in this order.
REQUIRED = (
    ("source_provenance_exact", "source_provenance_mismatch"),
    ("revision_metadata_exact", "revision_metadata_unproven"),
    ("parentid_verified", "true_parent_unverified"),
    ("local_hashes_verified", "local_content_hash_unverified"),
    ("deterministic_diff_available", "diff_unavailable"),
    ("changed_span_in_single_candidate", "changed_span_not_in_one_comment"),
    ("assignment_unique", "assignment_not_unique"),
    ("assignment_uncontested", "assignment_contested"),
    ("lifecycle_consistent", "lifecycle_inconsistent"),
    ("boundary_defensible", "boundary_not_defensible"),
)
AVAILABLE = ("available", "content_available", "exact_empty_root")
NEEDS_PREDECESSOR = ("creation", "addition", "modification", "restoration")
DISALLOWED = ("empty_candidate", "page_template", "section_heading", "terminal_signature", "unsigned_signature_residue")
SOFT = ("structure:terminal_signature", "structure:unsigned_signature_residue")
TIERS = ("historical_signature_fallback", "legacy_candidate_current_safety", "certified_source_artifact", "existing_current")


def multiset_difference(a: Column, b: Column) -> Column:
    """The elements of ``a`` that it has more often than ``b``, each once, sorted."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.array_sort(F.filter(F.array_distinct(a), lambda x: count(a, x) > count(b, x)))


def method_b(df: DataFrame) -> DataFrame:
    """``df`` with status, reasons and satisfied.

    Columns: action_type, target_availability, predecessor_availability, those of ``REQUIRED``, candidate_raw, candidate_body,
    flags (structural, an array), ambiguity (an array), and as far as there are such columns the rest of the evidence.
    """
    has = set(df.columns)
    yes = lambda name: truth(F.col(name)) if name in has else F.lit(False)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in has else F.lit("")
    blank = lambda name: F.length(F.trim(F.regexp_replace(text(name), r"\s", " "))) == 0
    kind = F.lower(text("action_type"))
    target, before = text("target_availability").isin(*AVAILABLE), text("predecessor_availability").isin(*AVAILABLE)
    needs = kind.isin(*NEEDS_PREDECESSOR)
    none = F.array().cast("array<string>")
    flags, ambiguity = (F.array_sort(F.array_distinct(F.coalesce(F.col(c), none))) if c in has else none for c in ("flags", "ambiguity"))
    unsigned = yes("explicit_unsigned_comment") & yes("closed_structural_boundaries")
    signed, expected = yes("signature_timestamp_consistent"), yes("signature_expected")
    offset, informative = yes("action_offset_consistent"), yes("action_offset_informative")
    continuity = yes("predecessor_target_comment_continuity")
    history = yes("restoration_reintroduction_verified") & yes("restoration_history_sufficient")
    aligned = yes("informative_fragment_aligned")
    parts = lambda c: F.coalesce(F.col(c), none) if c in has else none
    lost = F.size(multiset_difference(parts("trusted_critical"), parts("candidate_critical"))) > 0
    more = F.size(multiset_difference(parts("candidate_critical"), parts("trusted_critical"))) > 0
    why = [
        (~target, "target_content_unavailable"),
        (needs & ~before, "predecessor_content_unavailable"),
        *((~yes(key), reason) for key, reason in REQUIRED),
        (blank("candidate_raw") | blank("candidate_body"), "no_candidate"),
        *((yes(name), name) for name in ("adjacent_comment_contamination", "neighboring_comment_overlap", "page_level_structure_absorbed")),
        *((F.array_contains(flags, f), f"structure:{f}") for f in DISALLOWED),
        (expected & ~signed & ~unsigned, "signature_or_timestamp_inconsistent"),
        (informative & ~offset, "action_offset_contradiction"),
        ((kind == "modification") & ~continuity, "modification_continuity_unproven"),
        ((kind == "restoration") & ~history, "restoration_history_insufficient"),
        (aligned & lost, "critical_token_contradiction_missing"),
        (aligned & more, "critical_token_contradiction_added"),
        (F.size(ambiguity) > 0, "ambiguity_flags_present"),
    ]
    good = [
        (target, "target_content_available"),
        (before & ~(needs & ~before), "true_predecessor_content_available"),
        *((yes(key), key) for key, _ in REQUIRED),
        (expected & signed, "signature_timestamp_consistent"),
        (informative & offset, "action_offset_consistent"),
        ((kind == "modification") & continuity, "predecessor_target_comment_continuity"),
        ((kind == "restoration") & history, "restoration_history_verified"),
    ]
    named = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    gone = kind == "deletion"
    kept = F.when(yes("predecessor_side_evidence_retained"), F.array(F.lit("predecessor_side_evidence_retained"))).otherwise(none)
    df = df.withColumn("reasons", F.when(gone, F.array(F.lit("target_comment_not_applicable_for_deletion"))).otherwise(named(why)))
    df = df.withColumn("satisfied", F.when(gone, kept).otherwise(named(good)))
    r = F.col("reasons")
    status = (
        F.when(gone, "b_not_applicable")
        .when(F.array_contains(r, "no_candidate"), "b_no_candidate")
        .when(F.exists(r, lambda x: x.endswith("unavailable")), "b_unavailable")
        .when(F.arrays_overlap(r, F.array(*[F.lit(x) for x in ("ambiguity_flags_present", "assignment_not_unique", "assignment_contested")])), "b_ambiguous")
        .when(F.size(r) == 0, "b_safe")
        .when(F.forall(r, lambda x: x.isin(*SOFT)), "b_usable")
        .otherwise("b_review")
    )
    return df.withColumn("status", status)


def selectable(status: Column, reasons: Column, ambiguous: Column, body: Column) -> Column:
    """Whether Method B's text may be selected."""
    soft = (F.size(reasons) > 0) & F.forall(reasons, lambda x: x.isin(*SOFT))
    return F.coalesce(((status == "b_safe") | ((status == "b_usable") & soft)) & ~ambiguous & body.isNotNull(), F.lit(False))


def monotonic(df: DataFrame) -> DataFrame:
    """``df`` (a_status, a_text, b_selectable, b_text) with method, text and transition.

    A promoted text never changes; else the other method's, if it may be selected; else the text as it was.
    """
    promoted, b = F.col("a_status") == "promote", F.col("b_selectable")
    return df.withColumns(
        {
            "method": F.when(promoted, "method_a").when(b, "method_b").otherwise("method_a_fallback"),
            "text": F.when(~promoted & b, F.col("b_text")).otherwise(F.col("a_text")),
            "transition": F.when(promoted, "method_a_safe_unchanged").otherwise(F.concat("a_status", F.when(b, F.lit("_to_promote")).otherwise(F.lit("_preserved")))),
        }
    )


def recovery_tier(tier: Column, boundary: Column, provenance: Column, stripped: Column, mode: Column) -> Column:
    """The tier that a row names, else the one that its evidence shows."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    p = empty(provenance)
    return (
        F.when(tier.isin(*TIERS), tier)
        .when((empty(boundary) == "historical_signature_fallback") | p.startswith("historical_signature_fallback"), "historical_signature_fallback")
        .when((empty(boundary) == "legacy_timestamp_region_hypothesis") | p.startswith("legacy_candidate_current_safety"), "legacy_candidate_current_safety")
        .when(truth(stripped) | (empty(mode) == "certified_source_artifact"), "certified_source_artifact")
        .otherwise(F.coalesce(F.nullif(tier, F.lit("")), F.lit("existing_current")))
    )
