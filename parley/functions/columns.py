"""Scalar rules as column expressions, JVM side: coercions, classes, times, canonical JSON, intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
IPV6 = r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?::(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?$"
GREATEST = 2**63 - 1


def first_text(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def first_source(**texts: Column) -> Column:
    """Which of some texts is the first that is not blank."""
    return F.coalesce(*[F.when(F.trim(t) != "", F.lit(name)) for name, t in texts.items()])


def first_present(columns: list[str], *names: str) -> Column:
    """The first not empty value among those of some columns that a table has."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def truth(c: Column) -> Column:
    """1, true and yes in any case; all else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def three_state(c: Column) -> Column:
    """True, false, or null for what says neither."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False)


def whole(c: Column, default: int | None = None) -> Column:
    """A whole number, or the default."""
    n = F.trim(c.cast("string")).try_cast("long")
    return n if default is None else F.coalesce(n, F.lit(default))


def fraction(c: Column) -> Column:
    """A number, or null."""
    return F.trim(c.cast("string")).try_cast("double")


# -- canonical JSON ------------------------------------------------------------------------------------------------------


def json_part(c: Column, kind: str) -> Column:
    """One value as canonical JSON; strings stay strings and whole numbers numbers, so 1 and "1" differ."""
    if kind == "string":
        quoted = F.to_json(F.array(c))
        return F.when(c.isNull(), "null").otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))
    return F.coalesce(c.cast("string"), F.lit("null"))


def canonical_array(parts: list[tuple[Column, str]]) -> Column:
    """An ordered projection as compact JSON."""
    return F.concat(F.lit("["), F.concat_ws(",", *[json_part(c, kind) for c, kind in parts]), F.lit("]"))


def uid(namespace: str, parts: list[tuple[Column, str]]) -> Column:
    """A stable name of an entity, from the hash of its parts."""
    return F.concat(F.lit(f"{namespace}:v1:"), F.sha2(canonical_array(parts), 256))


# -- times ---------------------------------------------------------------------------------------------------------------


def instant(text: Column) -> Column:
    """A time of an ISO text, taken as UTC without a zone, or of the older day/month/year form; null for others.

    The session's time zone must be UTC.
    """
    t = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    iso = F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$")), t.try_cast("timestamp"))
    return F.coalesce(iso, F.try_to_timestamp(t, F.lit("dd/MM/yy HH:mm")))


def iso_of_unix(seconds: Column) -> Column:
    """The ISO text of seconds since 1970."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def signature_time(text: Column) -> Column:
    """The time of a signature, as in 12:34, 1 January 2020 (UTC)."""
    return F.try_to_timestamp(text, F.lit("H:mm, d MMMM yyyy '(UTC)'"))


def eastern_repair(shifted: Column) -> tuple[Column, Column]:
    """The UTC time of one that was written New York's offset too late, and how sure that is.

    Of the times 4 and 5 hours before, the one with that offset is right; near a change of the clock both or none can be.
    """
    def back(hours: int) -> Column:
        t = shifted - F.expr(f"INTERVAL {hours} HOUR")
        offset = (F.unix_timestamp(t) - F.unix_timestamp(F.from_utc_timestamp(t, "America/New_York"))) / 3600
        return F.when(offset == hours, t)

    four, five = back(4), back(5)
    both = four.isNotNull() & five.isNotNull()
    status = (
        F.when(shifted.isNull(), "creation_time_unavailable")
        .when(both, "dst_inverse_ambiguous")
        .when(four.isNull() & five.isNull(), "timezone_repair_failed")
        .otherwise("corrected_eastern_artifact")
    )
    return F.when(~both, F.coalesce(four, five)), status


# -- classes -------------------------------------------------------------------------------------------------------------


def _when(rules: list[tuple[Column, str]], other: str) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(other)


def tag_family(name: Column) -> Column:
    """The family of a dispute template; null without a name."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"^\{\{", ""), r"\}\}$", "")
    bare = F.regexp_replace(F.split_part(bare, F.lit("|"), F.lit(1)), "(?i)^(subst:|msg:)", "")
    c = F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "")
    npov = c.contains("npov") | c.contains("neutrality") | c.contains("neutralpointofview")
    rules = [(c.contains("totallydisputed"), "totally_disputed"), (npov, "neutral_point_of_view"), (c.contains("dispute"), "disputed"), (c.contains("accuracy") | c.contains("factual"), "factual_accuracy")]
    return F.when(F.coalesce(name, F.lit("")) != "", _when(rules, "other_dispute_template"))


def closure(value: Column) -> Column:
    """How a case was closed."""
    c = F.lower(value)
    rules = [(value.isNull(), "unknown"), (c.contains("fail"), "failure"), (c.contains("success") | c.contains("resolved"), "success"), (c.contains("withdraw"), "withdrawn"), (c.contains("general"), "general")]
    return _when(rules, "other")


def link_kind(target: Column) -> Column:
    """What a link target is."""
    low = F.lower(F.replace(target, F.lit("_"), F.lit(" ")))
    diff = low.contains("special:diff") | low.contains("oldid=") | low.contains("diff=")
    rules = [
        (low.startswith("user talk:"), "user_talk"),
        (low.startswith("user:"), "user"),
        (low.startswith("special:contributions"), "special_contributions"),
        (diff, "diff_revision"),
        (target.startswith("#"), "section_anchor"),
        (F.regexp_like(target, F.lit(r"^[A-Za-z]{2,11}:")) & ~F.regexp_like(low, F.lit("^(category|file|template):")), "interwiki"),
    ]
    return _when(rules, "article")


def actor_status(name: Column, number: Column, hidden: Column) -> Column:
    """What is known of who made a revision."""
    rules = [
        (F.coalesce(hidden, F.lit(False)), "revision_actor_hidden_or_deleted"),
        (F.coalesce(name, F.lit("")) == "", "revision_actor_not_observed"),
        (F.regexp_like(name, F.lit(IPV4)) | F.regexp_like(name, F.lit(IPV6)), "revision_actor_ip_observed"),
        (name.startswith("~"), "revision_actor_temporary_observed"),
        (number.isNull(), "revision_actor_name_observed_numeric_id_unavailable"),
    ]
    return _when(rules, "revision_actor_observed_rename_status_unchecked")


def title_key(title: Column) -> Column:
    """A title to compare by."""
    return F.lower(F.trim(F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), " +", " ")))


def user_key(name: Column) -> Column:
    """A user name to compare by, from its form in a URL."""
    return title_key(F.coalesce(F.try_url_decode(name), name))


def signature_match(targets: Column, actor: Column, hidden: Column) -> Column:
    """Whether the targets of a signature name the revision's actor."""
    named = F.filter(F.transform(targets, title_key), lambda t: t.isNotNull() & (t != ""))
    rules = [
        (F.coalesce(hidden, F.lit(False)), "revision_actor_hidden_or_deleted"),
        (F.coalesce(actor, F.lit("")) == "", "revision_actor_not_observed"),
        (F.size(named) == 0, "signature_identity_target_not_observed"),
        (F.array_contains(named, title_key(actor)), "exact_normalized_target_match"),
    ]
    return _when(rules, "observed_mismatch_or_rename")


def availability(page: Column, revision: Column) -> Column:
    """The state of a revision in an answer, from the JSON of its page and of itself."""
    has = lambda c, key: F.array_contains(F.json_object_keys(c), key)
    rules = [
        (F.coalesce(has(page, "missing"), F.lit(False)), "missing_page"),
        (revision.isNull(), "revision_not_returned"),
        (has(revision, "texthidden"), "suppressed_or_revision_deleted_text"),
        (~has(revision, "slots") & ~has(revision, "content"), "metadata_only"),
    ]
    return _when(rules, "content_available")


def cross_label(same: Column, verified: Column) -> Column:
    """What two contradicting labels of a case mean."""
    rules = [
        (F.coalesce(same, F.lit(False)) & F.coalesce(verified, F.lit(False)), "positive_formal_event_with_contradictory_source_provenance"),
        (~F.coalesce(same, F.lit(True)), "distinct_non_overlapping_episodes"),
    ]
    return _when(rules, "quarantined_episode_identity_unresolved")


def action_class(kind: Column) -> Column:
    """Creations, restorations, deletions; what else is named is a modification."""
    k = F.lower(F.trim(kind))
    rules = [
        (k.isin("creation", "original", "add", "addition", "insert", "new"), "addition"),
        (k.isin("restore", "restoration", "revert_restore"), "restoration"),
        (k.isin("delete", "deletion", "remove"), "deletion"),
        (F.coalesce(k, F.lit("")) != "", "modification"),
    ]
    return _when(rules, "unclassified")


def reasons(raw: Column) -> Column:
    """A JSON list or a text with bars between, as a sorted set."""
    parsed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))
    parts = F.transform(F.coalesce(parsed, F.split(raw, r"\|")), lambda x: F.trim(x))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), F.array().cast("array<string>"))


def contamination(status: Column) -> Column:
    """Clean, detected or unknown, from what can be a word, a number or empty."""
    s = F.lower(F.trim(status))
    rules = [(s.isin("clean", "", "0", "false", "no"), "clean"), (s.isin("detected", "1", "true", "yes"), "detected")]
    return _when(rules, "unknown")


# -- spans ---------------------------------------------------------------------------------------------------------------


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two half-open spans share a place."""
    return (a0 < b1) & (b0 < a1)


def merged(spans: Column) -> Column:
    """Sorted disjoint spans (start, end) that cover the same places."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, add)


def excerpt(text: Column, start: Column, end: Column, limit: int) -> Column:
    """At most ``limit`` characters around a span."""
    room = F.greatest(F.lit(limit) - (end - start), F.lit(0))
    first = F.greatest(start - F.floor(room / 2).cast("int"), F.lit(0))
    return F.substr(text, first + 1, F.lit(limit))


def preview(text: Column, limit: int) -> Column:
    """Blanks collapsed, and dots where it goes on."""
    even = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.when(F.length(even) <= limit, even).otherwise(F.concat(F.rtrim(F.substr(even, F.lit(1), F.lit(limit - 3))), F.lit("...")))


def occurrences(text: Column, needle: Column) -> Column:
    """How often a literal occurs, without overlaps."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))
