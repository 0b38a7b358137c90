"""Wikitext, alignment and the promotion gate, on the cases that fix their rules."""

import random
from difflib import SequenceMatcher

from parley.functions import alignment, text, wikitext

CONFIDENT = {"recovery_status": "high_confidence", "target_coverage": 1.0, "candidate_purity": 1.0, "signature_residue_detected": False}


def test_promotion_gate():
    whole = "The complete substantive comment."
    for tier, want in (("legacy_candidate_current_safety", "review"), ("historical_signature_fallback", "promote"), ("certified_source_artifact", "promote")):
        got = alignment.assess(whole, whole, {**CONFIDENT, "recovery_tier": tier})
        assert got["decision"] == want and ("legacy_candidate_raw_boundary_unvalidated" in got["reasons"]) == (want == "review")
    linked = "See [[Wikipedia:Neutral point of view|Neutral point of view]] and [https://example.test/source this source] for the relevant policy."
    got = alignment.assess("See Neutral point of view and this source for the relevant policy.", linked, CONFIDENT)
    assert got["decision"] == "promote" and got["retention"] == 1.0
    got = alignment.assess("P^NP is not (proven to be) the same class as NP. I haven't discussed the paper.", "P^NP is not the same class as NP. I have discussed the paper.", CONFIDENT)
    assert got["decision"] == "review" and "critical_token_loss" in got["reasons"] and "n't" in got["missing"]
    got = alignment.assess("NOTE: The account was blocked, but useful edits still need careful review.", ":::::NOTE:", CONFIDENT)
    assert got["decision"] == "review" and "substantive_token_loss" in got["reasons"]
    got = alignment.assess(whole, f"{whole}\n\n== Next section ==\n{{{{UnsignedIP|192.0.2.1}}}}", CONFIDENT)
    assert got["decision"] == "review" and {"structure:section_heading", "structure:unsigned_signature_residue"} <= set(got["reasons"])
    next_one = "The next editor instead discusses a completely separate proposal with many details."
    got = alignment.assess(whole, f"{whole} {next_one}", CONFIDENT, [None, next_one])
    assert got["decision"] == "review" and got["reasons"][-1] == "adjacent_utterance_contamination"
    assert alignment.assess(whole, whole, {**CONFIDENT, "recovery_status": "review"})["reasons"] == ["v33_not_high_confidence"]
    assert alignment.assess(whole, whole, {"recovery_status": "review"})["decision"] == "fallback"
    assert alignment.assess(None, None, CONFIDENT)["reasons"] == ["empty_candidate", "structure:empty_candidate"]


def test_promotion_gate_leaves_out_named_artifacts():
    whole = "The complete comment."
    cases = [
        ("— Preceding unsigned comment added by 192.0.2.1", "terminal_unsigned_attribution"),
        ("Best wishes", "terminal_valediction_artifact"),
        ("66.31.39.76", "terminal_bare_ipv4_after_sentence"),
        ("– ·", "terminal_signature_glyphs"),
        ("-- 192.0.2.1", "terminal_explicit_ip_signature"),
    ]
    for end, reason in cases:
        named = {**CONFIDENT, "source_signature_artifact_stripped": True, "source_signature_artifact_reason": reason}
        got = alignment.assess(f"{whole} {end}", whole, named)
        assert got["decision"] == "promote" and got["adjusted"] == [f"ignored_source_artifact:{reason}"], reason
        words = wikitext.comparison_tokens(end)
        assert alignment.assess(f"{whole} {end}", whole, CONFIDENT)["decision"] == ("review" if words else "promote"), reason
    assert wikitext.without_artifacts("Done. 266.31.39.76", True, "terminal_bare_ipv4_after_sentence")[1] == []


def test_structural_flags():
    assert wikitext.structural_flags("fine {{unsigned|Bob}} words") == ["unsigned_signature_residue"]
    assert wikitext.structural_flags("{{Talk header}} words") == ["page_template"]
    assert wikitext.structural_flags("x" * 1200 + "{{Talk header}} words") == []
    assert wikitext.structural_flags("I agree. [[User talk:Bob|Bob]] 10:01, 2 May 2010 (UTC)") == ["terminal_signature"]
    assert wikitext.structural_flags("[[User:Bob]] said so" + " and more" * 40) == []
    assert wikitext.structural_flags("see [ | ] there") == ["malformed_empty_link"]
    assert wikitext.structural_flags("== A ==\nbody") == ["section_heading"]
    assert wikitext.structural_flags("</span> rest ~~") == ["dangling_tilde", "leading_closing_html"]
    assert wikitext.structural_flags(" ") == ["empty_candidate"]


def test_alignment_spans():
    m = alignment.alignment("a b c d".split(), "a x c d e".split())
    assert (m["deleted"], m["added"]) == ([["b"]], [["x"], ["e"]])
    assert m["ratio"] == 6 / 9 and m["retention"] == 0.75 and m["purity"] == 0.6


def test_longest_common_runs_against_difflib():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(20))] for _ in "ab")
        assert alignment.Runs(a).longest(b) == SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
    many = [f"w{i}" for i in range(17)]
    assert alignment.holds_neighbour(many[:8], [], many) and not alignment.holds_neighbour(many[:7], [], many)
    assert not alignment.holds_neighbour(many[:8], many[:4], many) and not alignment.holds_neighbour(many[:7], [], many[:7])


def test_diff_limit_and_changes():
    a, b = ([f"{side}{i}" for i in range(3000)] for side in "ab")
    assert text.edit_script(a, b) is None and text.changes(a, b) is None and text.diff_decision(None) == "unresolved"
    assert text.changes("a b c d".split(), "a x c d e".split()) == [("replace", 1, 2, 1, 2), ("insert", 4, 4, 4, 5)]
    assert [text.diff_decision(text.changes(list(x), list(y))) for x, y in (("ab", "ab"), ("ab", "abc"), ("abc", "xbz"))] == ["no_change", "action", "unresolved"]
    assert text.diff_counts("a b", "a c") == (2, 1, 1)


def test_wikitext():
    assert wikitext.visible("'''A''' {{x|{{y}}}}[[B|c [[D]]]] <ref>no</ref>&amp; <b>e</b> [http://u f g]<!-- h -->") == "A c D & e f g"
    assert wikitext.comparison_tokens("I can’t, won't; it's 5% [[X]] https://a.b/c?d=e") == ["i", "can", "n't", "will", "n't", "it's", "5", "%", "x", "https://a.b/c?d=e"]
    found = wikitext.links("a [[File:x|y [[User:Bob_b|B]]]] https://q.r and [[fr:Z]] [[#s]]")
    assert [(f["kind"], f["target"]) for f in found] == [("article", "File:x"), ("user", "User:Bob b"), ("external", "https://q.r"), ("interwiki", "fr:Z"), ("section_anchor", "#s")]
    s = wikitext.signature("so. [[User:Ann|A]] ([[User talk:Ann|t]]) 12:34, 1 January 2020 (UTC)")
    assert (s["status"], s["user"], s["talk"], s["time"]) == ("explicit_evidence_observed", "Ann", "Ann", "12:34, 1 January 2020 (UTC)") and s["raw"].startswith("[[User:Ann")
    assert wikitext.signature("nothing")["status"] == "not_observed_in_fragment"


def test_reply_depth_flags_cycles(spark):
    from parley.operators import rel

    chain = [(i, i - 1 if i else None) for i in range(9)]
    d = spark.createDataFrame([*chain, (20, 21), (21, 22), (22, 20), (23, 20), (30, 99), (40, 40)], "node long, parent long")
    got = {r["node"]: (r["root"], r["depth"], r["cycle"]) for r in rel.roots(d).collect()}
    assert got == {**{i: (0, i, False) for i in range(9)}, **{i: (None, None, True) for i in (20, 21, 22, 23, 40)}, 30: (30, 0, False)}
