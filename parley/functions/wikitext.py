"""Wikitext: what a reader sees, comparison tokens, links, signatures and structural signs.  Plain functions over one text."""

from __future__ import annotations

import html
import re

# Patterns and word lists that decide what counts.
TOKEN = re.compile(r"https?://[^\s\]\[<>\"']+|[\w]+(?:['’][\w]+)*|!=|==|<=|>=|[%+*/^=<>-]", re.IGNORECASE)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NEGATIONS = ("not", "n't", "never", "no", "none", "neither", "nor", "nothing", "nobody", "nowhere", "cannot", "can't", "without", "hardly", "scarcely")
OPERATORS = ("%", "+", "*", "/", "^", "=", "==", "!=", "<", ">", "<=", ">=")
#: Contractions whose stem changes its spelling.
STEMS = {"ca": "can", "wo": "will"}
#: Page templates count in so many characters from the start.
HEAD = 1200
FLAGS = {
    "dangling_tilde": r"^\s*~+(?:\s|$)|(?:^|\s)~+\s*$",
    "leading_closing_html": r"(?is)^\s*</(?:span|div|small|sup|sub|blockquote|font)\b",
    "malformed_empty_link": r"\[\s*\|\s*\]",
    "page_template": r"(?i)\{\{\s*(?:WikiProject|Talk\s*header|Article\s*history|GA|FAQ|Archive|Controversial|Not\s*a\s*forum|Connected\s*contributor)\b",
    "section_heading": r"(?m)^\s*={2,6}\s*[^=\n].*?={2,6}\s*$",
    "terminal_signature": r"(?i)(?:\[\[\s*(?:User(?:\s+talk)?|Special:Contributions)\s*[:/]\s*[^\]]+\]\]|\b(?:Autosigned\s+by\s+SineBot|preceding\s+unsigned\s+comment)\b)"
    r"[\s\S]{0,240}(?:\d{1,2}:\d{2},\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}\s*\(UTC\))?\s*$",
    "unsigned_signature_residue": r"(?i)Template:Unsigned|Autosigned\s+by\s+SineBot|\{\{\s*unsigned(?:IP)?\b|preceding\s+unsigned\s+comment",
}
TIMESTAMP = r"\d{1,2}:\d{2},\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}\s*\(UTC\)"
#: What an earlier step can have found at the end of a source text, and how it is left out of a comparison.
ARTIFACTS = {
    "terminal_unsigned_attribution": r"(?is)\s*(?:(?:--+|[–—])\s*)?(?:preceding\s+)?unsigned\s+comment\s+added\s+by.*$",
    "terminal_unsigned_attribution_v32": r"(?is)\s*(?:(?:--+|[–—])\s*)?(?:preceding\s+)?unsigned\s+comment\s+added\s+by.*$",
    "terminal_bare_ipv4_after_sentence": r"(?<=[.!?])[ \t]+(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)[ \t]*$",
    "terminal_explicit_ip_signature": r"(?i)\s*(?:--+|[–—])[ \t]*(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9a-f:]{4,})[ \t'\"]*$",
    "terminal_signature_glyphs": r"\s+[–—][ \t]*[·•][ \t]*$",
    "terminal_valediction_artifact": r"(?i)(?<=[.!?])\s+(?:best|regards|cheers|best\s+wishes)\s*[,:;.!]*\s*(?:(?:--+|[–—])\s*)?[']*\s*$",
}

_FLAGS = {name: re.compile(p) for name, p in FLAGS.items()}
_ARTIFACTS = {name: re.compile(p) for name, p in ARTIFACTS.items()}
_TIMESTAMP = re.compile(TIMESTAMP)
_CRITICAL = frozenset((*MONTHS, *NEGATIONS, *OPERATORS))
_INNER = re.compile(r"\{\{[^{}]*\}\}|\[\[([^\[\]]*)\]\]|\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\]]*))?\]")
_DROPPED = re.compile(r"(?s)<!--.*?-->|<ref\b[^>]*/>|<ref\b.*?</ref>|</?[A-Za-z][^>]*>|'{2,5}|(?m:^\s*={1,6}|={1,6}\s*$|^[*#:;]+)")
_USER = re.compile(r"\[\[\s*(?P<space>User talk|User)\s*:\s*(?P<target>[^\]|#/]+)", re.IGNORECASE)
_CONTRIBUTIONS = re.compile(r"\[\[\s*Special:Contributions/(?P<target>[^\]|#]+)", re.IGNORECASE)
_URL = re.compile(r"https?://[^\s\]\[<>\"'|{}]+")


def visible(text: str | None) -> str:
    """Comparison text: links keep their label, templates, comments, references and tags go, blanks collapse.

    Markup is taken away from the inside out, so nesting needs no parser; what never closes stays as it is.
    """

    def label(m: re.Match) -> str:
        if m.group(1) is not None:
            target, _, shown = m.group(1).partition("|")
            return shown.rpartition("|")[2] or target.lstrip(":")
        return m.group(2) or ""

    out = re.sub(r"(?s)<!--.*?-->", " ", html.unescape(text or ""))
    while True:
        new = _INNER.sub(label, out)
        if new == out:
            break
        out = new
    return " ".join(_DROPPED.sub(lambda m: "" if m.group()[0] in "'" else " ", out).split())


def comparison_tokens(text: str | None) -> list[str]:
    """URLs, words and operators of the visible text without case; a lost n't shows, as it is a token of its own."""
    out: list[str] = []
    for token in TOKEN.findall(visible(text)):
        low = token.casefold().replace("’", "'")
        stem = low.removesuffix("n't")
        out += [STEMS.get(stem, stem), "n't"] if stem and stem != low else [low]
    return out


def critical(token: str) -> bool:
    """Whether the loss of a token would change what a text says."""
    return token in _CRITICAL or token.startswith(("http://", "https://")) or any(c.isdigit() for c in token)


def structural_flags(text: str | None) -> list[str]:
    """Signs that a text is not one whole comment, sorted."""
    raw = text or ""
    found = [name for name, p in _FLAGS.items() if p.search(raw[:HEAD] if name == "page_template" else raw)]
    return sorted(found if raw.strip() else [*found, "empty_candidate"])


def without_artifacts(text: str, stripped: bool, reasons: str | None) -> tuple[str, list[str]]:
    """A source text for comparison, without the endings that an earlier step named, and which of them were there."""
    named = {r.strip() for r in (reasons or "").split("|")} if stripped else set()
    done = []
    for name, p in _ARTIFACTS.items():
        new = p.sub("", text).rstrip() if name in named else text
        if new != text:
            text = new
            done.append(f"ignored_source_artifact:{name}")
    return text, done


def link_kind(target: str) -> str:
    """What a link target is."""
    low = target.casefold().replace("_", " ")
    space, colon, _ = target.partition(":")
    rules = (
        (low.startswith("user talk:"), "user_talk"),
        (low.startswith("user:"), "user"),
        (low.startswith("special:contributions"), "special_contributions"),
        (any(x in low for x in ("special:diff", "oldid=", "diff=")), "diff_revision"),
        (target.startswith("#"), "section_anchor"),
        (bool(colon) and not low.startswith(("category:", "file:", "template:")) and 2 <= len(space) <= 11 and space.isalpha(), "interwiki"),
    )
    return next((kind for holds, kind in rules if holds), "article")


def links(text: str | None) -> list[dict]:
    """Explicit links with their place in characters: wiki links, nested ones too, and bare or bracketed URLs."""
    raw, found, open_ = text or "", [], []
    for m in re.finditer(r"\[\[|\]\]", raw):
        if m.group() == "[[":
            open_.append(m.start())
        elif open_:
            start = open_.pop()
            target, _, shown = raw[start + 2 : m.start()].partition("|")
            target = target.strip()
            found.append({"start": start, "end": m.end(), "kind": link_kind(target), "target": " ".join(target.replace("_", " ").split()), "anchor": shown or None})
    for m in _URL.finditer(raw):
        found.append({"start": m.start(), "end": m.end(), "kind": "external", "target": m.group(), "anchor": None})
    return sorted(found, key=lambda x: (x["start"], x["end"]))


def signature(text: str | None) -> dict:
    """Explicit evidence of a signature: time, user, talk and contributions targets, and the text from the first of them on."""
    raw = text or ""
    time, users, other = _TIMESTAMP.search(raw), list(_USER.finditer(raw)), _CONTRIBUTIONS.search(raw)
    hits = [m.start() for m in (time, other, *users) if m]
    of = lambda space: next((m.group("target").strip() for m in users if m.group("space").casefold() == space), None)
    return {
        "status": "explicit_evidence_observed" if hits else "not_observed_in_fragment",
        "raw": raw[min(hits) :] if hits else None,
        "user": of("user"),
        "talk": of("user talk"),
        "contributions": other.group("target").strip() if other else None,
        "time": time.group() if time else None,
    }


def discrepancy(source: str, found: str, has_links: bool) -> str:
    """How a reconstructed visible text differs from the source's."""
    even = lambda s: " ".join(html.unescape(s).split())
    if source == found:
        return "exact_visible_match"
    if even(source) == even(found):
        return "whitespace_or_entity_difference"
    return "markup_or_link_target_loss_or_version_difference" if has_links else "comment_boundary_or_version_difference"
