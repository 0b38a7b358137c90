"""Comments of a discussion page: where they begin and end, which changes belong to them, and which action made which.

All places are in characters (code points) of the page's raw text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from .text import changes, edit_script, folded, token_spans, tokens
from .wikitext import visible

# How signatures and structure are written.
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_SHORT = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
_TIME, _DAY, _YEAR = r"\d{1,2}:\d{2}", r"\d{1,2}", r"(?:19|20)\d{2}"
CANONICAL = re.compile(rf"\b{_TIME},\s+{_DAY}\s+{_MONTH}\s+{_YEAR}\s*\(UTC\)", re.IGNORECASE)
HISTORICAL = re.compile(
    rf"\b(?:{_DAY}\s+{_SHORT}\s+{_YEAR}(?:\s+{_TIME})?|{_SHORT}\s+{_DAY}(?:st|nd|rd|th)?\s*,?\s+{_YEAR}(?:\s+{_TIME})?|{_YEAR}\s+{_SHORT}\s+{_DAY}(?:\s+{_TIME})?"
    rf"|{_TIME}\s*,?\s+{_DAY}\s+{_SHORT}\s+{_YEAR}|{_TIME}\s*,?\s+{_YEAR}\s+{_SHORT}\s+{_DAY})(?:\s*\(UTC\))?",
    re.IGNORECASE,
)
USER = re.compile(r"\[\[\s*(?:User(?:[ _]+talk)?|Special\s*:\s*Contributions)\s*[:/]\s*(?P<name>[^\]|#]+)", re.IGNORECASE)
HEADING = re.compile(r"^\s*={2,6}\s*[^=\n].*?={2,6}\s*$")
TEMPLATE = re.compile(r"^\s*\{\{")
_AFTER_DATE = re.compile(r"(?:<!--.*?-->|</?(?:small|span|sup|sub)\b[^>]*>|&nbsp;|[\s\]\[(){}'\"`.,;:!?~*/\\–—-])*", re.IGNORECASE)
#: How far before its time a signature's user link can stand.
REACH = 320
#: Limits and tolerance of a global assignment.
MOST_ACTIONS, MOST_CANDIDATES, MOST_EDGES, MOST_STATES, TOLERANCE = 10, 30, 200, 100_000, 1
#: Evidence that a text lived on: so many words and characters of one unchanged block.
PERSIST_WORDS, PERSIST_CHARS = 10, 40


@dataclass
class Comment:
    start: int
    end: int
    body_end: int
    signature: int | None
    user: str | None
    time: str | None
    indent: str
    evidence: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return sum(c in ":*#" for c in self.indent)

    def body(self, raw: str) -> str:
        return raw[self.start : self.body_end]


def _lines(raw: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in raw.splitlines(keepends=True):
        out.append((at, line))
        at += len(line)
    return out


def _indent(line: str) -> str:
    return re.match(r"[:*# \t]*", line).group()


def _signatures(line: str, times: re.Pattern) -> list[tuple[int, re.Match, str]]:
    """(start, time, user) of each signature of a line: the last user link shortly before a time, with the dash before it."""
    out = []
    for m in times.finditer(line):
        if times is HISTORICAL and not _AFTER_DATE.fullmatch(line, m.end()):
            continue
        near = [u for u in USER.finditer(line, 0, m.start()) if m.start() - u.start() <= REACH]
        if near:
            dash = re.search(r"(?:--+|[–—])\s*$", line[: near[-1].start()])
            out.append((dash.start() if dash else near[-1].start(), m, near[-1].group("name").strip()))
    return out


def comments(raw: str) -> list[Comment]:
    """The signed comments of a page; older date forms count only where no comment has the usual one."""
    return _read(raw, CANONICAL) or _read(raw, HISTORICAL)


def _read(raw: str, times: re.Pattern) -> list[Comment]:
    """One pass down the page: lines of one indentation gather until a signature closes them, a barrier drops them."""
    out: list[Comment] = []
    start, indent, merged, why = None, "", 0, None  # the open region: where it began, and what stands before it
    for at, line in _lines(raw):
        if not line.strip():
            continue
        if HEADING.match(line.rstrip("\n")) or TEMPLATE.match(line):
            start, why = None, "preceded_by_heading" if HEADING.match(line.rstrip("\n")) else "preceded_by_page_template"
            continue
        if start is not None and _indent(line) != indent:
            start, why = None, "preceded_by_incompatible_indentation"
        if start is None:
            start, indent, merged = at, _indent(line), 0
        else:
            merged += 1
        done = at
        for sig, time, user in _signatures(line, times):
            if at + sig < done:
                continue  # inside the one before
            first = max(start, done) if done > at else start
            body = len(raw[first : at + sig].rstrip()) + first
            kind = "terminal_utc_timestamp" if times is CANONICAL else "terminal_historical_timestamp"
            proof = ["terminal_explicit_user_link", kind, *["merged_preceding_unsigned_same_depth_paragraph"] * merged, *([why] if why else [])]
            warn = ["clipped_to_preceding_candidate"] if done > at else [] if why or at == 0 else ["start_boundary_reached_document_start"]
            done = at + time.end()
            out.append(Comment(first, done, body, at + sig, user, time.group(), indent, proof, warn))
            merged = 0
        if done > at:
            start, why = None, "preceded_by_prior_candidate"
    return out


def timestamp_regions(raw: str) -> list[tuple[int, int]]:
    """From each time to the next, without leading blank lines and headings; a last resort."""
    out, at = [], 0
    for m in CANONICAL.finditer(raw):
        start = at
        for _, line in _lines(raw[at : m.end()]):
            if line.strip() and not re.match(r"^\s*=+\s*.*?\s*=+\s*$", line):
                break
            start += len(line)
        if raw[start : m.end()].strip():
            out.append((start, m.end()))
        at = m.end()
    return out


def fragment(raw: str, shown: str, action_id: str | None) -> dict:
    """Where a text shown stands in a page: exactly, else from a place that its action's id names, if it is alike enough."""
    at = raw.find(shown) if shown else -1
    if at >= 0:
        return {"start": at, "end": at + len(shown), "similarity": 1.0, "status": "recovered"}
    size = max(len(shown), 80)
    even = lambda s: " ".join(s.split()).casefold()
    best = (0.0, 0, 0)
    for place in sorted({int(p) for p in (action_id or "").split(".")[1:3] if p.isdigit() and int(p) < len(raw)}):
        window = raw[place : place + 4 * size + 1500]
        signed = re.search(r"\d{1,2}:\d{2},\s+\d{1,2}\s+[A-Z][a-z]+\s+\d{4}\s+\(UTC\)", window)
        least = max(1, size // 3)
        gap = None if signed else re.compile(r"\n(?:==+|\n)").search(window, least)
        end = signed.end() if signed else gap.start() if gap else len(window)
        alike = SequenceMatcher(None, even(shown), even(visible(window[:end])), autojunk=False).ratio()
        best = max(best, (alike, -place, place + end))
    if best[0] >= 0.60:
        return {"start": -best[1], "end": best[2], "similarity": best[0], "status": "recovered_candidate"}
    return {"start": None, "end": None, "similarity": None, "status": "unresolved"}


# -- changes -------------------------------------------------------------------------------------------------------------


def changed_spans(before: str, after: str) -> list[tuple[str, int, int, int, int]] | None:
    """Changed places (kind, start and end before, start and end after) in characters; None beyond the diff's limit."""
    a, b = tokens(before), tokens(after)
    found = changes(a, b)
    if found is None:
        return None
    x, y = ([s for s, _ in token_spans(t)] + [len(t)] for t in (before, after))
    return [(kind, x[i], x[j], y[k], y[m]) for kind, i, j, k, m in found]


def touches(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two spans share a place; an empty one counts where it stands, at both edges too."""
    if a[0] == a[1] or b[0] == b[1]:
        return a[0] <= b[1] and b[0] <= a[1]
    return a[0] < b[1] and b[0] < a[1]


def localized(raw: str, found: Sequence[Comment], spans: Iterable[tuple[int, int]]) -> list[tuple[int, tuple[int, int], str]]:
    """(comment, span, reason) where a change touches a comment, or is a blank gap right beside it."""
    order = sorted(range(len(found)), key=lambda i: (found[i].start, found[i].end))
    out = []
    for span in spans:
        hits = [i for i in order if touches(span, (found[i].start, found[i].end))]
        out += [(i, span, "overlap") for i in hits]
        if not hits and not raw[slice(*span)].strip():
            before = [i for i in order if found[i].end <= span[0] and not raw[found[i].end : span[0]].strip()]
            after = [i for i in order if found[i].start >= span[1] and not raw[span[1] : found[i].start].strip()]
            out += [(i, span, "whitespace_neighbour") for i in before[-1:] + after[:1]]
    return out


def contamination_status(raw: str, one: Comment | None, found: Sequence[Comment]) -> str:
    """Detected where another comment overlaps or lies inside, clean where the text reads as exactly one comment, else unknown."""
    if one is None or not 0 <= one.start < one.end <= len(raw):
        return "unknown"
    span = (one.start, one.end)
    others = [c for c in found if (c.start, c.end) != span]
    if any(c.start < one.end and one.start < c.end or (c.signature is not None and one.start <= c.signature < one.end) for c in others):
        return "detected"
    inside = comments(raw[one.start : one.end])
    if len(inside) > 1:
        return "detected"
    return "clean" if len(inside) == 1 and not one.warnings else "unknown"


def _equal_chars(before: str, after: str) -> list[tuple[int, int, int, int]] | None:
    a, b = tokens(before), tokens(after)
    ops = edit_script(a, b)
    if ops is None:
        return None
    x, y = ([s for s, _ in token_spans(t)] + [len(t)] for t in (before, after))
    return [(x[i], x[j], y[k], y[m]) for kind, i, j, k, m in ops if kind == "equal"]


def _shared(lo: int, hi: int, start: int, end: int) -> int:
    return max(0, min(hi, end) - max(lo, start))


def continues(before: str, after: str, one: Comment, earlier: Sequence[Comment]) -> Comment | None:
    """The earlier comment with the same user or time that shares unchanged text with this one's body."""
    same = _equal_chars(before, after) or []
    for old in earlier:
        known = (one.user and old.user and one.user.casefold() == old.user.casefold()) or (one.time and one.time == old.time)
        if known and any(_shared(x, y, old.start, old.body_end) and _shared(u, v, one.start, one.body_end) for x, y, u, v in same):
            return old
    return None


def persists(before: str, after: str, one: Comment, earlier: Sequence[Comment], spans: Sequence[tuple[int, int]]) -> Comment | None:
    """The only clean earlier comment of the same indentation of which a long unchanged block stands beside the change.

    The changed spans must lie in the body and hold more than blanks; the block must border on one of them, and have enough words and characters.
    """
    solid = [s for s in spans if s[0] < s[1] and after[slice(*s)].strip()]
    if not solid or any(not (one.start <= a and b <= one.body_end) for a, b in solid):
        return None
    found = []
    for old in earlier:
        if old.warnings or old.indent != one.indent:
            continue
        for x, y, u, v in _equal_chars(before, after) or []:
            lo, hi = max(x, old.start), min(y, old.body_end)
            lo, hi = max(lo, one.start - u + x), min(hi, one.body_end - u + x)
            block = before[lo:hi] if lo < hi else ""
            beside = any(not after[v:a].strip() if v <= a else not after[b:u].strip() if b <= u else False for a, b in solid)
            if beside and len(re.findall(r"\w+", block)) >= PERSIST_WORDS and sum(not c.isspace() for c in block) >= PERSIST_CHARS:
                found.append(old)
                break
    return found[0] if len(found) == 1 else None


def region_of_change(raw: str, spans: Sequence[tuple[int, int]]) -> tuple[int, int, str, str] | None:
    """The smallest region of one indentation around all changes, closed on both sides, with what closes it.

    Nothing where a change lies on a heading, template or signed line, or where prose of the same indentation follows a blank line.
    """
    lines = _lines(raw)
    solid = [s for s in spans if s[0] < s[1] and raw[slice(*s)].strip()]
    if not solid or not lines:
        return None

    def barrier(line: str) -> str | None:
        if HEADING.match(line.rstrip("\n")):
            return "heading"
        if TEMPLATE.match(line):
            return "template"
        return "signed_neighbour" if _signatures(line, CANONICAL) or _signatures(line, HISTORICAL) else None

    kinds = [barrier(line) for _, line in lines]
    at = [i for i, (a, line) in enumerate(lines) if any(touches((a, a + len(line.rstrip("\n"))), s) and raw[max(a, s[0]) : min(a + len(line), s[1])].strip() for s in solid)]
    if not at:
        return None
    first, last = at[0], at[-1]
    indent = _indent(lines[first][1])
    if any(kinds[i] or not lines[i][1].strip() or _indent(lines[i][1]) != indent for i in range(first, last + 1)):
        return None

    def close(i: int, step: int) -> tuple[int, str] | None:
        edge, blank = i, False
        while 0 <= i + step < len(lines):
            i += step
            line = lines[i][1]
            if kinds[i]:
                return edge, kinds[i]
            if not line.strip():
                blank = True
            elif _indent(line) != indent:
                return edge, "incompatible_indentation"
            elif blank:
                return None
            else:
                edge = i
        return edge, "page_edge"

    top, bottom = close(first, -1), close(last, 1)
    if top is None or bottom is None:
        return None
    a, line = lines[bottom[0]]
    return lines[top[0]][0], a + len(line.rstrip("\n")), top[1], bottom[1]


# -- assignment ----------------------------------------------------------------------------------------------------------


def edges(actions: Sequence[dict], raw: str, found: Sequence[Comment]) -> list[tuple[int, int, tuple]]:
    """(action, comment, rank) by evidence: overlap of changes, logical identity, lifecycle, shared words, offset, speaker, and 1."""
    words = lambda t: set(re.findall(r"\w+", folded(t)))
    bodies = [words(c.body(raw)) for c in found]
    out = []
    for i, a in enumerate(actions):
        mine, allowed = words(a.get("text") or ""), a.get("allowed")
        for j, c in enumerate(found):
            if allowed is not None and j not in allowed:
                continue
            hit = any(touches((c.start, c.end), s) for s in a.get("spans", ()))
            identity = a.get("logical") is not None and a.get("logical") == a.get("candidate_logical", {}).get(j)
            fits = hit and (a.get("kind") or "").casefold() in ("creation", "modification", "restoration")
            shared = bool(mine) and len(mine & bodies[j]) >= min(3, len(mine))
            inside = a.get("offset") is not None and c.start <= a["offset"] < c.end
            speaks = bool(a.get("speaker") and c.user) and a["speaker"].casefold() == c.user.casefold()
            out.append((i, j, (*map(int, (hit, identity, fits, shared, inside, speaks)), 1)))
    return out


def assign(n_actions: int, ranked: Sequence[tuple[int, int, tuple]]) -> list[tuple[str, int | None, str]]:
    """(status, comment, warning) of each action, each comment used once, by all assignments that are best or nearly so.

    Partial assignments grow action by action, layer by layer, with the comments in use as bits.  Scores are compared
    component by component; an action is assigned only if all the best agree on it and no other edge of its own is as good.
    """
    mine: dict[int, list] = {i: [] for i in range(n_actions)}
    for i, j, rank in ranked:
        mine[i].append((j, rank))
    active = [i for i in range(n_actions) if mine[i]]
    if len(active) > MOST_ACTIONS or len({j for _, j, _ in ranked}) > MOST_CANDIDATES or len(ranked) > MOST_EDGES:
        return [("ambiguous" if mine[i] else "unmatched", None, "revision_too_large_for_safe_global_assignment" if mine[i] else "") for i in range(n_actions)]
    layer, seen = [((0,) * 7, 0, ())], 1
    for i in active:
        layer = [*((s, used, (*c, None)) for s, used, c in layer), *((tuple(map(sum, zip(s, rank, strict=True))), used | 1 << j, (*c, j)) for s, used, c in layer for j, rank in mine[i] if not used >> j & 1)]
        seen += len(layer)
        if seen > MOST_STATES:
            return [("ambiguous", None, "global_assignment_search_limit")] * n_actions
    best = max(s for s, _, _ in layer)
    good = [c for s, _, c in layer if s[:2] == best[:2] and sum(best[2:]) - sum(s[2:]) <= TOLERANCE]
    out = []
    for i in range(n_actions):
        choice = {c[active.index(i)] for c in good} if mine[i] else {None}
        (one,) = choice if len(choice) == 1 else (None,)
        top = sorted((rank for _, rank in mine[i]), reverse=True)[:2]
        if len(choice) > 1:
            out.append(("ambiguous", None, "equal_global_assignments"))
        elif one is None:
            out.append(("ambiguous", None, "no_unique_global_assignment") if mine[i] else ("unmatched", None, ""))
        elif len(top) > 1 and top[0] == top[1]:
            out.append(("ambiguous", None, "equal_local_evidence"))
        else:
            out.append(("assigned", one, ""))
    return out


# -- proofs --------------------------------------------------------------------------------------------------------------


def identity_mode(body: str, source: str, indent: str = "") -> str | None:
    """How a body is the source's text: exactly, but for outer blanks, or but for colons before it."""
    a, b = body.strip(), source.strip()
    if not b:
        return None
    if a == b:
        return "exact" if (a, b) == (body, source) else "outer_whitespace_only"
    colons = re.match(rf"{re.escape(indent)}[ \t]*" if re.fullmatch(r":+[ \t]*", indent) else r":+[ \t]*", a)
    return "colon_indentation_only" if colons and a[colons.end() :].strip() == b else None


def anchored(span: str | None, final: str, coded: str) -> str:
    """Where a quoted span is found: as it is, normalised, or as a reader sees it; in the final text first, else in the coded one."""
    needle = (span or "").strip()
    if not needle:
        return "blank"
    even = lambda t: " ".join(folded(t).split())
    for text, names in ((final, ("exact_final", "normalized_final", "visible_final")), (coded, ("legacy_only_exact", "legacy_only_normalized", "legacy_only_visible"))):
        for name, of in zip(names, (str, even, lambda t: even(visible(t))), strict=True):
            if of(needle) and of(needle) in of(text):
                return name
    return "unanchored"


def windows(size: int, focus: Sequence[tuple[int, int]], units: Sequence[tuple[int, int]], margin: int = 180) -> list[tuple[int, int]]:
    """Places to show around what matters: the units it touches and their neighbours, with a margin, joined where they meet.

    Of a focus longer than 480 characters only both edges matter.
    """
    wide = []
    for a, b in focus:
        wide += [(a, a + 240), (b - 240, b)] if b - a > 480 else [(a, b)]
    units = sorted(units)
    spans = []
    for a, b in wide:
        hit = [i for i, u in enumerate(units) if touches((a, b), u)]
        near = units[max(hit[0] - 1, 0) : hit[-1] + 2] if hit else []
        lo, hi = min([a, *(u[0] for u in near)]), max([b, *(u[1] for u in near)])
        spans.append((max(lo - margin, 0), min(hi + margin, size)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
