"""Exact byte spans of JSON values: where the items of an array and the members of an object stand, without decoding them."""

from __future__ import annotations

import re
from collections.abc import Iterator

_PIECE = re.compile(rb'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.DOTALL)
_CLOSES = {b"]": b"[", b"}": b"{"}


def children(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes | None, int, int]]:
    """(key, start, end) of each item or member of the one array or object in ``data[start:end]``; keys are raw, None in arrays.

    One pass over the tokens with a stack of open brackets; every bracket, separator and the end are checked.
    """
    end = len(data) if end is None else end
    open_: list[bytes] = []
    key = first = last = None
    at, want = start, "value"
    for m in _PIECE.finditer(data, start, end):
        if data[at : m.start()].strip():
            raise ValueError(f"no JSON at byte {at}")
        at, piece, depth = m.end(), m.group(), len(open_)
        if want == "end":
            raise ValueError(f"more than one value at byte {m.start()}")
        if depth == 0:
            if piece not in (b"[", b"{"):
                raise ValueError("neither an array nor an object")
            open_.append(piece)
            want = "first"
        elif piece in (b"[", b"{"):
            if depth == 1:
                if want not in ("first", "value") or (open_[0] == b"{" and key is None):
                    raise ValueError(f"unexpected value at byte {m.start()}")
                first = m.start()
            open_.append(piece)
        elif piece in _CLOSES:
            if open_.pop() != _CLOSES[piece]:
                raise ValueError(f"mismatched bracket at byte {m.start()}")
            if depth == 1:
                if want == "value" or key is not None and first is None:
                    raise ValueError(f"a value is missing at byte {m.start()}")
                if first is not None:
                    yield key, first, last
                want = "end"
            elif depth == 2:
                last, want = m.end(), "separator"
        elif depth == 1 and piece == b",":
            if want != "separator":
                raise ValueError(f"unexpected separator at byte {m.start()}")
            yield key, first, last
            key = first = last = None
            want = "value"
        elif depth == 1 and piece == b":":
            if open_[0] != b"{" or want != "colon":
                raise ValueError(f"unexpected colon at byte {m.start()}")
            want = "value"
        elif depth == 1:
            if open_[0] == b"{" and key is None:
                if want not in ("first", "value") or piece[:1] != b'"':
                    raise ValueError(f"a key is missing at byte {m.start()}")
                key, want = piece[1:-1], "colon"
            elif want in ("first", "value"):
                first, last, want = m.start(), m.end(), "separator"
            else:
                raise ValueError(f"a separator is missing at byte {m.start()}")
    if open_ or want != "end" or data[at:end].strip():
        raise ValueError("cut off, or more than one value")


def member(data: bytes, key: bytes, start: int = 0, end: int | None = None) -> tuple[int, int]:
    """The span of one member of an object."""
    for name, a, b in children(data, start, end):
        if name == key:
            return a, b
    raise KeyError(key.decode("utf-8", "replace"))
