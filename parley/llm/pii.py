"""Personal data: format-preserving Feistel pseudonyms.

Validated numbers and dates are replaced by other valid ones of the same format: a
keyed Feistel network permutes the value's own domain, so equal values get equal
pseudonyms in all documents, whatever separators they were written with, and the
key holder can invert them.  No table of values is kept, so documents are handled
one by one.

Kinds and their validation:

- ``card``: 13 to 19 digits, also in groups, with a right Luhn digit; all digits but the last are permuted, the last is made right again;
- ``iban``: right modulo 97; the digits of the account are permuted, the check digits made right again;
- ``ssn``: ddd-dd-dddd within the issued ranges;
- ``phone``: ddd-ddd-dddd with hyphens, dots, blanks or brackets, with 1 or +c before it, or + and 8 to 15 digits in groups; the last 10 digits, or all but the first two of fewer than 12, are permuted;
- ``ip``: dotted quads with parts up to 255, not part of a longer dotted number, all 32 bits permuted; IPv6 addresses with a digit, of which each group is permuted among those of its length;
- ``date``: calendar dates of 1900 to 2099 as y-m-d, y/m/d, d/m/y or d.m.y; the day number is permuted;
- ``email``: the letters and digits before the @ are permuted, each as its own kind of character, letters of any script among those near it in Unicode;
- ``secret``: runs of 32 to 64 hexadecimal digits with both letters and digits, of one case, and access key ids (AKIA or ASIA and 16 of A-Z and 2-7).

Numbers that fail validation stay; nine digits without hyphens are not taken for an SSN.  Where a match of an IBAN's form fails, because a word before or
after it was taken in, shorter ones and the other kinds are looked for inside it; about one in 97 of
these is followed by a word with which its pseudonym is an IBAN too, and ``undo`` by search misses it.  Defined cases: null stays null, empty stays empty, texts
without findings come back unchanged.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import secrets
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, text_udf

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")
_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
_PATTERNS = {
    "email": r"(?<![\w.%+-])[^\W_][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\w.+-])(?:1[-. ])?\d{3}(?P<gap>[-. ])\d{3}(?P=gap)\d{4}(?![\d-]|[. ]\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,8}){1,4}(?![\d-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "date": r"(?<![\w./-])\d{4}(?P<dash>[-/])\d{2}(?P=dash)\d{2}(?![\d/-])|(?<![\w./-])\d{2}(?P<sep>[/.])\d{2}(?P=sep)\d{4}(?![\d/])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
    r"|(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|A[KS]IA[A-Z2-7]{16})(?![0-9A-Za-z])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
_FIND = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in _PATTERNS.items()))
_SECRET = re.compile(_PATTERNS["secret"])
#: What a finding must contain; texts without any of it are not searched.
_MAY = re.compile(r"[@+]|\d{2}|\d\.\d|::|[0-9a-fA-F]:[0-9a-fA-F]|[0-9a-fA-F]{32}|A[KS]IA")
_UPPER_KEY = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class Cipher:
    """A keyed permutation of range(n), for any n, with its inverse."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, value: int, mask: int) -> int:
        h = hashlib.blake2b(b"%b|%d|%d" % (tweak, r, value), key=self.key, digest_size=24).digest()
        return int.from_bytes(h, "big") & mask

    def _walk(self, value: int, n: int, tweak: bytes, order: range) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:  # a permutation of a power of 4, walked along its cycle until the value is in range
            a, b = value >> half, value & mask
            if order.step > 0:
                for r in order:
                    a, b = b, a ^ self._round(tweak, r, b, mask)
            else:
                for r in order:
                    a, b = b ^ self._round(tweak, r, a, mask), a
            value = a << half | b
            if value < n:
                return value

    def encrypt(self, value: int, n: int, tweak: bytes) -> int:
        return self._walk(value, n, tweak, range(ROUNDS))

    def decrypt(self, value: int, n: int, tweak: bytes) -> int:
        return self._walk(value, n, tweak, range(ROUNDS - 1, -1, -1))


def luhn_digit(digits: str) -> str:
    """The digit that completes ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


@functools.cache
def _kind_of(c: str) -> tuple[str, str]:
    """The characters among which one of a name is permuted (none: it stays), and the one that stands for it there, without case.

    They are the digits, or the letters of the same 64 code points that are cased, or uncased, as it is, so that a name stays a name.
    """
    def cased(x: str) -> bool:
        return len(x.upper()) == 1 and x.upper() != x and x.upper().lower() == x

    if "0" <= c <= "9":
        return "0123456789", c
    if not c.isalpha():
        return "", c
    small = c.lower() if len(c.lower()) == 1 and cased(c.lower()) else c
    near = [chr(k) for k in range(ord(small) & ~63, (ord(small) | 63) + 1)]
    plain = lambda x: x.isalpha() and not cased(x) and not (len(x.lower()) == 1 and cased(x.lower()))
    return "".join(x for x in near if (cased(x) if cased(small) else plain(x))), small


class Pseudonymizer:
    """Replaces findings in texts; ``undo`` turns it round."""

    def __init__(self, key: bytes, undo: bool = False):
        c = Cipher(key)
        self.permute = c.decrypt if undo else c.encrypt

    def _digits(self, digits: str, tweak: str) -> str:
        n = len(digits)
        return f"{self.permute(int(digits), 10**n, f'{tweak}{n}'.encode()):0{n}d}" if n else ""

    def card(self, s: str) -> str | None:
        d = "".join(c for c in s if c.isdigit())
        if luhn_digit(d[:-1]) != d[-1]:
            return None
        new = self._digits(d[:-1], "card")
        return _refill(s, new + luhn_digit(new))

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
            return None
        body = _refill(flat[4:], self._digits("".join(c for c in flat[4:] if c.isdigit()), "iban" + flat[:2]))
        check = f"{98 - _mod97(body + flat[:2] + '00'):02d}"
        it = iter(flat[:2] + check + body)
        return "".join(" " if c == " " else next(it) for c in s)

    def ssn(self, s: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        d = s.replace("-", "")
        if not valid(d):
            return None
        while True:
            d = self._digits(d, "ssn")
            if valid(d):
                return _refill(s, d)

    def phone(self, s: str) -> str | None:
        d = "".join(c for c in s if c.isdigit())
        if not 8 <= len(d) <= 15:
            return None
        keep = max(len(d) - 10, 0) if len(d) > 11 or len(d) == 10 else len(d) - 10 if len(d) == 11 else 2
        return _refill(s, d[:keep] + self._digits(d[keep:], "phone"))

    def ip(self, s: str) -> str | None:
        if ":" in s:
            return self._ipv6(s)
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255:
            return None
        n = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
        return ".".join(str(x) for x in n.to_bytes(4, "big"))

    def _ipv6(self, s: str) -> str | None:
        try:
            ipaddress.IPv6Address(s)
        except ValueError:
            return None
        if not any(c.isdigit() for c in s):  # as in a::b of a program
            return None
        new = s
        while True:
            groups = [f"{self.permute(int(g, 16), 16 ** len(g), b'ip6-%d-%d' % (k, len(g))):0{len(g)}x}" if g else "" for k, g in enumerate(new.split(":"))]
            new = ":".join(groups)
            if any(c.isdigit() for c in new):
                return new.upper() if any("A" <= c <= "F" for c in s) else new

    def date(self, s: str) -> str | None:
        iso = not s[4].isdigit()
        y, m, d = (s[:4], s[5:7], s[8:]) if iso else (s[6:], s[3:5], s[:2])
        try:
            day = date(int(y), int(m), int(d)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        new = date.fromordinal(self.permute(day, _DAYS, b"date") + _FIRST_DAY)
        return new.isoformat().replace("-", s[4]) if iso else f"{new.day:02d}{s[2]}{new.month:02d}{s[5]}{new.year:04d}"

    def email(self, s: str) -> str | None:
        name, _, domain = s.partition("@")
        by: dict[str, list[str]] = {}
        for c in name:
            alphabet, small = _kind_of(c)
            by.setdefault(alphabet, []).append(small)
        new = {a: iter(self._in_base("".join(some), a, f"name{ord(a[0])}@{domain.lower()}")) if a else iter(some) for a, some in by.items()}
        out = []
        for c in name:
            alphabet, small = _kind_of(c)
            x = next(new[alphabet])
            out.append(x.upper() if small != c else x)
        return "".join(out) + "@" + domain

    def secret(self, s: str) -> str | None:
        if s[1:4] in ("KIA", "SIA"):
            return s[:4] + self._in_base(s[4:], _UPPER_KEY, "access key")
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
            return None
        n = len(s)
        x = f"{self.permute(int(s, 16), 16**n, b'secret%d' % n):0{n}x}"
        return x.upper() if s.isupper() else x

    def _in_base(self, text: str, alphabet: str, tweak: str) -> str:
        n, value = len(alphabet), 0
        for c in text:
            value = value * n + alphabet.index(c)
        value = self.permute(value, n ** len(text), f"{tweak}{len(text)}".encode()) if text else 0
        out = []
        for _ in text:
            value, k = divmod(value, n)
            out.append(alphabet[k])
        return "".join(reversed(out))

    def rewrite(self, text: str) -> tuple[str, list[dict]]:
        """The new text, and the kind and place (in characters of the old text) of each finding."""
        if not _MAY.search(text):
            return text, []
        spans: list[dict] = []
        out, done, at = [], 0, 0
        while m := _FIND.search(text, at):
            kind, start, end = m.lastgroup, m.start(), m.end()
            new = getattr(self, kind)(m.group())
            if new is None and kind == "iban":
                kind, end, new = self._inside(text, start, end)
            if new is None:
                at = end
                continue
            spans.append({"kind": kind, "start": start, "end": end})
            out += [text[done:start], new]
            done = at = end
        return "".join(out) + text[done:], spans

    def _inside(self, text: str, start: int, end: int) -> tuple[str, int, str | None]:
        """The longest IBAN that ends before a space of a match that is none, or a secret in its place; else where to search on."""
        cut = text.rfind(" ", start, end)
        while cut > start:
            new = self.iban(text[start:cut])
            if new is not None:
                return "iban", cut, new
            cut = text.rfind(" ", start, cut)
        m = _SECRET.match(text, start)
        new = self.secret(m.group()) if m else None
        return ("iban", start + 1, None) if new is None else ("secret", m.end(), new)


def rewrite_udf(key: bytes):
    def make():
        one = Pseudonymizer(key)

        def fn(texts: list) -> dict:
            both = [(None, []) if t is None else one.rewrite(t) for t in texts]
            return {"text": [b[0] for b in both], "spans": [b[1] for b in both]}

        return fn

    return text_udf(make, "text string, spans array<struct<kind:string,start:int,end:int>>")


_DRAWN: dict[str, bytes] = {}


def key_of(spark) -> bytes:
    """The key in the session setting ``parley.pii.secret.key`` (a name that Spark leaves out of its logs).

    Without the setting a random one is drawn for the application: values are linked in all it writes,
    nobody can undo them, and another application links nothing to them.
    """
    given = spark.conf.get("parley.pii.secret.key", None)
    return given.encode() if given else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonyms(docs: DataFrame, key: bytes, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the rewritten text, the number of findings of each kind, and their spans in the old text."""
    bounded_batches(docs.sparkSession)
    out = docs.select(*keep, rewrite_udf(key)("text").alias("s")).select(*keep, "s.text", "s.spans")
    return out.withColumns({f"n_{k}": F.expr(f"CAST(SIZE(FILTER(spans, x -> x.kind = '{k}')) AS LONG)") for k in KINDS})


def pseudonymized(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with rewritten texts, all other columns as they came (n_chars, where there is one, follows the text)."""
    bounded_batches(docs.sparkSession)
    (name,) = fresh(docs, "pii")
    out = docs.withColumn(name, rewrite_udf(key)("text")).withColumn("text", F.col(name)["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
