"""Benchmark decontamination with one Aho-Corasick automaton over item windows.

Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII bytes.
A window is 13 consecutive words of an item; an item with fewer words, but not
none, is one window.  A text is scanned once, whatever the number of windows; word
positions map back to character offsets of the original text.

Defined cases: a null or wordless text has no words, no hits and is clean.  An
item whose text is null or wordless has no window.  An item without an id still
marks words but is not listed.  Rows with one item_id are one item.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, settle, text_udf

WINDOW = 13
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The bytes of words, with A-Z lower-cased; all others become spaces.
_PLAIN = bytes(c + 32 * (65 <= c <= 90) if _WORD.match(bytes([c + 32 * (65 <= c <= 90)])) else 32 for c in range(256))
#: An automaton holds items of about so many bytes (some 400 MB in a worker); a larger benchmark takes a pass for each shard.
AUTOMATON_BYTES = 4 << 20
FOUND = "n_words long, runs array<struct<start:int,end:int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_PLAIN).split()


class Items:
    """The items of a benchmark in shards of bounded size, of which the driver fetches one at a time; normally there is one."""

    def __init__(self, benchmark: DataFrame, limit: int):
        self.rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("id"), "text")
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.shards = max(1, -(-total // limit))

    def shard(self, k: int) -> list[tuple]:
        one = F.pmod(F.xxhash64("id", "text"), F.lit(self.shards)) == k
        return sorted((tuple(r) for r in self.rows.where(one).distinct().collect()), key=lambda r: (r[0] or "", r[1]))


class Scanner:
    """An automaton that finds every occurrence of every window of some items.

    Any 13 consecutive words hold one whole aligned block of 7, so the automaton has
    the disjoint 7-word blocks of each item (short items as they are), and its size
    is that of the items, not 13 times that.  A block found is extended to both
    sides along its item; a common run of 13 words or more consists of windows.

    Blocks and texts are written as words with one space before, between and after
    them, so a match can only begin and end at word boundaries.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, step = window, (window + 1) // 2
        self.items = [(item, words(text)) for item, text in items]
        places: dict[tuple, list] = {}
        for k, (_, seq) in enumerate(self.items):
            if len(seq) >= window:
                for i in range(0, len(seq) - step + 1, step):
                    places.setdefault(tuple(seq[i : i + step]), []).append((k, i))
            elif seq:
                places.setdefault(tuple(seq), []).append((k, 0))
        self.automaton = ahocorasick.Automaton()
        for key, where in places.items():
            self.automaton.add_word(f" {b' '.join(key).decode()} ", (len(key), where))
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes], hit: bytearray, who: set) -> None:
        """Mark the words inside any occurrence, and collect the items."""
        if self.empty or not found:
            return
        matches = list(self.automaton.iter(f" {b' '.join(found).decode()} "))
        if not matches:
            return
        after = np.cumsum([len(w.decode()) + 1 for w in found])  # where the space after each word is
        last = np.searchsorted(after, [m[0] for m in matches]).tolist()
        done: dict[tuple, int] = {}  # how far a diagonal of (item, offset) was compared
        for end, (_, (length, where)) in zip(last, matches, strict=True):
            for k, i in where:
                item, seq = self.items[k]
                a, b, shift = end + 1 - length, end + 1, i - (end + 1 - length)
                if done.get((k, shift), 0) >= b:
                    continue
                while a > 0 and a + shift > 0 and found[a - 1] == seq[a - 1 + shift]:
                    a -= 1
                while b < len(found) and b + shift < len(seq) and found[b] == seq[b + shift]:
                    b += 1
                done[k, shift] = b
                if b - a >= min(self.window, len(seq)):
                    hit[a:b] = b"\1" * (b - a)
                    who.add(item)


def _spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character ranges of runs of words in the original text."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    # bytes to characters: continuation bytes do not count
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[at[a][0]]), "end": int(chars[at[b - 1][1]])} for a, b in runs]


#: The automaton of this Python worker, by its scan: built once, whatever the number of tasks.
_HELD: dict[str, Scanner] = {}


def scan_udf(spark: SparkSession, items: list[tuple], window: int = WINDOW) -> Callable:
    """A column function from a text to the words found by one automaton: n_words, runs of word numbers, items."""
    shared = spark.sparkContext.broadcast(items)  # at most AUTOMATON_BYTES and one item
    number = uuid.uuid4().hex

    def make():
        if number not in _HELD:
            _HELD.clear()
            _HELD[number] = Scanner(shared.value, window)
        one = _HELD[number]

        def fn(texts: list) -> dict:
            sizes, runs, items = [], [], []
            for t in texts:
                found = words(t)
                hit, who = bytearray(len(found)), set()
                one.scan(found, hit, who)
                sizes.append(len(found))
                runs.append(_runs(np.frombuffer(hit, dtype=np.uint8)))
                items.append(sorted(x for x in who if x is not None))
            return {"n_words": sizes, "runs": runs, "items": items}

        return fn

    return text_udf(make, FOUND)


def _runs(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)]


def _joined(runs: Column) -> Column:
    """Sorted disjoint ranges from the ranges of several passes."""
    first = F.array_sort(F.flatten(runs))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= r["start"]), longer).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(first, none, add)


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a column (its name follows) of FOUND.  Each shard of the items is one pass, written to the shared folder if there are several."""
    bounded_batches(docs.sparkSession)
    items = Items(benchmark, limit or AUTOMATON_BYTES)
    names = fresh(docs, *[f"scan{k}" for k in range(items.shards)], "scan")
    for k, name in enumerate(names[:-1]):
        docs = docs.withColumn(name, scan_udf(docs.sparkSession, items.shard(k), window)("text"))
        docs = settle(docs) if items.shards > 1 else docs
    if items.shards == 1:
        return docs, names[0]
    each = lambda f: F.array(*[F.col(n)[f] for n in names[:-1]])
    whole = F.struct(F.col(names[0])["n_words"].alias("n_words"), _joined(each("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(each("items")))).alias("items"))
    return docs.withColumn(names[-1], whole).drop(*names[:-1]), names[-1]


def _hits(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def spans_of(text: str | None, runs) -> list[dict]:
    """Character ranges in the original text of runs of words."""
    return _spans(text, [(r["start"], r["end"]) for r in runs]) if runs is not None and len(runs) else []


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple = ("doc_id",), limit: int | None = None) -> DataFrame:
    """The columns ``keep`` and, per document, n_words, n_hit, items, spans (characters) and contaminated."""
    marked, name = scanned(docs.select(*keep, "text"), benchmark, window, limit)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([spans_of(t, r) for t, r in zip(texts, runs, strict=True)])

    s = F.col(name)
    out = marked.select(*keep, s["n_words"].alias("n_words"), _hits(s["runs"]).alias("n_hit"), s["items"].alias("items"), spans("text", s["runs"]).alias("spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """Item counts and the hash of the sorted item ids in place of the lists."""
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean documents, all columns as they came."""
    marked, name = scanned(docs, benchmark)
    n, hit = F.col(name)["n_words"], _hits(F.col(name)["runs"])
    return marked.where(~((hit > 0) & (20 * hit >= n))).select(*docs.columns)


def sha256_of(items: list[str]) -> str:
    """The digest of a sorted list of item ids, as ``digest`` has it."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
