"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words.  Each source's target comes from its weight, stopped at ``cap`` times
its size, the excess reshared.  Hashed positions cut a source into blocks, random sets of
documents, and an affine permutation puts the blocks in order.  What the mix takes of
a source is a sequence of blocks: as many whole passes over the permuted blocks as the
target holds, and of one more pass the blocks that fit into the rest.  The number of blocks in the
sequence is the source's quota.  The block after them is taken up to a position, found by
histograms that narrow until one document is left, and of that document the leading
words that are missing, so that a source comes to its target to the word.

How many blocks of each source every output shard gets is drawn by a tree: at each node
the quotas are split between the two halves of the shards by a multivariate
hypergeometric draw, so quotas come out exactly.  Each shard takes its run of the source's
sequence, disjoint from all others; how often a document is taken is the number of runs that hold its
block.  ``shards_of`` makes the shards, each shuffled by itself.

The driver holds a few numbers per source and shard and at most ``BLOCKS`` block sums at a
time, whatever the number of documents; sources are not limited, but their table is small
only as long as they are categories.  It is broadcast up to ``BROADCAST_CELLS``; beyond, the joins shuffle.

Defined cases: null texts have size 0 and are taken 0 words.  A null source is a source of its
own, last in order.  Rows repeated with id, source and text share their fate, and where
such rows are cut, each loses the same words, at most one word each below the target.  All
draws follow from ``seed`` and the rows alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, settle

GRID = 1 << 40
_FINE = 1 << 10  # positions are multiplied by up to 2**20 blocks, in 64 bits
#: Blocks of all sources together, as long as there are fewer sources; a source has at most ``MOST`` of them.
BLOCKS, MOST = 1 << 18, 1 << 12
BLOCK_DOCS = 64
#: Tables of up to so many rows, shards counted, are broadcast (16 MB).
BROADCAST_CELLS = 1 << 18


def targets(sizes: list[int], weights: tuple = (1, 2, 3), cap: int = 3) -> list[float]:
    """Each source's share of the sum of sizes by its weight, none above ``cap`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        above = [i for i in open_ if left * w[i] / total > cap * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in above:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= set(above)
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks per shard and source; columns add up to ``quotas``, rows are equal to within one tree rounding."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def part(lo: int, hi: int, quota: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid = (lo + hi) // 2
        n = int(quota.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng((seed, lo, hi))
        left = rng.multivariate_hypergeometric(quota, n, method="marginals")
        part(lo, mid, left)
        part(mid, hi, quota - left)

    if len(quotas):
        part(0, shards, quotas.astype(np.int64))
    return out


def block_counts(docs: list[int]) -> list[int]:
    """Blocks of each source: one for about 64 documents, fewer where that would be too many in all."""
    want = [max(1, min(MOST, n // BLOCK_DOCS)) for n in docs]
    over = max(1.0, sum(want) / BLOCKS)
    return [max(1, int(w / over)) for w in want]


def measured(docs: DataFrame, seed: int, keep: tuple) -> DataFrame:
    """The columns ``keep`` with src, size and position u."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 24)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, F.col("source").alias("src"), size.alias("size"), u.alias("u"))


def _block(u: str, b: str) -> Column:
    return F.expr(f"({u} DIV {_FINE}) * {b} DIV {GRID // _FINE}")


class Mix:
    """The decisions of a mix over ``rows`` (doc_id, src, size, u)."""

    def __init__(self, rows: DataFrame, weights: tuple, cap: int, shards: int, seed: int):
        self.spark, self.shards, self.seed, self.cap = rows.sparkSession, shards, seed, cap
        found = rows.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        found.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
        self.src = [r["src"] for r in found]
        self.size = [int(r["size"]) for r in found]
        self.target = targets(self.size, weights, cap)
        self.repeats = [min(cap, math.floor(t / s + 1e-9)) if s else 0 for t, s in zip(self.target, self.size, strict=True)]
        self.rest = [max(0, math.floor(t - r * s + 1e-6)) if r < cap else 0 for t, r, s in zip(self.target, self.repeats, self.size, strict=True)]
        self.blocks = block_counts([int(r["n"]) for r in found])
        rng = np.random.default_rng((seed, 1))
        self.turn = [self._affine(b, rng) for b in self.blocks]
        self.whole = [0] * len(self.src)  # blocks of the pass that is not whole
        self.below = [0] * len(self.src)  # what the block after them is taken up to
        self.cut = [(-1, 0)] * len(self.src)  # the position taken in part, and how many words
        self._choose(rows)
        ends = [int(b > 0 or w > 0) for b, (_, w) in zip(self.below, self.cut, strict=True)]
        quota = [r * b + p + e for r, b, p, e in zip(self.repeats, self.blocks, self.whole, ends, strict=True)]
        self.allotted = split(np.array(quota, dtype=np.int64), shards, seed)

    @staticmethod
    def _affine(b: int, rng: np.random.Generator) -> tuple[int, int]:
        """The place of block k in a source's order is (a k + c) modulo b."""
        a, c = int(rng.integers(1, b + 1)), int(rng.integers(0, b))
        while math.gcd(a, b) != 1:
            a = a % b + 1
        return a, c

    def _frame(self, schema: str, rows: list) -> DataFrame:
        """A table made on the driver, broadcast if it is small; a larger one is joined by shuffles that adaptive execution can split."""
        df = self.spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) * (1 + schema.count("array") * self.shards) <= BROADCAST_CELLS else df

    def _choose(self, rows: DataFrame) -> None:
        """The blocks, the position and the words that come to each source's rest."""
        need = [i for i, r in enumerate(self.rest) if r >= 1]
        if not need:
            return
        side = self._frame("i int, src_ string, b int", [(i, self.src[i], self.blocks[i]) for i in need])
        part = rows.where("size > 0").select("src", "u", "size").join(side, F.col("src").eqNullSafe(F.col("src_")))
        part = settle(part.select("i", "u", "size", _block("u", "b").alias("block")))
        words = {(r["i"], r["block"]): int(r["s"]) for r in part.groupBy("i", "block").agg(F.sum("size").alias("s")).collect()}
        span: dict[int, tuple[int, int]] = {}
        left = {}
        for i in need:
            b, (a, c) = self.blocks[i], self.turn[i]
            order = sorted(range(b), key=lambda k, a=a, b=b, c=c: (a * k + c) % b)
            left[i], at = self.rest[i], 0
            while at < b and words.get((i, order[at]), 0) <= left[i]:
                left[i] -= words.get((i, order[at]), 0)
                at += 1
            self.whole[i] = at
            if at < b and left[i]:
                k = order[at]
                lo, hi = (-(-k * (GRID // _FINE) // b)) * _FINE, (-(-(k + 1) * (GRID // _FINE) // b)) * _FINE
                span[i] = (lo, hi)
        while span:
            bins = max(2, min(1024, BLOCKS // len(span)))
            side = self._frame("i int, lo long, hi long, step long", [(i, lo, hi, max(1, -(-(hi - lo) // bins))) for i, (lo, hi) in span.items()])
            inside = part.join(side, "i").where("u >= lo AND u < hi").withColumn("bin", F.expr("(u - lo) DIV step"))
            sums: dict[int, dict] = {i: {} for i in span}
            for r in inside.groupBy("i", "bin").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("u").alias("first"), F.max("u").alias("last")).collect():
                sums[r["i"]][r["bin"]] = r
            again = {}
            for i, (lo, hi) in span.items():
                self.below[i] = hi
                for k in sorted(sums[i]):
                    r = sums[i][k]
                    if r["s"] <= left[i]:
                        left[i] -= int(r["s"])
                        continue
                    self.below[i] = r["first"]
                    if left[i] and r["first"] == r["last"]:
                        self.cut[i] = (r["first"], left[i] // r["n"])
                    elif left[i]:
                        again[i] = (r["first"], r["last"] + 1)
                    break
            span = again

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with source_size, target, copies, part (words of one more, partial copy), taken and the shard of each copy."""
        side = [
            (i, s, self.size[i], self.target[i], self.repeats[i], self.blocks[i], *self.turn[i], self.whole[i], self.below[i], *self.cut[i], np.cumsum(self.allotted[:, i]).tolist())
            for i, s in enumerate(self.src)
        ]
        side = self._frame("i_ int, src_ string, source_size long, target double, r_ int, b_ int, a_ long, c_ long, p_ int, below_ long, cut_ long, words_ long, ends_ array<long>", side)
        x = rows.join(side, rows["src"].eqNullSafe(side["src_"])).withColumn("block_", _block("u", "b_"))
        x = x.withColumn("place_", F.expr("(a_ * block_ + c_) % b_"))
        # the runs of the shards end with the sequence: r whole passes, p blocks of one more, and the block that is taken up to a position
        more = F.expr("place_ < p_ OR (place_ = p_ AND u < below_)").cast("int")
        x = x.withColumn("copies", F.when(F.col("size") > 0, F.col("r_") + more).otherwise(F.lit(0)))
        x = x.withColumn("part", F.when((F.col("size") > 0) & F.expr("place_ = p_ AND u = cut_"), F.least("words_", "size")).otherwise(F.lit(0).cast("long")))
        x = x.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
        shard = "SIZE(FILTER(ends_, e -> e <= pass * b_ + place_))"
        x = x.withColumn("shards", F.expr(f"IF(taken > 0, TRANSFORM(SEQUENCE(0, copies - 1 + IF(part > 0, 1, 0)), pass -> {shard}), CAST(ARRAY() AS ARRAY<INT>))"))
        return x.drop("i_", "u", "src_", "r_", "b_", "a_", "c_", "p_", "below_", "cut_", "words_", "ends_", "block_", "place_")


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3, shards: int = 16, seed: int = 9) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, part, taken, shards."""
    rows = settle(measured(docs, seed, ("doc_id",)))
    return Mix(rows, weights, cap, shards, seed).apply(rows).withColumnRenamed("src", "source")


def mixed(docs: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3, shards: int = 16, seed: int = 9) -> DataFrame:
    """All columns of ``docs``, each document once, with what the mix does with it."""
    (whole,) = fresh(docs, "whole")
    plan = Mix(settle(measured(docs, seed, ("doc_id",))), weights, cap, shards, seed)
    out = plan.apply(measured(docs, seed, (F.struct(*docs.columns).alias(whole),))).drop("src")
    added = ["size", "source_size", "target", "copies", "part", "taken", "shards"]
    return out.select(F.col(whole + ".*"), *[F.col(a).alias(b) for a, b in zip(added, fresh(docs, *added), strict=True)])


def leading_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word."""
    space = WORD.removesuffix("+").replace("[^", "[")
    return F.regexp_substr(text, F.concat(F.lit(f"^(?:{space}*+{WORD}+){{"), n.cast("string"), F.lit("}+")))


def shards_of(docs: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3, shards: int = 16, seed: int = 9, slices: int = 64) -> DataFrame:
    """The mix itself: one row per copy taken, all columns of ``docs`` with shard, copy and the number of words taken.

    A copy taken in part has the leading words of its text only (and n_chars, where there is one, follows it).
    A shard is dealt over ``slices`` by a random place and is in the order of that place within each.
    """
    (whole, name, number, turn) = fresh(docs, "whole", "shard", "words", "copy")
    rows = measured(docs, seed, ("doc_id", F.struct(*docs.columns).alias(whole)))
    plan = Mix(settle(measured(docs, seed, ("doc_id",))), weights, cap, shards, seed)
    out = plan.apply(rows).select(whole, "size", "copies", "part", F.posexplode("shards").alias(turn, name))
    place = F.xxhash64(F.lit(seed), name, turn, F.col(whole)["doc_id"], F.col(whole)["text"])
    out = out.withColumn("place_", place).withColumn("slice_", F.pmod("place_", F.lit(slices))).repartition(name, "slice_").sortWithinPartitions(name, "slice_", "place_")
    cut = F.col(turn) >= F.col("copies")
    text = F.when(cut, leading_words(F.col(whole)["text"], F.col("part"))).otherwise(F.col(whole)["text"])
    value = {c: F.col(whole)[c] for c in docs.columns} | {"text": text}
    if "n_chars" in value:
        value["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col(whole)["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in value.items()], name, turn, F.when(cut, F.col("part")).otherwise(F.col("size")).alias(number))
