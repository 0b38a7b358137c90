"""MinHash near-duplicates with tensored banding.

Each distinct shingle set gets two collections of ``size`` sub-signatures of
``rows`` minhashes.  A table key pairs one of the first with one of the second
collection, so ``size**2`` tables cost ``2 * size * rows`` minhashes instead of
``size**2 * 2 * rows``.  Candidates that share a key are confirmed on whole sets.

Work stays bounded in hot groups: equal sets are one node; in each key only
hubs are compared with the others (two rounds, the second with the best linked
hub), links are contracted to components, and what is still apart is compared
pair by pair, in small keys by a join and in large ones in blocks.

Defined cases: a text that is null or has no word has an empty set, links with
nothing and is its own component.  Rows with equal sets are linked.  Null ids
take part but never name a component unless no other id is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, fresh, settle, text_udf
from .kernels import forest
from .minhash_kernel import Shingler

#: Pairs that agree in fewer sub-signatures are dropped unverified: at similarity 0.8
#: fewer of the 16 agree with probability 3e-5.
LEAST_AGREEING = 3
#: Keys with at most this many members are finished by a join of pairs, larger ones in blocks.
SMALL_KEY = 16
#: A block holds about so many sets, or so many shingles.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Up to so many ids (16 MB) are broadcast to find their texts; more are joined.
BROADCAST_IDS = 1_000_000


class Plan:
    """Parameters: words per shingle, least similarity in percent, and the two hash collections."""

    def __init__(self, width: int = 5, percent: int = 80, rows: int = 2, size: int = 8, seed: int = 20240917):
        self.width, self.percent, self.rows, self.size, self.seed = width, percent, rows, size, seed

    def shingler(self) -> Shingler:
        return Shingler(self.width, self.rows, self.size, self.seed)


def _signatures(plan: Plan):
    def make():
        sh = plan.shingler()

        def fn(texts: list) -> dict:
            sets = sh.sets([None if t is None else t.encode("utf-8", "replace") for t in texts])
            full = [s for s in sets if len(s)]
            sig = iter(sh.signatures(full))
            return {"n": [len(s) for s in sets], "node": [sh.identity(s) if len(s) else 0 for s in sets], "sig": [next(sig).tolist() if len(s) else [] for s in sets]}

        return fn

    return text_udf(make, "n long, node long, sig array<long>")


def _sets(plan: Plan):
    def make():
        sh = plan.shingler()

        def fn(texts: list) -> dict:
            sets = sh.sets([None if t is None else t.encode("utf-8", "replace") for t in texts])
            return {"node": [sh.identity(s) if len(s) else 0 for s in sets], "shingles": [s.view(np.int64).tolist() for s in sets]}

        return fn

    return text_udf(make, "node long, shingles array<long>")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


class _Run:
    def __init__(self, docs: DataFrame, plan: Plan):
        self.docs, self.plan = docs, plan
        self.spark = docs.sparkSession
        self.rows = settle(docs.select("doc_id", F.xxhash64("text").alias("fp"), _signatures(plan)("text").alias("s")).select("doc_id", "fp", "s.n", "s.node", "s.sig"))
        self.nodes = settle(self.rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity and whose sub-signatures do not speak against it."""
        p, side = self.plan.percent, self.nodes.select("node", "n", "sig")
        x = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
        agree = F.aggregate(F.zip_with("sa", "sb", lambda u, v: (u == v).cast("int")), F.lit(0), lambda t, e: t + e)
        return x.where((100 * F.least("na", "nb") >= p * F.greatest("na", "nb")) & (agree >= LEAST_AGREEING)).select("a", "b", "na", "nb")

    def whole_sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, made anew from one text of each."""
        reps = wanted.join(self.nodes.select("node", "rep"), "node").select("rep").distinct()
        reps = settle(reps)
        if reps.count() <= BROADCAST_IDS:
            reps = F.broadcast(reps)
        texts = self.docs.select("doc_id", "text").join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        sets = texts.select(_sets(self.plan)("text").alias("s")).select("s.*").where("node <> 0")
        return settle(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs confirmed on whole sets."""
        some = settle(self.plausible(pairs))
        sets = self.whole_sets(some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct())
        x = some.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
        x = x.withColumn("i", F.size(F.array_intersect("xa", "xb")))
        return settle(x.where(100 * F.col("i") >= self.plan.percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"))

    def apart(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """Members with their component, of keys that still hold several."""
        comp = components(links.toDF("u", "v"))
        x = members.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        keys = x.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        return x.join(keys, "key", "left_semi")

    def links(self) -> DataFrame:
        size = self.plan.size
        t = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1)))
        keys = self.nodes.select("node", "sig", t.alias("t")).select(
            "node",
            F.xxhash64("t", F.expr(f"sig[t div {size}]"), F.expr(f"sig[{size} + t % {size}]")).alias("key"),
        )
        multi = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
        members = settle(keys.join(multi, "key"))
        tried = _pairs(members.where("node <> hub"), "node", "hub")
        good = self.linked(tried)

        degree = good.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
        x = self.apart(members, good).join(degree, "node", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
        x = settle(x)
        best = x.groupBy("key").agg(F.max(F.struct("deg", "node", "comp")).alias("h"))
        second = _pairs(x.join(best, "key").where("comp <> h.comp").select("node", F.col("h.node").alias("top")), "node", "top")
        second = settle(second.join(tried, ["a", "b"], "left_anti"))
        good = settle(good.unionByName(self.linked(second)))

        rest = settle(self.apart(members, good).select("key", "node", "comp", "c"))
        small = rest.where(F.col("c") <= SMALL_KEY)
        other = small.select("key", F.col("node").alias("node2"), F.col("comp").alias("comp2"))
        third = _pairs(small.join(other, "key").where("node < node2 AND comp <> comp2"), "node", "node2")
        third = third.join(tried, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
        return good.unionByName(self.linked(third)).unionByName(self.in_blocks(rest.where(F.col("c") > SMALL_KEY)))

    def in_blocks(self, rest: DataFrame) -> DataFrame:
        """Links inside large keys.

        Members of a key share a sub-signature of the first collection; grouped by that, each set is
        sent once per column instead of once per key.  Sets of a group's largest component are compared
        with the others only, never with each other, so a hot group of which nearly all is linked is sent
        once, not once for each of its blocks.  Both sides are cut into blocks, and each pair of blocks is
        a task's unit, whatever the group's size.
        """
        size = self.plan.size
        nodes = settle(rest.select("node", "comp").distinct().join(self.nodes.select("node", "n", "sig"), "node"))
        sets = self.whole_sets(nodes.select("node"))
        g = nodes.select("node", "comp", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i"))
        g = g.withColumn("g", F.xxhash64("i", F.expr("sig[i]")))
        comps = g.groupBy("g", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
        per = comps.groupBy("g").agg(F.count("*").alias("k"), F.max(F.struct("c", "w", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w")).where("k > 1")
        blocks = lambda c, w: F.ceil(F.greatest(c / BLOCK_SETS, w / BLOCK_SHINGLES)).cast("int")
        # settled, so that the join below is of two plain exchanges, whose hot groups adaptive execution can split
        per = settle(per.select("g", F.col("top.comp").alias("main"), blocks(F.col("top.c"), F.col("top.w")).alias("nm"), blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("no")))
        g = g.join(per, "g").withColumn("is_main", F.col("comp") == F.col("main"))
        place = F.xxhash64("node", "g")
        g = g.withColumn("block", F.when(F.col("is_main"), F.pmod(place, "nm")).otherwise(F.col("nm") + F.pmod(place, "no")).cast("int"))
        first = F.when(F.col("is_main"), F.col("nm")).otherwise(F.lit(0))
        g = g.withColumn("other", F.explode(F.sequence(first, F.col("nm") + F.col("no") - 1)))
        g = g.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        g = g.join(sets, "node").select("g", "bi", "bj", "block", "i", "node", "comp", "n", "sig", "shingles")
        percent = self.plan.percent

        def compare(part: pd.DataFrame) -> pd.DataFrame:
            u, v = _block_links(part, percent, size)
            node, root = forest(u, v)
            apart = node != root
            return pd.DataFrame({"a": node[apart], "b": root[apart]})

        return settle(g.groupBy("g", "bi", "bj").applyInPandas(compare, "a long, b long"))

    def roots(self) -> DataFrame:
        """(node, rep, root) of every set."""
        comp = components(self.links().toDF("u", "v"))
        return self.nodes.select("node", "rep").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def result(self) -> DataFrame:
        named = self.roots()
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = named.join(least, "root").select("node", "component_id")
        rows = self.rows.join(named, "node", "left")
        rows = rows.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

    def kept(self) -> DataFrame:
        """(id, fp) of the document of each group with the smallest id, null ids last, and of all without words."""
        first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "fp")).alias("k")
        best = self.rows.where("n > 0").groupBy("node").agg(first).join(self.roots(), "node")
        best = best.groupBy("root").agg(F.min("k").alias("k")).select("k.id", "k.fp")
        return best.unionByName(self.rows.where("n = 0").select(F.col("doc_id").alias("id"), "fp")).distinct()


def _block_links(part: pd.DataFrame, percent: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of different components in one pair of blocks."""
    node, comp, n, block = (part[c].to_numpy() for c in ("node", "comp", "n", "block"))
    sig, i = np.stack(part["sig"].to_numpy()), int(part["i"].iloc[0])
    cross = part["bi"].iloc[0] != part["bj"].iloc[0]
    m = len(node)
    flat = np.concatenate(part["shingles"].to_numpy())
    row = np.repeat(np.arange(m), n)
    term, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    at, row = (np.cumsum(times > 1) - 1)[at[shared]], row[shared]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    one = np.flatnonzero(block == part["bi"].iloc[0])
    two = np.flatnonzero(block == part["bj"].iloc[0])
    inter = np.zeros((len(one), len(two)), dtype=np.float32)
    width = max(1024, (1 << 21) // max(m, 1))
    for lo in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(at, (lo, lo + width))
        dense = np.zeros((m, width), dtype=np.float32)
        dense[row[a:b], at[a:b] - lo] = 1
        inter += dense[one] @ dense[two].T
    both = n[one][:, None] + n[two][None, :]
    x, y = np.nonzero((100 * inter >= percent * (both - inter)) & (comp[one][:, None] != comp[two][None, :]))
    x, y = one[x], two[y]
    if not cross:
        x, y = x[x < y], y[x < y]
    first = (sig[x, :size] == sig[y, :size]).argmax(axis=1) == i
    return node[x[first]], node[y[first]]


def near_duplicates(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.  See the module's docstring."""
    bounded_batches(docs.sparkSession)
    return _Run(docs, plan or Plan()).result()


def keep_one(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The documents that stay: one of each group, that with the smallest id, all columns as they came.

    Rows with equal id and text are one document, of which one row stays.  Rows with one id, or
    none, but other texts are documents of their own.
    """
    bounded_batches(docs.sparkSession)
    fp, row, rank, its_id, its_fp = fresh(docs, "fp", "row", "rank", "its_id", "its_fp")
    kept = _Run(docs, plan or Plan()).kept().toDF(its_id, its_fp)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    out = docs.withColumn(fp, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(fp) == F.col(its_fp)), "left_semi")
    out = out.select("doc_id", fp, F.struct(*docs.columns).alias(row), F.xxhash64(*plain).alias(rank))
    return out.groupBy("doc_id", fp).agg(F.min_by(row, rank).alias(row)).select(f"{row}.*")
