"""Near-duplicate embeddings by collision-counting projections.

Only vectors of one label (and one length) are compared, by cosine.  Unit vectors
whose cosine is ``cosine`` lie at distance d = sqrt(2 - 2 cosine), so their
projections on a random Gaussian line differ by a normal variable of deviation d.

Each of ``tables`` tables sorts the vectors along a line of its own, inside cells that
some more lines cut; two vectors collide in a table if they share the cell and lie
within a window around each other along the line.  A pair is verified if it collides in
at least ``count`` tables.  The number of tables follows from the lines per cell (more for
more vectors, so that cells stay small) such that a pair at exactly the least cosine
reaches the count except with probability ``MISS``.

No pair leaves its task: a row carries its place in all tables, so the task of the
first table in which a pair collides counts its collisions and verifies it.  What
leaves are link counts and spanning edges, one row per vector and batch.  Large cells are
cut into blocks and each pair of blocks is a unit of its own.  Equal vectors are one
class with a multiplicity.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components, or has no label, links with nothing and is its own component.  Null ids
take part but never name a component unless no other id is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, settle
from .kernels import U64, forest, mix64

MISS = 1e-7
CELL, WINDOW = 6.0, 2.5  # in deviations d
BLOCK_ROWS = 1024
PAIRS = 1 << 17


class Plan:
    """Lines, cells and counts for at most ``most`` vectors of a label."""

    def __init__(self, cosine: float = 0.98, most: int = 1, seed: int = 77):
        self.cosine, self.seed = cosine, seed
        d = math.sqrt(2 - 2 * cosine)
        self.width, self.window = CELL * d, np.float32(WINDOW * d + 1e-5)  # coordinates are rounded to 32 bits
        share = min(0.9, self.width / math.sqrt(4 * math.pi))  # of unlike vectors that share a cell of one line
        self.cuts = max(2, math.ceil(math.log(max(most, 2) / 2000) / -math.log(share)))
        stay = 1 - math.sqrt(2 / math.pi) / CELL
        p = stay**self.cuts * math.erf(WINDOW / math.sqrt(2))
        self.count = 2
        self.tables = next(g for g in range(self.count, 10_000) if self._missed(g, p) <= MISS)

    def _missed(self, g: int, p: float) -> float:
        return sum(math.comb(g, k) * p**k * (1 - p) ** (g - k) for k in range(self.count))

    def lines(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions (dim, tables, cuts + 1), the last of each table sorts, and the cells' offsets."""
        rng = np.random.default_rng((self.seed, dim))
        return rng.standard_normal((dim, self.tables, self.cuts + 1)), rng.uniform(0, self.width, (self.tables, self.cuts))

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (32 bits, by which vectors are also brought together) and sorted coordinate of each unit vector in each table."""
        a, shift = self.lines(x.shape[1])
        y = np.tensordot(x, a, axes=1)
        cell = np.floor((y[:, :, :-1] + shift) / self.width).astype(np.int64).view(U64)
        key = np.zeros(cell.shape[:2], dtype=U64) + U64(x.shape[1])
        with np.errstate(over="ignore"):
            for k in range(self.cuts):
                key = mix64(key * U64(0x9E3779B97F4A7C15) + cell[:, :, k])
        return (key >> U64(32)).astype(np.uint32).view(np.int32), y[:, :, -1].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, safe from overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _places_udf(plan: Plan, kind: type):
    """The vectors as bytes of their own precision, their cells, and their cells and coordinates as bytes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            n = len(vectors)
            packed, cells, at = [None] * n, [None] * n, [None] * n
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims).tolist():
                where = np.flatnonzero(dims == dim)
                x = np.stack([vectors.iloc[i] for i in where]).astype(kind)
                key, y = plan.places(unit(x))
                for i, v, k, s in zip(where.tolist(), x, key, y, strict=True):
                    packed[i], cells[i], at[i] = v.tobytes(), k, k.tobytes() + s.tobytes()
            yield pd.DataFrame({"v": packed, "cells": cells, "at": at})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "v binary, cells array<int>, at binary").asNondeterministic()


class _Units:
    """Compares the vectors of complete units: rows sorted by unit, then by the table's coordinate."""

    def __init__(self, plan: Plan, kind: type):
        self.plan, self.kind = plan, kind

    def __call__(self, part: pa.Table) -> pa.RecordBatch:
        col = lambda c: part.column(c).to_numpy()
        g, tables = col("g"), self.plan.tables
        both = np.frombuffer(b"".join(part.column("at").to_pylist()), dtype=np.int32).reshape(len(g), 2 * tables)
        cells, at = both[:, :tables], both[:, tables:].view(np.float32)
        s = at[np.arange(len(g)), g]
        unit_of = _runs(part)
        order = np.lexsort((s, unit_of))
        g, cells, at, s, unit_of = g[order], cells[order], at[order], s[order], unit_of[order]
        node, times, block = (col(c)[order] for c in ("node", "times", "block"))
        cross = (col("bi") != col("bj"))[order]
        vectors = part.column("v").take(pa.array(order)).to_pylist()
        us, vs = [], []
        live, k = np.arange(len(g)), 0
        while len(live):
            k += 1
            live = live[live + k < len(g)]
            other = live + k
            live = live[(unit_of[live] == unit_of[other]) & (s[other] - s[live] <= self.plan.window)]
            take = live[~cross[live] | (block[live] != block[live + k])]
            for lo in range(0, len(take), PAIRS):
                u = take[lo : lo + PAIRS]
                v = u + k
                hit = (cells[u] == cells[v]) & (np.abs(at[u] - at[v]) <= self.plan.window)
                ok = (hit.argmax(axis=1) == g[u]) & (hit.sum(axis=1) >= self.plan.count)
                us.append(u[ok])
                vs.append(v[ok])
        u, v = np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)])
        sure = np.zeros(len(u), dtype=bool)
        for lo in range(0, len(u), PAIRS // 8):
            a, b = u[lo : lo + PAIRS // 8], v[lo : lo + PAIRS // 8]
            names, back = np.unique(np.concatenate((a, b)), return_inverse=True)
            # vectors of other lengths share no unit, but can share a batch
            size = np.array([len(vectors[i]) for i in names])
            x = np.zeros((len(names), size.max() // np.dtype(self.kind).itemsize))
            for n in np.unique(size).tolist():
                some = np.flatnonzero(size == n)
                raw = np.frombuffer(b"".join(vectors[i] for i in names[some]), dtype=self.kind).reshape(len(some), -1)
                x[some, : raw.shape[1]] = unit(raw)
            sure[lo : lo + len(a)] = (x[back[: len(a)]] * x[back[len(a) :]]).sum(axis=1) >= self.plan.cosine
        u, v = u[sure], v[sure]
        name, links, root = np.zeros((3, 0), dtype=np.int64)
        if len(u):
            # equal nodes of several units are one
            name, root = forest(node[u], node[v])
            links = np.zeros(len(name), dtype=np.int64)
            np.add.at(links, np.searchsorted(name, node[u]), times[v])
            np.add.at(links, np.searchsorted(name, node[v]), times[u])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (name, links, root)], names=["node", "links", "root"])


def _runs(part: pa.Table) -> np.ndarray:
    """A number for each run of rows of one unit."""
    change = np.zeros(part.num_rows, dtype=bool)
    for c in ("key", "bi", "bj"):
        x = part.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def _stream(plan: Plan, kind: type):
    """Whole units from batches of rows sorted by unit; only the last unit, which may go on, is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare, held = _Units(plan, kind), []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = _runs(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch]))[1 if held else 0 :]
            first = int(np.searchsorted(runs, runs[-1]))  # where the last unit of this batch begins
            if runs[-1] == 0 and held:
                held.append(batch)  # it all belongs to the unit that is held
                continue
            if held or first:
                yield compare(pa.Table.from_batches([*held, batch.slice(0, first)]))
            held = [batch.slice(first)]
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def linked(vectors: DataFrame, cosine: float = 0.98, seed: int = 77) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.  See the module's docstring."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    node = F.when(fine & F.coalesce(finite, F.lit(False)), F.xxhash64("label", e))
    rows = settle(vectors.select("vec_id", "label", "embedding").withColumn("node", node))
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    classes = settle(classes)
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    plan = Plan(cosine, most, seed)
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    placed = classes.select("node", "label", "times", _places_udf(plan, kind)("embedding").alias("p")).select("node", "label", "times", "p.v", "p.cells", "p.at")
    placed = settle(placed)
    key = F.xxhash64("label", "g", "cell").alias("key")
    narrow = placed.select("node", "label", F.posexplode("cells").alias("g", "cell")).select(key)
    full = narrow.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("nb"))
    x = placed.select("*", F.posexplode("cells").alias("g", "cell")).withColumn("key", key).drop("label", "cell").join(full, "key")
    x = x.withColumn("block", F.pmod(F.xxhash64("node", "g"), "nb").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    x = x.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    x = x.select("key", "bi", "bj", "block", "g", "node", "times", "v", "at")
    found = settle(x.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_stream(plan, kind), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.select("node", "rep", "times").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("node", "component_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
