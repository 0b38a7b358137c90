"""Relational building blocks: one-row picks, resolution, as-of and registry operators, all lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def extreme(df: DataFrame, keys: list[str], order: Column, latest: bool = True) -> DataFrame:
    """The row with the greatest (or least) ``order`` of each key, by a map-side combined aggregate instead of a sort."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    pick = (F.max_by if latest else F.min_by)(rest, order)
    return df.groupBy(*keys).agg(pick.alias("r_")).select(*keys, "r_.*")


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tie: str, value: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before it: one sort of the union, no range join."""
    cols = [c for c in left.columns if c != key]
    both = left.select(key, F.col(left_time).alias("t_"), F.lit(1).alias("side_"), F.lit(None).cast("long").alias("tie_"), F.struct(*cols).alias("l_"), *[F.lit(None).cast(right.schema[v].dataType).alias("v_" + v) for v in value])
    other = right.select(key, F.col(right_time).alias("t_"), F.lit(0).alias("side_"), F.col(tie).cast("long").alias("tie_"), F.lit(None).cast(both.schema["l_"].dataType).alias("l_"), *[F.col(v).alias("v_" + v) for v in value])
    w = Window.partitionBy(key).orderBy("t_", "side_", "tie_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = F.last(F.when(F.col("side_") == 0, F.struct(*["v_" + v for v in value])), ignorenulls=True).over(w)
    out = both.unionByName(other).withColumn("p_", picked).where("side_ = 1")
    return out.select(key, *[F.col("l_." + c) for c in cols], *[F.col("p_.v_" + v).alias("asof_" + v) for v in value])


def append_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old rows, and new rows whose key was never issued."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def islands(df: DataFrame, keys: list[str], order: str, same: str) -> DataFrame:
    """A run number for consecutive rows that agree in ``same``."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = (~F.col(same).eqNullSafe(F.lag(same).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    return df.withColumn("change_", change).withColumn("run", F.sum("change_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("change_")


def unique_resolution(rows: DataFrame, key: list[str], candidate: str) -> DataFrame:
    """How many distinct candidates each key has, and the candidate where it is the only one."""
    g = rows.groupBy(*key).agg(F.count_distinct(candidate).alias("n_candidates"), F.min(candidate).alias("one_"))
    return g.withColumn("resolved", F.when(F.col("n_candidates") == 1, F.col("one_"))).drop("one_")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; without one (single machine) keep the rows."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def roots(edges: DataFrame) -> DataFrame:
    """Depth and root of every node of (node, parent) by pointer doubling: log2(depth) joins.

    A node without a parent, or whose parent is no node, is a root.  Round r finishes the nodes
    of depth up to 2**r; depths have no gaps, so when a round finishes none the rest run into
    a cycle: they get neither depth nor root, and ``cycle`` is true.
    """
    known = edges.select(F.col("node").alias("parent"), F.lit(True).alias("is_node"))
    cur = edges.select("node", "parent").join(known, "parent", "left")
    top = F.col("is_node").isNull()
    cur = settle(cur.select("node", F.when(top, F.col("node")).otherwise(F.col("parent")).alias("up"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done")))
    left = cur.where("NOT done").count()
    while left:
        step = cur.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("done").alias("done2"))
        moved = cur.where("NOT done").join(step, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("done2").alias("done"))
        cur = settle(cur.where("done").unionByName(moved))
        now = cur.where("NOT done").count()
        if now == left:
            break
        left = now
    good = F.col("done")
    return cur.select("node", F.when(good, F.col("up")).alias("root"), F.when(good, F.col("depth")).alias("depth"), (~good).alias("cycle"))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows with equal keys whose half-open spans (a0, a1) and (b0, b1) share a place, as an equi-join.

    Each span goes to every stretch of ``width`` places it touches, and a pair counts in the first stretch that both touch.
    """
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))).alias("cell_")
    x = a.where("a0 < a1").select("*", cut("a0", "a1")).join(b.where("b0 < b1").select("*", cut("b0", "b1")), [*keys, "cell_"])
    return x.where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")) & (F.col("cell_") == F.floor(F.greatest("a0", "b0") / width))).drop("cell_")


def narrowed(rows: DataFrame, keys: list[str], steps: list[Column]) -> DataFrame:
    """Candidates of each key, narrowed step by step; a step that would leave none is left out.

    All steps in one sort by the key: a row's flags are compared with the best that a step can have among the rows still there.
    """
    rows = rows.withColumn("in_", F.lit(True))
    w = Window.partitionBy(*keys)
    for step in steps:
        fits = F.col("in_") & F.coalesce(step, F.lit(False))
        rows = rows.withColumn("in_", F.when(F.max(fits).over(w), fits).otherwise(F.col("in_")))
    return rows.where("in_").drop("in_")


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """A global dense rank by a column: its distinct values are numbered, and joined back."""
    values = df.select(column).distinct()
    rank = F.row_number().over(Window.orderBy(F.col(column).asc_nulls_last())).cast("long")
    right = values.select(F.col(column).alias("value_"), rank.alias(name))
    return df.join(right, F.col(column).eqNullSafe(F.col("value_"))).drop("value_")


def ranked_values(df: DataFrame, key: str, value: str, ranks: dict[str, Column], bins: int = 1024) -> DataFrame:
    """The values at some ranks (from 0; columns of n, the number of rows) of each key, as columns, with n, lo and hi.

    Values are counted in bins of equal width; only the rows of the bins that hold a rank are looked at
    again, counted by value first.  So a sort sees a bin of a key, never a key.
    """
    whole = df.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    whole = whole.withColumnRenamed(key, "k_")
    x = df.select(F.col(key).alias("key_"), F.col(value).alias("v_")).join(whole, F.col("key_").eqNullSafe(F.col("k_")))
    place = F.floor((F.col("v_") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    x = x.select("key_", "v_", F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).alias("bin_"))
    counts = x.groupBy("key_", "bin_").agg(F.count("*").alias("c_"))
    upto = F.sum("c_").over(Window.partitionBy("key_").orderBy("bin_"))
    counts = counts.withColumn("before_", upto - F.col("c_"))
    wanted = whole.select("k_", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()])).alias("w")).select("k_", "w.*")
    hold = counts.join(wanted, F.col("key_").eqNullSafe(F.col("k_"))).where("rank >= before_ AND rank < before_ + c_").select(F.col("key_").alias("k_"), F.col("bin_").alias("b_"), "name", F.col("rank") - F.col("before_"))
    hold = hold.toDF("k_", "b_", "name", "place")
    some = x.join(hold.select("k_", "b_").distinct(), F.col("key_").eqNullSafe(F.col("k_")) & (F.col("bin_") == F.col("b_")), "left_semi")
    values = some.groupBy("key_", "bin_", "v_").agg(F.count("*").alias("c_"))
    values = values.withColumn("end_", F.sum("c_").over(Window.partitionBy("key_", "bin_").orderBy("v_")))
    found = values.join(hold, F.col("key_").eqNullSafe(F.col("k_")) & (F.col("bin_") == F.col("b_"))).where("place < end_ AND place >= end_ - c_")
    found = found.groupBy("key_").pivot("name", list(ranks)).agg(F.first("v_"))
    return whole.join(found, F.col("key_").eqNullSafe(F.col("k_"))).drop("key_").withColumnRenamed("k_", key)
