"""Session, checkpoint and Arrow helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as runs of bytes other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Where the setting is absent and all threads are of this process (tests), a temporary folder is
    set once for the session and removed at exit; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="parley-")
        atexit.register(shutil.rmtree, local, True)
        at = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession, records: int = 512) -> None:
    """Keep Arrow batches small, as one text may be very long.

    This lowers two settings of the session, to the same values for every operator, as a lazy plan
    runs under what holds when it runs; smaller values of the caller stay.
    """
    for name, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", 16 << 20)):
        have = str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).removesuffix("b")
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_udf(make: Callable[[], Callable[[list], dict]], schema: str) -> Callable[..., Column]:
    """A column function over texts.

    ``make`` runs once per Python worker task and returns a function from a list of texts
    (None for null) to columns.  Marked nondeterministic only so that Catalyst never
    copies a costly call into both a filter and a projection.
    """

    import pandas as pd  # here, as workers of operators without texts need none

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = make()
        for texts in batches:
            yield pd.DataFrame(fn(texts.where(texts.notna(), None).tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema).asNondeterministic()


def spread(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Remainder classes that held-out folds use: crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string"))


def labelled_sample(docs: DataFrame, rows: int, chars: int, label: str) -> list:
    """At most about ``rows`` labelled texts of at most ``chars`` characters, spread by a hash of the id.

    A bounded training sample: two small jobs, one to count and one to fetch.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull() & (F.length("text") <= chars))
    n = usable.count()
    if not n:
        return []
    share = min(1.0, rows / n)
    keep = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True)
    picked = usable.where(keep).select("doc_id", "text", label).collect()
    return sorted(((r["doc_id"], r["text"], r[label]) for r in picked), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


#: A graph of at most so many edges (1 MB) is finished in one task instead of hundreds of tiny ones.
ONE_TASK_EDGES = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (node, root), root the smallest node; roots themselves are left out.

    Alternating large-star and small-star steps, each a map-side combined
    minimum and a join that adaptive execution can split, until every node
    hangs on one root.  Each step ends in the shared folder.  Edges are counted
    first; those of a small graph lie in one partition, where no step shuffles.
    """
    e = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    small = e.count() <= ONE_TASK_EDGES
    while True:
        e = e.coalesce(1) if small else e
        if _is_forest(e):
            break
        both = _least(_each(e, ("u", "v"), ("v", "u")), small)
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        star = _each(_least(large, small), ("v", "m"), ("u", "m"))
        e = settle(star.where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _each(e: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each of some pairs of columns."""
    one = F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("p")
    return e.select(one).select("p.*")


def _least(e: DataFrame, small: bool) -> DataFrame:
    """The edges with the least v of each u as m.  In one partition a window needs no shuffle; else hot keys need the join."""
    if small:
        return e.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")


def _is_forest(e: DataFrame) -> bool:
    """Whether each u has one v that is no u itself."""
    one = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("p")
    bad = e.select(one).select("p.*").groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 OR (up > 0 AND low = 0)")
    return bad.limit(1).count() == 0
