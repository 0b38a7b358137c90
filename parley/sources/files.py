"""Files as sources and sinks: hashed scans, archives, CSV, JSON, blobs, manifests, stages and shards that resume.

All paths are of folders that all executors see and are read and written through Spark.  A write goes to
its place under Spark's commit protocol, so readers see whole files only.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact_json


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without it, a temporary one on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


# -- scans ---------------------------------------------------------------------------------------------------------------


def hashed_files(spark: SparkSession, path: str, pins: dict[str, str] | None = None) -> DataFrame:
    """Path, size and SHA-256 of files, and whether the pinned hash of a file's name is its own (null without a pin)."""
    f = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    pin = F.lit(None).cast("string")
    for name, value in (pins or {}).items():
        pin = F.when(F.col("path").endswith("/" + name), value).otherwise(pin)
    return f.withColumn("verified", F.col("sha256") == pin)


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                yield info.filename, (b"" if info.is_dir() else z.read(info))
        return
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
        for info in t:
            f = t.extractfile(info) if info.isfile() else None
            yield info.name if info.isfile() or info.isdir() else "/" + info.name, f.read() if f else b""


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """The members of tar and zip archives: name, bytes, hash, whether they are UTF-8.

    A name that is absolute or leads out of the archive, and a link or device, fails the job.  An archive is held
    in memory while it is unpacked, as it is compressed as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for name, data in _members(content):
                    if name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"unsafe member {name!r} of {where}")
                    if not name.endswith("/"):
                        yield pa.RecordBatch.from_pydict({"archive": [where], "name": [name], "content": [data]})

    f = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, content binary")
    return f.withColumns({"bytes": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256), "utf8": F.is_valid_utf8(F.col("content").cast("string"))})


def json_spans(files: DataFrame) -> DataFrame:
    """The items or members of the JSON value in each file (path, content): ordinal, key, exact byte span and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(path, k, None if key is None else json.loads(b'"%b"' % key), a, b - a, data[a:b]) for k, (key, a, b) in enumerate(exact_json.children(data))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SPAN_TYPES, strict=True)], names=_SPAN_NAMES)

    return files.select("path", "content").mapInArrow(run, "path string, ordinal long, key string, offset long, length long, raw binary")


_SPAN_NAMES = ["path", "ordinal", "key", "offset", "length", "raw"]
_SPAN_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def nested_rows(files: DataFrame, inner: str, fields: str) -> DataFrame:
    """A row for each entry of the array ``inner`` of each item of a top-level array, with both places and a place in all."""
    case = json_spans(files).select("path", F.col("ordinal").alias("case_index"), "offset", F.col("raw").cast("string").alias("raw"))
    item = F.from_json("raw", f"{inner} array<struct<{fields}>>")
    x = case.select("path", "case_index", "offset", F.posexplode(item[inner]).alias("row_index", "r")).select("path", "case_index", "row_index", "offset", "r.*")
    first = x.groupBy("case_index").agg(F.count("*").alias("n"))
    first = first.select(F.col("case_index").alias("c_"), (F.sum("n").over(Window.orderBy("case_index")) - F.col("n")).alias("before_"))  # a row a case
    return x.join(first, F.col("c_") == F.col("case_index")).withColumn("source_order", F.col("before_") + F.col("row_index")).drop("c_", "before_")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns text, quotes doubled, texts with line breaks and of any length."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, emptyValue="", nullValue="\\N")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, with the exact line beside its fields; wrong types become null."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", schema).alias("j")).select("line", "j.*")


# -- sinks ---------------------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> str:
    """Parquet with zstd, sorted within and between files if an order is given."""
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV that ``csv_table`` reads back exactly, but for the text \\N, which stands for null."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def write_lines(df: DataFrame, path: str, order: list[str] | None = None) -> str:
    """A compact JSON object a line, keys sorted, nulls kept."""
    df = df.orderBy(*order) if order else df
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    return path


def write_several(df: DataFrame, outputs: dict[str, Column], folder: str) -> dict[str, str]:
    """One pass over rows into several tables, by predicates: one partitioned write, each table a folder of its own."""
    name = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in outputs.items()]))
    df.withColumn("output", F.explode(name)).write.mode("overwrite").partitionBy("output").parquet(folder)
    return {n: f"{folder}/output={n}" for n in outputs}


def put_blobs(df: DataFrame, content: str, folder: str) -> DataFrame:
    """Contents stored once under the first two digits of their SHA-256, gzipped without a time; the digest of each row."""

    @F.pandas_udf("binary")
    def packed(values):
        return values.map(lambda v: gzip.compress(bytes(v), 6, mtime=0))

    rows = df.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    blobs = rows.groupBy("digest").agg(F.first(F.col(content).cast("binary")).alias("raw"))
    blobs.select("digest", F.octet_length("raw").cast("long").alias("bytes"), packed("raw").alias("blob"), F.substr("digest", F.lit(1), F.lit(2)).alias("part")).write.mode("overwrite").partitionBy("part").parquet(folder)
    return rows.drop(content)


def get_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored contents unpacked; one that is not what its name says fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [gzip.decompress(b) for b in batch.column("blob").to_pylist()]
            for name, r in zip(batch.column("digest").to_pylist(), raw, strict=True):
                if hashlib.sha256(r).hexdigest() != name:
                    raise ValueError(f"blob {name} is broken")
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(raw, pa.binary())], names=["digest", "content"])

    return spark.read.parquet(folder).select("digest", "blob").mapInArrow(run, "digest string, content binary")


def views(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """A temporary view of each Parquet path; a second name of a table is a second view, not a copy."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return sorted(tables)


def schema_inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The columns of tables: type, whether they can be null, and the number of rows."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    out = spark.createDataFrame(rows, "table string, place int, column string, type string, nullable boolean")
    counts = None
    for t, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return out.join(counts, "table")


# -- caches, stages, shards ----------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: str, prefer: Column) -> DataFrame:
    """One row a key, the one that is preferred most; of equal ones, that of ``new``."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)), allowMissingColumns=True)
    rest = F.struct(*[c for c in both.columns if c not in (key, "new_")])
    return both.groupBy(key).agg(F.max_by(rest, F.struct(prefer.alias("p_"), "new_")).alias("r_")).select(key, "r_.*")


def stage(spark: SparkSession, folder: str, name: str, inputs: dict, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table of a stage, made anew only if its inputs changed; the marker of the inputs' hash is written last."""
    key = hashlib.sha256(json.dumps(inputs, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    at = f"{folder}/{name}/{key[:16]}"
    if force or not _exists(spark, f"{at}/done/_SUCCESS"):
        make().write.mode("overwrite").parquet(f"{at}/rows")
        spark.range(1).select(F.lit(key).alias("key")).coalesce(1).write.mode("overwrite").parquet(f"{at}/done")
    return spark.read.parquet(f"{at}/rows")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def resume_shards(todo: DataFrame, key: str, shards: int, folder: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results by shard of a key's hash; shards that an earlier run finished are read, the others made.

    A shard is one partition folder, which appears whole or not at all.
    """
    spark = todo.sparkSession
    todo = todo.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    done = spark.read.parquet(folder).select("shard").distinct() if _exists(spark, f"{folder}/shard=*") else None
    left = todo.join(done, "shard", "left_anti") if done is not None else todo
    out = make(left.drop("shard")).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    out.repartition("shard").write.mode("append").partitionBy("shard").parquet(folder)
    return spark.read.parquet(folder) if _exists(spark, f"{folder}/shard=*") else out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and one hash over the hashes of all files of a table, in the order of their names."""
    f = hashed_files(spark, f"{path}/*.parquet")
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]), ","), 256)
    return f.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), digest.alias("sha256"))


def review_page(rows: DataFrame, title: str, limit: int = 200) -> str:
    """A small HTML packet of at most ``limit`` rows (a review's size), all values escaped."""
    from html import escape

    body = "".join("<section>" + "".join(f"<h3>{escape(k)}</h3><pre>{escape('' if v is None else str(v))}</pre>" for k, v in r.asDict().items()) + "</section>" for r in rows.limit(limit).collect())
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>{body}"
