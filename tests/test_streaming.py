"""Streams against their batch forms, over files that arrive one by one."""

from pyspark.sql import functions as F

from parley.plans import registry
from parley.streaming import sessions

SF = "/root/testdata/sf0.001"


def arriving(spark, tmp_path, parts=4):
    """Events in files, each later than the one before, as a stream of one file a batch."""
    src = spark.read.parquet(f"{SF}/events.parquet")
    rows = src.orderBy("ts", "event_id").collect()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], src.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return src, sessions.bounded_batches(spark, f"{tmp_path}/in", src.schema)


def drained(query):
    query.awaitTermination(180)
    assert query.exception() is None
    return query


def test_windows_and_deduplication(spark, tmp_path):
    src, _ = arriving(spark, tmp_path)
    stream = sessions.read_events(spark, f"{tmp_path}/in", src.schema, late="400 days")
    for name, df in (("gaps", sessions.sessions(stream)), ("once", sessions.deduplicated(stream.unionByName(stream)).groupBy().count())):
        drained(df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start())
    batch = registry.queries()["session_windows"](spark, SF)
    assert sorted((r["user_id"], r["n"]) for r in spark.table("gaps").collect()) == sorted((r["user_id"], r["n"]) for r in batch.collect())
    assert spark.table("once").first()[0] == src.count()


def test_keyed_reverts(spark, tmp_path):
    _, stream = arriving(spark, tmp_path)
    drained(sessions.keyed_reverts(stream).writeStream.format("memory").queryName("reverts").outputMode("append").trigger(availableNow=True).start())
    batch = registry.queries()["identity_reverts"](spark, SF).collect()
    assert sorted(tuple(r) for r in spark.table("reverts").collect()) == sorted((r["user_id"], r["event_id"], r["n_between"]) for r in batch) != []


def test_upserts_survive_a_repeated_batch(spark, tmp_path):
    src, stream = arriving(spark, tmp_path)
    want = src.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id").collect()
    drained(sessions.upsert_latest(stream, f"{tmp_path}/out", f"{tmp_path}/ck"))
    drained(sessions.upsert_latest(stream, f"{tmp_path}/out", f"{tmp_path}/ck"))  # nothing new
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    got = spark.read.parquet(f"{tmp_path}/out/{last}").select("user_id", "event_id").collect()
    assert last == 3 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sql_functions_and_command_line(spark, tmp_path, capsys):
    from parley.__main__ import main
    from parley.functions import registered, text

    assert "wikitext_visible" in registered.register_functions(spark)
    row = spark.sql("SELECT wikitext_visible('[[a|b]] c') AS v, comparison_tokens(\"can't 5\") AS t, structural_flags('~~') AS f, text_simhash('one two three four') AS h").first()
    assert (row["v"], row["t"], row["f"], row["h"]) == ("b c", ["can", "n't", "5"], ["dangling_tilde"], text.simhash64_trigrams("one two three four".split()))
    assert main(["list"]) == 0 and "annotation_export\tsql" in capsys.readouterr().out
    assert main(["run", "counts_by_type", SF, f"{tmp_path}/o", "--format", "json"]) == 0
    assert spark.read.json(f"{tmp_path}/o").count() == 5
