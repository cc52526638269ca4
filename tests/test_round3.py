"""Findings of the third round: odd rows and larger tables."""

from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

from brooklet import queries as store
from brooklet.functions import vectors
from brooklet.functions.vectors import hash_counts
from brooklet.operators import consolidate, ingest, reads

ORACLES = store.oracle_sql()


def folder(spark, small, path, **changed):
    """The smallest tables with some of them changed: name -> a function of the table."""
    path.mkdir()
    for table in Path(small).glob("*.parquet"):
        if table.stem in changed:
            changed[table.stem](spark.read.parquet(str(table))).coalesce(1).write.parquet(str(path / table.name))
        else:
            (path / table.name).symlink_to(table)
    return str(path)


def agree(spark, name, where):
    """The query's rows and its SQL's, as sets of strings."""
    c = duckdb.connect()
    for table in Path(where).glob("*.parquet"):
        c.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}{'/*.parquet' if table.is_dir() else ''}'")
    got = store.queries()[name](spark, where)
    sql = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, sql))


def test_ingest_dedup_has_blank_and_null_texts(spark, small, tmp_path):
    """they are rows of the query like others; a store still refuses them (test_batches)."""
    more = lambda d: d.union(d.where("doc_id < 4").withColumns({"doc_id": F.col("doc_id") + 900_000, "text": F.element_at(F.array(F.lit(""), F.lit(" \n"), F.lit(" "), F.lit(None)), (F.col("doc_id") + 1).cast("int"))}).select(d.columns))
    got, wanted = agree(spark, "ingest_dedup", folder(spark, small, tmp_path / "in", documents=more))
    assert got == wanted and sum("90000" in r for r in got) == 3  # the store has the first


def test_store_fold_takes_the_last_write(spark, small, tmp_path):
    """a mark sets updated_at also where the memory's own date is later, as an UPDATE does."""
    late = lambda d: d.withColumn("doc_id", F.col("doc_id") + 9_000)
    got, wanted = agree(spark, "store_fold", folder(spark, small, tmp_path / "in", documents=late))
    assert got == wanted


def test_messages_are_spread_over_tasks(spark, monkeypatch):
    """one file of many messages is not one task's, whatever the splits of its file."""
    monkeypatch.setattr(ingest, "SPREAD", 10_000)
    said = spark.range(0, 2000, 1, 1).select(F.lit(0).alias("run"), F.col("id").alias("message"), F.concat(F.lit("We decided to call number "), F.col("id") % 500).alias("content"))
    found = ingest.conversation_items(said)
    assert ingest._spread(said).rdd.getNumPartitions() == 6
    assert sorted(r.message for r in found.collect()) == list(range(500))


def test_pairs_block_by_block(spark, monkeypatch):
    """blocks are broadcast, vectors are not copied for each; fewer links than vectors where components are wanted."""
    monkeypatch.setattr(consolidate, "BLOCK_BYTES", 12_000)
    monkeypatch.setattr(consolidate, "PRODUCT", 500)
    r = np.random.default_rng(1)
    base = np.repeat(r.normal(size=(20, 16)), 15, 0) + 0.2 * r.normal(size=(300, 16))
    frame = spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(base)], "id long, embedding array<double>")
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    x, y = np.nonzero(np.triu(unit @ unit.T >= 0.85, 1))
    wanted = sorted(zip((3 * x).tolist(), (3 * y).tolist(), strict=True))
    assert sorted(map(tuple, consolidate.exact_pairs(frame, 0.85).collect())) == wanted
    roots = lambda pairs: sorted(map(tuple, consolidate.components(pairs).collect()))
    few = consolidate.exact_pairs(frame, 0.85, True)
    assert few.count() < len(wanted) and roots(few) == roots(spark.createDataFrame(wanted, "a long, b long"))
    planes = np.array(consolidate.hyperplanes(16)).T
    side = (base @ planes >= 0).reshape(300, 16, 8)
    met = [(3 * int(a), 3 * int(b)) for a, b in zip(x, y, strict=True) if (side[a] == side[b]).all(1).any()]
    assert roots(consolidate.lsh_pairs(frame, 0.85, 16)) == roots(spark.createDataFrame(met, "a long, b long"))


def test_entities_of_new_items_are_found_once(spark):
    """F7, F8: importance and entities come from one reading of the new texts, which ids and the commit keep."""
    rows = spark.createDataFrame([(k, f"mail bob{k}@x.org on :80{k:02d}, see #tag{k % 3}") for k in range(50)], "position long, content string")
    scored = ingest.scored(ingest.prepared(rows, score=False))
    new = ingest.numbered(scored, 5, 1.0).localCheckpoint()
    plain = new.drop(ingest.ENTITIES)
    found = reads.memory_entities(new)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, reads.memory_entities(plain).collect()))
    whole = ingest.numbered(ingest.prepared(rows), 5, 1.0)
    assert sorted(map(str, whole.collect())) == sorted(map(str, plain.collect()))


def test_embedding_in_slices(spark, monkeypatch):
    """an Arrow batch is embedded some texts at a time, with the same counts."""
    rows = spark.createDataFrame([(k, f"text number {k} of {k % 7}") for k in range(100)], "id long, content string").coalesce(1)
    whole = sorted(map(tuple, hash_counts(rows).collect()))
    monkeypatch.setattr(vectors, "TEXTS", 7)
    assert vectors.TEXTS == 7 and sorted(map(tuple, hash_counts(rows).collect())) == whole
