import pytest
from pyspark.sql import functions as F

from weftlink.sources import tables as IO
from weftlink.streaming.arrivals import stream_candidates

L, R = "source1_entity_id", "entity_id"


def test_tsv_keeps_text(spark, tmp_path):
    path = tmp_path / "s1.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"""Acme"" Corp"\t12 Main St, X\tUS\nS1-2\tNA\t\tUS\n')
    rows = IO.read_tsv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("S1-1", '"Acme" Corp', "12 Main St, X", "US"), ("S1-2", "NA", "", "US")]
    assert IO.check_source(IO.read_tsv(spark, str(path)), 1).count() == 2
    with pytest.raises(ValueError, match="prefix"):
        IO.check_source(IO.read_tsv(spark, str(path)), 2)
    with pytest.raises(ValueError, match="missing"):
        IO.require_columns(spark.range(1), "entity_id")


def test_id_lists(spark, tmp_path):
    path = tmp_path / "lists.tsv"
    path.write_text("﻿source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2,\n\nS1-2\t\nS1-3\n")
    assert {r["id"]: r["ids"] for r in IO.read_id_lists(spark, str(path)).collect()} == {"S1-1": ["S2-1", "S2-2"], "S1-2": [], "S1-3": []}
    path.write_text("a\tb\tc\n")
    with pytest.raises(Exception, match="more than two"):
        IO.read_id_lists(spark, str(path)).collect()


def test_cached_table_refuses_other_configuration(spark, tmp_path):
    path = str(tmp_path / "t")
    build = lambda: spark.range(3)
    assert IO.cached(spark, path, build, {"k": 1}).count() == 3
    assert IO.cached(spark, path, lambda: spark.range(9), {"k": 1}).count() == 3
    with pytest.raises(ValueError, match="another configuration"):
        IO.cached(spark, path, build, {"k": 2})


def test_half_written_table_is_built_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)  # what a run that died before its key has left
    assert IO.cached(spark, path, lambda: spark.range(3), {"k": 1}).count() == 3
    store = IO.Store(spark, str(tmp_path / "store"), {"k": 1})
    calls = []
    build = lambda: calls.append(1) or spark.range(4).selectExpr("id", "id % 2 AS country")
    assert store("a", build, by="country").count() == 4 and store("a", build, by="country").count() == 4 and len(calls) == 1
    assert store.under("deeper")("a", build).count() == 4 and len(calls) == 2
    with pytest.raises(ValueError, match="another configuration"):
        IO.Store(spark, str(tmp_path / "store"), {"k": 2})("a", build)
    assert IO.Store(spark)("a", build).count() == 4 and len(calls) == 3


def test_dataset_folders(spark, tmp_path):
    with pytest.raises(ValueError, match="no train folder"):
        IO.find_dataset(spark, str(tmp_path))
    for split in ("train", "test"):
        folder = tmp_path / "dataset" / split
        folder.mkdir(parents=True)
        for k in (1, 2, 3):
            (folder / f"source{k}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nS{k}-1\tName {k}\t1 Road\tUS\nS{k}-2\tOther\t\tFrance\n")
    root = IO.find_dataset(spark, str(tmp_path))
    assert root.endswith("/dataset") and IO.find_dataset(spark, root) == root
    rows = IO.load_sources(spark, root, "test", (2, 3), ["entity_id", "country"], IO.Store(spark, str(tmp_path / "kept")))
    assert rows.columns == ["entity_id", "country"] and {r[0] for r in rows.collect()} == {"S2-1", "S2-2", "S3-1", "S3-2"}
    ids = spark.createDataFrame([("S2-1",), ("S3-2",), ("S3-2",)], "entity_id string")
    assert [tuple(r) for r in IO.load_normalised(rows, ["entity_id"], ["US"], ids).collect()] == [("S2-1",)]
    with pytest.raises(ValueError, match="no source"):
        IO.source_path(root, "dev", 1)
    a, b = root + "/train/source1.tsv", root + "/test/source1.tsv"
    assert IO.same_files({a: b, b: root + "/test/source2.tsv"}) == {a: True, b: False}


def test_submission_roundtrip(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], f"{L} string, position int")
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-4"), ("S1-1", "S2-1")], f"{L} string, {R} string")
    IO.write_submission(pairs, pairs, s1, str(tmp_path))
    lines = [line for f in sorted((tmp_path / "matches").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("source1")]
    assert sorted(lines) == ["S1-1\tS2-1,S3-4", "S1-2\t"]
    with pytest.raises(ValueError, match="no pair"):
        IO.check_pairs(spark.createDataFrame([("S1-1", "S1-2")], f"{L} string, {R} string"), "x")
    lists = IO.id_lists(pairs, s1)
    bad = lists.union(spark.createDataFrame([("S1-9", ["S2-7", "S2-7"]), ("S1-1", ["X-1"])], lists.schema))
    found = {r["rule"]: r["problems"] for r in IO.validate(bad, lists, s1).collect()}
    assert found["matches: repeated entity"] == 1 and found["matches: unknown entity"] == 1 and found["matches: repeated id"] == 1 and found["matches: foreign id"] == 1
    assert all(v == 0 for k, v in found.items() if k.startswith("candidates"))


def test_streamed_arrivals(spark, tmp_path):
    pool = spark.createDataFrame([("S2-1", "US", "acme"), ("S2-2", "US", "crowd"), ("S2-3", "US", "crowd"), ("S2-4", "US", "")], "entity_id string, country string, name_core string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"entity_id":"S1-1","country":"US","name_core":"acme"}\n{"entity_id":"S1-2","country":"US","name_core":"crowd"}\n{"entity_id":"S1-3","country":"US","name_core":""}\n')
    arrivals = spark.readStream.schema("entity_id string, country string, name_core string").json(str(tmp_path / "in"))
    query = stream_candidates(arrivals, pool, max_group=1).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("arrived").select(L, R).collect()] == [("S1-1", "S2-1")]
    assert IO.fingerprint(pool, "entity_id").first()["n"] == 4 and F is not None


def test_stage_tables_leave_no_shuffle_files(spark):
    """A stage's shuffle files are gone when its table is there."""
    from weftlink.sources.tables import stage_table

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if (n := f.getName()).startswith("shuffle_")}
    before = shuffled()
    table = stage_table(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "grouped")
    assert not shuffled() - before
    assert table.count() == 10
