from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.streaming.snapshots import BucketedSnapshot

SCHEMA = "project_id STRING, text STRING, `extra.col` ARRAY<INT>"


def rows(spark, keys, text):
    return spark.createDataFrame([(k, text, [1]) for k in keys], SCHEMA)


def files(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(folder).rglob("*.parquet")}


def test_a_version_writes_only_the_buckets_it_touches(spark, tmp_path):
    snapshot = BucketedSnapshot(str(tmp_path / "s"), buckets=8)
    assert snapshot.latest(spark) is None
    keys = [f"p{n}" for n in range(60)] + [None]
    assert snapshot.commit(rows(spark, keys, "old"), "start") == 0
    before = files(tmp_path)
    fresh = rows(spark, ["p1"], "new")
    (bucket,) = snapshot.touched(fresh)
    mine = snapshot.read(spark, buckets=[bucket])
    assert 0 < mine.count() < 30 and mine.schema == fresh.schema
    assert snapshot.commit(mine.unionByName(fresh), "b/0", [bucket]) == 1
    after = files(tmp_path)
    assert {k: after[k] for k in before} == before
    new = [k for k in after if k not in before]
    assert all(f"version=1/bucket={bucket}/" in k or "manifest/version=1/" in k for k in new)
    assert snapshot.read(spark).count() == 62 and snapshot.read(spark, 0).count() == 61
    assert {Path(f).parent.name for f in snapshot.read(spark, buckets=[bucket]).inputFiles()} == {f"bucket={bucket}"}


def test_batches_run_again_and_failed_ones(spark, tmp_path):
    snapshot = BucketedSnapshot(str(tmp_path / "s"), buckets=4)
    snapshot.commit(rows(spark, ["a", "b", "c"], "old"), "start")
    assert snapshot.commit(rows(spark, ["a"], "twice"), "x/0", snapshot.touched(rows(spark, ["a"], ""))) == 1
    assert snapshot.commit(rows(spark, ["a", "z"], "other"), "x/0") == 1  # the batch is known
    assert snapshot.latest(spark, "x/0") == 1 and snapshot.latest(spark, "x/1") is None
    # a run that died before its manifest: its files are no version and the next run writes over them
    rows(spark, ["q"], "lost").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "s/data/version=2"))
    (tmp_path / "s/manifest/version=2/_temporary").mkdir(parents=True)
    assert snapshot.latest(spark) == 1
    want = {r.project_id for r in snapshot.read(spark).collect()}
    touched = snapshot.touched(rows(spark, ["d"], ""))
    saved = snapshot.read(spark, buckets=touched)
    assert snapshot.commit(saved.unionByName(rows(spark, ["d"], "new")), "x/1", touched) == 2
    assert {r.project_id for r in snapshot.read(spark).collect()} == want | {"d"}


@pytest.mark.parametrize("touched", [None, [0, 1, 2, 3]])
def test_emptied_and_empty_tables(spark, tmp_path, touched):
    snapshot = BucketedSnapshot(str(tmp_path / "s"), buckets=4)
    none = rows(spark, ["a"], "x").limit(0)
    assert snapshot.commit(none, "start") == 0 and snapshot.read(spark).count() == 0
    snapshot.commit(rows(spark, ["a", "b"], "x"), "one")
    assert snapshot.commit(none, "gone", touched) == 2
    assert snapshot.read(spark).count() == 0 and snapshot.read(spark, 1).count() == 2
    assert snapshot.commit(none, "nothing", []) == 3
