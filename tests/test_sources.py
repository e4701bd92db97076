"""Blob stores, blob files and settings."""

from __future__ import annotations

import hashlib

import pytest

from lodestone.sources import blobs, config

KEY = bytes(range(32))


@pytest.mark.parametrize("backend", sorted(blobs.REGISTRY))
@pytest.mark.parametrize("key", [None, KEY])
def test_blob_stores(spark, tmp_path, backend, key):
    data = [b"one", b"two" * 1000, b"", b"one"]
    rows = [(k, hashlib.sha256(d).hexdigest(), d) for k, d in enumerate(data)]
    s = blobs.store(backend, f"file://{tmp_path}/s", key)
    s.write(spark.createDataFrame(rows, "seq long, object_hash string, content binary"))
    got = {r.object_hash: bytes(r.content) for r in s.read(spark).collect()}
    assert got == {h: d for _, h, d in rows}
    if backend == "local":
        s.write(spark.createDataFrame([*rows, (9, "ff" * 32, b"new")], "seq long, object_hash string, content binary"))
        assert s.read(spark).count() == len(got) + 1
        one = s.get(spark, spark.createDataFrame([(rows[0][1],)], "object_hash string")).collect()
        assert [bytes(r.content) for r in one] == [b"one"]


def test_unknown_backend():
    with pytest.raises(ValueError):
        blobs.store("tape", "x")


def test_blob_files(spark, tmp_path):
    (tmp_path / "aa").mkdir()
    (tmp_path / "aa" / "aabb").write_bytes(b"x\0y")
    assert [(r.object_hash, bytes(r.content)) for r in blobs.files(spark, f"file://{tmp_path}").collect()] == [("aabb", b"x\0y")]


GOOD = """[global]
auth_token = abc # note
debug = true
replication_order = 3, 2,1
replication_factor = 3
[metrics]
min_threshold = 0.2
max_threshold = 0.8
[daemon.1]
host = h1
[daemon.0]
host = h0
data = /d0
[p2p]
enabled = true
fanout = 4
"""


def test_settings(tmp_path):
    path = tmp_path / "s.ini"
    path.write_text(GOOD)
    s = config.load(str(path))
    assert s.cluster.replication_order == [3, 2, 1] and s.cluster.client_side_modes == [3] and s.metrics.high == 0.8
    assert [n.host for n in s.nodes] == ["h0", "h1"] and s.peering.enabled and s.peering.fanout == 4
    assert s.storage.backend == "local" and s.storage.tombstone_retention_s == 86_400 and s.storage.root == "/d0"


@pytest.mark.parametrize("change", [("auth_token = abc # note", "auth_token ="), ("3, 2,1", "3,x"), ("3, 2,1", " , "), ("replication_factor = 3", "replication_factor = 0"), ("max_threshold = 0.8", "max_threshold = 0.1"), ("[p2p]", "[storage]\nbackend = tape\n[p2p]"), ("debug = true", "minimum_durability_factor = 4"), ("abc # note", "x" * 65)])
def test_bad_settings(tmp_path, change):
    path = tmp_path / "s.ini"
    path.write_text(GOOD.replace(*change))
    with pytest.raises(ValueError):
        config.load(str(path))


def test_collector_runs_on_its_schedule(spark, tmp_path):
    """Two sweeps over a growing folder; each sees what is there."""
    from lodestone.streaming import twins

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 0), ("b", 1)], "object_hash string, ref_count long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    swept: list[list[str]] = []

    def sweep(batch, number):
        swept.append(sorted(r.object_hash for r in batch.where("ref_count <= 0").collect()))

    stream = spark.readStream.schema("object_hash string, ref_count long").parquet(f"file://{tmp_path}/in")
    query = twins.collect_garbage(stream, sweep, every="1 second", checkpoint=f"file://{tmp_path}/check")
    query.processAllAvailable()
    spark.createDataFrame([("c", 0)], "object_hash string, ref_count long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    assert [x for x in swept if x] == [["a"], ["c"]]
