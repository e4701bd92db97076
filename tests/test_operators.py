"""Placement, state, listing and the machines against plain models and fixed cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import digests
from lodestone.operators import gather, listing, machines, placement, state
from lodestone.plans.catalog import u1_global_list
from lodestone.plans.machines import attempts
from lodestone.sources import relations as rel
from lodestone.streaming import twins

SF = "/root/testdata/sf0.001"


def plain_placement(h: str, nodes: list[tuple[int, int, int]], rf: int) -> list[int]:
    scored = []
    for node, weight, order in nodes:
        if weight > 0:
            d = hashlib.sha256(h.encode() + node.to_bytes(8, "little")).digest()
            u = (int.from_bytes(d[:4], "little") << 20 | int.from_bytes(d[28:], "little") & 0xFFFFF) / (1 << 52)
            scored.append((-(-weight / math.log(u)) if 0 < u < 1 else 0.0, order, node))
    return [n for _, _, n in sorted(scored)[:rf]]


def test_placement_model_and_blocks(spark):
    nodes = [(1, 1, 0), (2, 3, 1), (3, 0, 2), (4, -5, 3), (1 + (1 << 32), 2, 4), (7, 10, 5)]
    nd = spark.createDataFrame(nodes, "node_id long, weight int, decl_order long")
    keys = spark.createDataFrame([(f"hash-{k}",) for k in range(200)] + [("",), (None,)], "object_hash string")
    for most in (placement.MAX_NODES, 2):  # one block, and several
        got = {r.object_hash: r.placement for r in placement.place(keys, nd, 3, max_nodes=most).collect()}
        for k in range(200):
            assert got[f"hash-{k}"] == plain_placement(f"hash-{k}", nodes, 3)
        assert got[""] is None and got[None] is None
    assert len(placement.place(keys.limit(1), nd, 9).first().placement) == 4


def test_placement_hashes_a_key_once(spark):
    """Copies of a key share their digests; what is different meets every node in one task, past a block's former 4096 nodes."""
    nd = spark.range(1, 5001).select(F.col("id").alias("node_id"), (F.col("id") % 4).cast("int").alias("weight"), (-F.col("id")).alias("decl_order"))
    keys = spark.createDataFrame([(f"k{k % 5}",) for k in range(400)], "object_hash string")
    plain = {f"k{k}": plain_placement(f"k{k}", [(i, i % 4, -i) for i in range(1, 5001)], 3) for k in range(5)}
    placed = placement.place(keys, nd, 3)
    assert "Cross" not in placed._jdf.queryExecution().toString()
    got = placed.collect()
    assert len(got) == 400 and all(r.placement == plain[r.object_hash] for r in got)


def test_digests_in_arrays():
    """The first words of the digests of keys of one and of two blocks with tails of any bytes."""
    tails = [random.Random(k).randbytes(8) for k in range(50)] + [bytes(8), b"\xff" * 8]
    for size in (64, 128):
        keys = [random.Random(-k).randbytes(size) for k in range(1, 8)]
        words = digests.first_words(digests.states(keys), digests.last_block(b"".join(tails), size), digests.room())
        assert words.tolist() == [[int.from_bytes(hashlib.sha256(k + t).digest()[:4], "little") for t in tails] for k in keys]


@pytest.mark.parametrize("weights", ["alike", "few", "spread", "one heavy", "infinite"])
@pytest.mark.parametrize(("n", "rf"), [(9000, 3), (4096, 1), (40, 50)])
def test_placement_takes_few_digests_singly(monkeypatch, weights, n, rf):
    """Keys of whole hash blocks get the plain winners, with whole digests only of nodes that can be among them."""
    rng = random.Random(n)
    weight = {"alike": lambda k: 2.5, "few": lambda k: 1 + k % 3, "spread": lambda k: 10 ** rng.uniform(-1, 1), "one heavy": lambda k: 1e12 if k == 7 else 1, "infinite": lambda k: math.inf if k % 5 == 0 else 1}[weights]
    nodes = [(k * 7919 - 10**6, weight(k), k % 50) for k in range(n)]
    keys = [hashlib.sha256(b"%d" % k).hexdigest() for k in range(max(4, 20000 // n))]
    mixed = [keys[0] * 2, "short", *keys]
    tails = [(i).to_bytes(8, "little", signed=True) for i, _, _ in nodes]
    taken = []
    monkeypatch.setattr(placement, "sha256", lambda b: taken.append(1) or hashlib.sha256(b))
    run = lambda some: placement._all_winners([k.encode() for k in some], [i for i, _, _ in nodes], np.array([w for _, w, _ in nodes], float), [o for _, _, o in nodes], tails, rf)
    got = run(keys)
    if n > rf and weights in ("alike", "few"):
        assert len(taken) < len(keys) * n / 20

    def plain(h: str) -> list[int]:
        scored = []
        for node, w, order in nodes:
            d = hashlib.sha256(h.encode() + node.to_bytes(8, "little", signed=True)).digest()
            u = (int.from_bytes(d[:4], "little") << 20 | int.from_bytes(d[28:], "little") & 0xFFFFF) / (1 << 52)
            scored.append((w / math.log(u), order, node))
        return [x for _, _, x in sorted(scored)[:rf]]

    assert got == [plain(k) for k in keys]
    assert run(mixed) == [plain(k) for k in mixed]


def test_merge_computes_lists_once(spark):
    """Both uses of the lists, the sources' check and the rows, read one exchange, below which placements are hashed."""
    merged = u1_global_list(spark, SF)
    assert merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1


def test_placement_combines_copies_before_the_exchange(spark):
    """A task's copies of a key are one row of the exchange that deals keys, so a key of many copies loads no task."""
    keys = spark.range(0, 40000, 1, 4).select(F.concat(F.lit("k"), F.greatest(F.col("id") - 39990, F.lit(0)).cast("string")).alias("object_hash"))
    nd = spark.createDataFrame([(1, 1, 0), (2, 3, 1)], "node_id long, weight int, decl_order long")
    placed = placement.place(keys, nd, 1)
    assert placed.count() == 40000
    lines = placed._jdf.queryExecution().sparkPlan().toString().splitlines()
    below = next(k for k, line in enumerate(lines) if "MapInArrow" in line)
    dealt = next(k for k, line in enumerate(lines) if k > below and "Exchange" in line)
    assert any("HashAggregate" in line for line in lines[dealt:])


def test_placement_errors(spark):
    keys = spark.createDataFrame([("h",)], "object_hash string")
    nd = spark.createDataFrame([(1, 0, 0)], "node_id long, weight int, decl_order long")
    for nodes, rf in ((nd, 1), (nd.where("false"), 1), (nd, 0), (nd, -5)):
        with pytest.raises(ValueError):
            placement.place(keys, nodes, rf)


def test_plan_keeps_place_when_a_node_leaves(spark):
    keys = spark.createDataFrame([(f"k{k}",) for k in range(100)], "object_hash string")
    nd = spark.createDataFrame([(n, 1, n) for n in range(1, 7)], "node_id long, weight int, decl_order long")
    before = {r.object_hash: r.placement for r in placement.place(keys, nd, 2).collect()}
    after = {r.object_hash: r.placement for r in placement.place(keys, nd.where("node_id <> 3"), 2).collect()}
    assert all(after[k] == p for k, p in before.items() if 3 not in p)


def test_modes(spark):
    cases = [("none", 3, 5, 1), ("chain", 2, 5, 2), ("splay", 5, 2, 2), ("primary-splay", 3, 5, 3), ("chain", 3, 3, 3), ("chain", 3, 1, 1)]
    df = spark.createDataFrame([(placement.MODES[m], rf, c, want) for m, rf, c, want in cases], "m int, rf int, c int, want int")
    assert all(r[0] for r in df.select(placement.effective_durability(F.col("m"), F.col("rf"), F.col("c")) == F.col("want")).collect())
    got = spark.range(4).select(placement.downgrade(F.col("id").cast("int"), [1, 3, 2], [3, 1])).collect()
    assert [r[0] for r in got] == [0, 2, 2, 2]


def test_fold_against_a_sequential_model(spark):
    rnd, names, refs, tombs, ops = random.Random(2), {}, {}, {}, []
    paths: dict[str, str] = {}
    for seq in range(1500):
        n, h = f"n{rnd.randrange(12)}", f"h{rnd.randrange(6)}"
        if rnd.random() < 0.6:
            p = rnd.choice(("", "a", "b"))
            ops.append((seq, seq, "put", n, h, 1, p, seq))
            names[n], refs[h] = h, refs.get(h, 0) + 1
            tombs.pop(n, None)
            if p:
                paths[n] = p
        else:
            ops.append((seq, seq, "delete", n, h, 1, "", seq))
            if n in names:
                refs[names[n]] -= 1
                del names[n]
            paths.pop(n, None)
            tombs[n] = seq
    df = spark.createDataFrame(ops, "seq long, op_id long, op string, name string, object_hash string, size long, remote_path string, op_ts long")
    assert {r.name: r.object_hash for r in state.namespace(df).collect()} == names
    assert {r.name: r.deleted_at for r in state.tombstones(df).collect()} == tombs
    assert {r.name: r.remote_path for r in state.paths(df).collect()} == paths
    for bucket in (100, 10**9):
        got = state.effects(df, bucket).where("delta <> 0").groupBy("ref_hash").agg(F.sum("delta").alias("n")).collect()
        assert {r.ref_hash: r.n for r in got} == refs


def test_remote_tombstones_against_a_model(spark):
    rnd, live, tomb, ops = random.Random(3), {}, {}, []
    for seq in range(1, 800):
        n, kind = f"n{rnd.randrange(9)}", rnd.choice(("put", "delete", "apply_tombstone"))
        ts = rnd.randrange(1, 900) if kind == "apply_tombstone" else seq
        ops.append((seq, seq, kind, n, f"h{seq % 5}", 1, "", ts))
        if kind == "put":
            live[n] = f"h{seq % 5}"
            tomb[n] = 0
        elif kind == "delete" or tomb.get(n, 0) < ts:
            live[n] = None
            tomb[n] = ts
    df = spark.createDataFrame(ops, "seq long, op_id long, op string, name string, object_hash string, size long, remote_path string, op_ts long")
    got = {r.name: (r.live_hash, r.deleted_at) for r in state.with_remote_tombstones(df).collect()}
    assert got == {n: (live.get(n), tomb[n]) for n in tomb}


def catalog(spark, names):
    return spark.createDataFrame([(n, f"h{n}"[:60], 1, 1700000000123000000) for n in names], "name string, object_hash string, size long, mod_time long")


def test_listing_pages(spark):
    cat = catalog(spark, ["a.txt", "docs/f1.txt", "docs/nested/f2.txt", "src/g.go"])
    one = listing.page(cat, delimiter="/", max_keys=2)
    assert [(r.kind, r.key) for r in one.orderBy("rank").collect()] == [("K", "a.txt"), ("P", "docs/")]
    s = listing.summary(one).first()
    assert s.truncated and s.key_count == 2 and s.prefixes == 1
    two = listing.page(cat, delimiter="/", after=("P", "docs/"), max_keys=2)
    assert [(r.kind, r.key, r.truncated) for r in two.collect()] == [("P", "src/", False)]
    after = listing.page(catalog(spark, ["a.txt", "b.txt", "c.txt", "d.txt"]), after=("K", "b.txt"))
    assert [r.key for r in after.orderBy("rank").collect()] == ["c.txt", "d.txt"]
    assert listing.page(catalog(spark, ["x" * 65, "ok"])).count() == 1
    assert listing.summary(listing.page(cat.where("false"))).first().key_count == 0


def test_pages_cover_the_list(spark):
    names = sorted(f"file-{k:02d}.txt" for k in range(25))
    cat, got, after = catalog(spark, names), [], None
    for _ in range(3):
        rows = listing.page(cat, after=after, max_keys=10).orderBy("rank").collect()
        got += [r.key for r in rows]
        after = ("K", rows[-1].key)
    assert got == names and not rows[-1].truncated


def test_merge_skips_broken_sources(spark):
    rows = [(1, "photo.jpg", "abc", 1), (2, "IMG_001.jpg", "abc", 1), (2, "photo.jpg", "abc", 2), (2, "doc.txt", "def", 1), (3, "bad", "x", -1), (3, "lost", "y", 1)]
    df = spark.createDataFrame(rows, "source_rank int, name string, object_hash string, size long")
    got = {(r.name, r.object_hash, r.size) for r in gather.merge(df, F.col("size") >= 0).collect()}
    assert got == {("photo.jpg", "abc", 1), ("IMG_001.jpg", "abc", 1), ("doc.txt", "def", 1)}
    quorum = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 9, 10)], "n int").select(gather.quorum(F.col("n"))).collect()
    assert [r[0] for r in quorum] == [0, 1, 2, 2, 3, 3, 5, 6]


def test_latency_and_timeouts(spark):
    ms = machines.MS
    cases = [(0, 5000, 5000), (30, 100, 300), (1, 5000, 5000), (10_000, 1000, 5000)]
    df = spark.createDataFrame([(r * ms, t * ms, w * ms) for r, t, w in cases], "r long, t long, w long")
    assert all(x[0] for x in df.select(machines.adaptive_timeout(F.col("r"), F.col("t")) == F.col("w")).collect())
    fan = {0: 1, 1: 1, 2: 1, 3: 2, 7: 2, 20: 3, 55: 5, 100: 5, 1000: 7, 100_000: 10}
    got = spark.createDataFrame([(n,) for n in fan], "n long").select(machines.fanout(F.col("n"))).collect()
    assert [r[0] for r in got] == list(fan.values())


def test_controller_steps(spark):
    cases = [(1, 50, 50, 1), (1, 90, 50, 2), (1, 10, 10, 0), (2, 90, 90, 2), (0, 10, 10, 0), (-1, 90, 90, -1)]
    df = spark.createDataFrame([(i, float(m), float(c), w) for i, m, c, w in cases], "i int, m double, c double, w int")
    assert all(r[0] for r in df.select(machines.control_step(F.col("i"), F.col("m"), F.col("c"), 20.0, 80.0, 3) == F.col("w")).collect())
    order = ["none", "chain", "splay", "primary-splay"]
    for floor, index, want in ((0, 0, True), (2, 0, False), (1, 0, True), (2, 1, True), (3, 2, True), (3, 1, True), (4, 2, False), (4, 9, True), (4, -1, True)):
        assert spark.range(1).select(machines.floor_allows(F.lit(index), order, floor, 3, 4)).first()[0] is want


def test_limiter_batch_equals_stream_and_model(spark):
    batch = machines.fold(attempts(spark, SF), "source", ["ts", "event_id"], ["ok"], machines.limiter_zero(), lambda s, x: machines.limiter_step(s, x, machines.SECOND))
    want = {r.source: tuple(r.state) for r in batch.collect()}
    model: dict[int, tuple] = {}
    for r in attempts(spark, SF).orderBy("ts", "event_id").collect():
        model[r.source] = twins.limiter_state(model.get(r.source, (0, 0, 0, 0, 0)), r.ts, r.ok, machines.SECOND)
    assert want == model


def test_limiter_locks_after_five(spark):
    base, now, s = 10 * machines.MS, 0, (0, 0, 0, 0, 0)
    delays = []
    for _ in range(5):
        s = twins.limiter_state(s, now, False, base)
        delays.append(s[1] - now)
        now = s[1]
    assert delays[1] == 2 * delays[0] and delays[4] == machines.lockout(base) == machines.MAX_DELAY
    assert twins.limiter_state(s, now - 1, True, base)[4] == 1 and twins.limiter_state(s, now + 1, True, base)[0] == 0


def test_liveness_against_ticks(spark):
    rnd = random.Random(4)
    tick, timeout, until = 10, 25, 2000
    beats = {p: sorted(rnd.sample(range(1, 1900), 25)) for p in range(6)}
    rows = [(p, t) for p, ts in beats.items() for t in ts]
    got = {r.peer: (r.state, r.last_seen, r.left) for r in machines.replay_liveness(spark.createDataFrame(rows, "peer int, ts_ns long"), tick, timeout, until).collect()}
    for p, ts in beats.items():
        status, seen, left, at = 0, ts[0], 0, 0
        for now in range(ts[0], until + 1):
            if now % tick == 0 and now > ts[0]:
                gap = now - seen
                if status == 0 and gap > timeout:
                    status = 1
                elif status == 1 and gap > 2 * timeout:
                    status, left = 2, left + 1
            if now in ts:
                status, seen = 0, now
        assert got[p] == (status, seen, left), p


def test_raw_allocation_and_recovery(spark):
    blobs = spark.createDataFrame([("a", 5, 10), ("b", 7, 3), ("a", 9, 10), ("c", 8, 4)], "object_hash string, seq long, length long")
    got = {r.object_hash: r.offset for r in state.allocate(blobs).collect()}
    assert got == {"a": 0, "b": 10, "c": 13}
    assert state.next_offset(state.allocate(blobs)).first()[0] == 17
    assert state.next_offset(state.allocate(blobs.where("object_hash = 'a'"))).first()[0] == 0


def test_relations_have_no_nulls(spark):
    assert rel.objects(spark, SF).where("name is null or object_hash is null or size is null").isEmpty()
