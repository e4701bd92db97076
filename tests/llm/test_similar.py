"""Near copies by shingle sets against all pairs."""

from __future__ import annotations

import random

import brute
import pytest

import corpus_pipeline
from lodestone.llm import similar


def texts() -> list[tuple[int, str | None]]:
    rnd, out = random.Random(5), []
    common = " ".join(f"c{k}" for k in range(40))
    for g in range(12):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice((6, 25, 60, 200)))]
        for _ in range(8):
            own = list(words)
            for _ in range(rnd.randrange(0, 1 + len(own) // 40 + (g % 3))):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(400)}"
            out.append(" ".join(own) + (f" {common}" if g % 2 else ""))
    out += [None, "", "  \n", "one two", "One  two", "one three"]
    return list(enumerate(out))


@pytest.mark.parametrize("bucket", [48, 2])  # 2: many shingles count as common and go last
def test_keeps_one_of_near_copies(spark, bucket):
    rows = texts()
    want = brute.first_of_copies(rows)
    assert 20 < len(want) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one(df, bucket=bucket).collect()) == want


def test_pipeline_stage_finds_near_copies(spark):
    """The two differ in one word of a hundred: far more than two bits, but similar by 0.9."""
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "other", *words[51:]])), (3, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3]


def test_links_by_all_pairs(spark):
    """Chains of similar texts, a large group, and pairs just above and below the bound."""
    rnd, rows = random.Random(9), []
    for g in range(30):
        n = rnd.choice((5, 9, 14, 30, 45, 90))
        words = [f"g{g}w{k}" for k in range(n)]
        for _ in range(12):  # each step changes a little, so that the ends of a chain may be far apart
            at = rnd.randrange(n)
            words = [*words[:at], f"x{rnd.randrange(9)}", *words[at + 1 :]]
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, " ".join([f"big{j}" for j in range(80)] + [f"own{k}"])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute.first_of_copies(rows)
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == want


def test_shingle_sets_are_sets_of_shingles():
    import pyarrow as pa

    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["a", "A", "be", "word" * 6, "É", "\x1c", "x\u00a0y"], k=rnd.randint(0, 12))) + rnd.choice(("", "\n", "\t z")) for _ in range(300)] + [None, "", " \n"]
    sets = [frozenset(s.tolist()) for s in similar.shingle_sets(pa.array(texts))]
    for a, x in zip(texts, sets, strict=True):
        assert len(x) == len(brute.shingles(a))
    for (a, x), (b, y) in zip(zip(texts, sets, strict=True), list(zip(texts, sets, strict=True))[1:], strict=False):
        assert len(x & y) == len(brute.shingles(a) & brute.shingles(b))


def test_similar_sets_share_a_block_and_near_fingerprints():
    import numpy as np

    rnd = np.random.default_rng(8)
    for n in [*range(4, 40), 90, 141, 142, 230, 700, 3000]:
        for _ in range(20):
            m = int(rnd.integers(n, n * 5 // 4 + 1))
            both = int(rnd.integers(-(-4 * (n + m) // 9), n + 1)) if -(-4 * (n + m) // 9) <= n else None
            if both is None:
                continue
            pool = rnd.integers(0, 1 << 64, n + m, np.uint64)
            x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : n + m - both]]))
            (x_keys, y_keys) = (np.concatenate([k for k, _ in similar.block_keys(s)] or [np.empty(0, np.uint64)]) for s in (x, y))
            assert both == n == m or len(np.intersect1d(x_keys, y_keys))
            a, b = similar._folded([similar.fingerprint(x), similar.fingerprint(y)])
            assert int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * both


def test_pairs_looked_at_are_in_proportion_to_a_group(spark, monkeypatch):
    """A group about one text, most of whose pairs are just below the bound: its pairs aren't verified one by one."""
    rnd, words, rows, looked = random.Random(4), [f"w{k}" for k in range(150)], [], []
    for k in range(500):
        own = list(words)
        for _ in range(rnd.randrange(1, 7)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(400)}"
        rows.append((k, " ".join(own)))
    plain = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, *a: looked.append(pairs.count()) or plain(pairs, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == brute.first_of_copies(rows)
    assert sum(looked) <= 4 * len(rows)
