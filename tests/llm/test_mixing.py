from collections import Counter

import numpy as np
import pytest

from cardflow.llm import mixing as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 400)) if i % 50 else 5000
        src = None if i % 23 == 0 else "hot" if i % 3 == 0 else f"s{i % 4}"
        rows.append((i, " ".join(f"{i}_{k}" for k in range(size)) if i % 31 else None, "en", src, size))
    return spark.createDataFrame(rows + [rows[5], rows[5]], SCHEMA)


def test_targets_reshare_the_excess():
    assert m.targets([10, 90], [1, 1]) == [30.0, 70.0]
    assert m.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert m.targets([0, 5], [5, 1]) == [0.0, 5.0] and m.targets([], []) == [] and m.targets([0], [1]) == [0.0]
    many = m.targets([1, 1, 1000, 7, 500], [5, 2, 1, 5, 2])
    assert sum(many) == pytest.approx(1509) and all(t <= 3 * s + 1e-9 for t, s in zip(many, [1, 1, 1000, 7, 500], strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation_is_one(n):
    for key in (1, 99):
        out = m.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(out.tolist()) == list(range(n))
    if n > 16:
        assert out.tolist() != list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 9001])
def test_words_of_a_quota_are_those_of_its_slots(n):
    """At every size, with a short last block: no source is too large to be exact."""
    key, size = m._key(3, np.full(n, 4)), 16 * n - 5
    out = m.permuted(np.arange(n), np.full(n, n), key)
    for at in {0, n // 2, n - 1}:
        assert out[m.place_of(at, n, key[:1])] == at
    for quota in {0, 1, n // 2, n - 1, n, n + 1, 2 * n + n // 3}:
        blocks = out[np.arange(quota) % n]
        assert m.taken_by_quota(quota, size, n, 16, 3, 4) == int(np.where(blocks == n - 1, 11, 16).sum())


def test_shares_limits_and_reruns(spark):
    df = docs(spark)
    rows = m.taken(m.mix(df, block=16, shard_slots=256)).collect()
    assert len(rows) == df.count()
    words = Counter()
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size > 0 or r.taken == 0)
        words[r.source] += r.taken
    for r in rows:
        assert abs(words[r.source] - r.target) <= max(16, 0.02 * r.target)
    again = m.taken(m.mix(df.repartition(7), block=16, shard_slots=256)).collect()
    assert Counter(rows) == Counter(again)


def test_slots_keep_quotas_and_draws(spark):
    plan = m.mix(docs(spark), block=16, shard_slots=256)
    slots = plan.slots.collect()
    assert Counter(s.src for s in slots) == Counter({i: s.quota for i, s in enumerate(plan.sources) if s.quota})
    for i, s in enumerate(plan.sources):
        own = sorted(x.n for x in slots if x.src == i)
        assert own == list(range(s.quota))
        uses = Counter(x.block for x in slots if x.src == i)
        assert not uses or max(uses.values()) <= -(-s.quota // s.n_blocks)
    per_shard = Counter(s.shard for s in slots)
    total = sum(s.quota for s in plan.sources)
    assert per_shard == Counter({k: min(256, total - 256 * k) for k in range(-(-total // 256))})


def test_mixed_texts_hold_the_words_taken(spark):
    df = docs(spark)
    plan = m.mix(df, block=16, shard_slots=256)
    got = Counter()
    mixed = m.mixed_texts(df, plan, block=16)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        own = [int(w.split("_")[1]) for w in r.text.split()]
        assert own == list(range(own[0], own[0] + len(own)))
    want = Counter()
    for r in m.taken(plan).collect():
        want[r.doc_id] += r.taken
    assert got == +want


def test_whole_runs_stay_whole():
    assert sorted(m.runs_of([(0, 4, 1), (4, 4, 2), (8, 2, 1)])) == [(0, 10), (4, 4)]
    assert list(m.runs_of([(0, 4, 1), (8, 2, 1)])) == [(0, 4), (8, 2)]


def test_empty_and_wordless_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.taken(m.mix(empty)).count() == 0 and m.mixed_texts(empty, m.mix(empty)).count() == 0
    blank = spark.createDataFrame([(None, None, None, None, None), (1, " ", None, "a", 1)], SCHEMA)
    assert [(r.size, r.source_size, r.target, r.taken) for r in m.taken(m.mix(blank)).collect()] == [(0, 0, 0.0, 0)] * 2
    clash = spark.createDataFrame([(1, "a b", "x", 5, 6)], "doc_id long, text string, source string, size int, h1 int")
    assert m.taken(m.mix(clash)).first().taken == 2
