"""The prefix trie against a plain dictionary of prefixes, also cut into tiny shards."""

import hashlib
import random
import zlib

import pytest

from cardflow.llm import forward, queries, trie
from tests.conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows (conv_id, turn, role, text) to the nodes of the trie."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members, ends = {(): []}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    if not own:
        return []
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + ((len(convs) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items())


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, trie.trie(df, **settings).collect())) == brute(rows)


def made(seed, convs, longest):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(convs * 3), convs):
        for turn in range(rng.randint(1, longest)):
            out.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "yes", "è x"])))
    rng.shuffle(out)
    return out


def test_query_equals_dictionary(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op13_prefix_trie(spark, DATA)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, df.collect())) == brute(rows)


def test_odd_rows(spark):
    """Null and repeated turns, nulls in all columns, absent heads, copies, silent conversations."""
    rows = [
        (None, 0, "user", "lost"), (100, None, None, None), (100, 0, "user", ""), (100, 0, "user", ""), (100, 1, None, "x"),
        (101, 0, "user", "own"), (102, 5, "user", "z" * 200_000), (102, 4, "a", "z" * 200_000), (103, 1, "user", "own"),
        (250, 0, "user", "head is absent"), (251, 0, "u", "one"), (252, 0, "u", "one"), (253, 0, "u", "one"), (254, 0, "u", "one"),
        (0, 0, "user", "hi"), (1, 0, "us", "erhi"), (2, 0, "user", "hi"), (3, 0, "user:", "hi"), (99, 1, "user", "hi"), (99, 0, "q", "é"),
    ]
    check(spark, rows)


def test_extra_columns_and_no_rows(spark):
    rows = [(1, 0, "a", "x", 9, "k", 8), (2, 0, "a", "x", 9, "k", 8)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, pos int, key string, depth int")
    assert sorted(map(tuple, trie.trie(df).collect())) == brute([r[:4] for r in rows])
    assert trie.trie(df.limit(0)).collect() == []
    assert trie.trie(df.withColumn("conv_id", df["conv_id"] * None)).collect() == []


@pytest.mark.parametrize("shard_rows, queue_rows", [(7, 100_000), (25, 3)])
def test_tiny_shards_and_queues(spark, shard_rows, queue_rows):
    """Conversations, keys and the tree itself spread over many ranges; queues spill."""
    rows = made(1, 60, 9) + [(400, t, "user", str(t % 3)) for t in range(60)] + [(c, 0, "u", "same") for c in range(500, 560)]
    check(spark, rows, shard_rows=shard_rows, queue_rows=queue_rows)


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "_PIECE", 5)
    check(spark, [(c, 0, "u", "same") for c in range(1000, 1300)], shard_rows=40)


def test_ties_by_hash_are_stable(spark):
    """Texts with equal heads in one turn keep the same order in every run and partitioning."""
    rows = [(7, 0, "u", "p" * 64 + str(i)) for i in range(12)] * 2
    first = sorted(map(tuple, trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()))
    again = sorted(map(tuple, trie.trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(4), shard_rows=5).collect()))
    assert first == again and len(first) == 25


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_queue_pops_in_order(limit):
    rng = random.Random(limit)
    queue, plain = forward.SpillingQueue(2, limit), []
    for _ in range(3000):
        if plain and rng.random() < 0.4:
            assert queue.peek() == min(plain)
            plain.remove(min(plain))
            queue.pop()
        else:
            item = (rng.randint(-50, 50), rng.randint(0, 5))
            queue.push(item)
            plain.append(item)
    assert [queue.pop() for _ in plain] == sorted(plain) and queue.peek() is None


def test_forward_over_a_random_tree(spark):
    """Subtree sums of a chain-structured tree cut into many shards, with roots of roots."""
    rng = random.Random(5)
    chains = {0: (0, 8, None)}
    for name in range(1, 400):
        up = rng.choice(list(chains))
        first, last, _ = chains[up]
        depth = rng.randint(first, last) + 1
        chains[name] = (depth, depth + rng.choice([0, 0, 1, 30]), up)
    tree = {}
    for name, (first, last, up) in chains.items():
        for d in range(first, last + 1):
            tree[name, d] = (((up if d == first else name), d - 1) if d else (None, None))
    own = {n: (rng.randint(0, 1), rng.randint(0, 9)) for n in tree}
    total = {n: list(v) for n, v in own.items()}
    for n in sorted(tree, reverse=True):
        if tree[n][0] is not None:
            for i in (0, 1):
                total[tree[n]][i] += total[n][i]
    df = spark.createDataFrame([(*n, *tree[n], *own[n]) for n in tree],
                               "name long, depth long, up_name long, up_depth long, leaves long, saved long")
    found = forward.totals(df, shard_rows=50, queue_rows=10).collect()
    assert {(r["name"], r["depth"]): [r["leaves"], r["saved"]] for r in found} == total
