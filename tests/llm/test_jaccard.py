import random

import pytest

from cardflow.llm import jaccard as j
from cardflow.llm.components import components


def brute(rows, percent=90, width=3):
    sets = []
    for _, t in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (t or "").translate({i: " " for i in range(9, 14)}).split(" ") if x]
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    ids = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), ids[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, node string")
    return sorted(((r.doc_id, r.n, r.root_id) for r in j.groups(df).collect()), key=str)


def corpus(seed, size=220):
    rng, rows = random.Random(seed), []
    for i in range(size):
        if rows and rng.random() < 0.7:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("abcdefgh") + str(rng.randint(0, 50))
        else:
            w = [rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(rng.randint(3, 160))]
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_large_groups_over_many_pages_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(j, "PAGE", 4)
    monkeypatch.setattr(j, "TWIG", 2)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    assert got(spark, rows) == brute(rows)


def test_contract_edges(spark):
    rows = [(9, None), (8, ""), (7, " \n\t"), (6, "One"), (5, "one"), (4, "two words"), (3, "TWO\x0bwords"), (2, "two words here"),
            (1, "a b c d"), (1, "a b c d"), (0, "É b"), (10, "é b"), (None, "a b c d"), (None, "lonely text of null id"), (11, "q " * 300_000)]
    assert got(spark, rows) == brute(rows)


def test_threshold_is_exact(spark):
    base = [f"t{i}" for i in range(21)]  # 19 shingles; one word at the end costs one on either side
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["z"])), (3, " ".join(base[:10] + ["z"] + base[11:]))]
    assert got(spark, rows) == [(1, 19, 1), (2, 19, 1), (3, 19, 3)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert j.groups(df).count() == 0


def test_bounds_never_drop_a_link():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 400))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.97], rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        maps = [j.bitmaps(v) for v in (a, b)]
        x, y = (tree.view(np.uint64)[None] for tree, _ in maps)
        odd = [j.folded(own, j.TREE_BITS // 8).view(np.uint64)[None] for _, own in maps]
        low = [np.bitwise_count(v).sum(axis=1).astype(np.int64) for v in (x, y)]
        n = np.array([len(a)]), np.array([len(b)])
        for percent in (90, 80):
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert j._possible(*n, x, y, *low, percent)[0]
                assert j._alike(*n, *odd, percent)[0]


def test_parity_bitmaps_tell_full_sets_apart():
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.concatenate([a[400:], rng.integers(0, 2**63, 400).astype(np.uint64)])
    n = np.array([2000])
    (x, own_x), (y, own_y) = j.bitmaps(a), j.bitmaps(b)
    x, y = (v.view(np.uint64)[None] for v in (x, y))
    assert j._possible(n, n, x, y, *(np.bitwise_count(v).sum(axis=1).astype(np.int64) for v in (x, y)), 90)[0]
    assert not j._alike(n, n, *(j.folded(v, j.TREE_BITS // 8).view(np.uint64)[None] for v in (own_x, own_y)), 90)[0]


@pytest.mark.parametrize("fan, partitions", [(1, 1), (1, 5), (2, 3), (4, 40)])
def test_traversal_meets_all_pages_of_a_tree(spark, fan, partitions, monkeypatch):
    """Every pair of leaves on different pages that may link comes out, whatever levels lie above."""
    import numpy as np

    monkeypatch.setattr(j, "FAN_BITS", fan)
    rng = np.random.default_rng(fan + partitions)
    rows, page, sets = [], 0, {}
    for token in (3, 4, 5):
        sizes = sorted(int(v) for v in rng.integers(20, 60, 60))
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        for i, n in enumerate(sizes):
            if i % 3 == 0:
                page += 1
                if rng.random() < partitions / 20 and (page >> 40) < partitions:
                    page = ((page >> 40) + 1) << 40
            s = base[:n].copy()
            s[rng.random(n) < 0.04] += np.uint64(1 << 45)
            tree, own = j.bitmaps(s)
            node = len(rows)
            sets[node] = (token, page, n, own)
            rows.append((token, page, n, node, node // 2, *tree.view(np.int64).tolist(), *own.view(np.int64).tolist()))
    names = ["token", "page", "n", "node", "root", *j.TREE, *j.ODD]
    leaves = spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"{c} long" for c in names))
    found = sorted(map(tuple, j.across_pages(leaves, 90).collect()))
    expected = [
        (u, v) for u in sets for v in sets
        if u < v and sets[u][0] == sets[v][0] and sets[u][1] != sets[v][1] and u // 2 != v // 2
        and 100 * min(sets[u][2], sets[v][2]) >= 90 * max(sets[u][2], sets[v][2])
        and int(np.bitwise_count(sets[u][3] ^ sets[v][3]).sum()) * 190 <= (sets[u][2] + sets[v][2]) * 10]
    assert expected and found == expected
    assert j.across_pages(leaves.filter("false"), 90).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_five_words_at_80_percent_match_brute_force(spark, seed):
    rows = corpus(seed, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n, r.root_id) for r in j.groups(df, width=5, percent=80).collect()), key=str)
    assert found == brute(rows, 80, 5)


def test_connected_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 300 + i) for i in range(50)] + [(5, 5)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {n: find(n) for n in root}
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_pages_cut_by_row_groups_keep_their_pairs(spark):
    from pyspark.sql import functions as F

    from cardflow.session import stored

    # Ten pages of one tree, in which every two sets of a page may reach the threshold.
    leaves = spark.range(10 * j.PAGE).select(
        F.expr(f"id div {j.PAGE}").alias("page"), F.lit(50).cast("long").alias("n"), F.col("id").alias("node"), F.col("id").alias("root"),
        *[F.lit(3).cast("long").alias(c) for c in j.TREE + j.ODD]).coalesce(1)
    small = {"parquet.block.size": "2000", "spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "2000"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        leaves = stored(leaves)
        pages = leaves.withColumn("task", F.spark_partition_id()).groupBy("page").agg(F.count_distinct("task").alias("k"))
        assert pages.filter("k > 1").count() > 0
        got = sorted(map(tuple, j.traversed(leaves, 90).distinct().collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == [(u, v) for u in range(10 * j.PAGE) for v in range(u + 1, (u // j.PAGE + 1) * j.PAGE)]


def test_levels_are_planned_one_by_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(j, "FAN_BITS", 1)
    leaves = spark.range(12).select(
        F.lit(1).cast("long").alias("token"), F.col("id").alias("page"), F.lit(50).cast("long").alias("n"), F.col("id").alias("node"),
        F.col("id").alias("root"), *[F.lit(3).cast("long").alias(c) for c in j.TREE + j.ODD])
    found = j.across_pages(leaves, 90)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # the leaves of both sides
    assert sorted(map(tuple, found.collect())) == [(u, v) for u in range(12) for v in range(u + 1, 12)]
