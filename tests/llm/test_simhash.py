"""SimHash fingerprints and links against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cardflow.llm import queries, simhash
from tests.conftest import DATA


def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes, limit=4):
    """Least index reachable by links, for a list of codes."""
    label = list(range(len(codes)))

    def root(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    code = np.array(codes, np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(code[i + 1 :] ^ code[i]) <= limit):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            label[b] = a
    return [root(i) for i in range(len(codes))]


def near_codes(seed, n, centres, flips):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 2**64, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        code = code ^ np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(code)


def check(rows, texts):
    """Rows (doc_id, fp as unsigned, component) of documents 0.. with these texts."""
    expected = [slow_fingerprint(t) for t in texts]
    assert sorted(rows) == list(zip(range(len(texts)), expected, components(expected), strict=True))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    df = queries.op12_simhash_dedup(spark, DATA)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    rows = df.collect()
    assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in rows)
    assert [d["doc_id"] for d in docs] == list(range(len(docs)))
    check([(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows], [d["text"] for d in docs])


def test_odd_documents(spark):
    """Null, empty, short and long texts, copies, and columns whose names clash."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(90_000)]
    long_text = " ".join(words)
    texts = [None, "", " \t\n", "One", "one", "a b", "A  B", "a b c d", "a b c d", " x y z w", "É b c d e", "a\x1cb c d e",
             long_text, long_text + " end", long_text.upper(), "x " * 50_000]
    schema = "doc_id long, text string, fp string, first int, node int, root long, least string, code long"
    docs = spark.createDataFrame([(i, t, "f", 1, 2, 3, "l", 4) for i, t in enumerate(texts)], schema)
    rows = simhash.near_duplicates(docs).collect()
    check([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows], texts)


def test_null_ids_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "z"), (5, "a b c d"), (5, "a b c d"), (7, "q")], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(None, 5), (None, None), (5, 5), (5, 5), (7, 7)], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("node_codes", [simhash.NODE_CODES, 60])
def test_links_of_dense_codes(spark, node_codes):
    """Nodes too big for a task are filed again, and lose no link."""
    codes = near_codes(3, 1500, 6, 9).tolist()
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "code long").repartition(3)
    found = simhash.links(df, node_codes=node_codes).collect()
    place = {c: i for i, c in enumerate(codes)}
    label = simhash._joined(np.arange(len(codes)), *np.array([[place[x % 2**64] for x in r] for r in found]).T)
    assert label.tolist() == components(codes)
    assert all(((r["u"] ^ r["v"]) % 2**64) for r in found)


@given(st.integers(0, 10**6), st.integers(2, 900), st.integers(1, 30), st.integers(0, 12))
@settings(max_examples=40, deadline=None)
def test_tree_equals_brute_force(seed, n, centres, flips):
    code = near_codes(seed, n, centres, flips)
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    code = code[np.argsort(rank)]
    assert simhash.Tree(code, 4).labels().tolist() == components(code.tolist())


def test_gray_rank_and_back(spark):
    codes = near_codes(1, 200, 50, 5)
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes.tolist()], "code long")
    ranks = [r[0] for r in df.select(simhash.gray_rank(df["code"])).collect()]
    assert simhash.code_of(np.array(ranks)).tolist() == codes.tolist()
    ordered = simhash.code_of(np.arange(-(2**63), -(2**63) + 100))
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


@given(st.text(alphabet="aAbÉ \n\t.", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
