import random

import pytest

from cardflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    convs = {c: [(t[2:]) for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, v in convs.items():
        if any(len(o) > len(v) and o[: len(v)] == v for o in convs.values()):
            continue
        if any(o == v and d < c for d, o in convs.items()):
            continue
        out[c] = "".join(f"<|im_start|>{t[1]}\n{t[3]}<|im_end|>\n" for t in v)
    return out


def conversations(seed):
    rng, rows, base = random.Random(seed), [], []
    for c in range(60):
        turns = rng.choice(base)[: rng.randint(1, 6)] if base and rng.random() < 0.6 else []
        turns = turns + [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", None, ""])) for _ in range(rng.randint(0 if turns else 1, 3))]
        base.append(turns)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    return rows + [(None, 0, "user", "x"), (99, None, None, None), (98, 0, "user", "x"), (98, 0, "user", "x"), (97, 0, "user", "x")]


@pytest.mark.parametrize("chunk", [4096, 2])
def test_collapse_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_TURNS", chunk)
    rows = conversations(chunk)
    random.Random(1).shuffle(rows)
    got = chat.rendered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.conv_id for r in got}) == len(got) and {r.conv_id: r.text for r in got} == brute(rows)


def test_null_and_empty_texts_differ_and_order_counts(spark):
    rows = [(1, 0, "u", None), (2, 0, "u", ""), (3, 0, "u", "a"), (3, 1, "u", "b"), (4, 0, "u", "b"), (4, 1, "u", "a")]
    assert chat.maximal(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_empty_table_extra_columns_and_long_text(spark):
    assert chat.rendered(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "x" * 300_000, 5, 6)], SCHEMA + ", part int, place int")
    assert len(chat.rendered(df).first().text) == 300_000 + len("<|im_start|>user\n<|im_end|>\n")


@pytest.mark.parametrize("turn", [lambda i: i, lambda i: None, lambda i: 7])
def test_one_row_for_a_conversation_of_any_length(spark, turn):
    """More turns than a chunk has, also with null or equal numbers, are one row."""
    n = chat.CHUNK_TURNS + 104
    rows = [(1, turn(i), "u", f"{i:06d}") for i in range(n)] + [(2, turn(i), "u", f"{i:06d}") for i in range(n - 1)]
    (row,) = chat.rendered(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert (row.conv_id, row.n_turns) == (1, n) and row.text == brute(rows)[1]
