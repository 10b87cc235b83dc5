import zlib

import numpy as np
import pytest

from cardflow.llm import coder as c
from cardflow.llm import id_files
from cardflow.llm.queries import op5_token_ids
from cardflow.llm.tokens import WordEncoder, default_path, encoder


def around(blocks):
    data = b"".join(c.encode_blocks(blocks))
    out = c.decode_blocks(c.split_blocks(data))
    assert len(out) == len(blocks) and all(np.array_equal(a, b) for a, b in zip(out, blocks, strict=True))
    return data


def test_round_trips():
    rng = np.random.default_rng(0)
    u = np.uint32
    around([np.zeros(0, u)])
    around([np.array([0], u), np.zeros(0, u), np.array([2**32 - 1, 0, 65536], u), rng.integers(0, 2**32, 900).astype(u),
            np.zeros(c.BLOCK_IDS, u), rng.integers(0, 3, 700).astype(u), rng.integers(65000, 65536, 1500).astype(u)])
    around([rng.integers(0, 2 ** int(rng.integers(1, 33)), int(rng.integers(1, 120))).astype(u) for _ in range(150)])


def test_contexts_are_learned():
    rng = np.random.default_rng(1)
    follows = rng.permutation(60)
    chain = [7]
    for _ in range(4000):
        chain.append(int(follows[chain[-1]]) if rng.random() < 0.95 else int(rng.integers(0, 60)))
    chain = np.array(chain, np.uint32)
    counts = np.bincount(chain) / len(chain)
    order0 = -(counts[counts > 0] * np.log2(counts[counts > 0])).sum() * len(chain) / 8
    assert len(around([chain])) < 0.4 * order0
    assert len(around([np.tile(np.arange(500, dtype=np.uint32) * 97, 8)])) < 2500


def test_damage_is_noticed():
    data = bytearray(around([np.arange(300, dtype=np.uint32)]))
    for at in (0, 3, 5, 13, 60, len(data) - 40):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(c.Damaged):
            c.decode_blocks(c.split_blocks(bytes(bad)))
    with pytest.raises(c.Damaged):
        c.split_blocks(bytes(data[:-1]))


def test_an_id_is_one_step_of_the_range(monkeypatch):
    steps, part = [], c._Models.part
    monkeypatch.setattr(c._Models, "part", lambda self, *a: steps.append(1) or part(self, *a))
    around([np.arange(70000, 70900, dtype=np.uint32), np.zeros(400, np.uint32)])
    assert len(steps) == 2 * 900  # there and back, both blocks at a time


def test_damage_of_any_byte_is_noticed():
    data = around([np.array([5, 9, 5, 9, 5, 9, 70000, 5], np.uint32), np.zeros(0, np.uint32)])
    for at in range(len(data)):
        for bit in (1, 128):
            bad = bytearray(data)
            bad[at] ^= bit
            with pytest.raises(c.Damaged):
                c.decode_blocks(c.split_blocks(bytes(bad)))


def test_words_of_letters_are_encoded_together():
    enc = WordEncoder(default_path())
    words = ["abc!!", "ABC's.", "Éa..", "ß!", "a×", "İstanbul", "ab<|endoftext|>", "ab<|", "ab'", "ab's'", "1a.", "a-b", "µ", "ﬁn", "a\u0301",
             "中文.", "ẞX", "Zürich###", "zürich"]
    for text in [*words, " ".join(words)]:
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"zürich".encode(), b"###"} <= set(enc.known)


def test_digests_shuffle_no_ids(spark, tmp_path):
    id_files.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), f"{tmp_path}/a", default_path())
    plan = id_files.digests(spark, f"{tmp_path}/a")._jdf.queryExecution().executedPlan().toString()
    assert "ids_crc32#" in plan and " ids#" not in plan and ",ids#" not in plan


def want(rows):
    enc, start, out = encoder(default_path()), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op5_token_ids(spark, d).collect()) == want(rows)


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_files, "SEGMENT_IDS", 40)
    rows = [(3, None), (1, ""), (None, "null id"), (2, "word " * 9000), (2, "a b c"), (5, "The end. <|endoftext|> é"), (5, "The end. <|endoftext|> é")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, data int")
    id_files.write(df, f"{tmp_path}/a", default_path())
    got = sorted((tuple(r) for r in id_files.digests(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    assert got == want(rows)
    id_files.write(df.limit(0), f"{tmp_path}/b", default_path())
    assert id_files.digests(spark, f"{tmp_path}/b").count() == 0


def test_special_strings_keep_the_librarys_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    library, start, expected = Tokenizer.from_file(default_path()), 0, []
    rows = [(1, "First <|endoftext|> second."), (2, "x<|startoftext|>y <|endoftext|>"), (3, "the last")]
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    id_files.write(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/a", default_path())
    assert sorted(tuple(r) for r in id_files.digests(spark, f"{tmp_path}/a").collect()) == expected
