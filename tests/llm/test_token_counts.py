import pytest

from cardflow.llm import tokens
from cardflow.llm.token_counts import TokenRollup
from cardflow.llm.tokens import default_path, encoder, token_count
from pyspark.sql import functions as F

SCHEMA = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def totals(rollup):
    return sorted(((r.source, r.lang, r.tokenizer, r.n_docs, r.n_tokens) for r in rollup.totals().collect()), key=str)


def test_signed_changes_and_replays(spark, tmp_path):
    r = TokenRollup(spark, str(tmp_path)).create()
    assert totals(r) == []
    load = changes(spark, ("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 5, None),
                   ("insert", None, None, "v1", None, None), ("insert", "a", "en", "v2", 7, None))
    assert r.apply("1", load) and not r.apply("1", load)
    assert totals(r) == sorted([("a", "en", "v1", 2, 10), (None, None, "v1", 1, 0), ("a", "en", "v2", 1, 7)], key=str)
    assert r.apply("2", changes(spark, ("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 3, 5),
                                ("delete", "a", "en", "v2", 7, None)))
    assert totals(r) == sorted([("a", "en", "v1", 1, 3), (None, None, "v1", 1, 0)], key=str)
    assert r.apply("3", load.limit(0)) and not r.apply("3", load)


def test_batch_without_commit_does_not_count_and_is_written_over(spark, tmp_path):
    r = TokenRollup(spark, str(tmp_path)).create()
    half = spark.createDataFrame([("a", "en", "v1", 9, 99, "1")], "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch string")
    half.write.parquet(f"{tmp_path}/deltas/b-1")
    assert totals(r) == []
    r.apply("1", changes(spark, ("insert", "a", "en", "v1", 5, None)))
    assert totals(r) == [("a", "en", "v1", 1, 5)]


def test_bad_changes_fail(spark, tmp_path):
    r = TokenRollup(spark, str(tmp_path)).create()
    for op in ("upsert", None):
        with pytest.raises(Exception, match="unknown op"):
            r.apply("1", changes(spark, (op, "a", "en", "v1", 5, None)))
    assert not r.committed("1") and totals(r) == []
    with pytest.raises(ValueError):
        r.apply("a/b", changes(spark))


def test_token_counts_are_the_tokenizers(spark):
    texts = [None, "", "Don't STOP., x.. A's 12.5, naïve Σς <|endoftext|> \x1c \u00a0y. ﬁ İ.", "é. e\u0301. \u0301. ß, The The, THE."]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    enc = encoder(default_path())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", token_count(F.col("text"), default_path()).alias("n")).collect()}
    for i, t in enumerate(texts):
        want = enc.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert enc.encode(t).tolist() == want and got[i] == len(want)


def test_query_matches_brute_force(spark):
    from cardflow.llm.queries import op1_token_counts

    enc = encoder(default_path())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want, seen = {}, set()
    for r in rows:
        if r.text in seen:
            continue
        seen.add(r.text)
        lines = r.text.split("\n")
        unique = list(dict.fromkeys(lines))
        text = "\n".join(unique) if len(unique) < len(lines) else r.text
        n, k = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = n + 1, k + len(enc.tokenizer.encode(text, add_special_tokens=False).ids)
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_special_strings_are_encoded_as_the_library_does(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    texts = ["<|endoftext|>", "One. <|endoftext|> Two", "a<|endoftext|>b. <|startoftext|>, <|ENDOFTEXT|> <|endof text|>", "x\u00a0<|endoftext|>\u2003y <|endoftext|>."]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [49407] and [encoder(default_path()).encode(t).tolist() for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.n for r in df.select("i", token_count(F.col("text"), default_path()).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [len(w) for w in want]


def test_text_of_more_words_than_are_remembered(monkeypatch):
    """A long text shares words with what a worker knows and has more than it may remember."""
    monkeypatch.setattr(tokens, "CACHED_WORDS", 4000)
    enc, plain = tokens.WordEncoder(tokens.default_path()), tokens.WordEncoder(tokens.default_path())
    first = " ".join(f"word{i}." for i in range(1500))
    long = " ".join(f"word{i}." for i in range(4500))
    for text in (first, long, first, long, ""):
        assert enc.encode(text).tolist() == plain.tokenizer.encode(text, add_special_tokens=False).ids
