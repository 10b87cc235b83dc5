"""Every stage of the pipeline on its own input, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from cardflow.llm.tokens import default_path, encoder

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_stage_drops_only_what_has_no_language(spark):
    odd = spark.createDataFrame([(-1, None, "en", "a", 0), (-2, "", None, None, 0), (-3, "12 34 %", "en", "a", 7)], SCHEMA)
    out = p.language_stage(spark, docs(spark).unionByName(odd), DATA)
    assert out.columns == docs(spark).columns
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {-1, -2, -3} and len(kept) == docs(spark).count()


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "x")
    rows = [(3, base, "en", "a", 1), (1, near, "en", "b", 1), (1, near, "en", "b", 1), (2, base, "en", "a", 1), (None, base, "en", "a", 1),
            (7, "other words here entirely", "en", "a", 1), (8, None, "en", "a", 1), (9, "", "en", "a", 1), (None, "alone " * 4, None, None, None)]
    out = p.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), DATA)
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 7, 8, 9, None]) and out.columns == docs(spark).columns


def test_decontamination_stage_drops_planted_passages(spark):
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {r.doc_id for r in docs(spark).collect() if not any(i in norm(r.text) for i in items)}
    assert {r.doc_id for r in p.decontamination_stage(spark, docs(spark), DATA).collect()} == want


def test_mixing_stage_takes_runs_of_the_texts(spark):
    texts = {r.doc_id: (r.text, r.text.split()) for r in docs(spark).collect()}
    out = p.mixing_stage(spark, docs(spark), DATA)
    assert out.columns == docs(spark).columns
    taken = Counter()
    for r in out.collect():
        text, words = texts[r.doc_id]
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and (r.text == text or f" {r.text} " in f" {' '.join(words)} ")
    assert all(n <= 3 * len(texts[i][1]) for i, n in taken.items())


def test_token_id_stage_equals_the_tokenizer(spark):
    some = docs(spark).filter(F.col("doc_id") < 60)
    enc, start, want = encoder(default_path()), 0, []
    for r in sorted(some.collect(), key=lambda r: r.doc_id):
        ids = [*enc.tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, p.token_id_stage(spark, some, DATA).collect())) == want


def test_empty_table_passes_all_stages(spark):
    now = docs(spark).limit(0)
    for _, stage in p.STAGES:
        now = stage(spark, now, DATA)
        assert now.count() == 0


def test_run_applies_all_stages(spark):
    out = p.run(spark, DATA)
    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_ids"]
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 150


def test_near_duplicate_stage_links_from_four_fifths_of_five_words(spark):
    from tests.llm.test_jaccard import brute, corpus

    rows, at = corpus(3), 1000
    # One word in the middle changed: 0.79 (48 words, not linked), 0.80 to 0.84, linked.
    for k, n in enumerate((48, 50, 53, 57)):
        base = [f"p{k}x{i}" for i in range(n)]
        rows += [(at, " ".join(base)), (at + 1, " ".join(base[:25] + ["z"] + base[26:]))]
        at += 2
    want = {root for _, _, root in brute(rows, percent=80, width=5)}
    assert {1000, 1001, 1002, 1004, 1006} <= want and not {1003, 1005, 1007} & want
    out = p.near_duplicate_stage(spark, spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA), DATA)
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_extra_columns_pass_all_filtering_stages(spark):
    """Columns that clash with the stages' own names keep their values."""
    extra = {"score": 42.0, "ambiguous": "q", "lang_pred": "no", "h1": 1, "h2": 2, "_words": 3, "_runs": 4, "_parts": 5,
             "_size": 6, "_rn": 7, "_p": 8, "n": 9, "root": 10, "best": 11, "kind": 12, "coverage": 13, "start": 14, "src": 15}
    now = docs(spark).select("*", *[F.lit(v).alias(c) for c, v in extra.items()])
    columns = now.columns
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == columns, name
        rows = now.collect()
        assert rows and all({c: r[c] for c in extra} == extra for r in rows), name
        now = spark.createDataFrame(rows, now.schema)
