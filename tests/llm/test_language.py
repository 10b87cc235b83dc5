import numpy as np
import pytest
from pyspark.sql import functions as F

from cardflow.llm import language as lang
from cardflow.llm.queries import op6_language_id


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 20])
def test_codewords_are_far_apart(k):
    code = lang.codewords(k)
    apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert len(code) == k and min(apart) >= (2 ** (k - 2) if k <= 5 else 3) and (np.abs(code.sum(axis=0)) < k).all()


def test_a_wrong_bit_is_corrected():
    code = lang.codewords(5)
    model = lang.Model(tuple("abcde"), code, np.eye(lang.DIM, code.shape[1], dtype=np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    x = np.zeros((1, lang.DIM), np.float32)
    x[0, : code.shape[1]] = 3 * code[2]
    x[0, 4] *= -1
    best, score, unsure = model.predict(x)
    assert best[0] == 2 and score[0] > 0.9 and not unsure[0]
    x[0, : code.shape[1]] = 3 * (code[2] + code[3]) / 2
    assert model.predict(x)[2][0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "12 !? 7", "en", 1), (4, "é" * 300_000, None, 1), (5, "a", "fr", 1), (5, "a", "fr", 1)],
                                 "doc_id long, text string, lang string, score int")
    model = lang.fit(docs, F.lit(True))
    out = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(docs, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] in ("en", "fr") and lang.identify(docs, model).count() == 6
    only = lang.fit(docs.filter("lang = 'fr'"), F.lit(True))
    assert lang.identify(docs, only).filter("doc_id = 5").first().lang_pred == "fr"
    assert lang.fit(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in lang.identify(docs, None).collect()} == {"und"}
    assert lang.identify(docs.limit(0), model).count() == 0
