from pyspark.sql import functions as F

from cardflow.llm import decontamination as dc

ITEM = "In the garden old Peter planted 12 apple trees and then 7 pear trees, how many trees did Peter plant there over 3 days?"
OTHER = "In the garden old Maria planted 25 apple trees and then 9 pear trees, how many trees did Maria plant there over 4 days?"
MIXED = "In the garden old Maria planted 25 apple trees and then 9 pear trees, how many trees did Anton plant there over 4 days?"
FILL = "some quite ordinary words that no question has ever had in it before now. "


def marked(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string, coverage string, extra int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in dc.mark(df, bench).collect()}


def test_copies_and_new_parameters_are_found(spark):
    texts = [ITEM, FILL * 3 + ITEM + " " + FILL, FILL + OTHER, FILL * 50, None, "", ITEM.upper(), "in the garden " * 9,
             ITEM.replace("garden", "park"), FILL * 20_000 + ITEM, "12 7 3 Peter " * 30]
    got = marked(spark, [(i, t, "x", 1) for i, t in enumerate(texts)], [(4, ITEM), (9, "unrelated text about the sea and ships and sand at noon"), (5, None), (6, "")])
    assert [got[i].contaminated for i in range(len(texts))] == [True, True, True, False, False, False, True, False, True, True, False]
    assert got[2].item_id == 4 and got[2].n_items == 1 and got[0].coverage == 1.0 and got[0].extra == 1


def test_slots_must_be_consistent(spark):
    # Peter became both Maria and Anton: windows that hold both slots in one run do not agree.
    got = marked(spark, [(1, OTHER, "", 0), (2, MIXED, "", 0)], [(1, ITEM)])
    assert got[1].contaminated and not got[2].contaminated


def test_windows_of_slots_need_equal_values(spark):
    item = "given 1 2 3 4 5 6 7 and 8 9 10 11 12 13 add them"
    got = marked(spark, [(1, item, "", 0), (2, item.replace("1", "4"), "", 0)], [(1, item)])
    assert got[1].contaminated and not got[2].contaminated


def test_short_items_and_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(dc, "MAX_BROADCAST_WINDOWS", 0)
    got = marked(spark, [(1, "so what is 2 plus 2 then", "", 0), (2, "so what is 3 plus 2 then", "", 0), (3, "what is", "", 0)],
                 [(1, "what is 2 plus 2"), (2, ITEM)])
    assert [got[i].contaminated for i in (1, 2, 3)] == [True, False, False]


def test_ties_repeats_and_empty_tables(spark):
    got = marked(spark, [(1, ITEM, "", 0), (1, ITEM, "", 0)], [(7, ITEM), (3, ITEM)])
    assert (got[1].item_id, got[1].n_items) == (3, 2)
    df = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, FILL)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert dc.mark(df, bench).count() == 3 and dc.mark(df, bench.limit(0)).filter("contaminated").count() == 0
    assert dc.mark(df.limit(0), bench).count() == 0
    assert [r.doc_id for r in dc.cleaned(df, bench).collect()] == [2] and dc.cleaned(df, bench.limit(0)).count() == 3


def test_planted_passages_match_brute_force(spark):
    import re

    d = "/root/testdata/sf0.001"
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for r in dc.mark(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect():
        assert r.contaminated == any(i in norm(r.text) for i in items), r.doc_id


def test_names_at_the_start_of_sentences(spark):
    item = "Anna buys 3 pens. Anna pays 4 euros each. How much does Anna pay?"
    once = "Anna walks along the river with her old dog. Peter follows them home in the rain. Where do they all sleep at night?"
    texts = [item, FILL + item.replace("Anna", "Boris"), FILL + item.replace("Anna", "Boris").replace("3", "6"),
             once.replace("Anna", "Olga").replace("Peter", "Ivan"), f'"{once.replace("Anna", "Olga")}"', FILL * 3]
    got = marked(spark, [(i, t, "", 0) for i, t in enumerate(texts)], [(1, item), (2, once)])
    assert [got[i].item_id for i in range(len(texts))] == [1, 1, 1, 2, 2, None]


def test_title_case_copies(spark):
    got = marked(spark, [(1, FILL + ITEM.title(), "", 0), (2, (FILL * 2).title(), "", 0), (3, ITEM, "", 0)], [(1, ITEM)])
    assert got[1].contaminated and got[1].coverage == 1.0 and not got[2].contaminated
    assert marked(spark, [(1, FILL + ITEM, "", 0)], [(1, ITEM.title())])[1].coverage == 1.0


def test_one_changed_place_leaves_the_other_windows(spark):
    one = ITEM.replace("did Peter", "did Pete")
    fruit = "Anna has 2 apples and 2 pears in her bag. How many pieces of fruit does Anna have in the bag?"
    other = fruit.replace("2 apples", "3 apples").replace("2 pears", "5 pears")
    got = marked(spark, [(1, FILL + one, "", 0), (2, FILL + other, "", 0), (3, MIXED, "", 0)], [(1, ITEM), (2, fruit)])
    assert (got[1].item_id, got[2].item_id, got[3].item_id) == (1, 2, None) and got[1].coverage == 11 / 17


def test_long_runs_count_whatever_the_share(spark):
    words = [f"{a}{b}" for a in ("lo", "ma", "ni", "pu", "re", "so") for b in ("bal", "cer", "dor", "fin", "gul", "hap", "jas", "kem", "lix", "mon")][:59]
    run = " ".join(words[15:45])
    short = " ".join(words[15:27])
    got = marked(spark, [(1, FILL + run + " and " + FILL, "", 0), (2, FILL + short + " and " + FILL, "", 0)], [(1, " ".join(words))])
    assert got[1].contaminated and got[1].coverage == 23 / 52 and not got[2].contaminated


def test_long_white_space_is_linear(spark):
    """A text with a run of a million line feeds takes seconds, and is read as before."""
    import time

    text = "Anna said." + "\n" * 1_000_000 + ITEM + " \t" * 200_000 + "so"
    begin = time.time()
    got = marked(spark, [(1, text, "", 0), (2, "so" + " \n" * 300_000 + "now", "", 0)], [(1, ITEM)])
    assert got[1].contaminated and not got[2].contaminated and time.time() - begin < 60
    odd = ["A b", "  A", "x. B", "x.B", "x \n B", "x\n\nB", "x  B", "x.\n B", "É\nÈ", " \n A"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    assert [r[0] for r in df.select(dc.tokens(df["text"])).collect()] == [
        ["\x01A", "b"], ["\x01A"], ["x", "\x01B"], ["x", "B"], ["x", "\x01B"], ["x", "\x01B"], ["x", "B"], ["x", "\x01B"], ["\x01É", "\x01È"], ["\x01A"]]


def test_tiny_items_mark_nothing_and_ids_may_be_texts(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat yes"), (2, FILL + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([("mmlu-1", "Yes"), ("mmlu-2", "the cat"), ("z", ITEM), ("mmlu-3", ITEM)], "item_id string, text string")
    got = {r.doc_id: r for r in dc.mark(docs, items).collect()}
    assert not got[1].contaminated and (got[2].item_id, got[2].n_items) == ("mmlu-3", 2)
    assert [r.doc_id for r in dc.cleaned(docs, items).collect()] == [1]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, 5, "a", 6, 7), (2, FILL, 8, "b", 9, 10)],
                                 "doc_id long, text string, h1 int, h2 string, best int, `a.b` int")
    items = spark.createDataFrame([(4, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in dc.cleaned(docs, items).collect()] == [(2, FILL, 8, "b", 9, 10)]
    assert sorted((r.doc_id, r.h1, r.h2, r.best, r["a.b"], r.item_id) for r in dc.mark(docs, items).collect()) == [
        (1, 5, "a", 6, 7, 4), (2, 8, "b", 9, 10, None)]


def test_readings_add_only_windows_with_new_names(spark):
    """Windows looked up are those of all three readings, and shared ones come once."""
    texts = [FILL + OTHER, "Only Anna. Bob saw Carl Dora 12 km away. then the Sea was calm, all of It. Every day", "a b", "", None,
             "\U0001d400b x \u01c5a 3 t Éa éa {a a{ Zz zz 4 kg 5 KG six seven eight", "low words only " * 5, "Every Word Is One " * 4]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for widths in ([8], [5, 8], [6]):
        each = [F.transform(dc.template_windows(F.col("text"), w), lambda x: x["h"]) for w in widths]
        got = df.select("text", dc.window_hashes(F.col("text"), widths).alias("got"), F.array_distinct(F.concat(*each)).alias("all")).collect()
        assert all(set(r["got"]) == set(r["all"]) for r in got)
        low = next(r for r in got if r["text"] == texts[6])
        assert len(low["got"]) == sum(15 - w + 1 for w in widths)
    plain = dc.window_hashes(F.col("text"), [8])._jc.toString()
    assert "array_distinct" not in plain and "slice" not in plain


def test_nothing_stays_cached(spark):
    def held():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    before, docs = held(), spark.createDataFrame([(1, ITEM), (2, FILL)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(4, ITEM)], "item_id long, text string")
    assert [r.doc_id for r in dc.cleaned(docs, benchmark).collect()] == [2]
    assert held() == before
