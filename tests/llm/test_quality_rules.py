import random
import re

from cardflow.llm import quality_rules as q

SPLIT = r"[\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    w = [x for x in re.split(SPLIT, t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t ", "a", "x " * 40, "𝔘 é\u00a0z\x1cq\n" * 3, "A | B <b> $5 & #x\n\n" * 4]
    for n in (7, 8, 9, 60, 400):
        out += [" ".join(rng.choice("ab") for _ in range(n)), "\n".join(rng.choice(["a b c", "d", "", " "]) for _ in range(n))]
    return out + ["w%d " % i * 9 for i in range(5)] + [" ".join(f"w{i % 5000}" for i in range(60_000))]


def test_measurements_match_brute_force(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    rows = {r.doc_id: r for r in q.ledger(df).collect()}
    for i, t in enumerate(given):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), i
        assert bool(r.fail_bits & 1) == (r.n_words < 20) and bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 30 * r.n_words)


def test_policies_and_ablations_match_brute_force(spark):
    bits = [0, 1, 2, 3, 4, 5, 12, 32, 32, 33, 8]
    marked = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in q.ablations(marked, q.FULL).collect()}
    for rule in q.RULES:
        bit, rest = 1 << rule.bit, q.FULL.mask() & ~(1 << rule.bit)
        assert got[rule.name] == (sum(b & bit > 0 for b in bits), sum(b & bit > 0 and not b & rest for b in bits),
                                  sum(not b & rest for b in bits))
    assert q.BASE.mask() == 3 and set(r.rule for r in q.ablations(marked, q.BASE).collect()) == set(q.BASE.rules)
    assert marked.filter(~q.failed(q.BASE)).count() == sum(not b & 3 for b in bits)


def test_empty_table_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 9, 9)] * 2, "doc_id long, text string, n_words int, extra int")
    out = q.ledger(df)
    assert out.columns[:2] == ["doc_id", "extra"] and [r.n_words for r in out.collect()] == [2, 2]
    assert q.ledger(df.limit(0)).count() == 0 and q.ablations(q.ledger(df.limit(0)), q.FULL).count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.001"
    kept = q.ledger(spark.read.parquet(f"{d}/documents.parquet")).withColumn("kept", ~q.failed(q.FULL))
    rows = kept.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.95 and not any(r.kept for r in rows if r.quality == 0 and r.n_words >= 60)
