"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one
bit per failed rule.  Policies are versioned sets of rules, applied to the
ledger with bitwise operations alone; ablations are counted from the failure bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.text import NOT_SPACE, let, windows, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


@dataclass(frozen=True)
class Rule:
    """``failed`` is an SQL condition on the measurements; ``bit`` never changes its meaning."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "shouting", "100 * n_upper > 30 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(r.name for r in RULES))


def repeated_positions(found: Column) -> Column:
    """Start positions, ascending, of windows that occur twice or more."""

    def marked(order: Column) -> Column:
        hit = F.filter(order, lambda x, i: (x["h"] == F.get(order, i - 1)["h"])
                       | F.coalesce(x["h"] == F.get(order, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    return let(F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)


def repeat_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, first ones included."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def counted(found: Column) -> Column:
        # Texts without a repeat, nearly all of them, need no sort.
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(
            let(repeated_positions(found), covered))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return let(let(hashes, lambda h: windows(h, WINDOW)), counted)


def measure(text: Column) -> Column:
    """Struct of MEASURES, all long; zeros for a null text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACE)))
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        let(words(text), of_words).alias("w"),
        let(F.coalesce(lines, F.array().cast("array<string>")), of_lines).alias("l"),
        F.coalesce(symbols, F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(upper, F.lit(0)).cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` but the text, the measurements and ``fail_bits``.

    Null and empty texts have zero measurements.  One row per input row, repeated ids
    included; columns that clash with the ledger's are replaced.
    """
    own = {*MEASURES, "fail_bits", "_m", text}
    kept = [c for c in docs.columns if c not in own]
    measured = docs.select(*kept, measure(F.col(text)).alias("_m")).select(
        *kept, *[F.col(f"_m.{p}{m}").alias(m) for m, p in (
            ("n_words", "w."), ("word_chars", "w."), ("n_symbols", ""), ("n_lines", "l."),
            ("n_dup_lines", "l."), ("n_repeat_words", "w."), ("n_upper", ""))],
    )
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def failed(policy: Policy, bits: str = "fail_bits", rules: tuple[Rule, ...] = RULES) -> Column:
    """Does a document fail any rule of the policy?"""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def ablations(marked: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that would
    be kept without it.  Documents are first counted by their failure bits."""
    mask = policy.mask(rules)
    patterns = marked.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                       for r in rules if r.name in policy.rules])
    each = patterns.select("bits", "count", F.explode(listed).alias("r")).select("bits", "count", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.lit(mask).cast("long") - F.col("bit"))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("count")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
    ).select(F.lit(policy.version).alias("policy"), "rule", "n_failed", "n_only", "n_kept_without")
