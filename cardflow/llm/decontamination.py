"""Benchmark decontamination by template canonicalisation.

Texts are cut into tokens; numbers, names and units become typed placeholders.  Windows of
the resulting template are hash-joined with those of the benchmark items.  Matches
on one diagonal (the same shift between text and item) must fill the slots
consistently: windows that depart from the filling of most places (see ``filled``) don't count,
those that are equal in all slots always do.  So a question with
other numbers or names is still found.

Which capitals are names does not show everywhere: at the start of a sentence, in a title or in a text
in capitals or small letters throughout.  So items and texts have three readings each: only
capitals inside sentences are names, capitals at their start are too, or none are.  A first pass
looks up the windows of all readings by hash; slot values are compared for texts with a hit.

Windows with few tokens in common, literals or equal names and units, say little; they count only
with equal slot values.  An item is found if half of its windows match, or if a run of matching
windows has MIN_RUN tokens in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardflow.llm.text import let, row_keys, unused
from cardflow.session import stored

WINDOW = 8
MIN_LITERALS = 5
MIN_ITEM = 5
MIN_COVERAGE = 0.5
# Tokens in common of a run of windows that are enough, whatever share of the item they are.
MIN_RUN = 13
# Benchmark windows up to which they are broadcast; beyond it Spark joins by shuffle.
MAX_BROADCAST_WINDOWS = 2_000_000
# Texts with a hit up to which their keys are broadcast.
MAX_BROADCAST_ROWS = 2_000_000
# Unit tokens after a number (fixed values).
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "t", "l", "ml", "s", "ms", "h", "min", "mph", "kmh", "ft", "lb", "lbs", "oz",
         "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "meters", "metres", "percent",
         "dollars", "euros", "pounds", "%", "$", "€", "£", "°")
NUM, NAME, UNIT, MARK, GAP = "\x02num", "\x02name", "\x02unit", "\x01", "\x03"
NUMBER = r"^\p{N}"
# Names by reading: capitals inside sentences, those at their start too, none.
INSIDE, ANYWHERE, NO_NAMES = r"^\p{Lu}\p{Ll}", rf"^{MARK}?\p{{Lu}}\p{{Ll}}", None
READINGS = (INSIDE, ANYWHERE, NO_NAMES)


def tokens(text: Column) -> Column:
    """Letter runs, numbers and unit signs; a capital that starts a sentence is marked."""
    # Possessive, and tried at the start of a run of white space only: linear in any text.
    marked = F.regexp_replace(text, r"(^\s*+|(?<=[.!?:])\s++|(?<!\s)[^\S\n]*+\n\s*+)(?=\p{Lu})", "$1" + MARK)
    found = F.regexp_extract_all(
        marked, F.lit(rf"{MARK}?\p{{L}}[\p{{L}}\p{{M}}]*|\p{{N}}+(?:[.,:/]\p{{N}}+)*|[%$€£°]"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _matches(token: Column, pattern: str) -> Column:
    """Whether a token is a number or name; few regular expressions run, as most tokens start with a to z."""
    return ~((token >= F.lit("a")) & (token < F.lit("{"))) & F.rlike(token, F.lit(pattern))


def template(found: Column, names: str | None = INSIDE) -> Column:
    """Tokens with placeholders for numbers, units and what a reading takes for names."""

    def typed(t: Column, i: Column) -> Column:
        plain = F.lower(F.ltrim(t, F.lit(MARK)))
        after_number = F.coalesce(F.rlike(F.get(found, i - 1), F.lit(NUMBER)), F.lit(False))
        return (F.when(_matches(t, NUMBER), F.lit(NUM))
                .when(_matches(t, names) if names else F.lit(False), F.lit(NAME))
                .when(plain.isin(*UNITS) & after_number, F.lit(UNIT)).otherwise(plain))

    return F.transform(found, typed)


def template_windows(text: Column, width: int | None) -> Column:
    """Array of (i, h, v, literals) of all readings: place, hash of the template window, its slot
    values (a field per token, empty for literals).  Without a width, it is WINDOW or the text's own if less."""

    def of(found: Column, shape: Column) -> Column:
        size = F.least(F.size(shape), F.lit(WINDOW)) if width is None else F.lit(width)

        def window(h: Column, slots: Column, i: Column) -> Column:
            value = F.slice(slots, i, size)
            return F.struct((i - 1).alias("i"), F.xxhash64(F.slice(h, i, size)).alias("h"), F.array_join(value, GAP, "").alias("v"),
                            F.size(F.filter(value, lambda v: v.isNull())).alias("literals"))

        last = F.size(shape) - size + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(shape, lambda x: F.xxhash64(x))
        slots = F.transform(shape, lambda x, i: F.when(x.startswith("\x02"), F.lower(F.ltrim(F.get(found, i), F.lit(MARK)))))
        return let(hashes, lambda h: let(slots, lambda s: F.transform(starts, lambda i: window(h, s, i))))

    return let(tokens(text), lambda t: F.flatten(F.transform(
        F.array(*[template(t, names) for names in READINGS]), lambda s: of(t, s))))


def window_hashes(text: Column, widths: list[int]) -> Column:
    """Hashes of the template windows of all readings of a text, as in ``template_windows``.

    Readings differ at names only.  So each of them adds just its windows that hold a name the reading
    before it has not: none, capitals inside sentences, capitals at their start too.
    """

    def read(found: Column, plain: Column, names: str) -> Column:
        # A name is no number, so its placeholder replaces what the reading without names has.
        return F.zip_with(found, plain, lambda t, h: F.when(_matches(t, names), F.xxhash64(F.lit(NAME))).otherwise(h))

    def places(found: Column, names: str, known: str | None) -> Column:
        """Places of the names that are none in the ``known`` reading."""
        new = (lambda t: _matches(t, names) & ~_matches(t, known)) if known else (lambda t: _matches(t, names))
        return F.filter(F.transform(found, lambda t, i: F.when(new(t), i)), lambda i: i.isNotNull())

    def between(first: Column, last: Column) -> Column:
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def holding(at: Column, width: int, last: Column) -> Column:
        """Starts of the windows that hold one of the places, each once: from its first place on."""
        return F.flatten(F.transform(at, lambda k, j: between(
            F.greatest(k - (width - 1), F.coalesce(F.get(at, j - 1) + 1, F.lit(0)), F.lit(0)), F.least(k, last))))

    def hashed(hashes: Column, starts: Column, width: int) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + n) for n in range(width)]))

    def added(found: Column, plain: Column, names: str, known: str | None) -> Column:
        def cut(hashes: Column, at: Column) -> Column:
            return F.concat(*[hashed(hashes, holding(at, w, F.size(hashes) - w), w) for w in widths])

        return let(read(found, plain, names), lambda h: let(places(found, names, known), lambda at: cut(h, at)))

    def of(found: Column, plain: Column) -> Column:
        own = [hashed(plain, between(F.lit(0), F.size(plain) - w), w) for w in widths]
        return F.concat(*own, added(found, plain, INSIDE, None), added(found, plain, ANYWHERE, INSIDE))

    return let(tokens(text), lambda t: let(F.transform(template(t, NO_NAMES), lambda x: F.xxhash64(x)), lambda p: of(t, p)))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items: width, h, item_id, j (place), w (slot values), literals, n_windows.

    An item shorter than a window is one window of its own width.  Items of fewer than MIN_ITEM
    tokens ("Yes") would mark every text with these words: they have no window and are never found.
    """
    sized = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        "item_id", "text", F.size(tokens(F.col("text"))).alias("_n"))
    rows = sized.filter(F.col("_n") >= MIN_ITEM).select(
        "item_id", F.least("_n", F.lit(WINDOW)).alias("width"), F.greatest(F.col("_n") - WINDOW + 1, F.lit(1)).alias("n_windows"), "text")
    cut = rows.select("item_id", "width", "n_windows", F.inline(template_windows(F.col("text"), None)))
    return cut.select("width", "h", "item_id", F.col("i").alias("j"), F.col("v").alias("w"), "literals", "n_windows").distinct()


def filled(pairs: DataFrame, line: list[str]) -> DataFrame:
    """Fillings of item values that hold on a diagonal: ``line``, a, b, good (true).

    ``pairs`` are line, place, a (item's value) and b (text's).  The value that fills most places holds.
    Among several, the item's own does; else numbers are slots that only happened to be equal in the
    item, and all hold, while a name that became two others holds for neither.
    """
    counts = pairs.groupBy(*line, "a", "b").agg(F.count("*").alias("n"))
    tops = counts.groupBy(*line, "a").agg(F.max("n").alias("top"))
    best = counts.join(tops, [*line, "a"]).filter("n = top").drop("n", "top")
    ties = best.groupBy(*line, "a").agg(F.count("*").alias("k"), F.max(F.col("a") == F.col("b")).alias("own"))
    number = F.rlike("a", F.lit(NUMBER))
    holds = (F.col("k") == 1) | F.when(F.col("own"), F.col("a") == F.col("b")).otherwise(number)
    return best.join(ties, [*line, "a"]).filter(holds).select(*line, "a", "b", F.lit(True).alias("good"))


def runs(sums: DataFrame, pairs: DataFrame, line: list[str]) -> DataFrame:
    """Runs of consecutive matching windows: ``line``, first and last place, n_same (tokens of the
    run that item and text have in common).  A short item is one window of less than MIN_RUN tokens."""
    numbered = sums.withColumn("run", F.col("j") - F.row_number().over(Window.partitionBy(*line).orderBy("j")))
    spans = numbered.groupBy(*line, "run").agg(F.min("j").alias("first"), (F.max("j") + WINDOW - 1).alias("last"))
    other = pairs.filter("a <> b").select(*line, "place").distinct()
    return spans.join(other, line, "left").groupBy(*line, "first", "last").agg(
        (F.col("last") - F.col("first") + 1 - F.count_if(F.col("place").between(F.col("first"), F.col("last")))).alias("n_same"))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Contaminating items: h1, h2 (key of the row), item_id, n_matched, coverage.

    Every window of every reading of every text is looked up.  Equal rows of ``docs`` share a key.
    """
    items = stored(item_windows(benchmark))  # not cached: nobody knows when the result was read
    widths = {r["width"]: r["count"] for r in items.groupBy("width").count().collect()}
    small = sum(widths.values()) <= MAX_BROADCAST_WINDOWS
    keyed = docs.select(*row_keys(docs), F.col(text).alias("text"))
    known = items.select("h").distinct()
    met = keyed.select("h1", "h2", F.explode(window_hashes(F.col("text"), sorted(widths) or [WINDOW])).alias("h"))
    met = stored(met.join(F.broadcast(known) if small else known, "h", "left_semi").select("h1", "h2").distinct())
    keyed = keyed.join(F.broadcast(met) if met.count() <= MAX_BROADCAST_ROWS else met, ["h1", "h2"], "left_semi")
    hits = None
    for width in sorted(widths) or [WINDOW]:
        own = items.filter(F.col("width") == width).drop("width")
        each = keyed.select("h1", "h2", F.inline(template_windows(F.col("text"), width))).drop("literals")
        found = each.join(F.broadcast(own) if small else own, "h").withColumn("slots", F.arrays_zip(
            F.split("w", GAP).alias("a"), F.split("v", GAP).alias("b")))
        # Short of common tokens, the slots must be equal; a short item must be found word by word.
        held = F.filter("slots", lambda s: (s["a"] != "") & (s["a"] == s["b"]) & ~F.rlike(s["a"], F.lit(NUMBER)))
        equal = (F.col("literals") + F.size(held) >= MIN_LITERALS) if width == WINDOW else F.lit(False)
        found = found.filter(equal | (F.col("v") == F.col("w")))
        hits = found if hits is None else hits.unionByName(found)
    line = ["h1", "h2", "item_id", "n_windows", "shift"]
    hits = stored(hits.select(*line[:4], (F.col("i") - F.col("j")).alias("shift"), "j", "v", "w", "slots").distinct())
    each = hits.select(*line, "j", "v", "w", F.posexplode("slots").alias("at", "slot")).select(
        *line, "j", "v", "w", (F.col("j") + F.col("at")).alias("place"), F.col("slot.a").alias("a"), F.col("slot.b").alias("b")).filter("a <> ''")
    own_pairs = each.select(*line, "place", "a", "b").distinct()
    good = filled(own_pairs, line)
    agrees = each.filter("v <> w").join(good, [*line, "a", "b"], "left").groupBy(*line, "j", "v", "w").agg(
        F.min(F.coalesce("good", F.lit(False))).alias("good")).filter("good")
    sums = hits.filter("v = w").select(*line, "j").unionByName(agrees.select(*line, "j")).distinct()
    long = runs(sums, own_pairs, line).groupBy(*line[:4]).agg(F.max("n_same").alias("n_same"))
    counted = sums.select(*line[:4], "j").distinct().groupBy(*line[:4]).agg(F.count("*").alias("n_matched"))
    coverage = F.col("n_matched") / F.col("n_windows")
    held = counted.join(long, line[:4]).filter((coverage >= MIN_COVERAGE) | (F.col("n_same") >= MIN_RUN))
    return held.select("h1", "h2", "item_id", "n_matched", coverage.alias("coverage"))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Add contaminated, item_id (best covered, then smallest), n_items and coverage.

    Null and empty texts are clean.  All rows and columns are kept; columns of these
    names are replaced.
    """
    own = ("contaminated", "item_id", "n_items", "coverage")
    h1, h2, found = unused(docs, "h1", "h2", "best")
    best = matches(docs, benchmark, text).groupBy(F.col("h1").alias(h1), F.col("h2").alias(h2)).agg(
        F.struct(F.min(F.struct(-F.col("coverage"), "item_id"))["item_id"].alias("item_id"), F.max("coverage").alias("coverage"),
                 F.count("*").alias("n_items")).alias(found))
    kept = [c for c in docs.columns if c not in own]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *row_keys(docs, h1, h2))
    return rows.join(best, [h1, h2], "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col(found).isNotNull().alias("contaminated"), F.col(f"{found}.item_id").alias("item_id"),
        F.coalesce(f"{found}.n_items", F.lit(0)).alias("n_items"), F.col(f"{found}.coverage").alias("coverage"))


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item."""
    h1, h2 = unused(docs, "h1", "h2")
    bad = matches(docs, benchmark, text).select(F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct()
    return docs.select("*", *row_keys(docs, h1, h2)).join(bad, [h1, h2], "left_anti").drop(h1, h2)
