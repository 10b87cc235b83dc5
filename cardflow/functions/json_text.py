"""Strict JSON decoding and encoding as column expressions.

One lenient pass turns the text into ``map<string,string>``; every field is then
checked and cast on its own, in stages that each read the columns of the one
before, so that nothing is computed twice.  Costlier work sits behind ``when``
guards and runs only for the rare rows that need it:

* repeated or unknown property names,
* the source digits of money that a double cannot carry exactly,
* a variant parse where the text alone cannot tell a JSON string from a nested
  value or from a bare number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.schemas import DAY_MS, MONEY, Field

_PARSE = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_MAP = "__json"
_CLEAN = "__clean"
# A fraction of 16 digits or more, plain money, and any number: sign, whole digits, fraction digits, exponent.
_LONG = r"(?:^|[^\d.])(?=[\d.]{17})\d+[.]\d"
_SIMPLE = r"^[+-]?\d+([.]\d{1,6})?$"
_NUMBER = r"^([+-]?)(\d+)(?:[.](\d*))?(?:[eE]([+-]?\d{1,3}))?$"

# Date texts that are accepted.
_DIGITS = r"^-?\d+$"
_FULL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d{1,9})?(Z|[+-]\d{2}(:?\d{2})?)$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_SHORT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?$"
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_RFC_1123 = (r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (\d{4}) "
             r"(\d{2}:\d{2}:\d{2}) (?:GMT|UTC)?([+-]\d{2}:?\d{2})?$")
_UNUSUAL = r"^\d{4}-\d{2}-(?:29|3[01])|^[A-Z][a-z]{2}, "
_LOCAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?Z?$"
_ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"
_MIN_MILLIS, _MAX_MILLIS = -62135596800000, 253402300799999  # years 1 to 9999


def _is_json_string(value: Column, name: str) -> Column:
    """Whether one property is a string in the source text."""
    variant = F.try_variant_get(F.try_parse_json(value), f"$.{name}", "variant")
    return F.schema_of_variant(variant).eqNullSafe(F.lit("STRING"))


# Readers: value of one field from its text, null if the text does not fit.  Except
# for text fields, the text is trimmed and null where the field reads as null.
def _read_text(value: Column, text: Column, field: Field) -> Column:
    looks_nested = text.startswith("{") | text.startswith("[")
    return F.when(text.isNull() | ~looks_nested, text).when(
        _is_json_string(value, field.json), text
    )


def _read_long(value: Column, text: Column, field: Field) -> Column:
    whole = text.try_cast("bigint")
    bare_number = ~_is_json_string(value, field.json)
    return F.when(whole.isNotNull(), whole).when(
        text.isNotNull() & bare_number, text.try_cast("decimal(38,6)").try_cast("bigint")
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, and little generated code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _read_money(value: Column, text: Column, field: Field) -> Column:
    """Exact money: at most 32 whole digits and six decimals, zeros at the ends aside.

    The digits are counted on the text, as the source writes it, so nothing is rounded:
    what does not fit is refused.  Numbers that a double would change are read again as text.
    """
    # Bare fractions come as a double prints them, so the record itself is searched for long ones.
    beyond_double = (F.length(text) > 15) | F.lower(text).contains("e") | value.rlike(_LONG)
    # The last one, as of repeated names the last counts.
    source = F.regexp_extract(
        value, rf'(?s)^.*"{field.json}"\s*:\s*"?\s*([+-]?\d+(?:[.]\d*)?(?:[eE][+-]?\d+)?)\s*"?\s*[,}}]', 1)
    exact = F.when(source != "", source).when(_is_json_string(value, field.json), text)

    def digits_of(number: Column) -> Column:
        part = [F.regexp_extract(number, _NUMBER, i) for i in range(5)]
        # Place of the decimal point in the digits; zeros are put in where it lies outside.
        point = F.length(part[2]) + F.coalesce(part[4].try_cast("int"), F.lit(0))
        return F.struct(part[1].alias("sign"), F.concat(part[2], part[3]).alias("digits"), point.alias("point"))

    def padded(x: Column) -> Column:
        zeros = [F.repeat(F.lit("0"), F.least(F.greatest(n, F.lit(0)), F.lit(99)))
                 for n in (-x["point"], x["point"] - F.length(x["digits"]))]
        return F.struct(x["sign"].alias("sign"), F.concat(zeros[0], x["digits"], zeros[1]).alias("digits"),
                        F.greatest(x["point"], F.lit(0)).alias("point"))

    def cut(x: Column) -> Column:
        whole = F.ltrim(F.substring(x["digits"], F.lit(1), x["point"]), F.lit("0"))
        fraction = F.rtrim(F.substring(x["digits"], x["point"] + 1, F.length(x["digits"])), F.lit("0"))
        return F.struct(whole.alias("whole"), fraction.alias("fraction"), x["sign"].alias("sign"))

    def money(x: Column) -> Column:
        fits = (F.length(x["whole"]) <= 32) & (F.length(x["fraction"]) <= 6)
        text = F.concat(x["sign"], F.lit("0"), x["whole"], F.lit("."), x["fraction"], F.lit("0"))
        return F.when(fits, text.try_cast(MONEY))

    steps = reduce(_let, (digits_of, padded, cut, money), exact)
    slow = F.when(exact.rlike(_NUMBER), steps)
    simple = ~beyond_double & text.rlike(_SIMPLE)
    return F.when(simple, text.try_cast(MONEY)).when(text.isNotNull(), slow)


def _from_rfc_1123(text: Column) -> Column:
    """ISO text of a date such as ``Tue, 03 Jun 2008 11:05:30 GMT``; the weekday is not checked."""
    day, month, year, time, zone = (F.regexp_extract(text, _RFC_1123, i) for i in range(1, 6))
    number = F.lpad(F.floor((F.instr(F.lit(_MONTHS), month) + 2) / 3).cast("string"), 2, "0")
    return F.concat(year, F.lit("-"), number, F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), time,
                    F.when(zone == "", "Z").otherwise(zone))


def _read_instant(value: Column, text: Column, field: Field) -> Column:
    """Epoch milliseconds, ISO text or RFC 1123; the 29th to 31st of a shorter month roll over."""

    def millis_of(iso: Column) -> Column:
        return F.unix_millis(iso.try_cast("timestamp"))

    def zoned(text: Column) -> Column:
        seconds = F.regexp_replace(text, r"(T\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
        return F.when(seconds.rlike(_FULL), seconds).otherwise(F.concat(seconds, F.lit("Z")))

    def as_iso(text: Column) -> Column:
        return (F.when(text.rlike(_DAY), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(_SHORT), zoned(text))
                .when(text.rlike(_RFC_1123), _from_rfc_1123(text)))

    def rolled(iso: Column) -> Column:
        day = F.substring(iso, 9, 2)
        first = F.concat(F.substring(iso, 1, 8), F.lit("01"), F.substring(iso, 11, 40))
        late = millis_of(first) + (day.try_cast("bigint") - 1) * DAY_MS
        return F.coalesce(millis_of(iso), F.when(day.isin("29", "30", "31"), late))

    # Patterns first: a failed cast costs far more than a failed match.
    usual = (
        F.when(text.rlike(_FULL), millis_of(text))
        .when(text.rlike(_DIGITS), text.try_cast("bigint"))
        .when(text.rlike(_DAY), millis_of(F.concat(text, F.lit("T00:00:00Z"))))
        .when(text.rlike(_SHORT), millis_of(zoned(text)))
    )
    millis = F.coalesce(usual, F.when(text.rlike(_UNUSUAL), _let(_let(text, as_iso), rolled)))
    return F.when(millis.between(_MIN_MILLIS, _MAX_MILLIS), F.timestamp_millis(millis))


def _read_local_datetime(value: Column, text: Column, field: Field) -> Column:
    part = F.from_json(text, "array<int>")
    seconds = F.coalesce(F.get(part, 5), F.lit(0)) + F.coalesce(F.get(part, 6), F.lit(0)) / 1e9
    from_parts = F.try_make_timestamp_ntz(
        *[F.get(part, i) for i in range(5)], seconds.cast("decimal(16,6)")
    )
    return F.when(text.startswith("["), from_parts).when(
        text.rlike(_LOCAL), F.rtrim(text, F.lit("Z")).try_cast("timestamp_ntz")
    )


def _read_number(value: Column, text: Column, field: Field) -> Column:
    return F.when(text.try_cast("double").isNotNull(), text)


_READERS = {
    "text": _read_text,
    "long": _read_long,
    "money": _read_money,
    "instant": _read_instant,
    "local_datetime": _read_local_datetime,
    "number": _read_number,
}


def _text(field: Field) -> Column:
    """Text of one field; for scalars, blank and ``null`` count as absent."""
    text = F.col(_MAP).getItem(field.json)
    if field.kind == "text":
        return text
    trimmed = F.trim(text)
    return F.when(~trimmed.isin("", "null"), trimmed)


def _last_wins() -> Column:
    """The map with the last value of every repeated name."""
    keys, values = F.map_keys(F.col(_MAP)), F.map_values(F.col(_MAP))
    distinct = F.array_distinct(keys)
    return F.map_from_arrays(
        distinct,
        F.transform(
            distinct,
            lambda k: F.element_at(values, -F.array_position(F.reverse(keys), k).cast("int")),
        ),
    )


def decode_json(df: DataFrame, fields: tuple[Field, ...], value: str = "value") -> DataFrame:
    """Add one typed column per field, ``is_valid`` and ``reason``.

    Nothing throws: a record that cannot be decoded has ``is_valid`` false, null
    fields and a reason.  Every input column is kept unless a field has its name.
    """
    v = F.col(value)
    kept = [c for c in df.columns if c not in {f.column for f in fields}]
    texts = {f.column: f"__text_{f.column}" for f in fields}

    parsed = df.withColumn(_MAP, F.from_json(v, "map<string,string>", _PARSE))
    # As many known names as entries: neither unknown nor repeated names.
    hits = reduce(
        lambda a, b: a + b,
        [F.map_contains_key(_MAP, f.json).cast("int") for f in fields],
    )
    marked = parsed.withColumn(_CLEAN, F.coalesce(hits == F.size(_MAP), F.lit(True)))
    checked = marked.withColumn(
        _MAP, F.when(F.col(_CLEAN), F.col(_MAP)).otherwise(_last_wins())
    )
    spread = checked.select(
        *df.columns, _MAP, _CLEAN, *[_text(f).alias(texts[f.column]) for f in fields]
    )
    known = F.array(*[F.lit(f.json) for f in fields])
    unknown = F.size(F.array_except(F.map_keys(_MAP), known)) > 0
    whole = (
        F.when(v.isNull(), "null_value")
        .when(F.trim(v) == "null", "null_document")
        .when(F.col(_MAP).isNull(), "malformed_json")
        .when(~F.col(_CLEAN) & unknown, "unknown_property")
    )
    read = spread.select(
        *{c: None for c in [*kept, value]},
        *texts.values(),
        *[
            _READERS[f.kind](v, F.col(texts[f.column]), f).alias(f"__{f.column}")
            for f in fields
        ],
        whole.alias("__whole"),
    )
    reason = reduce(
        lambda acc, f: acc.when(
            F.col(texts[f.column]).isNotNull() & F.col(f"__{f.column}").isNull(),
            f"bad_{f.column}",
        ),
        fields,
        F.when(F.col("__whole").isNotNull(), F.col("__whole")),
    )
    judged = read.select(
        *kept, *[F.col(f"__{f.column}") for f in fields], reason.alias("reason")
    )
    good = F.col("reason").isNull()
    outcome = judged.select(
        *kept,
        F.struct(
            *[F.when(good, F.col(f"__{f.column}")).alias(f.column) for f in fields],
            good.alias("is_valid"),
            "reason",
        ).alias(_MAP),
    )
    # A one-element explode: filters on decoded fields stay above it.  Pushed into
    # the projections they would repeat the whole decoding once per mention.
    return outcome.select(*kept, F.explode(F.array(_MAP)).alias(_MAP)).select(
        *kept, f"{_MAP}.*"
    )


def encode_json(fields: tuple[Field, ...], *, epoch_millis: bool = False) -> Column:
    """JSON text of one record in field order, nulls included.

    Producers write dates as ISO text; typed sinks write epoch milliseconds.
    """

    def item(f: Field) -> Column:
        col = F.col(f.column)
        if f.kind == "instant" and epoch_millis:
            return F.unix_millis(col).alias(f.json)
        return col.alias(f.json)

    options = {
        "ignoreNullFields": "false",
        "timestampFormat": _ISO_MILLIS,
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    }
    return F.to_json(F.struct(*[item(f) for f in fields]), options)
