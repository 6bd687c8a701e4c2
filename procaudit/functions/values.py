"""Codes, percentages, hours and fee strings as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procaudit.functions.text import strip

#: What a plain decimal is, and what stands for a blank percentage and for blank hours.
NUMBER = r"^[+-]?[0-9]*\.?[0-9]*([eE][+-]?[0-9]+)?$"
DEFAULT_PERCENT, DEFAULT_TIME = "100", "0"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def normalize_code(code: Column) -> Column:
    return digits(F.coalesce(code, F.lit("")))


def split_codes(codes: Column) -> Column:
    """Codes between commas and plus signs, trimmed, the first of equal ones kept."""
    parts = F.transform(F.split(F.coalesce(codes, F.lit("")), "[,+]"), strip)
    return F.array_distinct(F.filter(parts, lambda c: c != ""))


def has_code(codes: Column) -> Column:
    """Whether ``split_codes`` finds any, without splitting."""
    return F.coalesce(F.rlike(codes, F.lit(r"[^,+\s]")), F.lit(False))


def _number(raw: Column, kind: str) -> Column:
    """``raw`` as a number, null where it is no plain decimal."""
    return F.when(F.rlike(raw, F.lit(NUMBER)) & F.rlike(raw, F.lit("[0-9]")), raw.try_cast(kind))


def two_places(number: Column) -> Column:
    """A whole number within .001 as such, any other with two places and no trailing zeros."""
    whole = F.round(number).cast("decimal(38,0)").cast("string")
    return F.when(F.abs(number - F.round(number)) < 0.001, whole).otherwise(F.regexp_replace(F.round(number, 2).cast("decimal(38,2)").cast("string"), r"\.?0+$", ""))


def _canonical(value: Column, default: str, percent: bool) -> Column:
    raw = strip(F.coalesce(value, F.lit("")))

    def written(text: Column) -> Column:
        number = _number(text, "double")
        words = let(digits(text), lambda d: F.when(d == "", F.lit(default)).otherwise(d))
        scaled = let(number, lambda n: F.when((n > 0) & (n <= 1), n * 100).otherwise(n)) if percent else number
        return let(scaled, lambda n: F.when(n.isNull(), words).otherwise(two_places(n)))

    dotted = lambda r: strip(F.replace(F.replace(r, F.lit("%"), F.lit("")) if percent else r, F.lit(","), F.lit(".")))
    return let(raw, lambda r: F.when(r == "", F.lit(default)).otherwise(let(dotted(r), written)))


def normalize_percent(value: Column) -> Column:
    """A fee percentage as canonical text: fractions up to 1 are hundredths, a blank or a word means 100."""
    return _canonical(value, DEFAULT_PERCENT, True)


def normalize_time(value: Column) -> Column:
    """Hours as canonical text, 0 for a blank or a word."""
    return _canonical(value, DEFAULT_TIME, False)


def normalize_number(value: Column) -> Column:
    """Canonical decimal text of up to ten places; the digits of what is no number; empty for a blank."""

    def written(raw: Column) -> Column:
        return let(_number(raw, "decimal(38,10)"), lambda n: F.when(raw == "", F.lit("")).when(n.isNull(), digits(raw)).otherwise(F.regexp_replace(n.cast("string"), r"\.?0+$", "")))

    return let(strip(F.replace(F.coalesce(value, F.lit("")), F.lit(","), F.lit("."))), written)


def normalize_scalar(value: Column) -> Column:
    """``normalize_number`` of texts that are digits, commas and points only; empty for any other."""
    raw = strip(F.coalesce(value, F.lit("")))
    return F.when(F.rlike(raw, F.lit("^[0-9,.]+$")), normalize_number(raw)).otherwise(F.lit(""))


def _last_of_each(pairs: Column) -> Column:
    """Of (k, v) structs with equal k the last one, in the order of the first."""
    return let(pairs, lambda ps: F.transform(F.array_distinct(F.transform(ps, lambda p: p["k"])), lambda k: F.element_at(F.filter(ps, lambda p: p["k"] == k), -1)))


def _pairs(text: Column, pattern: str) -> Column:
    a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("k"), y.alias("v")))


def parse_fees_lenient(fees: Column, codes: Column) -> Column:
    """(k, v) of every ``code(value)`` with both non-blank, then ``100`` for each of ``codes`` that has none."""
    found = F.transform(_pairs(F.coalesce(fees, F.lit("")), r"([^(),+]+)\(([^()]*)\)"), lambda p: F.struct(strip(p["k"]).alias("k"), strip(p["v"]).alias("v")))
    missing = lambda ps: F.array_except(codes, F.transform(ps, lambda p: p["k"]))
    return let(_last_of_each(F.filter(found, lambda p: (p["k"] != "") & (p["v"] != ""))), lambda ps: F.concat(ps, F.transform(missing(ps), lambda c: F.struct(c.alias("k"), F.lit("100").alias("v")))))


def parse_fees_numeric(fees: Column) -> Column:
    """(k, v) of every ``digits(number)``, both normalized, empty values dropped, the last of equal codes kept."""
    found = F.transform(_pairs(F.coalesce(fees, F.lit("")), r"([0-9]+)\s*\(\s*([0-9,.]+)\s*\)"), lambda p: F.struct(normalize_code(p["k"]).alias("k"), normalize_number(p["v"]).alias("v")))
    return _last_of_each(F.filter(found, lambda p: (p["k"] != "") & (p["v"] != "")))


def fee_of(fees: Column, code: Column) -> Column:
    """What ``parse_fees_numeric`` has for one ``code``: the values of the others are not looked at."""
    mine = F.filter(_pairs(fees, r"([0-9]+)\s*\(\s*([0-9,.]+)\s*\)"), lambda p: digits(p["k"]) == code)
    values = F.filter(F.transform(mine, lambda p: normalize_number(p["v"])), lambda v: v != "")
    return F.try_element_at(values, F.lit(-1))


def value_of(pairs: Column, code: Column) -> Column:
    return F.get(F.filter(pairs, lambda p: p["k"] == code), F.lit(0))["v"]


def fee_string(codes: Column, pairs: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.concat(c, F.lit("("), value_of(pairs, c), F.lit(")"))), ",")


def time_summary(times: Column) -> Column:
    """The largest of the numeric texts as canonical text, empty if none is numeric."""
    most = F.array_max(F.transform(times, lambda t: _number(strip(t), "double")))
    return F.when(most.isNull(), F.lit("")).otherwise(two_places(most))


def freq_class(n: Column) -> Column:
    return F.when(n >= 1000, "ALTA_FRECUENCIA").when(n >= 100, "MEDIA_FRECUENCIA").when(n >= 10, "BAJA_FRECUENCIA").otherwise("RARA_REVISAR")


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))
