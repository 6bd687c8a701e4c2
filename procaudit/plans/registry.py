"""Where the query modules put their queries and the SQL that checks them, and pieces of that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from procaudit.functions.text import STOP_WORDS
from procaudit.sources.fixtures import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a query under its function's name; ``sql`` reads the derived ``tables``."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return wrap


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]+', '', 'g')"


def code(x: str) -> str:
    return digits(f"coalesce({x}, '')")


def _is_number(x: str) -> str:
    return rf"(regexp_matches({x}, '^[+-]?[0-9]*\.?[0-9]*([eE][+-]?[0-9]+)?$') AND regexp_matches({x}, '[0-9]'))"


def two_places(n: str) -> str:
    return rf"CASE WHEN abs({n} - round({n})) < 0.001 THEN CAST(CAST(round({n}) AS DECIMAL(38,0)) AS VARCHAR) ELSE regexp_replace(CAST(CAST(round({n}, 2) AS DECIMAL(38,2)) AS VARCHAR), '\.?0+$', '') END"


def canonical(x: str, default: str, percent: bool) -> str:
    raw = strip(f"coalesce({x}, '')")
    text = strip(f"replace(replace({raw}, '%', ''), ',', '.')" if percent else f"replace({raw}, ',', '.')")
    n = f"TRY_CAST({text} AS DOUBLE)"
    if percent:
        n = f"(CASE WHEN {n} > 0 AND {n} <= 1 THEN {n} * 100 ELSE {n} END)"
    return f"CASE WHEN {raw} = '' THEN '{default}' WHEN NOT {_is_number(text)} OR {n} IS NULL THEN coalesce(nullif({digits(text)}, ''), '{default}') ELSE {two_places(n)} END"


def percent(x: str) -> str:
    return canonical(x, "100", True)


def hours(x: str) -> str:
    return canonical(x, "0", False)


def number(x: str) -> str:
    raw = strip(f"replace(coalesce({x}, ''), ',', '.')")
    return rf"CASE WHEN {raw} = '' THEN '' WHEN NOT {_is_number(raw)} THEN {digits(raw)} ELSE regexp_replace(CAST(CAST({raw} AS DECIMAL(38,10)) AS VARCHAR), '\.?0+$', '') END"


def scalar(x: str) -> str:
    raw = strip(f"coalesce({x}, '')")
    return f"CASE WHEN regexp_matches({raw}, '^[0-9,.]+$') THEN {number(raw)} ELSE '' END"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g'))"


def joined(*cols: str) -> str:
    return " || ' ' || ".join(f"coalesce({c}, '')" for c in cols)


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def words(x: str) -> str:
    return f"list_filter(string_split({clean(x)}, ' '), lambda w: length(w) > 2 AND w NOT IN {STOP_SQL})"


def codes(x: str) -> str:
    """The split codes as a list, in the order of the first of each."""
    parts = f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[,+]'), lambda c: {strip('c')}), lambda c: c <> '')"
    return f"list_filter({parts}, lambda c, i: list_position({parts}, c) = i)"


def grams(x: str) -> str:
    ws = f"list_filter(string_split_regex(strip_accents(lower(coalesce({x}, ''))), '\\s+'), lambda w: w <> '')"
    one = "flatten(list_transform(range(3, greatest(3, least(5, length(w) + 2)) + 1), lambda n: list_transform(range(1, length(w) + 2 - n + 2), lambda i: substring(' ' || w || ' ', i, n))))"
    return f"flatten(list_transform({ws}, lambda w: {one}))"
