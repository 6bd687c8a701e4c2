"""Text cleaning and assembly as Spark columns."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no weight in matching.
STOP_WORDS = (
    "a", "al", "ante", "bajo", "con", "contra", "de", "del", "desde", "el", "en", "entre", "es", "esta", "las", "la", "lo",
    "los", "para", "por", "que", "se", "sin", "su", "sus", "un", "una", "y", "o", "u", "via", "oral", "rectal", "normal",
)


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


#: What a tag is, and what is left of a cleaned text.
TAG, NOT_WORD = "<[^>]+>", "[^a-z0-9]+"


def _fold(form: str, markup: bool):
    """Combining marks dropped; with ``markup`` entities are resolved and tags blanked before. Nulls stay null."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            if markup:
                text = re.sub(TAG, " ", html.unescape(text))
            return text if text.isascii() else "".join(c for c in unicodedata.normalize(form, text) if unicodedata.category(c) != "Mn")

        return texts.map(one, na_action="ignore")

    return fold


def fold_accents(text: Column, form: str = "NFD") -> Column:
    """Combining marks dropped. ASCII texts go to Python as nulls, so only the others are copied and worked on there."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, text).otherwise(_fold(form, False)(F.when(~plain, text)))


def clean_text(text: Column) -> Column:
    """Entities resolved, tags blanked, accents dropped, lower case, only a-z and 0-9 left, single spaces. One pass of
    Python, for the texts that have an entity or are not ASCII; the others are nulls there."""
    plain = (F.length(text) == F.octet_length(text)) & ~F.contains(text, F.lit("&"))
    folded = F.when(plain, F.regexp_replace(text, TAG, " ")).otherwise(_fold("NFD", True)(F.when(~plain, text)))
    return F.coalesce(F.trim(F.regexp_replace(F.lower(folded), NOT_WORD, " ")), F.lit(""))


def content_words(cleaned: Column) -> Column:
    """The words of a cleaned text that are longer than 2 and no stop words."""
    return F.filter(F.split(cleaned, " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def squeeze_text(text: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def joined(*parts: Column) -> Column:
    """The parts with a space between each two, nulls as empty texts."""
    return F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def request_text(df_prefix: str = "", trimmed: bool = False) -> Column:
    text = joined(*[F.col(df_prefix + c) for c in ("procedimiento_sistema", "hallazgos_conclusion", "descripcion_estudio_013")])
    return strip(text) if trimmed else text


def history_text() -> Column:
    return joined(*[F.col(c) for c in ("nombre_procedimiento", "procedimiento_auditor", "hallazgo", "conclusion")])


def training_text() -> Column:
    return strip(joined(*[F.col(c) for c in ("procedimiento_auditor", "nombre_procedimiento", "hallazgo", "conclusion")]))


def code_text(text: Column, code: Column) -> Column:
    return strip(F.concat(F.lit("CODIGO_"), code, F.lit(" "), F.coalesce(text, F.lit(""))))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Every gram of ``low`` (3 at least) to ``high`` characters of each word padded with one space on both sides; a
    padded word shorter than ``low`` is one gram of its whole. Ordered by length, then place. Lower case, accents dropped in compatibility form."""
    folded = fold_accents(F.lower(F.coalesce(text, F.lit(""))), "NFKD")
    spaced = F.concat(F.lit(" "), F.regexp_replace(folded, r"\s+", "  "), F.lit(" "))

    def grams(n: int) -> Column:
        """Looks ahead at every place, so grams overlap; a space is a gram's first or last character only."""
        inside = f"{{1,{n - 2}}}" if n == low else f"{{{n - 2}}}"
        return F.regexp_extract_all(spaced, F.lit(f"(?s)(?=([^ ]{{{n}}}| [^ ]{{{n - 1}}}|[^ ]{{{n - 1}}} | [^ ]{inside} ))."), F.lit(1))

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def observation_note(note: Column, suffix: str) -> Column:
    return F.concat(F.rtrim(F.coalesce(note, F.lit("")), F.lit(".")), F.lit(suffix))
